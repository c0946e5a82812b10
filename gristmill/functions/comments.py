"""The comment grammars of ``directives`` for one comment, as plain functions for the worker that reads the file."""

from __future__ import annotations

import re

from ..plans.catalog import SUPPRESSIBLE, UNSCOPED

#: White space without four control characters that Python counts as such.
_W = r"[^\S\x1c-\x1f]"
_SAFETY = re.compile(r"SAFETY\s*(?:\[([^\]]*)\]\s*)?:\s*(.+)", re.S)
_IGNORE = re.compile(rf"type:{_W}*ignore(?:{_W}*\[([^\]]*)\])?(?:{_W}.*)?", re.S)
_IGNORE_LIST = re.compile(rf"type:{_W}*ignore{_W}*\[[^\]]*\]")
_INLINE = re.compile(r"type:\s*ignore\s*(?:\[([^\]]*)\]\s*)?SAFETY:\s*(.+)", re.S)
_WORD, _CODE = re.compile("[A-Za-z0-9]+"), re.compile(r"[\w-]+")
_PART = re.compile(r"""((?:[^,"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))+|,)""")
_REPORT = re.compile(r"report([A-Z][A-Za-z0-9]*)[ \t-\r\x1c-\x1f]*=[ \t-\r\x1c-\x1f]*(false|none)", re.I | re.A)
_SUPPRESSIBLE, _UNSCOPED = frozenset(SUPPRESSIBLE), frozenset(UNSCOPED)


def body_of(comment: str) -> str:
    return comment.lstrip("#").strip()


def is_directive(comment: str) -> bool:
    """One number sign, not two."""
    return comment.startswith("#") and not comment.startswith("##")


def _reason_counts(reason: str) -> bool:
    """Two words at least."""
    return len(_WORD.findall(reason)) >= 2


def listed(text: str) -> list[str]:
    """Parts between commas, without the blank ones."""
    return [p for p in map(str.strip, text.split(",")) if p]


def _valid_list(text: str | None) -> bool:
    codes = listed(text or "")
    return bool(codes) and all(map(_CODE.fullmatch, codes))


def evidence(comment: str) -> frozenset[str] | None:
    """The rules that a valid SAFETY comment counts for, null for any other comment."""
    m = _SAFETY.fullmatch(body_of(comment)) if "SAFETY" in comment and is_directive(comment) else None
    if m is None or not _reason_counts(m[2]):
        return None
    if m[1] is None:
        return _UNSCOPED
    codes = frozenset(listed(m[1]))
    return codes if codes and codes <= _SUPPRESSIBLE else None


def _bracket(body: str) -> str | None:
    """The list in the brackets of the plain form; null without brackets."""
    m = _IGNORE.fullmatch(body) if _IGNORE_LIST.match(body) else None
    return None if m is None else m[1] or ""


def type_ignore(comment: str) -> tuple[str, bool, bool] | None:
    """Norm of a type-ignore comment; does it name codes that can be ones; does it give a reason itself. Null for any other comment."""
    if "type:" not in comment or not is_directive(comment):
        return None
    body = body_of(comment)
    inline = _INLINE.fullmatch(body) if "SAFETY" in body else None
    if not (inline or _IGNORE.fullmatch(body)):
        return None
    if inline:
        sound = _valid_list(inline[1])
        reasoned = _reason_counts(inline[2])
        valid, reasoned = reasoned and sound, reasoned and (inline[1] is None or sound)
        body = body.split("SAFETY:", 1)[0].strip()
    else:
        valid, reasoned = _valid_list(_bracket(body)), False
    inside = _bracket(body)
    if not _IGNORE.fullmatch(body):
        return "type:ignore:invalid", valid, reasoned
    if inside is None:
        return "type:ignore:uncoded", valid, reasoned
    if inside.endswith(",") or ",," in inside or body.endswith(",") or not _valid_list(inside):
        return "type:ignore:invalid-codes", valid, reasoned
    return f"type:ignore[{','.join(sorted(listed(inside)))}]", valid, reasoned


def _joined(norms: list[str]) -> str | None:
    return "|".join(sorted(set(norms))) or None


def mypy_norm(comment: str) -> str | None:
    """Weakening parts of a mypy comment, sorted; null: none, or it is malformed."""
    if not comment.startswith("# mypy: "):
        return None
    pieces = _PART.findall(comment.removeprefix("# mypy: "))
    parts = [p.strip() for p in pieces if p != ","]
    # as many commas as come between parts, or one more at the end: else a part is empty
    commas = len(pieces) - len(parts)
    if parts and not parts[-1]:
        parts.pop()
    if not parts or commas > len(parts) or pieces[0] == "," or not all(parts):
        return None
    norms = []
    for p in parts:
        name, equals, value = p.partition("=")
        key = (name.strip() if equals else p.split(None, 1)[0]).replace("-", "_").lower()
        value = value.strip()
        if not key:
            return None
        if key == "ignore_errors" and value.lower() in ("", "1", "on", "true", "yes"):
            norms.append("mypy:ignore-errors")
        elif key == "disable_error_code":
            codes = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
            if not _valid_list(codes) or codes.endswith(",") or ",," in codes:
                return None
            norms.append(f"mypy:disable-error-code[{','.join(sorted(listed(codes)))}]")
    return _joined(norms)


def pyright_norm(comment: str) -> str | None:
    """Weakening parts of a pyright comment, sorted; null: none, or it is malformed. Case does not matter but is kept in names."""
    body = body_of(comment)
    if not is_directive(comment) or not body.startswith("pyright:"):
        return None
    parts = [p.strip() for p in body.removeprefix("pyright:").strip().split(",")]
    if not all(parts):
        return None
    norms = []
    for p in parts:
        if p.lower() in ("basic", "standard"):
            norms.append(f"pyright:{p.lower()}")
        elif m := _REPORT.fullmatch(p):
            norms.append(f"pyright:report{m[1]}={m[2].lower()}")
    return _joined(norms)


def disable_norm(comment: str) -> str | None:
    return (mypy_norm(comment) or pyright_norm(comment)) if "mypy:" in comment or "pyright:" in comment else None
