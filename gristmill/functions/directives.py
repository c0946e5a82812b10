"""Comment grammars as column expressions: SAFETY evidence, type-ignore comments, checker-disable comments.

White space is what Python calls so: Java's own and four control characters, never blanks alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import SUPPRESSIBLE, UNSCOPED

_S = r"[\s\x1C-\x1F]"


def _match(text: Column, pattern: str, group: int) -> Column:
    """A group of a match over the whole text, or null."""
    found = F.regexp_extract(text, f"(?Us)^{pattern}$", group)
    return F.when(text.rlike(f"(?Us)^{pattern}$"), found)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_S}+|{_S}+$", "")


def comment_body(comment: Column) -> Column:
    return trimmed(F.regexp_replace(comment, "^#+", ""))


def is_directive(comment: Column) -> Column:
    """One number sign, not two."""
    return comment.startswith("#") & ~comment.startswith("##")


def _reason_counts(reason: Column) -> Column:
    """Two words at least."""
    return F.coalesce(F.regexp_count(reason, F.lit("[A-Za-z0-9]+")) >= 2, F.lit(False))


def listed(text: Column) -> Column:
    """Parts between commas, without the blank ones."""
    return F.filter(F.transform(F.split(text, ","), trimmed), lambda c: c != "")


_SAFETY = rf"SAFETY{_S}*(?:\[([^\]]*)\]{_S}*)?:{_S}*(.+)"
_IGNORE = r"type:\s*ignore(?:\s*\[([^\]]*)\])?(?:\s.*)?"
_INLINE = rf"type:{_S}*ignore{_S}*(?:\[([^\]]*)\]{_S}*)?SAFETY:{_S}*(.+)"


def safety_reason(comment: Column) -> Column:
    """The reason of a valid SAFETY comment, null for any other comment."""
    return F.when(safety_codes(comment).isNotNull(), _match(comment_body(comment), _SAFETY, 2))


def safety_codes(comment: Column) -> Column:
    """Codes of a valid SAFETY comment (empty: it names none), null for any other comment."""
    body = comment_body(comment)
    scope = body.rlike(rf"(?U)^SAFETY{_S}*\[")
    codes = listed(_match(body, _SAFETY, 1))
    known = (F.size(codes) > 0) & F.forall(codes, lambda c: c.isin(SUPPRESSIBLE))
    valid = is_directive(comment) & _reason_counts(_match(body, _SAFETY, 2)) & (~scope | known)
    return F.when(valid, F.when(scope, F.array_sort(F.array_distinct(codes))).otherwise(F.array().cast("array<string>")))


def accepted_codes(codes: Column) -> Column:
    """The rules that a SAFETY comment with these codes counts for."""
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(*map(F.lit, UNSCOPED)))


def _inline(comment: Column) -> tuple[Column, Column, Column]:
    """Is a type-ignore comment of the inline form; the list in its brackets; its reason."""
    body = comment_body(comment)
    is_inline = body.rlike(f"(?Us)^{_INLINE}$")
    bracket = body.rlike(rf"(?U)^type:{_S}*ignore{_S}*\[")
    return is_inline, F.when(is_inline & bracket, _match(body, _INLINE, 1)), _match(body, _INLINE, 2)


def is_type_ignore(comment: Column) -> Column:
    return is_directive(comment) & (comment_body(comment).rlike(f"(?Us)^{_IGNORE}$") | _inline(comment)[0])


def _bracket(body: Column) -> Column:
    """The list in the brackets of the plain form; null without brackets."""
    return F.when(body.rlike(r"(?U)^type:\s*ignore\s*\[[^\]]*\]"), _match(body, _IGNORE, 1))


def _valid_list(text: Column) -> Column:
    codes = listed(text)
    return F.coalesce((F.size(codes) > 0) & F.forall(codes, lambda c: c.rlike(r"(?U)^[\w-]+$")), F.lit(False))


def ignore_codes_valid(comment: Column) -> Column:
    """Does a type-ignore comment name codes that can be ones? An inline reason that is none voids them."""
    inline, inside, reason = _inline(comment)
    return is_type_ignore(comment) & F.when(inline, _reason_counts(reason) & _valid_list(inside)).otherwise(_valid_list(_bracket(comment_body(comment))))


def inline_reason(comment: Column) -> Column:
    """The reason that a type-ignore comment gives itself; null for none, or none that counts."""
    inline, inside, reason = _inline(comment)
    return F.when(is_directive(comment) & inline & _reason_counts(reason) & (inside.isNull() | _valid_list(inside)), reason)


def ignore_norm(comment: Column) -> Column:
    inline = _inline(comment)[0]
    body = comment_body(comment)
    body = F.when(inline, trimmed(F.substring_index(body, "SAFETY:", 1))).otherwise(body)
    inside = _bracket(body)
    codes = listed(inside)
    torn = inside.endswith(",") | inside.contains(",,") | body.endswith(",")
    good = F.concat(F.lit("type:ignore["), F.array_join(F.array_sort(codes), ","), F.lit("]"))
    return (
        F.when(~body.rlike(f"(?Us)^{_IGNORE}$"), "type:ignore:invalid").when(inside.isNull(), "type:ignore:uncoded")
        .when(torn | ~_valid_list(inside), "type:ignore:invalid-codes").otherwise(good)
    )


def _joined(norms: Column) -> Column:
    return F.when(F.size(norms) > 0, F.array_join(F.array_sort(F.array_distinct(norms)), "|"))


#: A part of a mypy comment: anything but commas, which may stand in quotes; a quote that is never closed takes the rest.
_PART = r"""(?s)((?:[^,"']|"[^"]*(?:"|$)|'[^']*(?:'|$))+|,)"""


def mypy_norm(comment: Column) -> Column:
    """Weakening parts of a mypy comment, sorted; null: none, or it is malformed."""
    rest = F.regexp_extract(comment, "(?s)^# mypy: (.*)$", 1)
    pieces = F.regexp_extract_all(rest, F.lit(_PART), F.lit(1))
    parts = F.transform(F.filter(pieces, lambda p: p != ","), trimmed)
    # as many commas as come between parts, or one more at the end: else a part is empty
    commas = F.size(F.filter(pieces, lambda p: p == ","))
    blank_end = F.coalesce(F.get(parts, F.size(parts) - 1) == "", F.lit(False))
    parts = F.when(blank_end, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    n = F.size(parts)
    whole = (n > 0) & (commas <= n) & ~pieces[0].eqNullSafe(F.lit(",")) & F.forall(parts, lambda p: p != "")
    key = lambda p: F.lower(F.replace(trimmed(F.when(p.contains("="), F.substring_index(p, "=", 1)).otherwise(F.regexp_extract(p, rf"(?U)^([^\s\x1C-\x1F]+)", 1))), F.lit("-"), F.lit("_")))
    value = lambda p: F.when(p.contains("="), trimmed(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)))
    off = lambda p: F.coalesce((F.lower(value(p)) != "") & ~F.lower(value(p)).isin("1", "on", "true", "yes"), F.lit(False))
    bare = lambda v: F.when(v.rlike("""(?s)^(["']).*\\1$""") & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    codes = lambda p: bare(F.coalesce(value(p), F.lit("")))
    good = lambda p: _valid_list(codes(p)) & ~codes(p).endswith(",") & ~codes(p).contains(",,")
    names = F.transform(
        parts,
        lambda p: F.when((key(p) == "ignore_errors") & ~off(p), "mypy:ignore-errors").when(
            key(p) == "disable_error_code", F.concat(F.lit("mypy:disable-error-code["), F.array_join(F.array_sort(listed(codes(p))), ","), F.lit("]"))
        ),
    )
    sound = F.forall(parts, lambda p: (key(p) != "") & ((key(p) != "disable_error_code") | good(p)))
    return F.when(comment.startswith("# mypy: ") & whole & sound, _joined(F.array_compact(names)))


def pyright_norm(comment: Column) -> Column:
    """Weakening parts of a pyright comment, sorted; null: none, or it is malformed. Case does not matter but is kept in names."""
    body = comment_body(comment)
    parts = F.transform(F.split(trimmed(F.regexp_extract(body, "(?s)^pyright:(.*)$", 1)), ","), trimmed)
    report = r"(?i)^report([A-Z][A-Za-z0-9]*)[\s\x1C-\x1F]*=[\s\x1C-\x1F]*(false|none)[\s\x1C-\x1F]*$"
    named = lambda p: F.concat(F.lit("pyright:report"), F.regexp_extract(p, report, 1), F.lit("="), F.lower(F.regexp_extract(p, report, 2)))
    names = F.transform(
        parts, lambda p: F.when(F.lower(p).isin("basic", "standard"), F.concat(F.lit("pyright:"), F.lower(p))).when(p.rlike(report), named(p))
    )
    valid = is_directive(comment) & body.startswith("pyright:") & F.forall(parts, lambda p: p != "")
    return F.when(valid, _joined(F.array_compact(names)))


def checker(comment: Column) -> Column:
    return F.when(mypy_norm(comment).isNotNull(), "mypy").when(pyright_norm(comment).isNotNull(), "pyright")


def disable_norm(comment: Column) -> Column:
    return F.coalesce(mypy_norm(comment), pyright_norm(comment))
