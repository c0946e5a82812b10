"""Changed lines: from git, or from the text of any unified diff.

``changed_lines`` asks git on the driver; ``diff_lines`` parses diffs that are rows, one a file or commit, on
the executors. Paths that differ only in composed letters are brought together where lines are compared.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .project import Project, ProjectError
from .reading import DEFAULT_BYTES, decode, is_excluded, line_count

TIMEOUT = 60
#: Variables of the environment that would point git elsewhere, and how a diff is asked for.
BLOCKED = {
    "GIT_ALTERNATE_OBJECT_DIRECTORIES", "GIT_CEILING_DIRECTORIES", "GIT_COMMON_DIR", "GIT_DIFF_OPTS", "GIT_DIR", "GIT_EXTERNAL_DIFF", "GIT_INDEX_FILE",
    "GIT_NAMESPACE", "GIT_OBJECT_DIRECTORY", "GIT_WORK_TREE",
}
DIFF = ("diff", "--unified=0", "--no-color", "--no-ext-diff", "--no-textconv")


class DiffError(ValueError):
    """A diff that does not hold together, or a git command that failed."""


@dataclass(frozen=True)
class Selection:
    """staged, worktree (against HEAD, with files git doesn't know), or diff-ref (against a commit)."""

    mode: str
    ref: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("staged", "worktree", "diff-ref"):
            raise ProjectError(f"unknown git selection mode: {self.mode!r}")
        if self.mode == "diff-ref" and (not self.ref or "\0" in self.ref or self.ref.startswith("-")):
            raise ProjectError(f"invalid git ref: {self.ref!r}")
        if self.mode != "diff-ref" and self.ref:
            raise ProjectError(f"--{self.mode} does not accept a ref argument")

    @property
    def command(self) -> tuple[str, ...]:
        more = {"staged": ("--cached",), "worktree": ("--end-of-options", "HEAD"), "diff-ref": ("--end-of-options", self.ref, "--")}
        return (*DIFF, *more[self.mode])


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def unquoted(path: str) -> str:
    """A path as git writes it: perhaps in quotes, with octal bytes and escapes."""
    path = path[1:-1] if len(path) > 1 and path[0] == path[-1] == '"' else path
    out = bytearray()
    for octal, escaped, plain in re.findall(r"\\([0-7]{1,3})|\\(.)|((?s:.))", path):
        out += bytes([int(octal, 8) & 255]) if octal else (_ESCAPES.get(escaped, escaped) if escaped else plain).encode("utf-8", "surrogateescape")
    return out.decode("utf-8", "surrogateescape")


def _named(path: str) -> str:
    """A path of a header, without the a/ or b/ before it."""
    quoted = path.startswith('"')
    path = unquoted(path) if quoted else path
    return path[2:] if path[:2] in ("a/", "b/") else path


_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_QUOTED = r'"(?:\\.|[^"\\])*"'
#: The new path of a "diff --git" line: both quoted, a/... b/..., or any two words.
_HEADERS = (rf"{_QUOTED} ({_QUOTED})", r"a/.*? b/(.*)", r'"?.+? "?(.+?)"?')


def _header(line: str) -> str | None:
    rest = line.removeprefix("diff --git ")
    for k, pattern in enumerate(_HEADERS):
        if m := re.fullmatch(pattern, rest):
            return unquoted(m[1]) if k == 1 else _named(m[1])
    return None


def parse_diff(text: str) -> dict[str, set[int]]:
    """New numbers of the lines that a unified diff adds, by path; a changed file without added lines has none.

    Lines end at line feeds alone. Hunks must be as long as they say.
    """
    found: dict[str, set[int]] = {}
    path, gone, inside, old, new, at = None, False, False, 0, 0, 0
    for line in text.split("\n"):
        if inside and line[:1] in (" ", "-", "+"):
            used = (line[0] in " -", line[0] in " +")
            if used[0] > old or used[1] > new:
                raise DiffError(f"unexpected line in diff hunk: {line}")
            if line[0] == "+":
                found[path].add(at)
            old, new, at = old - used[0], new - used[1], at + used[1]
            continue
        if line.startswith("\\"):
            continue
        if old or new:
            raise DiffError("truncated diff hunk")
        inside = False
        word = next((w for w in _WORDS if line.startswith(w)), None)
        if word == "@@":
            m = _HUNK.match(line)
            if not m:
                raise DiffError(f"unrecognized diff hunk header: {line}")
            if path is None and not gone:
                raise DiffError("diff hunk without a preceding file header")
            if path is not None:
                inside, old, new, at = True, int(m[1] or 1), int(m[3] or 1), int(m[2])
        elif word == "diff --git ":
            path, gone = _header(line), False
        elif word == "rename from ":
            path = None
        elif word == "rename to ":
            path = unquoted(line.removeprefix(word))
        elif word == "deleted file mode":
            found.pop(path, None)
            path, gone = None, True
        elif word == "+++ " and (named := line[4:].strip()) != "/dev/null":
            path, gone = _named(named), False
        if path is not None:
            found.setdefault(path, set())
    if old or new:
        raise DiffError("truncated diff hunk")
    return found


_WORDS = ("@@", "diff --git ", "rename from ", "rename to ", "deleted file mode", "+++ ")


def diff_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """path, line (null: a changed file without added lines), error of diffs that are rows; a diff that fails gives its error alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(0):
                try:
                    rows += [(p, n, None) for p, ns in parse_diff(value.as_py() or "").items() for n in sorted(ns) or [None]]
                except DiffError as e:
                    rows.append((None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "line", "error"])

    return diffs.select(text).mapInArrow(run, "path string, line int, error string")


def git(folder: Path, *args: str) -> bytes:
    env = {k: v for k, v in os.environ.items() if k not in BLOCKED and not k.startswith("GIT_CONFIG")} | {"GIT_TERMINAL_PROMPT": "0"}
    try:
        done = subprocess.run(("git", *args), cwd=folder, capture_output=True, check=False, stdin=subprocess.DEVNULL, timeout=TIMEOUT, env=env)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise DiffError("git command failed") from e
    if done.returncode:
        raise DiffError((done.stderr or done.stdout).decode("utf-8", "replace").strip() or "git command failed")
    return done.stdout


def _has_head(top: Path) -> bool:
    try:
        git(top, "rev-parse", "--verify", "--quiet", "HEAD")
    except DiffError:
        return False
    return True


def changed_lines(project: Project, selection: Selection, max_bytes: int = DEFAULT_BYTES) -> tuple[dict[str, set[int]], list[tuple[str, str, str]]]:
    """Changed lines by path from the project's root, and errors (path, kind, message) of files git doesn't know."""
    top = Path(os.fsdecode(git(project.root, "rev-parse", "--show-toplevel")).rstrip("\n"))
    if selection.mode == "diff-ref":
        git(top, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{selection.ref}^{{commit}}")
    nothing = selection.mode == "worktree" and not _has_head(top)
    parsed = {} if nothing else parse_diff(git(top, *selection.command).decode("utf-8", "surrogateescape"))
    found: dict[str, set[int]] = {}
    errors: list[tuple[str, str, str]] = []

    def own(name: str) -> str | None:
        try:
            return project.canonical(top / name)
        except ProjectError:
            return None

    for name, lines in parsed.items():
        if (path := own(name)) is not None:
            found.setdefault(path, set()).update(lines)
    if selection.mode == "worktree":
        for raw in filter(None, git(top, "ls-files", "--others", "--exclude-standard", "-z").split(b"\0")):
            name = os.fsdecode(raw)
            file, path = top / name, own(name)
            if path is None or file.suffix not in (".py", ".pyi") or file.is_symlink() or not file.is_file():
                continue
            with open(file, "rb") as f:
                text, error = decode(path, f.read(max_bytes + 1), max_bytes)
            if error:
                errors.append((path, *error))
            else:
                found.setdefault(path, set()).update(range(1, line_count(text) + 1))
    return found, errors


def changed_files(project: Project, changed: dict[str, set[int]], inputs: list[str] = (), excludes: tuple[str, ...] = ()) -> list[str]:
    """Changed Python files that are there, among or below the inputs, in the inputs' order."""
    from .reading import input_path

    scopes: list[tuple[str, bool]] = []
    for raw in inputs:
        path = input_path(project, raw)
        if not path.is_dir() and not path.is_file():
            raise ProjectError(f"input path does not exist: {raw}")
        scopes.append((project.canonical(path), path.is_dir()))
    files = [p for p in sorted(changed) if changed[p] and Path(p).suffix in (".py", ".pyi") and not is_excluded(p, excludes)]
    files = [p for p in files if (f := project.root / p).is_file() and not f.is_symlink()]
    inside = lambda p, s, folder: p == s or (folder and (s == "." or p.startswith(f"{s}/")))
    return list(dict.fromkeys(p for s, folder in scopes for p in files if inside(p, s, folder))) if inputs else files


def line_table(spark: SparkSession, changed: dict[str, set[int]]) -> DataFrame:
    rows = [(p, n) for p, lines in changed.items() for n in sorted(lines)]
    return spark.createDataFrame(rows, "path string, line int")
