"""Finding files, reading them within limits, and decoding them.

Listing happens on the driver, as for any Spark source; what is read goes through ``binaryFile`` with the
size as a pushed filter, so files above the limit are never read. Decoding runs in the extractor's worker.
"""

from __future__ import annotations

import codecs
import fnmatch
import io
import os
import re
import tokenize
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .project import Project, ProjectError

#: Folders that are never looked into, limits of files.
DEFAULT_EXCLUDES = (".git", ".mypy_cache", ".venv", "__pycache__", "build", "dist", "node_modules")
DEFAULT_BYTES, MOST_BYTES, MOST_LINES = 1_048_576, 4_194_304, 100_000


def is_python(path: Column | str) -> Column:
    """Is the last part of a path a name with the suffix .py or .pyi? A name that is nothing but a suffix has none."""
    return (F.col(path) if isinstance(path, str) else path).rlike(r"[^/]\.pyi?$")


def line_count(text: str) -> int:
    """Lines ended by a line feed, a carriage return or both; nothing else ends one."""
    if not text:
        return 0
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    return plain.count("\n") + (not plain.endswith("\n"))


def decode(path: str, content: bytes, max_bytes: int = DEFAULT_BYTES, max_lines: int = MOST_LINES) -> tuple[str | None, tuple[str, str] | None]:
    """Text, or the kind and message of what is wrong. The encoding is the file's own declaration."""
    if len(content) > max_bytes:
        return None, ("limit", f"source file exceeds max-file-bytes ({max_bytes}): {path}")
    try:
        text = bytes(content).decode(tokenize.detect_encoding(io.BytesIO(content).readline)[0])
    except (SyntaxError, UnicodeDecodeError, LookupError) as e:
        return None, ("encode", str(e))
    if line_count(text) > max_lines:
        return None, ("limit", f"source file exceeds maximum line count ({max_lines}): {path}")
    return text, None


def declared_encoding(content: bytes) -> str | None:
    try:
        return codecs.lookup(tokenize.detect_encoding(io.BytesIO(content).readline)[0]).name
    except (SyntaxError, LookupError):
        return None


def exclude_pattern(pattern: str) -> str:
    """A pattern as it is compared: no blanks around it, no ./ or / before it, no / after it."""
    plain = re.sub(r"^(\./)*/*", "", pattern.strip())
    return plain.rstrip("/") if len(plain) > 1 else plain


def excluded(path: Column, patterns: tuple[str, ...] | list[str] = ()) -> Column:
    """Is a path inside a folder that is left out, or does it match one of the patterns?"""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*map(F.lit, DEFAULT_EXCLUDES)))
    for p in map(exclude_pattern, patterns):
        if "*" in p or "?" in p:
            out = out | path.rlike(_java(p)) | path.rlike(_java(f"{p}/*"))
        else:
            out = out | (path == p) | path.startswith(f"{p}/") | F.array_contains(parts, p)
    return out


def _java(glob: str) -> str:
    """A shell pattern as a Java one."""
    return "^" + fnmatch.translate(glob).removesuffix(r"\Z").removesuffix(r"\z").replace("(?s:", "(?s:").replace("(?>", "(?:") + "$"


def is_excluded(path: str, patterns: tuple[str, ...] | list[str] = ()) -> bool:
    """The same for one path, to leave folders out while listing."""
    parts = path.split("/")
    if set(DEFAULT_EXCLUDES) & set(parts):
        return True
    for p in map(exclude_pattern, patterns):
        if "*" in p or "?" in p:
            if fnmatch.fnmatchcase(path, p) or fnmatch.fnmatchcase(path, f"{p}/*"):
                return True
        elif path == p or path.startswith(f"{p}/") or p in parts:
            return True
    return False


def discover(project: Project, inputs: list[str | Path] = (), excludes: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Paths (from the project's root) of the Python files among and below the inputs, each once, folders by name. Links are not followed."""
    found: dict[str, None] = {}

    def add(path: Path) -> None:
        if path.suffix in (".py", ".pyi") and not path.is_symlink():
            canonical = project.canonical(path)
            if not is_excluded(canonical, excludes):
                found.setdefault(canonical)

    def walk(folder: Path) -> None:
        try:
            names = sorted(os.listdir(folder))
        except OSError as e:
            raise ProjectError(f"cannot read directory: {folder}") from e
        for child in (folder / n for n in names):
            if child.is_symlink():
                continue
            if child.is_dir():
                if not is_excluded(project.canonical(child), excludes):
                    walk(child)
            elif child.is_file():
                add(child)

    for raw in list(inputs) or [project.root]:
        path = input_path(project, raw)
        if path.is_dir():
            walk(path)
        elif path.is_file():
            add(path)
        else:
            raise ProjectError(f"input path does not exist: {raw}")
    return list(found)


def input_path(project: Project, raw: str | Path) -> Path:
    path = Path(raw) if Path(raw).is_absolute() else Path.cwd() / raw
    if path.is_symlink():
        raise ProjectError(f"symlink inputs are not supported: {raw}")
    project.canonical(path)
    return path.resolve()


def read_files(spark: SparkSession, project: Project, paths: list[str], max_bytes: int = DEFAULT_BYTES) -> tuple[DataFrame, DataFrame]:
    """files(path, content) of the named files within the limit, and errors(path, kind, message) of the others."""
    if max_bytes < 1:
        raise ProjectError("max-file-bytes must be a positive integer")
    if not paths:
        return spark.createDataFrame([], "path string, content binary"), spark.createDataFrame([], "path string, kind string, message string")
    # signs that Hadoop would expand stand for themselves
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", str(project.root / p)) for p in paths]
    read = spark.read.format("binaryFile").load([f"file:{n}" for n in names])
    path = F.substring("path", len(f"file:{project.root.as_posix().rstrip('/')}/") + 1, 1 << 30)
    small = read.where(F.col("length") <= max_bytes).select(path.alias("path"), "content")
    message = F.concat(F.lit(f"source file exceeds max-file-bytes ({max_bytes}): "), path)
    large = read.where(F.col("length") > max_bytes).select(path.alias("path"), F.lit("limit").alias("kind"), message.alias("message"))
    return small, large


def decoded(files: DataFrame, max_bytes: int = DEFAULT_BYTES, max_lines: int = MOST_LINES) -> DataFrame:
    """files(path, content, ...) with text, or kind and message of what is wrong, instead of the content."""

    @F.pandas_udf("text string, kind string, message string")
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [decode(p, c, max_bytes, max_lines) for p, c in zip(paths, contents, strict=True)]
        return pd.DataFrame([(t, *(e or (None, None))) for t, e in rows], columns=["text", "kind", "message"])

    return files.withColumn("read", run("path", "content")).select(*[c for c in files.columns if c != "content"], "read.*")


def texts(files: DataFrame, max_bytes: int = DEFAULT_BYTES) -> DataFrame:
    """path, text of files(path, content) that can be decoded."""
    return decoded(files.select("path", "content"), max_bytes).where("text IS NOT NULL").select("path", "text")
