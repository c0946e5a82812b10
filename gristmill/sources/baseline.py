"""Baselines: the findings that are known already, as a document with a closed schema."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import CODES
from .project import Project, ProjectError, bounded_text

TOOL = "gristmill"
SCHEME = "tw-fp-2"
#: Limits of the document.
MOST_BYTES, MOST_COUNT = 8_388_608, 1_000_000
_ENTRY = {"fingerprint", "code", "path", "count"}
_ENTRY_TYPE = "struct<fingerprint:string,code:string,path:string,count:string>"


def _schema(tool: str) -> str:
    return f"{tool}-baseline-1"


def _bad_path(path: object) -> bool:
    return not isinstance(path, str) or "\0" in path or path.startswith("/") or "\\" in path or ".." in path.split("/")


def entry_problem(entry: object) -> str | None:
    """What is wrong with one entry."""
    if not isinstance(entry, dict):
        return "baseline entry must be an object"
    if set(entry) != _ENTRY:
        return "baseline entry has an invalid key set"
    fingerprint, code, path, count = (entry[k] for k in ("fingerprint", "code", "path", "count"))
    if not isinstance(fingerprint, str) or not re.fullmatch("[0-9a-f]{16}", fingerprint):
        return f"invalid fingerprint: {fingerprint!r}"
    if code not in CODES:
        return f"unknown rule code in baseline entry: {code!r}"
    if _bad_path(path):
        return f"invalid baseline path: {path!r}"
    if not isinstance(count, int) or isinstance(count, bool) or count < 1:
        return f"invalid baseline count: {count!r}"
    if count > MOST_COUNT:
        return f"baseline count exceeds maximum ({MOST_COUNT}): {count!r}"
    return None


def parse_baseline(text: str, tool: str = TOOL) -> list[dict]:
    """Entries of a baseline document; anything out of order is an error."""
    try:
        document = json.loads(text)
    except RecursionError as e:
        raise ProjectError("malformed baseline file: excessive nesting") from e
    except json.JSONDecodeError as e:
        raise ProjectError(f"malformed baseline file: {e}") from e
    if not isinstance(document, dict):
        raise ProjectError("baseline file must contain a JSON object")
    expected = {"schema": _schema(tool), "fingerprint_schema": SCHEME, "entries": None}
    for key in document:
        if key not in expected:
            raise ProjectError(f"unknown baseline key: {key!r}")
    if document.get("schema", _schema(tool)) != _schema(tool):
        raise ProjectError(f"unsupported baseline schema: {document['schema']!r}")
    for key in expected:
        if key not in document:
            raise ProjectError(f"missing baseline key: {key!r}")
    if document["fingerprint_schema"] != SCHEME:
        raise ProjectError(f"unsupported fingerprint schema: {document['fingerprint_schema']!r}")
    if not isinstance(document["entries"], list):
        raise ProjectError("baseline entries must be a list")
    seen: set[str] = set()
    for entry in document["entries"]:
        if problem := entry_problem(entry):
            raise ProjectError(problem)
        if entry["fingerprint"] in seen:
            raise ProjectError(f"duplicate baseline entry for fingerprint: {entry['fingerprint']}")
        seen.add(entry["fingerprint"])
    return document["entries"]


def load_baseline(spark: SparkSession, path: Path, tool: str = TOOL) -> DataFrame:
    """fingerprint, code, path, count of a baseline file."""
    return entry_table(spark, parse_baseline(bounded_text(path, MOST_BYTES, "baseline file"), tool))


def entry_table(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([(e["fingerprint"], e["code"], e["path"], e["count"]) for e in entries], "fingerprint string, code string, path string, count int")


def entries_of(documents: DataFrame, text: str = "text", key: str = "id", tool: str = TOOL) -> DataFrame:
    """key, fingerprint, code, path, count, problem of baseline documents that are rows, checked by the JVM's JSON reader.

    problem names the first thing that is wrong with a document or an entry; it is null for sound entries.
    """
    head = F.from_json(text, f"struct<schema:string,fingerprint_schema:string,entries:array<{_ENTRY_TYPE}>>")
    keys = F.json_object_keys(text)
    allowed = F.array(*map(F.lit, ("schema", "fingerprint_schema", "entries")))
    unknown, missing = F.size(F.array_except(keys, allowed)) > 0, F.size(F.array_except(allowed, keys)) > 0
    wrong = (
        F.when(keys.isNull(), "document").when(unknown, "unknown key").when(missing, "missing key").when(~head["schema"].eqNullSafe(F.lit(_schema(tool))), "schema")
        .when(~head["fingerprint_schema"].eqNullSafe(F.lit(SCHEME)), "fingerprint schema").when(head["entries"].isNull(), "entries")
    )
    rows = documents.select(F.col(key), wrong.alias("problem"), F.posexplode_outer(F.when(wrong.isNull(), head["entries"])).alias("at", "e"), F.col(text).alias("t"))
    raw = F.get_json_object("t", "$.entries")
    entry = F.get(F.from_json(raw, "array<string>"), F.col("at"))
    names = F.json_object_keys(entry)
    exact = (F.size(names) == 4) & (F.size(F.array_except(names, F.array(*map(F.lit, sorted(_ENTRY))))) == 0)
    count = F.regexp_extract(entry, r'"count"\s*:\s*(-?\d+)\s*[,}]', 1)
    number = F.when(count != "", F.expr("try_cast(regexp_extract(entry, '\"count\"\\\\s*:\\\\s*(-?\\\\d+)\\\\s*[,}]', 1) AS BIGINT)"))
    rows = rows.withColumn("entry", entry).withColumn("exact", exact).withColumn("n", number)
    parts = F.split("e.path", "/")
    bad = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("at").isNull(), F.lit(None)).when(~F.coalesce("exact", F.lit(False)), "keys")
        .when(~F.col("e.fingerprint").rlike("^[0-9a-f]{16}$"), "fingerprint").when(~F.col("e.code").isin(CODES), "code")
        .when(F.col("e.path").startswith("/") | F.col("e.path").contains("\\") | F.array_contains(parts, ".."), "path")
        .when(~F.coalesce(F.col("n").between(1, MOST_COUNT), F.lit(False)), "count")
    )
    return rows.select(key, "e.fingerprint", "e.code", "e.path", F.col("n").cast("int").alias("count"), bad.alias("problem"))


def render_baseline(entries: DataFrame, tool: str = TOOL) -> str:
    """The document of ``findings.baseline_of``'s rows; it has a row for each fingerprint, so it fits where findings can be read."""
    rows = [r.asDict() for r in entries.select("fingerprint", "code", "path", "count").orderBy("fingerprint").toLocalIterator()]
    return json.dumps({"schema": _schema(tool), "fingerprint_schema": SCHEME, "entries": rows}, indent=2, sort_keys=True) + "\n"


def write_baseline(project: Project, path: Path, text: str) -> None:
    """Put a baseline in its place at once, or not at all: nothing outside the project, and the file's mode stays."""
    path = Path(path) if Path(path).is_absolute() else project.root / path
    project.canonical(path)
    if path.is_symlink() or path.is_dir() or not path.parent.is_dir():
        raise ProjectError(f"cannot write baseline file: {path}")
    mode = path.stat().st_mode & 0o777 if path.exists() else 0o666 & ~_umask()
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fchmod(f.fileno(), mode)
            os.fsync(f.fileno())
        os.replace(name, path)
    except OSError as e:
        Path(name).unlink(missing_ok=True)
        raise ProjectError(f"cannot write baseline file: {path}") from e
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def _umask() -> int:
    mask = os.umask(0)
    os.umask(mask)
    return mask
