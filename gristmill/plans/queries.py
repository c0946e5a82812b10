"""Queries of the audit over sources made from the driver's tables, and their SQL twins.

No table holds Python sources, so queries write small modules for the rows of a table; what must be found in
them follows from the row's key, which is what the SQL states. The SQL never sees the engine's way.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import directives as D
from ..operators import findings as O
from ..operators import lines as L
from ..operators import local as A
from ..operators import reports as R
from ..sources import baseline as B
from ..sources import git as G
from ..sources.reading import decoded, excluded, is_python
from ..store import settled
from . import cases, catalog

#: Module for o_orderkey % 5: unexplained cast, unexplained ignore, explained ignore, nested casts, clean.
TEMPLATES = [
    "from typing import cast\n\nvalue = cast(int, {k})\n",
    "x = {k}  # type: ignore[assignment]\n",
    "# SAFETY: checked against the schema\nx = {k}  # type: ignore[assignment]\n",
    "from typing import cast\n\nvalue = cast(int, cast(str, {k}))\n",
    "text = 'cast(int, {k})'\n",
]
CODES_SQL = "SELECT * FROM (VALUES (0, 'TW002', 3), (1, 'TW003', 1), (3, 'TW001', 3), (3, 'TW002', 3)) AS v(m, code, line)"

#: Module for c_custkey % 6: bare decorator, created patch, undecided patch, explained patch, decided patch, shadowed patch.
TEST_TEMPLATES = [
    "from typing import no_type_check\n\n@no_type_check\ndef f{k}():\n    pass\n",
    "from unittest.mock import patch as p\n\np({k}, create=True)\n",
    "from unittest import mock\n\nmock.patch({k})\nmock.patch.dict({k})\n",
    "import unittest.mock as um\n\n# SAFETY: reviewed by hand\num.patch.object(x, {k}, create=True)\n",
    "import unittest.mock\n\nunittest.mock.patch.object(x, {k}, y)\n",
    "from unittest.mock import patch\n\ndef f(patch):\n    patch({k}, create=True)\n",
]


def _pick(values: list[str | None], key: str) -> F.Column:
    """The value for a key, counted round."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int") + 1)


def _modules(keys: DataFrame, key: str, templates: list[str]) -> DataFrame:
    text = F.replace(_pick(templates, key), F.lit("{k}"), F.col(key).cast("string"))
    return keys.select(F.concat(F.lit("pkg/m"), F.col(key), F.lit(".py")).alias("path"), text.alias("text"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _audited(spark: SparkSession, sf_dir: str, name: str, key: str, templates: list[str], **rules: set[str]) -> DataFrame:
    """Findings and errors of a module for every row of a table, each parsed once."""
    return A.audited(_modules(_table(spark, sf_dir, name).select(key), key, templates), **rules)


def _findings(spark: SparkSession, sf_dir: str, **rules: set[str]) -> DataFrame:
    return A.found(_audited(spark, sf_dir, "orders", "o_orderkey", TEMPLATES, **rules))


def _customer_findings(spark: SparkSession, sf_dir: str, templates: list[str], **rules: set[str]) -> DataFrame:
    return A.found(_audited(spark, sf_dir, "customer", "c_custkey", templates, **rules))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.failed(_audited(spark, sf_dir, "supplier", "s_suppkey", [t for t, _ in cases.BROKEN]))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows that are put in order: a sort looks at them twice, to sample them and to deal them out, and files are parsed once."""
    return settled(rows)


def _long(name: str) -> F.Column:
    return F.col(name).cast("long").alias(name)


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("code", "path", _long("line"), "fingerprint")


def audit_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorator and patch rules, one of them off by default."""
    rows = _customer_findings(spark, sf_dir, TEST_TEMPLATES, select={"TW008", "TW009", "TW012"})
    return rows.select("code", "path", _long("line"), "fingerprint")


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.count_by_rule(_findings(spark, sf_dir)).select("code", "findings", "files", "position")


def audit_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on lines that line items name: the item's number is the changed line of its order's module."""
    items = _table(spark, sf_dir, "lineitem")
    changed = items.select(F.concat(F.lit("pkg/m"), F.col("l_orderkey"), F.lit(".py")).alias("path"), F.col("l_linenumber").alias("line"))
    return O.on_changed_lines(_findings(spark, sf_dir).select("code", "path", "line", "end_line"), changed).select("code", "path", _long("line"))


def audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen rules over modules that meet, miss or explain each."""
    rows = _customer_findings(spark, sf_dir, [t for t, _ in cases.RULES], select=set(catalog.CODES))
    return rows.select("code", "path", _long("line"), _long("col"))


def audit_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name means after each way to bind it."""
    rows = _customer_findings(spark, sf_dir, [t for t, _ in cases.SCOPES])
    return rows.select("code", "path", _long("line"), _long("col"))


def audit_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of type-ignore comments: scopes of lines, tokens of logical lines, duplicates."""
    rows = _customer_findings(spark, sf_dir, [t for t, _ in cases.IGNORES], select={"TW003"})
    return rows.select("path", "fingerprint")


def audit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rules without ignored ones; fingerprints are those of any other selection."""
    rows = _findings(spark, sf_dir, select={"TW001", "TW002", "TW003"}, ignore={"TW002"})
    return rows.select("code", "path", "fingerprint")


def audit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be analysed give a row that says so, and nothing else."""
    return _errors(spark, sf_dir).select("path", "kind")


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report's lines."""
    return R.text_lines(_kept(_findings(spark, sf_dir))).select("value")


def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report's objects, one a line."""
    return R.json_lines(_kept(_customer_findings(spark, sf_dir, TEST_TEMPLATES, select={"TW008"}))).select("value")


def audit_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the baseline of all findings."""
    return O.baseline_of(_findings(spark, sf_dir)).select("fingerprint", "code", "path", "count")


def audit_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings of each rule, as a report shows them."""
    rows = L.top(_findings(spark, sf_dir), ["path", "line", "col", "fingerprint"], within=["code"]).where("shown")
    return rows.select("code", "path", _long("rank"))


def audit_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around findings."""
    modules = _modules(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", TEMPLATES)
    rows = L.snippets(_findings(spark, sf_dir), modules)
    return rows.select("code", "path", F.array_join("snippet.lines", "\n").alias("lines"), F.col("snippet.start").cast("long").alias("start"), F.col("snippet.at").cast("long").alias("at"))


def baseline_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference over events: of each user's event type the first two are known already."""
    events = _table(spark, sf_dir, "events")
    rows = events.select(
        O.fingerprint("k", F.col("user_id").cast("string"), F.col("event_type")).alias("fingerprint"), F.lit("").alias("path"),
        F.col("event_id").alias("line"), F.lit(0).alias("col"), F.lit("").alias("code"),
    )
    known = rows.select("fingerprint", F.lit(2).alias("count")).distinct()
    return O.minus_baseline(rows, known).select("fingerprint", F.col("line").alias("event_id"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines of every document: line feeds, carriage returns or both end one."""
    return _table(spark, sf_dir, "documents").select("doc_id", L.count(F.col("text")).cast("long").alias("n_lines"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with the characters before it and the run of comment lines above."""
    rows = L.lines(_table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", _long("line"), _long("offset"), F.length("text").cast("long").alias("length"), "comment_only", _long("run_start"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents with line ends made one."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(L.normalized(F.col("text")), 256).alias("digest"))


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment grammars over a comment for each event."""
    c = F.col("c")
    rows = _table(spark, sf_dir, "events").select("event_id", _pick([d[0] for d in cases.DIRECTIVES], "event_id").alias("c"))
    return rows.select(
        "event_id", F.array_join(D.safety_codes(c), ",").alias("codes"), D.ignore_codes_valid(c).alias("ignore_valid"),
        F.when(D.is_type_ignore(c), D.ignore_norm(c)).alias("ignore_norm"), D.disable_norm(c).alias("disable_norm"),
    )


def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules a comment counts for, by the codes it names."""
    said = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.element_at(F.array(*map(F.lit, catalog.SUPPRESSIBLE)), (F.col("event_id") % 12).cast("int") + 1)]))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(D.accepted_codes(said)), ",").alias("counts"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for every order: two hunks of as many lines as its key says, and a file that is deleted."""
    n, m = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    path = F.concat(F.lit('a'), F.col("o_orderkey"), F.lit(".py"))
    name = F.when(F.col("o_orderkey") % 2 == 0, path).otherwise(F.concat(F.lit("\\303\\251"), path))
    quote = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise('"')
    side = lambda s: F.concat(quote, F.lit(f"{s}/"), name, quote)
    added = lambda k: F.repeat(F.lit("+x\n"), k.cast("int"))
    text = F.concat(
        F.lit("diff --git "), side("a"), F.lit(" "), side("b"), F.lit("\n--- "), side("a"), F.lit("\n+++ "), side("b"), F.lit("\n"),
        F.concat(F.lit("@@ -1 +3,"), n, F.lit(" @@ f\n-y\n")), added(n), F.lit("\\ No newline at end of file\n"),
        F.concat(F.lit("@@ -9,0 +20"), F.when(m == 1, "").otherwise(F.concat(F.lit(","), m)), F.lit(" @@\n")), added(m),
        F.lit("diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"),
    )
    return _table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, F.concat(text, F.lit("diff --git a/x b/x\n@@ -1,2 +1 @@\n-x\n"))).otherwise(text).alias("diff"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines of unified diffs: several hunks, quoted paths, deleted files, hunks that are cut off."""
    return G.diff_lines(_diff(spark, sf_dir)).select("path", _long("line"), "error")


def _entry(**changes: object) -> dict:
    return {"fingerprint": "0123456789abcdef", "code": "TW002", "path": "a/b.py", "count": 2} | changes


#: Baseline documents, and what is wrong with each (null: nothing).
BASELINES = [
    ({}, None), ({"entries": []}, None), ({"entries": [_entry(), _entry(fingerprint="f" * 16, count=1_000_000)]}, None), ({"more": 1}, "unknown key"),
    ({"schema": "other"}, "schema"), ({"fingerprint_schema": "tw-fp-1"}, "fingerprint schema"), ({"entries": [_entry(count=0)]}, "count"),
    ({"entries": [_entry(count="1")]}, "count"), ({"entries": [_entry(count=True)]}, "count"), ({"entries": [_entry(count=1.5)]}, "count"),
    ({"entries": [_entry(count=1_000_001)]}, "count"), ({"entries": [_entry(fingerprint="F" * 16)]}, "fingerprint"), ({"entries": [_entry(code="TW099")]}, "code"),
    ({"entries": [_entry(path="/a")]}, "path"), ({"entries": [_entry(path="a/../b")]}, "path"), ({"entries": [_entry(path="a\\b")]}, "path"),
    ({"entries": [_entry(more=1)]}, "keys"),
]


def baseline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of baseline documents, each with what is wrong with it."""
    base = {"schema": "gristmill-baseline-1", "fingerprint_schema": "tw-fp-2", "entries": [_entry()]}
    texts = [json.dumps(base | change) for change, _ in BASELINES]
    documents = _table(spark, sf_dir, "part").select("p_partkey", _pick(texts, "p_partkey").alias("text"))
    return B.entries_of(documents, key="p_partkey").select("p_partkey", F.col("problem"), F.when(F.col("problem").isNull(), F.col("count")).cast("long").alias("count"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every supplier: usage errors before analysis errors before findings."""
    k = F.col("s_suppkey")
    runs = _table(spark, sf_dir, "supplier").select("s_suppkey", (k % 2).alias("findings"), (k % 3).alias("errors"), F.when(k % 5 == 0, 1).otherwise(0).alias("usage"))
    return O.exit_codes(runs).select("s_suppkey", _long("exit_code"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, names = ["src", "build", "a/b", "docs/.git", "lib/tests", "tests"], ["m.py", "m.pyi", "m.txt", ".py", "test_m.py", "build"]
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", _pick(folders, "p_partkey"), F.element_at(F.array(*map(F.lit, names)), (F.floor(k / 6) % 6).cast("int") + 1)).alias("path"))


def discovered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files outside folders that are left out and patterns that are excluded."""
    return _paths(spark, sf_dir).where(is_python("path") & ~excluded(F.col("path"), ("./tests/", "*/test_*.py", "a/?"))).select("p_partkey", "path")


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's flags, hints, levels and anchors."""
    return catalog.rules(spark).select("code", "on_by_default", "suppressible", "scoped_only", "hint", "level", "anchor")


def rule_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry with one rule missing and one too many differs in."""
    return catalog.mismatch(spark, [c for c in catalog.CODES if c != "TW007"] + ["TW099"])


def audit_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a SARIF document."""
    rows = _customer_findings(spark, sf_dir, TEST_TEMPLATES, select={"TW008", "TW012"})
    return R.sarif_results(_kept(rows)).select("value")


def audit_linter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a linter takes them."""
    rows = _customer_findings(spark, sf_dir, [t for t, _ in cases.SCOPES])
    return R.linter_rows(_kept(rows)).select(_long("line"), _long("column"), "text")


def audit_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for files with null bytes; other messages differ from one Python to another."""
    errors = _errors(spark, sf_dir).where("kind = 'encode'")
    return R.error_lines(_kept(errors)).select("value")


def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several encodings and sizes, read within limits of bytes and lines."""
    content = F.element_at(F.array(*[F.lit(c[0]) for c in cases.CONTENTS]), (F.col("s_suppkey") % len(cases.CONTENTS)).cast("int") + 1)
    files = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("f"), "s_suppkey").alias("path"), content.alias("content"))
    read = decoded(files, 1500, 500)
    return read.select("s_suppkey", "kind", F.length("text").cast("long").alias("n_chars"))


def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with signs that a terminal would act on or hide."""
    return _table(spark, sf_dir, "supplier").select("s_suppkey", L.escaped(_pick([n for n, _ in cases.NAMES], "s_suppkey")).alias("shown"))


_ALL = [
    audit_findings, audit_tests, audit_counts, audit_changed_lines, audit_rules, audit_scopes, audit_ignores, audit_selection, audit_errors, audit_report, audit_json,
    audit_baseline, audit_top, audit_snippets, baseline_rest, line_counts, line_offsets, normalized_texts, directives, evidence_counts, diff_lines, baseline_documents,
    exit_codes, discovered_paths, rule_catalog, rule_mismatch, audit_sarif, audit_linter, audit_error_lines, decoded_files, shown_names,
]
QUERIES = {f.__name__: f for f in _ALL}


def _quoted(value: str | int | bool | None) -> str:
    if value is None:
        return "NULL::VARCHAR"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS v({names})"


def _expected(of: list[tuple], table: str = "customer", key: str = "c_custkey") -> str:
    rows = [(m, *found) for m, (_, expected) in enumerate(of) for found in expected]
    return f"SELECT code, 'pkg/m' || {key} || '.py' AS path, line::BIGINT AS line, col::BIGINT AS col FROM {table} JOIN {_values(rows, 'm, code, line, col')} ON {key} % {len(of)} = m"


_FOUND = f"""
WITH found AS (SELECT 'pkg/m' || o_orderkey || '.py' AS path, o_orderkey AS k, m, code, line
               FROM orders JOIN ({CODES_SQL}) ON o_orderkey % 5 = m)
"""
_CAST = "'NAME:cast OP:( NAME:int OP:, NUMBER:' || k || ' OP:)'"
_NESTED = "'NAME:cast OP:( NAME:int OP:, NAME:cast OP:( NAME:str OP:, NUMBER:' || k || ' OP:) OP:)'"
_PRINT = f"""substr(sha256('tw-fp-2|' || code || '|' || path || '|' || CASE
  WHEN m = 1 THEN 'type-ignore-comment|module|type:ignore[assignment]|NAME:x OP:= NUMBER:' || k || '|'
  WHEN m = 0 THEN 'cast-call|module|' || {_CAST} || '|NAME:value OP:= ' || {_CAST} || '|'
  ELSE 'cast-call|module|' || {_NESTED} || '|NAME:value OP:= ' || {_NESTED} || '|' END), 1, 16)"""
_MESSAGES = "CASE code WHEN 'TW001' THEN 'nested typing.cast call' WHEN 'TW002' THEN 'cast call missing SAFETY evidence' ELSE 'type: ignore comment missing codes or SAFETY evidence' END"
_IGNORED = [(m, *row) for m, (_, expected) in enumerate(cases.IGNORES) for row in expected]
_TEMPLATE_SQL = "CASE k % 5 " + " ".join(f"WHEN {m} THEN {' || chr(10) || '.join(_quoted(p) for p in t.split(chr(10)))}" for m, t in enumerate(TEMPLATES)) + " END"
_DIRECTIVE_ROWS = [(m, codes, valid, norm, disable) for m, (_, codes, valid, norm, disable) in enumerate(cases.DIRECTIVES)]

SQL = {
    "audit_findings": f"{_FOUND} SELECT code, path, line::BIGINT AS line, {_PRINT} AS fingerprint FROM found",
    "audit_tests": """
SELECT code, path, line, substr(sha256('tw-fp-2|' || code || '|' || path || '|' || material || '|'), 1, 16) AS fingerprint
FROM (SELECT 'pkg/m' || c_custkey || '.py' AS path, 3::BIGINT AS line, unnest(CASE c_custkey % 6 WHEN 0 THEN ['TW008'] WHEN 1 THEN ['TW009', 'TW012'] WHEN 2 THEN ['TW012'] ELSE [] END) AS code,
      CASE c_custkey % 6 WHEN 0 THEN 'no-type-check-decorator|module|no_type_check|function|f' || c_custkey || '|OP:@ NAME:no_type_check'
        WHEN 1 THEN 'mock-patch-call|module|patch|create=true|fidelity=absent|kwargs=absent|NAME:p OP:( NUMBER:' || c_custkey || ' OP:, NAME:create OP:= NAME:True OP:)'
        ELSE 'mock-patch-call|module|patch|create=absent|fidelity=absent|kwargs=absent|NAME:mock OP:. NAME:patch OP:( NUMBER:' || c_custkey || ' OP:)' END AS material
      FROM customer)""",
    "audit_counts": f"{_FOUND} SELECT code, count(*) AS findings, count(DISTINCT path) AS files, CASE code WHEN 'TW001' THEN 0 WHEN 'TW002' THEN 1 ELSE 2 END::INT AS position FROM found GROUP BY code",
    "audit_changed_lines": f"{_FOUND} SELECT code, path, line::BIGINT AS line FROM found WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = line)",
    "audit_rules": _expected(cases.RULES),
    "audit_scopes": _expected(cases.SCOPES),
    "audit_ignores": f"""
SELECT path, substr(sha256('tw-fp-2|TW003|' || path || '|type-ignore-comment|' || scope || '|' || norm || '|' || replace(host, '{{k}}', c_custkey::VARCHAR) || '|' || dup), 1, 16) AS fingerprint
FROM (SELECT *, 'pkg/m' || c_custkey || '.py' AS path FROM customer JOIN {_values(_IGNORED, 'm, scope, norm, host, dup')} ON c_custkey % {len(cases.IGNORES)} = m)""",
    "audit_selection": f"{_FOUND} SELECT code, path, {_PRINT} AS fingerprint FROM found WHERE code IN ('TW001', 'TW003')",
    "audit_errors": f"SELECT 'pkg/m' || s_suppkey || '.py' AS path, kind FROM supplier JOIN {_values([(m, k) for m, (_, k) in enumerate(cases.BROKEN) if k], 'm, kind')} ON s_suppkey % {len(cases.BROKEN)} = m",
    "audit_report": f"{_FOUND} SELECT path || ':' || line || ':' || CASE m WHEN 1 THEN 6 + length(k::VARCHAR) + 1 ELSE 9 END || ': ' || code || ' ' || {_MESSAGES} AS value FROM found",
    "audit_json": """
SELECT '{"code":"TW008","column":1,"end_column":14,"end_line":3,"fingerprint":"' || substr(sha256('tw-fp-2|TW008|' || path || '|no-type-check-decorator|module|no_type_check|function|f' || c_custkey || '|OP:@ NAME:no_type_check|'), 1, 16)
       || '","line":3,"message":"no_type_check decorator missing SAFETY evidence","path":"' || path || '"}' AS value
FROM (SELECT c_custkey, 'pkg/m' || c_custkey || '.py' AS path FROM customer WHERE c_custkey % 6 = 0)""",
    "audit_baseline": f"{_FOUND} SELECT {_PRINT} AS fingerprint, min(code) AS code, min(path) AS path, count(*) AS count FROM found GROUP BY 1",
    "audit_top": f"{_FOUND} SELECT * FROM (SELECT code, path, row_number() OVER (PARTITION BY code ORDER BY path, line, {_PRINT}) AS rank FROM found) WHERE rank <= 25",
    "audit_snippets": f"""{_FOUND} SELECT code, path, array_to_string(list_slice(string_split(t, chr(10)), greatest(1, line - 2), least(len(string_split(t, chr(10))), line + 2)), chr(10)) AS lines,
  greatest(1, line - 2)::BIGINT AS start, (line - greatest(1, line - 2) + 1)::BIGINT AS at
FROM (SELECT *, replace({_TEMPLATE_SQL}, '{{k}}', k::VARCHAR) AS t FROM found)""",
    "baseline_rest": """
SELECT substr(sha256('k|' || user_id || '|' || event_type), 1, 16) AS fingerprint, event_id
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 2""",
    "line_counts": r"""
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END END::BIGINT AS n_lines
FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents)""",
    "line_offsets": r"""
WITH split AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
     each AS (SELECT doc_id, i AS line, ls[i] AS t FROM split, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
     marked AS (SELECT *, starts_with(ltrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '#') AS only_ FROM each)
SELECT doc_id, line::BIGINT AS line, coalesce(sum(length(t) + 1) OVER up, 0)::BIGINT AS "offset", length(t)::BIGINT AS length, only_ AS comment_only,
       (coalesce(max(CASE WHEN NOT only_ THEN line END) OVER up, 0) + 1)::BIGINT AS run_start
FROM marked WINDOW up AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "normalized_texts": r"SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS digest FROM documents",
    "directives": f"""
SELECT event_id, codes, ignore_valid, ignore_norm, disable_norm
FROM events JOIN {_values(_DIRECTIVE_ROWS, 'm, codes, ignore_valid, ignore_norm, disable_norm')} ON event_id % {len(cases.DIRECTIVES)} = m""",
    "evidence_counts": f"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'TW002,TW003,TW007,TW008,TW009,TW012' ELSE ({catalog.SUPPRESSIBLE!r}::VARCHAR[])[(event_id % 12)::INT + 1] END AS counts FROM events""",
    "diff_lines": """
WITH named AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'é' END || 'a' || o_orderkey || '.py' AS path FROM orders),
     added AS (SELECT k, path, unnest(list_concat(range(3, 3 + k % 4), range(20, 20 + k % 3))) AS line FROM named WHERE k % 50 <> 0)
SELECT path, line::BIGINT AS line, NULL::VARCHAR AS error FROM added
UNION ALL SELECT path, NULL, NULL FROM named WHERE k % 50 <> 0 AND k % 4 = 0 AND k % 3 = 0
UNION ALL SELECT NULL, NULL, 'truncated diff hunk' FROM named WHERE k % 50 = 0""",
    "baseline_documents": f"""
SELECT p_partkey, problem, CASE WHEN problem IS NULL THEN n END::BIGINT AS count FROM part
JOIN {_values([(m, p, e) for m, (c, p) in enumerate(BASELINES) for e in ([x['count'] if p is None else 0 for x in c.get('entries', [_entry()])] or [None])], 'm, problem, n').replace('NULL::VARCHAR)', 'NULL)')} ON p_partkey % {len(BASELINES)} = m""",
    "exit_codes": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 3 WHEN s_suppkey % 3 > 0 THEN 2 WHEN s_suppkey % 2 > 0 THEN 1 ELSE 0 END::BIGINT AS exit_code FROM supplier",
    "discovered_paths": """
SELECT p_partkey, folder || '/' || name AS path
FROM (SELECT p_partkey, ['src', 'build', 'a/b', 'docs/.git', 'lib/tests', 'tests'][(p_partkey % 6)::INT + 1] AS folder,
             ['m.py', 'm.pyi', 'm.txt', '.py', 'test_m.py', 'build'][((p_partkey // 6) % 6)::INT + 1] AS name FROM part)
WHERE folder IN ('src') AND name IN ('m.py', 'm.pyi')""",
    "rule_catalog": """
SELECT code, num NOT IN (4, 11, 12, 13) AS on_by_default, num > 1 AS suppressible, num IN (4, 5, 6, 10, 11, 13) AS scoped_only,
       CASE WHEN num = 1 THEN NULL WHEN num IN (4, 5, 6, 10, 11, 13) THEN '# SAFETY[' || code || ']: <reason>' ELSE '# SAFETY: <reason>' END AS hint,
       CASE WHEN num IN (4, 11, 12, 13) THEN 'note' ELSE 'warning' END AS level,
       lower(code) || '--' || name || CASE WHEN num IN (4, 11, 12, 13) THEN '-experimental' ELSE '' END AS anchor
FROM (SELECT num, 'TW' || lpad(num::VARCHAR, 3, '0') AS code,
  ['no-chained-cast', 'cast-needs-evidence', 'typed-ignore-needs-evidence', 'no-widen-then-cast', 'cast-to-any', 'discarded-cast', 'checker-disable-needs-evidence',
   'no-type-check-needs-evidence', 'mock-patch-create-needs-evidence', 'constant-type-guard', 'unvalidated-boundary-cast', 'mock-patch-needs-spec', 'cast-to-typevar'][num] AS name
  FROM (SELECT unnest(range(1, 14))::INT AS num))""",
    "audit_sarif": """
SELECT '{"level":"' || CASE code WHEN 'TW012' THEN 'note' ELSE 'warning' END || '","locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '","uriBaseId":"SRCROOT"},"region":{"endColumn":' || last
       || ',"endLine":3,"startColumn":' || CASE code WHEN 'TW008' THEN 2 ELSE 1 END || ',"startLine":3}}}],"message":{"text":"'
       || CASE code WHEN 'TW008' THEN 'no_type_check decorator missing SAFETY evidence' ELSE 'mock patch call missing explicit fidelity decision' END
       || '"},"partialFingerprints":{"value":"' || substr(sha256('tw-fp-2|' || code || '|' || path || '|' || material || '|'), 1, 16) || '"},"ruleId":"' || code || '"}' AS value
FROM (SELECT 'pkg/m' || c_custkey || '.py' AS path, CASE c_custkey % 6 WHEN 0 THEN 'TW008' ELSE 'TW012' END AS code,
      CASE c_custkey % 6 WHEN 0 THEN 15 WHEN 1 THEN length('p(, create=True)') + length(c_custkey::VARCHAR) + 1 ELSE length('mock.patch()') + length(c_custkey::VARCHAR) + 1 END AS last,
      CASE c_custkey % 6 WHEN 0 THEN 'no-type-check-decorator|module|no_type_check|function|f' || c_custkey || '|OP:@ NAME:no_type_check'
        WHEN 1 THEN 'mock-patch-call|module|patch|create=true|fidelity=absent|kwargs=absent|NAME:p OP:( NUMBER:' || c_custkey || ' OP:, NAME:create OP:= NAME:True OP:)'
        ELSE 'mock-patch-call|module|patch|create=absent|fidelity=absent|kwargs=absent|NAME:mock OP:. NAME:patch OP:( NUMBER:' || c_custkey || ' OP:)' END AS material
      FROM customer WHERE c_custkey % 6 < 3)""",
    "audit_linter": f"SELECT line, col AS \"column\", code || ' cast call missing SAFETY evidence' AS text FROM ({_expected(cases.SCOPES)})",
    "audit_error_lines": f"SELECT 'pkg/m' || s_suppkey || '.py: encode: source contains null bytes' AS value FROM supplier WHERE s_suppkey % {len(cases.BROKEN)} = 1",
    "decoded_files": f"SELECT s_suppkey, kind, n::BIGINT AS n_chars FROM supplier JOIN {_values([(m, k, n) for m, (_, k, n) in enumerate(cases.CONTENTS)], 'm, kind, n').replace('NULL::VARCHAR)', 'NULL)')} ON s_suppkey % {len(cases.CONTENTS)} = m",
    "shown_names": f"SELECT s_suppkey, shown FROM supplier JOIN {_values([(m, s) for m, (_, s) in enumerate(cases.NAMES)], 'm, shown')} ON s_suppkey % {len(cases.NAMES)} = m",
    "rule_mismatch": "SELECT * FROM (VALUES ('TW007', 'missing'), ('TW099', 'unknown')) AS v(code, problem)",
}
