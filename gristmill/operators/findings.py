"""Candidates, rules, evidence, fingerprints and what is done with findings, all as DataFrame plans."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import directives as D
from ..plans import catalog as C
from . import names as N

SCHEME = "tw-fp-2"
FINDING = ["code", "path", "line", "col", "end_line", "end_col", "message", "fingerprint"]


def fingerprint(prefix: str, *parts: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), *parts), 256), 1, 16)


def _has(flag: str) -> Column:
    return F.coalesce(F.array_contains("flags", flag), F.lit(False))


def candidates(facts: DataFrame, codes: list[str] = C.CODES) -> DataFrame:
    """All candidates with what rules ask of them: met (codes whose condition holds) and always (those no comment covers).

    Columns: path, kind, id, scope_path, line, col, end_line, end_col, low, high (lines at which evidence counts), norm, host, dup, met, always.
    """
    bound = N.bindings(facts)
    known = N.by_fact(N.lookup(facts, bound))
    rows = facts.where("fact IN ('call', 'decorator', 'patch', 'guard')").join(known, ["path", "fact", "id"], "left")
    patch = F.col("callee").isin(C.MOCKS)
    counts = {
        "call": F.col("callee_kind") == "cast", "decorator": F.col("unchecked"), "patch": patch, "guard": F.col("returns").isin("typing.TypeGuard", "typing.TypeIs"),
    }
    rows = rows.where(reduce(lambda a, b: a | b, [(F.col("fact") == k) & F.coalesce(v, F.lit(False)) for k, v in counts.items()]))
    form = F.when(F.col("callee") == "mock.patch.object", "patch.object").otherwise("patch")
    decided = _has("fidelity") | (F.col("level") > F.when(form == "patch.object", 2).otherwise(1))
    said = lambda c, yes: F.when(c, yes).otherwise("absent")
    norm = F.when(
        F.col("fact") == "patch", F.concat(form, F.lit("|create="), said(_has("create"), "true"), F.lit("|fidelity="), said(decided, "present"), F.lit("|kwargs="), said(_has("splat"), "present"))
    ).when(F.col("fact") == "guard", F.concat_ws("|", F.substring_index("returns", ".", -1), "norm")).otherwise(F.col("norm"))
    rows = rows.withColumn("norm", norm).withColumn("kind", F.col("fact"))

    calls = rows.where("fact = 'call'").select("path", "scope", "id", "value_node")
    inner = calls.select("path", "scope", F.col("id").alias("value_node"), F.lit(True).alias("has_child"))
    outer = calls.join(inner, ["path", "scope", "value_node"]).select("path", "scope", F.col("value_node").alias("id"), F.lit("call").alias("fact"), F.lit(True).alias("is_child"))
    rows = rows.join(inner, ["path", "scope", "value_node"], "left").join(outer, ["path", "fact", "scope", "id"], "left")
    if "TW013" in codes:
        proven = N.type_variables(bound, known).select("path", F.struct("scope", "id").alias("typevar"), F.lit(True).alias("is_typevar"))
        rows = rows.join(proven, ["path", "typevar"], "left")
    if "TW004" in codes:
        wide = N.widened(bound, known).select("path", "scope", F.col("name").alias("value_name"), F.struct(F.col("line"), F.col("col")).alias("widened_at"))
        rows = rows.join(wide, ["path", "scope", "value_name"], "left")

    cast, alone = F.col("fact") == "call", (F.col("fact") == "call") & F.col("is_child").isNull()
    meets = {
        "TW001": alone & F.col("has_child"), "TW002": alone, "TW005": cast & (F.col("type") == "typing.Any"), "TW006": alone & _has("discarded"),
        "TW008": F.col("fact") == "decorator", "TW009": (F.col("fact") == "patch") & _has("create"),
        "TW010": (F.col("fact") == "guard") & _has("constant") & ~F.col("overload") & ~F.col("protocol"),
        "TW011": alone & F.col("parser").isin(C.PARSERS) & ~F.coalesce(F.col("type_kind").isin("any", "object"), F.lit(False)),
        "TW012": (F.col("fact") == "patch") & ~decided & ~_has("splat"),
    }
    if "TW013" in codes:
        meets["TW013"] = alone & F.col("is_typevar")
    if "TW004" in codes:
        meets["TW004"] = cast & (F.col("widened_at") < F.struct("line", "col"))
    columns = ["path", "kind", "id", "scope_path", "line", "col", "end_line", "end_col", "low", "high", "norm", "host"]
    rows = rows.select(*columns, _codes(meets, codes).alias("met"), _codes({"TW001": F.lit(True)}, codes).alias("always"))
    every = rows.unionByName(_comments(facts, columns, codes))
    same = Window.partitionBy("path", "kind", "scope_path", "norm", "host")
    every = every.withColumn("size", F.count(F.lit(1)).over(same)).withColumn("at", F.row_number().over(same.orderBy("id")) - 1)
    return every.withColumn("dup", F.when(F.col("size") == 1, "").otherwise(F.format_string("dup:%d:%d", "size", "at"))).drop("size", "at")


def _codes(meets: dict[str, Column], codes: list[str]) -> Column:
    found = [F.when(meets[c], c) for c in codes if c in meets]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _comments(facts: DataFrame, columns: list[str], codes: list[str]) -> DataFrame:
    """Type-ignore comments, and checker-disable comments at the start of lines of the module."""
    comments = facts.where("fact = 'comment' AND host IS NOT NULL")
    ignores = comments.where(D.is_type_ignore(F.col("text"))).withColumn("kind", F.lit("ignore")).withColumn("norm", D.ignore_norm(F.col("text")))
    void = ~D.ignore_codes_valid(F.col("text"))
    unreasoned = void | D.inline_reason(F.col("text")).isNull()
    ignores = ignores.select(*columns, _codes({"TW003": unreasoned}, codes).alias("met"), _codes({"TW003": void}, codes).alias("always"))
    disables = comments.where((F.col("col") == 0) & (F.col("scope") == 0)).withColumn("norm", D.disable_norm(F.col("text"))).where("norm IS NOT NULL").withColumn("kind", F.lit("disable"))
    # evidence counts on the line above alone, if that is a comment; else there is no such line
    above = F.col("low") < F.col("line")
    disables = disables.withColumns({"low": F.when(above, F.col("line") - 1).otherwise(1), "high": F.when(above, F.col("line") - 1).otherwise(0)})
    return ignores.unionByName(disables.select(*columns, _codes({"TW007": F.lit(True)}, codes).alias("met"), F.array().cast("array<string>").alias("always")))


def uncovered(rows: DataFrame, facts: DataFrame, codes: list[str]) -> DataFrame:
    """Rows with one code each that they meet and no SAFETY comment covers.

    A comment counts at the last line of its logical line. For each rule the last line up to a candidate's ``high`` at
    which one counts is a running maximum; it covers the candidate if it isn't above ``low``. So evidence costs a sort.
    """
    notes = facts.where("fact = 'comment'").select("path", F.col("high").alias("at"), D.safety_codes(F.col("text")).alias("said")).where("said IS NOT NULL")
    notes = notes.select("path", "at", F.lit(0).alias("late"), D.accepted_codes(F.col("said")).alias("counts"))
    events = rows.where(F.size("met") > 0).withColumn("at", F.col("high")).withColumn("late", F.lit(1)).unionByName(notes, allowMissingColumns=True)
    upto = Window.partitionBy("path").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {c: F.max(F.when(F.array_contains("counts", c), F.col("at"))).over(upto) for c in codes if c in C.SUPPRESSIBLE}
    events = events.select("*", F.struct(*[v.alias(c) for c, v in last.items()] or [F.lit(0).alias("none")]).alias("last")).where("met IS NOT NULL")
    open_ = [F.when(F.array_contains("met", c) & (F.array_contains("always", c) | ~F.coalesce(F.col("last")[c] >= F.col("low"), F.lit(False)) if c in last else F.lit(True)), c) for c in codes]
    return events.withColumn("code", F.explode(F.array_compact(F.array(*open_)))).drop("at", "late", "counts", "last")


def findings(
    facts: DataFrame, select: set[str] | frozenset[str] | None = None, ignore: set[str] | frozenset[str] = frozenset(), scheme: str = SCHEME
) -> DataFrame:
    """code, path, line, col, end_line, end_col, message, fingerprint of every rule that runs. Selecting nothing finds nothing."""
    codes = C.active(select, ignore)
    rows = candidates(facts, codes)
    rows = uncovered(rows, facts, codes) if codes else rows.withColumn("code", F.lit("")).where("false")
    hosts = facts.where("fact = 'host'").select("path", F.col("id").alias("host"), F.col("text").alias("host_text"))
    rows = rows.join(hosts, ["path", "host"], "left")
    kind, message = F.element_at(N._table(C.KIND_NAMES), F.col("kind")), F.element_at(N._table(C.MESSAGES), F.col("code"))
    parts = [F.col("code"), F.col("path"), kind, F.col("scope_path"), F.col("norm"), F.coalesce("host_text", F.lit("")), F.col("dup")]
    return rows.select("code", "path", "line", "col", "end_line", "end_col", message.alias("message"), fingerprint(scheme, *parts).alias("fingerprint"))


def errors(facts: DataFrame) -> DataFrame:
    """path, kind, message of the files that could not be analysed."""
    return facts.where("fact = 'error'").select("path", F.col("name").alias("kind"), F.col("text").alias("message"))


def ordered(rows: DataFrame) -> DataFrame:
    """Findings by path, line, column, code and fingerprint."""
    return rows.orderBy("path", "line", "col", "code", "fingerprint")


def nfc(text: Column) -> Column:
    """The composed form of a text; ASCII texts are one already and stay in the JVM, the worker sees a null for them."""
    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    plain = text.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, text).otherwise(compose(F.when(~plain, text)))


def on_changed_lines(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings with any line of their range among changed(path, line). Paths that differ only in composition are one.

    The number of changed lines up to a place is a running count, so a finding costs two events, not its lines.
    """
    lines = changed.select(nfc(F.col("path")).alias("np"), F.col("line").cast("long").alias("at")).distinct()
    keyed = rows.withColumn("row", F.struct(*rows.columns)).withColumn("np", nfc(F.col("path")))
    ends = keyed.select("np", "row", F.explode(F.array(F.struct((F.col("line") - 1).cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end_line").cast("long").alias("at"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("np", "row", "e.at", "e.sign", F.lit(1).alias("late"))
    events = lines.select("np", "at", F.lit(0).alias("late")).unionByName(ends, allowMissingColumns=True)
    upto = Window.partitionBy("np").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("n", F.sum(F.when(F.col("late") == 0, 1).otherwise(0)).over(upto)).where("row IS NOT NULL")
    # a row has one path, so its events lie together already
    kept = events.groupBy("np", "row").agg(F.sum(F.col("n") * F.col("sign")).alias("inside"), (F.count(F.lit(1)) / 2).cast("int").alias("times")).where("inside > 0")
    return kept.select("row.*", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def minus_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Multiset difference: of each fingerprint the first ``count`` findings go."""
    order = Window.partitionBy("fingerprint").orderBy("path", "line", "col", "code")
    ranked = rows.withColumn("__k", F.row_number().over(order))
    budget = baseline.groupBy(F.col("fingerprint").alias("__f")).agg(F.sum("count").alias("__n"))
    kept = ranked.join(budget, F.col("fingerprint") == F.col("__f"), "left").where(F.col("__k") > F.coalesce("__n", F.lit(0)))
    return kept.drop("__k", "__f", "__n")


def baseline_of(rows: DataFrame) -> DataFrame:
    """fingerprint, code, path (of the first finding) and count, as a baseline has them."""
    first = F.min(F.struct("path", "line", "col", "code"))
    return rows.groupBy("fingerprint").agg(first.alias("f"), F.count(F.lit(1)).alias("count")).select("fingerprint", "f.code", "f.path", "count")


def count_by_rule(rows: DataFrame) -> DataFrame:
    """Findings and files of each rule that has any, with its position in the catalog."""
    position = F.element_at(N._table({c: k for k, c in enumerate(C.CODES)}), F.col("code"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files")).withColumn("position", position)


def exit_codes(runs: DataFrame) -> DataFrame:
    """runs with exit_code: 3 for a usage error, 2 for analysis errors, 1 for findings, else 0 (columns usage, errors, findings are counts)."""
    return runs.withColumn("exit_code", F.when(F.col("usage") > 0, 3).when(F.col("errors") > 0, 2).when(F.col("findings") > 0, 1).otherwise(0))
