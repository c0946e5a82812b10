"""Physical lines, snippets and escaping, in DataFrame expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines around a finding, characters of a line, findings in the body of a report.
CONTEXT, WIDTH, CAP = 2, 120, 25


def normalized(text: Column) -> Column:
    """Line ends to newlines, without a leading byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^﻿", "")


def count(text: Column) -> Column:
    """Physical lines: line feeds, carriage returns or both end one."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(text == "", 0).otherwise(F.size(F.split(plain, "\n", -1)) - F.when(plain.endswith("\n"), 1).otherwise(0))


def lines(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, line, text, offset (characters before it), comment_only, run_start (first line of the comment-only run above) of every line."""
    at = Window.partitionBy(key).orderBy("line")
    rows = sources.select(F.col(key), F.posexplode(F.split(normalized(F.col(text)), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    only = F.col("text").rlike(r"(?U)^[\s\x1C-\x1F]*#")
    rows = rows.withColumn("comment_only", only)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    # the last line above that is no comment ends the run
    last = F.max(F.when(~F.col("comment_only"), F.col("line"))).over(before)
    return rows.select(
        key, "line", "text", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("offset"), "comment_only", (F.coalesce(last, F.lit(0)) + 1).alias("run_start"),
    )


def cut(line: Column) -> Column:
    return F.when(F.length(line) > WIDTH, F.concat(F.substring(line, 1, WIDTH - 3), F.lit("..."))).otherwise(line)


def snippets(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (findings) with snippet: its first line, up to two lines on either side (cut), the line and column to point at; null without a source."""
    # texts may be far larger than the table they are made from, by whose size they would be sent to all
    text = sources.select(F.col("path").alias("sp"), F.split(normalized(F.col("text")), "\n", -1).alias("all")).hint("merge")
    rows = rows.join(text, F.col("path") == F.col("sp"), "left")
    start, end = F.greatest(F.lit(1), F.col("line") - CONTEXT), F.least(F.size("all"), F.col("line") + CONTEXT)
    part = F.transform(F.slice("all", start, end - start + 1), cut)
    inside = (F.col("line") >= 1) & (F.col("line") <= F.size("all"))
    at = F.col("line") - start
    column = F.least(F.greatest(F.col("col"), F.lit(0)), F.length(F.get(part, at)))
    snippet = F.struct(start.alias("start"), part.alias("lines"), (at + 1).alias("at"), column.alias("column"))
    return rows.withColumn("snippet", F.when(inside, snippet)).drop("sp", "all")


def top(rows: DataFrame, by: list[str], cap: int = CAP, within: list[str] = ()) -> DataFrame:
    """rows with rank (from 1, in the order of by, within groups) and shown: is it among the first cap?"""
    w = Window.partitionBy(*within).orderBy(*by)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("shown", F.col("rank") <= cap)


def escape(text: str) -> str:
    """Signs that a terminal would act on or hide, as codes."""
    out = []
    for c in text:
        n = ord(c)
        if n < 32 or 127 <= n <= 159:
            out.append(f"\\x{n:02x}")
        elif n in (0x2028, 0x2029) or unicodedata.category(c) == "Cf":
            out.append(f"\\u{n:04x}")
        else:
            out.append(c)
    return "".join(out)


def escaped(text: Column) -> Column:
    """The same as a column; the worker sees a null for plain ASCII, which stays in the JVM."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else escape(v))

    plain = text.rlike(r"\A[ -~]*\z")
    return F.when(plain, text).otherwise(run(F.when(~plain, text)))
