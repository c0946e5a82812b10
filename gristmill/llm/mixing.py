"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Each source may be repeated ``max_epochs`` times at most. With caps c = max_epochs * size and weights
w, the feasible targets are min(c, level * w): sources sorted by c / w fill up first, so the clamped
set is a prefix and the level follows from exact integer sums, without iterating. A document is then
taken floor(target / size) times, and the fractional rest goes to documents in seeded hash order: each
once more until the target's whole words are reached, which falls within one document. That one is taken
in part (its first words), or, with ``whole_documents``, wholly or not at all, whichever is nearer.
Hot sources are dealt over buckets of a hash of key and text, so no source or key is ever gathered in
one task; only sums per (source, bucket) are. Targets are found on one row a source.

Nulls: a null source is a source of its own, last in order; a null text has no words. Repeated rows
count each; which of equal rows is taken more often does not matter, for they are equal. Very long texts
are counted where they are. A source without words has target 0. An empty table gives an empty result.
Other columns are not looked at; ``rows`` brings them along as one column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, md5_long, quoted, table, whole_row

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Buckets a source is dealt over.
BUCKETS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """__source, __source_size (one row a source) to these and __target."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    df = sizes.withColumn("__k", F.row_number().over(order))
    df = df.withColumn("__w", F.element_at(cycle, F.pmod(F.col("__k") - 1, F.lit(len(weights))).cast("int") + 1))
    df = df.withColumn("__cap", F.col("__source_size") * max_epochs)
    ratio = F.col("__cap") / F.col("__w")
    filling = Window.orderBy(ratio, "__k")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    df = df.withColumn("__total", F.sum("__source_size").over(whole))
    # were all earlier sources clamped, this level would hold for the rest
    rest = F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    weight = F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    df = df.withColumn("__rest", rest).withColumn("__left", weight)
    clamped = F.col("__cap") * F.col("__left") < F.col("__rest") * F.col("__w")
    df = df.withColumn("__free", ~clamped)
    first = F.min_by(F.struct("__rest", "__left"), F.when(F.col("__free"), F.struct(ratio, F.col("__k")))).over(whole)
    df = df.withColumn("__first", first)
    filled = F.col("__w") * F.col("__first.__rest") / F.col("__first.__left")
    target = F.when(F.col("__free"), filled).otherwise(F.col("__cap").cast("double"))
    return df.select("__source", "__source_size", target.cast("double").alias("__target"))


def mix(
    df: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42, whole_documents: bool = False,
    key: str = "doc_id", text: str = "text", source: str = "source", rows: bool = False,
) -> DataFrame:
    """key, size, source_size, target, taken, times (whole copies), part (words of a further, partial copy) for every row; with rows also the row itself (a struct)."""
    own = F.coalesce(quoted(key).cast("string"), F.lit("\0"))
    hashed = md5_long(F.concat_ws(":", F.lit(seed), own, F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary"))))
    kept = [whole_row(df).alias("row")] if rows else []
    rows = df.select(
        quoted(key).alias("__key"), quoted(source).alias("__source"),
        F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"), hashed.alias("__h"), *kept,
    ).withColumn("__bucket", F.expr(f"cast(__h div {2**60 // BUCKETS} as int)"))
    # narrow on purpose: this branch and the next each read only key, source and text
    buckets = rows.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__bucket_size"))
    by_source = Window.partitionBy("__source")
    buckets = buckets.withColumn("__source_size", F.sum("__bucket_size").over(by_source)).withColumn(
        "__before",
        F.sum("__bucket_size").over(by_source.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("__bucket_size"),
    )
    goal = targets(buckets.groupBy("__source").agg(F.first("__source_size").alias("__source_size")), weights, max_epochs)
    goal = goal.select(F.col("__source").alias("__s"), "__target")
    buckets = buckets.join(goal, F.col("__source").eqNullSafe(F.col("__s"))).select(
        F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__source_size", "__before", "__target"
    )
    rows = rows.join(buckets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__h", F.col("__key").asc_nulls_first(), "__size")
    earlier = F.coalesce(F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__before")
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("__target") - whole * F.col("__source_size")).cast("long")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), rest - earlier))
    if whole_documents:
        more = F.when(more * 2 >= F.col("__size"), F.col("__size")).otherwise(0).cast("long")
    full = F.when((F.col("__size") > 0) & (F.col("__more") == F.col("__size")), 1).otherwise(0)
    rows = rows.withColumn("__whole", whole).withColumn("__more", more)
    return rows.select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__whole") * F.col("__size") + F.col("__more")).alias("taken"),
        (F.col("__whole") + full).cast("int").alias("times"),
        F.when(full == 1, 0).otherwise(F.col("__more")).cast("long").alias("part"), *["row"] * len(kept),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times", "part")


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, chr(0)) || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap,
         sum(source_size) OVER () AS total FROM src
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER before_it, 0))::BIGINT AS rest,
         (sum(w) OVER () - coalesce(sum(w) OVER before_it, 0))::BIGINT AS weight_left
  FROM weighed WINDOW before_it AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (SELECT *, cap::HUGEINT * weight_left >= rest::HUGEINT * w AS free FROM levels
), level AS (SELECT rest, weight_left FROM marked WHERE free ORDER BY cap / w, k LIMIT 1
), goals AS (
  SELECT source, source_size,
         CASE WHEN free THEN (w * (SELECT rest FROM level))::DOUBLE / (SELECT weight_left FROM level)::DOUBLE
              ELSE cap::DOUBLE END AS target
  FROM marked
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (size * whole + greatest(0, least(size, floor(target - whole * source_size)::BIGINT - earlier)))::BIGINT AS taken
FROM placed
"""
