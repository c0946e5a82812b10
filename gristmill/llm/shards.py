"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row gets a global number: rows are ordered by a hash bucket of key, text's CRC-32 and size (so that a
key that many rows share does not fill one), then by key and tie-breakers, so numbering needs one shuffle of narrow rows and a prefix sum over a fixed number of
bucket counts, never a global sort. A keyed Feistel network over the mixed-radix square a x b >= N
permutes the numbers; results outside 0..N-1 walk on along their cycle. ``p mod shards`` is the shard
and ``p div shards`` the slot, so shard sizes differ by one at most, slots have no gaps, and both can
be computed for any row number (``locate``) or inverted (``row_number_at``) without the data.

Nulls: a null key or text counts as a value of its own; a null text has no bytes. Ties and repeated
rows get different numbers. Very long texts are measured where they are. An empty table gives an empty
result. Other columns are not looked at; ``rows`` brings them along as one column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import md5_long, quoted, table, whole_row

#: A Mersenne prime: products of two residues stay below 2**62.
PRIME = 2147483647
ROUNDS = 6
#: Buckets for numbering. Their counts are broadcast: at most this many rows of two longs.
BUCKETS = 16384
#: Most steps on a cycle. For larger domains the chance to need more is below (1 / 64) ** 64; it then raises.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    keys, state = [], (seed * 6364136223846793005 + 1442695040888963407) % 2**64
    for _ in range(ROUNDS):
        triple = []
        for _ in range(3):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            triple.append((state >> 33) % (PRIME - 1) + 1)
        keys.append(tuple(triple))
    return keys


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and few numbers to spare."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: int, key: tuple[int, int, int]) -> int:
    y = (x % PRIME * key[0] + key[1]) % PRIME
    return (y * y + key[2]) % PRIME


def permute(x: int, n: int, seed: int) -> int:
    """The place of row number x among n, in plain Python."""
    a, b = sides(n)
    while True:
        left, right = x // b, x % b
        for i, key in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + _mix(right, key)) % a
            else:
                right = (right + _mix(left, key)) % b
        x = left * b + right
        if x < n:
            return x


def invert(p: int, n: int, seed: int) -> int:
    """The row number whose place is p."""
    a, b = sides(n)
    while True:
        left, right = p // b, p % b
        for i, key in reversed(list(enumerate(round_keys(seed)))):
            if i % 2 == 0:
                left = (left - _mix(right, key)) % a
            else:
                right = (right - _mix(left, key)) % b
        p = left * b + right
        if p < n:
            return p


def locate(row_number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = permute(row_number, n, seed)
    return p % shards, p // shards


def row_number_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    return invert(slot * shards + shard, n, seed)


def _feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    left, right = F.call_function("div", x, b), x % b
    for i, key in enumerate(round_keys(seed)):
        y = ((right if i % 2 == 0 else left) % F.lit(PRIME).cast("long") * F.lit(key[0]).cast("long") + key[1]) % PRIME
        z = (y * y + F.lit(key[2]).cast("long")) % PRIME
        if i % 2 == 0:
            left = (left + z) % a
        else:
            right = (right + z) % b
    return left * b + right


def numbered(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """df with __row (0..N-1) and __n (N)."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (key, *ties)]
    bucket = F.pmod(md5_long(F.concat_ws(":", *own)), F.lit(BUCKETS)).cast("int")
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__c"))
    over = Window.orderBy("__bucket")
    starts = counts.select(
        "__bucket",
        (F.sum("__c").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")).alias("__start"),
        F.sum("__c").over(Window.partitionBy()).alias("__n"),
    )
    inside = Window.partitionBy("__bucket").orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties])
    return (
        rows.withColumn("__in", F.row_number().over(inside))
        .join(F.broadcast(starts), "__bucket")  # BUCKETS rows at most
        .withColumn("__row", F.col("__start") + F.col("__in") - 1)
        .drop("__bucket", "__in", "__start")
    )


def shard(
    df: DataFrame, *, shards: int = 40, seed: int = 42, key: str = "doc_id", text: str = "text", rows: bool = False
) -> DataFrame:
    """key, size, text_crc32, shard, slot for every row; with rows also the row itself (a struct)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [whole_row(df).alias("row")] if rows else []
    rows = df.select(
        quoted(key).alias("__key"),
        (F.coalesce(F.octet_length(quoted(text)), F.lit(0)) + 16).cast("long").alias("__size"),
        F.coalesce(F.crc32(quoted(text).cast("binary")), F.lit(0)).cast("long").alias("__crc"),
        *kept,
    )
    rows = numbered(rows, "__key", ["__crc", "__size"])
    n = F.col("__n")
    root = F.floor(F.sqrt((n - 1).cast("double"))).cast("long")  # correct the float root to the integer one
    root = root + F.when((root + 1) * (root + 1) <= n - 1, 1).otherwise(0) - F.when(root * root > n - 1, 1).otherwise(0)
    rows = rows.withColumn("__a", root + 1).withColumn("__b", F.expr("(__n + __a - 1) div __a"))
    rows = rows.withColumn("__p", _feistel(F.col("__row"), F.col("__a"), F.col("__b"), seed))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.col("__p"),
        lambda acc, _: F.when(acc < F.col("__n"), acc).otherwise(_feistel(acc, F.col("__a"), F.col("__b"), seed)),
    )
    rows = rows.withColumn("__p", F.when(F.col("__p") < n, F.col("__p")).otherwise(walked))
    place = F.when(F.col("__p") < n, F.col("__p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return rows.withColumn("__p", place).select(
        F.col("__key").alias(key),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.pmod(F.col("__p"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__p div {int(shards)}").alias("slot"),
        *["row"] * len(kept),
    )


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _sql() -> str:
    """The same numbers by DuckDB: one CTE a step, the walk as a recursive one."""
    table_crc = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table_crc.append(c)
    steps = []
    left, right = "p // b", "p % b"
    steps.append(f"SELECT *, {left} AS l, {right} AS r FROM {{}}")
    for i, (k0, k1, k2) in enumerate(round_keys(42)):
        x, to, mod = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        y = f"(({x} % {PRIME} * {k0} + {k1}) % {PRIME})"
        steps.append(f"SELECT * REPLACE (({to} + ({y} * {y} + {k2}) % {PRIME}) % {mod} AS {to}) FROM ({{}})")
    steps.append("SELECT id, n, a, b, (l * b + r)::BIGINT AS p FROM ({})")
    query = "walk_in"
    for step in steps:
        query = step.format(query)
    return f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bs
  FROM documents
), docs AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || ':' || crc || ':' || size), 1, 15))::BIGINT % {BUCKETS} AS bucket FROM (SELECT doc_id, size::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda acc, x:
             xor(acc >> 8, ({table_crc}::BIGINT[])[(xor(acc, x) & 255) + 1])), 4294967295::BIGINT)::BIGINT AS crc
  FROM bytes)
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, crc, size) - 1 AS id, count(*) OVER () AS n FROM docs
), sided AS (
  SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM numbered
), start AS (
  SELECT id, n, a, (n + a - 1) // a AS b, id AS p FROM sided
), walk(id, n, a, b, p, step) AS (
  SELECT id, n, a, b, p, 0 FROM start
  UNION ALL
  SELECT id, n, a, b, p, step + 1 FROM (
    SELECT q.*, s.step FROM (SELECT id AS sid, step FROM walk WHERE step = 0 OR p >= n) s
    JOIN ({query.replace("walk_in", "(SELECT id, n, a, b, p FROM walk WHERE step = 0 OR p >= n)")}) q ON q.id = s.sid)
), placed AS (SELECT id, p FROM walk WHERE step > 0 AND p < n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p % 40)::INT AS shard, p // 40 AS slot, NULL::INT AS grown_shard
FROM numbered JOIN placed USING (id)
"""


OP8_SQL = _sql()
