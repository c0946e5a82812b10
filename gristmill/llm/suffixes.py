"""Removal of repeated byte strings, exact to the byte.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else.

``double_prefixes`` is prefix doubling as it stands in books: rank pairs of every position are sorted at
growing offsets and ranked again until they are unique or reach the length. It holds for small inputs and
for tests; a row for every byte and round is many times the input (figures in the README). ``remove``
keeps its idea, growing lengths with the unique falling away, but ranks ranges of starts instead of
single ones, and names strings by 64-bit hashes that each text's task can compute for any length:

1. Each start p belongs to the anchor with the least 16-gram hash in the ``reach`` bytes from p on; a run
   of starts with one anchor shares its next length - reach + 1 bytes (its core) with every string that
   equals one of its own. Runs whose core is unique fall away.
2. Runs that occur again whole, at the same place of the anchor, are repeated in all their starts. The
   rest is cut into ranges of ``fine`` starts, which share length - fine + 1 bytes, and judged alike.
3. Only what is still open is named start by start at full length. Of equal ranges one speaks for all,
   with a weight of two.

Names are counted with partial aggregation, so groups of copies of any size meet only as counts, and
looked up again by joins that adaptive execution splits. Texts go through the shuffle twice, once for
step 2 (each distinct text once) and once for the result; rows of one text share its spans. Strings count as
equal only if two 64-bit hashes agree, that of their core and their own, so chance can only make one of two
different strings with one core: about m * m / 2**65 for a core with m different surroundings.

Texts are UTF-8; nulls and texts shorter than ``length`` lose nothing. Strings never cross documents.
Repeated rows repeat each other. An empty table gives an empty result. Other columns are not looked at,
whatever they are called. Texts of any length are worked on in blocks of ``BLOCK`` starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, release, settle, table, utf8

LENGTH = 400
#: Starts that may share an anchor, and starts in a range of the second step.
REACH, FINE = 192, 16
GRAM = 16
#: Ranges with one core from which it counts as hot; so many hot cores may be broadcast (8 bytes each).
HOT_ROWS, MOST_HOT = 20_000, 1_000_000
#: Tasks over which the surroundings of one core are dealt.
SALTS = 16
#: Starts of a text worked on at once.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Names:
    """Hashes of any substrings of one text."""

    def __init__(self, raw: bytes) -> None:
        values = _VALUES[np.frombuffer(raw, np.uint8)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(raw)), dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(raw) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.back[begin]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _whole(names: Names, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Name of all bytes of a range of starts together with its place at the anchor."""
    place = (anchor - first) * 1_000_003 + (last - first)
    return names(first, last + length) ^ place.astype(np.uint64) * np.uint64(_BASE)


def _anchored(raw: bytes, length: int, reach: int) -> tuple[np.ndarray, ...]:
    n = len(raw) - length + 1
    names = Names(raw)
    at = np.arange(len(raw) - GRAM + 1)
    least, place, width = names(at, at + GRAM), at, 1
    while width < reach:  # least of the next 1, 2, 4 ... places and where it stands; the first of equals
        step = min(width, reach - width)
        left, right = least[: len(least) - step], least[step:]
        later = right < left
        place = np.where(later, place[step:], place[: len(place) - step])
        least, width = np.where(later, right, left), width + step
    place = place[:n]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, n - 1)
    anchor = place[first]
    return first, last, anchor, names(anchor, anchor + length - reach + 1), _whole(names, first, last, anchor, length)


def _blocks(raw: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, len(raw) - length + 1, BLOCK):
        yield at, raw[at : at + BLOCK + length - 1]


def anchors(raw: bytes, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """First start, last start and anchor of each run, name of what follows the anchor, name of the whole run."""
    parts = [(at, _anchored(block, length, reach)) for at, block in _blocks(raw, length)]
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate([p[k] + at if k < 3 else p[k] for at, p in parts]) for k in range(5))


def finer(raw: bytes, runs: list[tuple[int, int, int]], length: int, fine: int) -> list[tuple]:
    """(first, last, anchor, core, whole, names of the starts) of the ranges that (first, last, anchor) are cut into.

    Ranges are multiples of fine before the anchor, so that equal strings fall into equal ranges.
    """
    out: list[tuple] = []
    for at, block in _blocks(raw, length):
        own = [r for r in runs if at <= r[0] < at + BLOCK]
        if not own:
            continue
        first, last, anchor = (np.array(c, np.int64) - at for c in zip(*own, strict=True))
        n = last - first + 1
        names, row = Names(block), np.repeat(np.arange(len(own)), n)
        p = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        part = (anchor[row] - p) // fine
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
        end = np.append(new[1:], len(p))
        f, e, a, k = p[new], p[end - 1], anchor[row[new]], part[new]
        begin = a - fine * k
        core = names(begin, begin - fine + 1 + length) ^ (k.astype(np.uint64) * np.uint64(_BASE))
        each = names(p, p + length).view(np.int64)
        columns = [(x + at).tolist() for x in (f, e, a)] + [x.view(np.int64).tolist() for x in (core, _whole(names, f, e, a, length))]
        out += zip(*columns, [each[i:j] for i, j in zip(new, end, strict=True)], [own[i] for i in row[new]], strict=True)
    return out


def covered(n_bytes: int, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (half open) of what the half-open spans cover."""
    if not len(begin):
        return []
    edges = np.zeros(n_bytes + 1, np.int32)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    steps = np.diff(np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


def _judged(ranges: DataFrame, name: str) -> DataFrame:
    """rid, place, weight, bad, open of the ranges (rid, place, weight, core, whole) whose core is not unique."""
    often = settle(ranges.groupBy("core").agg(F.sum("weight").alias("n")).where("n > 1").select(F.col("core").alias("c"), "n"), "often")
    # ranges of very frequent cores need no look-up among all: there are few such cores, so they are told apart without a shuffle
    hot, same = often.where(F.col("n") > HOT_ROWS).select("c"), F.col("core") == F.col("c")
    n_hot = hot.count()
    if 0 < n_hot <= MOST_HOT:
        hot = F.broadcast(hot)
        kept = ranges.join(hot, same, "left_semi").unionAll(ranges.join(hot, same, "left_anti").join(often, same, "left_semi"))
    else:
        kept = ranges.join(often, same, "left_semi")
    ranges = settle(kept, name)
    forget(often)
    release(ranges.sparkSession)
    equal = ranges.groupBy("core", "whole").agg(F.sum("weight").alias("n"), F.min(F.struct("rid", "place")).alias("speaker"))
    single = equal.groupBy("core").agg(F.min("n").alias("least")).where("least = 1")
    # a hot core has very many wholes: they are dealt over SALTS tasks, and what is known of the core goes to each
    single = single.select(F.col("core").alias("c"), F.lit(True).alias("any"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod("whole", F.lit(SALTS))
    both = F.xxhash64("core", "whole")  # dealt by this, not by the core alone
    equal = equal.join(single, (F.col("core") == F.col("c")) & (salt == F.col("s")), "left")
    equal = equal.select(both.alias("k"), F.col("core").alias("kc"), F.col("whole").alias("kw"), "n", "any", "speaker")
    marked = ranges.join(equal, (both == F.col("k")) & (F.col("core") == F.col("kc")) & (F.col("whole") == F.col("kw")))
    speaks = F.col("any") & (F.col("speaker.rid") == F.col("rid")) & (F.col("speaker.place") == F.col("place"))
    kept = [c for c in ranges.columns if c not in ("core", "whole", "weight")]
    weight = F.when(F.col("n") > 1, 2).otherwise(1).alias("weight")
    marked = marked.select(*kept, weight, (F.col("n") > 1).alias("bad"), (F.coalesce(speaks, F.lit(False)) | (F.col("n") == 1)).alias("open"))
    marked = settle(marked, f"{name}-marked")
    release(marked.sparkSession)
    return marked


def _place(first: Column, last: Column, anchor: Column) -> Column:
    """A range in one long: first start, how far the anchor and the last start are from it."""
    return F.shiftleft(first.cast("long"), 24) + F.shiftleft((anchor - first).cast("long"), 12) + (last - first)


def _ends() -> tuple[Column, Column, Column]:
    """First start, last start and anchor of the column place."""
    place = F.col("place")
    first, mask = F.shiftrightunsigned(place, 24), F.lit(4095).cast("long")
    last, anchor = first + place.bitwiseAND(mask), first + F.shiftrightunsigned(place, 12).bitwiseAND(mask)
    return first.cast("int").alias("first"), last.cast("int").alias("last"), anchor.cast("int").alias("anchor")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_ranges(df: DataFrame, *, text: str = "text", length: int = LENGTH, reach: int = REACH, fine: int = FINE) -> DataFrame:
    """th (MD5 of a text), spans (array of first, last): starts of repeated strings, for every distinct text that has any."""
    if reach + GRAM > length or reach > 4095 or fine > reach:
        raise ValueError("reach and fine do not fit the length")
    texts = df.select(_digest(F.col(text)).alias("th"), F.col(text).alias("t")).where(F.octet_length("t") >= length)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                found = [anchors(utf8(t), length, reach) for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), *(pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in range(3))]
                columns += [pa.array([f[k].view(np.int64) for f in found], pa.list_(pa.int64())) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=["th", "first", "last", "anchor", "core", "whole"])

    shape = "th binary, first array<int>, last array<int>, anchor array<int>, core array<bigint>, whole array<bigint>"
    docs = settle(texts.mapInArrow(name, shape).withColumn("rid", F.monotonically_increasing_id()), "anchors")
    one = docs.select("rid", F.explode(F.arrays_zip("first", "last", "anchor", "core", "whole")).alias("a"))
    one = one.select("rid", _place(F.col("a.first"), F.col("a.last"), F.col("a.anchor")).alias("place"), F.lit(1).alias("weight"), "a.core", "a.whole")
    runs = _judged(one, "runs")

    # one row a text: copies are alike, so the least id stands for all of them
    owners = docs.groupBy("th").agg(F.min("rid").alias("rid"))
    ask = runs.where("open").select("rid", F.struct(*_ends(), "weight").alias("r"))
    ask = ask.groupBy("rid").agg(F.collect_list("r").alias("runs")).join(docs.select("rid", "th"), "rid")
    ask = ask.groupBy("th").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # runs of open texts only: no more than the text has
    ask = ask.join(owners, "th").select("th", "rid", "runs")
    single = texts.groupBy("th").agg(F.first("t").alias("t"))  # pre-aggregated: copies do not meet

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                out = []
                for rid, raw, runs in zip(*whole.slice(i, 200).columns, strict=True):
                    weights = {(r["first"], r["last"], r["anchor"]): r["weight"] for r in runs.as_py()}
                    for f, e, a, core, whole_name, each, own in finer(utf8(raw.as_py()), sorted(weights), length, fine):
                        w = weights[tuple(int(x) for x in own)]
                        out.append((rid.as_py(), f << 24 | (a - f) << 12 | e - f, w, core, whole_name, each))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "place", "weight", "core", "whole", "each"])

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    parts = ask.join(single, "th").select("rid", "t", "runs").mapInArrow(cut, "rid long, place long, weight int, core long, whole long, each array<bigint>")
    parts = settle(parts, "ranges")
    release(parts.sparkSession)
    ranges = _judged(parts.drop("each"), "fine")

    still = ranges.where("open").select("rid", "place", "weight").join(parts.select("rid", "place", "core", "each"), ["rid", "place"])
    starts = still.select("rid", "weight", "core", _ends()[0], F.posexplode("each").alias("i", "h"))
    starts = settle(starts.select("rid", "weight", (F.col("first") + F.col("i")).alias("p"), "core", "h"), "starts")
    twice = starts.groupBy("core", "h").agg(F.sum("weight").alias("n")).where("n > 1").select("core", "h")
    starts = starts.where("weight = 1").join(twice, ["core", "h"], "left_semi").select("rid", F.col("p").alias("first"), F.col("p").alias("last"))

    bad = runs.where("bad").unionByName(ranges.where("bad").select(*runs.columns)).select("rid", *_ends()[:2])
    bad = bad.unionByName(starts).join(owners.select("rid"), "rid", "left_semi")
    spans = bad.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return spans.join(owners, "rid").select("th", "spans")


def remove(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH, fine: int = FINE, with_kept: bool = True
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, spans (half open), kept (bytes; null unless with_kept), kept_sha256."""
    found = settle(repeated_ranges(df, text=text, length=length, reach=reach, fine=fine), "spans")
    release(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), _digest(F.col(text)).alias("th"))
    rows = rows.join(found, "th", "left").select("k", "t", "spans")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch, out = whole.slice(i, 500), []
                for value, ranges in zip(batch.column(1), batch.column(2), strict=True):
                    raw, spans = utf8(value.as_py()), []
                    if ranges.is_valid:
                        first, last = ranges.values.flatten()
                        spans = covered(len(raw), first.to_numpy(), last.to_numpy() + length)
                    ends = [0, *(e for _, e in spans)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True))
                    pairs = [{"start": a, "end": b} for a, b in spans]
                    out.append((len(raw), len(raw) - len(kept), len(spans), pairs, kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
                columns = [pa.array([r[k] for r in out], kinds[k]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pair, pa.binary(), pa.string())
    return rows.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")


def double_prefixes(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, p: starts of repeated strings by prefix doubling over every byte; key must be unique.

    Ranks begin with the single bytes. In each round the pairs (rank at p, rank at p + offset) are grouped and
    ranked again by a sort; positions with a unique rank fall away, for no longer string of theirs repeats.
    """
    codes = F.transform(F.sequence(F.lit(1), F.octet_length("b")), lambda i: F.conv(F.hex(F.substring("b", i, 1)), 16, 10).cast("long"))
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b")).where(F.octet_length("b") >= length)
    ranks, reached = rows.select("k", F.posexplode(codes).alias("p", "r")), 1
    while reached < length:
        step = min(reached, length - reached)
        after = ranks.select(F.col("k"), (F.col("p") - step).alias("p"), F.col("r").alias("s"))
        pairs = ranks.join(after, ["k", "p"])
        names = pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "s", F.xxhash64("r", "s").alias("new"))
        ranks = settle(pairs.join(names, ["r", "s"]).select("k", "p", F.col("new").alias("r")), "ranks")
        reached += step
    return ranks.select(F.col("k").alias(key), "p")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), with_kept=False).drop("kept", "spans")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The query's rows by counting every string; for tests."""
    from collections import Counter

    raws = [utf8(t) for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        bad = [i for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1]
        gone = sorted({j for i in bad for j in range(i, i + length)})
        spans = sum(1 for k, j in enumerate(gone) if not k or gone[k - 1] != j - 1)
        kept = bytes(c for j, c in enumerate(r) if j not in set(gone)) if gone else r
        out.append((len(r), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (SELECT rid, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) AS m FROM d, LATERAL (SELECT unnest(range(greatest(0, len(h) // 2 - {LENGTH - 1}))) AS p)
), bad AS (SELECT rid, p FROM starts QUALIFY count(*) OVER (PARTITION BY m) > 1
), parted AS (
  SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS part
  FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM bad)
), spans AS (SELECT rid, min(p) AS a, max(p) + {LENGTH} AS b FROM parted GROUP BY rid, part
), pieces AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS since FROM spans
), cut AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM pieces JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""
