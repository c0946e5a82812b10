"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints within four bits of each other agree on at least one of five bands, so every distinct
fingerprint goes to five groups (one a band) and links are looked for inside groups. A group above
``group_rows`` fingerprints is cut by five bands of the bits outside its own, and so on until it is small,
which loses no link either. A task holds its groups as a forest: fingerprints sorted by Gray rank, upper nodes for the bit
patterns that neighbours share, eight more bits a level. Pairs of nodes walk down together, carrying the
differences so far; a pair above the limit falls with all below it, and so does a pair whose leaves are
connected already. Groups report one link from each member to the smallest of its component, never
all pairs; components over all groups follow by stars (see graph).

Texts: A-Z lower-cased, words are runs of anything but ASCII white space, shingles of four words.
Nulls and texts without words have fingerprint zero, linked like any other. A null id is never the
smallest of a component unless there is none else. Repeated rows get a row each. Very long texts are hashed
whole, 8 bytes a shingle at a time in memory. An empty table gives an empty result. Other columns are not
looked at, whatever they are called. ``similar.keep_one`` leaves one text of each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, free_name, quoted, settle, table, utf8
from .graph import components, smallest_of

SHINGLE = 4
SEED = 42
LIMIT = 4
#: Fingerprints in a group from which it is cut further, and free bits from which it is not.
GROUP_ROWS = 5_000
LEAST_FREE = 16
#: Node pairs held at once.
PAIRS = 4_000_000


def shingle_hashes(line: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of a normalised line, in order."""
    words = line.split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, ends = [0, *ends[: n - 1]], ends[-n:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones, turned = np.zeros(64, np.int64), hashes.astype(">u8")
    for i in range(0, len(turned), 4096):
        ones += np.unpackbits(turned[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(turned)).tobytes(), "big")


def line_of(text: str | None) -> bytes:
    """A text's words in lower case with single blanks."""
    return b" ".join(utf8(text).translate(LOWER_TABLE).split())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(line_of(text), shingle))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def group_links(keys: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, smallest code of its component) among codes with equal keys."""
    if not len(codes):
        return codes, codes
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    # labels are places in (key, code) order, so that the smallest label is the smallest code
    by_code = np.lexsort((codes, keys))
    place = np.empty(len(codes), np.int64)
    place[by_code] = np.arange(len(codes))
    labels = np.arange(len(codes))
    near = np.flatnonzero((keys[1:] == keys[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= limit))
    smallest_of(labels, place[near], place[near + 1])

    new = np.ones(len(codes), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = [np.flatnonzero(new)]  # of the nodes of each level; level 0 is the group
    for bits in range(8, 65, 8):
        top = codes >> np.uint64(64 - bits)
        deeper = new.copy()
        deeper[1:] |= top[1:] != top[:-1]
        starts.append(np.flatnonzero(deeper))
    # children of node i of level k: first[k][i] .. first[k][i + 1] - 1 of level k + 1
    first = [np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])) for k in range(8)]

    def uniform(level: int) -> np.ndarray:
        """Label of each node whose leaves share one, else -1."""
        here = labels[place]
        low, high = np.minimum.reduceat(here, starts[level]), np.maximum.reduceat(here, starts[level])
        return np.where(low == high, low, -1)

    def descend(level: int, a: np.ndarray, b: np.ndarray, acc: np.ndarray) -> None:
        while level < 8:
            same = uniform(level)
            keep = (same[a] < 0) | (same[a] != same[b])
            a, b, acc = a[keep], b[keep], acc[keep]
            if not len(a):
                return
            na, nb = first[level][a + 1] - first[level][a], first[level][b + 1] - first[level][b]
            total = np.cumsum(na * nb)
            if total[-1] > PAIRS and len(a) > 1:
                half = len(a) // 2
                descend(level, a[:half], b[:half], acc[:half])
                descend(level, a[half:], b[half:], acc[half:])
                return
            if total[-1] > PAIRS:  # one pair of large nodes: by blocks of the left one's children
                x, y = int(a[0]), int(b[0])
                left, right = np.arange(first[level][x], first[level][x + 1]), np.arange(first[level][y], first[level][y + 1])
                step = max(1, PAIRS // len(right))
                for s in range(0, len(left), step):
                    part = left[s : s + step]
                    expand(level, np.repeat(part, len(right)), np.tile(right, len(part)), np.full(len(part) * len(right), acc[0]))
                return
            each = na * nb
            at = np.arange(each.sum()) - np.repeat(total - each, each)
            wide = np.repeat(nb, each)
            ca, cb = np.repeat(first[level][a], each) + at // wide, np.repeat(first[level][b], each) + at % wide
            level, a, b, acc = step_down(level, ca, cb, np.repeat(acc, each))
        if len(a):
            smallest_of(labels, place[starts[8][a]], place[starts[8][b]])

    def step_down(level: int, ca: np.ndarray, cb: np.ndarray, acc: np.ndarray) -> tuple:
        level += 1
        keep = ca <= cb
        ca, cb, acc = ca[keep], cb[keep], acc[keep]
        shift, mask = np.uint64(64 - 8 * level), np.uint64(255)
        x, y = codes[starts[level][ca]], codes[starts[level][cb]]
        acc = acc + np.bitwise_count((x ^ y) >> shift & mask)
        keep = acc <= limit
        return level, ca[keep], cb[keep], acc[keep]

    def expand(level: int, ca: np.ndarray, cb: np.ndarray, acc: np.ndarray) -> None:
        descend(*step_down(level, ca, cb, acc))

    roots = np.arange(len(starts[0]))
    several = np.diff(np.append(starts[0], len(codes))) > 1
    descend(0, roots[several], roots[several], np.zeros(int(several.sum()), np.int64))
    least = codes[by_code][labels]  # by place
    own = codes[by_code]
    linked = own != least
    return own[linked], least[linked]


def cuts(fixed: int, parts: int) -> list[int]:
    """Masks that part the bits outside fixed into so many bands."""
    free = [k for k in range(64) if not fixed >> k & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << k for k in free[a:b]) for a, b in pairwise(edges)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def groups(codes: DataFrame, limit: int, group_rows: int) -> DataFrame:
    """code, key: groups of which codes within limit bits share one. A group is all that agree on some bits.

    Groups of more than group_rows are cut by the bits on which they do not agree yet, again and again, until
    none is larger or LEAST_FREE bits are left, which bounds a group by itself: codes are distinct.
    """
    rows, done, fixed = codes.select("code", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("fixed")), [], [0]
    while True:
        masks = F.create_map(*[x for f in fixed for x in (F.lit(_signed(f)).cast("long"), F.array(*[F.lit(_signed(m)).cast("long") for m in cuts(f, limit + 1)]))])
        rows = rows.select("code", "key", "fixed", F.explode(F.element_at(masks, F.col("fixed"))).alias("mask"))
        key = F.xxhash64("key", "mask", F.col("code").bitwiseAND(F.col("mask")))
        rows = rows.select("code", key.alias("key"), F.col("fixed").bitwiseOR(F.col("mask")).alias("fixed"))
        hot = rows.where(F.bit_count("fixed") < 64 - LEAST_FREE).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        hot = hot.where(F.col("n") > group_rows).select("key")
        if hot.isEmpty():
            break
        hot = settle(hot, "hot")
        done.append(rows.join(hot, "key", "left_anti").select("code", "key"))
        rows = settle(rows.join(hot, "key", "left_semi").select("code", "key", "fixed"), "hot-rows")
        fixed = sorted(r[0] % 2**64 for r in rows.select("fixed").distinct().collect())  # kinds of masks, not groups: (limit + 1) ** depth at most
    for part in done:
        rows = rows.select("code", "key").unionAll(part)
    return rows.select("code", "key")


def links(codes: DataFrame, *, limit: int = LIMIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """u, v between distinct fingerprints of the column ``code`` that connect all that are within limit bits."""
    rows = groups(codes, limit, group_rows).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out(parts: list) -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in parts])
            found = group_links(keys, np.concatenate([c for _, c in parts]).view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names=["u", "v"])

        for batch in batches:
            codes, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if cut or (held and held[-1][0][-1] != keys[0]):
                held.append((keys[:cut], codes[:cut]))
                if sum(len(k) for k, _ in held) > 100_000:
                    yield out(held)
                    held = []
            held.append((keys[cut:], codes[cut:]))
        if held:
            yield out(held)

    return rows.mapInArrow(run, "u long, v long").distinct()


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """k, code (a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(codes, np.uint64).view(np.int64))], names=["k", "code"])

    return df.select(quoted(key), quoted(text)).mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, code long")


def text_digest(text: str) -> Column:
    return F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary"))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """key, fingerprint (hex), component_id of every row."""
    docs = settle(fingerprints(df, key=key, text=text), "fingerprints")
    codes = settle(docs.groupBy("code").agg(F.min("k").alias("first")), "codes")
    roots = components(links(codes, limit=limit, group_rows=group_rows))
    codes = codes.join(roots, codes.code == roots.node, "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    least = codes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = codes.join(least, "root").select("code", "component_id")
    return docs.join(classes, "code").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(df: DataFrame, docs: DataFrame, codes: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of df with the smallest key (null: last), then text digest, of each group; of equal rows, one.

    docs: k, th, code of every row; codes: code, root of every code. Rows are told apart by key and text, so
    documents that share a key, or have none, keep their own groups.
    """
    best = docs.groupBy("code").agg(F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("id"), "th")).alias("best"))
    best = best.join(codes.select("code", "root"), "code").groupBy("root").agg(F.min("best").alias("best"))
    th, own, digest = (free_name(df, x) for x in ("digest", "best_id", "best_digest"))
    best = best.select(F.col("best.id").alias(own), F.col("best.th").alias(digest))
    rows = df.withColumn(th, text_digest(text))
    rows = rows.join(best, quoted(key).eqNullSafe(F.col(own)) & (F.col(th) == F.col(digest)), "left_semi")
    return rows.dropDuplicates([key, th]).drop(th)


def op5_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
