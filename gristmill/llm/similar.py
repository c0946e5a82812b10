"""One document of each group of near-duplicates: SimHash first, then all that SimHash cannot see.

Two texts are near-duplicates if their sets of word shingles have a Jaccard similarity of ``percent`` or more.
A SimHash radius finds the near ones cheaply, but by the angle of such sets a pair at 0.8 is about ten bits
apart, so no radius that an index can serve finds all of them. So there are two phases:

1. SimHash: texts whose fingerprints the Gray-order index links (see simhash) are pairs to be judged.
2. Prefixes: sets are put in one order for all; two sets that are similar enough share one of the first few
   shingles of each, so only those are dealt. The order puts shingles last that many texts of a sample hold,
   which decides the cost and never the result. Texts that are connected already are not compared again.

No pair is accepted but by its whole sets, and none is refused but by a bound: sizes, the place of the shared
shingle, and a parity bitmap of each set (as many bits as the set has members), whose differing bits are never
more than the members in which two sets differ. Bitmaps decide nearly all pairs, so texts travel for few.

A group (texts with one shingle among their first) gives links from its members to leaders; groups of more
than ``SMALL`` texts are kept, each list of members once. Those that are not in one component when the leaders'
links are judged are compared each with each by bitmaps four times as wide. They give all pairs that are not
refused, or, where these are very many, as many as would connect them, and are looked at again; the last time
they give all that are in different components still. So a group of near copies costs its size, and no pair is
left out. A group of more than ``group_rows`` texts is dealt in pairs of blocks, so none meets in one task.

Texts: A-Z lower-cased, words are runs of anything but ASCII white space; a text of fewer words than a
shingle is one shingle. Nulls and texts without words are copies of each other and of nothing else. Very long
texts are taken whole, 8 bytes a shingle. Repeated rows leave one. An empty table gives an empty result.
Columns come back as they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, quoted, release, settle
from .graph import components
from .simhash import LIMIT, first_of_groups, line_of, links, majority, shingle_hashes, text_digest

SHINGLE = 5
PERCENT = 80
#: One text in so many is looked at for common shingles, and so many of these are remembered.
SAMPLE = 4
COMMON = 200_000
#: Texts of a group that are compared each with each at once, and from which a group is dealt in blocks.
SMALL = 4
GROUP_ROWS = 50_000
#: Pairs for each text of a group from which it gives only those that would connect it, and rounds in which it may.
MANY = 4
FORESTS = 1
#: Width of the bitmaps then.
WIDE = 4
#: Bytes of bitmaps compared at once, and bytes of sets held.
CHUNK = 1 << 20
HELD = 32 << 20


def code_of(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line) - 2**63


def shingles(line: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a normalised line."""
    return np.unique(shingle_hashes(line, width).view(np.int64))


def _within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def prefix(found: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which similar sets share one, in the order of all sets."""
    if not len(found):
        return found
    late = _within(found, common)
    n = len(found)
    return np.concatenate((found[~late], found[late]))[: n - -(-percent * n // 100) + 1]


def bitmap(found: np.ndarray, width: int = 1) -> bytes:
    """Parities of the members by their low bits; width times as many as members, up to a power of two."""
    size = max(64, 1 << (max(1, len(found) * width) - 1).bit_length())
    odd = np.bincount(found.view(np.uint64) & np.uint64(size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _fold(marks: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (a row each) as they would be with so many bytes: parities add up."""
    return np.bitwise_xor.reduce(marks.reshape(len(marks), -1, size), axis=1)


def apart(one: bytes, others: list[bytes]) -> np.ndarray:
    """At least so many members are in one set alone, for one against each of the others."""
    own, out = np.frombuffer(one, np.uint8)[None], np.zeros(len(others), np.int64)
    sizes = np.array([len(x) for x in others])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        least = min(size, own.shape[1])
        mine = _fold(own, least)
        rows = max(1, CHUNK // size)
        for i in range(0, len(at), rows):
            part = at[i : i + rows]
            theirs = _fold(np.frombuffer(b"".join([others[k] for k in part.tolist()]), np.uint8).reshape(len(part), size), least)
            out[part] = np.bitwise_count((theirs ^ mine).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return out


def _near(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """May sets of n and m members be similar that differ in so many or more?"""
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _mapped(df: DataFrame, text: str, run: Callable[[dict], list], schema: str) -> DataFrame:
    """run(lines by code) over the distinct normalised texts of each task."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                lines = {}
                for t in whole.column(0).slice(at, 500):
                    line = line_of(t.as_py())
                    code = code_of(line)
                    if code not in seen:
                        seen.add(code)
                        lines[code] = line
                if lines:
                    yield pa.RecordBatch.from_arrays(run(lines), names=names)

    return df.select(quoted(text)).mapInArrow(go, schema)


def common_shingles(df: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that several texts of a sample hold; COMMON at most, so they may be collected."""

    def run(lines: dict) -> list:
        return [pa.array(np.concatenate([shingles(x, width) for x in lines.values()]))]

    some = df.where(F.pmod(F.xxhash64(quoted(text)), F.lit(SAMPLE)) == 0)
    counted = _mapped(some, text, run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(found.column(0).to_numpy()).astype(np.int64)


def sketches(df: DataFrame, key: str, text: str, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """k, th, code of every row; for the first of a code in each task also its fingerprint, n, marks, wide marks and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                codes, rows = [], []
                for t in batch.column(1):
                    line = line_of(t.as_py())
                    code = code_of(line)
                    codes.append(code)
                    if code in seen:
                        rows.append((None,) * 5)
                        continue
                    seen.add(code)
                    hashes = shingle_hashes(line, width)
                    found = np.unique(hashes.view(np.int64))
                    fp = majority(hashes) if len(hashes) else 0
                    rows.append((fp - (1 << 64) if fp >> 63 else fp, len(found), bitmap(found), bitmap(found, WIDE), prefix(found, common, percent)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.int64()), *columns], names=names)
        give_back()

    names = ["k", "th", "code", "fp", "n", "marks", "wide", "first"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    rows = df.select(quoted(key), quoted(text), text_digest(text))
    return rows.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, th string, code long, fp long, n long, marks binary, wide binary, first array<bigint>")


def _groups(rows: DataFrame, judge: Callable, schema: str, group_rows: int) -> DataFrame:
    """judge(columns of one group) for every group; rows have the group's key first, then a code."""
    key, code = rows.columns[:2]
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > group_rows)
    if not hot.isEmpty():  # in pairs of blocks: rows of any two blocks meet
        hot = settle(hot, "hot")
        blocks = F.ceil(F.col("__n") * 2 / group_rows).cast("int")
        own = F.pmod(F.xxhash64(code), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64(F.col(key), F.least(k, own), F.greatest(k, own)))
        dealt = F.explode(F.when(F.col("__n").isNull(), F.array(key)).otherwise(pairs))
        rows = rows.join(hot, key, "left").select(dealt.alias(key), *rows.columns[1:])
    rows = rows.repartition(key).sortWithinPartitions(key, code)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def judged(columns: list) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            starts, ends = np.append(0, new), np.append(new, len(columns[0]))
            out, size = [], 0
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                for part in judge(*[c[a:b] for c in columns[1:]]):
                    out.append(part)
                    size += len(part[0])
                    if size > 500_000:
                        yield from packed(out)
                        out, size = [], 0
            if out:
                yield from packed(out)

        def packed(parts: list) -> list[pa.RecordBatch]:
            whole = pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)
            return whole.group_by(names).aggregate([]).combine_chunks().to_batches()

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            if cut:
                yield from judged([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None:
            yield from judged(held)
        give_back()

    return rows.mapInArrow(run, schema)


def first_round(codes: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple]:
    """g, u, v: pairs to be judged (g 0), then members u of groups g to be looked at again."""
    codes, at = np.unique(codes, return_index=True)
    n, place = n[at], place[at]
    if len(codes) < 2:
        return
    left, linked = np.arange(len(codes)), 0
    while len(left) > 1:
        a, rest = left[0], left[1:]
        most = np.minimum(n[a] - place[a], n[rest] - place[rest])  # members both may have: the shared one is the first
        near = most * 100 >= percent * (n[a] + n[rest] - most)
        b = rest[near]
        linked += len(b)
        yield np.zeros(len(b), np.int64), np.full(len(b), codes[a]), codes[b]
        left = rest if len(codes) <= SMALL else rest[~near]
    if len(codes) > SMALL and linked:
        yield np.full(len(codes), code_of(codes.tobytes()) | 1), codes, np.zeros(len(codes), np.int64)


def second_round(codes: np.ndarray, n: np.ndarray, marks: np.ndarray, roots: np.ndarray, percent: int, every: bool) -> Iterator[tuple]:
    """g, u, v: pairs (g 0) of a group in different components that no bound refuses.

    If those are many for the group's size, and not all are asked for, only as many as connect the same, and the group.
    """
    if (roots == roots[0]).all():
        return
    order = np.argsort(n, kind="stable")
    codes, n, marks = codes[order], n[order], marks[order]
    labels = np.unique(roots[order], return_inverse=True)[1]
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    found, total, merged = [], 0, labels.copy()
    for a, b in enumerate(ends.tolist()):
        rest = np.arange(a + 1, b)
        rest = rest[labels[rest] != labels[a]]
        if not len(rest):
            continue
        rest = rest[_near(n[a], n[rest], apart(marks[a], marks[rest].tolist()), percent)]
        if every:
            yield np.zeros(len(rest), np.int64), np.minimum(codes[rest], codes[a]), np.maximum(codes[rest], codes[a])
            continue
        total += len(rest)
        other = rest[merged[rest] != merged[a]]
        met, at = np.unique(merged[other], return_index=True)
        merged[np.isin(merged, met)] = merged[a]
        if total > MANY * len(codes):  # what connects is enough for now
            found = [(k, tree, tree) for k, _, tree in found]
            rest = other[at]
        found.append((a, rest, other[at]))
    for a, rest, _ in found:
        yield np.zeros(len(rest), np.int64), np.minimum(codes[rest], codes[a]), np.maximum(codes[rest], codes[a])
    if total > MANY * len(codes):
        yield np.array([code_of(np.sort(codes).tobytes()) | 1]), codes[:1], codes[:1]


def _judged(df: DataFrame, text: str, pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs u, v that are similar, settled. Bitmaps come first; texts are fetched for what they leave."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            differ = [int(apart(a.as_py(), [b.as_py()])[0]) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(_near(n, m, np.array(differ, np.int64), percent)))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def of(code: int, line: pa.Scalar) -> np.ndarray:
            nonlocal size
            found = held.get(code)
            if found is None:
                found = shingles(line.as_py(), width)
                if size + found.nbytes > HELD:
                    held.clear()
                    size = 0
                held[code] = found
                size += found.nbytes
            return found

        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for u, v, s, t in zip(us, vs, batch.column(2), batch.column(3), strict=True):
                a, b = of(u, s), of(v, t)
                both = int(_within(a, b).sum())
                good.append(both * 100 >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        held.clear()
        give_back()

    one = sets.select(F.col("code").alias("u"), F.col("n").alias("a"), F.col("marks").alias("x"))
    two = sets.select(F.col("code").alias("v"), F.col("n").alias("b"), F.col("marks").alias("y"))
    left = settle(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b", "x", "y").mapInArrow(near, "u long, v long"), "pairs")
    needed = left.select(F.col("u").alias("code")).unionAll(left.select("v")).distinct()

    def lines_of(lines: dict) -> list:
        return [pa.array(list(lines), pa.int64()), pa.array(list(lines.values()), pa.binary())]

    texts = _mapped(df, text, lines_of, "code long, line binary").join(needed, "code", "left_semi").dropDuplicates(["code"])
    texts = settle(texts, "lines")
    release(df.sparkSession)
    rows = left.join(texts.select(F.col("code").alias("u"), F.col("line").alias("s")), "u")
    rows = rows.join(texts.select(F.col("code").alias("v"), F.col("line").alias("t")), "v")
    found = settle(rows.select("u", "v", "s", "t").mapInArrow(similar, "u long, v long"), "similar")
    forget(left, texts)
    release(df.sparkSession)
    return found


def _connected(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots (code, root), after the links found: only what they connect anew is looked at."""
    ends = found.join(roots.select(F.col("code").alias("u"), F.col("root").alias("a")), "u").join(roots.select(F.col("code").alias("v"), F.col("root").alias("b")), "v")
    new = settle(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "new-links")
    if new.isEmpty():
        return roots
    moved = components(new).select("node", F.col("root").alias("to"))
    after = settle(roots.join(moved, roots.root == moved.node, "left").select("code", F.coalesce("to", "root").alias("root")), "roots")
    forget(new, roots)
    return after


def _classes(df: DataFrame, key: str, text: str, width: int, percent: int, limit: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """k, th, code of every row; code, root of every code."""
    rows = settle(sketches(df, key, text, width, percent, common_shingles(df, text, width)), "sketches")
    sets = settle(rows.where("n is not null").drop("k", "th").dropDuplicates(["code"]), "sets")
    docs = settle(rows.select("k", "th", "code"), "codes")
    roots = settle(sets.select("code", F.col("code").alias("root")), "roots")
    forget(rows)
    release(df.sparkSession)

    # SimHash: a fingerprint stands for its texts by the least code
    prints = settle(sets.groupBy("fp").agg(F.min("code").alias("least")), "prints")
    linked = links(prints.select(F.col("fp").alias("code")), limit=limit, group_rows=group_rows)
    near = sets.join(prints, "fp").where("code <> least").select(F.col("least").alias("u"), F.col("code").alias("v"))
    ends = linked.join(prints.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    pairs = settle(near.unionAll(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))), "pairs")

    # prefixes, leaders first
    dealt = sets.select("code", "n", F.posexplode("first").alias("place", "token")).select("token", "code", "n", "place")
    dealt = settle(_groups(dealt, lambda c, n, p: first_round(c, n, p.astype(np.int64), percent), "g long, u long, v long", group_rows), "groups")
    release(df.sparkSession)
    led = settle(dealt.where("g = 0").select("u", "v").unionAll(pairs).distinct(), "pairs")
    members = settle(dealt.where("g <> 0").select("g", F.col("u").alias("code")).distinct(), "members")
    forget(dealt, pairs)
    release(df.sparkSession)
    roots = _connected(roots, _judged(df, text, led, sets, width, percent))

    # and what is left of the groups
    rounds = 0
    while True:
        rooted = members.join(roots, "code").select("g", "code", "root")
        open_ = rooted.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("g")
        again = rooted.join(open_, "g", "left_semi").join(sets.select("code", "n", "wide"), "code").select("g", "code", "n", "wide", "root")
        again = _groups(again, lambda c, n, m, r, every=rounds >= FORESTS: second_round(c, n, m, r, percent, every), "g long, u long, v long", group_rows)
        again = settle(again, "again")
        release(df.sparkSession)
        pairs = settle(again.where("g = 0").select("u", "v").distinct().join(led, ["u", "v"], "left_anti"), "pairs")
        roots = _connected(roots, _judged(df, text, pairs, sets, width, percent))
        led, rounds = led.unionAll(pairs), rounds + 1
        if again.where("g <> 0").isEmpty():
            return docs, roots


def keep_one(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, limit: int = LIMIT, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """df with one row of each group of near-duplicates, that with the smallest key (null: last), then text digest."""
    docs, codes = _classes(df, key, text, shingle, percent, limit, group_rows)
    release(df.sparkSession)
    return first_of_groups(df, docs, codes, key, text)
