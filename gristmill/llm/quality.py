"""Quality rules: counts of a text's own repetition, and cross-document line frequency.

Lines are normalised (white space runs to one blank, lower case) and hashed; for each host the distinct
documents that hold a line are counted; rows of one key and one text are one document. Lines in more than
``max_documents`` documents and more than ``max_percent`` of the documents of a host are removed, so a
limit grows with its host; a document of which less than ``min_left`` of its words, or fewer than
``min_words`` words, is left is depleted and rejected.

One pass over the texts makes a narrow table (counts and line hashes) in the shared folder; each distinct
text of a host stands for its documents with their number, so copies shuffle no lines, and counting
shuffles (host, line) hashes, partially aggregated, so neither a hot host nor a hot line meets in one
task; lines are looked up again by a join that adaptive execution splits where a line is hot.

Nulls: a null text has no words and fails the base rules; null hosts are one host. Repeated rows count as
one document and get a row each. Lines without a word are never counted. Very long texts are counted whole.
An empty table gives an empty result. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, WORD, free_name, quoted, settle, table, utf8, with_column

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Documents of a host that may hold a line: so many of each hundred, and so many of however few.
MAX_PERCENT = 1
MAX_DOCUMENTS = 5
#: Part of its words that must be left of a document.
MIN_LEFT = 0.2

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; ids: equal for equal words."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = (keys ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    if not equal.any():
        return 0
    at = np.flatnonzero(equal)
    for k in range(window):  # hashes agree: do the words?
        same = ids[order[at] + k] == ids[order[at + 1] + k]
        at = at[same]
    marks = np.zeros(n, bool)
    marks[order[at]] = True
    marks[order[at + 1]] = True
    edges = np.zeros(len(ids) + 1, np.int32)
    edges[:n] += marks
    edges[window : window + n] -= marks
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: str | None, words: list[bytes], raw: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    return len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeat_words(ids)


def line_words(raw: bytes) -> dict[int, int]:
    """Words by hash of the normalised line they stand in."""
    found: dict[int, int] = {}
    for line in raw.lower().split(b"\n"):
        words = line.split()
        if words:
            h = xxhash.xxh64_intdigest(b" ".join(words)) - 2**63
            found[h] = found.get(h, 0) + len(words)
    return found


def measured(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row a document: key, host, the text's hash, the five counts, line hashes and words of lines."""
    rows = df.select(quoted(key).alias("k"), quoted(host).cast("string").alias("host"), quoted(text).alias("t"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(2).to_pylist()
                raws = [utf8(t) for t in texts]
                words = [r.split() for r in raws]
                flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
                ids, end = flat.indices.to_numpy(zero_copy_only=False), 0
                rows, hashes, lines, sizes = [], [], [], []
                for t, r, ws in zip(texts, raws, words, strict=True):
                    rows.append(counts(t, ws, r, ids[end : end + len(ws)]))
                    end += len(ws)
                    found = line_words(r)
                    hashes.append(xxhash.xxh64_intdigest(r) - 2**63)
                    lines.append(list(found))
                    sizes.append(list(found.values()))
                columns = [batch.column(0), batch.column(1), pa.array(hashes, pa.int64())]
                columns += [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                columns += [pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"k {kind}, host string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<bigint>, sizes array<int>"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _removals(docs: DataFrame, max_documents: int, max_percent: int) -> DataFrame:
    """rid, line, words of every line (of a text, once) that goes."""
    texts = docs.groupBy("host", "th", "k").agg(F.min("rid").alias("rid"))  # a document a row
    texts = texts.groupBy("host", "th").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("copies"))
    hosts = texts.groupBy(F.col("host").alias("h")).agg(F.sum("copies").alias("of"))
    pairs = docs.select("rid", "host", "lines").join(texts.select("first", "copies"), F.col("rid") == F.col("first"))
    pairs = pairs.select("host", F.explode("lines").alias("line"), "copies")
    common = pairs.groupBy("host", "line").agg(F.sum("copies").alias("n")).where(F.col("n") > max_documents)
    common = common.join(hosts, F.col("host").eqNullSafe(F.col("h")) & (F.col("n") * 100 > F.col("of") * max_percent))
    common = common.select("h", F.col("line").alias("l"))
    lines = docs.select("rid", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x"))
    lines = lines.select("rid", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("words"))
    return lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_semi")


def judge(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = MAX_DOCUMENTS,
    max_percent: int = MAX_PERCENT, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """key, the counts, base_failed, n_removed_words, kept."""
    docs = measured(df, key, text, host).withColumn("rid", F.monotonically_increasing_id())
    docs = settle(docs, "quality")  # ids of rows must not change between the uses below
    removed = _removals(docs, max_documents, max_percent).groupBy("rid").agg(F.sum("words").alias("removed"))
    rows = docs.drop("lines", "sizes").join(removed, "rid", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.col("removed")
    depleted = (F.col("removed") > 0) & ((left < min_words) | (left < F.col("n_words") * min_left))
    return rows.select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.col("removed").alias("n_removed_words"), (~failed & ~depleted).alias("kept"),
    )


def clean(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = MAX_DOCUMENTS, max_percent: int = MAX_PERCENT) -> DataFrame:
    """df with lines above the limit taken out of the text; texts without such lines stay as they are, to the byte."""
    docs = settle(measured(df, key, text, host).withColumn("rid", F.monotonically_increasing_id()), "quality")
    gone = _removals(docs, max_documents, max_percent).groupBy("rid").agg(F.collect_list("line").alias("lines"))  # of one text each
    gone = gone.join(docs.select("rid", "host", "th"), "rid").groupBy("host", "th").agg(F.first("lines").alias("__gone"))
    gone = gone.select(F.col("host").alias("__host"), F.col("th").alias("__of"), "__gone")

    at = df.columns.index(text)

    def hashed(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([xxhash.xxh64_intdigest(utf8(t.as_py())) - 2**63 for t in batch.column(at)], pa.int64())

    def cut(batch: pa.RecordBatch) -> pa.Array:
        out = []
        for t, lines in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
            t = t.as_py()
            if lines.is_valid:
                bad = set(lines.as_py())
                t = "\n".join(x for x in t.split("\n") if bad.isdisjoint(line_words(utf8(x))))
            out.append(t)
        return pa.array(out, pa.string())

    th, name = free_name(df, "th"), free_name(df, "clean")
    rows = with_column(df, th, T.LongType(), hashed)
    same = quoted(host).cast("string").eqNullSafe(F.col("__host")) & (F.col(th) == F.col("__of"))
    rows = rows.join(gone, same, "left").select(*[quoted(c) for c in df.columns], "__gone")
    rows = with_column(rows, name, T.StringType(), cut)
    return rows.select(*[quoted(name).alias(text) if c == text else quoted(c) for c in df.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base rules by plain loops; for tests."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        n < 10 or 100 * len(hit) > 20 * n,
    )


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), grams AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)
), twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid
), lines AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM d
), doubled AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY rid
), plain AS (
  SELECT rid, source, array_to_string(lw, ' ') AS line, sum(len(lw)) AS words
  FROM (SELECT rid, source, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{WORD}') AS lw FROM lines) WHERE len(lw) > 0 GROUP BY ALL
), named AS (SELECT rid, source, md5(t) || coalesce(doc_id::VARCHAR, '-') AS document FROM d
), hosts AS (SELECT source, count(DISTINCT document) AS documents FROM named GROUP BY source
), often AS (
  SELECT p.source, line FROM plain p JOIN named USING (rid) JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source
  GROUP BY p.source, line, h.documents HAVING count(DISTINCT document) > {MAX_DOCUMENTS} AND count(DISTINCT document) * 100 > h.documents * {MAX_PERCENT}
), removed AS (
  SELECT rid, sum(words) AS n FROM plain p JOIN often o ON p.source IS NOT DISTINCT FROM o.source AND p.line = o.line GROUP BY rid
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(doubled.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN doubled USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN removed USING (rid)
), failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, n_words - n_removed_words AS rest FROM counted)
SELECT * EXCLUDE (rest), NOT base_failed AND NOT (n_removed_words > 0 AND (rest < {MIN_WORDS} OR rest < n_words * {MIN_LEFT}::DOUBLE)) AS kept FROM failed
"""
