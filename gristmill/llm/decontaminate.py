"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark.

Texts are normalised (A-Z lower-cased, every other ASCII sign but letters and digits a blank) and
scanned once; a window is ``width`` consecutive words of an item, a shorter item is one window. Hits
come as word runs, mapped back to character offsets of the original text.

The automaton is built in each Python worker from the items' texts, which travel with the task. An
automaton's size is bounded: items are dealt into blocks of at most ``block_bytes`` normalised bytes
(about 8 trie nodes a byte), and several blocks follow each other in the same stage, each adding to
what the one before has found. Documents are never shuffled.

Nulls: a null or empty text has no words and no hits; an item without words has no windows; an item
with a null id is left out of the ids but marks words. Repeated items count once by id. Repeated rows
each get their row. Very long texts are scanned whole. An empty table gives an empty result, an empty
benchmark no hits. Other columns pass through ``annotate`` untouched, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, ALNUM_WORD, LOWER, UPPER, quoted, table, utf8, with_column, worker_cache

WIDTH = 8
#: Normalised bytes in one automaton; about 300 MB of trie at most.
BLOCK_BYTES = 512 * 1024
#: Items with occurring windows from which a document counts as contaminated.
MIN_ITEMS = 2


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM_TABLE).split()


def windows(words: list[bytes], width: int) -> list[tuple[bytes, int]]:
    if not words:
        return []
    if len(words) < width:
        return [(b" ".join(words), len(words))]
    return [(b" ".join(words[i : i + width]), width) for i in range(len(words) - width + 1)]


def _automaton(items: tuple, width: int):
    """Automaton over the windows of items: (id or None, normalised text)."""
    import ahocorasick

    built, key = worker_cache("automata"), (hash(items), width)
    if key not in built:
        found: dict[str, tuple[int, set]] = {}
        for item, text in items:
            for window, n in windows(text.split(), width):
                found.setdefault(f" {window.decode('latin-1')} ", (n, set()))[1].add(item)
        automaton = ahocorasick.Automaton()
        for window, (n, ids) in found.items():
            automaton.add_word(window, (n, frozenset(ids)))
        if found:
            automaton.make_automaton()
        if len(built) >= 2:
            built.pop(next(iter(built)))
        built[key] = automaton if found else None
    return built[key]


def hits(text: str | None, automaton) -> tuple[list[bytes], np.ndarray | None, set]:
    """Words, mask of hit words (None: none hit), ids of items."""
    words = words_of(text)
    if automaton is None or not words:
        return words, None, set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return words, None, set()
    blanks = np.cumsum(np.frombuffer(line, np.uint8) == 32)
    edges = np.zeros(len(words) + 1, np.int64)
    items: set = set()
    for end, (n, ids) in found:
        last = blanks[end] - 1  # words before the closing blank
        edges[last - n] += 1
        edges[last] -= 1
        items |= ids
    return words, np.cumsum(edges[:-1]) > 0, items


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    steps = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


def spans_of(text: str, mask: np.ndarray) -> list[dict]:
    """Hit runs of words as word numbers and character offsets (half open) of the original text."""
    raw = utf8(text)
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(ALNUM_TABLE))]
    return [
        {
            "first_word": a, "last_word": b - 1,
            "start": len(raw[: at[a][0]].decode("utf-8", "surrogatepass")),
            "end": len(raw[: at[b - 1][1]].decode("utf-8", "surrogatepass")),
        }
        for a, b in runs(mask)
    ]


SPAN = "array<struct<first_word:int,last_word:int,start:int,end:int>>"


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[tuple]:
    """Items as (id, normalised text) in blocks; read by the driver one partition at a time."""
    blocks, block, held = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        line = b" ".join(words_of(row[1]))
        if not line:
            continue
        if block and held + len(line) > block_bytes:
            blocks.append(tuple(block))
            block, held = [], 0
        block.append((row[0], line))
        held += len(line)
    return [*blocks, tuple(block)]


def annotate(
    docs: DataFrame, benchmark: DataFrame, *, out: str, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with the struct out: n_words, n_hit, items (sorted ids as strings), spans. out must be a free name."""
    at = docs.columns.index(text)
    state = T._parse_datatype_string(f"n_words long, n_hit long, items array<string>, spans {SPAN}")
    span = pa.struct([(n, pa.int32()) for n in ("first_word", "last_word", "start", "end")])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])

    def judged(value: str | None, automaton, had: dict | None) -> dict:
        words, mask, items = hits(value, automaton)
        if had and had["spans"]:
            mask = np.zeros(len(words), bool) if mask is None else mask
            for s in had["spans"]:
                mask[s["first_word"] : s["last_word"] + 1] = True
        ids = sorted({i for i in items if i is not None} | set(had["items"] if had else ()))
        spans = [] if mask is None else spans_of(value, mask)
        return {"n_words": len(words), "n_hit": 0 if mask is None else int(mask.sum()), "items": ids, "spans": spans}

    def scanner(block: tuple, first: bool):
        def scanned(batch: pa.RecordBatch) -> pa.Array:
            automaton = _automaton(block, width)
            before = [None] * batch.num_rows if first else batch.column(batch.num_columns - 1).to_pylist()
            return pa.array([judged(value.as_py(), automaton, had) for value, had in zip(batch.column(at), before, strict=True)], kind)

        return scanned

    df = docs
    for i, block in enumerate(blocks_of(benchmark, item, item_text, block_bytes)):
        df = with_column(df, f"{out}_{i}", state, scanner(block, i == 0))
        if i:  # the struct before it is part of the new one
            df = df.toDF(*[f"c{k}" for k in range(len(df.columns))]).drop(f"c{len(docs.columns)}").toDF(*docs.columns, f"{out}_{i}")
    return df.toDF(*docs.columns, out)


def scan(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_words, n_hit, items (sorted ids as strings), spans; options as for annotate."""
    df = annotate(docs.select(quoted(key).alias("k"), quoted(text).alias("t")), benchmark, out="found", text="t", **options)
    return df.select(F.col("k").alias(key), "found.n_words", "found.n_hit", "found.items", "found.spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str]], width: int = WIDTH) -> tuple[int, int, int, str, bool]:
    """The query's row for one text by comparing word lists; for tests."""
    words = words_of(text)
    hit, found = set(), set()
    for item, item_text in items:
        for window, n in windows(words_of(item_text), width):
            want = window.split()
            for i in range(len(words) - n + 1):
                if words[i : i + n] == want:
                    hit.update(range(i, i + n))
                    found |= {item} - {None}
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(found) >= MIN_ITEMS


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}')"
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, g FROM (
    SELECT item, least({WIDTH}, len(w)) AS n,
           unnest(list_transform(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1), lambda i: array_to_string(w[i:i + least({WIDTH}, len(w)) - 1], ' '))) AS g
    FROM b WHERE len(w) > 0)
), grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hits AS (SELECT rid, i, n, item FROM grams JOIN windows USING (n, g)
), marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), found AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN found USING (rid)
"""
