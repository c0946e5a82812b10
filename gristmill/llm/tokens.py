"""Token-id files of directly addressable codes (DACs).

An id is split into chunks of eight bits. Level k holds the k-th chunk of every id that has one, a
bitmap says which of them go on to the next level, and a rank directory (ones before every 512th bit)
finds the place there; any id can be read by itself, without decoding what stands before it.

A file holds a run of documents in ascending id order. Spark's text writer puts one file's bytes in one
row, so files commit atomically in any store; the line end it adds after them is not part of the format.
Files are ordered by (part, sequence) in their header, parts by ranges of document ids.

Tokenizing looks each distinct word up once for a batch: the tokenizer splits at white space before
anything else, lower-cases, and keeps letters apart from stops, so a text's ids are its words' ids in a
row. A tokenizer for which this does not hold must be used with ``by_word=False``. Very long texts are
tokenized in parts that end at white space, so memory follows the batch and one file, never the text.

Ids of documents are whole numbers or text. Nulls: a null text is empty; a document without ids has the end
id alone. A null document id comes first and reads back as null. Ties and repeated rows are documents of
their own, ordered by their text's CRC-32, then the text, and dealt over several ranges. An empty table
gives no files and no rows. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, give_back, scratch, settle, table, utf8, worker_cache

END_ID = 1
#: Ids in a file, up to the last document's.
FILE_IDS = 2_000_000
#: Distinct pieces from which a worker forgets those it keeps.
CACHE_WORDS = 500_000
#: Rows that go to a Python worker at once, and characters tokenized at once.
BATCH_ROWS = 1000
BATCH_BYTES = 3 << 20
RANK_BITS = 512
MAGIC = b"GMDAC001"


def build(ids: np.ndarray) -> bytes:
    """Levels of an array of unsigned 32-bit ids."""
    out, rest = [struct.pack("<Q", len(ids))], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            return b"".join([*out, struct.pack("<Q", 0)])


class Codes:
    """Random access to the ids in what ``build`` made."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        (self.n,) = struct.unpack_from("<Q", data, at)
        at += 8
        self.levels = []
        while True:
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            if n == 0:
                break
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            n_ranks = -(-n // RANK_BITS)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + n + len(bits))
            at += n + len(bits) + 4 * n_ranks
            self.levels.append((chunks, bits, ranks))
        self.end = at

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        if i // RANK_BITS >= len(ranks):
            if not len(ranks):
                return 0
            i0 = (len(ranks) - 1) * RANK_BITS
        else:
            i0 = i // RANK_BITS * RANK_BITS
        part = bits[i0 // 8 : -(-i // 8)]
        ones = np.unpackbits(part, bitorder="little")[: i - i0]
        return int(ranks[i0 // RANK_BITS]) + int(ones.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start..end-1: each level is read from its first rank on."""
        out = np.zeros(max(0, end - start), np.uint32)
        where, a, b = np.arange(len(out)), start, end
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[more]
            a = self._rank(bits, ranks, a)
            b = a + len(where)
        return out


def pack(part: int, seq: int, base: int, docs: list[tuple[int | str | None, int]], ids: np.ndarray) -> bytes:
    """A file: header, document ids with a mark (0 a number, 1 null, 2 text), ends of the documents, codes. base: ids before it in its part."""
    marks = np.array([1 if k is None else 2 if isinstance(k, str) else 0 for k, _ in docs], np.uint8)
    names = [k.encode("utf-8", "surrogatepass") for k, _ in docs if isinstance(k, str)]
    lengths = iter([len(x) for x in names])
    keys = np.array([0 if m == 1 else next(lengths) if m == 2 else k for m, (k, _) in zip(marks.tolist(), docs, strict=True)], "<i8")
    ends = np.cumsum(np.array([n for _, n in docs], "<u8"), dtype="<u8")
    head = struct.pack("<IIQQQ", part, seq, base, len(docs), len(ids))
    return b"".join([MAGIC, head, keys.tobytes(), marks.tobytes(), ends.tobytes(), *names, build(ids)])


class TokenFile:
    """A file's documents and ids."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("no token file")
        self.part, self.seq, self.base, n, self.n_ids = struct.unpack_from("<IIQQQ", data, 8)
        at = 40
        keys, marks = np.frombuffer(data, "<i8", n, at).tolist(), np.frombuffer(data, np.uint8, n, at + 8 * n).tolist()
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        self.keys: list[int | str | None] = []
        for k, mark in zip(keys, marks, strict=True):
            self.keys.append(None if mark == 1 else data[at : at + k].decode("utf-8", "surrogatepass") if mark == 2 else k)
            at += k if mark == 2 else 0
        self.codes = Codes(data, at)

    def document(self, i: int) -> np.ndarray:
        return self.codes.slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of ASCII letters and of UTF-8 letters from U+00C0 to U+023F (what is no letter there is looked for apart).
_LETTERS = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0xC0)) + bytes(range(0xC3, 0xC9)))
_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
#: 1 white space, 2 a stop, 4 no letter.
_KINDS = (_flags(b" \t\n\r\x0b\x0c") + 2 * _flags(b".,") + 4 * ~_LETTERS).astype(np.uint8)
#: Pairs of bytes that are no letter, or one whose lower case is two signs: times, divided by, capital I with a dot.
_ODD = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Length of every piece, is it letters only, pieces of each text, and the bytes of all pieces in a row.

    A piece is a word, but stops after a word of Latin letters are a piece of their own; white space is left out.
    """
    raw = b" ".join([*texts, b""])
    line = np.frombuffer(raw, np.uint8)
    kind = _KINDS[line]
    space = (kind & 1).astype(bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    begin, end = edge[::2], edge[1::2]
    other = kind & 4
    for pair in _ODD:
        if pair in raw:
            other[:-1] |= (line[:-1] == pair[0]) & (line[1:] == pair[1])
    # stops at the end of words: most have none or one
    core = end - (kind[end - 1] & 2 > 0)
    for i in np.flatnonzero((core < end) & (core > begin) & (kind[core - 1] & 2 > 0)).tolist():
        core[i] = begin[i] + len(raw[begin[i] : end[i]].rstrip(b".,"))
    strange = np.concatenate(([0], np.cumsum(other != 0, dtype=np.int32)))
    letters = (strange[core] == strange[begin]) & (core > begin)
    core = np.where(letters, core, end)
    # letters in lower case, so that more of them are alike; other words may be special tokens, whose case counts
    low = np.zeros(len(line) + 1, np.int8)
    low[begin[letters]] = 1
    low[core[letters]] -= 1
    line = np.where(np.cumsum(low[:-1], dtype=np.int8) > 0, _LOWER[line], line)
    both = np.stack((core - begin, end - core), axis=1).reshape(-1)
    alone = np.stack((letters, np.zeros(len(begin), bool)), axis=1).reshape(-1)
    keep = both > 0
    words = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))  # words up to the end of each text
    ends = np.concatenate(([0], np.cumsum(keep)))[2 * words]
    return both[keep], alone[keep], np.diff(np.concatenate(([0], ends))), line.tobytes().translate(None, b" \t\n\r\x0b\x0c")


class Encoder:
    """Texts to ids. Pieces are told apart and looked up by Arrow, so only new ones become Python objects."""

    def __init__(self, path: str, by_word: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]
        self.ends = np.zeros(max(ends, default=0) + 1, bool)
        self.ends[ends] = True
        self.known = self.ids = pa.array([], pa.large_binary())  # pieces and, as bytes, their ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of letter runs: encoded as one text and parted where a word's last token ends."""
        if not self.ends.any():
            return self._ids(texts)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(cuts) != len(texts) or cuts[-1] != len(ids):
            return self._ids(texts)
        data, to = ids.tobytes(), (cuts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]

    def _places(self, array: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Where each piece stands among the known ones; new ones are added."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.ids = self.known[:0], self.ids[:0]
        found = pc.index_in(array, self.known)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        place = found.fill_null(0).to_numpy()
        if not len(missing):
            return place
        coded = array.take(pa.array(missing)).dictionary_encode()
        index = coded.indices.to_numpy()
        new, kind = coded.dictionary, np.zeros(len(coded.dictionary), bool)
        kind[index] = letters[missing]
        ids: list = [None] * len(new)
        for kinds, encode in ((kind, self._letter_ids), (~kind, self._ids)):
            own = np.flatnonzero(kinds)
            texts = [x.decode("utf-8", "replace") for x in new.take(pa.array(own)).to_pylist()]
            for k in range(0, len(own), 5000):
                for i, x in zip(own[k : k + 5000].tolist(), encode(texts[k : k + 5000]), strict=True):
                    ids[i] = x
        place = place.astype(np.int64)
        place[missing] = len(self.known) + index
        self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, pa.array(ids, pa.large_binary())])
        return place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if not self.by_word:
            every = self._ids(texts)
            return np.frombuffer(b"".join(every), "<u4"), np.array([len(x) // 4 for x in every], np.int64)
        size, letters, counts, packed = pieces([utf8(t) for t in texts])
        if not len(size):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        place = self._places(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]), letters)
        ids = self.ids.take(pa.array(place))
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        return np.frombuffer(data, "<u4")[ends[0] : ends[-1]], np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])


def _batches(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Texts of about BATCH_BYTES; longer ones are parted at white space. The numbers say which text a part is of."""
    of, parts, held = [], [], 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        while text:
            cut = len(text)
            if cut > BATCH_BYTES:
                cut = next((m.start() for m in re.compile(r"[ \t\n\r\x0b\x0c]").finditer(text, BATCH_BYTES)), cut)
            of.append(i)
            parts.append(text[:cut])
            held, text = held + cut, text[cut:]
            if held >= BATCH_BYTES:
                yield of, parts
                of, parts, held = [], [], 0
    if parts:
        yield of, parts


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
    file_ids: int = FILE_IDS, by_word: bool = True,
) -> None:
    """Tokenize all documents and write their files below path. The tokenizer's file has this path on every executor."""
    whole_numbers = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rows = docs.select(F.col(key).cast("long" if whole_numbers else "string").alias("k"), F.col(text).alias("t"))
    rows = rows.withColumn("tie", F.crc32(F.coalesce("t", F.lit("")).cast("binary")))
    order = [F.col("k").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("tokenizers")
        if (tokenizer, by_word) not in cache:
            cache[tokenizer, by_word] = Encoder(tokenizer, by_word)
        encoder, part, end = cache[tokenizer, by_word], TaskContext.get().partitionId(), np.array([end_id], "<u4")
        seq = base = held = 0
        found: list = []
        ids: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            blob = pack(part, seq, base, found, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["value"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            done, n = 0, 0  # documents of the batch that are complete; ids of the next one so far

            def close(upto: int) -> Iterator[pa.RecordBatch]:
                nonlocal done, n, seq, base, held, found, ids
                while done < upto:
                    ids.append(end)
                    found.append((keys[done], n + 1))  # noqa: B023
                    held, done, n = held + n + 1, done + 1, 0
                    if held >= file_ids:
                        yield file()
                        seq, base, held, found, ids = seq + 1, base + held, 0, [], []

            for of, parts in _batches(batch.column(1)):
                flat, counts = encoder.encode(parts)
                at = 0
                for i, count in zip(of, counts.tolist(), strict=True):
                    yield from close(i)
                    ids.append(flat[at : at + count])
                    n, at = n + count, at + count
            yield from close(len(keys))
        if found:
            yield file()
        found, ids = [], []
        give_back()

    files = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(min(int(before), BATCH_ROWS)) if int(before) > 0 else str(BATCH_ROWS))  # while the files are written
    try:
        files.write.option("maxRecordsPerFile", 1).text(path)
    finally:
        conf.set(name, before)


def read_tokens(spark: SparkSession, path: str, *, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document in the files below path."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(content.as_py())
                starts = np.concatenate(([0], f.ends[:-1])) if len(f.ends) else f.ends
                ids = memoryview(f.codes.slice(0, f.n_ids).astype("<u4").tobytes())
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), f.ends.tolist(), strict=True)]
                columns = [[f.part] * len(crcs), starts + f.base, f.ends - starts, crcs]
                keys = pa.array([None if k is None else str(k) for k in f.keys], pa.string())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in columns)], names=["k", "part", "rel", "n", "crc"])

    # five narrow columns a document, kept so that files are read once
    rows = settle(files.mapInArrow(documents, "k string, part long, rel long, n long, crc long"), "documents")
    # one row a part: at most as many as the writing shuffle had partitions
    totals = rows.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(totals), "part").select(
        F.col("k").cast(key_type).alias(key), (F.col("before") + F.col("rel")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
