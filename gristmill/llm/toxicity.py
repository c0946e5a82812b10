"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own embedding and the mean embedding of its character 4-grams, both hashed, and
both started from the class log-odds of the training sample. Two GRUs read windows of 32 words, one in
each direction; attention pools their states to one logit a window. Windows overlap by half and cover
the whole text; a document's logit is its largest, put on a probability scale by a logistic fit.

Training is multiple-instance: each round scores all windows of the sample and learns from the largest
of every document. The sample is bounded: ``SAMPLE`` labelled rows of each class, in hash order, and of each
``SAMPLE_WORDS`` words: of a longer text runs of ``RUN_WORDS`` words at even distances. A task on an executor
trains; the driver gets the parameters alone. Rows that are held out (crc32 of the id mod 4 is 2) are never learnt
from, and only the text is an input.

Nulls, empty texts and texts without words score 0. Without labels of both classes every text scores
the share of toxic labels (0 without any). Repeated labels of an id count once, toxic if one of them is.
Repeated rows get a row each; of several texts with one id that with the least MD5 is learnt from. Very long
texts are scored whole, window by window. An empty table gives an empty result. Other columns pass untouched,
whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, give_back, md5_long, quoted, table, utf8, with_column

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, ATTEND = 8, 8, 8
WORD_ROWS = CHAR_ROWS = 1 << 16
GRAM = 4
SAMPLE = 1500
SAMPLE_WORDS, RUN_WORDS = 8192, 256
ROUNDS, BATCH, RATE = 5, 128, 0.01
THRESHOLD = 0.3
#: Windows computed at once.
CHUNK = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


def tokenize(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts in a row, words in each text, the distinct words."""
    words = [utf8(t).translate(ALNUM_TABLE).split() for t in texts]
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), np.array([len(w) for w in words], np.int64), flat.dictionary.to_pylist()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, rows of all character grams, and the word each gram is of."""
    rows = np.array([zlib.crc32(w) for w in words], np.int64) % WORD_ROWS
    if not words:
        return rows, rows, rows
    keys_of, words_of = [], []
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        buffer = np.frombuffer(b"".join([b"<%s>" % w for w in part]), np.uint8).astype(np.uint64)
        of = np.repeat(np.arange(at, at + len(part)), [len(w) + 2 for w in part])
        n = max(0, len(buffer) - GRAM + 1)
        keys = np.zeros(n, np.uint64)
        for k in range(GRAM):
            keys = keys * np.uint64(0x100000001B3) + buffer[k : k + n] + np.uint64(1)
        inside = of[:n] == of[GRAM - 1 : GRAM - 1 + n]
        keys = keys[inside]
        keys ^= keys >> np.uint64(23)
        keys_of.append((keys % np.uint64(CHAR_ROWS)).astype(np.int32))
        words_of.append(of[:n][inside].astype(np.int32))
    return rows, np.concatenate(keys_of), np.concatenate(words_of)


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (in the row of all words) and words of every window."""
    count = np.where(lengths > 0, np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + k * STRIDE
    return doc, begin, np.minimum(WINDOW, lengths[doc] - k * STRIDE)


class Model:
    """Parameters and both passes. Without ``p`` it only knows the share of toxic labels."""

    def __init__(self, p: dict[str, np.ndarray] | None, share: float = 0.0, scale: tuple[float, float] = (1.0, 0.0)) -> None:
        self.p, self.share, self.scale = p, share, scale

    @classmethod
    def start(cls, share: float, seed: int = 7) -> Model:
        rng, h, d = np.random.default_rng(seed), HIDDEN, 2 * EMBED
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        p = {
            "word": draw(WORD_ROWS, EMBED) * 0.03, "char": draw(CHAR_ROWS, EMBED) * 0.03, "wx": draw(d, 6 * h), "bx": np.zeros(6 * h, np.float32),
            "uf": draw(h, 3 * h), "ub": draw(h, 3 * h), "wa": draw(2 * h, ATTEND), "va": draw(ATTEND), "wo": draw(2 * h), "bo": np.zeros(1, np.float32),
        }
        return cls(p, share)

    def inputs(self, feats: tuple) -> np.ndarray:
        """Input of each distinct word, and a row of zeros for padding."""
        rows, grams, of = feats
        out = np.zeros((len(rows) + 1, 2 * EMBED), np.float32)
        out[:-1, :EMBED] = self.p["word"][rows]
        if len(grams):
            n = np.maximum(np.bincount(of, minlength=len(rows)), 1)
            for k in range(EMBED):
                out[:-1, EMBED + k] = np.bincount(of, self.p["char"][grams, k], minlength=len(rows)) / n
        return out

    def projected(self, feats: tuple) -> np.ndarray:
        out = self.inputs(feats) @ self.p["wx"]
        out += self.p["bx"]
        return out

    def forward(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window. ids: (windows, WINDOW) rows of proj."""
        p, h = self.p, HIDDEN
        n = len(ids)
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        saved: list = []
        for at, u, order in ((0, p["uf"], range(WINDOW)), (1, p["ub"], range(WINDOW - 1, -1, -1))):
            side, s = np.ascontiguousarray(proj[:, 3 * h * at : 3 * h * (at + 1)]), np.zeros((n, h), np.float32)
            for t in order:
                x, rec = side[ids[:, t]], s @ u
                zr = _sigmoid(x[:, : 2 * h] + rec[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = _tanh(x[:, 2 * h :] + r * rec[:, 2 * h :])
                new = (c + z * (s - c)) * mask[:, t, None]
                if keep:
                    saved.append((at, t, s, z, r, c, rec))
                states[t, :, h * at : h * (at + 1)] = s = new
        u = _tanh(states.reshape(-1, 2 * h) @ p["wa"])
        score = (u @ p["va"]).reshape(WINDOW, n)
        score = np.where(mask.T, score, -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, states, u, weight, pooled, saved) if keep else logit

    def gradients(self, feats: tuple, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x = self.inputs(feats)
        proj = x @ p["wx"] + p["bx"]
        logit, states, u, weight, pooled, saved = self.forward(proj, ids, mask, True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * p["wo"]
        ds = weight[:, :, None] * dp
        dw = np.einsum("tnh,nh->tn", states, dp)
        dscore = weight * (dw - (weight * dw).sum(axis=0))
        flat = dscore.reshape(-1)
        g["va"] = u.T @ flat
        du = flat[:, None] * p["va"] * (1 - u * u)
        g["wa"] = states.reshape(-1, 2 * h).T @ du
        ds += (du @ p["wa"].T).reshape(ds.shape)
        dproj = np.zeros_like(proj)
        carry = [np.zeros((len(y), h), np.float32), np.zeros((len(y), h), np.float32)]
        for at, t, s, z, r, c, rec in reversed(saved):
            name = "ub" if at else "uf"
            dn = (ds[t, :, h * at : h * (at + 1)] + carry[at]) * mask[:, t, None]
            dz, dc = dn * (s - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
            dr = dc * rec[:, 2 * h :] * r * (1 - r)
            drec = np.concatenate((dz, dr, dc * r), axis=1)
            g[name] += s.T @ drec
            carry[at] = drec @ p[name].T + dn * z
            np.add.at(dproj[:, 3 * h * at : 3 * h * (at + 1)], ids[:, t], np.concatenate((dz, dr, dc), axis=1))
        dproj[-1] = 0
        g["wx"], g["bx"] = x.T @ dproj, dproj.sum(axis=0)
        dx = dproj @ p["wx"].T
        rows, grams, of = feats
        np.add.at(g["word"], rows, dx[:-1, :EMBED])
        if len(grams):
            n = np.maximum(np.bincount(of, minlength=len(rows)), 1)
            np.add.at(g["char"], grams, (dx[:-1, EMBED:] / n[:, None])[of])
        return g

    def window_logits(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, proj: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        for i in range(0, len(begin), CHUNK):
            ids, mask = gather(flat, begin[i : i + CHUNK], size[i : i + CHUNK], len(proj) - 1)
            out[i : i + CHUNK] = self.forward(proj, ids, mask)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text."""
        flat, lengths, words = tokenize(texts)
        if self.p is None:
            return np.where(lengths > 0, self.share, 0.0)
        doc, begin, size = windows_of(lengths)
        best = np.full(len(texts), -np.inf)
        if len(doc):
            with np.errstate(over="ignore"):
                proj = self.projected(features(words))
                np.maximum.at(best, doc, self.window_logits(flat, begin, size, proj))
                return np.where(lengths > 0, _sigmoid(self.scale[0] * best + self.scale[1]), 0.0)
        return np.zeros(len(texts))


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    at = begin[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < size[:, None]
    return np.where(mask, flat[np.minimum(at, len(flat) - 1)], pad), mask


def log_odds(held: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of the toxic class for each row, from the distinct rows that each document holds."""
    count = np.zeros((2, size))
    for rows, toxic in zip(held, y, strict=True):
        count[int(toxic), rows] += 1
    neg, pos = count
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    return (odds * (pos + neg) / (pos + neg + 3)).astype(np.float32)


def word_runs(text: str | None, most: int = SAMPLE_WORDS, run: int = RUN_WORDS) -> list[list[bytes]]:
    """A text's words as one run, or, if there are more than most, runs at even distances."""
    words = utf8(text).translate(ALNUM_TABLE).split()
    if len(words) <= most:
        return [words]
    return [words[a : a + run] for a in np.linspace(0, len(words) - run, max(1, most // run)).astype(int).tolist()]


def train(flat: np.ndarray, lengths: np.ndarray, words: list[bytes], run_doc: np.ndarray, y: np.ndarray, share: float) -> Model:
    """flat: word numbers of all runs in a row, of these lengths; run_doc: document of each run (all of one stand together).

    y: label of each document. share: of toxic labels among all that could be learnt from, for the scale.
    """
    y = y.astype(np.float64)
    if not len(y) or not 0 < y.mean() < 1:
        return Model(None, share)
    model, rng = Model.start(share), np.random.default_rng(11)
    feats = rows, grams, of = features(words)
    run, begin, size = windows_of(lengths)
    doc = run_doc[run]
    cut = np.searchsorted(of, np.arange(len(words) + 1))  # a word's grams stand together
    held = [np.unique(part) for part in np.split(flat, np.cumsum(np.bincount(run_doc, lengths, len(y)).astype(np.int64))[:-1])]
    word_odds = log_odds([np.unique(rows[w]) for w in held], y, WORD_ROWS)
    char_odds = log_odds([np.unique(_only(feats, w, cut)[1]) for w in held], y, CHAR_ROWS)
    model.p["word"][:, 0] = word_odds
    model.p["char"][:, 0] = char_odds
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    first = np.maximum(word_odds[rows], 0)[flat] + np.maximum(np.bincount(of, char_odds[grams], minlength=len(words)) / np.maximum(np.diff(cut), 1), 0)[flat]
    sums = np.concatenate(([0], np.cumsum(first)))
    logits = sums[begin + size] - sums[begin]
    with np.errstate(over="ignore"):
        for _ in range(ROUNDS):
            order = np.lexsort((logits, doc))
            last = np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))
            pick = order[last]  # the largest window of each document
            clean = np.flatnonzero(y[doc] == 0)
            pick = np.concatenate((pick, rng.choice(clean, min(len(clean), len(pick) // 2), replace=False)))
            rng.shuffle(pick)
            for i in range(0, len(pick), BATCH):
                part = pick[i : i + BATCH]
                ids, mask = gather(flat, begin[part], size[part], len(words))
                used, local = np.unique(ids[mask], return_inverse=True)
                own = np.full(ids.shape, len(used))
                own[mask] = local
                g = model.gradients(_only(feats, used, cut), own, mask, y[doc[part]])
                step += 1
                for k, v in model.p.items():
                    m, s = adam[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] * g[k] - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            proj = model.projected(feats)
            logits = model.window_logits(flat, begin, size, proj)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc, logits)
    has = np.isfinite(best)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.scale = fit_scale(best[has], y[has], weight[has])
    return model


def _only(feats: tuple, used: np.ndarray, cut: np.ndarray) -> tuple:
    rows, grams, _ = feats
    n = np.diff(cut)[used]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[used], n)
    return rows[used], grams[at], np.repeat(np.arange(len(used)), n)


def fit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y to x by Newton's method, kept from steepness without end by a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * x + b)
        e, w = weight * (q - y), weight * q * (1 - q) + 1e-9
        ga, gb = (e * x).sum() + 0.01 * a, e.sum() + 0.01 * b
        haa, hab, hbb = (w * x * x).sum() + 0.01, (w * x).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        norm = max(1.0, abs(da), abs(db))
        a, b = a - da / norm, b - db / norm
        if abs(da) + abs(db) < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> Model:
    """Train on at most ``sample`` rows of each class, the first by a hash of the id, and ``words`` words of each."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("__k")).agg((F.max(label) > 0).cast("int").alias("__y"))
    share = float(known.agg(F.avg("__y")).first()[0] or 0.0)
    hashed = md5_long(F.col("__k").cast("string"))
    picked = [known.where(F.col("__y") == y).orderBy(hashed).limit(sample) for y in (0, 1)]
    picked = picked[0].unionAll(picked[1])  # 2 * sample rows at most, so it may be broadcast
    rows = docs.select(quoted(key).alias("__i"), quoted(text).alias("__t")).join(F.broadcast(picked), F.col("__i") == F.col("__k"))
    rows = rows.groupBy("__k", "__y").agg(F.min_by("__t", F.md5(F.coalesce("__t", F.lit("")).cast("binary"))).alias("__t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, y, t in zip(*batch.columns, strict=True):
                runs = word_runs(t.as_py(), words)
                n = len(runs)
                columns = [pa.array([k.as_py()] * n, pa.string()), pa.array([y.as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(runs, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "y", "run", "words"])

    rows = rows.select(F.col("__k").cast("string"), "__y", "__t").mapInArrow(cut, "k string, y int, run int, words array<binary>")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        sampled = pa.Table.from_batches(held)
        found = sampled.column("words").combine_chunks()
        coded = found.flatten().dictionary_encode()
        keys = sampled.column("k").combine_chunks().dictionary_encode().indices.to_numpy()
        y = sampled.column("y").to_numpy()[np.unique(keys, return_index=True)[1]]
        lengths = np.diff(found.offsets.to_numpy()).astype(np.int64)
        model = train(coded.indices.to_numpy(zero_copy_only=False), lengths, coded.dictionary.to_pylist(), keys, y, share)
        arrays = {**(model.p or {}), "scale": np.array(model.scale)}
        parts = [(k, list(v.shape), v.astype("<f8").tobytes()) for k, v in arrays.items()]
        columns = zip(zip(*parts, strict=True), (pa.string(), pa.list_(pa.int32()), pa.binary()), strict=True)
        del held, sampled, found, coded, keys, lengths, model, arrays
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["name", "shape", "data"])

    # one task trains, on 2 * sample * words words at most; the driver gets the parameters alone
    rows = rows.repartition(1).sortWithinPartitions("k", "run")
    got = {r.name: np.frombuffer(r.data, "<f8").reshape(r["shape"]) for r in rows.mapInArrow(learn, "name string, shape array<int>, data binary").collect()}
    scale = got.pop("scale", None)
    if not got:
        return Model(None, share)
    return Model({k: v.astype(np.float32) for k, v in got.items()}, share, (float(scale[0]), float(scale[1])))


def score(df: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """df with the column out (double, 0 to 1), which must be a free name."""
    at = df.columns.index(text)
    return with_column(df, out, T.DoubleType(), lambda batch: pa.array(model.scores(batch.column(at).to_pylist()), pa.float64()), 500)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, out="score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
