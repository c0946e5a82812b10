import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, licenses, mixing, quality, queries, shards, similar, simhash, suffixes, tokens, toxicity, warc
from gristmill.llm.graph import components

RNG = random.Random(3)
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"), (2, None, "a"), (3, "", None), (4, "é 日本 x", "b"),
    (4, "é 日本 x", "b"), (5, "Released under the MIT License.\nApache License, Version 2.0", "a"), (6, "same line here\nsame line here\n \n", "c"),
    (7, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"), (None, "no id", "a"), (8, "w " * 30_000, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, 1, "x", 2, 3) for i, t, s in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, kept string, size int, code int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(docs, none):
    rows = shards.shard(docs, shards=3).collect()
    counts = [sum(r.shard == k for r in rows) for k in range(3)]
    assert len(rows) == len(DOCS) and max(counts) - min(counts) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(3) for i in range(counts[k])]
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in DOCS)
    assert shards.shard(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    places = [shards.permute(x, n, 42) for x in range(n)]
    assert sorted(places) == list(range(n)) and [shards.invert(p, n, 42) for p in places] == list(range(n))


def test_mixing(docs, none):
    rows = mixing.mix(docs, rows=True).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, (r.row for r in rows))) == sorted(map(str, docs.collect()))
    by = {}
    for r in rows:
        by.setdefault((r.row.source, r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - goal) < 1 and goal <= 3 * size + 1e-6 for (_, size, goal), t in by.items())
    assert mixing.mix(none).count() == 0


def test_quality(spark, docs, none):
    got = quality.judge(docs).collect()
    key = lambda r: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert sorted(map(key, got)) == sorted(quality.brute_force(t) for _, t, _ in DOCS)
    assert quality.judge(none).count() == 0
    line = "one line that many pages of this host all have in common with each other"
    pages = spark.createDataFrame([(i, f"{line}\npage {i}", "h") for i in range(20)] + [(99, line + " not", "h")], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(pages, max_documents=10).collect()}
    assert kept[99] and not any(kept[i] for i in range(20))
    assert {r.doc_id: r.text for r in quality.clean(pages, max_documents=10).collect()} == {**{i: f"page {i}" for i in range(20)}, 99: line + " not"}
    assert sorted(map(str, quality.clean(docs).collect())) == sorted(map(str, docs.collect())) and quality.clean(none).count() == 0


def test_quality_limit_follows_the_host(spark):
    line, few = "home news sport weather contact us about this site", "read more of what others wrote about this page"
    texts = [(f"{line}\npage {i}", h) for h, n in (("small", 15), (None, 15), ("large", 60)) for i in range(n)]
    texts += [(f"{few}\nleaf {i}", "large") for i in range(12)]  # below the share of a large host
    texts += [(f"plain {h} words {i}", h) for h, n in (("small", 25), (None, 25), ("large", 1428)) for i in range(n)]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(texts)], "doc_id long, text string, source string")
    gone = {r.doc_id: r.n_removed_words for r in quality.judge(rows).collect()}
    assert gone == {i: 9 * t.startswith(line) for i, (t, _) in enumerate(texts)}


def test_quality_counts_documents_not_texts(spark):
    page, alone = "a page that many addresses of this host give back to the byte", "a page of one address that was fetched again and again"
    texts = [(i, page, h) for h in ("h", None) for i in range(30)] + [(None, alone, "h")] * 15 + [(99, alone, "h")] * 15
    texts += [(100 + i, f"{page}\nwith words of its own number {i} that are only here", "other") for i in range(4)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = quality.judge(rows).collect()
    assert sorted((r.doc_id or -1, r.n_removed_words, r.kept) for r in got) == sorted((i or -1, 13 * (t == page), t != page) for i, t, _ in texts)


def test_codes_and_token_files(spark, docs, none, tmp_path):
    ids = np.array([RNG.choice([RNG.randrange(256), RNG.randrange(50_000), RNG.randrange(2**32)]) for _ in range(1500)], np.uint32)
    codes = tokens.Codes(tokens.build(ids))
    assert [codes[i] for i in range(0, 1500, 7)] == ids[::7].tolist() and (codes.slice(300, 1400) == ids[300:1400]).all()
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_tokens(docs, str(tmp_path / "t"), path, file_ids=50)
    rows = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(path)
    want = {}
    for i, t, _ in DOCS:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in DOCS), key=lambda i: -1 if i is None else i)
    for r in rows:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    tokens.write_tokens(none, str(tmp_path / "e"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_encoder_by_word_is_exact(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    signs = "abcXYZ019 .,;'-  \n\t\x0b\x0céÉßÿ×÷İıŉſǅȿɐµªº\u00a0\u0301日本😀<|>"
    texts = ["It's A test, of İstanbul... naïve 12ab <|endoftext|>x  ́a", "<|ENDOFTEXT|> A<|EndOfText|>. <|endoftext|> <|STARTOFTEXT|>B", "WORD Word. word, WoRd...", "ÀÉ ,. don't'll x y z w", "", *("".join(RNG.choices(signs, k=60)) for _ in range(300))]
    split, whole = tokens.Encoder(path, True), tokens.Encoder(path, False)
    for size in (300_000, 50):  # with and without forgetting
        monkeypatch.setattr(tokens, "CACHE_WORDS", size)
        for i in range(0, len(texts), 100):
            for got, want in zip(split.encode(texts[i : i + 100]), whole.encode(texts[i : i + 100]), strict=True):
                assert got.tolist() == want.tolist()


def test_token_files_of_long_texts_and_text_ids(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "BATCH_BYTES", 100)  # every text is long
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [("b", "one two three " * 50), ("a:1", ""), (None, None), ("a:1", "x" * 300 + " y"), (None, "end\nof\tit " * 30), ("é", " \n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "name string, text string, k int")
    tokens.write_tokens(df, str(tmp_path / "t"), path, key="name", file_ids=40)
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t"), key="name", key_type="string").collect(), key=lambda r: r.start)
    whole = tokens.Encoder(path, False)
    want = sorted(((k or "", len(i := whole.encode([t or ""])[0].tolist()) + 1, zlib.crc32(np.array([*i, 1], "<u4").tobytes())) for k, t in rows))
    assert sorted((r.name or "", r.n_tokens, r.ids_crc32) for r in got) == want and [r.name for r in got] == [None, None, "a:1", "a:1", "b", "é"]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_simhash(spark, docs, none):
    base = [RNG.getrandbits(64) for _ in range(200)]
    found = set(base)
    for b in base[:80]:
        for _ in range(3):
            found.add(b ^ sum(1 << k for k in RNG.sample(range(64), RNG.randrange(1, 7))))
    codes = np.array(sorted(found), np.uint64)
    root = list(range(len(codes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(codes ^ c) <= 4):
            a, b = sorted((top(i), top(int(j))))
            root[b] = a
    df = spark.createDataFrame([(int(c.view(np.int64)),) for c in codes], "code long")
    for rows in (5000, 20):  # with and without further cuts
        got = {r.node: r.root for r in components(simhash.links(df, group_rows=rows), small=0 if rows == 20 else 20_000).collect()}
        classes, want = {}, {}
        for i, c in enumerate(codes.view(np.int64).tolist()):
            classes.setdefault(got.get(c, c), set()).add(c)
            want.setdefault(top(i), set()).add(c)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(DOCS) and {r.component_id for r in rows if r.doc_id in (1, 7)} == {1} and {r.component_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect() if r.doc_id in (1, 2, 3, 4, 7)) == [1, 2, 4]
    assert simhash.near_duplicates(none).count() == 0
    rows = [(None, "one text of its own"), (None, "quite another text here it is"), (5, "a third one with words"), (5, "and a fourth that shares its id"), (5, "a third one with words"), (9, "one text of its own")]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted({*rows} - {rows[0]}, key=str)


def naive_fingerprint(text, shingle):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_a_naive_one():
    texts = [t for _, t, _ in DOCS[:9]] + [" ".join(RNG.choices(["A", "b", "É", "c\x0bd", "\u00a0"], k=RNG.randrange(40))) for _ in range(40)]
    for width in (4, 5):
        assert [simhash.fingerprint(t, width) for t in texts] == [naive_fingerprint(t, width) for t in texts]


def test_hot_groups_are_cut_by_their_other_bits(spark):
    codes = {RNG.getrandbits(64) & ~0x1FFF | 0x155 for _ in range(20_000)}  # alike in the first band
    df = spark.createDataFrame([(c - (c >> 63 << 64),) for c in codes], "code long")
    dealt = simhash.groups(df, 4, 1000)
    sizes = [r.n for r in dealt.groupBy("key").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 1000
    same = dealt.groupBy("code").count().agg(F.min("count"), F.max("count")).first()
    assert same[0] == same[1] == 9  # four bands, and five more in the place of the first


def test_pipeline_keeps_one_of_texts_similar_by_five_words(spark):
    rng = random.Random(5)
    texts, hosts = [None, "", " \n", "one two", "One  two", "one two three"], " ".join(f"menu{i}" for i in range(30))
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 300]))]
        texts += [" ".join(words)] * (k % 3) + [f"{hosts} {' '.join(words)}"]
        for _ in range(12 if k < 3 else rng.randrange(3)):  # replaced words: similarity of 0.6 to 1
            copy = list(words)
            for _ in range(rng.randrange(1, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [set(similar.shingles(similar.line_of(t)).tolist()) for t in texts]
    root = list(range(len(texts)))
    between = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                between += 100 * len(a & b) < 95 * len(a | b)
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert between > 20
    rows = spark.createDataFrame([(*r, 1, 2, 3) for r in enumerate(texts)], "doc_id long, text string, root int, digest int, `code.u` int")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()) == sorted(set(root))
    blocks = similar.keep_one(rows, group_rows=6)  # groups go in pairs of blocks
    assert sorted(r.doc_id for r in blocks.collect()) == sorted(set(root)) and blocks.columns == rows.columns
    assert corpus_pipeline.drop_near_duplicates(spark, rows.limit(0), "").count() == 0


def test_suffixes(spark, none, monkeypatch):
    parts = ["".join(RNG.choice("abcdefgh ") for _ in range(n)) for n in (60, 45, 120)]
    texts = []
    for _ in range(40):
        t = "".join(RNG.choice("abcdefgh ") for _ in range(RNG.randrange(80)))
        for _ in range(RNG.randrange(3)):
            t += RNG.choice(parts)[RNG.randrange(10) :] + "é" * RNG.randrange(3)
        texts.append(t)
    texts += [None, "", texts[3], "a" * 100, "ab" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(df, length=40, reach=20, fine=4).collect()}
    assert [got[i] for i in range(len(texts))] == suffixes.brute_force(texts, 40)
    raws = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    seen = Counter(r[i : i + 40] for _, r in raws for i in range(len(r) - 39))
    want = {(k, i) for k, r in raws for i in range(len(r) - 39) if seen[r[i : i + 40]] > 1}
    assert {(r.doc_id, r.p) for r in suffixes.double_prefixes(df, length=40).collect()} == want
    monkeypatch.setattr(suffixes, "BLOCK", 16)  # long texts go block by block
    assert suffixes.finer(b"x" * 100, [(20, 30, 30)], 40, 8)[0][:3] == (20, 22, 30)
    assert [a.tolist() for a in suffixes.anchors(b"ab" * 50, 40, 8)][0][:2] == [0, 1]
    assert suffixes.remove(none).count() == 0


def test_licenses(docs, none):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = rows[5]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (10, 2, 1, 5, "apache-2,mit", "apache-2,mit")
    assert (rows[2].n_words, rows[2].labels, rows[2].first_word) == (0, "", None) and rows[8].n_words == 30_000
    assert licenses.scan(docs).count() == len(DOCS) and licenses.scan(none).count() == 0


def test_diagonals_bridge_an_inserted_word(spark):
    text = "x y " + licenses.TEMPLATES["bsd"][-1].replace("source and", "source code and").upper() + " z"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "bsd" and r.n_base == 0 and 0.75 <= r.score <= 1 and r.spans[0].first_word == 2


def test_licenses_against_brute_force(spark):
    templates = {"a": ["one two three four five six seven eight", "six seven one two three"], "b": [" ".join(f"w{i}" for i in range(40))], "c": ["one one one one two"]}
    phrases = {"one two three": "a", "two one": "d", "seven": "e"}
    vocabulary = ["one", "two", "Three", "four", "FIVE", "six", "seven", "eight", "w1", "é"]
    texts = [" ,".join(RNG.choices(vocabulary[: RNG.choice([2, 10])], k=RNG.randrange(60))) for _ in range(150)]
    for text in templates["a"] + templates["b"] * 20:
        words = text.split()
        for _ in range(8):
            k = RNG.randrange(len(words))
            words[k:k] = RNG.choices(vocabulary, k=RNG.choice([0, 1, 4, 5]))
            del words[RNG.randrange(len(words))]
        texts.append(" ".join(RNG.choices(vocabulary, k=5) + words))
    texts += [None, "", "ONE-two\x00three", "K one two three İ", "one two three " * 500]
    rows = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], "doc_id long, text string, words int, info string")
    for merge in (0, 4):
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(rows, templates=templates, phrases=phrases, merge=merge).collect()}
        assert [got[i] for i in range(len(texts))] == [licenses.brute_force(t, templates, phrases, merge=merge) for t in texts]


def test_licenses_of_a_very_long_text(spark):
    r = licenses.scan(spark.createDataFrame([(1, "released under the mit license now " * 300_000)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.labels, len(r.spans)) == (1_800_000, 300_000, "mit", 300_000)


def test_warc(spark, none, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 30_000, "x\r\n\r\nWARC/1.1\r\n" * 1000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i}", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest int")
    warc.write_archives(pages, str(tmp_path / "w"))
    rows = {int(r.page_id): r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == len(html) and all(r.problem is None for r in rows.values())
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = next(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(raw), warc.b32_sha1(raw))
        assert (rows[i].record_type, rows[i].refers_to) == (("response", None) if first == i else ("revisit", str(first)))
        assert rows[i].payload == (raw if first == i else None)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_decontamination(spark, docs, none):
    items = [("q1", "over the lazy dog near the old river bank"), ("q2", "quick brown fox"), ("q3", ""), (None, "same line here"), ("q2", "quick brown fox")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (10_000, 10):
        rows = decontaminate.annotate(docs, bench, out="found", block_bytes=size).collect()
        assert len(rows) == len(DOCS)
        for r in rows:
            assert (r.found.n_words, r.found.n_hit, len(r.found["items"])) == decontaminate.brute_force(r.text, items)[:3]
    r = next(r for r in rows if r.doc_id == 1)
    assert [r.text[s.start : s.end] for s in r.found.spans] == ["quick brown fox", "over the lazy dog near the old river bank"]
    assert sorted(map(str, (r[:-1] for r in rows))) == sorted(str(tuple(r)) for r in docs.collect())
    assert decontaminate.scan(none, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_pipeline_drops_passages_of_items_without_id(spark, tmp_path):
    items = [(1, "one two three four five six seven eight nine"), (None, "red green blue black white pink brown grey gold")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.createDataFrame([(1, f"so {items[0][1]} it is"), (2, f"and {items[1][1]} too"), (3, "red green blue"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path)).collect()) == [3, 4]


def test_decontamination_query_against_brute_force(spark, tmp_path):
    words = ["one", "Two", "three", "é1", "x"]
    items = [(i, " ".join(RNG.choices(words, k=k))) for i, k in enumerate([8, 9, 30, 3, 1, 0, 12])] + [(10, None), (2, "one two three x x"), (None, "x x x x x x x x")]
    texts = [None, "", *(" .".join(RNG.choices(words, k=RNG.randrange(60))) for _ in range(120))]
    texts += [f"{t} {RNG.choice(items[:3])[1]}, {t}" for t in texts[2:30]]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in decontaminate.op10_decontamination(spark, str(tmp_path)).collect()}
    known = [(None if i is None else str(i), t) for i, t in items]
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == decontaminate.brute_force(t, known)


def test_toxicity(spark, docs, none):
    texts = [f"some plain words number {i} in a text that is fine" + (" you idiot clown" if i % 3 == 0 else "") for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(rows, labels)
    got = toxicity.score(rows.withColumn("out", toxicity.held_out(rows.doc_id)), model).where("out").collect()
    assert len(got) > 30 and all((r["score"] >= 0.3) == (r.doc_id % 3 == 0) for r in got)
    assert {r["tox"] for r in toxicity.score(docs, model, out="tox").where("doc_id in (2, 3)").collect()} == {0.0}
    same = toxicity.fit(rows.unionAll(rows), labels.unionAll(labels))  # repeated rows and labels count once
    assert all((same.p[k] == model.p[k]).all() for k in model.p)
    assert toxicity.score(none, model, out="tox").count() == 0 and toxicity.fit(none, labels.limit(0)).p is None


def small_model():
    model = toxicity.Model.start(0.2, 3)
    for k, v in model.p.items():
        model.p[k] = v + np.random.default_rng(len(k)).standard_normal(v.shape).astype(np.float32) * 0.2
    model.scale = (1.3, -0.2)
    return model


def naive_logit(p, words):
    """One window's logit by plain loops."""
    h = toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def word_input(w):
        row = zlib.crc32(w) % toxicity.WORD_ROWS
        framed, rows = b"<%s>" % w, []
        for i in range(len(framed) - 3):
            key = 0
            for c in framed[i : i + 4]:
                key = (key * 0x100000001B3 + c + 1) % 2**64
            rows.append((key ^ key >> 23) % toxicity.CHAR_ROWS)
        grams = np.mean([p["char"][r] for r in rows], axis=0) if rows else np.zeros(toxicity.EMBED)
        return np.concatenate((p["word"][row], grams)).astype(np.float64)

    inputs = [word_input(w) @ p["wx"] + p["bx"] for w in words]
    states = [[None, None] for _ in words]
    for side, u, order in ((0, p["uf"], range(len(words))), (1, p["ub"], range(len(words) - 1, -1, -1))):
        s = np.zeros(h)
        for t in order:
            x, rec = inputs[t][3 * h * side : 3 * h * (side + 1)], s @ u
            z, r = sig(x[:h] + rec[:h]), sig(x[h : 2 * h] + rec[h : 2 * h])
            c = np.tanh(x[2 * h :] + r * rec[2 * h :])
            s = z * s + (1 - z) * c
            states[t][side] = s
    states = [np.concatenate(s) for s in states]
    weights = np.exp([np.tanh(s @ p["wa"]) @ p["va"] for s in states])
    return float((weights / weights.sum()) @ np.array(states) @ p["wo"] + p["bo"][0])


def test_network_against_plain_loops():
    model = small_model()
    texts = [" ".join(RNG.choices(["a", "bc", "déf", "Ghij", "klmno!", "p-q"], k=n)) for n in (1, 2, 31, 32, 33, 48, 49, 100)] + [None, "", " ;"]
    for text, score in zip(texts, model.scores(texts), strict=True):
        words = (text or "").encode().translate(toxicity.ALNUM_TABLE).split()
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        best = max((naive_logit(model.p, words[i : i + toxicity.WINDOW]) for i in starts), default=None) if words else None
        assert abs(score - (0 if best is None else 1 / (1 + np.exp(-1.3 * best + 0.2)))) < 1e-4


def test_gradients_against_differences():
    model = small_model()
    flat, lengths, words = toxicity.tokenize(["a bc déf a", "ghij", " ".join("klm a bc".split() * 15)])
    feats, (_, begin, size) = toxicity.features(words), toxicity.windows_of(lengths)
    ids, mask = toxicity.gather(flat, begin, size, len(words))
    y = np.arange(len(begin)) % 2

    def loss():
        logit = model.forward(model.inputs(feats) @ model.p["wx"] + model.p["bx"], ids, mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    found = model.gradients(feats, ids, mask, y)
    for name, g in found.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)  # the largest of each array
        was, eps = model.p[name][at], 1e-2
        model.p[name][at] = was + eps
        high = loss()
        model.p[name][at] = was - eps
        low = loss()
        model.p[name][at] = was
        assert abs((high - low) / (2 * eps) - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


def test_long_labelled_texts_are_learnt_from_in_runs(spark):
    assert toxicity.word_runs("a b c", 3, 2) == [[b"a", b"b", b"c"]]
    runs = toxicity.word_runs(" ".join(map(str, range(100))), 20, 5)
    assert len(runs) == 4 and runs[0][0] == b"0" and runs[-1][-1] == b"99" and all(len(r) == 5 for r in runs)
    rows = [(i, f"fine words {i} " * 50 + (" idiot clown" * 20 if i % 2 else "")) for i in range(60)] + [(60, None), (61, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, words=64)
    assert model.scores(["such an idiot clown"])[0] > model.scores(["fine words"])[0]


def test_broken_archives(spark, tmp_path):
    def record(kind, name, block, **fields):
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", *(f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def split(name, numbers, total, head=b"HTTP/1.1 200 OK\r\n\r\n"):
        blocks = {1: head + b"aaa", 2: b"bbb", 3: b"ccc"}
        out = b""
        for n in numbers:
            more = {"Segment_Number": n} | ({"Segment_Total_Length": total} if n == 3 else {})
            out += record("response", f"{name}:0", blocks[1], **more) if n == 1 else record("continuation", f"{name}:0:{n}", blocks[n], Segment_Origin_ID=f"<urn:page:{name}:0>", **more)
        return out

    whole = 19 + 9
    data = split("good", [3, 1, 2], whole) + split("gap", [1, 3], whole) + split("headless", [2, 3], whole) + split("endless", [1, 2], whole)
    data += split("twice", [1, 2, 2, 3], whole) + split("short", [1, 2, 3], whole + 1)
    data += split("framed", [1, 2, 3], 51, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"[:42])
    data += record("response", "digest:0", b"HTTP/1.1 200 OK\r\n\r\nx", Payload_Digest="sha1:WRONG")
    data += record("response", "a%3Ab:0", b"HTTP/1.1 200 OK\r\n\r\nx") + record("response", "!:0", b"HTTP/1.1 200 OK\r\n\r\ny")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc").write_bytes(data)
    rows = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    want = {
        "good": None, "gap": "segments are missing or repeated", "headless": "first segment is missing", "endless": "last segment is missing",
        "twice": "segments are missing or repeated", "short": "length differs from the total", "digest": "digest differs", "a:b": None, None: None,
    }
    assert {k: rows[k].problem for k in want} == want and bytes(rows["good"].payload) == b"aaabbbccc" and bytes(rows[None].payload) == b"y"
    with pytest.raises(ValueError):
        list(warc.parse(data[:100]))


def test_archives_keep_any_id(spark, tmp_path):
    pages = spark.createDataFrame([("a:b", "same"), ("ü <x>", "same"), (None, "same"), (None, "own"), ("null", "")], "page_id string, html string").withColumn("url", F.lit(None).cast("string"))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted((r.page_id or "", r.record_type, r.refers_to or "") for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [("", "response", ""), ("", "revisit", "a:b"), ("a:b", "response", ""), ("null", "response", ""), ("ü <x>", "revisit", "a:b")]


CLASHES = [
    "size", "shard", "slot", "text_crc32", "items", "n_words", "n_hit", "spans", "found", "toxicity", "score", "times", "taken", "part", "target", "source_size",
    "row", "digest", "best_id", "best_digest", "root", "code", "k", "t", "th", "n", "a.b", "`c`", "__h", "__key", "__size", "__bucket", "__n", "__c", "__p", "__t", "__k", "__y",
]


def test_pipeline_stages_with_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=rng.randrange(5, 80))) for _ in range(60)]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(i, t, f"s{i % 4}" if i % 4 else None) for i, t in enumerate(texts)] + [(3, texts[3], "s3"), (70, texts[5], "s1"), (None, "other words without an id that stand here alone", None), (None, None, "s2")]
    rows += [(71, f"see {passage} here", "s1"), (72, "", None), (73, None, None), (74, "word " * 20_000, "s2")]
    docs = spark.createDataFrame([(*r, *[k + 100] * len(CLASHES)) for k, r in enumerate(rows)], ["doc_id", "text", "source", *CLASHES])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns[: len(docs.columns)] == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        kept[name], docs = [tuple(r) for r in out.collect()], out
    assert len(kept["toxicity"]) == len(rows)  # no labels: nothing is known to be toxic
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(" ".join((r[1] or "").split()), r)
    assert sorted(str(r[:3]) for r in kept["simhash"]) == sorted(str(r) for r in first.values())
    assert {str(r[:3]) for r in kept["decontamination"]} == {str(r) for r in first.values()} - {str(rows[-4])}
    assert {r[:2] for r in kept["mixing"]} <= {r[:2] for r in kept["decontamination"]}
    assert sorted(str(r[: len(r) - 4]) for r in kept["sharding"]) == sorted(map(str, kept["mixing"]))
    assert out.columns[-4:] == ["size_", "text_crc32_", "shard_", "slot_"]
    sizes = Counter(r[-2] for r in kept["sharding"])
    assert max(sizes.values()) - min(sizes.values(), default=0) <= 1 and len({r[-2:] for r in kept["sharding"]}) == len(kept["sharding"])


def test_mixing_of_whole_documents_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(400)] + [(None, "null id " * 3, None)] * 30
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(rows, whole_documents=True).collect()
    by = {}
    for r in got:
        assert r.taken == r.times * r["size"] and r.part == 0 and r.times <= 3
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    by_target = {}
    for (_, goal), taken in by.items():
        by_target[goal] = by_target.get(goal, 0) + sum(taken)
    assert abs(sum(by_target.values()) - sum(r["size"] for r in got)) <= 7 * 6


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        path = f"/root/testdata/sf0.001/{table}.parquet"
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*[F.col(f"`{c}`") for c in want.columns]).collect()
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order(map(tuple, got)) == order(want.fetchall())
