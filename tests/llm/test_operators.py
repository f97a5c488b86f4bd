import random
from hashlib import sha256

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwell.llm import bpe, minhash, mixing, quality_model, quality_rules, sharding, substring_dedup, token_counts, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(30, 200))) for _ in range(60)]
    passage = " ".join(rng.choices(vocab, k=60))
    texts += [texts[0]] * 12 + [texts[1] + " more", texts[2].upper(), f"a {passage} b", f"{passage}", "a b c d", "a b c d", "", None, "  \n\t ", "x " * 300]
    texts += [" ".join(t.split()[:-1] + [f"n{i}"]) for i, t in enumerate([texts[3]] * 20)]
    return [(i, t, "en", [None, "s1", "s2"][i % 3], None, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates([(r[0], r[1]) for r in corpus()])
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("families", [True, False])
def test_large_groups_alike_but_too_little(spark, monkeypatch, families):
    """More members than a block, near the limit on both sides: regrouped by rare shingles, compared in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    if not families:  # as where a few members hold a large family together
        monkeypatch.setattr(minhash, "_families", lambda groups: groups)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(60), 2 + i % 2):
            words[at] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_signature_estimates_similarity():
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(250, 1250, dtype=np.uint64)
    same = (minhash.signature(minhash.mix(a)) == minhash.signature(minhash.mix(b))).mean()
    assert abs(same - 0.6) < 0.15


def test_substring_dedup(docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert list(map(got.get, range(len(corpus())))) == brute.substring_dedup([r[1] for r in corpus()])
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_with_full_sketch(docs, monkeypatch):
    """A sketch that says "repeated" of all windows changes nothing."""
    monkeypatch.setattr(substring_dedup, "_estimated_twice", lambda keys, bits: np.ones(len(keys), bool))
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert [got[i] for i in range(len(got))] == [x[1] for x in brute.substring_dedup([r[1] for r in corpus()])]


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs, mixing.word_count()).collect()
    assert len(rows) == len(corpus()) and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["size"] == len(brute.words(corpus()[r["doc_id"]][1]))
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 0.02 * v[0]["target"] + 50
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs, mixing.word_count()).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix_sources(empty, mixing.word_count()).count() == 0


def test_mixing_with_one_long_document(spark):
    """One document holds a third of its source: the sample goes on past it, down to a gap that no document fits."""
    rows = []
    for s in range(30):
        rng = random.Random(s)
        sizes = [rng.randint(50, 799) for _ in range(120)]
        rows += [(1000 * s + i, f"s{s:02}", n) for i, n in enumerate([*sizes, sum(sizes) // 2])]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix_sources(frame, F.col("size"), weights=(1.0,), repeats=1, share=0.5)
    by = {}
    for r in mixed.collect():
        assert 0 <= r["copies"] <= 1
        by.setdefault(r["source"], []).append(r)
    for got in by.values():
        left = got[0]["target"] - sum(r["taken"] for r in got)
        assert left < min(r["size"] for r in got if not r["copies"]) and abs(left) <= 0.005 * got[0]["target"]
    assert len(by) == 30 and 0 < sum(r["copies"] for v in by.values() for r in v if r["size"] > 10_000) < 30


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=5).collect()
    counts, slots = {}, {}
    for r in rows:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
        slots.setdefault(r["shard"], set()).add(r["slot"])
    assert max(counts.values()) - min(counts.values()) <= 1 and len(rows) == len(corpus())
    assert all(slots[s] == set(range(n)) for s, n in counts.items())
    assert len({r["shard"] for r in rows if corpus()[r["doc_id"]][1] == corpus()[0][1]}) <= 2
    assert sharding.shard_documents(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(900, None), (950, [1.0, None] + [0.0] * 6), (1000, [float("nan")] * 8), (401, rng.normal(size=3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector")).filter("vector IS NOT NULL")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = np.floor(256 * np.array([r[1] for r in rows[:400]], np.float32).astype(float)).astype(int)
    for q in range(0, 400, 50):
        scores = x @ x[q]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in best]
    none = df.filter("false")
    assert topk.top_k(none, none).count() == 0


def test_bpe_is_that_of_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(2)
    texts = ["", "<|endoftext|>a<|endoftext|> b", "aaaaaaaaa aaa", " \n\n x", "é😀" * 50] + ["".join(rng.choice("ab  c<é\n\t ▁😀19'sTHE") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    made = bpe.Bpe.of(bpe.VOCABULARY)
    got = list(made.encode(texts))
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [made.decode(g) for g in got] == texts
    rows = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs).collect()}
    assert all(r["decoded_sha256"] == sha256((corpus()[i][1] or "").encode()).hexdigest() for i, r in rows.items())
    assert bpe.bpe_round_trip(empty).count() == 0


def test_token_counts_in_chunks(docs, empty):
    counter = token_counts.Counter.of(token_counts.MODEL)
    rng = random.Random(4)
    texts = ["  ".join(r[1] or "" for r in corpus()), "é" * 3000, "a b" * 900, "x" * 2000 + " y " + "z" * 2000, "▁ a" * 300] + ["".join(rng.choice("ab  é▁\n😀") for _ in range(800)) for _ in range(20)]
    want = [len(x) for x in counter.pieces.encode(texts)]
    for chunk in (60, 400):
        assert [counter.count_chunked(t, chunk, 8) for t in texts] == want
    assert counter.count(texts, chunk=100) == counter.count(texts) == want
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    assert rows[76]["n_bytes"] == len((corpus()[76][1] or "").encode())
    assert token_counts.count_tokens(empty).count() == 0


def test_offsets_of_chunks_are_those_of_the_library():
    counter = token_counts.Counter.of(token_counts.MODEL)
    for text in ("", " ", "a  b c", "é a éé b", "\u2581 a\u2581b", "日本 😀\u0000 x", "<s> </s>\r\n\tx", "e\u0301 \ufeffa\u200bb"):
        raw = text.encode()
        want = [p.begin for p in counter.pieces.encode(text, return_type="proto").pieces]
        assert counter.boundaries(raw, 0, len(raw)).tolist() == want



def test_quality_rules(docs, empty):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, keep=["doc_id"]).collect()}
    for i, (_, t, *_) in enumerate(corpus()):
        w = brute.words(t)
        runs = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        inside = {k for j, r in enumerate(runs) if runs.count(r) > 1 for k in range(j, j + 8)}
        assert (rows[i]["n_words"], rows[i]["word_chars"], rows[i]["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(inside))
        assert rows[i]["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (rows[i]["base_failed"] and rows[i]["kept"])
    assert quality_rules.measure("a $b\n\nc d\na $b\n a $b")[1:4] == (11, 3, 1)
    assert quality_rules.quality_rules(empty).count() == 0


def _labelled(spark, toxic):
    rng = random.Random(9)
    good = [" ".join(rng.choices([f"v{i}" for i in range(200)], k=80)) for _ in range(300)]
    rows = [(i, t + (f" {rng.choice(['gromp', 'blargle'])} you" if i % 3 == 0 else "") if toxic else (t if i % 3 else " ".join(["SAME!! ###"] * 60))) for i, t in enumerate(good)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark, True)
    rows = toxicity.score_toxicity(docs, toxicity.learn_lexicon(docs, labels)).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert len(rows) == 302 and sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_folding_and_exceptions():
    made = toxicity.Lexicon({" idiot ": 3.0, " ioser ": 3.0}, ("idiot wind",))
    for t in ("1d10t", "Idiоt", "an idiot!!", "l0ser", "ídiot", "1oser"):
        assert made.measure(t)[0] > 0, t
    assert made.measure("idiot wind")[0] == made.measure("idiotic")[0] == made.measure(None)[0] == 0


def test_quality_model(spark):
    docs, labels = _labelled(spark, False)
    rows = quality_model.score_quality(docs, quality_model.learn_quality(docs, labels)).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert len(rows) == 302 and sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) >= 0.95 * len(held)


def test_pipeline_stages(spark, docs, empty):
    frame = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, "")
        assert name == "bpe" or out.columns == corpus_pipeline.COLUMNS
        frame = spark.createDataFrame(out.collect(), out.schema)
        assert frame.count() > 0
        stage(spark, empty.select(*corpus_pipeline.COLUMNS), "").count()


@pytest.mark.parametrize("repeat", [False, True])
def test_near_dedup_judges_each_text(spark, repeat):
    """Null ids and ids with several texts: what stays doesn't depend on whether some other id occurs twice."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, b), (None, c), (None, None), (None, None), (5, d), (5, e), (3, d), (7, c), (8, ""), (9, " ")]
    rows += [(2, f), (2, f)] if repeat else [(2, f)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, frame, "")
    assert out.columns == corpus_pipeline.COLUMNS
    want = [(None, a), (None, b), (None, None), (None, None), (3, d), (5, e), (7, c), (8, ""), (9, " "), (2, f)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))
