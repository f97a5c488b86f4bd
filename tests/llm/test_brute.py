"""Operators that SQL can't express against plain versions, and the cases that every operator must handle."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwell.llm import bpe, common, minhash, mixing, quality_model, quality_rules, sharding, substring_dedup, token_counts, topk, toxicity

#: names that operators use inside, as columns of the input
CLASHES = ["rep", "key", "n", "w", "tag", "component", "label", "row", "bucket", "sk", "u", "_row", "_tag", "_c0", "h", "at", "n_words", "kept", "score", "_key"]


def odd_rows():
    """Null ids, one id on several texts, repeated rows, empty and long texts."""
    rng = random.Random(7)
    some = [" ".join(rng.choices([f"v{i}" for i in range(300)], k=rng.randint(20, 120))) for _ in range(20)]
    long = " ".join(f"l{i * i % 99_991}" for i in range(30_000))
    rows = [(i, t) for i, t in enumerate(some)] + [(None, some[0]), (None, some[1]), (None, "one two three"), (5, some[6]), (5, "x y"), (5, some[5]), (7, some[7])]
    return rows + [(30, long), (31, long + " end"), (32, None), (33, ""), (34, " \n\t"), (None, None), (None, ""), (35, "a " * 3000), (36, "ß" * 5000)]


def frame(spark, rows, **more):
    made = spark.createDataFrame([(i, t, "s" if k % 3 else None, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long")
    return made.select("*", *[F.lit(1).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, odd_rows()[:1]).filter("false")


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


WANT = Counter(i for i, _ in odd_rows())


def test_near_duplicates_of_odd_rows(spark, odd, none):
    """Each row is judged by its own text: as if every row had an id of its own, named by the smallest given id."""
    texts = [t for _, t in odd_rows()]
    found = brute.near_duplicates(list(enumerate(texts)))
    least = {}
    for k, (i, _) in enumerate(odd_rows()):
        if i is not None:
            least[found[k][1]] = min(i, least.get(found[k][1], i))
    want = Counter((i, found[k][0], least.get(found[k][1]) if found[k][0] else i) for k, (i, _) in enumerate(odd_rows()))
    got = minhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(none).count() == 0


def test_candidates_of_tiny_sets_are_exact():
    rng = random.Random(2)
    for n in range(1, 13):
        for _ in range(300):
            base = rng.sample(range(1 << 62), n + 8)
            more = rng.randint(0, n // 3)
            a, b = base[:n], base[:n] + base[n : n + more]
            if 100 * len(set(a) & set(b)) < 75 * len(set(a) | set(b)):
                continue
            keys = [set(minhash.mix(np.sort(np.array(x, np.uint64))[: minhash.prefix_length(len(x))], 905).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


@pytest.mark.parametrize("n", [3, 4, 6, 9, 12, 15, 18, 21, 24, 30, 45, 60, 100])
def test_recall_by_set_size(n):
    """Pairs at the limit of similarity share a key and, but for tiny sets, have sketches that are near enough."""
    rng = np.random.default_rng(n)
    missed, pairs = 0, 150
    for _ in range(pairs):
        big = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        small = big[: math.ceil(0.75 * n)]
        found = []
        for x in (np.sort(big), np.sort(small)):
            places = minhash.signature(x)
            keys = {(i, *places[4 * i : 4 * i + 4].tolist()) for i in range(32)}
            if n <= minhash.TINY:
                keys |= {(-1, int(v)) for v in x[: minhash.prefix_length(len(x))]}
            found.append((keys, np.frombuffer(minhash._sketch_of(places), np.uint8)))
        near = n <= minhash.TINY or (found[0][1] == found[1][1]).sum() >= minhash.SKETCH_LEAST
        missed += not (found[0][0] & found[1][0] and near)
    assert missed == 0


def test_tiny_texts_are_all_linked(spark, monkeypatch):
    """Many short texts that are alike: groups go to blocks, and no link of tiny sets is lost there."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(9)]
    rows = list(enumerate({" ".join(vocab[: rng.randint(5, 9)] + rng.choices("abcdefgh", k=rng.randint(0, 2))) for _ in range(150)}))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_mixing_is_greedy_pareto_order(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 3, rng.randint(5, 900)])) for k in range(400)] + [(900, "a", 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long").coalesce(1)
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(F.hash("doc_id", F.col("words")), 20_240_501, F.col("doc_id")).alias("u")).collect()}
    got = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, F.col("words")).collect()}
    want = brute.mix([(k, s, n, u[k], k) for k, s, n in rows], mixing.WEIGHTS, mixing.REPEATS, mixing.LENGTH_SLOPE)
    assert got == want


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.mix_sources(odd, mixing.word_count()).collect()
    assert ids(rows) == WANT and {r["size"] for r in rows if r["doc_id"] in (32, 33, 34)} == {0} and max(r["size"] for r in rows) == 30_001
    total = sum(r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - total) < 1e-6 * total
    assert mixing.mix_sources(none, mixing.word_count()).count() == 0


def test_sharding_is_label_propagation(spark):
    """Linked documents end where plain propagation puts them; a group of a third of all rows fills several shards."""
    rng = random.Random(5)
    texts = [f"group {g}" for g in range(12) for _ in range(rng.randint(2, 9))] + ["large"] * 90 + [f"own {i}" for i in range(250)]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    rows = {r["doc_id"]: r for r in sharding.shard_documents(docs, shards=8).collect()}
    starts = {r["doc_id"]: ((r["h"], r["crc"], r["size"]), r["s"]) for r in docs.select("doc_id", F.xxhash64("text").alias("h"), F.crc32("text").alias("crc"), (F.octet_length("text") + 16).alias("size"), F.pmod(F.xxhash64("doc_id", F.lit(sharding.SEED)), F.lit(8)).alias("s")).collect()}
    groups = Counter(g for g, _ in starts.values())
    pieces = Counter(p for p in starts.values() if groups[p[0]] > 1)
    at = brute.propagate(pieces, len(texts) // 8, 8)
    load = Counter()
    for p, n in pieces.items():
        load[at[p]] += n
    assert max(load.values()) <= len(texts) // 8
    assert all(rows[i]["shard"] == at[p] for i, p in starts.items() if p in at)
    assert len({at[p] for p in pieces if p[0] == starts[len(texts) - 251][0]}) > 1


def test_sharding_of_odd_rows(odd, none):
    rows = sharding.shard_documents(odd, shards=4).collect()
    counts = Counter(r["shard"] for r in rows)
    assert ids(rows) == WANT and max(counts.values()) - min(counts.values()) <= 1
    assert all({r["slot"] for r in rows if r["shard"] == s} == set(range(n)) for s, n in counts.items())
    assert {r["size"] for r in rows if r["doc_id"] == 32} == {16} and sharding.shard_documents(none).count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randint(-1, 1) for _ in range(3)]) for i in range(300)] + [(7, [1, 1, 1]), (50, [0, 0, 0]), (500, [1]), (501, [2]), (502, list(range(2000)))]
    docs = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("query_id", F.lit(1)).withColumn("score", F.lit(2)).withColumn("rank", F.lit(3))
    queries = docs.filter("vec_id % 50 = 0")
    for waves in (topk.WAVE_BYTES, 60):
        got = {}
        for r in topk.top_k(docs, queries, wave_bytes=waves).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in {i for i, _ in rows if i % 50 == 0}:
            v = min(x for i, x in rows if i == q)
            scores = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in rows if i != q and len(x) == len(v))
            assert got.get(q, []) == [(i, -s) for s, i in scores[:5]]


def test_top_k_stops_early_where_values_are_uneven():
    """Lists are read to a depth at which few candidates are in, far from their ends."""
    rng = np.random.default_rng(0)
    vectors = np.floor(256 * rng.exponential(size=(2000, 8)) ** 3 * np.where(rng.random((2000, 8)) < 0.1, 20, 0.1))
    best, report = topk.Best(40, 5), {}
    topk.search_block(vectors[::50], np.arange(0, 2000, 50), topk.Lists(np.arange(2000), vectors), best, report)
    assert min(report) <= topk.FIRST_DEPTH and max(report) <= 500
    scores = vectors[::50] @ vectors.T
    scores[np.arange(40), np.arange(0, 2000, 50)] = -1
    assert (best.ids == np.array([np.lexsort((np.arange(2000), -s))[:5] for s in scores])).all()


def test_bpe_and_token_counts_of_odd_rows(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    counter = token_counts.Counter.of(token_counts.MODEL)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in bpe.bpe_round_trip(odd).collect()) == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows())
    assert all(len(p) <= bpe.LONGEST or p in bpe.Bpe.of(bpe.VOCABULARY).special for p in bpe.Bpe.of(bpe.VOCABULARY).known)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd).collect()) == Counter((i, len(counter.pieces.encode(t or ""))) for i, t in odd_rows())
    assert bpe.bpe_round_trip(none).count() == token_counts.count_tokens(none).count() == 0


def test_quality_rules_against_plain_counts(odd, none):
    rng = random.Random(3)
    texts = [t for _, t in odd_rows() if t is None or len(t) < 9000]
    for _ in range(60):
        lines = [" ".join(rng.choices(["aé", "b", "#c", "dd$", "|", "long" * 5], k=rng.randint(0, 14))) for _ in range(4)]
        texts.append(rng.choice(["\n", " \n", "\t"]).join(rng.choices(lines, k=rng.randint(1, 9))))
    for t in texts:
        n, chars, symbols, dup, again, shares, line_share = brute.repetition(t)
        got = quality_rules.measure(t)
        assert got[:5] == (n, chars, symbols, dup, again)
        assert got[5] == pytest.approx(max(shares.values())) and got[6] == pytest.approx(line_share)
        failed = n < 20 or 100 * again > 30 * n
        fine = all(shares[k] <= most for k, most in quality_rules.MAX_NGRAM_SHARE.items())
        assert got[7:] == (failed, not failed and fine and line_share <= quality_rules.MAX_LINE_SHARE and symbols <= quality_rules.MAX_SYMBOL_SHARE * chars)
    assert ids(quality_rules.quality_rules(odd, keep=["doc_id"]).collect()) == WANT and quality_rules.quality_rules(none).count() == 0


def test_lexicon_against_plain_search():
    rng = random.Random(1)
    made = toxicity.Lexicon({" bad ": 2.0, " ugi": 1.0, " vile thing ": 3.0}, ("bad luck",))
    vocab = ["bad", "b4d", "ugly", "uglier", "vile", "thing", "luck", "fine", "words", "bád", "so"]
    for _ in range(400):
        text = " ".join(rng.choices(vocab, k=rng.choice([2, 8, 60, 400])))
        folded = toxicity.fold(text)

        def hits(folded, whole):
            spared = [(m, m + 10) for m in range(len(folded)) if folded.startswith(" bad iuck ", m)]
            for term, weight in made.weights.items():
                for m in range(len(folded)):
                    if folded.startswith(term, m) and not any(a <= m and m + len(term) - 1 <= b for a, b in spared) and (not whole or term.endswith(" ")):
                        yield m, weight, term

        found = list(hits(folded, False))
        found += [h for h in hits(toxicity.without_accents(folded), True) if not any(h[0] == x[0] for x in found if x[2].endswith(" "))] if not folded.isascii() else []
        if not found:
            assert made.measure(text) == (0, 0)
            continue
        most = max(sum(w for b, w, _ in found if m - toxicity.STRETCH < b <= m) for m, _, _ in found)
        size = max(toxicity.LEAST_STRETCH, len(folded))
        assert made.measure(text) == pytest.approx((math.log1p(600 * most / min(600, size)), math.log1p(600 * sum(w for _, w, _ in found) / size)))
    clean, once = "plain words stand here " * 40, "you are bad " + "plain words stand here " * 40
    assert made.measure(once * 2)[0] == made.measure(once)[0] > made.measure(clean)[0] == 0
    assert made.measure(once * 50)[1] == pytest.approx(made.measure(once)[1], abs=0.01)


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, int(i % 2 == 0)) for i in range(40)] + [(1, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for learn, score in ((toxicity.learn_lexicon, toxicity.score_toxicity), (quality_model.learn_quality, quality_model.score_quality)):
        rows = score(odd, learn(odd, labels)).collect()
        assert ids(rows) == WANT and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] for r in rows if r["doc_id"] is None)
        assert len({r["score"] for r in rows if r["doc_id"] in (32, 33)}) == 1
        assert score(none, learn(none, labels)).count() == 0
        assert score(odd, learn(odd, labels.filter("false"))).count() == len(rows)


def test_attention_against_plain_loops():
    """The forward pass of one document, and the gradient that training follows, by differences."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality_model.FEATURES)).astype(np.float32) for n in (1, 4, 7)]
    y = np.array([1.0, 0.0, 1.0])
    model = quality_model.train(bags, y, np.ones(3), steps=5)
    p, got = model.p, model.scores(bags)

    def score(bag):
        h = [np.tanh((x - model.mean) / model.scale @ p["w"] + p["b"]) for x in bag]
        s = [float((np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"])))) @ p["a"]) for v in h]
        e = [math.exp(x) for x in s]
        z = sum(a / sum(e) * v for a, v in zip(e, h))
        return 1 / (1 + math.exp(-(float(z @ p["c"]) + float(p["d"]))))

    assert got == pytest.approx([score(b) for b in bags], abs=1e-6)

    def loss(steps):
        s = quality_model.train(bags, y, np.ones(3), steps=steps).scores(bags)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    assert loss(60) < 0.2 * loss(1)
    text = "aa b, C! 12 é " * 40
    made = quality_model.passages(text)
    assert made.shape == (4, quality_model.FEATURES)
    first = " ".join(text.split()[: quality_model.PASSAGE])
    counts = Counter(quality_model._CLASS[b] for b in first.encode())
    assert made[0][: quality_model._N_CLASSES] == pytest.approx([math.sqrt(counts[c] / len(first.encode())) for c in range(quality_model._N_CLASSES)])
    assert made[0][quality_model._N_CLASSES + 1] == pytest.approx(5 / 64)


def test_training_takes_whole_rows(spark):
    """A bound on passages leaves rows out, not parts of them."""
    docs = spark.createDataFrame([(i, "w " * (64 * (i % 5 + 1))) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    seen = []
    monkey = pytest.MonkeyPatch()
    monkey.setattr(quality_model, "train", lambda bags, y, weights: seen.append([len(b) for b in bags]))
    try:
        quality_model.learn_quality(docs, labels, passages_in_all=60)
        quality_model.learn_quality(docs, labels)
    finally:
        monkey.undo()
    assert sum(seen[0]) <= 60 < sum(seen[1]) and set(seen[0]) <= {1, 2, 3, 4, 5} and len(seen[1]) >= 75


def test_substring_dedup_of_odd_rows(spark, odd, none):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(odd).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(odd_rows(), brute.substring_dedup([t for _, t in odd_rows()])))
    assert substring_dedup.substring_dedup(none).count() == 0


def test_anchors_in_parts(monkeypatch):
    hashes = common.mix(np.arange(5000, dtype=np.uint64) % np.uint64(77))
    whole = substring_dedup._anchors(hashes, 35, 8)
    monkeypatch.setattr(substring_dedup, "RUNS", 100)
    part = substring_dedup._anchors(hashes, 35, 8)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def test_pipeline_of_odd_rows(spark, odd, none):
    """Stage by stage on rows with all odd cases: what each returns, against plain versions."""
    docs = odd
    want = [(i, t) for i, t in odd_rows() if quality_rules.measure(t)[-1]]
    docs = corpus_pipeline.quality(spark, docs, "")
    assert docs.columns == corpus_pipeline.COLUMNS and sorted(map(str, ((r[0], r[1]) for r in docs.collect()))) == sorted(map(str, want))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_shared_folder_on_a_cluster_must_be_named():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())
