"""Segments, filters over redacted texts, session tokens as whole words, and word lists in plans."""

import random

from pyspark.sql import functions as F

from maskwell.functions import text as T
from maskwell.operators import ner
from maskwell.operators import sessions as S
from maskwell.operators.redact import redact


def plain_segments(sentences, words):
    out = []
    for s in sentences:
        if out and sum(len(x.split()) for x in out[-1]) + len(s.split()) <= words:
            out[-1].append(s)
        else:
            out.append([s])
    return [" ".join(x) for x in out]


def test_segments(spark):
    rng = random.Random(1)
    texts = [[" ".join(["w"] * rng.randint(1, 30)) + rng.choice(".!?") for _ in range(rng.randint(1, 20))] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(98, ""), (99, None)]
    got = dict(spark.createDataFrame(rows, "i long, t string").select("i", ner.segments(F.coalesce("t", F.lit("")), 40).alias("s")).collect())
    assert all(got[i] == plain_segments(t, 40) for i, t in enumerate(texts)) and got[98] == got[99] == []


def test_filter_on_the_result_stays_above_the_fold(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co"), (2, "nothing")], "doc_id long, text string")
    done = redact(docs)
    assert [r["doc_id"] for r in done.filter("n_tokens > 0").collect()] == [1]
    assert done.select(F.explode("token_map")).count() == 1


def test_known_values_are_whole_words(spark):
    entry = F.struct(F.lit("[PERSON_1]").alias("token"), F.lit("PERSON").alias("type"), F.lit("Mark").alias("original_value"))
    df = spark.createDataFrame([("Mark's Market, MARK and remark Mark",)], "t string")
    assert df.select(T.apply_token_map(F.col("t"), F.array(entry))).first()[0] == "[PERSON_1]'s Market, [PERSON_1] and remark [PERSON_1]"


def test_context_core(spark):
    rows = [("account number 62847501234", "62847501234"), ("Passport: A1234567", "A1234567"), ("62847501234", None), ("account", None)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(rows, "v string, w string").select(T.context_core(F.col("v")), "w").collect())


def test_session_comes_back(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a@b.co"), (1, 1, "assistant", "c@d.co and a@b.co"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    masked = S.redact_session(turns).select("conv_id", "turn", F.col("sanitized").alias("text"))
    back = {(r[0], r[1]): r[2] for r in S.rehydrate_session(masked, S.session_tokens(turns)).collect()}
    assert back == {(1, 0): "a@b.co", (1, 1): "c@d.co and a@b.co", (2, 0): ""}
