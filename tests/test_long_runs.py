"""Runs of thousands of words: a group that is repeated with giving back takes stack for each round in Java."""

import random

import pytest
from pyspark.sql import functions as F

from maskwell.functions.rules import RULES
from maskwell.operators.mentions import _CAPITALS
from maskwell.operators.redact import redact
from maskwell.plans.queries import QUERIES

N = 10_000
LONG = {
    "reach kai at " + "blue " * N + "lake dot com to follow": "reach [EMAIL_1] to follow",
    "reach kai at " + "blue " * N + "lake, to follow": "reach kai at " + "blue " * N + "lake, to follow",
    "pay " + "one hundred and " * N + "five million dollars today": "pay [AMOUNT_1] today",
}
#: rule: words, and what may stand between them
WORDS = {
    "spoken_email": ["kai at", "kai at blue", "dot com", "dot org", *"at dot com co a bb him x9 é dotcom comx MeK".split()],
    "verbal_amount": "one two six sixteen sixty seventy hundred and point thousand million dollars rand oneX hundredth".split(),
    "url": "x.com www. www.a.co https:// http:// http://b.io/p?x=1 xhttps:// é com .com co .org/a/b a-b _ / 1 . WWW.X.NET x.y.z.africa".split(),
    "names": "A-- Foo Foo- B'x An' Abc-d X'' Éva Foé lower A'-b --- ABC Sarah Chen Foó Foo_".split(),
}
BETWEEN = [" ", " ", " ", "  ", "\n", " ", "-", ", ", ".", ""]


def test_long_runs_in_pages(spark, tmp_path):
    spark.createDataFrame(list(enumerate(LONG)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["sanitized"], r["n_tokens"]) for r in QUERIES["redact_pages"](spark, str(tmp_path)).collect()}
    assert got == {i: (s, s.count("_1]")) for i, s in enumerate(LONG.values())}


def test_long_run_of_names(spark):
    docs = spark.createDataFrame([(1, "Sarah " + "Chen " * N + "left")], "doc_id long, text string")
    assert redact(docs).first()["sanitized"] == "[PERSON_1] left"


@pytest.mark.parametrize("name", WORDS)
def test_flat_patterns_match_the_same(spark, name):
    flat = {r.name: ("(?iU)" + r.pattern, r.java) for r in RULES if r.flat}
    assert flat.keys() == WORDS.keys() - {"names"}
    plain, java = (flat | {"names": (r"(?U)\b[A-Z][a-zA-Z'-]{2,}(?:\s+[A-Z][a-zA-Z'-]{2,})*\b", "(?U)" + _CAPITALS)})[name]
    rng = random.Random(3)
    texts = ["kai at blue dot com lake dot org x", "one hundred sixty-six million", "Foo- Bar A-- Foo-- B-- X"]
    texts += ["".join(rng.choice(WORDS[name]) + rng.choice(BETWEEN) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(found(plain).alias("a"), found(java).alias("b"))
    assert both.filter("size(a) > 0").count() > 20 and both.filter("NOT a <=> b").collect() == []


def test_java_forms_and_gates_match_the_same(spark):
    """All rules over pieces of mentions: boundaries, gates and the shorter search for hosts lose and add nothing."""
    pieces = (
        "at dot com x.com www. www.a.co https:// http://b.io/p?x=1 é É 12 123-45-6789 4532 1234 5678 9012 the The only director of CEO fraud probe before announcement one million dollars "
        "R 5,000 zar kai him a@b.co 10.0.0.1 passport license account number ID acme capital standard bank May 5th 42 Rivonia Road . - / _"
    ).split()
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", ".", "-", "/", "_"]) for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    none = F.array().cast("array<string>")
    plain = [found(("(?iU)" if r.ignore_case else "(?U)") + r.pattern) for r in RULES]
    java = [F.when(F.col("t").rlike(r.gate), found(r.java)).otherwise(none) if r.gate else found(r.java) for r in RULES]
    differ = [F.count_if(~a.eqNullSafe(b)).alias(r.name) for r, a, b in zip(RULES, plain, java, strict=True)]
    hits = [F.count_if(F.size(a) > 0).alias(f"{r.name}_hits") for r, a in zip(RULES, plain, strict=True)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").agg(*differ, *hits).first().asDict()
    assert [r.name for r in RULES if got[r.name]] == [] and got["url_hits"] > 1000 and got["hybrid_email_hits"] > 10
