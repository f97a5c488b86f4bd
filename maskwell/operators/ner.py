"""Entities from an outside recogniser: filters, decoding of tagged words, chunks, duplicates, name repair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import COMMON_WORDS, FIRST_NAMES, ORG_SUFFIXES, WHITELIST
from ..functions.text import one_of

#: Types of the recogniser and ours.
TYPES = {
    "PERSON": "PERSON", "ORG": "ORG", "EMAIL": "EMAIL", "PHONE": "PHONE", "MONEY": "AMOUNT", "DATE": "DATE", "ADDRESS": "ADDRESS", "GOVID": "GOVID", "BANKACCT": "BANKACCT",
    "CARD": "CARD", "IPADDR": "IPADDR", "CASE": "GOVID",
}


def post_filter(entities: DataFrame, org_confidence: float = 0.7, confidence: float = 0.0) -> DataFrame:
    """Entities (doc_id, ord, type, value, confidence) that stand, with our types; persons with a firm's suffix are firms."""
    v, words = F.col("value"), F.split("value", "\\s+")
    single = ~F.contains(v, F.lit(" "))
    common = F.exists(words, lambda w: one_of(F.lower(w), COMMON_WORDS))
    person = F.col("type") == "PERSON"
    bad = (
        (F.length(v) < 3) | v.startswith("_") | F.contains(v, F.lit("\n")) | one_of(F.upper(v), WHITELIST) | v.rlike("^\\[?[A-Z]+_\\d+\\]?") | (F.col("type") == "MONEY")
        | (person & v.rlike("['’]")) | (person & single & one_of(F.lower(v), COMMON_WORDS)) | (person & (F.length(v) <= 4) & v.rlike("^[A-Z]+$"))
        | (person & ~single & common & ~F.exists(words, lambda w: one_of(w, FIRST_NAMES))) | ((F.col("type") == "ORG") & (F.col("confidence") < org_confidence))
    )
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("type"))
    firm = person & F.exists(words, lambda w: one_of(F.lower(w), ORG_SUFFIXES))
    return entities.filter(~bad & (F.col("confidence") >= confidence)).withColumn("type", F.when(firm, "ORG").otherwise(kind)).filter("type IS NOT NULL")


def decode_tags(words: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, start, type, value, confidence of runs of B-/I- tags. words: doc_id, pos, word, tag, confidence."""
    line = Window.partitionBy("doc_id").orderBy("pos")
    kind = F.regexp_replace("tag", "^[BI]-", "")
    begins = (F.col("tag") != "O") & (F.col("tag").startswith("B-") | (F.coalesce(F.lag("tag").over(line), F.lit("O")) == "O") | (F.lag(kind).over(line) != kind))
    runs = words.withColumn("kind", kind).withColumn("_b", begins.cast("int")).withColumn("run", F.sum("_b").over(line)).filter("tag <> 'O'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    out = runs.groupBy("doc_id", "run").agg(F.min("pos").alias("start"), F.first("kind").alias("type"), joined.alias("value"), F.avg("confidence").alias("confidence"))
    return out.filter(F.col("confidence") >= least).drop("run")


def best_entities(entities: DataFrame) -> DataFrame:
    """One entity for each (doc_id, type, value in lower case): the most confident, at the first place."""
    key = F.lower(F.regexp_replace("value", "^\\W+|\\W+$", ""))
    out = entities.groupBy("doc_id", "type", key.alias("_key")).agg(F.max_by("value", F.struct("confidence", -F.col("ord"))).alias("value"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))
    return out.drop("_key")


def chunks(words: Column, size: int = 126, overlap: int = 32) -> Column:
    """Overlapping slices of an array; the last one reaches the end."""
    stride = size - overlap
    last = F.greatest(F.ceil((F.size(words) - size) / F.lit(stride)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * stride + 1, F.lit(size)))


def segments(text: Column, words: int = 70) -> Column:
    """Sentences of a text joined to segments: one ends where the next sentence would bring it over so many words."""
    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda x: F.trim(x) != "")
    size = lambda x: F.size(F.filter(F.split(x, "\\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(at: Column, x: Column) -> Column:
        full = (at["n"] > 0) & (at["n"] + size(x) > words)
        done = F.when(full, F.array_append(at["done"], at["open"])).otherwise(at["done"])
        joined = F.when(full | (at["n"] == 0), x).otherwise(F.concat(at["open"], F.lit(" "), x))
        return F.struct(done.alias("done"), joined.alias("open"), (F.when(full, 0).otherwise(at["n"]) + size(x)).alias("n"))

    return F.aggregate(sentences, start, add, lambda at: F.when(at["n"] > 0, F.array_append(at["done"], at["open"])).otherwise(at["done"]))


def choose_pass(with_sounds: Column, without: Column, least: float = 0.75) -> Column:
    """Entities of the pass without sounds if they are more and on average surer than `least`, else of the other one."""
    mean = F.aggregate(without, F.lit(0.0), lambda s, e: s + e["confidence"]) / F.nullif(F.size(without), F.lit(0))
    return F.when((F.size(without) > F.size(with_sounds)) & (mean > least), without).otherwise(with_sounds)


def sound_ids(code: Column, vocabulary: str, slots: int = 6) -> Column:
    """The letters of a sound key as numbers: 0 fills up, 1 is unknown, the vocabulary counts from 2."""
    letters = F.filter(F.split(code, ""), lambda c: c != "")
    ids = F.transform(letters, lambda c: F.when(F.instr(F.lit(vocabulary), c) > 0, F.instr(F.lit(vocabulary), c) + 1).otherwise(1))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), slots)), 1, slots)


def capital_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word: the capitalised words of each text, once whatever the case, in the form that comes first."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?U)\\b[A-Z][a-zA-Z'-]{2,}\\b"), F.lit(0))
    placed = docs.select(key, F.posexplode(found).alias("pos", "word"))
    return placed.groupBy(key, F.lower("word").alias("_low")).agg(F.min_by("word", "pos").alias("word")).drop("_low")


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _deletions(word: Column) -> Column:
    """The forms of a word with up to two letters left out; two words at edit distance two or less share one."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.overlay(w, F.lit(""), i, F.lit(1)))
    once = F.when(F.length(word) > 0, one(word)).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(once, lambda w: F.when(F.length(w) > 0, one(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _prefixes(word: Column) -> Column:
    """The prefixes of four letters or more."""
    return F.when(F.length(word) >= 4, F.transform(F.sequence(F.lit(4), F.length(word)), lambda n: F.substring(word, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def repair_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, best: the nearest known name at edit distance two or less, or that a name of four letters or more begins.

    Case is ignored; of names as near the smallest. Joins on forms with up to two letters left out and on prefixes,
    which lose no such pair.
    """
    left = names.filter("name IS NOT NULL").select("name").distinct().withColumn("low", F.lower("name"))
    right = known.filter("name IS NOT NULL").select(F.col("name").alias("known")).distinct().withColumn("known_low", F.lower("known"))
    near = left.withColumn("_k", F.explode(_deletions(F.col("low")))).join(right.withColumn("_k", F.explode(_deletions(F.col("known_low")))), "_k")
    near = near.drop("_k").distinct().filter(F.levenshtein("low", "known_low") <= 2)
    begun = left.filter(F.length("low") >= 4).join(right.withColumn("low", F.explode(_prefixes(F.col("known_low")))), "low").select(*near.columns)
    pairs = near.unionByName(begun).withColumn("d", F.levenshtein("low", "known_low"))
    return pairs.groupBy("name").agg(F.min(F.struct("d", "known")).alias("m")).select("name", F.col("m.known").alias("best"))


_VOWELS = "AEIOUY"
_SOUNDS = {"B": "P", "D": "T", "G": "K", "Q": "K", "C": "K", "V": "F", "Z": "S", "J": "J", "X": "KS"}


def sound(word: str | None) -> str:
    """A short key of how a word sounds: consonants by class, a first vowel as A, doubles once, eight at most."""
    word = "".join(c for c in (word or "").upper() if c.isalpha())
    for old, new in (("PH", "F"), ("SCH", "X"), ("SH", "X"), ("CH", "X"), ("TH", "0"), ("CK", "K"), ("GH", ""), ("KN", "N"), ("WR", "R"), ("MB", "M")):
        word = word.replace(old, new)
    out = "A" if word[:1] and word[0] in _VOWELS else ""
    for i, c in enumerate(word):
        if c in _VOWELS or c in "HW":
            continue
        made = "S" if c == "C" and word[i + 1 : i + 2] in ("E", "I", "Y") else ("X" if c == "X" and i == 0 else _SOUNDS.get(c, c))
        if not out.endswith(made):
            out += made
    return out[:8]


def sounds(words: DataFrame, column: str = "word") -> DataFrame:
    """words with a column `sound`; no built-in has this key, so Arrow batches go through Python."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(sound=part[column].map(sound))

    return words.mapInPandas(run, words.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sound string")
