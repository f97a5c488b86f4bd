"""Tier A: typed mentions of documents as rows. One scan, one generate, no shuffle before numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import (
    COMMON_WORDS, DETERMINERS, FIRST_NAMES, GENERIC_ORGS, NATIONALITIES, NOT_NAMES, NOT_ORGS, ORG_CONTEXT, ORG_WORDS, ORGS, WHITELIST,
)
from ..functions.rules import NUMBER, RULES, Rule
from ..functions.text import dedup_key, has_public_company, is_safe_domain, is_sensitive, matches, one_of, quoted, role_is_specific

#: A capitalised word as far as its last boundary, and a whole one without any but at its beginning.
_ENDED = "[A-Z][a-zA-Z'-]{2,}\\b"
_OPEN = f"(?!{_ENDED})[A-Z][a-zA-Z'-]{{2,}}+\\s++"
#: Runs of capitalised words that end at a boundary: \b W(?:\s+W)*\b for W = [A-Z][a-zA-Z'-]{2,}. Possessive loops, as a
#: loop that can give back rounds takes stack for each of them.
_CAPITALS = f"\\b(?:{_OPEN})*+{_ENDED}(?:[a-zA-Z'-]*+\\s++(?:{_OPEN})*+{_ENDED})*+"
_NUMBERS = (*NUMBER.split("|"), "hundred", "thousand", "million", "billion")


def rule_mentions(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Array of mentions of all rules, in rule order."""
    def of_rule(rule: Rule, seq: int) -> Column:
        fixed = {"layer": rule.layer, "rule_seq": seq, "rule": rule.name, "type": rule.kind, "sensitivity": rule.sensitivity}
        columns = [F.lit(v).alias(k) for k, v in fixed.items()]
        return F.transform(matches(text, rule), lambda m, i: F.struct(*columns, i.alias("ord"), m["surface"].alias("surface"), m["core"].alias("core")))

    parts = [of_rule(r, k) for k, r in enumerate(rules)]
    return F.concat(*parts)


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, layer, rule_seq, rule, ord, surface, core, type, sensitivity; null texts have none.

    Safe domains, short firms, and roles that nothing makes sensitive are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), body.alias("_text"), is_sensitive(body).alias("_sensitive"), F.explode(rule_mentions(body, rules)).alias("m"))
    ahead = F.expr("substring(_text, instr(_text, m.surface) + length(m.surface), 50)")
    role_ok = ~has_public_company(ahead) & (F.col("_sensitive") | role_is_specific(F.col("m.surface")))
    kept = (
        F.when(F.col("m.rule") == "url", ~is_safe_domain(F.col("m.surface")))
        .when(F.col("m.rule") == "role", role_ok)
        .when(F.col("m.rule") == "investment_firm", (F.length("m.surface") > 3) & ~one_of(F.upper("m.surface"), WHITELIST))
        .otherwise(F.length("m.surface") >= 2)
    )
    return rows.filter(kept).select(F.col("_key").alias(key), "m.*")


def numbered(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first mention of each value of a document, with its token: numbers run per type in order of detection."""
    order = ["rule_seq", "ord", "surface"]
    value = dedup_key(F.col("core"))
    first = F.row_number().over(Window.partitionBy(key, value).orderBy(*order))
    once = found.withColumn("_first", first).filter("_first = 1").drop("_first")
    n = F.row_number().over(Window.partitionBy(key, "type").orderBy(*order))
    return once.withColumn("n", n).withColumn("token", F.concat(F.lit("["), "type", F.lit("_"), n.cast("string"), F.lit("]")))


def gazetteer(docs: DataFrame, orgs: tuple[str, ...] = ORGS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, org, n: organisations of a list that a text names as whole words, in any case."""
    pattern = "(?iU)\\b(?:" + "|".join(sorted(map(quoted, orgs), key=len, reverse=True)) + ")\\b"
    names = F.create_map(*[F.lit(x) for o in orgs for x in (o.lower(), o)])
    found = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("surface"))
    return found.groupBy(key, F.try_element_at(names, F.lower("surface")).alias("org")).agg(F.count("*").alias("n"))


def context_words(text: Column) -> Column:
    """Array of {pos, word}: capitalised words of four letters or more with a company word within three places.

    Out are currencies, words with more digits than half, listed and common words, first names and words that are no
    organisation. Arrays, not a window over exploded words: nothing is shuffled.
    """
    words = F.split(text, "\\s+")
    low = F.transform(words, F.lower)
    context = F.array(*[F.lit(c) for c in ORG_CONTEXT])
    clean = F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.regexp_replace(w, "[.,;:!?]+$", "").alias("word")))

    def fine(x: Column) -> Column:
        w, near = x["word"], F.slice(low, F.greatest(x["pos"] - 2, F.lit(1)), F.least(x["pos"], F.lit(3)) + 4)
        digits = F.length(w) - F.length(F.translate(w, "0123456789", ""))
        out = one_of(F.upper(w), WHITELIST) | one_of(F.lower(w), (*COMMON_WORDS, *NOT_ORGS)) | one_of(w, FIRST_NAMES) | w.rlike("^[A-Z]{0,3}[$€£]?\\d") | (digits * 2 > F.length(w))
        return w.rlike("^[A-Z]") & (F.length(w) >= 4) & ~out & F.arrays_overlap(near, context)

    any_context = text.rlike("(?i)(?<![a-z])(?:" + "|".join(ORG_CONTEXT) + ")(?![a-z])")
    return F.when(any_context, F.filter(clean, fine)).otherwise(F.array().cast("array<struct<pos:int,word:string>>"))


def contextual_orgs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, word of the context_words() of each text."""
    return docs.select(key, F.inline(context_words(F.coalesce(F.col(text), F.lit("")))))


def valid_name(value: Column, kind: Column) -> Column:
    """Is a run of capitalised words a person or an organisation? See the order of tests below."""
    lower, words = F.lower(value), F.split(value, "\\s+")
    single = ~F.contains(value, F.lit(" "))
    first = F.lower(F.get(words, F.lit(0)))
    known = F.exists(words, lambda w: one_of(w, FIRST_NAMES))
    rejected = [
        value.rlike("\\w+['’][a-z]"),
        value.rlike("^SPEAKER_?S?\\d+"),
        value.rlike("[\\r\\n]"),
        ~single & one_of(first, DETERMINERS),
        ~single & (kind == "PERSON") & one_of(first, COMMON_WORDS),
        single & (kind == "ORG") & (F.length(value) < 4),
        (kind == "PERSON") & (F.length(value) <= 4) & value.rlike("^[A-Z]+$"),
        single & one_of(lower, COMMON_WORDS),
        single & lower.endswith("ing") & (F.length(value) > 4),
        single & one_of(lower, NATIONALITIES),
        single & one_of(lower, _NUMBERS),
        (kind == "ORG") & one_of(lower, (*GENERIC_ORGS, *NOT_ORGS)),
        (kind == "ORG") & single & value.rlike("^[a-z]"),
        (kind == "PERSON") & one_of(lower, NOT_NAMES),
        one_of(F.upper(value), WHITELIST),
        (kind == "PERSON") & ~known,
    ]
    return ~reduce(lambda a, b: a | b, rejected)


def heuristic_names(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, value, type, n: runs of capitalised words that pass as persons or organisations."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?U)" + _CAPITALS), F.lit(0))
    found = docs.select(key, F.explode(runs).alias("value"))
    org = F.exists(F.split("value", "\\s+"), lambda w: one_of(w, ORG_WORDS))
    typed = found.withColumn("type", F.when(org, "ORG").otherwise("PERSON"))
    return typed.filter(valid_name(F.col("value"), F.col("type"))).groupBy(key, "value", "type").agg(F.count("*").alias("n"))


def stats(found: DataFrame, key: str = "doc_id", types: tuple[str, ...] = ("PERSON", "ORG", "EMAIL", "PHONE", "AMOUNT", "DATE", "ADDRESS", "GOVID", "BANKACCT", "CARD", "IPADDR", "ROLE", "SITUATION", "TEMPORAL")) -> DataFrame:
    """A count column for each type (lower case), and total."""
    return found.groupBy(key).agg(*[F.count_if(F.col("type") == t).alias(t.lower()) for t in types], F.count("*").alias("total"))
