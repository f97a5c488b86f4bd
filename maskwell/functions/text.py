"""Column functions over texts and token maps; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import PHANTOMS, PUBLIC_COMPANIES, SAFE_DOMAINS
from .rules import BY_NAME, Rule

TOKEN = "\\[[A-Z]+_\\d+\\]"
#: One entry of a token map, in order of detection.
ENTRY = "struct<token:string,type:string,original_value:string,phantom_value:string,sensitivity:string,source:string>"


def dedup_key(value: Column) -> Column:
    """What makes two surfaces one value: lower case, without trailing punctuation."""
    return F.lower(F.regexp_replace(value, "[.,;:!?]+$", ""))


#: What a letter, digit or mark next to a value would make part of its word.
WORD_CHAR = "[\\p{L}\\p{N}\\p{M}_]"


def quoted(value: str) -> str:
    """A pattern, in any engine, that matches a value alone."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in value)


def one_of(value: Column, words: tuple[str, ...]) -> Column:
    """Is a value one of the words? One pattern, where isin() would send each word to the JVM by itself."""
    return value.rlike("^(?:" + "|".join(map(quoted, words)) + ")$") & ~value.endswith("\n")


def may_match(text: Column, rule: Rule, low: Column | None = None) -> Column:
    """A cheap test that a text can match: does it hold a character and a part that the rule needs? low: text in lower case."""
    tests = [F.length(F.translate(text, rule.needs, "")) < F.length(text)] if rule.needs else []
    if rule.parts:
        tests.append(reduce(lambda a, b: a | b, [F.contains(F.lower(text) if low is None else low, F.lit(p)) for p in rule.parts]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def matches(text: Column, rule: Rule, may: Column | None = None) -> Column:
    """Array of {surface, core} of a rule's matches in order; empty without a match. may: a cheap test made before."""
    found = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    if rule.core:
        cores = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.core))
        pairs = F.zip_with(found, cores, lambda a, b: F.struct(F.trim(a).alias("surface"), b.alias("core")))
    else:
        pairs = F.transform(found, lambda a: F.struct(F.trim(a).alias("surface"), F.trim(a).alias("core")))
    empty = F.array().cast("array<struct<surface:string,core:string>>")
    return F.when(may_match(text, rule) if may is None else may, pairs).otherwise(empty)


def replace_value(text: Column, value: Column, token: Column, edges: tuple[bool, bool], first: bool = False) -> Column:
    """text with every occurrence of value in any case as token, at edges of words alone where so given.

    first: the first occurrence alone, in its own case.
    """
    edge = lambda side, sign: F.when(value.rlike(f"(?U){sign[0]}{WORD_CHAR}{sign[1]}"), F.lit(side)).otherwise("")
    left = edge(f"(?<!{WORD_CHAR})", ("^", "")) if edges[0] else F.lit("")
    right = edge(f"(?!{WORD_CHAR})", ("", "$")) if edges[1] else F.lit("")
    plain = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    if first:
        return F.regexp_replace(text, F.concat(F.lit("(?s)^(.*?)"), left, plain, right), F.concat(F.lit("$1"), token))
    return F.regexp_replace(text, F.concat(left, F.lit("(?iu:"), plain, F.lit(")"), right), token)


def domain(url: Column) -> Column:
    """Host of a URL as written: no scheme, no www, lower case, up to the first slash."""
    return F.lower(F.regexp_extract(F.regexp_replace(url, "(?i)^(?:https?://)?(?:www\\.)?", ""), "^[^/]*", 0))


def is_safe_domain(url: Column) -> Column:
    return domain(url).isin(*SAFE_DOMAINS)


def has_public_company(ahead: Column, companies: tuple[str, ...] = PUBLIC_COMPANIES) -> Column:
    return F.exists(F.array(*[F.lit(c.lower()) for c in companies]).cast("array<string>"), lambda c: F.contains(F.lower(ahead), c))


def role_is_specific(role: Column) -> Column:
    return F.lower(role).startswith("the ") | F.contains(F.lower(role), F.lit(" of "))


def is_sensitive(text: Column) -> Column:
    tests = [may_match(text, r) & text.rlike(r.java) for r in (BY_NAME["situation"], BY_NAME["temporal"])]
    return tests[0] | tests[1]


def _longest_first(entries: Column, field: str) -> Column:
    return F.array_sort(entries, lambda a, b: F.length(b[field]) - F.length(a[field]))


def _fold(text: Column, entries: Column, old: str, new: str) -> Column:
    return F.aggregate(_longest_first(entries, old), text, lambda t, e: F.when(F.length(e[old]) > 0, F.replace(t, e[old], e[new])).otherwise(t))


def rehydrate(text: Column, entries: Column, clean_orphans: bool = True) -> Column:
    """Tokens back to what they stand for; tokens that the map lacks become [redacted]."""
    restored = _fold(text, entries, "token", "original_value")
    return F.regexp_replace(restored, TOKEN, "[redacted]") if clean_orphans else restored


def phantom_text(text: Column, entries: Column) -> Column:
    return _fold(text, entries, "token", "phantom_value")


def reverse_phantom(text: Column, entries: Column) -> Column:
    return _fold(text, entries, "phantom_value", "original_value")


def apply_token_map(text: Column, entries: Column) -> Column:
    """Known values of another text, as whole words in any case, to their tokens, longest first."""
    known = F.filter(entries, lambda e: F.length(e["original_value"]) > 0)
    return F.aggregate(_longest_first(known, "original_value"), text, lambda t, e: replace_value(t, e["original_value"], e["token"], (True, True)))


def phantom_pools() -> Column:
    return F.create_map(*[x for k, v in PHANTOMS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])


def pick_phantom(kind: str, original: Column, used: Column) -> Column:
    """The first of a type's phantoms that isn't the value itself and isn't used in the document; else the first."""
    pool = F.array(*[F.lit(p) for p in PHANTOMS.get(kind, PHANTOMS["PERSON"])])
    free = F.filter(pool, lambda p: (p != original) & ~F.array_contains(used, p))
    return F.coalesce(F.get(free, F.lit(0)), F.get(pool, F.lit(0)))


_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_VALUES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_VALUES |= {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"oh": 0}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def digits_to_numeric(text: Column) -> Column:
    """Spoken digits to a number ("nine two oh" to "920"); other words are skipped; a text without any stays."""
    words = F.split(F.lower(text), "\\s+")
    joined = F.array_join(F.filter(F.transform(words, lambda w: F.try_element_at(_map(_DIGITS), w)), lambda d: d.isNotNull()), "")
    return F.when(joined != "", joined).otherwise(text)


def verbal_to_numeric(text: Column, currency: str = "$") -> Column:
    """Spoken amounts to figures: "twelve point five million dollars" to "$12.5M"; what can't be read stays."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "-", " ")), "\\s+"), lambda w: ~w.isin("", "and"))
    sign = F.coalesce(F.try_element_at(_map({"dollar": "$", "dollars": "$", "rand": "R", "rands": "R", "euro": "€", "euros": "€", "pound": "£", "pounds": "£"}), F.element_at(words, -1)), F.lit(currency))
    scale = F.get(F.filter(F.transform(words, lambda w: F.try_element_at(_map({"thousand": "K", "million": "M", "billion": "B"}), w)), lambda w: w.isNotNull()), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("d"), F.lit(False).alias("p"), F.lit(False).alias("seen"))
    value = lambda w: F.try_element_at(_map(_VALUES), w)

    def step(at: Column, w: Column) -> Column:
        made = lambda n, d, p, s: F.struct(n.alias("n"), d.alias("d"), p.alias("p"), s.alias("seen"))
        return (
            F.when(w == "point", made(at["n"], at["d"], F.lit(True), at["seen"]))
            .when(w == "hundred", made(F.greatest(at["n"], F.lit(1)) * 100, at["d"], at["p"], F.lit(True)))
            .when(value(w).isNotNull() & at["p"], made(at["n"], F.concat(at["d"], value(w).cast("string")), at["p"], F.lit(True)))
            .when(value(w).isNotNull(), made(at["n"] + value(w), at["d"], at["p"], F.lit(True)))
            .otherwise(at)
        )

    read = F.aggregate(words, start, step)
    number = F.concat(read["n"].cast("string"), F.when(read["d"] != "", F.concat(F.lit("."), read["d"])).otherwise(""))
    return F.when(read["seen"] & scale.isNotNull(), F.concat(sign, number, scale)).otherwise(text)


def context_core(value: Column) -> Column:
    """The number in a value with the words that lead to it ("account no 62847501234"); null where there is none."""
    core = F.regexp_extract(value, "(?iU)^(?:account|passport|licen[cs]e)[a-z\\s#.:]*?\\b([A-Z]?\\d[\\w -]*)$", 1)
    return F.when(core != "", core)


def highlight(text: Column, entries: Column) -> Column:
    """HTML of a text in which the values of a token map are marked with their types; all else is escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = lambda e: F.concat(F.lit('<mark class="'), F.lower(e["type"]), F.lit('">'), escape(e["original_value"]), F.lit("</mark>"))
    return F.aggregate(_longest_first(entries, "token"), escape(apply_token_map(text, entries)), lambda t, e: F.replace(t, e["token"], marked(e)))


def tokens_in(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
