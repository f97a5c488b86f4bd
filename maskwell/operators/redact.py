"""Tier B: redaction as an ordered fold inside each row. No shuffle, no Python: one state column, a step for each rule.

Steps are SQL expressions, so a plan of forty of them is built with as many calls to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RedactConfig
from ..functions.lexicon import ORG_WORDS, PHANTOMS, SAFE_DOMAINS, WHITELIST
from ..functions.rules import BY_NAME, INSIDE, Rule
from ..functions.text import ENTRY, TOKEN, WORD_CHAR, may_match, phantom_text, quoted, rehydrate
from .mentions import _CAPITALS, context_words, valid_name
from .ner import post_filter

_MAP = f"array<{ENTRY}>"
_KINDED = "array<struct<surface:string,core:string,kind:string>>"
#: Kinds that entities of a recogniser have.
ENTITY_KINDS = ("PERSON", "ORG", "EMAIL", "PHONE", "AMOUNT", "DATE", "ADDRESS", "GOVID", "BANKACCT", "CARD", "IPADDR")
TYPES = (*ENTITY_KINDS, "ROLE", "SITUATION", "TEMPORAL")


def _lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values) -> str:
    return f"array({', '.join(map(_lit, values))})"


def _replaced(value: str, edges: tuple[bool, bool], first: bool) -> str:
    """As functions.text.replace_value(), of s.text and token."""
    sides = [
        f"CASE WHEN {value} RLIKE {_lit(f'(?U){at}{WORD_CHAR}{end}')} THEN {_lit(f'(?{look}{WORD_CHAR})')} ELSE '' END" if edge else "''"
        for edge, at, end, look in zip(edges, ("^", ""), ("", "$"), ("<!", "!"), strict=True)
    ]
    plain = f"concat({_lit(chr(92) + 'Q')}, replace({value}, {_lit(chr(92) + 'E')}, {_lit(r'\E\\E\Q')}), {_lit(chr(92) + 'E')})"
    if first:
        return f"regexp_replace(s.text, concat('(?s)^(.*?)', {sides[0]}, {plain}, {sides[1]}), concat('$1', token))"
    return f"regexp_replace(s.text, concat({sides[0]}, '(?iu:', {plain}, ')', {sides[1]}), token)"


def _key(value: str) -> str:
    return f"lower(regexp_replace({value}, '[.,;:!?]+$', ''))"


def _accept(kinds: tuple[str, ...], sensitivity: str, source: str, edges: tuple[bool, bool], occurrence: str, fine: str) -> str:
    """The state s after a mention m: its value gets the next token of its type unless it is known, gone or not fine.

    m: surface, core and, where kinds are several, kind.
    """
    kind = _lit(kinds[0]) if len(kinds) == 1 else "m.kind"
    pools = [_array(PHANTOMS[k]) for k in kinds]
    pool = pools[0] if len(kinds) == 1 else "CASE " + " ".join(f"WHEN m.kind = {_lit(k)} THEN {p}" for k, p in zip(kinds, pools, strict=True)) + " END"
    token = f"concat('[', {kind}, '_', size(filter(s.entries, e -> e.type = {kind})) + 1, ']')"
    # the value alone, so that the words that led to it come back with it
    changed = _replaced("m.core" if occurrence == "all" else "m.surface", edges, occurrence != "all")
    free = "filter(pool, p -> p <> m.core AND NOT array_contains(transform(s.entries, e -> e.phantom_value), p))"
    phantom = f"get(transform(array({pool}), pool -> coalesce(get({free}, 0), get(pool, 0))), 0)"
    entry = f"named_struct('token', token, 'type', {kind}, 'original_value', m.core, 'phantom_value', {phantom}, 'sensitivity', {_lit(sensitivity)}, 'source', {_lit(source)})"
    keys = f"array({_key('m.surface')}, {_key('m.core')})"
    done = f"named_struct('text', changed, 'entries', array_append(s.entries, {entry}), 'seen', concat(s.seen, {keys}))"
    after = f"get(transform(array({changed}), changed -> CASE WHEN changed <> s.text THEN {done} ELSE s END), 0)"
    return (
        f"CASE WHEN length(m.surface) >= 2 AND NOT arrays_overlap(s.seen, {keys}) AND {fine} "
        f"THEN get(transform(array({token}), token -> {after}), 0) ELSE s END"
    )


def _fine(rule: Rule, config: RedactConfig) -> str:
    if rule.name == "url":
        host = f"lower(regexp_extract(regexp_replace(m.surface, {_lit('(?i)^(?:https?://)?(?:www' + chr(92) + '.)?')}, ''), '^[^/]*', 0))"
        return f"NOT array_contains({_array(SAFE_DOMAINS)}, {host})"
    if rule.name == "role":
        ahead = "lower(substring(s.text, instr(s.text, m.surface) + length(m.surface), 50))"
        public = f"exists(cast({_array(c.lower() for c in config.public_companies)} AS array<string>), c -> contains({ahead}, c))"
        return f"NOT {public} AND (_sensitive OR startswith(lower(m.surface), 'the ') OR contains(lower(m.surface), ' of '))"
    if rule.name == "investment_firm":
        return f"length(m.surface) > 3 AND NOT array_contains({_array(WHITELIST)}, upper(m.surface))"
    return "true"


def _found(rule: Rule) -> str:
    """As functions.text.matches(), of the state's text."""
    pattern = _lit(rule.java)
    if rule.core:
        pairs = f"zip_with(regexp_extract_all(_s.text, {pattern}, 0), regexp_extract_all(_s.text, {pattern}, {rule.core}), (a, b) -> named_struct('surface', trim(a), 'core', b))"
    else:
        pairs = f"transform(regexp_extract_all(_s.text, {pattern}, 0), a -> named_struct('surface', trim(a), 'core', trim(a)))"
    gate = f" AND _s.text RLIKE {_lit(rule.gate)}" if rule.gate else ""
    return f"CASE WHEN _may.{rule.name}{gate} THEN {pairs} ELSE cast(array() AS array<struct<surface:string,core:string>>) END"


def _plain(values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(x.alias("surface"), x.alias("core")))


def redact(docs: DataFrame, config: RedactConfig | None = None, key: str = "doc_id", text: str = "text", entities: DataFrame | None = None) -> DataFrame:
    """key, sanitized, token_map (in order of detection), stats (a count for each type, and total), n_tokens.

    Layers in order: e-mail addresses, so that no name is cut out of them; entities of a recogniser (key, ord, type,
    value, confidence), if given; listed organisations, institutions and firms, words near company words; spoken
    addresses and account numbers; names; patterns; domains; context. Each step sees the text as earlier steps left it,
    so tokens are never matched again. A value is replaced in every case that it is written in, and where its rule or
    list says so only as a whole word: no word is cut. Null texts are empty; null keys and repeated rows are redacted
    each by itself (entities go to all rows of their key).
    """
    config = config or RedactConfig()
    body = F.coalesce(F.col(text), F.lit(""))
    rules = config.rules
    df = docs.select(F.col(key).alias("_key"), body.alias("_text"))
    if entities is not None:
        named = post_filter(entities.withColumnRenamed(key, "doc_id"), config.org_confidence, config.confidence)
        found = F.array_sort(F.collect_list(F.struct("ord", F.col("value").alias("surface"), F.col("type").alias("kind"))))
        of_key = named.groupBy(F.col("doc_id").alias("_key")).agg(F.transform(found, lambda e: F.struct(e["surface"].alias("surface"), e["surface"].alias("core"), e["kind"].alias("kind"))).alias("_entities"))
        df = df.join(of_key, "_key", "left").withColumn("_entities", F.coalesce("_entities", F.array().cast(_KINDED)))
    # What a rule needs to match is there from the start, or never: redaction only takes away. One pass in lower case.
    df = df.withColumn("_low", F.lower("_text"))
    needs = sorted({r.needs for r in rules if r.needs})
    has = ", ".join(f"'n{i}', _text RLIKE {_lit('[' + n + ']')}" for i, n in enumerate(needs))
    df = df.withColumn("_has", F.expr(f"named_struct('a', true{', ' + has if has else ''})"))

    def may(rule: Rule) -> str:
        tests = [f"_has.n{needs.index(rule.needs)}"] if rule.needs else []
        if rule.parts:
            tests.append("(" + " OR ".join(f"contains(_low, {_lit(p)})" for p in rule.parts) + ")")
        return " AND ".join(tests) or "true"

    df = df.withColumn("_may", F.expr(f"named_struct('a', true, {', '.join(f'{_lit(r.name)}, {may(r)}' for r in rules)})" if rules else "named_struct('a', true)"))
    sensitive = [may_match(F.col("_text"), r, F.col("_low")) & F.col("_text").rlike(r.java) for r in (BY_NAME["situation"], BY_NAME["temporal"])]
    start = F.struct(F.col("_text").alias("text"), F.array().cast(_MAP).alias("entries"), F.array().cast("array<string>").alias("seen"))
    df = df.withColumn("_sensitive", sensitive[0] | sensitive[1]).withColumn("_s", start)

    def step(df: DataFrame, found: str, *how, fine: str = "true") -> DataFrame:
        return df.withColumn("_s", F.expr(f"aggregate({found}, _s, (s, m) -> {_accept(*how, config.occurrence, fine)})"))

    def apply(df: DataFrame, rule: Rule) -> DataFrame:
        source = {"L1b": "Gazetteer", "L5": "Context"}.get(rule.layer, "Regex")
        return step(df, _found(rule), (rule.kind,), rule.sensitivity, source, rule.edges, fine=_fine(rule, config))

    words = (True, True)
    listed = f"NOT array_contains({_array(w.upper() for w in config.extra_whitelist)}, upper(m.surface))" if config.extra_whitelist else "true"
    for rule in rules:
        if rule.name == "email":
            df = apply(df, rule)
    if entities is not None:
        df = step(df, "_entities", ENTITY_KINDS, "HIGH", "Model", words, fine=listed)
    if config.orgs:
        pattern = INSIDE + "(?iU)\\b(?:" + "|".join(sorted(map(quoted, config.orgs), key=len, reverse=True)) + ")\\b"
        found = f"transform(regexp_extract_all(_s.text, {_lit(pattern)}, 0), a -> named_struct('surface', a, 'core', a))"
        df = step(df, found, ("ORG",), "MEDIUM", "Gazetteer", words)
    for rule in rules:
        if rule.layer == "L1b":
            df = apply(df, rule)
    if config.gazetteer:
        df = df.withColumn("_words", _plain(F.transform(context_words(F.col("_s.text")), lambda x: x["word"])))
        df = step(df, "_words", ("ORG",), "MEDIUM", "Gazetteer", words, fine=listed)
    for rule in rules:
        if rule.layer == "L1.5":
            df = apply(df, rule)
    if config.names:
        runs = F.array_distinct(F.regexp_extract_all(F.col("_s.text"), F.lit("(?U)" + _CAPITALS), F.lit(0)))
        org = lambda v: F.when(v.rlike("(?U)(?<!\\S)(?:" + "|".join(ORG_WORDS) + ")(?!\\S)"), "ORG").otherwise("PERSON")
        kinded = F.transform(runs, lambda v: F.struct(v.alias("surface"), v.alias("core"), org(v).alias("kind")))
        names = F.filter(kinded, lambda x: valid_name(x["surface"], x["kind"]))
        # the longest first, so that a short name doesn't take part of a long one
        df = df.withColumn("_names", F.array_sort(names, lambda a, b: F.length(b["surface"]) - F.length(a["surface"])))
        df = step(df, "_names", ("PERSON", "ORG"), "MEDIUM", "Names", words, fine=listed)
    for rule in rules:
        if rule.layer not in ("L1b", "L1.5") and rule.name != "email":
            df = apply(df, rule)
    # A filter on the result stays above the fold: pushed down, it would hold a copy of all steps below for each use of
    # the state, twice as many at each step. Nothing is pushed through what isn't deterministic; filter docs before.
    df = df.withColumn("_s", F.expr("CASE WHEN monotonically_increasing_id() >= 0 THEN _s END"))
    sanitized = F.col("_s.text")
    if config.mode == "phantom":
        sanitized = phantom_text(sanitized, F.col("_s.entries"))
    elif config.mode == "redacted":
        sanitized = F.regexp_replace(sanitized, TOKEN, "[redacted]")
    of_type = ", ".join(f"'{t.lower()}', size(filter(_s.entries, e -> e.type = '{t}'))" for t in TYPES)
    stats = F.expr(f"named_struct({of_type}, 'total', size(_s.entries))")
    return df.select(F.col("_key").alias(key), sanitized.alias("sanitized"), F.col("_s.entries").alias("token_map"), stats.alias("stats"), F.size("_s.entries").cast("long").alias("n_tokens"))


def redact_rules(docs: DataFrame, rules: tuple[Rule, ...], occurrence: str = "all", key: str = "doc_id", text: str = "text") -> DataFrame:
    """As redact(), with the given rules alone."""

    class Some(RedactConfig):
        @property
        def rules(self):
            return rules

    return redact(docs, Some(gazetteer=False, names=False, occurrence=occurrence), key, text)


def wrap(docs: DataFrame, answer: Callable[[Column], Column], config: RedactConfig | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, masked, answer: answer() sees masked texts alone, and what it gives comes back with real values.

    answer: Column to Column, such as a pandas UDF that calls a model.
    """
    done = redact(docs, config, key, text).withColumn("_answer", answer(F.col("sanitized")))
    return done.select(key, F.col("sanitized").alias("masked"), rehydrate(F.col("_answer"), F.col("token_map")).alias("answer"))
