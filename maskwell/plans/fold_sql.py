"""Redaction in SQL for DuckDB: a recursive query that takes one mention, or one step, in each round of a text.

RE2 has no lookaround and its word boundaries are those of ASCII. Patterns with boundaries so run over texts in which
letters beyond ASCII are written as underscores, one for one; edges of values are tested by the characters around them.
"""

from __future__ import annotations

from ..config import RedactConfig
from ..functions import lexicon as L
from ..functions.rules import BY_NAME, NUMBER, Rule

#: Non-ASCII letters, digits and marks.
_WIDE = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}]"
_CHAR = r"\p{L}\p{N}\p{M}_"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def narrow(text: str) -> str:
    """A text in which RE2 finds the word boundaries that Java finds in the original."""
    return f"regexp_replace({text}, {quote(_WIDE)}, '_', 'g')"


def pattern(rule: Rule) -> tuple[str, str, bool]:
    """A rule's pattern for RE2, words that a match may not begin with, and whether it runs over narrow()."""
    made, out = rule.re2, ""
    if "(?!" in made:
        start, end = made.index("(?!"), made.index(r"\s+at\b)") + len(r"\s+at\b)")
        out = "(?i)^" + made[start + 3 : end - 1]
        made = (made[:start] + made[end:]).replace("(?!@)", "")
    plain = rule.name in ("email", "url", "spoken_email", "hybrid_email")
    if rule.name == "url":
        made = made.replace(r"[\w.-]", f"[{_CHAR}.-]").replace(r"[\w./", f"[{_CHAR}./")
    return made, out, not plain


def found(rule: Rule, text: str, core: bool = False) -> str:
    """The list of a rule's matches in a text."""
    made, out, narrowed = pattern(rule)
    matches = f"regexp_extract_all({narrow(text) if narrowed else text}, {quote(made)}, {rule.core if core else 0})"
    return f"list_filter({matches}, lambda x: NOT regexp_matches(x, {quote(out)}))" if out else matches


def _list(words) -> str:
    return "[" + ", ".join(map(quote, words)) + "]"


def valid_name(v: str, kind: str) -> str:
    words = f"string_split_regex({v}, '\\s+')"
    one = f"NOT contains({v}, ' ')"
    first = f"lower({words}[1])"
    numbers = (*NUMBER.split("|"), "hundred", "thousand", "million", "billion")
    bad = [
        f"regexp_matches({v}, {quote(chr(92) + 'w+[' + chr(39) + '’][a-z]')})", f"regexp_matches({v}, '^SPEAKER_?S?\\d+')", f"regexp_matches({v}, '[\\r\\n]')",
        f"contains({v}, ' ') AND list_contains({_list(L.DETERMINERS)}, {first})", f"contains({v}, ' ') AND {kind} = 'PERSON' AND list_contains({_list(L.COMMON_WORDS)}, {first})",
        f"{one} AND {kind} = 'ORG' AND length({v}) < 4", f"{kind} = 'PERSON' AND length({v}) <= 4 AND regexp_full_match({v}, '[A-Z]+')",
        f"{one} AND list_contains({_list(L.COMMON_WORDS)}, lower({v}))", f"{one} AND lower({v}) LIKE '%ing' AND length({v}) > 4",
        f"{one} AND list_contains({_list((*L.NATIONALITIES, *numbers))}, lower({v}))", f"{kind} = 'ORG' AND list_contains({_list((*L.GENERIC_ORGS, *L.NOT_ORGS))}, lower({v}))",
        f"{kind} = 'PERSON' AND list_contains({_list(L.NOT_NAMES)}, lower({v}))", f"list_contains({_list(L.WHITELIST)}, upper({v}))",
        f"{kind} = 'PERSON' AND NOT list_has_any({words}, {_list(L.FIRST_NAMES)})",
    ]
    return "NOT (" + " OR ".join(f"({b})" for b in bad) + ")"


def name_runs(text: str) -> str:
    """Lists of {v, k}: valid runs of capitalised words, once each, in order of place."""
    runs = f"regexp_extract_all({narrow(text)}, {quote(chr(92) + 'b[A-Z][a-zA-Z' + chr(39) + '-]{2,}(?:' + chr(92) + 's+[A-Z][a-zA-Z' + chr(39) + '-]{2,})*' + chr(92) + 'b')})"
    kind = f"CASE WHEN list_has_any(string_split_regex(v, '\\s+'), {_list(L.ORG_WORDS)}) THEN 'ORG' ELSE 'PERSON' END"
    return f"list_filter(list_transform({runs}, lambda v: {{'v': v, 'k': {kind}}}), lambda x: {valid_name('x.v', 'x.k')})"


def context_words(text: str) -> str:
    """Lists of {pos, word} of capitalised words near company words."""
    clean = "regexp_replace(w[i], '[.,;:!?]+$', '')"
    near = "list_transform(w[greatest(i - 3, 1):i + 3], lambda y: lower(y))"
    bad = [
        f"list_contains({_list(L.WHITELIST)}, upper(x.word))", f"list_contains({_list((*L.COMMON_WORDS, *L.NOT_ORGS))}, lower(x.word))", f"list_contains({_list(L.FIRST_NAMES)}, x.word)",
        "regexp_matches(x.word, '^[A-Z]{0,3}[$€£]?\\d')", "length(regexp_replace(x.word, '[^0-9]', '', 'g')) * 2 > length(x.word)",
    ]
    fine = f"regexp_matches(x.word, '^[A-Z]') AND length(x.word) >= 4 AND x.near AND NOT ({' OR '.join(bad)})"
    each = f"list_transform(range(1, len(w) + 1), lambda i: {{'pos': i - 1, 'word': {clean}, 'near': list_has_any({near}, {_list(L.ORG_CONTEXT)})}})"
    return f"list_filter(list_transform([string_split_regex({text}, '\\s+')], lambda w: {each})[1], lambda x: {fine})"


def _queue(matches: str, kind: str, core: str | None = None) -> str:
    if core:
        return f"list_transform(list_zip({matches}, {core}), lambda p: {{'s': trim(p[1]), 'c': p[2], 'k': {quote(kind)}}})"
    return f"list_transform({matches}, lambda p: {{'s': trim(p), 'c': trim(p), 'k': {quote(kind)}}})"


def _steps(config: RedactConfig) -> list[tuple[str, tuple[bool, bool], str]]:
    """Queue, edges and test of each step, in order."""
    host = "regexp_extract(regexp_replace(lower(queue[1].s), '^(?:https?://)?(?:www\\.)?', ''), '^[^/]*')"
    ahead = "lower(substr(txt, instr(txt, queue[1].s) + length(queue[1].s), 50))"
    public = " OR ".join(f"contains({ahead}, {quote(c.lower())})" for c in config.public_companies)
    tests = {
        "url": f"NOT list_contains({_list(L.SAFE_DOMAINS)}, {host})",
        "role": f"NOT ({public}) AND (sensitive OR starts_with(lower(queue[1].s), 'the ') OR contains(lower(queue[1].s), ' of '))",
        "investment_firm": f"length(queue[1].s) > 3 AND NOT list_contains({_list(L.WHITELIST)}, upper(queue[1].s))",
    }
    of = lambda r: (_queue(found(r, "txt"), r.kind, found(r, "txt", True) if r.core else None), r.edges, tests.get(r.name, "true"))
    both, steps = (True, True), [of(r) for r in config.rules if r.name == "email"]
    if config.orgs:
        orgs = "(?i)\\b(?:" + "|".join(sorted(config.orgs, key=len, reverse=True)) + ")\\b"
        steps.append((_queue(f"regexp_extract_all({narrow('txt')}, {quote(orgs)})", "ORG"), both, "true"))
    steps += [of(r) for r in config.rules if r.layer == "L1b"]
    if config.gazetteer:
        steps.append((_queue(f"list_transform({context_words('txt')}, lambda x: x.word)", "ORG"), both, "true"))
    steps += [of(r) for r in config.rules if r.layer == "L1.5"]
    if config.names:
        placed = f"list_transform({name_runs('txt')}, lambda x, i: {{'l': -length(x.v), 'i': i, 'v': x.v, 'k': x.k}})"
        steps.append((f"list_transform(list_sort({placed}), lambda x: {{'s': x.v, 'c': x.v, 'k': x.k}})", both, "true"))
    return steps + [of(r) for r in config.rules if r.layer not in ("L1b", "L1.5") and r.name != "email"]


def redact_sql(texts: str, config: RedactConfig, columns: str = "id AS doc_id, sanitized, n_tokens") -> str:
    """columns of id, sanitized, entries, n_tokens of the texts (id, txt) of a query."""
    steps = _steps(config)
    value = "queue[1].c" if config.occurrence == "all" else "queue[1].s"
    number = "(len(list_filter(entries, lambda e: e.type = queue[1].k)) + 1)"
    token = f"('[' || queue[1].k || '_' || {number} || ']')"
    key = lambda v: f"lower(regexp_replace({v}, '[.,;:!?]+$', ''))"
    fold = "(?i)" if config.occurrence == "all" else ""
    left = f"CASE WHEN le AND regexp_matches({value}, '^[{_CHAR}]') THEN '(^|[^{_CHAR}])' ELSE '()' END"
    right = f"CASE WHEN re AND regexp_matches({value}, '[{_CHAR}]$') THEN '($|[^{_CHAR}])' ELSE '()' END"
    whole = f"'{fold}' || {left} || regexp_escape({value}) || {right}"
    once = f"regexp_replace(txt, {whole}, '\\1' || {token} || '\\2'" + (", 'g')" if config.occurrence == "all" else ")")
    changed = f"regexp_replace({once}, {whole}, '\\1' || {token} || '\\2', 'g')" if config.occurrence == "all" else once
    pools = " ".join(f"WHEN {quote(k)} THEN {_list(v)}" for k, v in L.PHANTOMS.items())
    pool = f"CASE queue[1].k {pools} END"
    used = "list_transform(entries, lambda e: e.phantom)"
    phantom = f"coalesce(list_filter({pool}, lambda p: p <> queue[1].c AND NOT list_contains({used}, p))[1], ({pool})[1])"
    new = f"length(queue[1].s) >= 2 AND NOT list_has_any(seen, [{key('queue[1].s')}, {key('queue[1].c')}]) AND (CASE step {' '.join(f'WHEN {i} THEN {t}' for i, (_, _, t) in enumerate(steps, 1) if t != 'true')} ELSE true END)"
    if all(t == "true" for _, _, t in steps):
        new = new[: new.index(" AND (CASE step")]
    queues = " ".join(f"WHEN {i} THEN {q}" for i, (q, _, _) in enumerate(steps, 1))
    edges = [" ".join(f"WHEN {i} THEN {str(e[side]).lower()}" for i, (_, e, _) in enumerate(steps, 1)) for side in (0, 1)]
    sensitive = " OR ".join(f"len({found(BY_NAME[n], 'txt')}) > 0" for n in ("situation", "temporal"))
    empty_queue = "CAST([] AS STRUCT(s VARCHAR, c VARCHAR, k VARCHAR)[])"
    sanitized = "txt"
    if config.mode == "phantom":
        by_length = "list_sort(list_transform(entries, lambda e, i: {'l': -length(e.token), 'i': i, 't': e.token, 'p': e.phantom}))"
        sanitized = f"list_reduce([txt] || list_transform({by_length}, lambda x: x.t || chr(1) || x.p), lambda a, x: replace(a, string_split(x, chr(1))[1], string_split(x, chr(1))[2]))"
    return f"""
WITH RECURSIVE st AS (
  SELECT id, txt, CAST([] AS STRUCT(token VARCHAR, type VARCHAR, value VARCHAR, phantom VARCHAR)[]) AS entries, CAST([] AS VARCHAR[]) AS seen, 0 AS step, {empty_queue} AS queue,
         ({sensitive}) AS sensitive
  FROM (SELECT id, coalesce(txt, '') AS txt FROM ({texts}))
  UNION ALL
  SELECT id, CASE WHEN hit THEN after ELSE txt END, CASE WHEN hit THEN list_append(entries, entry) ELSE entries END, CASE WHEN hit THEN list_concat(seen, keys) ELSE seen END,
         CASE WHEN len(queue) > 0 THEN step ELSE step + 1 END,
         CASE WHEN len(queue) > 0 THEN queue[2:] ELSE CASE step + 1 {queues} ELSE {empty_queue} END END, sensitive
  FROM (
    SELECT *, coalesce(len(queue) > 0 AND ok AND after <> txt, false) AS hit FROM (
      SELECT *, CASE WHEN ok THEN {changed} END AS after, CASE WHEN ok THEN {{'token': {token}, 'type': queue[1].k, 'value': queue[1].c, 'phantom': {phantom}}} END AS entry,
             [{key('queue[1].s')}, {key('queue[1].c')}] AS keys
      FROM (SELECT *, CASE step {edges[0]} ELSE false END AS le, CASE step {edges[1]} ELSE false END AS re, len(queue) > 0 AND coalesce({new}, false) AS ok FROM st)
    )
  ) WHERE len(queue) > 0 OR step < {len(steps)}
)
SELECT {columns} FROM (SELECT id, {sanitized} AS sanitized, entries, CAST(len(entries) AS BIGINT) AS n_tokens FROM st WHERE step = {len(steps)} AND len(queue) = 0)
"""


def apply_sql(text: str, pairs: str) -> str:
    """text with the values of pairs (a list of {v, t}) as whole words in any case by their tokens, longest first."""
    placed = f"list_sort(list_transform({pairs}, lambda e, i: {{'l': -length(e.v), 'i': i, 'v': e.v, 't': e.t}}))"
    v, t = "string_split(x, chr(1))[1]", "string_split(x, chr(1))[2]"
    left = f"CASE WHEN regexp_matches({v}, '^[{_CHAR}]') THEN '(^|[^{_CHAR}])' ELSE '()' END"
    right = f"CASE WHEN regexp_matches({v}, '[{_CHAR}]$') THEN '($|[^{_CHAR}])' ELSE '()' END"
    whole = f"'(?i)' || {left} || regexp_escape({v}) || {right}"
    once = f"regexp_replace(a, {whole}, '\\1' || {t} || '\\2', 'g')"
    twice = f"regexp_replace({once}, {whole}, '\\1' || {t} || '\\2', 'g')"
    return f"list_reduce([{text}] || list_transform({placed}, lambda x: x.v || chr(1) || x.t), lambda a, x: {twice})"


def restore_sql(text: str, pairs: str) -> str:
    """text with tokens of pairs (a list of {v, t}) by their values, the longest token first."""
    placed = f"list_sort(list_transform({pairs}, lambda e, i: {{'l': -length(e.t), 'i': i, 'v': e.v, 't': e.t}}))"
    return f"list_reduce([{text}] || list_transform({placed}, lambda x: x.t || chr(1) || x.v), lambda a, x: replace(a, string_split(x, chr(1))[1], string_split(x, chr(1))[2]))"
