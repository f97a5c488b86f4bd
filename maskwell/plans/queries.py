"""One query for each operator over the driver's tables, and the same in SQL for DuckDB.

Detectors that no document trips read sentences built from keys, by the same expression in both engines. The three
phone detectors do so too, and read the documents in queries of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RedactConfig
from ..functions import text as T
from ..functions.lexicon import FIRST_NAMES, ORGS, PHANTOMS, SAFE_DOMAINS, WHITELIST
from ..functions.rules import BY_NAME
from ..operators import mentions as M
from ..operators import metrics, ner
from ..operators import sessions as S
from ..operators.redact import redact, redact_rules, wrap
from ..sources.tables import spread, token_rows
from ..sql import register
from ..streaming.sessions import windowed_counts
from . import fold_sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Sentences for each rule; {k} is a customer's number in four digits. The last one has no match.
SENTENCES = {
    "usd": ["pay ${k} now or $12.5M", "about $1,{k}.50 million left", "no money {k}"],
    "rand_prefix": ["salary R{k} and R1,500,000", "R {k} thousand", "none {k}"],
    "rand_suffix": ["it costs {k} rand today", "{k} million ZAR, 5 rands", "none {k}"],
    "bare_amount": ["sold {k} million units and 3 billion", "12.5 thousand {k}", "none {k}"],
    "verbal_amount": ["raised twelve point five million dollars in {k}", "two hundred and fifty thousand rand {k}", "none {k}"],
    "phone_intl": ["call +27 82 555 {k} now", "+1 22 333 {k} or +44225551234", "none {k}"],
    "phone_us": ["call 1-555-123-{k}", "+1 (415) 555-{k}.", "none {k}"],
    "phone_sa": ["cell 082-123-{k}", "0715551234 {k}", "none {k}"],
    "phone_local": ["office 011-555-{k}", "021 555 {k}", "none {k}"],
    "spoken_phone": ["plus two seven eight two five five five one {k}", "Plus one two three four five six seven", "none {k}"],
    "spoken_account": ["account number is one two three four five six seven eight {k}", "account nine nine nine nine nine nine nine nine nine", "none {k}"],
    "spoken_govid": ["ID number is nine four zero five one zero five eight zero zero eight {k}", "identity one two three four five six seven eight nine zero one two", "none {k}"],
    "ssn": ["ssn 123-45-{k}", "987 65 {k} given", "none {k}"],
    "sa_id": ["id 940510{k}086 given", "id 9405105800086", "none {k}"],
    "card": ["card 4532 1234 5678 {k}", "5500-0000-0000-{k}", "none {k}"],
    "iban": ["to GB29 NWBK 6016 1331 {k} 19", "DE89370400440532{k}00", "none {k}"],
    "passport": ["passport number is A0455{k}", "Passport: 12{k}7", "none {k}"],
    "license": ["driver's license number is D123{k}", "licence no 99{k}", "none {k}"],
    "bank_account": ["account number 12345{k}", "account 9988{k}77", "none {k}"],
    "date_month": ["due January 15th {k}", "on may 3 and June 22nd", "none {k}"],
    "date_numeric": ["on 03/20/2025 {k}", "1-2-24", "none {k}"],
    "spoken_date": ["meet march fifteenth twenty twenty six {k}", "July twenty-first", "none {k}"],
    "street": ["at 42 Rivonia Road {k}", "{k} North Main Street", "none {k}"],
    "institution": ["from Standard Bank and Goldman Sachs {k}", "absa {k}", "none {k}"],
    "investment_firm": ["met Alpha Capital {k}", "Blue River tech ventures", "none {k}"],
    "role": ["the CEO of Acme met {k}", "Senator spoke", "none {k}"],
    "situation": ["a pending acquisition {k}", "whistleblower and data breach", "none {k}"],
    "temporal": ["ahead of the earnings call {k}", "embargoed until noon", "none {k}"],
    "descriptor": ["the only engineer who {k}", "the patient with the rare condition", "none {k}"],
    "spoken_email": ["reach kai at blue lake dot com {k}", "write to info at shop dot io", "none {k}"],
    "hybrid_email": ["reach kai at hello.com {k}", "sam at example.org", "none {k}"],
}


def _sentence(templates: list[str]) -> str:
    """SQL for both engines: a sentence by customer."""
    k = "lpad(cast(c_custkey % 10000 as {S}), 4, '0')"
    made = []
    for t in templates:
        parts = ["'" + p.replace("'", "''") + "'" for p in t.split("{k}")]
        made.append(f"concat({f', {k}, '.join(parts)})")
    return f"case c_custkey % 3 when 0 then {made[0]} when 1 then {made[1]} else {made[2]} end"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sentences(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    made = _sentence(SENTENCES[name]).replace("{S}", "string")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(made).alias("text"))


def _sentences_sql(name: str) -> str:
    made = _sentence(SENTENCES[name]).replace("{S}", "varchar")
    return f"SELECT c_custkey AS doc_id, {made} AS text FROM customer"


def _detect(spark: SparkSession, sf_dir: str, rule: str, source: str | None = None) -> DataFrame:
    """All matches of one pattern: doc_id, ord, surface."""
    docs = _read(spark, sf_dir, source) if source else _sentences(spark, sf_dir, rule)
    found = docs.select("doc_id", F.posexplode(T.matches(F.col("text"), BY_NAME[rule])).alias("ord", "m"))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("m.surface").alias("surface"))


#: Rules that documents match too: their sentences keep detect_NAME, the whole table is detect_NAME_documents.
_PHONES = ("phone_us", "phone_sa", "phone_local")


def _detect_sql(rule: str, source: str | None = None) -> str:
    texts = f"SELECT doc_id, text FROM {source}" if source else _sentences_sql(rule)
    return f"""
SELECT doc_id, ord - 1 AS ord, trim(surface) AS surface FROM (
  SELECT doc_id, unnest(m) AS surface, unnest(generate_series(1, len(m))) AS ord
  FROM (SELECT doc_id, {Q.found(BY_NAME[rule], "text")} AS m FROM ({texts})) WHERE len(m) > 0
)"""


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


for _name in SENTENCES:
    QUERIES[f"detect_{_name}"] = partial(_detect, rule=_name)
    ORACLE[f"detect_{_name}"] = _detect_sql(_name)
for _name in ("email", "ipv4", "url"):
    QUERIES[f"detect_{_name}"] = partial(_detect, rule=_name, source="documents")
    ORACLE[f"detect_{_name}"] = _detect_sql(_name, "documents")

for _name in _PHONES:
    QUERIES[f"detect_{_name}_documents"] = partial(_detect, rule=_name, source="documents")
    ORACLE[f"detect_{_name}_documents"] = _detect_sql(_name, "documents")

_DOCS = "(SELECT doc_id, text FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


@query("scan_documents", "SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY lang")
def scan_documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_HOST = "lower(regexp_extract(regexp_replace(surface, '(?i)^(?:https?://)?(?:www\\.)?', ''), '^[^/]*'))"


@query("url_safe_domain_filter", f"SELECT {_HOST} AS host, count(*) AS n FROM ({_detect_sql('url', 'documents')}) WHERE {_HOST} NOT IN {SAFE_DOMAINS} GROUP BY 1")
def url_safe_domain_filter(spark, sf_dir):
    found = _detect(spark, sf_dir, "url", "documents").filter(~T.is_safe_domain(F.col("surface")))
    return found.groupBy(T.domain(F.col("surface")).alias("host")).agg(F.count("*").alias("n"))


_ORGS = ["we met {k} goldman sachs and McKinsey", "Deloitte, KPMG and Bain {k}", "none {k}"]
SENTENCES["orgs"] = _ORGS
SENTENCES["context"] = ["the company Zentriva grew {k} much faster than all others", "Plain Words {k} here are not near any such thing and Norvik acquired", "none {k}"]
SENTENCES["names"] = ["Sarah Chen met Acme Holdings {k}", "Michael Wong and The Swiss Board", "Xqzt Plomb {k}"]
SENTENCES["mixed"] = ["mail a{k}@b.co and call 082-123-{k} then a{k}@b.co again", "from 10.0.0.1 pay ${k} by 03/20/2025", "none {k}"]


@query(
    "gazetteer_org",
    f"""
WITH o AS (SELECT unnest({list(ORGS)}) AS org), t AS ({_sentences_sql("orgs")})
SELECT doc_id, org, CAST(len(regexp_extract_all(text, '(?i)\\b' || org || '\\b')) AS BIGINT) AS n FROM t, o WHERE regexp_matches(text, '(?i)\\b' || org || '\\b')""",
)
def gazetteer_org(spark, sf_dir):
    return M.gazetteer(_sentences(spark, sf_dir, "orgs"))


@query("contextual_org", f"SELECT doc_id, CAST(x.pos AS BIGINT) AS pos, x.word AS word FROM (SELECT doc_id, unnest({Q.context_words('text')}) AS x FROM documents UNION ALL SELECT -doc_id, unnest({Q.context_words('text')}) FROM ({_sentences_sql('context')}))")
def contextual_org(spark, sf_dir):
    both = _docs(spark, sf_dir).unionByName(_sentences(spark, sf_dir, "context").withColumn("doc_id", -F.col("doc_id")))
    return M.contextual_orgs(both).withColumn("pos", F.col("pos").cast("long"))


@query("heuristic_ner", f"SELECT doc_id, x.v AS value, x.k AS type, count(*) AS n FROM (SELECT doc_id, unnest({Q.name_runs('text')}) AS x FROM documents UNION ALL SELECT -doc_id, unnest({Q.name_runs('text')}) FROM ({_sentences_sql('names')})) GROUP BY ALL")
def heuristic_ner(spark, sf_dir):
    return M.heuristic_names(_docs(spark, sf_dir).unionByName(_sentences(spark, sf_dir, "names").withColumn("doc_id", -F.col("doc_id"))))


_FEW = ("email", "phone_sa", "ipv4", "usd", "date_numeric")
_RULES = tuple(BY_NAME[n] for n in _FEW)


def _mentions_sql(texts: str) -> str:
    parts = []
    for i, n in enumerate(_FEW):
        r = BY_NAME[n]
        parts.append(
            f"SELECT doc_id, {i} AS rule_seq, '{n}' AS rule, '{r.kind}' AS type, unnest(generate_series(0, len(m) - 1)) AS ord, trim(unnest(m)) AS surface "
            f"FROM (SELECT doc_id, {Q.found(r, 'text')} AS m FROM t) WHERE len(m) > 0"
        )
    return f"WITH t AS ({texts}), m AS ({' UNION ALL '.join(parts)})"


_MIXED = _mentions_sql(_sentences_sql("mixed"))
_REAL = _mentions_sql(f"SELECT doc_id, text FROM {_DOCS}")
_KEY = "lower(regexp_replace(surface, '[.,;:!?]+$', ''))"
_ONCE = f", o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY rule_seq, ord, surface) AS f FROM m) WHERE f = 1)"
_NUMBERED = _ONCE + ", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY rule_seq, ord, surface) AS n FROM o)"


def _mixed(spark, sf_dir):
    return M.mentions(_sentences(spark, sf_dir, "mixed"), rules=_RULES)


def _real(spark, sf_dir):
    return M.mentions(_docs(spark, sf_dir), rules=_RULES)


@query("mention_union", _REAL + " SELECT doc_id, rule, type, CAST(ord AS BIGINT) AS ord, surface FROM m")
def mention_union(spark, sf_dir):
    return _real(spark, sf_dir).select("doc_id", "rule", "type", F.col("ord").cast("long").alias("ord"), "surface")


@query("mention_dedup", _REAL + _ONCE + " SELECT doc_id, rule, surface FROM o")
def mention_dedup(spark, sf_dir):
    return M.numbered(_real(spark, sf_dir)).select("doc_id", "rule", "surface")


@query("token_numbering", _REAL + _NUMBERED + " SELECT doc_id, surface, '[' || type || '_' || n || ']' AS token FROM n")
def token_numbering(spark, sf_dir):
    return M.numbered(_real(spark, sf_dir)).select("doc_id", "surface", "token")


@query(
    "stats_pivot",
    _MIXED + _NUMBERED + " SELECT doc_id, count_if(type = 'EMAIL') AS email, count_if(type = 'PHONE') AS phone, count_if(type = 'AMOUNT') AS amount, count_if(type = 'DATE') AS date, "
    "count_if(type = 'IPADDR') AS ipaddr, count(*) AS total FROM n GROUP BY doc_id",
)
def stats_pivot(spark, sf_dir):
    return M.stats(M.numbered(_mixed(spark, sf_dir))).select("doc_id", "email", "phone", "amount", "date", "ipaddr", "total")


@query("type_share", _REAL + " SELECT type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM m GROUP BY type")
def type_share(spark, sf_dir):
    return metrics.type_share(_real(spark, sf_dir))


_MAIL = BY_NAME["email"]


class _Only(RedactConfig):
    """A configuration with the e-mail rule alone."""

    @property
    def rules(self):
        return (_MAIL,)


def _mail_config(occurrence: str) -> RedactConfig:
    return _Only(gazetteer=False, names=False, occurrence=occurrence)


def _sanitize_sql(occurrence: str) -> str:
    return f"SELECT * FROM ({Q.redact_sql('SELECT doc_id AS id, text AS txt FROM documents', _mail_config(occurrence))}) WHERE n_tokens > 0"


def _email_docs(spark, sf_dir, occurrence):
    return redact(_docs(spark, sf_dir), _mail_config(occurrence)).filter("n_tokens > 0")


@query("sanitize_all", _sanitize_sql("all"))
def sanitize_all(spark, sf_dir):
    return _email_docs(spark, sf_dir, "all").select("doc_id", "n_tokens", "sanitized")


@query("sanitize_first", _sanitize_sql("first"))
def sanitize_first(spark, sf_dir):
    return _email_docs(spark, sf_dir, "first").select("doc_id", "n_tokens", "sanitized")


@query("redact_documents", Q.redact_sql("SELECT doc_id AS id, text AS txt FROM documents", RedactConfig()))
def redact_documents(spark, sf_dir):
    return redact(spread(_read(spark, sf_dir, "documents"))).select("doc_id", "sanitized", "n_tokens")


@query("redact_pages", Q.redact_sql("SELECT page_id AS id, html AS txt FROM pages", RedactConfig(names=False), "id AS page_id, sanitized, n_tokens"))
def redact_pages(spark, sf_dir):
    return redact(spread(_read(spark, sf_dir, "pages")), RedactConfig(names=False), "page_id", "html").select("page_id", "sanitized", "n_tokens")


@query("phantom_mode", Q.redact_sql(f"SELECT doc_id AS id, text AS txt FROM ({_sentences_sql('mixed')})", RedactConfig(mode="phantom"), "id AS doc_id, sanitized"))
def phantom_mode(spark, sf_dir):
    return redact(_sentences(spark, sf_dir, "mixed"), RedactConfig(mode="phantom")).select("doc_id", "sanitized")


_MIXED_TEXT = f"SELECT doc_id, text FROM ({_sentences_sql('mixed')})"


_MIXED_IDS = f"SELECT doc_id AS id, text AS txt FROM ({_sentences_sql('mixed')})"
_PAIRS = "list_transform(entries, lambda e: {'v': e.value, 't': e.token})"
_COUNTED = r"CAST(len(regexp_extract_all(sanitized, '\[[A-Z]+_\d+\]')) AS BIGINT) AS masked"


def _masked(text):
    return T.tokens_in(text).cast("long").alias("masked")


@query("rehydrate", Q.redact_sql(_MIXED_IDS, RedactConfig(), f"id AS doc_id, {_COUNTED}, {Q.restore_sql('sanitized', _PAIRS)} AS restored"))
def rehydrate(spark, sf_dir):
    done = redact(_sentences(spark, sf_dir, "mixed"))
    return done.select("doc_id", _masked(F.col("sanitized")), T.rehydrate(F.col("sanitized"), F.col("token_map")).alias("restored"))


@query("rehydrate_orphans", Q.redact_sql(_MIXED_IDS, RedactConfig(), f"id AS doc_id, {_COUNTED}, {Q.restore_sql('sanitized', _PAIRS)} || ' [redacted]' AS restored"))
def rehydrate_orphans(spark, sf_dir):
    done = redact(_sentences(spark, sf_dir, "mixed"))
    return done.select("doc_id", _masked(F.col("sanitized")), T.rehydrate(F.concat("sanitized", F.lit(" [PERSON_99]")), F.col("token_map")).alias("restored"))


@query("wrap_answer", Q.redact_sql(_MIXED_IDS, RedactConfig(), f"id AS doc_id, sanitized AS masked, 'Re: ' || {Q.restore_sql('sanitized', _PAIRS)} AS answer"))
def wrap_answer(spark, sf_dir):
    return wrap(_sentences(spark, sf_dir, "mixed"), lambda masked: F.concat(F.lit("Re: "), masked))


@query("token_rows", Q.redact_sql("SELECT doc_id AS id, text AS txt FROM documents", RedactConfig(), "id AS doc_id, unnest(list_transform(entries, lambda e: {'token': e.token, 'type': e.type, 'original_value': e.value}), recursive := true)"))
def token_rows_of_documents(spark, sf_dir):
    done = redact(spread(_read(spark, sf_dir, "documents")))
    return token_rows(done).select("doc_id", "token", "type", "original_value")


_OF_TYPES = ", ".join(f"CAST(len(list_filter(entries, lambda e: e.type = '{t}')) AS BIGINT) AS {t.lower()}" for t in ("PERSON", "ORG", "EMAIL", "IPADDR", "ADDRESS"))


@query("redact_stats", Q.redact_sql("SELECT doc_id AS id, text AS txt FROM documents", RedactConfig(), f"id AS doc_id, {_OF_TYPES}, n_tokens AS total"))
def redact_stats(spark, sf_dir):
    done = redact(spread(_read(spark, sf_dir, "documents")))
    return done.select("doc_id", *[F.col(f"stats.{t}").cast("long").alias(t) for t in ("person", "org", "email", "ipaddr", "address", "total")])


@query("redact_entities", f"SELECT doc_id, replace(text, 'Xqzt Plomb', '[PERSON_1]') AS sanitized, CAST(contains(text, 'Xqzt Plomb') AS BIGINT) AS n_tokens FROM ({_sentences_sql('names')})")
def redact_entities(spark, sf_dir):
    """Entities of a recogniser alone: one stands, one is too unsure, one is no name."""
    docs = _sentences(spark, sf_dir, "names")
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(v).alias("value"), F.lit(c).alias("confidence")) for i, (t, v, c) in enumerate((("PERSON", "Xqzt Plomb", 0.9), ("ORG", "Acme Holdings", 0.6), ("PERSON", "SP", 0.9)))]
    entities = docs.select("doc_id", F.inline(F.array(*rows)))
    return redact(docs, RedactConfig(regex=False, gazetteer=False, contextual=False, names=False), entities=entities).select("doc_id", "sanitized", "n_tokens")


def _one_mail(spark, sf_dir):
    return redact_rules(_sentences(spark, sf_dir, "mixed"), (_MAIL,))


_SWAP = "SELECT doc_id, CASE c.doc_id % 3 WHEN 0 THEN replace(text, 'a' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '@b.co', {to}) ELSE text END AS {name} FROM ({texts}) c"


@query("phantom_text", _SWAP.format(to=f"'{PHANTOMS['EMAIL'][0]}'", name="phantom", texts=_MIXED_TEXT))
def phantom_text(spark, sf_dir):
    return _one_mail(spark, sf_dir).select("doc_id", T.phantom_text(F.col("sanitized"), F.col("token_map")).alias("phantom"))


@query("reverse_phantom", _SWAP.format(to=f"'{PHANTOMS['EMAIL'][0]}'", name="phantom, c.text AS restored", texts=_MIXED_TEXT))
def reverse_phantom(spark, sf_dir):
    done = _one_mail(spark, sf_dir).withColumn("p", T.phantom_text(F.col("sanitized"), F.col("token_map")))
    return done.select("doc_id", F.col("p").alias("phantom"), T.reverse_phantom(F.col("p"), F.col("token_map")).alias("restored"))


@query("apply_token_map", _SWAP.format(to="'[EMAIL_1]'", name="masked", texts=_MIXED_TEXT))
def apply_token_map(spark, sf_dir):
    done = _one_mail(spark, sf_dir).join(_sentences(spark, sf_dir, "mixed"), "doc_id")
    return done.select("doc_id", T.apply_token_map(F.col("text"), F.col("token_map")).alias("masked"))


_SPOKEN = [("twelve point five million dollars", "$12.5M"), ("two hundred and fifty thousand rand", "R250K"), ("three billion", "$3B"), ("not a number", "not a number")]


@query("verbal_to_numeric", f"SELECT n_nationkey AS id, [{', '.join(repr(b) for _, b in _SPOKEN)}][n_nationkey % 4 + 1] AS value FROM nation")
def verbal_to_numeric(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(a) for a, _ in _SPOKEN]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), T.verbal_to_numeric(words).alias("value"))


@query("digits_to_numeric", "SELECT n_nationkey AS id, ['920', '27', 'none'][n_nationkey % 3 + 1] AS value FROM nation")
def digits_to_numeric(spark, sf_dir):
    words = F.element_at(F.array(F.lit("nine two oh"), F.lit("plus two seven"), F.lit("none")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), T.digits_to_numeric(words).alias("value"))


_TURN = "concat(text, ' mail u', cast(turn % 3 as {S}), '@c', cast(conv_id as {S}), '.com from 10.0.0.', cast(conv_id % 200 as {S}))"


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").withColumn("text", F.expr(_TURN.replace("{S}", "string")))


_SESSION_RULES = (BY_NAME["email"], BY_NAME["ipv4"])
_SESSION = f"""
WITH t AS (SELECT conv_id, turn, role, {_TURN.replace("{S}", "varchar")} AS text FROM conversations),
m AS (
  SELECT conv_id, turn, 0 AS r, 'EMAIL' AS type, unnest(x) AS v, unnest(generate_series(1, len(x))) AS ord FROM (SELECT *, {Q.found(BY_NAME["email"], "text")} AS x FROM t) WHERE len(x) > 0
  UNION ALL
  SELECT conv_id, turn, 1, 'IPADDR', unnest(x), unnest(generate_series(1, len(x))) FROM (SELECT *, {Q.found(BY_NAME["ipv4"], "text")} AS x FROM t) WHERE len(x) > 0
), f AS (SELECT conv_id, v, min({{'turn': turn, 'r': r, 'ord': ord, 'type': type}}) AS p FROM m GROUP BY ALL),
n AS (SELECT conv_id, p.type AS type, v AS original_value, row_number() OVER (PARTITION BY conv_id, p.type ORDER BY p.turn, p.r, p.ord, v) AS n FROM f)
"""


@query("session_numbering", _SESSION + "SELECT conv_id, type, original_value, '[' || type || '_' || n || ']' AS token FROM n")
def session_numbering(spark, sf_dir):
    return S.session_tokens(_turns(spark, sf_dir), _SESSION_RULES).select("conv_id", "type", "original_value", "token")


_KNOWN = ", k AS (SELECT conv_id, list({'v': original_value, 't': '[' || type || '_' || n || ']'} ORDER BY type, n) AS m FROM n GROUP BY conv_id)"
_NO_PAIRS = "CAST([] AS STRUCT(v VARCHAR, t VARCHAR)[])"
_APPLIED = Q.apply_sql("text", f"coalesce(m, {_NO_PAIRS})")


@query("session_redact", _SESSION + _KNOWN + f"SELECT conv_id, turn, role, {_APPLIED} AS sanitized FROM t LEFT JOIN k USING (conv_id)")
def session_redact(spark, sf_dir):
    return S.redact_session(_turns(spark, sf_dir), _SESSION_RULES)


_TOOL = f"""{_KNOWN}, o AS (
  SELECT conv_id, turn, {_APPLIED} AS text FROM (SELECT conv_id, turn, text || ' and new@tool.org' AS text, m FROM t LEFT JOIN k USING (conv_id) WHERE role = 'assistant')
), m2 AS (
  SELECT conv_id, turn, 0 AS r, 'EMAIL' AS type, unnest(x) AS v, unnest(generate_series(1, len(x))) AS ord FROM (SELECT *, {Q.found(BY_NAME["email"], "text")} AS x FROM o) WHERE len(x) > 0
  UNION ALL
  SELECT conv_id, turn, 1, 'IPADDR', unnest(x), unnest(generate_series(1, len(x))) FROM (SELECT *, {Q.found(BY_NAME["ipv4"], "text")} AS x FROM o) WHERE len(x) > 0
), f2 AS (SELECT conv_id, v, min({{'turn': turn, 'r': r, 'ord': ord, 'type': type}}) AS p FROM m2 GROUP BY ALL),
n2 AS (
  SELECT f2.conv_id, v, p.type AS type, row_number() OVER (PARTITION BY f2.conv_id, p.type ORDER BY p.turn, p.r, p.ord, v) + coalesce((SELECT max(n) FROM n WHERE n.conv_id = f2.conv_id AND n.type = f2.p.type), 0) AS n FROM f2
), k2 AS (SELECT conv_id, list({{'v': v, 't': '[' || type || '_' || n || ']'}} ORDER BY type, n) AS m FROM n2 GROUP BY conv_id)
SELECT conv_id, turn, {_APPLIED} AS sanitized FROM o LEFT JOIN k2 USING (conv_id)"""


@query("session_reredact", _SESSION + _TOOL)
def session_reredact(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    outputs = turns.filter("role = 'assistant'").withColumn("text", F.concat("text", F.lit(" and new@tool.org")))
    return S.redact_tool_output(outputs, S.session_tokens(turns, _SESSION_RULES), _SESSION_RULES)


_TURN_TOKENS = f"CAST(len({Q.found(BY_NAME['email'], 'text')}) + len({Q.found(BY_NAME['ipv4'], 'text')}) AS BIGINT)"


@query("session_rehydrate", _SESSION + f"SELECT conv_id, turn, text AS restored, {_TURN_TOKENS} AS masked FROM t")
def session_rehydrate(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    done = S.redact_session(turns, _SESSION_RULES).select("conv_id", "turn", F.col("sanitized").alias("text"))
    back = S.rehydrate_session(done, S.session_tokens(turns, _SESSION_RULES))
    return back.join(done.select("conv_id", "turn", _masked(F.col("text"))), ["conv_id", "turn"])


@query("agent_replay", _SESSION + "SELECT conv_id, least(count(*), 2) AS answers, count(*) <= 2 AS finished, max_by(text, turn) FILTER (WHERE p <= 2) AS final FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t WHERE role = 'assistant') GROUP BY conv_id")
def agent_replay(spark, sf_dir):
    return S.replay(_turns(spark, sf_dir), _SESSION_RULES, max_turns=2)


@query("last_user_message", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
def last_user_message(spark, sf_dir):
    return S.last_user_message(_read(spark, sf_dir, "conversations"))


@query("tool_args_rehydrate", "SELECT c_custkey AS id, '{\"to\":\"say \\\"' || c_custkey || '\\\"\",\"x\":\"[ORG_9]\"}' AS args FROM customer")
def tool_args_rehydrate(spark, sf_dir):
    known = F.array(F.struct(F.lit("[PERSON_1]").alias("token"), F.concat(F.lit('say "'), F.col("c_custkey").cast("string"), F.lit('"')).alias("original_value")))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.rehydrate_args(F.lit('{"to":"[PERSON_1]","x":"[ORG_9]"}'), known).alias("args"))


@query("tool_calls_dry_run", "SELECT c_custkey AS conv_id, 'tool' AS role, 'c' || c_custkey AS tool_call_id, CASE c_custkey % 3 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN '{}' ELSE '{\"error\":\"unknown tool: other\"}' END AS content FROM customer")
def tool_calls_dry_run(spark, sf_dir):
    k = F.col("c_custkey")
    calls = _read(spark, sf_dir, "customer").select(k.alias("conv_id"), F.concat(F.lit("c"), k.cast("string")).alias("call_id"), F.when(k % 3 == 2, "other").otherwise("send").alias("name"), F.when(k % 3 == 1, "not json").otherwise('{"a":1}').alias("args"))
    return S.answer_calls(calls, ("send",))


@query(
    "leak_check",
    "SELECT DISTINCT o_custkey AS scenario, v AS value FROM (SELECT o_custkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS v, 'sent to customer#' || lpad(CAST(o_custkey + o_orderkey % 2 AS VARCHAR), 9, '0') AS arg FROM orders) WHERE contains(lower(arg), lower(v))",
)
def leak_check(spark, sf_dir):
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    orders = _read(spark, sf_dir, "orders")
    originals = orders.select(F.col("o_custkey").alias("scenario"), F.concat(F.lit("Customer#"), pad(F.col("o_custkey"))).alias("value")).distinct()
    args = orders.select(F.col("o_custkey").alias("scenario"), F.concat(F.lit("sent to customer#"), pad(F.col("o_custkey") + F.col("o_orderkey") % 2)).alias("arg"))
    return metrics.leaks(originals, args)


_TOOLS = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) ELSE ['send', 'pay'] END AS expected,
  CASE c_custkey % 3 WHEN 1 THEN ['send', 'look'] ELSE ['pay', 'send'] END AS called FROM customer"""


def _tools(spark, sf_dir):
    k = F.col("c_custkey")
    expected = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("send"), F.lit("pay")))
    called = F.when(k % 3 == 1, F.array(F.lit("send"), F.lit("look"))).otherwise(F.array(F.lit("pay"), F.lit("send")))
    return _read(spark, sf_dir, "customer").select(k.alias("id"), expected.alias("expected"), called.alias("called"))


@query("tool_accuracy", f"SELECT id, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(expected, called)) / len(expected) END::DOUBLE AS accuracy FROM ({_TOOLS})")
def tool_accuracy(spark, sf_dir):
    return _tools(spark, sf_dir).select("id", metrics.tool_accuracy(F.col("expected"), F.col("called")).alias("accuracy"))


@query(
    "tool_differences",
    "SELECT id, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(called, x))), ',') AS missing, "
    f"array_to_string(list_sort(list_filter(called, lambda x: NOT list_contains(expected, x))), ',') AS extra FROM ({_TOOLS})",
)
def tool_differences(spark, sf_dir):
    d = _tools(spark, sf_dir).withColumn("d", metrics.tool_differences(F.col("expected"), F.col("called")))
    return d.select("id", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.extra", ",").alias("extra"))


_RUNS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'masked' END AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' END AS error, o_orderkey % 900 AS input_tokens, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 90 END AS output_tokens FROM orders"


@query("run_totals", f"SELECT mode, count(error) AS errors, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens FROM ({_RUNS}) GROUP BY mode")
def run_totals(spark, sf_dir):
    _read(spark, sf_dir, "orders").createOrReplaceTempView("maskwell_runs")
    return metrics.totals(spark.sql(_RUNS.replace("FROM orders", "FROM maskwell_runs"))).select("mode", "errors", "tokens")


@query("latency_overhead", "SELECT o_orderkey AS id, (o_custkey % 7 - o_custkey % 5) * 100.0::DOUBLE / nullif(o_custkey % 5, 0) AS overhead FROM orders")
def latency_overhead(spark, sf_dir):
    raw, masked = (F.col("o_custkey") % 5).cast("double"), (F.col("o_custkey") % 7).cast("double")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), metrics.latency_overhead(raw, masked).alias("overhead"))


@query("types_ranked", _REAL + " SELECT type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, type) AS BIGINT) AS rank FROM m GROUP BY type")
def types_ranked(spark, sf_dir):
    return metrics.ranked_types(_real(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("sql_mentions", _MIXED + " SELECT doc_id, rule, type, surface FROM m")
def sql_mentions(spark, sf_dir):
    """The table function of SQL sessions."""
    register(spark, _RULES)
    _sentences(spark, sf_dir, "mixed").createOrReplaceTempView("maskwell_mixed")
    return spark.sql("SELECT d.doc_id, m.rule, m.type, m.surface FROM maskwell_mixed d, LATERAL pii_mentions(d.text) m")


@query("context_core", f"SELECT doc_id, surface, regexp_extract(surface, '[0-9]+$') AS core FROM ({_detect_sql('bank_account')})")
def context_core(spark, sf_dir):
    found = _detect(spark, sf_dir, "bank_account")
    return found.select("doc_id", "surface", T.context_core(F.col("surface")).alias("core"))


_MARK = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("highlight", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace({_MARK}, m, '<mark class=\"email\">' || m || '</mark>') ELSE {_MARK} END AS html FROM (SELECT doc_id, '<b>&' || text AS text, 'a' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '@b.co' AS m FROM ({_MIXED_TEXT}))")
def highlight(spark, sf_dir):
    docs = _sentences(spark, sf_dir, "mixed").withColumn("text", F.concat(F.lit("<b>&"), "text"))
    done = redact_rules(docs, (_MAIL,)).join(docs, "doc_id")
    return done.select("doc_id", T.highlight(F.col("text"), F.col("token_map")).alias("html"))


_CAPS = r"\b[A-Z][a-zA-Z''-]{2,}\b"


@query(
    "capital_words",
    f"SELECT doc_id, min_by(word, ord) AS word FROM (SELECT doc_id, unnest(m) AS word, unnest(generate_series(1, len(m))) AS ord "
    f"FROM (SELECT doc_id, regexp_extract_all({Q.narrow('text')}, '{_CAPS}') AS m FROM documents)) GROUP BY doc_id, lower(word)",
)
def capital_words(spark, sf_dir):
    return ner.capital_words(_docs(spark, sf_dir))


@query("sound_ids", "SELECT n_nationkey AS id, array_to_string((list_transform(string_split(n_name, ''), lambda c: CASE WHEN instr('ANTSKRFLMP', c) > 0 THEN instr('ANTSKRFLMP', c) + 1 ELSE 1 END) || [0, 0, 0, 0, 0, 0])[1:6], ',') AS ids FROM nation")
def sound_ids(spark, sf_dir):
    ids = ner.sound_ids(F.col("n_name"), "ANTSKRFLMP")
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))


_PASSES = "SELECT c_custkey AS id, list_transform(range(0, c_custkey % 3), lambda i: 0.6) AS a, list_transform(range(0, c_custkey % 5), lambda i: 0.5 + (c_custkey % 4) * 0.125) AS b FROM customer"


@query("ner_pass_choice", f"SELECT id, CAST(len(CASE WHEN len(b) > len(a) AND list_avg(b) > 0.75 THEN b ELSE a END) AS BIGINT) AS n, len(b) > len(a) AND list_avg(b) > 0.75 AS without FROM ({_PASSES})")
def ner_pass_choice(spark, sf_dir):
    k = F.col("c_custkey")
    made = lambda n, c: F.expr(f"transform(array_repeat(0, cast({n} as int)), x -> named_struct('confidence', cast({c} as double)))")
    some = _read(spark, sf_dir, "customer").select(k.alias("id"), made("c_custkey % 3", "0.6").alias("a"), made("c_custkey % 5", "0.5 + (c_custkey % 4) * 0.125").alias("b"))
    chosen = some.withColumn("c", ner.choose_pass(F.col("a"), F.col("b")))
    return chosen.select("id", F.size("c").cast("long").alias("n"), ((F.size("c") > F.size("a")) & F.lit(True)).alias("without"))


@query("ner_segments", None)
def ner_segments(spark, sf_dir):
    """Segments of the documents, of about seventy words."""
    found = _docs(spark, sf_dir).select("doc_id", F.posexplode(ner.segments(F.coalesce("text", F.lit("")))).alias("segment", "text"))
    return found.select("doc_id", F.col("segment").cast("long").alias("segment"), F.size(F.split(F.trim("text"), "\\s+")).cast("long").alias("n_words"))


@query("args_quality", "SELECT c_custkey AS scenario, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.5 END::DOUBLE AS quality FROM customer")
def args_quality(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario"))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(t).alias("token_type")) for f, v, t in (("to", "Ann", "PERSON"), ("sum", "$5", "AMOUNT"))]))
    expected = c.select("scenario", F.lit("send").alias("tool"), rows.alias("x")).select("scenario", "tool", "x.*")
    which = F.col("scenario") % 3
    got = F.array(F.struct(F.lit("to").alias("field"), F.when(which == 2, "Bob").otherwise("Ann").alias("arg")), F.struct(F.lit("sum").alias("field"), F.when(which == 1, "none").otherwise("[AMOUNT_1]").alias("arg")))
    calls = c.select("scenario", F.lit("send").alias("tool"), F.lit(1).alias("ord"), F.explode(got).alias("x")).select("scenario", "tool", "ord", "x.*")
    return metrics.args_quality(expected, calls)


_FACTS = "SELECT o_orderpriority AS vertical, CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'masked' END AS mode, CAST(o_orderkey % 4 AS DOUBLE) / 4 AS accuracy, o_custkey % 5 AS detected, o_custkey % 2 AS leaked, CAST(o_custkey % 3 AS DOUBLE) AS latency FROM orders"


@query(
    "vertical_breakdown",
    f"""
SELECT *, masked_accuracy - raw_accuracy AS delta, leaked / greatest(detected, 1) AS leak_rate FROM (
  SELECT vertical, count(*) AS n, avg(accuracy) FILTER (WHERE mode = 'raw') AS raw_accuracy, avg(accuracy) FILTER (WHERE mode = 'masked') AS masked_accuracy,
         CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(leaked) AS BIGINT) AS leaked, avg(nullif(latency, 0)) AS latency FROM ({_FACTS}) GROUP BY vertical)""",
)
def vertical_breakdown(spark, sf_dir):
    _read(spark, sf_dir, "orders").createOrReplaceTempView("maskwell_orders")
    return metrics.breakdown(spark.sql(_FACTS.replace("FROM orders", "FROM maskwell_orders")))


@query("token_preservation", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE least(1.0, 1.0 / (c_custkey % 3)) END::DOUBLE AS kept FROM customer")
def token_preservation(spark, sf_dir):
    k = F.col("c_custkey")
    found = T.tokens_in(F.lit('{"a":"[PERSON_1]","b":"x"}'))
    return _read(spark, sf_dir, "customer").select(k.alias("id"), metrics.token_preservation(found, k % 3).cast("double").alias("kept"))


def _entities(spark, sf_dir):
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(v).alias("value"), F.lit(c).alias("confidence")) for i, (t, v, c) in enumerate((("PERSON", "Sarah Chen", 0.9), ("ORG", "Acme", 0.6), ("PERSON", "Oak Partners", 0.8), ("MONEY", "$5M", 0.9), ("CASE", "CR-1-2", 0.9), ("PERSON", "sarah chen", 0.95), ("PERSON", "AB", 0.9)))]))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), made.alias("e")).select("doc_id", "e.*")


_VALUES = "SELECT c_custkey AS doc_id, unnest({rows}, recursive := true) FROM customer"


@query("ner_post_filter", _VALUES.format(rows="[{'type': 'PERSON', 'value': 'Sarah Chen'}, {'type': 'GOVID', 'value': 'CR-1-2'}, {'type': 'ORG', 'value': 'Oak Partners'}, {'type': 'PERSON', 'value': 'sarah chen'}]"))
def ner_post_filter(spark, sf_dir):
    return ner.post_filter(_entities(spark, sf_dir)).select("doc_id", "type", "value")


@query("ner_dedup", _VALUES.format(rows="[{'type': 'PERSON', 'value': 'sarah chen', 'confidence': 0.95::DOUBLE}, {'type': 'ORG', 'value': 'Acme', 'confidence': 0.6::DOUBLE}]"))
def ner_dedup(spark, sf_dir):
    some = _entities(spark, sf_dir).filter("lower(value) IN ('sarah chen', 'acme')")
    return ner.best_entities(some).select("doc_id", "type", "value", "confidence")


@query("ner_bio_decode", _VALUES.format(rows="[{'type': 'PERSON', 'value': 'Ann Lee', 'start': 0::BIGINT}, {'type': 'ORG', 'value': 'Acme', 'start': 3::BIGINT}]"))
def ner_bio_decode(spark, sf_dir):
    rows = [("Ann", "B-PERSON", 0.9), ("Lee", "I-PERSON", 0.8), ("met", "O", 0.9), ("Acme", "B-ORG", 0.9), ("Oslo", "B-LOC", 0.2)]
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(w).alias("word"), F.lit(t).alias("tag"), F.lit(c).alias("confidence")) for i, (w, t, c) in enumerate(rows)]))
    words = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), made.alias("e")).select("doc_id", "e.*")
    return ner.decode_tags(words).select("doc_id", "type", "value", F.col("start").cast("long").alias("start"))


@query("ner_chunks", "SELECT doc_id, CAST(i * 94 AS BIGINT) AS first, CAST(least(126, n - i * 94) AS BIGINT) AS size FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(CAST(ceil((n - 126) / 94.0) AS BIGINT), 0))) AS i FROM (SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM documents))")
def ner_chunks(spark, sf_dir):
    words = F.sequence(F.lit(0), F.size(F.split("text", " ", -1)) - 1)
    found = _read(spark, sf_dir, "documents").select("doc_id", F.explode(ner.chunks(words)).alias("c"))
    return found.select("doc_id", F.element_at("c", 1).cast("long").alias("first"), F.size("c").cast("long").alias("size"))


@query("name_fuzzy_match", "SELECT a AS name, b AS best FROM (VALUES ('Sara', 'Sarah'), ('Micheal', 'Michael'), ('Tom', 'Tim')) v(a, b)")
def name_fuzzy_match(spark, sf_dir):
    names = spark.createDataFrame([("Sara",), ("Micheal",), ("Tom",), ("Zzz",)], "name string")
    return ner.repair_names(names, spark.createDataFrame([("Sarah",), ("Michael",), ("Tim",)], "name string"))


@query("name_fuzzy_match_documents", None)
def name_fuzzy_match_documents(spark, sf_dir):
    """Each capitalised word of the documents, and the listed first name that it stands for."""
    words = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)\\b[A-Z][a-zA-Z'-]{2,}\\b"), F.lit(0)))
    return ner.repair_names(_docs(spark, sf_dir).select(words.alias("name")), spark.createDataFrame([(n,) for n in FIRST_NAMES], "name string"))


@query("name_sounds", None)
def name_sounds(spark, sf_dir):
    return ner.sounds(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("word")))


def _listed(spark, words):
    """A word list as the build side of a join: a fixed number of rows."""
    return F.broadcast(spark.createDataFrame([(w,) for w in words], "listed string"))


@query("whitelist_antijoin", f"SELECT doc_id, word FROM ({ORACLE['capital_words']}) WHERE upper(word) NOT IN {WHITELIST}")
def whitelist_antijoin(spark, sf_dir):
    return ner.capital_words(_docs(spark, sf_dir)).join(_listed(spark, WHITELIST), F.upper("word") == F.col("listed"), "left_anti")


@query("firstname_semijoin", f"SELECT doc_id, word FROM ({ORACLE['capital_words']} UNION ALL SELECT -doc_id, unnest(string_split(text, ' ')) FROM ({_sentences_sql('names')})) WHERE word IN {FIRST_NAMES}")
def firstname_semijoin(spark, sf_dir):
    made = _sentences(spark, sf_dir, "names").select((-F.col("doc_id")).alias("doc_id"), F.explode(F.split("text", " ")).alias("word"))
    return ner.capital_words(_docs(spark, sf_dir)).unionByName(made).join(_listed(spark, FIRST_NAMES), F.col("word") == F.col("listed"), "left_semi")


@query("fragment_antijoin", _REAL + " SELECT a.doc_id, a.surface FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND b.surface <> a.surface AND contains(b.surface, a.surface))")
def fragment_antijoin(spark, sf_dir):
    a = _real(spark, sf_dir).select("doc_id", "surface")
    b = a.withColumnRenamed("surface", "other")
    inside = (a["doc_id"] == b["doc_id"]) & (F.col("other") != a["surface"]) & F.contains(F.col("other"), a["surface"])
    return a.join(b, inside, "left_anti")


@query("windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(spark, sf_dir):
    return windowed_counts(_read(spark, sf_dir, "events"))
