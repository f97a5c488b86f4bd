"""Functions for SQL sessions: pii_mentions(text), pii_key(value), pii_domain(url). All are SQL, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.rules import RULES, Rule


def _lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> None:
    """Makes the functions known to a session. pii_mentions gives rows: rule_seq, ord, rule, type, surface."""
    parts = [
        f"transform(regexp_extract_all(t, {_lit(r.java)}, 0), (x, i) -> named_struct('rule_seq', {k}, 'ord', i, 'rule', {_lit(r.name)}, 'type', {_lit(r.kind)}, 'surface', trim(x)))"
        for k, r in enumerate(rules)
    ]
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pii_mentions(t STRING) RETURNS TABLE (rule_seq INT, ord INT, rule STRING, type STRING, surface STRING) "
        f"RETURN SELECT m.* FROM (SELECT explode(concat({', '.join(parts)})) AS m)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pii_key(v STRING) RETURNS STRING RETURN lower(regexp_replace(v, '[.,;:!?]+$', ''))")
    host = "(?i)^(?:https?://)?(?:www\\.)?"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_domain(u STRING) RETURNS STRING RETURN lower(regexp_extract(regexp_replace(u, {_lit(host)}, ''), '^[^/]*', 0))")
