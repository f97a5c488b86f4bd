"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .minhash import op2_minhash
from .mixing import op1_pareto_mix
from .quality_model import op9_quality_model
from .quality_rules import op8_quality_rules
from .sharding import op5_shard
from .substring_dedup import op10_substring_dedup
from .token_counts import op7_token_counts
from .topk import op4_topk
from .toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix, op2_minhash, op3_bpe, op4_topk, op5_shard, op6_toxicity, op7_token_counts, op8_quality_rules,
        op9_quality_model, op10_substring_dedup,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

_NEAR = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

_SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, i + j AS place FROM t, (SELECT unnest(generate_series(0, 34)) AS j)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM d),
k AS (
  SELECT doc_id, count(*) AS n_words, count(x.place) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (WHERE x.place IS NULL) AS kept
  FROM u LEFT JOIN x USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL = {"op2_minhash": _NEAR, "op4_topk": _TOP_K, "op10_substring_dedup": _SUBSTRING}
