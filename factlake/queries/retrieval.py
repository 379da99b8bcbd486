"""Queries that retrieve for many requests at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.text import LEX_STOP, norm_content
from factlake.operators import retrieval as op
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.queries.text import _SQL_LIST, _STEM
from factlake.registry import query


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.vectors(spark, sf_dir).where("id % 100 = 0").selectExpr("id as query_id", "namespace", "embedding")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = f"{_DOT.format('q.embedding', 'v.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('v.embedding', 'v.embedding')}))"


@query(
    oracle(
        f"""SELECT q.id AS query_id, v.id, round(1 - {_COS}, 6) AS distance, CAST(row_number() OVER (PARTITION BY q.id ORDER BY round(1 - {_COS}, 6), v.id) AS INTEGER) AS rank
FROM vectors q JOIN vectors v ON q.namespace = v.namespace WHERE q.id % 100 = 0 QUALIFY rank <= 10""",
        "vectors",
    )
)
def v1_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.vector_topk(_vector_queries(spark, sf_dir), t.vectors(spark, sf_dir), 10)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").selectExpr("doc_id as id", "lang as namespace", "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "'en' as namespace", "text")


_BM25 = f"""WITH w AS (SELECT lang AS namespace, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
p AS (SELECT namespace, id, {_STEM} AS term, count(*) AS tf FROM w WHERE length(w) >= 2 AND w NOT IN ({_SQL_LIST(LEX_STOP)}) GROUP BY ALL),
l AS (SELECT namespace, id, sum(tf) AS len FROM p GROUP BY ALL), n AS (SELECT lang AS namespace, count(*) AS n FROM documents GROUP BY lang),
a AS (SELECT namespace, any_value(n) AS n, sum(len) / any_value(n) AS avg FROM l JOIN n USING (namespace) GROUP BY namespace),
qw AS (SELECT item_id AS query_id, 'en' AS namespace, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
q AS (SELECT DISTINCT query_id, namespace, {_STEM} AS term FROM qw WHERE length(w) >= 2 AND w NOT IN ({_SQL_LIST(LEX_STOP)})),
d AS (SELECT namespace, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg))), 6) AS score
  FROM q JOIN p USING (namespace, term) JOIN d USING (namespace, term) JOIN l USING (namespace, id) JOIN a USING (namespace) GROUP BY ALL)
"""


@query(_BM25 + "SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def v3_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lexical_topk(_asked(spark, sf_dir), _docs(spark, sf_dir), 20)


@query(_BM25 + "SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def v3_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from written postings, with pruning."""
    return op.lexical_index(_docs(spark, sf_dir)).topk(_asked(spark, sf_dir), 20)


@query(
    _BM25
    + """, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 40),
c AS (SELECT b.item_id AS query_id, d.doc_id AS id, row_number() OVER (PARTITION BY b.item_id ORDER BY abs(length(d.text) - length(b.text)), d.doc_id) AS rank FROM benchmark b JOIN documents d ON d.lang = 'en' QUALIFY rank <= 40),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM r UNION ALL SELECT * FROM c) GROUP BY ALL)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 25"""
)
def v5_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = op.lexical_topk(_asked(spark, sf_dir), _docs(spark, sf_dir), 40)
    lengths = _docs(spark, sf_dir).selectExpr("id", "namespace", "length(text) as value")
    by_length = op.nearest_values(_asked(spark, sf_dir).selectExpr("query_id", "namespace", "length(text) as value"), lengths, 40)
    return op.rrf([lexical, by_length], 25)


@query()
def v6_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and lexical arms over documents that have an embedding of the same number."""
    table = _docs(spark, sf_dir).join(t.vectors(spark, sf_dir).select("id", "embedding"), "id", "left")
    queries = _asked(spark, sf_dir).join(t.vectors(spark, sf_dir).selectExpr("id as query_id", "embedding"), "query_id")
    return op.hybrid_search(queries, table).select("query_id", "id", "score", "rank")


@query(
    oracle(
        """, q AS (SELECT 'q' || user_id AS query_id, 'team:' || (user_id % 4) AS namespace, 'User_' || user_id AS entity FROM (SELECT DISTINCT user_id FROM events))
SELECT query_id, id, observed_at, statement, CAST(row_number() OVER (PARTITION BY query_id ORDER BY observed_at DESC, id DESC) AS INTEGER) AS rank FROM q JOIN facts f ON f.namespace = q.namespace AND lower(f.subject) = lower(q.entity) QUALIFY rank <= 12""",
        "facts",
    )
)
def v8_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = t.table(spark, sf_dir, "events").select("user_id").distinct()
    queries = users.selectExpr("concat('q', user_id) as query_id", "concat('team:', user_id % 4) as namespace", "array(concat('User_', user_id)) as entities")
    return op.timeline(queries, t.facts(spark, sf_dir), 12)


_CANDS = "SELECT user_id % 25 AS query_id, event_id AS id, round(value, 2) AS score, ts AS observed_at, event_type || ' ' || (event_id % 3) AS content, CASE WHEN event_id % 2 = 0 THEN 'fact' ELSE 'turn' END AS arm, event_id % 10 = 0 AS stale FROM events"


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t.table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_CANDS)


@query(
    f"""WITH c AS ({_CANDS}) SELECT query_id, id, content, count(*) OVER (PARTITION BY query_id, lower(content)) AS dup_count FROM c
QUALIFY row_number() OVER (PARTITION BY query_id, lower(content) ORDER BY score DESC, observed_at DESC, id) = 1"""
)
def v10_dedupe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedupe_candidates(_cands(spark, sf_dir), norm_content(F.col("content"))).select("query_id", "id", "content", "dup_count")


@query(
    f"""WITH c AS ({_CANDS}), r AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM c),
s AS (SELECT *, CASE WHEN rank <= 50 THEN (id % 97) / 97.0 END AS s FROM r), z AS (SELECT *, CASE WHEN rank <= 50 THEN s ELSE min(s) OVER (PARTITION BY query_id) - 1e-6 * (rank - 50) END AS rr FROM s)
SELECT query_id, id, rank, round(rr, 9) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank) AS INTEGER) AS final_rank FROM z WHERE rr >= 0"""
)
def v12_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = op.rank_in(_cands(spark, sf_dir).select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.col("id")])
    found = op.rerank(ranked, F.col("id") % 97 / 97.0, 50)
    return found.select("query_id", "id", "rank", F.round("rerank_score", 9).alias("rerank_score"), "final_rank")


@query(
    f"""WITH c AS ({_CANDS}), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, id) <= CASE arm WHEN 'fact' THEN 8 ELSE 11 END)
SELECT query_id, id, arm, stale, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stale, CASE WHEN (arm = 'fact') = (query_id % 2 = 0) THEN 0 ELSE 1 END, score DESC, id) AS INTEGER) AS position FROM k"""
)
def v14_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.assemble(_cands(spark, sf_dir), {"fact": 8, "turn": 11}, F.col("query_id") % 2 == 0).select("query_id", "id", "arm", "stale", "position")


@query(
    f"""WITH c AS ({_CANDS}), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY score DESC, id) = 1), p AS (SELECT DISTINCT query_id, -query_id - 1 AS id, 'click 1' AS content FROM c),
u AS (SELECT query_id, id, content, 0 AS g, CAST(0 AS DOUBLE) AS score FROM p UNION ALL SELECT query_id, id, content, 1, score FROM d WHERE content <> 'click 1')
SELECT query_id, id, content, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, score DESC, id) AS INTEGER) AS position, g = 0 AS pinned FROM u"""
)
def v17_inject_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = _cands(spark, sf_dir)
    ranked = op.rank_in(cands, ["query_id", "content"], [F.desc("score"), F.col("id")], 1, "__r").drop("__r")
    pins = cands.select("query_id").distinct().selectExpr("query_id", "-query_id - 1 as id", "'click 1' as content")
    return op.inject_pins(ranked, pins).select("query_id", "id", "content", "position", "pinned")


@query()
def v18_render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op.assemble(_cands(spark, sf_dir), {"fact": 8, "turn": 11}, F.lit(True))
    return op.render_context(kept.selectExpr("query_id", "position", "id % 7 = 0 as pinned", "concat('[', arm, '] ', content) as line"), 120)


@query(
    f"""WITH c AS (SELECT query_id, id, score, content AS level FROM ({_CANDS})), l AS (SELECT query_id, count(DISTINCT level) AS n FROM c GROUP BY query_id),
r AS (SELECT c.*, row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, id) <= 20 // n AS ins FROM c JOIN l USING (query_id))
SELECT query_id, id, level, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ins DESC, score DESC, id) AS INTEGER) AS rank FROM r QUALIFY rank <= 20"""
)
def s5_rank_fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rank_fair_share(_cands(spark, sf_dir).selectExpr("query_id", "id", "score", "content as level"), 20).select("query_id", "id", "level", "rank")


_TAILS = "concat(text, CASE doc_id % 4 WHEN 0 THEN ' A big cat in 日本: cat' WHEN 1 THEN ' the big category of them 日本語' WHEN 2 THEN ' Don''t the the' ELSE ' talk of\nthe, BIG-CAT' END)"
_HAS = "contains(ws, ' {} ')"
_MATCHES = {
    1: ("the -was", "{the} AND NOT {was}"), 2: ("der OR les", "{der} OR {les}"), 3: ('of "of the"', "{of} AND {of the}"), 4: ('"of the"', "{of the}"), 5: ("-the", "NOT {the}"),
    6: ("the OR der und OR les", "({the} OR {der}) AND ({und} OR {les})"), 7: ('"of the" OR der -"the of"', "({of the} OR {der}) AND NOT {the of}"), 8: ('"big cat"', "{big cat}"), 9: ("日本", "{日 本}"),
    10: ("日本 cat", "{日 本} AND {cat}"), 11: ('"日本語" -cat', "{日 本 語} AND NOT {cat}"), 12: ("don't", "{don t}"), 13: ('"the the"', "{the the}"), 14: ("!!! of", "{of}"), 15: ('"!!!"', "false"), 16: ('cat -"big cat"', "{cat} AND NOT {big cat}"),
}


@query(
    f"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(regexp_replace(lower({_TAILS}), '([\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ' ') || ' ' AS ws FROM documents)
"""
    + " UNION ALL ".join(f"SELECT {n} AS query_id, doc_id AS id FROM d WHERE {re.sub('{(.*?)}', lambda m: _HAS.format(m[1]), sql)}" for n, (_, sql) in _MATCHES.items())
)
def v4_boolean_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and marks inside phrases, words that begin like a phrase's last one, and other scripts."""
    queries = spark.createDataFrame([(n, text) for n, (text, _) in _MATCHES.items()], "query_id int, text string")
    docs = _docs(spark, sf_dir).withColumn("text", F.expr(_TAILS.replace("doc_id", "id")))
    scope = docs.select("namespace").distinct().withColumn("query_id", F.explode(F.lit([*_MATCHES])))
    return op.boolean_match(op.parse_terms(queries), docs, scope)
