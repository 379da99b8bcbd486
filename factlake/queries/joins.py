"""Queries over similarity closings, lookups and capture filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators import lookups as op
from factlake.operators import similarity
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.registry import query

_VFACTS = """SELECT vec_id AS id, 'ns' || label AS namespace, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN 'Even' ELSE 'odd' END AS subject, TIMESTAMP '2024-01-01 00:00:00' AS observed_at, embedding,
  CASE WHEN vec_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS source_speaker FROM embeddings"""
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_PAIRS = f"""f AS ({_VFACTS}), p AS (SELECT a.namespace, a.id AS older, b.id AS newer, round(1 - {_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6) AS distance
  FROM f a JOIN f b ON a.namespace = b.namespace AND a.id < b.id AND (a.subject IS NULL OR b.subject IS NULL OR lower(a.subject) = lower(b.subject)))"""


def _vfacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as id", "concat('ns', label) as namespace", "case when vec_id % 9 = 0 then null when vec_id % 2 = 0 then 'Even' else 'odd' end as subject", "timestamp_ntz'2024-01-01 00:00:00' as observed_at", "embedding",
        "case when vec_id % 3 = 0 then 'assistant' else 'user' end as source_speaker",
    )


@query(f"WITH {_PAIRS} SELECT * FROM p WHERE distance >= 0 AND distance < 0.7")
def j5_near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicate_pairs(_vfacts(spark, sf_dir), 0.7)


@query(f"WITH {_PAIRS} SELECT newer AS id, arg_min(older, (distance, older)) AS absorbed_by, min(distance) AS distance FROM p WHERE distance < 0.7 GROUP BY newer")
def t7_dedupe_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.dedupe_older(_vfacts(spark, sf_dir), 0.7)


@query(
    f"""WITH {_PAIRS}, d AS (SELECT newer AS id, arg_min(older, (distance, older)) AS absorbed_by FROM p WHERE distance < 0.7 GROUP BY newer)
SELECT absorbed_by AS id, count(*) AS restatements, count(*) FILTER (WHERE source_speaker <> 'assistant') AS corroborations, round(least(1.0, 0.5 + 0.1 * count(*)), 6) AS salience FROM d JOIN f USING (id) GROUP BY absorbed_by"""
)
def t5_restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _vfacts(spark, sf_dir)
    return similarity.restatements(facts, similarity.dedupe_older(facts, 0.7))


@query(f"WITH {_PAIRS} SELECT older AS id, min(newer) AS superseded_by FROM p WHERE distance >= 0.6 AND distance < 0.8 GROUP BY older")
def t9_supersede_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.supersede_similar(_vfacts(spark, sf_dir), 0.6, 0.8)


@query("SELECT o_orderkey AS id, n AS superseded_by FROM (SELECT o_orderkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 3 = 0) WHERE o_orderkey <> n")
def t11_supersede_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "'n' as namespace", "concat('C', o_custkey) as subject", "o_orderdate as observed_at", "case when o_orderkey % 3 = 0 then 'inferred' else 'fact' end as kind")
    return similarity.supersede_inferred(rows)


@query("SELECT c_custkey AS constraint_id, d.o_orderstatus AS deviation_until, d.o_orderkey AS deviation_id FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) d ON o_custkey = c_custkey")
def j6_latest_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    constraints = t.table(spark, sf_dir, "customer").selectExpr("c_custkey as constraint_id")
    return op.latest_deviation(constraints, t.table(spark, sf_dir, "orders").selectExpr("o_custkey as constraint_id", "o_orderstatus as until", "o_orderkey as id", "o_orderdate as created_at"))


@query("SELECT 'h' || user_id % 3 AS host, '/p' || user_id % 11 AS cwd, arg_max('s' || event_id, (ts, 's' || event_id)) AS session FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND ts + to_seconds(600 * (event_id % 40)) > TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL")
def j21_session_for_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = t.table(spark, sf_dir, "events").selectExpr("concat('h', user_id % 3) as host", "concat('/p', user_id % 11) as cwd", "concat('s', event_id) as name", "ts as last_seen", "600 * (event_id % 40) as ttl_seconds")
    return op.session_for_cwd(sessions, F.expr("timestamp_ntz'2024-01-15 00:00:00'"))


@query(
    oracle(
        ", c AS (SELECT 'c' || user_id AS claim_id, 'User_' || user_id AS subject, CASE WHEN user_id % 2 = 0 THEN 'click' END AS predicate, 'it is 1 units' AS claim FROM (SELECT DISTINCT user_id FROM events)) SELECT claim_id, id AS fact_id, CASE WHEN contains(claim, object) THEN 'agrees' ELSE 'conflict' END AS verdict FROM c JOIN facts f ON lower(c.subject) = f.subject AND (c.predicate IS NULL OR c.predicate = f.predicate)",
        "facts",
    )
)
def j15_check_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = t.table(spark, sf_dir, "events").select("user_id").distinct()
    return op.check_claims(users.selectExpr("concat('c', user_id) as claim_id", "concat('User_', user_id) as subject", "case when user_id % 2 = 0 then 'click' end as predicate", "'it is 1 units' as claim"), t.facts(spark, sf_dir))


@query(oracle(", l AS (SELECT f.id, t AS turn_id, pos FROM facts f, unnest(source_turn_ids) WITH ORDINALITY AS u(t, pos)) SELECT l.id, count(*) AS n, min(turn_id) AS first_turn FROM l JOIN turns ON turns.id = turn_id GROUP BY l.id", "facts", "turns"))
def j3_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.provenance_of(t.facts(spark, sf_dir), t.turns(spark, sf_dir)).select("id", F.size("turns").cast("long").alias("n"), F.element_at("turns", 1).turn_id.alias("first_turn"))


@query("SELECT l_suppkey AS entity, list_sort(list(DISTINCT l_orderkey)) AS memories FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 12")
def j17_entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.entity_clusters(t.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as entity", "l_orderkey as memory"), 12)


@query("SELECT n_nationkey AS role_id, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS members, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS grants FROM nation")
def g14_role_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.role_census(
        t.table(spark, sf_dir, "nation").selectExpr("n_nationkey as role_id"), t.table(spark, sf_dir, "customer").selectExpr("c_nationkey as role_id", "c_custkey as principal_id"), t.table(spark, sf_dir, "supplier").selectExpr("s_nationkey as role_id")
    )


@query("SELECT user_id AS principal_id, 'm' || event_id % 3 AS machine, max(ts) AS last_seen, arg_max(CASE WHEN event_id % 2 = 0 THEN event_type END, (ts, event_id)) FILTER (WHERE event_id % 2 = 0) AS name FROM events GROUP BY ALL")
def g30_host_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.host_registry(t.table(spark, sf_dir, "events").selectExpr("user_id as principal_id", "concat('m', event_id % 3) as machine", "ts", "event_id as id", "case when event_id % 2 = 0 then event_type end as name"))


_SAID = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'eval run number one' WHEN 2 THEN 'continue please' WHEN 3 THEN '<note>something is tagged</note>' WHEN 4 THEN 'too short' ELSE 'please explain the plan again' END"


@query("SELECT CASE event_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'eval' WHEN 2 THEN 'loop' WHEN 3 THEN 'tag' WHEN 4 THEN 'short' END AS reason, count(*) AS n, count(*) FILTER (WHERE event_id % 6 = 5) AS users, count(*) FILTER (WHERE event_id % 6 > 1 AND event_id % 2 = 0 OR event_id % 6 > 1 AND event_id % 10 = 5) AS replies FROM events GROUP BY 1")
def g27_capture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    exchanges = t.table(spark, sf_dir, "events").selectExpr("event_id as id", f"{_SAID} as user_text", "case when event_id % 2 = 0 or event_id % 10 = 5 then 'a reply that is certainly long enough' else 'short' end as reply")
    return op.capture_stats(op.capture_noise(exchanges))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'model' WHEN event_id % 100 < 10 THEN 'max_tokens' WHEN event_id % 3 = 0 THEN 'not_terminal' WHEN event_id % 7 = 0 THEN 'tools' WHEN event_id % 2 = 0 THEN 'short_user' END AS reason FROM events")
def b13_capture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    exchanges = t.table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "case when event_id % 5 = 0 then 'tiny-title-model' else 'large' end as model", "event_id % 100 as max_tokens", "event_id % 3 <> 0 as terminal", "event_id % 7 = 0 as has_tools",
        "case when event_id % 2 = 0 then 'hi' else 'please explain the plan again' end as user_text", "'a reply that is certainly long enough' as reply_text",
    )
    return op.capture_gate(exchanges, "title", 10).select("id", "reason")


@query(
    """WITH f AS (SELECT user_id AS turn_id, event_id AS n, event_type AS k FROM events), g AS (SELECT *, k = 'click' AS high FROM f WHERE k IN ('click', 'view', 'error'))
SELECT turn_id, n, high, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY high DESC, n) AS INTEGER) AS rank FROM g QUALIFY rank <= 6"""
)
def b14_assistant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = t.table(spark, sf_dir, "events").selectExpr(
        "user_id as turn_id", "event_id as n", "'build' as subject", "case event_type when 'click' then 'Status' when 'signup' then 'likes' else 'note' end as predicate",
        "case event_type when 'view' then 'it was merged' when 'error' then 'see PR #12' when 'signup' then 'deployed' else 'nothing to see' end as statement",
    )
    return op.filter_assistant_facts(facts).select("turn_id", "n", "high", "rank")


@query(oracle("SELECT id FROM facts WHERE contains(subject, 'user_1') OR contains(lower(statement), 'user_1')", "facts"))
def b5_scope_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scope_subject(t.facts(spark, sf_dir).withColumnRenamed("statement", "content"), "User_1").select("id")


@query(
    """WITH r AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, value AS score, event_id % 4 = 0 AS correct, user_id % 5 <> 0 AS has_answer FROM events QUALIFY rank <= 3),
b AS (SELECT case_id, max(CASE WHEN rank = 1 THEN CAST(correct AS INTEGER) END) AS first, max(CAST(correct AS INTEGER)) AS anyc, max(score) AS top, bool_or(has_answer) AS has_answer FROM r GROUP BY case_id)
SELECT threshold, round(avg(first) FILTER (WHERE has_answer), 6) AS recall_at_1, round(avg(anyc) FILTER (WHERE has_answer), 6) AS recall_at_k, round(avg(CAST(top >= threshold AS INTEGER)) FILTER (WHERE has_answer), 6) AS hinted,
  round(avg(CAST(top >= threshold AS INTEGER)) FILTER (WHERE NOT has_answer), 6) AS false_hint FROM b, (VALUES (CAST(150 AS DOUBLE)), (200), (250)) v(threshold) GROUP BY threshold"""
)
def v25_matcher_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.operators.retrieval import rank_in

    events = t.table(spark, sf_dir, "events").selectExpr("user_id as case_id", "event_id", "value as score", "event_id % 4 = 0 as correct", "user_id % 5 <> 0 as has_answer")
    return op.matcher_bench(rank_in(events, ["case_id"], [F.desc("score"), F.col("event_id")], 3), [150.0, 200.0, 250.0])
