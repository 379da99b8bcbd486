"""Queries over bi-temporal facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators import bitemporal as op
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.registry import query

#: The closing rule written as a self-join: the first later closer of the key with another object.
_CLOSERS = """, closers AS (SELECT * FROM facts WHERE NOT regexp_matches(statement, '(?i)\\bformerly\\b') AND object <> 'unknown'),
written AS (SELECT f.id, arg_min(c.id, c.observed_at) AS superseded_by, min(c.observed_at) AS valid_to
  FROM facts f LEFT JOIN closers c ON f.namespace = c.namespace AND f.subject = c.subject AND f.predicate = c.predicate AND f.object <> c.object
    AND (c.observed_at > f.observed_at OR (c.observed_at = f.observed_at AND c.id > f.id)) GROUP BY f.id)
"""


@query(oracle(_CLOSERS + "SELECT id, superseded_by, valid_to FROM written", "facts"))
def t1_supersede_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.supersede(t.facts(spark, sf_dir)).select("id", "superseded_by", "valid_to")


@query(
    oracle(
        """, closers AS (SELECT * FROM facts WHERE NOT regexp_matches(statement, '(?i)\\bformerly\\b') AND object <> 'unknown'),
newest AS (SELECT namespace, subject, predicate, arg_max(id, (observed_at, id)) AS id, arg_max(object, (observed_at, id)) AS object, max(observed_at) AS observed_at FROM closers GROUP BY ALL)
SELECT f.id, n.id AS superseded_by, n.observed_at AS valid_to FROM facts f LEFT JOIN newest n
  ON f.namespace = n.namespace AND f.subject = n.subject AND f.predicate = n.predicate AND f.object <> n.object AND f.observed_at <= n.observed_at""".replace(
            "GROUP BY ALL", "GROUP BY namespace, subject, predicate"
        ),
        "facts",
    )
)
def t2_supersede_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.supersede(t.facts(spark, sf_dir), "reconcile").select("id", "superseded_by", "valid_to")


@query(
    oracle(
        """, closed AS (SELECT a.id, a.subject, a.object, a.observed_at, (SELECT arg_min(b.id, (b.observed_at, b.id)) FROM states b WHERE b.namespace = a.namespace AND b.subject = a.subject
  AND b.object <> a.object AND (b.observed_at, b.id) > (a.observed_at, a.id)) AS superseded_by FROM states a)
SELECT subject, object AS status, observed_at AS since FROM closed WHERE superseded_by IS NULL""",
        "states",
    )
)
def t3_current_order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = op.supersede(t.states(spark, sf_dir))
    return closed.where("superseded_by is null").select("subject", F.col("object").alias("status"), F.col("observed_at").alias("since"))


@query(
    oracle(
        _CLOSERS
        + """SELECT f.namespace, f.subject, f.predicate, f.object FROM facts f JOIN written w USING (id)
WHERE f.valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (w.valid_to IS NULL OR w.valid_to > TIMESTAMP '2024-01-15 00:00:00')
  AND f.created_at <= TIMESTAMP '2024-01-20 00:00:00' AND (f.expired_at IS NULL OR f.expired_at > TIMESTAMP '2024-01-20 00:00:00')""",
        "facts",
    )
)
def b2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = op.supersede(t.facts(spark, sf_dir))
    at = op.as_of(state, F.expr("timestamp_ntz'2024-01-15 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return at.select("namespace", "subject", "predicate", "object")


@query(oracle(_CLOSERS + "SELECT f.id, f.subject, f.predicate, f.object FROM facts f JOIN written w USING (id) WHERE w.valid_to IS NULL AND f.expired_at IS NULL", "facts"))
def b1_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.live(op.supersede(t.facts(spark, sf_dir))).select("id", "subject", "predicate", "object")


@query(
    oracle(
        "SELECT id, CASE WHEN expired_at IS NULL AND (id IN (SELECT event_id FROM events WHERE event_type = 'error')) THEN TIMESTAMP '2024-02-01 00:00:00' ELSE expired_at END AS expired_at FROM facts",
        "facts",
    )
)
def b3_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = t.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return op.expire(t.facts(spark, sf_dir), wrong, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).select("id", "expired_at")


@query(
    oracle(
        _CLOSERS
        + """SELECT namespace, subject, predicate, count(DISTINCT object) AS n_objects, count(*) AS n_facts FROM facts JOIN written USING (id)
WHERE valid_to IS NULL AND expired_at IS NULL GROUP BY namespace, subject, predicate HAVING count(DISTINCT object) > 1 AND bool_or(object <> 'unknown')""",
        "facts",
    )
)
def t16_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.contradictions(op.supersede(t.facts(spark, sf_dir)))


@query(
    oracle(
        """, pins AS (SELECT *, 'turn' AS kind, CASE WHEN author <> 'author_4' THEN author END AS constraint_subject FROM turns WHERE memory_type = 'constraint')
SELECT id, CASE WHEN constraint_subject IS NOT NULL THEN lag('turn:' || id) OVER w END AS retired_by, CASE WHEN constraint_subject IS NOT NULL THEN lag(observed_at) OVER w END AS retired_at
FROM pins WINDOW w AS (PARTITION BY namespace, constraint_subject ORDER BY observed_at DESC, id DESC)""",
        "turns",
    )
)
def t12_retire_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = t.turns(spark, sf_dir).where("memory_type = 'constraint'").selectExpr("*", "'turn' as kind", "case when author <> 'author_4' then author end as constraint_subject")
    return op.retire_by_subject(pins).select("id", "retired_by", "retired_at")


@query(
    oracle(
        _CLOSERS
        + """, links AS (SELECT unnest(source_turn_ids) AS id, w.valid_to FROM facts f JOIN written w ON f.id = w.id)
SELECT t.id, max(l.valid_to) AS closed_at FROM turns t JOIN links l ON t.id = l.id GROUP BY t.id HAVING bool_and(l.valid_to IS NOT NULL)""",
        "facts",
        "turns",
    )
)
def j8_stale_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stale_turns(t.turns(spark, sf_dir), op.supersede(t.facts(spark, sf_dir)))


@query(oracle("SELECT id, count(*) OVER (PARTITION BY statement) > 1 AS has_twin FROM facts", "facts"))
def s3_twin_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.twin_flag(t.facts(spark, sf_dir)).select("id", "has_twin")


@query(
    oracle(
        _CLOSERS
        + """, newest AS (SELECT namespace, subject, predicate, arg_max(id, (observed_at, id)) AS id, arg_max(object, (observed_at, id)) AS object, max(observed_at) AS observed_at FROM closers GROUP BY namespace, subject, predicate),
rec AS (SELECT f.id, n.id AS superseded_by, n.observed_at AS valid_to FROM facts f LEFT JOIN newest n
  ON f.namespace = n.namespace AND f.subject = n.subject AND f.predicate = n.predicate AND f.object <> n.object AND f.observed_at <= n.observed_at)
SELECT id, a.valid_to AS valid_to_a, a.superseded_by AS by_a, b.valid_to AS valid_to_b, b.superseded_by AS by_b,
  CASE WHEN b.superseded_by IS NULL THEN 'did_less' WHEN a.superseded_by IS NULL THEN 'did_more' ELSE 'other' END AS change
FROM written a JOIN rec b USING (id) WHERE a.superseded_by IS DISTINCT FROM b.superseded_by OR a.valid_to IS DISTINCT FROM b.valid_to""",
        "facts",
    )
)
def a26_diff_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = t.facts(spark, sf_dir)
    return op.diff_states(op.supersede(facts), op.supersede(facts, "reconcile"))
