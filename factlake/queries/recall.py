"""Queries over the steps of a recall, constraints, names, anchors and closings that other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import predicates as p
from factlake.functions import text as x
from factlake.operators import anchors, bitemporal, constraints, graph, lookups, recall, retrieval, similarity
from factlake.operators import episodes as ep
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.queries.retrieval import _CANDS, _COS, _DOT
from factlake.queries.text import _SQL_LIST
from factlake.registry import query
from factlake.sources import tables
from factlake.streaming import feeds

_TABLES = ("customer", "nation", "documents", "supplier", "part", "events", "orders", "lineitem", "conversations", "embeddings", "pages")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A derivation that Spark and the oracle share."""
    for name in _TABLES:
        t.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


# constraints: turns of one conversation in three, facts of customers, episodes of suppliers
_PINS = """SELECT 'turn' AS kind, conv_id * 10000 + turn AS id, CASE conv_id % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'org:team' ELSE 'org:team:app' END AS namespace, 'must ' || role || ' ' || (turn % 7) AS content,
  conv_id AS ts, CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 = 1 THEN 'subject ' || (turn % 5) END AS constraint_subject, CASE WHEN conv_id % 11 = 0 THEN 1 END AS retired_at, false AS sourced FROM conversations
UNION ALL SELECT 'fact', CAST(c_custkey AS BIGINT), CASE c_custkey % 2 WHEN 0 THEN 'org' ELSE 'org:team' END, 'must keep ' || c_mktsegment, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Subject ' || (c_custkey % 4) END, CASE WHEN c_custkey % 10 = 0 THEN 1 END, c_custkey % 6 = 0 FROM customer
UNION ALL SELECT 'episode', CAST(s_suppkey AS BIGINT), 'org:team:app', 'must hold ' || (s_suppkey % 9), s_suppkey, 'subject ' || (s_suppkey % 3), NULL, false FROM supplier"""
_ASKED = "SELECT CAST(n_nationkey AS INTEGER) AS query_id, 'org:team:app' AS namespace FROM nation UNION ALL SELECT CAST(n_nationkey AS INTEGER), CASE n_nationkey % 2 WHEN 0 THEN 'org' ELSE 'org:team' END FROM nation"
_PINNED = f"""WITH p AS ({_PINS}), a AS (SELECT DISTINCT * FROM ({_ASKED})),
f AS (SELECT query_id, p.* FROM a JOIN p USING (namespace) WHERE retired_at IS NULL AND NOT sourced QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY ts, kind, id) = 1),
s AS (SELECT DISTINCT query_id, lower(constraint_subject) AS subj, namespace FROM f WHERE coalesce(constraint_subject, '') <> ''),
b AS (SELECT c.query_id, c.subj, c.namespace, arg_min(u.namespace, length(u.namespace)) AS by FROM s c JOIN s u ON c.query_id = u.query_id AND c.subj = u.subj AND starts_with(c.namespace, u.namespace || ':') GROUP BY ALL),
j AS (SELECT f.*, b.by AS beaten_by FROM f LEFT JOIN b ON f.query_id = b.query_id AND lower(f.constraint_subject) = b.subj AND f.namespace = b.namespace)"""


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _PINS).withColumn("author", F.lit(None).cast("string"))


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = spark.sql("select 'a' as child_namespace, 'b' as parent_namespace where false")
    return constraints.pinned_constraints(_sql(spark, sf_dir, _ASKED), _pins(spark, sf_dir), none, 10)


@query(_PINNED + " SELECT query_id, kind, id, namespace, content, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ts, content, kind, id) AS INTEGER) AS position FROM j WHERE beaten_by IS NULL QUALIFY position <= 10")
def j16_pinned_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir)[0]


@query(
    _PINNED
    + """, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts, content, kind, id) AS n FROM j WHERE beaten_by IS NULL)
SELECT query_id, kind || ':' || id AS "constraint", 'injected' AS event, NULL AS beaten_by FROM w WHERE n <= 10 UNION ALL SELECT query_id, kind || ':' || id, 'suppressed', beaten_by FROM j WHERE beaten_by IS NOT NULL"""
)
def g28_injection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.injection_audit(*_shown(spark, sf_dir))


@query(f"SELECT kind, id, namespace, content, constraint_subject FROM ({_PINS}) WHERE retired_at IS NULL")
def t15_list_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.list_pins(_pins(spark, sf_dir))


_ORDERS = "SELECT CASE c_custkey % 2 WHEN 0 THEN 'org' ELSE 'org:team' END AS namespace, CASE c_custkey % 5 WHEN 0 THEN 'fact:' || c_custkey WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN 'turn:' || c_custkey WHEN 3 THEN 'rule:' || c_custkey ELSE 'x' END AS constraint FROM customer"


@query(
    f"""WITH p AS ({_PINS}) SELECT DISTINCT kind, p.id, p.namespace, content, constraint_subject FROM p JOIN customer ON p.id = c_custkey AND p.namespace = CASE c_custkey % 2 WHEN 0 THEN 'org' ELSE 'org:team' END
WHERE retired_at IS NULL AND (c_custkey % 5 = 1 OR (c_custkey % 5 = 0 AND kind = 'fact') OR (c_custkey % 5 = 2 AND kind = 'turn'))"""
)
def t13_retire_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.retire_by_id(_pins(spark, sf_dir), _sql(spark, sf_dir, _ORDERS))


@query(
    rf"""WITH p AS ({_PINS}), n AS (SELECT *, trim(regexp_replace(lower(content), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM p), s AS (SELECT *, regexp_extract_all(norm, '[a-z0-9]+') AS w FROM n)
SELECT kind, id, CASE WHEN retired_at IS NULL AND coalesce(constraint_subject, '') = '' THEN 'auto:' || coalesce(nullif(trim(substr(array_to_string(w[1:6], '-'), 1, 60), '-'), ''), 'constraint') || '-' || substr(sha1(norm), 1, 10) ELSE constraint_subject END AS constraint_subject FROM s"""
)
def t14_backfill_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.backfill_subjects(_pins(spark, sf_dir)).select("kind", "id", "constraint_subject")


_RULES = "SELECT c_custkey AS rule_id, CASE c_custkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'src:src' || (c_custkey % 20) WHEN 2 THEN 'src:src' || (c_custkey % 20) || ':en' ELSE 'other' END AS namespace, CASE c_custkey % 2 WHEN 0 THEN 'block' ELSE 'ask' END AS level FROM customer"
_NAMES = "SELECT DISTINCT 'src:' || source || ':' || lang AS namespace FROM documents"
_LINKS = "SELECT DISTINCT 'src:' || source || ':' || lang AS src_ns, CASE WHEN lang = 'en' THEN 'other' ELSE 'src' END AS dst_ns FROM documents"


@query(
    f"""WITH r AS ({_RULES}), n AS ({_NAMES}), l AS ({_LINKS}), s AS (SELECT namespace AS ns, namespace, 'own' AS way, 0 AS step FROM n UNION ALL SELECT namespace, 'src:' || split_part(namespace, ':', 2), 'ancestor', 1 FROM n
  UNION ALL SELECT namespace, 'src', 'ancestor', 2 FROM n UNION ALL SELECT src_ns, dst_ns, 'link', 1000 FROM l)
SELECT ns AS namespace, rule_id, level, r.namespace AS rule_ns, way FROM s JOIN r ON s.namespace = r.namespace QUALIFY row_number() OVER (PARTITION BY ns, rule_id ORDER BY step) = 1"""
)
def j11_enforcement_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.enforcement_fanout(_sql(spark, sf_dir, _NAMES), _sql(spark, sf_dir, _RULES), _sql(spark, sf_dir, _LINKS))


_ASKS = """SELECT user_id AS query_id, 'team:' || (user_id % 4) AS namespace, CASE user_id % 4 WHEN 0 THEN 'When did User do it first?' WHEN 1 THEN 'What is the current state of Team?' WHEN 2 THEN 'Show Widget and Team' ELSE 'last time for Team in 2024' END AS text FROM (SELECT DISTINCT user_id FROM events)"""
_NAMED = """SELECT event_id AS id, 'team:' || (user_id % 4) AS namespace, CASE user_id % 3 WHEN 0 THEN 'Team' WHEN 1 THEN 'user' ELSE 'widget' END AS subject, 'the team saw ' || event_type AS statement, ts AS observed_at, ts AS valid_from,
  CASE WHEN event_id % 3 = 0 THEN ts END AS valid_to, CASE WHEN event_id % 13 = 0 THEN ts END AS expired_at FROM events"""


@query(
    f"""WITH q AS ({_ASKS}), f AS ({_NAMED}), e AS (SELECT query_id, namespace, query_id % 4 AS k, unnest(CASE query_id % 4 WHEN 0 THEN ['user'] WHEN 1 THEN ['team'] WHEN 2 THEN ['show', 'widget', 'team'] ELSE ['team'] END) AS w FROM q),
h AS (SELECT DISTINCT query_id, k, f.* FROM e JOIN f ON e.namespace = f.namespace AND (lower(f.subject) = w OR w = 'team') WHERE expired_at IS NULL AND (k IN (0, 3) OR valid_to IS NULL) AND (k <> 3 OR year(valid_from) = 2024))
SELECT query_id, id, CASE WHEN k = 2 THEN 'guarantee' ELSE 'timeline' END AS arm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k IN (2, 3) THEN -epoch(observed_at) ELSE epoch(observed_at) END, CASE WHEN k IN (2, 3) THEN -id ELSE id END) AS INTEGER) AS rank
FROM h QUALIFY rank <= CASE WHEN k = 2 THEN 20 ELSE 12 END"""
)
def v9_prefetch_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.prefetch_arms(_sql(spark, sf_dir, _ASKS), _sql(spark, sf_dir, _NAMED))


_ROWS = f"SELECT query_id, id, arm AS kind, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({_CANDS})"


@query(
    f"""WITH r AS ({_ROWS}), s AS (SELECT *, kind = 'turn' AND id % 10 = 0 OR kind = 'turn' AND id % 9 = 0 AS superseded FROM r)
SELECT query_id, id, kind, superseded, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'turn' AND superseded THEN 2 WHEN (kind = 'fact') = (query_id % 2 = 0) THEN 0 ELSE 1 END, rank, id) AS INTEGER) AS position FROM s"""
)
def v11_demote_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, _ROWS)
    stale = _sql(spark, sf_dir, "SELECT event_id AS id, ts AS closed_at FROM events WHERE event_id % 10 = 0 OR event_id % 9 = 0")
    marked = recall.mark_stale(rows, stale).withColumn("superseded", F.col("superseded") & (F.col("kind") == "turn"))
    return recall.demote_stale(marked, F.col("query_id") % 2 == 0).select("query_id", "id", "kind", "superseded", "position")


_SHAPED = """SELECT user_id % 25 AS query_id, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'fact' ELSE 'turn' END AS kind, CASE event_id % 3 WHEN 0 THEN 'Gateway went up' WHEN 1 THEN repeat('word ', 100) ELSE 'none' END AS content, round(value, 2) AS score,
  CASE event_id % 5 WHEN 0 THEN 'Gateway' WHEN 1 THEN 'crosswalk' END AS subject, CAST(event_id % 4 AS INTEGER) AS restatements, CASE WHEN event_id % 7 = 0 THEN 0.9 ELSE 0.4 END AS salience, CASE WHEN event_id % 6 = 0 THEN 'fix' ELSE 'fact' END AS memory_type, CASE WHEN event_id % 8 = 1 THEN 'git' ELSE 'ann' END AS speaker FROM events"""
_SHAPE_ASKS = "SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE n_nationkey % 4 WHEN 0 THEN 'Which error did Gateway raise?' WHEN 1 THEN 'what exactly did Gateway say' WHEN 2 THEN 'name the color' ELSE 'look at Gateway today' END AS text FROM nation"


@query(
    f"""WITH c AS ({_SHAPED}), q AS ({_SHAPE_ASKS}), r AS (SELECT *, query_id % 4 AS k, kind = 'fact' AS f, id % 3 = 0 OR id % 5 = 0 AS about FROM c JOIN q USING (query_id))
SELECT query_id, id, round(score / CASE WHEN f THEN 1.0 ELSE 1.0 + 0.15 * greatest(0.0, ln(greatest(length(content), 1) / 400.0)) END
  * CASE WHEN f THEN 1.0 + least(0.25, 0.05 * (ln(1 + restatements) + greatest(0.0, salience - 0.5))) ELSE 1.0 END * CASE WHEN f AND k <> 1 THEN 1.06 ELSE 1.0 END
  * CASE WHEN NOT f OR k IN (1, 2) THEN 1.0 WHEN about THEN 1.12 WHEN id % 5 = 1 THEN 1 / 1.12 ELSE 1.0 END * CASE WHEN k = 0 AND id % 6 = 0 THEN 1.1 ELSE 1.0 END * CASE WHEN id % 8 = 1 THEN 0.85 ELSE 1.0 END, 6) AS shaped FROM r"""
)
def v13_shape_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.shape_scores(_sql(spark, sf_dir, _SHAPED), _sql(spark, sf_dir, _SHAPE_ASKS))
    return found.select("query_id", "id", F.round("shaped", 6).alias("shaped"))


_WINDOWS = """SELECT user_id AS query_id, 'team:' || (user_id % 4) AS namespace, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-05 00:00:00' END AS start, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-08 00:00:00' END AS end, CASE user_id % 2 WHEN 0 THEN 'asc' ELSE 'desc' END AS order FROM (SELECT DISTINCT user_id FROM events)"""


@query(
    oracle(
        """, q AS (SELECT user_id AS query_id, 'team:' || (user_id % 4) AS namespace, user_id % 3 = 0 AS win, user_id % 2 = 0 AS up FROM (SELECT DISTINCT user_id FROM events)), d AS (SELECT id, namespace, valid_from FROM facts WHERE expired_at IS NULL),
h AS (SELECT user_id AS query_id, event_id AS id, 0 AS arm, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5),
w AS (SELECT query_id, id, 1 AS arm, row_number() OVER (PARTITION BY query_id ORDER BY valid_from, id) AS rank FROM q JOIN d USING (namespace) WHERE win AND valid_from >= TIMESTAMP '2024-01-05' AND valid_from < TIMESTAMP '2024-01-08' QUALIFY rank <= 40),
e AS (SELECT query_id, id, 2 AS arm, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN up THEN epoch_us(valid_from) ELSE -epoch_us(valid_from) END, CASE WHEN up THEN id ELSE -id END) AS rank FROM q JOIN d USING (namespace) QUALIFY rank <= 6),
u AS (SELECT * FROM (SELECT * FROM h UNION ALL SELECT * FROM w UNION ALL SELECT * FROM e) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY arm, rank) = 1)
SELECT query_id, id, ['hybrid', 'window', 'ends'][arm + 1] AS arm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY arm, rank, id) AS INTEGER) AS position FROM u""",
        "facts",
    )
)
def v7_temporal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _sql(spark, sf_dir, "SELECT user_id AS query_id, event_id AS id, value AS score FROM events")
    ranked = retrieval.rank_in(scored, ["query_id"], [F.desc("score"), F.col("id")], 5)
    facts = t.facts(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return recall.temporal_search(ranked, _sql(spark, sf_dir, _WINDOWS), facts)


_SCORED = "SELECT CAST(user_id % 25 AS INTEGER) AS query_id, 'team:' || (event_id % 8) AS namespace, CASE WHEN event_id % 2 = 0 THEN 'fact' ELSE 'turn' END AS kind, event_id AS id, round(value, 2) AS score FROM events"
_MAY = "SELECT CAST(n_nationkey AS INTEGER) AS principal_id, 'team:' || (n_nationkey % 8) AS namespace FROM nation UNION ALL SELECT CAST(n_nationkey AS INTEGER), 'team:' || ((n_nationkey + 3) % 8) FROM nation"
_WHO = "SELECT CAST(n_nationkey AS INTEGER) AS query_id, CAST((n_nationkey * 7) % 25 AS INTEGER) AS principal_id, 'team:' || (n_nationkey % 8) AS namespace FROM nation"


@query(
    f"""WITH c AS ({_SCORED}), m AS ({_MAY}), a AS ({_WHO}), k AS (SELECT c.* FROM c JOIN a USING (query_id) JOIN m ON m.principal_id = a.principal_id AND m.namespace = c.namespace
  QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, c.namespace, id) <= 60)
SELECT query_id, namespace, kind, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, namespace, id) AS INTEGER) AS rank FROM k"""
)
def v15_recall_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_wide(_sql(spark, sf_dir, _SCORED), _sql(spark, sf_dir, _MAY), _sql(spark, sf_dir, _WHO).drop("namespace")).select("query_id", "namespace", "kind", "id", "score", "rank")


_STATE = "SELECT principal_id, namespace AS src_ns, 'team:' || ((principal_id + 1) % 8) AS dst_ns, CASE WHEN principal_id % 3 = 0 THEN 'skipped' ELSE 'used' END AS state FROM (" + _WHO + ")"


@query(
    f"""WITH c AS ({_SCORED}), a AS ({_WHO}), g AS ({_STATE}), s AS (SELECT query_id, namespace FROM a UNION SELECT query_id, dst_ns FROM a JOIN g ON g.principal_id = a.principal_id AND g.src_ns = a.namespace AND state = 'used')
SELECT query_id, namespace, kind, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, namespace, id) AS INTEGER) AS rank FROM c JOIN s USING (query_id, namespace)"""
)
def v16_recall_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.recall_grounded(_sql(spark, sf_dir, _SCORED), _sql(spark, sf_dir, _WHO), _sql(spark, sf_dir, _STATE))
    return found.select("query_id", "namespace", "kind", "id", "score", "rank")


_DUAL = "SELECT user_id AS query_id, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'episodic' ELSE 'semantic' END AS kind, round(value / (1 + value), 6) AS relevance, CASE WHEN event_id % 9 > 0 THEN ts END AS at FROM events"


@query(
    f"""WITH c AS ({_DUAL}), a AS (SELECT *, exp(-0.03 * greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(coalesce("at", TIMESTAMP '2024-02-01 00:00:00'))) / 86400000000.0)) AS rec FROM c),
f AS (SELECT query_id, id, kind, round(relevance * CASE WHEN kind = 'episodic' THEN 0.3 + 0.7 * rec ELSE 0.6 * (0.85 + 0.15 * rec) END, 9) AS final FROM a)
SELECT query_id, id, kind, round(final, 6) AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, kind, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 12"""
)
def v19_dual_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.dual_retrieve(_sql(spark, sf_dir, _DUAL), F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    return found.select("query_id", "id", "kind", F.round("final", 6).alias("final"), "rank")


@query(
    f"""WITH c AS (SELECT query_id, count(*) AS found FROM ({_SCORED}) GROUP BY query_id), a AS ({_WHO}), m AS ({_MAY}), o AS (SELECT query_id, list_sort(list(DISTINCT m.namespace)) AS others FROM a JOIN m USING (principal_id) WHERE m.namespace <> a.namespace GROUP BY query_id)
SELECT query_id, coalesce(found, 0) AS found, 1 AS n_searched, coalesce(len(others), 0) AS n_others, CASE WHEN len(others) > 0 THEN 'results scoped to ' || namespace || '; also readable: ' || array_to_string(others, ', ') END AS hint FROM a LEFT JOIN c USING (query_id) LEFT JOIN o USING (query_id)"""
)
def v20_recall_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_scope(_sql(spark, sf_dir, _SCORED), _sql(spark, sf_dir, _WHO), _sql(spark, sf_dir, _MAY))


_LOGGED = "SELECT o_orderkey AS query_id, l_linenumber AS position, l_quantity > 25 AS pinned FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_RECALLS = "SELECT o_orderkey AS query_id, o_orderpriority AS namespace, o_orderdate AS ts FROM orders"


@query(
    f"""WITH r AS ({_LOGGED}), q AS (SELECT * FROM ({_RECALLS}) QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY ts DESC, query_id DESC) <= 50)
SELECT query_id, position, pinned, namespace FROM r JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, pinned ORDER BY position) <= CASE WHEN pinned THEN 2 ELSE 1 END"""
)
def v21_explain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.explain_log(_sql(spark, sf_dir, _LOGGED), _sql(spark, sf_dir, _RECALLS), pinned=2, ranked=1)


_TOUCHED = "SELECT CAST(user_id AS INTEGER) AS query_id, CASE event_id % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'org:team' ELSE 'org:team:app' END AS namespace, event_id AS id, round(value, 2) AS score FROM events"
_VERSIONED = "SELECT event_id AS id, 'x' AS namespace, CASE WHEN event_id % 4 = 0 THEN '2.0' WHEN event_id % 4 = 1 THEN '1.0.0' END AS since, CASE WHEN event_id % 5 = 0 THEN '1.4' END AS until, event_id % 7 = 0 AS has_deviation, CASE WHEN event_id % 2 = 0 THEN '1.4.9' END AS deviation_until FROM events"
_SEARCHED = "SELECT CAST(user_id AS INTEGER) AS query_id, CASE k WHEN 0 THEN 'org:team:app' WHEN 1 THEN 'org:team' ELSE 'org' END AS namespace, k AS depth FROM (SELECT DISTINCT user_id FROM events) u JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) d ON u.user_id % 3 >= d.k"


@query(
    f"""WITH h AS ({_TOUCHED}), c AS ({_VERSIONED}), s AS ({_SEARCHED}),
f AS (SELECT h.*, depth, CASE WHEN has_deviation AND (deviation_until IS NULL) THEN 'approved_deviation' WHEN until IS NOT NULL THEN 'expired' ELSE 'active' END AS status FROM h JOIN s USING (query_id, namespace) JOIN c USING (id) WHERE since IS DISTINCT FROM '2.0'),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY score DESC, id) AS n FROM f QUALIFY n <= 50), l AS (SELECT query_id, count(DISTINCT namespace) AS levels FROM k GROUP BY query_id)
SELECT query_id, id, namespace, status, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n <= greatest(1, 20 // levels) DESC, score DESC, depth, id) AS INTEGER) AS rank FROM k JOIN l USING (query_id) QUALIFY rank <= 20"""
)
def v22_corpus_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = x.semver(F.lit("1.5"))
    since, until, deviation = (x.semver(F.col(c)) for c in ("since", "until", "deviation_until"))
    status = F.when(F.col("has_deviation") & (deviation.isNull() | (version < deviation)), "approved_deviation").when(until.isNotNull() & (version >= until), "expired").otherwise("active")
    status = F.when(since.isNull() | (version >= since), status)
    return recall.corpus_check(_sql(spark, sf_dir, _TOUCHED), _sql(spark, sf_dir, _VERSIONED), _sql(spark, sf_dir, _SEARCHED), status)
