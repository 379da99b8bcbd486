"""Queries over episodes, constraint corpora, commits and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.text import DIFF_STOP, semver
from factlake.operators import corpus
from factlake.operators import episodes as op
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.queries.text import _SQL_LIST
from factlake.registry import query

_EPISODES = """, m AS (SELECT *, CASE WHEN lag(session_id) OVER w IS NULL OR lag(session_id) OVER w <> session_id OR observed_at > lag(observed_at) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s
  FROM turns WINDOW w AS (PARTITION BY namespace ORDER BY observed_at, id)), e AS (SELECT *, CAST(sum(s) OVER (PARTITION BY namespace ORDER BY observed_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM m),
ep AS (SELECT namespace, episode, min(observed_at) AS t_start, max(observed_at) AS t_end, count(*) AS n_turns, list(id ORDER BY observed_at, id) AS source_turn_ids, string_agg(text, ' ' ORDER BY observed_at, id) AS joined,
  CASE WHEN min(memory_type) = max(memory_type) THEN min(memory_type) END AS memory_type FROM e GROUP BY namespace, episode)
"""


@query(
    oracle(
        _EPISODES
        + r"""SELECT namespace, episode, t_start, t_end, n_turns, source_turn_ids, substr(array_to_string(string_split(regexp_replace(joined, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1))[1:2], ' '), 1, 400) AS summary,
  least(1.0, 0.3 + 0.1 * n_turns) AS salience, memory_type FROM ep""",
        "turns",
    )
)
def e1_segment_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.segment_episodes(t.turns(spark, sf_dir)).withColumn("salience", F.col("salience").cast("double"))


@query()
def e2_segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    turns = t.turns(spark, sf_dir).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(500)))
    return op.segment_events(turns.join(vectors, "v", "left").select("namespace", "session_id", "id", "observed_at", "embedding"))


@query(
    oracle(
        _EPISODES
        + "SELECT namespace, episode, round(least(1.0, pow(2.0, -((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(t_end))) / 86400.0) / 14.0) + 0.05 * least(n_turns, 10)), 6) AS strength FROM ep",
        "turns",
    )
)
def e3_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.segment_episodes(t.turns(spark, sf_dir)).withColumn("access_count", F.col("n_turns"))
    return op.decay(rows, F.expr("timestamp_ntz'2024-02-01 00:00:00'"), 14.0).select("namespace", "episode", "strength")


@query(
    """WITH e AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS access_count, TIMESTAMP '1995-01-01 00:00:00' AS last_access FROM customer), l AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey)
SELECT id, access_count + coalesce(n, 0) AS access_count, greatest(last_access, newest) AS last_access FROM e LEFT JOIN l USING (id)"""
)
def e4_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = t.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_nationkey as bigint) as access_count", "timestamp_ntz'1995-01-01 00:00:00' as last_access")
    return op.touch(episodes, t.table(spark, sf_dir, "orders").selectExpr("o_custkey as id", "o_orderdate as at"))


@query(oracle("SELECT id FROM turns WHERE id NOT IN (SELECT unnest(source_turn_ids) FROM facts)", "turns", "facts"))
def j1_uncovered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.uncovered_turns(t.turns(spark, sf_dir).select("id"), t.facts(spark, sf_dir))


@query(oracle(_EPISODES + ", ids AS (SELECT namespace || ':' || episode AS episode_id, unnest(source_turn_ids) // 10000 AS k FROM ep) SELECT DISTINCT f.id AS fact_id, episode_id FROM (SELECT id, unnest(source_turn_ids) AS k FROM facts) f JOIN ids USING (k)", "turns", "facts"))
def j2_link_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = op.segment_episodes(t.turns(spark, sf_dir)).select(F.concat_ws(":", "namespace", "episode").alias("id"), F.transform("source_turn_ids", lambda i: F.floor(i / 10000)).alias("source_turn_ids"))
    return op.link_provenance(t.facts(spark, sf_dir), episodes)


@query(
    """WITH r AS (SELECT o_orderkey AS id, [o_orderkey % 5, o_orderkey % 3, o_orderkey % 7] AS s, CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'sure' END AS confidence FROM orders)
SELECT id, CAST(len(list_distinct(list_filter(s, lambda i: i < 4))) AS INTEGER) AS n_supports, CASE confidence WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.6 ELSE 0.9 END AS score FROM r
WHERE len(list_distinct(list_filter(s, lambda i: i < 4))) >= 2 AND confidence <> 'sure'"""
)
def e7_accept_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "array(o_orderkey % 5, o_orderkey % 3, o_orderkey % 7) as supports", "4 as n_sources", "case o_orderkey % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'sure' end as confidence")
    return op.accept_conclusions(rows).select("id", F.size("supports").alias("n_supports"), "score")


@query(
    oracle(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY namespace, subject ORDER BY observed_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY namespace, subject) AS c FROM facts)
SELECT namespace, subject, string_agg(statement, '; ' ORDER BY n) AS statement, max(c) AS n_facts FROM r WHERE n <= 3 AND c >= 3 GROUP BY namespace, subject""",
        "facts",
    )
)
def e6_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.consolidate(t.facts(spark, sf_dir))


_DOCS = """SELECT 'src:' || source AS namespace, CAST(doc_id AS VARCHAR) AS source, '# Rules' || chr(10) || '* ' || text || ' It MUST hold. You may not know. Code SHALL NOT fail!' AS text FROM documents"""


@query(
    rf"""WITH d AS ({_DOCS}), l AS (SELECT namespace, source, unnest(regexp_split_to_array(text, '\n+')) AS line FROM d),
s AS (SELECT namespace, source, unnest(string_split(regexp_replace(trim(regexp_replace(trim(line), '^[#\-*>| ]+', '')), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1))) AS st FROM l)
SELECT namespace, source, substr(trim(st), 1, 1000) AS statement FROM s WHERE length(trim(st)) >= 8 AND regexp_matches(upper(trim(st)), '(^|[^\p{{L}}\p{{N}}_])(SHALL|MUST|SHOULD|REQUIRED|PROHIBITED|FORBIDDEN|MAY NOT)($|[^\p{{L}}\p{{N}}_])')"""
)
def a11_ingest_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return corpus.ingest_constraints(spark.sql(_DOCS.replace("VARCHAR", "STRING"))).select("namespace", "source", "statement")


_RULES = """SELECT CAST(doc_id AS VARCHAR) AS path, '# Style' || chr(10) || text || chr(10) || '```' || chr(10) || '- Never inside a fence at all' || chr(10) || '```' || chr(10) || '## Tests ' || lang || chr(10) || '* ' || text || chr(10) || 'You must run every test' AS text FROM documents"""
_BULLET = r"^\s*(?:[-*+]|\d+[.)])\s+"


@query(
    rf"""WITH d AS ({_RULES}), l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM d),
m AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, regexp_matches(line, '^#+\s') AS head FROM l),
w AS (SELECT *, sum(fence::INTEGER) OVER w % 2 = 1 AS fenced, last_value(CASE WHEN head THEN trim(regexp_replace(line, '^#+\s+', '')) END IGNORE NULLS) OVER w AS heading FROM m WINDOW w AS (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING)),
k AS (SELECT path, n, heading, trim(regexp_replace(line, '{_BULLET}', '')) AS rule FROM w WHERE NOT fenced AND NOT fence AND NOT head AND (regexp_matches(line, '{_BULLET}') OR regexp_matches(line, '(?i)\b(always|never|must|should|do not|don''t|avoid|prefer|ensure)\b')))
SELECT path, rule, CAST(min(n) AS INTEGER) AS n, arg_min(heading, n) AS heading FROM k WHERE length(rule) BETWEEN 15 AND 600 GROUP BY path, rule"""
)
def a9_extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction documents made around each document's own text."""
    t.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return corpus.extract_rules(spark.sql(_RULES.replace("VARCHAR", "STRING")))


@query(
    r"""WITH c AS (SELECT conv_id * 10000 + turn AS sha, trim(CASE turn % 4 WHEN 0 THEN 'fix: ' WHEN 1 THEN 'feat(x): ' WHEN 2 THEN 'wip ' ELSE '' END || substr(text, 1, 60)) AS s, trim(substr(text, 61)) AS body FROM conversations)
SELECT sha, CASE WHEN regexp_matches(s, '(?i)^fix|\b(fix(es|ed)?|bug|regression)\b') THEN 'fix' WHEN regexp_matches(s, '(?i)\b(decide|choose|switch|migrate|replace|instead)\b') THEN 'decision' ELSE 'fact' END AS memory_type,
  s || CASE WHEN body = '' THEN '' ELSE chr(10) || substr(body, 1, 500) END AS text
FROM c WHERE NOT regexp_matches(s, '(?i)^(merge|wip|bump|typo|fmt|lint|format|chore: release)\b') AND length(s) >= 10
  AND (regexp_matches(s, '(?i)^(feat|fix|perf|refactor|docs|test|build|ci|chore|revert)(\([^)]*\))?!?:') OR regexp_matches(s, '(?i)\b(fix|decide|choose|switch|migrate|remove|add|replace|because|instead)\b') OR length(body) >= 25)"""
)
def a10_classify_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commits: the first letters are the subject, the rest the body."""
    commits = t.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 10000 + turn as sha", "concat(case turn % 4 when 0 then 'fix: ' when 1 then 'feat(x): ' when 2 then 'wip ' else '' end, substr(text, 1, 60)) as subject", "substr(text, 61) as body"
    )
    return corpus.classify_commits(commits).select("sha", "memory_type", "text")


# a diff for each document and the next one: all lines of the first go, all of the second come
_DIFFS = """SELECT a.doc_id AS diff_id, '--- a/x.txt' || chr(10) || '+++ b/x.txt' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || replace(a.text, chr(10), chr(10) || '-') || chr(10) || '+' || replace(b.text, chr(10), chr(10) || '+') || chr(10) || ' context' || chr(10) || '@@ -9 +9 @@' || chr(10) || '--- kept' || chr(10) || '++++ kept ' || b.lang AS diff
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""


@query(
    """SELECT a.doc_id AS diff_id, 1 AS hunk, b.text AS added, a.text AS removed FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
UNION ALL SELECT a.doc_id, 2, '+++ kept ' || b.lang, '-- kept' FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""
)
def f30_diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return corpus.diff_hunks(spark.sql(_DIFFS)).withColumn("hunk", F.col("hunk").cast("int"))


_TURN_DIFFS = """SELECT a.conv_id * 10000 + a.turn AS diff_id, '@@ -1 +1 @@' || chr(10) || '-' || replace(a.text, chr(10), chr(10) || '-') || chr(10) || '+' || replace(b.text, chr(10), chr(10) || '+') AS diff FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
_HELD = "SELECT item_id AS constraint_id, CASE WHEN item_id % 2 = 0 THEN 'It SHALL NOT be: ' ELSE 'It SHALL be: ' END || text AS statement FROM benchmark"


@query(
    f"""WITH h AS (SELECT a.conv_id * 10000 + a.turn AS diff_id, b.text AS added, a.text AS removed FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), c AS ({_HELD}),
hw AS (SELECT DISTINCT diff_id, side, unnest(list_transform(regexp_extract_all(CASE side WHEN 'a' THEN added ELSE removed END, '[A-Za-z]{{4,}}'), lambda z: lower(z))) AS word FROM h, (SELECT unnest(['a', 'r']) AS side)),
cw AS (SELECT DISTINCT constraint_id, unnest(list_transform(regexp_extract_all(statement, '[A-Za-z]{{4,}}'), lambda z: lower(z))) AS word FROM c),
s AS (SELECT diff_id, constraint_id, count(*) FILTER (WHERE side = 'a') AS a, count(*) FILTER (WHERE side = 'r') AS r FROM hw JOIN cw USING (word) WHERE word NOT IN ({_SQL_LIST(DIFF_STOP)}) GROUP BY ALL)
SELECT diff_id, constraint_id, CASE WHEN greatest(a, r) < 2 THEN 'uncovered' WHEN (a >= r) = (constraint_id % 2 = 0) THEN 'violated' ELSE 'satisfied' END AS verdict FROM s"""
)
def v24_check_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change from each turn to the next against constraints made of the texts that are held."""
    for name in ("conversations", "benchmark"):
        t.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return corpus.check_diffs(corpus.diff_hunks(spark.sql(_TURN_DIFFS)), spark.sql(_HELD)).select("diff_id", "constraint_id", "verdict")


@query(
    """WITH v AS (SELECT p_partkey, p_size AS s, CASE WHEN p_partkey % 2 = 0 THEN 10 END AS since, CASE WHEN p_partkey % 3 = 0 THEN 30 END AS until, CASE WHEN p_partkey % 5 = 0 THEN 40 END AS dev FROM part)
SELECT p_partkey, CASE WHEN dev IS NOT NULL AND s < dev THEN 'approved_deviation' WHEN until IS NOT NULL AND s >= until THEN 'expired' ELSE 'active' END AS status FROM v WHERE since IS NULL OR s >= since"""
)
def v23_version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_size, '.0') as v", "case when p_partkey % 2 = 0 then '10' end as s", "case when p_partkey % 3 = 0 then '30' end as u", "case when p_partkey % 5 = 0 then '40.0' end as d")
    as_versions = rows.select("p_partkey", semver(F.col("v")).alias("version"), semver(F.col("s")).alias("since"), semver(F.col("u")).alias("until"), semver(F.col("d")).alias("deviation_until"))
    return corpus.version_status(as_versions).select("p_partkey", "status")


@query(
    """WITH n AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 50) / 450) AS INTEGER)) AS n FROM documents)
SELECT doc_id AS diff_id, count(*) AS windows, max(greatest(n - 25, 0)) AS truncated, CAST(sum(length(substr(text, CAST(w AS INTEGER) * 450 + 1, 500))) AS BIGINT) AS letters FROM n, unnest(generate_series(0, least(n, 25) - 1)) AS g(w) GROUP BY doc_id"""
)
def v26_drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.drift_windows(t.table(spark, sf_dir, "documents").selectExpr("doc_id as diff_id", "text as diff"), 500, 50)
    return rows.groupBy("diff_id").agg(F.count(F.lit(1)).alias("windows"), F.max("truncated").alias("truncated"), F.sum(F.length("text")).alias("letters"))
