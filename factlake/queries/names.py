"""Queries over names, signals, anchors, closings and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import predicates as p
from factlake.functions import text as x
from factlake.operators import anchors, bitemporal, corpus, graph, lookups, retrieval, similarity
from factlake.operators import episodes as ep
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.queries.recall import _sql
from factlake.queries.retrieval import _DOT
from factlake.queries.text import _SQL_LIST
from factlake.registry import query
from factlake.sources import tables
from factlake.streaming import feeds

_NAME = """CASE c_custkey % 24 WHEN 0 THEN c_name WHEN 1 THEN 'in the pool' WHEN 2 THEN 'In Memory Cache' WHEN 3 THEN '$ 1,200' WHEN 4 THEN 'Acme, Inc.' WHEN 5 THEN 'a, b and c' WHEN 6 THEN 'because it broke' WHEN 7 THEN 'passed'
  WHEN 8 THEN '2024-01-02' WHEN 9 THEN 'x' WHEN 10 THEN 'march 3, 2021' WHEN 11 THEN 'what?' WHEN 12 THEN 'done.' WHEN 13 THEN 'Jones Jr.' WHEN 14 THEN 'one two three four five six' WHEN 15 THEN 'cost $ 5 a day' WHEN 16 THEN ':8080'
  WHEN 17 THEN 'v2' WHEN 18 THEN 'For Loop' WHEN 19 THEN 'On my way' WHEN 20 THEN 'a name that is far too long to be that of a thing here' WHEN 21 THEN '12 gb' WHEN 22 THEN '' ELSE c_mktsegment END"""


@query(
    """SELECT c_custkey, c_custkey % 24 IN (0, 2, 4, 13, 14, 17, 18, 23) AS subject_ok, c_custkey % 24 IN (0, 2, 4, 13, 17, 18, 23) AS object_ok FROM customer"""
)
def f18_valid_entity_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT c_custkey, {_NAME} AS name FROM customer")
    return rows.select("c_custkey", x.valid_entity_name(F.col("name")).alias("subject_ok"), x.valid_entity_name(F.col("name"), is_object=True).alias("object_ok"))


_TRIPLES = f"""SELECT c_custkey AS id, 'team:' || (c_nationkey % 3) AS namespace, CASE c_custkey % 5 WHEN 0 THEN 'me' WHEN 1 THEN 'the  USER' ELSE 'Nation ' || c_nationkey END AS subject, {_NAME} AS object FROM customer"""
_TRIPLES_CTE = f"""f AS ({_TRIPLES}), r AS (SELECT id, namespace, CASE WHEN id % 5 IN (0, 1) THEN 'user' ELSE subject END AS s, CASE WHEN id % 24 IN (0, 2, 4, 13, 17, 18, 23) THEN object END AS o FROM f)"""


@query(
    f"""WITH {_TRIPLES_CTE}, n AS (SELECT namespace, id, s AS name FROM r UNION SELECT namespace, id, o FROM r WHERE o IS NOT NULL), e AS (SELECT namespace, lower(name) AS key, count(DISTINCT id) AS mentions FROM n GROUP BY ALL)
SELECT 'entity' AS what, namespace, key AS a, NULL AS b, CAST(mentions AS DOUBLE) AS n FROM e
UNION ALL SELECT 'edge', namespace, least(lower(s), lower(o)), greatest(lower(s), lower(o)), CAST(count(*) AS DOUBLE) FROM r WHERE o IS NOT NULL AND lower(s) <> lower(o) GROUP BY ALL"""
)
def t17_graph_from_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions, edges = graph.graph_from_facts(_sql(spark, sf_dir, _TRIPLES))
    counts = mentions.groupBy("namespace", "key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = entities.join(counts, ["namespace", "key"]).select(F.lit("entity").alias("what"), "namespace", F.col("key").alias("a"), F.lit(None).cast("string").alias("b"), "n")
    return rows.unionByName(edges.select(F.lit("edge").alias("what"), "namespace", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("n")))


_PHRASED = "CASE c_custkey % 5 WHEN 0 THEN 'What did Bank of Boston say' WHEN 1 THEN 'Where is The Acme  Corp now' WHEN 2 THEN 'nothing here' WHEN 3 THEN 'Tell Alice about Bob and Carol, Dave' ELSE 'Which Segment ' || c_name END"


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Bank of Boston' WHEN 1 THEN 'Acme Corp' WHEN 2 THEN '' WHEN 3 THEN 'Alice|Bob and Carol|Dave' ELSE 'Segment' END AS phrases FROM customer"""
)
def f2_entity_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT c_custkey, {_PHRASED.replace(' || c_name', ' || lower(c_mktsegment)')} AS q FROM customer")
    return rows.select("c_custkey", F.array_join(x.entity_phrases(F.col("q")), "|").alias("phrases"))


@query(
    """WITH s AS (SELECT a.c_custkey, lower(trim(a.c_mktsegment)) AS a, lower(trim(CASE a.c_custkey % 3 WHEN 0 THEN 'the ' || a.c_mktsegment || ', ltd' WHEN 1 THEN a.c_mktsegment || 's' ELSE n_name END)) AS b FROM customer a JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, c_custkey % 3 = 0 OR a = b AS matches FROM s"""
)
def f3_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT c_custkey, c_mktsegment AS a, CASE c_custkey % 3 WHEN 0 THEN 'the ' || c_mktsegment || ', ltd' WHEN 1 THEN c_mktsegment || 's' ELSE n_name END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey")
    return rows.select("c_custkey", x.entity_match(F.col("a"), F.col("b")).alias("matches"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Git trailer Fixes: #' || doc_id || ';References issue #' || (doc_id % 100) WHEN 1 THEN 'References PR #' || (doc_id % 50) || ';References commit 00abc12' WHEN 2 THEN 'Mentions version 1.' || (doc_id % 9) || '.3' ELSE '' END AS signals FROM documents WHERE doc_id % 4 < 3 OR true"""
)
def f4_developer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = """CASE doc_id % 4 WHEN 0 THEN 'see issue #' || (doc_id % 100) || chr(10) || 'Fixes: #' || doc_id WHEN 1 THEN 'PR ' || (doc_id % 50) || ' at commit 00ABC12, pr #' || (doc_id % 50) WHEN 2 THEN 'now v1.' || (doc_id % 9) || '.3 is out' ELSE 'plain' END"""
    rows = _sql(spark, sf_dir, f"SELECT doc_id, {said} AS s FROM documents")
    return rows.select("doc_id", F.array_join(x.developer_signals(F.col("s")), ";").alias("signals"))


_TOKEN = "CASE WHEN doc_id % 3 = 0 THEN sha1(CAST(doc_id AS STRING)) WHEN doc_id % 3 = 1 THEN repeat('ab', 20) ELSE 'short' || doc_id END"


@query("""WITH c AS (SELECT doc_id, unnest(string_split(sha1(CAST(doc_id AS VARCHAR)), '')) AS ch FROM documents), e AS (SELECT doc_id, entropy(ch) AS bits FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND bits >= 3.5 THEN 'key [REDACTED:high_entropy] end' WHEN doc_id % 3 = 0 THEN 'key ' || sha1(CAST(doc_id AS VARCHAR)) || ' end' WHEN doc_id % 3 = 1 THEN 'key ' || repeat('ab', 20) || ' end' ELSE 'key short' || doc_id || ' end' END AS clean FROM documents JOIN e USING (doc_id)""")
def f7_redact_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT doc_id, 'key ' || {_TOKEN} || ' end' AS s FROM documents").select("doc_id", x.redact_entropy(F.col("s")).alias("clean"))


_SALIENT = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_-]{{3,}}'), lambda w: w NOT IN (" + _SQL_LIST(p.SALIENT_STOP) + "))))"


@query(f"""SELECT doc_id, regexp_matches(lower(text), '{p.REVERSAL}') AS reversal, md5(array_to_string({_SALIENT.format('text')}, ',')) AS salient_md5 FROM documents""")
def f12_reversal_salient(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", p.reversal_cue(F.col("text")).alias("reversal"), F.md5(F.array_join(F.sort_array(p.salient_tokens(F.col("text"))), ",").cast("binary")).alias("salient_md5"))


@query(
    f"""SELECT conv_id, turn, regexp_matches(text, '(?i){x.TEMPORAL}') OR regexp_matches(text, '(?i){x.TEMPORAL_MORE}') OR regexp_matches(text, '\\b(19|20)\\d\\d\\b') AS temporal, regexp_matches(text, '(?i){x.CURRENT}') AS current,
  CASE WHEN regexp_matches(text, '(?i){x.ORDER_FIRST}') THEN 'first' WHEN regexp_matches(text, '(?i){x.ORDER_LAST}') THEN 'last' END AS "order", TRY_CAST(nullif(regexp_extract(text, '\\b((19|20)\\d\\d)\\b', 1), '') AS INTEGER) AS year FROM conversations"""
)
def f14_temporal_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", x.temporal_intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.*")


@query(
    f"""SELECT conv_id, turn, regexp_matches(text, '(?i){x.ERROR}') AS error_query, CASE WHEN regexp_matches(text, '(?i){x.ERROR}') AND turn % 3 = 0 THEN CAST(1.1 AS DOUBLE) ELSE 1.0 END AS boost, CAST(CASE WHEN turn % 4 = 0 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS weight FROM conversations"""
)
def f16_fix_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'fix' ELSE 'fact' END AS kind, CASE turn % 4 WHEN 0 THEN ' Git' ELSE role END AS speaker FROM conversations")
    error = x.is_error_query(F.col("text"))
    return rows.select("conv_id", "turn", error.alias("error_query"), x.fix_boost(F.col("kind"), error).alias("boost"), x.git_weight(F.col("speaker")).alias("weight"))


_CODE = """'call load_page_' || doc_id || '(x) in `Reader.next` of src/doc_' || doc_id || '.py, not ../up.py or /etc/a.sh, see ReadPage and README.md'"""


@query("SELECT doc_id, 'Reader.next,next,load_page_' || doc_id || ',doc_' || doc_id || ',ReadPage' AS identifiers, 'src/doc_' || doc_id || '.py,README.md' AS paths FROM documents")
def f23_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT doc_id, {_CODE} AS s FROM documents")
    return rows.select("doc_id", F.array_join(x.code_identifiers(F.col("s")), ",").alias("identifiers"), F.array_join(x.file_paths(F.col("s")), ",").alias("paths"))


_PATHS = "CASE p_partkey % 7 WHEN 0 THEN './a//b/' || p_partkey || '.py' WHEN 1 THEN '../x' WHEN 2 THEN '/abs/y' WHEN 3 THEN 'a\\\\b.py' WHEN 4 THEN 'dir/' WHEN 5 THEN 'a/./b' ELSE ' s/' || p_partkey || ' ' END"


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'a/b/' || p_partkey || '.py' WHEN 3 THEN 'a/b.py' WHEN 4 THEN 'dir' WHEN 6 THEN 's/' || p_partkey END AS path FROM part")
def f24_clean_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT p_partkey, {_PATHS} AS path FROM part").select("p_partkey", x.clean_path(F.col("path")).alias("path"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/' || p_partkey || '.py:abcdef0:one' WHEN 1 THEN 'b.py:0123456789ab:' END AS anchors FROM part"""
)
def f25_normalize_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(
        spark, sf_dir,
        """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN array(named_struct('file', './a/' || p_partkey || '.py', 'blob_sha', ' ABCDEF0', 'identifiers', array(' one', '', repeat('x', 90))), named_struct('file', 'a/' || p_partkey || '.py', 'blob_sha', 'fffffff', 'identifiers', array('two')))
      WHEN 1 THEN array(named_struct('file', '../no', 'blob_sha', 'abcdef0', 'identifiers', array('n')), named_struct('file', 'b.py', 'blob_sha', '0123456789ab', 'identifiers', cast(null as array<string>)))
      ELSE array(named_struct('file', 'c.py', 'blob_sha', 'xyz', 'identifiers', array('n'))) END AS a FROM part""",
    )
    shown = F.array_join(F.transform(anchors.normalize_anchors(F.col("a")), lambda a: F.concat_ws(":", a.file, a.blob_sha, F.array_join(a.identifiers, "+"))), ";")
    return rows.select("p_partkey", shown.alias("anchors"))


_FILES = "SELECT 'src/doc_' || doc_id || '.py' AS file, 'def load_page_' || doc_id || '(x):' || chr(10) || text AS content FROM documents WHERE doc_id % 3 < 2"


@query(
    f"""WITH f AS ({_FILES}) SELECT doc_id AS id, f.file, sha1('blob ' || strlen(content) || chr(0) || content) AS blob_sha,
  array_to_string(list_filter(['Reader.next', 'next', 'load_page_' || doc_id, 'doc_' || doc_id, 'ReadPage'], lambda w: regexp_matches(content, '\\b' || replace(w, '.', '\\.') || '\\b')), ',') AS identifiers
FROM documents JOIN f ON f.file = 'src/doc_' || doc_id || '.py'"""
)
def j20_extract_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sql(spark, sf_dir, f"SELECT doc_id AS id, {_CODE} AS text FROM documents")
    found = anchors.extract_anchors(texts, _sql(spark, sf_dir, _FILES))
    return found.withColumn("identifiers", F.array_join("identifiers", ","))


_OLD = "SELECT 'src/doc_' || doc_id || '.py' AS file, 'def load_page_' || doc_id || '(x):' || chr(10) || CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'other ' || text ELSE text || chr(10) || 'end' END AS content FROM documents"
_ANCHORS = f"SELECT doc_id AS anchor_id, 'src/doc_' || doc_id || '.py' AS file, CASE doc_id % 8 WHEN 7 THEN ['gone_name'] WHEN 5 THEN [] ELSE ['load_page_' || doc_id] END AS identifiers FROM documents"


@query(
    """SELECT doc_id AS anchor_id, 'src/doc_' || doc_id || '.py' AS file, CASE WHEN doc_id % 3 = 2 THEN 'deleted' ELSE 'modified' END AS reason, CASE WHEN doc_id % 8 = 7 THEN 'gone_name' WHEN doc_id % 8 = 5 THEN '' ELSE 'load_page_' || doc_id END AS identifiers
FROM documents WHERE doc_id % 3 = 2 OR doc_id % 4 > 0"""
)
def j13_code_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _sql(spark, sf_dir, _OLD).withColumn("blob_sha", x.git_blob_sha(F.col("content")))
    named = _sql(spark, sf_dir, _ANCHORS.replace("[", "array(").replace("]", ")")).withColumn("identifiers", F.col("identifiers").cast("array<string>")).join(old.select("file", "blob_sha"), "file")
    return anchors.code_drift(named, _sql(spark, sf_dir, _FILES), old.select("blob_sha", "content")).withColumn("identifiers", F.array_join("identifiers", ","))


_TYPED = "SELECT conv_id, turn, 'author_' || (conv_id % 5) AS author, CASE turn % 4 WHEN 0 THEN 'Fact' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'decision' END AS memory_type, turn % 9 = 0 AS pinned FROM conversations"


@query(f"SELECT conv_id, turn FROM ({_TYPED}) WHERE author IN ('author_1', 'author_3') AND (pinned OR memory_type IN ('Fact', 'decision'))")
def b4_filter_author_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.filter_type(lookups.filter_author(_sql(spark, sf_dir, _TYPED), ["author_1", "author_3"]), ["FACT", "decision"]).select("conv_id", "turn")


@query(f"SELECT conv_id, turn, memory_type IS DISTINCT FROM 'nonsense' AS valid FROM ({_TYPED})")
def b12_valid_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _TYPED).select("conv_id", "turn", x.valid_memory_type(F.col("memory_type")).alias("valid"))


@query("SELECT DISTINCT 'src:' || source || ':' || lang AS child, 'src:' || source AS parent, true AS inside, false AS turned FROM documents")
def b8_is_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT DISTINCT 'src:' || source || ':' || lang AS child, 'src:' || source AS parent FROM documents")
    return rows.select("child", "parent", x.is_ancestor(F.col("parent"), F.col("child")).alias("inside"), x.is_ancestor(F.col("child"), F.col("parent")).alias("turned"))


_EXCHANGES = "SELECT conv_id * 10000 + turn AS id, CASE turn % 6 WHEN 0 THEN '' WHEN 1 THEN '[eval run 5]' WHEN 2 THEN 'keep going now' WHEN 3 THEN '<note>hello there all</note>' WHEN 4 THEN 'too short' ELSE 'tell me about ' || text END AS user_text, CASE turn % 5 WHEN 0 THEN 'ok' ELSE text || repeat('.', 30) END AS reply FROM conversations"


@query(
    f"""WITH r AS (SELECT *, (id % 10000) % 6 AS k, (id % 10000) % 5 AS m FROM ({_EXCHANGES}))
SELECT id, ['empty', 'eval', 'loop', 'tag', 'short', NULL][k + 1] AS reason, k = 5 AS user_kept, m > 0 AND k > 1 AS reply_kept FROM r"""
)
def b15_capture_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.capture_noise(_sql(spark, sf_dir, _EXCHANGES))


_PAST = """SELECT event_id AS id, 'team:' || (user_id % 4) AS namespace, 'user_' || user_id AS subject, 'status' AS predicate, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' ELSE 'c' END AS object,
  CASE WHEN event_id % 5 = 0 THEN 'It was formerly held on 2024-01-10' WHEN event_id % 5 = 1 THEN 'It was formerly held' ELSE 'It holds' END AS statement, ts AS observed_at, CASE WHEN event_id % 9 > 0 THEN ts END AS valid_from FROM events"""


@query(
    f"""WITH f AS ({_PAST}), c AS (SELECT *, TIMESTAMP '2024-01-10' AS at FROM f WHERE id % 5 <> 1),
h AS (SELECT o.id, o.valid_from, c.id AS by, CASE WHEN c.id % 5 = 0 THEN c.at ELSE c.observed_at END AS at, row_number() OVER (PARTITION BY o.id ORDER BY c.observed_at, c.id) AS n FROM f o JOIN c ON o.namespace = c.namespace AND o.subject = c.subject AND o.object <> c.object
  AND (c.observed_at > o.observed_at OR (c.observed_at = o.observed_at AND c.id > o.id)) AND (c.id % 5 > 0 OR o.valid_from IS NULL OR o.valid_from <= c.at))
SELECT f.id, h.by AS superseded_by, CASE WHEN h.by IS NOT NULL THEN greatest(coalesce(f.valid_from, h.at), h.at) END AS valid_to FROM f LEFT JOIN h ON h.id = f.id AND n = 1"""
)
def t4_dated_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.supersede(_sql(spark, sf_dir, _PAST), dated=True).select("id", "superseded_by", "valid_to")


_REVERSED = """SELECT vec_id AS id, 'label:' || label AS namespace, CASE vec_id % 7 WHEN 0 THEN NULL ELSE 'Item ' || (vec_id % 3) END AS subject, CASE vec_id % 6 WHEN 0 THEN 'item deployment alpha is no longer blocked' WHEN 1 THEN 'item deployment alpha blocked' WHEN 2 THEN 'item rests' ELSE 'deployment of alpha waits' END AS statement,
  CAST(vec_id % 97 AS INTEGER) AS observed_at, CASE WHEN vec_id % 10 = 3 THEN 1 END AS valid_to, CAST(NULL AS INTEGER) AS expired_at, embedding FROM embeddings"""


@query(
    f"""WITH f AS (SELECT *, {_SALIENT.format('statement')} AS w, {_SALIENT.format("coalesce(subject, '')")} AS sw FROM ({_REVERSED}) WHERE valid_to IS NULL AND embedding IS NOT NULL),
n AS (SELECT r.id AS rid, r.observed_at AS rat, o.id, o.subject AS os, r.subject AS rs, r.w AS rw, o.w AS ow, r.sw AS rsw, o.sw AS osw, round(1 - {_DOT.format('r.embedding', 'o.embedding')} / (sqrt({_DOT.format('r.embedding', 'r.embedding')}) * sqrt({_DOT.format('o.embedding', 'o.embedding')})), 6) AS distance
  FROM f r JOIN f o ON r.namespace = o.namespace AND (o.observed_at < r.observed_at OR (o.observed_at = r.observed_at AND o.id < r.id)) WHERE r.id % 6 = 0),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, id) <= 8),
h AS (SELECT * FROM k WHERE distance <= 0.95 AND (rs IS NULL OR os IS NULL OR lower(rs) = lower(os)) AND len(list_intersect(rw, ow)) >= 2 AND len(list_filter(list_intersect(rw, ow), lambda z: NOT list_contains(list_concat(rsw, osw), z))) > 0)
SELECT id, rid AS superseded_by, distance FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY rat, rid) = 1"""
)
def t8_close_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a wide reach, as the tables' vectors lie far apart."""
    return similarity.close_reversals(_sql(spark, sf_dir, _REVERSED), reach=0.95)


_VECTOR_FACTS = "SELECT vec_id AS id, 'label:' || label AS namespace, 'item ' || (vec_id % 40) AS subject, CAST(vec_id % 97 AS INTEGER) AS observed_at, embedding, CASE WHEN vec_id % 4 = 0 THEN 'Assistant' ELSE 'user' END AS source_speaker FROM embeddings"
_PAIRS = f"""f AS ({_VECTOR_FACTS}), n AS (SELECT a.id AS older, b.id AS newer, b.observed_at AS seen, round(1 - {_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6) AS distance
  FROM f a JOIN f b ON a.namespace = b.namespace AND a.subject = b.subject AND (a.observed_at < b.observed_at OR (a.observed_at = b.observed_at AND a.id < b.id)))"""


@query(f"""WITH {_PAIRS} SELECT older AS id, arg_min(newer, CAST(seen AS BIGINT) * 1000000000 + newer) AS superseded_by FROM n WHERE distance < 0.7 GROUP BY older""")
def t10_supersede_near_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close-out below a single distance, here a wide one, as the tables' vectors lie far apart."""
    return similarity.supersede_similar(_sql(spark, sf_dir, _VECTOR_FACTS), 0.0, 0.7)


@query(
    f"""WITH {_PAIRS}, m AS (SELECT newer AS id, older AS absorber FROM n WHERE distance < 0.7 QUALIFY row_number() OVER (PARTITION BY newer ORDER BY distance, older) = 1)
SELECT absorber AS id, count(*) AS restatements, count(*) FILTER (WHERE lower(source_speaker) <> 'assistant') AS corroborations, round(least(1.0, 0.5 + 0.1 * count(*)), 6) AS salience FROM m JOIN f ON f.id = m.id GROUP BY absorber"""
)
def t6_corroborations(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _sql(spark, sf_dir, _VECTOR_FACTS)
    return similarity.restatements(facts, similarity.dedupe_older(facts, 0.7))


_SEEDS = "SELECT DISTINCT 's' || l_suppkey AS node FROM lineitem WHERE l_suppkey % 100 = 0"
_FACTS_OF = "SELECT o_orderkey AS id, 's' || (o_custkey % 100) AS key, o_orderdate AS valid_from, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS expired_at FROM orders"


@query(
    oracle(
        f""", b AS (SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), s AS ({_SEEDS}),
r AS (SELECT s.node AS seed, other AS node, max(weight) AS weight FROM s JOIN b ON b.node = s.node GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, node) AS rank FROM r),
f AS (SELECT key AS seed, id, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC, id DESC) AS rank FROM ({_FACTS_OF}) JOIN s ON s.node = key WHERE expired_at IS NULL)
SELECT seed, 'neighbour' AS what, node AS found, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 50 UNION ALL SELECT seed, 'fact', CAST(id AS VARCHAR), CAST(rank AS INTEGER) FROM f WHERE rank <= 20""",
        "edges",
    )
)
def n3_entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _sql(spark, sf_dir, _FACTS_OF)
    related, own = graph.entity_view(_sql(spark, sf_dir, _SEEDS), t.edges(spark, sf_dir), facts.select("key", "id"), facts, 0)
    rows = related.select("seed", F.lit("neighbour").alias("what"), F.col("node").alias("found"), "rank")
    return rows.unionByName(own.select("seed", F.lit("fact").alias("what"), F.col("id").cast("string").alias("found"), "rank"))


_EPISODES = "SELECT CAST(user_id AS BIGINT) AS episode, array_agg(event_id) AS turn_ids FROM (SELECT user_id, event_id FROM events ORDER BY event_id) GROUP BY user_id"


@query(
    oracle(
        """, t AS (SELECT user_id AS episode, event_id AS turn_id FROM events), l AS (SELECT id AS fact_id, unnest(source_turn_ids) AS turn_id FROM facts WHERE expired_at IS NULL)
SELECT CAST(episode AS BIGINT) AS episode, CAST(count(DISTINCT t.turn_id) AS INTEGER) AS n_turns, CAST(count(DISTINCT fact_id) AS INTEGER) AS n_facts, CAST(min(fact_id) AS BIGINT) AS first_fact FROM t LEFT JOIN l USING (turn_id) GROUP BY episode""",
        "facts",
    )
)
def j4_episode_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _sql(spark, sf_dir, "SELECT event_id AS id FROM events")
    facts = t.facts(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    found = lookups.episode_detail(_sql(spark, sf_dir, _EPISODES), turns, facts)
    return found.select("episode", F.size("turns").alias("n_turns"), F.size("facts").alias("n_facts"), F.array_min("facts").alias("first_fact"))


_DOSSIERS = "SELECT s_suppkey AS id, 'ns' || (s_suppkey % 2) AS namespace, upper('nation ' || s_nationkey) AS name, s_suppkey AS created_at FROM supplier"
_LOOKED = "SELECT 'ns' || k AS namespace, 'Nation ' || n_nationkey AS name FROM nation JOIN (SELECT 0 AS k UNION ALL SELECT 1) d ON n_nationkey >= d.k"


@query(f"WITH d AS ({_DOSSIERS}), a AS ({_LOOKED}) SELECT a.namespace, a.name, max(d.id) AS dossier_id FROM a JOIN d ON d.namespace = a.namespace AND lower(d.name) = lower(a.name) GROUP BY ALL")
def j18_get_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_dossier(_sql(spark, sf_dir, _LOOKED), _sql(spark, sf_dir, _DOSSIERS))


@query(
    oracle(
        """, m AS (SELECT DISTINCT namespace, lower(subject) AS key, id FROM facts UNION SELECT namespace, 'formerly', id FROM facts WHERE starts_with(statement, 'Formerly')) SELECT namespace, key, count(*) AS mentions FROM m GROUP BY ALL HAVING count(*) >= 3""",
        "facts",
    )
)
def g18_dossier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.dossier_candidates(graph.mentions_of(t.facts(spark, sf_dir)))


_TOPICS = "SELECT DISTINCT 'team:' || (user_id % 4) AS namespace, '#' || event_type AS channel FROM events"
_SUBSCRIBED = "SELECT DISTINCT 'team:' || (user_id % 4) AS namespace, '#' || event_type AS channel, 'session_' || (user_id % 20) AS session_name FROM events"
_READS = "SELECT CAST(n_nationkey AS INTEGER) AS principal_id, 'team:' || (n_nationkey % 4) AS namespace FROM nation"
_REQUESTS = "SELECT c_custkey AS request_id, CAST(c_nationkey AS INTEGER) AS principal_id, CASE c_custkey % 4 WHEN 0 THEN '#click' WHEN 1 THEN '#clik' WHEN 2 THEN '#Veiw' ELSE '#nothing' END AS channel FROM customer"


@query(
    f"""WITH t AS ({_TOPICS}), s AS ({_SUBSCRIBED}), r AS ({_READS}), q AS ({_REQUESTS}), n AS (SELECT DISTINCT principal_id, channel FROM r JOIN t USING (namespace)),
e AS (SELECT q.*, EXISTS (SELECT 1 FROM n WHERE n.principal_id = q.principal_id AND n.channel = q.channel) AS existed FROM q),
m AS (SELECT request_id, list_sort(list(n.channel)) AS alike FROM e JOIN n USING (principal_id) WHERE NOT existed AND n.channel <> '#general' AND levenshtein(lower(e.channel), lower(n.channel)) BETWEEN 1 AND 2 GROUP BY request_id),
c AS (SELECT request_id, count(DISTINCT session_name) AS subscribers FROM e JOIN r USING (principal_id) JOIN s ON s.namespace = r.namespace AND s.channel = e.channel WHERE existed GROUP BY request_id)
SELECT request_id, channel, existed, coalesce(array_to_string(alike, ','), '') AS "similar", coalesce(subscribers, 0) AS subscribers FROM e LEFT JOIN m USING (request_id) LEFT JOIN c USING (request_id)"""
)
def g29_topic_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.topic_census(_sql(spark, sf_dir, _REQUESTS), _sql(spark, sf_dir, _TOPICS), _sql(spark, sf_dir, _READS), _sql(spark, sf_dir, _SUBSCRIBED))


@query(
    """WITH e AS (SELECT 'p' || p_partkey AS name, p_partkey % 3 > 0 AS has FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), true FROM part WHERE p_partkey % 10 = 0), g AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), d AS (SELECT p AS name, count(*) AS d FROM g GROUP BY p)
SELECT round(avg(CASE WHEN coalesce(d, 0) = 1 THEN 1.0 ELSE 0.0 END), 6) AS leaf_share, round(avg(CASE WHEN starts_with(name, 'p') THEN 0.0 ELSE 1.0 END), 6) AS literal_share, round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END), 6) AS embedded_share FROM e LEFT JOIN d USING (name)"""
)
def g6_name_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _sql(spark, sf_dir, "SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 3 > 0 THEN 1 END AS embedding FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 1 FROM part WHERE p_partkey % 10 = 0")
    return graph.name_quality(entities, t.edges(spark, sf_dir))


_INGESTS = "SELECT 'src:' || source || ':' || lang AS namespace, 'doc ' || (doc_id % 9) AS name, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS kind, sha1(CAST(doc_id AS STRING)) AS git_sha, n_chars AS constraint_count, doc_id % 50 AS ingested_at, doc_id AS id FROM documents"


@query(f"WITH i AS ({_INGESTS}) SELECT namespace, name, kind, git_sha, constraint_count, ingested_at FROM i QUALIFY row_number() OVER (PARTITION BY namespace, name ORDER BY ingested_at DESC, id DESC) = 1")
def a12_corpus_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.corpus_sources(_sql(spark, sf_dir, _INGESTS))


@query(
    f"""WITH i AS (SELECT DISTINCT namespace, name FROM ({_INGESTS})), c AS (SELECT 'src' AS namespace UNION ALL SELECT DISTINCT 'src:' || source FROM documents)
SELECT c.namespace, i.namespace AS descendant, count(*) AS docs FROM c JOIN i ON starts_with(i.namespace, c.namespace || ':') GROUP BY ALL"""
)
def a13_corpus_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _sql(spark, sf_dir, "SELECT 'src' AS namespace UNION ALL SELECT DISTINCT 'src:' || source FROM documents")
    return tables.corpus_descendants(tables.corpus_sources(_sql(spark, sf_dir, _INGESTS)), changed).select("namespace", "descendant", "docs")


_COPIES = "SELECT o_orderkey AS id, 'ns' || (o_custkey % 7) AS dst_ns, 'ns' || (o_custkey % 5) AS src_ns, o_orderstatus AS mode, o_orderdate AS copied_at FROM orders"


@query(
    f"""WITH l AS ({_COPIES}), s AS (SELECT l.*, dst_ns AS namespace FROM l UNION SELECT l.*, src_ns FROM l)
SELECT namespace, id, mode, CAST(row_number() OVER (PARTITION BY namespace ORDER BY copied_at DESC, id DESC) AS INTEGER) AS rank FROM s WHERE namespace IN (SELECT 'ns' || n_nationkey FROM nation)"""
)
def a21_copy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.copy_log(_sql(spark, sf_dir, _COPIES), _sql(spark, sf_dir, "SELECT 'ns' || n_nationkey AS namespace FROM nation")).select("namespace", "id", "mode", "rank")


@query("SELECT conv_id * 10000 + turn AS id FROM conversations WHERE conv_id % 4 <> 2")
def a22_purge_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.purge_namespace(t.turns(spark, sf_dir), "team:2").select("id")


@query("SELECT s_suppkey AS id, s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 AS consolidated FROM supplier")
def e5_mark_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN true WHEN s_suppkey % 4 = 1 THEN false END AS consolidated FROM supplier")
    return ep.mark_consolidated(rows, _sql(spark, sf_dir, "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 6")).select("id", "consolidated")


@query("SELECT DISTINCT conv_id % 10 AS conversation, role AS user_text, substr(text, 1, 5) AS reply FROM conversations")
def h14_dedupe_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.dedupe_exchanges(_sql(spark, sf_dir, "SELECT conv_id % 10 AS conversation, role AS user_text, substr(text, 1, 5) AS reply FROM conversations"))


@query("SELECT event_id AS item_id, TIMESTAMP '2024-03-01' AS observed_at, coalesce(CASE WHEN event_id % 5 > 0 THEN ts END, TIMESTAMP '2024-03-01') AS event_at FROM events")
def h10_observed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = _sql(spark, sf_dir, "SELECT event_id AS item_id, CASE WHEN event_id % 5 > 0 THEN ts END AS queued_at FROM events")
    return feeds.observed_writes(writes, F.expr("timestamp_ntz'2024-03-01 00:00:00'")).select("item_id", "observed_at", "event_at")


@query()
def h7_lease_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential state; a test compares it with a simulation."""
    events = _sql(spark, sf_dir, "SELECT 'team:' || (user_id % 4) AS namespace, event_type AS key, 'session_' || (user_id % 20) AS holder, CASE event_id % 4 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'release' ELSE 'acquire' END AS action, ts, event_id AS id FROM events")
    return feeds.lease_spans(events)


_NEAR = "SELECT vec_id DIV 10 AS query_id, vec_id AS id, label AS score, vec_id AS observed_at, embedding, 'c' || (vec_id % 7) AS content FROM embeddings"


@query(
    f"""WITH RECURSIVE c AS (SELECT vec_id // 10 AS query_id, vec_id AS id, label AS score, vec_id AS seen, embedding, 'c' || (vec_id % 7) AS content FROM embeddings),
s AS (SELECT *, count(*) OVER (PARTITION BY query_id, content) AS n FROM c QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY score DESC, seen DESC, id) = 1),
p AS (SELECT a.query_id, a.id AS a, b.id AS b FROM s a JOIN s b ON a.query_id = b.query_id WHERE round(1 - {_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6) < 0.8 OR a.id = b.id),
r AS (SELECT query_id, a, b FROM p UNION SELECT r.query_id, r.a, p.b FROM r JOIN p ON p.a = r.b), l AS (SELECT query_id, a AS id, min(b) AS label FROM r GROUP BY ALL)
SELECT query_id, id, CAST(sum(n) OVER (PARTITION BY query_id, label) AS BIGINT) AS dup_count FROM s JOIN l USING (query_id, id) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, seen DESC, id) = 1"""
)
def v10_near_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten candidates a query; near here is wide, as the tables' vectors lie far apart."""
    found = retrieval.dedupe_near(_sql(spark, sf_dir, _NEAR), x.norm_content(F.col("content")), below=0.8)
    return found.select("query_id", "id", "dup_count")


@query("""WITH r AS (SELECT lang AS key, doc_id, n_chars FROM documents) SELECT key, doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 5""")
def s2_top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT lang AS key, doc_id, n_chars FROM documents")
    return retrieval.rank_in(rows, ["key"], [F.desc("n_chars"), F.col("doc_id")], 5).select("key", "doc_id", "rank")


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS INTEGER) AS rank FROM events""")
def s1_rank_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT user_id, event_id, value FROM events")
    return retrieval.rank_in(rows, ["user_id"], [F.col("value"), F.col("event_id")]).select("user_id", "event_id", "rank")


@query(
    """WITH m AS (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY e.ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m JOIN events e USING (user_id, event_id)"""
)
def s9_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _sql(spark, sf_dir, "SELECT user_id, event_id, event_type, ts FROM events")
    changes = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) != F.col("event_type")
    return ep.islands(rows, ["user_id"], ["ts", "event_id"], changes).select("user_id", "event_id", "island")


@query(
    oracle(
        f""", b AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges), s AS ({_SEEDS}),
r1 AS (SELECT s.node AS seed, other AS node FROM s JOIN b ON b.node = s.node), r2 AS (SELECT seed, other AS node FROM r1 JOIN b ON b.node = r1.node),
r AS (SELECT node AS seed, node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM r1 UNION ALL SELECT seed, node, 2 FROM r2), m AS (SELECT seed, node, min(hop) AS hop FROM r GROUP BY ALL)
SELECT seed, f.id, min(hop) AS hop FROM m JOIN ({_FACTS_OF}) f ON f.key = m.node WHERE expired_at IS NULL GROUP BY ALL""",
        "edges",
    )
)
def n2_expand_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that mention what two hops reach."""
    facts = _sql(spark, sf_dir, _FACTS_OF).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return graph.expand_facts(graph.expand(_sql(spark, sf_dir, _SEEDS), t.edges(spark, sf_dir), 2), facts.select("key", "id"), facts)


_CLAIMS = "SELECT vec_id AS claim_id, 'label:' || label AS namespace, 'the value is o' || (vec_id % 3) AS claim, embedding FROM embeddings WHERE vec_id % 100 = 0"
_OBJECTS = "SELECT vec_id AS id, 'label:' || label AS namespace, 'o' || (vec_id % 3) AS object, embedding FROM embeddings"


@query(
    f"""WITH c AS ({_CLAIMS}), f AS ({_OBJECTS}), n AS (SELECT claim_id, f.id AS fact_id, claim, object, round(1 - {_DOT.format('c.embedding', 'f.embedding')} / (sqrt({_DOT.format('c.embedding', 'c.embedding')}) * sqrt({_DOT.format('f.embedding', 'f.embedding')})), 6) AS distance FROM c JOIN f ON c.namespace = f.namespace),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY distance, fact_id) <= 8)
SELECT claim_id, fact_id, distance, CASE WHEN contains(claim, object) THEN 'agrees' ELSE 'related' END AS verdict FROM k WHERE distance < 0.9"""
)
def j15_claims_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector arm, with a wide reach, as the tables' vectors lie far apart; one claim in a hundred asks."""
    return lookups.check_claims_near(_sql(spark, sf_dir, _CLAIMS), _sql(spark, sf_dir, _OBJECTS), 0.9)


_SPOKEN = "SELECT conv_id * 10000 + turn AS diff_id, text AS diff FROM conversations"
_HELD = "SELECT item_id AS constraint_id, text AS statement FROM benchmark"


@query(
    f"""WITH d AS (SELECT conv_id * 10000 + turn AS diff_id, text AS diff, greatest(1, ceil((length(text) - 20) / 100.0)) AS n FROM conversations), w AS (SELECT diff_id, CAST(k AS INTEGER) AS "window", substr(diff, CAST(k * 100 + 1 AS BIGINT), 120) AS text FROM d, unnest(generate_series(0, CAST(n AS BIGINT) - 1)) AS s(k)),
ww AS (SELECT DISTINCT diff_id, "window", unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda z: lower(z))) AS word FROM w), cw AS (SELECT DISTINCT item_id AS constraint_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda z: lower(z))) AS word FROM benchmark),
s AS (SELECT diff_id, "window", constraint_id, count(*) AS n FROM ww JOIN cw USING (word) WHERE word NOT IN ({_SQL_LIST(x.DIFF_STOP)}) GROUP BY ALL HAVING count(*) >= 2)
SELECT diff_id, constraint_id, min("window") AS first_window, max(n) AS words FROM s GROUP BY ALL"""
)
def v26_drift_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of each turn against the texts that are held."""
    t.table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    windows = corpus.drift_windows(_sql(spark, sf_dir, _SPOKEN), 120, 20, None)
    return corpus.drift_matches(windows, _sql(spark, sf_dir, _HELD))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'load_page_' || doc_id ELSE 'load_page_' || doc_id END AS touched FROM documents"""
)
def j14_touched_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of the first line below a header, or of the end of its file, touches the header's name."""
    old = _sql(spark, sf_dir, _OLD.replace("SELECT ", "SELECT doc_id, 'def load_page_' || doc_id || '(x):' || chr(10) || text AS now, ", 1))
    names = F.array(F.concat(F.lit("load_page_"), F.col("doc_id").cast("string")), F.lit("absent_name"))
    changes = old.select("doc_id", F.col("content").alias("old"), F.col("now").alias("new"), names.alias("names"))
    touched = anchors.touched_names(changes, ["doc_id"])
    return old.join(touched, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("touched", ","), F.lit("")).alias("touched"))


_FLOW = """'sequenceDiagram' || chr(10) || 'participant A as Client ' || doc_id || chr(10) || '%% note' || chr(10) || 'A->>B: hello ' || doc_id || chr(10) || 'box Blue' || chr(10) || 'alt ok' || chr(10) || 'B-->>A: fine' || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN 'else' WHEN 1 THEN 'else not ok' ELSE 'opt maybe' END || chr(10) || 'Note over B: it must not leak' || chr(10) || CASE WHEN doc_id % 3 = 2 THEN 'end' || chr(10) ELSE '' END || 'end' || chr(10)
  || 'end' || chr(10) || 'loop again' || chr(10) || 'A->>B: never' || chr(10) || 'alt x' || chr(10) || 'A->>B: nor this' || chr(10) || 'end' || chr(10) || 'end' || chr(10) || 'end' || chr(10) || 'B-xA: bye'"""


@query(
    """SELECT doc_id AS diagram, unnest(list_filter(['Client ' || doc_id || ' SHALL send "hello ' || doc_id || '" to B.', 'When ok, B SHALL send "fine" to Client ' || doc_id || '.',
  CASE doc_id % 3 WHEN 0 THEN 'When otherwise, it must not leak.' WHEN 1 THEN 'When not ok, it must not leak.' END, 'B SHALL send "bye" to Client ' || doc_id || '.'], lambda s: s IS NOT NULL)) AS statement FROM documents"""
)
def a14_flow_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flow_constraints(_sql(spark, sf_dir, f"SELECT doc_id AS diagram, {_FLOW} AS text FROM documents")).select("diagram", "statement")


@query()
def v2_vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours by cells of a fitted sample; a test measures the recall."""
    vectors = t.vectors(spark, sf_dir)
    asked = vectors.where("id % 100 = 0").selectExpr("id as query_id", "namespace", "embedding")
    return retrieval.vector_topk_cells(asked, vectors, 10, retrieval.vector_cells(vectors, 32), 20)


@query()
def v2_vector_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours by codes of the vectors' parts; a test measures the recall and how many vectors are read."""
    vectors = t.vectors(spark, sf_dir)
    asked = vectors.where("id % 100 = 0").selectExpr("id as query_id", "namespace", "embedding")
    books = retrieval.vector_codebooks(vectors)
    return retrieval.vector_topk_codes(asked, retrieval.vector_codes(vectors, books), vectors, 10, books)


_SIGNED = "text || CASE turn % 3 WHEN 0 THEN chr(10) || 'Signed-off-by: Ann ' || turn WHEN 1 THEN ' see issue ' || turn || ' and PR #7' ELSE '' END || ' in v1.' || turn || '.0 '"


@query(
    """SELECT conv_id * 10000 + turn AS id, unnest(CASE turn % 3 WHEN 0 THEN ['Git trailer Signed-off-by: Ann ' || turn || ' in v1.' || turn || '.0'] WHEN 1 THEN ['References issue #' || turn, 'References PR #7'] ELSE [] END || ['Mentions version 1.' || turn || '.0']) AS statement FROM conversations"""
)
def u2_extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.extract_facts(_sql(spark, sf_dir, f"SELECT conv_id * 10000 + turn AS id, {_SIGNED} AS text FROM conversations")).select("id", "statement")
