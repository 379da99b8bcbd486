"""The steps of a recall between the arms and the rendered context, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import entity_match, entity_phrases, extract_entities, fix_boost, git_weight, is_error_query, query_intent, temporal_intent
from factlake.operators.retrieval import BROADCAST_QUERIES, rank_in
from factlake.sources.shared import stored


def prefetch_arms(queries: DataFrame, facts: DataFrame, timeline_limit: int = 12, guarantee_limit: int = 20) -> DataFrame:
    """Facts that a query is given by its entities and not by likeness: ``(query_id, id, arm, rank)``.

    A question about time gets the ``timeline`` of its entities, earliest first unless it asks for the
    last, within its year, and only current facts where it asks how things stand and names no year. Any
    other question that names entities gets the latest current facts about them (``guarantee``).
    ``queries(query_id, namespace, text)``; a fact is about an entity that is its subject or stands in its statement.

    The order depends on time alone, so each word that is asked for has one list for each choice of facts (all,
    current, those of a year) and direction, as long as the larger limit; questions meet lists, not facts.
    """
    intent = temporal_intent(F.col("text"))
    asked = queries.select("query_id", "namespace", intent.alias("i"), F.explode(extract_entities(F.col("text"))).alias("entity"))
    late = ~F.col("i.temporal") | F.coalesce(F.col("i.order") == "last", F.lit(False))
    choice = F.when(F.col("i.temporal") & F.col("i.year").isNotNull(), F.col("i.year").cast("string")).when(F.col("i.temporal") & ~F.col("i.current"), "all").otherwise("current")
    asked = asked.select("query_id", "namespace", F.lower("entity").alias("word"), choice.alias("choice"), late.alias("late"), "i.temporal").distinct()
    wanted = asked.select("namespace", "word", "choice", "late").distinct()
    few = wanted.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    sized = lambda df: F.broadcast(df) if few else df
    words = F.array_distinct(F.concat(F.array(F.lower("subject")), F.split(F.lower("statement"), r"[^\p{L}\p{N}_]+")))
    choices = F.array(F.lit("all"), F.when(F.col("valid_to").isNull(), "current"), F.year("valid_from").cast("string"))
    seconds = F.col("observed_at").cast("timestamp").cast("double")
    named = facts.where("expired_at is null").select("namespace", "id", seconds.alias("at"), choices.alias("choices"), F.explode(words).alias("word"))
    named = named.join(sized(wanted.select("namespace", "word").distinct()), ["namespace", "word"], "left_semi").withColumn("choice", F.explode("choices")).drop("choices")
    rows = named.join(sized(wanted), ["namespace", "word", "choice"])
    order = [F.when(F.col("late"), -F.col("at")).otherwise(F.col("at")), F.when(F.col("late"), -F.col("id")).otherwise(F.col("id"))]
    lists = rank_in(rows, ["namespace", "word", "choice", "late"], order, max(timeline_limit, guarantee_limit)).drop("rank")
    found = lists.join(sized(asked), ["namespace", "word", "choice", "late"]).select("query_id", "id", "at", "temporal", "late").distinct()
    ranked = rank_in(found, ["query_id"], order)
    kept = ranked.where(F.col("rank") <= F.when(F.col("temporal"), timeline_limit).otherwise(guarantee_limit))
    return kept.select("query_id", "id", F.when(F.col("temporal"), "timeline").otherwise("guarantee").alias("arm"), "rank")


def mark_stale(turns: DataFrame, stale: DataFrame) -> DataFrame:
    """Add ``superseded`` and ``superseded_at`` to retrieved turns ``(…, id)`` by ``stale(id, closed_at)``."""
    marks = stale.select("id", F.col("closed_at").alias("superseded_at"), F.lit(True).alias("superseded"))
    return turns.join(marks, "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def demote_stale(rows: DataFrame, facts_lead: Column) -> DataFrame:
    """Order of a query's rows ``(query_id, kind, superseded, rank, id)``: fresh turns and facts, whichever lead, then stale turns."""
    fact = F.col("kind") == "fact"
    group = F.when(~fact & F.col("superseded"), 2).when(fact == facts_lead, 0).otherwise(1)
    return rank_in(rows.withColumn("__g", group), ["query_id"], [F.col("__g"), F.col("rank"), F.col("id")], None, "position").drop("__g")


def shape_scores(
    cands: DataFrame, queries: DataFrame, length_penalty: float = 0.15, salience_boost: float = 0.05, fact_preference: float = 0.06, entity_boost: float = 0.12
) -> DataFrame:
    """Add ``shaped`` to ``cands(query_id, id, kind, content, score, subject, restatements, salience, memory_type, speaker)``.

    Long turns lose, restated and salient facts gain up to a quarter, facts gain a little unless the
    question asks for words as said, and facts about the question's entities gain while those about a
    competing subject lose. Fixes gain on error questions; a commit log's lines count less.
    """
    text = F.col("q_text")
    phrases = F.transform(entity_phrases(text), F.lower)
    singles = F.transform(extract_entities(text), F.lower)
    asked = queries.select("query_id", F.col("text").alias("q_text"))
    asked = asked.select("query_id", query_intent(text).alias("intent"), is_error_query(text).alias("errors"), F.when(F.size(phrases) > 0, phrases).otherwise(singles).alias("wanted"))
    rows = cands.join(asked, "query_id")
    fact, turn = F.col("kind") == "fact", F.col("kind") == "turn"
    subject = F.lower(F.trim(F.coalesce("subject", F.lit(""))))
    bound = F.filter(F.concat(F.array(subject), F.transform(extract_entities(F.col("content")), F.lower)), lambda e: e != "")
    about = F.exists("wanted", lambda w: F.exists(bound, lambda e: entity_match(w, e)))
    subject_fits = F.exists("wanted", lambda w: entity_match(w, subject))
    active = (F.col("intent") != "verbatim") & (F.size("wanted") > 0) & F.lit(entity_boost > 0)
    gain = 1.0 + min(0.20, entity_boost)
    entity = F.when(~active, 1.0).when(about, gain).when((subject != "") & ~subject_fits, 1.0 / gain).otherwise(1.0)
    shaped = F.col("score")
    shaped = shaped / F.when(turn, 1.0 + length_penalty * F.greatest(F.lit(0.0), F.log(F.greatest(F.length("content"), F.lit(1)) / 400.0))).otherwise(1.0)
    reinforced = F.log1p(F.coalesce("restatements", F.lit(0)).cast("double")) + F.greatest(F.lit(0.0), F.coalesce("salience", F.lit(0.0)) - 0.5)
    shaped = shaped * F.when(fact, 1.0 + F.least(F.lit(0.25), salience_boost * reinforced)).otherwise(1.0)
    shaped = shaped * F.when(fact & (F.col("intent") != "verbatim"), 1.0 + min(0.10, fact_preference)).otherwise(1.0)
    shaped = shaped * F.when(fact, entity).otherwise(1.0)
    shaped = shaped * fix_boost(F.col("memory_type"), F.col("errors")) * git_weight(F.col("speaker"))
    return rows.withColumn("shaped", shaped).drop("intent", "errors", "wanted")


def temporal_search(ranked: DataFrame, windows: DataFrame, facts: DataFrame, k: int = 40, ends: int = 6) -> DataFrame:
    """The hybrid arm, then facts of the query's window, then the first or last ``ends`` facts; each fact once, by its first arm.

    ``ranked(query_id, id, rank)``; ``windows(query_id, namespace, start, end, order)`` with ``order`` asc,
    desc or null and a half-open window or nulls. Returns ``(query_id, id, arm, position)``. Facts of a window are
    found once for all queries of a namespace that ask for it, and each such list goes to its queries.
    """
    dated = facts.where("expired_at is null and valid_from is not null").select("namespace", "id", "valid_from", "valid_to")
    hybrid = ranked.select("query_id", "id", F.lit(0).alias("arm"), "rank")
    bounded = windows.where("start is not null and end is not null").select("query_id", "namespace", "start", "end")
    spans = stored(bounded.select("namespace", "start", "end").distinct())
    few = spans.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    sized = lambda df: F.broadcast(df) if few else df
    lists = dated.join(sized(spans), "namespace").where("valid_from >= start and valid_from < end")
    lists = rank_in(lists, ["namespace", "start", "end"], [F.col("valid_from"), F.col("id")], k).select("namespace", "start", "end", "id", "valid_from")
    inside = rank_in(bounded.join(sized(lists), ["namespace", "start", "end"]), ["query_id"], [F.col("valid_from"), F.col("id")], k).select("query_id", "id", F.lit(1).alias("arm"), "rank")
    # the ends of a namespace are few and found once, whoever asks
    per_ns = lambda order, name: rank_in(dated, ["namespace"], order, ends).select("namespace", "id", F.lit(name).alias("order"), "rank")
    edges = per_ns([F.col("valid_from"), F.col("id")], "asc").unionByName(per_ns([F.desc("valid_from"), F.desc("id")], "desc"))
    last = windows.select("query_id", "namespace", "order").join(edges, ["namespace", "order"]).select("query_id", "id", F.lit(2).alias("arm"), "rank")
    first = hybrid.unionByName(inside).unionByName(last).groupBy("query_id", "id").agg(F.min(F.struct("arm", "rank")).alias("f"))
    rows = rank_in(first.select("query_id", "id", "f.*"), ["query_id"], [F.col("arm"), F.col("rank"), F.col("id")], None, "position")
    name = F.element_at(F.array(F.lit("hybrid"), F.lit("window"), F.lit("ends")), F.col("arm") + 1)
    return rows.select("query_id", "id", name.alias("arm"), "position")


def recall_wide(scored: DataFrame, readable: DataFrame, askers: DataFrame, per_kind: int = 60) -> DataFrame:
    """Candidates of all namespaces that the asker may read, the best ``per_kind`` of each kind by score, ranked over all.

    ``scored(query_id, namespace, kind, id, score)``, ``readable(principal_id, namespace)``, ``askers(query_id, principal_id)``.
    """
    may = askers.join(readable.select("principal_id", "namespace").distinct(), "principal_id").select("query_id", "namespace")
    kept = rank_in(scored.join(may, ["query_id", "namespace"]), ["query_id", "kind"], [F.desc("score"), F.col("namespace"), F.col("id")], per_kind, "__n").drop("__n")
    return rank_in(kept, ["query_id"], [F.desc("score"), F.col("kind"), F.col("namespace"), F.col("id")])


def recall_grounded(scored: DataFrame, askers: DataFrame, grounded: DataFrame) -> DataFrame:
    """Candidates of the asked namespace and of the linked ones that the asker may read, merged before one ranking.

    ``askers(query_id, principal_id, namespace)``; ``grounded(principal_id, src_ns, dst_ns, state)`` as of the link check.
    """
    linked = askers.withColumnRenamed("namespace", "src_ns").join(grounded.where("state = 'used'"), ["principal_id", "src_ns"])
    sources = askers.select("query_id", "namespace").unionByName(linked.select("query_id", F.col("dst_ns").alias("namespace"))).distinct()
    return rank_in(scored.join(sources, ["query_id", "namespace"]), ["query_id"], [F.desc("score"), F.col("kind"), F.col("namespace"), F.col("id")])


def dual_retrieve(cands: DataFrame, now: Column, top_k: int = 12, decay: float = 0.03, floor: float = 0.3, semantic: float = 0.6) -> DataFrame:
    """Episodes fade with age down to ``floor``; facts are weighed by ``semantic`` with a mild nudge for recent ones.

    ``cands(query_id, id, kind, relevance, at)``; a missing time counts as now.
    """
    seconds = lambda c: c.cast("timestamp").cast("double")
    age = F.greatest(F.lit(0.0), (seconds(now) - seconds(F.coalesce("at", now))) / 86400.0)
    recency = F.exp(-decay * age)
    weight = F.when(F.col("kind") == "episodic", floor + (1 - floor) * recency).otherwise(semantic * (0.85 + 0.15 * recency))
    rows = cands.withColumn("final", F.round(F.col("relevance") * weight, 9))
    return rank_in(rows, ["query_id"], [F.desc("final"), F.col("kind"), F.col("id")], top_k)


def recall_scope(results: DataFrame, searched: DataFrame, readable: DataFrame) -> DataFrame:
    """What a recall covered: rows found, namespaces searched, and others that the asker could read, with a hint if there are any.

    ``results(query_id, …)``, ``searched(query_id, principal_id, namespace)``, ``readable(principal_id, namespace)``.
    """
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    names = searched.groupBy("query_id", "principal_id").agg(F.array_sort(F.collect_set("namespace")).alias("searched"))
    others = names.join(readable, "principal_id").where(~F.array_contains("searched", F.col("namespace"))).groupBy("query_id").agg(F.array_sort(F.collect_set("namespace")).alias("others"))
    rows = names.join(found, "query_id", "left").join(others, "query_id", "left").fillna(0, ["found"])
    hint = F.when(F.size("others") > 0, F.concat(F.lit("results scoped to "), F.array_join("searched", ", "), F.lit("; also readable: "), F.array_join("others", ", ")))
    return rows.select("query_id", "found", F.size("searched").alias("n_searched"), F.coalesce(F.size("others"), F.lit(0)).alias("n_others"), hint.alias("hint"))


def explain_log(results: DataFrame, recalls: DataFrame, pinned: int = 50, ranked: int = 30, recent: int = 50) -> DataFrame:
    """Of the last ``recent`` recalls of a namespace the first rows shown: ``results(query_id, position, pinned, …)``, ``recalls(query_id, namespace, ts)``."""
    last = rank_in(recalls, ["namespace"], [F.desc("ts"), F.desc("query_id")], recent, "__n").select("query_id", "namespace")
    rows = rank_in(results.join(last, "query_id"), ["query_id", "pinned"], [F.col("position")], None, "__n")
    return rows.where(F.col("__n") <= F.when(F.col("pinned"), pinned).otherwise(ranked)).drop("__n")


def corpus_check(hits: DataFrame, constraints: DataFrame, searched: DataFrame, status: Column, k: int = 20, per_namespace: int = 50) -> DataFrame:
    """Constraints that a snippet touches, with a fair share for each namespace it is checked against.

    ``hits(query_id, namespace, id, score)`` come from a match of any of the snippet's words, ``constraints(id,
    namespace, since, …)`` hold what ``status`` looks at; a null status leaves a row out. ``searched(query_id,
    namespace, depth)`` ranks namespaces by how specific they are. What a namespace leaves of its share
    goes to the best of the rest.
    """
    found = hits.join(searched, ["query_id", "namespace"]).join(constraints.drop("namespace"), "id").withColumn("status", status).where("status is not null")
    kept = rank_in(found, ["query_id", "namespace"], [F.desc("score"), F.col("id")], per_namespace, "__n")
    share = kept.withColumn("__levels", F.size(F.collect_set("namespace").over(Window.partitionBy("query_id"))))
    inside = (F.col("__n") <= F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("__levels")))).cast("int")
    order = [F.desc(inside), F.desc("score"), F.col("depth"), F.col("id")]
    return rank_in(share.withColumn("__in", inside), ["query_id"], order, k).select("query_id", "id", "namespace", "status", "score", "rank")
