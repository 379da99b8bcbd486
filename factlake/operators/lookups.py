"""Lookups that join one table's keys to another's rows, and filters of captured exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.predicates import has
from factlake.operators.retrieval import vector_topk

# Signs of an identifier in a statement; predicates of an assistant's facts that are dropped or kept, its own names, and signs of a hard fact.
DROP_PREDICATES = ("did_activity", "did", "performed", "performed_activity", "activity", "worked_on", "met_person", "met", "visited", "likes", "enjoys", "hobby", "experienced", "feels")
HIGH_PREDICATES = ("decided", "status", "result", "root_cause", "version", "deployed_version", "merged_as", "fixed_in", "is_blocked_by", "identifier")
SELF = ("assistant", "the assistant", "agent", "the agent", "ai", "i", "me", "we", "bot", "model")
IDENT = r"(#\d+|\b[A-Z][A-Z0-9]+-\d+\b|\bv?\d+\.\d+(?:\.\d+)*\b|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,40}\b|https?://|\bhost\d+\b|:\d{2,5}\b|\b(?:PR|MR|issue|ticket)\s*#?\d+\b)"
STATE = (
    r"\b(deployed|merged|released|shipped|fixed|reverted|rolled back|broken|blocked|unblocked|is now|are now|now (?:uses|runs|points|lives|returns)|switched to|no longer|"
    r"decided|chose|chosen|root cause|pass(?:es|ed|ing)?|fail(?:s|ed|ing)?|green|resolved|migrated|upgraded|downgraded|deprecated)\b"
)


def provenance_of(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """Each fact with its source turns in their order: ``(id, turns)``."""
    links = facts.select("id", F.posexplode("source_turn_ids").alias("n", "turn_id"))
    found = links.join(turns.select(F.col("id").alias("turn_id"), "speaker", "text"), "turn_id")
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "turn_id", "speaker"))), lambda t: F.struct(t.turn_id.alias("turn_id"), t.speaker.alias("speaker"))).alias("turns"))


def latest_deviation(constraints: DataFrame, deviations: DataFrame) -> DataFrame:
    """The newest deviation of each constraint, if there is one."""
    last = deviations.groupBy("constraint_id").agg(F.max_by(F.struct("until", "id"), F.struct("created_at", "id")).alias("d"))
    return constraints.join(last, "constraint_id", "left").select(*constraints.columns, F.col("d.until").alias("deviation_until"), F.col("d.id").alias("deviation_id"))


def session_for_cwd(sessions: DataFrame, at: Column) -> DataFrame:
    """The latest session of each (host, cwd) that is live at a time."""
    live = sessions.where((F.col("last_seen") <= at) & (F.col("last_seen") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_seconds")) > at))
    return live.groupBy("host", "cwd").agg(F.max_by("name", F.struct("last_seen", "name")).alias("session"))


def check_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims against live facts of their subject (and predicate, if they name one): conflict where the claim lacks the fact's object."""
    keyed = claims.withColumn("k", F.lower("subject")).join(facts.select(F.lower("subject").alias("k"), F.col("predicate").alias("fact_predicate"), "object", F.col("id").alias("fact_id")), "k")
    named = keyed.where(F.col("predicate").isNull() | (F.lower("predicate") == F.lower("fact_predicate")))
    return named.select("claim_id", "fact_id", F.when(F.contains(F.lower("claim"), F.lower("object")), "agrees").otherwise("conflict").alias("verdict"))


def entity_clusters(mentions: DataFrame, least: int) -> DataFrame:
    """Memories of entities that at least so many mention: ``mentions(entity, memory)``."""
    return mentions.groupBy("entity").agg(F.array_sort(F.collect_set("memory")).alias("memories")).where(F.size("memories") >= least)


def role_census(roles: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    m = members.groupBy("role_id").agg(F.countDistinct("principal_id").alias("members"))
    g = grants.groupBy("role_id").agg(F.count(F.lit(1)).alias("grants"))
    return roles.select("role_id").join(m, "role_id", "left").join(g, "role_id", "left").fillna(0, ["members", "grants"])


def host_registry(checkins: DataFrame) -> DataFrame:
    """When each machine of a principal was last seen, and the last name it gave."""
    named = F.max_by(F.col("name"), F.when(F.col("name").isNotNull(), F.struct("ts", "id")))
    return checkins.groupBy("principal_id", "machine").agg(F.max("ts").alias("last_seen"), named.alias("name"))


def capture_noise(exchanges: DataFrame) -> DataFrame:
    """Why a captured exchange is skipped, by the first reason: ``exchanges(id, user_text, reply)``; a reply is cut at 8,000 letters."""
    u = F.trim(F.coalesce("user_text", F.lit("")))
    words = F.size(F.split(u, r"\s+"))
    reason = (
        F.when(u == "", "empty").when(has(u, r"^\[?eval"), "eval").when(has(u, r"^(continue|keep going|proceed)\b.{0,20}$"), "loop").when(u.startswith("<"), "tag")
        .when((F.length(u) < 15) | (words < 3), "short")
    )
    reply = F.substring(F.trim(F.coalesce("reply", F.lit(""))), 1, 8000)
    return exchanges.select("id", reason.alias("reason"), reason.isNull().alias("user_kept"), ((F.length(reply) >= 30) & ~F.coalesce(reason.isin("empty", "eval"), F.lit(False))).alias("reply_kept"))


def capture_stats(noise: DataFrame) -> DataFrame:
    return noise.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("user_kept").alias("users"), F.count_if("reply_kept").alias("replies"))


def capture_gate(exchanges: DataFrame, denied: str, least_tokens: int) -> DataFrame:
    """Whether a relayed exchange is captured, and else the first reason: model, limit, tools, unfinished, short question or reply."""
    u, r = F.trim(F.coalesce("user_text", F.lit(""))), F.trim(F.coalesce("reply_text", F.lit("")))
    reason = (
        F.when(has(F.col("model"), denied), "model").when(F.col("max_tokens") < least_tokens, "max_tokens").when(~F.col("terminal"), "not_terminal").when(F.col("has_tools"), "tools")
        .when((F.length(u) < 15) | (F.size(F.split(u, r"\s+")) < 3), "short_user").when(F.length(r) < 30, "short_reply")
    )
    return exchanges.select("id", reason.alias("reason"), reason.isNull().alias("captured"))


def filter_assistant_facts(facts: DataFrame, cap: int = 6, own_names: tuple[str, ...] = SELF) -> DataFrame:
    """Facts from an assistant's turn that are worth keeping: high-value predicates first, at most ``cap`` a turn.

    ``facts(turn_id, n, subject, predicate, statement)``; ``n`` is their order in the turn.
    """
    p, s = F.lower(F.trim("predicate")), F.lower(F.trim("subject"))
    high = F.coalesce(p.isin(*HIGH_PREDICATES) & ~F.coalesce(s.isin(*own_names), F.lit(False)), F.lit(False))
    kept = facts.withColumn("high", high).where(~F.coalesce(p.isin(*DROP_PREDICATES), F.lit(False)) & (F.col("high") | has(F.col("statement"), IDENT) | has(F.col("statement"), STATE)))
    order = Window.partitionBy("turn_id").orderBy(F.desc("high"), "n")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def scope_subject(df: DataFrame, subject: str) -> DataFrame:
    """Rows about a subject: equal, part of the row's subject, or named in its content."""
    low = subject.lower()
    return df.where(F.contains(F.lower(F.coalesce("subject", F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(low)))


def matcher_bench(ranked: DataFrame, thresholds: list[float]) -> DataFrame:
    """Recall at one and at all, hints and false hints by threshold: ``ranked(case_id, rank, score, correct, has_answer)``."""
    limits = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    best = ranked.groupBy("case_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("correct").cast("int"))).alias("first"), F.max(F.col("correct").cast("int")).alias("any"), F.max("score").alias("top"), F.bool_or("has_answer").alias("has_answer")
    )
    rows = best.select("*", limits)
    hinted = F.col("top") >= F.col("threshold")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("threshold").agg(
        rate(F.when(F.col("has_answer"), F.col("first"))).alias("recall_at_1"), rate(F.when(F.col("has_answer"), F.col("any"))).alias("recall_at_k"),
        rate(F.when(F.col("has_answer"), hinted)).alias("hinted"), rate(F.when(~F.col("has_answer"), hinted)).alias("false_hint"),
    )


def episode_detail(episodes: DataFrame, turns: DataFrame, facts: DataFrame) -> DataFrame:
    """Each episode with its turns and the live facts drawn from them, in order: ``episodes(episode, turn_ids)``."""
    links = episodes.select("episode", F.posexplode("turn_ids").alias("n", "turn_id"))
    said = links.join(turns.select(F.col("id").alias("turn_id")), "turn_id").groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "turn_id"))), lambda x: x.turn_id).alias("turns"))
    drawn = facts.where("valid_to is null and expired_at is null").select(F.col("id").alias("fact_id"), F.explode("source_turn_ids").alias("turn_id"))
    found = links.join(drawn, "turn_id").groupBy("episode").agg(F.array_sort(F.collect_set("fact_id")).alias("facts"))
    none = F.array().cast("array<bigint>")
    rows = episodes.select("episode").join(said, "episode", "left").join(found, "episode", "left")
    return rows.select("episode", F.coalesce("turns", none).alias("turns"), F.coalesce("facts", none).alias("facts"))


def get_dossier(asked: DataFrame, dossiers: DataFrame) -> DataFrame:
    """The newest dossier of each ``asked(namespace, name)``, without regard to case: ``dossiers(namespace, name, id, created_at)``."""
    newest = dossiers.groupBy("namespace", F.lower("name").alias("k")).agg(F.max_by("id", F.struct("created_at", "id")).alias("dossier_id"))
    return asked.withColumn("k", F.lower("name")).join(newest, ["namespace", "k"]).drop("k")


def dossier_candidates(mentions: DataFrame, least: int = 3) -> DataFrame:
    """Entities that enough memories of their namespace mention: ``mentions(namespace, key, id)``, each once."""
    return mentions.groupBy("namespace", "key").agg(F.count(F.lit(1)).alias("mentions")).where(F.col("mentions") >= least)


def filter_author(df: DataFrame, authors: list[str]) -> DataFrame:
    """Rows by one of ``authors``; an empty list asks for all."""
    return df.where(F.col("author").isin(*authors)) if authors else df


def filter_type(df: DataFrame, types: list[str]) -> DataFrame:
    """Rows of one of ``types``, without regard to case, and pinned ones, which always stay: ``df(memory_type, pinned, …)``."""
    return df.where(F.col("pinned") | F.lower("memory_type").isin(*(t.lower() for t in types))) if types else df


def topic_census(asked: DataFrame, topics: DataFrame, readable: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Whether a topic exists where its asker may read, and else which like-named ones do; with its subscribers there.

    ``asked(request_id, principal_id, channel)``, ``topics(namespace, channel)`` of catalogue and messages,
    ``readable(principal_id, namespace)``, ``subscriptions(namespace, channel, session_name)``. Names within two
    edits count as alike, but for ``#general``; they meet by their lengths, which differ by two at most.
    """
    seen = readable.join(topics.where(F.startswith("channel", F.lit("#"))).distinct(), "namespace").select("principal_id", "namespace", "channel")
    names = seen.select("principal_id", F.col("channel").alias("other")).distinct()
    exact = asked.join(names.withColumn("existed", F.lit(True)), (asked.principal_id == names.principal_id) & (F.col("channel") == F.col("other")), "left")
    exact = exact.select("request_id", asked.principal_id, "channel", F.coalesce("existed", F.lit(False)).alias("existed"))
    length = lambda c: F.length(c)
    near = exact.where("not existed").select("request_id", "principal_id", "channel", F.explode(F.sequence(length("channel") - 2, length("channel") + 2)).alias("l"))
    near = near.join(names.withColumn("l", length("other")), ["principal_id", "l"]).where("other <> '#general'")
    d = F.levenshtein(F.lower("channel"), F.lower("other"), 2)
    similar = near.where((d >= 1) & (d <= 2)).groupBy("request_id").agg(F.array_sort(F.collect_set("other")).alias("similar"))
    heard = exact.join(seen, ["principal_id", "channel"]).join(subscriptions, ["namespace", "channel"]).groupBy("request_id").agg(F.countDistinct("session_name").alias("subscribers"))
    rows = exact.join(similar, "request_id", "left").join(heard, "request_id", "left")
    return rows.select("request_id", "channel", "existed", F.array_join(F.coalesce("similar", F.array().cast("array<string>")), ",").alias("similar"), F.coalesce("subscribers", F.lit(0)).alias("subscribers"))


def check_claims_near(claims: DataFrame, facts: DataFrame, below: float = 0.45, k: int = 8) -> DataFrame:
    """Live facts that are near a claim, whatever their subject: ``(claim_id, fact_id, distance, verdict)``.

    ``claims(claim_id, namespace, claim, embedding)``, ``facts(id, namespace, object, embedding)``: of the ``k``
    nearest those closer than ``below``. A claim that has the fact's object agrees with it, else it is related.
    """
    near = vector_topk(claims.select(F.col("claim_id").alias("query_id"), "namespace", "embedding"), facts.where("embedding is not null"), k).where(F.col("distance") < below)
    rows = near.select(F.col("query_id").alias("claim_id"), F.col("id").alias("fact_id"), "distance").join(claims.select("claim_id", "claim"), "claim_id")
    rows = rows.join(facts.select(F.col("id").alias("fact_id"), "object"), "fact_id")
    return rows.select("claim_id", "fact_id", "distance", F.when(F.contains(F.lower("claim"), F.lower("object")), "agrees").otherwise("related").alias("verdict"))
