"""Namespaces, grants, links, subscriptions and precedence, as joins.

A grant is a namespace, a prefix (``team:*``) or ``*``. Every namespace is exploded into the few grants
that would cover it and joined by equality, so no pattern join and no cross product is needed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import ancestors
from factlake.sources.shared import spread

#: Enforcement patterns without three letters in a row that are broadcast together, and letters of a pattern's beginning that are looked up.
STAR_RULES, PREFIX = 10_000, 64
#: Namespaces with what covers or reaches them that are broadcast to grants and rules, which are more.
BROADCAST_NAMES = 200_000


def covering_grants(namespace: Column) -> Column:
    """The grants that cover a namespace: itself, ``<prefix>:*`` for itself and each ancestor, and ``*``."""
    stars = F.transform(ancestors(namespace), lambda a: F.concat(a, F.lit(":*")))
    return F.concat(F.array(namespace), stars, F.array(F.lit("*")))


def authorize(requests: DataFrame, grants: DataFrame, write: bool = False) -> DataFrame:
    """The ``requests(request_id, principal_id, namespace)`` that a grant of their principal covers."""
    may = grants.where("can_write" if write else "can_read").select("principal_id", F.col("namespace").alias("__g")).distinct()
    asked = requests.withColumn("__g", F.explode(covering_grants(F.col("namespace"))))
    hits = asked.join(may, ["principal_id", "__g"]).select("request_id").distinct()
    return requests.join(hits, "request_id", "left_semi")


def effective_grants(grants: DataFrame, members: DataFrame, role_grants: DataFrame) -> DataFrame:
    """Own grants and those of one's roles together; rights on a namespace add up."""
    by_role = members.join(role_grants, "role_id").select("principal_id", "namespace", "can_read", "can_write")
    both = grants.select("principal_id", "namespace", "can_read", "can_write").unionByName(by_role)
    return both.groupBy("principal_id", "namespace").agg(F.bool_or("can_read").alias("can_read"), F.bool_or("can_write").alias("can_write"))


def readable_namespaces(effective: DataFrame, registry: DataFrame) -> DataFrame:
    """Patterns expanded against the registry: ``(principal_id, namespace, can_write)``.

    A wide pattern gives its principal very many rows, so principals are dealt to tasks by how many rows they make.
    """
    names = registry.select("namespace").distinct().withColumn("__g", F.explode(covering_grants(F.col("namespace"))))
    may = effective.where("can_read").select("principal_id", F.col("namespace").alias("__g"), "can_write")
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        may, names = spread(may, made_rows(may, names, "__g"), "principal_id"), F.broadcast(names)
    return may.join(names, "__g").groupBy("principal_id", "namespace").agg(F.bool_or("can_write").alias("can_write"))


def made_rows(left: DataFrame, right: DataFrame, key: str) -> int:
    """How many rows the join of both by ``key`` has."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return count(left, "n").join(count(right, "m"), key).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def admins(effective: DataFrame) -> DataFrame:
    return effective.where("namespace = '*' and can_write").select("principal_id").distinct()


def effective_ancestors(namespaces: DataFrame, registry: DataFrame) -> DataFrame:
    """``(namespace, ancestor, depth)`` for namespaces that inherit; one that the registry lacks does."""
    flags = registry.select("namespace", "inherit_ancestors")
    rows = namespaces.join(flags, "namespace", "left").where("coalesce(inherit_ancestors, true)")
    return rows.select("namespace", F.posexplode(ancestors(F.col("namespace"))).alias("depth", "ancestor")).withColumn("depth", F.col("depth") + 1)


def resolve_bindings(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """The binding that decides a request: by repository, then host and repository, then host and path; the latest of a kind.

    Of the bindings of one key only the latest can decide, so requests meet one row for each of their three keys.
    """
    latest = bindings.groupBy("principal_id", "key_type", "key").agg(F.max(F.struct("bound_at", "namespace")).alias("b")).select("principal_id", "key_type", "key", "b.bound_at", "b.namespace")
    keys = F.array(
        F.struct(F.lit("repo").alias("key_type"), F.col("repo").alias("key"), F.lit(1).alias("priority")),
        F.struct(F.lit("host_repo").alias("key_type"), F.concat_ws("|", "host", "repo").alias("key"), F.lit(2).alias("priority")),
        F.struct(F.lit("host_path").alias("key_type"), F.concat_ws("|", "host", "path").alias("key"), F.lit(3).alias("priority")),
    )
    asked = requests.select("request_id", "principal_id", F.explode(keys).alias("k")).select("request_id", "principal_id", "k.*")
    found = asked.join(latest, ["principal_id", "key_type", "key"])
    order = Window.partitionBy("request_id").orderBy("priority", F.desc("bound_at"), F.desc("namespace"))
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("request_id", "namespace", "key_type")


def grounded_namespaces(links: DataFrame, effective: DataFrame) -> DataFrame:
    """For each principal and linked namespace, whether it is used or skipped for want of a grant."""
    asked = links.select("principal_id", "src_ns", F.col("dst_ns").alias("namespace")).distinct()
    keyed = asked.withColumn("request_id", F.concat_ws("|", "principal_id", "src_ns", "namespace"))
    ok = authorize(keyed, effective).select("request_id").withColumn("__ok", F.lit(True))
    used = keyed.join(ok, "request_id", "left")
    return used.select("principal_id", "src_ns", F.col("namespace").alias("dst_ns"), F.when(F.col("__ok"), "used").otherwise("skipped").alias("state"))


def resolve_precedence(pins: DataFrame, overrides: DataFrame) -> DataFrame:
    """Constraints on one subject along a line of namespaces: an ancestor beats its descendants.

    An override (child over parent) turns a pair around. Adds ``beaten_by`` (the strongest beater: the
    shortest namespace, then by name) to each ``pins(pin_id, namespace, subject)``. If the rules leave a
    subject without any winner (a cycle), none of its pins is beaten.
    """
    named = pins.select(F.lower("subject").alias("__s"), "namespace").where("__s is not null").distinct()
    up = named.select("__s", F.col("namespace").alias("child"), F.explode(ancestors(F.col("namespace"))).alias("parent"))
    pairs = up.join(named.select("__s", F.col("namespace").alias("parent")), ["__s", "parent"])
    turned = overrides.select(F.col("child_namespace").alias("child"), F.col("parent_namespace").alias("parent")).distinct().withColumn("__turned", F.lit(True))
    pairs = pairs.join(turned, ["child", "parent"], "left")
    loser, winner = F.when(F.col("__turned"), F.col("parent")).otherwise(F.col("child")), F.when(F.col("__turned"), F.col("child")).otherwise(F.col("parent"))
    beaten = pairs.groupBy("__s", loser.alias("namespace")).agg(F.min(F.struct(F.length(winner).alias("l"), winner.alias("w"))).alias("b")).select("__s", "namespace", F.col("b.w").alias("__by"))
    counts = named.join(beaten, ["__s", "namespace"], "left").groupBy("__s").agg((F.count("__by") < F.count(F.lit(1))).alias("__some_win"))
    rows = pins.withColumn("__s", F.lower("subject")).join(beaten, ["__s", "namespace"], "left").join(counts, "__s", "left")
    return rows.withColumn("beaten_by", F.when(F.col("__some_win"), F.col("__by"))).drop("__s", "__by", "__some_win")


def match_subscriptions(subs: DataFrame, messages: DataFrame) -> DataFrame:
    """Unread messages for each subscription: ``subs(namespace, session_name, channel, cursor)``.

    A channel is exact, a prefix (``#x*``) or ``*``. Own posts and recalled messages are left out. Exact
    subscriptions join by equality; patterns by the distinct channels of their namespace, which are few.
    """
    channels = messages.select("namespace", F.col("channel").alias("__c")).distinct()
    wild = F.col("channel").endswith("*")
    exact = subs.where(~wild).withColumn("__c", F.col("channel"))
    patterns = subs.where(wild).join(channels, "namespace").where(F.startswith(F.col("__c"), F.expr("substring(channel, 1, length(channel) - 1)")))
    wanted = exact.unionByName(patterns)
    unread = messages.where("recalled_at is null").withColumnRenamed("channel", "__c")
    found = unread.join(wanted, ["namespace", "__c"]).where("id > cursor and sender_session <> session_name")
    return found.select("namespace", "session_name", "channel", "id", F.col("__c").alias("message_channel"), "sender_session")


def poll(subs: DataFrame, messages: DataFrame) -> DataFrame:
    """Each message once for a session, however many of its subscriptions match."""
    return match_subscriptions(subs, messages).groupBy("namespace", "session_name", "id").agg(F.count(F.lit(1)).alias("matches"))


def unread(subs: DataFrame, messages: DataFrame) -> DataFrame:
    found = match_subscriptions(subs, messages)
    return found.groupBy("namespace", "session_name").agg(F.countDistinct("id").alias("unread"), F.array_sort(F.collect_set("message_channel")).alias("channels"))


def glob_regex(pattern: Column) -> Column:
    """A shell-style pattern as a regular expression for the whole of a string, line breaks and all.

    ``*`` is any run, ``?`` any letter, ``[seq]`` and ``[!seq]`` one in or not in a set of letters and ranges; a
    bracket that is not closed stands for itself. A range that runs backwards holds nothing.
    """
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)\*+|\?|\[!?+\]?+[^\]]*+\]|\[|[^*?\[]+"), F.lit(0))
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    negated = lambda x: F.substring(x, 2, 1) == "!"

    def letters(x: Column) -> Column:
        inside = F.substr(x, F.when(negated(x), 3).otherwise(2), F.length(x) - F.when(negated(x), 3).otherwise(2))
        items = F.regexp_extract_all(inside, F.lit(r"(?s).-.|."), F.lit(0))
        items = F.filter(items, lambda i: (F.length(i) == 1) | (F.substring(i, 1, 1) <= F.substring(i, 3, 1)))
        escape = lambda c: F.concat(F.lit("\\"), c)
        own = lambda c: F.when(c.rlike(r"^[A-Za-z0-9]$"), c).otherwise(F.when(F.ascii(c) < 128, escape(c)).otherwise(c))
        named = F.transform(items, lambda i: F.when(F.length(i) == 1, own(i)).otherwise(F.concat(own(F.substring(i, 1, 1)), F.lit("-"), own(F.substring(i, 3, 1)))))
        whole = F.concat(F.when(negated(x), "[^").otherwise("["), F.array_join(named, ""), F.lit("]"))
        return F.when(F.size(items) > 0, whole).otherwise(F.when(negated(x), ".").otherwise("(?!)"))

    turned = F.transform(
        parts,
        lambda x: F.when(x.startswith("*"), F.lit(".*")).when(x == "?", F.lit(".")).when((F.length(x) > 2) & x.startswith("[") & x.endswith("]"), letters(x)).otherwise(quoted(x)),
    )
    return F.concat(F.lit("(?s)^"), F.array_join(turned, ""), F.lit("\\z"))


def match_enforcement(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that decides a tool call: globs on ``tool(input)`` or the tool's name; block before ask, then the first.

    Rules are an index by what they begin with up to their first wildcard, :data:`PREFIX` letters at most; a call
    meets those that it begins with, looked up for the lengths that occur. Rules that begin with a wildcard are
    found by three letters in a row that they need, among those of the call; those without, which hardly tell
    calls apart, are few after equal patterns are one, and are broadcast, :data:`STAR_RULES` at a time. Rules up to
    that number are broadcast, more are merged by a shuffle; calls, which are many more than their file's size tells
    once they are looked up by their beginnings, never are broadcast. A ``run_command`` is also judged as ``Bash``.
    """
    # of rules with one pattern the best is the one that counts
    level = F.when(F.col("level") == "block", 0).otherwise(1)
    best = rules.groupBy("pattern").agg(F.min(F.struct(level.alias("order"), "rule_no", "level")).alias("rule"))
    plain = F.regexp_extract("pattern", r"(?s)^[^*?\[]*", 0)
    runs = F.filter(F.split("pattern", r"\*|\?|\[!?+\]?+[^\]]*+\]|\["), lambda r: F.length(r) >= 3)
    best = best.select("rule", glob_regex(F.col("pattern")).alias("regex"), F.substring(plain, 1, PREFIX).alias("begin"), F.substring(F.get(runs, 0), 1, 3).alias("gram"))
    told = calls.select("call_id", "tool", F.concat("tool", F.lit("("), "input", F.lit(")")).alias("whole"), F.col("input"))
    bash = F.col("tool") == "run_command"
    told = told.select("call_id", F.explode(F.array_distinct(F.array("whole", "tool", F.when(bash, F.concat(F.lit("Bash("), "input", F.lit(")"))), F.when(bash, F.lit("Bash"))))).alias("subject")).where("subject is not null")
    fits = F.expr("rlike(subject, regex)")
    few = best.limit(STAR_RULES + 1).count() <= STAR_RULES
    sized = lambda df: F.broadcast(df) if few else df.hint("merge")
    lengths = sorted(r["n"] for r in best.select(F.length("begin").alias("n")).where("n > 0").distinct().collect())
    tries = F.array(*(F.when(F.length("subject") >= n, F.substring("subject", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    hits = [told.withColumn("begin", F.explode(tries)).join(sized(best.where("begin <> ''").select("begin", "rule", "regex")), "begin").where(fits)]
    starred = best.where("begin = ''")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("subject") - 2), lambda i: F.substr("subject", i, F.lit(3))))
    asked = starred.where("gram is not null")
    if not asked.isEmpty():
        several = told.where(F.length("subject") >= 3).withColumn("gram", F.explode(grams))
        hits.append(several.join(sized(asked.select("gram", "rule", "regex")), "gram").where(fits))
    loose = starred.where("gram is null")
    blocks = -(-loose.count() // STAR_RULES)
    hits += [told.join(F.broadcast(loose.where(F.pmod(F.xxhash64("regex"), F.lit(blocks)) == k)), fits) for k in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, (h.select("call_id", "rule") for h in hits))
    return found.groupBy("call_id").agg(F.min("rule").alias("rule")).select("call_id", "rule.level", "rule.rule_no")


def suggest_namespace(tokens: DataFrame, known: DataFrame, least: int = 2, share: float = 0.6, top: int = 12) -> DataFrame:
    """Namespaces that know most of a write's entities: ``tokens(write_id, namespace, token)``, ``known(namespace, token)``."""
    n = tokens.groupBy("write_id").agg(F.countDistinct("token").alias("n"))
    hits = tokens.select("write_id", F.col("namespace").alias("own"), "token").distinct().join(known.distinct(), "token")
    scores = hits.groupBy("write_id", "own", "namespace").agg(F.count(F.lit(1)).alias("hits"))
    own = scores.where("namespace = own").select("write_id", F.col("hits").alias("own_hits"))
    rows = scores.where("namespace <> own").join(n, "write_id").join(own, "write_id", "left").fillna(0, ["own_hits"])
    rows = rows.where((F.col("n") >= least) & (F.col("hits") >= share * F.col("n")) & (F.col("hits") > F.col("own_hits")))
    order = Window.partitionBy("write_id").orderBy(F.desc("hits"), "namespace")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("write_id", "namespace", "hits", "n", "own_hits", "rank")
