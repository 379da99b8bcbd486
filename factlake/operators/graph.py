"""The entity graph: neighbours, bounded neighbourhoods, clean-up. Edges are undirected rows ``(src, dst, weight)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import canonical_entity, extract_entities, valid_entity_name
from factlake.operators.governance import made_rows
from factlake.sources.shared import one_scan, spread, stored

#: Entities of an episode that meet in one task, about.
BLOCK = 200
#: Tasks that share the neighbours of a node; each passes on its heaviest only.
PARTS = 8
#: Bytes of pairs of seed and node that are broadcast together to the edges of a hop, about; of so many broadcasts at most, and to nodes that are that many.
FRONTIER_BYTES, FRONTIERS, FRONTIER_NODES = 1 << 27, 8, 1_000_000
#: Pairs that edges into one node make in one task, about.
HUB_ROWS = 2_000_000
#: Pairs of seed and mentioned node that are broadcast to facts.
BROADCAST_NEAR = 200_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: ``(node, other, weight)``; self-loops are left out."""
    return edges.where("src <> dst").selectExpr("inline(array(named_struct('node', src, 'other', dst, 'weight', weight), named_struct('node', dst, 'other', src, 'weight', weight)))")


def merge_edges(edges: DataFrame) -> DataFrame:
    """Endpoints in order, loops dropped, weights of equal pairs added up."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def comention_edges(mentions: DataFrame) -> DataFrame:
    """Entities that share an episode, once for each: ``mentions(episode, entity)``.

    An episode's entities are dealt to blocks of about :data:`BLOCK`, and each two blocks meet by themselves, so that
    an episode with very many is compared in many tasks. Tasks are dealt by how many pairs there are.
    """
    own = mentions.where("episode is not null and entity is not null").distinct()
    met = mentions.groupBy("episode").agg(F.count("entity").alias("n")).where("episode is not null").agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    sizes = own.groupBy("episode").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = own.join(sizes, "episode").withColumn("block", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("episode", F.col("entity").alias("src"), F.col("block").alias("i"), others.alias("j"))
    right = dealt.select("episode", F.col("entity").alias("dst"), others.alias("i"), F.col("block").alias("j"))
    left, right = (spread(df, met, "episode", "i", "j") for df in (left, right))
    pairs = left.join(right, ["episode", "i", "j"]).where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def degree_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities, orphans and those of degree one, in one pass over the degrees."""
    d = entities.select(F.col("name").alias("node")).distinct().join(degree(edges), "node", "left")
    return d.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("degree").isNull()).alias("orphans"), F.count_if(F.col("degree") == 1).alias("leaves"))


def orphan_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("name")).union(edges.select(F.col("dst").alias("name"))).distinct()
    return entities.join(ends, "name", "left_anti")


def neighbours(seeds: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The heaviest direct neighbours of each ``seeds(node)``. Edges are written and dealt to tasks by how many there are."""
    edges = stored(edges.select("src", "dst", "weight"))
    ends = both_ways(edges).join(seeds.select("node").distinct(), "node").withColumn("part", F.pmod(F.xxhash64("other"), F.lit(PARTS)))
    found = spread(ends, 2 * edges.count(), "node", "part").groupBy("node", "part", "other").agg(F.max("weight").alias("weight")).drop("part")
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Nodes within so many hops of each seed, with the hop at which they are first reached.

    Each hop goes on from the frontier and drops what was reached a hop or two before: no end of an edge is nearer.
    Edges and frontiers that a hop goes on from are written, so a hop reads tables and the plan grows by one scan
    each; the last and largest frontier is not, and where :func:`_beyond` can tell tasks the frontier it is not
    shuffled either. Edges that come more than once do no harm.
    """
    step = stored(edges.where("src <> dst").select("src", "dst")) if hops else edges
    reached = stored(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0)))
    frontiers = [reached]
    for hop in range(1, hops + 1):
        found = _beyond(frontiers[-1], frontiers[-2:], step, hop).withColumn("hop", F.lit(hop))
        frontiers.append(stored(found) if hop < hops else found)
    return reduce(DataFrame.unionByName, frontiers)


def _beyond(frontier: DataFrame, known: list[DataFrame], edges: DataFrame, hop: int) -> DataFrame:
    """The pairs ``(seed, node)`` of this ``hop`` from the ``frontier(seed, node, hop)``, without those ``known``: the frontier and what was reached before it.

    Edges are dealt to tasks by where they end, and tasks are told which seeds have reached which node, so a task finds
    all seeds of a node and what they reach is never shuffled. A node that is known comes as an edge to itself.
    If there are too many pairs for one broadcast, seeds are dealt to a few, over the same edges. Edges into a node that
    makes very many pairs go to several tasks, each of which looks at its share of the seeds.
    """
    told = one_scan(*known).where("node is not null")
    weight = F.octet_length("seed") + F.octet_length("node") + 48
    blocks = max(1, -(-(told.agg(F.sum(weight)).first()[0] or 0) // FRONTIER_BYTES))
    block = F.pmod(F.xxhash64("seed"), F.lit(blocks))
    largest = told.groupBy(block).agg(F.sum(weight).alias("n")).agg(F.max("n")).first()[0] if blocks > 1 else 0
    ends = both_ways(edges.withColumn("weight", F.lit(False))).withColumnRenamed("weight", "known")
    if blocks > FRONTIERS or largest > 2 * FRONTIER_BYTES:
        found = frontier.select("seed", "node").join(ends, "node").select("seed", F.col("other").alias("node")).distinct()
        return found.join(told.select("seed", "node"), ["seed", "node"], "left_anti")
    sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(FRONTIER_NODES + 1).count() <= FRONTIER_NODES
    load = ends.join(F.broadcast(sizes) if few else sizes, "node").groupBy("other").agg(F.sum("n").alias("load"))
    made, most = load.agg(F.sum("load"), F.max("load")).first()
    ends = ends.join(F.broadcast(sizes), "node", "left_semi") if few else ends
    own = told.select("node").distinct().select("node", F.col("node").alias("other"), F.lit(True).alias("known"))
    dealt, keys, mine = ends.union(own), ["other"], F.lit(True)
    if (most or 0) > HUB_ROWS:
        hubs = load.where(F.col("load") > HUB_ROWS).select("other", F.ceil(F.col("load") / HUB_ROWS).cast("int").alias("parts"))
        dealt = dealt.join(F.broadcast(hubs), "other", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys, mine = ["other", "part"], F.pmod(F.xxhash64("seed", F.lit(1)), F.col("parts")) == F.col("part")
    dealt = spread(dealt, (made or 0) // blocks, *keys)
    now, found = F.col("hop") == hop - 1, []
    for k in range(blocks):
        seeds = (told.where(block == k) if blocks > 1 else told).groupBy("node").agg(F.collect_list(F.when(now, F.col("seed"))).alias("now"), F.collect_list(F.when(~now, F.col("seed"))).alias("old"))
        hits = dealt.join(F.broadcast(seeds), "node").select("*", F.explode(F.expr("if(known, concat(now, old), now)")).alias("seed")).where(mine)
        pairs = hits.groupBy("seed", *keys).agg(F.bool_or("known").alias("known")).where("not known")
        found.append(pairs.select("seed", F.col("other").alias("node")))
    return reduce(DataFrame.unionByName, found)


def neighbourhood(seeds: DataFrame, edges: DataFrame, max_nodes: int, hub: int = 100, frontier: int = 50, good_name: Column | None = None) -> DataFrame:
    """Up to two hops around each seed without passing through hubs: ranked by hop, then weight, then name.

    Nodes of a degree over ``hub`` are reached but not passed. Of the first hop the ``frontier``
    heaviest go on. ``good_name`` filters the nodes shown and passed (a condition on ``node``). All edges are dealt
    to tasks by how many there are, once; then only those of the first hop's nodes count.
    """
    edges = stored(edges.select("src", "dst", "weight"))
    ends = both_ways(edges)
    fine = good_name if good_name is not None else F.lit(True)
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "node")
    first = ends.join(seeds.select(F.col("node").alias("seed")).distinct(), F.col("node") == F.col("seed")).groupBy("seed", F.col("other").alias("node")).agg(F.max("weight").alias("weight")).where(fine)
    first = stored(first)
    near = stored(spread(ends, 2 * edges.count(), "node").join(first.select("node").distinct(), "node", "left_semi"))
    dealt = spread(near, near.count(), "node")
    small = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") <= hub)
    passing = stored(first.join(small, "node").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= frontier).select("seed", "node", "degree"))
    made = passing.agg(F.sum("degree")).first()[0] or 0
    reached = dealt.join(passing.select("seed", "node"), "node").select("seed", "other", "weight")
    second = spread(reached, made, "seed", "other").groupBy("seed", F.col("other").alias("node")).agg(F.max("weight").alias("weight")).where(fine & (F.col("node") != F.col("seed")))
    second = second.join(first.select("seed", "node"), ["seed", "node"], "left_anti")
    both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    rank = Window.partitionBy("seed").orderBy("hop", F.desc("weight"), "node")
    return both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_nodes)


def clean_graph(entities: DataFrame, edges: DataFrame, valid: Column, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """Drop entities whose name is no name, merge those of one canonical name, and re-point edges.

    ``entities(id, name)``; the smallest id of a name stays. Returns the kept entities ``(id, name)`` and
    the merged edges; edges to dropped entities go, loops vanish, weights add up.
    """
    named = entities.where(valid).select("id", canonical.alias("name"))
    ids = named.withColumn("to", F.min("id").over(Window.partitionBy(F.lower("name"))))
    kept = ids.where("id = to").select("id", "name")
    mapping = ids.select(F.col("id").alias("from"), "to")
    moved = edges.join(mapping.withColumnsRenamed({"from": "src", "to": "__s"}), "src").join(mapping.withColumnsRenamed({"from": "dst", "to": "__d"}), "dst")
    return kept, merge_edges(moved.selectExpr("__s as src", "__d as dst", "weight"))


def upsert_entities(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each lower-cased name: the existing id and embedding if there are any, else the first new ones."""
    rows = existing.select("id", "name", "embedding", F.lit(0).alias("__new")).unionByName(new.select("id", "name", "embedding", F.lit(1).alias("__new")))
    order = F.struct("__new", "id")
    return rows.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("id", order).alias("id"), F.min_by("name", order).alias("name"), F.min_by("embedding", F.when(F.col("embedding").isNotNull(), order)).alias("embedding")
    )


def graph_from_facts(facts: DataFrame, user_name: str | None = None, letters: int | None = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and edges that subjects and objects give.

    Stand-ins become one name; names that are none give nothing, and an object only counts beside a valid
    subject. Of an object the first ``letters`` are its name (None: all of it). Returns ``(namespace, key, name)`` with the first spelling, ``(namespace, key, id)`` and
    ``(namespace, src, dst, weight)``; an edge weighs as many facts as name both ends.
    """
    s, o = canonical_entity(F.col("subject"), user_name), canonical_entity(F.col("object") if letters is None else F.substring("object", 1, letters), user_name, is_object=True)
    rows = facts.where("subject is not null").select("namespace", "id", s.alias("s"), o.alias("o"), F.col("object").isNotNull().alias("has"))
    rows = rows.where(valid_entity_name(F.col("s"))).withColumn("o", F.when(F.col("has") & valid_entity_name(F.col("o"), is_object=True), F.col("o")))
    names = rows.select("namespace", "id", F.explode(F.array(F.struct(F.col("s").alias("name"), F.lit(0).alias("n")), F.struct(F.col("o").alias("name"), F.lit(1).alias("n")))).alias("x")).where("x.name is not null")
    names = names.select("namespace", "id", "x.*", F.lower("x.name").alias("key"))
    entities = names.groupBy("namespace", "key").agg(F.min_by("name", F.struct("id", "n")).alias("name"))
    edges = rows.where("o is not null").select("namespace", F.lower("s").alias("s"), F.lower("o").alias("o")).where("s <> o")
    edges = edges.groupBy("namespace", F.least("s", "o").alias("src"), F.greatest("s", "o").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return entities, names.select("namespace", "key", "id").distinct(), edges


def mentions_of(facts: DataFrame) -> DataFrame:
    """``(namespace, key, id)``: the subject and the proper nouns of each fact, in lower case."""
    keys = F.array_distinct(F.transform(F.concat(F.array("subject"), extract_entities(F.col("statement"))), F.lower))
    return facts.select("namespace", F.explode(keys).alias("key"), "id").where("key is not null")


def expand_facts(reached: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """The live facts that mention what :func:`expand` reached: ``(seed, id, hop)``, each by its nearest hop.

    A fact comes once for each seed near it. Where the nodes that both are reached and mentioned can be broadcast,
    facts are dealt by their id alone, before they are multiplied, and their nearest hops are found in place.
    """
    live = facts.where("valid_to is null and expired_at is null").select("id")
    named = mentions.select(F.col("key").alias("node"), "id")
    near = stored(reached.select("seed", "node", "hop").join(named.select("node").distinct(), "node", "left_semi"))
    if near.limit(BROADCAST_NEAR + 1).count() <= BROADCAST_NEAR:
        rows = made_rows(named, near, "node")
        named, live, near = spread(named, rows, "id"), spread(live, rows, "id"), F.broadcast(near)
        hits = named.join(live, "id").join(near, "node")
    else:
        hits = near.join(named, "node").join(live, "id")
    return hits.groupBy("seed", "id").agg(F.min("hop").alias("hop"))


def entity_view(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, facts: DataFrame, depth: int = 1, most: int = 50, fact_limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """What stands around each ``seeds(node)``: its neighbours up to ``depth`` hops and the facts that mention it.

    Neighbours ``(seed, node, weight, rank)`` rank by the heaviest edge that joins them to what was reached a
    hop before; facts ``(seed, id, rank)`` that are not corrected by the latest ``valid_from``.
    """
    inner = expand(seeds, edges, depth).select("seed", F.col("node").alias("from"))
    around = inner.join(both_ways(edges).withColumnRenamed("node", "from"), "from").where(F.col("other") != F.col("seed"))
    best = around.groupBy("seed", F.col("other").alias("node")).agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "node")
    related = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    own = seeds.select(F.col("node").alias("key")).distinct().join(mentions.select("key", "id").distinct(), "key").join(facts.where("expired_at is null").select("id", "valid_from"), "id")
    newest = Window.partitionBy("key").orderBy(F.desc_nulls_last("valid_from"), F.desc("id"))
    return related, own.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= fact_limit).select(F.col("key").alias("seed"), "id", "rank")


def name_quality(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Shares of entities of degree one, of names that are literals, and of those with an embedding: ``entities(name, embedding)``."""
    d = entities.join(degree(edges).withColumnRenamed("node", "name"), "name", "left")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return d.agg(share(F.coalesce(F.col("degree") == 1, F.lit(False))).alias("leaf_share"), share(~valid_entity_name(F.col("name"))).alias("literal_share"), share(F.col("embedding").isNotNull()).alias("embedded_share"))
