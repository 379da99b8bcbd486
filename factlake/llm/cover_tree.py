"""Exact near-duplicate pairs of embeddings by cover trees (operator 7).

Vectors with equal components are one class. The tree of a group (equal label and dimension) has its upper
levels in Spark: a node with more than a block of members deals them to centres drawn from them, each member
to its nearest, again and again until nodes are small. Each small node then gets a cover tree of its own,
whose levels cover its members by balls of halving radii.

Both parts are descended in pairs. Two nodes are dropped when their centres lie further apart than both
covering radii and the threshold distance allow, and wholly linked, without comparing their members, when
the centres lie so close that no two members can be further apart than the threshold.

Vectors are written once and travel as they were given. While the centres are few, tasks know them all, and a level
costs a pass over the classes that writes places only. The blocks of a group stand in chunks, in the order of the
tree; a task gets two chunks and makes all their pairs of blocks, so a vector is copied as often as its group
has chunks, and not for each pair that its block is in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import connected_components, sorted_groups, stored

#: Members of a node that are not dealt out further; such a node is a block.
BLOCK = 1024
#: Centres that a node is dealt to, at most, on the average.
CENTRES = 64
#: Members of a node that are dealt to its centres in one task, on the average.
DEALT = 50_000
#: Levels in Spark, at most. Nodes that are still large then, or whose members all lie nearest to one centre, are cut into blocks by hash.
DEPTH = 16
#: Bytes of centres that all tasks are told; with more, members are shuffled to the centres of their node.
TOLD_BYTES = 1 << 25
#: Bits that components of unit vectors are rounded to for the nearest centre: their products add up exactly, in any order.
BITS = 24
#: Bytes of a chunk's unit vectors, which a task holds while it reads another chunk block by block.
CHUNK_BYTES = 1 << 26
#: Tasks that are numbered one for each pair of chunks; more are dealt by hash.
TILES = 10_000
#: Blocks that are broadcast with their tasks to their members.
BROADCAST_BLOCKS = 200_000
#: Members of a node of a block's tree that is not split further.
LEAF = 16
#: Room for rounding in bounds on distances.
SLACK = 1e-7


class CoverTree:
    """A flattened tree over the rows of ``x`` (unit vectors), which it reorders: ``order`` names them as they were.

    Row ``i`` of ``nodes`` is (centre, radius, first child, children, start, end); the members of a node are
    the rows ``start`` to ``end``, and its radius truly covers them. Children stand side by side.
    """

    def __init__(self, nodes: np.ndarray, order: np.ndarray, computed: int = 0):
        self.nodes, self.order, self.computed = nodes, order, computed
        self.centre, self.first, self.children, self.start, self.end = (nodes[:, k].astype(np.int64) for k in (0, 2, 3, 4, 5))
        self.radius = nodes[:, 1]

    @classmethod
    def of(cls, x: np.ndarray) -> CoverTree:
        """Grow level by level: within a node, a member that no child covers yet becomes the centre of the next one."""
        apart = lambda at, some: np.sqrt(np.maximum(2 - 2 * (x[some] @ x[at]), 0))
        everyone = np.arange(len(x))
        near = apart(0, everyone)
        computed = len(x)
        found = [[0, float(near.max()), 0, 0, everyone, near]]
        at = 0
        while at < len(found):
            centre, radius, _, _, members, near = found[at]
            if len(members) > LEAF and radius > SLACK:
                found[at][2] = len(found)
                left = members
                while len(left):
                    own = near <= radius / 2
                    found.append([centre, float(near[own].max()), 0, 0, left[own], near[own]])
                    found[at][3] += 1
                    left = left[~own]
                    if len(left):
                        centre = int(left[0])
                        near = apart(centre, left)
                        computed += len(left)
            at += 1
        # children come after their parents, so places are handed down in order
        start, order = np.zeros(len(found), np.int64), np.zeros(len(x), np.int64)
        for i, (_, _, first, n, members, _) in enumerate(found):
            place = start[i]
            if not n:
                order[place : place + len(members)] = members
            for k in range(first, first + n):
                start[k] = place
                place += len(found[k][4])
        where = np.empty(len(x), np.int64)
        where[order] = everyone
        rows = [(where[c], r, first, n, start[i], start[i] + len(m)) for i, (c, r, first, n, m, _) in enumerate(found)]
        return cls(np.array(rows, np.float64), order, computed)


class Links:
    """What comparing two blocks gives: for each member how many vectors it links with, and edges that span the links.

    ``x`` and ``y`` are in the order of their trees. ``compared`` counts the inner products taken.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weights_x: np.ndarray, weights_y: np.ndarray, cosine: float, same: bool):
        self.x, self.y, self.wx, self.wy, self.cosine, self.same = x, y, weights_x, weights_y, cosine, same
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self.of_x, self.of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.label = np.arange(len(x) if same else len(x) + len(y))
        self.edges: list[tuple[int, int]] = []
        self.compared = 0

    def found(self, i: np.ndarray, j: np.ndarray, linked: np.ndarray) -> None:
        """Take up a matrix of links between members ``i`` of x and ``j`` of y."""
        if self.same:
            linked = linked & (i[:, None] != j[None, :])
        if not linked.any():
            return
        self.of_x[i] += linked @ self.wy[j]
        if not self.same:
            self.of_y[j] += self.wx[i] @ linked
        shift = 0 if self.same else len(self.x)
        for row in np.flatnonzero(linked.any(axis=1)).tolist():
            own = j[linked[row]]
            labels, at = np.unique(self.label[own + shift], return_index=True)
            for label, k in zip(labels.tolist(), own[at].tolist()):
                if label != self.label[i[row]]:
                    self.edges.append((int(i[row]), k))
                    self.label[self.label == label] = self.label[i[row]]

    def descend(self, s: CoverTree, t: CoverTree) -> None:
        """Compare all below the roots of two trees that the bounds have not told apart."""
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if not s.children[a] and not t.children[b]:
                i, j = np.arange(s.start[a], s.end[a]), np.arange(t.start[b], t.end[b])
                self.compared += len(i) * len(j)
                self.found(i, j, self.x[i] @ self.y[j].T >= self.cosine)
                continue
            left = np.arange(s.first[a], s.first[a] + s.children[a]) if s.children[a] else np.array([a])
            right = np.arange(t.first[b], t.first[b] + t.children[b]) if t.children[b] else np.array([b])
            dots = self.x[s.centre[left]] @ self.y[t.centre[right]].T
            self.compared += dots.size
            apart = np.sqrt(np.maximum(2 - 2 * dots, 0))
            both = s.radius[left][:, None] + t.radius[right][None, :]
            single = (s.end - s.start == 1)[left][:, None] & (t.end - t.start == 1)[right][None, :]
            self.found(s.centre[left], t.centre[right], single & (dots >= self.cosine))
            near = (apart <= both + self.reach + SLACK) & ~single
            inside = near & (apart + both + SLACK <= self.reach)
            for m, n in zip(*np.nonzero(inside)):
                i, j = np.arange(s.start[left[m]], s.end[left[m]]), np.arange(t.start[right[n]], t.end[right[n]])
                self.found(i, j, np.ones((len(i), len(j)), bool))
            stack += [(left[m], right[n]) for m, n in zip(*np.nonzero(near & ~inside))]


def _units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1, each by itself."""
    x = x.astype(np.float64) + 0.0
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _read(given: Sequence[bytes], dim: int) -> np.ndarray:
    """The unit vectors of ``given``, floats or doubles as they came."""
    return _units(np.frombuffer(b"".join(given), np.float32 if len(given[0]) == 4 * dim else np.float64).reshape(-1, dim))


def _dim(grp: str) -> int:
    return int(grp.partition(":")[0])


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, unit, same, grp)``; ``unit`` is the vector as it came, null where it can't link, and ``same`` is one for equal unit vectors."""
    kind = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "double"

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, labels = batch.column("embedding"), batch.column("label")
            length = np.array(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls are NaN
            start = np.cumsum(length) - length
            units, same = [None] * len(batch), [None] * len(batch)
            for dim in np.unique(length[length > 0]).tolist():
                at = np.flatnonzero((length == dim) & np.array(labels.is_valid()))
                x = flat[start[at][:, None] + np.arange(dim)]
                ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
                for i, own, unit in zip(at[ok].tolist(), x[ok], _units(x[ok]) if ok.any() else []):
                    units[i], same[i] = own.tobytes(), hashlib.blake2b(unit.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), labels, pa.array(units, pa.binary()), pa.array(same, pa.binary())], ["vec_id", "label", "unit", "same"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    found = rows.mapInArrow(normal, "vec_id long, label string, unit binary, same binary")
    return found.withColumn("grp", F.concat_ws(":", (F.octet_length("unit") / (4 if kind == "float" else 8)).cast("int").cast("string"), "label"))


def _walked(classes: DataFrame, told: Broadcast) -> DataFrame:
    """``classes`` with the ``path`` of the last node that each reaches among the centres ``told`` for ``(grp, path)``,
    and how far ``off`` the centre of that node is. A vector takes the same way each time."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grp, part in pdf.groupby("grp", sort=False):
                x = _read(part["unit"].tolist(), _dim(grp))
                rounded = np.rint(x * float(1 << BITS))
                path, off = np.full(len(x), "", object), np.full(len(x), 2.0)
                stack = [("", np.arange(len(x)))]
                while stack:
                    at, own = stack.pop()
                    if (grp, at) not in told.value:
                        path[own] = at
                        continue
                    near, centres, names = told.value[grp, at]
                    best = (rounded[own] @ near.T).argmax(axis=1)
                    off[own] = np.sqrt(np.maximum(2 - 2 * (x[own] * centres[best]).sum(axis=1), 0))
                    stack += [(names[k], own[best == k]) for k in np.unique(best).tolist()]
                yield part.assign(path=path, off=off)

    return classes.select("cls", "grp", "unit", "weight").mapInPandas(walk, "cls long, grp string, unit binary, weight long, path string, off double")


def _told(picked: DataFrame) -> dict:
    """For each ``(grp, parent)`` its centres, rounded and as unit vectors, and their paths."""
    held: dict = {}
    for r in sorted(picked.select("grp", "parent", "path", "centre").collect()):
        held.setdefault((r["grp"], r["parent"]), []).append((r["path"], bytes(r["centre"])))
    centres = {key: _read([c for _, c in own], _dim(key[0])) for key, own in held.items()}
    return {key: (np.rint(x * float(1 << BITS)), x, [p for p, _ in held[key]]) for key, x in centres.items()}


def _dealt(members: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members(cls, grp, path, unit, weight)`` one level down: each goes to the nearest of its node's ``centres(grp, path, n, centre)``.

    A node's members are dealt over tasks by hash, each with all its centres, and pass through in batches.
    """
    salts = F.ceil(F.col("size") / DEALT).cast("long")
    several = lambda df: df.join(sizes.select("grp", "path", salts.alias("salts")), ["grp", "path"])
    own = several(members).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts"))).select("grp", "path", "salt", F.lit(1).alias("side"), F.lit(0).alias("n"), "cls", "unit", "weight")
    each = several(centres).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    each = each.select("grp", "path", "salt", F.lit(0).alias("side"), "n", F.lit(0).cast("long").alias("cls"), F.col("centre").alias("unit"), F.lit(0).cast("long").alias("weight"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, names = None, [], []
        for pdf in batches:
            for now, part in pdf.groupby(["grp", "path", "salt"], sort=False):
                if now != key:
                    key, held, names = now, [], []
                given, rest = part[part["side"] == 0], part[part["side"] == 1]
                held += [_read([u], _dim(now[0]))[0] for u in given["unit"]]
                names += given["n"].tolist()
                if len(rest):
                    dots = _read(rest["unit"].tolist(), _dim(now[0])) @ np.stack(held).T
                    best = dots.argmax(axis=1)
                    off = np.sqrt(np.maximum(2 - 2 * dots.max(axis=1), 0))
                    yield rest[["cls", "grp", "unit", "weight"]].assign(path=[f"{now[1]}/{names[k]}" for k in best.tolist()], off=off)

    rows = own.unionByName(each).repartition("grp", "path", "salt").sortWithinPartitions("grp", "path", "salt", "side", "n")
    return rows.mapInPandas(nearest, "cls long, grp string, unit binary, weight long, path string, off double")


def _levels(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The upper levels: ``members(cls, grp, unit, weight, path)`` of the nodes that are not dealt out, and all
    ``nodes(grp, path, parent, centre, radius, size, weight, rep, inner)``. A path names a node below its ancestors.

    Only places are written. Members come with the way that they take among the told centres, or from a join.
    """
    context = classes.sparkSession.sparkContext
    keys, mark = ["cls", "grp", "mark"], F.xxhash64("unit").alias("mark")
    marked = classes.select("*", mark)
    frontier = marked.select(*keys, "weight", F.lit("").alias("path"), F.lit(2.0).alias("off"))
    centres = classes.groupBy("grp").agg(F.min("cls").alias("cls")).join(classes.select("cls", "grp", F.col("unit").alias("centre")), ["cls", "grp"])
    centres = centres.groupBy("grp").agg(F.min("centre").alias("centre")).withColumns({"parent": F.lit(None).cast("string"), "path": F.lit("")})
    before, told, told_bytes = None, {}, 0
    walked = _walked(classes, context.broadcast(told))
    all_members, all_nodes = [], []
    for depth in range(DEPTH + 1):
        frontier = stored(frontier)
        sums = frontier.groupBy("grp", "path").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"), F.min("cls").alias("rep"), F.max("off").alias("radius"))
        nodes = sums.join(centres.select("grp", "path", "parent", "centre"), ["grp", "path"])
        shrunk = F.lit(depth < DEPTH)
        if before is not None:  # all members lie nearest to one centre: dealing does not help
            nodes = nodes.join(before, ["grp", "parent"])
            shrunk = shrunk & (F.col("size") < F.col("parent_size"))
        nodes = stored(nodes.withColumn("inner", (F.col("size") > BLOCK) & shrunk).select("grp", "path", "parent", "centre", "radius", "size", "weight", "rep", "inner"))
        all_nodes.append(nodes)
        placed = frontier.join(nodes.select("grp", "path", "inner", "size", "rep"), ["grp", "path"])
        all_members.append(placed.where("not inner").select(*keys, "path"))
        large = nodes.where("inner")
        share = F.least(F.ceil(F.col("size") / BLOCK) * 2, F.lit(CENTRES))
        drawn = placed.where("inner").select(*keys, "path", "size", "rep", "weight")
        expected = large.agg(F.sum(share * F.octet_length("centre"))).first()[0]
        if expected is None:
            break
        chosen = (F.pmod(F.xxhash64("cls", F.lit(depth)), F.lit(1 << 40)) < share / F.col("size") * float(1 << 40)) | (F.col("cls") == F.col("rep"))
        few = told is not None and told_bytes + expected <= TOLD_BYTES
        picked = drawn.where(chosen).select(*keys, F.col("path").alias("parent"))
        picked = marked.join(F.broadcast(picked) if few else picked, keys).select("grp", "parent", "cls", F.col("unit").alias("centre"))
        picked = picked.withColumn("n", F.pmod(F.xxhash64("cls"), F.lit(1 << 31)))  # a name within the node; equal ones would share a path
        picked = picked.groupBy("grp", "parent", "n").agg(F.min_by("centre", F.struct("cls", "centre")).alias("centre"))
        picked = stored(picked.withColumn("path", F.concat_ws("/", "parent", F.col("n").cast("string"))))
        if few:
            told, told_bytes = told | _told(picked), told_bytes + expected
            walked = _walked(classes, context.broadcast(told))
            frontier = walked.where(F.size(F.split("path", "/")) == depth + 2)
        else:
            told = None
            frontier = _dealt(drawn.select(*keys, "path", "weight").join(marked.select(*keys, "unit"), keys).drop("mark"), picked.select("grp", F.col("parent").alias("path"), F.col("n").cast("int").alias("n"), "centre"), large)
        frontier = frontier.select("cls", "grp", mark, "weight", "path", "off")
        centres, before = picked, large.select("grp", F.col("path").alias("parent"), F.col("size").alias("parent_size"))
    nodes = stored(reduce(DataFrame.unionByName, all_nodes))
    if told is not None:
        return walked.drop("off"), nodes
    return marked.join(reduce(DataFrame.unionByName, all_members), keys).drop("mark"), nodes


@F.pandas_udf(T.DoubleType())
def _apart(grp: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The distance of two vectors of a group."""
    out = np.empty(len(grp))
    for dim, at in grp.map(_dim).reset_index(drop=True).groupby(grp.map(_dim).to_numpy()).indices.items():
        x, y = _read(a.iloc[at].tolist(), dim), _read(b.iloc[at].tolist(), dim)
        out[at] = np.sqrt(np.maximum(2 - 2 * (x * y).sum(axis=1), 0))
    return pd.Series(out)


def _node_pairs(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Descend the upper levels in pairs: pairs ``(grp, a, b)`` of last nodes that are to be compared, and of nodes that are wholly linked."""
    reach = float(np.sqrt(2 - 2 * cosine))
    own = nodes.select("grp", F.col("path").alias("of"), "path", "centre", "radius", "inner")
    kids = own.where("not inner").unionByName(nodes.where("parent is not null").select("grp", F.col("parent").alias("of"), "path", "centre", "radius", "inner"))
    kids = stored(kids)
    side = lambda s, of: kids.select("grp", F.col("of").alias(of), *(F.col(c).alias(f"{c}_{s}") for c in ("path", "centre", "radius", "inner")))
    roots = nodes.where("parent is null")
    pairs = stored(roots.select("grp", F.col("path").alias("a"), F.col("path").alias("b"), F.col("inner").alias("open")))
    last, whole = [pairs.where("not open").select("grp", "a", "b")], [pairs.limit(0).select("grp", "a", "b")]
    while not pairs.where("open").isEmpty():
        below = pairs.where("open").select("grp", "a", "b").join(side("x", "a"), ["grp", "a"]).join(side("y", "b"), ["grp", "b"]).where("a <> b or path_x <= path_y")
        below = below.withColumn("apart", F.when(F.col("path_x") == F.col("path_y"), 0.0).otherwise(_apart("grp", "centre_x", "centre_y")))
        below = below.where(F.col("apart") <= F.col("radius_x") + F.col("radius_y") + reach + SLACK)
        inside = F.col("apart") + F.col("radius_x") + F.col("radius_y") + SLACK <= reach
        pairs = stored(below.select("grp", F.col("path_x").alias("a"), F.col("path_y").alias("b"), inside.alias("inside"), ((F.col("inner_x") | F.col("inner_y")) & ~inside).alias("open")))
        last.append(pairs.where("not inside and not open").select("grp", "a", "b"))
        whole.append(pairs.where("inside").select("grp", "a", "b"))
    return reduce(DataFrame.unionByName, last), reduce(DataFrame.unionByName, whole)


def _tiles(nodes: DataFrame, last: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Deal the pairs of ``last`` nodes to tasks: ``routes(grp, path, block, blocks, num, to)`` of each block of a node, with
    the ``(tile, side)`` that it goes to, and ``headers(tile, side, num, meets)`` with the blocks that it is compared with there.

    Blocks are numbered in the order of their paths, and stand in as many equal chunks as a task's memory and the number of
    tasks ask for. A tile has the pairs of two chunks.
    """
    tasks = nodes.sparkSession.sparkContext.defaultParallelism
    one = nodes.where("not inner").select("grp", "path", "size", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    one = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    order = Window.partitionBy("grp").orderBy("path", "block")
    own, most = F.col("size") / F.col("blocks"), F.greatest(F.lit(1.0), F.least(CHUNK_BYTES / 8 / F.split("grp", ":")[0].cast("long"), F.lit(max(BLOCK, -(-total // tasks)))))
    sums = {"num": F.row_number().over(order), "upto": F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0)) - own, "all": F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    chunk = F.floor((F.col("upto") + own / 2) * F.ceil(F.col("all") / most) / F.col("all"))
    one = stored(one.withColumns(sums).select("grp", "path", "block", "blocks", "num", chunk.cast("int").alias("chunk")))
    side = lambda s: one.select("grp", F.col("path").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("block", "num", "chunk")))
    pairs = last.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]).where("a <> b or block_a <= block_b")
    ends = {"near": F.least("num_a", "num_b"), "far": F.greatest("num_a", "num_b"), "i": F.least("chunk_a", "chunk_b"), "j": F.greatest("chunk_a", "chunk_b")}
    meets = stored(pairs.select("grp", *(c.alias(n) for n, c in ends.items())).groupBy("grp", "i", "j", "far").agg(F.collect_list("near").alias("meets")))
    tiles = meets.select("grp", "i", "j").distinct()
    number = F.row_number().over(Window.orderBy("grp", "i", "j")).cast("long") if tiles.limit(TILES + 1).count() <= TILES else F.xxhash64("grp", "i", "j")
    tiles = stored(tiles.withColumn("tile", number))
    meets = meets.join(tiles, ["grp", "i", "j"]).withColumn("side", F.when(F.col("i") == F.col("j"), 1).otherwise(2))
    gone = meets.select("grp", "tile", "side", F.col("far").alias("num")).unionByName(meets.select("grp", "tile", F.lit(1).alias("side"), F.explode("meets").alias("num"))).distinct()
    routes = one.drop("chunk").join(gone.groupBy("grp", "num").agg(F.collect_list(F.struct("tile", "side")).alias("to")), ["grp", "num"])
    return stored(routes), stored(meets.select("tile", "side", F.col("far").alias("num"), "meets"))


def _compared(members: DataFrame, nodes: DataFrame, last: DataFrame, total: int, cosine: float) -> DataFrame:
    """Grow the trees of a tile's blocks and descend them in pairs: rows ``(a, a, n)`` for links of a member, and ``(a, b, 0)`` for edges.

    A task holds one chunk and reads the blocks of the other, each of which names the blocks that it is compared with.
    """
    routes, headers = _tiles(nodes, last, total)
    few = routes.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    own = members.join(F.broadcast(routes) if few else routes, ["grp", "path"]).where(F.col("block") == F.pmod(F.xxhash64("cls"), F.col("blocks")))
    own = own.select(F.inline("to"), "num", F.lit(0).alias("pos"), F.split("grp", ":")[0].cast("int").alias("dim"), "cls", "weight", "unit", F.lit(None).cast("array<int>").alias("meets"))
    none = {"pos": F.lit(-1), "dim": F.lit(0), "cls": F.lit(None).cast("long"), "weight": F.lit(None).cast("long"), "unit": F.lit(None).cast("binary")}
    rows = own.unionByName(headers.withColumns(none))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held = None, {}
        for g in sorted_groups(batches, ["tile", "side", "num"]):
            if tile != g["tile"].iloc[0]:
                tile, held = g["tile"].iloc[0], {}
            meets = g["meets"].iloc[0] if g["pos"].iloc[0] < 0 else []
            side, num, g = g["side"].iloc[0], g["num"].iloc[0], g[g["pos"] == 0]
            if not len(g):  # no member's hash is of this block
                continue
            x = _read(g["unit"].tolist(), int(g["dim"].iloc[0]))
            tree = CoverTree.of(x)
            far = tree, x[tree.order], g["cls"].to_numpy(np.int64)[tree.order], g["weight"].to_numpy(np.int64)[tree.order]
            if side == 1:
                held[num] = far
            for k in meets:
                if k in held:
                    (s, x, cls_x, wx), (t, y, cls_y, wy) = held[k], far
                    links = Links(x, y, wx, wy, cosine, k == num)
                    links.descend(s, t)
                    for c, n in ((cls_x, links.of_x), (cls_y, links.of_y)):
                        if n.any():
                            yield pd.DataFrame({"a": c[n > 0], "b": c[n > 0], "n": n[n > 0]}, dtype="int64")
                    if links.edges:
                        yield pd.DataFrame({"a": [cls_x[i] for i, _ in links.edges], "b": [cls_y[j] for _, j in links.edges], "n": 0}, dtype="int64")

    tasks = max(1, min(TILES, headers.select("tile").distinct().count()))
    rows = rows.repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int")).sortWithinPartitions("tile", "side", "num", "pos", "cls")
    return rows.mapInPandas(compare, "a long, b long, n long")


def _whole(members: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of :func:`_compared` for pairs of nodes that are wholly linked: each member links with all of the other node."""
    named = nodes.select("grp", "path", F.col("weight").alias("all"), "rep")
    both = pairs.join(named.withColumnsRenamed({"path": "a", "all": "all_a", "rep": "rep_a"}), ["grp", "a"]).join(named.withColumnsRenamed({"path": "b", "all": "all_b", "rep": "rep_b"}), ["grp", "b"])
    given = both.select("grp", F.col("a").alias("path"), F.col("all_b").alias("n"), F.col("rep_b").alias("rep"), (F.col("a") == F.col("b")).alias("self"))
    given = given.unionByName(both.where("a <> b").select("grp", F.col("b").alias("path"), F.col("all_a").alias("n"), F.col("rep_a").alias("rep"), F.lit(False).alias("self")))
    given = stored(given.groupBy("grp", "path").agg(F.sum("n").alias("n"), F.count_if("self").alias("self"), F.min("rep").alias("rep")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hits = members.select("grp", "cls", "weight", F.explode(above).alias("path")).join(given, ["grp", "path"])
    # a member is not its own partner, and copies of it are counted apart
    links = hits.select(F.col("cls").alias("a"), F.col("cls").alias("b"), (F.col("n") - F.col("self") * F.col("weight")).alias("n"))
    none = F.lit(0).cast("long").alias("n")
    edges = hits.select(F.col("cls").alias("a"), F.col("rep").alias("b"), none).unionByName(both.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), none))
    return links.where("n > 0").unionByName(edges.where("a <> b"))


def near_pairs(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at
    least ``cosine`` (0 or more). Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different dimensions. Repeated rows are vectors of their own
    that link with one another. ``component_id`` is the smallest ``vec_id`` that links reach; ``kept``
    says that it is the row's own. Rows without ``vec_id`` can't be named: they link with nothing, their
    component is null and they are not kept. Other columns are ignored; an empty table gives no rows.
    """
    given = _unit_vectors(vectors)
    rows = stored(given.select("vec_id", "grp", "same"))
    able = rows.where("same is not null and vec_id is not null")
    classes = given.where("unit is not null and vec_id is not null").groupBy("grp", "same")
    classes = stored(classes.agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")))
    members, nodes = _levels(classes.drop("same"))
    last, whole = _node_pairs(nodes, cosine)
    found = _compared(members, nodes, last, classes.count(), cosine)
    found = stored(found if whole.isEmpty() else found.unionByName(_whole(members, nodes, whole)))
    labels = connected_components(found.where("a <> b").select("a", "b")).withColumnsRenamed({"node": "cls", "component": "component_id"})
    links = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    named = classes.join(links, "cls", "left").join(labels, "cls", "left")
    # written, so that the join with the vectors is of two scans, whose skewed keys Spark splits
    named = stored(named.select("grp", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "cls").alias("component_id")))
    linked = able.join(named, ["grp", "same"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("same is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
