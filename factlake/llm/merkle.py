"""Merkle manifest of a dataset (operator 12).

Every row is a leaf, every source a tree of runs of 16, and the sources' roots make one more tree.
Leaves are dealt to aligned *blocks* of 16^3. A block is a stream of appends: each append attaches a
witness to the open run it falls into, and every sibling that is completed later extends the witnesses
of its run, so only open runs are held. The roots of blocks are appended in the same way to the blocks
above, until one is left. On the way back each block gets the witness of its own root, and hands it on
to what its leaves have gathered.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import stored

#: Nodes in a run, and levels of a block.
FAN, DEPTH = 16, 3
#: Pairs of a tree and a range up to this many are broadcast to number the rows; more are joined by shuffle.
BROADCAST_RANGES = 100_000


class Path:
    """A witness that keeps its siblings: for each level those on the left and those on the right."""

    def __init__(self) -> None:
        self.levels: list[list[bytes]] = []

    def begin(self, left: bytes) -> None:
        self.levels.append([left, b""])

    def sibling(self, digest: bytes) -> None:
        self.levels[-1][1] += digest

    def close(self) -> None:
        pass


class Fold:
    """A witness that is used as it grows: ``proof`` runs over the siblings, ``own`` is the leaf folded so far."""

    def __init__(self, own: bytes) -> None:
        self.proof, self.own = sha256(), own

    def begin(self, left: bytes) -> None:
        self.proof.update(left)
        self.level = sha256(left + self.own)

    def sibling(self, digest: bytes) -> None:
        self.proof.update(digest)
        self.level.update(digest)

    def close(self) -> None:
        self.own = self.level.hexdigest().encode()


class OpenTree:
    """A tree of ``levels`` levels that grows by appends and holds open runs only.

    ``runs[k]`` has the digests of the open run of level ``k``, and the witnesses that wait there for more siblings.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.runs: list[list[bytes]] = [[] for _ in range(levels + 1)]
        self.waiting: list[list] = [[] for _ in range(levels + 1)]

    def append(self, digest: bytes, witness=None) -> None:
        self._complete(0, digest, [witness] if witness else [])

    def _complete(self, level: int, digest: bytes, witnesses: list) -> None:
        """A node of ``level`` is complete: it extends those that wait in its run, and its own witnesses join them."""
        run, waiting = self.runs[level], self.waiting[level]
        if level < self.levels:
            for w in waiting:
                w.sibling(digest)
            left = b"".join(run)
            for w in witnesses:
                w.begin(left)
        run.append(digest)
        waiting += witnesses
        if len(run) == FAN and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        run, waiting = self.runs[level], self.waiting[level]
        self.runs[level], self.waiting[level] = [], []
        for w in waiting:
            w.close()
        self._complete(level + 1, sha256(b"".join(run)).hexdigest().encode(), waiting)

    def finish(self) -> bytes:
        """Close what is open, and return the root."""
        for level in range(self.levels):
            if self.runs[level]:
                self._close(level)
        return self.runs[self.levels][0]


def levels_of(n: int, depth: int) -> int:
    """Levels of a block, ``depth`` at most, in a tree that has ``n`` nodes on the block's lowest level."""
    levels = 0
    while FAN**levels < min(n, FAN**depth):
        levels += 1
    return levels


def digest_of(fields: Sequence[Column]) -> Column:
    """The digest of values: each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, from 0 within each ``tree``, and ``n``, the tree's size, by ``order`` (which begins with the tree).

    Rows are sorted in ranges, whatever their trees, so a large tree lies in many of them; each range counts its
    own, and what the ranges before it have of the tree is added.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column("tree").to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "at"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(ranged.mapInArrow(counted, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, part int, at long"))
    sizes = stored(held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own")))
    so_far = F.sum("own").over(Window.partitionBy("tree").orderBy("part")) - F.col("own")
    sizes = stored(sizes.select("tree", "part", so_far.alias("before"), F.sum("own").over(Window.partitionBy("tree")).alias("n")))
    few = sizes.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    placed = held.join(F.broadcast(sizes) if few else sizes, ["tree", "part"])
    return stored(placed.select(*rows.columns, (F.col("before") + F.col("at")).alias("pos"), "n"))


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes, each in one task and in order."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _in_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**depth).cast("long"))


def _block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """The roots of the blocks of ``nodes(tree, pos, digest, n)``, as nodes of the level above."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, tree, done = None, 0, OpenTree(0), []
        for batch in batches:
            for name, block, digest, size in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, block) != key:
                    if key:
                        done.append((*key, tree.finish().decode(), -(-n // FAN**depth)))
                    key, n, tree = (name, block), size, OpenTree(levels_of(size, depth))
                tree.append(digest.encode())
            yield _rows(done, ROOTS)
            done = []
        if key:
            yield _rows([(*key, tree.finish().decode(), -(-n // FAN**depth))], ROOTS)

    rows = _dealt(_in_blocks(nodes, depth).select("tree", "block", "pos", "digest", "n")).select("tree", "block", "digest", "n")
    return stored(rows.mapInArrow(grown, "tree string, pos long, digest string, n long"))


def _levels(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` and the levels of block roots above them, up to one node a tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(_block_roots(levels[-1], depth))
    return levels


_PATH = "array<struct<left:string,right:string>>"
_HEADS = f"tree string, pos long, path {_PATH}, subroot string, root string"
ROOTS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
HEADS = pa.schema([
    ("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())
])
PROOFS = pa.schema([
    ("id", pa.int64()), ("source", pa.string()), ("position", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
    ("proof_sha256", pa.string()), ("folded_root", pa.string()),
])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _witnessed(nodes: DataFrame, heads: DataFrame, depth: int, leaves: bool = False) -> DataFrame:
    """The witnesses of ``nodes`` up to the root: used up for ``leaves``, else kept, as heads of the blocks below.

    ``heads(tree, pos, path, subroot, root)`` have the witness of each block's own root. A head comes before the
    nodes of its block, which replay their appends; what they have gathered is then extended by it.
    """

    def extended(block: OpenTree, waiting: list, path: list[dict], subroot: str, root: str) -> list[tuple]:
        block.finish()
        done = []
        for node, w in waiting:
            for level in path:
                w.begin(level["left"].encode())
                w.sibling(level["right"].encode())
                w.close()
            if leaves:
                done.append((node["id"], node["source"], node["pos"], node["digest"], subroot, root, w.proof.hexdigest(), w.own.decode()))
            else:
                levels = [{"left": a.decode(), "right": b.decode()} for a, b in w.levels]
                done.append((node["tree"], node["pos"], levels, subroot, root))
        return done

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, block, waiting = None, OpenTree(0), []
        for batch in batches:
            done = []
            for node in batch.to_pylist():
                if node["pos"] < 0:
                    if head:
                        done += extended(block, waiting, *head)
                    head, block, waiting = (node["path"], node["subroot"], node["root"]), None, []
                    continue
                if block is None:
                    block = OpenTree(levels_of(node["n"], depth))
                w = Fold((node["claimed"] or node["digest"]).encode()) if leaves else Path()
                waiting.append((node, w))
                block.append(node["digest"].encode(), w)
            yield _rows(done, PROOFS if leaves else HEADS)
        if head:
            yield _rows(extended(block, waiting, *head), PROOFS if leaves else HEADS)

    heads = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    rows = _dealt(_in_blocks(nodes, depth).unionByName(heads, allowMissingColumns=True))
    schema = "id long, source string, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" if leaves else _HEADS
    return rows.mapInArrow(replayed, schema)


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", source: str = "source", claimed: Mapping[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, source, position, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of ``docs``.

    ``leaf`` is the digest of a row's ``fields``. Leaves of a ``source`` (nulls are one) ascend by ``key`` (a long;
    nulls first, equal ones by their digests) and are hashed in runs of 16, level by level, to ``subroot``; the
    subroots, by source with null first and else by bytes, in the same way to ``root``. ``proof_sha256`` is the
    digest of all siblings on the way to the root, level by level and from left to right. ``claimed`` replaces
    fields by what is to be verified: ``folded_root`` comes from that leaf and the siblings, and ``verified`` tells
    whether it is the root. Blocks have ``16 ** depth`` leaves, which changes no result. Texts are hashed whole in the JVM, however long; repeated rows are leaves of their own;
    other columns are ignored; an empty table gives no rows.
    """
    claimed = dict(claimed or {})
    columns = {f: F.col(f"`{f}`") for f in fields}
    changed = functools.reduce(Column.__or__, (~c.eqNullSafe(columns[f]) for f, c in claimed.items()), F.lit(False))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("")).alias("tree"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{source}`").alias("source"),
        digest_of([*columns.values()]).alias("digest"), F.when(changed, digest_of([*(columns | claimed).values()])).alias("claimed"),
    )
    leaves = _numbered(stored(leaves), ["tree", "id", "digest"])
    own = _levels(leaves.select("tree", "pos", "digest", "n"), depth)
    # sources, in order, are the leaves of the last tree
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = _numbered(subroots, ["tree", "name"])
    top = _levels(subroots.select("tree", "pos", "digest", "n"), depth)
    none = F.array().cast(_PATH)
    heads = top[-1].select("tree", "pos", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in top[-2::-1]:
        heads = stored(_witnessed(nodes, heads, depth))
    # a source's one node at its top is the subroot, whose witness leads on to the root
    heads = subroots.join(heads.select("pos", "path", "root"), "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    heads = stored(heads)
    for nodes in own[-2:0:-1]:
        heads = stored(_witnessed(nodes, heads, depth))
    proofs = _witnessed(leaves, heads, depth, leaves=True)
    return proofs.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same manifest in DuckDB, with the fifth of the rows whose crc32 five divides lower-cased; the table is called documents.
ORACLE = """
WITH RECURSIVE crcs AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  )) AS crc
  FROM documents
), fields AS (
  SELECT doc_id, source, crc % 5 = 0 AS tampered,
    coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS own,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS folded
  FROM crcs
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(front || own) AS leaf, sha256(front || CASE WHEN tampered THEN folded ELSE own END) AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(front || own)) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM fields
), up(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY tree, level, pos // 16, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top(level, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, pos // 16, n
), runs AS (
  SELECT l.tree, l.pos, u.level, u.digest, u.pos AS place, l.pos // (16 ** u.level)::BIGINT AS mine
  FROM leaves l JOIN up u ON u.tree = l.tree AND u.n > 1 AND u.pos // 16 = l.pos // (16 ** (u.level + 1))::BIGINT
  UNION ALL
  SELECT l.tree, l.pos, 100 + t.level, t.digest, t.pos, s.pos // (16 ** t.level)::BIGINT
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN top t ON t.n > 1 AND t.pos // 16 = s.pos // (16 ** (t.level + 1))::BIGINT
), steps AS (
  SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY level) AS step, before, after FROM (
    SELECT tree, pos, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place > mine), '') AS after
    FROM runs GROUP BY tree, pos, level
  )
), folds(tree, pos, step, digest) AS (
  SELECT tree, pos, 0::BIGINT, claimed FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, s.step, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step + 1
), proofs AS (
  SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY tree, pos
), ends AS (
  SELECT tree, pos, max_by(digest, step) AS folded_root FROM folds GROUP BY tree, pos
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified, l.pos AS position
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN top r ON r.n = 1 JOIN ends e ON e.tree = l.tree AND e.pos = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
"""
