"""Compression of vectors to short codes by dual-tree Lloyd iterations (operator 13).

Vectors are cut into equal parts, and each part position has a codebook. To assign all parts to their
nearest entries, a tree over a block's parts and a tree over the entries are descended together: a pair
of nodes is pruned where bounds on distances show that no part of the one has its nearest entry in the
other. A node of parts that is left with one entry is assigned as a whole, by its cached sums; parts of
leaves that stay uncertain are compared with the entries that are left. All bounds and distances are
those of integers, so ties and borders are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import stored

#: Bytes of vectors in a block at most, and parts in a leaf of its trees, about.
BLOCK_BYTES, LEAF = 1 << 20, 16
#: The largest value of the result's columns.
MOST = (1 << 63) - 1
#: Labels up to this many have their errors broadcast; more are joined by shuffle.
BROADCAST_LABELS = 50_000


def whole_numbers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """``floor(scale * x)``; as Python's integers if ``wide``."""
    if not wide:
        return np.floor(scale * x).astype(np.int64)
    exact = np.empty(x.shape, object)
    exact.flat = [math.floor(scale * v) if abs(v) < 2.0**53 else scale * int(v) for v in x.ravel().tolist()]
    return exact


def edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and ``n``: a node's halves are nodes of the next level."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth_of(n: int, leaf: int) -> int:
    """Levels below the root of a tree over ``n`` points, so that leaves have at least ``leaf`` of them."""
    return max(0, (n // leaf).bit_length() - 1) if n else 0


def order_of(x: np.ndarray, leaf: int) -> np.ndarray:
    """Points in the order of their tree: each node is halved at the median of the dimension in which it is widest."""
    order = np.arange(len(x))
    for level in range(depth_of(len(x), leaf)):
        begin = edges(len(x), level)
        now = x[order]
        widest = (np.maximum.reduceat(now, begin[:-1]) - np.minimum.reduceat(now, begin[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(begin))
        order = order[np.lexsort((now[np.arange(len(x)), widest[node]], node))]
    return order


@dataclass
class Tree:
    """A tree over integer points ``x``, which are in its order: for each level the boxes, sums and sizes of its nodes."""

    x: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    begin: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, leaf: int) -> Tree:
        depth = depth_of(len(x), leaf)
        begin = [edges(len(x), k) for k in range(depth + 1)]
        low, high, sums = ([f.reduceat(x, begin[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
        for _ in range(depth):
            for levels, f in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
                levels.insert(0, f(levels[0][::2], levels[0][1::2]))
        return cls(x, low, high, sums, begin)


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


class Assignment:
    """The nearest entry of every part in a tree: ``code`` by its order, and the sums and counts of each entry's parts.

    ``pairs`` counts the pairs of a part and an entry that were compared one by one.
    """

    def __init__(self, tree: Tree, book: np.ndarray):
        self.tree, self.book, self.pairs = tree, book, 0
        self.code = np.zeros(len(tree.x), np.int64)
        self.sums = np.zeros(book.shape, book.dtype)
        self.counts = np.zeros(len(book), np.int64)
        seen: dict[tuple, int] = {}
        for k, entry in enumerate(book.tolist()):
            seen.setdefault(tuple(entry), k)  # of equal entries only the first is ever the nearest
        own = np.array([*seen.values()])
        own = own[order_of(book[own].astype(float), 1)]
        self.entries = Tree.of(book[own], 1)
        self.index = own  # of an entry's place in its tree
        self._descend()

    def _descend(self) -> None:
        tree, entries = self.tree, self.entries
        deepest = len(entries.low) - 1
        node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
        last = len(tree.low) - 1
        for level in range(last + 1):
            down = min(level, deepest)
            single = level >= deepest
            if single and level == deepest:  # leaves of the entries' tree hold one or two
                begin = entries.begin[deepest]
                node, other = self._spread(node, begin[other], begin[other + 1])
            node, other = self._pruned(level, node, other, None if single else down)
            if single:
                node, other = self._settled(level, node, other)
            if not len(node):
                return
            if level < last:
                if level < deepest:
                    node, other = (np.concatenate([2 * node + i for i in (0, 0, 1, 1)]), np.concatenate([2 * other + j for j in (0, 1, 0, 1)]))
                else:
                    node, other = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([other, other])
                sort = np.argsort(node, kind="stable")
                node, other = node[sort], other[sort]
        if last < deepest:
            begin = entries.begin[down]
            node, other = self._spread(node, begin[other], begin[other + 1])
            node, other = self._pruned(last, node, other, None)
            node, other = self._settled(last, node, other)
        self._compared(last, node, other)

    @staticmethod
    def _spread(node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node with all numbers from ``low`` to below ``high``."""
        n = high - low
        ends = np.cumsum(n)
        return np.repeat(node, n), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(low, n)

    def _pruned(self, level: int, node: np.ndarray, other: np.ndarray, down: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that may hold a nearest entry; ``other`` are nodes of level ``down``, or entries."""
        if not len(node):
            return node, other
        low, high = self.tree.low[level][node], self.tree.high[level][node]
        to_low, to_high = (self.entries.x[other],) * 2 if down is None else (self.entries.low[down][other], self.entries.high[down][other])
        nearest = _square(np.maximum(np.maximum(low - to_high, to_low - high), 0))
        farthest = _square(np.maximum(high - to_low, to_high - low))
        first = _first_of(node)
        sizes = np.diff(np.append(first, len(node)))
        # every part of a node has an entry within the least of its farthest distances
        kept = nearest <= np.repeat(np.minimum.reduceat(farthest, first), sizes)
        if down is not None:
            return node[kept], other[kept]
        # and entries that are farther than one chosen entry from all of the box
        least = np.repeat(np.minimum.reduceat(farthest, first), sizes)
        place = np.where(farthest == least, np.arange(len(node)), len(node))
        chosen = np.repeat(other[np.minimum.reduceat(place, first)], sizes)
        a, b = self.entries.x[chosen], self.entries.x[other]
        step = 2 * (b - a)
        gain = _square(a) - _square(b) + np.where(step > 0, step * high, step * low).sum(axis=-1)
        # the most by which the chosen entry can be farther than the other
        kept &= (gain > 0) | ((gain == 0) & (self.index[other] < self.index[chosen])) | (other == chosen)
        return node[kept], other[kept]

    def _settled(self, level: int, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Assign nodes that are left with one entry, by their sums; return the others."""
        if not len(node):
            return node, other
        first = _first_of(node)
        sizes = np.diff(np.append(first, len(node)))
        alone = first[sizes == 1]
        n, e = node[alone], self.index[other[alone]]
        begin, end = self.tree.begin[level][n], self.tree.begin[level][n + 1]
        np.add.at(self.sums, e, self.tree.sums[level][n])
        np.add.at(self.counts, e, end - begin)
        entry, at = self._spread(e, begin, end)
        self.code[at] = entry
        rest = np.repeat(sizes > 1, sizes)
        return node[rest], other[rest]

    def _compared(self, level: int, node: np.ndarray, other: np.ndarray) -> None:
        """Compare the parts of uncertain leaves with their entries, one by one; of equally near ones the first counts."""
        if not len(node):
            return
        begin = self.tree.begin[level]
        pair, at = self._spread(np.arange(len(node)), begin[node], begin[node + 1])
        sort = np.argsort(at, kind="stable")
        pair, at = pair[sort], at[sort]
        self.pairs += len(at)
        entry = self.index[other[pair]]
        apart = _square(self.tree.x[at] - self.book[entry])
        first = _first_of(at)
        sizes = np.diff(np.append(first, len(at)))
        best = np.repeat(np.minimum.reduceat(apart, first), sizes)
        code = np.minimum.reduceat(np.where(apart == best, entry, len(self.book)), first)
        at = at[first]
        self.code[at] = code
        np.add.at(self.sums, code, self.tree.x[at])
        np.add.at(self.counts, code, 1)


def _blocks(rows: DataFrame, dims: int, parts: int, scale: int) -> DataFrame:
    """``(ids, labels, x, orders, top)``: vectors in blocks, with the orders of each part's tree and the largest component."""
    size = max(64, BLOCK_BYTES // (8 * dims))
    width = dims // parts
    label = rows.schema["label"].dataType.simpleString()

    def made(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).combine_chunks()
        lists = table.column("vector").combine_chunks()
        x = np.asarray(lists.flatten(), np.float64).reshape(-1, dims)
        orders = np.stack([order_of(x[:, k * width : (k + 1) * width], LEAF) for k in range(parts)]).astype(np.int32)
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(c).combine_chunks())
        columns = [whole("id"), whole("label"), pa.array([x.tobytes()], pa.binary()), pa.array([orders.tobytes()], pa.binary()), pa.array([float(np.abs(x).max())])]
        return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "x", "orders", "top"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return stored(rows.mapInArrow(gathered, f"ids array<bigint>, labels array<{label}>, x binary, orders binary, top double"))


def _trees(x: bytes, orders: bytes, dims: int, parts: int, scale: int, wide: bool) -> Iterator[tuple[Tree, np.ndarray]]:
    """The tree of each part of a block, and its order."""
    whole = whole_numbers(np.frombuffer(x, np.float64).reshape(-1, dims), scale, wide)
    for k, order in enumerate(np.frombuffer(orders, np.int32).reshape(parts, -1)):
        width = dims // parts
        yield Tree.of(whole[order, k * width : (k + 1) * width], LEAF), order


def _moved(blocks: DataFrame, books: list[np.ndarray], dims: int, scale: int, wide: bool) -> list[np.ndarray]:
    """One round: every part is assigned, and used entries move to the floor of their parts' means.

    Sums come from the cached ones of whole nodes and from uncertain leaves, are added up in each task, and then by
    Spark, for each entry: what comes to the driver is as large as the codebooks.
    """
    parts, entries, width = len(books), len(books[0]), dims // len(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), object if wide else np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for x, orders in zip(batch.column("x"), batch.column("orders")):
                for k, (tree, _) in enumerate(_trees(x.as_py(), orders.as_py(), dims, parts, scale, wide)):
                    done = Assignment(tree, books[k])
                    sums[k] += done.sums
                    counts[k] += done.counts
        at = np.argwhere(counts > 0)
        text = [[str(v) for v in sums[k, e].tolist()] for k, e in at] if wide else [sums[k, e].tolist() for k, e in at]
        columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[counts > 0], pa.int64()), pa.array(text, pa.list_(pa.string() if wide else pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    found = blocks.select("x", "orders").mapInArrow(summed, f"part int, entry int, n long, sums array<{'string' if wide else 'bigint'}>")
    if wide:  # numbers that no column type holds: a row for each task and entry is added up by Python

        def added(pdf):
            sums = [str(sum(map(int, column))) for column in zip(*pdf["sums"])]
            return pdf.iloc[:1].assign(n=pdf["n"].sum(), sums=[sums])

        found = found.groupBy("part", "entry").applyInPandas(added, found.schema)
    else:
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    books = [b.copy() for b in books]
    for row in found.collect():
        books[row["part"]][row["entry"]] = [int(s) // row["n"] for s in row["sums"]]
    return books


def _coded(blocks: DataFrame, books: list[np.ndarray], dims: int, scale: int, wide: bool) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector."""
    parts = len(books)
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                codes = np.zeros((len(ids), parts), np.uint8)
                errors = np.zeros(len(ids), object if wide else np.int64)
                for k, (tree, order) in enumerate(_trees(batch.column("x")[i].as_py(), batch.column("orders")[i].as_py(), dims, parts, scale, wide)):
                    code = Assignment(tree, books[k]).code
                    codes[order, k] = code
                    errors[order] += _square(tree.x - books[k][code])
                text = codes.tobytes().hex()
                columns = [ids, batch.column("labels")[i].values, pa.array([text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([min(e, MOST) for e in errors.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "x", "orders").mapInArrow(coded, f"vec_id long, label {label}, code string, error long")


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` of the rows of ``vectors(vec_id, embedding, label)`` that can be coded.

    Components become ``floor(scale * x)``. Each of ``parts`` codebooks begins as that part of the ``entries`` (at
    most 256) smallest ids' vectors (fewer if there are fewer; nulls last, equal ids by their vectors) and takes
    ``rounds`` of Lloyd's iteration, after which all parts are assigned to their nearest entries (of equally near
    ones the first). ``code`` has two hex digits a part, ``error`` is the sum of squared distances (2^63 - 1 if it is
    more), ``label_error`` its sum over equal labels, null ones together. Rows without a vector, with null or
    non-finite components, or with another dimension than the first vector's are dropped, and all where that is not
    a positive multiple of ``parts``. Repeated rows are coded each; components may be as large as doubles are; other
    columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & ~odd)
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(1).collect()
    dims = len(first[0]["vector"]) if first else 0
    if not dims or dims % parts:
        rows, dims = rows.limit(0), parts
    rows = rows.where(F.size("vector") == dims)
    start = [r["vector"] for r in rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()]
    blocks = _blocks(rows, dims, parts, scale)
    top = scale * (blocks.agg(F.max("top")).first()[0] or 0.0) + 1
    wide = not 8 * dims * top * top < 2.0**62  # squares and differences of squares, summed over a part
    whole = whole_numbers(np.array(start, np.float64).reshape(-1, dims), scale, wide)
    books = [*np.split(whole, parts, axis=1)] if start else []
    for _ in range(rounds if start else 0):
        books = _moved(blocks, books, dims, scale, wide)
    coded = stored(_coded(blocks, books, dims, scale, wide)) if start else blocks.select(F.lit(0).cast("long").alias("vec_id"), F.explode("labels").alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = stored(sums.select(F.col("label").alias("of"), "label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    digest = sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    both = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """One assignment in SQL, ``near{k}``, by the codebooks ``book{k}``, and the codebooks that follow."""
    return f"""near{k} AS (
  SELECT vec_id, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (
    SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM components c JOIN book{k} b ON b.p = c.p AND b.j = c.j GROUP BY c.vec_id, c.p, b.e
  ) GROUP BY vec_id, p
), book{k + 1} AS (
  SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT c.p, n.e, c.j, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x FROM components c JOIN near{k} n ON n.vec_id = c.vec_id AND n.p = c.p GROUP BY c.p, n.e, c.j
  ) m ON m.p = b.p AND m.e = b.e AND m.j = b.j
)"""


#: The same codes in DuckDB for tables whose ids are not repeated; the table is called embeddings.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS w, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), components AS (
  SELECT vec_id, label, place, (i - 1) // w AS p, (i - 1) % w AS j, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, unnest(range(1, len(embedding) + 1)) AS s(i)
), book0 AS (
  SELECT p, place - 1 AS e, j, x FROM components WHERE place <= 64
), {_round(0)}, {_round(1)}, {_round(2)}, coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
