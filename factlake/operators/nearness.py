"""Exact pairs of near vectors within groups, in tasks of bounded size.

A large group is cut into *cells* around pivots. A vector's home is the cell of its nearest pivot; it also
visits every earlier cell whose pivot is farther from it by no more than twice the radius, which is where
a neighbour can be at home. A cell's rows are dealt to blocks, and every two blocks that may hold pairs
make a *tile*: a task compares tiles, none of which is larger than two blocks, whatever the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.sources.shared import sorted_groups, stored

#: Rows of a cell, about, and of a block at most on the average; pivots of a group at most; rows that are placed together.
CELL, BLOCK, PIVOTS, DEALT = 2048, 512, 256, 20_000
#: Rows in cells that a task gives out together.
PLACED = 10_000
#: What floating point may add to a distance.
SLACK = 1e-6


def _unit(rows: DataFrame) -> DataFrame:
    """``(grp, id, seq, lead, unit)``: vectors of length 1 as bytes, without those that are null, zero or not finite."""

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = []
            for v in pdf["embedding"]:
                x = np.asarray(v, np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                x = x / top if top > 0 and np.isfinite(top) else x
                length = math.sqrt(float(x @ x)) if len(x) else 0.0
                units.append((x / length).tobytes() if length > 0 and np.isfinite(length) else None)
            yield pdf.drop(columns="embedding").assign(unit=units)

    kinds = dict(rows.dtypes)
    named = rows.select("grp", "id", "seq", "lead", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    found = named.mapInPandas(scaled, f"grp string, id {kinds['id']}, seq {kinds['seq']}, lead boolean, unit binary").where("unit is not null")
    return found.withColumn("grp", F.concat_ws(":", F.octet_length("unit").cast("string"), "grp"))  # vectors of other lengths don't meet


def _placed(rows: DataFrame, sizes: DataFrame, radius: float) -> DataFrame:
    """``rows`` of large groups in their cells: ``(…, cell, home)``, a row for the home and one for each visit."""
    columns = rows.columns
    share = F.least(F.ceil(F.col("n") / CELL) * 2, F.lit(PIVOTS)) / F.col("n")
    large = rows.join(sizes.select("grp", "n", "first"), "grp")
    picked = large.where((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share * float(1 << 40)) | (F.col("id") == F.col("first")))
    picked = picked.select("grp", "unit", F.row_number().over(Window.partitionBy("grp").orderBy("id")).alias("pivot"))
    salts = F.ceil(F.col("n") / DEALT).cast("long")
    own = large.select(*columns, F.lit(1).alias("side"), F.lit(0).alias("pivot"), F.pmod(F.xxhash64("id"), salts).alias("salt"))
    pivots = stored(picked).join(sizes.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")), "grp").withColumn("side", F.lit(0))
    dealt = own.unionByName(pivots, allowMissingColumns=True).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "side", "pivot")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            for now, part in pdf.groupby(["grp", "salt"], sort=False):
                if now != key:
                    key, held = now, []
                held += [np.frombuffer(u, np.float64) for u in part.loc[part["side"] == 0, "unit"]]
                part = part[part["side"] == 1]
                if len(part):
                    dots = np.stack([np.frombuffer(u, np.float64) for u in part["unit"]]) @ np.stack(held).T
                    apart = np.sqrt(np.maximum(2 - 2 * dots, 0))
                    home = apart.argmin(axis=1)
                    reach = apart.min(axis=1, keepdims=True) + 2 * radius + SLACK
                    at, cell = np.nonzero((apart <= reach) & (np.arange(len(held)) <= home[:, None]))
                    for k in range(0, len(at), PLACED):
                        some, its = at[k : k + PLACED], cell[k : k + PLACED]
                        yield part.iloc[some][columns].assign(cell=its, home=its == home[some])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInPandas(place, f"{schema}, cell int, home boolean")


def tiles(rows: DataFrame, radius: float) -> DataFrame:
    """``(grp, cell, i, j, side, id, seq, lead, unit)``: the rows of each tile, on its left side (0) or its right one (1).

    ``rows(grp, id, seq, lead, unit)``; pairs need a lead. Blocks hold either leads (L) or others (O), at home (H) or on
    a visit (V). Tiles are of LH with every block and of OH with LV; a block of LH meets itself in a tile that has
    a left side only.
    """
    sizes = stored(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("leads"), F.min("id").alias("first")).where("leads > 0 and n > 1"))
    cut = F.col("n") > CELL if radius < 1 else F.lit(False)  # unit vectors lie within 2: from a radius of 1 on all rows would visit all cells
    small = rows.join(sizes.where(~cut).select("grp"), "grp").withColumns({"cell": F.lit(0), "home": F.lit(True)})
    placed = stored(small.unionByName(_placed(rows, sizes.where(cut), radius)) if radius < 1 else small)
    number = lambda home, lead: F.ceil(F.count_if((F.col("home") == home) & (F.col("lead") == lead)) / BLOCK).cast("int")
    counts = placed.groupBy("grp", "cell").agg(number(True, True).alias("lh"), number(True, False).alias("oh"), number(False, True).alias("lv"), number(False, False).alias("ov"))
    counts = stored(counts.where("lh + lv > 0"))
    each = placed.join(counts, ["grp", "cell"])
    lh, oh, lv, ov = (F.col(c) for c in ("lh", "oh", "lv", "ov"))
    size = F.when(F.col("home"), F.when(F.col("lead"), lh).otherwise(oh)).otherwise(F.when(F.col("lead"), lv).otherwise(ov))
    before = F.when(F.col("home"), F.when(F.col("lead"), 0).otherwise(lh)).otherwise(F.when(F.col("lead"), lh + oh).otherwise(lh + oh + lv))
    each = each.withColumn("b", before + F.pmod(F.xxhash64("id", "cell"), size).cast("int"))
    b = F.col("b")

    def span(low: Column, high: Column) -> Column:
        """``low`` to below ``high``."""
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    zero = F.lit(0)
    left = F.when(F.col("home") & F.col("lead"), span(b, lh + oh + lv + ov)).when(F.col("home"), span(lh + oh, lh + oh + lv)).otherwise(F.array().cast("array<int>"))
    right = F.when(F.col("home") & F.col("lead"), span(zero, b)).when(~F.col("home") & F.col("lead"), span(zero, lh + oh)).otherwise(span(zero, lh))
    at = F.concat(F.transform(left, lambda j: F.struct(F.lit(0).alias("side"), b.alias("i"), j.alias("j"))), F.transform(right, lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), b.alias("j"))))
    return each.withColumn("t", F.explode(at)).select("grp", "cell", "t.i", "t.j", "t.side", "id", "seq", "lead", "unit")


def near_pairs(rows: DataFrame, below: float, least: float = 0.0, newer_leads: bool = False, nearest: int | None = None, first: bool = False) -> DataFrame:
    """Pairs ``(older, newer, distance)`` within a group with ``least <= distance < below``, older by (seq, id).

    ``rows(grp, id, seq, lead, embedding)``; ``distance`` is 1 - cosine to six places. One of a pair is a ``lead``, the
    newer one if ``newer_leads``. Only the ``nearest`` older ones of each newer one may be asked for (ties by id), or
    the ``first`` newer one of each older one (by seq and id): then tiles keep no more than that, and what is shuffled
    does not grow with the pairs. Vectors that are null, zero or not finite, and rows whose ``seq`` or ``id`` is null, have no pairs.
    """
    radius = math.sqrt(2 * min(2.0, below + SLACK)) + SLACK
    keys = ["grp", "cell", "i", "j"]
    held = stored(_unit(rows.where("id is not null and seq is not null and grp is not null")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, keys):
            x = np.stack([np.frombuffer(u, np.float64) for u in g["unit"]])
            ids, seq, lead = g["id"].to_numpy(), g["seq"].to_numpy(), g["lead"].to_numpy()
            left = np.flatnonzero(g["side"].to_numpy() == 0)
            right = left if g["i"].iloc[0] == g["j"].iloc[0] else np.flatnonzero(g["side"].to_numpy() == 1)
            apart = 1 - x[left] @ x[right].T
            a, b = np.nonzero((apart < below + SLACK) & (apart >= least - SLACK))
            distance = np.floor(apart[a, b] * 1e6 + 0.5) / 1e6 + 0.0
            a, b = left[a], right[b]
            kept = (distance >= least) & (distance < below) & (ids[a] != ids[b])
            kept &= (a < b) if right is left else True
            a, b, distance = a[kept], b[kept], distance[kept]
            swap = (seq[a] > seq[b]) | ((seq[a] == seq[b]) & (ids[a] > ids[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            if newer_leads:
                kept = lead[b]
                a, b, distance = a[kept], b[kept], distance[kept]
            pairs = pd.DataFrame({"older": ids[a], "newer": ids[b], "distance": distance, "seen": seq[b]})
            if nearest:
                pairs = pairs.sort_values(["distance", "older"]).groupby("newer", sort=False).head(nearest)
            elif first:
                pairs = pairs.sort_values(["seen", "newer"]).groupby("older", sort=False).head(1)
            yield pairs

    kinds = dict(rows.dtypes)
    found = tiles(held, radius).repartition(*keys).sortWithinPartitions(*keys, "side")
    found = found.mapInPandas(compare, f"older {kinds['id']}, newer {kinds['id']}, distance double, seen {kinds['seq']}")
    found = found.withColumn("distance", F.round("distance", 6))
    if nearest == 1:
        best = found.groupBy("newer").agg(F.min(F.struct("distance", "older")).alias("m"))
        return best.select("m.older", "newer", "m.distance")
    if nearest:
        order = Window.partitionBy("newer").orderBy("distance", "older")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest).select("older", "newer", "distance")
    if first:
        best = found.groupBy("older").agg(F.min(F.struct("seen", "newer", "distance")).alias("m"))
        return best.select("older", "m.newer", "m.distance")
    return found.select("older", "newer", "distance")
