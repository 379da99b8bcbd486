"""A quality classifier: histogram gradient-boosted trees over document statistics (operator 2).

The trees are grown on quantised statistics of a bounded, hash-drawn sample of labelled documents,
then flattened into arrays that numpy walks for many documents at once, one level a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import carried, restored

#: Statistics of a text, in this order.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "upper", "digits", "blanks", "beyond_ascii", "marks", "stops", "commas",
    "symbols", "quotes", "brackets", "slashes", "bars", "commonest_mark", "mark_kinds", "log_lines", "line_bytes", "distinct_lines",
    "longest_line", "ends_in_stop", "short_words", "long_words", "commonest_word", "entropy", "repeated_marks",
)
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blanks": b" \t\r\n\v\f", "beyond_ascii": bytes(range(128, 256)), "stops": b".!?",
    "commas": b",;:", "symbols": b"#$%&*+<=>@^_`~", "quotes": b"\"'", "brackets": b"()[]{}", "slashes": b"/\\", "bars": b"|-",
}
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_RUNS = re.compile(rb"([!-/:-@\[-`{-~])\1")
_MEMBERS = np.zeros((256, len(_KINDS)))
for _j, _letters in enumerate(_KINDS.values()):
    _MEMBERS[list(_letters), _j] = 1


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all are finite, also for an empty one."""
    raw = text.encode("utf-8")
    n = len(raw) or 1
    words = raw.split()
    w = len(words) or 1
    lines = raw.split(b"\n")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = dict(zip(_KINDS, (counts @ _MEMBERS / n).tolist()))
    marks = counts[_MARKS]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    p = counts[counts > 0] / n
    often: dict[bytes, int] = {}
    for x in words:
        often[x] = often.get(x, 0) + 1
    filled = [x for x in lines if x.strip()]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lengths.sum()) / w, len(often) / w, shares["upper"], shares["digits"], shares["blanks"],
        shares["beyond_ascii"], float(marks.sum()) / n, shares["stops"], shares["commas"], shares["symbols"], shares["quotes"], shares["brackets"],
        shares["slashes"], shares["bars"], float(marks.max()) / n, float((marks > 0).sum()), np.log1p(len(lines)), len(raw) / len(lines),
        len({*filled}) / (len(filled) or 1), max(map(len, lines)) / n, sum(x.rstrip().endswith((b".", b"!", b"?")) for x in filled) / (len(filled) or 1),
        float((lengths <= 2).sum()) / w, float((lengths >= 12).sum()) / w, max(often.values(), default=0) / w, float(-(p * np.log2(p)).sum()),
        len(_RUNS.findall(raw)) / w,
    ]


@dataclass
class BoostedTrees:
    """Flattened trees. Node ``i`` sends a row to ``left[i]`` if its statistic ``feature[i]`` is at most
    ``threshold[i]``, else to ``left[i] + 1``; leaves send rows to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, one level a step."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.feature[at] < 0
            right = x[rows, np.maximum(self.feature[at], 0)] > self.threshold[at]
            at = np.where(leaf, at, self.left[at] + right)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0) -> BoostedTrees:
    """Grow the trees level by level from gradient histograms over quantiles of the statistics."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1) if len(x) else np.zeros((0, len(STATISTICS)), int)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    score = np.full(len(y), base)

    def node() -> int:
        for column, blank in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            column.append(blank)
        return len(feature) - 1

    offsets = np.arange(x.shape[1]) * bins
    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for at_depth in range(depth + 1):
            deeper = []
            for i, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[i] = -rate * gs / (hs + 1)
                best = (1e-6, -1, -1)
                if at_depth < depth:
                    cells = (binned[rows] + offsets).ravel()
                    size = bins * x.shape[1]
                    hist_g = np.bincount(cells, np.repeat(g[rows], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    hist_h = np.bincount(cells, np.repeat(h[rows], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    gain = hist_g**2 / (hist_h + 1) + (gs - hist_g) ** 2 / (hs - hist_h + 1) - gs**2 / (hs + 1)
                    gain[(hist_h < least) | (hs - hist_h < least)] = 0
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] > best[0] and b < len(cuts[j]):
                        best = (gain[j, b], j, b)
                if best[1] < 0:
                    score[rows] += value[i]
                    continue
                _, j, b = best
                feature[i], threshold[i], left[i] = int(j), float(cuts[j][b]), node()
                node()
                low = binned[rows, j] <= b
                deeper += [(left[i], rows[low]), (left[i] + 1, rows[~low])]
            level = deeper
    return BoostedTrees(np.array(roots, int), np.array(feature or [-1]), np.array(threshold or [0.0]), np.array(left or [0]), np.array(value or [0.0]), base, depth)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``stats``, an array in the order of :data:`STATISTICS`."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found, pa.list_(pa.float64()))], ["kept", "stats"])

    rows = carried(docs, keep, F.coalesce("text", F.lit("")).alias("text"))
    return restored(rows.mapInArrow(measured, f"kept {rows.schema['kept'].dataType.simpleString()}, stats array<double>"))


def train(docs: DataFrame, labels: DataFrame, where: Column, most: int = 12_000, label: str = "quality") -> BoostedTrees:
    """Fit on documents labelled 0 or 1 in ``labels(doc_id, quality)``.

    ``most`` bounds the sample: rows of ``labels`` are drawn by hash to about that many, at every size
    of the corpus. Rows without a document or a label are passed over. Only statistics, never texts,
    come to the driver. Labels and ids that repeat count as often as they stand there.
    """
    marked = labels.where(where & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("__y"))
    n = marked.count()
    few = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, most / max(n, 1)) * (1 << 40)))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    found = with_statistics(rows, ["doc_id", "__y"]).collect()
    found.sort(key=lambda r: (r["doc_id"], r["__y"], r["stats"]))
    x = np.array([r["stats"] for r in found]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["__y"] for r in found]))


def score(docs: DataFrame, model: BoostedTrees, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: ``doc_id``) of ``docs`` and ``score`` (0 to 1; label 1 is likelier if higher).

    Texts are measured whole; a null text counts as empty and is scored as such. Repeated rows give
    repeated results; without labelled rows every score is 0.5; an empty table gives no rows. Kept columns
    may have any name, but one called ``score`` gives way to the result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = carried(docs, keep or ["doc_id"], F.coalesce("text", F.lit("")).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("text")]
            p = held.value.probability(np.array(found).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(p)], ["kept", "score"])

    return restored(rows.mapInArrow(scored, f"kept {rows.schema['kept'].dataType.simpleString()}, score double"))
