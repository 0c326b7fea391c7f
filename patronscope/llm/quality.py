"""A generalised additive model with pairwise interactions for text quality.

Each measure of a text is cut into bins. Boosting goes round the measures again and again; each
step fits a shallow tree to the residuals over one measure's bins and adds it to that measure's
lookup table. Then the pairs of measures that explain most of what is left get tables of two
dimensions in the same way. A score is the sum of one entry of each table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.labelled import labelled_sample
from patronscope.llm.texthash import Buffer, buffers, prefix_sums, span_hash, words_of

# Labelled rows of either class used in training: a documented bound.
PER_CLASS = 6000
HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, false)"
BINS, PAIR_BINS, PAIRS = 32, 8, 8

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~",
    "bracket": b"()[]\"'-",
    "high": bytes(range(128, 256)),
}
CLASSES = np.array([[b in chosen for b in range(256)] for chosen in _SETS.values()], np.int64)
MEASURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "lines_per_kb",
    "distinct_lines", "long_words", *_SETS,
)


def measure(texts) -> np.ndarray:
    """One row of ``MEASURES`` for each whole text; an empty or null one has zeros."""
    found = np.zeros((len(texts), len(MEASURES)))
    for b in buffers(texts):
        found[b.first : b.last] = _measure_buffer(b)
    return found


def _measure_buffer(b: Buffer) -> np.ndarray:
    n, size = len(b.start), (b.end - b.start)
    w = words_of(b)
    count = np.diff(w.of)
    safe, some = np.maximum(size, 1), np.maximum(count, 1)
    by_class = []
    for table in CLASSES:
        sums = np.append(0, np.cumsum(table[b.bytes]))
        by_class.append((sums[b.end] - sums[b.start]) / safe)
    distinct, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        own = w.hash[w.of[i] : w.of[i + 1]]
        if len(own):
            kinds = np.unique(own, return_counts=True)[1]
            distinct[i], top[i] = len(kinds), kinds.max()
    breaks = np.flatnonzero(b.bytes == 10)
    sums, down = prefix_sums(b.bytes.astype(np.uint64) + np.uint64(1))
    lines, kinds = np.ones(n), np.ones(n)
    first, last = np.searchsorted(breaks, b.start), np.searchsorted(breaks, b.end)
    for i in range(n):
        if last[i] > first[i]:
            cut = breaks[first[i] : last[i]]
            starts, ends = np.append(b.start[i], cut + 1), np.append(cut, b.end[i])
            lines[i], kinds[i] = len(starts), len(np.unique(span_hash(sums, down, starts, ends)))
    letters = size - by_class[2] * safe
    columns = [
        np.log1p(size),
        np.log1p(count),
        letters / some,
        distinct / some,
        top / some,
        1000 * lines / safe * (size > 0),
        kinds / lines * (size > 0),
        np.sqrt(letters / some) * (count > 0),
        *by_class,
    ]
    return np.column_stack(columns)


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(
            [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        )

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        coarse = bins * PAIR_BINS // BINS
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[:, a], coarse[:, b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of a run of bins into two; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
    k = int(gain.argmax())
    won = float(gain[k] - all_g**2 / (all_h + 1))
    return (won, k + 1) if won > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step for each bin: a tree that cuts the bins greedily into up to ``leaves`` runs."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        found = [
            (*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        gain, place, start = max(found)
        if not place:
            break
        cuts = sorted([*cuts, start + place])
    step = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step) of a tree over two measures: cut one, then the other on both sides."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(gg)):
            gain, step = 0.0, np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = gg[part].sum(0), hh[part].sum(0)
                place = _best_cut(pg, ph)[1]
                for run in (slice(0, place), slice(place, None)):
                    a, b = pg[run].sum(), ph[run].sum()
                    gain += a * a / (b + 1)
                    step[part, run] = -a / (b + 1)
            if gain > best[0]:
                best = (gain, step.T if turn else step)
    return best


def train(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, pair_rounds: int = 15,
    rate: float = 0.15,
) -> AdditiveModel:
    """Cyclic boosting of log loss: first single measures, then the most useful pairs."""
    n_features = x.shape[1]
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(n_features)]
    model = AdditiveModel(
        float(np.log(share / (1 - share))), edges, np.zeros((n_features, BINS)), [], np.empty(0)
    )
    bins = model.bins(x)
    total = np.full(len(x), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            grad, hess = residual()
            step = rate * _tree(
                np.bincount(bins[:, f], grad, BINS), np.bincount(bins[:, f], hess, BINS)
            )
            model.tables[f] += step
            total += step[bins[:, f]]
    coarse = bins * PAIR_BINS // BINS
    cells = {
        (a, b): coarse[:, a] * PAIR_BINS + coarse[:, b]
        for a in range(n_features)
        for b in range(a + 1, n_features)
    }

    def sums(pair) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = residual()
        return tuple(
            np.bincount(cells[pair], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            for v in (grad, hess)
        )

    gains = sorted(((_pair_tree(*sums(pair))[0], pair) for pair in cells), reverse=True)
    model.pairs = [pair for _, pair in gains[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            step = rate * _pair_tree(*sums(pair))[1]
            model.pair_tables[k] += step
            total += step.ravel()[cells[pair]]
    return model


def _texts(column: pd.Series) -> list[str | None]:
    return [None if pd.isna(t) else t for t in column]


def fit_quality(docs: DataFrame, labels: DataFrame, usable: str = "true") -> AdditiveModel:
    """Train on a bounded sample whose classes weigh as in all usable labels.

    The sample's measures reach the driver, not its texts. Without labels of both classes every
    score is one half.
    """
    sample, counts = labelled_sample(docs, labels, "quality", usable, PER_CLASS)

    def run(batches):
        for rows in batches:
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "y": rows["y"],
                    "x": list(measure(_texts(rows["text"]))),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInPandas(run, f"doc_id {kind}, y int, x array<double>").toPandas()
    if not counts.get(0) or not counts.get(1) or rows["y"].nunique() < 2:
        flat = np.zeros((len(MEASURES), BINS))
        return AdditiveModel(0.0, [np.empty(0)] * len(MEASURES), flat, [], np.empty(0))
    rows = rows.sort_values("doc_id", ignore_index=True)
    y = rows["y"].to_numpy(float)
    true = {k: counts[k] / sum(counts.values()) for k in (0, 1)}
    weight = np.where(y == 1, true[1] / y.mean(), true[0] / (1 - y.mean()))
    return train(np.array(rows["x"].tolist()), y, weight)


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; null and empty texts are scored as empty."""

    def run(batches):
        for rows in batches:
            score = model.score(measure(_texts(rows["text"])))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")


def op7_quality(spark, folder: str) -> DataFrame:
    """Score every document, learning from labels outside the held-out third."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_quality(docs, labels, f"NOT ({HELD_OUT})")
    return score_quality(docs, model).select(
        "doc_id",
        F.expr(HELD_OUT).alias("held_out"),
        "score",
        F.expr("IF(score >= 0.5, 1, 0)").alias("predicted"),
    )
