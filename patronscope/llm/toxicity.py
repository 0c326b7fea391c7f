"""A convolutional text classifier for toxicity, trained in numpy.

Words and their beginnings are hashed to rows of an embedding table, whose sum stands for the word;
so inflected forms of one stem are near each other. Filters over one, two and three neighbouring words
slide over the whole text, each keeps its greatest value (max pooling), and a logistic layer turns
these into a score. The threshold that decides is calibrated for each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.labelled import labelled_rows
from patronscope.llm.shared import Store, parts_for
from patronscope.llm.texthash import NOT_ALNUM, words

# Scores of either class that a threshold is sought on: all, or so many at even ranks among all.
PER_CLASS = 3000
BUCKET_BITS = 15
WIDTHS = (1, 2, 3)
# Beginnings of a word, in bytes, that are embedded along with the whole word.
HEADS = (4, 6)
# Blanks after each text, so that no filter spans two texts and a text without words has a value.
GAP = max(WIDTHS) - 1
# Labelled texts and their bytes that one task trains on together, about.
SHARD_TEXTS, SHARD_BYTES = 1 << 13, 1 << 26
# Numbers that travel together from tasks to sums of them, in rows of an embedding table.
SLICE = 256
# Scores that one task sorts.
SORTED = 1 << 18
# Words that are scored together in training.
WORDS_HELD = 1 << 16
# Rows that a task decides on and passes on together, which bounds its memory.
TOGETHER = 500
# Parts of the labelled rows that are scored by models of the others.
FOLDS = 3
MIN_CALIBRATION = 20
# Least threshold, that of few labels, and the share of clean rows that a threshold may reject.
LOWEST, FALLBACK, MOST_CLEAN = 0.05, 0.5, 0.01
# Training documents that a bucket must occur in to be embedded.
LEAST_SEEN = 4
HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, false)"


@dataclass
class ConvModel:
    """``kernels`` has for each width an array of (offset, dimension, filter)."""

    table: np.ndarray
    kernels: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def score(self, texts) -> np.ndarray:
        scores = np.zeros(len(texts))
        for first, last, ids, start in token_ids(texts):
            scores[first:last] = self.score_ids(ids, start)
        return scores

    def score_ids(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        seen = embed(self.table, ids)
        pooled = np.concatenate(
            [np.maximum.reduceat(convolve(seen, self.kernels[w]), start) for w in WIDTHS],
            axis=1,
        )
        logit = np.maximum(pooled + self.bias, 0) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def dense(self) -> list[np.ndarray]:
        """Trained arrays besides the table."""
        return [*self.kernels.values(), self.bias, self.out, self.shift]


def embed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    seen = table.take(ids[0], axis=0)
    for row in ids[1:]:
        seen += table.take(row, axis=0)
    return seen


def convolve(seen: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Value of every filter at every position; past the end there is nothing to add."""
    value = seen @ kernel[0]
    for t in range(1, len(kernel)):
        value[:-t] += (seen @ kernel[t])[t:]
    return value


def token_ids(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Buckets of the words of whole texts: a row for words, one for each length of ``HEADS``.

    ``GAP`` zeros follow each text; 0 is no word's bucket.
    """
    for w in words(texts, NOT_ALNUM, HEADS):
        n = w.last - w.first
        place = np.arange(len(w.hash)) + GAP * np.repeat(np.arange(n), np.diff(w.of))
        ids = np.zeros((1 + len(HEADS), len(w.hash) + GAP * n), dtype=np.int32)
        for row, hashes in zip(ids, [w.hash, *w.heads], strict=True):
            row[place] = np.maximum(hashes >> np.uint64(64 - BUCKET_BITS), 1)
        yield w.first, w.last, ids, w.of[:-1] + GAP * np.arange(n)


class _Adam:
    """Adam steps; of rows that have a gradient only, if ``rows`` are given."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.t = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def step(self, grad: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        m, v = self.m[rows] / (1 - 0.9**self.t), self.v[rows] / (1 - 0.99**self.t)
        self.value[rows] -= self.rate * m / (np.sqrt(v) + 1e-8)


def evidence(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How surely each bucket tells the classes apart, by the ``n`` documents that have it.

    ``n`` has a row for each class, of ``total`` documents. The signed root of the likelihood ratio
    statistic, less what the most extreme of so many buckets would reach by chance; zero within
    that, and for buckets of fewer than ``LEAST_SEEN`` documents.
    """
    seen = n.sum(axis=0)
    found = np.zeros(1 << BUCKET_BITS)
    used = seen >= LEAST_SEEN
    used[0] = False
    if not used.any() or not total.all():
        return found
    share = total / total.sum()
    parts = np.zeros(used.sum())
    for c in (0, 1):
        have, want = n[c, used], seen[used] * share[c]
        parts += 2 * have * np.log(np.maximum(have, 1e-9) / want)
    sign = np.sign(n[1, used] - seen[used] * share[1])
    chance = np.sqrt(2 * np.log(used.sum() + 1))
    found[used] = sign * np.maximum(np.sqrt(np.maximum(parts, 0)) - chance, 0)
    return found


@dataclass
class _Training:
    """A model in training on ``total`` texts of either class, with buckets too rare to embed."""

    model: ConvModel
    rare: np.ndarray
    total: np.ndarray
    rng: np.random.Generator

    @property
    def share(self) -> np.float32:
        return np.float32(np.clip(self.total[1] / self.total.sum(), 1e-3, 1 - 1e-3))


def untrained(
    n: np.ndarray, total: np.ndarray, dim: int = 12, filters: int = 8, seed: int = 5
) -> _Training:
    """The model that training starts from; see :func:`evidence` for ``n`` and ``total``.

    The first dimension starts from ``evidence``, and the first filter reads it; so few labels
    suffice where single words tell, and training goes on from there. Words of fewer than
    ``LEAST_SEEN`` documents have no embedding, as it would only remember these.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    table[:, 0] = evidence(n, total)
    rare = n.sum(axis=0) < LEAST_SEEN
    rare[0] = True
    table[rare] = 0
    kernels = {w: rng.normal(0, 0.1, (w, dim, filters)).astype(np.float32) for w in WIDTHS}
    bias = np.zeros(filters * len(WIDTHS), dtype=np.float32)
    out = rng.normal(0, 0.1, filters * len(WIDTHS)).astype(np.float32)
    kernels[WIDTHS[0]][:, :, 0] = 0
    kernels[WIDTHS[0]][0, 0, 0] = out[0] = 1
    shift = np.zeros(1, dtype=np.float32)
    return _Training(ConvModel(table, kernels, bias, out, shift), rare, total, rng)


def train(
    start: _Training, docs: list[np.ndarray], y: np.ndarray, passes: int, batch: int = 32
) -> ConvModel:
    """Go round all of ``docs`` by Adam on log loss; classes weigh the same."""
    model, share, rng = deepcopy(start.model), start.share, deepcopy(start.rng)
    table, kernels, bias, out, shift = (
        model.table, model.kernels, model.bias, model.out, model.shift
    )
    dim, filters = table.shape[1], len(out) // len(WIDTHS)
    by_kernel = {w: _Adam(kernels[w], 0.005) for w in WIDTHS}
    by_table, by_bias = _Adam(table, 0.01), _Adam(bias, 0.005)
    by_out, by_shift = _Adam(out, 0.005), _Adam(shift, 0.005)
    for _ in range(passes):
        batches = np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch))
        for chosen in batches:
            if not len(chosen):
                continue
            ids = np.concatenate([docs[i] for i in chosen], axis=1)
            ids[start.rare[ids]] = 0
            sizes = np.array([docs[i].shape[1] for i in chosen])
            begin = np.cumsum(sizes) - sizes
            seen = embed(table, ids)
            pooled, at = [], []
            for w in WIDTHS:
                value = convolve(seen, kernels[w])
                best = np.stack(
                    [s + value[s : s + n].argmax(0) for s, n in zip(begin, sizes, strict=True)]
                )
                at.append(best)
                pooled.append(np.take_along_axis(value, best, axis=0))
            before = np.concatenate(pooled, axis=1) + bias
            hidden = np.maximum(before, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + shift[0], -30, 30)))
            weight = np.where(y[chosen] == 1, 0.5 / share, 0.5 / (1 - share))
            error = (weight * (p - y[chosen]) / len(chosen)).astype(np.float32)
            back = (error[:, None] * out) * (before > 0)
            rows, grads = [], []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * filters : (k + 1) * filters]
                grad = np.zeros_like(kernels[w])
                for t in range(w):
                    place = np.minimum(at[k] + t, len(seen) - 1)
                    grad[t] = np.einsum("bfd,bf->df", seen[place], g)
                    to_table = (g[:, :, None] * kernels[w][t].T[None]).reshape(-1, dim)
                    for row in ids:
                        rows.append(row[place].ravel())
                        grads.append(to_table)
                by_kernel[w].step(grad)
            touched = np.concatenate(rows)
            order = np.argsort(touched, kind="stable")
            used, first = np.unique(touched[order], return_index=True)
            by_table.step(np.add.reduceat(np.concatenate(grads)[order], first), used)
            table[0] = 0
            by_bias.step(back.sum(0))
            by_out.step(hidden.T @ error)
            by_shift.step(np.array([error.sum()], dtype=np.float32))
    return model


def _tokenised(batches):
    """Buckets of each text, as bytes of 16-bit numbers: a row for words, one for each of ``HEADS``."""
    for rows in batches:
        for first, last, ids, start in token_ids([None if pd.isna(t) else t for t in rows["text"]]):
            own = rows.iloc[first:last]
            cut = np.split(ids.astype(np.int16), start[1:], axis=1)
            yield own[["shard", "fold", "y", "lang"]].assign(ids=[c.tobytes() for c in cut])


def _buckets(ids: Sequence[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(i, dtype=np.int16).reshape(1 + len(HEADS), -1) for i in ids]


def _shards(batches) -> Iterator[tuple[int, pd.DataFrame]]:
    """The shards of a task whole, however they are cut into batches."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        for shard, part in rows.groupby("shard", sort=False):
            if held and held[0]["shard"].iloc[0] != shard:
                yield held[0]["shard"].iloc[0], pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0]["shard"].iloc[0], pd.concat(held, ignore_index=True)


_NUMBERS = "key int, slice int, shard int, numbers binary"


def _sliced(key: int, shard: int, numbers: np.ndarray, size: int) -> pd.DataFrame:
    numbers = numbers.astype(np.float32)
    cut = [numbers[at : at + size].tobytes() for at in range(0, len(numbers), size)]
    return pd.DataFrame({"key": key, "slice": range(len(cut)), "shard": shard, "numbers": cut})


def _seen(batches):
    """How many texts of each fold and class have each bucket."""
    for shard, rows in _shards(batches):
        n = np.zeros((2 * FOLDS, 1 << BUCKET_BITS))
        for key, ids in zip(2 * rows["fold"] + rows["y"], _buckets(rows["ids"]), strict=True):
            n[key, np.unique(ids)] += 1
        for key in range(2 * FOLDS):
            yield _sliced(key, shard, n[key], 8 * SLICE)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums over shards, in the order of these, of the numbers of each key."""

    def run(batches):
        place, total = None, np.empty(0)
        for rows in batches:
            for key, slice_, data in zip(rows["key"], rows["slice"], rows["numbers"], strict=True):
                if place != (key, slice_):
                    if place:
                        yield pd.DataFrame([(*place, total.tobytes())], columns=names)
                    place, total = (key, slice_), 0.0
                total = total + np.frombuffer(data, dtype=np.float32).astype(float)
        if place:
            yield pd.DataFrame([(*place, total.tobytes())], columns=names)

    names = ["key", "slice", "numbers"]
    rows = (
        parts.repartition("key", "slice")
        .sortWithinPartitions("key", "slice", "shard")
        .mapInPandas(run, "key int, slice int, numbers binary")
        # As many numbers as the models have.
        .toPandas()
        .sort_values(["key", "slice"])
    )
    return {
        int(key): np.concatenate([np.frombuffer(n) for n in own["numbers"]])
        for key, own in rows.groupby("key")
    }


def _trained(
    starts: Mapping[int, _Training], passes: Mapping[int, int]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Models after ``passes`` over a shard's texts outside the fold that each is named by.

    Sent are a table's rows that changed, each with a one, under an even key; under an odd key the
    other arrays and a one. So sums of these give means over the shards that changed a number.
    """

    def run(batches):
        for shard, rows in _shards(batches):
            docs, y = _buckets(rows["ids"]), rows["y"].to_numpy(np.float32)
            for fold, start in starts.items():
                own = np.flatnonzero(rows["fold"].to_numpy() != fold)
                if not len(own):
                    continue
                model = train(start, [docs[i] for i in own], y[own], passes[fold])
                changed = (model.table != start.model.table).any(axis=1)[:, None]
                table = np.hstack([model.table * changed, changed])
                yield _sliced(2 * fold, shard, table, SLICE)
                dense = np.concatenate([*map(np.ravel, model.dense()), [1]])
                yield _sliced(2 * fold + 1, shard, dense, len(dense))

    return run


def _train_all(
    tokens: DataFrame, starts: dict[int, _Training], shards: int,
    steps: int = 700, passes: int = 12, batch: int = 32,
) -> None:
    """Train each model on all texts outside the fold that it is named by.

    Every task trains on a shard, and their means start the next pass, until ``steps`` steps in a
    shard or ``passes`` are made. With one shard there is nothing to take means of in between.
    """
    left = {
        fold: min(passes, -(-steps * batch * shards // max(1, int(s.total.sum()))))
        for fold, s in starts.items()
    }
    done = 0
    while any(left.values()):
        own = {fold: n if shards == 1 else 1 for fold, n in left.items() if n}
        found = _added(
            tokens.mapInPandas(_trained({fold: starts[fold] for fold in own}, own), _NUMBERS)
        )
        done += 1
        for fold, n in own.items():
            start, left[fold] = starts[fold], left[fold] - n
            start.rng = np.random.default_rng((done, fold))
            model = start.model
            sums = found[2 * fold].reshape(len(model.table), -1)
            changed = sums[:, -1] > 0
            model.table[changed] = sums[changed, :-1] / sums[changed, -1:]
            mean, at = found[2 * fold + 1][:-1] / found[2 * fold + 1][-1], 0
            for array in model.dense():
                array[...] = mean[at : at + array.size].reshape(array.shape)
                at += array.size


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between neighbouring scores that gives the greatest F1.

    A row counts as ``weight`` rows.
    """
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum((y * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + max(1, (y * weight).sum()))
    ends = np.append(s[1:] < s[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def safe_threshold(highest: float) -> float:
    """The least threshold, from ``LOWEST`` up, that keeps clean rows of scores up to ``highest``."""
    return max(LOWEST, float(np.nextafter(highest, 2)))


def _crossed(models: Mapping[int, ConvModel]):
    """Each text's score by the model that was trained without its fold."""

    def run(batches):
        for rows in batches:
            docs, scores = _buckets(rows["ids"]), np.zeros(len(rows))
            sizes = np.array([d.shape[1] for d in docs])
            for f, model in models.items():
                own = np.flatnonzero(rows["fold"].to_numpy() == f)
                held = np.cumsum(sizes[own]) // WORDS_HELD
                for some in np.split(own, np.flatnonzero(np.diff(held)) + 1):
                    if len(some):
                        start = np.cumsum(sizes[some]) - sizes[some]
                        ids = np.concatenate([docs[i] for i in some], axis=1)
                        scores[some] = model.score_ids(ids, start)
            yield rows[["lang", "y"]].assign(score=scores)

    return run


def _ranked(scores: DataFrame, store: Store) -> pd.DataFrame:
    """(whole, lang, y, n, score, even, safe): of each class ``PER_CLASS`` scores at even ranks.

    All of them if it has no more; for all rows (``whole``) and each language. ``safe`` marks the
    greatest score of clean rows that may not be rejected, ``even`` the others. Ranks are exact: all
    scores are sorted, and a score's rank is its place in its task plus what other tasks hold before.
    """
    group = ["whole", "lang", "y"]
    each = scores.selectExpr(
        "explode(array(struct(true AS whole, '' AS lang), struct(false AS whole, lang))) AS of",
        "y", "score", "monotonically_increasing_id() AS tie",
    ).selectExpr("of.*", "y", "score", "tie").filter("lang IS NOT NULL")
    order = [*group, "score", "tie"]
    ordered = store.save(
        each.repartitionByRange(parts_for(2 * scores.count(), SORTED), *order)
        .sortWithinPartitions(*order)
        .drop("tie")
        .withColumn("at", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.expr("shiftright(at, 33)").alias("part")
    # A row for each sorting task, language and class.
    parts = (
        ordered.groupBy(*group, part)
        .agg(F.count("*").alias("here"), F.min("at").alias("first"))
        .toPandas()
        .sort_values([*group, "part"])
    )
    sizes = parts.groupby(group)["here"]
    parts["before"] = sizes.cumsum() - parts["here"] - parts["first"]
    parts["n"] = sizes.transform("sum")
    parts["keep"] = parts["n"].clip(upper=PER_CLASS)
    parts["least"] = parts["n"] - 1 - (MOST_CLEAN * parts["n"]).astype(int)
    known = scores.sparkSession.createDataFrame(
        parts[[*group, "part", "before", "n", "keep", "least"]]
    )
    # The even ranks are (2 i + 1) n div 2 keep.
    nearest = "(2 * keep * rank + n - 1) div (2 * n)"
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(known), [*group, "part"])
        .withColumn("rank", F.expr("at + before"))
        .selectExpr(
            *group, "n", "score",
            f"(2 * ({nearest}) + 1) * n < 2 * keep * (rank + 1) AS even",
            "y = 0 AND rank = least AS safe",
        )
        .filter("even OR safe")
        .toPandas()
    )


def _threshold(rows: pd.DataFrame, each: np.ndarray) -> float:
    """The greater of ``best_threshold`` and ``safe_threshold``; class c counts ``each[c]`` times."""
    highest = float(rows.loc[rows["safe"], "score"].iloc[0])
    rows = rows[rows["even"]]
    y = rows["y"].to_numpy()
    stands = rows["n"].to_numpy() / rows.groupby("y")["y"].transform("size").to_numpy()
    best = best_threshold(rows["score"].to_numpy(), y.astype(np.float32), stands * each[y])
    return max(best, safe_threshold(highest))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: str = "true") -> ConvModel:
    """Train on all labelled rows, with thresholds from scores that the same rows get crosswise.

    Texts of any length are used, whole; tasks train on shards of them (see :func:`_train_all`). For
    the thresholds the rows are cut into ``FOLDS`` parts, each scored by a model of the others. A
    row stands for as many labels as its class has for each one whose document is there. A threshold
    gives the greatest F1 (by all scores, or so many at even ranks among them, see :func:`_ranked`),
    or is the least one that rejects few clean rows, whichever is greater. A language with fewer
    than ``MIN_CALIBRATION`` rows of either class takes the threshold of all; with fewer than that in
    all the threshold is ``FALLBACK``. Without labels of both classes every document scores one half
    and the threshold is 1.
    """
    rows, counts = labelled_rows(docs, labels, "toxic", usable)
    rows = rows.withColumn("fold", F.expr(f"part % {FOLDS}")).drop("part")
    sizes = rows.groupBy("fold", "y").agg(
        F.count("*").alias("n"), F.expr("sum(coalesce(octet_length(text), 0))").alias("bytes")
    ).toPandas()
    total = np.zeros((FOLDS, 2))
    total[sizes["fold"], sizes["y"]] = sizes["n"]
    if not total.sum(axis=0).all():
        model = untrained(np.zeros((2, 1 << BUCKET_BITS)), np.zeros(2)).model
        model.out[:] = 0
        model.default_threshold = 1.0
        return model
    shards = max(
        parts_for(int(sizes["n"].sum()), SHARD_TEXTS), parts_for(int(sizes["bytes"].sum()), SHARD_BYTES)
    )
    tokens = (
        rows.withColumn("shard", F.expr(f"CAST(pmod(xxhash64(doc_id, text, 1), {shards}) AS INT)"))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", "text", "lang")
        .drop("doc_id")
        .mapInPandas(_tokenised, "shard int, fold int, y int, lang string, ids binary")
        .persist(StorageLevel.DISK_ONLY)
    )
    try:
        return _fit(tokens, total, counts, shards)
    finally:
        tokens.unpersist()


def _fit(
    tokens: DataFrame, total: np.ndarray, counts: Mapping[int, int], shards: int
) -> ConvModel:
    """The model of all ``tokens``, of which ``total`` has the rows of each fold and class."""
    known = total.sum(axis=0)
    calibrated = known.min() >= MIN_CALIBRATION
    seen = _added(tokens.mapInPandas(_seen, _NUMBERS))
    n = np.stack([seen[key] for key in range(2 * FOLDS)]).reshape(FOLDS, 2, -1)
    starts = {FOLDS: untrained(n.sum(axis=0), known)}
    if calibrated:
        for f in range(FOLDS):
            others = np.arange(FOLDS) != f
            starts[f] = untrained(n[others].sum(axis=0), total[others].sum(axis=0))
    _train_all(tokens, starts, shards)
    true = np.clip(counts[1] / sum(counts.values()), 1e-6, 1 - 1e-6)
    models = {fold: start.model for fold, start in starts.items()}
    for each in models.values():
        # The classes weighed the same; this restores their true share.
        each.shift[0] += np.log(true / (1 - true))
    model = models.pop(FOLDS)
    model.default_threshold = FALLBACK
    if not calibrated:
        return model
    store = Store(tokens.sparkSession)
    scores = tokens.mapInPandas(_crossed(models), "lang string, y int, score double")
    ranked = _ranked(store.save(scores, "scores"), store)
    stands = np.array([counts[c] / known[c] for c in (0, 1)])
    for (whole, lang), rows in ranked.groupby(["whole", "lang"]):
        if whole:
            model.default_threshold = _threshold(rows, stands)
        elif rows.groupby("y")["n"].first().reindex([0, 1], fill_value=0).min() >= MIN_CALIBRATION:
            model.thresholds[lang] = _threshold(rows, stands)
    return model


def score_toxicity(docs: DataFrame, model: ConvModel) -> DataFrame:
    """(doc_id, score, threshold) for every row of ``docs`` (doc_id, text, lang).

    The score reads the text alone, whole and however long; null and empty texts have the score of
    no words. The threshold is that of the row's language.
    """
    def run(batches):
        for rows in batches:
            limit = rows["lang"].map(model.thresholds).fillna(model.default_threshold)
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "score": model.score([None if pd.isna(t) else t for t in rows["text"]]),
                    "threshold": limit.astype(float),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInPandas(
        run, f"doc_id {kind}, score double, threshold double"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose score is below the threshold of their language.

    Equal rows have equal scores, so repeated ids with different texts are decided by text: the
    decision travels with the row, and nothing is joined.
    """
    model = fit_toxicity(docs, labels)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                rows = batch.iloc[at : at + TOGETHER]
                score = model.score([None if pd.isna(t) else t for t in rows["text"]])
                limit = rows["lang"].map(model.thresholds).fillna(model.default_threshold)
                yield rows.loc[score < limit.to_numpy(float), names]

    return docs.mapInPandas(run, docs.schema)


def op8_toxicity(spark, folder: str) -> DataFrame:
    """Score every document, learning from labels outside the held-out quarter."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_toxicity(docs, labels, f"NOT ({HELD_OUT})")
    return score_toxicity(docs, model).select(
        "doc_id",
        F.expr(HELD_OUT).alias("held_out"),
        "score",
        F.expr("IF(score >= 0.3, 1, 0)").alias("predicted"),
        "threshold",
        F.expr("IF(score >= threshold, 1, 0)").alias("rejected"),
    )
