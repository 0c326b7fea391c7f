"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams of its letters, weighed by TF-IDF and normalised. Each
language has a few centroids, found by spherical k-means over a bounded sample of its documents, so
that registers of one language need not share one mean. A text gets the language of the centroid of
greatest cosine; one farther from it than nearly all sample texts near that centroid is marked as
rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store, rows_with_keys
from patronscope.llm.texthash import BLANK, LOWERED, buffers, mix

# Bounds of the training sample: documents of a language, and languages, those with most documents.
PER_LANGUAGE = 400
LANGUAGES = 256
CENTROIDS = 3
PASSES = 8
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 12
# Sample texts of a centroid that may be farther from it than its limit.
OUTSIDE = 0.01
UNKNOWN = "und"
HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, false)"

# Runs of anything but letters count as one blank: by byte in ASCII texts, by code point in others.
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_OTHERS = re.compile(r"[\W\d_]+")
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lower(text: str | None) -> str | None:
    if pd.isna(text):
        return None
    return text if text.isascii() else _OTHERS.sub(" ", text.lower())


def gram_counts(texts) -> np.ndarray:
    """One row of bucket counts for each whole text; null texts and those without letters: zeros."""
    found = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for b in buffers([_lower(t) for t in texts]):
        data = np.where(_LETTER[b.bytes], LOWERED[b.bytes], 32).astype(np.uint8)
        owner = np.repeat(np.arange(len(b.start)), b.end - b.start + 1)
        # Of neighbouring blanks the first is kept; a text begins with one.
        blank = data == 32
        kept = ~blank | np.append(True, ~blank[:-1])
        data, owner = data[kept], owner[kept]
        values = _BYTE[data]
        gram = np.zeros(len(data), dtype=np.uint64)
        blank = data == 32
        for n in range(1, max(GRAMS) + 1):
            # Grams that start at each place; those over the end of a text are left out.
            last = len(data) - n + 1
            if last < 1:
                break
            gram = gram[:last] * _STEP + values[n - 1 :]
            if n not in GRAMS:
                continue
            inside = owner[:last] == owner[n - 1 :]
            # A blank may begin or end a gram, but not be all of it.
            if n == 1:
                inside &= ~blank
            place = mix(gram + np.uint64(n)) >> np.uint64(64 - 12)
            at = owner[:last][inside] * BUCKETS + place[inside].astype(np.int64)
            found[b.first : b.last] += np.bincount(
                at, minlength=len(b.start) * BUCKETS
            ).reshape(-1, BUCKETS)
    return found


@dataclass
class CentroidModel:
    """``centroids`` are unit rows; ``of`` gives the language of each and ``limit`` its distance."""

    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    limit: np.ndarray
    idf: np.ndarray

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text; without letters or languages: unknown, 0."""
        counts = gram_counts(texts)
        some = counts.any(axis=1)
        names = np.full(len(counts), UNKNOWN, dtype=object)
        cosine = np.zeros(len(counts))
        rejected = np.ones(len(counts), dtype=bool)
        if len(self.of) and some.any():
            near = unit(counts[some], self.idf) @ self.centroids.T
            best = near.argmax(axis=1)
            cosine[some] = np.clip(near[np.arange(len(best)), best], 0, 1)
            names[some] = np.array(self.languages, dtype=object)[self.of[best]]
            rejected[some] = 1 - cosine[some] > self.limit[best]
        return names, cosine, rejected


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, of length one."""
    weighed = np.log1p(counts) * idf
    size = np.sqrt((weighed * weighed).sum(axis=1, keepdims=True))
    return weighed / np.maximum(size, 1e-12)


def cluster(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, limits) by spherical k-means from far-apart starts; depends on row order only."""
    mean = vectors.sum(axis=0)
    starts = [vectors @ mean]
    chosen = [int(starts[0].argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen].copy()
    for _ in range(PASSES):
        of = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (of == c).any():
                total = vectors[of == c].sum(axis=0)
                centroids[c] = total / np.maximum(np.sqrt((total * total).sum()), 1e-12)
    cosine = vectors @ centroids.T
    of = cosine.argmax(axis=1)
    gaps = 1 - cosine[np.arange(len(of)), of]
    everywhere = np.quantile(gaps, 1 - OUTSIDE)
    limits = [
        max(everywhere, np.quantile(gaps[of == c], 1 - OUTSIDE) if (of == c).any() else 0.0)
        for c in range(len(centroids))
    ]
    return centroids, np.array(limits)


def _drawn(known: DataFrame) -> DataFrame:
    """(lang, draw) of up to ``PER_LANGUAGE`` texts of each of the most frequent languages.

    Distinct texts are drawn by least hash, so partitions and repeated rows don't matter. Of each
    language a task passes on no more than these.
    """
    ranked = known.select("lang", "draw").distinct().selectExpr(
        "*", "row_number() OVER (PARTITION BY lang ORDER BY draw) AS place"
    )
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    return ranked.filter(f"place <= {PER_LANGUAGE}").select("lang", "draw").join(
        F.broadcast(common.select("lang")), "lang"
    )


def _vectors(batches):
    for rows in batches:
        for at in range(0, len(rows), 256):
            some = rows.iloc[at : at + 256]
            counts = gram_counts(some["text"].tolist())
            keep = counts.any(axis=1)
            yield pd.DataFrame(
                {
                    "lang": some["lang"].to_numpy()[keep],
                    "draw": some["draw"].to_numpy()[keep],
                    "counts": [c.tobytes() for c in counts[keep]],
                }
            )


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["counts"]), dtype=np.float32).reshape(-1, BUCKETS)


def _seen_in(batches):
    """In how many vectors of this task each bucket occurs."""
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for rows in batches:
        counts = _matrix(rows)
        total += (counts > 0).sum(axis=0)
        n += len(counts)
    yield pd.DataFrame({"n": [n], "seen": [total.tobytes()]})


def fit_languages(docs: DataFrame, store: Store, usable: str = "true") -> CentroidModel:
    """Learn from a bounded sample of the rows of ``docs`` for which the SQL condition holds.

    The sample has at most ``PER_LANGUAGE`` texts of each of the ``LANGUAGES`` most frequent values
    of lang. Texts become vectors of fixed size in tasks; only document frequencies and centroids
    reach the driver.
    """
    known = docs.filter(f"lang IS NOT NULL AND text IS NOT NULL AND ({usable})").selectExpr(
        "lang", "xxhash64(text) AS draw", "text"
    )
    chosen = store.save(_drawn(known), "chosen")
    texts = rows_with_keys(known, chosen, ["lang", "draw"]).dropDuplicates(["lang", "draw"])
    sample = store.save(
        texts.mapInPandas(_vectors, "lang string, draw long, counts binary"), "sample"
    )
    parts = sample.mapInPandas(_seen_in, "n long, seen binary").collect()
    n = sum(r["n"] for r in parts)
    seen = sum((np.frombuffer(r["seen"], dtype=np.int64) for r in parts), np.zeros(BUCKETS, np.int64))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw")
        centroids, limits = cluster(unit(_matrix(rows), idf), CENTROIDS)
        return pd.DataFrame(
            {
                "lang": rows["lang"].iloc[0],
                "centroid": [c.astype(np.float32).tobytes() for c in centroids],
                "distance": limits,
            }
        )

    found = (
        sample.groupBy("lang")
        .applyInPandas(centre, "lang string, centroid binary, distance double")
        .toPandas()
        .sort_values(["lang", "centroid"], ignore_index=True)
    )
    languages = sorted(found["lang"].unique())
    centroids = np.frombuffer(b"".join(found["centroid"]), dtype=np.float32).reshape(-1, BUCKETS)
    of = np.array([languages.index(x) for x in found["lang"]], dtype=np.int64)
    return CentroidModel(languages, centroids, of, found["distance"].to_numpy(float), idf)


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text).

    ``lang_pred`` is the language of the nearest centroid, ``score`` its cosine (0 to 1) and
    ``rejected`` whether it is too far away to be trusted. Null texts and texts without a letter are
    ``und`` with score 0, as is everything if the model has learnt no language. Whole texts count,
    however long. Ties go to the language that comes first; repeated rows and null ids are kept.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows in batches:
            for at in range(0, len(rows), 256):
                some = rows.iloc[at : at + 256]
                names, cosine, rejected = handle.value.predict(some["text"].tolist())
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].to_numpy(),
                        "lang_pred": names,
                        "score": cosine,
                        "rejected": rejected,
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )


def op13_language_id(spark, folder: str) -> DataFrame:
    """Language of every document, learnt outside the held-out quarter."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_languages(docs, Store(spark), f"NOT ({HELD_OUT})")
    return identify(docs, model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected"
    )
