"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Strings of ``LENGTH`` bytes are compared by position, so a copy is found wherever it starts. Every
such string is filed under its seed, the least-hashed short string inside it; equal strings have
equal seeds at equal offsets, so a string whose seed occurs once in the corpus is unique. Strings
that share a seed and their surroundings come as one stretch, and only its first occurrence goes
on. A stretch is then cut in four by where the seed lies in its strings; all strings of such a piece
have some 83 bytes in common, under whose hash it is filed again, and one that is alone there is
unique. Of what remains, the suffixes of a bounded block are sorted one bucket at a time by their first
bytes; longer ties are resolved by the ranks of a difference-cover sample of the suffixes, which
were computed before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import SENDABLE_ROWS, Store, parts_for, rows_with_keys
from patronscope.llm.texthash import BYTE_VALUES, Buffer, buffers, mix, prefix_sums, span_hash

LENGTH = 100
SEED = 32
# Period of the difference cover; suffixes are first sorted by so many bytes.
PERIOD = 32
# Starts of a piece: its strings have their seed after ``PIECE * i`` to ``PIECE * (i + 1) - 1`` bytes.
PIECE = -(-(LENGTH - SEED + 1) // 4)
# Pieces that one task sorts together, some 115 bytes each; those of one key may be ``CROWD`` times more.
BLOCK, CROWD = 6000, 4
# Id of documents without one: after all others.
LAST = (1 << 63) - 1


def difference_cover(period: int) -> np.ndarray:
    """Residues of which any difference mod ``period`` is a difference of two."""
    root = int(np.ceil(np.sqrt(period)))
    return np.unique(np.append(np.arange(root), np.arange(0, period, root)))


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
# SHIFT[i, j]: the least step after which positions of residues i and j are both in the sample.
SHIFT = np.array(
    [
        [
            next(k for k in range(PERIOD) if _IN_COVER[i + k] and _IN_COVER[j + k])
            for j in range(PERIOD)
        ]
        for i in range(PERIOD)
    ]
)


def stretches(b: Buffer) -> tuple[np.ndarray, ...]:
    """(first start, starts, hash of the seed, hash of the bytes, place of the seed after the first
    start) of the stretches in a buffer.

    A stretch is a run of starts in one text whose strings have the same occurrence of a seed.
    """
    size = len(b.bytes)
    n = size - LENGTH + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    sums, down = prefix_sums(BYTE_VALUES[b.bytes])
    hashes = mix((sums[SEED:] - sums[:-SEED]) * down[: size - SEED + 1])
    # The place in the low bits makes the leftmost of equal seeds the least.
    low = np.uint64((1 << max(24, size.bit_length())) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, step = LENGTH - SEED + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[width - step : width - step + n])
    seed = (least & low).astype(np.int64)
    edges = np.zeros(size + 1, dtype=np.int32)
    long = b.end - b.start >= LENGTH
    edges[b.start[long]] += 1
    edges[b.end[long] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edges)[:n])
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    seed = seed[starts]
    cut = np.flatnonzero((np.diff(seed) != 0) | (np.diff(starts) != 1)) + 1
    lo, hi = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]
    at = seed[np.append(0, cut)]
    whole = span_hash(sums, down, lo, hi + LENGTH)
    whole = mix(whole + (at - lo).astype(np.uint64))
    return lo, hi - lo + 1, hashes[at].view(np.int64), whole.view(np.int64), at - lo


def _strings(column: pd.Series) -> list[str | None]:
    return [None if pd.isna(t) else t for t in column]


def _file(batches):
    for rows in batches:
        ids, copies = rows["id"].to_numpy(), rows["copy"].to_numpy()
        for b in buffers(_strings(rows["text"])):
            lo, n, seed, whole, after = stretches(b)
            text = np.searchsorted(b.start, lo, side="right") - 1
            yield pd.DataFrame(
                {
                    "id": ids[b.first + text],
                    "copy": copies[b.first + text],
                    "lo": (lo - b.start[text]).astype(np.int32),
                    # Both are below 128; one column instead of two is less to shuffle.
                    "span": (n | after << 8).astype(np.int32),
                    "seed": seed,
                    "whole": whole,
                }
            )


def _cut_out(batches):
    """The pieces of wanted stretches, with a hash of what all strings of a piece have in common."""
    for rows in batches:
        ids, copies = rows["id"].to_numpy(), rows["copy"].to_numpy()
        wanted = rows["wanted"].tolist()
        for b in buffers(_strings(rows["text"])):
            sums, down = prefix_sums(BYTE_VALUES[b.bytes])
            own = wanted[b.first : b.last]
            text = np.repeat(np.arange(b.last - b.first), [len(w) for w in own])
            lo, span = np.array([(w["lo"], w["span"]) for ws in own for w in ws], np.int64).T
            lo, n, after = b.start[text] + lo, span & 255, span >> 8
            for i in range(-(-(LENGTH - SEED + 1) // PIECE)):
                # Bytes before the seed in this piece's strings.
                least, most = PIECE * i, min(PIECE * (i + 1) - 1, LENGTH - SEED)
                first = np.maximum(lo, lo + after - most)
                last = np.minimum(lo + n - 1, lo + after - least)
                has = first <= last
                first, last, seed, of = first[has], last[has], (lo + after)[has], text[has]
                key = span_hash(sums, down, seed - least, seed - most + LENGTH)
                yield pd.DataFrame(
                    {
                        "key": mix(key + np.uint64(i)).view(np.int64),
                        "id": ids[b.first + of],
                        "copy": copies[b.first + of],
                        "lo": (first - b.start[of]).astype(np.int32),
                        "n": (last - first + 1).astype(np.int32),
                        "data": [
                            b.bytes[s:e].tobytes()
                            for s, e in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)
                        ],
                    }
                )


class CoverSample:
    """Ranks and common prefixes of the suffixes at cover positions, to LENGTH bytes.

    Only positions less than PERIOD after one of ``starts`` are ever asked for, so only those are
    sampled.
    """

    WORDS = -(-LENGTH // 8)

    def __init__(self, text: np.ndarray, starts: np.ndarray):
        padded = np.append(text, np.zeros(8 * self.WORDS + PERIOD + 8, dtype=np.uint8))
        n = len(text)
        # Eight bytes from every position on, most significant first.
        self.words = np.zeros(len(padded) - 8, dtype=np.uint64)
        for i in range(8):
            self.words = (self.words << np.uint64(8)) | padded[i : i + len(self.words)]
        near = np.zeros(n + PERIOD + 1, dtype=np.int32)
        near[starts] += 1
        near[starts + PERIOD] -= 1
        at = np.flatnonzero(_IN_COVER[np.arange(n) % PERIOD] & (np.cumsum(near)[:n] > 0))
        columns = [self.words[at + 8 * c] for c in range(self.WORDS)]
        order = np.lexsort(columns[::-1])
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[at[order]] = np.arange(len(at))
        common = np.zeros(max(0, len(at) - 1), dtype=np.int64)
        open_ = np.ones(len(common), dtype=bool)
        for column in columns:
            differ = column[order[1:]] ^ column[order[:-1]]
            equal = np.full(len(differ), 8)
            for k in range(8):
                equal[(differ >> np.uint64(8 * k)) != 0] = 7 - k
            common += np.where(open_, equal, 0)
            open_ &= equal == 8
        # levels[j][i]: the least of 2^j common prefixes from i on.
        self.levels = [common]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0, 1 for suffixes p and q, equal to PERIOD bytes, by their first LENGTH bytes."""
        shift = SHIFT[p % PERIOD, q % PERIOD]
        a, b = self.rank[p + shift], self.rank[q + shift]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        same = hi == lo
        span = np.maximum(hi - lo, 1)
        level = np.frexp(span.astype(float))[1] - 1
        common = np.full(len(p), LENGTH)
        for j in np.unique(level[~same]):
            own = (level == j) & ~same
            row = self.levels[j]
            common[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << j)])
        return np.where(common >= LENGTH - shift, 0, np.sign(a - b))


def repeated_starts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts (ascending) whose LENGTH bytes also are at an earlier one of ``starts``.

    One bucket of suffixes, those of one first byte, is sorted at a time.
    """
    if not len(starts):
        return starts
    sample, found = CoverSample(text, starts), [starts[:0]]
    for byte in np.unique(text[starts]):
        bucket = starts[text[starts] == byte]
        columns = [sample.words[bucket + 8 * c] for c in range(PERIOD // 8)]
        order = np.lexsort(columns[::-1])
        bucket = bucket[order]
        new = np.zeros(len(bucket), dtype=bool)
        for column in columns:
            new[1:] |= column[order[1:]] != column[order[:-1]]
        ties = np.cumsum(new)
        # Three-way quicksort of all ties at once: each is parted by its middle suffix.
        while len(bucket):
            first = np.flatnonzero(np.append(True, ties[1:] != ties[:-1]))
            count = np.diff(np.append(first, len(bucket)))
            alone = np.repeat(count == 1, count)
            bucket, ties = bucket[~alone], ties[~alone]
            if not len(bucket):
                break
            first = np.flatnonzero(np.append(True, ties[1:] != ties[:-1]))
            count = np.diff(np.append(first, len(bucket)))
            pivot = np.repeat(bucket[first + count // 2], count)
            side = sample.compare(bucket, pivot)
            equal = side == 0
            group = np.repeat(np.arange(len(first)), count)
            earliest = np.full(len(first), LAST)
            np.minimum.at(earliest, group[equal], bucket[equal])
            found.append(bucket[equal & (bucket != earliest[group])])
            rest = ~equal
            ties = 2 * group[rest] + (side[rest] > 0)
            again = np.argsort(ties, kind="stable")
            bucket, ties = bucket[rest][again], ties[again]
    return np.sort(np.concatenate(found))


def _sort_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of starts whose string occurs earlier, in a block of pieces; equal ones aren't sorted."""
    rows = rows.sort_values(["id", "copy", "lo"], ignore_index=True)
    equal = rows["data"].duplicated()
    names = ["id", "copy", "lo", "n"]
    return pd.concat([rows.loc[equal, names], _sorted_runs(rows[~equal].reset_index(drop=True))])


def _sorted_runs(rows: pd.DataFrame) -> pd.DataFrame:
    sizes = rows["data"].map(len).to_numpy()
    text = np.frombuffer(b"".join(rows["data"]), dtype=np.uint8)
    base, n = np.cumsum(sizes) - sizes, rows["n"].to_numpy(np.int64)
    of = np.repeat(np.arange(len(rows)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    again = repeated_starts(text, base[of] + within)
    row = np.searchsorted(base, again, side="right") - 1
    cut = np.flatnonzero((np.diff(again) != 1) | (np.diff(row) != 0)) + 1
    first = np.append(0, cut) if len(again) else cut
    count = np.diff(np.append(first, len(again)))
    row, start = row[first], again[first]
    return pd.DataFrame(
        {
            "id": rows["id"].to_numpy()[row],
            "copy": rows["copy"].to_numpy()[row],
            "lo": (rows["lo"].to_numpy()[row] + start - base[row]).astype(np.int32),
            "n": count.astype(np.int32),
        }
    )


def removed_spans(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes covered by strings at n starts from lo on."""
    if not len(lo):
        return lo, lo
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate((lo + n - 1 + LENGTH)[order])
    first = np.append(True, start[1:] > end[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)
    return start[first], end[last]


def _remove(names: list[str]):
    def run(batches):
        for rows in batches:
            texts, removed, spans = [], [], []
            for text, los, ns in zip(rows["_text"], rows["_lo"], rows["_n"], strict=True):
                data = b"" if pd.isna(text) else text.encode("utf-8", "replace")
                start, end = np.empty(0, np.int64), np.empty(0, np.int64)
                if los is not None and len(los):
                    start, end = removed_spans(
                        np.asarray(los, dtype=np.int64), np.asarray(ns, dtype=np.int64)
                    )
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(data[at:s])
                    at = e
                texts.append(b"".join([*kept, data[at:]]))
                removed.append(int((end - start).sum()))
                spans.append(len(start))
            yield rows[names].assign(kept=texts, n_removed=removed, n_spans=spans)

    return run


def _numbered(docs: DataFrame, store: Store) -> DataFrame:
    """``docs`` with _own_id (doc_id, nulls last) and _own_copy: above 0 for an id's further texts."""
    texts = docs.withColumns(
        {
            "_own_id": F.expr(f"CAST(coalesce(doc_id, {LAST}) AS BIGINT)"),
            "_key": F.xxhash64("text"),
        }
    )
    more = store.save(
        texts.select("_own_id", "_key").distinct()
        .withColumn(
            "_own_copy", F.expr("row_number() OVER (PARTITION BY _own_id ORDER BY _key) - 1")
        )
        .filter("_own_copy > 0"),
        "copies",
    )
    n = more.count()
    if not n:
        return texts.drop("_key").withColumn("_own_copy", F.lit(0))
    more = F.broadcast(more) if n <= SENDABLE_ROWS else more
    return texts.join(more, ["_own_id", "_key"], "left").drop("_key").fillna(0, ["_own_copy"])


def repeated_strings(numbered: DataFrame, store: Store) -> DataFrame:
    """(id, copy, lo, n): n starts from lo on whose strings occur earlier in the corpus."""
    texts = numbered.selectExpr("_own_id AS id", "_own_copy AS copy", "text")
    place = "struct(id, copy, lo)"
    filed = texts.mapInPandas(
        _file, "id long, copy int, lo int, span int, seed long, whole long"
    ).repartition("seed").sortWithinPartitions("seed", "whole")
    marked = filed.selectExpr(
        "*",
        "min(whole) OVER (PARTITION BY seed) <> max(whole) OVER (PARTITION BY seed) AS varied",
    ).selectExpr("*", f"min({place}) OVER (PARTITION BY seed, whole) = {place} AS first")
    marked = store.save(
        marked.filter("varied OR NOT first").drop("seed", "whole", "varied"), "marked"
    )
    again = marked.filter("NOT first").selectExpr("id", "copy", "lo", "span & 255 AS n")
    open_ = marked.filter("first")
    wanted = open_.groupBy("id", "copy").agg(
        F.expr("collect_set(struct(lo, span))").alias("wanted")
    )
    owners = rows_with_keys(texts, open_.select("id", "copy").distinct(), ["id", "copy"])
    pieces = owners.dropDuplicates(["id", "copy"]).join(wanted, ["id", "copy"]).mapInPandas(
        _cut_out, "key long, id long, copy int, lo int, n int, data binary"
    )
    pieces = store.save(pieces, "pieces")
    repeated = store.save(
        pieces.groupBy("key")
        .agg(F.count("*").alias("m"), F.sum("n").alias("starts"))
        .filter("m > 1")
        .selectExpr("*", f"m > {CROWD * BLOCK} AS crowded")
        .selectExpr("key", "crowded", "IF(crowded, starts, m) AS size"),
        "repeated",
    )
    known = repeated.agg(F.count("*").alias("keys"), F.sum("size").alias("size")).first()
    groups = parts_for(known["size"] or 0, BLOCK)
    keys = repeated.drop("size")
    # Pieces of a crowded key go string by string, spread by content.
    cut = (
        pieces.join(F.broadcast(keys) if known["keys"] <= SENDABLE_ROWS else keys, "key")
        .selectExpr("*", "explode(IF(crowded, sequence(0, n - 1), array(0))) AS i")
        .selectExpr(
            "id", "copy", "CAST(lo + i AS INT) AS lo", "IF(crowded, 1, n) AS n", "key", "crowded",
            f"IF(crowded, substring(data, i + 1, {LENGTH}), data) AS data",
        )
        .selectExpr(
            f"pmod(IF(crowded, xxhash64(data), key), {groups}) AS place",
            "id", "copy", "lo", "n", "data",
        )
    )
    sorted_ = cut.groupBy("place").applyInPandas(
        _sort_block, "id long, copy int, lo int, n int"
    )
    return again.unionByName(sorted_)


def remove_repeats(docs: DataFrame, store: Store) -> DataFrame:
    """Rows of ``docs`` with kept (bytes that stay), n_removed and n_spans.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document of a
    smaller id, or before in the same one; strings are judged on the input. Null texts are empty,
    null ids come last. Several texts of one id follow each other by hash; rows that repeat id and
    text are one document, each with its result. Columns of the three names are replaced.
    """
    names = [c for c in docs.columns if c not in ("kept", "n_removed", "n_spans")]
    numbered = _numbered(docs.select(*names), store)
    gone = repeated_strings(numbered, store).groupBy("id", "copy").agg(
        F.expr("collect_list(struct(lo, n))").alias("_runs")
    ).selectExpr(
        "id AS _id", "copy AS _nth", "transform(_runs, r -> r.lo) AS _lo",
        "transform(_runs, r -> r.n) AS _n",
    )
    rows = numbered.join(gone, F.expr("_own_id = _id AND _own_copy = _nth"), "left")
    schema = docs.select(*names).schema
    for name, kind in (("kept", "binary"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)
    return rows.select(*names, F.col("text").alias("_text"), "_lo", "_n").mapInPandas(
        _remove(names), schema
    )


def op6_suffix_dedup(spark, folder: str) -> DataFrame:
    """What is removed from every document as repeated, and a digest of the bytes that stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, Store(spark)).selectExpr(
        "doc_id",
        "CAST(coalesce(octet_length(text), 0) AS BIGINT) AS n_bytes",
        "n_removed",
        "n_spans",
        "sha2(kept, 256) AS kept_sha256",
    )
