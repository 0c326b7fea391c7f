"""Removal of repeated runs of lines by content-defined chunks.

A rolling hash over the hashes of two neighbouring lines puts a boundary wherever it is smaller than
the next on either side. Boundaries thus depend on three lines around them and nothing else, so a
passage is cut alike wherever it stands, up to its edges. Chunks between boundaries that occur
earlier in the corpus go whole, after their bytes were compared.

What chunks leave is then gone through line by line: every two neighbouring lines inside a chunk
that stays, or across a boundary, are filed too, and go if they occur earlier. This extends the
copied chunks to both sides as far as lines agree, and finds passages too short to hold a chunk. So
a repeated passage of ``LEAST`` lines or more goes whole wherever it stands. A text of fewer lines
is one chunk and goes if it is a copy of another such text; single lines inside longer texts stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store, rows_with_keys
from patronscope.llm.texthash import BYTE_VALUES, Buffer, buffers, mix, prefix_sums, span_hash

# Fewest lines of a chunk (of a longer text), and those looked at together beside chunks.
LEAST = 2
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = "start long, bytes long, cut long, line long, lines long, chunk long, hash long"
_PLACE = "struct(doc_id IS NULL AS no_id, doc_id, text_key, start)"


def boundaries(lines: np.ndarray, first: np.ndarray, after_last: np.ndarray) -> np.ndarray:
    """Where chunks begin, for the line hashes of many texts.

    ``first`` and ``after_last`` give each line's text. A chunk begins with each text and where the
    rolling hash of the line and the one before it is a local minimum (the first of equal ones), but
    never so that a text's first or last chunk would have a single line.
    """
    at = np.arange(len(lines))
    begins = at == first
    if len(lines) > 2 * LEAST - 1:
        rolled = mix(lines[:-1] * _ROLL + lines[1:])
        i = at[LEAST : 1 - LEAST]
        i = i[(i - first[i] >= LEAST) & (after_last[i] - i >= LEAST)]
        # rolled[i - 1] is that of the lines i - 1 and i; both neighbours lie in the same text.
        here = rolled[i - 1]
        begins[i[(here < rolled[i - 2]) & (here <= rolled[i])]] = True
    return begins


def line_runs(b: Buffer) -> tuple[np.ndarray, ...]:
    """Chunks, then pairs of lines, of all texts of a buffer.

    (text, first byte, bytes, bytes to cut, first line, lines, chunk, hash), where ``chunk`` is -1
    for a chunk, the first byte of its chunk for a pair inside one, and -2 for a pair across a
    boundary. A run's bytes end before its last line break, so that a run at the end of a text
    without one equals its copies elsewhere; the break is cut along with it. An empty text has none.
    """
    sums, down = prefix_sums(BYTE_VALUES[b.bytes])
    after = np.flatnonzero(b.bytes == 10) + 1
    after = after[after < b.end[np.searchsorted(b.start, after - 1, side="right") - 1]]
    starts = np.sort(np.concatenate([b.start[b.end > b.start], after]))
    text = np.searchsorted(b.start, starts, side="right") - 1
    cut_ends = b.end[text]
    inner = np.flatnonzero(text[1:] == text[:-1])
    cut_ends[inner] = starts[inner + 1]
    ends = cut_ends - (b.bytes[cut_ends - 1] == 10)
    first, after_last = np.searchsorted(text, text), np.searchsorted(text, text, side="right")
    begins = boundaries(span_hash(sums, down, starts, ends), first, after_last)
    head = np.flatnonzero(begins)
    last = np.append(head[1:], len(starts)) - 1
    chunk_of = starts[head][np.cumsum(begins) - 1] - b.start[text]
    pair = np.arange(len(starts))
    pair = pair[pair + LEAST <= after_last]
    across = chunk_of[pair] != chunk_of[pair + LEAST - 1]
    at = np.concatenate([head, pair])
    to = np.concatenate([last, pair + LEAST - 1])
    inside = np.concatenate([np.full(len(head), -1), np.where(across, -2, chunk_of[pair])])
    start, end = starts[at], ends[to]
    hashes = span_hash(sums, down, start, end).view(np.int64)
    return (
        text[at], start - b.start[text[at]], end - start, cut_ends[to] - start, at - first[at],
        to - at + 1, inside, hashes,
    )


def _runs(bits: int):
    def run(batches):
        for rows in batches:
            for b in buffers(rows.column("text").to_pylist()):
                text, *numbers, hashes = line_runs(b)
                own = rows.slice(b.first, b.last - b.first).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"),
                        own.column("text_key"),
                        *(pa.array(n.astype(np.int64)) for n in (*numbers, hashes >> (64 - bits))),
                    ],
                    ["doc_id", "text_key", *(f.split()[0] for f in _FIELDS.split(", "))],
                )

    return run


def copies(texts: DataFrame, runs: DataFrame, store: Store, name: str) -> DataFrame:
    """Those ``runs`` of ``texts`` whose bytes equal those of an earlier one.

    Earlier means a smaller doc_id (nulls last), or the same and a smaller text_key, or the same text
    and a smaller start. A run that shares lines with its first occurrence is no copy of it.
    """
    again = runs.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    again = rows_with_keys(runs, store.save(again, f"{name}-repeated"), ["hash"])
    again = store.save(again.distinct(), f"{name}-candidates")
    of_text = again.groupBy("doc_id", "text_key").agg(
        F.expr("collect_list(struct(start, bytes, hash))").alias("runs")
    )
    owners = of_text.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    keys = again.select("text_key").distinct()
    pieces = (
        rows_with_keys(texts, keys, ["text_key"])
        .join(owners, F.expr("text_key = _key AND doc_id <=> _id"))
        .selectExpr("doc_id", "text_key", "encode(text, 'UTF-8') AS data", "inline(runs)")
        .withColumn("piece", F.expr("substring(data, start + 1, bytes)"))
        .drop("data")
    )
    told = pieces.select("hash", "piece").distinct().groupBy("hash").count()
    shared = store.save(told.filter("count > 1").select("hash"), f"{name}-shared")
    found = again.withColumn("piece", F.lit(None).cast("binary"))
    if not shared.isEmpty():
        # Different runs of one hash are told apart by their bytes.
        bytes_of = pieces.join(shared, "hash").distinct()
        bytes_of = bytes_of.withColumnsRenamed({"doc_id": "_id"})
        on = ["text_key", "start", "bytes", "hash"]
        apart = again.join(shared, "hash").join(bytes_of, on).filter("doc_id <=> _id")
        found = found.join(shared, "hash", "left_anti").unionByName(apart.drop("_id"))
        found = store.save(found, f"{name}-told_apart")
    first = found.groupBy("hash", "piece").agg(F.expr(f"min({_PLACE})").alias("first"))
    first = first.withColumnsRenamed({"hash": "_hash", "piece": "_piece"})
    return found.join(first, F.expr("hash = _hash AND piece <=> _piece")).filter(
        f"{_PLACE} <> first AND NOT (doc_id <=> first.doc_id AND text_key = first.text_key"
        " AND start <= first.start + bytes)"
    )


def repeated_runs(docs: DataFrame, store: Store, bits: int = 64) -> DataFrame:
    """(doc_id, text_key, start, cut, line, lines) of copied chunks, then of copied pairs of lines.

    Pairs inside copied chunks aren't looked at again: the first chunk of that content has them all.
    ``bits`` are those of the hash that are used.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    schema = f"doc_id {kind}, text_key long, {_FIELDS}"
    runs = store.save(texts.mapInArrow(_runs(bits), schema), "runs")
    chunks = store.save(copies(texts, runs.filter("chunk = -1"), store, "chunks"), "chunk-copies")
    gone = chunks.selectExpr("doc_id AS _id", "text_key AS _key", "start AS _start")
    pairs = runs.filter("chunk <> -1").join(
        gone, F.expr("text_key = _key AND chunk = _start AND doc_id <=> _id"), "left_anti"
    )
    pairs = copies(texts, store.save(pairs, "pairs"), store, "pairs")
    return chunks.unionByName(pairs).select("doc_id", "text_key", "start", "cut", "line", "lines")


def _without(names: list[str]):
    def run(batches):
        for rows in batches:
            texts, stretches, lines = [], [], []
            for text, starts, cuts, firsts, counts in zip(
                *(
                    rows.column(c).to_pylist()
                    for c in ("text", "_starts", "_cuts", "_lines", "_counts")
                ),
                strict=True,
            ):
                stretches.append(0)
                lines.append(0)
                if text is None or not starts:
                    texts.append(text)
                    continue
                data, kept, at, line = text.encode("utf-8", "replace"), [], 0, 0
                for start, cut, first, n in sorted(
                    zip(starts, cuts, firsts, counts, strict=True)
                ):
                    if start > at or not at:
                        stretches[-1] += 1
                        kept.append(data[at:start])
                    lines[-1] += first + n - max(first, line)
                    at, line = start + cut, first + n
                texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
            own = {c: rows.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            counts = [pa.array(n, pa.int64()) for n in (stretches, lines)]
            yield pa.RecordBatch.from_arrays(
                [*own.values(), *counts], [*own, "removed_chunks", "removed_lines"]
            )

    return run


def dedup_lines(docs: DataFrame, store: Store) -> DataFrame:
    """Rows of ``docs`` with repeated runs cut from ``text``, and how much was cut.

    Adds ``removed_chunks``, the stretches cut, and ``removed_lines`` (columns of these names are
    replaced). Null texts stay null, empty ones empty; rows that repeat both id and text count as one
    document, so each of them keeps what is first in it.
    """
    spans = "array_sort(collect_list(struct(start, cut, line, lines)))"
    gone = (
        repeated_runs(docs, store)
        .groupBy("doc_id", "text_key")
        .agg(F.expr(spans).alias("_spans"))
        .selectExpr(
            "doc_id AS _id", "text_key AS _key", "_spans.start AS _starts", "_spans.cut AS _cuts",
            "_spans.line AS _lines", "_spans.lines AS _counts",
        )
    )
    names = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    keyed = docs.select(*names).withColumn("_text_key", F.xxhash64("text"))
    joined = keyed.join(gone, F.expr("_text_key = _key AND doc_id <=> _id"), "left")
    schema = keyed.drop("_text_key").schema.add("removed_chunks", "long").add(
        "removed_lines", "long"
    )
    return joined.select(*names, "_starts", "_cuts", "_lines", "_counts").mapInArrow(
        _without(names), schema
    )


def op5_line_dedup(spark, folder: str) -> DataFrame:
    """What repeated runs of lines were cut from every document, and a digest of what is left."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, Store(spark)).selectExpr(
        "doc_id",
        "removed_chunks",
        "removed_lines",
        "CAST(octet_length(coalesce(text, '')) AS BIGINT) AS kept_bytes",
        "sha2(coalesce(text, ''), 256) AS kept_sha256",
    )
