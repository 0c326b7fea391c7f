"""Spelling variants by Bloom-guided neighbourhoods.

Two words are near if they differ by one inserted, deleted or replaced letter. Instead of shuffling
every possible edit of every word, the edits are generated and hashed in numpy and probed against
blocked Bloom filters of the vocabulary, one for each word length. Filters are built by tasks and
broadcast in rounds of bounded size, so a vocabulary of any size is covered. Only edits that pass
are shuffled, to a join with the vocabulary by their text, which removes false positives; a word
that is there always passes, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store
from patronscope.llm.texthash import mix

# Words of fewer code points or occurrences aren't looked at by the query.
LEAST_LETTERS, LEAST_SEEN = 7, 2
# How many times as frequent a word's form has to be.
RATIO = 10
# A block has eight words of 32 bits, of which a key sets one bit each.
LANES = 8
BITS_PER_WORD = 24
# Blocks that one task fills, and most bytes of filters that are sent to the executors at once.
SEGMENT = 4096
ROUND_BYTES = 1 << 26
# Letters of a batch of words of one length that are edited together.
STRETCH = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_SALTS = mix(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)

Piece = tuple[int, int, int, int]


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def letter_values(letters: np.ndarray) -> np.ndarray:
    return mix((letters.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, code points): a matrix for words of one length, of bounded size."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, STRETCH // max(1, int(length)))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            joined = "".join([words[i] for i in some]).encode("utf-32-le")
            yield some, np.frombuffer(joined, dtype=np.uint32).reshape(len(some), length)


def spread(sums: np.ndarray) -> np.ndarray:
    """Spread sums of letter values over all bits; the upper half chooses a block."""
    h = sums * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
    """The bit, 0 to 31, that a key sets in a lane of its block."""
    return (((h & np.uint64(0xFFFFFFFF)) * _SALTS[lane]) >> np.uint64(59)).astype(np.uint32)


def blocks_for(words: int) -> int:
    """Blocks of the filter of so many words; ``block_of`` can tell 2^32 apart."""
    return min(max(1, -(-words * BITS_PER_WORD // (32 * LANES))), 1 << 32)


def _hashed(blocks: dict[int, int]):
    def run(batches):
        for rows in batches:
            words = rows["word"].tolist()
            for _, letters in by_length(words):
                length = letters.shape[1]
                values = letter_values(letters)
                h = spread((values * _powers(length)).sum(axis=1, dtype=np.uint64))
                segment = block_of(h, blocks[length]) // np.uint64(SEGMENT)
                yield pd.DataFrame(
                    {"letters": length, "segment": segment.astype(np.int64), "h": h.view(np.int64)}
                )

    return run


def _filled(blocks: dict[int, int]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        length, segment = key
        h = rows["h"].to_numpy().view(np.uint64)
        first = segment * SEGMENT
        bits = np.zeros((min(SEGMENT, blocks[length] - first), LANES), dtype=np.uint32)
        place = block_of(h, blocks[length]).astype(np.int64) - first
        for lane in range(LANES):
            np.bitwise_or.at(bits[:, lane], place, np.uint32(1) << lane_bit(h, lane))
        return pd.DataFrame({"letters": [length], "segment": [segment], "bits": [bits.tobytes()]})

    return run


def rounds(blocks: dict[int, int]) -> list[list[tuple[int, int, int]]]:
    """Pieces (length, first block, end) of all filters, in groups of at most ``ROUND_BYTES``."""
    most = max(SEGMENT, ROUND_BYTES // (4 * LANES) // SEGMENT * SEGMENT)
    found, group, size = [], [], 0
    for length, n in sorted(blocks.items()):
        first = 0
        while first < n:
            if size >= most:
                found.append(group)
                group, size = [], 0
            end = min(n, first + max(SEGMENT, (most - size) // SEGMENT * SEGMENT))
            group.append((length, first, end))
            size += -(-(end - first) // SEGMENT) * SEGMENT
            first = end
    return found + [group] if group else found


class Probe:
    """The filters of one round. ``pieces``: length -> (blocks in all, first, end, offset)."""

    def __init__(self, pieces: dict[int, Piece], bits: np.ndarray, letters: np.ndarray):
        self.pieces, self.bits, self.letters = pieces, bits, letters

    def passing(self, length: int, sums: np.ndarray) -> np.ndarray:
        """Places of the keys that may be words of that length in this round."""
        blocks, first, end, offset = self.pieces[length]
        h = spread(sums)
        block = block_of(h, blocks).astype(np.int64)
        if first > 0 or end < blocks:
            left = np.flatnonzero((block >= first) & (block < end))
            h, block = h[left], block[left]
        else:
            left = None
        at = (block + (offset - first)) * LANES
        for lane in range(LANES):
            hit = np.flatnonzero((self.bits[at + lane] >> lane_bit(h, lane)) & np.uint32(1))
            left = hit if left is None else left[hit]
            if not len(left):
                break
            h, at = h[hit], at[hit]
        return left

    def edits(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        """(rows, edited words): replacements and deletions that pass. Of two words that differ by
        a replacement only one has the other among its edits, and the longer one of two lengths."""
        n, length = letters.shape
        up = _powers(length + 1)
        values = letter_values(letters)
        sums = np.zeros((n, length + 1), dtype=np.uint64)
        np.cumsum(values * up[:-1], axis=1, out=sums[:, 1:])
        whole = sums[:, -1:]
        if length in self.pieces:
            index = np.searchsorted(self.letters, letters)
            size = len(self.letters)
            known = letter_values(self.letters)
            for step in range(1, size // 2 + 1):
                after = np.roll(np.arange(size), -step)
                moved = (known[after] - known)[index]
                hit = self.passing(length, (whole + moved * up[:-1]).ravel())
                row, place = np.divmod(hit, length)
                old = index[row, place]
                if 2 * step == size:  # both directions have the same step
                    row, place, old = (x[old < after[old]] for x in (row, place, old))
                if len(row):
                    edited = letters[row]
                    edited[np.arange(len(row)), place] = self.letters[after[old]]
                    yield row, _texts(edited)
        if length - 1 in self.pieces and length > 1:
            rest = sums[:, :-1] + (whole - sums[:, 1:]) * _INVERSE
            hit = self.passing(length - 1, rest.ravel())
            row, place = np.divmod(hit, length)
            # Of equal neighbours only the first is deleted.
            new = (place == 0) | (letters[row, place] != letters[row, np.maximum(place - 1, 0)])
            row, place = row[new], place[new]
            if len(row):
                kept = np.arange(length - 1)[None, :]
                kept = kept + (kept >= place[:, None])
                yield row, _texts(np.take_along_axis(letters[row], kept, axis=1))

    def run(self, batches):
        for rows in batches:
            words = rows["word"].tolist()
            n = rows["n"].to_numpy()
            for places, letters in by_length(words):
                for row, edited in self.edits(letters):
                    at = places[row]
                    yield pd.DataFrame(
                        {"word": [words[i] for i in at], "n": n[at], "near": edited}
                    )


def _texts(letters: np.ndarray) -> list[str]:
    n, length = letters.shape
    joined = letters.tobytes().decode("utf-32-le")
    return [joined[i : i + length] for i in range(0, n * length, length)]


def near_pairs(vocabulary: DataFrame, store: Store) -> DataFrame:
    """(word, n, near, near_n): every two near words of ``vocabulary`` (word, n) once."""
    spark = vocabulary.sparkSession
    sizes = vocabulary.groupBy(F.length("word").alias("letters")).count().collect()
    blocks = {r["letters"]: blocks_for(r["count"]) for r in sizes}
    alphabet = (
        vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
        .distinct()
        .collect()
    )
    letters = np.sort(np.array([ord(r["letter"]) for r in alphabet if r["letter"]], np.uint32))
    filters = store.save(
        vocabulary.select("word")
        .mapInPandas(_hashed(blocks), "letters int, segment long, h long")
        .groupBy("letters", "segment")
        .applyInPandas(_filled(blocks), "letters int, segment long, bits binary"),
        "filters",
    )
    passed = None
    for number, group in enumerate(rounds(blocks)):
        pieces, offset = {}, 0
        for length, first, end in group:
            pieces[length] = (blocks[length], first, end, offset)
            offset += end - first
        # The pieces of a round are one range of (length, segment).
        low, high = group[0], group[-1]
        own = filters.filter(
            f"(letters, segment) BETWEEN ({low[0]}, {low[1] // SEGMENT}L)"
            f" AND ({high[0]}, {(high[2] - 1) // SEGMENT}L)"
        ).collect()
        own.sort(key=lambda r: (r["letters"], r["segment"]))
        bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in own), dtype=np.uint32)
        probe = spark.sparkContext.broadcast(Probe(pieces, bits, letters))
        lengths = sorted({x for length in pieces for x in (length, length + 1)} & set(blocks))
        asked = vocabulary.filter(F.length("word").between(lengths[0], lengths[-1]))
        edits = asked.mapInPandas(
            lambda batches, probe=probe: probe.value.run(batches), "word string, n long, near string"
        )
        found = store.save(
            edits.join(vocabulary.selectExpr("word AS near", "n AS near_n"), "near").select(
                "word", "n", "near", "near_n"
            ),
            f"pairs-{number}",
        )
        probe.unpersist()
        passed = found if passed is None else passed.unionByName(found)
    if passed is None:
        passed = vocabulary.selectExpr("word", "n", "word AS near", "n AS near_n")
    return passed


def _roots(forms: DataFrame, store: Store) -> DataFrame:
    """(word, root): the last word reached over forms.

    Counts grow by ``RATIO`` with each form, so a chain is short; each step halves what is left.
    """
    now = store.save(forms.selectExpr("word", "form AS root"), "roots-0")
    step = 0
    while True:
        step += 1
        ahead = now.selectExpr("word AS root", "root AS further")
        now = store.save(
            now.join(ahead, "root", "left").selectExpr(
                "word", "coalesce(further, root) AS root", "further IS NOT NULL AS moved"
            ),
            f"roots-{step}",
        )
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(vocabulary: DataFrame, store: Store, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``vocabulary``.

    ``vocabulary`` has distinct words and their counts n; null and empty words are left out. A
    word's form is its near word of largest n (ties: smallest in code-point order) if that is at
    least ``ratio`` times its own n, else null; its root is where the forms end, itself without one.
    Other columns aren't read. An empty vocabulary gives no rows. Words may have any length.
    """
    vocabulary = store.save(
        vocabulary.filter("word <> '' AND n IS NOT NULL").selectExpr("word", "CAST(n AS LONG) AS n"),
        "vocabulary",
    )
    pairs = near_pairs(vocabulary, store)
    both = pairs.unionByName(
        pairs.selectExpr("near AS word", "near_n AS n", "word AS near", "n AS near_n")
    )
    counts = both.groupBy("word").agg(F.count("*").alias("n_near"))
    forms = store.save(
        both.filter(f"near_n >= {ratio} * n")
        .groupBy("word")
        .agg(F.expr("min(struct(-near_n AS less, near)) AS best"))
        .selectExpr("word", "best.near AS form", "-best.less AS form_n"),
        "forms",
    )
    return (
        vocabulary.join(counts, "word", "left")
        .join(forms.join(_roots(forms, store), "word"), "word", "left")
        .selectExpr(
            "word", "form", "coalesce(root, word) AS root", "n", "coalesce(n_near, 0L) AS n_near",
            "form_n",
        )
    )


def altered_words(docs: DataFrame) -> DataFrame:
    """(word, n): counts of the words of whole texts, some of which lose a letter.

    A run of letters A-Z, a-z and U+00C0-U+00FF, with A-Z as a-z, loses one code point where the
    crc32 of ``<doc_id>:<run>`` is divisible by 31. Null texts have no words, a null id counts as
    empty, repeated rows count each. Only words of ``LEAST_LETTERS`` or more that occur
    ``LEAST_SEEN`` times or more are returned; shorter runs cannot become such words, so the pattern
    passes them over.
    """
    runs = docs.selectExpr(
        "coalesce(CAST(doc_id AS STRING), '') AS id",
        f"explode(regexp_extract_all(text, '[A-Za-z\\\\u00C0-\\\\u00FF]{{{LEAST_LETTERS},}}', 0)) AS run",
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = runs.selectExpr("id", f"translate(run, '{upper}', '{upper.lower()}') AS run")
    hashed = lowered.selectExpr("run", "crc32(CAST(concat(id, ':', run) AS BINARY)) AS h")
    words = hashed.selectExpr(
        "IF(h % 31 = 0, concat(substring(run, 1, CAST(h % length(run) AS INT)),"
        " substring(run, CAST(h % length(run) AS INT) + 2)), run) AS word"
    )
    return (
        words.filter(F.length("word") >= LEAST_LETTERS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= LEAST_SEEN)
    )


def op12_spelling(spark, folder: str) -> DataFrame:
    """Variants among all words of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return spelling_variants(altered_words(docs), Store(spark))
