"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than blank and 0x09-0x0D; A-Z count as a-z. Texts are joined into
buffers of about ``CHUNK`` bytes and hashed by prefix sums, so cost per byte is a few vector steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 19
# Bytes from which a word is hashed by itself.
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
WORD_VALUES = BYTE_VALUES[LOWERED]
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
# For words without punctuation: every ASCII byte but digits and letters separates.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of the base and of its inverse, as long as the longest buffer so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums with which ``span_hash`` finds the hash of any span of ``values``."""
    up, down = _powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix((sums[end] - sums[start]) * down[start] + length)


@dataclass
class Buffer:
    """Consecutive texts ``first`` to ``last - 1``; text i is bytes[start[i]:end[i]]."""

    first: int
    last: int
    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray


def buffers(texts: Sequence[str | None]) -> Iterator[Buffer]:
    """Whole texts as UTF-8 with a blank after each; a null text is empty."""
    raw: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "replace")
        raw.append(data)
        size += len(data) + 1
        if size >= CHUNK:
            yield _buffer(first, raw)
            first, size, raw = i + 1, 0, []
    if raw:
        yield _buffer(first, raw)


def _buffer(first: int, raw: list[bytes]) -> Buffer:
    joined = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    end = np.cumsum(lengths + 1) - 1
    return Buffer(first, first + len(raw), joined, end - lengths, end)


@dataclass
class Words:
    """Hashes of the words of a buffer's texts; those of text i are hash[of[i]:of[i + 1]].

    ``heads`` has one row for each asked-for length: hashes of the first so many bytes of a word.
    """

    first: int
    last: int
    hash: np.ndarray
    of: np.ndarray
    heads: list[np.ndarray]


def words(
    texts: Sequence[str | None], between: np.ndarray = BLANK, heads: Sequence[int] = ()
) -> Iterator[Words]:
    for b in buffers(texts):
        yield words_of(b, between, heads)


def words_of(b: Buffer, between: np.ndarray = BLANK, heads: Sequence[int] = ()) -> Words:
    """Words separated by the bytes that ``between`` marks; a blank must be among them."""
    blank = np.ones(len(b.bytes) + 2, dtype=bool)
    blank[1:-1] = between[b.bytes]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    sums, down = prefix_sums(WORD_VALUES[b.bytes])
    of = np.append(np.searchsorted(start, b.start), len(start))
    cut = [span_hash(sums, down, start, np.minimum(end, start + n)) for n in heads]
    found = span_hash(sums, down, start, end)
    # Sums of powers agree for some long, highly regular words.
    for i in np.flatnonzero(end - start > LONG_WORD):
        data = LOWERED[b.bytes[start[i] : end[i]]].tobytes()
        found[i] = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    return Words(b.first, b.last, found, of, cut)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending.

    A text of fewer words than ``size`` has its whole word sequence as its one shingle; one without
    words has none.
    """
    n = max(0, len(w.hash) - size + 1)
    run = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        run = run * np.uint64(_BASE) + w.hash[j : j + n]
    run = mix(run)
    found = []
    for s, e in zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True):
        if e - s >= size:
            found.append(np.unique(run[s : e - size + 1]))
        elif e > s:
            whole = np.uint64(e - s)
            for h in w.hash[s:e]:
                with np.errstate(over="ignore"):
                    whole = whole * np.uint64(_BASE) + h
            found.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            found.append(np.empty(0, dtype=np.uint64))
    return found
