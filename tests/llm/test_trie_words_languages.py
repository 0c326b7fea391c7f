"""Conversation trie, spelling variants and language identification against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from patronscope.llm import language_id, spelling
from patronscope.llm.conversation_trie import IDS, conversation_trie
from patronscope.llm.language_id import fit_languages, identify
from patronscope.llm.shared import Store
from patronscope.llm.spelling import altered_words, spelling_variants

TURNS = "conv_id long, turn long, role string, text string, node string, place string, path string"


def turns_frame(spark, conversations: dict):
    rows = [
        Row(c, i, role, text, "x", "y", "z")
        for c, turns in conversations.items()
        for i, (role, text) in enumerate(turns)
    ]
    return spark.createDataFrame(rows, TURNS).repartition(5)


def trie_by_hand(conversations: dict) -> set:
    """Every prefix is visited once for each conversation that starts with it."""
    members: dict = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    found = set()
    for top, convs in members.items():
        under = [p for p in members if p[: len(top)] == top]
        leaves = [p for p in under if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(top))
        found.add(
            (
                min(convs), len(top), min(members[top[:-1]]) if top else None, len(convs),
                sum(1 for q in members if q and q[:-1] == top), len(leaves), saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def test_trie_matches_brute_force(spark):
    rng = random.Random(4)
    words = ["yes", "no", "", "é", "why " * 50]
    conversations = {
        c * 7 - 20: [(rng.choice(["user", ""]), rng.choice(words)) for _ in range(rng.randrange(1, 7))]
        for c in range(120)
    }
    # Copies of one long conversation, one that leaves it late, and one that stops inside it.
    long = [("user", f"turn {i}") for i in range(41)]
    conversations |= {9000 + c: long for c in range(2 * IDS + 5)}
    conversations |= {5: [*long[:12], ("user", "else")], 6: long[:9]}
    got = conversation_trie(turns_frame(spark, conversations), Store(spark)).collect()
    assert {tuple(r) for r in got} == trie_by_hand(conversations)
    assert len(got) == len({tuple(r) for r in got})


def test_trie_of_awkward_rows(spark):
    rows = [
        Row(1, 5, "user", "b", "", "", ""),
        Row(1, None, "user", "a", "", "", ""),  # no turn: first
        Row(2, 0, None, None, "", "", ""),
        Row(3, 0, "", "", "", "", ""),  # as the one before
        Row(4, 0, "user", "a", "", "", ""),
        Row(4, 0, "user", "a", "", "", ""),  # a repeated row is a turn
        Row(None, 0, "user", "a", "", "", ""),
    ]
    got = conversation_trie(spark.createDataFrame(rows, TURNS), Store(spark)).collect()
    convs = {
        1: [("user", "a"), ("user", "b")], 2: [("", "")], 3: [("", "")],
        4: [("user", "a"), ("user", "a")],
    }
    assert {tuple(r) for r in got} == trie_by_hand(convs)
    empty = conversation_trie(spark.createDataFrame([], TURNS), Store(spark))
    assert empty.count() == 0


def near_by_hand(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = sorted((a, b), key=len, reverse=True)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(counts: dict, ratio: int) -> set:
    forms, near = {}, {}
    for w in counts:
        near[w] = [v for v in counts if near_by_hand(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            forms[w] = best
    found = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        found.add((w, form, root, n, len(near[w]), counts.get(form)))
    return found


@pytest.mark.parametrize("letters", ["ab", "abc", "aé語z"])
def test_variants_match_brute_force(spark, monkeypatch, letters):
    rng = random.Random(len(letters))
    counts = {
        "".join(rng.choices(letters, k=rng.randrange(1, 8))): 2 ** rng.randrange(12) for _ in range(300)
    }
    counts |= {"a" * 70_001: 5, "a" * 70_000: 50, "a" * 69_999 + "b": 500}
    # Small rounds and segments: the filters of one length are sent in several pieces.
    monkeypatch.setattr(spelling, "SEGMENT", 2)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 128)
    table = spark.createDataFrame([Row(w, n, 1) for w, n in counts.items()], "word string, n int, near int")
    got = spelling_variants(table.repartition(3), Store(spark), ratio=4).collect()
    assert len(got) == len(counts)
    assert {tuple(r) for r in got} == variants_by_hand(counts, 4)


def test_rounds_cover_all_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "ROUND_BYTES", 1 << 19)
    blocks = {7: 1, 8: 40_000, 9: 4096, 30: 3}
    groups = spelling.rounds(blocks)
    seen = {n: [] for n in blocks}
    for group in groups:
        assert sum(end - first for _, first, end in group) * 32 <= 1 << 19
        for n, first, end in group:
            assert first % spelling.SEGMENT == 0
            seen[n] += range(first, end)
    assert all(seen[n] == list(range(blocks[n])) for n in blocks)


def test_few_words_pass_that_are_not_there():
    rng = np.random.default_rng(1)
    words = rng.integers(97, 123, (20_000, 9), dtype=np.uint32)
    values = spelling.letter_values(words) * spelling._powers(9)
    h = spelling.spread(values.sum(axis=1, dtype=np.uint64))
    blocks = spelling.blocks_for(len(words))
    bits = np.zeros((blocks, spelling.LANES), dtype=np.uint32)
    place = spelling.block_of(h, blocks).astype(np.int64)
    for lane in range(spelling.LANES):
        np.bitwise_or.at(bits[:, lane], place, np.uint32(1) << spelling.lane_bit(h, lane))
    probe = spelling.Probe({9: (blocks, 0, blocks, 0)}, bits.ravel(), np.arange(97, 123, dtype=np.uint32))
    assert len(probe.passing(9, values.sum(axis=1, dtype=np.uint64))) == len(words)
    others = spelling.letter_values(rng.integers(200, 300, (100_000, 9), dtype=np.uint32))
    passed = probe.passing(9, (others * spelling._powers(9)).sum(axis=1, dtype=np.uint64))
    assert len(passed) < 100


def test_words_of_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, "Weather weather"), (None, "ÉTÉtéàç x1"), (None, "ÉTÉtéàç"), (4, "short")]
    rows.append((5, "x" * 200_000))
    rows.append((5, "x" * 200_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in altered_words(docs).collect()}
    assert got.pop("ÉtÉtéàç") == 2  # only A-Z is lowered
    assert all(len(w) in (199_999, 200_000) or w == "weather" for w in got)
    none = spelling_variants(spark.createDataFrame([], "word string, n long"), Store(spark))
    assert none.count() == 0
    odd = spark.createDataFrame([("", 3), (None, 3), ("a", None), ("b", 2)], "word string, n long")
    assert [tuple(r) for r in spelling_variants(odd, Store(spark)).collect()] == [("b", None, "b", 2, 0, None)]


SOUNDS = {"x": ["ka", "to", "mi", "rek"], "y": ["shu", "blé", "ong", "vri"], "z": ["ka", "ong", "pfu", "zd"]}


def speech(rng, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_languages_of_held_out_texts(spark):
    rng = random.Random(2)
    rows = [
        Row(i, speech(rng, lang, rng.randrange(4, 60)), lang, "s", 1.0)
        for i, lang in enumerate(rng.choices("xyz", k=600))
    ]
    schema = "doc_id long, text string, lang string, source string, score double"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    model = fit_languages(docs, Store(spark), "doc_id % 3 <> 0")
    assert model.languages == ["x", "y", "z"]
    assert len(model.of) == 3 * language_id.CENTROIDS
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = spark.createDataFrame([(1, "Qwwq Jhhj Qjwh " * 9), (2, speech(rng, "y", 40))], "doc_id long, text string")
    assert [r["rejected"] for r in identify(strange, model).orderBy("doc_id").collect()] == [True, False]


def test_languages_of_awkward_texts(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "12 – 34 … !?", "x"), (None, "katomi katomi", None),
        (5, "KATOMI " * 40_000, "x"), (5, "katomi", "x"), (6, "語", "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, Store(spark))
    got = [(r["doc_id"], r["lang_pred"]) for r in identify(docs, model).collect()]
    want = [(1, "und"), (2, "und"), (3, "und"), (None, "x"), (5, "x"), (5, "x"), (6, "y")]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = fit_languages(docs, Store(spark), "false")
    assert {r["lang_pred"] for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0
