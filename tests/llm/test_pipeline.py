"""Each stage of the corpus pipeline against brute force on its own input, and near duplicates."""

import math
import random
import re
import string
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import regex

from patronscope.llm import near_duplicates as nd
from patronscope.llm.decontamination import UNITS, contaminated, op2_decontamination
from patronscope.llm.near_duplicates import keep_one_of_each, near_duplicates
from patronscope.llm.shared import Store

FOLDER = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def shingles(text: str | None) -> set:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups_by_hand(texts: list) -> list[int]:
    """For each text the first place of those it is linked to, over links."""
    sets, parent, holders = [shingles(t) for t in texts], list(range(len(texts))), {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own:
            holders.setdefault(s, []).append(i)
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def stored(spark):
    """The input of each stage and, last, the result."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, docs))
        docs = Store(spark).save(stage(spark, docs, FOLDER), name)
    return dict(found) | {"result": docs}


def test_stages_keep_the_columns(stored):
    first = stored["toxicity"].columns
    assert all(stored[n].columns == first for n in list(stored)[:-1])
    assert {*first, "shard", "grown_shard"} <= set(stored["result"].columns)


def test_toxic_documents_go_and_clean_ones_stay(spark, stored):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before = {r.doc_id for r in stored["toxicity"].select("doc_id").collect()}
    after = {r.doc_id for r in stored["near_duplicates"].select("doc_id").collect()}
    clean = [d for d in before if toxic.get(d) == 0]
    assert sum(d not in after for d in clean) <= 0.02 * len(clean)
    bad = [d for d in before if toxic.get(d) == 1]
    assert sum(d not in after for d in bad) >= 0.9 * len(bad)


def test_one_of_each_group_stays(stored):
    rows = sorted(stored["near_duplicates"].select("doc_id", "text").collect())
    groups = groups_by_hand([r.text for r in rows])
    want = [rows[g].doc_id for i, g in enumerate(groups) if i == g]
    got = stored["decontamination"].select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == want


def test_documents_with_benchmark_items_go(spark, stored):
    """Whole items are looked for as plain runs of words, so these at least must go."""
    split = re.compile(r"\w+")
    items = [
        " ".join(split.findall(r.text.lower()))
        for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    ]
    kept = {r.doc_id for r in stored["mixing"].select("doc_id").collect()}
    rows = stored["decontamination"].select("doc_id", "text").collect()
    found = {
        r.doc_id
        for r in rows
        if any(f" {item} " in f" {' '.join(split.findall((r.text or '').lower()))} " for item in items)
    }
    assert found and not found & kept
    gone = {r.doc_id for r in rows} - kept
    assert len(gone) < len(rows) / 10


def test_mix_meets_the_targets(stored):
    """Targets by water filling: a source at its limit gives the rest to the others."""
    size = {}
    before = Counter()
    for r in stored["mixing"].select("doc_id", "source", "text").collect():
        size[r.doc_id] = (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        before[r.source] += size[r.doc_id][1]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(before, key=lambda s: (s is None, s)))}
    target, free = {}, dict(weights)
    while True:
        left = sum(before.values()) - sum(target.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * before[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * before[s]
            del free[s]
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    copies = Counter(r.doc_id for r in stored["sharding"].select("doc_id").collect())
    taken = Counter()
    for d, n in copies.items():
        assert n <= 3
        taken[size[d][0]] += n * size[d][1]
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)


def test_every_row_gets_a_shard(stored):
    rows = stored["result"].select("doc_id", "shard", "grown_shard").collect()
    assert len(rows) == stored["sharding"].count()
    of = {}
    for r in rows:
        assert 0 <= r.shard < corpus_pipeline.SHARDS
        assert r.grown_shard in (r.shard, corpus_pipeline.SHARDS)
        assert of.setdefault(r.doc_id, r.shard) == r.shard
    moved = sum(r.grown_shard != r.shard for r in rows) / len(rows)
    assert 0 < moved < 0.25


AWKWARD = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, target string,"
    " copies int, source_size int, words int, row string, _copy string, whole string, id string,"
    " text_key string, kept_id int, copy int, shard string"
)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "sharding"])
def test_awkward_rows_and_clashing_names(spark, name):
    own = (111, "keep", 222, 7, 8, "r", "c", "w", "i", "k", 9, 10, "s")
    texts = [(1, None), (1, ""), (None, None), (None, "no id"), (2, "w " * 50_000), (2, "w " * 50_000)]
    rows = [(d, t, None, None, None, *own) for d, t in texts]
    docs = spark.createDataFrame(rows, AWKWARD)
    out = STAGES[name](spark, docs, FOLDER)
    assert out.schema.names == docs.schema.names
    assert {tuple(r)[5:] for r in out.collect()} == {own}
    assert STAGES[name](spark, docs.limit(0), FOLDER).count() == 0
    assert STAGES["sharding"](spark, docs, FOLDER).count() == len(rows)


def component_of(spark, rows) -> dict:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, Store(spark)).collect()
    return Counter((r.doc_id, r.component_id) for r in found)


@pytest.mark.parametrize("bridge", [2, None])
def test_a_text_without_id_links_others(spark, bridge):
    """1 and 3 are linked through the middle text only, whether or not it has an id."""
    words = [f"w{i}" for i in range(104)]
    middle = " ".join(words[:100])
    left = " ".join(["x", "y", "z", "u", "v", "q", "p", *words[7:100]])
    right = " ".join([*words[:93], "a", "b", "c", "d", "e", "f", "g"])
    texts = [left, middle, right]
    assert groups_by_hand([left, right]) == [0, 1] and groups_by_hand(texts) == [0, 0, 0]
    rows = [(1, left), (bridge, middle), (bridge, middle), (3, right), (None, "alone here")]
    assert component_of(spark, rows) == Counter([(1, 1), (bridge, 1), (bridge, 1), (3, 1), (None, None)])
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), Store(spark))
    assert sorted(r.text for r in kept.collect()) == sorted([left, "alone here"])


def test_regular_words_do_not_collide(spark):
    """A Thue-Morse word and its complement agree in any sum of powers modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    assert component_of(spark, rows) == Counter([(1, 1), (2, 2)])


def test_a_family_of_unlinked_copies(spark, monkeypatch):
    """Copies of one text with many changes: few are linked, all share shingles; small cells."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for d in range(150):
        changed = set(rng.sample(range(80), rng.randrange(1, 9)))
        rows.append((d, " ".join(f"c{d}x{i}" if i in changed else w for i, w in enumerate(base))))
    groups = groups_by_hand([t for _, t in rows])
    assert 5 < len(set(groups)) < 140
    assert component_of(spark, rows) == Counter(enumerate(groups))


def found_items(spark, texts: list, items: list) -> dict:
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {
        (r.doc_id, r.item_id): (r.matched, r.item_windows)
        for r in contaminated(docs, bench, Store(spark)).collect()
    }


def test_slots_are_checked_without_an_id(spark):
    """A question with other figures, one of them inconsistent, matches alike with and without id."""
    item = (
        "If Anna buys 12 apples for 3 dollars and then, Anna gives 5 apples to Peter, how many of"
        " the apples does Anna still have at the end of the day when 12 were bought first"
    )
    changed = item.replace("12 apples", "48 apples").replace("12 were", "31 were")
    got = found_items(spark, [(1, changed), (None, changed + " ")], [(1, item)])
    assert got[1, 1] == got[None, 1] and got[1, 1][0] < got[1, 1][1]


def test_items_without_template_windows(spark):
    """Short items and rows of figures are found as literal copies, and only so."""
    items = [(1, "What is 17 plus 25?"), (2, "1 2 3 5 8 13 21 34 55 89 144"), (3, "too short"), (4, None)]
    texts = [
        (1, "He asked: what is 17 plus 25? Nobody knew."),
        (2, "He asked: what is 18 plus 25? Nobody knew."),
        (None, "The row 1 2 3 5 8 13 21 34 55 89 144 goes on."),
        (3, "The row 1 2 3 5 8 13 22 35 57 92 149 doesn't."),
        (4, "This is too short a text, or 17 plus 25 words."),
        (5, ""),
        (6, None),
    ]
    assert found_items(spark, texts, items) == {(1, 1): (1, 1), (None, 2): (4, 4)}
    assert found_items(spark, texts[:2], items[3:]) == {}


def template_words(text: str | None) -> list[tuple]:
    """(slot or word, word) of a text: digits first, names after a lower-case letter or comma, units."""
    text = regex.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "\x04", text or "")
    text = regex.sub(r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", "\x03\\1", text).lower()
    found = [w for w in re.split(f"[ \\t\\n\\v\\f\\r{re.escape(string.punctuation)}]+", text) if w]
    kinds = []
    for i, w in enumerate(found):
        number = w[0] in "0123456789"
        unit = w in UNITS and i > 0 and found[i - 1][0] in "0123456789"
        kinds.append("number" if number else "name" if w[0] == "\x03" else "unit" if unit else f"={w}")
    return list(zip(kinds, found, strict=True))


def contaminated_by_hand(texts: dict, items: dict) -> tuple[dict, set]:
    """(matched, item_windows) by document and item; items with a template window that repeats."""
    usable, repeating = {}, set()
    for item, text in items.items():
        own, seen = template_words(text), set()
        for place in range(len(own) - 7):
            window = own[place : place + 8]
            kinds = tuple(k for k, _ in window)
            if sum(k[0] == "=" for k in kinds) < 4:
                continue
            if kinds in seen:
                repeating.add(item)
            seen.add(kinds)
            usable.setdefault(kinds, []).append((item, place, [w for _, w in window]))
    sizes = Counter(item for found in usable.values() for item, _, _ in found)
    result = {}
    for doc, text in texts.items():
        own, met = template_words(text), defaultdict(list)
        for place in range(len(own) - 7):
            window = own[place : place + 8]
            for item, at, was in usable.get(tuple(k for k, _ in window), ()):
                slots = [(k, a, b) for (k, b), a in zip(window, was, strict=True) if k[0] != "="]
                met[item].append((at, slots))
        for item, found in met.items():
            became = defaultdict(Counter)
            for _, slots in found:
                for kind, was, now in slots:
                    became[kind, was][now] += 1
            usual = {x: max(c, key=lambda now: (c[now], now)) for x, c in became.items()}
            right = {at for at, slots in found if all(usual[k, was] == now for k, was, now in slots)}
            if len(right) >= min(sizes[item], max(3, math.ceil(0.1 * sizes[item]))):
                result[doc, item] = (len(right), sizes[item])
    return result, repeating | (set(items) - set(sizes))


def test_decontamination_by_hand(spark):
    """All documents against all items; one that says a thing twice may choose either place."""
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()
    texts = {r.doc_id: r.text for r in read("documents")}
    items = {r.item_id: r.text for r in read("benchmark")}
    want, either = contaminated_by_hand(texts, items)
    got = {
        (r.doc_id, r.item_id): (r.matched, r.item_windows)
        for r in op2_decontamination(spark, FOLDER).collect()
    }
    plain = {k: v for k, v in got.items() if k[1] not in either}
    assert plain == {k: v for k, v in want.items() if k[1] not in either}
    assert len(plain) > 10 and len(either) < len(items) / 10
