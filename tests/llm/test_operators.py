"""Every operator on small awkward tables: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import Row

from patronscope.llm import quality, suffix_dedup, toxicity
from patronscope.llm import components
from patronscope.llm.components import connected_components
from patronscope.llm.decontamination import contaminated, drop_contaminated
from patronscope.llm.fingerprints import compare_versions
from patronscope.llm.licenses import _CUE, LONG_TEMPLATES, TEMPLATES, scan_licenses, wordings
from patronscope.llm.line_dedup import dedup_lines, line_runs, repeated_runs
from patronscope.llm.mixing import fit_counts, mix
from patronscope.llm.near_duplicates import keep_one_of_each, near_duplicates
from patronscope.llm.shared import Store
from patronscope.llm.sharding import SEED, assign_shards, number_slots, op1_sharding
from patronscope.llm.suffix_dedup import remove_repeats
from patronscope.llm.texthash import buffers

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, copy int,"
    " token string, place string, size string, hash string, key string, shard string, kept string"
)


def words(rng, n):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randint(30, 90))) for _ in range(20)]
    shared = " ".join(words(rng, 40))
    near = [t.split() for t in texts[:6]]
    for w in near:
        w[len(w) // 2] = "changed"
    texts += [" ".join(w) for w in near] + texts[:4] + texts[:1] * 5
    texts += [f"{a} {shared} {b}" for a, b in zip(texts[6:10], texts[10:14], strict=True)]
    texts += [None, "", "   \n\t ", "one", "One", "two words", "é" * 150, "ab" * 120, "x " * 300]
    texts += [" ".join(words(rng, 4000)), "line one\nline two\nline three\n" * 4]
    found = [(i * 3, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3]) for i, t in enumerate(texts)]
    found += [found[0], (found[1][0], "another text of a repeated id", "en", "s1")]
    found += [(None, texts[0], "en", "s1"), (None, None, None, None)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = (5, 1, 2, "t", "p", "z", "h", "k", "s", "x")
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_near_duplicates(spark, docs, rows, empty):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))
    found = near_duplicates(docs, Store(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    kept = keep_one_of_each(docs, Store(spark))
    assert kept.columns == docs.columns
    texts = Counter(r.text for r in kept.collect())
    assert texts[rows[0][1]] == 1 and texts["another text of a repeated id"] == 1
    assert near_duplicates(empty, Store(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (70, 60), (80, 80), (60, 50)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Store(spark), "c")
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 70: 50}


def test_suffix_dedup(spark, docs, rows, empty):
    last = (1 << 63) - 1
    order, seen, want = {}, set(), {}
    for r in rows:
        h = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        key = (last if r[0] is None else r[0], 42 if r[1] is None else h - (1 << 64) * (h >> 63))
        order[key] = (r[1] or "").encode()
    for key, data in sorted(order.items()):
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[key[0], data] = (kept, sum(gone), spans)
    found = remove_repeats(docs, Store(spark)).collect()
    assert len(found) == len(rows)
    for r in found:
        key = (last if r.doc_id is None else r.doc_id, (r.text or "").encode())
        assert (bytes(r.kept), r.n_removed, r.n_spans) == want[key]
    assert remove_repeats(empty, Store(spark)).count() == 0


@pytest.mark.parametrize("shared", [60, 82, 100, 101, 150, 400])
def test_pieces_of_repeated_strings_meet(shared):
    """Pieces with a copy of one of their strings have another's key; few shared bytes do not do."""
    rng = random.Random(shared)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = fresh(shared)
    texts = [fresh(n) + passage + fresh(300) for n in (0, 130, 211)] + [fresh(50)]
    (b,) = buffers(texts)
    lo, n, _, _, after = suffix_dedup.stretches(b)
    text = np.searchsorted(b.start, lo, side="right") - 1
    assert sum(n) == sum(max(0, len(t) - 99) for t in texts)
    wanted = [
        [{"lo": at, "span": span} for at, span in zip(lo[own] - b.start[i], (n | after << 8)[own])]
        for i, own in enumerate(text == np.arange(len(texts))[:, None])
    ]
    rows = pd.DataFrame({"id": range(len(texts)), "copy": 0, "text": texts, "wanted": wanted})
    pieces = pd.concat(suffix_dedup._cut_out([rows[rows["wanted"].map(len) > 0]]))
    assert pieces["n"].sum() == sum(n)
    holders = {}
    for key, id_, at, count, data in pieces[["key", "id", "lo", "n", "data"]].values:
        assert data == texts[id_].encode()[at : at + count + 99]
        for i in range(count):
            holders.setdefault(data[i : i + 100], set()).add(key)
    assert all(len(keys) == 1 for keys in holders.values())
    met = pieces["key"].value_counts()
    if shared < 83:
        assert met.max() == 1
    for i in range(shared - 99):
        (key,) = holders[passage.encode()[i : i + 100]]
        assert met[key] == 3


def test_repeated_starts_against_a_dictionary(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2600] = text[100:700]
    text[3000:3300] = 97
    starts = np.arange(len(text) - 99)
    seen, want = set(), []
    for s in starts:
        piece = text[s : s + 100].tobytes()
        if piece in seen:
            want.append(s)
        seen.add(piece)
    assert suffix_dedup.repeated_starts(text, starts).tolist() == want
    cover = set(suffix_dedup.COVER.tolist())
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))


def test_a_block_without_copies():
    data = [bytes(range(i, i + 110)) for i in (1, 140)]
    rows = pd.DataFrame({"id": [0, 1], "copy": 0, "lo": 0, "n": 11, "data": data})
    assert not len(suffix_dedup._sort_block(rows))
    found = suffix_dedup._sort_block(pd.concat([rows, rows.assign(id=[5, 6])]))
    assert found[["id", "lo", "n"]].values.tolist() == [[5, 0, 11], [6, 0, 11]]


def test_crowded_seeds_give_the_same(spark, docs, monkeypatch):
    whole = {(r.doc_id, r.text, r.n_removed) for r in remove_repeats(docs, Store(spark)).collect()}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1)
    again = {(r.doc_id, r.text, r.n_removed) for r in remove_repeats(docs, Store(spark)).collect()}
    assert again == whole


def draw(key, shard: int, seed: int) -> float:
    """The hash of three values, each seeded by the one before; a null is left out."""
    h = 42
    for value, size in ((key, 8), (shard, 4), (seed, 4)):
        if value is not None:
            h = xxhash.xxh64(value.to_bytes(size, "little", signed=True), seed=h).intdigest()
    return ((h >> 11) + 0.5) / 2**53


def shard_by_hand(key, weights: list[float]) -> int:
    return min(range(len(weights)), key=lambda s: -math.log(draw(key, s, SEED)) / weights[s])


def test_sharding_by_hand(spark):
    """The query's rows over a whole table, and weighted shards of awkward keys."""
    folder = "/root/testdata/sf0.001"
    got = op1_sharding(spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == shard_by_hand(r.doc_id, [1.0] * 8)
        assert r.grown_shard == shard_by_hand(r.doc_id, [1.0] * 9)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    keys = [None, 0, -1, 2**62, -(2**63), *range(100, 400), 100, 100]
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for r in assign_shards(docs, [0.5, 1.0, 3.0], grown_weight=2.0).collect():
        assert r.shard == shard_by_hand(r.doc_id, [0.5, 1.0, 3.0])
        assert r.grown_shard == shard_by_hand(r.doc_id, [0.5, 1.0, 3.0, 2.0])


def test_sharding(spark, docs, rows, empty):
    placed = assign_shards(docs, [1.0, 1.0, 2.0])
    got = number_slots(placed, Store(spark)).collect()
    assert len(got) == len(rows)
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    many = assign_shards(spark.range(20000).withColumnRenamed("id", "doc_id"), [1.0, 1.0, 2.0])
    share = {r.shard: r["count"] for r in many.groupBy("shard").count().collect()}
    assert abs(share[2] - 10000) < 400 and abs(share[0] - 5000) < 300
    assert number_slots(assign_shards(empty, [1.0]), Store(spark)).count() == 0
    with pytest.raises(ValueError):
        assign_shards(docs, [0.0])


def test_fit_counts_is_exact_where_a_sum_exists():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 4))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 120))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = fit_counts(lengths, counts, budget)
        got = int((taken * lengths).sum())
        assert (taken <= counts).all() and (taken >= 0).all() and got <= budget
        if budget >= max(sums):
            assert got == max(sums)


def test_mix(spark, docs, rows, empty):
    found = mix(docs, Store(spark)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source]
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    rate = {s: target[s] / w for s, w in (("s1", 5), ("s2", 2), (None, 1))}
    free = [s for s in size if target[s] < 3 * size[s] - 1e-6]
    assert all(rate[s] == pytest.approx(max(rate.values())) for s in free)
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    again = mix(docs.repartition(7), Store(spark)).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in again) == Counter(
        (r.doc_id, r.text, r.copies) for r in found
    )
    assert mix(empty, Store(spark)).count() == 0


def test_decontamination(spark, docs, empty):
    item = (
        "If Anna buys 12 apples for 3 dollars and then, Anna gives 5 apples to Peter, how many of"
        " the apples does Anna still have at the end of the day when 12 were bought first"
    )
    bench = spark.createDataFrame(
        [(1, item, 7), (2, None, 7), (3, "", 7), (4, "too short", 7), (None, item, 7)],
        "item_id long, text string, doc_id long",
    )
    changed = item.replace("12", "48").replace("3 d", "9 d").replace("5", "7").replace("Anna", "Zoe")
    mixed_up = changed.replace("48 were", "31 were")
    extra = [(9001, f"some words before {item} and after"), (9002, changed), (9003, mixed_up)]
    extra += [(9004, item.upper()), (9005, "nothing of the kind is in here at all, be sure of it")]
    texts = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string")
    )
    got = {r.doc_id: r for r in contaminated(texts, bench, Store(spark)).collect()}
    assert {9001, 9002, 9003, 9004} == set(got)
    assert got[9003].matched < got[9002].matched == got[9002].item_windows
    kept = drop_contaminated(texts, bench, Store(spark))
    assert kept.count() == texts.count() - 4
    assert contaminated(empty, bench, Store(spark)).count() == 0
    assert contaminated(texts, bench.limit(0), Store(spark)).count() == 0


def test_fingerprints(spark, rows, docs, empty):
    pattern = re.compile(r"[^\n]{120,}?[.!?](?=[ \t\n\x0b\f\r])|[^\n]+")
    own = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = sorted(((r.doc_id, r.text or "") for r in own.collect()), reverse=True)
    got = {r.doc_id: r for r in compare_versions(own, Store(spark)).collect()}
    assert len(got) == len(texts)
    for k, (doc_id, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(pattern.findall(t)) for t in (text, edited, after))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
    assert compare_versions(docs, Store(spark)).count() == len(rows)
    assert compare_versions(empty, Store(spark)).count() == 0


def scanned(spark, texts, **kw):
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS blocks")
    return {r.doc_id: r for r in scan_licenses(docs, **kw).collect()}


def test_licenses(spark, docs, empty):
    texts = [(i, f"before\n{t}\nafter") for i, t in enumerate(TEMPLATES.values())]
    texts += [(100, "Licensed under the Apache License, Version 1.1."), (101, "a licence to spy")]
    found = scanned(spark, texts)
    for i, name in enumerate(TEMPLATES):
        assert (found[i].license, found[i].exact) == (name, True)
    assert (found[100].license, found[100].exact) == ("Apache-2.0", False)
    assert found[100].changes == ["2.0>1.1"] and found[101].license is None
    assert {r.license for r in scan_licenses(docs).collect()} == {None}
    assert scan_licenses(empty).count() == 0


def test_licenses_inside_other_text(spark):
    """All wordings inside prose of their own words, commented and wrapped, are found exactly."""
    rng = random.Random(13)
    known = wordings()
    common = " ".join(t for _, t in known if "SPDX" not in t).split()

    def prose(n):
        plain = [w for w in common if not _CUE.search(w)]
        return " ".join(rng.choice(plain) for _ in range(n))

    texts, want = [], []
    for name, text in known:
        wrapped, line = [], ""
        for word in text.split():
            if len(line) + len(word) > 50:
                wrapped, line = [*wrapped, line], ""
            line += f" {word}"
        marked = "\n".join(f" *{x}" for x in [*wrapped, line])
        for form in (text, f"\n{marked}\n", text.replace("Version", "version")):
            texts.append((len(texts), f"{prose(200)} . {form} . {prose(200)}"))
            want.append(name)
    far = "licence " + "word " * 40_000
    texts.append((len(texts), far + TEMPLATES["MIT"] + " licence" * 5000 + " . " + TEMPLATES["MPL-2.0"]))
    found = scanned(spark, texts)
    for i, name in enumerate(want):
        assert name in found[i].licenses and found[i].exact, (texts[i], found[i])
    assert found[len(want)].licenses == ["MIT", "MPL-2.0"]
    notices = {
        0: "Copyright 2021 The Example Authors and Contributors of the Project. All rights reserved.",
        1: "Two people wrote it in a long winter and it is, as the readme says, useful. Released under"
        " the MIT License.",
        2: "# SPDX-License-Identifier: Apache-2.0\nimport x",
        3: "# SPDX-License-Identifier: Apache-1.1\nimport x",
        4: LONG_TEMPLATES["ISC"].replace("without fee", "without a small fee"),
        5: "",
    }
    got = scanned(spark, [*notices.items(), (6, None), (None, TEMPLATES["MIT"])])
    names = ["All rights reserved", "MIT", "Apache-2.0", None, "ISC", None, None]
    assert [got[i].license for i in range(7)] == names and got[None].license == "MIT"
    assert not got[4].exact and got[4].changes == [">a small"]
    assert [got[i].blocks for i in (5, 6)] == [0, 0] and got[6].exact is None
    own = scanned(spark, [(1, notices[1])], templates={"own": "as the readme licence says"})[1]
    assert (own.license, own.exact, own.changes) == ("own", False, ["licence>"])


def test_line_dedup(spark, docs, rows, empty):
    rng = random.Random(5)
    block = "\n".join(" ".join(words(rng, 6)) for _ in range(30))
    texts = [(i, "\n".join([" ".join(words(rng, 6)) for _ in range(i + 1)] + [block, "end"])) for i in range(4)]
    found = dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), Store(spark))
    got = {r.doc_id: r for r in found.collect()}
    assert got[0].text == texts[0][1] and got[0].removed_chunks == 0
    for i in (1, 2, 3):
        lost = len(texts[i][1].splitlines()) - len(got[i].text.splitlines())
        assert lost == got[i].removed_lines > 15
        assert got[i].text.splitlines()[0] == texts[i][1].splitlines()[0]
    all_of_it = dedup_lines(docs, Store(spark)).collect()
    assert len(all_of_it) == len(rows)
    assert sum(r.text is None for r in all_of_it) == sum(r[1] is None for r in rows)
    assert dedup_lines(empty, Store(spark)).count() == 0


def test_line_dedup_cuts_every_repeated_run(spark):
    rng = random.Random(8)
    fresh = lambda n: [" ".join(words(rng, 6)) for _ in range(n)]
    lines = []
    for n in range(2, 7):
        for _ in range(6):
            passage = fresh(n)
            lines += [fresh(2) + passage + fresh(3), fresh(1) + passage + fresh(1), fresh(1) + passage]
    lines += [["a"] * 3, ["b"] * 5, [""] * 4, ["q", "", "", ""], ["only line"], ["only line"], ["x", "only line", "y"]]
    texts = [(2**60 + i, "\n".join(own)) for i, own in enumerate(lines)]
    texts += [(None, texts[0][1] + "\n"), (None, "é\nü\n\n"), (2**60 + 500, "")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    seen, want = {}, {}
    for doc_id, text in sorted(texts, key=lambda t: (t[0] is None, t[0] or 0)):
        own = text.removesuffix("\n").split("\n") if text else []
        gone = set()
        for k in range(max(len(own) - 1, min(1, len(own)))):
            run = tuple(own[k : k + 2])
            *doc, first_k = seen.setdefault(run, (doc_id, text, k))
            if doc != [doc_id, text] or k >= first_k + len(run):
                gone |= set(range(k, k + len(run)))
        left = "\n".join(x for k, x in enumerate(own) if k not in gone)
        want[doc_id, text.count("é")] = (left, len(gone))
    got = dedup_lines(table, Store(spark)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.text.removesuffix("\n"), r.removed_lines) == want[r.doc_id, r.text.count("é")]
    few = repeated_runs(table, Store(spark), bits=3).collect()
    assert Counter(few) == Counter(repeated_runs(table, Store(spark)).collect())


def test_line_chunks_resist_shifts(spark):
    """Chunks partition a text, have two lines or more, and are cut alike inside a moved passage."""
    rng = random.Random(12)
    fresh = lambda n: [" ".join(words(rng, 6)) for _ in range(n)]
    passage = fresh(40)
    texts = ["\n".join(fresh(n) + passage + fresh(3)) for n in (0, 1, 2, 7)] + ["one", "", "a\nb\nc"]
    (b,) = buffers(texts)
    text, start, size, cut, line, lines, chunk, _ = line_runs(b)
    found = []
    for i, t in enumerate(texts):
        whole, own = t.split("\n") if t else [], (text == i) & (chunk == -1)
        assert lines[own].sum() == len(whole) and cut[own].sum() == len(t.encode())
        assert all(n >= min(2, len(whole)) for n in lines[own])
        places = sorted(zip(line[own], lines[own], strict=True))
        found.append({tuple(whole[k : k + n]) for k, n in places})
        inside = Counter(chunk[(text == i) & (chunk >= 0)])
        assert inside == {start[j]: lines[j] - 1 for j in np.flatnonzero(own) if lines[j] > 1}
    # A pair of lines is a chunk's or lies across a boundary, so all pairs are there.
    assert sum(chunk != -1) == sum(max(0, len(t.split("\n")) - 1) for t in texts)
    common = set.intersection(*found[:4])
    assert sum(map(len, common)) >= 30 and all(set(c) <= set(passage) for c in common)


def labelled(spark, positive, negative, label, n=600):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        texts.append((i, (positive if y else negative)(rng), "en"))
        labels.append(Row(doc_id=i, **{label: y}))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels)


def test_toxicity(spark, docs, rows, empty):
    def clean(rng):
        return " ".join(words(rng, 25))

    def bad(rng):
        w = words(rng, 25)
        w[rng.randrange(25)] = rng.choice(["vileword", "vilewords", "nastything"])
        return " ".join(w)

    texts, labels = labelled(spark, bad, clean, "toxic", 3000)
    model = toxicity.fit_toxicity(texts, labels, f"NOT ({toxicity.HELD_OUT})")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [
        r
        for r in toxicity.score_toxicity(texts, model).collect()
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    ]
    right = sum((r.score >= r.threshold) == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.9
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(texts, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_thresholds_follow_the_true_share(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = np.repeat([1, 0], [50, 50])
    scores = np.concatenate([rng.normal(0.6, 0.15, 50), rng.normal(0.4, 0.15, 50)])
    times = np.where(y == 1, 1, 8)
    repeated = toxicity.best_threshold(
        np.repeat(scores, times), np.repeat(y, times), np.ones(times.sum())
    )
    assert toxicity.best_threshold(scores, y, times) == repeated
    assert repeated > toxicity.best_threshold(scores, y, np.ones(100))

    def either(rng):
        return " ".join(words(rng, 8))

    texts, labels = labelled(spark, either, either, "toxic", 2000)
    counts = Counter(r.toxic for r in labels.collect())
    given = []

    def spy(scores, y, weight):
        given.append((y, weight))
        return 0.5

    monkeypatch.setattr(toxicity, "PER_CLASS", 400)
    monkeypatch.setattr(toxicity, "best_threshold", spy)
    toxicity.fit_toxicity(texts, labels)
    assert len(given) == 2
    for y, weight in given:
        for c in (0, 1):
            assert set(weight[y == c]) == {counts[c] / 400}


@pytest.mark.parametrize("texts_in_shard", [700, 1 << 13])
def test_toxicity_learns_from_every_label(spark, monkeypatch, texts_in_shard):
    """Each of many toxic words is in few texts, so that a part of the labels would not do."""
    vile = [hashlib.md5(b"%d" % i).hexdigest()[:9] for i in range(40)]

    def clean(rng):
        return " ".join(words(rng, 25))

    def bad(rng):
        return f"{clean(rng)} {rng.choice(vile)} {clean(rng)}"

    monkeypatch.setattr(toxicity, "PER_CLASS", 100)
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", texts_in_shard, raising=False)
    texts, labels = labelled(spark, bad, clean, "toxic", 3000)
    model = toxicity.fit_toxicity(texts, labels, f"NOT ({toxicity.HELD_OUT})")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [
        r
        for r in toxicity.score_toxicity(texts, model).collect()
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    ]
    assert sum((r.score >= r.threshold) == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_toxicity_learns_from_long_texts(spark):
    def clean(rng):
        return " ".join(words(rng, 9000))

    def bad(rng):
        return f"{clean(rng)} vileword"

    texts, labels = labelled(spark, bad, clean, "toxic", 90)
    assert texts.selectExpr("min(length(text)) AS n").first().n > 1 << 15
    model = toxicity.fit_toxicity(texts, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(texts, model).collect()}
    assert min(s for d, s in scores.items() if truth[d]) > max(
        s for d, s in scores.items() if not truth[d]
    )


def test_ranks_of_scores_are_exact(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_CLASS", 50)
    monkeypatch.setattr(toxicity, "SORTED", 64)
    rng = random.Random(6)
    made = [
        (rng.choice(["en", "de", None]), int(rng.random() < 0.2), round(rng.random(), 2))
        for _ in range(700)
    ]
    found = toxicity._ranked(
        spark.createDataFrame(made, "lang string, y int, score double"), Store(spark)
    )
    for whole, lang in ((True, ""), (False, "en"), (False, "de")):
        for y in (0, 1):
            own = sorted(s for at, c, s in made if c == y and (whole or at == lang))
            n, m = len(own), min(len(own), 50)
            rows = found.query("whole == @whole and lang == @lang and y == @y")
            assert set(rows["n"]) == {n}
            even = rows[rows["even"]]["score"]
            assert sorted(even) == [own[(2 * i + 1) * n // (2 * m)] for i in range(m)]
            assert list(rows[rows["safe"]]["score"]) == ([] if y else [own[n - 1 - n // 100]])


def test_quality(spark, docs, rows, empty):
    def good(rng):
        return " ".join(words(rng, 40)) + "."

    def poor(rng):
        return "!! ".join(words(rng, 40)).upper()

    texts, labels = labelled(spark, good, poor, "quality")
    model = quality.fit_quality(texts, labels, f"NOT ({quality.HELD_OUT})")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [
        r
        for r in quality.score_quality(texts, model).collect()
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    ]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.97
    x = quality.measure([r[1] for r in rows])
    by_hand = [
        model.base
        + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        for row in x
    ]
    pairs = model.logit(x) - by_hand
    assert len(model.pairs) == quality.PAIRS and np.abs(pairs).max() < 20
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(empty, model).count() == 0
    none = quality.fit_quality(texts, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_settling_is_one_count(spark, tmp_path):
    """A settled table is judged by one grouping; more jobs and plans only fill the driver."""
    stars = spark.createDataFrame([(i, i % 5) for i in range(5, 200)], "hi long, lo long")
    stars.repartition(8).write.parquet(str(tmp_path / "stars"))
    context, settled = spark.sparkContext, components._settled
    context.setJobGroup("settling", "")
    try:
        assert settled(spark.read.parquet(str(tmp_path / "stars")))
        jobs = context.statusTracker().getJobIdsForGroup("settling")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4
    for loose in [(3, 2), (4, 3)], [(4, 2), (4, 3)]:
        assert not settled(spark.createDataFrame(loose, "hi long, lo long"))


def test_search_takes_few_jobs(spark, tmp_path):
    """Near duplicates of few texts take a bounded number of jobs, whose plans fill the driver."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, 60)) for _ in range(40)]
    rows = [(i, texts[i % 40] + (f" w{i}" if i % 3 else "")) for i in range(120)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    context = spark.sparkContext
    context.setJobGroup("searching", "")
    try:
        found = near_duplicates(spark.read.parquet(path), Store(spark)).collect()
        jobs = context.statusTracker().getJobIdsForGroup("searching")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.doc_id: r.component_id for r in found} == {i: i % 40 for i in range(120)}
    assert len(jobs) <= 66


def test_search_with_nameless_classes(spark):
    """A class none of whose rows has an id links others, beside classes that have one."""
    rng = random.Random(8)
    long = " ".join(words(rng, 60))
    rows = [(None, long), (None, long), (4, long + " one"), (9, long + " one two"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, Store(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [
        (0, 4), (0, 4), (4, 4), (5, 5), (9, 4)
    ]
