"""N-gram Jaccard join by T-occurrence search.

Documents with equal shingle sets are one class from the start. Two classes can only be linked if
they share shingles among the first few of each in one common order. Classes first meet the one with
which they share most, which joins large groups at the cost of one search each. What is left is dealt
into cells of an inverted index: classes of different components that share a first shingle meet in
the cell of that shingle's smallest holder. First only these shingles meet there, and a class goes on
if it shares with another one as many as any two linked sets do; then whole sets are searched. Pairs
are never listed: a cell returns classes, then links between components. A search
has inverted lists: of a document's lists the longest, fewer than the required overlap T, are only
probed by binary search; the short rest are merged (DivideSkip).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.components import larger_nodes
from patronscope.llm.shared import SENDABLE_ROWS, Store, parts_for
from patronscope.llm.texthash import shingle_sets, words

SHINGLE = 5
# Similarity as a fraction of whole numbers, so that comparing is exact.
NUMERATOR, DENOMINATOR = 3, 4
# Most frequent shingles that come last in the common order. Only speed depends on it.
FREQUENT = 1 << 19
# A shingle is counted where a task sees it in so many documents of a stretch of about so many
# shingles, which bounds a task's memory. Only speed depends on these.
COUNTED_FROM = 2
STRETCH = 1_000_000
# Documents that are searched in one task.
BLOCK = 1024
# What a binary search in one list costs, for each halving, in steps of a merge.
PROBE_COST = 1.0
# Share of a document's first shingles (one in so many) that makes a first meeting worthwhile.
WORTHWHILE = 5


def _strings(column: pd.Series) -> list[str | None]:
    return [None if pd.isna(t) else t for t in column]


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    data = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(data, dtype=np.int64).tolist())


def _sets(rows: pd.DataFrame):
    """(rows, their sets) for each buffer of texts, so that memory doesn't grow with a batch."""
    for w in words(_strings(rows["text"])):
        yield rows.iloc[w.first : w.last], shingle_sets(w, SHINGLE)


def _repeated(seen: list[np.ndarray]) -> pd.DataFrame:
    tokens, counts = np.unique(np.concatenate(seen), return_counts=True)
    often = counts >= COUNTED_FROM
    return pd.DataFrame(
        {
            "doc_id": pd.Series([None] * int(often.sum()), dtype=object),
            "text_key": 0,
            "n_shingles": counts[often],
            "hi": _signed(tokens[often]),
            "lo": 0,
            "frequent": True,
        }
    )


def _profile(kind: str):
    """Size and digest of each document's set, and what this task has often seen."""

    def run(batches):
        seen, size = [], 0
        for rows, sets in (part for batch in batches for part in _sets(batch)):
            digests = [_digest(s) for s in sets]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "text_key": rows["text_key"],
                    "n_shingles": [len(s) for s in sets],
                    "hi": [d[0] for d in digests],
                    "lo": [d[1] for d in digests],
                    "frequent": False,
                }
            )
            for s in sets:
                seen.append(s)
                size += len(s)
                if size >= STRETCH:
                    yield _repeated(seen)
                    seen, size = [], 0
        if seen:
            yield _repeated(seen)

    return run, (
        f"doc_id {kind}, text_key long, n_shingles long, hi long, lo long, frequent boolean"
    )


def _frequent(counted: DataFrame, store: Store, name: str) -> np.ndarray:
    """Up to ``FREQUENT`` shingles (signed), most frequent first, from the tasks' own counts.

    All with a count above some least one, so neither side has to sort what doesn't fit.
    """
    total = store.save(counted.groupBy("hi").agg(F.sum("n_shingles").alias("n")), name)
    by_count = total.groupBy("n").agg(F.count("*").alias("shingles"))
    running = by_count.selectExpr("n", "sum(shingles) OVER (ORDER BY n DESC) AS so_far")
    least = running.filter(f"so_far <= {FREQUENT}").agg(F.min("n")).first()[0]
    if least is None:
        return np.empty(0, dtype=np.int64)
    rows = total.filter(F.col("n") >= least).select("hi", "n").toArrow()
    hi, n = (rows[c].to_numpy().astype(np.int64) for c in ("hi", "n"))
    return hi[np.lexsort((hi, -n))]


def required(n):
    """Least number of shingles that a set of n shares with any set it is linked to."""
    return -(-n * NUMERATOR // DENOMINATOR)


def _first_shingles(frequent: np.ndarray):
    """(token, key, n) for the shingles of each document that may lead to a link: its first ones.

    The common order is by hash, with the ``frequent`` ones (signed, most frequent first) last.
    """
    known = frequent.view(np.uint64)
    by_value = np.argsort(known)
    ordered = known[by_value]

    def run(batches):
        done = set()  # of the sets in this task: copies add nothing
        for _, sets in (part for batch in batches for part in _sets(batch)):
            tokens, keys, sizes = [], [], []
            for s in sets:
                key = _digest(s)[1]
                if not len(s) or key in done:
                    continue
                done.add(key)
                first = len(s) - required(len(s)) + 1
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                    often = ordered[at] == s
                    rare = s[~often]
                    if len(rare) < first:
                        rest = s[often][np.argsort(-by_value[at[often]])]
                        rare = np.concatenate([rare, rest])
                    s_first = rare[:first]
                else:
                    s_first = s[:first]
                tokens.append(s_first)
                keys.append(np.full(len(s_first), key))
                sizes.append(np.full(len(s_first), len(s), dtype=np.int32))
            if tokens:
                yield pd.DataFrame(
                    {
                        "token": _signed(np.concatenate(tokens)),
                        "key": np.concatenate(keys),
                        "n": np.concatenate(sizes),
                    }
                )

    return run


def _whole_sets(batches):
    for _, sets in (part for batch in batches for part in _sets(batch)):
        digests = [_digest(s) for s in sets]
        yield pd.DataFrame(
            {
                "key": [d[1] for d in digests],
                "tokens": [s.tobytes() for s in sets],
            }
        )


class TOccurrence:
    """Inverted lists of sets, searched with DivideSkip.

    Sets are ascending arrays of hashes. ``labels`` holds a component label for each set; a search
    stops looking at members of components that the query has already joined.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=self.m)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.vocabulary, ids = np.unique(tokens, return_inverse=True)
        owners = np.repeat(np.arange(self.m), self.sizes)
        # One ascending array of list * m + member: both the lists and what probes search.
        self.entries = np.sort(ids * max(1, self.m) + owners)
        self.start = np.searchsorted(
            self.entries, np.arange(len(self.vocabulary) + 1) * max(1, self.m)
        )

    def search(self, query: np.ndarray, below: int, own: int, labels: np.ndarray) -> list[int]:
        """Members before place ``below`` that are linked to ``query``: one for each component.

        Members whose label equals that at place ``own`` (-1: none) aren't looked at.
        """
        n = len(query)
        need = required(n)
        at = np.searchsorted(self.vocabulary, query)
        at = at[at < len(self.vocabulary)]
        lists = at[self.vocabulary[at] == query[: len(at)]] if len(at) else at
        if len(lists) < need:
            return []
        length = self.start[lists + 1] - self.start[lists]
        lists = lists[np.argsort(length, kind="stable")]
        # The longer the lists, the more a probe costs against a step of the merge.
        n_long = min(need - 1, int(need / (PROBE_COST * np.log2(length.max()) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.concatenate([self.entries[self.start[k] : self.start[k + 1]] for k in short])
        counts = np.bincount(merged % self.m, minlength=self.m)[:below]
        # What a linked member shares beyond the long lists.
        cand = np.flatnonzero(counts >= need - n_long)
        size = self.sizes[cand]
        fits = (size * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= size * NUMERATOR)
        if own >= 0:
            fits &= labels[cand] != labels[own]
        cand = cand[fits]
        cand = cand[np.argsort(-counts[cand], kind="stable")]
        found: list[int] = []
        # First one of each component; then all members of those that it didn't settle.
        picks = np.sort(np.unique(labels[cand], return_index=True)[1])
        for members in (cand[picks], np.delete(cand, picks)):
            members = members[~np.isin(labels[members], labels[found])] if found else members
            if not len(members):
                continue
            probe = long[:, None] * self.m + members
            place = np.minimum(np.searchsorted(self.entries, probe), len(self.entries) - 1)
            overlap = counts[members] + (self.entries[place] == probe).sum(axis=0)
            union = n + self.sizes[members] - overlap
            linked = members[overlap * DENOMINATOR >= union * NUMERATOR]
            found += linked[np.unique(labels[linked], return_index=True)[1]].tolist()
        return found


def link_cell(components: list, sets: list[np.ndarray], side: np.ndarray) -> list[tuple]:
    """(component, smallest one linked to it): sets of side 1 are searched among those of side 0.

    ``components`` gives the component that each set is known to be in; these are not searched.
    """
    hubs = np.flatnonzero(side == 0)
    order = np.append(hubs, np.flatnonzero(side == 1))
    known, labels = np.unique(np.array(components, dtype=np.int64)[order], return_inverse=True)
    first = labels.copy()
    index = TOccurrence([sets[i] for i in hubs])
    for i in range(len(hubs), len(order)):
        for other in index.search(sets[order[i]], len(hubs), i, labels):
            if labels[other] != labels[i]:
                labels[labels == labels[other]] = labels[i]
    # Of the known components, ascending, the first to carry a label is its smallest.
    after = np.empty(len(known), dtype=np.int64)
    after[first] = labels
    _, smallest, of = np.unique(after, return_index=True, return_inverse=True)
    lowest = known[smallest][of]
    return [(c, low) for c, low in zip(known.tolist(), lowest.tolist()) if c != low]


def link_members(components: list, sets: list[np.ndarray], cells: list) -> list[tuple]:
    """(component, smallest one linked to it): sets are searched among those of their cells.

    Members of one cell are indexed together; each is searched among those before it.
    """
    known, labels = np.unique(np.array(components, dtype=np.int64), return_inverse=True)
    members: dict = {}
    for i, own in enumerate(cells):
        for cell in own:
            members.setdefault(cell, []).append(i)
    for places in members.values():
        at = np.array(places)
        if len(np.unique(labels[at])) < 2:
            continue
        index = TOccurrence([sets[i] for i in places])
        for i, place in enumerate(places):
            for other in index.search(sets[place], i, i, labels[at]):
                if labels[at[other]] != labels[place]:
                    labels[labels == labels[at[other]]] = labels[place]
    # Each component with the smallest of those that carry its label now.
    of = dict(zip(components, labels.tolist(), strict=True))
    lowest: dict = {}
    for c in known.tolist():
        lowest[of[c]] = min(c, lowest.get(of[c], c))
    return [(c, lowest[of[c]]) for c in known.tolist() if lowest[of[c]] != c]


def _search_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates(["key", "side"])
    sets = [np.frombuffer(b, dtype=np.uint64) for b in rows["tokens"]]
    edges = link_cell(rows["component"].tolist(), sets, rows["side"].to_numpy())
    return pd.DataFrame(edges, columns=["a", "b"])


def _search_cells(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates(["key"])
    sets = [np.frombuffer(b, dtype=np.uint64) for b in rows["tokens"]]
    edges = link_members(rows["component"].tolist(), sets, rows["cells"].tolist())
    return pd.DataFrame(edges, columns=["a", "b"])


def _sets_of(
    keys: DataFrame, few: bool, texts: DataFrame, owners: DataFrame, nameless: bool, store: Store,
    name: str,
):
    """(key, tokens) of the classes in ``keys`` (``few``: sendable), each from the text of one row.

    ``nameless`` tells whether ``owners`` has any without an id.
    """
    wanted = store.save(
        owners.join(keys.distinct(), "key", "left_semi").selectExpr(
            "doc_id AS _id", "text_key AS _key"
        ),
        f"{name}-wanted",
    )
    rows = texts.join(
        F.broadcast(wanted) if few else wanted,
        F.expr("text_key = _key AND doc_id <=> _id"),
        "left_semi",
    )
    if nameless:
        # Rows without an id that repeat a text.
        rows = rows.filter("doc_id IS NOT NULL").unionByName(
            texts.filter("doc_id IS NULL")
            .join(wanted.filter("_id IS NULL"), F.expr("text_key = _key"), "left_semi")
            .dropDuplicates(["text_key"])
        )
    return rows.select("text").mapInPandas(_whole_sets, "key long, tokens binary")


def _search(
    pairs: DataFrame, texts: DataFrame, owners: DataFrame, nameless: bool, store: Store, name: str
):
    """Links (a, b) among components that the classes of ``pairs`` (a, hub) are in.

    They join all pairs that are similar enough; ``of_a`` and ``of_hub`` are a pair's components.

    Hubs are spread over tasks, a hub with many partners over several, each with a part of them.
    """
    met = pairs.groupBy("hub").agg(F.expr(f"ceil(count(*) / {BLOCK}D)").alias("chunks"))
    spread = pairs.join(met, "hub").withColumn(
        "chunk", F.expr("pmod(xxhash64(a, 3), chunks)")
    )
    rows = pairs.count()
    groups = parts_for(rows, BLOCK)
    place = f"pmod(xxhash64(hub, chunk), {groups}) AS place"
    placed = spread.selectExpr("*", place).selectExpr(
        "inline(array(struct(a AS key, place AS place, 1 AS side, of_a AS component), "
        "struct(hub AS key, place AS place, 0 AS side, of_hub AS component)))"
    )
    placed = store.save(placed.distinct(), f"{name}-placed")
    # Few places are sent to the sets, so that these move only once; a pair has at most two.
    few = 2 * rows <= SENDABLE_ROWS
    sets = _sets_of(placed.select("key"), few, texts, owners, nameless, store, name)
    return (
        sets.join(F.broadcast(placed) if few else placed, "key")
        .groupBy("place")
        .applyInPandas(_search_group, "a long, b long")
    )


def _first_pairs(entries: DataFrame) -> DataFrame:
    """(a, hub, of_a, of_hub): each class with the leader with which it shares most first shingles."""
    shared = entries.filter("key <> leader").groupBy("key", "n", "leader").count()
    best = shared.groupBy("key", "n").agg(
        F.expr("max_by(leader, struct(count, leader))").alias("hub"), F.max("count").alias("c")
    )
    need = f"ceil(n * {NUMERATOR} / {DENOMINATOR}D)"
    return best.filter(f"c * {WORTHWHILE} >= n - {need} + 1").selectExpr(
        "key AS a", "hub", "key AS of_a", "hub AS of_hub"
    )


def _unsettled(entries: DataFrame, joined: DataFrame, store: Store, name: str) -> DataFrame:
    """Entries, with their class's component, of shingles that different components share."""
    labelled = entries.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.expr("coalesce(component, key)")
    )
    met = labelled.selectExpr(
        "*", "min(component) OVER (PARTITION BY token) AS x",
        "max(component) OVER (PARTITION BY token) AS y",
    )
    return store.save(met.filter("x <> y").drop("x", "y"), name)


def least_first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of first shingles that two linked sets of ``a`` and ``b`` shingles share.

    They share T = 3 (a + b) / 7 shingles or more. In the common order, one of them has its first
    shingles all before the end of the other's; what they share beyond these is at most what that
    set has left, which is 0.75 of it less one.
    """
    both = -(-(a + b) * NUMERATOR // (NUMERATOR + DENOMINATOR))
    return both - required(np.maximum(a, b)) + 1


def meeting(rows: pd.DataFrame) -> pd.DataFrame:
    """(cell, key, component) of the classes that share enough first shingles with another one.

    ``rows`` has of each class its cells and the first shingles that classes of other components
    share. Each class is searched by merging its inverted lists in a cell's index.
    """
    cells: dict = {}
    for i, own in enumerate(rows["cells"]):
        for cell in own:
            cells.setdefault(cell, []).append(i)
    sizes, components = rows["n"].to_numpy(), rows["component"].to_numpy()
    firsts = rows["firsts"].to_numpy()
    found: list[tuple] = []
    for cell, places in cells.items():
        at = np.array(places)
        n, own, m = sizes[at], components[at], len(at)
        if (own == own[0]).all():
            continue
        _, ids = np.unique(np.concatenate(firsts[at]), return_inverse=True)
        counts = np.array([len(firsts[i]) for i in places])
        entries = np.sort(ids * m + np.repeat(np.arange(m), counts))
        starts = np.searchsorted(entries, np.arange(ids.max() + 2) * m)
        met = np.zeros(m, dtype=bool)
        for i, lists in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            merged = np.concatenate([entries[starts[k] : starts[k + 1]] for k in lists])
            shared = np.bincount(merged % m, minlength=m)
            other = np.flatnonzero(shared)
            size = n[other]
            fits = (shared[other] >= least_first(n[i], size)) & (own[other] != own[i])
            fits &= (size * DENOMINATOR >= n[i] * NUMERATOR) & (n[i] * DENOMINATOR >= size * NUMERATOR)
            met[i] = fits.any()
        found += [(cell, places[i]) for i in np.flatnonzero(met)]
    chosen = rows.iloc[[i for _, i in found]]
    return pd.DataFrame(
        {
            "cell": [cell for cell, _ in found],
            "key": chosen["key"].to_numpy(),
            "component": chosen["component"].to_numpy(),
        }
    )


def _cells(rest: DataFrame, store: Store, name: str) -> DataFrame:
    """(cell, key, component): classes that meet in a cell another one they may be linked to.

    ``rest`` has all first shingles that classes of different components share. The cell of such a
    shingle is that of its smallest holder, so any two classes to be linked have a cell in common;
    one of more than ``BLOCK`` classes is cut into parts, of which any two are a cell. Only first
    shingles move here.
    """
    members = store.save(
        rest.selectExpr("key", "n", "component", "min(key) OVER (PARTITION BY token) AS leader")
        .distinct(),
        f"{name}-members",
    )
    parts = members.groupBy("leader").agg(F.expr(f"ceil(count(*) / {BLOCK}D)").alias("parts"))
    groups = parts_for(members.count(), BLOCK)
    placed = (
        members.join(parts, "leader")
        .selectExpr("*", "pmod(xxhash64(key, 5), parts) AS part")
        .selectExpr("*", "explode(sequence(0L, parts - 1)) AS other")
        .selectExpr(
            "key", "n", "component",
            "xxhash64(leader, least(part, other), greatest(part, other)) AS cell",
        )
        .groupBy(F.expr(f"pmod(cell, {groups}) AS place"), "key", "n", "component")
        .agg(F.collect_set("cell").alias("cells"))
    )
    firsts = rest.groupBy("key").agg(F.collect_list("token").alias("firsts"))
    return store.save(
        placed.join(firsts, "key")
        .groupBy("place")
        .applyInPandas(meeting, "cell long, key long, component long"),
        f"{name}-cells",
    )


def _search_open(
    met: DataFrame, texts: DataFrame, owners: DataFrame, nameless: bool, store: Store, name: str
):
    """Links (a, b) among the components that meet in the cells of ``met``."""
    rows = met.count()
    groups = parts_for(rows, BLOCK)
    placed = store.save(
        met.groupBy(F.expr(f"pmod(cell, {groups}) AS place"), "key", "component").agg(
            F.collect_set("cell").alias("cells")
        ),
        f"{name}-placed",
    )
    few = rows <= SENDABLE_ROWS
    sets = _sets_of(placed.select("key"), few, texts, owners, nameless, store, name)
    return (
        sets.join(F.broadcast(placed) if few else placed, "key")
        .groupBy("place")
        .applyInPandas(_search_cells, "a long, b long")
    )


def _meet(texts: DataFrame, often: np.ndarray) -> DataFrame:
    """First shingles (token, key, n) that two classes share, with the smallest key as leader."""
    first = texts.select("text").mapInPandas(
        _first_shingles(often), "token long, key long, n int"
    )
    met = first.selectExpr(
        "*", "min(key) OVER (PARTITION BY token) AS leader",
        "max(key) OVER (PARTITION BY token) AS last",
    )
    return met.filter("leader <> last").drop("last").distinct()


def near_duplicates(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id), one row for each row of ``docs``.

    ``docs`` has doc_id (an integer) and text. Words are runs without blanks, A-Z as a-z. Two
    documents link if their sets of 5-word shingles have a Jaccard similarity of at least 0.75;
    component_id is the smallest id reachable over links, the own id included. Null texts and
    texts without words have no shingles and no links. A null id is never smallest: a row without id
    has its group's smallest id, or null if none there has one, and it links others like any row.
    ``text_key`` is the hash of the text, for joins back to rows whose id is repeated. Whole texts
    count, however long; shingles and sets are known by 64-bit hashes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    run, schema = _profile(kind)
    stored = store.save(texts.mapInPandas(run, schema), "profile")
    profile = stored.filter("NOT frequent").drop("frequent")
    often = _frequent(stored.filter("frequent"), store, "shared")
    entries = store.save(_meet(texts, often), "entries")
    with_words = profile.filter("n_shingles > 0").withColumnRenamed("lo", "key")
    # The text of a class is that of its row with the smallest id, or of any row if none has one.
    classes = store.save(
        with_words.groupBy("key")
        .agg(F.expr("min(struct(doc_id IS NULL AS none, doc_id, text_key)) AS found"))
        .selectExpr("key", "found.doc_id AS rep", "found.text_key"),
        "classes",
    )
    owners = classes.selectExpr("key", "rep AS doc_id", "text_key")
    nameless = owners.filter("doc_id IS NULL").agg(F.count("*")).first()[0] > 0
    pairs = store.save(_first_pairs(entries), "first-pairs")
    links = _search(pairs, texts, owners, nameless, store, "first")
    joined = larger_nodes(links, store, "first")
    rest = _unsettled(entries.select("token", "key", "n"), joined, store, "unsettled")
    links = _search_open(_cells(rest, store, "open"), texts, owners, nameless, store, "open")
    merged = larger_nodes(links, store, "linked").selectExpr(
        "node AS first", "component AS last"
    )
    joined = joined.selectExpr("node AS key", "component AS first")
    of_class = (
        classes.join(joined, "key", "left")
        .selectExpr("key", "rep", "coalesce(first, key) AS first")
        .join(merged, "first", "left")
        .selectExpr("key", "rep", "coalesce(last, first) AS component")
    )
    lowest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = store.save(of_class.join(lowest, "component").select("key", "component_id"), "of")
    without = profile.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "text_key", "n_shingles", "component_id"]
    return with_words.join(of_class, "key").select(*names).unionByName(without.select(*names))


def keep_one_of_each(docs: DataFrame, store: Store) -> DataFrame:
    """Rows of ``docs``, one for each component: that with the smallest id.

    Of rows that repeat an id and its text, one stays; all rows without words stay, once for each
    id. Rows without an id stay unless they repeat a text.
    """
    found = near_duplicates(docs, store)
    kept = found.filter("component_id IS NULL OR doc_id = component_id").selectExpr(
        "doc_id AS kept_id", "text_key AS kept_key"
    ).distinct()
    # The row travels as one column, so none of its names can clash.
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("whole"),
        docs["doc_id"].alias("id"),
        F.xxhash64(docs["text"]).alias("text_key"),
    )
    return (
        whole.join(kept, F.expr("id <=> kept_id AND text_key = kept_key"), "left_semi")
        .withColumn("copy", F.expr("row_number() OVER (PARTITION BY id, text_key ORDER BY id)"))
        .filter("copy = 1")
        .select("whole.*")
    )


def op10_near_duplicates(spark, folder: str) -> DataFrame:
    """Shingle count and component of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs, Store(spark)).select("doc_id", "n_shingles", "component_id")
