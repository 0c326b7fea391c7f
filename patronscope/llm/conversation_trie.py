"""A prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns, known by a digest that chains the digests of its
turns. Peeling starts at the deepest node that may be shared and goes up one turn at a time:
conversations that end at a depth are merged with the nodes that survived from below, which gives
that depth's nodes with all their figures; then every node loses its last turn and what is left is
grouped again. Equal conversations are one class from the start, and the tail that a class has to
itself is a plain chain that needs no grouping, so the number of steps follows the depth to which
different conversations agree, not the length of the longest one.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store

ROOT = bytes(16)
DIGEST = 16
# Ids that are joined to one text before they go to the task that digests a node's ids.
IDS = 256

CHAIN = "conv_id long, depth long, node binary, above binary, chars long, chars_so_far long, is_end boolean"


def digest_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): every turn in order, with what the trie needs of it.

    Turns are ordered by ``turn``, null first; rows of one turn by the digest of role and text, and
    repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id
    belong to no conversation and are left out. ``chars`` counts code points of the whole text.
    """
    digested = conversations.filter("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS LONG) AS conv_id",
        "turn",
        "substring(unhex(sha2(concat(length(coalesce(role, '')), ':', coalesce(role, ''),"
        f" coalesce(text, '')), 256)), 1, {DIGEST}) AS digest",
        "CAST(length(coalesce(text, '')) AS LONG) AS chars",
    )
    order = "PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, digest"
    return digested.selectExpr(
        "conv_id", f"CAST(row_number() OVER ({order}) - 1 AS LONG) AS place", "digest", "chars"
    )


def _chain(batches):
    """Rows sorted by conversation and place; place -1 is the conversation itself, without a turn.

    A row goes out when the next one tells whether the conversation ends; memory doesn't grow with
    its length.
    """
    waiting = None
    for rows in batches:
        out = []
        columns = (rows[c].tolist() for c in ("conv_id", "place", "digest", "chars"))
        for conv, place, digest, chars in zip(*columns, strict=True):
            if waiting is None or waiting[0] != conv:
                if waiting is not None:
                    out.append((*waiting, True))
                waiting = (conv, 0, ROOT, None, 0, 0)
                if place < 0:
                    continue
            out.append((*waiting, False))
            node = hashlib.sha256(waiting[2] + digest).digest()[:DIGEST]
            waiting = (conv, waiting[1] + 1, node, waiting[2], chars, waiting[5] + chars)
        if out:
            yield pd.DataFrame(out, columns=_CHAIN_NAMES)
    if waiting is not None:
        yield pd.DataFrame([(*waiting, True)], columns=_CHAIN_NAMES)


_CHAIN_NAMES = ["conv_id", "depth", "node", "above", "chars", "chars_so_far", "is_end"]


def _joined_ids(batches):
    """Up to ``IDS`` ids of one node in one text, from rows sorted by node and id."""
    node, first, ids = None, None, []
    for rows in batches:
        out = []
        for key, conv in zip(rows["node"].tolist(), rows["conv_id"].tolist(), strict=True):
            if key != node or len(ids) == IDS:
                if ids:
                    out.append((node, first, ",".join(map(str, ids))))
                node, first, ids = key, conv, []
            ids.append(conv)
        if out:
            yield pd.DataFrame(out, columns=["node", "first", "ids"])
    if ids:
        yield pd.DataFrame([(node, first, ",".join(map(str, ids)))], columns=["node", "first", "ids"])


def _digested_ids(batches):
    """SHA-256 of each node's ids, read piece by piece in order."""
    node, state = None, None
    for rows in batches:
        out = []
        for key, ids in zip(rows["node"].tolist(), rows["ids"].tolist(), strict=True):
            if key != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at a node.

    A digest reads its ids one after the other, so a node's ids must reach one task in the end; they
    arrive as few joined texts and are never held together. Ids are sorted across tasks before.
    """
    pieces = (
        ends.select("node", "conv_id")
        .repartitionByRange("node", "conv_id")
        .sortWithinPartitions("node", "conv_id")
        .mapInPandas(_joined_ids, "node binary, first long, ids string")
    )
    return (
        pieces.repartition("node")
        .sortWithinPartitions("node", "first")
        .mapInPandas(_digested_ids, "node binary, ends_sha256 string")
    )


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _entries(chain: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(entries, tails): the classes as they come into the peeling, and nodes below that.

    A class comes in at the least depth 1, 2, 4, ... at which no other class shares its node, as a
    node with the figures of its whole tail, or at its end if there is none.
    """
    ends = chain.filter("is_end")
    classes = ends.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("members"),
        F.first("depth").alias("turns"),
        F.first("chars_so_far").alias("chars_in_all"),
    )
    classes = store.save(classes.join(_ends_digests(ends), "node").drop("node"), "classes")
    rows = chain.drop("is_end").join(classes, "conv_id")
    probes = rows.filter("depth > 0 AND depth & (depth - 1) = 0")
    alone = (
        probes.groupBy("node")
        .agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"))
        .filter("n = 1")
        .groupBy("conv_id")
        .agg(F.min("depth").alias("alone_from"))
    )
    rows = store.save(rows.join(alone, "conv_id", "left"), "paths")
    tail = (
        "members AS n_convs",
        "IF(depth < turns, 1L, 0L) AS n_children",
        "1L AS n_leaves",
        # A node of the tail saves its own turn and all turns after it.
        "(members - 1) * (chars_in_all - chars_so_far + chars) AS saved_tokens",
        f"IF(depth = turns, ends_sha256, '{_NO_ENDS}') AS ends_sha256",
    )
    tails = rows.filter("depth > alone_from").selectExpr(
        "conv_id", "conv_id AS parent_conv_id", "depth", *tail
    )
    paths = (
        rows.filter("depth <= coalesce(alone_from, turns)")
        .groupBy("conv_id")
        .agg(
            F.expr(
                "array_sort(collect_list(named_struct('depth', depth, 'node', node, 'chars', chars,"
                " 'so_far', chars_so_far))) AS path"
            ),
            *(F.first(c).alias(c) for c in ("members", "turns", "chars_in_all", "ends_sha256")),
            F.first(F.expr("alone_from IS NOT NULL")).alias("is_alone"),
        )
        .withColumn("top", F.expr("element_at(path, -1)"))
        .selectExpr(
            "* EXCEPT (top)", "top.node", "top.depth", "top.chars", "top.so_far AS chars_so_far"
        )
    )
    figures = ("n_leaves", "saved_tokens", "n_children")
    entries = (
        paths.selectExpr("node", "path", "conv_id", "depth", "is_alone", *tail)
        .withColumns({c: F.expr(f"IF(is_alone, {c}, 0L)") for c in figures})
    )
    return entries, tails


_KEPT = (
    "node", "path", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def _strip(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn: the figures they add to what is left of them."""
    return nodes.selectExpr(
        "element_at(path, -2).node AS node", "slice(path, 1, size(path) - 1) AS path", "conv_id",
        "depth - 1 AS depth", "n_convs", "1L AS n_children", "n_leaves", "saved_tokens",
        f"'{_NO_ENDS}' AS ends_sha256",
    )


def _regroup(rows: DataFrame) -> DataFrame:
    """One row for each node, of conversations that end there and of nodes stripped to it."""
    met = rows.groupBy("node").agg(
        F.first("path").alias("path"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max(F.expr(f"nullif(ends_sha256, '{_NO_ENDS}')")).alias("ends_sha256"),
    )
    return met.withColumns(
        {
            "n_leaves": F.expr("IF(n_children = 0, 1L, n_leaves)"),
            "saved_tokens": F.expr("saved_tokens + (n_convs - 1) * element_at(path, -1).chars"),
            "ends_sha256": F.expr(f"coalesce(ends_sha256, '{_NO_ENDS}')"),
        }
    )


def trie_of_turns(turns: DataFrame, conversations: DataFrame, store: Store) -> DataFrame:
    """The nodes of the trie, as ``conversation_trie`` returns them.

    ``turns`` is as ``digest_turns`` returns it, ``conversations`` has the conv_id (distinct) of
    every conversation, also of those without turns.
    """
    marks = conversations.selectExpr(
        "conv_id", "-1L AS place", "CAST(NULL AS BINARY) AS digest", "0L AS chars"
    )
    chain = store.save(
        turns.select("conv_id", "place", "digest", "chars")
        .unionByName(marks)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
        .mapInPandas(_chain, CHAIN),
        "chain",
    )
    entries, tails = _entries(chain, store)
    entries = store.save(entries, "entries")
    deepest = entries.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = -1
    levels, below = [], None
    for depth in range(deepest, -1, -1):
        here = entries.filter(F.col("depth") == depth)
        ended = here.filter("NOT is_alone").select(*_KEPT)
        merged = _regroup(ended if below is None else ended.unionByName(_strip(below)))
        alone = here.filter("is_alone").select(*_KEPT)
        below = store.save(merged.select(*_KEPT).unionByName(alone), f"depth-{depth}")
        levels.append(below.selectExpr(*_KEPT, "element_at(path, -2).node AS above") if depth else
                      below.selectExpr(*_KEPT, "CAST(NULL AS BINARY) AS above"))
    if not levels:
        return tails.select(*RESULT)
    nodes = levels[0].drop("path")
    for more in levels[1:]:
        nodes = nodes.unionByName(more.drop("path"))
    parents = nodes.filter("n_children > 0").selectExpr("node AS above", "conv_id AS parent_conv_id")
    return (
        nodes.join(parents, "above", "left")
        .select(*RESULT)
        .unionByName(tails.select(*RESULT))
    )


RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def conversation_trie(conversations: DataFrame, store: Store) -> DataFrame:
    """One row for each distinct sequence of first turns of ``conversations``.

    ``conversations`` has conv_id, turn, role and text; other columns aren't read. Columns:
    ``conv_id`` the smallest member, ``depth`` the number of turns (0: the root, which all share),
    ``parent_conv_id`` the parent's conv_id (null for the root), ``n_convs`` the members,
    ``n_children``, ``n_leaves`` nodes without children in its subtree, ``saved_tokens`` the code
    points that storing each node of the subtree once saves, ``ends_sha256`` the digest of the ids
    that end at the node. See ``digest_turns`` for nulls, ties and repeated rows. An empty table has
    no nodes. Empty and very long texts count like others: only their digest and length move.
    Steps follow the depth to which different conversations agree, each a small job.
    """
    turns = digest_turns(conversations)
    return trie_of_turns(turns, turns.select("conv_id").distinct(), store)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of every conversation c after its first h are replaced by those of c - c % 100.

    h is the unsigned crc32 of the decimal id, modulo 6.
    """
    cut = "crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 6"
    own = turns.filter(f"place >= {cut}")
    heads = turns.filter("conv_id % 100 = 0 AND place < 5").withColumnRenamed("conv_id", "base")
    borrowed = (
        turns.select("conv_id")
        .distinct()
        .selectExpr("conv_id", "conv_id - conv_id % 100 AS base", f"{cut} AS h")
        .join(heads, "base")
        .filter("place < h")
    )
    return own.unionByName(borrowed.select(*own.columns))


def op11_conversation_trie(spark, folder: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its hundred's first."""
    store = Store(spark)
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    turns = store.save(digest_turns(conversations), "turns")
    return trie_of_turns(rebuilt(turns), turns.select("conv_id").distinct(), store)
