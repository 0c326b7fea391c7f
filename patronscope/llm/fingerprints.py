"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs are hashed into the cells of a sketch: three cells each, holding a count and
the exclusive ors of digests and of their checks. The sketches of two versions are subtracted cell
by cell; paragraphs that both have cancel out. A cell left with one digest names a differing
paragraph, whose removal from its other cells lays bare more of them (peeling). If cells remain,
the pair is tried again with four times as many cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import Store

# A paragraph ends with its line, or with the first sentence that ends after so many characters.
PARAGRAPH = r"[^\n]{120,}?[.!?](?=\s)|[^\n]+"
PARTS = 3
# Cells in each of the three parts of the fingerprint, and growth of a retried sketch.
CELLS, GROWTH = 4, 4
# Rounds of peeling in one try, three of which go once over all cells; more than trials needed.
ROUNDS = 15
# A try never has more cells in a part than this; see ``differences``.
MOST_CELLS = 1 << 20
# Ids of documents that are neighbours in one task.
SPAN = 2048


def digests(text: str) -> str:
    """SQL: the distinct hashes of a text's paragraphs. A null or empty text has none."""
    return (
        f"array_distinct(transform(regexp_extract_all(coalesce({text}, ''), r'{PARAGRAPH}', 0),"
        " p -> xxhash64(p)))"
    )


def _cell(digest: str, part: str, cells: int) -> str:
    """SQL: number of a digest's cell in a part (0 to 2) of a sketch."""
    return f"CAST({part} * {cells} + pmod(xxhash64({digest}, {part}, 7), {cells}) AS INT)"


def _check(digest: str) -> str:
    return f"xxhash64({digest}, 'check')"


def sketch(rows: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, cell, n, ids, checks) from rows (keys, digest, sign); empty cells are left out."""
    entries = rows.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS))))).selectExpr(
        *keys, f"{_cell('digest', 'part', cells)} AS cell", "sign", "digest",
        f"{_check('digest')} AS checked",
    )
    return entries.groupBy(*keys, "cell").agg(
        F.sum("sign").alias("n"), F.expr("bit_xor(digest)").alias("ids"),
        F.expr("bit_xor(checked)").alias("checks"),
    ).filter("n <> 0 OR ids <> 0 OR checks <> 0")


def _peel(sketches: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, left, found): cells that remain after peeling, and digests recovered.

    A round peels the lone digests of one part, where each digest has one cell, so none is removed
    twice. Row -1 of a pair counts what was recovered. No round shuffles: rows of a pair stay where
    the first grouping has put them.
    """
    now = sketches.selectExpr(*keys, "cell", "n", "ids", "checks", "0L AS found")
    for turn in range(ROUNDS):
        part = turn % PARTS
        lone = (
            f"cell >= {part * cells} AND cell < {(part + 1) * cells} AND abs(n) = 1"
            f" AND checks = {_check('ids')} AND cell = {_cell('ids', str(part), cells)}"
        )
        gone = ", ".join(
            f"struct({_cell('ids', str(p), cells)} AS cell, -n AS n, ids, checks, 0L AS found)"
            for p in range(PARTS)
            if p != part
        )
        steps = (
            f"IF({lone}, array(struct(-1 AS cell, 0L AS n, 0L AS ids, 0L AS checks, 1L AS found),"
            f" {gone}), array(struct(cell, n, ids, checks, found)))"
        )
        now = (
            now.select(*keys, F.expr(f"explode_outer({steps})").alias("x"))
            .select(*keys, "x.*")
            .groupBy(*keys, "cell")
            .agg(
                F.sum("n").alias("n"), F.expr("bit_xor(ids)").alias("ids"),
                F.expr("bit_xor(checks)").alias("checks"), F.sum("found").alias("found"),
            )
            .filter("cell = -1 OR n <> 0 OR ids <> 0 OR checks <> 0")
        )
    return now.groupBy(*keys).agg(
        F.expr("sum(IF(cell >= 0, 1, 0))").alias("left"), F.sum("found").alias("found")
    )


def differences(pairs: DataFrame, store: Store) -> DataFrame:
    """(place, pair, differing): the number of paragraphs in one of two versions only.

    ``pairs`` has place (rows of one place stay together in a task), pair (unique), and the digest
    arrays ours and theirs. Failed pairs are tried again with ``GROWTH`` times as many cells. A
    sketch of ``MOST_CELLS`` holds any text of some 200 MB; should a pair fail there, its arrays are
    compared directly.
    """
    keys, cells, done = ["place", "pair"], CELLS, []
    waiting = pairs.select(*keys, "ours", "theirs")
    while True:
        both = waiting.select(
            *keys,
            F.expr(
                "explode(concat(transform(ours, d -> struct(d AS digest, 1 AS sign)),"
                " transform(theirs, d -> struct(d AS digest, -1 AS sign))))"
            ).alias("x"),
        ).select(*keys, "x.*")
        tried = store.save(
            _peel(sketch(both.repartition("place"), keys, cells), keys, cells), f"tried-{cells}"
        )
        failed = tried.filter("left > 0").select(*keys)
        done.append(tried.filter("left = 0").selectExpr(*keys, "found AS differing"))
        if failed.isEmpty():
            break
        waiting = store.save(waiting.join(failed, keys, "left_semi"), f"waiting-{cells}")
        cells *= GROWTH
        if cells > MOST_CELLS:
            done.append(
                waiting.selectExpr(
                    *keys,
                    "CAST(size(array_except(ours, theirs)) + size(array_except(theirs, ours))"
                    " AS BIGINT) AS differing",
                )
            )
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def fingerprint(rows: DataFrame, name: str) -> DataFrame:
    """(place, pair, name): the sketch of digests ``ours`` as text, after its paragraph count."""
    entries = rows.select(
        "place", "pair", F.size("ours").alias("size"), F.expr("explode_outer(ours)").alias("digest")
    ).withColumn("sign", F.lit(1))
    keys = ["place", "pair", "size"]
    cells = sketch(entries.filter("digest IS NOT NULL").repartition("place"), keys, CELLS)
    texts = cells.groupBy(*keys).agg(
        F.expr(
            "array_join(transform(array_sort(collect_list(struct(cell, n, ids, checks))), x ->"
            " concat_ws('.', hex(x.cell), hex(x.n), hex(x.ids), substring(hex(x.checks), 1, 4))),"
            " '-')"
        ).alias("cells")
    )
    return texts.selectExpr("place", "pair", f"concat(size, ':', cells) AS {name}")


def _likeness(ours: str, theirs: str, differing: str) -> str:
    """SQL: shared paragraphs among all, from both counts and the number of differing ones."""
    total = f"({ours} + {theirs})"
    return f"IF({total} + {differing} = 0, 1D, ({total} - {differing}) / ({total} + {differing}))"


def with_next_text(docs: DataFrame, store: Store) -> DataFrame:
    """(place, doc_id, text, next_text): each document with the next by descending doc_id.

    Nulls count as the smallest ids and as empty texts; rows of one id follow by their hash. Texts
    move once, in runs of ``SPAN`` ids; only the first row of a run is needed by another run.
    """
    texts = docs.selectExpr(
        "doc_id", "coalesce(text, '') AS text", "xxhash64(text) AS text_key",
        f"coalesce(CAST(floor(doc_id / {SPAN}D) AS BIGINT), {-(1 << 62)}) AS place",
    )
    order = "struct(doc_id, text_key)"
    runs = texts.groupBy("place").agg(F.expr(f"max_by(text, {order})").alias("first_text"))
    runs = store.save(runs, "first-of-runs")
    # One narrow row for each run.
    after = store.save(
        runs.select("place").selectExpr(
            "place",
            "coalesce(lead(place) OVER (ORDER BY place DESC),"
            " first_value(place) OVER (ORDER BY place DESC)) AS next_place",
        ),
        "next-runs",
    )
    following = after.join(
        runs.selectExpr("place AS next_place", "first_text"), "next_place"
    ).select("place", "first_text")
    within = texts.withColumn(
        "_next",
        F.expr(
            "lead(text) OVER (PARTITION BY place ORDER BY doc_id DESC NULLS LAST, text_key DESC)"
        ),
    )
    ends = within.filter("_next IS NULL").join(following, "place").selectExpr(
        "place", "doc_id", "text", "first_text AS next_text"
    )
    inner = within.filter("_next IS NOT NULL").selectExpr(
        "place", "doc_id", "text", "_next AS next_text"
    )
    return inner.unionByName(ends)


def compare_versions(docs: DataFrame, store: Store) -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness.

    The edited version ends in the first characters of the next document instead of its own last
    third. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Two texts without paragraphs are alike (1).
    """
    edited = (
        "concat(left(text, n_chars - CAST(floor(n_chars / 3D) AS INT)),"
        " left(next_text, CAST(floor(n_chars / 3D) AS INT)))"
    )
    rows = (
        with_next_text(docs, store)
        .withColumn("n_chars", F.expr("char_length(text)"))
        .withColumn("edited", F.expr(edited))
        .selectExpr(
            "place", "doc_id", "CAST(n_chars AS BIGINT) AS n_chars",
            "sha2(edited, 256) AS edited_sha256", f"{digests('text')} AS own",
            f"{digests('edited')} AS edited", f"{digests('next_text')} AS next",
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = store.save(rows, "digests")
    pairs = rows.selectExpr("place", "own AS ours", "edited AS theirs", "2 * row AS pair").unionByName(
        rows.selectExpr("place", "own AS ours", "next AS theirs", "2 * row + 1 AS pair")
    )
    found = store.save(differences(pairs, store), "differing")
    own = fingerprint(rows.selectExpr("place", "row AS pair", "own AS ours"), "fingerprint")
    of_edited = fingerprint(
        rows.selectExpr("place", "row AS pair", "edited AS ours"), "edited_fingerprint"
    )
    # Pairs without any paragraph have no cells, so no row to join.
    joined = (
        rows.selectExpr(
            "place", "row", "doc_id", "n_chars", "edited_sha256", "size(own) AS a",
            "size(edited) AS b", "size(next) AS c",
        )
        .join(own.withColumnRenamed("pair", "row"), ["place", "row"], "left")
        .join(of_edited.withColumnRenamed("pair", "row"), ["place", "row"], "left")
        .join(
            found.groupBy("place", F.expr("shiftright(pair, 1)").alias("row")).agg(
                F.expr("sum(IF(pair % 2 = 0, differing, 0))").alias("d1"),
                F.expr("sum(IF(pair % 2 = 1, differing, 0))").alias("d2"),
            ),
            ["place", "row"],
            "left",
        )
        .fillna(0, ["d1", "d2"])
        .fillna("0:", ["fingerprint", "edited_fingerprint"])
    )
    return joined.selectExpr(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        f"{_likeness('a', 'b', 'd1')} AS near_edited", f"{_likeness('a', 'c', 'd2')} AS near_next",
    )


def op4_fingerprints(spark, folder: str) -> DataFrame:
    """Fingerprints and likenesses of all documents."""
    return compare_versions(spark.read.parquet(f"{folder}/documents.parquet"), Store(spark))
