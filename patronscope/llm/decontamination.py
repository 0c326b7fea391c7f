"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed slots; what is left of a text is its template. Windows of
template words of the benchmark are hash-joined with those of all documents, so a question is found
again when its figures and names were replaced. Matched windows then have to agree on the slots: one
value of the benchmark item must always have become the same value in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronscope.llm.shared import SENDABLE_ROWS, Store, rows_with_keys

WINDOW = 8
# A window of the benchmark counts if at least so many of its words aren't slots.
LITERALS = 4
# A document is contaminated by an item if so many of its windows are found, or all of fewer.
LEAST_WINDOWS, LEAST_SHARE = 3, 0.1
# Words of a short item that make a literal copy of it no accident.
LEAST_PLAIN = 4
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "tonne", "tonnes", "oz", "lb", "lbs", "pound", "pounds",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "degree", "degrees", "dollar", "dollars", "euro", "euros", "cent", "cents",
    "mph", "kmh", "hz", "khz", "mhz", "w", "kw", "v", "kb", "mb", "gb",
)
NUMBER, UNIT, NAME = 1, 2, 3
# Stand for a point inside a number and before a name while a text is cut into words.
_POINT, _NAME = "\x04", "\x03"


def raw_words(text: Column) -> Column:
    """Lower-case words of a text; a name starts with a mark, inner points of numbers are kept.

    A name is a capitalised word that follows a lower-case letter or comma and one blank, so not
    one that starts a sentence.
    """
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[.,:/](?=\d)", _POINT)
    named = F.regexp_replace(kept, r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", _NAME + "$1")
    return F.filter(F.split(F.lower(named), r"[\s\p{Punct}]+"), lambda w: w != "")


def template(words: str) -> str:
    """SQL: for each word its type of slot (1 to 3), or a hash of the word itself."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""transform({words}, (w, i) -> CASE
        WHEN ascii(w) BETWEEN 48 AND 57 THEN {NUMBER}L
        WHEN ascii(w) = 3 THEN {NAME}L
        WHEN w IN ({units}) AND i > 0 AND ascii(get({words}, i - 1)) BETWEEN 48 AND 57 THEN {UNIT}L
        ELSE xxhash64(w) END)"""


def _paired(column: str, step: int) -> str:
    """SQL: hashes of each entry with that ``step`` further on."""
    return (
        f"transform(slice({column}, 1, greatest(size({column}) - {step}, 0)),"
        f" (x, i) -> xxhash64(x, get({column}, i + {step})))"
    )


def windows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, window): a hash for each window of eight template words; place counts from 0."""
    return (
        texts.select(*keys, raw_words(F.col("text")).alias("words"))
        .select(*keys, F.expr(template("words")).alias("one"))
        .select(*keys, F.expr(_paired("one", 1)).alias("two"))
        .select(*keys, F.expr(_paired("two", 2)).alias("four"))
        .select(*keys, F.expr(_paired("four", 4)).alias("eight"))
        # Outer, as for the inner form Spark filters by the array's size before it is computed.
        .select(*keys, F.posexplode_outer("eight").alias("place", "window"))
        .filter("window IS NOT NULL")
    )


def benchmark_windows(benchmark: DataFrame, store: Store) -> DataFrame:
    """(window, item_id, item_place, item_windows, item_words) of usable windows, each once."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", "text")
    words = items.select("item_id", raw_words(F.col("text")).alias("words"))
    usable = (
        windows(items, ["item_id"])
        .join(words, "item_id")
        .withColumn("item_words", F.expr(f"slice(words, place + 1, {WINDOW})"))
        .filter(
            f"size(filter({template('item_words')}, x -> x NOT IN (1, 2, 3))) >= {LITERALS}"
        )
        .selectExpr("window", "item_id", "place AS item_place", "item_words")
    )
    usable = usable.dropDuplicates(["item_id", "window"])
    sizes = usable.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    return store.save(usable.join(sizes, "item_id"), "benchmark-windows")


def plain_windows(texts: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, place, window): a hash for each run of ``length`` words as they are, without slots."""
    hashed = f"""IF(size(words) < {length}, array(), transform(
        sequence(1, greatest(size(words) - {length} + 1, 1)),
        i -> xxhash64(slice(words, i, {length}))))"""
    return (
        texts.select(*keys, raw_words(F.col("text")).alias("words"))
        .select(*keys, F.expr(f"posexplode_outer({hashed}) AS (place, window)"))
        .filter("window IS NOT NULL")
    )


def _plain_matches(
    texts: DataFrame, benchmark: DataFrame, known: DataFrame, store: Store
) -> DataFrame:
    """(doc_id, text_key, item_id, matched, item_windows) for items without usable windows.

    Such an item, short or nearly all slots, is looked for as it is: by its runs of eight words, or
    by all its words if it has fewer, but at least ``LEAST_PLAIN``.
    """
    keys = ["doc_id", "text_key"]
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", "text").join(
        known.select("item_id").distinct(), "item_id", "left_anti"
    )
    sized = store.save(
        items.withColumn("length", F.least(F.size(raw_words(F.col("text"))), F.lit(WINDOW))).filter(
            f"length >= {LEAST_PLAIN}"
        ),
        "plain-items",
    )
    found = None
    # At most as many lengths as there are between the two bounds.
    for (length,) in sorted(sized.select("length").distinct().collect()):
        own = plain_windows(sized.filter(F.col("length") == length), ["item_id"], length)
        own = own.select("item_id", "window").distinct()
        few = own.count() <= SENDABLE_ROWS
        met = plain_windows(texts, keys, length).join(F.broadcast(own) if few else own, "window")
        sizes = own.groupBy("item_id").agg(F.count("*").alias("item_windows"))
        counted = met.groupBy(*keys, "item_id").agg(F.countDistinct("window").alias("matched"))
        counted = counted.join(sizes, "item_id").select(*keys, "item_id", "matched", "item_windows")
        found = counted if found is None else found.unionByName(counted)
    return found


def _inconsistent(found: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Matches (text_key, item_id, item_place, place) whose slots contradict the item's usual ones.

    Slots depend on the text alone, so rows that repeat a text count once, with or without an id.
    """
    keys = ["text_key"]
    found = found.select(*keys, "item_id", "item_place", "place").distinct()
    slotted = known.filter(
        f"exists({template('item_words')}, x -> x IN (1, 2, 3))"
    ).select("item_id", "item_place", "item_words")
    matches = found.join(slotted, ["item_id", "item_place"])
    words = rows_with_keys(texts, matches.select(*keys).distinct(), keys).select(
        *keys, raw_words(F.col("text")).alias("words")
    ).dropDuplicates(keys)
    slots = (
        matches.join(words, keys)
        .withColumn("own", F.expr(f"slice(words, place + 1, {WINDOW})"))
        .withColumn("kinds", F.expr(template("item_words")))
        .select(
            *keys, "item_id", "item_place", "place",
            F.expr("inline(arrays_zip(kinds, item_words, own)) AS (kind, was, now)"),
        )
        .filter("kind IN (1, 2, 3)")
    )
    slot = [*keys, "item_id", "kind", "was"]
    counted = slots.groupBy(*slot, "now").agg(F.count("*").alias("n"))
    usual = counted.groupBy(*slot).agg(F.expr("max_by(now, struct(n, now)) AS usual"))
    return (
        slots.join(usual, slot)
        .filter("now <> usual")
        .select(*keys, "item_id", "item_place", "place")
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame:
    """(doc_id, text_key, item_id, matched, item_windows) of contaminated documents.

    ``matched`` counts the item's distinct windows that were found with consistent slots. A pair
    counts from the larger of three windows and a tenth of the item's, or all if it has fewer. An
    item without a window of eight template words of which four are no slots is looked for word by
    word instead (``_plain_matches``); one of fewer than ``LEAST_PLAIN`` words, a null text and an
    item without an id are never found. Whole texts are searched, however long. Rows with a null
    doc_id count under the null id; ``text_key`` is the hash of the text and tells texts of a
    repeated id apart.
    """
    known = benchmark_windows(benchmark, store)
    few = known.count() <= SENDABLE_ROWS
    lookup = known.select("window", "item_id", "item_place")
    texts = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text")
    )
    keys = ["doc_id", "text_key"]
    found = store.save(
        windows(texts, keys).join(F.broadcast(lookup) if few else lookup, "window"), "matches"
    ).drop("window")
    wrong = store.save(_inconsistent(found, texts, known), "wrong")
    right = found.join(wrong, ["text_key", "item_id", "item_place", "place"], "left_anti")
    sizes = known.select("item_id", "item_windows").distinct()
    counted = right.groupBy(*keys, "item_id").agg(F.countDistinct("item_place").alias("matched"))
    counted = counted.join(sizes, "item_id").select(*keys, "item_id", "matched", "item_windows")
    plain = _plain_matches(texts, benchmark, known, store)
    return (counted if plain is None else counted.unionByName(plain)).filter(
        f"matched >= least(item_windows, greatest({LEAST_WINDOWS},"
        f" ceil({LEAST_SHARE}D * item_windows)))"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame:
    """Rows of ``docs`` that no benchmark item contaminates."""
    keys = contaminated(docs, benchmark, store).selectExpr("doc_id AS _id", "text_key AS _key")
    bad = store.save(keys.distinct(), "contaminated")
    few = bad.count() <= SENDABLE_ROWS
    return docs.withColumn("_text_key", F.xxhash64("text")).join(
        F.broadcast(bad) if few else bad,
        F.expr("doc_id <=> _id AND _text_key = _key"),
        "left_anti",
    ).select(*docs.columns)


def op2_decontamination(spark, folder: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item and the windows found."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return contaminated(docs, benchmark, Store(spark)).select(
        "doc_id", "item_id", "matched", "item_windows"
    )
