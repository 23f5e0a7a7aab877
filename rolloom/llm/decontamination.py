"""Benchmark decontamination (DataFrame operations only).

Windows of ``width`` words of the benchmark items (shorter items are one window)
form a hash set that travels with the plan, as bits (``columns.BitFilter``: a bounded
size, whatever the number of windows). Every text is scanned by its own window
hashes. Places that pass are verified: the words themselves are compared, by an
equality join with the windows, which are broadcast where they are few; where they are
many, those of hot windows still are (``columns.meet``). Only hits and what passes beside them are
joined, so what is shuffled grows with the hits, at every size of the benchmark. A
word is hit if a verified window covers it.

Defined results: null and empty texts and items have no words; an item without
words has no window and never occurs; repeated items with one id count once;
null item ids are ignored; ids of items may be of any type that can be a string;
repeated rows are judged each; nothing is ranked, so there are no ties; very long
texts are scanned whole; null ids are carried through; empty tables give empty
results or no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.columns import BitFilter, ascii_lower, covered, meet, window_hashes, words
from rolloom.session import materialize, prepare

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13


def _spans(words_col: Column, places: Column, length: int) -> Column:
    """Structs (start, end, gram) of the windows of one length at the places given."""
    return F.transform(places, lambda p: F.struct(p.alias("start"), (p + length).alias("end"), F.array_join(F.slice(words_col, p + 1, length), " ").alias("gram")))


def item_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram, length, h, items: each distinct window of the benchmark with the items that hold it."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS).alias("w"))
    items = materialize(items.withColumn("length", F.least(F.size("w"), F.lit(width))).where("length > 0"))
    parts = []
    for n in sorted(r.length for r in items.select("length").distinct().collect()):
        own = window_hashes(items.where(F.col("length") == n), "w", [n])
        # The outer form: for the other, Spark adds a filter on the array and copies the array's whole definition into it.
        places = own.select("item", "length", "w", F.posexplode_outer(f"h{n}").alias("p", "h")).where("h IS NOT NULL")
        parts.append(places.select("item", "length", "h", F.array_join(F.slice("w", F.col("p") + 1, n), " ").alias("gram")))
    rows = reduce(DataFrame.unionByName, parts, items.select("item", "length", F.lit(0).cast("long").alias("h"), F.lit("").alias("gram")).limit(0))
    return rows.groupBy("gram", "length", "h").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """doc_id, n_words, spans (sorted structs start, end in words) and items (as strings) of every row."""
    prepare(docs.sparkSession)
    windows = materialize(item_windows(benchmark, width, **columns))
    counts = {r.length: r.n for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), words(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    hashed = window_hashes(rows, "w", sorted(counts))
    parts = [F.array().cast("array<struct<start:int,end:int,gram:string>>")]
    for n in sorted(counts):
        known = BitFilter(windows.where(F.col("length") == n).select("h"), counts[n])
        at = F.transform(f"h{n}", lambda x, i: F.when(known.passes(x), i))  # noqa: B023
        hashed = hashed.withColumn(f"h{n}", F.filter(at, lambda p: p.isNotNull()))
        parts.append(_spans(F.col("w"), F.col(f"h{n}"), n))
    scanned = materialize(hashed.select("rid", "doc_id", "n_words", F.concat(*parts).alias("places")))
    passed = scanned.select("rid", F.explode("places").alias("x")).select("rid", "x.*")
    by_gram = windows.groupBy("gram").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = meet(passed, by_gram, ["gram"]).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return scanned.join(hits, "rid", "left").select("doc_id", "n_words", none("spans", "array<struct<start:int,end:int>>"), none("items", "array<string>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    rows = scan(docs, benchmark, **options).withColumn("n_hit", covered(F.col("spans")))
    names = F.array_join(F.sort_array("items"), ",")
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
