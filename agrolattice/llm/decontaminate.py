"""Benchmark decontamination in DataFrame operations: item-sized windows over shared
shingles, bounded, then checked by exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most_broadcast, materialize, row_key, text_of


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: str, size: int) -> Column:
    """xxhash64 of each run of ``size`` words, in order; of all words if there are fewer."""
    picks = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> xxhash64({picks})) "
                  f"when size({words}) > 0 then array(xxhash64(array_join({words}, ' '))) else cast(array() as array<bigint>) end")


def runs_of(words: str, length: int) -> Column:
    """The hash that ``shingles_of`` gives a whole text of ``length`` words, of each run of so many."""
    return F.expr(f"case when size({words}) >= {length} then transform(sequence(0, size({words}) - {length}), "
                  f"i -> xxhash64(array_join(slice({words}, i + 1, {length}), ' '))) else cast(array() as array<bigint>) end")


def benchmark_items(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, n_words, shingles and fp (a hash of them) of every item with a word.

    A shingle's weight is its count in the item times ln(1 + items / items with it), so what
    many items share says little.
    """
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(text_of()).alias("words"))
             .where("size(words) > 0").withColumn("shingles", shingles_of("words", size))
             .select("item_id", F.size("words").alias("n_words"), "shingles", F.xxhash64("shingles").alias("fp")))
    return materialize(items.dropDuplicates(["item_id", "shingles"]), "items")


def shingle_weights(items: DataFrame) -> DataFrame:
    """item_id, fp, n_words, shingle, times, weight, total."""
    n_items = items.agg(F.count(F.lit(1)).alias("n_items"))
    rows = items.select("item_id", "n_words", "fp", F.explode("shingles").alias("shingle"))
    by_item = Window.partitionBy("item_id", "fp")
    by_shingle = rows.groupBy("shingle").agg(F.countDistinct("item_id").alias("df"))
    out = (rows.groupBy("item_id", "fp", "n_words", "shingle").agg(F.count(F.lit(1)).alias("times"))
           .join(by_shingle, "shingle").join(F.broadcast(n_items), F.lit(True))
           .withColumn("weight", F.log(1 + F.col("n_items") / F.col("df"))))
    return materialize(out.withColumn("total", F.sum(F.col("times") * F.col("weight")).over(by_item))
                       .select("item_id", "fp", "n_words", "shingle", "times", "weight", "total"), "weights")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, doc_key, item_id, similarity, first_word, n_words: the best window of each
    document for each benchmark item it contains.

    Windows have the length of the item in words and slide over whole documents.  The shingles
    that a document shares with an item are found by a join on the benchmark's shingles, whose
    number does not grow with the corpus and is checked before it is broadcast; the weight of
    those in a window bounds what the two share, and windows whose bound is too low go.  Every
    other window is checked exactly: the weight of the shingle
    occurrences that window and item share, over the larger of the two total weights (a shingle
    of the window that no item has weighs as much as one that one item has), at least
    ``similarity``.  An item of fewer than ``size`` words is one shingle of its own length.

    Null and empty texts match nothing; items without a word are ignored; repeated document
    rows are one document; a null doc_id stays null; an empty table on either side gives no
    rows; further columns are ignored.
    """
    items = benchmark_items(benchmark, size)
    weights = shingle_weights(items)
    shared = at_most_broadcast(weights.select("shingle", "item_id", F.col("fp").alias("item_fp"), "n_words", "weight", "total"), 2_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc_key"), text_of().alias("text"))
    worded = lambda d: (d.withColumn("words", words_of(F.col("text"))).withColumn("shingles", shingles_of("words", size))
                        .drop("words", "text"))
    # the outer form: the plain one filters on the array first and so computes it twice
    places = worded(texts).select("doc_key", F.posexplode_outer("shingles").alias("i", "shingle"))
    # the windows first: the rest needs only the documents that have any
    length = f"greatest(1, n_words - {size - 1})"
    least = f"({similarity} - 1e-6) * total"
    pair = ["doc_key", "item_id", "item_fp", "n_words", "total"]
    # grouped by place, so that repeated rows count once
    hits = materialize(places.join(shared.where(f"n_words >= {size}"), "shingle")
                       .groupBy(*pair, "i").agg(F.max("weight").alias("weight")), "hits")
    enough = hits.groupBy(*pair).agg(F.sum("weight").alias("sum")).where(f"sum >= {least}")
    # a hit is in the windows that start up to their length before it; their sums are one aggregate
    starts = hits.join(enough, pair, "left_semi").withColumn("start", F.explode(F.expr(f"sequence(greatest(0, i - {length} + 1), i)")))
    hits = (starts.groupBy(*pair, "start").agg(F.sum("weight").alias("inside")).where(f"inside >= {least}")
            .select("doc_key", "item_id", "item_fp", "n_words", "start"))
    hits = materialize(hits, "places")
    found = at_most_broadcast(materialize(hits.select("doc_key").distinct(), "seeded"), 1_000_000)
    seeded = worded(texts.join(found, "doc_key", "left_semi").dropDuplicates(["doc_key"]))
    windows = (hits.join(seeded, "doc_key")
               .withColumn("part", F.expr("slice(shingles, start + 1, greatest(1, n_words - %d))" % (size - 1)))
               .select("doc_key", "doc_id", "item_id", "item_fp", "n_words", "start", "part"))
    scored = _scored(materialize(windows, "windows"), weights, similarity)
    # at most size - 1 lengths
    for row in items.where(f"n_words < {size}").select("n_words").distinct().orderBy("n_words").collect():
        runs = texts.withColumn("words", words_of(F.col("text"))).select(
            "doc_key", "doc_id", F.posexplode_outer(runs_of("words", row["n_words"])).alias("start", "shingle"))
        scored = scored.unionByName(runs.join(shared.where(f"n_words = {row['n_words']}"), "shingle").select(
            "doc_key", "doc_id", "item_id", "n_words", "start", F.lit(1.0).alias("similarity")))
    best = Window.partitionBy("doc_key", "item_id").orderBy(F.desc("similarity"), "start")
    return (scored.withColumn("r", F.row_number().over(best)).where("r = 1")
            .select("doc_id", "doc_key", "item_id", "similarity", F.col("start").alias("first_word"), "n_words"))


def _scored(windows: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """The windows at ``similarity`` or more, with their similarity."""
    by_window = ["doc_key", "doc_id", "item_id", "item_fp", "n_words", "start"]
    counted = (windows.select(*by_window, F.explode("part").alias("shingle"))
               .groupBy(*by_window, "shingle").agg(F.count(F.lit(1)).alias("seen")))
    known = weights.groupBy("shingle").agg(F.max("weight").alias("any_weight"))
    rarest = weights.agg(F.max("weight").alias("rarest"))
    own = weights.select("item_id", F.col("fp").alias("item_fp"), "shingle", "times", "weight", "total")
    joined = (counted.join(known, "shingle", "left").join(F.broadcast(rarest), F.lit(True))
              .join(own.drop("total"), ["item_id", "item_fp", "shingle"], "left"))
    sums = joined.groupBy(*by_window).agg(
        F.sum(F.coalesce(F.least("seen", "times") * F.col("weight"), F.lit(0.0))).alias("both"),
        F.sum(F.col("seen") * F.coalesce("any_weight", "rarest")).alias("window_total"))
    totals = own.groupBy("item_id", "item_fp").agg(F.first("total").alias("total"))
    return (sums.join(totals, ["item_id", "item_fp"])
            .withColumn("similarity", F.round(F.col("both") / F.greatest("total", "window_total"), 6))
            .where(f"similarity >= {similarity}")
            .select("doc_key", "doc_id", "item_id", "n_words", "start", "similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns stay."""
    bad = contamination(docs, benchmark, **options).select(F.col("doc_key").alias("_bad")).distinct()
    return docs.withColumn("_key", row_key()).join(bad, F.col("_key") == F.col("_bad"), "left_anti").drop("_key")
