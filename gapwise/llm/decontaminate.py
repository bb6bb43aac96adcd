"""Benchmark decontamination with DataFrame functions only.

Documents are cut into windows of an item's size; window and item fingerprints (SimHash of their word shingles)
meet through Hamming blocks, and the exact weighted-shingle similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import table
from gapwise.session import write_stage

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints up to RADIUS bits apart are candidates. RADIUS + 1 blocks: at least one block is then without a
#: difference, so every pair within the radius is found. At similarity 0.8 about 10 of 64 bits differ (spread 3).
RADIUS = 20
BLOCKS = RADIUS + 1
#: A written table of a few numbers a row goes to every task if it has at most so many rows; else it is joined by a shuffle.
BROADCAST_ROWS = 500_000
CUT = "[\\x20\\x09-\\x0D]+"


def sized(written: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if its counted rows allow it."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def words(text: str) -> Column:
    """Lower-case words of a text column; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), CUT), "")


def shingles(column: str, size: int = SHINGLE) -> Column:
    """Word shingles of an array of words, repeats included; fewer words are one shingle, none give none."""
    return F.expr(f"transform(if(size({column}) = 0, cast(array() as array<int>), sequence(1, greatest(1, size({column}) - {size - 1}))), "
                  f"i -> array_join(slice({column}, i, {size}), ' '))")


def with_fingerprint(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` (unique by ``key``) with ``print``: a bit is 1 where over half of the shingles' hashes have it."""
    hashes = rows.select(key, F.explode(column).alias("s")).select(key, F.xxhash64("s").alias("h"))
    bits = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    counted = hashes.groupBy(key).agg(F.count("*").alias("n"), *bits)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return rows.join(counted.select(key, value.alias("print")), key)


def blocks(print_column: str) -> Column:
    """(block number, block value) of the RADIUS + 1 blocks, 3 or 4 bits each."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(print_column), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
             for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.explode(F.array(*parts))


def starts(seeded: DataFrame) -> DataFrame:
    """(text_hash, size, start) of all windows with enough shingles of one item, from (text_hash, length, size, of, at) per shared shingle.

    Of two sets of n and m shingles SIMILARITY / (1 + SIMILARITY) * (n + m) are shared at least. With the places sorted, a
    window that holds that many starts between the last of them less a window's length and the first of them.
    """
    at = seeded.groupBy("text_hash", "length", "size", "of").agg(F.sort_array(F.collect_set("at")).alias("p"))
    count = f"greatest(1, size - {SHINGLE - 1})"
    at = at.withColumn("k", F.expr(f"least({count}, greatest(1, length - {SHINGLE - 1}))"))
    at = at.withColumn("need", F.expr(f"cast(greatest(1, ceil({SIMILARITY / (1 + SIMILARITY)}D * (k + {count}) - 1e-9D)) as int)")).where("size(p) >= need")
    laid = ("flatten(transform(sequence(0, size(p) - need), j -> if(p[j + need - 1] - p[j] < k, "
            "sequence(greatest(0, p[j + need - 1] - k + 1), greatest(0, least(p[j], length - size))), cast(array() as array<int>))))")
    return at.select("text_hash", "size", F.explode(F.array_distinct(F.expr(laid))).alias("start")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item key, start word, similarity, text_hash): the best window per row key and item, where similarity is enough.

    Windows have the item's number of words (the whole text where it is shorter) and may start at any word. Those that hold
    too few shingles of the item to reach SIMILARITY, in whatever order, are not laid. Equal windows are compared once,
    whatever the number of copies.
    Edge cases: null, empty and blank texts and items match nothing; an item shorter than a shingle is one shingle;
    repeated rows of a key give one result; a null key is kept as a key; empty tables give no rows.
    """
    item = benchmark.select(F.col(item_key).alias("item"), words(item_text).alias("w")).where("size(w) > 0")
    item = item.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("size", F.size("w"))
    item = with_fingerprint(item.withColumn("item_no", F.array_join("w", " ")).withColumn("item_shingles", shingles("w")), "item_no", "item_shingles")
    item = write_stage(item, "items").frame
    seeds = item.select("size", F.xxhash64("item_no").alias("of"), F.explode("item_shingles").alias("s")).select(F.xxhash64("s").alias("h"), "size", "of").distinct()
    short = [r[0] for r in item.where(F.col("size") < SHINGLE).select("size").distinct().collect()]  # at most four values
    seeds = sized(write_stage(seeds, "seeds").frame)
    body = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    found = []
    for size in (SHINGLE, *short):
        own = body.select("text_hash", F.size("w").alias("length"), F.posexplode(shingles("w", size)).alias("at", "s"))
        found.append(own.select("text_hash", "length", "at", F.xxhash64("s").alias("h")).join(seeds, "h"))
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    places = sized(write_stage(starts(places), "places").frame)
    windows = (docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("body")).join(places, "text_hash")
               .withColumn("w", words("body")).select("key", "text_hash", "size", "start", F.expr("slice(w, start + 1, size)").alias("w")))
    windows = write_stage(windows.withColumn("window", F.array_join("w", " ")).drop("w"), "windows").frame
    distinct = windows.select("size", "window").distinct().withColumn("own", F.concat_ws(":", "size", "window"))
    distinct = distinct.withColumn("ww", F.split("window", " ")).withColumn("window_shingles", shingles("ww")).drop("ww")
    printed = write_stage(with_fingerprint(distinct, "own", "window_shingles"), "prints").frame
    left = printed.select("own", "size", F.col("print").alias("p"), blocks("print").alias("b")).select("own", "size", "p", "b.*")
    right = item.select("item_no", "size", F.col("print").alias("q"), blocks("print").alias("b")).select("item_no", "size", "q", "b.*")
    near = left.join(right, ["size", "block", "value"]).where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= RADIUS).select("own", "item_no").distinct()
    shared = F.expr("aggregate(array_intersect(window_shingles, item_shingles), 0, (t, x) -> t + "
                    "least(size(filter(window_shingles, y -> y = x)), size(filter(item_shingles, y -> y = x))))")
    judged = (near.join(printed.select("own", "size", "window", "window_shingles"), "own")
              .join(item.select("item_no", "items", "item_shingles"), "item_no")
              .withColumn("shared", shared)
              .withColumn("similarity", F.col("shared") / (F.size("window_shingles") + F.size("item_shingles") - F.col("shared")))
              .where(F.col("similarity") >= SIMILARITY).select("size", "window", F.explode("items").alias("item"), "similarity"))
    hits = windows.join(judged, ["size", "window"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return hits.groupBy("key", "item", "text_hash").agg(best).select(
        F.col("key").alias(key), F.col("item").alias(item_key), (-F.col("best.back")).alias("start"),
        F.col("best.similarity").alias("similarity"), "text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; all others stay as they are."""
    bad = matches(docs, benchmark, key, text).select(F.col(key).alias("__bad_key"), F.col("text_hash").alias("__bad_hash")).distinct()
    bad = sized(write_stage(bad, "contaminated").frame)
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__bad_key")) & (F.xxhash64(text) == F.col("__bad_hash")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy("doc_id", "item_id").agg(
        F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).alias("start"), F.max("similarity").alias("similarity"))
