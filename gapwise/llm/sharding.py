"""Balanced shards: longest processing time first, over groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwise.llm.common import table
from gapwise.session import write_stage

#: A group above 1/FINE of all bytes is scheduled by itself, so there are fewer than FINE such groups;
#: the others are gathered by hash into FINE bundles. The heap never sees more than 2 * FINE items.
FINE = 4096


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest first, each to the shard with the least load. Items are (size, name); ties go by name and shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its size, shard and gapless slot; rows of equal text stay in one shard.

    Edge cases: null text has size 1 and is a group of its own, apart from empty text; repeated rows get slots
    of their own; null keys come first within their group; an empty table gives no rows; further columns are
    ignored. Texts are not shuffled: they are named by their digest. Slots are ranks within small pieces of an item
    (so that one group with a third of all rows is ranked by many tasks) plus the pieces before.
    """
    spark = docs.sparkSession
    body = F.col(text)
    rows = write_stage(docs.select(
        F.col(key).alias("__key"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(body), F.lit("null")).alias("group")), "rows").frame
    total = rows.agg(F.sum("size"), F.count("*")).first()
    all_bytes, all_rows = total[0] or 0, total[1]
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") * FINE > F.lit(all_bytes)).select("group", F.lit(True).alias("alone"))
    bundle = F.concat(F.lit("bundle-"), F.lpad(F.pmod(F.xxhash64("group"), F.lit(FINE)).cast("string"), 5, "0"))
    # fewer than FINE rows, by the meaning of the threshold
    named = rows.join(F.broadcast(large), "group", "left").withColumn("item", F.when(F.col("alone"), F.col("group")).otherwise(bundle))
    counted = named.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most 2 * FINE rows
    placed = schedule([(r["bytes"], r["item"]) for r in counted], shards)
    start, free, widths = {}, [0] * shards, {}
    for r in sorted(counted, key=lambda r: r["item"]):
        start[r["item"]] = free[placed[r["item"]]]
        free[placed[r["item"]]] += r["n"]
        widths[r["item"]] = max(1, -(-r["n"] * FINE // max(1, all_rows)))
    plan = spark.createDataFrame([(i, s, start[i], widths[i]) for i, s in placed.items()],
                                 "item string, shard int, start long, width long")
    # an item is cut into pieces of about 1/FINE of all rows: at most 3 * FINE pieces
    cut = named.join(F.broadcast(plan), "item").withColumn("piece", F.pmod(F.xxhash64("__key", "group"), F.col("width")))
    sizes = cut.groupBy("item", "piece").agg(F.count("*").alias("n")).collect()
    before, run = [], {}
    for r in sorted(sizes, key=lambda r: (r["item"], r["piece"])):
        before.append((r["item"], r["piece"], run.get(r["item"], 0)))
        run[r["item"]] = run.get(r["item"], 0) + r["n"]
    offsets = spark.createDataFrame(before, "item string, piece long, before long")
    rank = F.row_number().over(Window.partitionBy("item", "piece").orderBy("__key", "group")) - 1
    return cut.join(F.broadcast(offsets), ["item", "piece"]).select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("before") + rank).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
