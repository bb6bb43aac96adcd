"""One document of each group of near-duplicates, for the pipeline.

Two texts are linked exactly if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. The SimHash
operator comes first: fingerprints of five-word shingles, deletion variants, equality grouping; its pairs are verified on the
sets. At a similarity near 0.8 fingerprints differ in about 15 % of their bits and the variants reach two of 64, so the
parity-sketch join of ``jaccard`` then compares what is still in different components and loses no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm import jaccard, simhash
from gapwise.llm.components import components
from gapwise.llm.decontaminate import sized
from gapwise.session import write_stage

SHINGLE, PERCENT = 5, 80


def identity(text: str) -> Column:
    """A number per different text; all texts without a word have the same."""
    return F.when(F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def print_links(source: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of (id, __text) by the SimHash operator, each verified on the sets of shingles.

    Texts of one fingerprint are paired with the smallest id, and the smallest ids of close fingerprints with each other.
    Texts without a word take no part.
    """
    prints = write_stage(simhash.fingerprints(source, ["id"], "__text", SHINGLE).where("id != 0").distinct(), "prints")
    own = prints.frame.groupBy("fingerprint").agg(F.min("id").alias("own"))
    own = write_stage(own, "own")
    alike = prints.frame.join(own.frame, "fingerprint").where("id != own").select(F.col("own").alias("a"), F.col("id").alias("b"))
    of = lambda c: own.frame.select(F.col("fingerprint").alias(f"{c}_print"), F.col("own").alias(c))
    close = simhash.links(own.frame.select("fingerprint")).select(F.col("a").alias("a_print"), F.col("b").alias("b_print"))
    close = close.join(of("a"), "a_print").join(of("b"), "b_print").select("a", "b")
    found = jaccard.verified(alike.unionByName(close), source, PERCENT, SHINGLE)
    prints.drop()
    own.drop()
    return found


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar texts: one that has the smallest key. All columns stay as they are.

    Texts without a word are copies of each other; a null key is kept only where its component has no other. Copies are
    one class before any bucket. The documents are filtered by the list of rows that go, and shuffled only where that
    list is too long to send to every task; rows repeated in full meet in a shuffle of their own.
    """
    source = docs.select(identity(text).alias("id"), F.col(f"`{text}`").alias("__text"))
    seen = docs.select(identity(text).alias("id"), F.col(f"`{key}`").alias("key")).groupBy("id", "key").count()
    seen = write_stage(seen, "texts").frame
    rows = seen.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    labels = components(jaccard.text_links(source, rows, PERCENT, SHINGLE, print_links(source)))
    named = seen.join(labels, seen.id == labels.node, "left").select("id", "key", "count", F.coalesce("label", "id").alias("label"))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("id"))).alias("best"))
    judged = named.join(best, "label").select(F.col("id").alias("__id"), F.col("key").alias("__key"), "count",
                                              ((F.col("id") == F.col("best.id")) & F.col("key").eqNullSafe(F.col("best.key"))).alias("stays"))
    judged = write_stage(judged, "judged").frame
    gone = sized(write_stage(judged.where("not stays").select("__id", "__key"), "gone").frame)
    same = (identity(text) == F.col("__id")) & F.col(f"`{key}`").eqNullSafe(F.col("__key"))
    kept = docs.join(gone, same, "left_anti")
    repeated = judged.where("stays and count > 1").select("__id", "__key")
    if repeated.isEmpty():
        return kept
    repeated = sized(write_stage(repeated, "repeated").frame)
    names = [f"`{n}`" for n in docs.columns]
    once = kept.join(repeated, same, "left_semi").withColumn("__id", identity(text)).dropDuplicates(["__id", key]).select(*names)
    return kept.join(repeated, same, "left_anti").unionByName(once)
