"""SimHash near-duplicates: deletion-variant signatures, equality grouping, verified links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import as_bytes, map_slices, table, words_of
from gapwise.llm.components import components
from gapwise.session import write_stage

SHINGLE = 3
SEED = 42
#: The signature cut: two segments of 32 bits. Fingerprints at most RADIUS bits apart differ in at most one bit of one of them.
RADIUS = 2
HALF = 32
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 15
#: Buckets up to this size compare all members at once; larger ones are linked through deletion variants of the other segment.
SMALL_BUCKET = 512


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Bit is 1 where over half of the shingle hashes have it; no words: zero."""
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(shingles), BLOCK):
        part = shingles[start:start + BLOCK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (long, the 64 bits, of shingles of ``size`` words) of every row. Null text has no words."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def work(batch: pa.RecordBatch) -> dict:
        out = {f.name: batch.column(f.name) for f in fields}
        prints = [fingerprint(words_of(t.lower()), size) for t in as_bytes(batch.column("__text"))]
        return out | {"fingerprint": pa.array(np.array(prints, dtype=np.uint64).view(np.int64))}

    source = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text).alias("__text"))
    return map_slices(source, work, f"{shape}, fingerprint long")


def variants(prints: DataFrame) -> DataFrame:
    """The 64 one-wildcard signatures of each fingerprint: a 32-bit segment without one bit, and that bit's place."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    return prints.select("fingerprint", bit).select(
        "fingerprint",
        F.expr(f"(shiftrightunsigned(fingerprint, if(bit < {HALF}, 0, {HALF})) & 4294967295L & ~shiftleft(1L, bit % {HALF}))"
               f" | shiftleft(cast(bit as bigint), {HALF})").alias("signature"))


class _Forest:
    """Union-find over the members of one bucket; remembers the links that joined two trees."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        rx, ry = self.root(x), self.root(y)
        if rx != ry:
            self.parent[max(rx, ry)] = min(rx, ry)
            self.links.append((x, y))


def bucket_links(members: np.ndarray) -> list[tuple[int, int]]:
    """Verified links (index pairs) that connect what is within RADIUS in one bucket: a forest, never all pairs.

    Members of a bucket agree in 31 bits of a segment, so a large bucket is linked by equality again: two
    members are within RADIUS exactly if they agree after two bits are cleared. For every pair of bits the
    members are sorted once and equal neighbours joined; memory stays at a few numbers per member.
    """
    forest = _Forest(len(members))
    if len(members) <= SMALL_BUCKET:
        close = np.bitwise_count(members[:, None] ^ members[None, :]) <= RADIUS
        for x, y in zip(*np.nonzero(np.triu(close, 1))):
            forest.join(int(x), int(y))
        return forest.links
    varied = np.bitwise_or.reduce(members ^ members[0])
    bits = [np.uint64(1) << np.uint64(b) for b in range(64) if int(varied) >> b & 1]
    for i, first in enumerate(bits):
        for second in bits[i:]:
            cleared = members & ~(first | second)
            order = np.argsort(cleared, kind="stable")
            for at in np.flatnonzero(cleared[order][1:] == cleared[order][:-1]):
                forest.join(int(order[at]), int(order[at + 1]))
    return forest.links


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by signature; a bucket may go on in the next batch, so its last run is carried."""
    keys, prints = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            members = prints[s:e]
            for x, y in bucket_links(members.view(np.uint64)):
                a.append(int(members[x]))
                b.append(int(members[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        keys = np.r_[keys, batch.column("signature").to_numpy()]
        prints = np.r_[prints, batch.column("fingerprint").to_numpy()]
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield links(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield links(keys, prints)


def links(distinct_prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within RADIUS bits."""
    signed = variants(distinct_prints).repartition("signature").sortWithinPartitions("signature")
    return signed.mapInArrow(_link_buckets, "a long, b long").distinct()


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fingerprint, own_id, label, component_id) per distinct fingerprint of (key, fingerprint) rows.

    own_id is the smallest key with that fingerprint, component_id the smallest of the component (null keys
    only name a component that has no other), label the component's smallest fingerprint.
    """
    own = prints.groupBy("fingerprint").agg(F.min(key).alias("own_id"))
    labels = components(links(prints.select("fingerprint").distinct()))
    named = own.join(labels, own.fingerprint == labels.node, "left").select(
        "fingerprint", "own_id", F.coalesce("label", "fingerprint").alias("label"))
    best = named.join(labels.select("label").distinct(), "label").groupBy("label").agg(F.min("own_id").alias("component_id"))
    return named.join(best, "label", "left").select(
        "fingerprint", "own_id", "label", F.when(F.col("component_id").isNull(), F.col("own_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint hex, component_id) for every row.

    Edge cases: null or blank text has fingerprint zero and is linked like any other; repeated rows give
    repeated result rows; a null key gets the smallest key of its component; an empty table gives no rows;
    further columns are ignored. Copies share a fingerprint, so they are one class before any signature is made.
    """
    prints = write_stage(fingerprints(docs, [key], text), "fingerprints").frame
    known = classes(prints, key).select("fingerprint", "component_id")
    return prints.join(known, "fingerprint").select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one that has the smallest key. All columns stay as they are.

    Links are those of ``near_duplicates``: RADIUS bits between fingerprints of SHINGLE words. That finds all copies and
    texts that differ in very little; most pairs with a five-word similarity just above 0.8 are further apart and stay.

    The winner's fingerprint and key name the row, so the documents are shuffled on both; copies of one text spread
    over the tasks by their keys, and rows repeated in full meet in one.
    """
    names = docs.columns
    prints = write_stage(fingerprints(docs, [key], text), "fingerprints").frame
    won = classes(prints, key).where(F.col("own_id").eqNullSafe(F.col("component_id")))
    best = won.groupBy("label").agg(F.min("fingerprint").alias("__print"), F.first("own_id").alias("__first"))
    best = best.select("__print", F.xxhash64("__first").alias("__key"), "__first").hint("merge")
    marked = fingerprints(docs, names, text).withColumnRenamed("fingerprint", "__print").withColumn("__key", F.xxhash64(F.col(f"`{key}`")))
    kept = marked.join(best, ["__print", "__key"]).where(F.col(f"`{key}`").eqNullSafe(F.col("__first")))
    return kept.dropDuplicates(["__print", "__key"]).select(*[f"`{n}`" for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
