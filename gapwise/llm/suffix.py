"""Removal of long byte strings that occur again: content-chosen anchors deal the text out, suffix arrays compare it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import as_bytes, map_slices, table
from gapwise.session import write_stage

LENGTH = 200
#: An anchor is the 32-byte gram with the smallest hash among those of a window of LENGTH bytes.
GRAM = 32
#: Window starts handled at once within a text, and bytes of contexts that one suffix array covers (one anchor's group is never cut).
STRETCH = 1 << 19
CHUNK = 1 << 19
#: Anchors with more different contexts than this compare their windows by a grouped count instead.
CROWDED = 20_000
#: UTF-8 has no such byte; it ends every context.
STOP = 255

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, width, k = _BYTE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _ODD[k] + h[width:]
        width, k = width * 2, k + 1
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(position, first window start, last window start, gram hash): every window belongs to the anchor it is smallest at."""
    span = LENGTH - GRAM + 1
    out: list[tuple[int, int, int, int]] = []
    total = len(data) - LENGTH + 1
    for begin in range(0, max(0, total), STRETCH):
        count = min(STRETCH, total - begin)
        h = gram_hashes(data[begin:begin + count + LENGTH - 1])
        low = np.uint64((1 << 20) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[:len(m) - (span - width)], m[span - width:])
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        where = at[first]
        values = h[where].view(np.int64)
        out += zip((where + begin).tolist(), (first + begin).tolist(), (last + begin).tolist(), values.tolist())
    return out


ANCHORS = "t1 long, t2 long, at int, first int, last int, gram long, context long"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """The anchors of every text with the hash of their context: the bytes that the anchor's windows cover."""
    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in ANCHORS.split(", ")}
        for t1, t2, raw in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), as_bytes(batch.column("text"))):
            found = anchors(np.frombuffer(raw, dtype=np.uint8))
            if found:
                at, first, last, gram = zip(*found)
                out["t1"] += [t1] * len(at)
                out["t2"] += [t2] * len(at)
                out["at"] += at
                out["first"] += first
                out["last"] += last
                out["gram"] += gram
                out["context"] += [xxhash.xxh64_intdigest(raw[a:b + LENGTH]) for a, b in zip(first, last)]
        out["context"] = np.array(out["context"], dtype=np.uint64).view(np.int64)
        return out

    return map_slices(docs, work, ANCHORS)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Two-stage suffix order to depth LENGTH. Only suffixes smaller than their successors are sorted directly; a scan of
    the first-byte buckets in order then puts every other suffix behind those found before it: the suffix one byte
    to the left of an entry goes to the next free place of its own bucket."""
    n = len(data)
    padded = np.r_[data, np.full(LENGTH + 1, STOP, dtype=np.uint8)]
    change = np.flatnonzero(padded[:-1] != padded[1:])
    change = change[change < n]
    nearest = np.searchsorted(change, np.arange(n))
    rising = np.zeros(n, dtype=bool)
    inside = nearest < len(change)
    at = change[nearest[inside]]
    rising[inside] = padded[at] < padded[at + 1]
    rising[~inside] = True  # the padded tail counts as smaller than what follows
    keys = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    small = np.flatnonzero(rising)
    sorted_small = small[np.argsort(np.ascontiguousarray(keys[small]).view(f"S{LENGTH}").ravel(), kind="stable")]
    by_byte = np.searchsorted(padded[sorted_small], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~rising[before]]
        if not len(before):
            return
        first = data[before]
        order = np.argsort(first, kind="stable")
        first, before = first[order], before[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            queues[first[a]].append(before[a:b])

    # the suffix at the very end has nothing behind it: it counts as the smallest of all
    if n and not rising[n - 1]:
        queues[data[n - 1]].append(np.array([n - 1]))
    for byte in range(256):
        done = 0
        while done < len(queues[byte]):  # grows while a run of equal bytes is induced
            part = queues[byte][done]
            out.append(part)
            induce(part)
            done += 1
        part = sorted_small[by_byte[byte]:by_byte[byte + 1]]
        out.append(part)
        induce(part)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def adjacent_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length (up to LENGTH) of each suffix in ``order`` with the next one."""
    padded = np.r_[data, np.full(LENGTH, STOP, dtype=np.uint8)]
    keys = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    out = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    for start in range(0, len(out), 1 << 15):
        a, b = order[start:start + (1 << 15)], order[start + 1:start + 1 + (1 << 15)]
        same = keys[a[:len(b)]] == keys[b]
        out[start:start + len(b)] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    return out


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context the window starts inside it that occur again in these contexts."""
    data = np.frombuffer(b"".join(c + bytes([STOP]) for c in contexts), dtype=np.uint8)
    ends = np.cumsum([len(c) + 1 for c in contexts]) - 1
    order = suffix_array(data)
    order = order[ends[np.searchsorted(ends, order)] - order >= LENGTH]  # no clipped suffix can lie between equal windows
    same = adjacent_prefixes(data, order) >= LENGTH
    again = np.zeros(len(data), dtype=bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [np.flatnonzero(again[e - len(c):e]) for c, e in zip(contexts, ends)]


def runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Byte stretches [from, to) that windows at ``starts`` (ascending) cover."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + LENGTH).tolist()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; groups are gathered up to CHUNK bytes and compared by one suffix array."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        spans = [runs(s) for s in repeated_starts([h[2] for h in held])]
        return pa.RecordBatch.from_arrays([
            pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
            pa.array([s[0] for s in spans], pa.list_(pa.int32())), pa.array([s[1] for s in spans], pa.list_(pa.int32()))], names=["gram", "context", "begin", "end"])

    for batch in batches:
        for gram, context, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and gram != held[-1][0] and size >= CHUNK:
                yield flush()
                held, size = [], 0
            if not held or (gram, context) != held[-1][:2]:
                held.append((gram, context, body))
                size += len(body)
    if held:
        yield flush()


def spans(docs: DataFrame, text: str = "text", crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """(texts, found): the documents with two hashes that name their text, and per named text the stretches to remove.

    Equal windows have the same anchor gram at the same place, so only anchors whose gram occurs twice go on. If a
    whole context occurs twice, all its windows do. Other contexts travel with their bytes to the task of their
    gram, one of each kind, and a suffix array finds the windows that occur again. Grams with very many kinds of context
    are not gathered: their windows are counted by hash, one row each.
    """
    named = docs.withColumn("__t1", F.xxhash64(text)).withColumn("__t2", F.xxhash64(F.lit(1), text))
    source = named.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), F.col(text).alias("text"))
    repeated = anchor_rows(source).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    marked = write_stage(anchor_rows(source).join(repeated, "gram"), "anchors").frame
    kinds = marked.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "at", "first", "last")).alias("one"))
    kinds = write_stage(kinds, "kinds").frame
    many = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    needed = kinds.join(many, "gram").groupBy("one.t1", "one.t2").agg(
        F.collect_list(F.struct("gram", "context", F.col("one.first").alias("first"), F.col("one.last").alias("last"), (F.col("kinds") > crowded).alias("crowded"))).alias("places"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("gram", "context", "body", "crowded")}
        for raw, places in zip(as_bytes(batch.column("text")), batch.column("places").to_pylist()):
            for p in places:
                out["gram"].append(p["gram"])
                out["context"].append(p["context"])
                out["body"].append(raw[p["first"]:p["last"] + LENGTH])
                out["crowded"].append(p["crowded"])
        return out

    bodies = write_stage(map_slices(source.join(needed, ["t1", "t2"]).select("text", "places"), cut,
                                    "gram long, context long, body binary, crowded boolean"), "contexts").frame
    few = bodies.where("not crowded").select("gram", "context", "body").repartition("gram").sortWithinPartitions("gram", "context")
    partial = few.mapInArrow(_compare, "gram long, context long, begin array<int>, end array<int>")

    def windows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("gram", "context", "start", "w1", "w2")}
        for gram, context, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for start in range(len(body) - LENGTH + 1):
                w = xxhash.xxh3_128_intdigest(body[start:start + LENGTH])
                out["gram"].append(gram)
                out["context"].append(context)
                out["start"].append(start)
                out["w1"].append((w >> 64) - (1 << 63))
                out["w2"].append((w & ((1 << 64) - 1)) - (1 << 63))
        return out

    crowd = map_slices(bodies.where("crowded").dropDuplicates(["gram", "context"]).select("gram", "context", "body"), windows,
                       "gram long, context long, start int, w1 long, w2 long")
    again = crowd.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1")
    counted = (crowd.join(again, ["w1", "w2"]).groupBy("gram", "context").agg(F.sort_array(F.collect_set("start")).alias("begin"))
               .withColumn("end", F.transform("begin", lambda s: s + LENGTH)))
    partial = partial.unionByName(counted.select("gram", "context", "begin", "end"))
    width = F.col("one.last") - F.col("one.first") + LENGTH
    whole = kinds.where("n > 1").select("gram", "context", F.array(F.lit(0)).alias("begin"), F.array(width).alias("end"))
    partial = partial.where(F.size("begin") > 0).join(kinds.where("n = 1").select("gram", "context"), ["gram", "context"], "left_semi")
    cover = whole.unionByName(partial)
    found = (marked.join(cover, ["gram", "context"]).select("t1", "t2", F.explode(F.arrays_zip("begin", "end")).alias("z"), "first")
             .groupBy("t1", "t2").agg(F.collect_set(F.struct((F.col("first") + F.col("z.begin")).alias("a"), (F.col("first") + F.col("z.end")).alias("b"))).alias("spans")))
    return named, found


def kept_bytes(raw: bytes, found: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    out, at, count, end = [], 0, 0, -1
    for a, b in sorted((s["a"], s["b"]) for s in found or []):
        if a > end:
            out.append(raw[at:a])
            count += 1
        end = max(end, b)
        at = end
    return b"".join(out) + raw[at:], count


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", crowded: int = CROWDED, output: str = "digest") -> DataFrame:
    """Every row with the bytes removed that a string of LENGTH bytes covers which starts anywhere else too.

    output "digest": (key, n_bytes, n_removed, n_spans, kept_sha256); "bytes": (key, kept binary).
    Edge cases: null is empty; texts below LENGTH bytes stay whole; a repeated row is removed wholly, in all its copies,
    if it has LENGTH bytes; strings are bytes, so what is left may cut a character; further columns are ignored.
    """
    named, found = spans(docs.select(F.col(key), F.col(text)), text, crowded)
    kind = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for raw, where in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            kept, count = kept_bytes(raw, where)
            out.append((len(raw), len(raw) - len(kept), count, kept))
        if output == "bytes":
            return {key: batch.column(0), "kept": [o[3] for o in out]}
        return {key: batch.column(0), "n_bytes": [o[0] for o in out], "n_removed": [o[1] for o in out], "n_spans": [o[2] for o in out],
                "kept_sha256": [hashlib.sha256(o[3]).hexdigest() for o in out]}

    joined = named.join(found, (named["__t1"] == found["t1"]) & (named["__t2"] == found["t2"]), "left").select(key, text, "spans")
    return map_slices(joined, work, f"`{key}` {kind}, " + ("kept binary" if output == "bytes" else "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
