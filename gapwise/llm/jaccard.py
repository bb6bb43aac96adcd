"""Jaccard join of word shingles by parity sketches.

A set's sketch has 2^j blocks, where 2^j..2^(j+1) is the band of its size. Every shingle falls into one block and flips
that block's bits (its hash is XORed in), so blocks differ only where the sets do: two sets that differ in d shingles
differ in at most d blocks. Sets as similar as asked differ in at most ``allowed(size)`` shingles, so by the pigeonhole
principle every ``allowed(size) + 1`` blocks of one hold a block of the other; the first so many blocks of both, in one
common order, share one. Those blocks are joined by equality within a band (a set near the upper end of its band joins
the next one too). What meets is tested by a second, one-bit sketch, whose Hamming distance is also no larger than the
difference, and then verified on the sets.

The order puts blocks last that many texts have, so a passage in many different texts fills no bucket unless a text has
little else; what counts as common comes from a sample and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import SLICE_ROWS, as_bytes, hash_share, table, words_of
from gapwise.llm.components import components
from gapwise.llm.decontaminate import sized
from gapwise.session import write_stage

SHINGLE, PERCENT = 4, 85
#: Blocks found in COMMON of about SAMPLE_TEXTS different texts come last in the order; COMMON_BLOCKS of them at most.
SAMPLE_TEXTS, COMMON, COMMON_BLOCKS = 20_000, 8, 200_000
#: Buckets up to SMALL rows give their pairs at once; larger ones first link to one member, then compare what is still apart.
SMALL = 32
#: Rounds in which rows of crowded buckets are linked to their nearest, before all that is still apart is compared.
NEAREST_ROUNDS = 2
#: Rows of a bucket, or partners of one text, that are held or met in one piece (about).
PIECE = 4096

U = np.uint64
# Multipliers and shifts of the SplitMix64 finaliser (Steele, Lea and Flood 2014).
_GOLDEN, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than ``size`` are one shingle, none give none."""
    words = words_of(text.lower())
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U, count=len(words))
    width = min(size, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, U(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out + h[i:len(h) - width + 1 + i]) * _GOLDEN
        out = np.sort(mixed(out))
    return out[np.r_[True, out[1:] != out[:-1]]]


def allowed(size, percent: int = PERCENT):
    """The most shingles in which a set of this size and any set similar to it differ."""
    return (100 - percent) * (size + 100 * size // percent) // (100 + percent)


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """The band of a set's own size, and the next one if a similar set may lie there."""
    own = size.bit_length() - 1
    return [own, own + 1] if 100 * size >= percent << (own + 1) else [own]


def blocks(hashes: np.ndarray, band: int) -> np.ndarray:
    """Tokens of a sketch's blocks that are not empty: band, place and the XOR of the shingles that fell there."""
    place = hashes >> U(64 - band) if band else np.zeros(len(hashes), dtype=U)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    with np.errstate(over="ignore"):
        return mixed(np.bitwise_xor.reduceat(hashes, first) + mixed(place[first] * _GOLDEN + U(band + 1)))


def empties(hashes: np.ndarray, band: int, count: int) -> np.ndarray:
    """Tokens of the first ``count`` empty blocks; only needed where too few others are there."""
    place = np.setdiff1d(np.arange(1 << band, dtype=U), hashes >> U(64 - band) if band else np.zeros(1, dtype=U), assume_unique=False)[:count]
    with np.errstate(over="ignore"):
        return mixed(mixed(place * _GOLDEN + U(band + 1)))


def one_bit(hashes: np.ndarray) -> bytes:
    """A sketch of two to four bits a shingle (128 at least); a shingle flips one of them."""
    bits = max(128, 1 << (len(hashes).bit_length() + 1))
    flips = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch that ``size`` bytes would have held: halves are XORed, which never adds to a distance."""
    words = np.frombuffer(sketch, dtype=U)
    while len(words) * 8 > size:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


def distances(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j), each at the size of the smaller sketch; sizes of a pair differ by a factor of two at most."""
    size = np.array([len(s) for s in sketches])
    small, out = np.minimum(size[i], size[j]), np.zeros(len(i), dtype=np.int64)
    for width in np.unique(small):
        rows = np.flatnonzero((size == width) | (size == 2 * width))
        place = np.zeros(len(size), dtype=np.int64)
        place[rows] = np.arange(len(rows))
        table, hit = np.stack([folded(sketches[r], width) for r in rows]), np.flatnonzero(small == width)
        for s in range(0, len(hit), step := max(1, (1 << 24) // int(width))):
            at = hit[s:s + step]
            out[at] = np.bitwise_count(table[place[i[at]]] ^ table[place[j[at]]]).sum(axis=1)
    return out


class Common:
    """Sorted tokens that many texts have, and into how many pieces their buckets are dealt."""

    def __init__(self, tokens: np.ndarray, pieces: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.pieces = tokens[order], pieces[order]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Pieces of each token, 0 where it is not common."""
        if not len(self.tokens) or not len(tokens):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.pieces[at], 0)


def signatures(hashes: np.ndarray, common: Common, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, pieces): the blocks by which any similar set is found, for all bands of the set; pieces is 0 for rare ones."""
    need, out = int(allowed(len(hashes), percent)) + 1, [(np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))]
    for band in bands(len(hashes), percent) if len(hashes) else []:
        tokens = blocks(hashes, band)
        pieces = common.of(tokens)
        rare, late = tokens[pieces == 0], pieces > 0
        if len(rare) > need:
            rare = np.partition(rare, need - 1)[:need]
        elif len(rare) < need and late.any():
            order = np.argsort(tokens[late])[:need - len(rare)]
            out.append((tokens[late][order], pieces[late][order]))
        out.append((rare, np.zeros(len(rare), dtype=np.int64)))
        if len(tokens) < need:
            spare = empties(hashes, band, need - len(tokens))
            out.append((spare, common.of(spare)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _common(source: DataFrame, rows: int, percent: int, size: int) -> Common:
    """Blocks that many of the sampled texts have; what reaches the driver is bounded by COMMON_BLOCKS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in as_bytes(batch.column("__text")):
                hashes = shingle_set(text, size)
                if len(hashes):
                    tokens = np.concatenate([blocks(hashes, band) for band in bands(len(hashes), percent)])
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    sample = source.where(hash_share(F.col("id"), SAMPLE_TEXTS, rows)).dropDuplicates(["id"])
    found = sample.select("__text").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    found = found.orderBy(F.desc("count"), "token").limit(COMMON_BLOCKS).toArrow()
    times = max(1.0, rows / SAMPLE_TEXTS)
    pieces = np.ceil(found.column("count").to_numpy() * times / PIECE).astype(np.int64)
    return Common(found.column("token").to_numpy().view(U), np.maximum(1, pieces))


def _signed(docs: DataFrame, common: Common, percent: int, size: int) -> DataFrame:
    """(__key, id, n, tokens, pieces, sketch, s0, s1) for every row; of copies in one task only the first carries its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size_of = set(), {}
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                n, sketch, tokens, pieces, ends = [], [], [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)], [0]
                for own, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("__text"))):
                    if own not in seen:
                        hashes = shingle_set(text, size)
                        size_of[own] = len(hashes)
                        sketch.append(one_bit(hashes))
                        for held, new in zip((tokens, pieces), signatures(hashes, common, percent)):
                            held.append(new)
                        seen.add(own)
                    else:
                        sketch.append(b"")
                        tokens.append(np.zeros(0, dtype=U))
                    n.append(size_of[own])
                    ends.append(ends[-1] + len(tokens[-1]))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key"), batch.column("id"), pa.array(n, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens).view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pieces).astype(np.int32))), pa.array(sketch, pa.binary()),
                     *[pa.array([int(folded(x, 16).view(np.int64)[i]) if x else 0 for x in sketch], pa.int64()) for i in (0, 1)]],
                    names=["__key", "id", "n", "tokens", "pieces", "sketch", "s0", "s1"])

    kind = docs.schema["__key"].dataType.simpleString()
    return docs.mapInArrow(run, f"__key {kind}, id long, n int, tokens array<long>, pieces array<int>, sketch binary, s0 long, s1 long")


def _rows(signed: DataFrame) -> DataFrame:
    """A row for each signature; ``piece`` is -1 for rare blocks, the buckets of common ones are dealt into pieces."""
    each = signed.select(F.explode(F.arrays_zip("tokens", "pieces")).alias("x"), "id", "n", "s0", "s1")
    token, pieces = F.col("x.tokens"), F.col("x.pieces")
    piece = F.when(pieces > 0, F.pmod(F.xxhash64(token, F.col("id")), pieces)).otherwise(F.lit(-1)).cast("int")
    return each.select(token.alias("token"), piece.alias("piece"), "id", "n", "s0", "s1")


def near(n: np.ndarray, s0: np.ndarray, s1: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) can be similar, by their sizes and the distance of their one-bit sketches."""
    a, b = n[i].astype(np.int64), n[j].astype(np.int64)
    distance = np.bitwise_count((s0[i] ^ s0[j]).view(U)).astype(np.int64) + np.bitwise_count((s1[i] ^ s1[j]).view(U))
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * distance <= (100 - percent) * (a + b))


FOUND = [("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64()), ("other", pa.int64())]


def _found(parts: list[dict], pairs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows of crowded buckets (other is null) and pairs (id, other), each once a batch."""
    a, b = (x.astype(np.int64) for x in pairs)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
    a, b = a[fresh], b[fresh]
    crowd = {c: np.concatenate([np.zeros(0, dtype=np.int64), *[p[c] for p in parts]]) for c in ("token", "id", "n", "s0", "s1")}
    void = np.zeros(len(a), dtype=np.int64)
    columns = [np.r_[crowd[c], a if c == "id" else void] for c in ("token", "id", "n", "s0", "s1")]
    empty = np.r_[np.ones(len(crowd["id"]), dtype=bool), np.zeros(len(a), dtype=bool)]
    other = pa.array(np.r_[np.zeros(len(crowd["id"]), dtype=np.int64), b], type=pa.int64(), mask=empty)
    return pa.RecordBatch.from_arrays([*[pa.array(x, type=t) for x, (_, t) in zip(columns, FOUND)], other], names=[c for c, _ in FOUND])


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """First pass over the buckets: all pairs of small ones; of crowded ones the pairs with their first row, and their rows.

    No bucket is held: of a crowded one only the first row is kept while the others pass by.
    """
    names = ["token", "piece", "id", "n", "s0", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the last bucket so far, while small
        hub: dict | None = None   # first and last row of a crowded bucket that may go on

        def crowded(part: dict, first: dict) -> tuple[np.ndarray, np.ndarray]:
            both = {c: np.r_[first[c][:1], part[c]] for c in names}
            j = np.arange(1, len(both["id"]))
            i = np.zeros(len(j), dtype=np.int64)
            ok = near(both["n"], both["s0"], both["s1"], i, j, percent) & (both["id"][j] != both["id"][0])
            return both["id"][i[ok]], both["id"][j[ok]]

        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch.column(c).to_numpy() for c in names}
            if held is not None:
                part = {c: np.concatenate([held[c], part[c]]) for c in names}
                held = None
            out, a, b = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            if hub is not None:
                go_on = int(np.argmin(np.r_[(part["token"] == hub["token"][0]) & (part["piece"] == hub["piece"][0]), False]))
                if go_on:
                    more = {c: v[:go_on] for c, v in part.items()}
                    fresh = np.r_[more["id"][0] != hub["id"][1], more["id"][1:] != more["id"][:-1]]
                    more = {c: v[fresh] for c, v in more.items()}
                    x, y = crowded(more, hub)
                    a, b, out = [*a, x], [*b, y], [*out, more]
                    hub = {c: np.r_[hub[c][:1], more[c][-1:]] if fresh.any() else hub[c] for c in names}
                    part = {c: v[go_on:] for c, v in part.items()}
                if len(part["id"]):
                    hub = None
            if len(part["id"]):
                new = np.r_[True, (part["token"][1:] != part["token"][:-1]) | (part["piece"][1:] != part["piece"][:-1])]
                fresh = new | np.r_[True, part["id"][1:] != part["id"][:-1]]
                part, new = {c: v[fresh] for c, v in part.items()}, new[fresh]
                start = np.flatnonzero(new)
                size = np.diff(np.r_[start, len(new)])
                big = (size > SMALL) | (part["piece"][start] >= 0)
                last = len(start) - 1
                if not big[last]:  # it may go on in the next batch
                    held = {c: v[start[last]:] for c, v in part.items()}
                    size, big, start = size[:last], big[:last], start[:last]
                each = np.repeat(np.where(big, 0, size), size)
                place = np.arange(len(each)) - np.repeat(start, size)
                times = np.where(each > 1, place, 0)  # a row of a small bucket meets all rows before it
                j = np.repeat(np.arange(len(each)), times)
                i = np.repeat(np.repeat(start, size), times) + np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)
                for s in range(0, len(j), 1 << 18):
                    x, y = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
                    ok = near(part["n"], part["s0"], part["s1"], x, y, percent)
                    a.append(part["id"][x[ok]])
                    b.append(part["id"][y[ok]])
                for s, m in zip(start[big], size[big]):
                    own = {c: v[s:s + m] for c, v in part.items()}
                    x, y = crowded({c: v[1:] for c, v in own.items()}, own)
                    a, b, out = [*a, x], [*b, y], [*out, own]
                if len(big) == last + 1 and big[last]:
                    hub = {c: v[[start[last], len(new) - 1]] for c, v in part.items()}
            yield _found(out, (np.concatenate(a), np.concatenate(b)))
        if held is not None:
            i, j = np.triu_indices(len(held["id"]), 1)
            ok = near(held["n"], held["s0"], held["s1"], i, j, percent)
            yield _found([], (held["id"][i[ok]], held["id"][j[ok]]))

    dealt = rows.repartition("token", "piece").sortWithinPartitions("token", "piece", "id")
    return dealt.mapInArrow(run, "token long, id long, n int, s0 long, s1 long, other long")


def _apart(crowd: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Second pass: pairs (id, other) of crowded buckets whose rows are not yet in one component; with ``nearest`` only
    the nearest one, by the sketches, that a row meets in a piece.

    Rows of the component that most of a bucket belongs to stay in their piece; all others visit every piece and pass
    by what is held there, so no pair within a component is made and no bucket is held whole.
    """
    marked = write_stage(crowd.join(labels, crowd.id == labels.node, "left").select("token", "id", "n", "s0", "s1", F.coalesce("label", "id").alias("label")), "marked")
    each = marked.frame.groupBy("token", "label").count()
    live = each.groupBy("token").agg(F.sum("count").alias("rows"), F.max_by("label", "count").alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    live = write_stage(live.select("token", "main", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces")), "live").frame
    there = write_stage(marked.frame.join(sized(live), "token"), "there").frame
    wanted = write_stage(there.select("id").distinct(), "wanted").frame
    own = sketches.join(sized(wanted), "id", "left_semi").groupBy("id").agg(F.first("sketch").alias("sketch"))
    there = there.join(own, "id")
    stay = there.withColumns({"piece": F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), "visitor": F.lit(False)})
    visit = there.where("label != main").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("visitor", F.lit(True))
    names = ["token", "piece", "visitor", "id", "n", "s0", "s1", "label", "sketch"]
    both = stay.select(*names).unionByName(visit.select(*names)).repartition("token", "piece").sortWithinPartitions("token", "piece", "visitor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            edge = np.flatnonzero(np.r_[True, np.any([part[c][1:] != part[c][:-1] for c in names[:3]], axis=0)])
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for s, e in zip(edge, np.r_[edge[1:], batch.num_rows]):
                if (part["token"][s], part["piece"][s]) != key:
                    key, parts = (part["token"][s], part["piece"][s]), []
                run = {c: part[c][s:e] for c in names}
                if not run["visitor"][0]:
                    parts.append(run)
                    continue
                if len(parts) > 1:
                    parts = [{c: np.concatenate([p[c] for p in parts]) for c in names}]
                for home in parts:
                    both = {c: np.concatenate([home[c], run[c]]) for c in names}
                    m, step = len(home["id"]), max(1, (1 << 18) // max(1, len(home["id"])))
                    for at in range(m, len(both["id"]), step):
                        rows = np.arange(at, min(at + step, len(both["id"])))
                        i, j = np.tile(np.arange(m), len(rows)), np.repeat(rows, m)
                        ok = (both["label"][i] != both["label"][j]) & near(both["n"], both["s0"], both["s1"], i, j, percent)
                        i, j = i[ok], j[ok]
                        used, at_both = np.unique(np.r_[i, j], return_inverse=True)
                        apart = distances([both["sketch"][k] for k in used], at_both[:len(i)], at_both[len(i):])
                        ok = (100 + percent) * apart <= (100 - percent) * (both["n"][i].astype(np.int64) + both["n"][j])
                        if nearest:
                            order = np.flatnonzero(ok)[np.lexsort((apart[ok], j[ok]))]
                            ok = order[np.r_[True, j[order][1:] != j[order][:-1]]] if len(order) else order
                        a.append(np.minimum(both["id"][i[ok]], both["id"][j[ok]]))
                        b.append(np.maximum(both["id"][i[ok]], both["id"][j[ok]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["id", "other"])

    return both.mapInArrow(run, "id long, other long")


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The different pairs (id, other) whose one-bit sketches are near enough; sketches take a sixteenth of a text's set."""
    pairs = write_stage(pairs.distinct(), "candidates")
    wanted = write_stage(pairs.frame.select("id").unionByName(pairs.frame.select(F.col("other").alias("id"))).distinct(), "wanted")
    own = sketches.join(sized(wanted.frame), "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    own = write_stage(own, "sketches")
    both = pairs.frame.join(own.frame.toDF("id", "n", "s"), "id").join(own.frame.toDF("other", "m", "t"), "other").select("id", "other", "n", "m", "s", "t")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, s, t in zip(*[batch.column(c).to_pylist() for c in ("n", "m", "s", "t")]):
                size = min(len(s), len(t))
                distance = int(np.bitwise_count(folded(s, size) ^ folded(t, size)).sum())
                good.append((100 + percent) * distance <= (100 - percent) * (n + m))
            yield batch.select(["id", "other"]).filter(pa.array(good, pa.bool_()))

    good = write_stage(both.mapInArrow(check, "id long, other long"), "close").frame
    for copy in (pairs, wanted, own):
        copy.drop()
    return good


def _verified(pairs: DataFrame, source: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b) of the pairs (id, other) that are similar. A text moves once to where its id is asked for, then once for each
    pair in which its id is the larger one and once for each piece of the partners of the smaller one."""
    pairs = write_stage(pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    hubs = write_stage(pairs.frame.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")), "hubs")
    many = hubs.frame.where("pieces > 1")  # few: each has over PIECE partners
    first = hubs.frame.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(None).cast("long").alias("b"))
    second = pairs.frame.join(sized(many), "a", "left").select(
        F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"), "b")
    asked = first.unionByName(second)
    wanted = write_stage(asked.select("id").distinct(), "wanted")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = [i for i, k in enumerate(batch.column("id").to_pylist()) if not (k in seen or seen.add(k))]
            yield batch.take(pa.array(new, pa.int64()))

    texts = source.join(sized(wanted.frame), "id", "left_semi").select("id", F.col("__text").cast("binary").alias("text")).mapInArrow(once, "id long, text binary")
    met = texts.groupBy("id").agg(F.first("text").alias("text")).join(asked.hint("merge"), "id").select("a", "piece", "b", "text")
    met = met.repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                hashes, a, b = shingle_set(batch.column("text")[i].as_py(), size), batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                if b is None:
                    own = hashes
                elif 100 * (shared := len(np.intersect1d(own, hashes, assume_unique=True))) >= percent * (len(own) + len(hashes) - shared):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    good = write_stage(met.mapInArrow(check, "a long, b long"), "links").frame
    for copy in (pairs, hubs, wanted):
        copy.drop()
    return good


def links(signed: DataFrame, source: DataFrame, percent: int = PERCENT, size: int = SHINGLE, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the ids of (id, __text) that connect exactly what chains of similar texts connect.

    ``known`` are verified links (a, b) from elsewhere; only candidates in different components of these are compared.
    Each text is first compared with its smallest candidate. Most groups are connected by that; of the other candidates
    and of the crowded buckets only what is still in different components is compared then.
    """
    sketches = signed.where("length(sketch) > 0").select("id", "n", "sketch")
    met = write_stage(_meet(_rows(signed), percent), "met")
    joined = lambda: labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    apart = lambda pairs: pairs.join(label("id"), "id", "left").join(label("other"), "other", "left").where(
        F.coalesce("id_label", "id") != F.coalesce("other_label", "other")).select("id", "other")
    pairs = met.frame.where("other IS NOT NULL").select("id", "other")
    if known is not None:
        labels = components(known)
        pairs = apart(pairs)
    pairs = _close(pairs, sketches, percent)
    found = _verified(pairs.groupBy("other").agg(F.min("id").alias("id")), source, percent, size)
    labels = components(found if known is None else joined().unionByName(found))
    crowd = met.frame.where("other IS NULL").drop("other")
    crowded = not crowd.isEmpty()
    for _ in range(NEAREST_ROUNDS if crowded else 0):  # connects most of a large group with a few pairs a text
        found = _verified(_apart(crowd, labels, sketches, percent, True), source, percent, size)
        if found.isEmpty():
            break
        labels = components(joined().unionByName(found))
    left = apart(pairs)
    if crowded:
        left = left.unionByName(_apart(crowd, labels, sketches, percent, False))
    rest = _verified(left, source, percent, size)
    met.drop()
    return joined().unionByName(rest)


def text_links(source: DataFrame, rows: int, percent: int = PERCENT, size: int = SHINGLE, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the ids of about ``rows`` rows (id, __text); rows of one id hold the same text, or none has a word."""
    signed = write_stage(_signed(source.select(F.lit(0).alias("__key"), "id", "__text"), _common(source, rows, percent, size), percent, size), "signed")
    found = links(signed.frame, source, percent, size, known)
    signed.drop()
    return found


def verified(pairs: DataFrame, source: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(a, b) of the pairs (a, b) of ids of (id, __text) whose shingle sets are similar."""
    return _verified(pairs.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other")), source, percent, size)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) for every row; links are Jaccard similarities of ``percent`` hundredths or more.

    ``percent`` is 70 or more: below, similar sets may differ in more shingles than a sketch has blocks.

    Edge cases: null, empty and blank texts have no shingle and are components of their own; repeated rows give repeated
    result rows; a null key gets the smallest key of its component; texts of any length are read whole; an empty table
    gives no rows; further columns are ignored. Equal texts are one before anything is joined.
    """
    if percent < 70:
        raise ValueError(f"percent is 70 or more, not {percent}")
    source = docs.select(F.col(f"`{key}`").alias("__key"), F.xxhash64(text).alias("id"), F.col(f"`{text}`").alias("__text"))
    common = _common(source, source.count(), percent, size)
    signed = write_stage(_signed(source, common, percent, size), "signed")
    members = write_stage(signed.frame.select("__key", F.col("id").alias("__id"), F.col("n").cast("long").alias("n_shingles")), "members").frame
    labels = components(links(signed.frame, source.select("id", "__text"), percent, size))
    signed.drop()
    own = members.where("n_shingles > 0").groupBy("__id").agg(F.min("__key").alias("own"))
    named = write_stage(own.join(labels, own["__id"] == labels.node, "left").select("__id", "own", F.coalesce("label", "__id").alias("label")), "named").frame
    best = named.groupBy("label").agg(F.min("own").alias("component"))
    known = named.join(best, "label").select("__id", "component")
    out = members.join(known, "__id", "left")
    mark = F.when(F.col("n_shingles") > 0, F.coalesce("component", "__key")).otherwise(F.col("__key"))
    return out.select(F.col("__key").alias(key), "n_shingles", mark.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM w),
d AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, n, unnest(s) AS x FROM d),
l AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT id, id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN d ON d.s = s.s LEFT JOIN c ON c.id = d.id
"""
