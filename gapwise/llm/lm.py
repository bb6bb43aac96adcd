"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, and corpus unigrams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import as_bytes, crc_mod, map_slices, table, words_of
from gapwise.session import write_stage

#: The end of a text as a token; no word is empty.
END = b""
#: Outputs of the network: the most frequent tokens one by one, all others by hash class.
SINGLE, CLASSES = 190, 64
OUTPUTS = SINGLE + CLASSES
START = OUTPUTS
#: The weights of the network, in the order of a gradient.
WEIGHTS = ("read", "near", "far", "write", "bias")
DIM, NOISE, STEPS, RATE = 24, 10, 40, 0.1
#: Contexts whose outputs are figured at once.
BLOCK = 512
#: Counts that are packed into blocks at once.
PACKED = 500_000
#: A token with at least one in FREQUENT of all training tokens is looked up inside the tasks. There are at
#: most FREQUENT of them; the rest is joined.
FREQUENT = 1_000_000
#: Tokens counted in a task before a flush.
FLUSH = 400_000
#: Tokens turned into numbers at once (one text may have more), and numbers held in a task before they are counted.
GROUP, HELD = 100_000, 4_000_000


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): counts of all tokens, ends included, over all rows. Tasks pre-aggregate in bounded memory."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                held.update(words_of(raw.lower()))
                held[END] += 1
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_class(word: bytes) -> int:
    return SINGLE + zlib.crc32(word) % CLASSES


def word_classes(words: list[bytes]) -> np.ndarray:
    return SINGLE + np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % CLASSES


def before(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs one and two before each of many texts' tokens; ``size`` tokens a text, at least one."""
    starts = np.cumsum(size) - size
    one, two = (np.r_[START, START, ids][2 - k:][:len(ids)] for k in (1, 2))
    one[starts] = two[starts] = START
    two[starts[size > 1] + 1] = START
    return one, two


def blocks(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts by at most BLOCK contexts: these, the cell of each count in [context, output], and the counts."""
    seen, at = np.unique(context, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at = at[order]
    for low in range(0, len(seen), BLOCK):
        begin, end = np.searchsorted(at, (low, low + BLOCK))
        rows = order[begin:end]
        yield seen[low:low + BLOCK].astype(np.int32), ((at[begin:end] - low) * OUTPUTS + word[rows]).astype(np.int32), n[rows].astype(np.int64)


class LogBilinear:
    """log P(w | two tokens before) = softmax over outputs of (A r[-1] + B r[-2]) . t[w] + bias[w]."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.read = rng.normal(0, 0.1, (OUTPUTS + 1, DIM))
        self.near, self.far = np.eye(DIM), np.eye(DIM) * 0.5
        self.write = rng.normal(0, 0.1, (OUTPUTS, DIM))
        self.bias = np.zeros(OUTPUTS)

    def start(self, unigram: np.ndarray) -> None:
        """Noise and first biases from the counts of all outputs; a fresh Adagrad state."""
        self.noise = (unigram + 1.0) / (unigram + 1.0).sum()
        self.bias = np.log(self.noise)
        self.square = np.full(sum(getattr(self, k).size for k in WEIGHTS), 1e-12)  # far below any mean gradient

    def gradient(self, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Noise-contrastive estimation over counted tokens: the sum of all their gradients, as one array.

        Each token stands against NOISE draws from the unigram distribution, taken by their expectation, so nothing is
        drawn. Counts of one context may be split over calls: the sum is the same.
        """
        return self.gradient_of(blocks(context, word, n))

    def gradient_of(self, counted: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """``gradient`` over ``blocks``."""
        up = {k: np.zeros_like(getattr(self, k)) for k in WEIGHTS}
        shift = self.bias - np.log(NOISE * self.noise)
        for context, cell, n in counted:
            two, one = np.divmod(context, OUTPUTS + 1)
            gap = np.bincount(cell, n, len(one) * OUTPUTS).reshape(-1, OUTPUTS)
            read_one, read_two = self.read[one], self.read[two]
            query = read_one @ self.near + read_two @ self.far
            odds = query @ self.write.T
            odds += shift
            np.exp(np.negative(odds, out=odds), out=odds)
            odds += 1
            drawn = np.outer(NOISE * gap.sum(axis=1), self.noise)
            drawn += gap
            drawn /= odds
            gap -= drawn
            to_query = gap @ self.write
            up["write"] += gap.T @ query
            up["bias"] += gap.sum(axis=0)
            np.add.at(up["read"], one, to_query @ self.near.T)
            np.add.at(up["read"], two, to_query @ self.far.T)
            up["near"] += read_one.T @ to_query
            up["far"] += read_two.T @ to_query
        return np.concatenate([up[k].ravel() for k in WEIGHTS])

    def step(self, gradient: np.ndarray) -> None:
        """One Adagrad step on the mean gradient of a token."""
        self.square += gradient * gradient
        move, at = RATE * gradient / np.sqrt(self.square), 0
        for k in WEIGHTS:
            own = getattr(self, k)
            setattr(self, k, own + move[at:at + own.size].reshape(own.shape))
            at += own.size

    def train(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """The same steps as ``learn``, on tokens at hand."""
        self.start(np.bincount(ids, minlength=OUTPUTS))
        for _ in range(STEPS):
            self.step(self.gradient(two * (OUTPUTS + 1) + one, ids, np.ones(len(ids))) / len(ids))

    def table(self) -> np.ndarray:
        """log10 probabilities [two before, one before, output], normalised, by one matrix product per row of contexts."""
        one = self.read @ self.near
        two = self.read @ self.far
        out = np.empty((OUTPUTS + 1, OUTPUTS + 1, OUTPUTS), dtype=np.float32)
        for b in range(OUTPUTS + 1):
            score = (one + two[b]) @ self.write.T + self.bias
            out[b] = (score - np.logaddexp.reduce(score, axis=1, keepdims=True)) / np.log(10)
        return out


def context_counts(training: DataFrame, single: dict[bytes, int], text: str = "text") -> DataFrame:
    """(context, word, n): how often an output follows two others, over all tokens of all rows.

    At most (OUTPUTS + 1)^2 * OUTPUTS rows, however many texts there are.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        words: list[bytes] = []
        size: list[int] = []

        def number() -> int:
            ids = np.fromiter(map(single.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            other = np.flatnonzero(ids < 0)
            ids[other] = word_classes([words[i] for i in other.tolist()])
            one, two = before(ids, np.array(size, dtype=np.int64))
            held.append(((two * (OUTPUTS + 1) + one) * OUTPUTS + ids).astype(np.int32))
            words.clear()
            size.clear()
            return len(ids)

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.empty(0, dtype=np.int32), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((code // OUTPUTS).astype(np.int64)), pa.array(code % OUTPUTS), pa.array(n.astype(np.int64))],
                                              names=["context", "word", "n"])

        rows = 0
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                now = len(words)
                words += words_of(raw.lower())
                words.append(END)
                size.append(len(words) - now)
                if len(words) > GROUP:
                    rows += number()
                    if rows > HELD:
                        yield flush()
                        rows = 0
        number()
        yield flush()

    parts = training.select(F.col(f"`{text}`")).mapInArrow(count, "context long, word int, n long")
    return parts.groupBy("context", "word").agg(F.sum("n").alias("n"))


def packed(counts: DataFrame) -> DataFrame:
    """``context_counts`` as ``blocks``, one a row: what every step reads, without a row for every count."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for block in blocks(*map(np.concatenate, zip(*found))) if found else ():
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in block], names=["context", "cell", "n"])
            found.clear()

        for b in batches:
            found.append([b.column(i).to_numpy() for i in range(3)])
            if sum(len(f[0]) for f in found) > PACKED:
                yield from flush()
        yield from flush()

    tasks = counts.sparkSession.sparkContext.defaultParallelism
    return counts.repartition(tasks, "context").sortWithinPartitions("context").mapInArrow(pack, "context binary, cell binary, n binary")


def add_up(counted: DataFrame, part: Callable[[Iterator[tuple]], np.ndarray], size: int) -> np.ndarray:
    """The sum over tasks of ``part``, ``size`` numbers made from a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i) for i in range(3))))
        read = ((np.frombuffer(c.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int64)) for c, x, n in rows)
        for first in read:
            yield pa.RecordBatch.from_arrays([pa.array([part(chain([first], read))], pa.list_(pa.float64()))], names=["v"])

    sums = counted.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out


def learn(training: DataFrame, single: dict[bytes, int], text: str = "text") -> LogBilinear:
    """The network of all training tokens: every step is one job over their counts; the driver holds the weights only."""
    model = LogBilinear()
    counted = write_stage(packed(context_counts(training, single, text)), "contexts")
    unigram = add_up(counted.frame, lambda read: sum((np.bincount(cell % OUTPUTS, n, OUTPUTS) for _, cell, n in read), np.zeros(OUTPUTS)), OUTPUTS)
    total = unigram.sum()
    if total:
        model.start(unigram)
    for _ in range(STEPS if total else 0):
        model.step(add_up(counted.frame, model.gradient_of, len(model.square)) / total)
    counted.drop()
    return model


_TABLES: dict[int, tuple] = {}


def score(docs: DataFrame, training: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    The network gives the probability of a frequent token or of a class; inside a class a token has
    (c + 1) / (N_class + V_class + 1). Frequent tokens are looked up in the task (a table with a proven bound),
    the others are joined with the counts, and rows are put together again by a row number written with them.
    Edge cases: null and empty text is one end token; without training text every count is zero; repeated rows give
    equal rows; further columns are ignored.
    """
    spark = docs.sparkSession
    counts = write_stage(token_counts(training, text), "counts").frame
    total, distinct = (v or 0 for v in counts.agg(F.sum("n"), F.count("*")).first())
    frequent = {r["word"].encode(): r["n"] for r in counts.where(F.col("n") * FREQUENT >= F.lit(total)).toLocalIterator()}  # at most FREQUENT rows
    top = sorted(frequent, key=lambda w: (-frequent[w], w))[:SINGLE]
    single = {w: i for i, w in enumerate(top)}
    rest = counts.where(~F.col("word").isin([w.decode() for w in top]) if top else F.lit(True))
    mass = np.ones(CLASSES)  # N_class + V_class + 1
    for r in rest.groupBy((F.crc32("word") % CLASSES).alias("k")).agg((F.sum("n") + F.count("*")).alias("m")).collect():
        mass[r["k"]] += r["m"]
    model = learn(training, single, text)
    whole = float(np.log10(total + distinct + 1))
    shared = spark.sparkContext.broadcast((model, frequent, single, np.log10(mass)))
    stamp = zlib.crc32(repr((total, distinct, len(frequent), top[:5], mass.tolist(), model.bias.tolist())).encode())

    def tables() -> tuple:
        if stamp not in _TABLES:
            _TABLES.clear()
            fitted, known, numbers, class_mass = shared.value
            names = {w: i for i, w in enumerate(known)}
            log_count = np.array([np.log10(n + 1) for n in known.values()] + [0.0])
            output = np.array([numbers[w] if w in numbers else word_class(w) for w in known] + [0], dtype=np.int64)
            minus = np.array([0.0 if w in numbers else log_count[i] for i, w in enumerate(known)] + [0.0])
            _TABLES[stamp] = fitted.table(), names, log_count, output, minus, class_mass
        return _TABLES[stamp]

    fields = [f for f in docs.schema.fields if f.name in keep]
    shape = "".join(f"__keep{i} {f.dataType.simpleString()}, " for i, f in enumerate(fields))

    def work(batch: pa.RecordBatch) -> dict:
        log_p, names, log_count, output, in_class, class_mass = tables()
        lists = [[*words_of(t.lower()), END] for t in as_bytes(batch.column("__text"))]
        size = np.array([len(x) for x in lists])
        ends = np.cumsum(size)
        starts = ends - size
        words = list(chain.from_iterable(lists))
        codes = np.fromiter(map(names.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        ids = output[codes]
        cold = np.flatnonzero(codes < 0)
        ids[cold] = word_classes([words[i] for i in cold.tolist()])
        one, two = before(ids, size)
        net = log_p[two, one, ids].astype(float) + in_class[codes]
        classed = ids >= SINGLE
        net[classed] -= class_mass[ids[classed] - SINGLE]
        base = log_count[codes] - whole
        known = (codes >= 0).astype(np.int64)
        per = np.searchsorted(cold, starts), np.searchsorted(cold, ends)
        add = lambda v: np.add.reduceat(v, starts)  # noqa: E731  every text has its end token
        return {f"__keep{i}": batch.column(f"__keep{i}") for i in range(len(fields))} | {
            "__row": batch.column("__row"), "n_tokens": size, "known": add(known), "base": add(base), "net": add(net),
            "cold": [[words[i].decode() for i in cold[a:b].tolist()] for a, b in zip(*per)]}

    source = docs.select(*[F.col(f"`{f.name}`").alias(f"__keep{i}") for i, f in enumerate(fields)],
                         F.monotonically_increasing_id().alias("__row"), F.col(f"`{text}`").alias("__text"))
    part = write_stage(map_slices(source, work, shape + "__row long, n_tokens long, known long, base double, net double, cold array<string>"), "scored").frame
    cold = part.select("__row", F.explode("cold").alias("word")).join(counts.where(F.col("n") * FREQUENT < F.lit(total)), "word")
    sums = cold.groupBy("__row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return part.drop("cold").join(sums, "__row", "left").select(
        *[F.col(f"__keep{i}").alias(f.name) for i, f in enumerate(fields)], "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("net") + gain).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return score(docs, docs.where("not held_out"), ["doc_id", "held_out"])
