"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import add_columns, distinct_texts, hash_share, table, words_of

#: Bounds of the training sample, in documents of each label; longer documents are cut into chains of CHAIN lines for training.
SAMPLE_DOCS = 500
CHAIN = 32
STEPS, RATE, DECAY = 200, 0.05, 1e-3
#: A document stays if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
MARKS = b"!?=_~^"
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + WINDOW - max(end, at)
            end = at + WINDOW
    return covered


def lines_of(text: bytes) -> list[tuple[bytes, list[bytes]]]:
    """Lines that hold a word, each with its words."""
    return [(line, words) for line in text.split(b"\n") if (words := words_of(line))]


def line_features(lines: list[tuple[bytes, list[bytes]]]) -> np.ndarray:
    """One row of observations per line: length, shares of capitals, symbols and marks, repetition, word length."""
    rows, earlier = [], set()
    for line, words in lines:
        size, n = len(line), len(words)
        shown = size - (size - len(line.translate(None, BLANK)))
        rows.append((
            1.0,
            min(n, 100) ** 0.5,
            (size - len(line.translate(None, UPPER))) / shown,
            (size - len(line.translate(None, SYMBOLS))) / shown,
            (size - len(line.translate(None, MARKS))) / shown,
            1 - len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            float(line in earlier),
            min(shown / n, 30.0) / 10,
            float(n < 4),
        ))
        earlier.add(line)
    return np.array(rows, dtype=float).reshape(len(rows), 10)


class LineField:
    """Two labels (0 boilerplate, 1 content), a weight per observation, and four transition scores."""

    def __init__(self, weight: np.ndarray, step: np.ndarray) -> None:
        self.weight, self.step = weight, step

    def decode(self, observed: np.ndarray) -> list[bool]:
        """Viterbi: the most likely labels of the whole line sequence."""
        score = (observed @ self.weight).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        junk, content, back = 0.0, score[0], []
        for s in score[1:]:
            from_junk = (junk + s00 >= content + s10, junk + s01 > content + s11)
            junk, content = max(junk + s00, content + s10), max(junk + s01, content + s11) + s
            back.append(from_junk)
        labels = [content >= junk]
        for to_junk, to_content in reversed(back):
            labels.append(not (to_content if labels[-1] else to_junk))
        return labels[::-1]


def train(documents: list[tuple[bytes, int]]) -> LineField:
    """Maximum likelihood by gradient ascent over padded chains. A line takes the label of its document.

    Without examples of both labels nothing can be told apart, and every line counts as content.
    """
    chains = []
    for text, good in documents:
        seen = line_features(lines_of(text))
        chains += [(seen[i:i + CHAIN], good) for i in range(0, len(seen), CHAIN)]
    if len({good for _, good in chains}) < 2:
        return LineField(np.array([1.0] + [0.0] * 9), np.zeros((2, 2)))
    length = np.array([len(c) for c, _ in chains])
    observed = np.zeros((len(chains), CHAIN, 10))
    for i, (c, _) in enumerate(chains):
        observed[i, :len(c)] = c
    label = np.array([good for _, good in chains])
    there = np.arange(CHAIN)[None, :] < length[:, None]
    balance = np.where(label == 1, 1 / (there[label == 1].sum()), 1 / (there[label == 0].sum())) / 2
    spread = observed[there].std(axis=0)
    scale = np.where(spread > 0, spread, 1.0)
    observed /= scale
    theta, mean, square = np.zeros(14), np.zeros(14), np.zeros(14)
    for k in range(1, STEPS + 1):
        weight, step = theta[:10], theta[10:].reshape(2, 2)
        emit = np.stack([np.zeros(there.shape), observed @ weight], axis=2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, CHAIN):
            forward[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + step, axis=1) + emit[:, t], forward[:, t - 1])
        for t in range(CHAIN - 2, -1, -1):
            after = np.logaddexp.reduce(step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], after, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        content = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        gap = (label[:, None] - content) * there * balance[:, None]
        up = np.einsum("ct,ctf->f", gap, observed) - DECAY * weight
        pair = forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * (there[:, 1:] * balance[:, None])[:, :, None, None]).sum(axis=(0, 1))
        own = np.zeros((2, 2))
        for value in (0, 1):
            own[value, value] = ((length - 1) * balance)[label == value].sum()
        slope = np.r_[up, (own - expected - DECAY * step).ravel()]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        theta = theta + RATE * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
    return LineField(theta[:10] / scale, theta[10:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> LineField:
    """Fit on a bounded sample of labelled documents: about ``rows`` of each label, chosen by a hash of their id.

    Only the chosen ids (a bounded number) go to the documents; null labels, ids and texts are left out.
    """
    sample = []
    for good in (0, 1):
        known = labels.where((F.col("quality") == good) & F.col("doc_id").isNotNull()).select("doc_id")
        chosen = known.where(hash_share(F.xxhash64("doc_id"), rows, known.count())).distinct().limit(2 * rows)
        texts = docs.join(F.broadcast(chosen), "doc_id").select("text")
        sample += [(t.encode(), good) for t in distinct_texts(texts, 2 * rows)]
    return train(sample)


SHAPE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "content_share double, kept boolean")


def verdicts(texts: list[bytes], field: LineField) -> list[tuple]:
    """The columns of SHAPE for each text."""
    out = []
    for raw in texts:
        words, lines = words_of(raw), lines_of(raw)
        n, repeat = len(words), repeated_words(words)
        failed = n < 10 or 100 * repeat > 20 * n
        labels = field.decode(line_features(lines)) if lines else []
        share = sum(len(w) for (_, w), good in zip(lines, labels) if good) / n if n else 0.0
        out.append((n, len(raw.decode()) - (len(raw) - len(raw.translate(None, BLANK))), len(raw) - len(raw.translate(None, SYMBOLS)),
                    len(lines) - len({line for line, _ in lines}), repeat, failed, share, not failed and share >= CONTENT_SHARE))
    return out


def judge(docs: DataFrame, field: LineField, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the counts and the verdict of every row.

    Edge cases: null, empty and blank text has no words and fails the base rule; content_share is then 0; repeated
    rows get equal verdicts; a text of one endless line is one line.
    """
    def work(texts: list[bytes]) -> dict:
        found = verdicts(texts, field)
        return {c.split()[0]: [v[i] for v in found] for i, c in enumerate(SHAPE.split(", "))}

    return add_columns(docs, keep, text, work, SHAPE)


def keep_good(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they are."""
    marked = add_columns(docs, docs.columns, text, lambda texts: {"__good": [v[-1] for v in verdicts(texts, field)]}, "__good boolean")
    return marked.where("__good").drop("__good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), field, ["doc_id"])
