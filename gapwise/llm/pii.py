"""Personal data: base patterns, and a skip-chain conditional random field that carries their labels to further tokens."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import add_columns, bounded_sample, table

KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match cannot start inside a run of digits, so the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@+]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Bound of the training sample in documents that hold a digit, an @ or a plus sign.
SAMPLE_DOCS = 2000
ROUNDS = 8
STEPS, RATE, DECAY = 200, 1.0, 1e-3
#: A token joins the spans when its belief reaches this.
CERTAIN = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind, then start. Linear in the text's length."""
    spans = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            found = DOMAIN.match(text, at) if start < at else None
            free = found.end() if found else max(free, at + 1)
            if found:
                spans.append((0, start, free))
            at = text.find("@", free)
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, *m.span()))
    return spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def shape(token: str) -> list[str]:
    """Observations of one token."""
    digits = sum(c.isdigit() for c in token)
    return [f"digits:{min(digits, 20)}", f"letters:{min(sum(c.isalpha() for c in token), 4)}", f"dots:{min(token.count('.'), 4)}",
            f"dashes:{min(token.count('-'), 4)}", f"at:{'@' in token.strip('@')}", f"plus:{token.startswith('+')}",
            f"paren:{'(' in token}", f"outline:{re.sub('[0-9]+', '9', re.sub('[^0-9@.+()-]+', 'a', token))[:12]}"]


FEATURES = 1 << 10


def observe(tokens: list[str]) -> np.ndarray:
    """Hashed observation numbers per token: its own and its neighbours' number of digits and outline."""
    own = [shape(t) for t in tokens]
    rows = []
    for i, o in enumerate(own):
        before = own[i - 1] if i else ["edge"] * 8
        after = own[i + 1] if i + 1 < len(own) else ["edge"] * 8
        rows.append([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % FEATURES
                     for x in [*o, "<" + before[0], "<" + before[-1], ">" + after[0], ">" + after[-1]]])
    return np.array(rows, dtype=np.int64).reshape(len(rows), 12)


def similar_key(token: str) -> str:
    """Tokens with the same key are joined by skip edges: equal digits (four or more), else equal letters and digits."""
    digits = "".join(c for c in token if c.isdigit())
    core = "".join(c for c in token.lower() if c.isalnum() or c == "@")
    return digits if len(digits) >= 4 and "@" not in token else core if len(core) >= 4 else ""


class Graph:
    """Marked tokens of a text with their neighbours, chain edges, and skip edges between similar tokens.

    Occurrences of a key are joined one to the next, so edges stay in proportion to tokens. Tokens further than
    one place from a digit, @ or plus sign take no part: no observation speaks for personal data there.
    """

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        marked = [i for i, (s, e) in enumerate(found) if MARK.search(text, s, e)]
        chosen = sorted({j for i in marked for j in (i - 1, i, i + 1) if 0 <= j < len(found)})
        self.places = [found[i] for i in chosen]
        self.tokens = [text[s:e] for s, e in self.places]
        self.marked = np.isin(chosen, marked)
        label = np.zeros(len(chosen), dtype=np.int64)
        starts = np.array([s for s, _ in self.places])
        ends = np.array([e for _, e in self.places])
        for kind, s, e in spans:
            label[np.searchsorted(ends, s, "right"):np.searchsorted(starts, e, "left")] = kind + 1
        self.label = label
        chain = [(i, i + 1) for i in range(len(chosen) - 1) if chosen[i] + 1 == chosen[i + 1]]
        last: dict[str, int] = {}
        skip = []
        for i, token in enumerate(self.tokens):
            if self.marked[i] and (key := similar_key(token)):
                if key in last:
                    skip.append((last[key], i))
                last[key] = i
        self.chain, self.skip = np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(skip, dtype=np.int64).reshape(-1, 2)


class SkipChainField:
    """Observation weights, chain potentials and skip potentials, and loopy message passing over them."""

    def __init__(self, weight: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.weight, self.chain, self.skip = weight, chain, skip

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Label probabilities per token after ROUNDS of messages in both directions of every edge; base labels are fixed."""
        node = self.weight[observe(graph.tokens)].sum(axis=1)
        fixed = graph.label > 0
        node[fixed] = -50.0
        node[fixed, graph.label[fixed]] = 0.0
        edges = np.vstack([graph.chain, graph.skip])
        potential = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)])
        source = np.r_[edges[:, 0], edges[:, 1]]
        target = np.r_[edges[:, 1], edges[:, 0]]
        both = np.concatenate([potential, potential.transpose(0, 2, 1)])
        reverse = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        message = np.zeros((len(source), node.shape[1]))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, target, message)
            out = np.logaddexp.reduce((total[source] - message[reverse])[:, :, None] + both, axis=1)
            message = 0.5 * message + 0.5 * (out - out.max(axis=1, keepdims=True))
        total = node.copy()
        np.add.at(total, target, message)
        total -= total.max(axis=1, keepdims=True)
        return np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)

    def further(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that the field adds: runs of marked tokens with one certain label, outside the base spans."""
        graph = Graph(text, spans)
        if not graph.tokens:
            return []
        belief = self.beliefs(graph)
        best = np.where(graph.marked & (graph.label == 0) & (belief.max(axis=1) >= CERTAIN), belief.argmax(axis=1), 0)
        added: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(best):
            start, end = graph.places[i]
            token = graph.tokens[i]
            start, end = start + len(token) - len(token.lstrip("([<\"',;")), end - (len(token) - len(token.rstrip(")]>\"'.,;!?")))
            if start < end:
                added.append((int(best[i]) - 1, start, end))
        return added


def train(texts: list[str]) -> SkipChainField:
    """Node weights by softmax regression on the labels that the base patterns give, chain and skip potentials as
    log ratios of seen to expected label pairs. Without examples nothing is ever added."""
    graphs = [Graph(t, base_spans(t)) for t in texts]
    graphs = [g for g in graphs if g.tokens]
    size = len(KINDS) + 1
    weight = np.zeros((FEATURES, size))
    weight[:, 0] = 1.0
    pairs = {"chain": np.ones((size, size)), "skip": np.ones((size, size))}
    if graphs:
        seen = np.vstack([observe(g.tokens) for g in graphs])
        label = np.concatenate([g.label for g in graphs])
        target = np.eye(size)[label]
        weight = np.zeros((FEATURES, size))
        for _ in range(STEPS):
            score = weight[seen].sum(axis=1)
            score = np.exp(score - score.max(axis=1, keepdims=True))
            gap = target - score / score.sum(axis=1, keepdims=True)
            up = np.zeros_like(weight)
            for column in seen.T:
                np.add.at(up, column, gap)
            weight += RATE * (up / np.maximum(1, np.bincount(seen.ravel(), minlength=FEATURES))[:, None] - DECAY * weight)
        for g in graphs:
            for name, edges in (("chain", g.chain), ("skip", g.skip)):
                np.add.at(pairs[name], (g.label[edges[:, 0]], g.label[edges[:, 1]]), 1.0)
    potentials = [np.clip(np.log(p * p.sum() / np.outer(p.sum(axis=1), p.sum(axis=0))), -3, 3) for p in pairs.values()]
    return SkipChainField(weight, *potentials)


def learn(docs: DataFrame, text: str = "text", rows: int = SAMPLE_DOCS) -> SkipChainField:
    """Fit on a bounded sample of documents that hold a digit, an @ or a plus sign."""
    return train(bounded_sample(docs.where(F.col(text).rlike("[0-9@+]")).select(text), rows, text))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in angle brackets; where spans overlap, the first names the whole stretch."""
    out, at, name = [], 0, ""
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        name = KINDS[kind].upper()
        out += [text[at:s], f"<{name}>"]
        at = e
    return "".join(out) + text[at:]


SHAPE = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: SkipChainField, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the base counts, the digest of the base spans, and all spans.

    Edge cases: null and empty text has no spans; repeated rows give equal rows; offsets are code points; the time is
    in proportion to the text's length, whatever its runs of digits or letters.
    """
    def work(texts: list[str]) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in SHAPE.split(", ")}
        for t in texts:
            spans = base_spans(t) if MARK.search(t) else []
            more = field.further(t, spans) if MARK.search(t) else []
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[0] == k for s in spans))
            out["base_sha256"].append(hashlib.sha256(written(spans).encode()).hexdigest())
            out["spans"].append(written(spans + more))
        return out

    return add_columns(docs, keep, text, work, SHAPE, binary=False)


def redact(docs: DataFrame, field: SkipChainField, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind, and the ``length`` column, where there is one, set to
    the new length. Null text stays null; all other columns and rows stay as they are."""
    def work(texts: list[str]) -> dict:
        out = []
        for t in texts:
            spans = base_spans(t) if MARK.search(t) else []
            out.append(redacted(t, spans + field.further(t, spans)) if MARK.search(t) else t)
        return {"__redacted": out}

    done = add_columns(docs, docs.columns, text, work, "__redacted string", binary=False)
    done = done.withColumn(text, F.when(F.col(text).isNotNull(), F.col("__redacted"))).drop("__redacted")
    if length in docs.columns:
        done = done.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return done.select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, learn(docs), ["doc_id"])
