"""Main text of web pages: a bidirectional LSTM labels every text block from its tag path, its words and its neighbours."""

from __future__ import annotations

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import as_text, bounded_sample, map_slices, table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
MARKS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}

#: Sizes of the network and bounds of its training sample.
PATH, WORDS, NUMBERS, HIDDEN = 64, 16, 4, 12
INPUT = PATH + WORDS + NUMBERS
SAMPLE_PAGES, LONGEST, BATCH, PASSES, RATE = 300, 48, 32, 12, 0.01
#: Pages whose blocks go through the network together.
TOGETHER = 64


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, tag path, share of linked characters) of each text block, in page order. References are decoded, white
    space inside a block becomes one space; an element that is never closed ends with its parent, a paragraph or
    list item also with the next one."""
    out, stack, texts = [], [], []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            path = tuple(x for name, marks in stack if name not in INLINE for x in (name, *marks))
            out.append((text, path, min(1.0, linked / len(text))))
        texts.clear()
        linked = 0

    at, raw = 0, ""
    while at < len(page):
        if raw:
            found = re.compile(rf"</{raw}\b[^>]*>", re.I).search(page, at)
            at, raw = (found.end() if found else len(page)), ""
            continue
        found = TAG.search(page, at)
        piece = page[at:found.start() if found else len(page)]
        if piece:
            texts.append(piece)
            if any(name == "a" for name, _ in stack):
                linked += len(piece)
        if not found:
            break
        at = found.end()
        shut, name, attributes = found[1] or found[4], (found[2] or found[5] or "").lower(), found[3] or found[6] or ""
        if not name:
            continue
        if name not in INLINE:
            close()
        if shut:
            names = [n for n, _ in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name):]
        elif name in RAW:
            raw = "" if attributes.endswith("/") else name
        elif name not in VOID and not attributes.endswith("/"):
            if name not in INLINE:
                inner = [n for n, _ in stack]
                if name == "li" and "li" in inner and inner[::-1].index("li") < (inner[::-1].index("ul") if "ul" in inner else len(inner)):
                    del stack[len(inner) - 1 - inner[::-1].index("li"):]
                elif "p" in inner:
                    del stack[len(inner) - 1 - inner[::-1].index("p"):]
            marks = tuple(dict.fromkeys(w for m in MARKS.finditer(attributes) for w in NAME.findall((m[1] or m[2] or m[3] or "").lower())))
            stack.append((name, marks))
    close()
    return out


def features(found: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray:
    """One row per block: hashed tag path (the innermost step counts more), hashed words, length, links, place."""
    rows = np.zeros((len(found), INPUT), dtype=np.float32)
    for i, (text, path, linked) in enumerate(found):
        for step in path:
            rows[i, zlib.crc32(step.encode()) % PATH] = 1.0
        words = text.split(" ")
        counts = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        rows[i, PATH:PATH + WORDS] = counts / len(words)
        rows[i, PATH + WORDS:] = np.log1p(len(words)) / 5, linked, i / len(found), text[-1] in ".!?"
    return rows


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction. Inputs come as (steps, pages, INPUT); a mask of 0 keeps the state."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.weights = {"x": rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)), "h": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), "b": np.zeros(4 * HIDDEN)}
        self.weights["b"][HIDDEN:2 * HIDDEN] = 1.0

    def forward(self, inputs: np.ndarray, mask: np.ndarray, remember: bool = False) -> np.ndarray:
        steps, pages, _ = inputs.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out = np.zeros((steps, pages, HIDDEN))
        self.trace = []
        ready = inputs @ self.weights["x"] + self.weights["b"]
        for t in range(steps):
            gates = ready[t] + h @ self.weights["h"]
            i, f, o = (sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            h_new = m * (o * np.tanh(c_new)) + (1 - m) * h
            if remember:
                self.trace.append((h, c, i, f, o, g, c_new, m))
            h, c = h_new, c_new
            out[t] = h
        return out

    def backward(self, inputs: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        up = {k: np.zeros_like(v) for k, v in self.weights.items()}
        dh, dc = np.zeros_like(slope[0]), np.zeros_like(slope[0])
        for t in range(len(slope) - 1, -1, -1):
            h, c, i, f, o, g, c_new, m = self.trace[t]
            dh = dh + slope[t]
            tanh = np.tanh(c_new)
            dcell = dc * m + dh * m * o * (1 - tanh ** 2)
            gates = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * m * tanh * o * (1 - o), dcell * i * (1 - g ** 2)], axis=1)
            up["x"] += inputs[t].T @ gates
            up["h"] += h.T @ gates
            up["b"] += gates.sum(axis=0)
            dh, dc = gates @ self.weights["h"].T + dh * (1 - m), dcell * f + dc * (1 - m)
        return up


class BlockLabeller:
    """Both directions and a logistic output per block."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.output = {"w": rng.normal(0, 0.1, 2 * HIDDEN), "s": np.zeros(INPUT), "b": np.zeros(1)}

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        inputs, mask = np.zeros((steps, len(pages), INPUT)), np.zeros((steps, len(pages)))
        for i, rows in enumerate(pages):
            inputs[:len(rows), i] = rows
            mask[:len(rows), i] = 1
        return inputs, mask

    def chances(self, inputs: np.ndarray, mask: np.ndarray, remember: bool = False) -> np.ndarray:
        both = np.concatenate([self.ahead.forward(inputs, mask, remember), self.back.forward(inputs[::-1], mask[::-1], remember)[::-1]], axis=2)
        self.both = both
        return sigmoid(both @ self.output["w"] + inputs @ self.output["s"] + self.output["b"][0])

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 3) -> None:
        """Cross entropy by back-propagation through time, Adam, mini-batches."""
        rng = np.random.default_rng(seed)
        groups = [self.ahead.weights, self.back.weights, self.output]
        moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in g.items()} for g in groups]
        count = 0
        for _ in range(PASSES):
            order = rng.permutation(len(pages))
            for start in range(0, len(order), BATCH):
                at = order[start:start + BATCH]
                inputs, mask = self.padded([pages[i] for i in at])
                target, _ = self.padded([np.repeat(labels[i][:, None], INPUT, 1) for i in at])
                gap = (self.chances(inputs, mask, True) - target[:, :, 0]) * mask / mask.sum()
                slope = gap[:, :, None] * self.output["w"]
                ups = [self.ahead.backward(inputs, slope[:, :, :HIDDEN]), self.back.backward(inputs[::-1], slope[::-1, :, HIDDEN:]),
                       {"w": np.einsum("tp,tph->h", gap, self.both), "s": np.einsum("tp,tpi->i", gap, inputs), "b": np.array([gap.sum()])}]
                count += 1
                for group, up, moment in zip(groups, ups, moments):
                    for k, g in up.items():
                        m, v = moment[k]
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        group[k] -= RATE * (m / (1 - 0.9 ** count)) / (np.sqrt(v / (1 - 0.99 ** count)) + 1e-8)

    def content(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for content blocks; pages of like length share a batch, whole sequences always."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        for start in range(0, len(order), TOGETHER):
            at = order[start:start + TOGETHER]
            inputs, mask = self.padded([pages[i] for i in at])
            chance = self.chances(inputs, mask)
            for k, i in enumerate(at):
                out[i] = chance[:len(pages[i]), k] >= 0.5
        return out


#: Ways in which pages mark what is not the article, as opening tags; fixed values for the training layouts.
APART = ["<nav>", "<header>", "<footer>", "<aside>", "<form>", '<div class="ad">', '<div class="advert">', '<div class="ads banner">',
         '<div class="sponsored promo">', '<section class="comments">', '<div id="comments">', '<div class="comment">', '<div class="cookie-notice">',
         '<div class="notice">', '<div id="sidebar">', '<div class="sidebar">', '<div class="menu">', '<ul class="menu">', '<div class="share social">',
         '<div class="related">', '<div class="newsletter">', '<div class="footer">', '<div id="header">', '<div class="breadcrumb">',
         '<div class="consent">', '<div role="navigation">', '<div role="complementary">', "<button>", '<div class="popup">', '<div class="login">']
AROUND = ["<article>", "<main>", '<article class="post">', '<main><article>', '<div class="content">', '<div id="content">', '<div class="article">',
          '<div id="main">', '<div class="post entry">', '<div role="main">', '<section class="story">']


def teacher(page: str) -> tuple[list, np.ndarray]:
    """Blocks of a page and whether each is inside an article or main element, but not inside what stands apart there."""
    found = blocks(page)
    apart = {"nav", "header", "footer", "aside", "form", "ad", "ads", "advert", "comments", "comment", "sidebar", "menu", "notice"}
    return found, np.array([float(bool({"article", "main"} & set(p)) and not apart & set(p)) for _, p, _ in found])


def layout(body: list[str], other: list[str], rng: random.Random) -> tuple[str, list[float]]:
    """A page of known labels: article blocks in a random frame, other blocks in random frames before, inside and after it."""
    def shut(opening: str) -> str:
        return "".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", opening)))

    def apart() -> None:
        opening = rng.choice(APART)
        texts = [rng.choice(other) for _ in range(rng.choice([1, 1, 2, 4]))]
        inner = rng.choice(["<p>", "<li>", "<div>", ""])
        texts = texts if inner else [" ".join(texts)]
        parts.append(opening + "".join(f"{inner}{html.escape(t)}{shut(inner)}" for t in texts) + shut(opening))
        labels.extend([0.0] * len(texts))

    parts, labels = ["<html><body>"], []
    for _ in range(rng.randrange(4)):
        apart()
    frame = rng.choice(AROUND)
    parts.append(frame)
    for i, text in enumerate(body):
        tag = "h1" if i == 0 else rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "div"])
        parts.append(f"<{tag}>{html.escape(text)}</{tag}>")
        labels.append(1.0)
        if rng.random() < 0.06:
            apart()
    parts.append(shut(frame))
    for _ in range(rng.randrange(4)):
        apart()
    return "".join(parts) + "</body></html>", labels


def train(pages: list[str], seed: int = 9) -> BlockLabeller:
    """Fit on the pages as they are and on layouts dealt from their blocks. Without pages a block needs an article around it to score."""
    rng = random.Random(seed)
    seen, labels, body, other = [], [], [], []
    for page in pages:
        found, own = teacher(page)
        if found:
            seen.append(features(found)[:LONGEST])
            labels.append(own[:LONGEST])
            body.append([t for (t, _, _), y in zip(found, own) if y])
            other += [t for (t, _, _), y in zip(found, own) if not y]
    body = [b for b in body if b]
    for _ in range(len(pages) if body and other else 0):
        mixed = other + [rng.choice(rng.choice(body)) for _ in range(len(other) // 2)]
        page, own = layout(rng.choice(body)[:rng.randrange(1, 30)], mixed, rng)
        found = blocks(page)
        if len(found) == len(own):
            seen.append(features(found)[:LONGEST])
            labels.append(np.array(own)[:LONGEST])
    model = BlockLabeller()
    if seen:
        model.train(seen, labels)
    return model


def learn(pages: DataFrame, column: str = "html", rows: int = SAMPLE_PAGES) -> BlockLabeller:
    return train(bounded_sample(pages.select(column), rows, column))


def extract(pages: DataFrame, model: BlockLabeller, keep: list[str], column: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars of every page.

    Edge cases: null, empty and tag-only pages have empty text; text without any tag is one block without path;
    repeated rows give equal rows; long pages are labelled as one sequence.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in pages.schema.fields if f.name in keep]
    shape = "".join(f"__keep{i} {f.dataType.simpleString()}, " for i, f in enumerate(fields))

    def work(batch: pa.RecordBatch) -> dict:
        found = [blocks(p) for p in as_text(batch.column("__html"))]
        good = shared.value.content([features(f) if f else np.zeros((0, INPUT)) for f in found])
        texts = [" ".join(t for (t, _, _), y in zip(f, g) if y) for f, g in zip(found, good)]
        return {f"__keep{i}": batch.column(f"__keep{i}") for i in range(len(fields))} | {"text": texts, "n_chars": [len(t) for t in texts]}

    source = pages.select(*[F.col(f"`{f.name}`").alias(f"__keep{i}") for i, f in enumerate(fields)], F.col(f"`{column}`").alias("__html"))
    out = map_slices(source, work, shape + "text string, n_chars long")
    return out.withColumnsRenamed({f"__keep{i}": f.name for i, f in enumerate(fields)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), learn(pages), ["page_id", "url"])
