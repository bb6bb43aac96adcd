"""Language identification by cross-parsing: the language whose texts cut a new text into the fewest phrases."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import as_bytes, crc_mod, distinct_texts, hash_share, map_slices, table, words_of

#: Bounds of the labelled sample that the automata are built from: rows and characters of each language.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 60_000
#: Words whose phrase counts a worker remembers; it starts anew when full.
WORD_CACHE = 400_000
#: Words of a group of texts (one text may have more), and new words or runs of letters, that are worked on at once.
GROUP_WORDS, GROUP_NEW = 200_000, 20_000
#: Longer runs of letters are cut one by one: too few share their last steps.
LONG_RUN = 64
#: Over any code point: a state and a character as one number.
CHARS = 1 << 21
LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


class SuffixAutomaton:
    """All substrings of one text as a deterministic automaton (arcs only; that is all cross-parsing needs).

    The arcs are held twice: by state, for one text, and as sorted numbers, for many short texts at once.
    """

    def __init__(self, text: str) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.arcs)
            self.arcs.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and c not in self.arcs[at]:
                self.arcs[at][c] = new
                at = link[at]
            if at != -1:
                to = self.arcs[at][c]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    copy = len(self.arcs)
                    self.arcs.append(dict(self.arcs[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at != -1 and self.arcs[at].get(c) == to:
                        self.arcs[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        keys = np.array([at * CHARS + ord(c) for at, arcs in enumerate(self.arcs) for c in arcs], dtype=np.int64)
        targets = np.array([to for arcs in self.arcs for to in arcs.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = np.append(keys[order], -1), np.append(targets[order], 0)  # the last one is never a match
        self.first = len(self.arcs[0])

    def phrases(self, text: str) -> int:
        """Number of pieces when each piece is the longest match; a character never seen is a piece of its own."""
        arcs, root, at, count = self.arcs, self.arcs[0], 0, 0
        for c in text:
            to = arcs[at].get(c)
            if to is None:
                count += 1
                to = root.get(c, 0)
                if at and not to:
                    count += 1
            at = to
        return count + (at != 0)

    def phrases_of(self, chars: np.ndarray, live: list[int]) -> np.ndarray:
        """``phrases`` of many texts: code points as [position, text], of which the first ``live[position]`` texts have one there."""
        at, count = np.zeros(chars.shape[1], dtype=np.int64), np.zeros(chars.shape[1], dtype=np.int64)
        for row, n in zip(chars, live):
            c, old = row[:n], at[:n]
            key = old * CHARS + c
            place = np.searchsorted(self.keys[:-1], key)
            to = self.targets[place]
            miss = np.flatnonzero(self.keys[place] != key)
            seen = np.searchsorted(self.keys[:self.first], c[miss])
            again = np.where(self.keys[seen] == c[miss], self.targets[seen], 0)
            count[miss] += 1 + ((old[miss] != 0) & (again == 0))
            to[miss] = again
            at[:n] = to
        return count + (at != 0)


class Model:
    """One automaton per language and the phrase counts of the words met so far."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[lang]) for lang in self.langs]
        self.weight = np.array([math.log2(max(2, len(texts[lang]))) for lang in self.langs])
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.counts = np.zeros((1024, len(self.langs) + 1))

    def _phrases(self, runs: list[str]) -> np.ndarray:
        """[run, language]: the phrases of every run."""
        found = np.empty((len(runs), len(self.langs)))
        size = np.array([len(r) for r in runs], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        long = int((size > LONG_RUN).sum())
        for i in order[:long]:
            found[i] = [a.phrases(runs[i]) for a in self.automata]
        for low in range(long, len(runs), GROUP_NEW):  # one word may have any number of runs
            short = order[low:low + GROUP_NEW]
            width = size[short]
            chars = np.zeros((len(short), width[0]), dtype=np.int64)
            chars[np.arange(width[0]) < width[:, None]] = np.frombuffer("".join([runs[i] for i in short]).encode("utf-32-le"), dtype="<u4")
            live = np.searchsorted(-width, -np.arange(width[0])).tolist()
            chars = np.ascontiguousarray(chars.T)
            for k, automaton in enumerate(self.automata):
                found[short, k] = automaton.phrases_of(chars, live)
        return found

    def _learn(self, words: list[bytes]) -> None:
        """Remember the phrase counts of words not met before; equal runs of letters are cut once."""
        place: dict[str, int] = {}
        run_of, word_of = [], []
        for i, word in enumerate(words):
            for r in LETTERS.findall(word.decode("utf-8", "replace").lower()):
                run_of.append(place.setdefault(f" {r} ", len(place)))
                word_of.append(i)
        runs = list(place)
        each = np.column_stack([self._phrases(runs), [len(r) for r in runs]])[run_of]
        low = len(self.place)
        while low + len(words) > len(self.counts):
            self.counts = np.vstack([self.counts, np.zeros_like(self.counts)])
        for k in range(each.shape[1]):
            self.counts[low:low + len(words), k] = np.bincount(word_of, each[:, k], len(words))
        self.place.update(zip(words, range(low, low + len(words))))

    def predict(self, texts: list[bytes]) -> Iterator[tuple[str, float]]:
        """The language and score of every text. New words are cut a group of texts at a time."""
        at = 0
        while at < len(texts):
            group, n = [], 0
            while at < len(texts) and (not group or n < GROUP_WORDS):
                group.append(words_of(texts[at]))
                n += len(group[-1])
                at += 1
            if len(self.place) > WORD_CACHE:
                self.clear()
            new = list(set().union(*group).difference(self.place))
            for low in range(0, len(new), GROUP_NEW):
                self._learn(new[low:low + GROUP_NEW])
            for words in group:
                yield self._verdict(words)

    def _verdict(self, words: list[bytes]) -> tuple[str, float]:
        """Fewest phrases, each worth log2 of the language's text size, per character; ties go to the first name.

        The score is how far the winner is below the next language, as a share of the latter.
        """
        found = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        total = self.counts[found].sum(axis=0)
        if not total[-1] or not self.langs:
            return UNKNOWN, 0.0
        entropy = total[:-1] * self.weight / total[-1]
        order = np.argsort(entropy, kind="stable")
        best = entropy[order[0]]
        return self.langs[order[0]], float(1 - best / entropy[order[1]]) if len(order) > 1 and entropy[order[1]] else 1.0


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Text per language from a bounded sample: about ``rows`` different texts of each language, chosen by a hash of the
    text, as lower-case letter runs padded by spaces, until ``chars`` characters. Rows without label or text are left out.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    texts: dict[str, str] = {}
    for row in sorted(known.groupBy("lang").count().collect()):
        own, have = known.where(F.col("lang") == row["lang"]), ""
        chosen = own.where(hash_share(F.xxhash64("text"), rows, row["count"])).select(F.substring("text", 1, chars).alias("text"))
        for body in distinct_texts(chosen, 2 * rows):
            if len(have) < chars:
                have = (have + " " + " ".join(LETTERS.findall(body.lower())) + " ")[:chars]
        if have.strip():
            texts[row["lang"]] = have
    return texts


_BUILT: dict[int, Model] = {}


def identify(docs: DataFrame, texts: dict[str, str], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score of every row, from the text alone.

    Edge cases: null text or text without a letter is ``und`` with score 0, as is everything when nothing was
    learned; with one learned language the score is 1; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most SAMPLE_CHARS characters of each language
    name = zlib.crc32(repr(sorted(texts.items())).encode())
    fields = [f for f in docs.schema.fields if f.name in keep]

    def work(batch: pa.RecordBatch) -> dict:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Model(shared.value)
        said = list(_BUILT[name].predict(as_bytes(batch.column("__text"))))
        return {f.name: batch.column(f.name) for f in fields} | {"lang_pred": [s[0] for s in said], "score": [s[1] for s in said]}

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    source = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text).alias("__text"))
    return map_slices(source, work, f"{shape}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    texts = learn(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), texts, ["doc_id", "held_out"])
