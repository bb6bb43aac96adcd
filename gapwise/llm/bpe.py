"""BPE as a deterministic automaton over pre-split words.

Merges are compiled one after the other. The automaton starts with one state per base symbol and all arcs
open. The gadget of merge k, (a, b) -> c, does three things: it adds a state for c that starts as a copy of
b's state as it is then; it closes the arc b behind a; and it opens the arc c wherever the arc a is open. An
arc table of 49k x 49k cells would be mostly unused, so the gadgets are kept as arrays (parts and rank of each
token) and an arc is settled from them on first use, then stored in the transition table.
A word has exactly one path through the automaton, which is the merge-by-rank result. So has each of its prefixes:
the walk takes the longest token first, steps back where no arc is open, and never enters a place twice.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import as_bytes, held, map_slices, table

#: Words, and settled arcs, that a worker remembers; when full they become the older half, which is dropped next.
WORD_CACHE = 300_000
ARC_CACHE = 1_000_000
#: Stands behind the last byte of a word; no UTF-8 text holds it.
END = b"\xff"
#: Spells the token of the byte END itself, which no text holds either.
NEVER = b"\xfe\xfe"
#: White space of the word pattern, as Unicode defines it.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BASE = -1
LETTERS = string.ascii_lowercase


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Automaton:
    """Vocabulary, merge gadgets, arcs settled so far, and a trie of the tokens over base symbols."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        cut = "|".join(sorted(map(regex.escape, (s.decode() for s in self.special)), key=len, reverse=True))
        self.cut = regex.compile(f"({cut})".encode()) if cut else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE))
        symbols = byte_symbols()
        self.whole_letters = all(self.split.findall(a + LETTERS) == [a + LETTERS] for a in LETTERS)
        symbols = byte_symbols()
        spelled = {vocab[s]: bytes([b]) for b, s in enumerate(symbols)}
        spelled[vocab[symbols[END[0]]]] = NEVER
        spelled |= {vocab[s + suffix]: bytes([b]) + END for b, s in enumerate(symbols)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.parts[c], self.rank[a, b] = (a, b, k), k
            spelled[c] = spelled[a] + spelled[b]
        self.by_spelling = {s: t for t, s in spelled.items()}
        # trie over bytes, a node named by its spelling: the tokens that start there, the longest first
        self.ways: dict[bytes, tuple[int, ...]] = {b"": ()}
        for way in sorted(spelled.values()):
            for n in range(1, len(way) + 1):
                if way[:n] not in self.ways:
                    here = self.by_spelling.get(way[:n])
                    self.ways[way[:n]] = (() if here is None else (here,)) + self.ways[way[:n - 1]]
        self.states = 1 + max(self.token)
        self.length = [len(spelled.get(t, b"")) for t in range(self.states)]
        self.packed = [t.to_bytes(4, "little") for t in range(self.states)]
        self.arcs: dict[int, bool] = {}
        self.older_arcs: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def settle(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state`` once all gadgets are in place; written to the transition table."""
        arc = state * self.states + token
        is_open = self.older_arcs.get(arc)
        if is_open is None:
            is_open = self._open_before(state, token, len(self.rank))
        if len(self.arcs) >= ARC_CACHE:
            self.arcs, self.older_arcs = {}, self.arcs
        self.arcs[arc] = is_open
        return is_open

    def _open_before(self, state: int, token: int, time: int) -> bool:
        """The same, with the gadgets of merges below ``time`` only."""
        parts, rank = self.parts, self.rank
        while True:
            if rank.get((state, token), time) < time:
                return False
            of_state, of_token = parts.get(state), parts.get(token)
            born_state, born_token = of_state[2] if of_state else BASE, of_token[2] if of_token else BASE
            if born_state == born_token == BASE:
                return True
            if born_token >= born_state:  # the token's gadget opened its arc where its left part was open
                token, time = of_token[0], born_token + 1
            else:  # the state's gadget copied the state of its right part
                state, time = of_state[1], born_state

    def starting(self, word: bytes, at: int) -> Iterator[int]:
        """Tokens that are spelled from ``at`` on, the longest first."""
        ways, size = self.ways, len(word)
        to = min(at + 3, size)
        way = ways.get(word[at:to])
        while way is None:
            to -= 1
            way = ways.get(word[at:to])
        while to < size:
            to += 1
            longer = ways.get(word[at:to])
            if longer is None:
                break
            way = longer
        return iter(way)

    def path(self, word: bytes) -> list[int]:
        """Ids of a word whose last byte is END. A place left behind lies on no path to the end, so it stays closed."""
        size, length, states, arcs = len(word), self.length, self.states, self.arcs
        out: list[int] = []
        ways, closed, at, row = [self.starting(word, 0)], set(), 0, BASE
        while at < size:
            for token in ways[-1]:
                to = at + length[token]
                if to in closed:
                    continue
                if row != BASE:
                    is_open = arcs.get(row + token)
                    if is_open is None:
                        is_open = self.settle(out[-1], token)
                        arcs = self.arcs
                    if not is_open:
                        continue
                out.append(token)
                at, row = to, token * states
                if at < size:
                    ways.append(self.starting(word, at))
                break
            else:
                closed.add(at)
                ways.pop()
                at -= length[out.pop()]
                row = out[-1] * states if out else BASE
        return out

    def word(self, piece: bytes) -> bytes:
        """Ids (little-endian, 32 bits each) of a piece without ASCII white space. Only they are remembered, the labels are read off a text's ids."""
        found = self.older.get(piece)
        if found is None:
            if piece.isalpha() and self.whole_letters:  # ASCII letters: nothing to compose, one part
                parts = [piece.lower()]
            else:
                text = unicodedata.normalize("NFC", piece.decode())
                text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
                parts = [part.encode() for part in self.split.findall(text)]
            ids: list[int] = []
            for part in parts:
                token = self.by_spelling.get(part + END)
                ids += self.path(part + END) if token is None else [token]
            found = b"".join([self.packed[i] for i in ids])
        if len(self.known) >= WORD_CACHE:
            self.known, self.older = {}, self.known
        self.known[piece] = found
        return found

    def labels(self, ids: list[int]) -> str:
        """Decoding: the arc labels of the ids; this vocabulary joins them by a space."""
        return " ".join(map(self.token.__getitem__, ids))

    def encode(self, text: bytes) -> tuple[bytes, str]:
        """Ids and labels of a whole text. White space never joins words, so pieces are encoded one by one."""
        ids, known = [], self.known.get
        for at, segment in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]):
            if at % 2:
                ids.append(self.packed[self.special[segment]])
                continue
            for piece in segment.split():
                found = known(piece)
                if found is None:
                    found = self.word(piece)
                    known = self.known.get
                ids.append(found)
        joined = b"".join(ids)
        return joined, self.labels(np.frombuffer(joined, dtype="<u4").tolist())


def automaton(content: bytes) -> Automaton:
    """The automaton of a tokenizer file, built once per worker process and held while the worker's tasks ask for it."""
    return held(hashlib.sha256(content).hexdigest(), lambda: Automaton(json.loads(content)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, output: str = "ids") -> DataFrame:
    """Encode and decode every whole text.

    output "ids": (key, ids array<int>, decoded string). output "digest": (key, n_tokens, ids_sha256,
    decoded_sha256), made in the same pass. ``vocabulary`` is a tokenizer file that the driver reads (a fixed
    few MB, broadcast); workers build the automaton from it once.
    Edge cases: null and empty text have no ids and decode to empty text; special tokens in a text are
    recognised as such; repeated rows give repeated rows; further columns are ignored.
    """
    with open(vocabulary or default_vocabulary(), "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        coder = automaton(content.value)
        coded = [coder.encode(t) for t in as_bytes(batch.column(1))]
        if output == "ids":
            ends = np.cumsum([0, *(len(i) // 4 for i, _ in coded)], dtype=np.int32)
            ids = np.frombuffer(b"".join([i for i, _ in coded]), dtype="<i4")  # no Python number per id
            return {key: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), "decoded": [d for _, d in coded]}
        return {key: batch.column(0), "n_tokens": [len(i) // 4 for i, _ in coded],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in coded],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in coded]}

    shape = "ids array<int>, decoded string" if output == "ids" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(docs.select(F.col(key), F.col(text)), work, f"`{key}` {kind}, {shape}")


def decode(rows: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, text) of id lists; null lists decode to empty text."""
    with open(vocabulary or default_vocabulary(), "rb") as file:
        content = rows.sparkSession.sparkContext.broadcast(file.read())
    kind = rows.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        coder = automaton(content.value)
        return {key: batch.column(0), "text": [coder.labels(i or []) for i in batch.column(1).to_pylist()]}

    return map_slices(rows.select(key, ids), work, f"`{key}` {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), output="digest")
