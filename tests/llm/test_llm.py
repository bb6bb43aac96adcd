"""Each operator against a brute-force version on the smallest tables with odd rows, and the pipeline against its parts."""

import gc
import hashlib
import json
import random
import struct
import re
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gapwise.llm import bpe, decontaminate, html, jaccard, langid, lm, overlap, pii, quality, sharding, simhash, suffix
from gapwise.llm.common import as_bytes, map_slices

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def rows(df, *key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [str(r[k]) for k in key])


def lowered(text):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")


def test_every_operator_is_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == [] and "pipeline" in entry.queries()


# ------------------------------------------------------------------ 1, near-duplicates

def brute_prints(texts):
    out = []
    for t in texts:
        w = WORD.findall(lowered(t))
        s = [] if not w else [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        out.append(sum(1 << b for b in range(64) if s and sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def brute_components(prints):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash_components(documents):
    docs = documents.collect()
    prints = brute_prints([d["text"] for d in docs])
    label, least = brute_components(set(prints)), {}
    for d, p in zip(docs, prints):
        if d["doc_id"] is not None:
            least[label[p]] = min(least.get(label[p], d["doc_id"]), d["doc_id"])
    want = sorted((str(d["doc_id"]), f"{p:016x}", least.get(label[p])) for d, p in zip(docs, prints))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect())
    assert got == want
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(least.values()))
    assert kept.count() == len(set(label.values()))


def test_bucket_links_connect_all_within_radius():
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(6)]
    members = np.array([c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centre for k in (0, 1, 2, 3, 4) for _ in range(60)], dtype=np.uint64)
    assert len(members) > simhash.SMALL_BUCKET
    pairs = simhash.bucket_links(members)
    assert len(pairs) < len(members) and all((int(members[a]) ^ int(members[b])).bit_count() <= 2 for a, b in pairs)
    forest = simhash._Forest(len(members))
    for a, b in pairs:
        forest.join(a, b)
    label = brute_components({int(m) for m in members})
    groups = defaultdict(set)
    for i, m in enumerate(members):
        groups[label[int(m)]].add(forest.root(i))
    assert all(len(g) == 1 for g in groups.values())


def test_chain_of_links_is_one_component(spark):
    prints = spark.createDataFrame([(i, (1 << 2 * i) - 1) for i in range(20)], "doc_id long, fingerprint long")
    assert {r["component_id"] for r in simhash.classes(prints).collect()} == {0}


def shingle_groups(texts):
    """Brute force: a label per text, equal where a chain of texts with a five-word similarity of 0.8 connects them."""
    sets = [set(shingle_counts(WORD.findall(lowered(t)))) if WORD.search(t or "") else {""} for t in texts]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and min(len(x), len(sets[j])) >= 0.8 * max(len(x), len(sets[j])) and len(x & sets[j]) >= 0.8 * len(x | sets[j]) - 1e-9:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    return label


@pytest.mark.parametrize("crowded", [jaccard.SMALL, 2])
def test_pipeline_dedup_equals_brute_force(spark, documents, sf, crowded, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", crowded)
    rng = random.Random(5)
    made = []
    for group in range(4):
        base = [f"g{group}w{rng.randrange(10 ** 6)}" for _ in range(150)]
        for k in (0, 1, 2, 3, 4, 6, 9, 14):  # changed words: from near copies to texts below 0.8
            changed = list(base)
            for at in rng.sample(range(150), k):
                changed[at] = f"n{rng.randrange(10 ** 6)}"
            made.append((600000 + len(made), " ".join(changed), "en", "x", 1, "mine"))
    passage = " ".join(f"p{i}" for i in range(40))
    made += [(610000 + i, passage + " " + " ".join(f"r{rng.randrange(10 ** 6)}" for _ in range(60)), "en", "x", 1, "mine") for i in range(20)]
    docs = documents.unionByName(spark.createDataFrame(made, documents.schema))
    all_rows = docs.collect()
    label, least = shingle_groups([r["text"] for r in all_rows]), {}
    for r, l in zip(all_rows, label):
        if r["doc_id"] is not None:
            least[l] = min(least.get(l, r["doc_id"]), r["doc_id"])
    want = sorted([str(v) for v in least.values()] + ["None" for l in set(label) if l not in least])
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_pipeline_dedup_links_by_simhash_variants(spark, documents, monkeypatch):
    """The stage takes its first links from the SimHash operator: similar texts within its radius, and no others."""
    words = [f"w{i}" for i in range(900)]
    made = [(700000 + i, " ".join(words[:at] + [f"n{i}"] + words[at + 1:]), "en", "x", 1, "mine") for i, at in enumerate((0, 899, 300, 600))]
    docs = spark.createDataFrame(made, documents.schema)
    prints = [simhash.fingerprint(r[1].encode().split(), overlap.SHINGLE) for r in made]
    assert any(0 < (a ^ b).bit_count() <= simhash.RADIUS for a in prints for b in prints)
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            if (a ^ b).bit_count() <= simhash.RADIUS:
                label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
    monkeypatch.setattr(jaccard, "text_links", lambda source, rows, percent, size, known: known)  # what SimHash alone links
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.count() == len(set(label)) < len(made)


# ------------------------------------------------------------------ 2, benchmark decontamination

def shingle_counts(words):
    return Counter([" ".join(words)] if len(words) < 5 else [" ".join(words[i:i + 5]) for i in range(len(words) - 4)])


def test_decontamination_finds_exact_and_near_items(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: WORD.findall(r["text"].lower()) for r in bench.collect()}
    texts = [(r["doc_id"], WORD.findall((r["text"] or "").lower())) for r in documents.collect()]
    first = next(iter(items))
    planted = [(800000, "before " + " ".join(items[first]).upper() + " after"), (800001, " ".join(items[first][:-1])), (800002, " ".join(items[first][: len(items[first]) // 2]))]
    texts += [(i, WORD.findall(t.lower())) for i, t in planted]
    docs = documents.unionByName(spark.createDataFrame([(i, t, "en", "x", 1, "mine") for i, t in planted], documents.schema))
    want = set()
    for doc, words in texts:
        whole = shingle_counts(words)
        for item, own in items.items():
            mine, n = shingle_counts(own), len(own)
            if not mine.keys() & whole.keys() and len(words) >= 5 <= n:
                continue
            for s in range(max(1, len(words) - n + 1)):
                there = shingle_counts(words[s:s + n])
                if sum((mine & there).values()) >= 0.8 * sum((mine | there).values()) and words:
                    want.add((doc, item))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and (800000, first) in got and (800001, first) in got
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len([1 for d, _ in texts if d in {x for x, _ in want}])


def test_decontamination_finds_items_in_another_order(spark):
    rng = random.Random(11)
    item = [f"i{k}" for k in range(60)]
    a, b = [f"x{k}" for k in range(100)], [f"y{k}" for k in range(100)]
    texts = {1: a + item[30:] + item[:30] + b, 2: a + item[20:40] + item[:20] + b + item[40:], 3: item[:50] + a, 4: a + item + b, 5: item[30:] + item[:27]}
    for doc in range(6, 30):  # pieces in any order, repeats and foreign words between
        cuts = [0, *sorted(rng.sample(range(60), rng.choice((1, 1, 2)))), 60]
        parts = [item[i:j] for i, j in zip(cuts, cuts[1:])] + [[f"z{rng.randrange(9)}"] * rng.choice((0, 0, 1))]
        rng.shuffle(parts)
        texts[doc] = a[:rng.choice((0, 3, 70))] + sum(parts, []) + b[:rng.choice((0, 2, 70))]
    mine, want = shingle_counts(item), {}
    for doc, words in texts.items():
        for s in range(max(1, len(words) - 59)):
            there = shingle_counts(words[s:s + 60])
            value = sum((mine & there).values()) / sum((mine | there).values())
            if value >= 0.8 and value > want.get(doc, (0, 0))[0] + 1e-12:
                want[doc] = (value, s)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "nothing of the kind in any of these texts")], "item_id long, text string")
    got = {r["doc_id"]: (r["similarity"], r["start"]) for r in decontaminate.matches(docs, bench).collect()}
    assert {1, 4} <= want.keys() and {d: s for d, (_, s) in got.items()} == {d: s for d, (_, s) in want.items()}
    assert all(abs(got[d][0] - want[d][0]) < 1e-9 for d in want) and abs(want[1][0] - 0.867) < 0.001
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == texts.keys() - want.keys()


def test_decontamination_of_short_items_and_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "tiny item"), (2, None), (3, "  ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see the Tiny  item there"), (2, "tiny thing"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.matches(docs, bench).collect()] == [(1, 1, 2)]
    assert decontaminate.matches(docs, bench.limit(0)).count() == decontaminate.matches(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ 3, repeated strings

def brute_repeats(texts, length=suffix.LENGTH):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i:i + length] = True
        out.append((len(t), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [suffix.CROWDED, 1])
def test_repeats_equal_brute_force(spark, documents, crowded):
    rng = random.Random(8)
    piece = "".join(rng.choice("abcdé ") for _ in range(260))
    extra = [(700000 + i, a + piece[i:i + 230] + b, "en", "x", 1, "mine") for i, (a, b) in enumerate((("x" * 150, "y" * 900), ("left ", " right"), ("", "z"), ("ab" * 300, "")))]
    docs = documents.where("coalesce(doc_id, 0) <> 900004").unionByName(spark.createDataFrame(extra, documents.schema))
    have = docs.collect()
    want = sorted((str(d["doc_id"]), *b) for d, b in zip(have, brute_repeats([(d["text"] or "").encode() for d in have])))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs, crowded=crowded).collect())
    assert got == want and sum(w[2] for w in want) > 1000


def test_suffix_array_orders_suffixes():
    rng = random.Random(5)
    for letters in ("ab", "a", "abcdefgh"):
        data = "".join(rng.choice(letters) for _ in range(700)).encode() + b"\xff" + b"banana" * 30 + b"\xff"
        order = suffix.suffix_array(np.frombuffer(data, dtype=np.uint8))
        pad = data + bytes([suffix.STOP]) * (suffix.LENGTH + 1)
        keys = [pad[i:i + suffix.LENGTH] for i in order]
        assert sorted(order.tolist()) == list(range(len(data)))
        whole = [k for i, k in zip(order, keys) if suffix.STOP not in data[i:i + suffix.LENGTH]]
        assert whole == sorted(whole)


# ------------------------------------------------------------------ 4, quality

def test_quality_counts_and_verdicts(spark, documents, sf):
    field = quality.learn(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    for r in quality.judge(documents, field, ["doc_id", "text"]).collect():
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(*(words[i:] for i in range(5))))
        inside = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(documents, field)
    assert kept.columns == documents.columns and {r[0] for r in kept.select("kept").collect()} == {"mine"}


def test_quality_separates_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    field = quality.learn(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, field, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert ((held["quality"] == 1) == held["kept"]).mean() > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        field = quality.LineField(rng.normal(size=3), rng.normal(size=(2, 2)))
        seen = rng.normal(size=(7, 3))
        emit = seen @ field.weight
        best = max(range(2 ** 7), key=lambda k: sum(emit[t] * (k >> t & 1) for t in range(7)) + sum(field.step[k >> t & 1, k >> t + 1 & 1] for t in range(6)))
        assert field.decode(seen) == [bool(best >> t & 1) for t in range(7)]


# ------------------------------------------------------------------ 5, personal data

def test_base_patterns():
    text = "a.b@c-d.org x@y @z.de 1.2.3.4 300.1.1.1 01.2.3.255 4539 1488 0343 6467 4539148803436468 +1 (574) 555-1575 +12 mail@host.example.com."
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [("email", "a.b@c-d.org"), ("email", "mail@host.example.com"), ("ip", "1.2.3.4"), ("ip", "01.2.3.255"),
                     ("phone", "+1 (574) 555-1575")] or ("card", "4539 1488 0343 6467") in found
    for t in [text, "@" * 50, "1" * 5000, "a" * 20000 + "@b.c", "a@b.c@d.e", "+1+2 345 678 90", "1.2.3.4.5.6.7.8.9"]:
        email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 6000 else None
        ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))] if len(t) < 6000 else None
        spans = pii.base_spans(t)
        assert email is None or [s[1:] for s in spans if s[0] == 0] == email
        assert ip is None or [s[1:] for s in spans if s[0] == 1] == ip


def test_repeated_tokens_share_labels():
    texts = [f"word {i} call +1 (574) 555-1{i % 10}75 now or write to person{i}@mail.example.com soon, as said +1 (574) 555-1{i % 10}75 or person{i}@mail.example.com" for i in range(60)] + [f"in {1900 + i} we sold {i} of them" for i in range(60)]
    field = pii.train(texts)
    text = "call +1 (574) 555-1275 now ... later 555-1275 again and in 1990 nothing"
    spans = pii.base_spans(text)
    added = field.further(text, spans)
    assert all(text[s:e] != "1990" for _, s, e in added)
    graph = pii.Graph(text, spans)
    assert len(graph.skip) == 1 and field.beliefs(graph).sum(axis=1) == pytest.approx(np.ones(len(graph.tokens)))
    alone = pii.SkipChainField(field.weight, field.chain, np.zeros((5, 5)))
    at = [i for i, t in enumerate(graph.tokens) if t == "555-1275"][-1]
    assert field.beliefs(graph)[at, 4] > alone.beliefs(graph)[at, 4]


def test_redaction_keeps_rows_and_columns(documents):
    field = pii.learn(documents)
    out, was = rows(pii.redact(documents, field), "doc_id", "text"), documents.collect()
    assert len(out) == len(was) and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in out)
    assert not any(pii.base_spans(r["text"]) for r in out if r["text"]) and sum("<EMAIL>" in (r["text"] or "") for r in out) >= 0
    found = pii.find(documents, field, ["doc_id", "text"])
    for r in found.collect():
        base = pii.base_spans(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest() and set(pii.written(base).split(",")) <= set(r["spans"].split(","))


# ------------------------------------------------------------------ 6, BPE

def test_bpe_equals_the_library(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(4)
    made = ["".join(rng.choice("ab'sé 1!Σ\x1c ") for _ in range(rng.randrange(40))) for _ in range(400)] + ["x<|endoftext|>y", "aaaaaaa" * 900]
    coder = bpe.automaton(open(bpe.default_vocabulary(), "rb").read())
    for text in made:
        ids = library.encode(text, add_special_tokens=False).ids
        packed, labels = coder.encode(text.encode())
        assert (memoryview(packed).cast("I").tolist() if packed else []) == ids and labels == library.decode(ids, skip_special_tokens=False)
    coded = bpe.tokenize(documents.select("doc_id", "text"))
    whole = {str(r["doc_id"]): r["text"] or "" for r in documents.collect()}
    for r in coded.collect():
        assert r["ids"] == library.encode(whole[str(r["doc_id"])], add_special_tokens=False).ids
    assert rows(bpe.decode(coded), "doc_id") == rows(coded.select("doc_id", F.col("decoded").alias("text")), "doc_id")
    for r in bpe.tokenize(documents, output="digest").collect():
        ids = library.encode(whole[str(r["doc_id"])], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.tokenize(documents.limit(0), output="digest").count() == bpe.decode(coded.limit(0)).count() == 0


def test_bpe_caches_turn_over(monkeypatch):
    """Words and arcs that fall out of the caches are settled again with the same result."""
    with open(bpe.default_vocabulary(), "rb") as file:
        spec = json.load(file)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abenrstü.") for _ in range(rng.randrange(1, 14))) for _ in range(60)).encode() for _ in range(30)]
    want = [bpe.Automaton(spec).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "WORD_CACHE", 5)
    monkeypatch.setattr(bpe, "ARC_CACHE", 7)
    small = bpe.Automaton(spec)
    assert [small.encode(t) for t in texts] == want and len(small.known) <= 5 and len(small.arcs) <= 7


def test_pipeline_sends_texts_in_small_batches(spark, sf):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 500) AS text")
    measure = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    try:
        assert dict(corpus_pipeline.STAGES)["encoding"](spark, docs, sf).columns == ["doc_id", "n_tokens", "ids", "decoded"]
        sent = [r["n"] for r in docs.mapInArrow(measure, "n long").collect()]
        assert sum(sent) > 16_000_000 and max(sent) < 4_000_000
        spark.conf.set(corpus_pipeline.BATCH_KEY, "64m")  # a session's own choice stays
        dict(corpus_pipeline.STAGES)["encoding"](spark, docs, sf)
        assert spark.conf.get(corpus_pipeline.BATCH_KEY).startswith("6")
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_KEY)


def test_bpe_remembers_ids_only():
    """A remembered word takes its own bytes, its ids and a place in the table."""
    coder = bpe.automaton(open(bpe.default_vocabulary(), "rb").read())
    texts = [" ".join(f"w{i}x{j}" for j in range(100)).encode() for i in range(200)]
    settled = [coder.encode(t)[0] for t in texts[:20]]
    coder.known, coder.older = {}, {}
    gc.collect()
    tracemalloc.start()
    for t in texts:
        coder.encode(t)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(coder.known) == 20_000 and taken < 200 * 20_000
    assert [coder.encode(t)[0] for t in texts[:20]] == settled


def test_a_worker_lets_the_automaton_go_with_the_next_operator():
    """Spark gives idle workers to later stages, so what one operator built must not stay in the memory of the next."""
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    content = open(bpe.default_vocabulary(), "rb").read()
    batch = pa.RecordBatch.from_arrays([pa.array(["some words", None])], names=["text"])
    coded = lambda b: {"n": [len(bpe.automaton(content).encode(t)[0]) // 4 for t in as_bytes(b.column(0))]}
    other = lambda b: {"n": [len(t) for t in as_bytes(b.column(0))]}
    held = [list(map_slices(Frame(), coded, "n long")(iter([batch]))) and weakref.ref(bpe.automaton(content)) for _ in range(2)]
    assert held[0]() is held[1]() is not None  # tasks of one operator share it
    assert list(map_slices(Frame(), other, "n long")(iter([batch])))[0].column(0).to_pylist() == [10, 0]
    assert held[0]() is None


# ------------------------------------------------------------------ 7, language

def test_suffix_automaton_phrases():
    rng = random.Random(6)
    for _ in range(40):
        text = "".join(rng.choice("abc") for _ in range(60))
        query = "".join(rng.choice("abcd") for _ in range(30))
        count, at = 0, 0
        while at < len(query):
            size = 1
            while at + size < len(query) and query[at:at + size + 1] in text:
                size += 1
            count, at = count + 1, at + size
        assert langid.SuffixAutomaton(text).phrases(query) == count


def test_new_words_are_cut_together(monkeypatch):
    rng = random.Random(8)
    word = lambda low, high: "".join(rng.choice("abcdXY,é") for _ in range(rng.randint(low, high)))
    learned = {k: " ".join(rng.choice(letters) * rng.randint(1, 3) + rng.choice(letters) for _ in range(400)) for k, letters in (("p", "abc"), ("q", "bcdé"), ("r", "axy"))}
    texts = [" ".join(word(1, 9) for _ in range(40)) for _ in range(60)] + ["", "  ", "12 ,", f"ab {word(200, 300)} Ab, AB"]
    model = langid.Model(learned)
    want = []
    for text in texts:
        runs = [f" {r} " for w in text.split() for r in langid.LETTERS.findall(w.lower())]
        entropy = np.array([sum(a.phrases(r) for r in runs) for a in model.automata]) * model.weight / max(1, sum(map(len, runs)))
        best, second = np.sort(entropy)[:2]
        want.append((model.langs[int(np.argmin(entropy))], float(1 - best / second)) if runs else ("und", 0.0))
    cut, one = [], langid.SuffixAutomaton.phrases
    monkeypatch.setattr(langid.SuffixAutomaton, "phrases", lambda self, run: cut.append(run) or one(self, run))
    monkeypatch.setattr(langid, "GROUP_WORDS", 100)
    monkeypatch.setattr(langid, "GROUP_NEW", 7)
    assert list(model.predict([t.encode() for t in texts])) == want and {p for p, _ in want} >= {"q", "r", "und"}
    assert all(len(run) > langid.LONG_RUN for run in cut)  # before, every new word was cut by itself
    wide, many = [], langid.SuffixAutomaton.phrases_of
    monkeypatch.setattr(langid.SuffixAutomaton, "phrases_of", lambda self, chars, live: wide.append(chars.shape[1]) or many(self, chars, live))
    list(model.predict(["1".join(word(1, 9) for _ in range(90)).encode()]))
    assert len(wide) > 3 and max(wide) <= 7  # one word with many runs is not one array


def test_languages_of_held_out_documents(spark):
    got = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_edge_cases(documents):
    texts = langid.learn(documents.limit(0))
    assert {r["lang_pred"] for r in langid.identify(documents, texts, ["doc_id"]).collect()} == {"und"}
    out = {r["doc_id"]: r for r in langid.identify(documents, {"en": " the of and "}, ["doc_id"]).collect()}
    assert [out[900000 + i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und", "und", "und", "en"] and out[900005]["score"] == 1.0


# ------------------------------------------------------------------ 8, shards

def test_shards(documents):
    out = sharding.assign(documents).toPandas()
    texts = {str(r["doc_id"]): r["text"] for r in documents.collect()}
    assert len(out) == documents.count() and set(out["shard"]) == set(range(8))
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    place = defaultdict(set)
    for r in out.itertuples():
        text = texts[str(int(r.doc_id)) if r.doc_id == r.doc_id else "None"]
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        place[text].add(r.shard)
    assert all(len(p) == 1 for p in place.values())
    load = sharding.schedule([(7, "a"), (5, "b"), (4, "c"), (4, "d"), (2, "e")], 2)
    assert load == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert sharding.assign(documents.limit(0)).count() == 0


# ------------------------------------------------------------------ 9, language model

def test_scores(documents):
    docs = documents.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
    have = docs.collect()
    tokens = [lowered(d["text"]).encode().split() + [b""] for d in have]
    counts = Counter(w for d, t in zip(have, tokens) if not d["held_out"] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(d["doc_id"]), len(t), sum(counts[w] > 0 for w in t), total, sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)) for d, t in zip(have, tokens))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score(docs, docs.where("not held_out"), ["doc_id"]).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(g[5] < 0 for g in got)
    none = lm.score(docs, docs.limit(0), ["doc_id"]).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == r["n_known"] == 0 for r in none)


def test_network_learns_and_is_normalised():
    rng = np.random.default_rng(1)
    ids = [0]
    for _ in range(20_000):
        ids.append((ids[-1] * 3 + 1) % 7 if rng.random() < 0.9 else int(rng.integers(7)))
    ids = np.array(ids)
    model = lm.LogBilinear()
    model.train(ids[2:], ids[1:-1], ids[:-2])
    table = model.table()
    assert np.allclose((10.0 ** table[::50, ::50]).sum(axis=2), 1, atol=1e-4)
    unigram = np.log10(np.bincount(ids, minlength=7) / len(ids))
    assert table[ids[:-2], ids[1:-1], ids[2:]].mean() > unigram[ids[2:]].mean() + 0.2


def test_network_learns_from_every_training_text(spark):
    texts = ["a b c"] * 3 + [" ".join(f"w{i % 7}" for i in range(at, at + 9)) for at in range(2500)] + [None, "", "A"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    single = {b"a": 0, b"b": 1, lm.END: 2}
    got = {(r["context"], r["word"]): r["n"] for r in lm.context_counts(docs.repartition(3), single).collect()}
    want = Counter()
    for t in texts:
        ids = [single.get(w, -1) if w in single else lm.word_class(w) for w in [*(t or "").lower().encode().split(), lm.END]]
        past = [lm.START, lm.START, *ids]
        want.update(((past[i] * (lm.OUTPUTS + 1) + past[i + 1]), w) for i, w in enumerate(ids))
    assert got == want
    flat = [(c, w, n) for (c, w), n in want.items()]
    model = lm.LogBilinear()
    model.start(np.bincount([w for _, w, _ in flat], [n for *_, n in flat], lm.OUTPUTS))
    columns = [np.array(v) for v in zip(*flat)]
    for _ in range(lm.STEPS):
        model.step(model.gradient(*columns) / sum(want.values()))
    learned = lm.learn(docs, single)
    assert all(np.allclose(getattr(model, k), getattr(learned, k)) for k in lm.WEIGHTS)


def test_steps_read_blocks_of_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 3)
    monkeypatch.setattr(lm, "GROUP", 5)
    monkeypatch.setattr(lm, "HELD", 40)
    rng = random.Random(9)
    docs = spark.createDataFrame([(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))),) for _ in range(300)] + [(None,)], "text string")
    counts = lm.context_counts(docs.repartition(2), {b"a": 0, lm.END: 1})
    want = {(r["context"], r["word"]): r["n"] for r in counts.collect()}
    rows = lm.packed(counts).collect()
    assert len(rows) < len(want) / 3  # before, every step read a row for each count
    got = Counter()
    for r in rows:
        context, cell, n = np.frombuffer(r["context"], np.int32), np.frombuffer(r["cell"], np.int32), np.frombuffer(r["n"], np.int64)
        assert 0 < len(set(context.tolist())) == len(context) <= 3 and len(cell) == len(n)
        for c, k in zip(cell.tolist(), n.tolist()):
            got[int(context[c // lm.OUTPUTS]), c % lm.OUTPUTS] += k
    assert got == want and sum(got.values()) == sum(len((r["text"] or "").split()) + 1 for r in docs.collect())
    assert len(list(lm.blocks(np.empty(0, int), np.empty(0, int), np.empty(0, int)))) == 0


# ------------------------------------------------------------------ 10, pages

def test_blocks_of_broken_markup():
    found = [b[0] for b in html.blocks("<p>a<b>b</b>c<br>d &amp; &eacute;<p>y<ul><li>1<li>2</ul><!-- z --><script>q</p></script>t<style>s")]
    assert found == ["abc", "d & é", "y", "1", "2", "t"]
    assert html.blocks("") == [] and [b[0] for b in html.blocks("plain < text")] == ["plain < text"]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, "u", "<nav>only</nav>")], pages.schema)
    model = html.learn(pages.where("page_id % 2 = 0"))
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    right = total = 0
    for r in html.extract(pages.unionByName(odd), model, ["page_id", "url"]).collect():
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in (-1, -2, -3):
            assert r["text"] == ""
        elif r["page_id"] % 2:
            found, good = html.teacher(texts[r["page_id"]])
            total, right = total + 1, right + (r["text"] == " ".join(b[0] for b, y in zip(found, good) if y))
    assert right / total > 0.98


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    model, pages = html.BlockLabeller(), [rng.normal(size=(n, html.INPUT)) for n in (3, 5)]
    label = [np.array([1.0, 0, 1]), np.array([0.0, 0, 1, 1, 0])]

    def loss():
        inputs, mask = model.padded(pages)
        chance = model.chances(inputs, mask, True)
        target, _ = model.padded([np.repeat(y[:, None], html.INPUT, 1) for y in label])
        y = target[:, :, 0]
        return -((y * np.log(chance) + (1 - y) * np.log(1 - chance)) * mask).sum() / mask.sum(), (chance - y) * mask / mask.sum(), inputs

    _, gap, inputs = loss()
    up = model.ahead.backward(inputs, (gap[:, :, None] * model.output["w"])[:, :, :html.HIDDEN])
    for name, at in (("x", (3, 5)), ("h", (2, 20)), ("b", (17,))):
        w = model.ahead.weights[name]
        w[at] += 1e-5
        above = loss()[0]
        w[at] -= 2e-5
        below = loss()[0]
        w[at] += 1e-5
        assert up[name][at] == pytest.approx((above - below) / 2e-5, abs=1e-6)


# ------------------------------------------------------------------ the pipeline

def test_pipeline_equals_its_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [r for r in docs.collect() if quality.verdicts([(r["text"] or "").encode()], field)[0][-1]]
    least = {}
    for r, l in zip(kept, shingle_groups([r["text"] for r in kept])):
        least[l] = min(least.get(l, r["doc_id"]), r["doc_id"])
    one = [r for r in kept if r["doc_id"] in set(least.values())]
    items = [shingle_counts(WORD.findall(r["text"].lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        words = WORD.findall(text.lower())
        whole = shingle_counts(words)
        for mine in items:
            if not mine.keys() & whole.keys():
                continue
            n = sum(mine.values()) + 4
            for s in range(max(1, len(words) - n + 1)):
                there = shingle_counts(words[s:s + n])
                if sum((mine & there).values()) >= 0.8 * sum((mine | there).values()):
                    return True
        return False

    want = {r["doc_id"] for r in one if not leaks(r["text"])}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == want and 4 <= len(corpus_pipeline.STAGES) <= 5
    coder = bpe.automaton(open(bpe.default_vocabulary(), "rb").read())
    for r in one:
        if r["doc_id"] in out and not pii.MARK.search(r["text"]):
            packed, labels = coder.encode(r["text"].encode())
            assert out[r["doc_id"]]["ids"] == memoryview(packed).cast("I").tolist() and out[r["doc_id"]]["decoded"] == labels
