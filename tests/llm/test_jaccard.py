"""The shingle join against brute force, also where every bucket is crowded and dealt into pieces."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.llm import jaccard

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=4):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < size else frozenset(zip(*(w[i:] for i in range(size))))


def brute(rows, percent=85, size=4):
    sets = [shingle_set(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def families():
    """Families of near copies at every distance from the limit, texts that share passages of all lengths, short texts and one large group."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=300)
    out = []
    for family in range(40):
        base = rng.choices(words, k=rng.choice([3, 5, 9, 16, 31, 64, 70, 120, 260]))
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(text))
                text[at:at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            out.append(" ".join(text).title() if rng.random() < 0.2 else " ".join(text))
    for share in (0.2, 0.5, 0.8, 0.9, 0.93):  # different texts around one passage
        for _ in range(12):
            own = rng.choices(words, k=int(200 * (1 - share)))
            out.append(" ".join(passage[:int(200 * share)] + own))
    group = rng.choices(words, k=90)
    out += [" ".join(group[:i % 90] + [f"x{i}"] + group[i % 90 + 1:]) for i in range(60)]
    out += [None, "", " \n ", "one", "one", "One two", "one two three", "ünï ÜNÏ a", "ünï ÜNÏ A", out[0], out[0], "a " * 9000]
    return [(i if i % 17 else None, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("small,piece,common", [(32, 4096, 8), (2, 5, 2), (1, 3, 10_000)])
def test_equals_brute_force(spark, families, monkeypatch, small, piece, common):
    for name, value in (("SMALL", small), ("PIECE", piece), ("COMMON", common)):
        monkeypatch.setattr(jaccard, name, value)
    df = spark.createDataFrame([(k, t, "mine") for k, t in families], "doc_id long, text string, n_shingles string").repartition(6)
    assert found(jaccard.near_duplicates(df)) == brute(families)


def test_other_sizes_and_limits(spark, families):
    df = spark.createDataFrame(families, "doc_id long, text string")
    assert found(jaccard.near_duplicates(df, percent=80, size=5)) == brute(families, 80, 5)
    with pytest.raises(ValueError):
        jaccard.near_duplicates(df, percent=60)


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(jaccard.near_duplicates(documents)) == brute(rows)
    assert found(jaccard.near_duplicates(documents.limit(0))) == []
    assert found(jaccard.near_duplicates(documents.where(F.col("text").isNull()))) == [(900001, 0, 900001)]


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    none = jaccard.Common(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for size in [*range(1, 40), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for partner in {size, size * 100 // 85}:
            limit = 15 * (size + partner) // 185
            cut = min(size, (limit - (partner - size)) // 2)
            if cut < 0:
                continue
            b = np.unique(np.r_[a[cut:], rng.integers(0, 2**64, partner - size + cut, dtype=np.uint64)])
            differ = len(np.setxor1d(a, b))
            for band in set(jaccard.bands(len(a))) & set(jaccard.bands(len(b))):
                assert len(np.setdiff1d(jaccard.blocks(a, band), jaccard.blocks(b, band))) <= differ
                assert jaccard.allowed(len(a)) < 1 << band
            x, y = jaccard.one_bit(a), jaccard.one_bit(b)
            for width in {16, min(len(x), len(y))}:
                assert np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum() <= differ
            assert np.intersect1d(jaccard.signatures(a, none)[0], jaccard.signatures(b, none)[0]).size
