"""Conversation repair against a brute-force search over all edits, and long conversations cut into chunks against the search of the whole."""

import hashlib
import heapq
import random
import re

import pytest

from gapwise.llm import dialogue

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Cheapest edits by uniform-cost search on (cost, edits); rows are (role, text) in order."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, initials, out = heapq.heappop(todo)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            break
        state = (i, initials[-1:] or "-")
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(todo, (cost + 5, audit + "I", i, initials + role[0], (*out, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, initials, out))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                heapq.heappush(todo, (cost + more, audit + "K", i + 1, initials + (role[:1] or "-"), (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(todo, (cost + more + 1, audit + "R", i + 1, initials + name[0], (*out, f"{name}:{text}")))
        todo = [t for t in todo if re.fullmatch("s?(ua)*u?", t[3])]
        heapq.heapify(todo)
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return (*[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), out)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "why", "  ", "", "So? ", "and then\x1c", "Ünï.\n", ".", "a.b"]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "umpire"]
    out = {}
    for k in range(70):
        out[k] = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 7))]
    out[None] = [("system", "Hi."), ("user", "Go."), ("assistant", "Gone.")]
    return out


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def frame(spark, conversations):
    rows = [(k, i * 2 if i or k != 3 else None, role, text, "mine") for k, c in conversations.items() for i, (role, text) in enumerate(c)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string").repartition(3)


@pytest.mark.parametrize("whole,chunk", [(1024, 128), (4, 2)])
def test_equals_brute_force(spark, conversations, monkeypatch, whole, chunk):
    monkeypatch.setattr(dialogue, "WHOLE", whole)
    monkeypatch.setattr(dialogue, "CHUNK", chunk)
    df = frame(spark, conversations)
    want = {k: brute(c) for k, c in conversations.items()}
    assert found(dialogue.repairs(df, df)) == {k: w[:-1] for k, w in want.items()}
    rows = {}
    for r in dialogue.repaired(df).orderBy("conv_id", "place").collect():
        rows.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert rows == {k: list(w[-1]) for k, w in want.items() if w[-1]}


def test_chunks_give_the_search_of_the_whole():
    rng = random.Random(4)
    for n in [1, 2, 5, 9, 23, 40] * 6:
        rows = [(rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.choice("suauao")) for _ in range(n)]
        step = rng.randint(1, 6)
        assert dialogue.cheapest_of_chunks([dialogue.chunk_table(rows[i:i + step]) for i in range(0, n, step)]) == dialogue.cheapest(rows)


def test_nulls_repeats_and_empty_tables(spark):
    shape = "conv_id long, turn int, role string, text string"
    df = spark.createDataFrame([(1, None, None, None), (1, 5, "user", "A."), (1, 5, "user", "A."), (1, 9, "assistant", "B."), (2, None, "user", None), (2, None, "user", None)], shape)
    got = {r["conv_id"]: r for r in dialogue.repairs(df, df).collect()}
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["cost"], got[1]["audit"]) == (3, 1, 1, 4, "DKDK")
    assert (got[2]["gaps"], got[2]["blank"], got[2]["audit"]) == (0, 2, "DD") and got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    one = dialogue.repairs(df.where("conv_id = 1"), df.where("conv_id = 2")).collect()
    assert [tuple(r) for r in one] == [(2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogue.repairs(df.limit(0), df.limit(0)).collect() == [] and dialogue.repaired(df.limit(0)).collect() == []


def test_a_long_conversation(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(1400)]
    rows[500] = (7, 500, "tool", "Line.")
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    row = dialogue.repairs(df, df).first()
    assert (row["gaps"], row["illegal"], row["cost"], row["audit"]) == (0, 2, 1, "K" * 500 + "R" + "K" * 899)
