"""Repair of conversation structure: the cheapest edits by iterative-deepening A* (Korf 1985).

A repaired conversation's role initials read ``(s?(ua)+)?``. Edits, in ASCII order of their initials: Delete 2, Insert 5,
Keep 0, Rerole 1. The search goes depth first in that order under a bound that rises to the least cost seen beyond it,
and remembers which (place, state) failed with how much left; so the first path that ends well is the cheapest, and
among equally cheap ones the least in ASCII.

Rows are put in order over all tasks by ranges, so no conversation has to fit a task. One that lies in one task and has
at most WHOLE rows is searched as it is. Longer ones are cut: for each chunk and each pair of states before and after it
the search gives the cheapest edits, and a search of the same kind over the chunks picks among them. An edit string
of a chunk ends with the edit of its last row, so none begins another, and the least string of the whole is made of least strings.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import table
from gapwise.session import write_stage

# The costs of the edits.
DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
#: Rows of a conversation searched as a whole, of a chunk of a longer one, and of a stretch of the lower bounds.
WHOLE, CHUNK, STRETCH = 1024, 128, 64
SPACE = "[^\\x20\\x09-\\x0D]"
#: States: nothing yet, after the system's row, after a user's, after an assistant's; FINE is the first fault of a row, or none.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
INITIALS = "suao"
Move = tuple[str, int, int, int]


def deepening(n: int, start: int, moves: Callable[[int, int], Iterable[Move]], goal: Callable[[int], bool], least: list[list[int]]) -> tuple[int, list[str]] | None:
    """(cost, labels) of the first cheapest path from (0, start) to (n, state with goal), or None.

    ``moves`` gives (label, cost, place, state) in the order of labels; ``least[i][state]`` is a lower bound from there on.
    """
    if n == 0 and goal(start):
        return 0, []
    bound = least[0][start]
    while bound < math.inf:
        failed: dict[tuple[int, int], int] = {}
        beyond, path, stack = math.inf, [], [(0, start, bound, iter(moves(0, start)))]
        while stack:
            i, state, left, rest = stack[-1]
            for label, cost, j, after in rest:
                budget = left - cost
                if budget < least[j][after]:
                    beyond = min(beyond, bound + least[j][after] - budget)
                elif failed.get((j, after), -1) < budget:
                    path.append(label)
                    if j == n and goal(after):
                        return bound - budget, path
                    stack.append((j, after, budget, iter(moves(j, after))))
                    break
            else:
                failed[i, state] = left
                stack.pop()
                if path:
                    path.pop()
        bound = beyond
    return None


def row_moves(rows: list[tuple[int, str]], tail: bool) -> Callable[[int, int], Iterator[Move]]:
    """Edits of (fault, initial) rows; with ``tail`` rows may be inserted after the last one."""
    def moves(i: int, state: int) -> Iterator[Move]:
        other = ASSISTANT if state == USER else USER
        if i < len(rows):
            yield "D", DELETE, i + 1, state
        if i < len(rows) or tail:
            yield "I", INSERT, i, other
        if i < len(rows) and rows[i][0] in (FINE, TRUNCATED):
            fault, initial = rows[i]
            more = CUT_SHORT if fault == TRUNCATED else 0
            if AFTER.get(initial) == other or initial == "s" and state == NOTHING:
                yield "K", more, i + 1, AFTER[initial]
            if AFTER.get(initial) != other:
                yield "R", REROLE + more, i + 1, other

    return moves


def lower_bounds(rows: list[tuple[int, str]], end: list[float], stretch: int) -> list[list[float]]:
    """By place and state: the exact cost to the end of a stretch of rows, and the least costs of the stretches after it."""
    out = [end]
    for i in range(len(rows) - 1, -1, -1):
        fault, initial = rows[i]
        after = out[-1] if (i + 1) % stretch and i + 1 < len(rows) or i + 1 == len(rows) else [min(out[-1])] * 4
        cost = []
        for state in range(4):
            other, best = ASSISTANT if state == USER else USER, DELETE + after[state]
            if fault in (FINE, TRUNCATED):
                more = CUT_SHORT if fault == TRUNCATED else 0
                best = min(best, more + after[other] + (0 if AFTER.get(initial) == other else REROLE))
                if initial == "s" and state == NOTHING:
                    best = min(best, more + after[SYSTEM])
            cost.append(best)
        user, assistant = cost[USER], cost[ASSISTANT]
        shifted = min(INSERT + user, 2 * INSERT + assistant)
        out.append([min(cost[NOTHING], shifted), min(cost[SYSTEM], shifted), min(user, INSERT + assistant), min(assistant, INSERT + user)])
    return out[::-1]


def cheapest(rows: list[tuple[int, str]]) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    cost, path = deepening(len(rows), NOTHING, row_moves(rows, True), lambda s: s in (NOTHING, ASSISTANT), lower_bounds(rows, [0, 2 * INSERT, INSERT, 0], STRETCH))
    return cost, "".join(path)


def chunk_table(rows: list[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) for every pair of states that a chunk can join."""
    out, moves = [], row_moves(rows, False)
    for after in range(4):
        least = lower_bounds(rows, [0 if s == after else math.inf for s in range(4)], len(rows))
        for before in range(4):
            if least[0][before] < math.inf:
                cost, path = deepening(len(rows), before, moves, lambda s: s == after, least)
                out.append((before, after, cost, "".join(path)))
    return out


def cheapest_of_chunks(tables: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, edits) of a conversation from the tables of its chunks."""
    def moves(i: int, state: int) -> list[Move]:
        if i == len(tables):
            return [("I", INSERT, i, ASSISTANT if state == USER else USER)]
        return sorted((edits, cost, i + 1, after) for before, after, cost, edits in tables[i] if before == state)

    least = [[0, 2 * INSERT, INSERT, 0]]
    for t in reversed(tables):
        rest = min(least[-1])
        least.append([min((cost + rest for before, _, cost, _ in t if before == state), default=math.inf) for state in range(4)])
    cost, path = deepening(len(tables), NOTHING, moves, lambda s: s in (NOTHING, ASSISTANT), least[::-1])
    return cost, "".join(path)


def named(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) with null roles and texts as one space."""
    fill = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), fill(role).alias("role"), fill(text).alias("text"))


def _order(*more: str) -> list[Column]:
    return [F.col("conv").asc_nulls_first(), *map(F.col, more), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("h").asc_nulls_first()]


def _marks(rows: DataFrame) -> DataFrame:
    """What the search needs of every row, without its text: place in the order, initial and first fault."""
    own = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "tie")
    marks = rows.select("conv", "turn", "role", F.md5("text").alias("h"), F.monotonically_increasing_id().alias("tie"),
                        (~F.col("text").rlike(SPACE)).alias("blank"),
                        (~F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", "").rlike("[.!?]\\z")).alias("cut"))
    marks = write_stage(marks, "marks").frame  # the ties are final
    first = marks.groupBy("conv", "role", "h").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first")).where("n > 1")
    first = first.toDF("conv_", "role_", "h_", "n", "first")
    joined = marks.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("h") == F.col("h_")), "left")
    fault = F.when(F.col("blank"), BLANK).when(own > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    return joined.select("conv", "turn", "role", "h", "tie", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _count(rows: list[tuple[int, str]]) -> list[int]:
    faults = [f for f, _ in rows]
    return [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)] + [sum(a + b not in ("su", "ua", "au") for (_, a), (_, b) in zip(rows, rows[1:]))]


def _solved(rows: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    marks = _marks(rows)
    kind = rows.schema["conv"].dataType.simpleString()
    shape = f"conv {kind}, part int, chunk int, whole boolean, first string, last string, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, edits array<struct<b:int,a:int,c:long,e:string>>"
    names = ["conv", "part", "chunk", "whole", "first", "last", *COUNTS, "cost", "audit", "edits"]
    ordered = marks.repartitionByRange(*_order(), F.col("tie")).sortWithinPartitions(*_order(), "tie").select("conv", "fault", "initial")
    to_pylist = lambda batch, columns: zip(*[batch.column(c).to_pylist() for c in columns])

    def typed(out: list[tuple], schema: pa.Schema, conv: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema.set(0, pa.field("conv", conv)))

    numbers = [pa.field(c, pa.int64()) for c in [*COUNTS, "cost"]]
    edits = pa.list_(pa.struct([("b", pa.int32()), ("a", pa.int32()), ("c", pa.int64()), ("e", pa.string())]))
    schema = pa.schema([("conv", pa.null()), ("part", pa.int32()), ("chunk", pa.int32()), ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()),
                        *numbers, ("audit", pa.string()), ("edits", edits)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv_type = TaskContext.get().partitionId(), None
        conv, held, chunk, edge, begun = None, [], 0, True, False  # edge: the conversation may have begun in another task

        def pieces(whole: bool) -> Iterator[tuple]:
            nonlocal held, chunk
            if whole:
                yield (conv, part, 0, True, held[0][1], held[-1][1], *_count(held), *cheapest(held), None)
            else:
                for s in range(0, len(held), CHUNK):
                    rows, chunk = held[s:s + CHUNK], chunk + 1
                    edits = [dict(zip("bace", x)) for x in chunk_table(rows)]
                    yield (conv, part, chunk, False, rows[0][1], rows[-1][1], *_count(rows), None, None, edits)
            held = []

        for batch in batches:
            out, conv_type = [], batch.schema.field("conv").type
            for own, fault, initial in to_pylist(batch, ["conv", "fault", "initial"]):
                if held and own != conv:
                    out += pieces(not edge and not chunk)
                if own != conv:
                    edge, chunk = conv is None and edge and not begun, 0
                elif len(held) == WHOLE:
                    out += pieces(False)
                conv, begun = own, True
                held.append((fault, initial))
            yield typed(out, schema, conv_type)
        if held:
            yield typed(list(pieces(False)), schema, conv_type)

    pieces = ordered.mapInArrow(cut, shape)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, conv_type = None, [], None

        def whole() -> tuple:
            counts = [sum(r[6 + i] for r in held) for i in range(4)]
            counts[3] += sum(a[5] + b[4] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
            if held[0][3]:
                cost, audit = held[0][10:12]
            else:
                cost, audit = cheapest_of_chunks([[(e["b"], e["a"], e["c"], e["e"]) for e in r[12]] for r in held])
            return (conv, None, None, None, None, None, *counts, cost, audit, None)

        for batch in batches:
            out, conv_type = [], batch.schema.field("conv").type
            for row in to_pylist(batch, names):
                if held and row[0] != conv:
                    out.append(whole())
                    held = []
                conv = row[0]
                held.append(row)
            yield typed(out, schema, conv_type)
        if held:
            yield typed([whole()], schema, conv_type)

    dealt = pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "chunk")
    return dealt.mapInArrow(join, shape).select("conv", *COUNTS, "cost", "audit")


def _applied(rows: DataFrame, plans: DataFrame, digest: bool) -> DataFrame:
    """The edits of ``plans`` (conv, audit) carried out: the repaired rows, or with ``digest`` the SHA-256 of their
    ``role:text`` lines. A conversation's plan comes first and its texts pass by in order; none is held."""
    kind = rows.schema["conv"].dataType.simpleString()
    texts = rows.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", F.md5("text").alias("h"), "text")
    void = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role")]
    plan = plans.select("conv", F.lit(0).alias("kind"), "audit", *void, F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("text"))
    met = plan.unionByName(texts).repartition("conv").sortWithinPartitions(*_order("kind")).select("conv", "audit", "role", "text")
    columns = ["conv", "sha"] if digest else ["conv", "place", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, sha = None, None, 0, NOTHING, 0, None

        def made(role: str, text: str) -> None:
            nonlocal state, place
            state = AFTER[role[0]]
            if digest:
                sha.update((("\n" if place else "") + f"{role}:{text}").encode())
            else:
                out.append((conv, place, role, text))
            place += 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                made("assistant" if state == USER else "user", "")
                at += 1

        def ended() -> None:
            inserted()
            if digest:
                out.append((conv, sha.hexdigest()))

        def batch_of(conv_type: pa.DataType) -> pa.RecordBatch:
            types = [conv_type, pa.string()] if digest else [conv_type, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=columns)

        conv_type = None
        for batch in batches:
            out, conv_type = [], batch.schema.field("conv").type
            for own, plan, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")]):
                if plan is not None:
                    if audit is not None:
                        ended()
                    conv, audit, at, state, place, sha = own, plan, 0, NOTHING, 0, hashlib.sha256()
                    continue
                if audit is None or own != conv:  # nobody asked for this conversation
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    made(role, text)
                elif edit == "R":
                    made("assistant" if state == USER else "user", text)
            yield batch_of(conv_type)
        if audit is not None:
            out = []
            ended()
            yield batch_of(conv_type)

    return met.mapInArrow(run, f"conv {kind}, sha string" if digest else f"conv {kind}, place long, role string, text string")


def _plans(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Everything but the texts: a row for each of ``conversations`` (conv)."""
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv", "conv_")
    solved = _solved(rows).withColumnRenamed("conv", "conv__")
    out = conversations.distinct().join(gaps, F.col("conv").eqNullSafe(F.col("conv_")), "left").join(solved, F.col("conv").eqNullSafe(F.col("conv__")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return write_stage(out.select("conv", zero("gaps"), *map(zero, COUNTS), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit")), "plans").frame


def repaired(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows (conversation, place, role, text), places from 0; edge cases as in ``repairs``."""
    own = named(rows, conversation, turn, role, text)
    return _applied(own, _plans(own, own.select("conv")), False).withColumnRenamed("conv", conversation)


def repairs(rows: DataFrame, conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each of ``conversations``.

    Edge cases: null roles and texts are one space; null conversations are one conversation; null turns come first; rows
    of one turn are ordered by role, then by the MD5 of the text, so repeated rows are neighbours and all but one of them
    duplicates; a conversation without rows has zeros, no edits and the hash of an empty text; an empty table gives no
    rows; rows of conversations that are not asked for and further columns are ignored. A conversation's texts pass by one at a time; its edits (a letter a row) are one value.
    """
    own = named(rows, conversation, turn, role, text)
    plans = _plans(own, conversations.select(F.col(f"`{conversation}`").alias("conv")))
    sha = _applied(own, plans, True).toDF("conv_", "repaired_sha256")
    return plans.join(sha, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_").withColumnRenamed("conv", conversation)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut, repeated or given to the user, by the hash of conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fill = lambda c: F.coalesce(F.col(c), F.lit(" "))
    fate = F.crc32(key) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(fill("text"), "[.!?]", "")).otherwise(fill("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(fill("role"))
    kept = rows.select("conv_id", "turn", "role", "text", fate.alias("fate")).where("fate != 0")
    twice = F.explode(F.sequence(F.lit(0), F.when(F.col("fate") == 3, 1).otherwise(0)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repairs(damaged(rows), rows)


def _insert(state: str, role: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': ({state}).c + 5, 'a': ({state}).a || 'I', 'o': ({state}).o || chr(10) || '{role}:'}} END"


def _edit(state: str, when: str, cost: str, letter: str, out: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': ({state}).c + {cost}, 'a': ({state}).a || '{letter}', 'o': ({state}).o{out}}} END"


def _oracle() -> str:
    role = lambda r: f" || chr(10) || {r} || ':' || x.text"
    good, more = "x.fault IN (0, 3)", "(CASE WHEN x.fault = 3 THEN 5 ELSE 0 END)"
    drop = lambda s: _edit(s, "TRUE", "2", "D", "")
    keep = lambda s, i: _edit(s, f"{good} AND x.initial = '{i}'", more, "K", role("x.role"))
    rerole = lambda s, i, name: _edit(s, f"{good} AND x.initial <> '{i}'", f"1 + {more}", "R", role(f"'{name}'"))
    to_user = ", ".join(f(s) for s in ("y.z", "y.s", "y.a") for f in (lambda s: keep(s, "u"), lambda s: rerole(s, "u", "user")))
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        [4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fate FROM conversations, crc),
g AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fate <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM g),
x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN min(i) OVER (PARTITION BY conv_id, role, text) < i THEN 2
                     WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
             CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
d AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS z, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS s,
             NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, i, list_min([{drop('y.z')}]), list_min([{drop('y.s')}, {keep('y.z', 's')}]), list_min([{drop('y.u')}, {to_user}]),
             list_min([{drop('y.a')}, {keep('y.u', 'a')}, {rerole('y.u', 'a', 'assistant')}])
      FROM (SELECT d.conv_id, x.i, d.z, d.s, list_min([d.u, {', '.join(_insert(f'd.{q}', 'user') for q in 'zsa')}]) AS u,
                   list_min([d.a, {_insert('d.u', 'assistant')}, {_insert('(' + _insert('d.z', 'user') + ')', 'assistant')}, {_insert('(' + _insert('d.s', 'user') + ')', 'assistant')}]) AS a, x
            FROM d JOIN x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND x.i = d.i + 1) y),
e AS (SELECT conv_id, list_min([z, a, {_insert('u', 'assistant')}, {_insert('(' + _insert('s', 'user') + ')', 'assistant')}]) AS e FROM d
      QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(substr(e.o, 2)) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
