r"""Repair of conversation structure by Knuth's lightest derivations.

A conversation is sound if the initials of its roles read `(s?(ua)+)?`. Each turn is kept (K, cost 0), given the role user or
assistant (R, 1) or deleted (D, 2; the only choice for blank turns and repeats of an earlier turn), and turns without text
can be put in anywhere (I, 5); a truncated turn that is not deleted costs 5 more. The cheapest edits win, then those
whose letters come first in ASCII.

Items are (rows so far, state of the pattern) for a state that the conversation is entered with. A rule derives an item from a shorter one and
an edit of the next row, or an insertion; its function adds the costs and appends the letters, so it is superior: never below
what it is given, and monotone, because of two derivations of one item at one cost neither's letters begin the other's (letters
tell the rows that they use, and one more I costs 5). The agenda pops items by (cost, letters), and a popped item is final; it ends when the goals are.

Rows are sorted by conversation and turn in range partitions, so a conversation of any length is spread over tasks. A task
reduces its part of a conversation to the lightest derivation from each state to each state: SPAN rows at a time by the agenda over edits,
then FAN spans at a time by the same agenda over spans. Parts, one row for each task that holds a conversation, are joined in the same way. Copies of one row
are counted before the shuffle, and first occurrences are found by a partial aggregate, so neither needs a group in one task. The letters of
a conversation then meet its texts, sorted, in a stream that holds one row at a time; texts of one conversation pass one task, as they must for
one hash over them.

Defined results: null role or text is one blank, null conv_id is a conversation of its own, null turns come first. Rows of one turn
are in the order of their roles, then of a hash of their texts; equal rows are interchangeable. An empty role has no initial: keeping
it changes nothing. Roles that begin with other letters can only be changed or deleted. Very long texts are read whole. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES, GOALS = range(4), (0, 3)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
SPAN, FAN, MEMO = 64, 16, 20_000
LEGAL = ("su", "ua", "au")
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PLAN = "low: long, high: long, turns: long, blank: long, duplicate: long, truncated: long, illegal: long, first_role: string, last_role: string, costs: array<long>, audits: array<string>"
Derived = dict[int, dict[int, tuple[int, str]]]


def _edits(kind: str) -> Derived:
    """Of a row (initial, in upper case if truncated; e without one, x another one, D if it must go): the lightest edit between states."""
    out: Derived = {q: {q: (DELETE, "D")} for q in STATES}
    if kind == "D":
        return out
    more = TRUNCATED if kind.isupper() else 0
    ways = [(KEEP, "K", NEXT.get(kind.lower(), {q: q for q in STATES} if kind.lower() == "e" else {}))]
    ways += [(REROLE, "R", NEXT[role]) for role in "ua"]
    for cost, letter, step in ways:
        for q, r in step.items():
            out[q][r] = min(out[q].get(r, (1 << 60, "")), (cost + more, letter))
    return out


EDITS = {k: _edits(k) for k in "DsuaxeSUAXE"}
INSERTS = {q: [r for role in "ua" if (r := NEXT[role].get(q)) is not None] for q in STATES}


def lightest(parts: list[Derived], entry: int, goal: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """The lightest (cost, letters) from the state entry to each state over all parts, by Knuth's agenda; ends at the first state in goal."""
    agenda, final, goals = [(0, "", 0, entry)], set(), {}
    while agenda and len(goals) < len(STATES) and not any(q in goals for q in goal):
        cost, letters, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == len(parts):
            goals[q] = (cost, letters)
        else:
            for r, (c, more) in parts[i][q].items():
                if (i + 1, r) not in final:
                    heapq.heappush(agenda, (cost + c, letters + more, i + 1, r))
        for r in INSERTS[q]:
            if (i, r) not in final:
                heapq.heappush(agenda, (cost + INSERT, letters + "I", i, r))
    return goals


class Solver:
    """Lightest derivations of row kinds; keeps those of the short patterns that it has seen."""

    def __init__(self):
        self.memo: dict[tuple[str, bool], Derived] = {}

    def derive(self, pattern: str, whole: bool) -> Derived:
        """From each state to each state; only from the first one to the goal if the pattern is a whole conversation."""
        if len(pattern) <= SPAN:
            if (got := self.memo.get((pattern, whole))) is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                rows = [EDITS[k] for k in pattern]
                got = self.memo[pattern, whole] = {0: lightest(rows, 0, GOALS)} if whole else {p: lightest(rows, p) for p in STATES}
            return got
        return joined([self.derive(pattern[i : i + SPAN], False) for i in range(0, len(pattern), SPAN)])


def joined(parts: list[Derived]) -> Derived:
    """One part of neighbouring ones, FAN at a time."""
    while len(parts) > 1:
        parts = [{p: lightest(own, p) for p in STATES} if len(own := parts[i : i + FAN]) > 1 else own[0] for i in range(0, len(parts), FAN)]
    return parts[0]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after a damage that crc32 of conv_id:turn decides."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _told(turns: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    return rows.select("*", *[h.alias(n) for h, n in zip(common.text_hash(F.col("text")), ("h1", "h2"))])


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def faults(told: DataFrame) -> DataFrame:
    """Rows without their texts, each kind of row once: copies, blank, duplicate (an earlier turn says the same), open (truncated)."""
    end = F.rtrim(F.col("text"), F.lit(common.ASCII_SPACE))
    thin = told.select("conv_id", "turn", "role", "h1", "h2", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"))
    rows = thin.groupBy(*thin.columns).agg(F.count("*").alias("copies"))
    when = lambda: F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))  # noqa: E731  null turns first
    said = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min(when()).alias("first"), F.count("*").alias("times")).where("times > 1")
    said = said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x"), F.col("h2").alias("y"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))
    return rows.join(said, same, "left").select(*rows.columns, F.coalesce(when() > F.col("first"), F.lit(False)).alias("duplicate"))


class Part:
    """A run of rows of one conversation: counts, and the kinds of its rows."""

    def __init__(self, conv):
        self.conv, self.kinds = conv, []
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.first_role = self.last_role = None

    def add(self, turn, role: str, blank: bool, is_open: bool, copies: int, duplicate: bool) -> None:
        first = role[:1]
        if self.n and self.last_role + first not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # copies stand side by side
        self.first_role = first if self.first_role is None else self.first_role
        self.last_role = first
        self.n += copies
        if turn is not None:
            self.turns += turn != self.high  # rows come in order
            self.low = turn if self.low is None else self.low
            self.high = turn
        if blank or duplicate:
            self.kinds.append("D" * copies)
        else:
            kind = first if first in ("s", "u", "a") else "x" if first else "e"
            self.kinds.append((kind.upper() if is_open else kind) + "D" * (copies - 1))
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies if duplicate else copies - 1
        self.truncated += is_open and not blank and not duplicate

    def row(self, solver: Solver, whole: bool) -> dict:
        got = solver.derive("".join(self.kinds), whole)
        flat = [got.get(p, {}).get(q) for p in STATES for q in STATES]
        return {
            "low": self.low, "high": self.high, "turns": self.turns, "blank": self.blank,
            "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "first_role": self.first_role, "last_role": self.last_role,
            "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat],
        }


def _reduced(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row for each conversation of the partition; the first and the last one may go on elsewhere."""
    solver, place, part, first, out = Solver(), TaskContext.get().partitionId(), None, True, []
    for batch in batches:
        for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "open", "copies", "duplicate")]):
            if part is None or part.conv != conv:
                if part is not None:
                    out.append({"conv_id": part.conv, "place": place, "plan": part.row(solver, not first)})
                    first = False
                part = Part(conv)
            part.add(*row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if part is not None:
        out.append({"conv_id": part.conv, "place": place, "plan": part.row(solver, False)})
    yield pa.RecordBatch.from_pylist(out, schema)


def settled(plans: list[dict]) -> dict:
    """The report and the letters of a conversation, of the plans of its parts in order."""
    if not plans:
        return dict.fromkeys(REPORT, 0) | {"audit": ""}
    derived = joined([{p: {q: (x["costs"][4 * p + q], x["audits"][4 * p + q]) for q in STATES if x["costs"][4 * p + q] is not None} for p in STATES} for x in plans])
    cost, audit = min(derived[0][q] for q in GOALS if q in derived[0])
    total = {c: sum(x[c] for x in plans) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    total["illegal"] += sum(x["last_role"] + y["first_role"] not in LEGAL for x, y in zip(plans, plans[1:]))
    told = [x for x in plans if x["low"] is not None]
    total["turns"] -= sum(x["high"] == y["low"] for x, y in zip(told, told[1:]))
    turns = total.pop("turns")
    gaps = told[-1]["high"] - told[0]["low"] + 1 - turns if told else 0
    return total | {"gaps": gaps, "cost": cost, "audit": audit}


class Replay:
    """Applies the letters of a conversation to its rows, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _role(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = NEXT[role[0]][self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What stands in place of a row: turns put in before it, and what is left of it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[role[0]][self.state] if role else self.state
            yield role, text
        elif letter == "R":
            yield self._role(), text


def _replayed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    """Markers, plans and rows of each conversation, in this order, to its report and hash, or to its turns."""
    none = object()
    conv, plans, replay, told, sha, n, out, held = none, [], None, None, None, 0, [], 0

    def emit(turns: Iterator[tuple[str, str]]) -> None:
        nonlocal n, held
        for role, text in turns:
            if digest:
                sha.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                out.append({"conv_id": conv, "place": n, "role": role, "text": text})
                held += len(text)
            n += 1

    def start() -> None:
        nonlocal told, replay, sha, n
        told = settled(plans)
        replay, sha, n = Replay(told["audit"]), hashlib.sha256(), 0

    def finish() -> None:
        if conv is not none:
            if replay is None:
                start()
            emit(replay.inserted())
            if digest:
                out.append({"conv_id": conv, **told, "repaired_sha256": sha.hexdigest()})

    for batch in batches:
        for c, kind, plan, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "kind", "plan", "role", "text")]):
            if c != conv:
                finish()
                conv, plans, replay = c, [], None
            if kind == 1:
                plans.append(plan)
            elif kind == 2:
                if replay is None:
                    start()
                emit(replay.turns(role, text))
            if len(out) >= 1000 or held > common.PART_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    finish()
    yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repair(turns: DataFrame, every: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation after its repair, place counting from 0.

    With digest instead one row for each conv_id of turns and of every: (conv_id, REPORT, audit, repaired_sha256).
    """
    told = _told(turns)
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = faults(told).repartitionByRange(partitions, *_order()).sortWithinPartitions(*_order())
    parts, made = f"conv_id long, place int, plan struct<{PLAN}>", "conv_id long, place long, role string, text string"
    if digest:
        made = "conv_id long, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"
    plan_schema, out_schema = _arrow(parts), _arrow(made)
    plans = ordered.mapInArrow(lambda batches: _reduced(batches, plan_schema), parts)
    rows = plans.withColumn("kind", F.lit(1)).unionByName(told.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if every is not None:
        marks = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    first, *rest = _order()
    met = rows.repartition("conv_id").sortWithinPartitions(first, "kind", "place", *rest)
    return met.select("conv_id", "kind", "plan", "role", "text").mapInArrow(lambda batches: _replayed(batches, out_schema, digest), made)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(turns), turns, digest=True)


def faults_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11 that SQL can express."""
    return op11(spark, sf_dir).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")


# crc32 by its definition: eight steps a byte, over the ASCII letters of conv_id:turn.
_STEP = "list_reduce(list_prepend(xor(c, b::bigint), range(8)::bigint[]), lambda v, i: case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)"
_CRC = f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: ord(x)::bigint)), lambda c, b: {_STEP}))"
_SPACE = " ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) "
ORACLE = f"""with k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
c as (select *, ({_CRC}) % 20 as kind from k),
d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case kind when 3 then 2 else 1 end)) as copy from c where kind <> 0),
o as (select *, rtrim(text, {_SPACE}) as shown, row_number() over w as at, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as times, lag(role[1]) over w || role[1] as two
  from d window w as (partition by conv_id order by turn nulls first, role, copy)),
f as (select *, case when shown = '' then 'b' when times > 1 then 'd' when shown[-1] not in ('.', '!', '?') then 't' end as fault from o),
r as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
  count(*) filter (where fault = 't') as truncated, count(*) filter (where two is not null and two not in ('su', 'ua', 'au')) as illegal from f group by 1)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal
from (select distinct conv_id from conversations) a left join r on r.conv_id is not distinct from a.conv_id"""
