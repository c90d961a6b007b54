"""Conversation repair against every possible edit of short conversations, a plain search on whole tables, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import xxhash
from pyspark.sql import functions as F

from aquabill.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
SOUND = re.compile(r"(s?(ua)+)?")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def order(row):
    _, turn, role, text = row
    h1 = xxhash.xxh64_intdigest(text.encode(), 42)
    h2 = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"second", 42))
    return (turn is not None, turn or 0, role, signed(h1), signed(h2))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def kinds(rows):
    """(row, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for r in sorted(rows, key=order):
        shown = r[3].strip(SPACE)
        out.append((r, "blank" if not shown else "duplicate" if r[2:] in seen else "truncated" if shown[-1] not in ".!?" else ""))
        seen.add(r[2:])
    return out


def choices(row, fault):
    """(cost, letter, what stays) of a row."""
    out = [(2, "D", None)]
    if fault not in ("blank", "duplicate"):
        more = 5 if fault == "truncated" else 0
        out += [(more, "K", row[2:]), (1 + more, "R", ("user", row[3])), (1 + more, "R", ("assistant", row[3]))]
    return out


def every_edit(told):
    """By trying everything, with two turns put in at each place at most."""
    gaps = [[*itertools.product(("user", "assistant"), repeat=k)] for k in range(3)]
    gaps = [g for k in gaps for g in k]
    best = None
    for edit in itertools.product(gaps, *[x for row, fault in told for x in (choices(row, fault), gaps)]):
        cost, audit, turns = 5 * len(edit[0]), "I" * len(edit[0]), [(r, "") for r in edit[0]]
        for k in range(1, len(edit), 2):
            c, letter, stays = edit[k]
            cost, audit = cost + c + 5 * len(edit[k + 1]), audit + letter + "I" * len(edit[k + 1])
            turns += ([stays] if stays else []) + [(r, "") for r in edit[k + 1]]
        if SOUND.fullmatch("".join(r[:1] for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, turns
    return best


def searched(told):
    """By the shortest prefix of each role pattern, row by row."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def put_in(best):
        for _ in range(2):
            for q, (c, w, t) in list(best.items()):
                for role in ("user", "assistant"):
                    if (r := step[q].get(role[0])) and (c + 5, w + "I") < best.get(r, (1 << 60,))[:2]:
                        best[r] = c + 5, w + "I", [*t, (role, "")]
        return best

    best = put_in({"": (0, "", [])})
    for row, fault in told:
        new = {}
        for q, (c, w, t) in best.items():
            for cost, letter, stays in choices(row, fault):
                r = q if not stays or not stays[0] else step[q].get(stays[0][0])
                if r is not None and (c + cost, w + letter) < new.get(r, (1 << 60,))[:2]:
                    new[r] = c + cost, w + letter, t + ([stays] if stays else [])
        best = put_in(new)
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def report(rows, solve):
    out = []
    for conv in {r[0] for r in rows}:
        told = kinds(damaged([r for r in rows if r[0] == conv]))
        turns = {r[1] for r, _ in told} - {None}
        count = {f: sum(x == f for _, x in told) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][2][:1] + b[0][2][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, kept = solve(told)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def ran(spark, rows, parts=3):
    turns = frame(spark, rows).repartition(parts)
    got = C.repair(C.damage(turns), turns, digest=True)
    assert got.columns == ["conv_id", *C.REPORT, "audit", "repaired_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def made(n_convs, longest, seed):
    rng, rows = random.Random(seed), []
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "no", "Well?", "", " \n", "ok!", "Yes.", None, "É.  \n"]
    for conv in [None, *range(n_convs)]:
        for _ in range(rng.randrange(longest + 1)):
            rows.append((conv, rng.choice([None, *range(longest + 2)]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_equals_every_edit(spark):
    rows = made(60, 3, 1)
    small = {c for c in {r[0] for r in rows} if len(damaged([r for r in rows if r[0] == c])) <= 3}
    own = [r for r in rows if r[0] in small]
    assert report(own, every_edit) == report(own, searched) == ran(spark, own)


def test_long_conversations_over_many_parts(spark, monkeypatch):
    rows = made(40, 9, 2) + [(77, i // 2, r[2], r[3]) for i, r in enumerate(made(300, 6, 3))] + [(78, 5, "user", "Same."), (79, None, "assistant", "x. " * 50_000)] * 30
    want = report(rows, searched)
    assert ran(spark, rows) == want
    monkeypatch.setattr(C, "SPAN", 3)
    monkeypatch.setattr(C, "FAN", 2)
    solver, rng = C.Solver(), random.Random(4)
    for _ in range(50):  # spans of any length give the same
        pattern = "".join(rng.choice("DsuaxeSUAXE") for _ in range(rng.randrange(1, 40)))
        whole = {p: C.lightest([C.EDITS[k] for k in pattern], p) for p in C.STATES}
        assert solver.derive(pattern, False) == whole
        assert solver.derive(pattern, True)[0].items() >= {min(((q, whole[0][q]) for q in C.GOALS if q in whole[0]), key=lambda x: x[1])}


def test_query_equals_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.op11(spark, sf_dir).collect()), key=str) == report(rows, searched)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (1, 2, "assistant", "cut"), (1, 2, "assistant", "Yes."), (2, 4, "tool", " "), (3, 1, "assistant", "Only.")]
    got = C.repair(frame(spark, rows).withColumns({"place": F.lit("x"), "kind": F.lit(9)}))
    assert got.columns == ["conv_id", "place", "role", "text"]
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r["conv_id"], r["place"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert by == {1: [("user", "More?"), ("assistant", "Yes.")]}  # letters DK.. come before KD..
    assert C.repair(frame(spark, []), frame(spark, []), digest=True).count() == 0
