"""Conversation repair against a search over all edits, also where conversations reach over many runs, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from starfield.llm import queries, repair

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}
NEXT = {"n": "us", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def solve(rows):
    """Cheapest first over (turn, last role), the audit deciding between equals."""
    faults, seen = [], set()
    for role, text in rows:
        visible = re.findall("[^\x20\x09-\x0d]", text)
        faults.append(1 if not visible else 2 if (role, text) in seen else 3 if visible[-1] not in ".!?" else 0)
        seen.add((role, text))
    heap, done = [(0, "", 0, "n", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(rows) and state in "na":
            return cost, audit, out, faults
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in NEXT[state].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", k, role, (*out, (NAMES[role], ""))))
        if k == len(rows):
            continue
        own, text = rows[k]
        heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, out))
        if faults[k] in (0, 3):
            for role in NEXT[state]:
                if own[:1] == role:
                    heapq.heappush(heap, (cost + faults[k], audit + "K", k + 1, role, (*out, (own, text))))
                if role != "s":
                    heapq.heappush(heap, (cost + faults[k] + 3, audit + "R", k + 1, role, (*out, (NAMES[role], text))))
    raise AssertionError


def brute(rows, every):
    by, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    for conv in every:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines, faults = solve([r[1:] for r in own])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(map(":".join, lines)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in queries.conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows), {r[0] for r in rows})
    assert found(queries.op12_repair(spark, sf_dir)) == want and any("R" in r[-2] or "I" in r[-2] for r in want)


@pytest.mark.parametrize(("run", "fan"), [(2048, 256), (3, 2)])
def test_random_conversations(spark, monkeypatch, run, fan):
    """Runs of three turns in groups of two parts: conversations of up to 90 turns take several levels."""
    monkeypatch.setattr(repair, "RUN", run)
    monkeypatch.setattr(repair, "FAN", fan)
    rng, rows = random.Random(run), []
    for conv in range(30):
        for turn in range(rng.choice([1, 2, 5, 9, 90])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", " ", "", f"Answer {turn}.", f"Cut off {turn}", "Same!", "Ends. \n", None])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(repair.report(repair.damaged(df), df)) == brute(damage(rows), range(30))
    plain = [(c, t, r or "", x or "") for c, t, r, x in rows]
    assert found(repair.report(df, df)) == brute(plain, range(30))


def test_repaired_turns_are_those_of_the_hash(spark, monkeypatch):
    monkeypatch.setattr(repair, "RUN", 4)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {t}.", f"cut {t}", ""])) for c in range(9) for t in range(14)]
    df = spark.createDataFrame(rows, COLUMNS)
    lines = defaultdict(list)
    for r in repair.repaired(df).orderBy("conv_id", "place", "step").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert (r.turn is None) == (r.edit == "I")
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.report(df, df).collect()}
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in range(9)} == hashes
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in lines.values())


def test_odd_rows(spark):
    long = "word " * 60_000 + "end."
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "A."), (1, 5, "assistant", long), (1, 5, "assistant", long), (1, 5, "assistant", long), (2, 0, "user", "  ")]
    rows += [(3, k, "user" if k % 2 else "assistant", "Tie.") for k in range(6)] + [(4, 0, "system", "S.")]
    df = spark.createDataFrame(rows, COLUMNS)
    for c in ("_at", "_run", "edits", "fault", "low", "cost"):
        df = df.withColumn(c, F.lit("extra"))
    every = {r[0] for r in rows}
    assert found(repair.report(repair.damaged(df), df)) == brute(damage(rows), every)
    assert repair.report(repair.damaged(df.limit(0)), df.limit(0)).collect() == []
    assert found(repair.report(df.limit(0), df)) == brute([], every)
    assert repair.repaired(df.limit(0)).collect() == []


def test_one_long_conversation(spark):
    """Most rows are one conversation's, of many runs."""
    rows = [(7, k, ["user", "assistant"][(k + k // 50) % 2], f"Line {k % 4000}." if k % 11 else f"cut {k}") for k in range(9000)]
    df = spark.createDataFrame([*rows, (8, 0, "user", "Hello.")], COLUMNS)
    assert found(repair.report(df, df)) == brute([*rows, (8, 0, "user", "Hello.")], [7, 8])
