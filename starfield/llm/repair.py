"""Repair of conversations: the cheapest deletions, rerolings and insertions after which roles alternate.

A repaired conversation is empty, or a system turn at most, then pairs of a user's and an assistant's turn. The repair
chooses the turns to retain, kept or reroled. Between two retained turns all others are deleted, which prefix sums of
deletions price, and the pair of their roles says how many turns must be inserted. So, from the end of a conversation to
its beginning, the cheapest rest is the least, over the next retained turn's role, of a running minimum and the price of
the pair. Of equally cheap repairs the one whose audit (its edits' initials) is least is read off from the beginning.

The turns are sorted once, by ranges of (conv_id, turn, role, text), and cut into runs of at most ``RUN`` rows. A
conversation in one run is solved there. One that reaches over several is solved in parts: each part's prices from any
role to any role are a small matrix, products of all later ones give the prices at its end, and compositions of all
earlier parts' choices the role at its beginning; both are scans over groups of ``FAN`` parts and groups of groups.
So no task needs a whole conversation, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfield.plans.materialize import checkpoint, written

RUN = 2048
FAN = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
#: The role before: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Turns to insert between two retained roles, and at the end after a role.
BETWEEN = {NONE: {SYSTEM: 0, USER: 0, ASSISTANT: 1}, SYSTEM: {USER: 0, ASSISTANT: 1}, USER: {USER: 1, ASSISTANT: 0}, ASSISTANT: {USER: 0, ASSISTANT: 1}}
AT_END = [0, 2, 1, 0]
ROLE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A turn's fault.
FINE, BLANK, DUPLICATE, CUT = range(4)

# The characters that count as blank, and those that end a sentence.
_VISIBLE = "[^\\x20\\x09-\\x0D]"
_ENDS = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """A log with known faults, by the hash of conv_id and turn: of twenty rows each one is dropped, emptied, robbed of its
    ends of sentences, repeated, or given to the user. Nulls count as one blank, but in conv_id and turn stay null. Rows
    that repeat are each damaged alike."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("_kind <> 0").withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def sorted_turns(rows: DataFrame) -> DataFrame:
    """A written table: _conv (a struct of conv_id, so that nulls are equal), turn, role, text, _at (the place in the order
    of conv_id, turn, role and text, with gaps between partitions), _run, _initial, _fault (without duplicates), and two
    hashes of role and text."""
    key = ["conv_id", "turn", "role", "text"]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    fault = F.when(~F.col("text").rlike(_VISIBLE), BLANK).when(F.col("text").rlike(_ENDS), FINE).otherwise(CUT)
    run = F.col("_at") - F.col("_at") % RUN
    hashes = [F.xxhash64("role", "text").alias("_one"), F.xxhash64(F.lit(1), "text", "role").alias("_two")]
    return written(rows.select(F.struct("conv_id").alias("_conv"), "turn", "role", "text", "_at", run.alias("_run"), F.substring("role", 1, 1).alias("_initial"), fault.alias("_fault"), *hashes), "turns")


def in_runs(turns: DataFrame) -> DataFrame:
    """A row for each run, written: _run, rows (an array of _at, _conv, turn, _initial, _fault, in order) with duplicates
    marked. First holders of a role and text are found by their places, so a text that many rows have is no hot key."""
    first = turns.groupBy("_conv", "_one", "_two").agg(F.min("_at").alias("_at"))
    firsts = first.groupBy((F.col("_at") - F.col("_at") % RUN).alias("_run")).agg(F.collect_set("_at").alias("_firsts"))
    rows = turns.groupBy("_run").agg(F.sort_array(F.collect_list(F.struct("_at", "_conv", "turn", "_initial", "_fault"))).alias("rows"))
    return written(rows.join(firsts, "_run", "left").select("_run", "rows", F.coalesce("_firsts", F.array().cast("array<long>")).alias("firsts")), "turn-runs")


class Part:
    """The turns of one conversation within one run, in order."""

    def __init__(self, conv, rows: list[dict], firsts: set[int]):
        self.conv, self.rows = conv, rows
        self.roles = [ROLE_OF.get(r["_initial"]) for r in rows]
        self.faults = [DUPLICATE if r["_fault"] != BLANK and r["_at"] not in firsts else r["_fault"] for r in rows]

    def price(self, k: int, role: int) -> int | None:
        """Of retaining turn ``k`` as ``role``; None where it cannot be."""
        if self.faults[k] in (BLANK, DUPLICATE):
            return None
        more = TRUNCATED if self.faults[k] == CUT else 0
        return more if self.roles[k] == role else None if role == SYSTEM else more + REROLE

    def last_turn(self) -> tuple[int, int]:
        """The last turn number that is no null, and whether there is one."""
        numbers = [r["turn"] for r in self.rows if r["turn"] is not None]
        return (numbers[-1], 1) if numbers else (0, 0)

    def rests(self, after: list[int]) -> list[list[int]]:
        """For each turn and the end, the cheapest rest by the role before, given the prices ``after`` the part."""
        n = len(self.rows)
        # Deletions of the turns before each; least prices of going on with a retained turn of a role, and of leaving the
        # part after deletions only.
        deletions = [DELETE * k for k in range(n + 1)]
        least = {SYSTEM: FAR, USER: FAR, ASSISTANT: FAR}
        rest = [after]
        for k in range(n - 1, -1, -1):
            further = rest[-1]
            for role in least:
                if (own := self.price(k, role)) is not None:
                    least[role] = min(least[role], deletions[k] + own + further[role])
            gap = deletions[n] - deletions[k]
            rest.append([min(after[before] + gap, *(least[role] + INSERT * m - deletions[k] for role, m in BETWEEN[before].items())) for before in range(4)])
        return [[min(x, FAR) for x in r] for r in rest[::-1]]

    def matrix(self) -> np.ndarray:
        """The price from each role before the part to each role after it."""
        ends = [self.rests([0 if role == end else FAR for role in range(4)])[0] for end in range(4)]
        return np.array(ends, np.int64).T

    def walk(self, before: int, after: list[int], last: bool) -> tuple[list[str], list[int], int]:
        """The edits of each turn (its insertions before it), its role where it is retained, and the role at the end. With
        ``last`` the conversation's end follows, whose insertions the last edit holds."""
        rest, edits, roles = self.rests(after), [], []
        for k in range(len(self.rows)):
            now = rest[k][before]
            if DELETE + rest[k + 1][before] == now:
                edits.append("D")
                roles.append(NONE)
                continue
            ways = []
            for role, m in BETWEEN[before].items():
                own = self.price(k, role)
                if own is not None and INSERT * m + own + rest[k + 1][role] == now:
                    ways.append(("I" * m + ("K" if self.roles[k] == role else "R"), role))
            edit, before = min(ways)
            edits.append(edit)
            roles.append(before)
        if last and edits:
            edits[-1] += "I" * AT_END[before]
        return edits, roles, before


END = [INSERT * m for m in AT_END]


def parts_of(run: dict) -> list[Part]:
    parts, rows, firsts = [], run["rows"], set(run["firsts"])
    begin = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k]["_conv"] != rows[begin]["_conv"]:
            parts.append(Part(rows[begin]["_conv"], rows[begin:k], firsts))
            begin = k
    return parts


def scanned(parts: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], identity: np.ndarray, late: bool, span: int = RUN) -> DataFrame:
    """``parts`` (_conv, _run, v: numbers as an array) with ``w``, all earlier values of the conversation combined in order, or
    all later ones with ``late``. Groups hold at most ``FAN`` parts; their totals are scanned in the same way."""
    span *= FAN
    group = F.col("_run") - F.col("_run") % span
    parts = parts.withColumn("_group", group)
    shape = identity.shape

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        value = identity
        for v in rows.sort_values("_run")["v"]:
            value = combine(value, np.array(v).reshape(shape))
        return pd.DataFrame({"_conv": [rows["_conv"].iloc[0]], "_run": [rows["_group"].iloc[0]], "v": [value.ravel().tolist()]})

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_run", ascending=not late)
        value, found = np.array(rows["w"].iloc[0]).reshape(shape), []
        for v in rows["v"]:
            found.append(value.ravel().tolist())
            own = np.array(v).reshape(shape)
            value = combine(own, value) if late else combine(value, own)
        return rows[["_conv", "_run", "v"]].assign(w=found)

    kind = parts.select("_conv", "_run", "v").schema
    totals = checkpoint(parts.groupBy("_conv", "_group").applyInPandas(total, kind))
    one = F.array(*[F.lit(int(x)) for x in identity.ravel()]).cast("array<long>")
    if totals.groupBy("_conv").count().filter("count > 1").isEmpty():
        totals = totals.withColumn("w", one)
    else:
        totals = scanned(totals, combine, identity, late, span)
    outer = totals.select(F.col("_conv").alias("_of"), F.col("_run").alias("_group"), "w")
    rows = parts.join(outer, (F.col("_conv") == F.col("_of")) & (parts["_group"] == outer["_group"])).drop("_of", "_group")
    return checkpoint(rows.withColumn("_group", group).groupBy("_conv", "_group").applyInPandas(within, kind.add("w", kind["v"].dataType)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of matrices of prices: the cheapest way through a role between."""
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of what two parts in turn do: the role at the end by the role before, the last turn's initial (a role's number, 4 for
    others, -1 without turns), the last turn number that is no null, and whether there is one."""
    return np.concatenate([b[a[:4]], b[4:5], b[5:7] if b[6] else a[5:7]])


_FREE = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
_NOTHING = np.array([0, 1, 2, 3, -1, 0, 0], np.int64)


def _initial(row: dict) -> int:
    return ROLE_OF.get(row["_initial"], 4)


def spanning(runs: DataFrame) -> DataFrame:
    """What each part of a conversation in several runs starts and ends with: _run, known, an array of at most two structs of
    _conv, after (the prices at its end), before (as in ``_then``, of all earlier parts), and last."""
    ends = runs.select("_run", F.explode(F.array_distinct(F.array(F.col("rows")[0]["_conv"], F.element_at("rows", -1)["_conv"]))).alias("_conv"))
    convs = checkpoint(ends.groupBy("_conv").agg(F.count("*").alias("_n"), F.max("_run").alias("_last")).filter("_n > 1"))
    parts = ends.join(convs.select(F.col("_conv").alias("_of"), "_last"), F.col("_conv") == F.col("_of")).select("_conv", "_run", "_last")
    asked = parts.groupBy("_run").agg(F.collect_list("_conv").alias("known"))
    conv = runs.schema["rows"].dataType.elementType["_conv"].dataType.simpleString()

    def prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _numbers(batch, [(p.conv, run["_run"], p.matrix().ravel().tolist()) for run in batch.to_pylist() for p in parts_of(run) if p.conv in run["known"]])

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for run in batch.to_pylist():
                after = [(k["_conv"], k["after"]) for k in run["known"]]
                for p in parts_of(run):
                    found += [(p.conv, run["_run"], [*(p.walk(b, x, False)[2] for b in range(4)), _initial(p.rows[-1]), *p.last_turn()]) for c, x in after if c == p.conv]
            yield from _numbers(batch, found)

    def _numbers(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        kind = batch.schema.field("rows").type.value_type.field("_conv").type
        c, r, v = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(r, pa.int64()), pa.array(v, pa.list_(pa.int64()))], names=["_conv", "_run", "v"])

    numbers = f"_conv {conv}, _run long, v array<long>"
    later = scanned(checkpoint(runs.join(asked, "_run").mapInArrow(prices, numbers)), _product, _FREE, late=True)
    after = F.array(*[F.array_min(F.array(*[F.col("w")[4 * r + e] + END[e] for e in range(4)])) for r in range(4)])
    later = checkpoint(later.select("_conv", "_run", after.alias("after")))
    told = later.groupBy("_run").agg(F.collect_list(F.struct("_conv", "after")).alias("known"))
    earlier = scanned(checkpoint(runs.join(told, "_run").mapInArrow(choices, numbers)), _then, _NOTHING, late=False)
    own = lambda df, name, what: df.select(F.col("_conv").alias(f"_{name}"), F.col("_run").alias(f"_{name}_run"), what)
    at = lambda name: (F.col("_conv") == F.col(f"_{name}")) & (F.col("_run") == F.col(f"_{name}_run"))
    all_ = parts.join(own(later, "later", "after"), at("later")).join(own(earlier, "earlier", F.col("w").alias("before")), at("earlier"))
    return all_.groupBy("_run").agg(F.collect_list(F.struct("_conv", "after", "before", (F.col("_run") == F.col("_last")).alias("last"))).alias("known"))


#: What ``edited`` adds up of a conversation's parts.
SUMS = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]


def edited(turns: DataFrame) -> DataFrame:
    """The edits of all turns of ``sorted_turns``, a row for each run's part of a conversation: _conv, _run, ats, edits and
    roles (arrays, in order), ``SUMS``, low and high (its least and greatest turn)."""
    runs = in_runs(turns)
    conv = turns.schema["_conv"].dataType.simpleString()
    found = runs.join(spanning(runs), "_run", "left")
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run in batch.to_pylist():
                known = run["known"] or []
                for p in parts_of(run):
                    at = next((k for k in known if k["_conv"] == p.conv), {"after": END, "before": _NOTHING.tolist(), "last": True})
                    before = at["before"]
                    edits, roles, _ = p.walk(before[NONE], at["after"], at["last"])
                    initials = [before[4], *map(_initial, p.rows)]
                    numbers = [r["turn"] for r in p.rows if r["turn"] is not None]
                    again = bool(numbers) and bool(before[6]) and before[5] == numbers[0]
                    out.append({
                        "_conv": p.conv, "_run": run["_run"], "ats": [r["_at"] for r in p.rows], "edits": edits, "roles": roles,
                        "blank": p.faults.count(BLANK), "duplicate": p.faults.count(DUPLICATE), "truncated": p.faults.count(CUT),
                        "illegal": sum(a >= 0 and (a, b) not in legal for a, b in zip(initials, initials[1:], strict=False)),
                        "cost": sum(DELETE * ("D" in e) + REROLE * ("R" in e) + INSERT * e.count("I") + TRUNCATED * (f == CUT and "D" not in e) for e, f in zip(edits, p.faults, strict=True)),
                        "turns": len(set(numbers)) - again, "low": min(numbers, default=None), "high": max(numbers, default=None),
                    })
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_conv", batch.schema.field("rows").type.value_type.field("_conv").type), *fields]))

    long, texts = pa.int64(), pa.list_(pa.string())
    fields = [("_run", long), ("ats", pa.list_(long)), ("edits", texts), ("roles", pa.list_(long)), *((c, long) for c in (*SUMS, "low", "high"))]
    sums = ", ".join(f"{c} long" for c in (*SUMS, "low", "high"))
    return found.mapInArrow(edit, f"_conv {conv}, _run long, ats array<long>, edits array<string>, roles array<long>, {sums}")


def _output(edit: str, role: int, own: str, text: str) -> list[tuple[str, str, str]]:
    """What an edit puts out: (initial, role, text). A turn is inserted before a retained one of the same role, and at a
    conversation's end to finish it, so the role retained and the number of insertions tell the inserted roles."""
    kept = edit.rstrip("I")
    out = [("I", NAMES[USER if role == ASSISTANT else ASSISTANT], "")] if kept[0] == "I" else []
    if kept[-1] != "D":
        out.append((kept[-1], own if kept[-1] == "K" else NAMES[role], text))
    return out + [("I", NAMES[r], "") for r in (USER, ASSISTANT)[2 - (len(edit) - len(kept)) :]]


def _with_edits(turns: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Turns and parts in one table, dealt out by ``key`` and sorted so that each part comes before its turns."""
    rows = turns.select("_conv", "_run", "_at", "turn", "role", "text").unionByName(parts, allowMissingColumns=True)
    return rows.repartition(F.col(key)).sortWithinPartitions("_conv", "_run", F.col("_at").asc_nulls_first())


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of all repaired conversations: conv_id, place (of the turn that the edit is of, increasing within a
    conversation, with gaps), step (within the place), edit (K, R or I), turn (null for insertions), role, text.

    Rows are taken by turn (null turns first), then role and text; a null role or text counts as an empty one, a null
    conv_id is a conversation of its own. Rows with a role and text that an earlier one has are duplicates; they and blank
    ones are deleted. A very long text is one turn's; a very long conversation goes through many tasks. A conversation of
    which nothing is left gives no rows, and so does an empty table. Other columns are ignored.
    """
    turns = sorted_turns(rows)
    kind = turns.schema["_conv"].dataType["conv_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits: dict[int, tuple[str, int]] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_at"] is None:
                    edits = dict(zip(r["ats"], zip(r["edits"], r["roles"], strict=True), strict=True))
                else:
                    found = _output(*edits[r["_at"]], r["role"], r["text"])
                    out += [{"conv_id": r["_conv"]["conv_id"], "place": r["_at"], "step": k, "edit": e, "turn": None if e == "I" else r["turn"], "role": role, "text": text} for k, (e, role, text) in enumerate(found)]
            id_ = batch.schema.field("_conv").type.field("conv_id")
            yield pa.RecordBatch.from_pylist(out, pa.schema([id_, ("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    return _with_edits(turns, edited(turns), "_run").mapInArrow(apply, f"conv_id {kind}, place long, step int, edit string, turn long, role string, text string")


class _Digest:
    """What a stream of one conversation's parts and turns adds up to."""

    def __init__(self, conv: dict):
        self.conv, self.sums, self.numbers = conv, dict.fromkeys(SUMS, 0), []
        self.audit, self.hashed, self.begun, self.edits = [], hashlib.sha256(), False, {}

    def add(self, r: dict) -> None:
        if r["_at"] is None:
            self.edits = dict(zip(r["ats"], zip(r["edits"], r["roles"], strict=True), strict=True))
            self.audit.append("".join(r["edits"]))
            self.sums = {c: n + r[c] for c, n in self.sums.items()}
            found = [*self.numbers, *(x for x in (r["low"], r["high"]) if x is not None)]
            self.numbers = [min(found), max(found)] if found else []
            return
        for _, role, text in _output(*self.edits[r["_at"]], r["role"], r["text"]):
            self.hashed.update(("\n" * self.begun + f"{role}:{text}").encode())
            self.begun = True

    def row(self) -> dict:
        gaps = self.numbers[1] - self.numbers[0] + 1 - self.sums["turns"] if self.numbers else 0
        return {"conv_id": self.conv["conv_id"], "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.hashed.hexdigest()}


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """What was found and done, for every conv_id of ``conversations``: conv_id, gaps (missing turn numbers), blank, duplicate,
    truncated, illegal (adjacent roles), cost, audit (the edits' initials), repaired_sha256 (of the repaired ``role:text``,
    joined by newlines). Rows as in ``repaired``; a conversation without rows has zeros, an empty audit and the hash of
    nothing. Null turns leave gaps alone.

    An audit is a row's cell, and one hash needs a conversation's turns in order: they stream through one task, which holds
    one run's edits and the audit. ``repaired`` does without.
    """
    turns = sorted_turns(rows)
    parts = edited(turns)
    every = conversations.select(F.struct("conv_id").alias("_conv")).distinct()
    kind = turns.schema["_conv"].dataType["conv_id"].dataType.simpleString()
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["_conv"] != now.conv:
                    out += [now.row()] if now else []
                    now = _Digest(r["_conv"])
                if r["_run"] is not None:
                    now.add(r)
            yield pa.RecordBatch.from_pylist(out, schema(batch))
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema(batch))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([batch.schema.field("_conv").type.field("conv_id"), *((c, pa.int64()) for c in counted), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    rows = _with_edits(turns, parts.unionByName(every, allowMissingColumns=True), "_conv")
    return rows.mapInArrow(digest, f"conv_id {kind}, {', '.join(f'{c} long' for c in counted)}, audit string, repaired_sha256 string")
