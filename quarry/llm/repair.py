"""Conversation structure repair: the cheapest edits that make roles follow (s?(ua)+)?, found by dynamic programming.

A backward pass gives, for each turn and state of the grammar, the least cost of all that follows (cost-to-go); a forward walk from the start
takes among the transitions that keep to it the one whose initial is least in ASCII (D, I, K, R), which gives the least of the cheapest
audits, as no initial leads to two states. Then turns are rebuilt.

A conversation is not one group. Turns are dealt by range over (conversation, turn) and numbered; consecutive turns of a conversation
within a block of numbers are a run. A run's costs are a matrix from its first state to its last, so runs are solved apart: matrices of all
runs, then cost-to-go at each run's end (a stream of small matrices), then each run's map of states under its greedy walk, then
the state in which each run starts, then the edits of each run. Tables between the steps go to the shared folder.

Defined results: a null role or text is one space, and a null conversation or turn is hashed so; null turns come first; equal turns are
in order of role and text, so repeated rows are adjacent; a null conversation is one of its own; empty tables give empty results; other
columns of df are not read, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, settle

#: States of the grammar: before all, after s, after u, after a; it may end in the first and the last. `NEXT`: (initial, state) -> state.
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
#: What a rerole or an insertion gives in each state.
GIVES = ("u", "u", "a", "u")
AFTER = tuple(NEXT[g, i] for i, g in enumerate(GIVES))
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
#: Bits of a turn's number within a block.
BLOCK = 16
SPACE = " \t\n\x0b\x0c\r"


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv:turn`) % 20: 0 drops a row, 1 empties it, 2 takes its [.!?], 3 repeats it, 4 sets role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20).alias("c"))
    times = F.when(F.col("c") == 3, 2).otherwise(1)
    hurt = own.where("c <> 0").select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), times.alias("times"))
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("o")).drop("o")


def ordered(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text in order and numbered (`at`), with the fault of each turn alone: blank, truncated or none. A written table."""
    # equal rows are dealt apart by their place in the input, which is as good an order among them as any
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("i")]
    dealt = df.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(*by)
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return settle(dealt.sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", fault.alias("alone"), F.monotonically_increasing_id().alias("at")), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, at, initial, fault of each turn: a written table without texts. Only the first of equal turns is no duplicate; it is found by sums, so a hot one is never one task."""
    first = turns.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    own = turns.select("conv_id", "at", F.substring("role", 1, 1).alias("initial"), "alone").join(first, "at", "left")
    fault = F.when(F.col("alone") == "blank", "blank").when(F.col("new").isNull(), "duplicate").otherwise(F.col("alone"))
    return settle(own.select("conv_id", "at", "initial", fault.alias("fault"), F.shiftright("at", BLOCK).alias("run")), "faults")


Vector = tuple[int, int, int, int]


def relaxed(c: Vector) -> Vector:
    """The same costs where turns may be inserted."""
    c2, c3 = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + c2), min(c[1], INSERT + c2), c2, c3


def before(initial: str, fault: str, c: Vector) -> Vector:
    """Cost-to-go before a turn, from that after it."""
    if fault in ("blank", "duplicate"):
        return relaxed(tuple(DELETE + x for x in c))
    more = TRUNCATED if fault == "truncated" else 0
    out = []
    for state in range(4):
        least = min(DELETE + c[state], REROLE + more + c[AFTER[state]])
        if (kept := NEXT.get((initial, state))) is not None:
            least = min(least, more + c[kept])
        out.append(least)
    return relaxed(tuple(out))


END: Vector = relaxed((0, FAR, FAR, 0))


def walk(turns: list[tuple[str, str]], after: list[Vector], state: int, last: bool) -> tuple[int, list[tuple[str, str]]]:
    """The greedy walk over a run: the state it ends in, and for each turn its edits' initials and what they give ('-': nothing). after: costs-to-go before each turn, and after the run; last: does the conversation end with the run?"""
    out = []
    for i, (initial, fault) in enumerate(turns):
        edits = gives = ""
        now, then = after[i], after[i + 1]
        free, more = fault not in ("blank", "duplicate"), int(fault == "truncated")
        while True:
            cost, kept = now[state], NEXT.get((initial, state))
            if DELETE + then[state] == cost:
                edits, gives = edits + "D", gives + "-"
                break
            if INSERT + now[AFTER[state]] == cost:
                edits, gives, state = edits + "I", gives + GIVES[state], AFTER[state]
                continue
            if free and kept is not None and more + then[kept] == cost:
                edits, gives, state = edits + "K", gives + initial, kept
            else:
                edits, gives, state = edits + "R", gives + GIVES[state], AFTER[state]
            break
        if last and i == len(turns) - 1:
            while END[state]:
                edits, gives, state = edits + "I", gives + GIVES[state], AFTER[state]
        out.append((edits, gives))
    return state, out


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of equal keys, which are adjacent; a run has at most 2^BLOCK rows."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            k = tuple(row[c] for c in key)
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(row)
    if held:
        yield now, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _costs(turns: list[tuple[str, str]], end: Vector) -> list[Vector]:
    """Costs-to-go before each turn of a run, and after it."""
    out = [end]
    for initial, fault in reversed(turns):
        out.append(before(initial, fault, out[-1]))
    return out[::-1]


def edits(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of faults(): (conv_id, at, edits, gives) for each turn, and (conv_id, cost, illegal) for each conversation; both written tables."""
    kind = dict(table.dtypes)["conv_id"]
    conv = pa.string() if kind == "string" else {"int": pa.int32(), "bigint": pa.int64()}[kind]
    four = pa.list_(pa.int64())
    runs = table.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "at").select("conv_id", "run", "at", "initial", "fault")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = [tuple(0 if i == j else FAR for i in range(4)) for j in range(4)]

        def each():
            for (c, run), rows in _groups(batches, ("conv_id", "run")):
                turns = [(r["initial"], r["fault"]) for r in rows]
                said = [t[0] for t in turns]
                to = [_costs(turns, u)[0] for u in unit]
                yield c, run, [min(FAR, x) for v in to for x in v], said[0], said[-1], sum(x + y not in ("su", "ua", "au") for x, y in zip(said, said[1:]))

        return _batches(each(), pa.schema([("conv_id", conv), ("run", pa.int64()), ("matrix", four), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())]))

    made = settle(runs.mapInArrow(solve, f"conv_id {kind}, run long, matrix array<long>, head string, tail string, illegal long"), "matrices")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a conversation from its last to its first: only a vector is held."""

        def each():
            now, vector, head = (), END, None
            for b in batches:
                for r in b.to_pylist():
                    last = now != (r["conv_id"],)
                    if last:
                        now, vector, head = (r["conv_id"],), END, None
                    joint = int(head is not None and r["tail"] + head not in ("su", "ua", "au"))
                    m, end = r["matrix"], vector
                    vector = tuple(min(m[4 * j + i] + end[j] for j in range(4)) for i in range(4))
                    head = r["head"]
                    yield r["conv_id"], r["run"], list(end), last, vector[0], r["illegal"] + joint

        return _batches(each(), pa.schema([("conv_id", conv), ("run", pa.int64()), ("end", four), ("last", pa.bool_()), ("togo", pa.int64()), ("illegal", pa.int64())]))

    ends = settle(made.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.desc("run")).mapInArrow(compose, f"conv_id {kind}, run long, end array<long>, last boolean, togo long, illegal long"), "ends")
    totals = settle(ends.groupBy("conv_id").agg(F.min_by("togo", "run").alias("cost"), F.sum("illegal").alias("illegal"), F.count("*").alias("runs"), F.min("run").alias("first")), "totals")
    # conversations of one run start in state 0; for the others, where each state leads is found for each run, then followed from run to run
    several = totals.where("runs > 1").select("conv_id")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    more = runs.join(several, same(runs, several), "left_semi").join(ends.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "end", "last"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).drop("c", "r")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (c, run), rows in _groups(batches, ("conv_id", "run")):
                turns = [(r["initial"], r["fault"]) for r in rows]
                after = _costs(turns, tuple(rows[0]["end"]))
                yield c, run, [walk(turns, after, s, rows[0]["last"])[0] if after[0][s] < FAR else 0 for s in range(4)]

        return _batches(each(), pa.schema([("conv_id", conv), ("run", pa.int64()), ("to", four)]))

    maps = settle(more.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "at").mapInArrow(lead, f"conv_id {kind}, run long, to array<long>"), "maps")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            now, state = (), 0
            for b in batches:
                for r in b.to_pylist():
                    if now != (r["conv_id"],):
                        now, state = (r["conv_id"],), 0
                    yield r["conv_id"], r["run"], state
                    state = r["to"][state]

        return _batches(each(), pa.schema([("conv_id", conv), ("run", pa.int64()), ("state", pa.int64())]))

    starts = settle(maps.repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(follow, f"conv_id {kind}, run long, state long"), "starts")
    known = ends.join(starts.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "state"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")), "left").select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "end", "last", F.coalesce("state", F.lit(0)).alias("state"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (c, _), rows in _groups(batches, ("conv_id", "run")):
                turns = [(r["initial"], r["fault"]) for r in rows]
                done = walk(turns, _costs(turns, tuple(rows[0]["end"])), rows[0]["state"], rows[0]["last"])[1]
                for r, (edit, gives) in zip(rows, done, strict=True):
                    yield c, r["at"], edit, gives

        return _batches(each(), pa.schema([("conv_id", conv), ("at", pa.int64()), ("edits", pa.string()), ("gives", pa.string())]))

    full = runs.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).drop("c", "r")
    done = settle(full.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "at").mapInArrow(decide, f"conv_id {kind}, at long, edits string, gives string"), "edits")
    drop(made, maps, starts, ends)
    return done, totals.drop("runs", "first")


def rebuilt(turns: DataFrame, done: DataFrame) -> DataFrame:
    """conv_id, at, part (0 and on within a turn's place), edit, role, text: the edits, with the repaired turns they give (role null: deleted)."""
    place = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("edits")), lambda i: F.struct(F.substr("edits", i, F.lit(1)).alias("edit"), F.substr("gives", i, F.lit(1)).alias("give")))).alias("part", "e")
    one = done.select(F.col("at"), "edits", "gives").join(turns.select("conv_id", "at", "role", "text"), "at").select("conv_id", "at", "role", "text", place)
    edit, give = F.col("e.edit"), F.col("e.give")
    role = F.when(edit == "K", F.col("role")).when(edit == "D", F.lit(None)).when(give == "u", ROLES["u"]).otherwise(ROLES["a"])
    return one.select("conv_id", "at", "part", edit.alias("edit"), role.alias("role"), F.when(edit == "I", "").when(edit != "D", F.col("text")).alias("text"))


def _digests(parts: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256: a digest is sequential, so a conversation is a stream through one task, of which nothing but the digest is held."""
    kind = dict(parts.dtypes)["conv_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = pa.string() if kind == "string" else {"int": pa.int32(), "bigint": pa.int64()}[kind]

        def each():
            now = digest = None
            audit: list[str] = []
            for b in batches:
                for c, edit, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "edit", "role", "text")), strict=True):
                    if now != (c,):
                        if now is not None:
                            yield now[0], "".join(audit), digest.hexdigest()
                        now, digest, audit, some = (c,), hashlib.sha256(), [], False
                    audit.append(edit)
                    if role is not None:
                        digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                        some = True
            if now is not None:
                yield now[0], "".join(audit), digest.hexdigest()

        return _batches(each(), pa.schema([("conv_id", conv), ("audit", pa.string()), ("repaired_sha256", pa.string())]), 200)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part").select("conv_id", "edit", "role", "text").mapInArrow(fold, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair(hurt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text): the numbered turns, their faults, the rebuilt turns (see rebuilt), and cost and illegal of each conversation."""
    turns = ordered(hurt)
    found = faults(turns)
    done, totals = edits(found)
    return turns, found, rebuilt(turns, done), totals


def repair_report(df: DataFrame, hurt: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation of df: gaps, faults, illegal neighbours, cost, audit and digest of its repaired turns."""
    turns, found, parts, totals = repair(hurt)
    count = lambda f: F.sum((F.col("fault") == f).cast("long")).alias(f)
    kinds = found.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"))
    gaps = turns.where("turn is not null").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    every = df.select(F.col(conv).alias("conv_id")).distinct()
    for part in (gaps, kinds, totals, _digests(parts)):
        other = part.withColumnRenamed("conv_id", "__c")
        every = every.join(other, every["conv_id"].eqNullSafe(other["__c"]), "left").drop("__c")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    said: Column = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    return every.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), said.alias("repaired_sha256"))
