"""Stateful and governance operators (H1-H16) in batch; quarry.streaming has their streaming forms.

What depends on earlier decisions (a rejected request costs nothing) is a fold over a key's ordered events, read as a stream of which
only the state is held; what depends on counts only is a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def estimate_tokens(c: Column) -> Column:
    """H2."""
    return F.greatest(F.lit(1).cast("long"), F.expr("1L") * F.floor(F.length(c) / 4))


def _folded(df: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str], start: Callable, step: Callable, made: Sequence[tuple[str, str, pa.DataType]]) -> DataFrame:
    """key, order and the columns made (name, SQL type, Arrow type): step(state, *fields) gives the next state and a row's values; start(*key) begins a key."""
    kinds, n = dict(df.dtypes), len(key)
    rest = [*order, *[f for f in fields if f not in order]]
    near = df.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for b in batches:
            keys = zip(*[b.column(i).to_pylist() for i in range(n)], strict=True)
            out = []
            for k, *values in zip(keys, *[b.column(f).to_pylist() for f in fields], strict=True):
                if k != now:
                    now, state = k, start(*k)
                state, row = step(state, *values)
                out.append(row)
            cols = list(zip(*out, strict=True)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([*b.columns[: n + len(order)], *[pa.array(c, t) for c, (_, _, t) in zip(cols, made, strict=True)]], [*key, *order, *[m[0] for m in made]])

    return near.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in (*key, *order)] + [f"`{m[0]}` {m[1]}" for m in made]))


def spend(left: int | None, a: int | None) -> tuple[int | None, bool | None]:
    """H1: what is left after a request, and whether it is accepted."""
    ok = None if left is None or a is None else a <= left
    return (left - a if ok else left), ok


def hit(state: tuple, at: int | None, micros: int) -> tuple:
    """H3 from the first hit: (start, number, hits) of the window after a request at that microsecond."""
    start, w, n = state
    if start is None or (at is not None and at >= start + micros):
        start, w, n = at, w + 1, 0
    return start, w, n + 1


def step_outcome(done: bool, tries: int | None, past_gate: bool, red: bool | None, ok: bool | None, retries: int) -> str:
    """H5: what comes of a step that is done already or not, was tried so often (None: not a known step), and is past the gate or not."""
    if done:
        return "skipped"
    if red and past_gate:
        return "blocked"
    if tries is not None and tries >= retries:
        return "max_retries"
    return "success" if ok else "failed"


def budget(df: DataFrame, key: str, order: Sequence[str], amount: str, total: Column) -> DataFrame:
    """H1: (key, order, amount, accepted, remaining): a request is accepted if it fits what is left; rejected ones use nothing."""
    own = df.withColumn("__amount", F.col(amount).cast("long")).withColumn("__total", total.cast("long"))

    def step(left: int | None, a: int | None):
        left, ok = spend(left, a)
        return left, (a, ok, left)

    made = [(amount, "bigint", pa.int64()), ("accepted", "boolean", pa.bool_()), ("remaining", "bigint", pa.int64())]
    return _folded(own, [key, "__total"], order, ["__amount"], lambda k, t: t, step, made).drop("__total")


def budget_left(total: Column, used: Column) -> Column:
    """H15."""
    return F.greatest(F.lit(0), total - used)


def rate_limit(df: DataFrame, key: str, ts: str = "ts", order: Sequence[str] = (), limit: int = 300, seconds: int = 60) -> DataFrame:
    """H3: aligned windows; allowed up to `limit` a window, and the seconds to wait otherwise."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    start = at - F.pmod(at, F.lit(seconds * 1_000_000))
    n = F.row_number().over(W.partitionBy(key, "window_start").orderBy(ts, *order))
    own = df.withColumn("window_start", F.floor(start / 1_000_000).cast("long")).withColumn("n", n)
    wait = F.col("window_start") + seconds - F.floor(at / 1_000_000)
    return own.withColumns({"allowed": F.col("n") <= limit, "retry_after": F.when(F.col("n") <= limit, 0).otherwise(F.greatest(wait, F.lit(1))).cast("long")})


def first_hit_windows(df: DataFrame, key: str, ts: str = "ts", order: Sequence[str] = (), limit: int = 300, seconds: int = 60) -> DataFrame:
    """H3: windows that begin with the first request after the last window's end; (key, ts, order, window_no, n, allowed)."""
    own = df.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")))

    def step(state: tuple, at: int | None):
        state = hit(state, at, seconds * 1_000_000)
        return state, state[1:]

    made = [("window_no", "int", pa.int32()), ("n", "int", pa.int32())]
    return _folded(own, [key], [ts, *order], ["__s"], lambda k: (None, 0, 0), step, made).withColumn("allowed", F.col("n") <= limit)


def concurrency(df: DataFrame, key: Sequence[str], start: str, end: str, order: str, limit: int, ttl: int | None = None) -> DataFrame:
    """H4: how many intervals of the key are open when each begins (itself too), from starts and ends in order; ends come first. With ttl, none lasts longer. An end that is null
    comes last: its interval stays open."""
    stop = F.col(end) if ttl is None else F.least(F.col(end), F.col(start) + F.expr(f"interval {ttl} seconds"))
    ups = df.select(*key, F.col(start).alias("t"), F.lit(1).alias("d"), F.col(order).alias("__id"))
    downs = df.select(*key, stop.alias("t"), F.lit(-1).alias("d"), F.col(order).alias("__id"))
    w = W.partitionBy(*key).orderBy(F.asc_nulls_last("t"), "d", F.asc_nulls_last("__id")).rowsBetween(W.unboundedPreceding, 0)
    return ups.unionByName(downs).withColumn("open", F.sum("d").over(w)).where("d = 1").select(*key, F.col("__id").alias(order), "open", (F.col("open") <= limit).alias("within"))


def step_machine(events: DataFrame, key: str, order: str, steps: Sequence[str], gate: str, retries: int = 3) -> DataFrame:
    """H5: (key, order, step, outcome): success, failed, skipped (already done), blocked (a red line is raised and the step is past the gate) or max_retries.

    events: key, order, step, ok and blocked (is a red line raised?).
    """
    place = {name: i for i, name in reversed(list(enumerate(steps)))}

    def fold(state: tuple, name: str | None, ok: bool | None, red: bool | None):
        done, tries = state
        outcome = step_outcome(name in done, tries.get(name), name is not None and place.get(name, -1) > place.get(gate, -1), red, ok, retries)
        if outcome == "success" and name is not None:
            done.add(name)
        if outcome == "failed" and name in tries:
            tries[name] += 1
        return state, (name, outcome)

    own = events.select(key, order, F.col("step").alias("__step"), "ok", "blocked")
    made = [("step", "string", pa.string()), ("outcome", "string", pa.string())]
    return _folded(own, [key], [order], ["__step", "ok", "blocked"], lambda k: (set(), dict.fromkeys(steps, 0)), fold, made)


def latest_status(events: DataFrame, key: Sequence[str], ts: str, status: str) -> DataFrame:
    """Each key's last status (of equal times the largest) and how often it was retried."""
    return events.groupBy(*key).agg(F.max_by(status, F.struct(ts, status)).alias(status), F.count_if(F.col(status) == "RETRY").alias("retries"))


def cache_state(entries: DataFrame, as_of: Column, size: int = 4096, key: str = "cache_key", expires: str = "expires_at", written: str = "ts", drop_prefix: str | None = None) -> DataFrame:
    """H7: the entries a cache holds: each key's last write (of equal times that which expires last), not expired or invalidated, of these the `size` that expire last."""
    last = entries.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(written), F.desc(expires)))).where("__n = 1").drop("__n").where(F.col(expires) > as_of)
    if drop_prefix:
        last = last.where(~F.startswith(key, F.lit(drop_prefix)))
    return last.orderBy(F.desc(expires), F.asc(key)).limit(size)


def routing_stats(df: DataFrame, key: Sequence[str], order: Sequence[str], success: str, latency: str, keep: float = 0.7) -> DataFrame:
    """H8: attempts, successes and the exponentially weighted latency (the first value as it is) of each key's calls in order."""
    # a key may hold a large part of all rows: ranges of its rows are folded apart, and what they give is put together in order
    rest = [*order, *[f for f in (success, latency) if f not in order]]
    own = df.withColumn(latency, F.greatest(F.lit(0.0), F.col(latency).cast("double"))).select(*key, *rest)
    kinds, n = dict(own.dtypes), len(key)
    near = own.repartitionByRange(*key, *rest).sortWithinPartitions(*key, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, said, held = None, None, [0, 0, 0.0, 0.0]

        def made() -> pa.RecordBatch:
            cols = [*said, *[pa.array([x]) for x in (part, *held)]]
            return pa.RecordBatch.from_arrays(cols, [*key, "__part", "__n", "__ok", "__first", "__on"])

        for b in batches:
            keys = zip(*[b.column(i).to_pylist() for i in range(n)], strict=True)
            for at, (k, ok, x) in enumerate(zip(keys, b.column(success).to_pylist(), b.column(latency).to_pylist(), strict=True)):
                if said is None or k != now:
                    if said is not None:
                        yield made()
                    now, said, held = k, [b.column(i).slice(at, 1) for i in range(n)], [0, 0, x, 0.0]
                # as a key's first range, and as one that goes on from what was before it
                held = [held[0] + 1, held[1] + bool(ok), x if not held[0] else held[2] * keep + x * (1 - keep), held[3] * keep + x * (1 - keep)]
        if said is not None:
            yield made()

    runs = near.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in key] + ["__part long, __n long, __ok long, __first double, __on double"]))
    each = runs.groupBy(*key).agg(F.sum("__n").cast("int").alias("attempts"), F.sum("__ok").cast("int").alias("successes"), F.array_sort(F.collect_list(F.struct("__part", "__n", "__first", "__on"))).alias("__e"))
    ewma = F.aggregate("__e", F.lit(None).cast("double"), lambda acc, e: F.when(acc.isNull(), e["__first"]).otherwise(acc * F.pow(F.lit(float(keep)), e["__n"]) + e["__on"]))
    return each.select(*key, "attempts", "successes", F.round(ewma, 6).alias("latency"))


def reward(attempts: Column, successes: Column, latency: Column) -> Column:
    """H9: .85 of the success rate and .15 of how far latency is below four seconds; .5 if never tried."""
    return F.when(F.coalesce(attempts, F.lit(0)) <= 0, 0.5).otherwise(F.least(F.lit(1.0), successes / attempts) * 0.85 + (1 - F.least(F.lit(1.0), latency / 4000)) * 0.15)


def routing_order(stats: DataFrame, bucket: str, index: str, explore: float = 0.0, seed: int = 0) -> DataFrame:
    """H9: profiles of a bucket by reward, then attempts, then place; with explore, that share of buckets gets a shuffled order, the same for the same seed."""
    r = F.round(reward(F.col("attempts"), F.col("successes"), F.col("latency")), 9)
    shuffled = F.pmod(F.xxhash64(bucket, F.lit(seed)), F.lit(10_000)) < int(explore * 10_000)
    own = stats.withColumn("reward", r).withColumn("__x", F.when(shuffled, F.xxhash64(bucket, index, F.lit(seed))))
    return own.withColumn("place", F.row_number().over(W.partitionBy(bucket).orderBy(F.col("__x").asc_nulls_last(), F.desc("reward"), F.desc(F.coalesce("attempts", F.lit(0))), F.asc(index)))).drop("__x")


def first_success(attempts: DataFrame, key: str, place: str = "place", ok: str = "ok") -> DataFrame:
    """Each call's first successful attempt by place, and the attempts made up to it (all if none succeeded)."""
    at = F.min(F.when(F.col(ok), F.col(place))).over(W.partitionBy(key))
    made = attempts.withColumn("__at", at).where(F.col("__at").isNull() | (F.col(place) <= F.col("__at")))
    return made.groupBy(key).agg(F.count("*").alias("attempts"), F.max("__at").alias("used"))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before a retry, doubling up to a bound; with jitter (what tells tries apart, such as key and attempt), whole seconds from none to these, the same for the same one."""
    wait = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    if jitter is None:
        return wait
    draw = F.conv(F.substring(F.md5(jitter.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(draw, F.floor(wait).cast("long") + 1).cast("double")


def pipeline_status(steps: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """READY if every step is done, FATAL_BLOCKED from a gate that stopped it, FAILED, else RUNNING, with the first step that is not done."""
    names = F.array(*[F.lit(s) for s in order])
    one = steps.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("status") == "DONE", F.col("step")))).alias("done"), F.bool_or(F.col("status") == "BLOCKED").alias("b"), F.bool_or(F.col("status") == "FAILED").alias("f"))
    left = F.filter(names, lambda s: ~F.array_contains("done", s))
    return one.select(key, F.when(F.col("b"), "FATAL_BLOCKED").when(F.col("f"), "FAILED").when(F.size(left) == 0, "READY").otherwise("RUNNING").alias("status"), F.get(left, F.lit(0)).alias("resume_from"))
