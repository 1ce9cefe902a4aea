"""Keyed streams with lasting state (R22, H1, H3 from the first hit, H5, H7): a key's events pass one writer, in order, as under a row lock.

Each takes a streaming DataFrame and gives one whose rows are those of the batch form in quarry.operators.state, if no event of a key comes in
a later batch than one that follows it. State is in the checkpoint, so a query that starts again goes on where it was. The state
store must be RocksDB: `rocksdb` says so for the queries started under it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import state as st

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Within it, streams start with the state store that keyed streams need; after it the session is as before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


class Ordered(StatefulProcessor):
    """Rows of a key in a batch, in order; subclasses give a row's values."""

    def __init__(self, order: Sequence[str], columns: Sequence[str]):
        self.order, self.columns = list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def begin(self, key: tuple) -> None: ...

    def row(self, key: tuple, r) -> tuple:
        raise NotImplementedError

    def end(self) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        self.begin(key)
        out = [self.row(key, r) for r in frame.itertuples(index=False)]
        self.end()
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def close(self) -> None: ...


def _known(x):
    """None for what pandas has as missing."""
    return None if x is None or x != x or x is pd.NaT or x is pd.NA else x


class Budget(Ordered):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("left", "remaining long")

    def begin(self, key: tuple) -> None:
        self.left = self.value.get()[0] if self.value.exists() else Ellipsis

    def row(self, key: tuple, r) -> tuple:
        a, total = _known(r.a), _known(r.total)
        if self.left is Ellipsis:
            self.left = None if total is None else int(total)
        self.left, ok = st.spend(self.left, None if a is None else int(a))
        return (*key, *[getattr(r, c) for c in self.order], a, ok, self.left)

    def end(self) -> None:
        self.value.update((self.left,))


def budget(df: DataFrame, key: str, order: Sequence[str], amount: str, total: Column) -> DataFrame:
    """(key, order, amount, accepted, remaining), a reservation ledger; a key's total is that of its first request."""
    own = df.select(key, *order, F.col(amount).cast("long").alias("a"), total.cast("long").alias("total"))
    columns = [key, *order, amount, "accepted", "remaining"]
    kinds = f"{_kinds(own, [key, *order])}, `{amount}` long, accepted boolean, remaining long"
    return own.groupBy(key).transformWithStateInPandas(Budget(order, columns), kinds, "Append", "None")


class Hits(Ordered):
    def __init__(self, order: Sequence[str], columns: Sequence[str], micros: int):
        super().__init__(order, columns)
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("window", "start long, number int, hits int")

    def begin(self, key: tuple) -> None:
        self.state = tuple(self.value.get()) if self.value.exists() else (None, 0, 0)

    def row(self, key: tuple, r) -> tuple:
        at = _known(r.at)
        self.state = st.hit(self.state, None if at is None else int(at), self.micros)
        return (*key, *[getattr(r, c) for c in self.order], *self.state[1:])

    def end(self) -> None:
        self.value.update(self.state)


def first_hit_windows(df: DataFrame, key: str, ts: str = "ts", order: Sequence[str] = (), limit: int = 300, seconds: int = 60) -> DataFrame:
    """H3: windows that begin with the first request after the last window's end; (key, ts, order, window_no, n, allowed)."""
    own = df.select(key, ts, *order, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    columns = [key, ts, *order, "window_no", "n"]
    made = own.groupBy(key).transformWithStateInPandas(Hits([ts, *order], columns, seconds * 1_000_000), f"{_kinds(own, [key, ts, *order])}, window_no int, n int", "Append", "None")
    return made.withColumn("allowed", F.col("n") <= limit)


class Steps(Ordered):
    """A run's steps are entries of a map, so a batch reads and writes those it names."""

    def __init__(self, order: Sequence[str], columns: Sequence[str], steps: Sequence[str], gate: str, retries: int):
        super().__init__(order, columns)
        self.place = {name: i for i, name in reversed(list(enumerate(steps)))}
        self.gate, self.retries = gate, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step string", "done boolean, tries int")

    def begin(self, key: tuple) -> None:
        self.held: dict = {}

    def row(self, key: tuple, r) -> tuple:
        name, known = _known(r.step), False
        if name is not None and name not in self.held:
            self.held[name] = tuple(self.steps.getValue((name,))) if self.steps.containsKey((name,)) else (False, 0)
        done, tries = self.held.get(name, (False, 0))
        known = name in self.place
        past = name is not None and self.place.get(name, -1) > self.place.get(self.gate, -1)
        outcome = st.step_outcome(done, tries if known else None, past, _known(r.blocked), _known(r.ok), self.retries)
        if name is not None:
            self.held[name] = (done or outcome == "success", tries + (outcome == "failed" and known))
        return (*key, *[getattr(r, c) for c in self.order], name, outcome)

    def end(self) -> None:
        for name, value in self.held.items():
            self.steps.updateValue((name,), value)


def step_machine(events: DataFrame, key: str, order: str, steps: Sequence[str], gate: str, retries: int = 3) -> DataFrame:
    """(key, order, step, outcome) of each run's events; see the batch form."""
    own = events.select(key, order, F.col("step").alias("step"), "ok", "blocked")
    made = Steps([order], [key, order, "step", "outcome"], steps, gate, retries)
    return own.groupBy(key).transformWithStateInPandas(made, f"{_kinds(own, [key, order])}, step string, outcome string", "Append", "None")


class Cache(StatefulProcessor):
    """An entry's last write, and a timer that forgets it when the watermark passes its expiry."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("entry", "written long, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        last = tuple(self.value.get()) if self.value.exists() else None
        new = max(zip(frame["w"], frame["x"], strict=True))
        if last is None or new > last:
            if last is not None:
                self.handle.deleteTimer(-(-int(last[1]) // 1000))
            self.value.update((int(new[0]), int(new[1])))
            self.handle.registerTimer(-(-int(new[1]) // 1000))  # milliseconds
            yield pd.DataFrame([(*key, "put", int(new[0]), int(new[1]))], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.value.exists():
            written, expires = self.value.get()
            self.value.clear()
            yield pd.DataFrame([(*key, "expired", int(written), int(expires))], columns=self.columns)

    def close(self) -> None: ...


def cache_changes(entries: DataFrame, key: str = "cache_key", expires: str = "expires_at", written: str = "ts", late: str = "0 seconds") -> DataFrame:
    """H7: (key, change, written, expires): put for each batch's last write of a key, expired when the watermark of `written` has passed the expiry. Times are microseconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = entries.withWatermark(written, late).select(key, written, micros(written).alias("w"), micros(expires).alias("x")).where(f"{key} is not null and w is not null and x is not null")
    return own.groupBy(key).transformWithStateInPandas(Cache([key, "change", "written", "expires"]), f"{_kinds(own, [key])}, change string, written long, expires long", "Append", "EventTime")


def held(changes: DataFrame, size: int = 4096, key: str = "cache_key") -> DataFrame:
    """H7: of the changes so far, the `size` entries that expire last among those still held."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("change", "expires"), F.struct("written", "expires", F.col("change") == "expired")).alias("e"))
    return last.where("e.change = 'put'").select(key, F.timestamp_micros("e.expires").alias("expires_at")).orderBy(F.desc("expires_at"), F.asc(key)).limit(size)
