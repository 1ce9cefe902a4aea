"""Chat formatting: conversations rebuilt from event logs and rendered with a turn template.

An event is (conv, turn, seq, kind, role, text). Logs are partitioned by conversation and sorted by (turn, seq), so each
partition is folded as a stream: only the open turn's text is held, however long a conversation is. Kinds:

- message: a whole turn; always a turn of its own, also where conv and turn repeat
- delta: text appended to the turn (opened with the event's role)
- edit: replaces the turn's text, and its role if the event has one
- regenerate: empties the turn; later deltas fill it anew

Defined results: null text or role is empty; null conv is a conversation of its own; events of equal (turn, seq) go by kind,
role and text. The template is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside role and text a backslash becomes two and `<|`
becomes `<\\|` (in roles also newline becomes `\\n`), so no control string can appear there and each text reads back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
COLUMNS = ("conv", "turn", "seq", "kind", "role", "text")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and where the loss mask begins and ends in it (equal unless the assistant speaks)."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    end = len(head) + len(body)
    return f"{head}{body}{END}\n", len(head) if role == "assistant" else end, end


def parse(turn: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    if not turn.startswith(START) or not turn.endswith(f"{END}\n"):
        raise ValueError("not a turn")
    role, _, text = turn[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


class Turns:
    """Finds the turns in a conversation's output, which may come in pieces cut anywhere; only an open turn is held."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, output: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that ends in what has come so far. An end mark within a text is escaped, so it ends none."""
        *whole, self.rest = (self.rest + output).split(f"{END}\n")
        for turn in whole:
            yield parse(f"{turn}{END}\n")


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv, turn, role, text) of each final message, from events sorted by conv, turn and seq."""
    key, role, parts = None, "", []
    for conv, turn, _, kind, who, text in events:
        if key is not None and (kind == "message" or key != (conv, turn)):
            yield (*key, role, "".join(parts))
            key = None
        if kind == "message":
            yield conv, turn, who, text
            continue
        if key is None:
            key, role, parts = (conv, turn), who, []
        if kind == "delta":
            parts.append(text)
        elif kind == "edit":
            role, parts = who or role, [text]
        elif kind == "regenerate":
            role, parts = who or role, []
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if key is not None:
        yield (*key, role, "".join(parts))


def events(df: DataFrame, conv: str | Column, turn: str | Column, seq: Column, kind: Column, role: str | Column, text: str | Column) -> DataFrame:
    """The columns that fold() takes, from any table."""
    own = lambda c: F.col(c) if isinstance(c, str) else c
    none = lambda c: F.coalesce(own(c).cast("string"), F.lit(""))
    return df.select(own(conv).cast("long").alias("conv"), own(turn).cast("long").alias("turn"), seq.cast("long").alias("seq"), kind.alias("kind"), none(role).alias("role"), none(text).alias("text"))


def _sorted(log: DataFrame) -> DataFrame:
    return log.select(*COLUMNS).repartition("conv").sortWithinPartitions(*COLUMNS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in COLUMNS], strict=True)


def format_turns(log: DataFrame) -> DataFrame:
    """A row per final message: conv, turn, formatted, and char_start, loss_start and loss_end within the conversation's whole output."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv", "turn", "formatted", "char_start", "loss_start", "loss_end"])

        rows, held, last, at = [], 0, (), 0
        for conv, turn, role, text in fold(_rows(batches)):
            if (conv,) != last:
                last, at = (conv,), 0
            s, a, b = render(role, text)
            rows.append((conv, turn, s, at, at + a, at + b))
            at, held = at + len(s), held + len(s)
            if held > 4_000_000 or len(rows) >= 5000:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)

    return _sorted(log).mapInArrow(turns, "conv long, turn long, formatted string, char_start long, loss_start long, loss_end long")


def format_digests(log: DataFrame) -> DataFrame:
    """A row per conversation, read back from its rendered turns as they stream by: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        rows, last, n = [], (), 0
        for conv, _, role, text in fold(_rows(batches)):
            if (conv,) != last:
                if last:
                    rows.append((*last, n, whole.hexdigest(), lost, loss.hexdigest(), size))
                if len(rows) >= 5000:
                    yield out(rows)
                    rows = []
                last, n, lost, size, whole, loss, found = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256(), Turns()
            s, a, b = render(role, text)
            for back, said in found.feed(s):
                whole.update(f"{back}\n{said}\n".encode())
                n += 1
            masked = unescape(s[a:b])
            loss.update(masked.encode())
            lost, size = lost + len(masked), size + len(s)
        if last:
            rows.append((*last, n, whole.hexdigest(), lost, loss.hexdigest(), size))
        if rows:
            yield out(rows)

    return _sorted(log).mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
