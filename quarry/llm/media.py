"""Media columns: Matroska bytes to packet tables and back.

A reader for EBML's variable-length elements that lists a file's tracks, packets (with timestamps and byte ranges, laced or
not) and cues, and a writer that stores 8-bit mono PCM samples in clusters of laced SimpleBlocks with cues.

Defined results: a null payload is an empty one; a file that breaks off or isn't EBML gives the packets before the break and
`error` set, whatever the bytes are (numbers of over 8 bytes and nesting deeper than DEEPEST count as broken); equal payloads give equal
files (no dates, no random ids). A laced frame's time is its block's and, for each frame before it, the block's duration shared out
or else the track's default duration. A block of a group is a key frame if it refers to no other block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of EBML (RFC 8794) and Matroska (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
SIMPLE, BLOCK, SCALE, TIME, NUMBER, KIND, CODEC, RATE, CHANNELS, DEPTH, UID, LASTING, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xA3, 0xA1, 0x2AD7B1, 0xE7, 0xD7, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0x73C5, 0x9C, 0xB3, 0xF7, 0xF1
EACH, BLOCK_LASTS, REFERS = 0x23E383, 0x9B, 0xFB
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
#: A cluster of unknown size ends where one of these begins.
TOP = {CLUSTER, CUES, TRACKS, INFO, EBML, SEGMENT}

FRAME, LACED, PER_CLUSTER, HERTZ = 576, 8, 32, 8000
#: Levels of elements within elements.
DEEPEST = 32


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(n: int) -> bytes:
    """An element size in as few bytes as it fits (all ones is kept for "unknown")."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(x: int, body: bytes) -> bytes:
    return _id(x) + vint(len(body)) + body


def uint(x: int, n: int) -> bytes:
    return element(x, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def mux(payload: bytes, frame: int = FRAME, laced: int = LACED, per_cluster: int = PER_CLUSTER, hertz: int = HERTZ) -> bytes:
    """payload, a multiple of frame bytes, as one PCM track: fixed-size lacing of `laced` frames a block, `per_cluster` blocks a cluster, one cue a cluster."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"quarry") + element(0x5741, b"quarry"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", hertz)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(LASTING, 1) + uint(EACH, frame * 1_000_000_000 // hertz) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = frame * laced
    for c in range(0, len(payload), step * per_cluster):
        start = c * 1000 // hertz
        blocks = [uint(TIME, start)]
        for b in range(c, min(c + step * per_cluster, len(payload)), step):
            data = payload[b : b + step]
            n = len(data) // frame
            laces = (b"\x84" + bytes([n - 1])) if n > 1 else b"\x80"
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">h", b * 1000 // hertz - start) + laces + data))
        parts.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE, uint(CUE_TIME, start) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def _number(data: bytes, at: int) -> tuple[int, int, int]:
    """A variable-length number: value without the marker, its length, value if unknown (-1 else)."""
    first = data[at]
    if not first:
        raise ValueError("number of over 8 bytes")
    k = 9 - first.bit_length()
    if at + k > len(data):
        raise ValueError("cut off")
    n = int.from_bytes(data[at : at + k], "big") & ((1 << 7 * k) - 1)
    return n, k, (1 << 7 * k) - 1


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body) from at to end; of a cluster of unknown size, up to the next top element."""
    while at < end:
        n, k, _ = _number(data, at)
        x = n | 1 << 7 * k
        if inside and x in TOP:
            return
        size, m, unknown = _number(data, at + k)
        body = at + k + m
        stop = end if size == unknown else body + size
        if size == unknown and x == CLUSTER:
            stop = body
            for *_, stop in elements(data, body, end, x):  # noqa: B007
                pass
        if stop > end:
            raise ValueError("cut off")
        yield x, at, body, stop
        at = stop


def laces(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """Start and end of each frame of a block: no, Xiph, fixed-size or EBML lacing."""
    kind = flags & 6
    if not kind:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 6:
        for i in range(n - 1):
            v, k, top = _number(data, at)
            at += k
            sizes.append(v if not i else sizes[-1] + v - (top >> 1))
    else:
        if (end - at) % n:
            raise ValueError("laces of unequal size")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError("laces beyond the block")
    return [*out, (at, end)]


NUMBERS = {NUMBER: "number", KIND: "kind", EACH: "each", CHANNELS: "channels", DEPTH: "depth", CUE_TIME: "ms", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}


def demux(data: bytes) -> dict:
    """tracks: number to {codec, rate, depth, …}; packets: (track, ms, keyframe, start, end) in file order; cues: (ms, track, cluster's byte); error: what is wrong first, or None. A broken block loses its own frames only; a broken element ends the reading."""
    out: dict = {"tracks": {}, "packets": [], "cues": [], "error": None}
    state = {"scale": 1_000_000, "time": 0, "segment": 0}

    def whole(a: int, b: int) -> int:
        if b - a > 8:
            raise ValueError("number of over 8 bytes")
        return int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, key: bool | None, lasts: int | None = None) -> None:
        track, k, _ = _number(data, a)
        if a + k + 3 + bool(data[a + k + 2] & 6) > b:
            raise ValueError("block without a head")
        (delta,) = struct.unpack_from(">h", data, a + k)
        flags = data[a + k + 2]
        own = laces(data, a + k + 3, b, flags)
        ms = (state["time"] + delta) * state["scale"] / 1e6
        step = lasts * state["scale"] / 1e6 / len(own) if lasts is not None else out["tracks"].get(track, {}).get("each", 0) / 1e6
        out["packets"] += [(track, ms + i * step, bool(flags & 128) if key is None else key, s, e) for i, (s, e) in enumerate(own)]

    def group(a: int, b: int) -> None:
        own = list(elements(data, a, b))
        lasts = [whole(s, e) for x, _, s, e in own if x == BLOCK_LASTS]
        for x, _, s, e in own:
            if x == BLOCK:
                block(s, e, all(y != REFERS for y, *_ in own), lasts[0] if lasts else None)

    def tried(read: Callable, *args) -> None:
        try:
            read(*args)
        except (ValueError, IndexError, struct.error) as e:
            out["error"] = out["error"] or str(e) or "broken block"

    def walk(at: int, end: int, of: dict, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        for x, _, a, b in elements(data, at, end):
            if x == TRACK:
                own: dict = {}
                walk(a, b, own, depth + 1)
                out["tracks"][own.pop("number", 0)] = own
            elif x == CUE:
                own = {}
                walk(a, b, own, depth + 1)
                out["cues"].append((own.get("ms", 0), own.get("track", 0), own.get("cluster", 0) + state["segment"]))
            elif x == GROUP:
                tried(group, a, b)
            elif x in MASTERS:
                if x == SEGMENT:
                    state["segment"] = a
                walk(a, b, of, depth + 1)
            elif x == SIMPLE:
                tried(block, a, b, None)
            elif x == TIME:
                state["time"] = whole(a, b)
            elif x == SCALE:
                state["scale"] = whole(a, b)
            elif x == CODEC:
                of["codec"] = data[a:b].decode("ascii", "replace")
            elif x == RATE:
                of["rate"] = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]
            elif x in NUMBERS:
                of[NUMBERS[x]] = whole(a, b)

    try:
        if data[:4] != _id(EBML):
            raise ValueError("no EBML header")
        walk(0, len(data), {})
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = out["error"] or str(e)
    return out


def features(samples: np.ndarray, packets: int, clusters: int) -> str:
    """Rounded figures of 8-bit samples (128 is silence)."""
    if not len(samples):
        return "packets=0"
    x = samples.astype(np.int64) - 128
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={packets};clusters={clusters};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={turns};entropy={-(p * np.log2(p)).sum():.4f}"


def padded(data: bytes, to: int = FRAME) -> bytes:
    """data with bytes 255 up to a positive multiple of `to`."""
    return data + b"\xff" * (to - len(data) % to if len(data) % to or not data else 0)


def encode_media(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text (null: empty) as a Matroska file: the columns of keep, n_bytes (of the text) and media (the file)."""
    one = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = one.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [x.encode() for x in part.column("__text").to_pylist()]
                cols = [part.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())], [*keep, "n_bytes", "media"])

    return one.mapInArrow(write, schema)


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What a column of Matroska files holds: payload (the packets' bytes in order) as its size, digest and tail checksum, the file's size and digest, and features of the samples. Where the file is broken there is an error and no payload."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = ["long", "string", "long", "long", "string", "string", "string"]
    one = df.select(*keep, F.col(media).alias("__media"))
    schema = one.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)]).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("__media"):
                data = m.as_py() or b""
                got = demux(data)
                payload = b"".join([data[s:e] for _, _, _, s, e in got["packets"]])
                if got["error"]:
                    rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, got["error"]))
                    continue
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(np.frombuffer(payload, np.uint8), len(got["packets"]), len(got["cues"])), got["error"]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)]], [*keep, *names])

    return one.mapInArrow(read, schema)


def packet_table(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per packet: keep, track, ms, keyframe, byte_start, byte_end (a half-open range of the file)."""
    one = df.select(*keep, F.col(media).alias("__media"))
    schema = one.select(*keep, F.lit(0).cast("long").alias("track"), F.lit(0.0).alias("ms"), F.lit(True).alias("keyframe"), F.lit(0).cast("long").alias("byte_start"), F.lit(0).cast("long").alias("byte_end")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [demux(m.as_py() or b"")["packets"] for m in b.column("__media")]
            which = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = list(zip(*[p for f in found for p in f], strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(which) for k in keep], *[pa.array(c, t) for c, t in zip(flat, kinds, strict=True)]], [*keep, "track", "ms", "keyframe", "byte_start", "byte_end"])

    return one.mapInArrow(read, schema)
