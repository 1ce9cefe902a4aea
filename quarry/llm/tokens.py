"""Token ids of whole texts by the tokenizers library, with a cache of words.

Byte-level BPE (ByteBPE): the file's own cutting rule begins a new piece before white space after a letter, after a lone line end, and
where ASCII letters, digits and other signs meet; texts are cut there, each different word is encoded by the library once while the
worker's cache (Known) keeps it, and joined again. Files whose pipeline is not known to have that property are encoded whole.

SentencePiece models (Pieces): the protobuf is parsed here and rebuilt as a tokenizers pipeline: its normaliser, the marker for
spaces, unigram scores or BPE merges, byte fallback and decoder. No piece of the vocabulary has the marker after another
character (checked when a model is loaded; else texts are encoded whole), so no token spans a space between two words, and texts
are cut there, and before line ends if no piece of the vocabulary has one. Decoding is the library's, of each text's whole ids;
parity compares them with the sentencepiece library's ids of the whole text.

Words of over LONG bytes are encoded each time, so the cache is bounded in bytes, too. Texts of any length and content are encoded:
a text of millions of spaces or of one letter is one word.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import process_cache

#: Words that the cache holds before it begins anew, and bytes of the longest one kept (a key has 16).
CACHED, LONG = 2_000_000, 15
#: Characters encoded together.
TOGETHER = 2_000_000
_ROOM = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


class Known:
    """Ids of words of at most LONG bytes, looked up many at once: an open hash table in arrays.

    A key is a word's bytes and, in the last byte, its length (and 16 if it stands inside a longer word), so words of equal keys are equal.
    """

    def __init__(self, size: int = CACHED):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self._n, self._used = 1, 0  # place 0 is nobody's: its key has a length that no word has
        self._low, self._high = np.zeros(1024, np.uint64), np.full(1024, 2**64 - 1, np.uint64)
        self._start, self._count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._ids, self._slots = np.zeros(4096, "<u4"), np.zeros(1 << 12, np.int32)

    def __iter__(self) -> Iterator[str]:
        for low, high in zip(self._low[1 : self._n].tolist(), self._high[1 : self._n].tolist(), strict=True):
            yield (low.to_bytes(8, "little") + high.to_bytes(8, "little"))[: high >> 56 & 15].decode()

    def __setitem__(self, word: str, ids: bytes) -> None:
        raw = word.encode()
        if len(raw) > LONG:
            raise ValueError("a word too long to be kept")
        low, high = self._keys(np.frombuffer(raw + bytes(16), np.uint8), np.zeros(1, np.int64), np.array([len(raw)]), np.zeros(1, bool))
        at, own = self._find(low, high)[0], np.frombuffer(ids, "<u4")
        if at:
            self._start[at], self._count[at] = self._store(own), len(own)
        else:
            self._add(low, high, own, np.array([len(own)]))

    @staticmethod
    def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low, high = eight[starts] & _ROOM[np.minimum(sizes, 8)], eight[starts + 8] & _ROOM[np.maximum(sizes - 8, 0)]
        return low, high | (sizes + 16 * inside).astype(np.uint64) << np.uint64(56)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(65 - len(self._slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each key's place, or 0."""
        at = self._slot(low, high)
        place = self._slots[at]
        left = np.flatnonzero(((self._low[place] != low) | (self._high[place] != high)) & (place != 0))
        while len(left):
            at[left] = now = at[left] + 1 & len(self._slots) - 1
            place[left] = p = self._slots[now]
            left = left[((self._low[p] != low[left]) | (self._high[p] != high[left])) & (p != 0)]
        return place

    def _store(self, ids: np.ndarray) -> int:
        """Where ids begin, behind all others."""
        at, end = self._used, self._used + len(ids)
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(end, "<u4")])
        self._ids[at:end] = ids
        self._used = end
        return at

    def _append(self, low: np.ndarray | int, high: np.ndarray | int, ids: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
        n, end = self._n, self._n + len(counts)
        if end > len(self._low):
            self._low, self._high, self._start, self._count = (np.concatenate([x, np.zeros(end, x.dtype)]) for x in (self._low, self._high, self._start, self._count))
        self._low[n:end], self._high[n:end], self._count[n:end] = low, high, counts
        self._start[n:end] = self._store(ids) + np.cumsum(counts) - counts
        return n, end

    def _add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> int:
        """The place of the first of these new words; the others follow."""
        n, self._n = self._append(low, high, ids, counts)
        first = n
        if 2 * self._n > len(self._slots):
            self._slots, first = np.zeros(1 << (4 * self._n).bit_length(), np.int32), 1
        left = np.arange(first, self._n, dtype=np.int32)
        at = self._slot(self._low[left], self._high[left])
        while len(left):
            free = self._slots[at] == 0
            self._slots[at[free]] = left[free]
            more = self._slots[at] != left
            left, at = left[more], at[more] + 1 & len(self._slots) - 1
        return n

    def ids(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, bounds: np.ndarray, encode: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """The ids of texts in little-endian unsigned 32-bit integers.

        A word is raw[start:end]; text i has the words bounds[i] to bounds[i + 1]. encode gives the ids of words not kept, and how many each has.
        """
        data, sizes = np.frombuffer(raw + bytes(16), np.uint8), ends - starts
        text = lambda some: [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        low, high = self._keys(data, starts, np.minimum(sizes, LONG), inside)
        place = self._find(low, high).astype(np.int64)
        long = sizes > LONG
        if len(new := np.flatnonzero((place == 0) & ~long)):
            new = new[np.lexsort((low[new], high[new]))]
            other = np.concatenate([[True], (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])])
            some = new[other]
            place[new] = self._add(low[some], high[some], *encode(text(some), inside[some])) + np.cumsum(other) - 1
        used = self._used
        if len(some := np.flatnonzero(long)):
            at: dict = {}
            place[some] = [at.setdefault(k, len(at)) for k in zip(text(some), inside[some].tolist(), strict=True)]
            place[some] += self._append(0, 0, *encode([w for w, _ in at], np.array([x for _, x in at], bool)))[0]  # until the next words come
        counts = self._count[place]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        out = self._ids[np.repeat(self._start[place] - (after - counts), counts) + np.arange(total)].tobytes()
        self._used = used
        if self._n > self.size:
            self.clear()
        cut = (4 * np.concatenate([[0], after])[bounds]).tolist()
        return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def groups(texts: pa.Array | list[str], size: int = TOGETHER) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about size characters."""
    held, n = [], 0
    for t in texts:
        held.append((t if isinstance(t, str) else t.as_py()) or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


# Kinds of bytes: spaces, line ends, ASCII letters, digits and signs (no apostrophe, as 's is one piece), others that are no white
# space; ODD ones may be. Letters of two bytes from U+00C0 on are OTHER: no white space is among them.
ODD, SPACE, END, LETTER, DIGIT, SIGN, OTHER = range(7)
_KIND = np.array([SPACE if c == " " else END if c == "\n" else ODD if not "!" <= c <= "~" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER if c == "'" else SIGN for c in map(chr, range(256))], np.uint8)
#: Is there a cut between two kinds?
_CUT = np.array([[a >= LETTER and (b in (SPACE, END) or LETTER <= b <= SIGN and a != b and a != OTHER) for b in range(8)] for a in range(7)]).reshape(-1)
#: Words that the rule leaves in one piece.
_SINGLE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n").fullmatch


def cuts(data: np.ndarray) -> np.ndarray:
    """Does a word begin at this byte of a text in UTF-8? Only where the rule of byte-level BPE, which looks ahead but not back, begins a piece whatever stands around."""
    kind = _KIND[data]
    two = np.flatnonzero((data >= 0xC3) & (data <= 0xDF))
    kind[two] = kind[two + 1] = OTHER
    begins = np.zeros(len(data), bool)
    begins[1:] = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
    begins[2:] |= (kind[1:-1] == END) & (kind[2:] >= LETTER) & (kind[:-2] >= LETTER)
    return begins


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def _parted(ids: bytes, mark: bytes) -> Iterator[bytes]:
    """What stands before each mark of four bytes."""
    start = at = 0
    while (at := ids.find(mark, at)) >= 0:
        if at % 4:
            at += 1
            continue
        yield ids[start:at]
        start = at = at + 4


class ByteBPE:
    """ids(texts) has each text's ids as little-endian unsigned 32-bit integers: those of the library's encode with add_special_tokens=False."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        own = json.loads(spec)
        first, model = own.get("pre_tokenizer") or {}, own["model"]
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not own.get("normalizer")
        # added tokens are found in a text before it is cut; none may reach over a cut, or take spaces or letters around it into account
        alone = all(" " not in t["content"] and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in own.get("added_tokens", []))
        self._added = [t["content"] for t in own.get("added_tokens", [])]
        self._cut = plain and alone and model["type"] == "BPE" and not model.get("dropout")
        self._known, self._model, self._letters = Known(), self._tokenizer.model, _byte_letters()

    @classmethod
    def of(cls, spec: str) -> ByteBPE:
        """The worker's encoder for a tokenizer.json."""
        own, key = process_cache("byte_bpe"), zlib.crc32(spec.encode())
        if key not in own:
            own[key] = cls(spec)
        return own[key]

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of each word, which may begin with a space, by itself.

        A thousand are encoded together: those without white space inside a line each, as the rule parts a line's end from what stands
        before it and from a space or letter behind it; others with an added token between each two; those that hold one of these alone.
        """
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            kinds[2 if any(t in w for t in self._added) else 0 if w.isprintable() and len(w) > 1 and " " not in w[1:] else 1 if self._added else 2].append(i)
        out = [b""] * len(words)
        for own, mark in zip(kinds, ("\n", self._added[0] if self._added else "", ""), strict=True):
            many = 1000 if mark else 1
            parts = [own[i : i + many] for i in range(0, len(own), many)]
            found = self._tokenizer.encode_batch_fast([mark.join([words[i] for i in p]) + mark for p in parts], add_special_tokens=False)
            cut = _little(self._tokenizer.encode(mark, add_special_tokens=False).ids)
            for p, e in zip(parts, found, strict=True):
                for i, ids in zip(p, _parted(_little(e.ids), cut) if mark else [_little(e.ids)], strict=True):
                    out[i] = ids
        return out

    def _new(self, words: list[str], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are one piece go to the library's model at once, others through its pipeline."""
        single = [_SINGLE(w) is not None for w in words]
        rest = iter(self._each([w for w, s in zip(words, single, strict=True) if not s]))
        lists = [[t.id for t in self._model.tokenize(w.encode().decode("latin-1").translate(self._letters))] if s else _listed(next(rest)) for w, s in zip(words, single, strict=True)]
        return np.array([*chain.from_iterable(lists)], "<u4"), np.array([len(x) for x in lists], np.int64)

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [not self._cut or any(a in t for a in self._added) for t in texts]
        others = iter([_little(e.ids) for e in self._tokenizer.encode_batch_fast([t for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False)])
        held = [b"" if w else t.encode() for t, w in zip(texts, whole, strict=True)]
        raw, ends = b"".join(held), np.cumsum([len(h) for h in held], dtype=np.int64)
        begins = np.append(cuts(np.frombuffer(raw, np.uint8)), True)
        begins[ends] = begins[0] = True
        starts = np.flatnonzero(begins)
        found = self._known.ids(raw, starts[:-1], starts[1:], np.zeros(len(starts) - 1, bool), np.append(0, np.searchsorted(starts, ends)), self._new)
        return [next(others) if w else f for w, f in zip(whole, found, strict=True)]


# SentencePiece

MARK = "▁"
# Numbers of SentencePiece's model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, or bytes of fixed and delimited fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a model")
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        if at + size > len(data):
            raise ValueError("model cut off")
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """pieces (text, score, type), model type, byte_fallback, unk, charsmap, prefix (is a space put first?), squeeze (are runs of spaces one?)."""
    m = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk": 0, "charsmap": b"", "prefix": True, "squeeze": True}
    for k, v in fields(data):
        if k == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(v))
            m["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif k == 2:
            t = dict(fields(v))
            m |= {"type": t.get(3, UNIGRAM), "byte_fallback": bool(t.get(35, 0)), "unk": t.get(40, 0)}
        elif k == 3:
            t = dict(fields(v))
            m |= {"charsmap": t.get(2, b""), "prefix": bool(t.get(3, 1)), "squeeze": bool(t.get(4, 1))}
    return m


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, the best-scored result first."""
    at = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, OWN, UNUSED)}
    found = []
    for p, score, kind in pieces:
        if kind == NORMAL:
            own = sorted((at[p[:i]], at[p[i:]], i) for i in range(1, len(p)) if p[:i] in at and p[i:] in at)
            found += [(-score, at[p], k, p[:i], p[i:]) for k, (_, _, i) in enumerate(own)]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(m: dict):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

    unk = m["pieces"][m["unk"]][0]
    if m["type"] == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m["pieces"]], m["unk"], m["byte_fallback"])
    elif m["type"] == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m["pieces"])}, merges(m["pieces"]), unk_token=unk, fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if m["prefix"] else []
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if separable(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoder(m)
    own = [AddedToken(p, normalized=False) for p, _, kind in m["pieces"] if kind == OWN]
    if own:
        t.add_tokens(own)
    t.encode_special_tokens = True
    return t


def decoder(m: dict, late: bool = False):
    """late: markers become spaces in the whole text, not in each piece."""
    from tokenizers import decoders

    mark, joined = [decoders.Replace(MARK, " ")], [decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence([*(joined + mark if late else mark + joined), *([decoders.Strip(" ", 1, 0)] if m["prefix"] else [])])


def separable(m: dict) -> bool:
    return not any(MARK in p.lstrip(MARK) for p, _, _ in m["pieces"])


class Pieces:
    """Encodes and decodes by a rebuilt SentencePiece model, and says whether the sentencepiece library gives the same ids."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        self.model = parse_model(data)
        self.tokenizer = rebuild(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self._threads = threads
        # texts can be cut before single spaces if the normaliser does nothing across them and every word starts alike
        self._cut = separable(self.model) and not self.model["charsmap"] and self.model["prefix"] and not any(k == OWN for *_, k in self.model["pieces"])
        self._heads = np.array([p.startswith(MARK) for p, *_ in self.model["pieces"]])
        # a line end in no piece is a byte by itself, so texts can be cut before it, too
        pieces = {p for p, _, k in self.model["pieces"] if k != UNUSED}
        self._lines = self.model["byte_fallback"] and {MARK, "<0x0A>"} <= pieces and not any("\n" in p for p in pieces)
        self._mark = next((i for i, (p, *_) in enumerate(self.model["pieces"]) if p == MARK), None)
        self._known = Known()
        # the marker may be replaced at last, in the whole text, unless it can come from bytes
        self._decoders = [self.tokenizer.decoder, decoder(self.model, late=True)]
        self._e2 = next((i for i, (p, *_) in enumerate(self.model["pieces"]) if p == "<0xE2>"), None)

    @classmethod
    def of(cls, data: bytes, threads: int = 2) -> Pieces:
        own, key = process_cache("pieces"), (zlib.crc32(data), threads)
        if key not in own:
            own[key] = cls(data, threads)
        return own[key]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        plain = [self._cut and bool(t) and "  " not in t and MARK not in t and t[0] != " " and t[-1] != " " for t in texts]
        odd = [t for t, p in zip(texts, plain, strict=True) if not p]
        whole = iter([_little(e.ids) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)])
        held = [t.encode() if p else b"" for t, p in zip(texts, plain, strict=True)]
        # every text ends with a space
        raw, after = b" ".join([*held, b""]), np.cumsum([len(h) + 1 for h in held], dtype=np.int64)
        data = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(data == 32)
        starts, inside = np.append(0, ends[:-1] + 1).astype(np.int64), np.zeros(len(ends), bool)
        if self._lines and len(cut := np.setdiff1d(np.flatnonzero(data == 10), starts, assume_unique=True)):
            order = np.argsort(np.concatenate([starts, cut]), kind="stable")
            starts, inside, ends = np.concatenate([starts, cut])[order], np.concatenate([inside, np.ones(len(cut), bool)])[order], np.sort(np.concatenate([ends, cut]))
        # a text that is not plain is one empty word here
        keep = ends > starts
        starts, ends, inside = starts[keep], ends[keep], inside[keep]
        found = self._known.ids(raw, starts, ends, inside, np.append(0, np.searchsorted(starts, after)), self._new)
        return [f if p else next(whole) for p, f in zip(plain, found, strict=True)]

    def _new(self, words: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word by itself. A thousand are encoded as one text; a word's first piece begins with the marker, and no other does. What stands inside a word has none: the marker is a piece by itself before a line end, and goes."""
        lists = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        found, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for own, e in zip(lists, self.tokenizer.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self._heads[ids])
            if len(at) != len(own) or at[0]:
                raise ValueError("words and pieces that begin one differ in number")
            found.append(ids)
            counts.append(np.diff(at, append=len(ids)))
        ids, n = np.concatenate(found), np.concatenate(counts)
        heads = (np.cumsum(n) - n)[inside]
        if (ids[heads] != (self._mark or 0)).any():
            raise ValueError("a marker that is no piece by itself")
        return np.delete(ids, heads), n - inside

    def decode(self, ids: list[bytes]) -> list[str]:
        """The library's decoding of each text's ids."""
        lists = [_listed(i) for i in ids]
        late = [self._e2 not in x for x in lists]
        out = []
        for how, d in enumerate(self._decoders):
            self.tokenizer.decoder = d
            out.append(iter(self.tokenizer.decode_batch([x for x, k in zip(lists, late, strict=True) if k == how], skip_special_tokens=False)))
        self.tokenizer.decoder = self._decoders[0]
        return [next(out[k]) for k in late]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """Each text's ids, what those decode to, and whether the library that the model was made for gives the same ids for the whole text."""
        out = []
        for part in groups(texts, TOGETHER // 8):
            ids = self.ids(part)
            back = self.decode(ids)
            want = self.original.encode(part, num_threads=self._threads)
            out += [(i, b, i == _little(w)) for i, b, w in zip(ids, back, want, strict=True)]
        return out


def _listed(ids: bytes) -> list[int]:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tolist()


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def sentencepieces(df: DataFrame, model: str, threads: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded and parity of every row.

    model: a SentencePiece model's path on the driver; executors get its bytes. decoded: the library's decoding of the
    whole ids. parity: the sentencepiece library gives the same ids for the whole text. A model is unigram or BPE, as its protobuf says. Null and empty texts have no tokens and decode to nothing; repeated rows are encoded alike; null ids are kept.
    """
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens int, " + "ids array<int>, " * with_ids + "ids_crc32 long, decoded string, parity boolean"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.of(shared.value, threads)
        for b in batches:
            at = 0
            for texts in groups(b.column(1)):
                got = p.encode(texts)
                ids = [i for i, _, _ in got]
                cols = [b.column(0).slice(at, len(texts)), pa.array([len(i) // 4 for i in ids], pa.int32())]
                cols += [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))] if with_ids else []
                cols += [pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([d for _, d, _ in got], pa.string()), pa.array([x for *_, x in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_crc32", "decoded", "parity"])
                at += len(texts)

    return one.mapInArrow(encode, schema)
