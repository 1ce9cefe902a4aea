"""Parts of the operators that need no session."""

import random
import struct
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarry.llm import chat, media, packing, quality, simhash, substring, tokens, vafile


def test_vint_and_elements():
    assert media.vint(1) == b"\x81" and media.vint(126) == b"\xfe" and media.vint(127) == b"\x40\x7f"
    for n in (0, 126, 127, 16382, 16383, 10**9):
        got, k, _ = media._number(media.vint(n), 0)
        assert (got, k) == (n, len(media.vint(n)))


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 8, 576 * 8 * 32, 576 * 8 * 33 + 5])
def test_mux_round_trip(size):
    data = media.padded(random.Random(size).randbytes(size))
    blob = media.mux(data)
    got = media.demux(blob)
    assert got["error"] is None and b"".join(blob[s:e] for *_, s, e in got["packets"]) == data
    assert all(e - s == 576 for *_, s, e in got["packets"])
    assert got["tracks"][1]["codec"] == "A_PCM/INT/LIT" and got["tracks"][1]["depth"] == 8
    for ms, track, at in got["cues"]:
        assert blob[at : at + 4] == b"\x1fC\xb6u" and track == 1
    assert [p[1] for p in got["packets"]] == sorted(p[1] for p in got["packets"])


def wrap(block: bytes, unknown: bool = False) -> bytes:
    cluster = media.uint(media.TIME, 100) + media.element(media.SIMPLE, block)
    body = b"\x1fC\xb6u\x01\xff\xff\xff\xff\xff\xff\xff" + cluster if unknown else media.element(media.CLUSTER, cluster)
    return media.element(media.EBML, b"") + media.element(media.SEGMENT, body + (media.element(media.CUES, b"") if unknown else b""))


@pytest.mark.parametrize("unknown", [False, True])
def test_lacing(unknown):
    head = b"\x81" + struct.pack(">h", 5)
    xiph = head + b"\x82" + bytes([2, 255, 45, 10]) + b"a" * 300 + b"b" * 10 + b"c" * 7
    ebml = head + b"\x86" + bytes([2]) + media.vint(20) + bytes([0x80 | (63 - 5)]) + b"a" * 20 + b"b" * 15 + b"c" * 7
    for block, sizes in ((xiph, [300, 10, 7]), (ebml, [20, 15, 7]), (head + b"\x80" + b"x" * 9, [9])):
        got = media.demux(wrap(block, unknown))
        assert got["error"] is None and [e - s for *_, s, e in got["packets"]] == sizes and {p[1] for p in got["packets"]} == {105}


def test_broken_media():
    blob = media.mux(media.padded(b"x" * 5000))
    assert media.demux(b"nothing")["error"] and media.demux(b"")["error"]
    for cut in range(1, len(blob), 997):
        media.demux(blob[:cut])  # never raises


def test_no_bytes_raise():
    rnd = random.Random(6)
    blob = media.mux(media.padded(rnd.randbytes(9000)))
    for _ in range(3000):
        own = bytearray(blob)
        for _ in range(rnd.randrange(1, 12)):
            own[rnd.randrange(400 if rnd.random() < 0.7 else len(own))] = rnd.choice([0, 1, 0x80, 0xA0, 0xA1, 0xA3, 0xE7, 0xFF, rnd.randrange(256)])
        media.demux(bytes(own))
    deep = b""
    for _ in range(3000):
        deep = media.element(media.CLUSTER, deep)
    assert media.demux(media.element(media.EBML, b"") + deep)["error"] == "nested too deeply"
    long = media.element(media.EBML, b"") + media.element(media.SEGMENT, media.element(media.CLUSTER, media.element(media.TIME, b"\xff" * 200)))
    assert media.demux(long)["error"] == "number of over 8 bytes"


def test_frame_times():
    blob = media.mux(media.padded(b"x" * 576 * 20))
    assert [p[1] for p in media.demux(blob)["packets"]] == [72.0 * i for i in range(20)] and all(p[2] for p in media.demux(blob)["packets"])
    xiph = b"\x81" + struct.pack(">h", 5) + b"\x02" + bytes([2, 3, 4]) + b"abcdefghi"
    refers = media.element(media.REFERS, b"\xff")
    for more, key, step in ((b"", True, 0), (refers, False, 0), (refers + media.uint(media.BLOCK_LASTS, 30), False, 10)):
        cluster = media.element(media.CLUSTER, media.uint(media.TIME, 100) + media.element(media.GROUP, media.element(media.BLOCK, xiph) + more))
        got = media.demux(media.element(media.EBML, b"") + media.element(media.SEGMENT, cluster))
        assert got["error"] is None and [p[1:3] for p in got["packets"]] == [(105.0 + i * step, key) for i in range(3)]


def test_laces_of_any_kind_and_number():
    """Blocks of one to five frames in every lacing are read, with the blocks around them; a broken block between loses its own frames only."""
    rnd = random.Random(11)
    head = lambda flags: b"\x81" + struct.pack(">h", 0) + bytes([flags])
    file = lambda blocks: media.element(media.EBML, b"") + media.element(media.SEGMENT, media.element(media.CLUSTER, media.uint(media.TIME, 1) + b"".join(media.element(media.SIMPLE, b) for b in blocks)))
    read = lambda data: [data[s:e] for *_, s, e in media.demux(data)["packets"]]
    for _ in range(300):
        n, kind = rnd.randrange(1, 6), rnd.choice([2, 4, 6])
        frames = [rnd.randbytes(rnd.randrange(0, 700)) for _ in range(n)]
        if kind == 4:
            frames = [rnd.randbytes(len(frames[0])) for _ in range(n)]
        sizes = b""
        if kind == 2:
            sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
        elif kind == 6 and n > 1:
            sizes = media.vint(len(frames[0])) + b"".join(struct.pack(">H", 0x4000 + 0x1FFF + len(b) - len(a)) for a, b in zip(frames, frames[1:-1], strict=False))
        block = head(0x80 | kind) + bytes([n - 1]) + sizes + b"".join(frames)
        around = [head(0x80) + b"before", head(0x80) + b"after"]
        data = file([around[0], block, around[1]])
        assert media.demux(data)["error"] is None and read(data) == [b"before", *frames, b"after"]
        bad = rnd.choice([head(0x84) + b"\x02" + b"xxxx", head(0x82) + b"\x01\xff", head(0x82) + b"\x01\x09abc", head(0x86) + b"\x02\x88", head(0x86), b"\x81", b""])
        data = file([around[0], bad, block, around[1]])
        assert media.demux(data)["error"] and read(data) == [b"before", *frames, b"after"]


def test_escape():
    for t in ("", "\\", "<|im_end|>", "\\<|", "<<||", "a\\nb", "<\\|x", "line\nline"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        for role in ("user", "assistant", "<|im_start|>\n\\n", ""):
            s, a, b = chat.render(role, t)
            assert chat.parse(s) == (role, t)
            assert chat.unescape(s[a:b]) == (t if role == "assistant" else "")


def test_turns_are_found_in_output_cut_anywhere():
    rnd = random.Random(3)
    said = [(rnd.choice(["user", "assistant", "<|im_end|>\n"]), "".join(rnd.choice(["<|im_end|>\n", "<|im_start|>", "\\", "x", "\n", "<", "|"]) for _ in range(rnd.randrange(6)))) for _ in range(60)]
    whole = "".join(chat.render(*x)[0] for x in said)
    for step in (1, 3, 17, len(whole)):
        t = chat.Turns()
        assert [x for at in range(0, len(whole), step) for x in t.feed(whole[at : at + step])] == said and t.rest == ""


def test_fold():
    e = [(1, 0, 0, "delta", "user", "a"), (1, 0, 1, "delta", "user", "b"), (1, 1, 0, "delta", "assistant", "x"), (1, 1, 1, "regenerate", "", ""), (1, 1, 2, "delta", "assistant", "y"), (1, 2, 0, "delta", "user", "z"), (1, 2, 1, "edit", "", "q"), (2, 0, 0, "message", "user", "m"), (2, 0, 0, "message", "user", "m")]
    assert list(chat.fold(e)) == [(1, 0, "user", "ab"), (1, 1, "assistant", "y"), (1, 2, "user", "q"), (2, 0, "user", "m"), (2, 0, "user", "m")]
    with pytest.raises(ValueError):
        list(chat.fold([(1, 0, 0, "odd", "", "")]))


def test_best_fit():
    rnd = random.Random(5)
    for _ in range(50):
        fills = [rnd.randrange(1, 101) for _ in range(rnd.randrange(0, 60))]
        bins = packing.best_fit(fills, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(fills)))
        assert all(sum(fills[i] for i in b) <= 100 for b in bins)
        room: list[int] = []
        for n in sorted(fills, reverse=True):  # the same by a plain search
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                room.append(100 - n)
            else:
                room.remove(fit)
                room.append(fit - n)
        assert len(bins) == len(room)


def test_grid_bounds_and_what_is_kept():
    rng = np.random.default_rng(1)
    for scale in (3, 256, 10_000):
        x, q = rng.integers(-scale, scale + 1, (300, 16)), rng.integers(-scale, scale + 1, (20, 16))
        grid = vafile.Grid(x.min(0), x.max(0))
        cells, exact = grid.cells(x), q @ x.T
        middle, spread = grid.middles(q.astype(float), cells), grid.spread(q.astype(float))[:, None]
        assert (middle - spread <= exact).all() and (exact <= middle + spread).all()
        ids, q_ids = np.arange(300), np.arange(20)
        for held in (10**6, 50):
            blocks = ((ids[a : a + 70], ids[a : a + 70], cells[a : a + 70]) for a in range(0, 300, 70))
            i, keys, _ = vafile.kept(grid, q.astype(float), q_ids, blocks, 5, held)
            for r in range(20):
                best = [v for _, v in sorted((-int(exact[r, v]), v) for v in range(300) if v != r)[:5]]
                assert set(best) <= set(keys[i == r].tolist()) and r not in keys[i == r]
        assert len(keys) < 20 * 60


def test_majority_and_chain():
    rnd = random.Random(7)
    hashes = [[rnd.getrandbits(64) for _ in range(n)] for n in (0, 1, 2, 255, 256, 600)]
    got = simhash.majority(np.array([h for x in hashes for h in x], np.uint64), [len(x) for x in hashes])
    for fp, x in zip(got.tolist(), hashes, strict=True):
        assert fp == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in x) > len(x))
    for _ in range(2000):  # the principle: at most 3 bits differ, so some chain passes; and a key of it is equal
        bits = rnd.sample(range(64), rnd.randrange(0, 4))
        x = np.array([sum(1 << b for b in bits)], np.uint64)
        starts = [s for s in range(5) if simhash.chain(x, s, 3)[0]]
        seg = simhash.segments(x)[0]
        assert starts and any(seg[s] == 0 and (seg[(s + 1) % 5] == 0 or seg[(s + 2) % 5] == 0) for s in starts)


def test_forest_connects_like_all_pairs(monkeypatch):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = np.array(sorted({b ^ sum(1 << i for i in rnd.sample(range(30, 64), rnd.randrange(0, 4))) for b in base for _ in range(15)}), np.uint64)

    def parts(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(fps))]

    def linked(start):
        return [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if simhash.chain(np.array([fps[i] ^ fps[j]], np.uint64), start, 3)[0]]

    for start in range(5):
        want = parts(linked(start))
        assert parts(simhash.forest(fps, start)) == want
        monkeypatch.setattr(simhash, "LARGE", 10)
        assert parts(simhash.forest(fps, start)) == want
        monkeypatch.undo()


def test_automaton():
    rnd = random.Random(2)
    seqs = [[rnd.choice("ab") for _ in range(rnd.randrange(0, 25))] for _ in range(30)]
    a = substring.Automaton()
    have: set = set()
    for s in seqs:
        want = []
        for i in range(len(s)):
            want.append(max((n for n in range(i + 2) if tuple(s[i + 1 - n : i + 1]) in have or n == 0)))
        assert a.statistics(s) == want
        a.add(s)
        have |= {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}


def test_word_hashes():
    data = b"  ab c\tab\n\x0bba abc\x1cd \xc2\xa0x ab"
    starts, h = substring.word_hashes(np.frombuffer(data, np.uint8))
    words = data.split()
    assert [data[i : i + len(w)] for i, w in zip(starts.tolist(), words, strict=True)] == words
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[2] == h[-1]


def test_stretches_hold_every_window_once():
    rnd = random.Random(4)
    words = [[rnd.choice([b"x", b"y", b"zz"]) for _ in range(n)] for n in (19, 20, 21, 90)]
    h, doc, start, n = substring.stretches([5, 6, 7, 8], [b"\n".join(w) for w in words], 20)
    got = sorted((d, s + j) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True) for j in range(k))
    assert got == [(d, i) for d, w in zip((5, 6, 7, 8), words, strict=True) for i in range(len(w) - 19)]
    # equal windows have equal minimizers
    by: dict = {}
    for hh, d, s, k in zip(h.tolist(), doc.tolist(), start.tolist(), n.tolist(), strict=True):
        for j in range(k):
            by.setdefault(tuple(words[d - 5][s + j : s + j + 20]), set()).add(hh)
    assert all(len(x) == 1 for x in by.values())


def test_weak_labels():
    assert quality.votes("") == (1, 1, 1, -1, -1, -1, -1)
    assert quality.votes("LOUD WORDS IN CAPITALS")[0] == 0 and quality.votes("wor### oth$$$ and### the&&&")[1] == 0
    assert quality.shape("Wörd42!!") == "Axaa00!!"
    p, rate = quality.fit_labellers([((1, 1, 1), 90), ((0, 1, 1), 5), ((1, 0, -1), 5)])
    assert 0.8 < p[0] < 0.98 and quality.posterior(np.array([[1, 1, 1]]), p, rate)[0] > 0.9 > 0.5 > quality.posterior(np.array([[0, 1, 1]]), p, rate)[0]
    w, b = quality.fit_scorer([(np.array([1, 2]), np.array([1, 1])), (np.array([3]), np.array([1]))] * 50, np.array([1.0, 0.0] * 50))
    assert b + w[1] + w[2] > 0 > b + 2 * w[3]


def test_sample_bound():
    share = lambda total, sample: (quality.bound(total, sample) + 2**63) / 2**64
    for total in (10**5, 10**11, 10**15):
        assert abs(share(total, 8000) * total / 8000 - 1) < 0.01
    assert quality.bound(10, 8000) == quality.bound(0, 8000) == 2**63 - 1


def test_counted_features():
    at, k = quality.counted("one two two three three three")
    assert k.sum() == 2 * 6 + 3 and k[at == quality.REPEATED] == 3
    at, k = quality.counted(" ".join(f"w{i}x" for i in range(50_000)))
    assert len(at) == quality.SLOTS and len(set(at.tolist())) == quality.SLOTS
    assert len(quality.counted("")[0]) == 0


def test_byte_bpe_equals_tokenizers():
    p = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    spec = open(p.path("byte_bpe_50k.json"), encoding="utf-8").read()
    t = Tokenizer.from_str(spec)
    texts = ["", " ", "a  b", "\n\n x", "it's 12,000 naïve ☃ 東京\t\r\n", "<|endoftext|>", "x" * 3000, "    end ", "a<|endoftext|> b", "a \n b", "a\u3000 b \u3000c", "\x1c a \x1c b", " lead", "a\u180e b", "it 's don' t", "y" * 70 + " " + "y" * 70]
    mine = tokens.ByteBPE(spec)
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert mine._cut
    for _ in range(2):  # the second time from the cache
        assert mine.ids(texts) == want
    assert max(map(len, mine._known)) <= tokens.LONG
    mine._cut = False
    assert mine.ids(texts) == want


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 5) + struct.pack("<f", v) for k, v in parts)


def test_unigram_model_is_rebuilt():
    spm = pytest.importorskip("sentencepiece")
    bytes_ = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *bytes_, ("▁", -3.0, 1), ("▁the", -2.0, 1), ("the", -4.0, 1), ("▁c", -3.5, 1), ("at", -2.5, 1), ("a", -5.0, 1), ("t", -5.0, 1), ("c", -5.0, 1), ("h", -6.0, 1), ("e", -6.0, 1)]
    model = message(*[(1, message((1, p.encode()), (2, float(s)), (3, k))) for p, s, k in vocab], (2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    p = tokens.Pieces(model, 1)
    texts = ["the cat", "the  cat at ", "hat é", "", "tthe"]
    got = p.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i, _, _ in got] == spm.SentencePieceProcessor(model_proto=model).encode(texts)
    assert all(same for *_, same in got) and got[0][1] == "the cat" and got[2][1] == "hat é"


def test_bpe_model_is_rebuilt():
    p = pytest.importorskip("public_tokenizers")
    m = tokens.Pieces(open(p.path("piece_bpe_32k.model"), "rb").read(), 1)
    texts = ["", " ", "a  b", "  lead", "trail ", "x y\tz", "日本語 text ☃", "a\n\nb", "<s> </s>", "▁ ▁▁a"]
    for _ in range(2):  # the second time from the cache
        got = m.encode(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i, _, _ in got] == m.original.encode(texts) and all(x for *_, x in got)
        assert [b for _, b, _ in got] == [m.original.decode(np.frombuffer(i, "<u4").tolist()) for i, _, _ in got]


def spent(f):
    """What f gives, and the CPU seconds it took."""
    began = time.process_time()
    got = f()
    return got, time.process_time() - began


def odd_texts(seed, n):
    parts = ["a", "Z", "the", "é", "ß", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'ll", "1", "23", ".", ",!", "\x00", "\x1c", "\x7f", "\xa0", "᠎", "²", "×", "½", "א", "東", "☃", "😀", "́", "<|endoftext|>", "<|", "▁", "<0x0A>", "y" * 20]
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(n)]


def small_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    return [t or "" for t in texts]


def test_byte_bpe_known_words_cost_little():
    p = pytest.importorskip("public_tokenizers")
    mine, texts = tokens.ByteBPE(open(p.path("byte_bpe_50k.json"), encoding="utf-8").read()), small_documents()
    want, whole = spent(lambda: mine._tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    first, _ = spent(lambda: mine.ids(texts))
    again, known = spent(lambda: mine.ids(texts))
    assert first == again == [np.array(e.ids, "<u4").tobytes() for e in want]
    assert known < 0.15 * whole


def test_byte_bpe_cuts_only_where_the_rule_does():
    p = pytest.importorskip("public_tokenizers")
    mine = tokens.ByteBPE(open(p.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for size in (tokens.CACHED, 100):  # the smaller cache begins anew after every call
        mine._known.size = size
        for seed in range(6):
            texts = odd_texts(seed, 400)
            assert mine.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in mine._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert mine.ids([]) == []
    assert tokens.cuts(np.frombuffer("a b.\nc1 'x é\t\n".encode(), np.uint8)).nonzero()[0].tolist() == [1, 3, 4, 5, 6, 7, 10]


def test_known_words():
    k = tokens.Known()
    words = [f"w{i}" for i in range(30_000)] + ["é" * 7, "x" * 15, "a\0", "a"]
    raw = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    starts, asked = np.append(0, ends[:-1]), []

    def encode(new, inside):
        asked.extend(new)
        return np.array([zlib.crc32(w.encode()) for w in new for _ in range(len(w) % 3)], "<u4"), np.array([len(w) % 3 for w in new], np.int64)

    want = [zlib.crc32(w.encode()).to_bytes(4, "little") * (len(w) % 3) for w in words]
    for _ in range(2):
        assert k.ids(raw, starts, ends, np.zeros(len(words), bool), np.arange(len(words) + 1), encode) == want
    assert sorted(asked) == sorted(words) == sorted(k)
    k["w7"] = b"\1\0\0\0" * 5
    assert k.ids(b"w7w7", np.array([0, 2]), np.array([2, 4]), np.zeros(2, bool), np.array([0, 0, 2]), encode) == [b"", b"\1\0\0\0" * 10]
    k.ids(b"w7", np.array([0]), np.array([2]), np.array([True]), np.array([0, 1]), encode)
    assert asked[len(words) :] == ["w7"]  # inside another word it is a word of its own
    with pytest.raises(ValueError):
        k["x" * 16] = b""


def test_pieces_known_words_cost_little():
    p = pytest.importorskip("public_tokenizers")
    m, texts = tokens.Pieces(open(p.path("piece_bpe_32k.model"), "rb").read(), 1), small_documents()
    want, whole = spent(lambda: m.original.encode(texts, num_threads=1))
    first, _ = spent(lambda: m.ids(texts))
    again, known = spent(lambda: m.ids(texts))
    assert first == again == [np.array(w, "<u4").tobytes() for w in want]
    assert known < 0.4 * whole


def test_pieces_of_odd_texts():
    p = pytest.importorskip("public_tokenizers")
    m = tokens.Pieces(open(p.path("piece_bpe_32k.model"), "rb").read(), 1)
    assert m._lines
    for size in (tokens.CACHED, 100):
        m._known.size = size
        for seed in range(6):
            texts = odd_texts(seed, 400)
            want = m.original.encode(texts)
            for (ids, back, same), w, t in zip(m.encode(texts), want, texts, strict=True):
                assert same and ids == np.array(w, "<u4").tobytes() and back == m.tokenizer.decode(w, skip_special_tokens=False), t
    marks = [next(i for i, (x, *_) in enumerate(m.model["pieces"]) if x == f"<0x{b:02X}>") for b in "▁".encode()]
    assert m.decode([np.array(marks, "<u4").tobytes()]) == [m.tokenizer.decode(marks, skip_special_tokens=False)] == ["▁"]  # a marker of bytes is no space
