"""Round trips, brute force and odd rows for the operators on single texts."""

import hashlib
import itertools
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest

from feldspar.llm import bpe, html, langid, quality, secrets, tiff, toolcalls, toxicity
from feldspar.llm.words import NOT_SPACE, WORD_BYTES, shingles, word_hashes, words

ODD = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "naïve café ß Ж 漢字 😀"), (5, "naïve café ß Ж 漢字 😀"), (None, "no id"), (7, "long " * 30000), (8, "x" * 70000), (9, "\0\0")]


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- TIFF


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_tiff_round_trips(scheme):
    r = np.random.default_rng(0)
    for predictor, tiled, order, planar, samples in itertools.product((1, 2), (False, True), "<>", (1, 2), (1, 3)):
        images = [r.integers(0, 9, (h, w, samples)).astype(np.uint8) for h, w in ((70, 130), (1, 1), (64, 64))]
        pages = tiff.read_pages(tiff.write_pages(images, scheme, predictor, tiled, order, planar))
        assert [p[0] for p in pages] == [0, 1, 2]
        for image, p in zip(images, pages):
            assert p[7] is None and p[1:4] == (image.shape[1], image.shape[0], samples)
            assert p[6] == (image if planar == 1 else image.transpose(2, 0, 1)).tobytes()


def test_codecs_on_awkward_bytes():
    for data in (b"", b"a", b"ab", b"aaa" * 5000, bytes(range(256)) * 300, random.Random(1).randbytes(30000), b"abab" * 20000):
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_of_the_format_s_own_example():
    # 7 7 7 8 8 7 7 6 6 -> clear, 7, 258, 8, 8, 258, 6, 6, end, all of 9 bits
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


def test_damaged_files_say_so():
    good = tiff.write_pages([np.zeros((3, 3), np.uint8)] * 2)
    assert tiff.read_pages(b"") == [] and tiff.read_pages(b"nonsense")[0][7]
    for cut in range(8, len(good), 7):
        pages = tiff.read_pages(good[:cut])
        assert pages[-1][7] and len(pages) <= 2


def tiff_file(order, pages):
    """pages: (width, height, samples, bits, scheme, predictor, tile sides or None, blocks)."""
    out, link = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4
    for width, height, samples, bits, scheme, predictor, tile, blocks in pages:
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        sizes = [len(b) for b in blocks]
        fields = [(256, [width]), (257, [height]), (258, [bits]), (259, [scheme]), (277, [samples]), (317, [predictor])]
        fields += [(322, [tile[0]]), (323, [tile[1]]), (324, offsets), (325, sizes)] if tile else [(273, offsets), (278, [height]), (279, sizes)]
        entries = b""
        for tag, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                data, at = struct.pack(f"{order}I", len(out)), data
                out += at
            entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + data
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("order", "<>")
def test_tiff_predictors_of_deep_samples_and_tiles_of_any_depth(order):
    r, zip_ = np.random.default_rng(3), zlib.compress
    for size, samples in itertools.product((2, 4, 8), (1, 3)):
        a = r.integers(0, 1 << 62, (5, 7, samples)).astype(f"{order}u{size}")
        d = a.copy()
        d[:, 1:] -= a[:, :-1]
        assert tiff.read_pages(tiff_file(order, [(7, 5, samples, size * 8, 8, 2, None, [zip_(d.tobytes())])]))[0][6] == a.tobytes()
        a = r.normal(size=(5, 7, samples)).astype(f"{order}f{size}")
        planes = a.astype(f">f{size}").view(np.uint8).reshape(5, 7 * samples, size).transpose(0, 2, 1).reshape(5, -1)
        d = planes.copy()
        d[:, samples:] -= planes[:, :-samples]
        assert tiff.read_pages(tiff_file(order, [(7, 5, samples, size * 8, 8, 3, None, [zip_(d.tobytes())])]))[0][6] == a.tobytes()
    a = r.integers(0, 60000, (20, 40)).astype(f"{order}u2")
    whole = np.pad(a, ((0, 12), (0, 8)), constant_values=9)
    tiles = [whole[y : y + 16, x : x + 16].tobytes() for y in (0, 16) for x in (0, 16, 32)]
    assert tiff.read_pages(tiff_file(order, [(40, 20, 1, 16, 1, 1, (16, 16), tiles)]))[0][6] == a.tobytes()
    a = r.integers(0, 2, (20, 37)).astype(np.uint8)
    whole = np.pad(a, ((0, 12), (0, 11)), constant_values=1)
    tiles = [np.packbits(whole[y : y + 16, x : x + 16], axis=1).tobytes() for y in (0, 16) for x in (0, 16, 32)]
    assert tiff.read_pages(tiff_file(order, [(37, 20, 1, 1, 1, 1, (16, 16), tiles)]))[0][6] == np.packbits(a, axis=1).tobytes()


def test_a_page_of_another_form_ends_no_walk():
    good = (2, 2, 1, 8, 1, 1, None, [b"abcd"])
    pages = tiff.read_pages(tiff_file("<", [good, (2, 2, 1, 8, 7, 1, None, [b"jpeg"]), good, (2, 2, 1, 8, 8, 1, None, [b"bad"]), (2, 2, 1, 4, 1, 2, None, [b"ab"]), good]))
    assert [p[0] for p in pages] == list(range(6)) and [p[6] for p in pages] == [b"abcd", None, b"abcd", None, None, b"abcd"] and [bool(p[7]) for p in pages] == [False, True, False, True, True, False]


def test_no_mutation_of_a_file_raises():
    r = np.random.default_rng(7)
    images = [r.integers(0, 5, (9, 11, 3)).astype(np.uint8), r.integers(0, 5, (70, 66)).astype(np.uint8)]
    files = [bytearray(tiff.write_pages(images, scheme, predictor, tiled, order)) for scheme, (predictor, tiled, order) in itertools.product((1, 5, 8, 32773), ((1, False, "<"), (2, True, ">")))]
    files += [bytearray(tiff_file("<", [(7, 5, 1, 32, 8, 3, None, [zlib.compress(bytes(140))]), (5, 5, 1, 1, 1, 1, (16, 16), [bytes(32)])]))]
    rnd = random.Random(1)
    places = []  # the directories, where most values matter
    for f in files:
        order = "<" if f[:2] == b"II" else ">"
        (at,) = struct.unpack_from(f"{order}I", f, 4)
        own = [*range(8)]
        while at:
            (n,) = struct.unpack_from(f"{order}H", f, at)
            own += range(at, at + 6 + 12 * n)
            (at,) = struct.unpack_from(f"{order}I", f, at + 2 + 12 * n)
        places.append(own)
    failed = 0
    for k in range(20000):
        data = bytearray(files[k % len(files)])
        for _ in range(rnd.randint(1, 3)):
            at = rnd.choice(places[k % len(files)]) if rnd.random() < 0.8 else rnd.randrange(len(data))
            data[at] = rnd.choice([0, 0, 1, 255, rnd.randrange(256)])
        pages = tiff.read_pages(bytes(data[: rnd.choice([len(data)] * 9 + [rnd.randrange(len(data))])]))
        failed += any(p[7] for p in pages)
        assert len(pages) < 200
    assert failed > 2000


def test_sizes_of_zero_and_bombs():
    def page(**fields):
        data = tiff.write_pages([np.zeros((4, 4), np.uint8)], tiled=fields.pop("tiled", False))
        (at,) = struct.unpack_from("<I", data, 4)
        out = bytearray(data)
        for i in range(struct.unpack_from("<H", data, at)[0]):
            tag = struct.unpack_from("<H", data, at + 2 + 12 * i)[0]
            if f"t{tag}" in fields:
                struct.pack_into("<I", out, at + 10 + 12 * i, fields[f"t{tag}"])
        return tiff.read_pages(bytes(out))

    assert page()[0][6] == bytes(16)
    for fields in ({"t278": 0}, {"t322": 0, "tiled": True}, {"t323": 0, "tiled": True}, {"t257": 1 << 31, "t278": 1 << 31}, {"t256": 1 << 31, "t257": 1 << 31}):
        assert [bool(p[7]) and p[6] is None for p in page(**fields)] == [True], fields
    bomb = zlib.compress(bytes(50_000_000))
    assert len(tiff.unpack(bomb, tiff.DEFLATE, 100)) == 100


def test_op1_columns(spark, docs):
    stored = tiff.store_as_tiff(docs(ODD))
    got = rows(tiff.tiff_pages(stored, keys=("doc_id", "n_bytes")).select("doc_id", "n_bytes", "samples", "error"))
    for (i, t), (j, n, samples, error) in zip(ODD, got):
        data = (t or "").encode()
        assert (i, len(data), None) == (j, n, error) and samples == data + b"\0" * (-len(data) % 64 if data else 64)
    assert rows(tiff.tiff_pages(spark.createDataFrame([], "doc_id long, media binary"))) == []


# ---- BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    c, library = bpe.codec(path), Tokenizer.from_file(path)
    r = random.Random(1)
    letters = [chr(i) for i in range(0x250)] + list("　‘​  ͅ١Ⅰ😀\U0010fffd") + ["'s", "'ll", " ", "  ", "<|endoftext|>", "the ", "\n\n"]
    texts = [t or "" for _, t in ODD] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = c.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want and c.decode(got) == library.decode(want, skip_special_tokens=False)


def test_cuts_are_between_bytes_of_no_token():
    c = bpe.codec(bpe.default_path())
    for data in ("naïve Ж漢字 qzx".encode(), bytes(range(256)), b"q" * 200):
        parts = c.cuts(data)
        assert b"".join(parts) == data
        at = np.cumsum([len(p) for p in parts])[:-1]
        assert set(at.tolist()) == {i for i in range(1, len(data)) if not c.inside[data[i - 1], data[i]]}


def test_bpe_frames(docs):
    got = rows(bpe.decode_bpe(bpe.encode_bpe(docs(ODD))).select("doc_id", "n_tokens", "text"))
    assert [(i, t) for i, _, t in got] == [(i, t or "") for i, t in ODD] and got[0][1] == 0


# ---- secrets


def slow_spans(text):
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_patterns_by_brute_force():
    r = random.Random(3)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "ToKen", "ſecret", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é", "😀", "\n", "short", "--==--=="]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert [s for s in secrets.find_secrets(t) if s[0] != "guess"] == slow_spans(t), t


def test_guess_cost_prefers_habits():
    low = ["password123", "changeme", "qwerty123456", "aaaaaaaaaaaa", "abcabcabcabc", "2024-01-31", "P@ssw0rd2023!", "xxxxxxxxxxxxxxxx"]
    high = ["x9$Kq2!zLw", "24be64439e3e49cf46b2d7c90f3602a3", "Tr0ub4dor&3"]
    assert all(secrets.guess_bits(v) < secrets.MIN_BITS for v in low) and all(secrets.guess_bits(v) >= secrets.MIN_BITS for v in high)
    assert secrets.guess_bits("") == 0


def slow_bits(v, guesser):
    """The least over all segmentations, each span's cost by its definition."""
    import math

    low = v.lower() if len(v.lower()) == len(v) else v
    plain = low.translate(secrets._LEET)

    def span(i, j):
        own, n = low[i:j], j - i
        pairs = list(zip(own, own[1:]))
        costs = [guesser.word_bits(v[i:j], own, plain[i:j]), math.inf]
        if secrets._DATE.fullmatch(own):
            costs.append(7.0 if n == 4 else 16.0)
        if n >= 3:
            k = int(math.log2(n))
            costs += [5.0 + k] * (len(set(own)) == 1) + [7.0 + k] * all(a + b in secrets._NEXT for a, b in pairs) + [5.0 + k] * all(ord(b) - ord(a) == 1 and b.isalnum() for a, b in pairs)
        if n >= 2 and low.find(own, 0, j - 1) >= 0:
            costs.append(2.0 + int(math.log2(n)) + math.log2(j))
        return min(costs) + secrets.JOIN_BITS

    best = [0.0]
    for j in range(1, len(v) + 1):
        best.append(min([best[-1] + math.log2(secrets._alphabet(v[j - 1]))] + [best[i] + span(i, j) for i in range(j)]))
    return best[-1]


def test_guess_cost_by_all_segmentations():
    r = random.Random(4)
    bits = ["password", "Welcome", "P@ss", "admin", "tyuiop", "erty", "fghjk", "abcd", "6789", "aaa", "zzzzzz", "2024", "20240131", "01-31-99", "311299", "x9k2", "q7", "!", "Zk", "é", "İ", "ſ", "zq9x"]
    values = ["", "passwordfghjk", "welcomerty", "x9k2welcomertyuiop", "abcdefabcdefabcdef", "1231231231231", "2024-01-31"]
    for _ in range(2000):
        v = "".join(r.choice(bits) for _ in range(r.randint(1, 5)))
        values.append(v + v[: r.randint(0, len(v))] if r.random() < 0.3 else v[: r.randint(1, 30)])
    own = secrets.Guesser(["zq9x", *secrets.WORDS])
    for g in (secrets._guesser, own):
        for v in values[:: 1 if g is own else 5]:
            assert abs(g.bits(v) - slow_bits(v, g)) < 1e-9, v
    assert secrets.find_secrets("password: x9k2welcomertyuiop") == [("assign", 0, 28)] and own.bits("zq9x") < secrets.guess_bits("zq9x")
    for v in ("x" * 70000, "ab" * 30000, "qwertyuiop" * 3000):
        assert secrets.guess_bits(v) < 60


def test_secret_frames(docs):
    text = "my password is x9$Kq2!zLw. ok token='abcd1234efgh'"
    got = rows(secrets.redact_secrets(docs([*ODD, (10, text)])))
    assert got[0] == (1, None, None) and got[-1][1] == "my password is [guess]. ok [assign]'"
    assert [r[0] for r in rows(secrets.scan_secrets(docs(ODD)))] == [i for i, _ in ODD]
    assert rows(secrets.scan_secrets(docs([]))) == [] and rows(secrets.redact_secrets(docs([]))) == []
    assert rows(bpe.encode_bpe(docs([]))) == [] and rows(bpe.decode_bpe(bpe.encode_bpe(docs([])))) == []


def test_credential_words_that_end_a_longer_name():
    value = "q7!Zx@92#Lm$w"
    for form in ('clientSecret = "{}"', 'dbPassword="{}"', 'accessToken: "{}"', "DB_PASSWORD={}", "MYAPIKEY={}", "dbPass={}", "userAuth: {}", "secretAccessKey => '{}'", "my password is {}"):
        t = "say " + form.format(value) + " and go"
        assert [(k, t[a:b]) for k, a, b in secrets.find_secrets(t) if k == "guess"] == [("guess", value)], t
    for form in ("compass: {}", "bypass={}", "OAUTH={}", "mypassword is {}"):
        assert secrets.find_secrets(form.format(value)) == [], form


# ---- words


def test_words_by_brute_force():
    r = random.Random(5)
    pool = ["a", "B", "é", "É", "word", "WORD", "eightlet", "\0", "\x1f", " ", "  ", "\t", "\x0b", "\xa0", "-", "7", " ", "x_y"]
    for member, pattern in ((NOT_SPACE, rb"[^\x20\x09-\x0d]+"), (WORD_BYTES, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        number: dict[bytes, int] = {}
        for _ in range(400):
            t = "".join(r.choice(pool) for _ in range(r.randint(0, 15)))
            want = re.findall(pattern, t.encode().lower())
            got = word_hashes(t, member).tolist()
            assert len(got) == len(want) and words(t, member) == want
            for w, h in zip(want, got):
                assert number.setdefault(w, h) == h
            size = min(3, len(want))
            assert len(shingles(np.array(got, np.uint64), 3)) == len({tuple(want[i : i + size]) for i in range(len(want) - size + 1)} if want else ())
        assert len(set(number.values())) == len(number)


# ---- classifiers


def labelled(n, seed, bad):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    out = []
    for k in range(n):
        y = k % 2
        w = [word() for _ in range(r.randint(20, 200))]
        if y == bad[1]:
            for _ in range(max(2, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(bad[0])
        out.append((" ".join(w), y))
    return out


def test_quality_on_held_out_texts():
    junk = (["buy!!!", "CLICK", "$$$", "win###"], 0)
    m = quality.fit(labelled(300, 1, junk))
    held = labelled(200, 2, junk)
    assert sum((m.score(t) >= 0.5) == bool(y) for t, y in held) > 165
    assert m.score("") == m.score(None) and 0 <= m.score("") <= 1
    assert quality.fit([]).score("x") == 0.5 and quality.fit([("x", 1)]).score("y") > 0.9


def test_toxicity_gradient_and_held_out_texts():
    words = (["idiot", "scum", "moron"], 1)
    n = toxicity.Network()
    windows, y = [toxicity.words_of(t)[:12] for t, _ in labelled(4, 3, words)], np.array([1, 0, 1, 0], np.float32)
    none = toxicity.Odds({})
    _, g = n.gradient(windows, y, none)
    for k in ("chars", "cw", "cu", "cv", "ww", "wu", "wv", "o"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = n.p[k][at]
        n.p[k][at] = was + 1e-2
        up = n.gradient(windows, y, none)[0]
        n.p[k][at] = was - 1e-2
        down = n.gradient(windows, y, none)[0]
        n.p[k][at] = was
        assert abs((up - down) / 2e-2 - g[k][at]) < 1e-3 + 0.05 * abs(g[k][at]), k
    n = toxicity.Network().fit(labelled(240, 4, words), 0.5, epochs=8, batch=32)
    held = labelled(100, 5, words)
    scores = n.scores([t for t, _ in held])
    assert sum((s >= 0.5) == bool(v) for s, (_, v) in zip(scores, held)) >= 90
    texts = [t for t, _ in held[:12]] + [None, "", "w" * 5000, "\U0001f600 ß"]
    assert [n.scores([t])[0] for t in texts] == n.scores(texts) == n.scores(texts[::-1])[::-1] and n.scores([]) == []
    assert n.scores([None]) == n.scores([""]) == n.scores([" ! "])


def test_toxicity_forward_by_plain_loops():
    """Log odds of windows, one word, character and step at a time."""
    n = toxicity.Network().fit(labelled(60, 6, (["idiot", "scum", "moron"], 1)), 0.5, batch=16)
    p, k = n.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(xs, u, half):
        h, out = np.zeros(k), []
        for x in xs:
            x, a = x[3 * k * half : 3 * k * (half + 1)], h @ u
            z, r = sig(x[:k] + a[:k]), sig(x[k : 2 * k] + a[k : 2 * k])
            h = (1 - z) * h + z * np.tanh(x[2 * k :] + r * a[2 * k :])
            out.append(h)
        return out

    def both(xs, u, v):
        h = [np.concatenate([a, b]) for a, b in zip(states(xs, u[0], 0), states(xs[::-1], u[1], 1)[::-1])]
        w = np.exp([np.tanh(x) @ v for x in h])
        return sum(a * b for a, b in zip(w / w.sum(), h))

    def word(w):
        slots = [1 + (ord(c) * 40503 % 2**32 >> 3) % (toxicity.CHAR_SLOTS - 1) for c in w]
        own = both([p["chars"][c] @ p["cw"] + p["cb"] for c in slots], p["cu"], p["cv"])
        odds = [0.0] * 3
        for g in toxicity.grams(w):
            if (v := n.odds.table.get(g)) is not None:
                odds = [v if g == f"^{w}$" else odds[0], max(odds[1], v), min(odds[2], v)]
        return np.concatenate([p["words"][n.vocabulary.get(w, 0)], own, np.array(odds) / 2]) @ p["ww"] + p["wb"]

    texts = [t for t, _ in labelled(4, 7, (["idiot"], 1))] + ["one", "ÀÉ ß漢 x"]
    for t, got in zip(texts, n._logits(texts)):
        want = [both([word(w) for w in ws], p["wu"], p["wv"]) @ p["o"] + p["ob"][0] for ws in toxicity.windows_of(toxicity.words_of(t))]
        assert np.allclose(got, want, atol=2e-3), t


def test_gram_counts_by_brute_force():
    windows = [(set(toxicity.words_of(t)), y) for t, y in labelled(30, 9, (["idiot"], 1))] + [(set(), 0)]
    names, counts, totals = toxicity.gram_counts([windows[:11], windows[11:]])
    for part, count, total in zip((windows[:11], windows[11:]), counts, totals):
        for y in (0, 1):
            each = [set().union(*map(toxicity.grams, ws)) for ws, v in part if v == y]
            assert total[y] == len(each) and all(count[y, i] == sum(g in s for s in each) for i, g in enumerate(names))


def test_quality_difference_by_single_blocks():
    import zstandard

    m = quality.fit(labelled(300, 1, (["buy!!!", "CLICK", "$$$", "win###"], 0)))
    sizes = [lambda b, d=d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(b)) for d in (m.good, m.bad)]
    for t in [t for t, _ in labelled(20, 3, (["CLICK"], 0))] + ["naïve " * 3000, "x"]:
        b = t.encode()
        want = sum(sizes[1](b[i : i + 2048]) - sizes[0](b[i : i + 2048]) for i in range(0, len(b), 2048)) / len(b)
        w = len(b) / (len(b) + 64)
        assert m.difference(t) == want and abs(m.score(t) - 1 / (1 + np.exp(-(w * (m.a * want + m.b) + (1 - w) * m.prior)))) < 1e-9


def test_classifiers_on_odd_tables(spark, docs):
    """Null ids, repeated rows, ids with several texts, empty tables, clashing columns."""
    from pyspark.sql import functions as F

    from feldspar.llm.common import sample_of_labels

    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "y"), (2, 1, 1, "x"), (None, 1, 1, "x"), (3, None, None, "x"), (4, 7, 7, "x"), (5, 0, 0, "x"), (77, 1, 1, "x")], "doc_id long, quality int, toxic int, TEXT string")
    many = docs([(1, "a"), (1, "a"), (2, None), (None, "n"), (3, "c"), (4, "d"), (5, "x " * 9000)]).union(spark.range(10000).selectExpr("2L as doc_id", "concat('t', id) as text", "'' as `DOC_ID`", "0 as score"))
    got = sample_of_labels(many, labels, "quality", F.lit(True), 2)
    assert [y for _, y in got] == [0, 1, 0] and got[0] == ("a", 0) and got[2] == ("x " * 9000, 0) and len(sample_of_labels(many, labels, "quality", F.lit(True), 1)) == 2
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        m = fit(many, labels)
        out = rows(score(docs(ODD), m))
        assert [i for i, _ in out] == [i for i, _ in ODD] and all(0 <= s <= 1 for _, s in out) and out[4] == out[5] and out[0][1] == out[1][1]
        assert rows(score(docs([]), m)) == [] and rows(score(docs(ODD[:1]), fit(docs([]), labels.limit(0))))[0][0] == 1


def test_every_window_and_character_counts():
    n = 500
    assert {i for s in toxicity._starts(n) for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
    assert "".join(toxicity.words_of("ab" * 100)) == "ab" * 100


def test_languages(spark):
    own = {"aa": "the cat and the dog", "bb": "der hund und die katze"}
    train = spark.createDataFrame([(i, own[k] * 3, k) for i, k in enumerate(["aa", "bb"] * 5)] + [(99, "zzz", None)], "doc_id long, text string, lang string")
    p = langid.fit_profiles(train)
    got = rows(langid.identify(spark.createDataFrame([(1, "THE DOG!"), (2, "die Katze"), (3, "12 34"), (4, None), (5, "")], "doc_id long, text string"), p))
    assert [r[1] for r in got] == ["aa", "bb", "und", "und", "und"] and all(0 <= r[2] <= 1 for r in got)
    assert langid.fit_profiles(train.limit(0)).predict("x") == ("und", 0.0)


def test_out_of_place_distance_by_brute_force():
    from collections import Counter

    r = random.Random(2)
    word = lambda k: "".join(r.choice("abcdefgh"[k : k + 5]) for _ in range(r.randint(1, 6)))
    train = [(k, " ".join(word(i) for _ in range(200))) for i, k in enumerate(("aa", "bb", "cc"))]

    def slow(t):  # the n-grams of a text and how often each occurs
        count: Counter = Counter()
        for w in t.lower().split():
            count.update((0x1FFFFF, 0, ord(c)) for c in w)
            s = [0, *map(ord, w), 0]
            count.update((0x1FFFFE, *s[i : i + 2]) for i in range(len(s) - 1))
            count.update(tuple(s[i : i + 3]) for i in range(len(s) - 2))
        return count

    size = 60
    profiles = {k: [int(x) for x in langid.ranked(*langid.ngrams(t), size)] for k, t in train}
    p = langid.Profiles(profiles, size)
    for t in [t for _, t in train] + [" ".join(word(r.randrange(3)) for _ in range(r.randint(1, 40))) for _ in range(60)]:
        grams, counts = langid.ngrams(t)
        own = [g for _, g in sorted(zip((-counts).tolist(), grams.tolist()))][:size]
        assert len(own) == min(size, len(slow(t))) and sorted(counts.tolist()) == sorted(slow(t).values())
        distance = {k: sum(abs(q.index(g) - i) if g in q else size for i, g in enumerate(own)) for k, q in profiles.items()}
        best = min(distance, key=lambda k: (distance[k], k))
        weight = [np.exp(-(d - distance[best]) / (len(own) * size * langid._TEMPERATURE)) for d in distance.values()]
        got = p.predict(t)
        assert got[0] == best and abs(got[1] - 1 / sum(weight)) < 1e-9
    tie = langid.Profiles({"zz": profiles["aa"], "mm": profiles["aa"]}, size)  # equal distances: the alphabetically first
    assert tie.predict("abc cab")[0] == "mm" and tie.predict("abc cab")[1] == 0.5


def test_language_frames(spark, docs):
    p = langid.fit_profiles(spark.createDataFrame([(1, "the cat", "aa", "x"), (1, "the cat", "aa", "x"), (None, "die katze", "bb", "x"), (3, None, "bb", "x"), (4, "", "bb", "x")], "doc_id long, text string, lang string, LANG string"))
    got = rows(langid.identify(docs(ODD), p))
    assert [r[0] for r in got] == [i for i, _ in ODD] and got[4] == got[5] and [r[1] for r in got[:3]] == ["und"] * 3 and rows(langid.identify(docs([]), p)) == []


def test_ngrams_by_brute_force():
    from collections import Counter

    for t in ("Ab ab, café!", "a", "1 2", "ÀÉ ß漢 x-y", "İstanbul"):
        want: Counter = Counter()
        for w in "".join(chr(c) if c else " " for c in (langid.letters()[ord(x)] for x in t)).split():
            s = f"\0{w}\0"
            want.update((1, x) for x in w)
            want.update((2, s[i : i + 2]) for i in range(len(s) - 1))
            want.update((3, s[i : i + 3]) for i in range(len(s) - 2))
        assert sorted(langid.ngrams(t)[1].tolist()) == sorted(want.values())


# ---- pages


def test_pages_of_known_content():
    m = html.fitted()
    wrong = total = 0
    for page, good in html.labelled_pages(60, seed=1234):
        p = html.Page(page)
        wanted = [" ".join(g.split()) for g in good]
        kept = m.texts([p])[0].split("\n")
        there = [t for _, t, _ in p.texts]
        wrong += len({t for t in kept if t} ^ {t for t in there if t in wanted})
        total += len(there)
    assert wrong < 0.01 * total


PROSE = ["A plain line of the text goes here and on.", "Another one follows it. It is as long as the first was, and has more.", "Why not?"]
#: Layouts that the labelled pages don't have by these names, and what may stand beside or in the text.
LAYOUTS = ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}", "<div><div>{}</div></div>", "<div class=frame><div class=cols>{}</div></div>", "<article><div>{}</div></article>",
           '<div class=container-fluid><div class=row><div class="col-lg-9">{}</div></div></div>', "<section>{}</section>", '<div class="css-1x2y3z"><div id=__next>{}</div></div>', "<div>" * 9 + "{}" + "</div>" * 9,
           "<table><tr><td>{}</td></tr></table>", "<center>{}</center>", "<div class=content>{}</div>", "<article><section>{}</section></article>", "<body class='sidebar-right ads'><div class='story'>{}</div>"]
BESIDE = ["{}", "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News of today</a></li></ul></nav>{}<footer><p>Copyright of it.</p></footer>", "<div class=menu><a href=/>Home</a> <a href=/b>News</a></div><div class=ad>Buy now.</div>{}<div id=footer><p>All rights reserved.</p></div>",
          "<header><h1>Site name</h1></header>{}<section class=comments><div class=comment><p>I like it very much.</p></div></section>", "<div class=cookie-notice><p>We use cookies on this site.</p></div>{}<form><p>Subscribe to it</p><input></form>"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_no_layout_loses_its_text(layout):
    m = html.fitted()
    for beside, n in itertools.product(BESIDE, (1, 2, 3, 12, 40)):
        text = [PROSE[i % 3] for i in range(n)]
        page = beside.replace("{}", layout.replace("{}", "".join(f"<p>{t}</p>" for t in text)))
        assert m.texts([html.Page(f"<!doctype html><html><head><title>t</title></head><body>{page}</body></html>")]) == ["\n".join(text)], page


def test_clutter_inside_articles():
    text = "".join(f"<p>{t}</p>" for t in PROSE)
    for inside in (f"<header><h1>Its title</h1></header>{text}", f"{text}<aside><p>Other things to read.</p></aside>", f"{text}<footer><p>Posted by someone.</p></footer>", f"<p>{PROSE[0]}</p><div class=advert><p>Buy this now.</p></div><p>{PROSE[1]}</p><p>{PROSE[2]}</p>", f"<nav><a href=x>Up</a></nav>{text}<div class=comment-list><article class=comment><p>So do I.</p></article></div>"):
        assert html.fitted().texts([html.Page(f"<body><article>{inside}</article></body>")]) == ["\n".join(PROSE)], inside


def test_marks_that_browsers_read_otherwise():
    for page, want in {"<!--> one": "one", "<!---> one": "one", "<!-- x --!> one": "one", "<!-- x -- > y --> one": "one", "a <é> b": "a <é> b", "</3> one": "one", "</> one": "one", "one <": "one <", "<head><!--> <p>one": "one", "<p>1 <2 3": "1 <2 3", "<math><mi>x</mi></math> one": "x one", "<?x?> one": "one"}.items():
        assert " ".join(t for _, t, _ in html.Page(page).texts) == want, page
    deep = html.Page("<div>" * 5000 + "down here" + "</div>" * 5000)
    assert len(html.Forest([deep], {}).levels) <= html.DEEPEST + 2 and len(html.fitted().texts([deep])) == 1
    assert html.fitted().texts([html.Page("<div>" * 60 + PROSE[0] + "</div>" * 60)]) == [PROSE[0]]


def test_page_frames(spark):
    page = f"<article><p>{PROSE[0]}</p></article>"
    data = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, None, None, None), (3, "v", "", "x", "y"), (4, "w", f"<p>{'long words ' * 40000}</p>", "x", "y")]
    table = spark.createDataFrame(data, "page_id long, url string, html string, PAGE_ID string, text string")
    got = rows(html.extract(table))
    long_ = ("long words " * 40000).strip()
    assert got == [(1, "u", PROSE[0], len(PROSE[0]))] * 2 + [(None, None, "", 0), (3, "v", "", 0), (4, "w", long_, len(long_))] and rows(html.extract(table.limit(0))) == []


def test_messy_pages():
    page = "<!doctype html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A &amp; B</h1><p>one<b> two<br>three<p>fo&#117;r <script>x('</p>')</script>five<!-- no --></article><footer>&copy; x</footer><p cut='"
    assert html.fitted().texts([html.Page(page)])[0] == "A & B\none two three\nfour five"
    assert html.fitted().texts([html.Page(x) for x in (None, "", "<", "</", "<>", "<p", "<!--", "a < b", "<script>")])[1] == ""


def test_pages_without_head_end_or_body():
    text = ["A plain line of the text goes here and on.", "Another one follows it, as long as the first was."]
    inside = f"<nav class=menu><ul><li><a href='/'>Home</a><li><a href='/b'>More</a></ul></nav><article><h1>Title</h1><p>{text[0]}</p><p>{text[1]}</p></article><footer class=footer>&copy; x</footer>"
    m, want = html.fitted(), "\n".join(["Title", *text])
    heads = ["<head><title>no</title></head><body>", "<head><title>no</title><meta charset=utf8><!-- </head> --><style>p{}</style>", "<head><title>no</title><script>'<p>'</script><body>", "<title>no</title>", ""]
    for head in heads:
        assert m.texts([html.Page(f"<!doctype html><html>{head}{inside}")]) == [want], head
    assert html.Page("<head><meta name=a>Words at once").texts == [(2, "Words at once", 0)]


def test_content_straight_in_body():
    m = html.fitted()
    text = "The first line of it has some words. The next one has more of them, and it ends here."
    for body in (f"<p>{text}</p><p>{text}</p><p>{text}</p>", f"{text}<br><br>{text}<br>{text}", f"<h1>Title</h1>{text}<br><br>{text}"):
        got = m.texts([html.Page(f"<html><head><title>x</title></head><body><nav class=menu><ul><li><a href=/>Home page</a></li><li><a href=/b>More of it</a></li></ul></nav>{body}<footer class=footer><p>Some words.</p></footer></body></html>")])[0]
        assert got.count(text) == body.count(text) and "Home" not in got and "Some words" not in got, (body, got)


def test_inference_by_brute_force():
    m = html.Model()
    r = np.random.default_rng(1)
    m.names = {"a": 0}
    m.unary, m.pair = r.normal(size=html.FIXED + 1), r.normal(size=(3, 2, 2))
    f = html.Forest([html.Page("<body><div class=a><p>x</p><ul><li>y</li></ul></div><p>z</p></body>")], m.names)
    own = np.bincount(f.row, m.unary[f.column], f.n)
    total, mass = 0.0, np.zeros(f.n)
    for y in itertools.product((0, 1), repeat=f.n):
        w = np.exp(sum(own[i] * y[i] for i in range(f.n)) + sum(m.pair[f.group[i], y[f.parent[i]], y[i]] for i in range(f.n) if f.parent[i] >= 0))
        total += w
        mass += w * np.array(y)
    assert np.allclose(m.infer(f)[0], mass / total)


# ---- tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "sum", '{"y": 2, "x":1.0}', None),
            (1, 3, "b", "sum", '{"x":"1"}', "a"),
            (1, 5, "c", "sum", "{bad", "b"),
            (1, 7, "d", "nope", "{}", "e"),
            (1, 8, "e", "sum", '{"x":1,"y":2,"z":3}', "d"),
            (2, 1, None, None, None, "gone"),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, 4, "a", "late"), (1, 2, "a", "3"), (1, 9, "zz", "alone"), (1, 9, None, None)], "conv_id long, turn long, call_id string, content string")
    got = {(r["kind"], r["call_id"]): r for r in toolcalls.link_calls(calls, results, {"sum": {"x": ("BIGINT", True, True), "y": ("BIGINT", True, True)}}).collect()}
    a = got["call", "a"]
    assert (a["linked"], a["n_results"], a["position"], a["valid"]) == (True, 2, 0, False)
    assert a["record"].startswith('{"arguments":{"x":1,"y":2},"call_id":"a"') and '"result":"3","result_turn":2' in a["record"]
    assert "x: not BIGINT" in got["call", "b"]["record"] and "y: missing" in got["call", "b"]["record"] and got["call", "b"]["position"] == 1
    assert "arguments: not JSON" in got["call", "c"]["record"] and got["call", "c"]["position"] == 2
    assert got["call", "d"]["position"] is None and "cycle" in got["call", "d"]["record"] and "unknown: z" in got["call", "e"]["record"]
    assert got["call", None]["position"] == 0 and not got["call", None]["linked"]
    assert ("result", "zz") in got and ("result", None) in got and len(got) == 8


def test_tool_calls_in_messages(spark):
    talk = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"k","name":"f","arguments":"{}"}]}'), (1, 2, "tool", '{"tool_call_id":"k","content":"ok"}'), (1, 3, "assistant", "bye"), (None, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    calls, results = toolcalls.chat_events(talk)
    assert {r["call_id"] for r in calls.collect()} == {"1:0", "k"} and {r["call_id"] for r in results.collect()} == {"k", "1:2"}
    assert toolcalls.link_calls(*toolcalls.chat_events(talk.limit(0)), toolcalls.CHAT).count() == 0
    injected = spark.createDataFrame([(1, 0, "user", '{"tool_calls":[{"id":"k","name":"f","arguments":"{}"}]}'), (1, 2, "system", '{"tool_calls":[{"id":"s"}]}')], "conv_id long, turn long, role string, text string")
    assert [r["call_id"] for r in toolcalls.chat_events(injected)[0].collect()] == ["1:0"]


def test_calls_and_results_meet_in_hash_joins(spark):
    talk = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "ho", "x")], "conv_id long, turn long, role string, text string, TEXT string")
    plan = toolcalls.link_calls(*toolcalls.chat_events(talk), toolcalls.CHAT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin [call_id") >= 3


def test_a_conversation_with_tools(spark):
    """Several calls in one turn, results in any order, a wrong argument, a call that needs two others."""
    call = lambda i, name, args, after=None: {"id": i, "name": name, "arguments": json.dumps(args), "after": after}
    said = [(0, "system", "Use the tools."), (1, "user", "Which is warmer?"), (2, "assistant", json.dumps({"tool_calls": [call("p", "weather", {"town": "Paris"}), call("o", "weather", {"unit": "C", "town": "Oslo"}), call("m", "max", {"of": "p,o"}, ["o", "p"])]})),
            (3, "tool", json.dumps({"tool_call_id": "o", "content": "4"})), (4, "tool", json.dumps({"tool_call_id": "p", "content": "11"})), (5, "tool", json.dumps({"tool_call_id": "m", "content": "p"})), (6, "tool", json.dumps({"tool_call_id": "m", "content": "again"})),
            (7, "assistant", json.dumps({"tool_calls": [call("w", "weather", {"town": 7, "sky": 1}, "m"), call("w", "weather", {"town": ""}, ["gone"])]})), (8, "assistant", "Paris.")]
    talk = spark.createDataFrame([(9, *x) for x in said], "conv_id long, turn long, role string, text string")
    schemas = {"weather": {"town": ("STRING", True, False), "unit": ("STRING", False, False)}, "max": {"of": ("STRING", True, False)}}
    calls, results = toolcalls.chat_events(talk)
    got = [json.loads(r["record"]) for r in toolcalls.link_calls(calls, results, schemas).where("kind = 'call' and name != 'reply'").orderBy("position", "call_id", "record").collect()]
    assert [(g["call_id"], g["position"], g["result"], g["result_turn"], g["errors"]) for g in got] == [
        ("o", 0, "4", 3, []), ("p", 0, "11", 4, []), ("m", 1, "p", 5, []), ("w", 2, None, None, ["town: not STRING", "unknown: sky"]), ("w", 2, None, None, ["town: empty"])]
    assert [g["arguments"] for g in got[:3]] == [{"town": "Oslo", "unit": "C"}, {"town": "Paris"}, {"of": "p,o"}] and all(list(g) == sorted(g) for g in got)
    assert [(r["call_id"], r["record"]) for r in toolcalls.further_results(calls, results).collect()] == [("m", '{"call_id":"m","conv_id":9,"rank":2,"result":"again","turn":6}')]


def test_no_result_is_dropped(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "ho"), (2, 1, "assistant", '{"tool_calls":[]}'), (3, 5, "assistant", "alone"), (3, 5, "assistant", "too")]
    talk += [(4, 0, "user", "hot")] + [(4, 1, "assistant", f"r{i:04}") for i in range(500)]
    calls, results = toolcalls.chat_events(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    got = toolcalls.further_results(calls, results).collect()
    assert sorted(r["record"] for r in got if r["conv_id"] == 1) == ['{"call_id":"1:0","conv_id":1,"rank":2,"result":"b","turn":1}', '{"call_id":"1:0","conv_id":1,"rank":3,"result":"b","turn":1}']
    assert sorted(r["record"] for r in got if r["conv_id"] == 4) == sorted(f'{{"call_id":"4:0","conv_id":4,"rank":{i + 1},"result":"r{i:04}","turn":1}}' for i in range(1, 500))
    assert len(got) == 501 and all(r["kind"] == "result" and r["linked"] and r["n_results"] in (3, 500) for r in got)
    linked = {r["call_id"]: r for r in toolcalls.link_calls(calls, results, toolcalls.CHAT).where("kind = 'call'").collect()}
    assert '"result":"a"' in linked["1:0"]["record"] and linked["2:0"]["n_results"] == 1 and '"result":"r0000"' in linked["4:0"]["record"]


def test_order_of_calls_with_several_predecessors(spark):
    from functools import cache

    r = random.Random(8)
    after = {f"n{i}": [f"n{r.randrange(max(1, i - 9), i)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] if i > 1 else [] for i in range(1, 60)}
    after |= {f"d{i}": [f"d{i - 1}", f"d{i - 2}"] for i in range(2, 40)} | {"d0": [], "d1": ["d0", "gone", None]} | {"x": ["y", "n5"], "y": ["x"], "z": ["x", "n9"], "s": ["s"]}
    rows_ = [(i, a) for i, a in after.items()] + [("n7", ["n3"]), (None, ["n1"])]
    after["n7"] = [*after["n7"], "n3"]

    @cache
    def longest(i):
        return max((longest(a) + 1 for a in after[i] if a in after), default=0)

    got = {x["id"]: x["position"] for x in toolcalls.positions(spark.createDataFrame(rows_, "id string, after array<string>")).collect()}
    assert got == {i: None if i in "xyzs" else longest(i) for i in after} and got["d39"] == 39
    talk = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls":[{"id":"a"},{"id":"b","after":"a"},{"id":"c","after":["a","b"]},{"id":"d","after":null},{"id":"e","after":[]}]}')], "conv_id long, turn long, role string, text string")
    assert {x["call_id"]: x["position"] for x in toolcalls.link_calls(*toolcalls.chat_events(talk), {}).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0}


def test_digests_of_empty_texts(docs):
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(bpe.codec(bpe.default_path()).encode("")).hexdigest()
