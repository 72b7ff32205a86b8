"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A token never spans two bytes that stand side by side in no vocabulary token.  Between two such bytes
a boundary is certain before any merge is tried, and merges on one side can't touch the other: the
pieces of a text are cut there, encoded independently (and once per distinct fragment), and concatenated.

Rules: null text counts as empty and has no ids.  Strings of added tokens in a text become their ids, as
the vocabulary file asks for.  Texts of any length are encoded whole.  Repeated rows are encoded each on their own and come out equal.
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import kind, map_rows, pick, spread

#: The split rule of this family of vocabularies, and White_Space as it means it.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = " ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Entries after which a worker's table of known pieces starts anew.
KNOWN = 300_000


def byte_letters() -> dict[str, int]:
    """The letter by which such vocabulary files write each byte, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def spans_of(category: str) -> str:
    """The characters of a category up to U+FFFF, as ranges for a class of the re module."""
    found = regex.findall(rf"\p{{{category}}}", "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000))
    n = np.array([ord(c) for c in found])
    new = np.flatnonzero(np.diff(n) > 1)
    pairs = zip(n[[0, *(new + 1)]].tolist(), n[[*new, len(n) - 1]].tolist())
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in pairs)


class _Table(dict):
    """Known pieces and their ids; an unknown one is encoded when asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        if len(self) >= KNOWN:
            self.clear()
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = byte_letters(), spec["model"]["vocab"]
        spelled = {t: bytes(letter[c] for c in t) for t in vocab}
        self.letter = {b: ord(c) for c, b in letter.items()}
        self.model = Tokenizer.from_file(path).model  # merges the bytes of a fragment
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.outside = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        #: the same rule for ASCII, for texts up to U+FFFF and for all: short classes are searched faster
        self.ascii = re.compile(SPLIT.format(L="A-Za-z", N="0-9", S=r"\t-\r "))
        self.plane = re.compile(SPLIT.format(L=spans_of("L"), N=spans_of("N"), S=SPACE))
        self.any = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=SPACE))
        #: inside[a, b]: some vocabulary token has byte b right after byte a
        self.inside = np.zeros((256, 256), bool)
        for t in spelled.values():
            if len(t) > 1:
                x = np.frombuffer(t, np.uint8)
                self.inside[x[:-1], x[1:]] = True
        self.flat = self.inside.tobytes()
        words = {i: spelled[t] for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        size = max(words) + 1
        self.length = np.array([len(words.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(words.get(i, b"") for i in range(size)), np.uint8)
        self.fragments = _Table(self._fragment)
        self.pieces = _Table(self._piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.outside is None or not any(t in text for t in self.added):
            return self._plain(text)
        out = []
        for part in self.outside.split(text):
            out.append(self.added[part] if part in self.added else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        rule = self.ascii if text.isascii() else self.plane if max(text) < "\U00010000" else self.any
        return b"".join(map(self.pieces.__getitem__, rule.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        if not ids:
            return ""
        n = np.frombuffer(ids, "<u4")
        lengths = self.length[n]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.start[n] - (ends - lengths), lengths)
        return self.bytes[at].tobytes().decode("utf-8", "replace")

    def cuts(self, data: bytes) -> list[bytes]:
        """data, cut wherever two neighbouring bytes are inside no token."""
        if len(data) <= 64:
            flat = self.flat
            at = [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not flat[a << 8 | b]]
        else:
            x = np.frombuffer(data, np.uint8)
            at = (np.flatnonzero(~self.inside[x[:-1], x[1:]]) + 1).tolist()
        return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])] if at else [data]

    def _piece(self, piece: str) -> bytes:
        parts = self.cuts(piece.encode("utf-8"))
        return self._fragment(parts[0]) if len(parts) == 1 else b"".join(map(self.fragments.__getitem__, parts))

    def _fragment(self, data: bytes) -> bytes:
        found = self.model.tokenize(data.decode("latin-1").translate(self.letter))
        return pack(f"<{len(found)}I", *[t.id for t in found])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_bpe(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (long), ids (binary, little-endian unsigned 32-bit).  path names the vocabulary
    file, which every machine must have there; None: the one that the tokenizers package of the machine has."""

    def make():
        own = codec(path or default_path())

        def row(i, t):
            ids = own.encode(t or "")
            return i, len(ids) // 4, ids

        return row

    df = pick(df, doc_id, text)
    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, n_tokens long, ids binary", make)


def decode_bpe(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, n_tokens, ids, text: the decoded text of every row's ids (null: empty)."""

    def make():
        own = codec(path or default_path())
        return lambda i, x: (i, len(x or b"") // 4, x or b"", own.decode(x or b""))

    df = pick(df, doc_id, ids)
    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, n_tokens long, `{ids}` binary, text string", make)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    both = decode_bpe(encode_bpe(docs))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
