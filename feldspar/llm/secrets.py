"""Secret scans: fixed patterns, and a password guess-cost for values in credential context.

The guess-cost of a value is the cheapest segmentation, found by dynamic programming over all of them, into words, dates,
repeats (spans that stand earlier in the value too), keyboard walks, runs and brute-force characters: the bits that a guesser who knows
these habits needs.  A value after a credential word that costs MIN_BITS or more becomes a span of kind `guess`.

Spans are in code points, the end exclusive.  Rules: null text counts as empty and has no spans.
Texts of any length are scanned whole; the segmentation of n characters takes a time of n log n, whatever repeats or runs they hold: a
span's cost depends on its length by whole powers of two, and the least cost before all spans of such a length is kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, kind, map_rows, pick, spread

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run of 32 and more
_LONG = r"pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private)[_-]?key|bearer|credentials?"
#: A credential word with a sign or "is" after it, and the value.  Before a sign the word may end a longer name (dbPassword); pass and
#: auth only behind a non-letter or as a part in camel case, as compass and others end so too.
CONTEXT = re.compile(
    rf"""(?:(?:{_LONG}|(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|auth))["']?[\x20\t]*(?:=>|:=|->|[:=])|(?<![a-z])(?:{_LONG}|pass|auth)["']?[\x20\t]*\x20(is|was)\x20)[\x20\t]*["'`]?([^\s"'`<>,;]{{6,}})""",
    re.ASCII | re.IGNORECASE,
)
#: Some of these stands in every text that ASSIGN or CONTEXT can match.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
#: Bits from which a value in credential context counts as a secret.
MIN_BITS = 32.0
#: Bits for going over from one span to the next.
JOIN_BITS = 1.0
#: Words that people build passwords from, the most frequent first; a longer list is a parameter of Guesser.
WORDS = """password pass admin welcome qwerty letmein login master hello monkey dragon love secret test
user root guest default change changeme access example sample demo temp dummy token key your here value
sunshine princess football baseball soccer hockey batman superman shadow michael jordan harley ranger
daniel george charlie andrew thomas robert jessica ashley summer winter spring autumn january february march april
june july august september october november december monday friday sunday money computer internet
server database company home family freedom star pepper cheese banana orange apple cookie purple silver
golden flower tiger eagle black white green blue none null true false undefined insert placeholder
redacted xxxx todo""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("013457@$!", "oleastasi")
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:(?:19|20)?[0-9]{2})"
#: A year of four digits, or day, month and year in any usual order, with the same sign or none between them.
_DATE = re.compile(rf"(?:19|20)[0-9]{{2}}|{_YEAR}([-/._]?){_MONTH}\1{_DAY}|{_DAY}([-/._]?){_MONTH}\2{_YEAR}|{_MONTH}([-/._]?){_DAY}\3{_YEAR}")
_DATE_SIZES = (4, 6, 8, 10)
YEAR_BITS, DATE_BITS, SAME_BITS, WALK_BITS, RISE_BITS, COPY_BITS = 7.0, 16.0, 5.0, 7.0, 5.0, 2.0
#: Characters of a run or walk at least, and of a repeat.
RUN, COPY = 3, 2


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33 if c.isascii() else 2000


def _runs(s: str, joined) -> list[int]:
    """For each end, how long the longest run of joined neighbours that ends there is."""
    out = [0]
    for i in range(len(s)):
        out.append(out[-1] + 1 if i and joined(s, i) else 1)
    return out


def _copies(s: str) -> list[int]:
    """For each end, how long the longest span that ends there and also ends earlier is (by a suffix automaton)."""
    step, link, size, last = [{}], [-1], [0], 0
    out = [0]
    for c in s:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
        out.append(size[link[last]])
    return out


class _Least:
    """The least of any stretch of a growing list."""

    def __init__(self):
        self.rows: list[list[float]] = [[]]  # rows[k][i]: the least of the 2 ** k that end at i

    def add(self, v: float) -> None:
        i, k = len(self.rows[0]), 0
        self.rows[0].append(v)
        while 2 << k <= i + 1:
            if k + 1 == len(self.rows):
                self.rows.append([math.inf] * i)
            row = self.rows[k]
            self.rows[k + 1].append(min(row[i], row[i - (1 << k)]))
            k += 1

    def of(self, a: int, b: int) -> float:
        """Of the list from a to b inclusive."""
        k = (b - a + 1).bit_length() - 1
        row = self.rows[k]
        return min(row[b], row[a + (1 << k) - 1])


class Guesser:
    """Costs of values for a guesser who tries these words, the most frequent first."""

    def __init__(self, words: Iterable[str] = WORDS):
        self.words: dict[str, float] = {}
        for i, w in enumerate(words):
            self.words.setdefault(w.lower(), math.log2(i + 2))
        self.sizes = sorted({len(w) for w in self.words})

    def word_bits(self, own: str, low: str, plain: str) -> float:
        """Of a span as it is, in lower case, and without signs for letters."""
        bits = min(self.words.get(low, math.inf), self.words.get(plain, math.inf) + 2.0)
        return bits + (0.0 if own == own.lower() else 1.0 if own[1:] == own[1:].lower() or own == own.upper() else float(len(own)))

    def bits(self, value: str) -> float:
        """The bits of the cheapest segmentation."""
        low = value.lower()
        if len(low) != len(value):  # a letter whose lower case is longer
            low = value
        plain = low.translate(_LEET)
        n = len(value)
        ends: dict[int, list[tuple[int, float]]] = {}
        for size in self.sizes:
            for i in range(n - size + 1):
                if low[i : i + size] in self.words or plain[i : i + size] in self.words:
                    ends.setdefault(i + size, []).append((i, self.word_bits(value[i : i + size], low[i : i + size], plain[i : i + size])))
        for i in range(n):
            if low[i] in "0123456789":
                for size in _DATE_SIZES:
                    if i + size <= n and _DATE.fullmatch(low, i, i + size):
                        ends.setdefault(i + size, []).append((i, YEAR_BITS if size == 4 else DATE_BITS))
        runs = [
            (_runs(low, lambda s, i: s[i] == s[i - 1]), RUN, SAME_BITS),
            (_runs(low, lambda s, i: s[i - 1 : i + 1] in _NEXT), RUN, WALK_BITS),
            (_runs(low, lambda s, i: ord(s[i]) - ord(s[i - 1]) == 1 and s[i].isalnum()), RUN, RISE_BITS),
            (_copies(low), COPY, COPY_BITS),
        ]
        best, least = [0.0], _Least()
        least.add(0.0)
        for j in range(1, n + 1):
            cost = best[j - 1] + math.log2(_alphabet(value[j - 1]))
            for longest, shortest, bits in runs:
                for k in range(shortest.bit_length() - 1, longest[j].bit_length()):  # lengths from 2 ** k on
                    a, b = max(shortest, 1 << k), min(longest[j], (2 << k) - 1)
                    if a <= b:
                        cost = min(cost, least.of(j - b, j - a) + bits + k + JOIN_BITS + (math.log2(j) if bits == COPY_BITS else 0.0))
            for i, bits in ends.get(j, ()):
                cost = min(cost, best[i] + bits + JOIN_BITS)
            best.append(cost)
            least.add(cost)
        return best[n]


_guesser = Guesser()


def guess_bits(value: str) -> float:
    return _guesser.bits(value)


def find_secrets(text: str | None, guesser: Guesser = _guesser) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as in KINDS."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        values = {}
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), 0, m.end()))
                values[m.start(2)] = m.end(2)
        for m in CONTEXT.finditer(text):
            v = m[2].rstrip(".)]}")
            if m[1] and not any(c.isdigit() for c in v):  # "the secret is otherwise"
                continue
            if len(v) >= 6:
                values.setdefault(m.start(2), m.start(2) + len(v))
        found += [(a, 3, b) for a, b in values.items() if guesser.bits(text[a:b]) >= MIN_BITS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", guesser: Guesser = _guesser) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, digest): of what is found only a digest leaves."""
    df = pick(df, doc_id, text)

    def row(i, t):
        return i, [{"kind": k, "start": a, "end": b, "sha256": hashlib.sha256(t[a:b].encode()).hexdigest()} for k, a, b in find_secrets(t, guesser)]

    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, spans array<struct<kind: string, start: long, end: long, sha256: string>>", lambda: row)


def redact_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), guesser: Guesser = _guesser) -> DataFrame:
    """doc_id, text with each stretch of overlapping spans replaced by the first one's [kind], n_chars, and the
    columns to carry."""
    df = pick(df, doc_id, text, *carry)

    def row(i, t, *rest):
        if t is None:
            return i, None, None, *rest
        out, at = [], 0
        for k, a, b in find_secrets(t, guesser):
            if a >= at:
                out += [t[at:a], f"[{k}]"]
            at = max(at, b)
        new = "".join(out) + t[at:]
        return i, new, len(new), *rest

    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, `{text}` string, n_chars long{ddl(df, carry)}", lambda: row)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(spread(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")))

    def shown(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(k):
        return F.filter("spans", lambda s: s["kind"] == F.lit(k))

    base = F.filter("spans", lambda s: s["kind"] != F.lit("guess"))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return spans.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLE_SQL: dict[str, str] = {}
