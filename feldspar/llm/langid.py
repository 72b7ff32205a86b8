"""Language identification by rank-order profiles (out-of-place distance of frequent n-grams).

N-grams are of 1 to 3 characters within words, with the word's ends marked; letters are lower-cased, and
every character that isn't a letter ends a word.  A language's profile is its PROFILE most frequent n-grams, in order,
of a bounded sample: about PER_LANG labelled documents of each language, by hashed id.  A document's most frequent
n-grams, of its whole text, are compared with each profile: the distance is the sum of the differences of
the ranks, and PROFILE for an n-gram that the profile lacks.

Rules: null texts and texts without a letter give `und` and score 0, as does a model without languages.  Equally
frequent n-grams are ordered by code points; of languages at equal distance the alphabetically first wins.
Equal texts get equal results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, kind, map_rows, pick, ship, spread

PROFILE, PER_LANG = 400, 2000
_TEMPERATURE = 0.03
_BITS = np.int64(21)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what isn't a letter."""
    t = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            t[i] = ord(low[0]) if low[0].isalpha() else i
    return t


_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _table:
        _table.append(_letters())
    return _table[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as numbers, sorted, and how often each occurs."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]  # one mark between words
    if len(c) < 3:
        return none, none
    one = c[c != 0] | np.int64(0x1FFFFF) << 2 * _BITS
    two = c[:-1] << _BITS | c[1:] | np.int64(0x1FFFFE) << 2 * _BITS
    three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[c[1:-1] != 0]
    g = np.concatenate([one, two, three])
    g.sort()
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[at], np.diff(np.append(at, len(g)))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, in order."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        """profiles: each language's n-grams, the most frequent first."""
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            p = np.array(profiles[name], np.int64)
            self.rank[k, np.searchsorted(self.grams, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        r = self.rank[:, at]
        distance = np.where(r < 0, self.size, np.abs(r - np.arange(len(own)))).sum(1)
        best = int(distance.argmin())
        share = np.exp(-(distance - distance[best]) / (len(own) * self.size * _TEMPERATURE))
        return self.names[best], float(1 / share.sum())


def fit_profiles(docs: DataFrame, train: Column | None = None, size: int = PROFILE, per_lang: int = PER_LANG, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages of the rows that train (a Column over doc_id) admits.  The sample's bound is
    per_lang documents of each language, in expectation; its n-grams are counted on the executors."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id, text, lang).where(F.col(lang).isNotNull() & (F.lit(True) if train is None else train))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Profiles({}, size)
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, (1 << 30) * per_lang // n))])
    some = rows.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) < limits[F.col(lang)])

    def run(batches):
        import pyarrow as pa

        total: dict[str, list] = {}

        def merge(parts):
            g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, inverse = np.unique(g, return_inverse=True)
            return u, np.bincount(inverse, n, len(u)).astype(np.int64)

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                parts = total.setdefault(name, [])
                parts.append(ngrams(t.as_py()))
                if len(parts) >= 64:
                    total[name] = [merge(parts)]
        for name, parts in total.items():
            g, n = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = some.select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).orderBy("lang", "r").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, size)


def identify(df: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    df = pick(df, doc_id, text)
    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, lang_pred string, score double", lambda: lambda i, t: (i, *profiles.predict(t)))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(spread(docs), fit_profiles(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_langid": op2_langid}
ORACLE_SQL: dict[str, str] = {}
