r"""Benchmark decontamination by a prefix-filtered join of word windows.

Every window of an item is a set of (word, place).  Words are ordered by rarity, counted over all documents;
as a window must be contained in full, its prefix has length one: its rarest word.  A document word joins the
windows whose prefix it is; the place of the word in the window fixes where the window would begin, the
lengths bound that place, and what is left is verified word by word.  Words are compared as they are, not by hashes.

The items are taken in blocks of about BLOCK_BYTES of text, whose index is broadcast (an item that is longer goes in pieces that overlap by
a window less one word); benchmarks of one block (the usual case) cost one pass for the counts and one for the join, without a shuffle of
texts.  Of more blocks each reads the documents twice and writes the hits alone, which then meet their documents in a join by doc_id and a
digest of the text.

Rules: words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; null or empty texts have
none and no hits.  Items with a null id or without words are left out; an item_id in several rows counts once.
An item of fewer words than a window is one window.  Repeated documents are each judged on their own.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, kind, map_rows, pick, ship, spread, written
from .words import WORD_BYTES, words

WINDOW, BLOCK_BYTES = 10, 8 << 20


class Index:
    """Windows of one block of items.  number: of each word; flat: the word numbers of all windows, one
    after the other from start[w], size[w] of them; items of window w: owner[first[w]:first[w + 1]]."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        parts: dict[bytes, set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        own = {i: k for k, i in enumerate(self.ids)}
        lists = [(own[i], words(t, WORD_BYTES)) for i, t in items]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in lists for w in ws}))}
        for i, ws in lists:
            w = self.lookup(ws)
            for at in range(max(1, len(w) - window + 1) if len(w) else 0):
                parts.setdefault(w[at : at + window].tobytes(), set()).add(i)
        self.size = np.array([len(p) // 4 for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(parts), np.int32)
        owners = [sorted(s) for s in parts.values()]
        self.first = np.cumsum([0, *map(len, owners)])
        self.owner = np.array([i for s in owners for i in s], np.int64)

    def order(self, counts: np.ndarray) -> None:
        """Choose every window's rarest word, given how many documents have each word."""
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.offset = np.array([int(np.argmin(rank[self.flat[s : s + n]])) for s, n in zip(self.start, self.size)], np.int64)
        prefix = self.flat[self.start + self.offset] if len(self.start) else np.zeros(0, np.int64)
        self.window = np.argsort(prefix, kind="stable")  # windows by prefix word
        self.begin = np.searchsorted(prefix[self.window], np.arange(len(counts) + 1))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))

    def search(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and window of every occurrence in a document of these word numbers."""
        found_at, found = [], []
        place = np.flatnonzero(w >= 0)
        n = self.begin[w[place] + 1] - self.begin[w[place]]
        place, n = place[n > 0], n[n > 0]
        for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1):
            p, k = place[part], n[part]
            if not len(p):
                continue
            win = self.window[np.repeat(self.begin[w[p]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            at = np.repeat(p, k) - self.offset[win]
            fits = (at >= 0) & (at + self.size[win] <= len(w))
            at, win = at[fits], win[fits]
            for j in range(int(self.size[win].max()) if len(win) else 0):
                inside = j < self.size[win]
                same = ~inside
                same[inside] = w[at[inside] + j] == self.flat[self.start[win[inside]] + j]
                at, win = at[same], win[same]
            found_at.append(at)
            found.append(win)
        none = np.zeros(0, np.int64)
        return np.concatenate(found_at or [none]), np.concatenate(found or [none])


    def hits(self, w: np.ndarray) -> tuple[list[dict], list[str]]:
        """The words inside windows, as disjoint ranges, and the items of the windows, sorted."""
        at, win = self.search(w)
        if not len(at):
            return [], []
        owners = np.unique(np.concatenate([self.owner[self.first[v] : self.first[v + 1]] for v in np.unique(win)]))
        return _union(at, at + self.size[win], len(w)), sorted(self.ids[o] for o in owners)


def _union(begins: np.ndarray, ends: np.ndarray, n: int) -> list[dict]:
    """The union of ranges below n, as disjoint ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(change) > 0]).astype(np.int8))
    return [{"begin": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def _count(docs: DataFrame, index: Index, text: str) -> np.ndarray:
    """How many documents have each word of the index: summed in each task, then by word.  What comes to
    the driver is bounded by the words of the block."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(index.number)

    def run(batches):
        import pyarrow as pa

        own = Index.__new__(Index)
        own.number = shared.value
        total = np.zeros(len(own.number), np.int64)
        for b in batches:
            for t in b.column(0):
                w = own.lookup(words(t.as_py(), WORD_BYTES))
                total[np.unique(w[w >= 0])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["word", "n"])

    rows = pick(docs, text).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(index.number), np.int64)
    for r in rows:
        counts[r["word"]] = r["n"]
    return counts


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """i and t of items, those of more than `most` bytes in pieces of about so many that share window - 1 words with the next."""

    def row(i, t):
        if len(t) * 4 <= most or len(t.encode()) <= most:
            return [(i, t)]
        own = words(t, WORD_BYTES)
        place = np.cumsum([len(w) + 1 for w in own])
        cuts = np.flatnonzero(np.diff(place // most)) + 1
        return [(i, b" ".join(own[a : b + window - 1]).decode()) for a, b in zip([0, *cuts], [*cuts, len(own)])]

    return map_rows(items, "i string, t string", lambda: row, many=True).distinct()


_HITS = "hits array<struct<begin: long, end: long>>, items array<string>"


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, hits (array of struct begin, end: the hit words, as disjoint ranges), items
    (array of item ids as strings, sorted) and the columns to carry, a row for every row of docs."""
    spark = docs.sparkSession
    own = pick(items, item_id, item_text).toDF("i", "t").where("i is not null and t is not null").select(F.col("i").cast("string").alias("i"), "t")
    own = _pieces(own, window, block_bytes)
    blocks = max(1, -(-(own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    docs = pick(docs, doc_id, text, *carry)
    whole = f"`{doc_id}` {kind(docs, doc_id)}, `{text}` string, n_words long, {_HITS}{ddl(docs, carry)}"

    def index_of(part: DataFrame):
        index = Index([(r["i"], r["t"]) for r in part.collect()], window)
        index.order(_count(docs, index, text))
        return spark.sparkContext.broadcast(index)

    if blocks == 1:
        shared = index_of(own)

        def make():
            x = shared.value

            def row(i, t, *rest):
                w = x.lookup(words(t, WORD_BYTES))
                return i, t, len(w), *x.hits(w), *rest

            return row

        return map_rows(docs, whole, make)

    keyed = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"), F.sha2(F.col(f"`{text}`"), 256).alias("k"))
    found = []
    for b in range(blocks):
        shared = index_of(own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b))

        def make(shared=shared):
            x = shared.value

            def row(i, t, k):
                hits, had = x.hits(x.lookup(words(t, WORD_BYTES)))
                return [(i, k, hits, had)] if hits else []

            return row

        found.append(written(map_rows(keyed, f"i {kind(keyed, 'i')}, k string, {_HITS}", make, many=True), "hits"))
        shared.unpersist()
    # rows of one doc_id and text have the same hits
    every = reduce(DataFrame.unionByName, found).groupBy("i", "k").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    met = docs.withColumn("digest_", F.sha2(F.col(f"`{text}`"), 256)).alias("d").join(every.alias("e"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("e.i")) & (F.col("d.digest_") == F.col("e.k")), "left")

    def merged(i, t, hits, had, *rest):
        n = len(words(t, WORD_BYTES))
        begins, ends = (np.array([h[e] for h in hits or []], np.int64) for e in ("begin", "end"))
        return i, t, n, _union(begins, ends, n), sorted(had or []), *rest

    return map_rows(met.select(f"d.`{doc_id}`", f"d.`{text}`", "e.hits", "e.items", *[f"d.`{c}`" for c in carry]), whole, lambda: merged)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["begin"])
    return find_items(spread(docs), items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op4_decontaminate": f"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
windows as (
  select distinct item_id, least({WINDOW}, len(w)) as n, array_to_string(w[a : a + least({WINDOW}, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as a from i where len(w) > 0)),
sizes as (select distinct n from windows),
grams as (
  select k, a, n, array_to_string(w[a : a + n - 1], ' ') as s
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as a from d, sizes where len(w) >= n)),
found as (select k, a, n, item_id from grams join windows using (n, s)),
hit as (select k, count(distinct p) as n_hit from (select k, unnest(range(a, a + n)) as p from found) group by k),
own as (select k, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct k, item_id::varchar as item_id from found) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (k) left join own using (k)
"""
}
QUERIES = {"op4_decontaminate": op4_decontaminate}
