"""Near-duplicate documents: MinHash with tensored banding, candidates verified on full shingle sets.

A table key of 2 * ROWS minima is a pair (a, b) of half keys from two collections of HALVES half keys each: HALVES ** 2
tables for the price of 2 * HALVES * ROWS minima.  A pair of texts with similarity s meets in some table with
probability (1 - (1 - s ** ROWS) ** HALVES) ** 2.

No bucket is expanded into all its pairs.  Documents with equal sets are one node.  A node is the more central
the fuller its buckets are; each bucket's members are compared with its most central ones (one of each of HUBS
shares), and what is linked becomes one component: first every member with one of them, then the pairs that these links leave apart.  Buckets that still hold several components go on: the members
outside the largest one are compared with those of other components that share a half key, unless a bound excludes a link: a shingle
that no other node of such buckets has is outside every intersection, and so is one whose bit the other's bitmap
lacks.  So no link between components is lost,
and what is compared follows the members that the bound leaves, not the square of the bucket.

Shingles are 64-bit hashes (see words.py); the sets that are compared are whole.  What moves is whichever is shorter, a set or its text's
words deflated.  Each table in between is deleted when it has been read for the last time; the result goes when the application ends.

Rules: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer words than a shingle is one shingle;
null texts and those without words have none and link with nothing.  Rows of one doc_id are one node.  A null doc_id
links with nothing, has component_id null and is kept.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, pick, remove, spread, written
from .graph import components
from .words import NOT_SPACE, mix, shingles, word_hashes, words

HALVES, ROWS = 8, 2
#: Members with which all others of a bucket are compared first.
HUBS = 4
#: 64-bit words of a set's bitmap.
WORDS = 6


def half_keys(s: np.ndarray, halves: int, rows: int) -> list[int]:
    """2 * halves half keys of a non-empty set of shingle hashes: first all a, then all b."""
    n = 2 * halves * rows
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 4096):
            h = s[None, at : at + 4096] ^ seeds[:, None]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, (h ^ (h >> np.uint64(32))).min(1), out=least)
        key = np.arange(2 * halves, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least.reshape(2 * halves, rows)[:, r])
    return key.view(np.int64).tolist()


def sketch(docs: DataFrame, size: int, halves: int, rows: int) -> DataFrame:
    """id, n (shingles), set (16 bytes that stand for the set) and half keys of every row."""

    def row(i, t):
        s = shingles(word_hashes(t, NOT_SPACE), size)
        if not len(s):
            return i, 0, None, None
        return i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), half_keys(s, halves, rows)

    return map_rows(docs, "id long, n long, `set` binary, halves array<long>", lambda: row)


def packed(text: str | None, s: np.ndarray) -> bytes:
    """What unpacked() makes the text's shingles s of again: its words deflated or, where they are shorter, the shingles themselves."""
    short = zlib.compress(b" ".join(words(text, NOT_SPACE)))
    return b"w" + short if len(short) < s.nbytes else b"s" + s.tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"s":
        return np.frombuffer(data[1:], np.uint64)
    return shingles(word_hashes(zlib.decompress(data[1:]).decode("utf-8", "surrogatepass"), NOT_SPACE), size)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """Of id and text: id, the shingles (packed), and a bitmap of 64 * WORDS bits in WORDS columns."""

    def row(i, t):
        s = shingles(word_hashes(t, NOT_SPACE), size)
        bits = np.zeros(64 * WORDS, np.uint8)
        bits[(s % np.uint64(64 * WORDS)).astype(np.int64)] = 1
        return i, packed(t, s), *np.packbits(bits).view(np.int64).tolist()

    return map_rows(texts.select("id", "text"), "id long, s binary, " + ", ".join(f"b{k} long" for k in range(WORDS)), lambda: row)


def _verify(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (u, v): those with 100 * intersection >= percent * union.  Pairs are a written table: Spark knows its size and moves
    whichever of pairs and sets is smaller."""
    left = pairs.join(sets.select(F.col("id").alias("u"), "s"), "u")
    right = sets.select(F.col("id").alias("v"), F.col("s").alias("t")).join(pairs.select("v"), "v", "left_semi")
    both = left.join(right, "v")

    def make():
        read = lru_cache(4)(unpacked)  # pairs of one v mostly follow each other

        def row(u, v, s, t):
            a, b = read(s, size), read(t, size)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int(np.count_nonzero(b[at] == a)) if len(b) else 0
            return u, v, 100 * shared >= percent * (len(a) + len(b) - shared)

        return row

    return map_rows(both.select("u", "v", "s", "t"), "u long, v long, linked boolean", make).where("linked").select("u", "v").distinct()


def _own_shingles(sets: DataFrame, size: int) -> DataFrame:
    """id and alone: how many of its shingles no other of these sets has."""

    def row(i, s):
        return [(i, v) for v in unpacked(s, size).view(np.int64).tolist()]

    each = map_rows(sets.select("id", "s"), "id long, shingle long", lambda: row, many=True)
    one = each.groupBy("shingle").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("sets")).where("sets = 1")
    return one.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, halves: int = 10, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; doc_id must be a whole number."""
    docs = pick(docs, doc_id, text).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    sketched = written(sketch(spread(docs), size, halves, rows), "sketch")
    real = sketched.where("id is not null and `set` is not null")

    # equal sets: one node, named by its smallest id
    nodes = written(real.groupBy("set").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("halves").alias("halves")), "nodes")
    member = written(real.select("id", "n", "set").join(nodes.select("set", "node"), "set").select("id", "n", "node"), "member")
    lone = written(sketched.where("id is null or `set` is null").select("id", "n"), "lone")
    several = member.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v != w")
    edges = member.join(several, "id").select(F.col("node").alias("u"), "v").where("u != v").distinct()

    # nodes that share a table key share both its half keys: only half keys of two nodes and more make table keys
    half = nodes.select("node", F.posexplode("halves").alias("at", "half"))
    often = half.groupBy("half").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("half")
    met = half.join(often, "half", "left_semi").groupBy("node").agg(F.collect_list(F.struct("at", "half")).alias("met"))
    met = written(met, "met")
    a, b = F.filter("met", lambda x: x["at"] < halves), F.filter("met", lambda x: x["at"] >= halves)
    tables = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.xxhash64(x["at"], y["at"], x["half"], y["half"]))))

    # buckets of two and more: (key, node, members)
    keyed = met.select("node", F.explode(tables).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = written(keyed.join(shared, "key"), "buckets")
    remove(met)
    central = written(buckets.groupBy("node").agg(F.sum("members").alias("central")).join(nodes, "node").select("node", "n", "halves", "central"), "central")
    remove(nodes)
    # (both lists of ids are written tables: Spark sees their sizes and moves the texts only if the ids are many, and then once)
    wanted = written(central.select(F.col("node").alias("id")), "wanted")
    repeated = sketched.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    repeated = written(wanted.join(repeated, "id", "left_semi"), "repeated")
    remove(sketched)
    found = written(_sets(docs.join(wanted, "id"), size), "found")
    # an id whose rows have different texts has all their sets here, each once
    sets = found.join(repeated, "id", "left_anti").union(found.join(repeated, "id", "left_semi").dropDuplicates(["id", "s"]))
    sets = written(sets, "sets")
    remove(repeated, wanted, found)

    # every bucket's members against its most central ones
    ranked = buckets.join(central.select("node", "n", "central"), "node")
    hub = ranked.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("share")).agg(F.max(F.struct("central", "node", "n")).alias("hub"))
    near = ranked.join(hub.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("nh"), F.col("hub.central").alias("c")), "key")
    near = near.where((F.col("node") != F.col("hub")) & (100 * F.least("n", "nh") >= percent * F.greatest("n", "nh")))
    near = written(near.groupBy(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).agg(F.max("c").alias("c")), "near")
    # one pair of each u first; its links leave few of the other pairs between two components
    best = written(near.groupBy("u").agg(F.max(F.struct("c", "v")).alias("m")).select("u", F.col("m.v").alias("v")), "best")
    one = written(edges.union(_verify(best, sets, size, percent)), "linked")
    labels = components(one)
    apart = near.join(labels.toDF("u", "cu"), "u", "left").join(labels.toDF("v", "cv"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
    apart = written(apart.select("u", "v").join(best, ["u", "v"], "left_anti"), "apart")
    remove(near, best, labels)
    first = written(one.union(_verify(apart, sets, size, percent)), "linked")
    remove(one, apart)
    labels = components(first)

    # nodes of buckets that still hold several components
    held = buckets.where("members > 2").join(labels.toDF("node", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
    mixed = held.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    pool = written(held.join(mixed, "key").select("node", "c").distinct(), "pool")
    remove(buckets, labels)
    own_sets = sets.join(pool.select(F.col("node").alias("id")), "id")
    odd = several.select(F.col("id").alias("node"), F.lit(True).alias("odd"))
    info = pool.join(central, "node").join(_own_shingles(own_sets, size).withColumnRenamed("id", "node"), "node", "left").join(odd, "node", "left")
    bits = [f"b{k}" for k in range(WORDS)]
    # o: what an intersection can have at most
    info = info.select("node", "c", "n", "halves", F.coalesce("odd", F.lit(False)).alias("odd"), (F.col("n") - F.coalesce("alone", F.lit(0))).alias("o"))
    info = info.join(own_sets.withColumnRenamed("id", "node").select("node", *bits), "node")
    # what shares a bucket shares a first half key: an eighth of the tables finds every pair again
    half = [f"a{k}" for k in range(halves)]
    halved = info.select("*", *[F.element_at("halves", k + 1).alias(h) for k, h in enumerate(half)], F.posexplode(F.slice("halves", 1, halves)).alias("at", "half"))
    halved = halved.withColumn("key", F.xxhash64("at", "half")).drop("halves", "half")
    halved = written(halved, "halved")
    remove(pool, central)
    groups = halved.groupBy("key").agg(F.min("n").alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key", "least")
    # the smallest partner that could hold o makes the union least
    able = halved.join(groups, "key").where(F.col("odd") | (100 * F.col("o") >= percent * (F.col("n") + F.greatest("least", "o") - F.col("o")))).drop("least")
    able = written(able, "able")
    remove(halved)
    main = able.groupBy("key", "c").count().groupBy("key").agg(F.max(F.struct("count", "c")).alias("m")).select("key", F.col("m.c").alias("main"))
    marked = able.join(main, "key")
    stray = marked.where("c != main").select("key", *[F.col(x).alias(f"s_{x}") for x in ("node", "c", "n", "o", "odd", *bits, *half)])

    def lacking(a: str, b: str) -> Column:
        """Bits of one side that the other lacks: so many shingles at least are not shared."""
        return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}{k}")))) for k in bits])

    most = F.least(F.least("o", F.col("n") - lacking("", "s_")), F.least("s_o", F.col("s_n") - lacking("s_", "")))
    possible = 100 * most >= percent * (F.col("n") + F.col("s_n") - most)
    both = (F.col("main") == F.col("c")) | (F.col("node") < F.col("s_node"))  # two strays meet once
    # in no group of an earlier half key (an id with several texts may be there by another of them)
    again = reduce(lambda x, y: x | y, [(F.col("at") > k) & (F.col(h) == F.col(f"s_{h}")) for k, h in enumerate(half)])
    pairs = stray.join(marked, "key").where((F.col("c") != F.col("s_c")) & both & (F.col("odd") | F.col("s_odd") | possible & ~again))
    far = written(pairs.select(F.greatest("s_node", "node").alias("u"), F.least("s_node", "node").alias("v")).distinct(), "far")
    remove(able)
    second = written(_verify(far, sets, size, percent), "linked")
    remove(sets, far)
    labels = components(first.union(second))
    own = member.join(labels.toDF("node", "c"), "node", "left").select("id", "n", F.coalesce("c", "node").alias("component"))
    rest = lone.select("id", "n", F.col("id").alias("component"))
    result = own.union(rest).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
    result = written(result, "components")
    remove(member, lone, first, second, labels)
    return result


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85, halves=HALVES)


QUERIES = {"op3_minhash": op3_minhash}
ORACLE_SQL: dict[str, str] = {}
