"""Operators on whole tables, and the pipeline, against brute force in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from feldspar.llm import decontaminate, dedup
from feldspar.llm.common import pick, remove, written
from feldspar.llm.graph import components
from feldspar.llm.words import NOT_SPACE, shingles, word_hashes


def set_of(text, size):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(rows, size, percent):
    """The smallest id reachable over links; rows of one id are one node."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, set_of(t, size)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def corpus(seed, n=160):
    """Originals, copies, chains of near copies and a template that many nearly share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows = [(None, "no id at all"), (9001, None), (9002, ""), (9003, " \t "), (9004, "one"), (9005, "ONE"), (9006, "two words"), (9007, "two words"), (9008, "a\xa0b c d"), (9010, "x " * 20000)]
    texts = []
    template = [word() for _ in range(60)]
    for i in range(n):
        kind = r.random()
        if kind < 0.35 and texts:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
        elif kind < 0.55:
            w = list(template)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.randint(1, 80))]
        texts.append(" ".join(w))
        rows.append((r.randrange(5000), texts[-1]))
    rows += [rows[20], (rows[25][0], "quite another text of the same id here"), (8000, "quite another text of the same id here")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(docs, seed):
    rows = corpus(seed)
    size, percent, halves = [(3, 85, 8), (5, 80, 10)][seed - 1]
    got = dedup.near_duplicates(docs(rows), size=size, percent=percent, halves=halves).collect()
    want = brute_components([x for x in rows if x[0] is not None], size, percent)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((i or -1, len(set_of(t, size))) for i, t in rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        elif r["n_shingles"]:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]), r
        else:
            assert r["component_id"] == r["doc_id"]


def parity(n, flip=0):
    """Words of n letters that a polynomial modulo 2 ** 64 can't tell apart."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_long_words_that_differ_everywhere(spark, docs):
    for n in (1024, 4096):
        one, other = (" ".join(["same words before", parity(n, k), "and after"]) for k in (0, 1))
        got = dedup.near_duplicates(docs([(1, one), (2, other), (3, one)]), size=3, percent=85, halves=8).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}
        items = spark.createDataFrame([("x", one), ("y", parity(n))], "item_id string, text string")
        hits = decontaminate.find_items(docs([(1, one), (2, other), (3, parity(n, 1))]), items).collect()
        assert {r["doc_id"]: r["items"] for r in hits} == {1: ["x", "y"], 2: [], 3: []}


def test_long_items_go_in_pieces(spark, docs):
    """An item longer than a block, and its windows that lie across the cuts."""
    r = random.Random(3)
    w = [f"w{r.randrange(90)}" for _ in range(700)]
    table = spark.createDataFrame([("long", " ".join(w)), ("short", "w1 w2")], "item_id string, text string")
    assert decontaminate._pieces(table.toDF("i", "t"), 10, 400).count() > 5
    rows = [(i, " ".join(w[i : i + 10 + i % 3])) for i in range(0, 690, 7)] + [(1000, " ".join(w)), (1001, " ".join(w[5:14]))]
    got = decontaminate.find_items(docs(rows), table, block_bytes=400).collect()
    assert {x["doc_id"]: (x["n_words"], sum(h["end"] - h["begin"] for h in x["hits"]), x["items"]) for x in got} == {i: brute_hits(t, [("long", " ".join(w)), ("short", "w1 w2")]) for i, t in rows}


def test_near_duplicates_of_nothing(docs):
    assert dedup.near_duplicates(docs([])).count() == 0
    assert [tuple(r) for r in dedup.near_duplicates(docs([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_a_crowd_of_near_copies(docs):
    """One group whose members are partly linked and mostly not: the bounds must lose no link."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(100)] = f"n{r.randrange(400)}"
        rows.append((i, " ".join(w)))
    got = dedup.near_duplicates(docs(rows), size=3, percent=85, halves=8).collect()
    want = brute_components(rows, 3, 85)
    assert {x["doc_id"]: x["component_id"] for x in got} == want and 1 < len(set(want.values())) < 150


def on_disk(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_table_that_they_made(spark, docs):
    held = docs([(i, f"text {i % 7}") for i in range(50)])
    before, key = on_disk(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    table = written(held.groupBy("text").count(), "test")
    assert {r["text"]: r["count"] for r in table.collect()} == {f"text {i}": 8 if i == 0 else 7 for i in range(7)}
    assert not on_disk(spark) - before and spark.conf.get(key, None) == was
    remove(table)


def test_what_is_moved_of_a_set(spark, docs):
    """Shorter than the set where the text allows it, and the whole set again."""
    r = random.Random(6)
    prose = " ".join(r.choice(["and", "The", "river", "of", "stone", "went", "slowly", "by"]) + str(r.randrange(9)) for _ in range(900))
    odd = ["one", "A b\x0bC\x00d", "\ud800 x \u00c4\u3000y", "a\u00a0b c d e", "z " * 5000, " ".join(str(r.getrandbits(200)) for _ in range(60)), prose]
    for text in odd:
        for size in (3, 5):
            s = shingles(word_hashes(text, NOT_SPACE), size)
            data = dedup.packed(text, s)
            assert len(data) <= s.nbytes + 1 and dedup.unpacked(data, size).tolist() == s.tolist(), text[:20]
    got = dedup._sets(pick(docs([(1, prose)]), "doc_id", "text").toDF("id", "text"), 3).first()
    assert len(got["s"]) < 8 * len(set_of(prose, 3)) / 2


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}


def brute_hits(text, items, window=10):
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(pattern, (text or "").encode().lower())
    hit, found = set(), set()
    for i, t in items:
        v = re.findall(pattern, (t or "").encode().lower())
        if i is None or not v:
            continue
        k = min(window, len(v))
        wins = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in wins:
                hit |= set(range(a, a + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination(spark, docs, block_bytes):
    r = random.Random(6)
    word = lambda: r.choice(["the", "a", "of", "x1", "é", "Zed", "q", "rare", "w7", "mm"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(None, "the a of"), (50, None), (3, "x1 x1, x1"), (3, "x1 x1, x1")]
    rows = [(1, None), (2, ""), (None, "x1 x1 x1"), (4, "x1.x1-x1")]
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 50))]
        if i % 3 == 0:
            v = (r.choice(items)[1] or "").split(" ")
            at = r.randint(0, len(w))
            w[at:at] = v[: r.randint(0, len(v))]
        rows.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    rows += rows[-9:]
    table = spark.createDataFrame([(*x, "clash", 1.0) for x in items], "item_id long, text string, ITEM_ID string, doc_id double")
    got = decontaminate.find_items(docs(rows), table, block_bytes=block_bytes).collect()
    show = lambda i, n, h, f: (i or -1, n, h, list(f))
    assert sorted(show(x["doc_id"], x["n_words"], sum(h["end"] - h["begin"] for h in x["hits"]), x["items"]) for x in got) == sorted(show(i, *brute_hits(t, items)) for i, t in rows)
    assert decontaminate.find_items(docs(rows), table.limit(0)).where("size(hits) > 0").count() == 0 and decontaminate.find_items(docs([]), table).count() == 0


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(r.randint(40, 120))]
        good = i % 4 != 0
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(good), 0))
    bench = " ".join(word() for _ in range(15))
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[2][1] + " more", "en", "s", 0), (1002, rows[3][1] + " " + bench, "en", "s", 0), (1003, rows[5][1].replace(" ", "  ") + ' zz password = "x9kq2zlw77ab"', "en", "s", 0), (1004, None, None, None, None), (None, rows[6][1] + " nobody", "en", "s", 0)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, bench)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = {x["doc_id"]: x for x in docs.collect()}
    good = {i for i in range(240) if i % 4}
    assert len(good - set(seen["quality"])) <= 2 and len(set(seen["quality"]) & set(range(0, 240, 4))) <= 4
    assert not {1000, 1001} & set(seen["dedup"]) and None in seen["dedup"] and len((good & set(seen["quality"])) - set(seen["dedup"])) == 0
    assert set(seen["dedup"]) - set(seen["decontaminate"]) == {1002} & set(seen["dedup"])
    left = seen["secrets"]
    assert set(left) == set(seen["decontaminate"])
    for i, x in left.items():
        if "zz " in (x["text"] or ""):
            assert "x9kq2zlw77ab" not in x["text"] and "[assign]" in x["text"] and x["n_chars"] == len(x["text"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    from feldspar.llm.bpe import codec, default_path

    assert {x["doc_id"]: bytes(x["ids"]) for x in out.collect()} == {i: codec(default_path()).encode(x["text"] or "") for i, x in left.items()}


PROSE = "the quick brown fox jumps over the lazy dog and runs far away from it all day long until night falls".split()
ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \n", "en", None, 0), (5, "naïve café ß Ж 漢字 😀", "fr", "s", 0), (5, "naïve café ß Ж 漢字 😀", "fr", "s", 0), (6, "one", "en", "s", 0), (6, "two texts of one id", "en", "s", 0), (None, "no id", "en", "s", 0), (8, "long " * 30000, "en", "s", 0), (9, "x" * 70000, "en", "s", 0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with all the tables: odd rows with extra columns whose names clash, and the same without rows."""
    r = random.Random(12)
    text = lambda: " ".join(r.choice(PROSE) for _ in range(r.randint(5, 60)))
    documents = ODD + [(i, text(), "en" if i % 3 else "fr", "s", 0) for i in range(100, 140)]
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(100, 140)] + [(None, 1, 1), (100, None, None), (3, 5, 5), (5, 1, 0), (5, 0, 1)]
    benchmark = [("b1", " ".join(PROSE[:12])), ("b1", " ".join(PROSE[:12])), (None, "fox"), ("b2", None), ("b3", ""), ("b4", "lazy dog")]
    pages = [(1, "u", "<article><p>Some text of it.</p></article>"), (1, "u", "<article><p>Some text of it.</p></article>"), (None, None, None), (3, "v", "")]
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 1, "assistant", "hey"), (2, 0, "system", "be kind"), (None, None, None, None), (3, 0, "user", None), (3, 1, "assistant", ""), (1, 0, "user", "hi"), (4, 0, "user", "w " * 40000), (5, 3, "assistant", "alone")]
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id string, text string", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}
    rows = {"documents": documents, "labels": labels, "benchmark": benchmark, "pages": pages, "conversations": talk}
    out = {}
    for which in ("odd", "empty"):
        out[which] = str(tmp_path_factory.mktemp(which))
        for name, schema in kinds.items():
            spark.createDataFrame(rows[name] if which == "odd" else [], schema).selectExpr("*", "'z' as extra", "1.5D as score").write.parquet(f"{out[which]}/{name}.parquet")
    return out, documents


def test_dedup_stage_keeps_one_row_of_an_id(spark, tables):
    folders, documents = tables
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.dedup(spark, docs, folders["odd"]).collect()
    ids = [x["doc_id"] for x in got]
    assert len(ids) == len(set(ids)) and {None, 1, 2, 3, 5, 6, 8, 9} <= set(ids)
    assert [x["text"] for x in got if x["doc_id"] == 6] == [min(("one", "two texts of one id"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    assert all(tuple(x) in documents for x in got)


QUERY_COLUMNS = {
    "op1_tiff": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op2_langid": "doc_id held_out lang_pred score", "op3_minhash": "doc_id n_shingles component_id kept",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_toxicity": "doc_id held_out score predicted", "op6_html": "page_id url text n_chars",
    "op7_toolcalls": "kind conv_id turn call_id name linked n_results position valid record", "op8_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op10_quality": "doc_id held_out score predicted", "pipeline": "doc_id n_tokens ids",
}


@pytest.mark.parametrize("name", QUERY_COLUMNS)
def test_every_query_runs_on_small_tables(spark, tables, name):
    import __spark_entry__

    folders, documents = tables
    query = __spark_entry__.queries()[name]
    got, nothing = query(spark, folders["odd"]), query(spark, folders["empty"])
    assert got.columns == nothing.columns == QUERY_COLUMNS[name].split() and nothing.count() == 0
    rows = got.collect()
    if name.startswith("op") and name not in ("op6_html", "op7_toolcalls"):
        assert sorted(x["doc_id"] or -1 for x in rows) == sorted(x[0] or -1 for x in documents)
    if name not in ("op3_minhash", "op7_toolcalls", "pipeline"):  # equal rows come out equal
        for i, n in ((5, 2), (1, 2)) if name == "op6_html" else ((5, 2),):
            same = [tuple(x) for x in rows if x[0] == i]
            assert len(set(same)) <= 1 and len(same) in (0, n)
    if name == "op1_tiff":
        from feldspar.llm.tiff import text_to_tiff

        for i, text, *_ in documents:
            data = (text or "").encode()
            payload, media = data + b"\0" * (-len(data) % 64 if data else 64), text_to_tiff(text)
            want = (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
            assert want in {tuple(x)[:7] for x in rows} and all(x["feature"] for x in rows)
    if name == "op8_bpe":
        from tokenizers import Tokenizer

        from feldspar.llm.bpe import default_path

        library = Tokenizer.from_file(default_path())
        for i, text, *_ in documents:
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert (i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in {tuple(x) for x in rows}
