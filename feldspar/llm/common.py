"""What the training-data operators share: reading columns, running Python per row in bounded
batches, shipping the package to executors and finding the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken from an Arrow batch at once and output bytes after which a batch is sent on.
ROWS, FLUSH_BYTES = 256, 4 << 20
#: Whether a query's shuffle files go when it ends (Spark 4; others take no notice).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that workers can import it
    whatever their working folder is."""
    sc = spark.sparkContext
    if getattr(sc, "_feldspar_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="feldspar"), "feldspar_llm.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("feldspar", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._feldspar_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only where that is unset and the session runs on this
    machine alone (tests) a temporary one is made and set; on a cluster it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="feldspar-shared")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def _place(df: DataFrame):
    """Path and file system of a table made by written()."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._feldspar_path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, and lost executors
    cost only what they were working on.  remove() deletes it, at the latest the end of the application does.  The shuffle
    files of the write, which nothing reads again, go with its end and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/feldspar-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._feldspar_path = path
    where, files = _place(out)
    files.deleteOnExit(where)
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables made by written()."""
    for df in tables:
        path, files = _place(df)
        files.delete(path, True)
        files.cancelDeleteOnExit(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name even when others differ in case only or are repeated
    (the first counts).  Names with dots are taken literally."""
    have = df.columns
    low = [c.lower() for c in have]
    for n in names:
        if n not in have:
            raise ValueError(f"no column {n!r} among {have}")
    if all(low.count(n.lower()) == 1 for n in names):
        return df.select(*[F.col(f"`{n}`") for n in names])
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"c{have.index(n)}").alias(n) for n in names])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than there are cores, as one small file does; else df."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def ddl(df: DataFrame, names: tuple[str, ...]) -> str:
    """Those columns for the end of a schema string."""
    return "".join(f", `{n}` {kind(df, n)}" for n in names)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable], many: bool = False) -> DataFrame:
    """make() runs once in each task and returns f; f(*row) returns a tuple (many: any number of
    tuples).  Rows go through in small batches, so memory follows the longest rows, not the partition."""
    ship(df.sparkSession)
    arrow = _arrow(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        f = make()
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    got = f(*row)
                    if many:
                        for g in got:
                            out.append(g)
                            size += sum(len(v) for v in g if isinstance(v, (str, bytes, list))) + 32
                            if size > FLUSH_BYTES:
                                yield _batch(out, arrow)
                                out, size = [], 0
                    else:
                        out.append(got)
                        size += sum(len(v) for v in got if isinstance(v, (str, bytes, list))) + 32
                    if size > FLUSH_BYTES:
                        yield _batch(out, arrow)
                        out, size = [], 0
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """The rows for whose value in that column the function that make() returns is true, with all columns."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield part.filter(pa.array([bool(f(v.as_py())) for v in part.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def sample_of_labels(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most per_class labelled texts of each class, whole, those with the smallest hashed ids among the rows that keep
    admits: (text, label), in the order of the ids.  Only for fitting; its bound is 2 * per_class texts.  A document with several
    labels takes the smallest, an id with several texts the first of them by their digests; a null text is an empty one."""
    own = pick(labels, doc_id, label).where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & keep)
    own = own.groupBy(doc_id).agg(F.min(label).alias("label_"))
    some = None
    for v in (0, 1):
        top = own.where(F.col("label_") == v).orderBy(F.xxhash64(F.col(doc_id).cast("string")), F.col(doc_id)).limit(per_class)
        some = top if some is None else some.unionByName(top)
    got = pick(docs, doc_id, text).join(F.broadcast(some), doc_id)  # at most 2 * per_class rows
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = got.groupBy(doc_id, "label_").agg(F.min_by(t, F.sha2(t, 256)).alias("t")).orderBy(doc_id).collect()
    return [(r["t"], r["label_"]) for r in rows]
