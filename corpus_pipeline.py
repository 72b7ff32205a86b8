"""The corpus pipeline: documents in, token ids out, each stage written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents, the last
one doc_id, n_tokens and ids.  Extra columns of documents are dropped by the first stage.  Null and empty texts go through
every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.llm.bpe import encode_bpe
from feldspar.llm.common import fold, pick, remove, written
from feldspar.llm.decontaminate import find_items
from feldspar.llm.dedup import near_duplicates
from feldspar.llm.quality import fit_quality, keep_good
from feldspar.llm.secrets import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    docs = pick(docs, *COLUMNS)
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 4) != 2))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word shingles of five, similarity 0.8) the smallest doc_id stays; rows
    without an id can't be grouped and stay.  Of several rows of an id that stays one does: one with a text if there is one,
    the first by the text's SHA-256, lang, source and n_chars."""
    ids = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    # written, so that Spark knows how few they are; all others stay as they are, in place
    odd = written(ids.where("not kept or rows > 1").select("doc_id"), "odd")
    again = written(ids.where("kept and rows > 1").select("doc_id"), "again")
    single = docs.join(odd, "doc_id", "left_anti")
    order = F.struct(F.col("text").isNull(), F.sha2("text", 256), "lang", "source", "n_chars")
    several = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS[1:]), order).alias("row"))
    return single.select(*COLUMNS).union(several.select("doc_id", "row.*").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_items(docs, items, carry=COLUMNS[2:]).where(F.size("hits") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become their kind in brackets."""
    return redact_secrets(docs, carry=("lang", "source")).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    return encode_bpe(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("bpe", bpe)]
#: Training, dictionaries and byte-pair merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents.  A stage's table goes when the next one has been written, the last one's with the application."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(*before)
        before = [docs]
    return docs
