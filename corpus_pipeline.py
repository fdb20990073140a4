"""The corpus pipeline: documents through quality rules, near-copies, repeated passages, secrets and packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last give the columns of docs, whatever their names. A stage's intermediate tables are deleted when a later stage begins, so a
stage's result has to be written before the next stage is called, as ``run`` does.
"""

from __future__ import annotations

import functools
import threading
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import common, jaccard_join, packing, passage_dedup, quality_rules, secret_scan

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_last = threading.local()


def forget(spark: SparkSession) -> None:
    """Deletes the intermediate tables of the stage that this thread has called last."""
    common.delete(spark, getattr(_last, "tables", []))
    _last.tables = []


def stage(f):
    """Deletes the intermediate tables of the stage called before, and remembers its own."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark)
        before = common.n_written()
        out = f(spark, docs, sf_dir)
        _last.tables = common.taken(before)
        return out

    return run_stage


def row_key() -> Column:
    """What decides about a row: its id and a hash of its text; rows with an id come first."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))


def without_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of docs whose key isn't in chosen (key)."""
    own_id, own_th = common.fresh(docs, "_id", "_th")
    chosen = chosen.select(F.col("key.id").alias(own_id), F.col("key.th").alias(own_th)).distinct()
    few = chosen.limit(passage_dedup.BROADCAST + 1).count() <= passage_dedup.BROADCAST
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_th))
    return docs.join(F.broadcast(chosen) if few else chosen, same, "left_anti")


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Rows of one id and text are one document, which stays where any of them may."""
    verdicts = quality_rules.judged(docs.select(row_key().alias("key"), "text", "lang", "source"), id_col="key")
    return without_rows(docs, common.written(verdicts.groupBy("key").agg(F.max("kept").alias("kept")).where("not kept")))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies stays: the one with the smallest id, rows without id last. Near-copies share 80 % of their 5-word shingles."""
    groups = common.written(jaccard_join.near_copies(docs.select(row_key().alias("key"), "text"), num=80, k=5, id_col="key"))
    kept = without_rows(docs, common.written(groups.where(F.col("key") != F.col("component_id")).select("key")))
    # rows that repeat both id and text are copies as well
    again = not groups.groupBy("key").count().where("count > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of which nothing else is left go."""
    cut = passage_dedup.without_passages(docs)
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    others = [F.col(c).alias(f"_{c}") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.struct("doc_id", *others).alias("row"), "text")
    scanned = secret_scan.scan(rows, id_col="row")
    clean = scanned.select("row", secret_scan.masked(scanned).alias("text"))
    out = {"doc_id": F.col("row.doc_id"), "text": F.col("text")} | {c: F.col(f"row._{c}") for c in docs.columns if c not in ("doc_id", "text")}
    out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[out[c].alias(c) for c in docs.columns])


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces_written(docs, TOKENIZER))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("secret scans", secrets), ("best-fit packing", packed)]

#: Packing and chaining aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), []
    for _, f in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        f(spark, docs, sf_dir).write.parquet(path)
        common.delete(spark, last)
        docs, last = spark.read.parquet(path), [path]
    forget(spark)
    return docs
