"""Cleaning pipeline of the training corpus: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay,
with the columns of ``docs``; the last returns the encoded documents' digests.
``run`` writes each stage's result to the shared checkpoint folder and reads it
again, so a lost executor costs a stage's tasks at most, never the chain.

Every decision is about a row, not about an id: rows with a null id and rows
that share an id are judged by their own text. Columns that are named like a
result of an operator are the caller's and come through as they are. Empty
tables pass every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrgrid.llm import byte_bpe, content_sort, decontaminate, simhash, toxicity
from addrgrid.llm.stored import stored
from addrgrid.session import ensure_checkpoint_dir
from addrgrid.sources.tables import table


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that no operator uses, and those names."""
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _numbered(docs: DataFrame) -> DataFrame:
    """``_plain`` rows with a number (own_row), stored so that it stays the same."""
    return stored(_plain(docs)[0].withColumn("own_row", F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under the threshold."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, own = _plain(docs)
    scored = toxicity.score(rows, model, id_col=own["doc_id"], text_col=own["text"])
    return scored.where("tox_label = 0").select(*own.values()).toDF(*own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to blanks."""
    rows, own = _plain(docs)
    judged = content_sort.exact_dedup(rows, id_col=own["doc_id"], text_col=own["text"])
    return judged.where("kept").select(*own.values()).toDF(*own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest id (rows
    without an id come last, any one of equal ids)."""
    own, rows = _plain(docs)[1], _numbered(docs)
    key = F.struct(F.col(own["doc_id"]).isNull().alias("none"), F.col(own["doc_id"]).alias("id"), F.col("own_row").alias("row"))
    groups = simhash.near_duplicates(rows.select(key.alias("key"), own["text"]), id_col="key", text_col=own["text"])
    gone = groups.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias("own_row"))
    return rows.join(gone, "own_row", "left_anti").select(*own.values()).toDF(*own)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    own, rows = _plain(docs)[1], _numbered(docs)
    found = decontaminate.find_overlaps(rows, table(spark, sf_dir, "benchmark"), id_col="own_row", text_col=own["text"],
                                        tolerant_words=5)
    gone = found.select(F.col("doc_id").alias("own_row")).distinct()
    return rows.join(gone, "own_row", "left_anti").select(*own.values()).toDF(*own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("byte_bpe", encode)]

#: The toxicity model cannot be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that pass all stages, as digests of their ids
    and bytes (the last stage's columns)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
