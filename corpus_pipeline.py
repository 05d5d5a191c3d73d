"""A training corpus from raw documents: filter, deduplicate, mask, mix and pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet
and reread as the next one's docs. Stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import mixing, packing, quality, secrets, simhash
from tidemill.llm.common import pick, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Quality below which a document goes: lower than the reporting threshold, to keep clean ones.
LEAST_QUALITY = 0.5
#: Junk is gone by the time of mixing; what remains should hold this share of toxic tokens.
TARGETS = {"clean": 0.98, "low": 0.0, "toxic": 0.02}


def of_documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose attention-weighted passages score at least ``LEAST_QUALITY``.

    A null text scores as an empty one; null and repeated ids are judged row by row. Without labels
    every score is 0.5, so all stay. Texts of any length are read whole.
    """
    docs = of_documents(docs)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_score", quality.score("text", model)).where(F.col("_score") >= LEAST_QUALITY).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of similar texts; documents without an id stay.

    Rows that repeat an id are told apart: one row of each group stays, and a row whose text is
    like no other's stays whatever its id.
    """
    docs = simhash.numbered_rows(of_documents(docs))
    found = simhash.similar_rows(docs.where("doc_id is not null"))
    kept = docs.join(found.where("first").select("row_id"), "row_id", "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span masked; a null text stays null, and n_chars follows the text where it changed."""
    held = of_documents(docs).withColumn("_masked", secrets.masked("text"))
    changed = ~F.col("_masked").eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length("_masked").cast("long")).otherwise(F.col("n_chars"))
    return held.select("doc_id", F.col("_masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its rounded rate says; none if that is zero.

    Rows that repeat an id take the highest of its copies; null texts have a rate by the few
    features of an empty one, and rows without an id stay once.
    """
    docs = of_documents(docs)
    rates = mixing.mix(docs, table(spark, sf_dir, "labels"), targets=TARGETS).groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    # Documents without an id have no rate of their own: they stay once.
    joined = docs.where("doc_id is not null").join(rates, "doc_id").unionByName(docs.where("doc_id is null").withColumn("_copies", F.lit(1)))
    return joined.where("_copies > 0").select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null text is an empty one and has the closing id only."""
    pieces = packing.pack(of_documents(docs))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
