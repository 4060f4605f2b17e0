"""From raw documents to token ids: five stages, each over all rows the one before it kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm.common import shared_folder
from staywise.llm.decontaminate import drop_contaminated
from staywise.llm.line_dedup import drop_lines
from staywise.llm.queries import GOOD, bpe_digests, quality_model
from staywise.llm.quality import score
from staywise.llm.simhash import drop_near_copies

SHINGLE, BITS = 4, 4  # the near-dedup operator's contract


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_model(docs, spark, sf_dir)
    packed = docs.select(F.struct("*").alias("row"), "text")
    return score(packed, model).filter(F.col("score") >= GOOD).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before; ``n_chars`` follows the text."""
    cut = drop_lines(docs).withColumn("text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.col("t")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("t"))}
    kinds = dict(docs.dtypes)
    return cut.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs, length=SHINGLE, most=BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with digests of the ids and of what they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: Boosted tables, edit bands, fingerprints and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
