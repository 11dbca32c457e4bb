"""The corpus pipeline: toxicity, quality, exact dedup, near-dedup, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. What a stage drops is gone for the next. Empty tables pass through. The dedup stages decide
by row: exactly one row of a group stays, whether identifiers are missing or repeated or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.llm import queries as q
from manyfold.llm._common import drop, mark, quoted, release, stage, unused
from manyfold.llm.exact_dedup import exact_dedup
from manyfold.llm.packing import pack
from manyfold.llm.quality import fit, with_quality
from manyfold.llm.simhash import near_dedup
from manyfold.llm.toxicity import train, with_score

#: A document goes if its toxicity is at least this, or its quality below that.
TOXIC_FROM, GOOD_FROM = 0.3, 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text scores as toxic."""
    model = train(docs, _labels(spark, sf_dir).where(~q.held_out()))
    name = unused(docs.columns, "_toxicity")
    return with_score(docs, model, name=name).where(F.col(name) < TOXIC_FROM).select(*map(quoted, docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low posterior quality."""
    model = fit(docs, _labels(spark, sf_dir).where(~q.held_out()))
    name = unused(docs.columns, "_quality")
    while {f"{name}{x}".lower() for x in ("", "_evidence", "_host", "_path")} & {c.lower() for c in docs.columns}:
        name += "_"
    scored = with_quality(docs, model, F.col("source"), F.col("lang"), name=name)
    return scored.where(F.col(name) >= GOOD_FROM).select(*map(quoted, docs.columns))


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, written so that all that follows sees the same keys, and
    the key's name."""
    name = unused(docs.columns, "_row")
    return stage(spark, docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _keep(docs: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` keeps, by their keys, which are left out."""
    mine = unused(docs.columns, "_kept")
    kept = found.where("kept").select(F.col("row").alias(mine))
    return docs.join(kept, F.col(name) == F.col(mine), "left_semi").select(*(quoted(c) for c in docs.columns if c != name))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the one with the most code points, then the smallest identifier."""
    docs, row = _numbered(spark, docs)
    return _keep(docs, row, exact_dedup(docs, row_col=row))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates, keeps the document with the smallest identifier."""
    docs, row = _numbered(spark, docs)
    return _keep(docs, row, near_dedup(docs, row_col=row))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 ids, with their ids."""
    return pack(docs, q.tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("quality", good_quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("packing", packed)]

#: Toxicity and quality are learned, which SQL can't express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    began = mark()
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(spark, docs, name)
            drop(spark, began, keep=[docs])  # what the stage and the one before it have staged
            release(spark)
    return docs
