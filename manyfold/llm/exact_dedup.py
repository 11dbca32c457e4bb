"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only.

Every input partition is a run: one entry for each digest, with the best row so far and how many rows
it stands for, in digest order. There are 2 ** bits runs. In each round, runs whose numbers differ
in a few bits only are partners (``fan_in`` of them; with two, the rounds of a binomial tree): an
entry goes to the partner that has, in these bits, the bits of the entry's digest. So a run is sent
to its partners alone, each takes its share of the digests, sorts what it got and merges equal ones,
keeping the best row. After all rounds a run holds whole digests: those whose bits are its number.

A partition of Spark is a run, by its number; the merge is a sort-based aggregate over the sorted
partition, without a further exchange. A digest that a third of all rows share is combined before
it is sent first, and then enters a round at most once per run: no task ever holds a group.

An entry is verified at each level: its key is the SHA-256 of the normalised text together with
that text's byte length and an independent 64-bit hash, so rows merge only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, quoted, stage, text_of

KEY = ("digest", "n_bytes", "check_hash")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row (the row key given, or one made up), points (code points of the text as given),
    the key and the run of each row."""
    row = quoted(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("t"), row.alias("row"))
    texts = texts.select("doc_id", "row", F.length("t").cast("long").alias("points"), F.regexp_replace("t", SPACE_CLASS + "+", "").alias("n"))
    return texts.select(
        "doc_id", "row", "points", F.unhex(F.sha2("n", 256)).alias("digest"),
        F.octet_length("n").cast("long").alias("n_bytes"), F.xxhash64("n").alias("check_hash"),
        F.spark_partition_id().alias("run")
    )


def merge_runs(rows: DataFrame, runs: int, fan_in: int = 8) -> DataFrame:
    """One row for each key: best (struct with the identifier and the row key that stay) and size."""
    bits, step = max(1, (runs - 1).bit_length()), max(1, fan_in.bit_length() - 1)
    entry = F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = rows.select(*KEY, "run", entry.alias("best"), F.lit(1).cast("long").alias("size"))
    for low in range(0, bits, step):
        mask = ((1 << min(step, bits - low)) - 1) << low
        partner = F.col("run").bitwiseAND(~mask).bitwiseOR(F.col("check_hash").bitwiseAND(mask).cast("int"))
        level = level.withColumn("run", partner)
        if low:  # in the first round Spark combines each input partition before it sends it
            level = level.repartitionById(1 << bits, "run").sortWithinPartitions("run", *KEY)
        level = level.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the row with
    the most code points in the text as given stays, then the one with the smallest identifier.
    A null text is empty, and all empty texts are one group. A null identifier comes last. Exactly
    one row of a group is kept: of rows that repeat identifier and text, the one with the smallest
    row key. ``row_col`` names such a key, unique in the table, and has it returned as ``row``;
    without it one is made up. An empty table gives an empty result; further columns are not looked at.
    """
    spark = docs.sparkSession
    rows = stage(spark, digest_rows(docs, id_col, text_col, row_col), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    groups = merge_runs(rows, runs, fan_in).where("size > 1").select(
        *(F.col(k).alias(f"g_{k}") for k in KEY), F.col("best.doc_id").alias("best_id"),
        F.col("best.row").alias("best_row"), "size"
    )
    same = [rows[k] == groups[f"g_{k}"] for k in KEY]
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    kept = F.coalesce(F.col("best_row") == F.col("row"), F.lit(True))
    return rows.join(groups, same, "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *(["row"] if row_col else [])
    )
