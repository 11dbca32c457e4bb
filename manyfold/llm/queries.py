"""One query for each operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", folds: int = 4) -> Column:
    """The fold that nothing is learned from: crc32 of the identifier as text leaves 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 2, F.lit(False))


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = score(_table(spark, sf_dir, "documents"), F.coalesce(fold != 2, F.lit(True)), fold == 3)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    rows = encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), decoded=True)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.crc32("decoded").alias("decoded_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip")
    )


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import train, with_score

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    scored = with_score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op6_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    found = near_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, with_quality

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), _table(spark, sf_dir, "labels")
    scored = with_quality(docs, fit(docs, labels.where(~held_out())), F.col("source"), F.col("lang"), name="score", keep_text=False)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("score_evidence").alias("evidence"), F.col("score_host").alias("host_prior"),
        F.col("score_path").alias("path_prior")
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import own_folder
    from .token_files import read_token_files, write_token_files

    path = own_folder(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_epsilon_grid_join": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.d = b.d AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x, min(y) AS c FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x""",
        "op8_exact_dedup": """
WITH r AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM r
)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
    }
