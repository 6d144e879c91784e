"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, media, mixing, ngram_join, pii, quality, secrets, spotsigs, url_filters, warc
from tessella.plans.shared import spread

#: Weights of the sources in order of code points, repeating.
WEIGHTS = [3, 1, 2]
#: The session's setting for the key of pseudonyms, and the key of sessions that set none (for tests).
KEY_SETTING, TEST_KEY = "spark.tessella.pii.key", "a key of the deployment"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("draws.order").alias("orders"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=4, pct=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key(spark))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def spotsigs_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_copies(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


OPERATORS = (op1_url_filters, op2_mixing, op3_secrets, op4_ngram_join, op5_quality, op6_pii, op7_media, op8_bpe, op9_spotsigs, spotsigs_near_copies, op10_warc)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filters.SQL, "op3_secrets": secrets.SQL, "op4_ngram_join": ngram_join.SQL, "op10_warc": warc.SQL}
