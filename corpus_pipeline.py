"""A training-data pipeline in stages; each reads what its predecessor kept, as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, mixing, ngram_join, pii, quality
from tessella.llm.queries import WEIGHTS, key, table
from tessella.plans.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of this input, doesn't reject.

    Null and empty texts are scored as empty ones; repeated rows and null ids as any; without labels all stay. Other columns are dropped.
    """
    model = quality.train(quality.document_statistics(docs), table(spark, sf_dir, "labels"))
    return quality.keep(docs.select(*COLUMNS), model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (shingles of five words, Jaccard 0.8) the document with the smallest id.

    Rows that repeat its id stay with it; rows without id are in no group and stay. Texts go through no shuffle while the ids of the others can be broadcast.
    """
    groups = ngram_join.ngram_components(docs, k=5, pct=80)
    dropped = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    if dropped.count() <= ngram_join.BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data. Null texts stay null; n_chars is the new text's length."""
    return pii.pseudonymize(docs, key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in random order; one that it takes in part is in if that is half or more of it.

    Null ids, null sources and repeated rows are rows like others; texts without a word add nothing to any weight and are in no mix.
    """
    drawn = mixing.shards(mixing.mix_rows(docs.select(*COLUMNS), WEIGHTS)).where("words * 2 >= size")
    return drawn.select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids and whether these decode to its text. Null texts count as empty: no ids."""
    return bpe.encode_and_decode(docs).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", replace_pii),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", encode_tokens),
]

#: Learning, components and keyed permutations have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
