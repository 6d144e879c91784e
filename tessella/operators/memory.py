"""Message windows of conversations(conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window(messages: DataFrame, size: int) -> DataFrame:
    """The last `size` messages of every conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def last(messages: DataFrame, conversation: int, n: int) -> DataFrame:
    """A conversation's last n messages in order; all if there are fewer."""
    if n < 0:
        raise ValueError("n must not be negative")
    return messages.where(F.col("conv_id") == conversation).orderBy(F.desc("turn")).limit(n).orderBy("turn")


def sizes(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


def transcripts(messages: DataFrame) -> DataFrame:
    """(conv_id, transcript): lines `[role]: text` in order."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["text"], F.lit("\n")))
    return messages.groupBy("conv_id").agg(F.array_join(said, "").alias("transcript"))


def state(changes: DataFrame, at: str = "turn") -> DataFrame:
    """(conv_id, key, value, changes): of changes(conv_id, key, value, turn), each key's last value and how often it was set."""
    return changes.groupBy("conv_id", "key").agg(F.max_by("value", F.struct(at, "value")).alias("value"), F.count(F.lit(1)).alias("changes"))


def history(changes: DataFrame, at: str = "turn") -> DataFrame:
    """changes with the value that each replaced (null for the first)."""
    w = Window.partitionBy("conv_id", "key").orderBy(at, "value")
    return changes.withColumn("before", F.lag("value").over(w))
