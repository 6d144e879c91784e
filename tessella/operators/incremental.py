"""Change detection between a scan and the saved state of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change, mod_time, size) of current and state(path, mod_time, size): added, modified, unchanged or deleted.

    Modified means a later time or another size. The new time and size are given; for deleted files the old ones.
    """
    c = current.select("path", F.col("mod_time").alias("new_time"), F.col("size").alias("new_size"))
    s = state.select("path", F.col("mod_time").alias("old_time"), F.col("size").alias("old_size"))
    change = F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "deleted").when((F.col("new_time") > F.col("old_time")) | (F.col("new_size") != F.col("old_size")), "modified").otherwise("unchanged")
    both = c.join(s, "path", "full_outer")
    return both.select("path", change.alias("change"), F.coalesce("new_time", "old_time").alias("mod_time"), F.coalesce("new_size", "old_size").alias("size"))


def has_changes(changes: DataFrame) -> bool:
    return not changes.where("change <> 'unchanged'").isEmpty()


def next_state(changes: DataFrame) -> DataFrame:
    """The state after the changes have been applied."""
    return changes.where("change <> 'deleted'").select("path", "mod_time", "size")


def purge(chunks: DataFrame, changes: DataFrame, file: str = "file") -> DataFrame:
    """Chunks whose file is neither modified nor deleted."""
    stale = changes.where("change IN ('modified', 'deleted')").select(F.col("path").alias(file))
    return chunks.join(stale, file, "left_anti")


def apply(chunks: DataFrame, changes: DataFrame, made: DataFrame, file: str = "file") -> DataFrame:
    """Chunks after the changes: stale ones go, those made of added and modified files come. One plan, one write."""
    fresh = changes.where("change IN ('added', 'modified')").select(F.col("path").alias(file))
    return purge(chunks, changes, file).unionByName(made.join(fresh, file, "left_semi"), allowMissingColumns=True)


def needs_reindex(now: DataFrame, before: DataFrame) -> DataFrame:
    """(needs_reindex) of two fingerprints; true without an earlier one."""
    none = F.lit(None).cast("string")
    both = now.select(F.col("fingerprint").alias("new"), none.alias("old")).union(before.select(none, "fingerprint"))
    return both.agg((~F.max("new").eqNullSafe(F.max("old"))).alias("needs_reindex"))
