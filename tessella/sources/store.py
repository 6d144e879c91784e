"""The table of chunks with vectors: one Parquet table, partitioned by workspace and language.

A write makes a new version of the partitions that it touches; readers see old or new files, never a mixture of rows
from one upsert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITIONS = ["workspace_id", "language"]


def upsert(base: DataFrame, news: DataFrame, key: str = "id", *newest: str) -> DataFrame:
    """base with rows of news in place of those of the same key; of several new rows of a key, the newest one.

    Rows that are equally new are told apart by all their columns, so reruns agree.
    """
    order = [*(F.desc(c) for c in newest), F.desc(F.to_json(F.struct(*news.columns)))]
    last = news.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return base.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def valid(rows: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Rows that may be stored: with an id and a vector that isn't empty."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & (F.size(vector) > 0))


def rejected(rows: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The others, with the reason."""
    no_id = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return rows.where(no_id | F.coalesce(F.size(vector) <= 0, F.lit(True))).withColumn("reason", F.when(no_id, "no id").otherwise("no vector"))


def delete(base: DataFrame, column: str, value) -> DataFrame:
    """base without the rows whose column is exactly the value; rows without a value stay."""
    return base.where(~F.col(column).eqNullSafe(F.lit(value)))


def delete_keys(base: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """base without the rows whose column is among keys."""
    return base.join(keys.select(column).distinct(), column, "left_anti")


def collections(base: DataFrame) -> DataFrame:
    """(workspace_id, language, points)."""
    return base.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("points"))


class Store:
    """A chunk table below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Writes rows(id, ..., workspace_id, language) unless the table is there."""
        if not self.exists():
            valid(rows).write.partitionBy(*PARTITIONS).parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """New contents for the partitions that occur in rows; others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.path)

    def drop(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def clear(self) -> None:
        raise NotImplementedError("a store isn't emptied in place; drop() it")


class MemoryStore:
    """A store of rows(id, ..., embedding) that lives in a session's DataFrame; nothing is written."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def store(self, rows: DataFrame, *newest: str) -> None:
        self.rows = upsert(self.rows, valid(rows), "id", *newest)

    def search(self, vector: list[float], limit: int) -> DataFrame:
        """The nearest rows; none for a limit below 1."""
        from tessella.operators.vector import top_k

        return top_k(self.rows, vector, max(limit, 0))

    def delete(self, keys: DataFrame) -> None:
        self.rows = delete_keys(self.rows, keys, "id")

    def delete_by_metadata(self, column: str, value) -> None:
        self.rows = delete(self.rows, column, value)

    def clear(self) -> None:
        self.rows = self.rows.limit(0)
