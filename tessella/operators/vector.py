"""Retrieval by vectors, exact: cosine likeness computed in the JVM, top-k as TakeOrderedAndProject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine likeness in doubles; null where a vector has length 0, is null, or the sizes differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def query_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def scored(rows: DataFrame, query: list[float] | Column, vector: str = "embedding") -> DataFrame:
    """rows with their score, to six places; rows without one (no or zero vector) are left out."""
    q = query if isinstance(query, Column) else query_vector(query)
    return rows.withColumn("score", F.round(cosine(F.col(vector), q), 6)).where("score IS NOT NULL")


def code_only(rows: DataFrame) -> DataFrame:
    """Without Markdown chunks; rows without a chunk type stay."""
    return rows.where(~F.coalesce(F.col("chunk_type") == "markdown", F.lit(False))) if "chunk_type" in rows.columns else rows


def docs_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("chunk_type") == "markdown", F.lit(False)))


def top_k(rows: DataFrame, query: list[float] | Column, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the query; ties by id."""
    return scored(rows, query, vector).orderBy(F.desc("score"), key).limit(k)


def top_k_of_each(rows: DataFrame, query: list[float] | Column, k: int, groups: list[str], key: str = "id", vector: str = "embedding") -> DataFrame:
    """Of every group its k nearest rows, then the k nearest of those overall.

    The nearest of all lie among the nearest of the groups; a salt cuts groups that hold most of the rows, and each
    task keeps k rows of a group before anything is dealt to groups (the window's group limit).
    """
    near = scored(rows, query, vector).drop(vector).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(32)))
    order = [F.desc("score"), F.col(key)]
    for keys in ([*groups, "_salt"], groups):
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    return near.drop("_salt").orderBy(*order).limit(k)


def lookup(rows: DataFrame, name: str, types: list[str], limit: int = 10, name_column: str = "name", type_column: str = "type", key: str = "id") -> DataFrame:
    """Rows of exactly this name and one of the types, with score 1."""
    found = rows.where(F.col(name_column) == name)
    if types:
        found = found.where(F.col(type_column).isin(types))
    return found.withColumn("score", F.lit(1.0)).orderBy(key).limit(limit)


def exact_or_near(rows: DataFrame, name: str, types: list[str], query: list[float] | Column, k: int = 50, package: str = "", key: str = "id", vector: str = "embedding") -> DataFrame:
    """The row of a symbol: an exact match of name and type if there is one, else the nearest of the k nearest that match; one plan.

    A package filter (a part of the package, as plain text) decides before the choice, so an exact row of another package
    doesn't hide the one asked for.
    """
    fits = F.col("name") == name
    if types:
        fits &= F.col("type").isin(types)
    if package:
        fits &= F.col("package").contains(package)
    exact = rows.where(fits).withColumn("score", F.lit(1.0)).withColumn("_p", F.lit(0)).orderBy(key).limit(1)
    near = top_k(code_only(rows), query, k, key, vector).where(fits).withColumn("_p", F.lit(1))
    return exact.unionByName(near).orderBy("_p", F.desc("score"), key).limit(1).drop("_p")
