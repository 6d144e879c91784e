"""Joins and merges between symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Methods of a resource controller.
RESOURCE_ACTIONS = ["index", "create", "store", "show", "edit", "update", "destroy"]


def enrich(rows: DataFrame, models: DataFrame | None, controllers: DataFrame | None, key: str = "full_name") -> DataFrame:
    """rows with the model or else the controller of their full name. Small sides are broadcast by the optimizer, by their size."""
    if models is not None:
        rows = rows.join(models, key, "left")
    if controllers is not None:
        rows = rows.join(controllers, key, "left")
        if models is not None:
            rows = rows.withColumn("controller", F.when(F.col("model").isNull(), F.col("controller")))
    return rows


def resolve_names(rows: DataFrame, imports: DataFrame, fallback: Column, short: str = "short") -> DataFrame:
    """rows with `resolved`: the import of their short name, else the fallback (name in the own namespace)."""
    return rows.join(imports, short, "left").withColumn("resolved", F.coalesce("full", fallback)).drop("full")


def class_methods(chunks: DataFrame) -> DataFrame:
    """(name, methods): types with the sorted names of their methods; types without have none."""
    owner = F.from_json(F.concat(F.lit('{"c":'), F.try_element_at("metadata", F.lit("class_name")), F.lit("}")), "c string")["c"]
    methods = chunks.where("type = 'method'").select("file_path", owner.alias("name"), F.col("name").alias("m")).groupBy("file_path", "name").agg(F.sort_array(F.collect_set("m")).alias("methods"))
    types = chunks.where("type IN ('type', 'class')").select("file_path", "name")
    return types.join(methods, ["file_path", "name"], "left").select("name", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def merge_properties(parts: DataFrame) -> DataFrame:
    """(name, getter, setter, deleter) of parts(name, part)."""
    return parts.groupBy("name").agg(*(F.coalesce(F.bool_or(F.col("part") == p), F.lit(False)).alias(p) for p in ("getter", "setter", "deleter")))


def resource_controllers(methods: DataFrame, least: int = 4) -> DataFrame:
    """(class, is_resource): whether a class has at least so many of the seven resource actions among methods(class, method)."""
    hit = F.when(F.col("method").isin(RESOURCE_ACTIONS), F.col("method"))
    return methods.groupBy("class").agg((F.size(F.collect_set(hit)) >= least).alias("is_resource"))


def route_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """routes(controller, action, ...) of all files with the file and first line of the method that handles them, null where there is none.

    symbols: methods (full_name of their class, name, file_path, start_line). An equi-join over all files, however they were dealt to batches.
    """
    handlers = symbols.groupBy(F.col("full_name").alias("controller"), F.col("name").alias("action")).agg(F.min(F.struct("file_path", "start_line")).alias("h"))
    return routes.join(handlers, ["controller", "action"], "left").select(*routes.columns, F.col("h.file_path").alias("handler_file"), F.col("h.start_line").alias("handler_line"))
