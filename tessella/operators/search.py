"""The search tools: each takes chunk rows and gives a DataFrame.

Chunk rows have id, name, type, package, language, file, start_line, end_line, content, code, embedding, chunk_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import vector as V


def search_code(rows: DataFrame, query: list[float] | Column, limit: int = 5, key: str = "id") -> DataFrame:
    """The code chunks nearest to the query."""
    return V.top_k(V.code_only(rows), query, limit, key)


def search_docs(rows: DataFrame, query: list[float] | Column, limit: int = 5, key: str = "id", faithful: bool = False) -> DataFrame:
    """The Markdown chunks nearest to the query. faithful: all chunks, as the tool that this replaces does."""
    return V.top_k(rows if faithful else V.docs_only(rows), query, limit, key)


def candidates(rows: DataFrame, query: list[float] | Column, limit: int, key: str = "id") -> DataFrame:
    """What a hybrid search ranks anew: max(5 * limit, 10) code chunks."""
    return V.top_k(V.code_only(rows), query, max(5 * limit, 10), key)


def fuse(found: DataFrame, words: Column, content: str = "content") -> DataFrame:
    """Candidates with lexical counts and combined score 0.6 * score + 0.4 * lexical / max(lexical).

    Candidates without any word go, unless none has one: then all stay with their score. The window is over
    the candidates, a few times the limit.
    """
    whole = Window.partitionBy()
    out = found.withColumn("lexical", T.lexical_score(F.col(content), words)).withColumn("_max", F.max("lexical").over(whole))
    out = out.where((F.col("lexical") > 0) | (F.col("_max") == 0))
    return out.withColumn("hybrid", F.round(F.when(F.col("_max") > 0, 0.6 * F.col("score") + 0.4 * F.col("lexical") / F.col("_max")).otherwise(F.col("score")), 6)).drop("_max")


def hybrid_search(rows: DataFrame, query: list[float] | Column, text: str, limit: int = 5, key: str = "id", content: str = "content") -> DataFrame:
    """The code chunks nearest to the query vector, ranked anew with the words of the query text."""
    limit = limit if limit > 0 else 5
    words = F.array(*map(F.lit, text.lower().split())) if text.split() else F.array().cast("array<string>")
    return fuse(candidates(rows, query, limit, key), words, content).orderBy(F.desc("hybrid"), key).limit(limit)


def usages(rows: DataFrame, symbol: str, package: str = "", key: str = "id") -> DataFrame:
    """Chunks whose code holds the symbol as text, without chunks of that name: occurrences and a snippet in place of the code, most first.

    One row for each file, name and first line. All chunks are searched.
    """
    found = rows.where((F.col("name") != symbol) & F.col("code").contains(symbol))
    if package:
        found = found.where(F.col("package").contains(package))
    # Code stays where it is read: only what is told of it is dealt, and of each place the first is found on the map side.
    found = found.withColumn("occurrences", T.occurrences(F.col("code"), F.lit(symbol))).withColumn("snippet", T.snippet(F.col("code"), F.lit(symbol)))
    place = ["file", "name", "start_line"]
    rest = [c for c in found.columns if c not in ("code", *place)]
    found = found.groupBy(*place).agg(F.min_by(F.struct(*rest), key).alias("_first")).select(*place, "_first.*")
    return found.orderBy(F.desc("occurrences"), "file", "start_line", key)


def exports(rows: DataFrame, package: str, kind: str = "", key: str = "id", php: bool = False) -> DataFrame:
    """(type, name, ...): the exported symbols of a package, one for each type and name, sorted by these.

    A package is given by a part of its name, or for PHP by namespace. All of its chunks are seen, not the nearest hundred.
    """
    found = rows.where(T.in_namespace(F.col("package"), package) if php else F.col("package").contains(package)).where(T.exported(F.col("name")))
    if kind:
        found = found.where(F.col("type") == kind)
    return one_export_each(found, key).orderBy("type", "name")


def one_export_each(found: DataFrame, key: str = "id") -> DataFrame:
    w = Window.partitionBy("type", "name").orderBy(*([F.desc("score")] if "score" in found.columns else []), key)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exports_by_type(found: DataFrame) -> DataFrame:
    """(type, n, total, names) of exports(type, name)."""
    by = found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy()))


def render_hits(found: DataFrame) -> DataFrame:
    """(rank, markdown) of hybrid results(name, type, file, start_line, score, lexical, hybrid), best first."""
    w = Window.orderBy(F.desc("hybrid"), "id")
    line = F.format_string("### %d. %s (%s)\n- file: %s:%d\n- score: %.4f, semantic: %.4f, lexical: %.1f", F.col("rank"), "name", "type", "file", "start_line", "hybrid", "score", "lexical")
    return found.withColumn("rank", F.row_number().over(w)).select("rank", line.alias("markdown"))


def render_exports(by_type: DataFrame) -> DataFrame:
    """(type, markdown): a heading with the number, then the names."""
    return by_type.select("type", F.concat(F.lit("## "), "type", F.lit(" ("), "n", F.lit(")\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("markdown"))


def collection_status(rows: DataFrame) -> str:
    """A message for an empty collection, else an empty text."""
    return "This workspace has no chunks yet; index it first." if rows.isEmpty() else ""


def go_function(rows: DataFrame) -> DataFrame:
    """Function rows(name, signature, docstring, package, metadata map) with receiver, visibility, kind, parameters and returns."""
    params = "array<struct<name:string,type:string>>"
    upper = T.exported(F.col("name"))
    receiver = F.coalesce(F.try_element_at("metadata", F.lit("receiver")), F.lit(""))
    return rows.select(
        *[c for c in rows.columns if c != "metadata"],
        receiver.alias("receiver"),
        F.when(receiver != "", "method").otherwise("function").alias("kind"),
        F.when(upper, "exported").otherwise("private").alias("visibility"),
        F.from_json(F.try_element_at("metadata", F.lit("params")), params).alias("parameters"),
        F.from_json(F.try_element_at("metadata", F.lit("returns")), params).alias("returns"),
    )


PARAMS = "array<struct<name:string,type:string,description:string,optional:boolean>>"


def _json(name: str, kind: str) -> Column:
    """A metadata value, which is a JSON text."""
    return F.from_json(F.concat(F.lit('{"x":'), F.try_element_at("metadata", F.lit(name)), F.lit("}")), f"x {kind}")["x"]


def php_function(rows: DataFrame) -> DataFrame:
    """Function and method chunks of PHP with class, visibility, parameters and return type; without a type it is mixed."""
    found = rows.where("type IN ('function', 'method')")
    params = F.transform(_json("params", PARAMS), lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.nullif(p["type"], F.lit("")), F.lit("mixed")).alias("type"), p["optional"].alias("optional")))
    return found.select("name", F.col("type").alias("kind"), F.coalesce(_json("class_name", "string"), F.lit("")).alias("class_name"), F.coalesce(_json("visibility", "string"), F.lit("public")).alias("visibility"), F.coalesce(_json("is_static", "boolean"), F.lit(False)).alias("is_static"), params.alias("parameters"), F.coalesce(F.nullif(_json("returns", "string"), F.lit("")), F.lit("mixed")).alias("returns"), "package", "start_line", "end_line")


MODEL = "struct<table:string,fillable:array<string>,soft_deletes:boolean,relations:array<struct<name:string,type:string,related_model:string>>>"


def php_type(rows: DataFrame) -> DataFrame:
    """Classes, interfaces and traits of PHP; models say so, with their relations as return types, and have tags."""
    model = _json("eloquent", MODEL)
    found = rows.where("type IN ('class', 'interface', 'trait')").withColumn("m", model)
    tags = F.array_compact(F.array(F.when(F.col("m").isNotNull(), "eloquent"), F.when(F.col("m.soft_deletes"), "soft_deletes"), F.when(_json("is_abstract", "boolean"), "abstract")))
    relations = F.transform(F.coalesce("m.relations", F.array().cast("array<struct<name:string,type:string,related_model:string>>")), lambda r: F.struct(r["name"].alias("name"), T.relation_return_type(r["type"], r["related_model"]).alias("returns")))
    return found.select("name", F.when(F.col("m").isNotNull(), "model").otherwise(F.col("type")).alias("kind"), _json("full_name", "string").alias("full_name"), "package", F.coalesce("m.table", F.lit("")).alias("table_name"), relations.alias("relations"), tags.alias("tags"))
