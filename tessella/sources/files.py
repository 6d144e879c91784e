"""Scans of source trees and reads of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import paths as P


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, mod_time, size, content) of every file below a folder that Spark can read; unreadable files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def classify(files: DataFrame) -> DataFrame:
    """files(path, ...) outside skipped directories with their language: go, php, python, html, markdown or empty."""
    return files.where(~P.skipped(F.col("path"), P.SCAN_SKIPS)).withColumn("language", P.lookup(P.extension(F.col("path")), P.SCAN_LANGUAGES))


def languages(files: DataFrame) -> DataFrame:
    """The languages that an inventory of files(path) finds."""
    found = files.where(~P.skipped(F.col("path"), P.INVENTORY_SKIPS, dotted=True)).select(P.inventory_language(F.col("path")).alias("language"))
    return found.where("language <> ''").distinct()


def language_dirs(files: DataFrame) -> DataFrame:
    """(language, dirs): the sorted directories that hold files of a language. Distinct pairs are found before they are gathered."""
    pairs = classify(files).where("language <> ''").select("language", P.directory(F.col("path")).alias("dir")).distinct()
    return pairs.groupBy("language").agg(F.sort_array(F.collect_list("dir")).alias("dirs"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint, n): a hash of the directories by language, the number of files and the names of documents.

    Directories are hashed one by one, and the sum of 60 bits of the hashes is the whole's, so nothing is gathered in one place.
    """
    kept = classify(files)
    dirs = kept.where("language NOT IN ('', 'markdown')").select(F.concat_ws("|", F.lit("dir"), "language", P.directory(F.col("path"))).alias("x")).distinct()
    docs = kept.where("language = 'markdown'").select(F.concat_ws("|", F.lit("doc"), "path").alias("x")).distinct()
    number = F.conv(F.left(F.md5(F.col("x").cast("binary")), F.lit(15)), 16, 10).cast("decimal(38,0)")
    parts = dirs.union(docs).select(number.alias("h"), F.lit(0).cast("long").alias("n"))
    total = parts.union(kept.agg(F.lit(0).cast("decimal(38,0)"), F.count(F.lit(1)))).agg(F.sum("h").alias("s"), F.sum("n").alias("n"))
    return total.select(F.md5(F.concat_ws(":", F.col("s").cast("string"), "n").cast("binary")).alias("fingerprint"), "n")


def resolve_paths(asked: DataFrame, entries: DataFrame, bases: list[str]) -> DataFrame:
    """(path, resolved) of every row of asked(path): itself if absolute and among entries(path), else the first base below which it is; null if nowhere.

    Bases are few and in order (the working directory, then the parents of the program); the paths that they make meet entries by an equi-join.
    """
    rows = asked.select("path", F.monotonically_increasing_id().alias("_row"))
    made = F.array(*(F.concat(F.lit(b.rstrip("/") + "/"), "path") for b in bases))
    tried = rows.select("_row", "path", F.posexplode(F.when(F.col("path").startswith("/"), F.array("path")).otherwise(made)).alias("_i", "_try"))
    there = entries.select(F.col("path").alias("_try")).distinct().withColumn("_there", F.lit(True))
    best = F.min(F.when(F.col("_there"), F.struct("_i", "_try")))
    return tried.join(there, "_try", "left").groupBy("_row", "path").agg(best.alias("b")).select("path", F.col("b._try").alias("resolved"))


def resources(files: DataFrame, root: str) -> DataFrame:
    """(uri, name, title, description, mime) of Markdown and YAML files(path) below root."""
    rel = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    ext = P.extension(F.col("path"))
    kept = files.where(ext.isin("md", "yaml", "yml")).where(~P.skipped(F.col("path"), P.RESOURCE_SKIPS))
    uri = F.concat(F.lit("file://"), F.replace(F.replace(F.col("path"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")))
    base = F.lower(P.basename(F.col("path")))
    about = F.when(ext != "md", "Configuration file").when(base.contains("readme"), "README documentation").when(F.lower(rel).contains("docs"), "Technical documentation").otherwise("Project documentation")
    return kept.select(uri.alias("uri"), F.regexp_replace(F.replace(rel, F.lit("/"), F.lit("-")), r"\.[^.]*$", "").alias("name"), P.resource_title(F.col("path")).alias("title"), about.alias("description"), F.when(ext == "md", "text/markdown").otherwise("application/x-yaml").alias("mime"))


def extract(text: Column, start: Column, end: Column, cap: int | None = None) -> Column:
    """Lines start to end, clamped to the text; at most cap lines after the first."""
    lines = F.split(text, "\n", -1)
    low = F.greatest(start, F.lit(1))
    high = F.least(end, F.size(lines), *([low + cap] if cap is not None else []))
    return F.when(low <= high, F.array_join(F.slice(lines, low, high - low + 1), "\n")).otherwise("")


def code_context(docs: DataFrame, start: int, end: int, around: int = 5) -> DataFrame:
    """(doc_id, line_no, region, rendered): lines start to end of docs(doc_id, text) as body, and the lines around as context.

    start is clamped to 1 and end to the text; texts where start is then beyond end give no rows.
    """
    lines = docs.select("doc_id", F.split("text", "\n", -1).alias("lines")).withColumn("last", F.least(F.lit(end), F.size("lines"))).where(F.col("last") >= max(start, 1))
    begin = max(start, 1)
    rows = lines.select("doc_id", "last", F.posexplode(F.slice("lines", max(1, begin - max(around, 0)), F.least(F.col("last") + max(around, 0), F.size("lines")) - max(1, begin - max(around, 0)) + 1)).alias("p", "line"))
    rows = rows.withColumn("line_no", F.col("p") + max(1, begin - max(around, 0)))
    body = (F.col("line_no") >= begin) & (F.col("line_no") <= F.col("last"))
    text = F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.when(body, " ┃ ").otherwise(" │ "), "line")
    return rows.select("doc_id", "line_no", F.when(body, "body").otherwise("context").alias("region"), text.alias("rendered"))


def find_workspaces(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Of files(path): root, markers, project_type and languages of the nearest directory above with a marker among entries(path).

    Files below none get their own directory, type unknown. Ancestors (a path's depth at most) meet markers by an
    equi-join on the directory.
    """
    marked = entries.select(P.directory(F.col("path")).alias("root"), P.basename(F.col("path")).alias("marker")).where(F.col("marker").isin(P.MARKERS)).distinct()
    order = F.array(*map(F.lit, P.MARKERS))
    found = marked.groupBy("root").agg(F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("marker")).alias("i"), "marker"))).alias("m")).select("root", F.col("m.marker").alias("markers"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("path", F.explode(above).alias("root"))
    best = up.join(found, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "root", "markers")).alias("b"))
    out = files.select("path").join(best, "path", "left")
    markers = F.coalesce("b.markers", F.array().cast("array<string>"))
    kind = F.coalesce(F.try_element_at(F.filter(F.transform(markers, lambda m: P.project_type(m)), lambda x: x != "unknown"), F.lit(1)), F.lit("unknown"))
    known = F.array_distinct(F.filter(F.transform(markers, lambda m: P.marker_language(m)), lambda x: x != ""))
    root = F.coalesce("b.root", P.directory(F.col("path")))
    return out.select("path", root.alias("root"), P.workspace_id(root).alias("workspace_id"), markers.alias("markers"), kind.alias("project_type"), known.alias("languages"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of every key, the first by an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
