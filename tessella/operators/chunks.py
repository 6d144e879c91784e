"""Chunks: the rows that are indexed, and how results describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import truncate_bytes

LOCATION = "struct<file_path:string,uri:string,start_line:int,end_line:int>"
#: A chunk as analyzers give it; metadata values are JSON texts.
CHUNK = "type string, name string, package string, language string, file_path string, uri string, start_line int, end_line int, selection_start_line int, selection_end_line int, signature string, docstring string, code string, metadata map<string,string>"
#: The stored JSON of a chunk.
CHUNK_JSON = "Type string, Name string, Package string, Language string, FilePath string, URI string, StartLine int, EndLine int, SelectionStartLine int, SelectionEndLine int, Signature string, Docstring string, Code string, Metadata map<string,string>"


def go_json(json: Column) -> Column:
    """JSON with <, > and & escaped, as stored chunks have it."""
    out = json
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def stored_json(chunk: DataFrame) -> Column:
    """The stored JSON of chunk columns; what is absent is empty or 0."""
    fields = [x.split(" ") for x in CHUNK_JSON.split(", ")]
    snake = {"URI": "uri", "FilePath": "file_path", "StartLine": "start_line", "EndLine": "end_line", "SelectionStartLine": "selection_start_line", "SelectionEndLine": "selection_end_line"}
    values = []
    for name, kind in fields:
        c = F.col(snake.get(name, name.lower()))
        values.append((c if kind.startswith("map") else F.coalesce(c, F.lit(0 if kind == "int" else ""))).alias(name))
    return go_json(F.to_json(F.struct(*values)))


def chunk_id(file: Column, start: Column, end: Column, name: Column) -> Column:
    from tessella.functions.text import fnv1a_64

    return fnv1a_64(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), name))


def describe(results: DataFrame, content: str = "content") -> DataFrame:
    """results(content, score, metadata map, ...) as symbols: language, kind, name, namespace, package, signature, description, location, metadata.

    Content that is a chunk's JSON with a name gives its fields; the package stands for namespace and package. Other content is a
    document, its first 400 bytes the description. Metadata holds the code as snippet, unless the result has one of its own.
    """
    c = F.from_json(content, CHUNK_JSON)
    rows = results.withColumn("_c", c).withColumn("_is", F.coalesce(F.col("_c.Name") != "", F.lit(False)))
    pick = lambda field, other: F.when(F.col("_is"), F.col(f"_c.{field}")).otherwise(other)
    own = F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    snippet = F.when(F.col("_is") & (F.col("_c.Code") != "") & ~F.map_contains_key(own, F.lit("snippet")), F.map_concat(F.create_map(F.lit("snippet"), F.col("_c.Code")), own)).otherwise(own)
    location = F.struct(pick("FilePath", F.lit(None)).alias("file_path"), pick("URI", F.lit(None)).alias("uri"), pick("StartLine", F.lit(None)).alias("start_line"), pick("EndLine", F.lit(None)).alias("end_line"))
    keep = [x for x in results.columns if x not in (content, "metadata")]
    return rows.select(
        *keep,
        pick("Language", F.lit("")).alias("language"),
        pick("Type", F.lit("document")).alias("kind"),
        pick("Name", F.lit("")).alias("name"),
        pick("Package", F.lit("")).alias("namespace"),
        pick("Package", F.lit("")).alias("package"),
        pick("Signature", F.lit("")).alias("signature"),
        pick("Docstring", truncate_bytes(F.col(content), 400)).alias("description"),
        location.alias("location"),
        snippet.alias("metadata"),
    )
