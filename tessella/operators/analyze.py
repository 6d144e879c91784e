"""Files to chunks: a table function for each language, Markdown by Catalyst alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T
from tessella.operators.analyzers import FIELDS, go, html, php, python
from tessella.operators.chunks import CHUNK, chunk_id, stored_json

#: Registered analyzers by language; more can be added.
ANALYZERS: dict[str, Callable[[str, str], list[dict]]] = {"go": go.analyze, "python": python.analyze, "php": php.analyze, "html": html.analyze}

_TYPES = {"start_line": pa.int32(), "end_line": pa.int32(), "selection_start_line": pa.int32(), "selection_end_line": pa.int32(), "metadata": pa.map_(pa.string(), pa.string())}
#: Bytes up to which a Markdown chunk grows.
MARKDOWN_BYTES = 1000


def read_one(analyzer: Callable[[str, str], list[dict]], path: str | None, content: str | None) -> tuple[list[dict], str | None]:
    """(chunks, error): a file that its analyzer can't read has no chunks and an error."""
    try:
        return analyzer(path or "", content or ""), None
    except (IndexError, StopIteration, ValueError, RecursionError) as e:  # text that isn't of the language
        return [], f"{type(e).__name__}: {e}"


def rejected(files: DataFrame, language: str | None = None) -> DataFrame:
    """(path, language, error) of the files that analyze() can't read."""
    table = dict(ANALYZERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, lang, read_one(table[lang], p, content)[1]) for p, content, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            rows = [r for r in rows if r[2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "language", "error"])

    return analyzable(files, language).mapInArrow(run, "path string, language string, error string")


def analyzable(files: DataFrame, language: str | None) -> DataFrame:
    lang = F.lit(language) if language else P.lookup(P.extension(F.col("path")), P.SCAN_LANGUAGES)
    return files.select("path", F.col("content").cast("string").alias("content"), lang.alias("lang")).where(F.col("lang").isin(*ANALYZERS))


def analyze(files: DataFrame, language: str | None = None) -> DataFrame:
    """Chunks of files(path, content), each by the analyzer of its path's language or of the one given.

    A file that its analyzer can't read gives nothing here; rejected() tells which these are. Files are independent, so partitions are; nothing is shuffled.
    """
    table = dict(ANALYZERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for path, content, lang in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    rows += read_one(table[lang], path, content)[0]
                arrays = [pa.array([list(r[f].items()) if f == "metadata" else r[f] for r in rows], _TYPES.get(f, pa.string())) for f in FIELDS]
                yield pa.RecordBatch.from_arrays(arrays, FIELDS)

    return analyzable(files, language).mapInArrow(run, CHUNK)


def markdown_pieces(text: Column, most: int = MARKDOWN_BYTES) -> Column:
    """array<string>: paragraphs of a Markdown text, cut where the next line would pass `most` bytes. Lines are never cut.

    A fold over the lines: an empty line, or a blank one after text, ends a piece.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    clean = lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def put(out: Column, buf: Column) -> Column:
        return F.when(clean(buf) != "", F.concat(out, F.array(clean(buf)))).otherwise(out)

    def step(s: Column, line: Column) -> Column:
        blank = (clean(line) == "") & (F.length(s["buf"]) > 0)
        full = (F.octet_length(s["buf"]) + F.octet_length(line) + 1 > most) & (F.length(s["buf"]) > 0)
        grown = F.concat(F.when(full, "").otherwise(s["buf"]), line, F.lit("\n"))
        return F.struct(F.when(blank, "").otherwise(grown).alias("buf"), F.when(blank | full, put(s["out"], s["buf"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: put(s["out"], s["buf"]))


def markdown_chunks(files: DataFrame, most: int = MARKDOWN_BYTES) -> DataFrame:
    """(id, file, chunk_id, content, chunk_type) of files(path, content)."""
    rows = files.select("path", F.posexplode(markdown_pieces(F.col("content"), most)).alias("chunk_id", "content"))
    return rows.select(T.fnv1a_64(F.concat("path", F.lit("#"), F.col("chunk_id").cast("string"))).alias("id"), F.col("path").alias("file"), "chunk_id", "content", F.lit("markdown").alias("chunk_type"))


def index_rows(chunks: DataFrame, embedder=None, dimension: int = 64) -> DataFrame:
    """What is stored of chunks: id, content (JSON), columns for filters, and the vector of doc, signature and code.

    Chunks with nothing to embed are left out.
    """
    from tessella.functions.embed import embed

    rows = chunks.withColumn("_text", T.embed_text(F.col("docstring"), F.col("signature"), F.col("code"))).where("_text IS NOT NULL")
    return rows.select(chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("name")).alias("id"), stored_json(rows).alias("content"), F.col("file_path").alias("file"), "package", "name", "type", "signature", "language", "start_line", "end_line", "code", F.lit(None).cast("string").alias("chunk_type"), embed(F.col("_text"), embedder, dimension).alias("embedding"))
