"""The indexing job: a tree of sources into the chunk table, whole or by what has changed."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.operators import analyze as A
from tessella.operators import incremental as I
from tessella.plans.shared import materialize
from tessella.sources import files as S
from tessella.sources.store import PARTITIONS, Store, valid


@dataclass(frozen=True)
class Config:
    """Settings of a deployment; TESSELLA_<NAME> in the environment overrides a field."""

    dimension: int = 64
    collection_prefix: str = ""
    exclude: list[str] = field(default_factory=list)
    search_limit: int = 5
    markdown_bytes: int = 1000
    debounce_seconds: int = 5

    @classmethod
    def load(cls, values: dict | None = None, env: dict[str, str] | None = None) -> Config:
        """Defaults, then the values of a file, then the environment; unknown names and wrong values are errors."""
        out = replace(cls(), **(values or {}))
        for name, text in (os.environ if env is None else env).items():
            if name.startswith("TESSELLA_"):
                key = name.removeprefix("TESSELLA_").lower()
                if key not in cls.__dataclass_fields__:
                    raise ValueError(f"unknown setting {name}")
                old = getattr(out, key)
                out = replace(out, **{key: int(text) if isinstance(old, int) else [x.strip() for x in text.split(",") if x.strip()] if isinstance(old, list) else text})
        if out.dimension < 1 or out.markdown_bytes < 1 or out.search_limit < 1:
            raise ValueError("dimension, markdown_bytes and search_limit must be positive")
        return out


def chunk_rows(files: DataFrame, workspace: str, config: Config, embedder=None) -> DataFrame:
    """Stored rows of files(path, content, language): code by its analyzers, Markdown by paragraphs."""
    from tessella.functions.embed import embed

    code = A.index_rows(A.analyze(files), embedder, config.dimension)
    text = A.markdown_chunks(files.where("language = 'markdown'"), config.markdown_bytes)
    text = text.select("id", "content", "file", "chunk_type", F.lit("markdown").alias("language"), F.lit("").alias("name"), F.lit("document").alias("type"), embed(F.col("content"), embedder, config.dimension).alias("embedding"))
    return valid(code.unionByName(text, allowMissingColumns=True)).withColumn("workspace_id", F.lit(workspace))


def index_workspace(spark: SparkSession, root: str, path: str, config: Config | None = None, embedder=None) -> dict[str, int]:
    """Indexes what has changed below root into the table at path; returns the number of files by change."""
    config = config or Config.load()
    scan = S.scan(spark, root)
    if config.exclude:
        scan = scan.where(~P.excluded(F.col("path"), config.exclude))
    workspace = spark.range(1).select(P.workspace_id(F.lit(root))).first()[0]
    return index_files(spark, scan, path, workspace, config, embedder)


def index_files(spark: SparkSession, files: DataFrame, path: str, workspace: str, config: Config | None = None, embedder=None) -> dict[str, int]:
    """Indexes files(path, mod_time, size, content) of a workspace, as index_workspace() does those of a folder.

    Only the partitions (workspace and language) of added, modified and deleted files are read and written anew; the state of files lies
    beside the table and is written after it: a job that fails in between is repeated from the older state, and its rows
    replace those of the same files. Deleted and modified files' rows go. One writer at a time (see IndexFlag).
    """
    config = config or Config.load()
    table, states = Store(spark, f"{path}/chunks"), Store(spark, f"{path}/state/{workspace}")
    scan = S.classify(files).where("language <> ''")
    state = states.read() if states.exists() else spark.createDataFrame([], "path string, mod_time timestamp, size long")
    changes = materialize(I.diff(scan, state), "changes")
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if set(counts) <= {"unchanged"}:
        return counts
    language = P.lookup(P.extension(F.col("path")), P.SCAN_LANGUAGES)
    touched = [r[0] for r in changes.where("change <> 'unchanged'").select(language).distinct().collect()]  # a handful of languages
    fresh = scan.join(changes.where("change IN ('added', 'modified')").select("path"), "path", "left_semi")
    rows = chunk_rows(fresh, workspace, config, embedder)
    if table.exists():
        old = table.read().where((F.col("workspace_id") == workspace) & F.col("language").isin(touched))
        rows = I.purge(old, changes).unionByName(rows, allowMissingColumns=True)
    rows = materialize(rows, "chunks")
    table.replace(rows)
    there = {r[0] for r in rows.select("language").distinct().collect()}
    for gone in set(touched) - there:
        Store(spark, f"{table.path}/workspace_id={workspace}/language={gone}").drop()
    materialize(I.next_state(changes), "state").write.mode("overwrite").parquet(states.path)
    return counts


def acquire(spark: SparkSession, path: str, workspace: str, language: str, most: int) -> bool:
    """Whether the collection (workspace, language) is in the table at path already; an error if it isn't and `most` collections are."""
    table = Store(spark, f"{path}/chunks")
    known = table.read().select(*PARTITIONS).distinct() if table.exists() else spark.createDataFrame([], "workspace_id string, language string")
    there = not known.where((F.col("workspace_id") == workspace) & (F.col("language") == language)).isEmpty()
    if not there and known.limit(most).count() >= most:
        raise ValueError(f"{most} collections are indexed; no other is taken")
    return there


class IndexFlag:
    """Tells that a workspace is being indexed: a file that only one job can create."""

    def __init__(self, spark: SparkSession, path: str, workspace: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/indexing/{workspace}")
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def start(self) -> bool:
        """True for the one who set the flag."""
        try:
            return bool(self.store.createNewFile(self.path))
        except Py4JJavaError:
            return False

    def is_indexing(self) -> bool:
        return bool(self.store.exists(self.path))

    def stop(self) -> None:
        self.store.delete(self.path, False)


def ensure_indexed(spark: SparkSession, files: DataFrame, path: str, workspace: str, config: Config | None = None, embedder=None) -> str:
    """Indexes a workspace of which nothing is stored: "indexed", "there" or, while another job does it, "indexing"."""
    flag = IndexFlag(spark, path, workspace)
    if Store(spark, f"{path}/state/{workspace}").exists():
        return "there"
    if not flag.start():
        return "indexing"
    try:
        index_files(spark, files, path, workspace, config, embedder)
    finally:
        flag.stop()
    return "indexed"


def index_all(spark: SparkSession, roots: list[str], path: str, config: Config | None = None, embedder=None, recreate: bool = False) -> dict[str, dict[str, int] | str]:
    """Indexes several folders, each as a workspace of its own: counts by change, or the error, of each. recreate: from nothing."""
    if recreate:
        Store(spark, path).drop()
    out: dict[str, dict[str, int] | str] = {}
    for root in roots:
        try:
            out[root] = index_workspace(spark, root, path, config, embedder)
        except Exception as e:  # one folder's failure doesn't keep the others from being indexed
            out[root] = f"{type(e).__name__}: {e}".splitlines()[0]
    return out
