"""Ingest: state of files, changes, upserts and deletes, from documents as files. The saved state is made from them by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import incremental as I
from tessella.plans.registry import query
from tessella.plans.shared import spread
from tessella.queries.scalar import EXT_SQL, FILE_SQL, case, files, skip_sql
from tessella.functions import paths as P
from tessella.sources import files as S
from tessella.sources import store

#: Files now: all but every eleventh. Saved: all but every seventh; of every fifth with an older time, of every ninth with another size.
NOW = "n AS (SELECT 'f' || doc_id AS path, TIMESTAMP '2024-01-02' AS mod_time, n_chars AS size FROM documents WHERE doc_id % 11 <> 0)"
OLD = "o AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS mod_time, CASE WHEN doc_id % 9 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 7 <> 0)"
DIFF = f"""{NOW}, {OLD}, d AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.mod_time > o.mod_time OR n.size <> o.size THEN 'modified' ELSE 'unchanged' END AS change,
 coalesce(n.size, o.size) AS size FROM n FULL JOIN o ON n.path = o.path)"""


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def now(t):
    return t("documents").where("doc_id % 11 <> 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), at("2024-01-02").alias("mod_time"), F.col("n_chars").alias("size"))


def saved(t):
    n = F.col("doc_id")
    return t("documents").where(n % 7 != 0).select(F.concat(F.lit("f"), n).alias("path"), F.when(n % 5 == 0, at("2024-01-01")).otherwise(at("2024-01-02")).alias("mod_time"), F.when(n % 9 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"))


def chunks(t):
    """Three stored chunks of every saved file."""
    return t("documents").where("doc_id % 7 <> 0").select(F.concat(F.lit("f"), "doc_id").alias("file"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("part"))


CHUNKS = "c AS (SELECT 'f' || doc_id AS file, unnest([1, 2, 3]) AS part FROM documents WHERE doc_id % 7 <> 0)"


@query("incremental_diff", f"WITH {DIFF} SELECT path, change, size FROM d")
def incremental_diff(t):
    return I.diff(now(t), saved(t)).select("path", "change", "size")


@query("has_changes", f"WITH {DIFF} SELECT count(*) FILTER (change <> 'unchanged') > 0 AS changed, count(*) FILTER (change = 'added') AS added FROM d")
def has_changes(t):
    d = I.diff(now(t), saved(t))
    return d.agg((F.count_if(F.col("change") != "unchanged") > 0).alias("changed"), F.count_if(F.col("change") == "added").alias("added"))


@query("state_after", f"WITH {DIFF} SELECT path, size FROM d WHERE change <> 'deleted'")
def state_after(t):
    return I.next_state(I.diff(now(t), saved(t))).select("path", "size")


@query("purge_stale", f"WITH {DIFF}, {CHUNKS} SELECT file, part FROM c WHERE file NOT IN (SELECT path FROM d WHERE change IN ('modified', 'deleted'))")
def purge_stale(t):
    return I.purge(chunks(t), I.diff(now(t), saved(t)))


@query("incremental_apply", f"WITH {DIFF}, {CHUNKS} SELECT file, part FROM c WHERE file NOT IN (SELECT path FROM d WHERE change IN ('modified', 'deleted')) UNION ALL SELECT 'f' || doc_id, 9 FROM documents WHERE 'f' || doc_id IN (SELECT path FROM d WHERE change IN ('added', 'modified'))")
def incremental_apply(t):
    made = t("documents").select(F.concat(F.lit("f"), "doc_id").alias("file"), F.lit(9).alias("part"))
    return I.apply(chunks(t), I.diff(now(t), saved(t)), made)


@query("upsert_latest", """WITH l AS (SELECT doc_id // 2 AS id, max(doc_id) AS v FROM documents GROUP BY 1)
 SELECT id, v FROM l UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT id FROM l)""")
def upsert_latest(t):
    base = t("documents").select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("v"))
    news = t("documents").select(F.expr("doc_id div 2").alias("id"), F.col("doc_id").alias("v"))
    return store.upsert(base, news, "id", "v")


@query("store_validation", "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS valid FROM documents")
def store_validation(t):
    n = F.col("doc_id")
    rows = t("documents").select("doc_id", F.when(n % 3 != 0, n.cast("string")).alias("id"), F.when(n % 5 != 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("embedding"))
    return store.valid(rows).select("doc_id", F.lit(True).alias("valid")).unionByName(store.rejected(rows).select("doc_id", F.lit(False).alias("valid")))


@query("delete_by_metadata", "SELECT doc_id FROM documents WHERE source <> 'src3'")
def delete_by_metadata(t):
    return store.delete(t("documents"), "source", "src3").select("doc_id")


@query("delete_by_id", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_id(t):
    return store.delete_keys(t("documents").select("doc_id"), t("labels").select("doc_id"), "doc_id")


@query("scan_fingerprint", f"""WITH f AS (SELECT path, {case(EXT_SQL, P.SCAN_LANGUAGES, repr(''))} AS language, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM {FILE_SQL} WHERE NOT ({skip_sql(P.SCAN_SKIPS)})),
 x AS (SELECT DISTINCT 'dir|' || language || '|' || dir AS x FROM f WHERE language NOT IN ('', 'markdown') UNION ALL SELECT DISTINCT 'doc|' || path FROM f WHERE language = 'markdown')
 SELECT md5((SELECT coalesce(sum(('0x' || md5(x)[1:15])::HUGEINT), 0) FROM x)::VARCHAR || ':' || count(*)) AS fingerprint, count(*) AS n FROM f""")
def scan_fingerprint(t):
    return S.fingerprint(files(t))


@query("needs_reindex", "SELECT true AS changed, false AS same")
def needs_reindex(t):
    every, fewer = S.fingerprint(files(t)), S.fingerprint(files(t).where("doc_id % 2 = 0"))
    none = F.lit(None).cast("boolean")
    both = I.needs_reindex(every, fewer).select(F.col("needs_reindex").alias("changed"), none.alias("same")).union(I.needs_reindex(every, every).select(none, "needs_reindex"))
    return both.agg(F.bool_or("changed").alias("changed"), F.bool_or("same").alias("same"))


@query("markdown_ids", """WITH RECURSIVE k AS (SELECT doc_id, encode('f' || doc_id || '#0') AS b FROM documents), h AS (SELECT doc_id, b, 0 AS i, 14695981039346656037::HUGEINT AS h FROM k UNION ALL
  SELECT doc_id, b, i + 1, ((h // 256 * 256 + xor((h % 256)::INT, ('0x' || hex(b[i + 1:i + 1]))::INT)) % 4294967296 * 1099511628211 + ((h // 4294967296) * 1099511628211 % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT FROM h WHERE i < octet_length(b))
 SELECT doc_id, h::VARCHAR AS id FROM h WHERE i = octet_length(b)""")
def markdown_ids(t):
    return t("documents").select("doc_id", T.fnv1a_64(F.concat(F.lit("f"), "doc_id", F.lit("#0"))).alias("id"))


@query("detect_workspace", f"""WITH f AS (SELECT path, string_split(path, '/') AS p FROM {FILE_SQL}), a AS (SELECT path, array_to_string(p[1:i], '/') AS root FROM (SELECT path, p, unnest(range(1, len(p))) AS i FROM f)),
 m(root, marker, kind, lang) AS (SELECT '/w/' || source, 'go.mod', 'go', 'go' FROM (SELECT DISTINCT source FROM documents WHERE contains(source, '1')) UNION ALL SELECT '/w/' || source || '/src/app', 'artisan', 'laravel', '' FROM (SELECT DISTINCT source FROM documents WHERE contains(source, '2'))),
 b AS (SELECT path, max_by(root, length(root)) AS root, max_by(kind, length(root)) AS project_type FROM a JOIN m USING (root) GROUP BY path)
 SELECT path, coalesce(b.root, regexp_extract(path, '^(.*)/[^/]*$', 1)) AS root, coalesce(project_type, 'unknown') AS project_type FROM (SELECT path FROM f) LEFT JOIN b USING (path)""")
def detect_workspace(t):
    of = t("documents").select("source").distinct()
    entries = of.where(F.col("source").contains("1")).select(F.concat(F.lit("/w/"), "source", F.lit("/go.mod")).alias("path")).union(of.where(F.col("source").contains("2")).select(F.concat(F.lit("/w/"), "source", F.lit("/src/app/artisan"))))
    return S.find_workspaces(files(t), entries).select("path", "root", "project_type")


@query("embed_hashing")
def embed_hashing(t):
    from tessella.functions.embed import embed

    return spread(t("documents")).select("doc_id", embed(F.col("text")).alias("embedding"))


@query("memory_store", "SELECT doc_id AS id, lang FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'en'")
def memory_store(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), "lang", F.array(F.lit(1.0)).alias("embedding"))
    held = store.MemoryStore(rows.limit(0))
    held.store(rows)
    held.store(rows.where("doc_id % 2 = 0"))
    held.delete(rows.where("id % 3 = 0"))
    held.delete_by_metadata("lang", "en")
    return held.rows.select("id", "lang")


@query("store_lifecycle", "SELECT * FROM (SELECT 'before' AS step, false AS there, 0 AS points UNION ALL SELECT 'created', true, count(*) FROM documents UNION ALL SELECT 'created again', true, count(*) FROM documents UNION ALL SELECT 'clear refused', true, count(*) FROM documents UNION ALL SELECT 'dropped', false, 0)")
def store_lifecycle(t):
    from tessella.plans.shared import fresh_path

    rows = t("documents").select(F.col("doc_id").alias("id"), F.array(F.lit(1.0)).alias("embedding"), F.lit("w").alias("workspace_id"), F.col("lang").alias("language"))
    spark = rows.sparkSession
    held, told = store.Store(spark, fresh_path(spark, "store")), []
    note = lambda step: told.append((step, held.exists(), held.read().count() if held.exists() else 0))
    note("before")
    held.create(rows)
    note("created")
    held.create(rows.limit(1))
    note("created again")
    try:
        held.clear()
    except NotImplementedError:
        note("clear refused")
    held.drop()
    note("dropped")
    return spark.createDataFrame(told, "step string, there boolean, points long")


@query("config_load", "SELECT * FROM (VALUES ('dimension', '32'), ('search_limit', '9'), ('exclude', 'a,b'), ('markdown_bytes', '1000'), ('debounce_seconds', '5')) AS v(name, value)")
def config_load(t):
    from tessella.plans.index import Config

    config = Config.load({"dimension": 32, "search_limit": 7}, {"TESSELLA_SEARCH_LIMIT": "9", "TESSELLA_EXCLUDE": "a, b", "HOME": "/"})
    rows = [(n, ",".join(v) if isinstance(v, list) else str(v)) for n in ("dimension", "search_limit", "exclude", "markdown_bytes", "debounce_seconds") for v in [getattr(config, n)]]
    return t("region").sparkSession.createDataFrame(rows, "name string, value string")


@query("embed_retry", "SELECT doc_id, length(text)::FLOAT AS size FROM documents")
def embed_retry(t):
    """An embedder that fails at every first call."""
    from tessella.functions.embed import embed

    calls: list[int] = []

    def flaky(texts):
        import numpy as np

        calls.append(1)
        if len(calls) % 2:
            raise ConnectionError("not yet")
        return np.array([[len(x)] for x in texts], np.float32)

    return t("documents").select("doc_id", F.element_at(embed(F.col("text"), flaky, 1), 1).alias("size"))


@query("index_workspace", """SELECT * FROM (SELECT 'first added' AS what, count(*) AS n FROM documents UNION ALL SELECT 'again unchanged', count(*) FROM documents UNION ALL SELECT 'later deleted', count(*) FROM documents WHERE doc_id % 11 = 0
 UNION ALL SELECT 'later modified', count(*) FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 = 0 UNION ALL SELECT 'later unchanged', count(*) FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0
 UNION ALL SELECT 'go points', 4 * count(*) FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 2 = 0 UNION ALL SELECT 'markdown points', count(*) FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 2 = 1) WHERE n > 0""")
def index_workspace(t):
    """Go and Markdown files indexed, again without changes, and again with some gone and some changed."""
    from tessella.plans.index import index_files
    from tessella.plans.shared import fresh_path
    from tessella.queries.structure import go_files

    n = F.col("doc_id")
    go = go_files(t).where(n % 2 == 0).select("doc_id", "path", "content")
    rows = go.union(t("documents").where(n % 2 == 1).select("doc_id", F.concat(F.lit("/w/m"), n, F.lit(".md")), F.lit("# One paragraph")))
    rows = rows.select("doc_id", "path", at("2024-01-02").cast("timestamp").alias("mod_time"), F.length("content").cast("long").alias("size"), "content")
    later = rows.where(n % 11 != 0).withColumn("size", F.when(n % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    spark, told = rows.sparkSession, []
    path = fresh_path(spark, "indexed")
    for name, files_now in (("first", rows), ("again", rows), ("later", later)):
        told += [(f"{name} {k}", v) for k, v in index_files(spark, files_now.drop("doc_id"), path, "w").items()]
    points = store.collections(store.Store(spark, f"{path}/chunks").read())
    return spark.createDataFrame(told, "what string, n long").union(points.select(F.concat("language", F.lit(" points")), "points"))


@query("ensure_indexed", """SELECT * FROM (VALUES ('flag set', 'true'), ('flag set again', 'false'), ('asked while indexing', 'indexing'), ('asked', 'indexed'), ('asked again', 'there'), ('collection of go', 'true'), ('collection of php', 'false'), ('collection of php, 1 at most', 'refused')) AS v(step, told)
 UNION ALL SELECT 'points of go', (4 * count(*))::VARCHAR FROM documents""")
def ensure_indexed(t):
    """Go files indexed on first demand only, and by one job at a time; collections taken up to a limit."""
    from tessella.plans.index import IndexFlag, acquire, ensure_indexed
    from tessella.plans.shared import fresh_path
    from tessella.queries.structure import go_files
    from tessella.sources.store import Store, collections

    files = go_files(t).select("path", at("2024-01-02").cast("timestamp").alias("mod_time"), F.length("content").cast("long").alias("size"), "content")
    spark = files.sparkSession
    path = fresh_path(spark, "ensured")
    flag, other = IndexFlag(spark, path, "w"), IndexFlag(spark, path, "w")
    told = [("flag set", flag.start()), ("flag set again", other.start()), ("asked while indexing", ensure_indexed(spark, files, path, "w"))]
    flag.stop()
    told += [("asked", ensure_indexed(spark, files, path, "w")), ("asked again", ensure_indexed(spark, files, path, "w"))]
    told += [("collection of go", acquire(spark, path, "w", "go", 1)), ("collection of php", acquire(spark, path, "w", "php", 2))]
    try:
        acquire(spark, path, "w", "php", 1)
    except ValueError:
        told.append(("collection of php, 1 at most", "refused"))
    points = collections(Store(spark, f"{path}/chunks").read())
    steps = spark.createDataFrame([(k, str(v).lower()) for k, v in told], "step string, told string")
    return steps.union(points.select(F.concat(F.lit("points of "), "language"), F.col("points").cast("string")))
