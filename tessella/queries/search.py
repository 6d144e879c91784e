"""Retrieval over documents as chunks and embeddings as their vectors; the query vector is that of vec_id 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunks as C
from tessella.operators import search as S
from tessella.operators import vector as V
from tessella.plans.registry import query

TYPES = ["function", "method", "type", "class", "const"]
#: Chunk columns of a document, but its text.
HEAD = f"""SELECT doc_id AS id, {[*TYPES]}[1 + doc_id % 5] AS type, 'Sym' || (doc_id % 40) AS name, lang AS language, source AS package, '/w/' || source || '/f' || (doc_id % 97) AS file,
 (doc_id % 300)::INT AS start_line, (doc_id % 300 + 9)::INT AS end_line, CASE WHEN doc_id % 4 = 0 THEN 'markdown' END AS chunk_type, text AS content FROM documents"""
SCORED = f"""h AS ({HEAD}), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
 s AS (SELECT h.*, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM h JOIN embeddings ON id = vec_id, q)"""


def heads(t, text: bool = False):
    """Chunk columns of documents; with their text only where it is asked for."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (n % 5 + 1).cast("int"))
    cols = [n.alias("id"), kind.alias("type"), F.concat(F.lit("Sym"), n % 40).alias("name"), F.col("lang").alias("language"), F.col("source").alias("package"), F.concat(F.lit("/w/"), "source", F.lit("/f"), n % 97).alias("file"), (n % 300).cast("int").alias("start_line"), (n % 300 + 9).cast("int").alias("end_line"), F.when(n % 4 == 0, "markdown").alias("chunk_type")]
    return t("documents").select(*cols, *([F.col("text").alias("content"), F.col("text").alias("code")] if text else []))


def chunk_rows(t):
    """Chunks with vectors, without texts: what is ranked."""
    return heads(t).join(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


def query_vector(t) -> list[float]:
    """The parameter of a search: one vector of a fixed size."""
    return [float(x) for x in t("embeddings").where("vec_id = 0").first()["embedding"]]


def with_text(t, found):
    """Results (a few rows, by a limit) with the texts of their documents."""
    return t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(F.broadcast(found), "id")


@query("vector_topk", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 10")
def vector_topk(t):
    return V.top_k(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), query_vector(t), 10).select("id", "score")


@query("vector_topk_filtered", f"WITH {SCORED} SELECT id, score FROM s WHERE chunk_type IS DISTINCT FROM 'markdown' ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(t):
    return V.top_k(V.code_only(chunk_rows(t)), query_vector(t), 10).select("id", "score")


@query("search_code_only", f"WITH h AS ({HEAD}) SELECT id, type, name FROM h WHERE chunk_type IS DISTINCT FROM 'markdown'")
def search_code_only(t):
    return V.code_only(heads(t)).select("id", "type", "name")


@query("lookup_name_type", f"WITH h AS ({HEAD}) SELECT id, name, type FROM h WHERE name = 'Sym7' AND type IN ('type', 'class')")
def lookup_name_type(t):
    return heads(t).where((F.col("name") == "Sym7") & F.col("type").isin("type", "class")).select("id", "name", "type")


@query("exact_lookup", f"WITH h AS ({HEAD}) SELECT id, name, type, 1.0::DOUBLE AS score FROM h WHERE name = 'Sym7' AND type IN ('type', 'class') ORDER BY id LIMIT 10")
def exact_lookup(t):
    return V.lookup(heads(t), "Sym7", ["type", "class"]).select("id", "name", "type", "score")


@query("search_code", f"WITH {SCORED} SELECT id, score, name, type, package, content FROM s WHERE chunk_type IS DISTINCT FROM 'markdown' ORDER BY score DESC, id LIMIT 5")
def search_code(t):
    return with_text(t, S.search_code(chunk_rows(t), query_vector(t)).drop("embedding")).select("id", "score", "name", "type", "package", "content")


@query("search_docs", f"WITH {SCORED} SELECT id, score, content FROM s WHERE chunk_type = 'markdown' ORDER BY score DESC, id LIMIT 5")
def search_docs(t):
    return with_text(t, S.search_docs(chunk_rows(t), query_vector(t)).drop("embedding")).select("id", "score", "content")


@query("search_docs_faithful", f"WITH {SCORED} SELECT id, score, content FROM s ORDER BY score DESC, id LIMIT 5")
def search_docs_faithful(t):
    return with_text(t, S.search_docs(chunk_rows(t), query_vector(t), faithful=True).drop("embedding")).select("id", "score", "content")


def hybrid_sql(words: list[str], k: int, select: str, order: str = "ORDER BY hybrid DESC, id LIMIT {k}") -> str:
    lex = " + ".join(f"((length(content) - length(replace(lower(content), '{w}', ''))) // {len(w)})" for w in words)
    return f"""WITH {SCORED}, c AS (SELECT * FROM s WHERE chunk_type IS DISTINCT FROM 'markdown' ORDER BY score DESC, id LIMIT {max(5 * k, 10)}),
 l AS (SELECT *, ({lex})::DOUBLE AS lexical FROM c), m AS (SELECT *, max(lexical) OVER () AS top FROM l),
 f AS (SELECT *, round(CASE WHEN top > 0 THEN 0.6 * score + 0.4 * lexical / top ELSE score END, 6) AS hybrid FROM m WHERE lexical > 0 OR top = 0)
 SELECT {select} FROM f {order.format(k=k)}"""


def fused(t, text: str, k: int = 5):
    found = with_text(t, S.candidates(chunk_rows(t), query_vector(t), k).drop("embedding"))
    return S.fuse(found, F.array(*map(F.lit, text.lower().split())))


@query("hybrid_search", hybrid_sql(["the", "schen"], 5, "id, name, type, package, score, lexical, hybrid"))
def hybrid_search(t):
    return fused(t, "the schen").orderBy(F.desc("hybrid"), "id").limit(5).select("id", "name", "type", "package", "score", "lexical", "hybrid")


@query("hybrid_fusion", hybrid_sql(["the", "of"], 20, "id, lexical, hybrid", ""))
def hybrid_fusion(t):
    return fused(t, "the of", 20).select("id", "lexical", "hybrid")


@query("hybrid_fallback", hybrid_sql(["qqzz"], 5, "id, lexical, hybrid"))
def hybrid_fallback(t):
    return fused(t, "qqzz").orderBy(F.desc("hybrid"), "id").limit(5).select("id", "lexical", "hybrid")


@query("render_markdown", hybrid_sql(["the", "schen"], 5, "row_number() OVER (ORDER BY hybrid DESC, id) AS rank, printf('### %d. %s (%s)' || chr(10) || '- file: %s:%d' || chr(10) || '- score: %.4f, semantic: %.4f, lexical: %.1f', row_number() OVER (ORDER BY hybrid DESC, id), name, type, file, start_line, hybrid, score, lexical) AS markdown"))
def render_markdown(t):
    return S.render_hits(fused(t, "the schen").orderBy(F.desc("hybrid"), "id").limit(5))


def detail_sql(name: str, types: list[str], package: str = "") -> str:
    fits = f"name = '{name}' AND type IN ({', '.join(repr(x) for x in types)})" + (f" AND contains(package, '{package}')" if package else "")
    return f"""WITH {SCORED}, e AS (SELECT id, 1.0 AS score, 0 AS p FROM h WHERE {fits} ORDER BY id LIMIT 1), n AS (SELECT * FROM s WHERE chunk_type IS DISTINCT FROM 'markdown' ORDER BY score DESC, id LIMIT 50),
 b AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT id, score, 1 FROM n WHERE {fits}) ORDER BY p, score DESC, id LIMIT 1)
 SELECT h.id, h.name, h.type, h.package, b.score::DOUBLE AS score, h.content AS code FROM b JOIN h USING (id)"""


def detail(t, name: str, types: list[str], package: str = ""):
    rows = heads(t).join(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    found = V.exact_or_near(rows, name, types, query_vector(t), package=package).select("id", "name", "type", "package", "score")
    return with_text(t, found).select("id", "name", "type", "package", "score", F.col("content").alias("code"))


@query("function_details", detail_sql("Sym11", ["function", "method"], "c1"))
def function_details(t):
    return detail(t, "Sym11", ["function", "method"], "c1")


@query("type_definition", detail_sql("Sym12", ["type", "class", "interface", "trait", "model"]))
def type_definition(t):
    return detail(t, "Sym12", ["type", "class", "interface", "trait", "model"])


USAGES = f"""WITH h AS ({HEAD}), u AS (SELECT *, (length(content) - length(replace(content, 'Then', ''))) // 4 AS occurrences, row_number() OVER (PARTITION BY file, name, start_line ORDER BY id) AS n FROM h WHERE contains(content, 'Then') AND name <> 'Sym1')"""


@query("find_usages", USAGES + " SELECT id, file, name, start_line, occurrences FROM u WHERE n = 1")
def find_usages(t):
    rows = heads(t, text=True).withColumn("name", F.when(F.col("name") == "Sym1", "Then").otherwise(F.col("name")))
    return S.usages(rows, "Then").select("id", "file", "name", "start_line", "occurrences")


@query("find_usages_top", USAGES + " SELECT id, occurrences FROM u WHERE n = 1 ORDER BY occurrences DESC, file, start_line, id LIMIT 20")
def find_usages_top(t):
    rows = heads(t, text=True).withColumn("name", F.when(F.col("name") == "Sym1", "Then").otherwise(F.col("name")))
    return S.usages(rows, "Then").select("id", "occurrences").limit(20)


@query("dedupe_usages", f"WITH h AS ({HEAD}) SELECT file, name, start_line, min(id) AS id FROM h GROUP BY ALL")
def dedupe_usages(t):
    return heads(t).groupBy("file", "name", "start_line").agg(F.min("id").alias("id"))


@query("list_exports", f"WITH h AS ({HEAD}) SELECT type, name, min(id) AS id FROM h WHERE contains(package, 'src1') GROUP BY type, name")
def list_exports(t):
    return S.exports(heads(t), "src1").select("type", "name", "id")


@query("dedupe_exports", f"WITH {SCORED} SELECT type, name, id, score FROM (SELECT *, row_number() OVER (PARTITION BY type, name ORDER BY score DESC, id) AS n FROM s) WHERE n = 1")
def dedupe_exports(t):
    return S.one_export_each(V.scored(chunk_rows(t), query_vector(t))).select("type", "name", "id", "score")


EXPORTS = f"WITH h AS ({HEAD}), g AS (SELECT type, count(DISTINCT name) AS n, list_sort(list(DISTINCT name)) AS names FROM h WHERE contains(package, 'src1') GROUP BY type)"


@query("exports_by_type", EXPORTS + " SELECT type, n, names, (sum(n) OVER ())::BIGINT AS total FROM g")
def exports_by_type(t):
    return S.exports_by_type(S.exports(heads(t), "src1"))


@query("render_exports", EXPORTS + " SELECT type, '## ' || type || ' (' || n || ')' || chr(10) || array_to_string(list_transform(names, lambda x: '- ' || x), chr(10)) AS markdown FROM g")
def render_exports(t):
    return S.render_exports(S.exports_by_type(S.exports(heads(t), "src1")))


@query("search_all_workspaces", f"WITH {SCORED} SELECT id, package, language, score FROM s ORDER BY score DESC, id LIMIT 10")
def search_all_workspaces(t):
    return V.top_k_of_each(chunk_rows(t), query_vector(t), 10, ["package", "language"]).select("id", "package", "language", "score")


@query("topk_per_collection", f"WITH {SCORED} SELECT id, package, score FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY score DESC, id) AS n FROM s) WHERE n <= 3")
def topk_per_collection(t):
    from pyspark.sql import Window

    w = Window.partitionBy("package").orderBy(F.desc("score"), "id")
    return V.scored(chunk_rows(t), query_vector(t)).withColumn("n", F.row_number().over(w)).where("n <= 3").select("id", "package", "score")


@query("list_collections", "SELECT DISTINCT source AS workspace_id, lang AS language FROM documents")
def list_collections(t):
    return t("documents").select(F.col("source").alias("workspace_id"), F.col("lang").alias("language")).distinct()


@query("collection_counts", "SELECT source AS workspace_id, lang AS language, count(*) AS points FROM documents GROUP BY ALL")
def collection_counts(t):
    from tessella.sources.store import collections

    return collections(t("documents").select(F.col("source").alias("workspace_id"), F.col("lang").alias("language")))


@query("collection_status", "SELECT count(*) = 0 AS empty FROM documents WHERE source = 'none'")
def collection_status(t):
    return t("documents").where("source = 'none'").agg((F.count(F.lit(1)) == 0).alias("empty"))


@query("result_adaptation", f"WITH h AS ({HEAD}) SELECT id, coalesce(content, '<nil>') AS content, name, package, 1.0::DOUBLE AS score FROM h")
def result_adaptation(t):
    return heads(t, text=True).select("id", F.coalesce("content", F.lit("<nil>")).alias("content"), "name", "package", F.lit(1.0).alias("score"))


@query("symbol_projection", """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'function' ELSE 'document' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'Sym' || doc_id ELSE '' END AS name,
 CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS namespace, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS package, CASE WHEN doc_id % 2 = 0 THEN doc_id::INT END AS start_line, CASE WHEN doc_id % 2 = 0 THEN 'body ' || doc_id END AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'doc' ELSE 'plain ' || source END AS description FROM documents""")
def symbol_projection(t):
    n = F.col("doc_id")
    chunk = t("documents").select(n.alias("id"), F.lit("function").alias("type"), F.concat(F.lit("Sym"), n).alias("name"), F.col("source").alias("package"), F.col("lang").alias("language"), F.lit("/f").alias("file_path"), F.lit("file:///f").alias("uri"), n.cast("int").alias("start_line"), n.cast("int").alias("end_line"), n.cast("int").alias("selection_start_line"), n.cast("int").alias("selection_end_line"), F.lit("").alias("signature"), F.lit("doc").alias("docstring"), F.concat(F.lit("body "), n).alias("code"), F.create_map(F.lit("a"), F.lit("1")).alias("metadata"), F.concat(F.lit("plain "), "source").alias("plain"))
    rows = chunk.select("id", F.when(F.col("id") % 2 == 0, C.stored_json(chunk)).otherwise(F.col("plain")).alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return C.describe(rows).select("id", "language", "kind", "name", "namespace", "package", "location.start_line", F.try_element_at("metadata", F.lit("snippet")).alias("snippet"), "description")


@query("go_function_descriptor", f"""WITH h AS ({HEAD}) SELECT id, name, CASE WHEN id % 3 = 0 THEN '*T' ELSE '' END AS receiver, CASE WHEN id % 3 = 0 THEN 'method' ELSE 'function' END AS kind, 'exported' AS visibility, 'x' || id AS p_name, 'int' AS p_type FROM h""")
def go_function_descriptor(t):
    meta = F.map_concat(F.create_map(F.lit("params"), F.concat(F.lit('[{"name":"x'), "id", F.lit('","type":"int"}]'))), F.create_map(F.lit("receiver"), F.when(F.col("id") % 3 == 0, "*T").otherwise("")))
    out = S.go_function(heads(t).withColumn("metadata", meta))
    return out.select("id", "name", "receiver", "kind", "visibility", F.col("parameters")[0]["name"].alias("p_name"), F.col("parameters")[0]["type"].alias("p_type"))


@query("lexical_filter", f"WITH h AS ({HEAD}) SELECT id FROM h WHERE contains(content, 'tion') AND name <> 'Sym3'")
def lexical_filter(t):
    rows = heads(t, text=True)
    return rows.where((F.col("name") != "Sym3") & (T.occurrences(F.col("code"), F.lit("tion")) > 0)).select("id")
