"""Scalar functions, predicates and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T
from tessella.plans.registry import query
from tessella.plans.shared import spread


def case(key: str, table: dict[str, str], default: str) -> str:
    """A SQL CASE for a table of fixed values."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: A file path for every document, by its id: extensions, directories and names in turn.
EXTS = ["go", "PY", "js", "ts", "jsx", "tsx", "mjs", "php", "html", "htm", "md", "rs", "java", "kt", "rb", "swift", "c", "h", "cpp", "hpp", "cc", "cxx", "cs", "yaml", "txt", ""]
DIRS = ["src/app", "vendor/lib", "docs", "node_modules/x", ".git/hooks", "build", "lib/.hidden", "pkg/util", "target/out", "public/js"]
FILE_SQL = f"""(SELECT doc_id, text, lang, source, n_chars, '/w/' || source || '/' || {listed(DIRS)}[1 + doc_id % {len(DIRS)}] || '/' || CASE WHEN doc_id % 7 = 0 THEN 'ReadMe-first_part' ELSE 'file' || doc_id END ||
  CASE WHEN {listed(EXTS)}[1 + doc_id % {len(EXTS)}] = '' THEN '' ELSE '.' || {listed(EXTS)}[1 + doc_id % {len(EXTS)}] END AS path FROM documents)"""


def files(t):
    """documents with a path."""
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % len(EXTS) + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, DIRS)), (F.col("doc_id") % len(DIRS) + 1).cast("int"))
    name = F.when(F.col("doc_id") % 7 == 0, "ReadMe-first_part").otherwise(F.concat(F.lit("file"), F.col("doc_id")))
    return t("documents").withColumn("path", F.concat(F.lit("/w/"), "source", F.lit("/"), folder, F.lit("/"), name, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))


EXT_SQL = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"


def skip_sql(names: list[str], dotted: bool = False) -> str:
    return f"len(list_filter(string_split(path, '/')[1:-2], lambda p: list_contains({listed(names)}, p)" + (" OR starts_with(p, '.')" if dotted else "") + ")) > 0"


@query("infer_language", f"SELECT doc_id, path, {case(EXT_SQL, P.QUERY_LANGUAGES, repr(''))} AS language FROM {FILE_SQL}")
def infer_language(t):
    return files(t).select("doc_id", "path", P.query_language(F.col("path")).alias("language"))


@query("scan_classify", f"SELECT path, {case(EXT_SQL, P.SCAN_LANGUAGES, repr(''))} AS language, n_chars AS size FROM {FILE_SQL} WHERE NOT ({skip_sql(P.SCAN_SKIPS)})")
def scan_classify(t):
    from tessella.sources.files import classify

    return classify(files(t).withColumnRenamed("n_chars", "size")).select("path", "language", "size")


@query("distinct_languages", f"SELECT DISTINCT {case(EXT_SQL, P.INVENTORY_LANGUAGES, repr(''))} AS language FROM {FILE_SQL} WHERE NOT ({skip_sql(P.INVENTORY_SKIPS, True)}) AND {case(EXT_SQL, P.INVENTORY_LANGUAGES, repr(''))} <> ''")
def distinct_languages(t):
    from tessella.sources.files import languages

    return languages(files(t))


@query("language_dirs", f"SELECT language, list_sort(list(DISTINCT dir)) AS dirs FROM (SELECT {case(EXT_SQL, P.SCAN_LANGUAGES, repr(''))} AS language, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM {FILE_SQL} WHERE NOT ({skip_sql(P.SCAN_SKIPS)})) WHERE language <> '' GROUP BY language")
def language_dirs(t):
    from tessella.sources.files import language_dirs as run

    return run(files(t))


@query("resource_catalog", f"""
SELECT 'file://' || path AS uri, replace(regexp_replace(rel, '\\.[^.]*$', ''), '/', '-') AS name,
 array_to_string(list_transform(list_filter(string_split(translate(regexp_replace(base, '\\.[^.]*$', ''), '-_', '  '), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
 CASE WHEN ext = 'yaml' THEN 'Configuration file' WHEN contains(lower(base), 'readme') THEN 'README documentation' WHEN contains(lower(rel), 'docs') THEN 'Technical documentation' ELSE 'Project documentation' END AS description,
 CASE WHEN ext = 'md' THEN 'text/markdown' ELSE 'application/x-yaml' END AS mime
FROM (SELECT *, {EXT_SQL} AS ext, path[4:] AS rel, regexp_extract(path, '[^/]*$', 0) AS base FROM {FILE_SQL} WHERE NOT ({skip_sql(P.RESOURCE_SKIPS)})) WHERE ext IN ('md', 'yaml', 'yml')""")
def resource_catalog(t):
    from tessella.sources.files import resources

    return resources(files(t), "/w")


@query("extensions_of_language", "SELECT lang AS language, e.extensions FROM (VALUES " + ", ".join(f"('{k}', {listed(v)})" for k, v in P.EXTENSIONS.items()) + ") AS e(lang, extensions)")
def extensions_of_language(t):
    names = t("region").limit(1).select(F.explode(F.array(*map(F.lit, P.EXTENSIONS))).alias("language"))
    return names.select("language", P.extensions_of(F.col("language")).alias("extensions"))


MARKER = f"{listed(P.MARKERS + ['requirements.txt', 'none'])}[1 + s_suppkey % {len(P.MARKERS) + 2}]"


def markers(t):
    return t("supplier").withColumn("marker", F.element_at(F.array(*map(F.lit, [*P.MARKERS, "requirements.txt", "none"])), (F.col("s_suppkey") % (len(P.MARKERS) + 2) + 1).cast("int")))


@query("project_type", f"SELECT s_suppkey, {MARKER} AS marker, {case(MARKER, P.PROJECT_TYPES, repr('unknown'))} AS project_type FROM supplier")
def project_type(t):
    return markers(t).select("s_suppkey", "marker", P.project_type(F.col("marker")).alias("project_type"))


@query("marker_language", f"SELECT s_suppkey, {MARKER} AS marker, {case(MARKER, P.MARKER_LANGUAGES, repr(''))} AS language FROM supplier")
def marker_language(t):
    return markers(t).select("s_suppkey", "marker", P.marker_language(F.col("marker")).alias("language"))


@query("primary_language", f"SELECT s_suppkey, coalesce(nullif({case('m1', P.PRIMARY_LANGUAGES, repr(''))}, ''), {case('m2', P.PRIMARY_LANGUAGES, repr(''))}) AS language FROM (SELECT s_suppkey, {MARKER} AS m1, {listed(P.MARKERS)}[1 + (s_suppkey * 5) % {len(P.MARKERS)}] AS m2 FROM supplier)")
def primary_language(t):
    second = F.element_at(F.array(*map(F.lit, P.MARKERS)), (F.col("s_suppkey") * 5 % len(P.MARKERS) + 1).cast("int"))
    return markers(t).select("s_suppkey", P.primary_language(F.array("marker", second), F.lit(False)).alias("language"))


KINDS = ["", "go", " Laravel ", "unknown", "PHP", "web", "Django", "fastapi", "rust", "static-html"]


@query("normalize_project", f"SELECT s_suppkey, k AS kind, {case('lower(trim(k))', P.PROJECT_LANGUAGES, 'lower(trim(k))')} AS language FROM (SELECT s_suppkey, {listed(KINDS)}[1 + s_suppkey % {len(KINDS)}] AS k FROM supplier)")
def normalize_project(t):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("s_suppkey") % len(KINDS) + 1).cast("int"))
    return t("supplier").select("s_suppkey", kind.alias("kind")).withColumn("language", P.project_language(F.col("kind")))


@query("workspace_id", "SELECT s_suppkey, left(sha256('/home/' || s_name), 12) AS workspace_id FROM supplier")
def workspace_id(t):
    return t("supplier").select("s_suppkey", P.workspace_id(F.concat(F.lit("/home/"), "s_name")).alias("workspace_id"))


@query("collection_name", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{P.DEFAULT_PREFIX}' ELSE 'own' END || '-' || source || CASE WHEN lang = 'es' THEN '' ELSE '-' || lang END AS collection FROM documents")
def collection_name(t):
    prefix = F.when(F.col("doc_id") % 3 == 0, "").otherwise("own")
    return t("documents").select("doc_id", P.collection_name(prefix, F.col("source"), F.when(F.col("lang") == "es", "").otherwise(F.col("lang"))).alias("collection"))


@query("path_exclusion", f"SELECT doc_id, path, contains(path, 'build') OR contains(path, '.git') AS excluded FROM {FILE_SQL}")
def path_exclusion(t):
    return files(t).select("doc_id", "path", P.excluded(F.col("path"), ["build", ".git"]).alias("excluded"))


@query("valid_root", "SELECT doc_id, r AS root, NOT (r = '/' OR r = '/home/me' OR starts_with(r, '/tmp')) AS valid FROM (SELECT doc_id, ['/', '/home/me', '/tmpfoo', '/tmp/a', '/srv/' || source][1 + doc_id % 5] AS r FROM documents)")
def valid_root(t):
    root = F.element_at(F.array(F.lit("/"), F.lit("/home/me"), F.lit("/tmpfoo"), F.lit("/tmp/a"), F.concat(F.lit("/srv/"), "source")), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", root.alias("root")).withColumn("valid", P.valid_root(F.col("root"), "/home/me"))


@query("coalesce_path", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, ''), '') AS path FROM documents")
def coalesce_path(t):
    return t("documents").select("doc_id", T.coalesce_path(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("path"))


@query("truncate_bytes", r"""SELECT doc_id, octet_length(encode(cut)) AS bytes, CASE WHEN cut = text THEN text ELSE cut END AS head FROM (SELECT doc_id, text,
 CASE WHEN octet_length(encode(text)) <= 400 THEN text ELSE list_max(list_transform(range(1, 401), lambda n: CASE WHEN octet_length(encode(text[:n])) <= 400 THEN lpad(n::VARCHAR, 4, '0') END)) END AS k,
 CASE WHEN octet_length(encode(text)) <= 400 THEN text ELSE text[:k::INT] || CASE WHEN octet_length(encode(text[:k::INT])) < 400 THEN chr(65533) ELSE '' END END AS cut FROM documents)""")
def truncate_bytes(t):
    return t("documents").select("doc_id", T.truncate_bytes(F.col("text"), 400).alias("head")).select("doc_id", F.octet_length("head").cast("long").alias("bytes"), "head")


@query("embed_text", "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN text ELSE '  ' END, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END, CASE WHEN doc_id % 10 = 5 THEN '' ELSE lang END], lambda x: coalesce(trim(x), '') <> ''), chr(10) || chr(10)) AS embed FROM documents WHERE NOT (doc_id % 10 = 5)")
def embed_text(t):
    d = t("documents")
    doc = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("  ")
    sig, code = F.when(F.col("doc_id") % 5 != 0, F.col("source")), F.when(F.col("doc_id") % 10 == 5, "").otherwise(F.col("lang"))
    return d.select("doc_id", T.embed_text(doc, sig, code).alias("embed")).where("embed IS NOT NULL")


@query("exported_filter", "SELECT p_partkey, name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS name FROM part) WHERE regexp_matches(name, '^[A-Z]')")
def exported_filter(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 10000))).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", name.alias("name")).where(T.exported(F.col("name")))


@query("namespace_prefix", r"SELECT doc_id, ns FROM (SELECT doc_id, ['App', 'App\Models', 'Application', 'App\Http\Controllers', ''][1 + doc_id % 5] AS ns FROM documents) WHERE ns = 'App' OR starts_with(ns, 'App\')")
def namespace_prefix(t):
    ns = F.element_at(F.array(*map(F.lit, ["App", "App\\Models", "Application", "App\\Http\\Controllers", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", ns.alias("ns")).where(T.in_namespace(F.col("ns"), "App"))


@query("package_filter", "SELECT doc_id, source FROM documents WHERE contains(source, 'c1')")
def package_filter(t):
    return t("documents").where(F.col("source").contains("c1")).select("doc_id", "source")


TOKENS = ["the", "that", "of"]


@query("query_tokens", r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS tokens FROM documents")
def query_tokens(t):
    return t("documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("lexical_score", "SELECT doc_id, " + " + ".join(f"((length(text) - length(replace(lower(text), '{w}', ''))) // {len(w)})" for w in TOKENS) + "::DOUBLE AS lexical FROM documents")
def lexical_score(t):
    return spread(t("documents")).select("doc_id", T.lexical_score(F.col("text"), F.array(*map(F.lit, TOKENS))).alias("lexical"))


@query("occurrence_count", "SELECT doc_id, (length(text) - length(replace(text, 'Th', ''))) // 2 AS n FROM documents")
def occurrence_count(t):
    return t("documents").select("doc_id", T.occurrences(F.col("text"), F.lit("Th")).alias("n"))


@query("snippet", """SELECT doc_id, CASE WHEN pos IS NULL THEN '' ELSE array_to_string(ls[greatest(pos - 2, 1):least(pos + 2, len(ls))], chr(10)) END AS snippet FROM
 (SELECT doc_id, string_split(text, chr(10)) AS ls, list_min(list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'tion'))) AS pos FROM documents)""")
def snippet(t):
    return t("documents").select("doc_id", T.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


@query("read_lines", "SELECT doc_id, array_to_string(ls[2:3], chr(10)) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE len(ls) >= 3")
def read_lines(t):
    return t("documents").select("doc_id", T.read_lines(F.col("text"), F.lit(2), F.lit(3)).alias("body")).where("body IS NOT NULL")


@query("code_context", """SELECT doc_id, n AS line_no, CASE WHEN n BETWEEN 3 AND 4 THEN 'body' ELSE 'context' END AS region, lpad(n::VARCHAR, 4, ' ') || CASE WHEN n BETWEEN 3 AND 4 THEN ' ┃ ' ELSE ' │ ' END || ls[n] AS rendered FROM
 (SELECT doc_id, ls, unnest(range(2, least(6, len(ls) + 1)))::INT AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE len(ls) >= 3)""")
def code_context(t):
    from tessella.sources.files import code_context as run

    return run(t("documents"), 3, 4, 1)


@query("extract_capped", "SELECT doc_id, array_to_string(ls[2:least(len(ls), 5)], chr(10)) AS code FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def extract_capped(t):
    from tessella.sources.files import extract

    return t("documents").select("doc_id", extract(F.col("text"), F.lit(2), F.lit(400), cap=3).alias("code"))


@query("normalize_ws", r"SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(html, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> ''), chr(10)) AS cleaned FROM pages")
def normalize_ws(t):
    return t("pages").select("page_id", T.normalize_whitespace(F.col("html")).alias("cleaned"))


@query("first_line", "SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents")
def first_line(t):
    return t("documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


NAME = "['firstName', 'HTTPServer', 'getFullNameAttribute', 'setPasswordAttribute', 'scopeActive', 'scope', 'index', 'UpdateUser', 'deleteAll', 'MAX_SIZE', 'Max', 'listItems', 'getAttribute'][1 + doc_id % 13]"
NAMES = ["firstName", "HTTPServer", "getFullNameAttribute", "setPasswordAttribute", "scopeActive", "scope", "index", "UpdateUser", "deleteAll", "MAX_SIZE", "Max", "listItems", "getAttribute"]


def named(t):
    return t("documents").select("doc_id", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 13 + 1).cast("int")).alias("name"))


@query("snake_case", f"SELECT doc_id, lower(n[1] || regexp_replace(n[2:], '([A-Z])', '_\\1', 'g')) AS snake FROM (SELECT doc_id, {NAME} AS n FROM documents)")
def snake_case(t):
    return named(t).select("doc_id", T.snake_case(F.col("name")).alias("snake"))


@query("eloquent_attributes", f"SELECT doc_id, CASE n[1:3] WHEN 'get' THEN 'accessor' ELSE 'mutator' END AS kind, lower(m[1] || regexp_replace(m[2:], '([A-Z])', '_\\1', 'g')) AS attribute FROM (SELECT doc_id, {NAME} AS n, regexp_extract(n, '^[gs]et(.*)Attribute$', 1) AS m FROM documents) WHERE m <> ''")
def eloquent_attributes(t):
    return named(t).select("doc_id", T.attribute_kind(F.col("name")).alias("kind"), T.attribute_name(F.col("name")).alias("attribute")).where("kind IS NOT NULL")


@query("eloquent_scopes", f"SELECT doc_id, lower(n[6]) || n[7:] AS scope FROM (SELECT doc_id, {NAME} AS n FROM documents) WHERE starts_with(n, 'scope') AND length(n) > 5")
def eloquent_scopes(t):
    return named(t).select("doc_id", T.scope_name(F.col("name")).alias("scope")).where("scope IS NOT NULL")


@query("http_methods", f"SELECT doc_id, CASE WHEN l IN ('index','show','create','edit') THEN ['GET'] WHEN l = 'store' THEN ['POST'] WHEN l = 'update' THEN ['PUT','PATCH'] WHEN l = 'destroy' THEN ['DELETE'] WHEN l[1:3] = 'get' OR l[1:4] IN ('show','list') THEN ['GET'] WHEN l[1:6] = 'create' OR l[1:5] = 'store' THEN ['POST'] WHEN l[1:6] = 'update' THEN ['PUT','PATCH'] WHEN l[1:6] = 'delete' OR l[1:7] = 'destroy' THEN ['DELETE'] ELSE []::VARCHAR[] END AS verbs FROM (SELECT doc_id, lower({NAME}) AS l FROM documents)")
def http_methods(t):
    return named(t).select("doc_id", T.http_methods(F.col("name")).alias("verbs"))


@query("is_constant", f"SELECT doc_id, regexp_matches(n, '^[A-Z]') AND NOT regexp_matches(n, '[a-z]') AS constant FROM (SELECT doc_id, {NAME} AS n FROM documents)")
def is_constant(t):
    return named(t).select("doc_id", T.is_constant(F.col("name")).alias("constant"))


@query("relation_return_type", f"SELECT p_partkey, base || CASE WHEN p_partkey % 2 = 0 THEN '<App\\' || p_brand || '>' ELSE '' END AS type FROM (SELECT p_partkey, p_brand, {case('k', T.RELATION_TYPES, 'k')} AS base FROM (SELECT *, {listed([*T.RELATION_TYPES, 'morphOne'])}[1 + p_partkey % 10] AS k FROM part))")
def relation_return_type(t):
    kind = F.element_at(F.array(*map(F.lit, [*T.RELATION_TYPES, "morphOne"])), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t("part").select("p_partkey", T.relation_return_type(kind, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("App\\"), "p_brand"))).alias("type"))


@query("indent_width", r"SELECT doc_id, length(replace(regexp_extract(l, '^[ \t]*', 0), chr(9), '    ')) AS width FROM (SELECT doc_id, repeat(chr(9), (doc_id % 3)::INT) || repeat(' ', (doc_id % 4)::INT) || text AS l FROM documents)")
def indent_width(t):
    line = F.concat(F.repeat(F.lit("\t"), (F.col("doc_id") % 3).cast("int")), F.repeat(F.lit(" "), (F.col("doc_id") % 4).cast("int")), F.col("text"))
    return t("documents").select("doc_id", T.indent_width(line).alias("width"))


@query("base_type", "SELECT doc_id, ['User', 'Order', 'Item', 'str', 'User'][1 + doc_id % 5] AS base FROM documents")
def base_type(t):
    kind = F.element_at(F.array(*map(F.lit, ["List[User]", "Dict[str, Order]", "Optional[List[Item]]", "str", "Dict[str, List[User]]"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", T.base_type(kind).alias("base"))


@query("split_csv", "SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents")
def split_csv(t):
    return t("documents").select("doc_id", T.split_csv(F.col("text")).alias("items"))


@query("fnv_id", """WITH RECURSIVE k AS (SELECT doc_id, encode(source || ':' || lang || ':' || doc_id) AS b FROM documents),
 h AS (SELECT doc_id, b, 0 AS i, 14695981039346656037::HUGEINT AS h FROM k UNION ALL
  SELECT doc_id, b, i + 1, ((h // 256 * 256 + xor((h % 256)::INT, ('0x' || hex(b[i + 1:i + 1]))::INT)) % 4294967296 * 1099511628211 + ((h // 4294967296) * 1099511628211 % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT FROM h WHERE i < octet_length(b))
 SELECT doc_id, h::VARCHAR AS id FROM h WHERE i = octet_length(b)""")
def fnv_id(t):
    return spread(t("documents")).select("doc_id", T.fnv1a_64(F.concat_ws(":", "source", "lang", "doc_id")).alias("id"))


@query("chunk_json", """SELECT doc_id, '{"Type":"function","Name":"' || source || '","Package":"","Language":"' || lang || '","FilePath":"a\\u003cb","StartLine":' || doc_id || ',"EndLine":' || (doc_id + 2) || '}' AS json FROM documents""")
def chunk_json(t):
    from tessella.operators.chunks import go_json

    return t("documents").select("doc_id", go_json(F.to_json(F.struct(F.lit("function").alias("Type"), F.col("source").alias("Name"), F.lit("").alias("Package"), F.col("lang").alias("Language"), F.lit("a<b").alias("FilePath"), F.col("doc_id").alias("StartLine"), (F.col("doc_id") + 2).alias("EndLine")))).alias("json"))


HEADING = "['h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'hr'][1 + doc_id % 8]"


@query("heading_level", f"SELECT doc_id, CASE WHEN doc_id % 8 < 6 THEN {HEADING}[2]::INT ELSE 0 END AS level FROM documents")
def heading_level(t):
    tag = F.element_at(F.array(*map(F.lit, ["h1", "H2", "h3", "h4", "h5", "h6", "p", "hr"])), (F.col("doc_id") % 8 + 1).cast("int"))
    return t("documents").select("doc_id", T.heading_level(tag).alias("level"))


@query("first_character", "SELECT doc_id, text[1] AS first FROM documents")
def first_character(t):
    return t("documents").select("doc_id", T.first_character(F.col("text")).alias("first"))


@query("doc_examples", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN ['Run(' || doc_id || ')' || chr(10) || 'more' || chr(10)] ELSE ['a' || doc_id || chr(10), 'b' || chr(10)] END AS examples FROM documents")
def doc_examples(t):
    n = F.col("doc_id").cast("string")
    one = F.concat(F.lit("Runs.\n\nExample:\n    Run("), n, F.lit(")\n    \tmore\n\nEnd."))
    two = F.concat(F.lit("Usage:\n\ta"), n, F.lit("\n\n```go\n    b\n```\n    no example"))
    doc = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Plain "), n, F.lit("\n    indented"))).when(F.col("doc_id") % 3 == 1, one).otherwise(two)
    return t("documents").select("doc_id", T.doc_examples(doc).alias("examples"))


@query("resolve_path", """SELECT p.path, coalesce(CASE WHEN starts_with(p.path, '/') THEN a.path END, CASE WHEN NOT starts_with(p.path, '/') THEN coalesce(b.path, c.path) END) AS resolved FROM
 (SELECT CASE WHEN doc_id % 4 = 0 THEN '/w/m' || doc_id WHEN doc_id % 4 = 1 THEN 'm' || doc_id WHEN doc_id % 4 = 2 THEN 'x/m' || doc_id ELSE 'none' || doc_id END AS path FROM documents) p
 LEFT JOIN (SELECT '/w/m' || doc_id AS path FROM documents WHERE doc_id % 8 <> 0) a ON a.path = p.path LEFT JOIN (SELECT '/w/m' || doc_id AS path FROM documents WHERE doc_id % 8 <> 0) b ON b.path = '/w/' || p.path LEFT JOIN (SELECT '/x/m' || doc_id AS path FROM documents) c ON c.path = '/' || p.path""")
def resolve_path(t):
    from tessella.sources.files import resolve_paths

    n = F.col("doc_id")
    asked = t("documents").select(F.when(n % 4 == 0, F.concat(F.lit("/w/m"), n)).when(n % 4 == 1, F.concat(F.lit("m"), n)).when(n % 4 == 2, F.concat(F.lit("x/m"), n)).otherwise(F.concat(F.lit("none"), n)).alias("path"))
    entries = t("documents").where(n % 8 != 0).select(F.concat(F.lit("/w/m"), n).alias("path")).union(t("documents").select(F.concat(F.lit("/x/m"), n)))
    return resolve_paths(asked, entries, ["/w", "/"])


@query("tool_parameters", "SELECT * FROM (VALUES ('search_code', 'query', 'string', true, ''), ('search_code', 'limit', 'number', false, '5'), ('find_implementations', 'symbol_name', 'string', true, ''), ('get_code_context', 'context_lines', 'number', false, '5')) AS v(tool, parameter, kind, required, default_value)")
def tool_parameters(t):
    from tessella.plans.tools import schemas

    rows = schemas(t("region").sparkSession)
    return rows.where("(tool, parameter) IN (('search_code', 'query'), ('search_code', 'limit'), ('find_implementations', 'symbol_name'), ('get_code_context', 'context_lines'))")
