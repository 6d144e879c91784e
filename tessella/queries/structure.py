"""Structure of sources. The tables hold no code, so each document becomes a small file whose symbols the SQL knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import analyze as A
from tessella.operators import joins as J
from tessella.plans.registry import query
from tessella.plans.shared import spread

#: Stands for the document's id among the parts of a source.
N = object()


def sources(t, ext: str, *parts):
    """documents as files: the parts, one after the other."""
    columns = [F.lit(p) if isinstance(p, str) else F.col("doc_id") if p is N else p for p in parts]
    return spread(t("documents")).select("doc_id", F.concat(F.lit("/w/m"), "doc_id", F.lit(ext)).alias("path"), F.concat(*columns).alias("content"))


def python_files(t):
    return sources(t, ".py", "import os\nfrom pkg", N, " import Base, Item as I\n\nMAX_", N, ": int = ", N, "\nname = \"x\"\n\nclass K", N, "(Base):\n    \"\"\"Doc ", F.col("source"), ".\"\"\"\n    size: int = 1\n\n    @property\n    def v(self) -> int:\n        return 1\n\n    @v.setter\n    def v(self, x):\n        pass\n\n    def run(self, a: int, b: List[Item]) -> Order:\n        self.go(a)\n        return Helper.make(b)\n\nasync def f", N, "(x, *args):\n    yield x\n")


def of(t, kind: str, files):
    return A.analyze(files(t)).where(F.col("type") == kind)


def meta(name: str, schema: str):
    return F.from_json(F.try_element_at("metadata", F.lit(name)), schema)


@query("py_classes", "SELECT 'K' || doc_id AS name, 'Doc ' || source || '.' AS docstring, 7 AS start_line, 21 AS end_line, 'class K' || doc_id || '(Base)' AS signature, ['Base'] AS bases FROM documents")
def py_classes(t):
    return of(t, "class", python_files).select("name", "docstring", "start_line", "end_line", "signature", meta("bases", "array<string>").alias("bases"))


@query("py_methods", "SELECT '/w/m' || doc_id || '.py' AS file_path, 'run' AS name, 'def run(self, a: int, b: List[Item]) -> Order' AS signature, 19 AS start_line, 21 AS end_line FROM documents")
def py_methods(t):
    return of(t, "method", python_files).select("file_path", "name", "signature", "start_line", "end_line")


@query("py_functions", "SELECT 'f' || doc_id AS name, 'async def f' || doc_id || '(x, *args)' AS signature, true AS is_generator FROM documents")
def py_functions(t):
    return of(t, "function", python_files).select("name", "signature", (F.try_element_at("metadata", F.lit("is_generator")) == "true").alias("is_generator"))


@query("py_vars", "SELECT 'const' AS type, 'MAX_' || doc_id AS name, 'MAX_' || doc_id || ': int = ' || doc_id AS signature FROM documents UNION ALL SELECT 'var', 'name', 'name: ' FROM documents")
def py_vars(t):
    return A.analyze(python_files(t)).where("type IN ('const', 'var')").select("type", "name", "signature")


@query("py_imports", "SELECT 'K' || doc_id AS name, 'os' AS module, false AS is_from, []::VARCHAR[] AS names FROM documents UNION ALL SELECT 'K' || doc_id, 'pkg' || doc_id, true, ['Base', 'Item'] FROM documents")
def py_imports(t):
    rows = of(t, "class", python_files).select("name", F.explode(meta("imports", "array<struct<module:string,is_from:boolean,names:array<string>>>")).alias("i"))
    return rows.select("name", "i.module", "i.is_from", "i.names")


@query("py_calls", "SELECT '/w/m' || doc_id || '.py' AS file_path, 'self' AS receiver, 'go' AS name, 20 AS line FROM documents UNION ALL SELECT '/w/m' || doc_id || '.py', 'Helper', 'make', 21 FROM documents")
def py_calls(t):
    rows = of(t, "method", python_files).select("file_path", F.explode(meta("calls", "array<struct<name:string,receiver:string,line:int>>")).alias("c"))
    return rows.select("file_path", "c.receiver", "c.name", "c.line")


@query("method_calls", "SELECT receiver, name, count(*) AS n FROM (SELECT 'self' AS receiver, 'go' AS name FROM documents UNION ALL SELECT 'Helper', 'make' FROM documents) GROUP BY ALL")
def method_calls(t):
    return py_calls(t).groupBy("receiver", "name").agg(F.count(F.lit(1)).alias("n"))


@query("type_deps", "SELECT 'K' || doc_id AS name, ['Base', 'Item', 'Order', 'Helper'] AS deps FROM documents")
def type_deps(t):
    return of(t, "class", python_files).select("name", meta("dependencies", "array<string>").alias("deps"))


@query("property_merge", "SELECT '/w/m' || doc_id || '.py' AS file_path, 'v' AS name, true AS getter, true AS setter, false AS deleter FROM documents")
def property_merge(t):
    flag = lambda k: (F.try_element_at("metadata", F.lit(f"has_{k}")) == "true").alias(k)
    return of(t, "property", python_files).select("file_path", "name", flag("getter"), flag("setter"), flag("deleter"))


@query("property_merge_rows", "SELECT o_orderkey % 1000 AS name, bool_or(o_orderstatus = 'O') AS getter, bool_or(o_orderstatus = 'F') AS setter, bool_or(o_orderstatus = 'P') AS deleter FROM orders GROUP BY 1")
def property_merge_rows(t):
    part = F.element_at(F.create_map(F.lit("O"), F.lit("getter"), F.lit("F"), F.lit("setter"), F.lit("P"), F.lit("deleter")), F.col("o_orderstatus"))
    return J.merge_properties(t("orders").select((F.col("o_orderkey") % 1000).alias("name"), part.alias("part")))


def go_files(t):
    return sources(t, ".go", "package p", N, "\n\nimport (\n\t\"fmt\"\n\t\"os\"\n)\n\n// Run", N, " runs.\nfunc Run", N, "(a, b int) error { return nil }\n\ntype T", N, " struct {\n\tName string\n}\n\nfunc (t *T", N, ") Do(x string) (int, error) {\n\treturn 0, nil\n}\n\nconst C", N, " = ", N, "\n\nfunc hidden() {}\n")


@query("go_symbols", """SELECT 'p' || doc_id AS package, u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('function', 'Run' || doc_id, 'func Run' || doc_id || '(a, b int) error', 9, 9), ('type', 'T' || doc_id, 'type T' || doc_id || ' struct', 11, 13),
 ('method', 'Do', 'func (t *T' || doc_id || ') Do(x string) (int, error)', 15, 17), ('const', 'C' || doc_id, 'const C' || doc_id || ' = ' || doc_id, 19, 19)) AS v(type, name, signature, start_line, end_line)) AS u""")
def go_symbols(t):
    return A.analyze(go_files(t)).select("package", "type", "name", "signature", "start_line", "end_line")


@query("package_imports", "SELECT 'p' || doc_id AS package, ['fmt', 'os'] AS imports FROM documents")
def package_imports(t):
    rows = A.analyze(go_files(t)).select("package", F.explode(meta("imports", "array<string>")).alias("i")).distinct()
    return rows.groupBy("package").agg(F.sort_array(F.collect_list("i")).alias("imports"))


@query("class_methods", "SELECT 'T' || doc_id AS name, ['Do'] AS methods FROM documents")
def class_methods(t):
    return J.class_methods(A.analyze(go_files(t)))


def php_files(t):
    return sources(t, ".php", "<?php\nnamespace App\\Models", N, ";\nuse Illuminate\\Database\\Eloquent\\Model;\nuse App\\Other\\Role;\n\n/** A model. */\nclass M", N, " extends Model\n{\n    use SoftDeletes;\n    protected $table = 't", N, "';\n    protected $fillable = ['a', 'b'];\n    const X = 1;\n\n    /** Its posts. */\n    public function posts(): HasMany\n    {\n        return $this->hasMany(Post::class, 'k');\n    }\n\n    public function role()\n    {\n        return $this->belongsTo(Role::class);\n    }\n\n    public function scopeActive($q) { return $q; }\n    public function getFullNameAttribute() { return 1; }\n}\n\nfunction helper", N, "(int $a) { return $a; }\n")


@query("php_symbols", """SELECT '/w/m' || doc_id || '.php' AS file_path, u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('class', 'M' || doc_id, 7, 27), ('method', 'posts', 15, 18), ('method', 'role', 20, 23), ('method', 'scopeActive', 25, 25), ('method', 'getFullNameAttribute', 26, 26),
 ('property', 'table', 10, 10), ('property', 'fillable', 11, 11), ('constant', 'X', 12, 12), ('function', 'helper' || doc_id, 29, 29)) AS v(type, name, start_line, end_line)) AS u""")
def php_symbols(t):
    return A.analyze(php_files(t)).select("file_path", "type", "name", "start_line", "end_line")


MODEL = "struct<full_name:string,table:string,fillable:array<string>,soft_deletes:boolean,relations:array<struct<name:string,type:string,related_model:string,foreign_key:string>>,scopes:array<struct<name:string>>,attributes:array<struct<name:string,type:string>>>"


@query("eloquent_models", r"SELECT 'App\Models' || doc_id || '\M' || doc_id AS full_name, 't' || doc_id AS table_name, ['a', 'b'] AS fillable, true AS soft_deletes, ['active'] AS scopes, ['full_name'] AS attributes FROM documents")
def eloquent_models(t):
    m = of(t, "class", php_files).select(meta("eloquent", MODEL).alias("m"))
    return m.select("m.full_name", F.col("m.table").alias("table_name"), "m.fillable", "m.soft_deletes", F.col("m.scopes.name").alias("scopes"), F.col("m.attributes.name").alias("attributes"))


@query("resolve_relations", r"SELECT 'M' || doc_id AS class, 'posts' AS name, 'hasMany' AS type, 'App\Models' || doc_id || '\Post' AS related, 'k' AS foreign_key FROM documents UNION ALL SELECT 'M' || doc_id, 'role', 'belongsTo', 'App\Other\Role', '' FROM documents")
def resolve_relations(t):
    r = of(t, "class", php_files).select(F.col("name").alias("class"), F.explode(meta("eloquent", MODEL)["relations"]).alias("r"))
    return r.select("class", "r.name", "r.type", F.col("r.related_model").alias("related"), "r.foreign_key")


@query("resolve_names", "SELECT o_orderkey, coalesce(c_name, 'App.' || o_custkey) AS model FROM (SELECT o_orderkey, o_custkey FROM orders) LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def resolve_names(t):
    imports = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("short"), F.col("c_name").alias("full"))
    return J.resolve_names(t("orders").select("o_orderkey", F.col("o_custkey").alias("short")), imports, F.concat(F.lit("App."), "short")).select("o_orderkey", F.col("resolved").alias("model"))


@query("enrich_models", "SELECT o_orderkey, c_name AS model, CASE WHEN c_name IS NULL THEN s_name END AS controller FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey LEFT JOIN supplier ON o_custkey = s_suppkey")
def enrich_models(t):
    models = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("full_name"), F.col("c_name").alias("model"))
    controllers = t("supplier").select(F.col("s_suppkey").alias("full_name"), F.col("s_name").alias("controller"))
    return J.enrich(t("orders").select("o_orderkey", F.col("o_custkey").alias("full_name")), models, controllers).select("o_orderkey", "model", "controller")


@query("enrich_controllers", "SELECT l_orderkey, l_linenumber, s_name AS controller FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 1) ON l_suppkey = s_suppkey")
def enrich_controllers(t):
    controllers = t("supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("full_name"), F.col("s_name").alias("controller"))
    return J.enrich(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("full_name")), None, controllers).select("l_orderkey", "l_linenumber", "controller")


def controller_files(t):
    return sources(t, ".php", "<?php\nnamespace App\\Http\\Controllers;\n\nclass C", N, "Controller extends Controller\n{\n    public function index() { return 1; }\n    public function store(Request $request) { return 2; }\n    public function show($id) { return 3; }\n", F.when(F.col("doc_id") % 2 == 0, "    public function update($id) { return 4; }\n").otherwise(""), "    private function hid() { return 5; }\n    public function __construct() {}\n}\n")


CONTROLLER = "struct<class_name:string,is_resource:boolean,actions:array<struct<name:string,http_methods:array<string>>>>"


@query("controllers", "SELECT 'C' || doc_id || 'Controller' AS name, doc_id % 2 = 0 AS is_resource, CASE WHEN doc_id % 2 = 0 THEN ['index', 'store', 'show', 'update'] ELSE ['index', 'store', 'show'] END AS actions FROM documents")
def controllers(t):
    c = of(t, "class", controller_files).select("name", meta("controller", CONTROLLER).alias("c"))
    return c.select("name", "c.is_resource", F.col("c.actions.name").alias("actions"))


@query("resource_controllers", "SELECT l_orderkey AS class, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 5) >= 4 AS is_resource FROM lineitem GROUP BY l_orderkey")
def resource_controllers(t):
    action = F.element_at(F.array(*map(F.lit, ["index", "create", "store", "show", "edit", "other", "more"])), F.col("l_linenumber"))
    return J.resource_controllers(t("lineitem").select(F.col("l_orderkey").alias("class"), action.alias("method")))


def route_files(t):
    return sources(t, ".php", "<?php\nuse App\\Http\\Controllers\\UserController;\nRoute::get('/u", N, "', [UserController::class, 'index']);\nRoute::match(['put', 'patch'], '/m', 'C@up');\nRoute::resource('p", N, "', PhotoController::class);\nRoute::post('/x', function () { return 1; });\n")


@query("routes", r"""SELECT u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('GET', '/u' || doc_id, 'App\Http\Controllers\UserController', 'index', 3), ('PUT', '/m', 'C', 'up', 4), ('PATCH', '/m', 'C', 'up', 4), ('POST', '/x', 'Closure', '', 6),
 ('GET', '/p' || doc_id, 'PhotoController', 'index', 5), ('GET', '/p' || doc_id || '/create', 'PhotoController', 'create', 5), ('POST', '/p' || doc_id, 'PhotoController', 'store', 5), ('GET', '/p' || doc_id || '/{id}', 'PhotoController', 'show', 5),
 ('GET', '/p' || doc_id || '/{id}/edit', 'PhotoController', 'edit', 5), ('PUT', '/p' || doc_id || '/{id}', 'PhotoController', 'update', 5), ('DELETE', '/p' || doc_id || '/{id}', 'PhotoController', 'destroy', 5)) AS v(method, uri, controller, action, line)) AS u""")
def routes(t):
    r = of(t, "route", route_files).select(meta("route", "struct<method:string,uri:string,controller:string,action:string,line:int>").alias("r"))
    return r.select("r.*")


def phpdoc_files(t):
    return sources(t, ".php", "<?php\n/**\n * Sums ", F.col("source"), ".\n *\n * @param int $a first\n * @param string[] $b\n * @return bool done\n * @throws E", N, "\n * @deprecated soon\n */\nfunction g($a, $b) {}\n")


@query("phpdoc_tags", "SELECT 'Sums ' || source || '.' AS description, ['int', 'string[]'] AS types, 'bool' AS returns FROM documents")
def phpdoc_tags(t):
    return of(t, "function", phpdoc_files).select(F.col("docstring").alias("description"), meta("params", "array<struct<type:string>>")["type"].alias("types"), F.from_json(F.concat(F.lit('{"x":'), F.try_element_at("metadata", F.lit("returns")), F.lit("}")), "x string")["x"].alias("returns"))


def html_files(t):
    return sources(t, ".html", "<html><body><script>var t=\"</p>\";</script><h1 id=\"i", N, "\">Title ", N, "</h1><p>One &amp; two</p><h2>Sub</h2><p>Text ", F.col("source"), "</p><pre><code>code", N, "</code></pre></body></html>")


@query("html_sections", "SELECT '/w/m' || doc_id || '.html' AS file_path, 'Title ' || doc_id AS name, 'One & two' AS docstring, 'Title ' || doc_id || chr(10) || chr(10) || 'One & two' AS code FROM documents UNION ALL SELECT '/w/m' || doc_id || '.html', 'Sub', 'Text ' || source || chr(10) || 'code' || doc_id, 'Sub' || chr(10) || chr(10) || 'Text ' || source || chr(10) || 'code' || doc_id || chr(10) || chr(10) || 'code' || doc_id FROM documents")
def html_sections(t):
    return of(t, "section", html_files).select("file_path", "name", "docstring", "code")


@query("html_pages", "SELECT page_id, 1::BIGINT AS sections FROM pages")
def html_pages(t):
    pages = spread(t("pages")).select(F.concat(F.lit("/w/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return A.analyze(pages).groupBy(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("sections"))


@query("markdown_chunks", """WITH RECURSIVE l AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END), chr(10)) AS ls FROM documents),
 f AS (SELECT doc_id, ls, 0 AS i, '' AS buf, NULL::VARCHAR AS done FROM l UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN i = len(ls) THEN '' WHEN trim(ls[i + 1]) = '' AND buf <> '' THEN '' WHEN buf <> '' AND octet_length(encode(buf)) + octet_length(encode(ls[i + 1])) + 1 > 1000 THEN ls[i + 1] || chr(10) ELSE buf || ls[i + 1] || chr(10) END,
   CASE WHEN buf <> '' AND (i = len(ls) OR trim(ls[i + 1]) = '' OR octet_length(encode(buf)) + octet_length(encode(ls[i + 1])) + 1 > 1000) THEN nullif(regexp_replace(regexp_replace(buf, '^\\s+', ''), '\\s+$', ''), '') END FROM f WHERE i <= len(ls))
 SELECT 'f' || doc_id AS file, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_id, done AS content FROM f WHERE done IS NOT NULL""")
def markdown_chunks(t):
    text = F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(".\n"), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise("")))
    return A.markdown_chunks(spread(t("documents")).select(F.concat(F.lit("f"), "doc_id").alias("path"), text.alias("content"))).select("file", "chunk_id", "content")


@query("index_chunks", "SELECT u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('class', 'K' || doc_id, 'm' || doc_id), ('method', 'run', 'm' || doc_id), ('property', 'v', 'm' || doc_id), ('function', 'f' || doc_id, 'm' || doc_id), ('const', 'MAX_' || doc_id, 'm' || doc_id), ('var', 'name', 'm' || doc_id)) AS v(type, name, package)) AS u")
def index_chunks(t):
    return A.index_rows(A.analyze(python_files(t))).where(F.size("embedding") == 64).select("type", "name", "package")


@query("php_function_descriptor", "SELECT '/w/m' || doc_id AS file, u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('posts', 'method', 'M' || doc_id, 'HasMany', 0), ('role', 'method', 'M' || doc_id, 'mixed', 0), ('scopeActive', 'method', 'M' || doc_id, 'mixed', 1), ('getFullNameAttribute', 'method', 'M' || doc_id, 'mixed', 0), ('helper' || doc_id, 'function', '', 'mixed', 1)) AS v(name, kind, class_name, returns, n_params)) AS u")
def php_function_descriptor(t):
    from tessella.operators import search as S

    rows = S.php_function(A.analyze(php_files(t)))
    return rows.select(F.concat(F.lit("/w/m"), F.regexp_extract("package", r"(\d+)$", 1)).alias("file"), "name", "kind", "class_name", "returns", F.size("parameters").alias("n_params"))


@query("php_type_descriptor", r"SELECT 'M' || doc_id AS name, 'model' AS kind, 't' || doc_id AS table_name, ['HasMany<App\Models' || doc_id || '\Post>', 'BelongsTo<App\Other\Role>'] AS relations, ['eloquent', 'soft_deletes'] AS tags FROM documents")
def php_type_descriptor(t):
    from tessella.operators import search as S

    return S.php_type(A.analyze(php_files(t))).select("name", "kind", "table_name", F.col("relations.returns").alias("relations"), "tags")


@query("php_exports", r"SELECT 'class' AS type, 'M' || doc_id AS name FROM documents WHERE doc_id = 7")
def php_exports(t):
    from tessella.operators import search as S

    rows = A.analyze(php_files(t)).withColumn("id", F.col("file_path"))
    return S.exports(rows, "App\\Models7", kind="class", php=True).select("type", "name")


@query("go_code", r"""SELECT '/w/m' || doc_id || '.go' AS file_path, u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('Run' || doc_id, 'func Run' || doc_id || '(a, b int) error { return nil }'), ('T' || doc_id, 'type T' || doc_id || ' struct {' || chr(10) || chr(9) || 'Name string' || chr(10) || '}'),
 ('Do', 'func (t *T' || doc_id || ') Do(x string) (int, error) {' || chr(10) || chr(9) || 'return 0, nil' || chr(10) || '}'), ('C' || doc_id, doc_id::VARCHAR)) AS v(name, code)) AS u""")
def go_code(t):
    return A.analyze(go_files(t)).select("file_path", "name", "code")


def app_files(t):
    """Routes in one file, their controllers in another."""
    n = F.col("doc_id").cast("string")
    route = F.concat(F.lit("<?php\nuse App\\Http\\Controllers\\A"), n, F.lit("Controller;\nRoute::prefix('api')->group(function () {\n  Route::get('/u', [A"), n, F.lit("Controller::class, 'index']);\n  Route::group(['prefix' => '/v2'], function () {\n    Route::post('x', [A"), n, F.lit("Controller::class, 'none']);\n  });\n});\nRoute::put('/out', [A"), n, F.lit("Controller::class, 'up']);\n"))
    code = F.concat(F.lit("<?php\nnamespace App\\Http\\Controllers;\nclass A"), n, F.lit("Controller extends Controller\n{\n    public function index() { return 1; }\n    public function up() { return 2; }\n}\n"))
    routes = spread(t("documents")).select(F.concat(F.lit("/w/routes/r"), n, F.lit(".php")).alias("path"), route.alias("content"))
    return routes.union(spread(t("documents")).select(F.concat(F.lit("/w/app/a"), n, F.lit(".php")), code))


@query("route_handlers", r"""SELECT u.* FROM documents, LATERAL (SELECT * FROM (VALUES ('GET', '/api/u', 'index', '/w/app/a' || doc_id || '.php', 5), ('POST', '/api/v2/x', 'none', NULL, NULL), ('PUT', '/out', 'up', '/w/app/a' || doc_id || '.php', 6)) AS v(method, uri, action, handler_file, handler_line)) AS u""")
def route_handlers(t):
    chunks = A.analyze(app_files(t))
    routes = chunks.where("type = 'route'").select(meta("route", "struct<method:string,uri:string,controller:string,action:string>").alias("r")).select("r.*")
    text = F.from_json(F.concat(F.lit('{"x":'), F.try_element_at("metadata", F.lit("class_name")), F.lit("}")), "x string")["x"]
    methods = chunks.where("type = 'method'").select(F.concat("package", F.lit("\\"), F.coalesce(text, F.try_element_at("metadata", F.lit("class_name")))).alias("full_name"), "name", "file_path", "start_line")
    return J.route_handlers(routes, methods).select("method", "uri", "action", "handler_file", "handler_line")


@query("rejected_files", "SELECT '/w/m' || doc_id || '.py' AS path, 'python' AS language, true AS told FROM documents WHERE doc_id % 4 = 0")
def rejected_files(t):
    n = F.col("doc_id")
    rows = spread(t("documents")).select(F.concat(F.lit("/w/m"), n, F.lit(".py")).alias("path"), F.when(n % 4 == 0, F.concat(F.lit("def f(:\n  x"), n)).otherwise(F.concat(F.lit("x = "), n)).alias("content"))
    return A.rejected(rows).select("path", "language", (F.length("error") > 0).alias("told"))
