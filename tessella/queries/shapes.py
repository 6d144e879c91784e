"""Sources of many shapes. Every document becomes a file of the shape that its id picks; the symbols of a shape are written down by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import analyze as A
from tessella.plans.registry import query
from tessella.plans.shared import spread

#: Stands for the document's id.
ID = "§"

#: (source, its symbols as type, name, signature, first and last line).
PYTHON = [
    (
        "import enum\nfrom dataclasses import dataclass\n\n\n@dataclass(frozen=True)\nclass Tide§:\n    height: float = 0.0\n    port: str = 'x'\n\n\nclass Phase§(enum.Enum):\n    EBB = 1\n    FLOOD = 2\n",
        [("class", "Tide§", "class Tide§", 6, 8), ("class", "Phase§", "class Phase§(enum.Enum)", 11, 13)],
    ),
    (
        "from abc import ABCMeta, abstractmethod\n\nclass Gauge§(metaclass=ABCMeta):\n    @abstractmethod\n    def read(self, at: float) -> \"Level\": ...\n\n    @classmethod\n    def of(cls, **kinds: int): return cls()\n",
        [("class", "Gauge§", "class Gauge§(metaclass=ABCMeta)", 3, 8), ("method", "read", "def read(self, at: float) -> 'Level'", 5, 5), ("method", "of", "def of(cls, **kinds: int)", 8, 8)],
    ),
    (
        "async def flow§(x, /, y=1, *rest, key=None, **more):\n    async def inner(): pass\n    yield x\n",
        [("function", "flow§", "async def flow§(x, y, *rest, key, **more)", 1, 3)],
    ),
    (
        "from functools import cached_property\n\nclass Basin§:\n    @property\n    def depth(self) -> int:\n        return 1\n\n    @depth.setter\n    def depth(self, v): pass\n\n    @cached_property\n    def width(self): return 2\n",
        [("class", "Basin§", "class Basin§", 3, 12), ("property", "depth", "@property depth: int", 5, 6), ("property", "width", "@property width: ", 12, 12)],
    ),
    (
        "#!/usr/bin/env python\n\"\"\"Doc of §.\"\"\"\nLIMIT_§ = (1, 2)\nratio: float = 0.5\nname = other = 'x'\nMixed = 3\nf = lambda x: x\na, b = 1, 2\n",
        [("const", "LIMIT_§", "LIMIT_§:  = (1, 2)", 3, 3), ("var", "ratio", "ratio: float", 4, 4), ("var", "Mixed", "Mixed: ", 6, 6)],
    ),
    (
        "if True:\n    def hidden(): pass\n\nclass Outer§(Base, list[int]):\n    class Inner:\n        def m(self): pass\n\n    def own(self): pass\n",
        [("class", "Outer§", "class Outer§(Base, list[int])", 4, 8), ("method", "own", "def own(self)", 8, 8)],
    ),
    (
        "class Crlf§:\r\n    x = 1\r\n\r\ndef after§(): return 1\r\n",
        [("class", "Crlf§", "class Crlf§", 1, 2), ("function", "after§", "def after§()", 4, 4)],
    ),
    ("def broken§(:\n", []),
    (
        "text§ = '''\nclass Fake:\n    def no(self): pass\n'''\n\ndef real§(x: \"A | None\" = None) -> list[\"B\"]:\n    \"\"\"def no2(): pass\"\"\"\n    return x\n",
        [("var", "text§", "text§: ", 1, 1), ("function", "real§", "def real§(x: 'A | None') -> list['B']", 6, 8)],
    ),
    (
        "@route('/x',\n       methods=['GET'])\ndef größe§(\n    a: int,\n    b: dict[str, tuple[int, ...]],\n) -> None:\n    pass\n",
        [("function", "größe§", "def größe§(a: int, b: dict[str, tuple[int, ...]]) -> None", 3, 7)],
    ),
    ("# only a comment of §\n", []),
    (
        "class Reader§(Protocol):\n    def read(self) -> bytes: ...\nclass LogMixin§:\n    @staticmethod\n    async def log(msg: str, *, level=1): ...\n",
        [("class", "Reader§", "class Reader§(Protocol)", 1, 2), ("method", "read", "def read(self) -> bytes", 2, 2), ("class", "LogMixin§", "class LogMixin§", 3, 5), ("method", "log", "async def log(msg: str, level)", 5, 5)],
    ),
]

GO = [
    ("package p§\n\n// Map maps.\nfunc Map[T, U any](xs []T, f func(T) U) []U {\n\treturn nil\n}\n", [("function", "Map", "func Map[T, U any](xs []T, f func(T) U) []U", 4, 6)]),
    (
        "package p§\n\ntype (\n\t// A one.\n\tA§ struct{ X, Y int }\n\tb int\n\tC interface {\n\t\tRead(p []byte) (n int, err error)\n\t\tClose() error\n\t}\n)\n",
        [("type", "A§", "type A§ struct", 5, 5), ("type", "C", "type C interface", 7, 10)],
    ),
    (
        "package p§\n\nconst (\n\tLow§ = iota\n\tmid\n\tHigh\n)\n\nconst Pi, E float64 = 3.14, 2.72\n",
        [("const", "Low§", "const Low§ = iota", 4, 4), ("const", "High", "const High", 6, 6), ("const", "Pi", "const Pi float64 = 3.14", 9, 9), ("const", "E", "const E float64 = 2.72", 9, 9)],
    ),
    (
        "package p§\n\ntype Stack§[T any] struct {\n\titems []T\n}\n\nfunc (s *Stack§[T]) Push(x T) { s.items = append(s.items, x) }\n\nfunc (s *Stack§[T]) pop() T { var z T; return z }\n\ntype hidden struct{}\n\nfunc (h hidden) Show() {}\n",
        [("type", "Stack§", "type Stack§ struct", 3, 5), ("method", "Push", "func (s *Stack§[T]) Push(x T)", 7, 7)],
    ),
    (
        "package p§\n\nvar Tmpl§ = `func Fake() {}`\n\n/* func AlsoFake() {} */\nfunc Real§(s string) bool {\n\treturn s == \"}\" || s == \"{\" // }\n}\n",
        [("var", "Tmpl§", "var Tmpl§ = `func Fake() {}`", 3, 3), ("function", "Real§", "func Real§(s string) bool", 6, 8)],
    ),
    (
        "package p§\n\ntype Handler§ func(w Writer, r *Request) error\n\nfunc Serve(h Handler§, opts ...func(*Server)) (n int, err error) { return }\n\nfunc Pipe(in <-chan int, out chan<- string) <-chan error { return nil }\n",
        [("type", "Handler§", "type Handler§ func(w Writer, r *Request) error", 3, 3), ("function", "Serve", "func Serve(h Handler§, opts ...func(*Server)) (n int, err error)", 5, 5), ("function", "Pipe", "func Pipe(in <-chan int, out chan<- string) <-chan error", 7, 7)],
    ),
    (
        "package p§\n\nimport (\n\t\"fmt\"\n\tstr \"strings\"\n)\n\ntype ID§ = string\n\ntype Node§ struct {\n\tfmt.Stringer\n\t*Base\n\tName string `json:\"name\"`\n}\n",
        [("type", "ID§", "type ID§ = string", 8, 8), ("type", "Node§", "type Node§ struct", 10, 14)],
    ),
    ("package p§\n", []),
    (
        "package p§\n\nfunc Any§() interface{ Read() } { return nil }\n\nfunc Unit§() struct{} { return struct{}{} }\n",
        [("function", "Any§", "func Any§() interface{ Read() }", 3, 3), ("function", "Unit§", "func Unit§() struct{}", 5, 5)],
    ),
    (
        "package p§\n\nvar (\n\tOne§, Two = 1, f(2, 3)\n\tcache = map[string]int{\n\t\t\"a\": 1,\n\t}\n\tThree []int\n)\n",
        [("var", "One§", "var One§ = 1", 4, 4), ("var", "Two", "var Two = f(2, 3)", 4, 4), ("var", "Three", "var Three []int", 8, 8)],
    ),
    ("package p§\n\nfunc init() {}\n\nfunc main() {\n\tRun := func() {}\n\tRun()\n}\n", []),
]

PHP = [
    (
        "<?php\nnamespace Tide\\Gauges§;\n\ninterface Reads extends Base, Counts\n{\n    const UNIT = 'm';\n    public function read(int $at, ?string $port = null): float;\n}\n",
        [("interface", "Reads", "interface Reads extends Base, Counts", 4, 8), ("constant", "UNIT", "const UNIT = 'm'", 6, 6), ("method", "read", "function read(int $at, ?string $port): float", 7, 7)],
    ),
    (
        "<?php\ntrait Logs§\n{\n    protected static array $lines = [];\n    abstract public function name(): string;\n    private static function put(string ...$xs): void { self::$lines[] = $xs; }\n}\n",
        [("trait", "Logs§", "trait Logs§", 2, 7), ("property", "lines", "protected static array $lines", 4, 4), ("method", "name", "abstract function name(): string", 5, 5), ("method", "put", "static function put(string $xs): void", 6, 6)],
    ),
    (
        "<?php\nenum Suit§: string implements HasLabel\n{\n    case Hearts = 'H';\n    const Wild = self::Hearts;\n    public function label(): string { return 'x'; }\n}\n",
        [("enum", "Suit§", "enum Suit§ implements HasLabel", 2, 7), ("constant", "Wild", "const Wild = self::Hearts", 5, 5), ("method", "label", "function label(): string", 6, 6)],
    ),
    (
        "<?php\nnamespace A§ {\n    class One {}\n    function first(): int { return 1; }\n}\nnamespace B§ {\n    final class Two extends One {}\n}\n",
        [("class", "One", "class One", 3, 3), ("function", "first", "function first(): int", 4, 4), ("class", "Two", "final class Two extends One", 7, 7)],
    ),
    (
        "<?php\n$x = new class { public function hidden() {} };\n$f = function ($a) { return $a; };\nfunction real§(&$a, int|string $b = 5) { return <<<EOT\nclass Fake { }\nEOT;\n}\n",
        [("function", "real§", "function real§($a, int|string $b)", 4, 7)],
    ),
    (
        "<?php\nclass Point§\n{\n    public function __construct(\n        public readonly int $x = 0,\n        protected ?Point§ $next = null,\n    ) {\n    }\n}\n",
        [("class", "Point§", "class Point§", 2, 9), ("method", "__construct", "function __construct(int $x, ?Point§ $next)", 4, 8)],
    ),
    (
        "<?php\n/** Old. */\n#[Attribute(Attribute::TARGET_CLASS)]\nabstract class Marked§\n{\n    #[Pure]\n    abstract protected function go(): static;\n}\n",
        [("class", "Marked§", "abstract class Marked§", 4, 8), ("method", "go", "abstract function go(): static", 7, 7)],
    ),
    ("<h1>T§</h1>\n<?php\nfunction tail§() {}\n?>\n<p>class Fake {} isn't code</p>\n<?php function last() {}\n", [("function", "tail§", "function tail§()", 3, 3), ("function", "last", "function last()", 6, 6)]),
    (
        "<?php\nclass Str§\n{\n    private $open = \"{\";\n    public $text = 'function no() {}';\n    public function say($n) { return \"{$n} }\"; } // }\n}\n",
        [("class", "Str§", "class Str§", 2, 7), ("property", "open", "private $open", 4, 4), ("property", "text", "public $text", 5, 5), ("method", "say", "function say($n)", 6, 6)],
    ),
    ("just text §\n", []),
    (
        "<?php\nif (!function_exists('h§')) {\n    function h§($x) { return $x; }\n}\n$g = static function () use ($x): int { function no() {} };\n$o = new class(1) extends Base { const NO = 1; };\nuse_it(Base::class, [Other::class]);\n",
        [("function", "h§", "function h§($x)", 3, 3)],
    ),
    ("<?php\nnamespace K§;\nconst LIMIT = 10, OTHER = 'x';\ndefine('NOT_THIS', 1);\n", [("constant", "LIMIT", "const LIMIT = 10", 3, 3), ("constant", "OTHER", "const OTHER = 'x'", 3, 3)]),
]


#: Models and controllers: (source, what the framework makes of them as kind, name and detail).
LARAVEL = [
    (
        "<?php\nnamespace App\\Models;\nuse App\\Shop\\Item as Thing;\nclass Order§ extends Model\n{\n    protected $primaryKey = 'no';\n    public $timestamps = false;\n    protected $casts = ['paid' => 'boolean', 'at' => Moment::class];\n    public function things() { return $this->hasMany(Thing::class, 'order_no', 'no')->latest(); }\n    public function buyer() { return $this->belongsTo(\\Crm\\Buyer::class); }\n    public function owner() { return $this->morphTo(); }\n}\n",
        [("model", "App\\Models\\Order§", "no,false,false"), ("cast", "paid", "boolean"), ("cast", "at", "Moment::class"), ("relation", "things", "hasMany App\\Shop\\Item order_no"), ("relation", "buyer", "belongsTo Crm\\Buyer "), ("relation", "owner", "morphTo  ")],
    ),
    (
        "<?php\nnamespace App;\nuse Illuminate\\Foundation\\Auth\\User as Authenticatable;\nclass User§ extends Authenticatable\n{\n    use HasFactory, \\Illuminate\\Database\\Eloquent\\SoftDeletes;\n    public function scopeOfAge($q, $n) { return $q->where('age', '>', $n); }\n    public function scope() {}\n    public function getFullNameAttribute() { return ''; }\n    public function setNickAttribute($v) {}\n    public function getAttribute($key) {}\n}\n",
        [("model", "App\\User§", "id,true,true"), ("scope", "ofAge", "scopeOfAge"), ("attribute", "full_name", "accessor"), ("attribute", "nick", "mutator")],
    ),
    (
        "<?php\nnamespace App\\Models;\nclass Tag§ extends \\Illuminate\\Database\\Eloquent\\Model\n{\n    public function posts()\n    {\n        // $this->hasOne(No::class)\n        return $this->belongsToMany('App\\\\Models\\\\Post', \"post_tag\");\n    }\n    public function late() { $x = $this->other(); if ($x) { return $this->hasManyThrough(A::class, B::class); } }\n    public function plain() { return other()->hasOne(A::class); }\n}\n",
        [("model", "App\\Models\\Tag§", "id,true,false"), ("relation", "posts", "belongsToMany App\\Models\\Post post_tag"), ("relation", "late", "hasManyThrough App\\Models\\A B::class")],
    ),
    ("<?php\nnamespace App\\Services;\nclass Mailer§ extends Sender\n{\n    protected $fillable = ['a'];\n    public function scopeAll() {}\n}\ninterface Model {}\ntrait Relates { public function a() { return $this->hasOne(B::class); } }\n", []),
    (
        "<?php\nnamespace App\\Http\\Controllers\\Api;\nclass Port§Controller extends Controller\n{\n    public function __construct() { $this->middleware('auth'); $this->middleware(['log', 'throttle:60'])->only('index'); }\n    public function index() {}\n    public function listOpen(Request $r) {}\n    protected function helper() {}\n}\n",
        [("controller", "App\\Http\\Controllers\\Api\\Port§Controller", "Controller,false,true"), ("middleware", "auth", ""), ("middleware", "log", ""), ("middleware", "throttle:60", ""), ("action", "index", "GET"), ("action", "listOpen", "GET")],
    ),
    (
        "<?php\nnamespace Modules\\Web;\nuse App\\Http\\Controllers\\Controller;\nfinal class Page§ extends Controller\n{\n    public function store() {}\n    public function update($id) {}\n    public function destroy($id) {}\n    public function edit($id) {}\n    public function other() {}\n}\n",
        [("controller", "Modules\\Web\\Page§", "Controller,true,false"), ("action", "store", "POST"), ("action", "update", "PUT,PATCH"), ("action", "destroy", "DELETE"), ("action", "edit", "GET"), ("action", "other", "")],
    ),
    ("<?php\nnamespace App\\Http\\Controllers;\nclass Lone§ApiController\n{\n    public function __invoke() {}\n}\n", [("controller", "App\\Http\\Controllers\\Lone§ApiController", ",false,true")]),
]

#: Pages: (source, sections as type, name, signature, text and code).
HTML = [
    (
        "<div><h1>Tide §</h1><p>one</p></div><section><h3 class='x'>Ebb</h3><p>two</p><p>three</p></section>",
        [("section", "Tide §", "<h1>Tide §</h1>", "one", "Tide §\n\none"), ("section", "Ebb", "<h3>Ebb</h3>", "two\nthree", "Ebb\n\ntwo\nthree")],
    ),
    ("<html><head><title>Page §</title><style>h1 {}</style></head><body><p>only this</p>\n\n  <pre>x = 1</pre></body></html>", [("file", "Page §", "Page §", "only this\nx = 1", "only this\nx = 1")]),
    ("<h1>Empty §</h1><h2> </h2><p>t</p>loose text<p>u</p>", [("section", "Section 2", "<h2>Section 2</h2>", "t\nu", "Section 2\n\nt\nu")]),
    (
        "<h1 id='i'>Caf&eacute; <b>§</b></h1><p>a &lt; b</p><script>var h = '<h2>x</h2></p>';</script><!-- <h2>no</h2> --><h4>Deep</h4><div><pre>if a:\n  b</pre></div>",
        [("section", "Café §", "<h1>Café §</h1>", "a < b", "Café §\n\na < b"), ("section", "Deep", "<h4>Deep</h4>", "if a:\nb", "Deep\n\nif a:\nb\n\nif a:\nb")],
    ),
    ("<H2>Upper §</H2><P>first<P>second", [("section", "Upper §", "<h2>Upper §</h2>", "first\nsecond", "Upper §\n\nfirst\nsecond")]),
    (
        "<table><tr><td><h5>Cell §</h5><p>inside</p></td><td><p>beside</p></td></tr></table><h6>Last</h6><code>f()</code><code>g()</code>",
        [("section", "Cell §", "<h5>Cell §</h5>", "inside", "Cell §\n\ninside"), ("section", "Last", "<h6>Last</h6>", "f()\ng()", "Last\n\nf()\ng()\n\nf()\n\ng()")],
    ),
    ("<body><h1>Nothing §</h1><p> </p></body>", [("file", "m§", "", "Nothing §", "Nothing §")]),
    ("  \n", []),
]


def literal(text: str) -> str:
    """A string of SQL."""
    return "'" + text.replace("'", "''") + "'"


def sql(shapes) -> str:
    rows = ", ".join(f"({i}, {literal(kind)}, {literal(name)}, {literal(signature)}, {start}, {end})" for i, (_, symbols) in enumerate(shapes) for kind, name, signature, start, end in symbols)
    at = lambda c: f"replace({c}, '{ID}', doc_id::VARCHAR) AS {c}"
    return f"SELECT doc_id, type, {at('name')}, {at('signature')}, start_line, end_line FROM documents JOIN (VALUES {rows}) AS v(shape, type, name, signature, start_line, end_line) ON doc_id % {len(shapes)} = shape"


def shaped(t, ext: str, shapes):
    n = F.col("doc_id").cast("string")
    source = F.element_at(F.array(*(F.lit(s) for s, _ in shapes)), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    return spread(t("documents")).select(F.concat(F.lit("/w/m"), n, F.lit(ext)).alias("path"), F.replace(source, F.lit(ID), n).alias("content"))


def symbols(t, ext: str, shapes):
    return A.analyze(shaped(t, ext, shapes)).select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), "type", "name", "signature", "start_line", "end_line")


@query("py_shapes", sql(PYTHON))
def py_shapes(t):
    return symbols(t, ".py", PYTHON)


@query("go_shapes", sql(GO))
def go_shapes(t):
    return symbols(t, ".go", GO)


@query("php_shapes", sql(PHP))
def php_shapes(t):
    return symbols(t, ".php", PHP)


def laravel_sql() -> str:
    rows = ", ".join(f"({i}, {literal(kind)}, {literal(name)}, {literal(detail)})" for i, (_, found) in enumerate(LARAVEL) for kind, name, detail in found)
    return f"SELECT doc_id, kind, replace(name, '{ID}', doc_id::VARCHAR) AS name, detail FROM documents JOIN (VALUES {rows}) AS v(shape, kind, name, detail) ON doc_id % {len(LARAVEL)} = shape"


MODEL = "struct<full_name:string,primary_key:string,timestamps:boolean,soft_deletes:boolean,casts:map<string,string>,relations:array<struct<name:string,type:string,related_model:string,foreign_key:string>>,scopes:array<struct<name:string,method_name:string>>,attributes:array<struct<name:string,type:string>>>"
CONTROLLER = "struct<full_name:string,base_controller:string,is_resource:boolean,is_api:boolean,middleware:array<string>,actions:array<struct<name:string,http_methods:array<string>>>>"


@query("laravel_shapes", laravel_sql())
def laravel_shapes(t):
    rows = A.analyze(shaped(t, ".php", LARAVEL)).select("file_path", *(F.from_json(F.try_element_at("metadata", F.lit(k)), kind).alias(k[0]) for k, kind in (("eloquent", MODEL), ("controller", CONTROLLER))))
    told = lambda kind, name, detail: F.struct(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))
    each = lambda items, f: F.coalesce(F.transform(items, f), F.array().cast("array<struct<kind:string,name:string,detail:string>>"))
    m, c = F.col("e"), F.col("c")
    found = F.concat(
        F.when(m.isNotNull(), F.array(told("model", m["full_name"], F.concat_ws(",", m["primary_key"], m["timestamps"], m["soft_deletes"])))).otherwise(F.array()),
        each(F.map_entries(m["casts"]), lambda x: told("cast", x["key"], x["value"])),
        each(m["relations"], lambda x: told("relation", x["name"], F.concat_ws(" ", x["type"], x["related_model"], x["foreign_key"]))),
        each(m["scopes"], lambda x: told("scope", x["name"], x["method_name"])),
        each(m["attributes"], lambda x: told("attribute", x["name"], x["type"])),
        F.when(c.isNotNull(), F.array(told("controller", c["full_name"], F.concat_ws(",", c["base_controller"], c["is_resource"], c["is_api"])))).otherwise(F.array()),
        each(c["middleware"], lambda x: told("middleware", x, F.lit(""))),
        each(c["actions"], lambda x: told("action", x["name"], F.array_join(x["http_methods"], ","))),
    )
    return rows.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), F.explode(found).alias("x")).select("doc_id", "x.*")


def html_sql() -> str:
    rows = ", ".join(f"({i}, {', '.join(map(literal, x))})" for i, (_, found) in enumerate(HTML) for x in found)
    columns = ["name", "signature", "docstring", "code"]
    return f"SELECT doc_id, type, {', '.join(f"replace({c}, '{ID}', doc_id::VARCHAR) AS {c}" for c in columns)} FROM documents JOIN (VALUES {rows}) AS v(shape, type, {', '.join(columns)}) ON doc_id % {len(HTML)} = shape"


@query("html_shapes", html_sql())
def html_shapes(t):
    return A.analyze(shaped(t, ".html", HTML)).select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), "type", "name", "signature", "docstring", "code")
