"""Analyzers on small sources."""

import json

import pytest

from tessella.operators.analyzers import go, html, php, python


def by_name(chunks):
    return {(c["type"], c["name"]): c for c in chunks}


def test_go():
    src = '// Package tide predicts tides.\npackage tide\n\nimport "time"\n\n// Height gives metres.\nfunc Height(at time.Time, port string) float64 { return 0 }\n\ntype Gauge struct {\n\tPort string\n}\n\ntype Empty struct{}\n\nfunc (g *Gauge) Read(raw []byte, n int) (int, error) {\n\treturn n, nil\n}\n\nfunc Open() *Gauge { return nil }\n\ntype Source interface {\n\tNext(n int) error\n}\n\nfunc unseen() {}\nvar Depth, w = 1, 2\n'
    c = by_name(go.analyze("/x/tide.go", src))
    assert set(c) == {("function", "Height"), ("type", "Gauge"), ("type", "Empty"), ("method", "Read"), ("function", "Open"), ("type", "Source"), ("var", "Depth")}
    assert c["function", "Height"]["docstring"] == "Height gives metres." and c["function", "Height"]["package"] == "tide"
    assert json.loads(c["type", "Gauge"]["metadata"]["methods"]) == ["Read"]
    assert json.loads(c["type", "Source"]["metadata"]["methods"]) == ["Next"]
    assert go.analyze("/x/tide_test.go", src) == []


def test_go_with_odd_text():
    assert go.analyze("/x.go", "") == []
    assert [c["name"] for c in go.analyze("/x.go", 'package p\nconst S = "func X() {"\nfunc F(m map[string]func(int) error, c chan<- int) {}\n')] == ["S", "F"]


def test_python():
    src = 'from typing import List\nMAX_SIZE = 3\nDEFAULT_NAME = "x"\nmy_variable: int = 1\nanother_var = 2\n\nclass UserService(Base):\n    """Serves."""\n    def get(self, u: User, items: List[Product]) -> Order:\n        self.validate()\n        super().process()\n        return Helper.compute(save_to_db(u))\n\n@dataclass\nclass D(Enum): pass\n'
    c = by_name(python.analyze("/a/mod.py", src))
    assert {k for k in c if k[0] in ("const", "var")} == {("const", "MAX_SIZE"), ("const", "DEFAULT_NAME"), ("var", "my_variable"), ("var", "another_var")}
    calls = json.loads(c["method", "get"]["metadata"]["calls"])
    assert {(x["receiver"], x["name"]) for x in calls} == {("self", "validate"), ("super()", "process"), ("Helper", "compute"), ("", "save_to_db")}
    assert json.loads(c["class", "UserService"]["metadata"]["dependencies"])[:4] == ["Base", "User", "Product", "Order"]
    assert c["class", "D"]["metadata"]["is_dataclass"] == "true" and c["class", "D"]["metadata"]["is_enum"] == "true"
    with pytest.raises(ValueError, match="line 1"):
        python.analyze("/a.py", "def f(:\n")
    assert python.module_name("/p/pkg/__init__.py") == "pkg"


def test_php_and_laravel():
    src = "<?php\nnamespace App\\Models;\nuse App\\Models\\Comment;\nuse App\\Other\\Role as UserRole;\nuse Illuminate\\Database\\Eloquent\\Model;\n\n/** Users. */\nfinal class User extends Model {\n    use SoftDeletes;\n    protected $table = 'users';\n    protected $fillable = ['name', 'email'];\n    protected $casts = ['at' => 'datetime'];\n    public function posts() { return $this->hasMany(Post::class); }\n    public function role() { return $this->belongsTo(UserRole::class, 'role_id'); }\n    private function setName(string $n): void { $x = \"{$n}\"; }\n    public function scopeActive($q) {}\n    public function getFullNameAttribute() {}\n}\n"
    c = by_name(php.analyze("/app/User.php", src))
    m = json.loads(c["class", "User"]["metadata"]["eloquent"])
    assert m["table"] == "users" and m["fillable"] == ["name", "email"] and m["casts"] == {"at": "datetime"} and m["soft_deletes"]
    assert [(r["name"], r["type"], r["related_model"]) for r in m["relations"]] == [("posts", "hasMany", "App\\Models\\Post"), ("role", "belongsTo", "App\\Other\\Role")]
    assert m["scopes"][0]["name"] == "active" and m["attributes"][0]["name"] == "full_name"
    assert c["method", "setName"]["metadata"]["visibility"] == '"private"' and c["class", "User"]["package"] == "App\\Models"
    assert c["class", "User"]["metadata"]["is_final"] == "true"


def test_routes():
    src = "<?php\nRoute::get('/', function () { return view('x'); });\nRoute::get('/u', [UserController::class, 'index']);\nRoute::post('/u', [UserController::class, 'store']);\nRoute::put('/u/{id}', 'UserController@update');\nRoute::match(['get', 'post'], '/m', 'C@m');\nRoute::resource('photos', PhotoController::class);\n"
    r = [c for c in php.analyze("/routes/web.php", src) if c["type"] == "route"]
    assert len(r) == 13
    assert r[0]["docstring"] == "Route GET / -> Closure" and r[3]["docstring"] == "Route PUT /u/{id} -> UserController@update"


def test_php_with_odd_text():
    assert php.analyze("/x.php", "") == [] and php.analyze("/x.php", "no code") == []
    assert php.phpdoc("/** A.\n * @see B\n * @return int n\n */") == {"description": "A.", "params": [], "returns": [{"type": "int", "description": "n"}], "throws": [], "var": "", "deprecated": "", "see": ["B"], "examples": []}


def test_html():
    page = '<head><title> Tides </title></head><body><h1 id="ebb">Ebb</h1><p>Falls</p><h2 class="wide">Flood</h2><p>Rises</p><pre><code>h = 1</code></pre></body>'
    a, b = html.analyze("/p/x.html", page)
    assert (a["name"], a["signature"], a["docstring"], a["code"]) == ("Ebb", "<h1>Ebb</h1>", "Falls", "Ebb\n\nFalls")
    assert {k: json.loads(v) for k, v in a["metadata"].items()} == {"heading_level": 1, "page_title": "Tides", "html_id": "ebb"}
    assert (b["name"], b["code"]) == ("Flood", "Flood\n\nRises\nh = 1\n\nh = 1")
    assert {k: json.loads(v) for k, v in b["metadata"].items()} == {"heading_level": 2, "page_title": "Tides", "class": "wide", "code_blocks": ["h = 1"]}
    assert html.analyze("/p/x.html", "<p>only</p><script>a<b</script>")[0]["type"] == "file"
    assert html.analyze("/p/x.html", "") == []


@pytest.mark.parametrize(("src", "found"), [
    ("", []),
    ("x = 1\n", [("var", "x", 1, 1)]),
    ("async def go(a, /, b, *, c=1): ...\n", [("function", "go", 1, 1)]),
    ("@a\n@b(1,\n   2)\ndef f():\n    def inner(): pass\n    return inner\n", [("function", "f", 4, 6)]),
    ("class A:\n    class B:\n        def m(self): pass\n", [("class", "A", 1, 3)]),
    ("class P(Protocol):\n    def m(self) -> int: ...\n", [("class", "P", 1, 2), ("method", "m", 2, 2)]),
    ("if True:\n    def f(): pass\n", []),
    ("class A:\n    @property\n    def v(self): return 1\n    @staticmethod\n    def s(): pass\n", [("class", "A", 1, 5), ("method", "s", 5, 5), ("property", "v", 3, 3)]),
    ("LIMIT = (1,\n  2)\n", [("const", "LIMIT", 1, 1)]),
    ("def f(x: dict[str, list[int]]) -> 'T':\n    yield x\n\n\ndef g(): return 1\n", [("function", "f", 1, 2), ("function", "g", 5, 5)]),
])
def test_shapes_of_python(src, found):
    got = sorted((c["type"], c["name"], c["start_line"], c["end_line"]) for c in python.analyze("/a/m.py", src))
    assert [x for x in got if x[0] != "module"] == found


@pytest.mark.parametrize(("src", "uris"), [
    ("Route::get('a', 'C@a');", ["a"]),
    ("Route::prefix('api')->group(function () { Route::get('a', 'C@a'); });", ["/api/a"]),
    ("Route::middleware('x')->prefix('/api/')->group(function () { Route::get('/a', 'C@a'); }); Route::get('/b', 'C@b');", ["/api/a", "/b"]),
    ("Route::group(['middleware' => 'x', 'prefix' => 'v1'], function () { Route::prefix('in')->group(fn () => Route::post('a', 'C@a')); });", ["/v1/in/a"]),
    ("Route::group(['middleware' => 'x'], function () { Route::resource('p', P::class); });", ["/p", "/p/create", "/p", "/p/{id}", "/p/{id}/edit", "/p/{id}", "/p/{id}"]),
    ("Route::prefix('api')->group(function () { Route::get('/', 'C@a'); });", ["/api"]),
])
def test_route_groups(src, uris):
    got = [json.loads(c["metadata"]["route"])["uri"] for c in php.analyze("/r.php", "<?php\n" + src) if c["type"] == "route"]
    assert got == uris
