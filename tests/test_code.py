import pytest
from pyspark.sql import functions as F

from orbweft.operators import resolve
from orbweft.sources import ir, scan
from orbweft.sources.extract import extract, extracted, language_of

REPO = {
    "app/models.py": '''"""Models."""
from enum import Enum
from typing import Protocol


class Color(Enum):
    RED = 1


class Store(Protocol):
    def save(self, item: "Item") -> None:
        """Keep an item."""


class Base:
    def touch(self):
        """Mark as used."""


class Item(Base):
    LIMIT = 3

    def __init__(self, name: str):
        self.name = name

    @property
    def label(self):
        return self.name

    def refresh(self):
        self.touch()
        return self.label
''',
    "app/service.py": '''import os
from app.models import Item, Color as C
from . import helpers

TIMEOUT = os.environ["APP_TIMEOUT"]


def build_item(name):
    item = Item(name)
    item.refresh()
    helpers.normalise_name(name)
    return register_all(build_item)


def register_all(callback):
    return callback
''',
    "app/helpers.py": "def normalise_name(x):\n    return x.strip()\n",
    "app/web.py": "from app.service import build_item\n\n@app.get('/items')\ndef list_items():\n    return build_item('x')\n",
    "tests/test_service.py": "from app.service import build_item\n\ndef test_build():\n    assert build_item('a')\n",
    "docs/guide.md": "# Guide\n\nUse `build_item`.\n\n## More\n\nSee [models](../app/models.py).\n\n```py\n# not a heading\n```\n",
    "db/schema.sql": "-- All users.\nCREATE TABLE users (\n  id INT PRIMARY KEY,\n  name TEXT NOT NULL, -- a; b\n  team_id INT REFERENCES teams(id)\n);\nCREATE TYPE mood AS ENUM ('sad', 'ok');\nCREATE VIEW active AS SELECT * FROM users;\nCOMMENT ON TABLE users IS 'People; it''s them';\nALTER TABLE users ADD COLUMN age INT;\n",
    "web/util.ts": "// Adds.\nexport function addAll(a: number, b: number) { return a + b; }\nexport class Cart extends Basket {\n  total() { return addAll(1, 2); }\n}\nconst key = process.env.API_KEY;\n",
    "web/main.ts": "import { addAll, Cart } from './util';\nexport const boot = () => { const c = new Cart(); addAll(1, 2); c.total(); };\n",
    "go/main.go": 'package main\n\nimport (\n\t"os"\n)\n\n// Serve runs.\nfunc Serve() { helper(); os.Getenv("PORT") }\n\nfunc helper() {}\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Open() { helper() }\n',
    "src/lib.rs": "pub struct Node { pub n: i32 }\nimpl Node {\n    pub fn grow(&self) { helper_fn(); }\n}\nfn helper_fn() {}\n",
    "Makefile": "include common.mk\nCC = gcc\n# Build it.\nbuild: deps\n\t$(CC) main.c\ndeps:\n\ttrue\n",
    ".github/workflows/ci.yml": "on: push\njobs:\n  lint:\n    runs-on: x\n  test:\n    needs: lint\n    env:\n      T: ${{ secrets.TOKEN }}\n",
    "bin/x.dat": "zzz",
}


def kinds(record):
    return {(d["kind"], d["fqn"]) for d in record["definitions"]}


def test_python():
    r = extract("app/models.py", REPO["app/models.py"])
    assert r["doc"] == "Models." and {("enum", "Color"), ("enum_member", "Color.RED"), ("interface", "Store"), ("constructor", "Item.__init__"), ("property", "Item.label"), ("method", "Item.refresh")} <= kinds(r)
    assert {"scope": "Store.save", "name": "item", "type": "Item", "via": "annotation"} in r["local_types"]
    s = extract("app/service.py", REPO["app/service.py"])
    assert any(x["kind"] == "config" and x["name"] == "APP_TIMEOUT" for x in s["refs"])
    assert any(x["kind"] == "value" and x["name"] == "build_item" for x in s["refs"])
    assert extract("a.py", "def (")["error_pct"] == 100


def test_sql():
    r = extract("db/schema.sql", REPO["db/schema.sql"])
    assert {("struct", "users"), ("field", "users.id"), ("field", "users.name"), ("field", "users.team_id"), ("field", "users.age"), ("enum", "mood"), ("enum_member", "mood.sad"), ("struct", "active")} <= kinds(r)
    users = next(d for d in r["definitions"] if d["fqn"] == "users")
    assert users["doc"] == "People; it's them"
    assert {"teams", "users"} <= {x["name"] for x in r["refs"]}


def test_markdown_make_yaml():
    r = extract("docs/guide.md", REPO["docs/guide.md"])
    assert kinds(r) == {("section", "Guide"), ("section", "Guide.More")}
    assert [i["source"] for i in r["imports"]] == ["../app/models.py"] and r["refs"][0]["name"] == "build_item"
    m = extract("Makefile", REPO["Makefile"])
    assert {("function", "build"), ("function", "deps"), ("variable", "CC")} == kinds(m) and m["imports"][0]["source"] == "common.mk"
    y = extract("ci.yml", REPO[".github/workflows/ci.yml"])
    assert kinds(y) == {("function", "lint"), ("function", "test")} and {x["name"] for x in y["refs"]} == {"lint", "TOKEN"}


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("web/util.ts", REPO["web/util.ts"], {("function", "addAll"), ("class", "Cart"), ("method", "Cart.total")}),
        ("go/main.go", REPO["go/main.go"], {("function", "Serve"), ("struct", "Box"), ("method", "Box.Open")}),
        ("src/lib.rs", REPO["src/lib.rs"], {("struct", "Node"), ("method", "Node.grow"), ("function", "helper_fn")}),
        ("A.java", "package a;\npublic class A extends B {\n  public int f(int x) { return x; }\n}\n", {("class", "A"), ("method", "A.f")}),
        ("a.kt", "class K : Base() {\n  fun go() {}\n}\nfun top() = 1\n", {("class", "K"), ("method", "K.go"), ("function", "top")}),
        ("a.rb", "class Dog < Animal\n  def bark\n    1\n  end\nend\n", {("class", "Dog"), ("method", "Dog.bark")}),
        ("a.php", "<?php\nclass P {\n  public function run() { return 1; }\n}\n", {("class", "P"), ("method", "P.run")}),
        ("a.cs", "namespace N {\n class C {\n  public void M() { }\n }\n}\n", {("class", "N.C"), ("method", "N.C.M")}),
        ("a.c", "#include \"b.h\"\nstatic int add(int a, int b) {\n  return a;\n}\n", {("function", "add")}),
        ("a.swift", "struct S {\n  func go() {}\n}\n", {("struct", "S"), ("method", "S.go")}),
        ("a.lua", "local function f(x)\n  return x\nend\n", {("function", "f")}),
        ("a.sh", "deploy() {\n  echo hi\n}\n", {("function", "deploy")}),
        ("a.ex", "defmodule M do\n  def go(x) do\n    x\n  end\nend\n", {("namespace", "M"), ("function", "M.go")}),
        ("a.sol", "contract T is Base {\n  function pay() public { }\n}\n", {("class", "T"), ("method", "T.pay")}),
        ("a.scala", "object O {\n  def f(x: Int): Int = { x }\n}\n", {("class", "O"), ("method", "O.f")}),
        ("a.dart", "class D {\n  void go() { }\n}\n", {("class", "D"), ("method", "D.go")}),
        ("a.ps1", "function Get-Thing {\n  1\n}\n", {("function", "Get-Thing")}),
        ("a.vue", "<template><Child/></template>\n<script>\nfunction f() { }\n</script>\n", {("class", "a")}),
    ],
)
def test_lexical_languages(path, text, want):
    r = extract(path, text)
    assert want <= kinds(r), kinds(r)
    assert r["error_pct"] >= 1


def test_language_names():
    assert [language_of(p) for p in ("a.py", "GNUmakefile", "x.tsx", "noext", "a.unknown")] == ["python", "make", "tsx", None, None]
    assert language_of("a.h", "@interface A") == "objc" and language_of("a.h") == "c"


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame(list(REPO.items()), "path string, text string")
    records = extracted(files).cache()
    symbols, refs, local = ir.symbols(records).cache(), ir.references(records), ir.local_types(records)
    imports = resolve.import_targets(ir.imports(records), records.select("path")).cache()
    supers, _ = resolve.resolve(refs.where("kind IN ('extends', 'implements')"), symbols, imports, local)
    edges, unresolved = resolve.resolve(refs, symbols, imports, local, supers.cache())
    return symbols, imports, {(r.src, r.dst, r.kind): (r.resolver, r.confidence) for r in edges.collect()}, unresolved


def test_edges(graph):
    _, imports, edges, _ = graph
    assert edges["app/service.py::build_item", "app/models.py::Item", "calls"] == ("import", 1.0)
    assert edges["app/service.py::build_item", "app/models.py::Item.refresh", "calls"] == ("receiver", 0.9)
    assert edges["app/service.py::build_item", "app/helpers.py::normalise_name", "calls"][0] in ("import", "heuristic")
    assert edges["app/service.py::build_item", "app/service.py::register_all", "calls"] == ("scope", 1.0)
    assert edges["app/models.py::Item.refresh", "app/models.py::Base.touch", "calls"] == ("receiver", 1.0)
    assert edges["app/models.py::Item", "app/models.py::Base", "extends"] == ("scope", 1.0)
    assert ("app/service.py", "env::APP_TIMEOUT", "reads_config") in edges
    assert ("tests/test_service.py::test_build", "app/service.py::build_item", "tests") in edges
    assert edges["docs/guide.md::Guide", "app/service.py::build_item", "references"] == ("unique", 0.7)
    assert ("app/web.py::GET /items", "app/web.py::list_items", "defines_route") in edges
    assert ("web/main.ts::boot", "web/util.ts::addAll", "calls") in edges
    assert ("go/main.go::Serve", "go/main.go::helper", "calls") in edges
    assert not any(s == d for s, d, _ in edges)
    got = {(r.file, r.source): r.resolved for r in imports.collect()}
    assert got["docs/guide.md", "../app/models.py"] == "app/models.py" and got["web/main.ts", "./util"] == "web/util.ts" and got["app/service.py", "os"] is None


def test_symbols_are_unique(spark):
    files = spark.createDataFrame([("a.py", "def f(): pass\ndef f(): pass\n")], "path string, text string")
    assert sorted(r.id for r in ir.symbols(extracted(files)).collect()) == ["a.py", "a.py::f", "a.py::f#2"]


def test_ignore_rules(spark):
    rules = [("", "*.log"), ("", "/build/"), ("", "docs/**/tmp"), ("", "!keep.log"), ("sub", "secret*")]
    paths = {"a.log": True, "x/a.log": True, "keep.log": False, "build/a": True, "x/build/a": False, "docs/a/b/tmp": True, "sub/secret.txt": True, "secret.txt": False, "a.py": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.i for r in df.select("path", scan.ignored(F.col("path"), rules).alias("i")).collect()} == paths


def test_scan_and_diff(spark, tmp_path):
    for p, t in REPO.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / ".gitignore").write_text("*.dat\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("1")
    (tmp_path / "empty.py").write_text("")
    got = {r.path for r in scan.scan(spark, str(tmp_path)).select("path").collect()}
    assert got == (set(REPO) - {"bin/x.dat"}) | {".gitignore"}
    diff = ["--- a/app/models.py", "+++ b/app/models.py", "@@ -28,0 +29,2 @@", "+x", "@@ -1 +1 @@", "--- a/b", "+++ /dev/null", "@@ -1,3 +0,0 @@"]
    ranges = scan.diff_ranges(spark.createDataFrame(list(enumerate(diff)), "pos int, line string"))
    assert sorted((r.file, r.start, r.end) for r in ranges.collect()) == [("app/models.py", 1, 1), ("app/models.py", 29, 30)]
    symbols = ir.symbols(extracted(scan.scan(spark, str(tmp_path))))
    assert {r.id for r in scan.changed_symbols(ranges, symbols).collect()} == {"app/models.py", "app/models.py::Item.refresh"}


def edges_of(spark, files):
    records = extracted(spark.createDataFrame(list(files.items()), "path string, text string")).cache()
    imports = resolve.import_targets(ir.imports(records), records.select("path"))
    edges, unresolved = resolve.resolve(ir.references(records), ir.symbols(records), imports, ir.local_types(records))
    return {(r.src, r.dst, r.kind): (r.resolver, r.confidence) for r in edges.collect()}, {(r.scope, r.name) for r in unresolved.collect()}


def test_bare_names_mean_members(spark):
    files = {
        "A.java": "class Base {\n  void helper() { }\n}\nclass A extends Base {\n  void run() {\n    helper();\n  }\n}\n",
        "b.rb": "class Dog\n  def bark\n    sound(1)\n  end\n  def sound(x)\n    x\n  end\nend\n",
        "c.py": "class P:\n    def run(self):\n        helper_py()\n    def helper_py(self):\n        pass\n",
    }
    edges, _ = edges_of(spark, files)
    assert edges["A.java::A.run", "A.java::Base.helper", "calls"] == ("receiver", 0.95)
    assert edges["b.rb::Dog.bark", "b.rb::Dog.sound", "calls"] == ("receiver", 0.95)
    assert ("c.py::P.run", "c.py::P.helper_py", "calls") not in edges or edges["c.py::P.run", "c.py::P.helper_py", "calls"][1] < 0.95


def test_names_are_followed_through_files_and_stop_outside(spark):
    files = {
        "pkg/deep.py": "def worker_main():\n    pass\n",
        "pkg/mid.py": "from pkg.deep import worker_main as middle\n",
        "pkg/__init__.py": "from pkg.mid import *\n",
        "use.py": "from pkg import middle\nfrom requests import fetch_all\n\ndef go():\n    middle()\n    fetch_all()\n",
        "other.py": "def fetch_all():\n    pass\n",
    }
    edges, unresolved = edges_of(spark, files)
    assert edges["use.py::go", "pkg/deep.py::worker_main", "calls"] == ("import", 1.0)
    assert ("use.py::go", "other.py::fetch_all", "calls") not in edges and ("use.py::go", "fetch_all") not in unresolved


def test_inherited_members_bind_without_given_supers(spark):
    edges, _ = edges_of(spark, {"m.py": "class A:\n    def touch(self):\n        pass\n\nclass B(A):\n    def go(self):\n        self.touch()\n"})
    assert edges["m.py::B.go", "m.py::A.touch", "calls"] == ("receiver", 1.0)


def test_deep_scopes(spark):
    text = "".join("    " * k + f"def f{k}():\n" for k in range(14)) + "    " * 14 + "f0()\n"
    edges, _ = edges_of(spark, {"d.py": text})
    inner = "d.py::" + ".".join(f"f{k}" for k in range(14))
    assert edges[inner, "d.py::f0", "calls"] == ("scope", 1.0)


def test_lexical_extraction_is_linear():
    import time

    body = "".join(f"class C{i} {{\n  m{i}(x) {{\n    return helper{i}(x, new D{i}());\n  }}\n}}\nfunction g{i}() {{ return C{i}.m{i}(1); }}\n" for i in range(12_000))
    began = time.time()
    r = extract("big.ts", body)
    assert len(body) > 1_200_000 and len(r["definitions"]) > 30_000 and time.time() - began < 60
    scopes = {x["name"]: x["scope"] for x in r["refs"] if x["name"].startswith("helper")}
    assert scopes["helper11999"].endswith("C11999.m11999")


@pytest.mark.parametrize(("name", "made"), [("index-DrLLgu_7.js", True), ("main.a1b2c3d4.js", True), ("app-settings.js", False), ("chunk-XYZ.js", True), ("a.min.css", True), ("m.g.dart", True), ("F.designer.cs", True), ("lib/generated/a.py", True), ("gen/a.py", False), ("vendor-x.ts", False)])
def test_generated_names(spark, name, made):
    from orbweft.functions import text as fn

    assert spark.createDataFrame([(name,)], "p string").select(fn.generated_name(F.col("p"))).first()[0] is made


def test_scan_keeps_to_the_repository(spark, tmp_path):
    (tmp_path / "out.py").write_text("x = 1\n")
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    for name in ("a.py", "b.min.js", "yarn.lock", "main.a1b2c3d4.js", "keep.a1b2c3d4.js", "t.d.ts"):
        (root / "src" / name).write_text("1\n")
    (root / ".gitignore").write_text("!src/keep.a1b2c3d4.js\n")
    (root / "src" / "leak.py").symlink_to(tmp_path / "out.py")
    (root / "src" / "same.py").symlink_to(root / "src" / "a.py")
    got = {r.path for r in scan.scan(spark, str(root)).collect()}
    assert got == {".gitignore", "src/a.py", "src/same.py", "src/keep.a1b2c3d4.js"}


def test_manifests_lead_imports(spark):
    from orbweft.sources import manifest

    files = {
        "tsconfig.json": '{ // root\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lib/*"],}, /* x */ } }',
        "apps/web/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./src/*"], "~one": ["./src/one.ts"]}}}',
        "packages/ui/package.json": '{"name": "@shop/ui", "version": "1.0.0"}',
        "packages/ui/src/index.ts": "export function paint() { }\n",
        "packages/ui/src/theme.ts": "export const dark = 1;\n",
        "lib/util.ts": "export function rooted() { }\n",
        "apps/web/src/util.ts": "export function nested() { }\n",
        "apps/web/src/one.ts": "export function single() { }\n",
        "apps/web/main.ts": "import { nested } from '@/util';\nimport { paint } from '@shop/ui';\nimport { dark } from '@shop/ui/src/theme';\nimport { single } from '~one';\nimport fs from 'fs';\n",
        "tools/t.ts": "import { rooted } from '@/util';\n",
        "svc/go.mod": "module example.org/svc\n\ngo 1.22\n",
        "svc/store/b.go": "package store\n\nfunc Save() {}\n",
        "svc/store/a.go": "package store\n\nfunc Load() {}\n",
        "svc/main.go": 'package main\n\nimport (\n\t"example.org/svc/store"\n\t"fmt"\n)\n',
        "bad/package.json": "{nonsense",
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    records = extracted(df)
    got = {(r.file, r.source): r.resolved for r in resolve.import_targets(ir.imports(records), records.select("path"), manifest.read(df)).collect()}
    assert got["apps/web/main.ts", "@/util"] == "apps/web/src/util.ts" and got["tools/t.ts", "@/util"] == "lib/util.ts"
    assert got["apps/web/main.ts", "@shop/ui"] == "packages/ui/src/index.ts" and got["apps/web/main.ts", "@shop/ui/src/theme"] == "packages/ui/src/theme.ts"
    assert got["apps/web/main.ts", "~one"] == "apps/web/src/one.ts" and got["apps/web/main.ts", "fs"] is None
    assert got["svc/main.go", "example.org/svc/store"] == "svc/store/a.go" and got["svc/main.go", "fmt"] is None
    assert manifest.facts("composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/"}}}') == [("php", "", "App", "src")]
