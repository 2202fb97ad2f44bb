import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweft.functions import text as fn
from orbweft.operators import embed, graph, search
from orbweft.operators.retrieval import phrases
from orbweft.plans.queries import part_symbols

SCHEMA = "id string, kind string, name string, fqn string, signature string, doc string, file string, is_test boolean, exported boolean, reopened boolean, inherited boolean, parent string"


def sym(name, kind="function", fqn=None, doc="", file="src/a.py", test=False, reopened=False, inherited=False, signature=None):
    fqn = fqn or name
    return (f"{file}::{fqn}", kind, name, fqn, signature or f"def {name}()", doc, file, test, True, reopened, inherited, None)


def plain(rows, metrics, question, limit=20):
    """The ranking once more, symbol by symbol."""
    q = search.asked(question)
    split = lambda n: re.sub(r"[^A-Za-z0-9]+", " ", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", n))).lower().strip()
    token = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    fields = [{"name": r[2], "split_name": split(r[2]), "fqn": r[3], "signature": r[4], "doc": r[5], "file": r[6]} for r in rows]
    sizes = [sum(len(token(v)) for v in f.values()) for f in fields]
    words = list(dict.fromkeys([*q.terms, *(i.lower() for i in q.idents if "." not in i)]))
    bm = [0.0] * len(rows)
    hit = [False] * len(rows)
    for term, prefix in phrases(words):
        f = [sum(search.FIELDS[k] * sum(t.startswith(term) if prefix else t == term for t in token(v)) for k, v in x.items()) for x in fields]
        n = sum(v > 0 for v in f)
        idf = max(math.log((len(rows) - n + 0.5) / (n + 0.5)), 1e-6) if n < len(rows) + 0.5 else 1e-6
        for i, v in enumerate(f):
            if v > 0:
                hit[i] = True
                bm[i] += idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * sizes[i] / (sum(sizes) / len(sizes))))
    top = sorted((i for i in range(len(rows)) if hit[i]), key=lambda i: (-bm[i], rows[i][0]))[: max(60, 6 * limit)]
    out = []
    for i, r in enumerate(rows):
        bonus, named = 0.0, False
        for ident in q.idents:
            last = ident.rsplit(".", 1)[-1]
            match = (lambda x: x[3] == ident or x[3].endswith("." + ident)) if "." in ident else (lambda x: x[2].lower() == last.lower())  # noqa: B023
            n = sum(map(match, rows))
            coded = search.code_shaped(ident) or ident.lower() in q.quoted
            if match(r) and n <= 200 and (coded or len(q.terms) <= 2):
                named = True
                bonus += (22 if r[2] == last or r[3] == ident else 10) / (1 + math.log2(n)) * (1 if coded else 0.35)
        if not named and i not in top:
            continue
        s = bonus + (min(10, bm[i]) * (0.85 if r[10] else 1) if i in top else 0)
        name = f"{r[2]} {split(r[2])}".lower()
        full = f"{name} {r[3]} {r[4]}".lower()
        if q.terms:
            idf = {t: max(0.15, math.log((len(rows) + 1) / (sum(any(w.startswith(t) for w in token(f"{x[2]} {split(x[2])}")) for x in rows) + 1))) for t in q.terms}
            total = sum(idf.values())
            s += sum(w for t, w in idf.items() if t in full) / total * 3 + sum(w for t, w in idf.items() if t in name) / total * 3.5
            if len(q.terms) >= 2 and all(t in name for t in q.terms):
                s += 2
        s *= (0.35 if r[7] or r[1] == "test" else 1) * search.KINDS.get(r[1], 1) * (search.ASKED.get(r[1], 1) if q.behavioural else 1)
        s *= (0.5 if r[9] else 1) * (0.6 if re.search(r"(^|/)(docs|examples)/", r[6]) else 1)
        pr, callers = metrics.get(r[0], (0, 0))
        out.append([s + math.log1p(pr) * 0.8 + math.log1p(callers) * 0.3 + (0.3 if r[5] else 0), r])
    seen = {}
    for x in sorted(out, key=lambda x: (-x[0], x[1][0])):
        k = seen.get(x[1][3], 0)
        seen[x[1][3]] = k + 1
        x[0] *= (0.5 if x[1][9] or x[1][1] in search.REDUNDANT else 0.92) ** min(k, 6)
    return [(x[1][0], x[0]) for x in sorted(out, key=lambda x: (-x[0], x[1][3], x[1][0]))[:limit]]


@pytest.mark.parametrize("question", ["loadConfig", "how does the parser load a config file", "`run` things", "Store.save", "parse", "where are tokens counted and stored", "Bytes"])
def test_search_is_the_plain_ranking(spark, question):
    rng = random.Random(4)
    words = ["load", "config", "parse", "token", "store", "save", "run", "count"]
    rows = [sym("loadConfig", doc="loads the config file"), sym("load_config", "test", file="tests/t.py", test=True), sym("run"), sym("Run", "class", file="docs/x.py"), sym("save", "method", "Store.save"), sym("Store", "class"), sym("Bytes", "struct")]
    rows += [sym("Bytes", "class", f"Bytes{i % 3}", file=f"src/b{i}.rs", reopened=True) for i in range(6)] + [sym("parser", "module", file="examples/p.py"), sym("token_count", doc="inherited words on tokens", inherited=True)]
    rows += [sym("".join(w.title() for w in rng.sample(words, 2)), rng.choice(["function", "property", "class"]), f"m{i}.x{i}", rng.choice(["", "parses tokens"]), f"src/f{i}.py") for i in range(40)]
    metrics = {r[0]: (rng.random() * 5, rng.randrange(9)) for r in rows if rng.random() < 0.6}
    s = spark.createDataFrame(rows, SCHEMA)
    m = spark.createDataFrame([(k, a, b) for k, (a, b) in metrics.items()], "id string, pagerank double, callers long")
    got = [(r.id, r.score) for r in search.search(s, m, question, limit=12).orderBy(F.desc("score"), "id").collect()]
    want = plain(rows, metrics, question, 12)
    assert np.allclose([x for _, x in got], [x for _, x in want]) and {i for i, _ in got} == {i for i, _ in want}


def test_search_options_and_nothing(spark, sf):
    s, m = part_symbols(spark, sf)
    assert search.search(s, m, "").count() == 0
    assert {r.kind for r in search.search(s, m, "small ring", kinds=["class"]).join(s, "id").collect()} == {"class"}
    assert all(r.file.startswith("docs/") for r in search.search(s, m, "small ring", path="docs/").join(s, "id").collect())


def test_find_symbol_stages(spark):
    rows = [sym("save", "method", "Store.save"), sym("save", "method", "Other.save", file="tests/t.py", test=True), sym("Save", "class", file="lib/b.py"), sym("store", "module")]
    s = spark.createDataFrame(rows, SCHEMA)
    m = spark.createDataFrame([(rows[0][0], 2.0, 1)], "id string, pagerank double, callers long")
    ids = lambda t: [r.id for r in search.find_symbols(s, m, t).orderBy("place").collect()]
    assert ids("save") == [rows[0][0], rows[1][0]] and ids(rows[2][0]) == [rows[2][0]] and ids("lib/b.py:Save") == [rows[2][0]]
    assert ids("Other.save") == [rows[1][0]] and ids("SAVE")[0] == rows[2][0] and ids("nothing at all") == []
    assert [r.name for r in search.near_names(s, "sav").collect()] == ["Save", "save", "save"]


def test_relations_and_edges_among(spark):
    e = spark.createDataFrame([("a", "b", "calls", 3, 0.5), ("a", "b", "calls", 1, 1.0), ("c", "b", "calls", 2, None), ("b", "d", "imports", 9, 1.0), ("a", "a", "calls", 1, 1.0)], "src string, dst string, kind string, line int, confidence double")
    s = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, fqn string")
    got = {(r.way, r.kind, r.other, r.line) for r in search.relations(e, s, ["b"]).collect()}
    assert got == {("in", "calls", "a", 1), ("in", "calls", "c", 2), ("out", "imports", "d", 9)}
    assert {tuple(r) for r in search.edges_among(e, ["a", "b"]).collect()} == {("a", "b", "calls", 1)}


@pytest.mark.parametrize(("path", "aside"), [("docs/x.md", True), ("src/a.py", False), ("app/My Demo/x.swift", True), ("src/main/java/com/example/A.java", False), ("src/main/java/example/A.java", False), ("examples/a.py", True), ("org/example/B.kt", False), ("x/sample-app/b.kt", True), ("db/migrate/1.rb", True), ("a.migration.sql", True), ("example.py", False), ("windows/runner/m.cpp", True), ("android/x.kt", False)])
def test_peripheral(spark, path, aside):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(fn.peripheral(F.col("p"))).first()[0] is aside
    assert df.select(fn.peripheral(F.col("p"), True)).first()[0] is (aside or path.startswith("android/"))


def test_questions_and_lines(spark):
    assert search.is_question("how does it work", 3) and not search.is_question("how so", 2) and not search.is_question("parse the file", 3)
    row = spark.sql("SELECT 'class' AS k, 'A' AS f, 'a.py' AS p, 1 AS s, 9 AS e, 'class A(B)' AS g")
    assert row.select(fn.fmt_symbol(*[F.col(c) for c in "kfpseg"])).first()[0] == "class A (a.py:1-9)  class A(B)"


def test_route(spark):
    nodes = spark.createDataFrame([(x, "module" if x == "m" else "test" if x == "t" else "function", x == "t") for x in "abcdmhtz"], "id string, kind string, is_test boolean")
    edges = [("m", "a", "contains"), ("m", "d", "contains"), ("a", "h", "calls"), ("d", "h", "calls"), ("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("z", "t", "calls")]
    edges += [(f"x{i}", "h", "calls") for i in range(60)]
    e = spark.createDataFrame([(*x, 1) for x in edges], "src string, dst string, kind string, line int")
    ids = lambda r: r and [x["id"] for x in r]
    assert ids(graph.route(nodes, e, "a", "d")) == ["a", "b", "c", "d"]  # not through the helper or the module
    back = graph.route(nodes, e, "d", "a")
    assert ids(back) == ["d", "c", "b", "a"] and all(x["reversed"] for x in back[1:]) and graph.route(nodes, e, "d", "a", directed=True) is None
    assert ids(graph.route(nodes, e, "z", "t")) == ["z", "t"] and ids(graph.route(nodes, e, "a", "a")) == ["a"]
    assert graph.route(nodes, e, "a", "none") is None and graph.route(nodes, e, "a", "z") is None


def test_vectors(spark):
    rows = [sym("load_config", doc="loads the config"), sym("save_file", doc="writes a file"), sym("x", "field"), sym("mod", "module", doc="about")]
    s = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "id string, file string, text_hash string, vec array<float>")
    first = embed.refreshed(s, none)
    got = {r.id: r.vec for r in first.collect()}
    assert set(got) == {rows[0][0], rows[1][0], rows[3][0]} and all(abs(np.linalg.norm(v) - 1) < 1e-5 and len(v) == embed.DIM for v in got.values())
    changed = spark.createDataFrame([rows[0], sym("save_file", doc="another doc")], SCHEMA)
    assert [r.id for r in embed.pending(changed, first).collect()] == [rows[1][0]]
    assert {r.id for r in embed.refreshed(changed, first).collect()} == {rows[0][0], rows[1][0]}
    assert embed.pending(s, first, "other").count() == 3
    assert embed.semantic_search(first, "load the configuration", floor=-1).orderBy("rank").first().id == rows[0][0]
    m = spark.createDataFrame([], "id string, pagerank double, callers long")
    assert embed.hybrid(s, m, first, "load config").first().id == rows[0][0] == embed.hybrid(s, m, none, "load config").first().id
    v = [0.25, -1.5, 3.75, 1e-7]
    df = spark.createDataFrame([(v,), ([0.0, 0.0],), (None,)], "v array<float>").select("v", embed.encoded("v").alias("b"), embed.normalised(F.col("v")).alias("n"))
    a, b, c = df.select("v", "b", "n", embed.decoded("b").alias("d")).collect()
    assert len(a.b) == 16 and a.b[:4] == bytes([0, 0, 0x80, 0x3E]) and a.d == a.v and abs(np.linalg.norm(a.n) - 1) < 1e-6 and b.n == [0, 0] and c.b is None
