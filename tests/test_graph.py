import random

from orbweft.operators import graph, louvain, relational
from orbweft.operators.retrieval import phrases, query_terms


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scc_against_reachability(spark):
    rng = random.Random(3)
    nodes = list(range(14))
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    reach = {(a, b) for a, b in edges}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    want = {a: min(b for b in nodes if (a, b) in reach and (b, a) in reach) for a in nodes if any((a, b) in reach and (b, a) in reach and a != b for b in nodes)}
    got = graph.scc(frame(spark, [(f"{a:02}", f"{b:02}") for a, b in sorted(edges)], "src string, dst string"))
    assert {int(r.id): int(r.component) for r in got.collect()} == want


def test_pagerank_sums_to_one_and_stops(spark):
    n = frame(spark, [("a",), ("b",), ("c",)], "id string")
    e = frame(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("a", "b", 1.0)], "src string, dst string, weight double")
    ranks = {r.id: r.rank for r in graph.pagerank(n, e).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and abs(ranks["a"] - ranks["b"]) < 1e-6 and ranks["c"] < ranks["a"]


def test_empty_graph(spark):
    n = frame(spark, [], "id string")
    e = frame(spark, [], "src string, dst string, weight double")
    assert graph.pagerank(n, e).count() == 0
    assert graph.scc(e).count() == 0


def test_louvain_finds_two_cliques_whatever_the_order():
    edges = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.1)]
    want = louvain.communities(edges)
    random.Random(1).shuffle(edges)
    assert louvain.communities(edges) == want
    assert len({want[x] for x in "abcd"}) == 1 and len(set(want.values())) == 2


def test_inherit_docs_takes_the_nearest(spark):
    members = frame(spark, [("C.f", "C", "f", None, 0), ("B.f", "B", "f", "near", 0), ("A.f", "A", "f", "far", 0), ("C.g", "C", "g", "own", 1)], "id string, parent string, name string, doc string, ordinal int")
    supers = frame(spark, [("C", "B"), ("B", "A"), ("A", "C")], "child string, parent string")
    got = {r.id: (r.doc, r.doc_from) for r in graph.inherit_docs(members, supers).collect()}
    assert got == {"C.f": ("near", "B.f")}


def test_sessions_end_after_a_gap_or_the_cap(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(400)) for i in range(300)] + [("c", 900, None)]
    e = spark.createDataFrame(rows, "user_id string, event_id long, s int").selectExpr("*", "timestamp_micros(s * 1000000L) AS ts")
    got = relational.sessions(e, "user_id", "ts", "event_id", gap_us=3_000_000, most_us=9_000_000)
    want = set()
    for k in ("a", "b", None):
        number, burst = 0, None
        for t in sorted(s for u, _, s in rows if u == k):
            if burst is None or t - burst[1] > 3 or t - burst[0] > 9:
                want |= {(k, number, *burst)} if burst else set()
                number, burst = number + 1, (t, t, 0)
            burst = (burst[0], t, burst[2] + 1)
        want.add((k, number, *burst))
    assert {(r.user_id, r.session, r.start_us // 10**6, r.end_us // 10**6, r.n) for r in got.collect()} == want
    assert relational.sessions(e.limit(0), "user_id", "ts", "event_id", gap_us=1, most_us=1).count() == 0

def test_query_terms():
    assert query_terms("How does the parser handle imported modules?") == ["parser", "imported", "modules", "pars", "import", "modul"]
    assert query_terms("getUserName parse-tree v2") == ["user", "name", "parse", "tree", "v2"]
    assert phrases(["ab", "abc"]) == [("ab", False), ("abc", False), ("abc", True)]
