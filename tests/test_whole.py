"""Queries over whole tables, against plain statements that leave nothing out."""

import random

import duckdb

from orbweft.operators import graph, louvain, relational
from orbweft.plans.queries import QUERIES


def plain(sf, sql):
    con = duckdb.connect()
    for t in "customer lineitem nation orders part supplier".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).fetchall()


def test_innermost_by_brute_force(spark):
    rng = random.Random(5)
    points = [(i, a, a + rng.randrange(4)) for i in range(60) for a in [rng.randrange(100)]]
    ranges = [(i, a, a + rng.randrange(1, 9)) for i in range(80) for a in [rng.randrange(-5, 95)]]
    ranges += [(i + 100, a, b) for i, a, b in ranges[:20]]
    want = {}
    for k, f, t in points:
        if over := [(e - s, r) for r, s, e in ranges if s <= t and e >= f]:
            want[k] = min(over)[1]
    p = spark.createDataFrame(points, "point_id long, from_ long, to_ long")
    r = spark.createDataFrame(ranges, "range_id long, start long, end long")
    assert {x.point_id: x.range_id for x in relational.innermost(p, r, width=8).collect()} == want


def test_innermost_looks_at_every_order(spark, sf):
    got = {(r.point_id, r.range_id) for r in QUERIES["range_overlap_innermost"](spark, sf).collect()}
    want = plain(sf, """WITH r AS (SELECT o_orderkey AS range_id, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 30 AS e FROM orders),
    p AS (SELECT c_custkey AS point_id, 10000 + c_custkey % 1000 AS f, 10001 + c_custkey % 1000 AS t FROM customer)
    SELECT point_id, range_id FROM p JOIN r ON s <= t AND e >= f QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY e - s, range_id) = 1""")
    assert got == set(want) and any(r % 4 for _, r in got)


def test_every_lineitem_is_a_site(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["candidate_callers"](spark, sf).select("src", "dst", "line", "confidence").collect())
    want = plain(sf, """WITH c AS (SELECT p_name, list(p_partkey ORDER BY p_partkey)[1:8] AS ids, count(*) AS m FROM part GROUP BY 1),
    s AS (SELECT l_orderkey AS o, l_linenumber AS line, unnest(ids) AS t, greatest(0.1, round(1.0 / len(ids), 2)) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey JOIN c USING (p_name) WHERE m > 1)
    SELECT 'order:' || o, 'part:' || t, line, CAST(confidence AS DOUBLE) FROM s ANTI JOIN lineitem l ON s.o = l.l_orderkey AND s.t = l.l_partkey AND s.line = l.l_linenumber""")
    assert got == sorted(want) and len({line for _, _, line, _ in got}) > 1


TRADE = """SELECT 'nation:' || s_nationkey, 'nation:' || c_nationkey, round(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) / 1e8, 6)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL"""


def walked(nodes, edges, share):
    total, rank = dict.fromkeys(nodes, 0.0), dict(share)
    for a, _, w in edges:
        total[a] += w
    for _ in range(10):
        spare = sum(rank[n] for n in nodes if not total[n])
        after = {n: 0.15 * share[n] + 0.85 * spare * share[n] for n in nodes}
        for a, b, w in edges:
            after[b] += 0.85 * rank[a] * w / total[a]
        rank = after
    return rank


def test_ranks_of_the_whole_trade(spark, sf):
    edges, nodes = plain(sf, TRADE), [f"nation:{k}" for (k,) in plain(sf, "SELECT n_nationkey FROM nation")]
    for name, e, share in (
        ("pagerank_k10", edges, dict.fromkeys(nodes, 1 / len(nodes))),
        ("ppr_k10", edges + [(b, a, 0.7 * w) for a, b, w in edges], {n: float(n == "nation:0") for n in nodes}),
    ):
        want = walked(nodes, e, share)
        got = {r.id: r.rank for r in QUERIES[name](spark, sf).collect()}
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 2e-6 for n in nodes), name


def test_communities_of_the_whole_trade(spark, sf):
    pairs = {}
    for a, b, w in plain(sf, TRADE):
        pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + w
    want = louvain.communities([(a, b, w) for (a, b), w in pairs.items()])
    assert {r.id: r.community for r in QUERIES["louvain_trade"](spark, sf).collect()} == want
    near = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    label = {n: n for n in near}
    for _ in range(10):
        votes = {n: {} for n in near}
        for n in near:
            for m, w in near[n].items():
                votes[n][label[m]] = votes[n].get(label[m], 0) + w
        label = {n: min(v, key=lambda c: (-round(v[c], 9), c)) for n, v in votes.items()}
    assert {r.id: r.community for r in QUERIES["label_propagation_trade"](spark, sf).collect()} == label


def test_ranks_of_the_orders_graph(spark, sf):
    got = {r.id: r.rank for r in QUERIES["pagerank_orders_k10"](spark, sf).collect()}
    n = plain(sf, "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + 5")[0][0]
    assert len(got) == n and abs(sum(got.values()) / n - 1) < 1e-6


def test_every_component_of_many_cycles(spark):
    n = 66
    edges = [(f"{2 * i:04}", f"{2 * i + 1:04}") for i in range(n)] + [(f"{2 * i + 1:04}", f"{2 * i:04}") for i in range(n)]
    edges += [(f"{2 * i:04}", f"{2 * j:04}") for i in range(n) for j in range(i + 1, n)]
    got = {r.id: r.component for r in graph.scc(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"{2 * i + k:04}": f"{2 * i:04}" for i in range(n) for k in (0, 1)}
