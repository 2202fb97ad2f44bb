"""What operators must not make: rows, keys and copies that grow faster than their input or result."""

import random

from orbweft.operators import graph, relational, retrieval
from orbweft.plans.queries import QUERIES


def most_made(spark, run, kinds=("Join", "Cartesian", "Generate")):
    """The most rows that a node of one of the kinds has put out while run() ran, and what run() gave."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out, most = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for i in range(before, runs.size()):
        at = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            for k in range(node.metrics().size() if any(x in node.name() for x in kinds) else 0):
                m = node.metrics().apply(k)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, out


def test_tiers_list_no_pairs_of_bound_refs(spark, tmp_path):
    n = 1200
    rows = [(i, "b", "t", i // 2) for i in range(n)] + [(n, "b", "u", None), (n + 1, None, "t", 0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    most, got = most_made(spark, lambda: {tuple(r)[:3] for r in QUERIES["tier_cascade"](spark, str(tmp_path)).collect()})
    assert got == {(i, i ^ 1, 0) for i in range(n)} | {(n, 0, 2)}
    assert 0 < most < 10 * n  # every part of the type with every other would be n * n


def test_tiers_by_brute_force(spark):
    rng = random.Random(4)
    refs = [(i, rng.choice("abc"), rng.choice([None, *range(12)])) for i in range(60)]
    found = [(t, a, b) for t, a, b in refs if t % 2] * 2
    tops = [(min((t for t, a, _ in refs if a == x), default=None), x) for x in "ab"]
    r = spark.createDataFrame(refs, "ref long, a string, b int")
    t = spark.createDataFrame(found, "target long, a string, b int")
    want = {}
    for x, a, b in refs:
        for k, hits in enumerate(({u for u, c, d in found if b is not None and (a, b) == (c, d) and u != x}, {u for u, c in tops if c == a})):
            if hits:
                want[x] = {(u, k) for u in hits}
                break
    tiers = [(t, ["a", "b"], "near", 1.0, False), (spark.createDataFrame(tops, "target long, a string"), ["a"], "top", 0.5, True)]
    for pairs in (1, 7, 1 << 22):
        rows = relational.cascade(r, tiers, "ref", pairs=pairs).collect()
        assert sorted((x.ref, x.target, x.tier) for x in rows) == sorted((x, *u) for x, us in want.items() for u in us)
    assert relational.cascade(r.limit(0), tiers, "ref").collect() == []


def written(monkeypatch, module):
    """Rows of what the module stores, by name."""
    rows, stored = {}, module.stored

    def noted(df, name, **more):
        out = stored(df, name, **more)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "stored", noted)
    return rows


def test_closure_goes_on_from_parents_alone(spark, monkeypatch):
    rows = written(monkeypatch, graph)
    pairs = [(f"leaf:{i}", f"n:{i % 2}") for i in range(500)] + [("n:0", "root"), ("n:1", "root"), ("root", "n:1"), ("root", None)]
    got = {(r.child, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(pairs, "child string, parent string")).collect()}
    assert len(got) == 500 + 3 + 500 + 250 + 1 and got["leaf:0", "n:1"] == 3 and got["n:0", "n:1"] == 2
    assert rows["up"] == [3]


def test_load_looks_for_unknown_ends(spark, monkeypatch):
    rng = random.Random(6)
    ids = [f"n{i}" for i in range(30)] + [None]
    nodes = [(f"n{i}", rng.choice([None, "n1", "n99", f"n{i}"]), i % 5 == 0) for i in range(20)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "tests"])) for _ in range(200)]
    n = spark.createDataFrame(nodes, "id string, parent string, is_test boolean")
    e = spark.createDataFrame(edges, "src string, dst string, kind string")
    for skip in (False, True):
        own = [x for x in nodes if not (skip and x[2])]
        known = {x[0] for x in own}
        want = sorted((a, b, k) for a, b, k in edges + [(p, i, "contains") for i, p, _ in own] if a != b and a in known and b in known)
        for limit in (graph.FEW, 0):
            monkeypatch.setattr(graph, "FEW", limit)
            rows = written(monkeypatch, graph)
            assert sorted((r.src, r.dst, r.kind) for r in graph.load(n, e, skip_tests=skip).collect()) == want
            assert rows["unknown"] == [len({x for a, b, _ in edges + [(p, i, "") for i, p, _ in own] if a != b and a and b for x in (a, b)} - known)]
            monkeypatch.undo()


def test_ranks_take_as_many_steps_as_the_longest_path(spark, monkeypatch):
    rows = written(monkeypatch, graph)
    nodes = [chr(97 + i) for i in range(7)]
    edges = [("a", "b", 1.0), ("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 2.0), ("e", "d", 0.5)]
    cycle = [("d", "a", 1.0)]
    share = {x: (0.75 if x == "e" else 0.25 if x == "a" else 0.0) for x in nodes}
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    restart = spark.createDataFrame([("a", 0.25), ("e", 0.75)], "id string, share double")
    for rounds in (0, 1, 3, 10):
        for more in ([], cycle):
            e = spark.createDataFrame(edges + more, "src string, dst string, weight double")
            for start, own in ((None, dict.fromkeys(nodes, 1 / 7)), (restart, share)):
                rows.clear()
                got = {r.id: r.rank for r in graph.pagerank(n, e, rounds=rounds, tolerance=None, restart=start).collect()}
                total, want = {}, dict(own)
                for a, _, w in edges + more:
                    total[a] = total.get(a, 0) + w
                for _ in range(rounds):
                    spare = sum(want[x] for x in nodes if x not in total)
                    after = {x: (0.15 + 0.85 * spare) * own[x] for x in nodes}
                    for a, b, w in edges + more:
                        after[b] += 0.85 * want[a] * w / total[a]
                    want = after
                assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in nodes)
                assert more or len(rows.get("term", [])) <= 4  # a b c d, and one that is empty


def test_neighbours_by_nine_digits_and_id(spark):
    rows = [(i, [1.0, (20 - i) * 1e-6, 0.0]) for i in range(20)] + [(i, [1.0, 0.0, 0.5]) for i in range(20, 40)] + [(40, [0.0, 0.0, 0.0]), (41, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    for block in (1, 5, 1024):
        hits = retrieval.cosine_topk_batch(v, v.where("id IN (0, 30, 41)"), 6, block=block)
        got = {q: [r.id for r in sorted(hits.collect(), key=lambda r: r.k) if r.query == q] for q in (0, 30, 41)}
        assert got == {0: [1, 2, 3, 4, 5, 6], 30: [20, 21, 22, 23, 24, 25], 41: [0, 1, 2, 3, 4, 5]}, block
    few = retrieval.cosine_topk_batch(v.where("id < 3"), v.where("id < 2"), 6).collect()
    assert sorted((r.query, r.id, r.k) for r in few) == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2)]
    assert retrieval.cosine_topk_batch(v.limit(0), v.limit(0), 6).count() == 0


def test_impact_merges_only_what_the_front_meets(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(25), rng.randrange(25), rng.choice([0.3, 0.5, 1.0])) for _ in range(60)] * 2
    seen, front = {3: (0, 1.0)}, {3: 1.0}
    for d in (1, 2, 3):
        step = {}
        for a, b, w in edges:
            if b in front and a not in seen:
                step[a] = max(step.get(a, 0), front[b] * w * (1 if d == 1 else 0.6))
        front, seen = step, seen | {a: (d, s) for a, s in step.items()}
    e = spark.createDataFrame([(str(a), str(b), "calls", w) for a, b, w in edges], "src string, dst string, kind string, weight double")
    for limit in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", limit)
        rows = written(monkeypatch, graph)
        got = {int(r.id): (r.depth, round(r.score, 9)) for r in graph.impact(e, spark.createDataFrame([("3", 1.0)], "id string, score double")).collect()}
        assert got == {a: (d, round(s, 9)) for a, (d, s) in seen.items() if d}
        assert set(rows) == {"front"}
        monkeypatch.undo()


def test_candidates_meet_only_edges_to_candidates(spark, monkeypatch):
    rng = random.Random(2)
    sites = [(f"s{rng.randrange(9)}", line, [f"t{j}" for j in rng.sample(range(6), rng.randrange(1, 5))] + ["gone", "s1"][: line % 3]) for line in range(40)]
    edges = [(f"s{rng.randrange(9)}", f"t{rng.randrange(60)}", rng.randrange(40)) for _ in range(3000)]
    targets = [f"t{j}" for j in range(60)] + ["s1"]
    want = sorted((s, t, n, max(0.1, round(1 / len(c), 2))) for s, n, c in sites for t in c if t in targets and t != s and (s, t, n) not in set(edges))
    frames = (spark.createDataFrame(sites, "scope string, line int, candidates array<string>"), spark.createDataFrame(edges, "src string, dst string, line int"), spark.createDataFrame([(t,) for t in targets], "id string"))
    for limit in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", limit)
        rows = written(monkeypatch, graph)
        assert sorted(tuple(r) for r in graph.candidate_callers(*frames).collect()) == want
        assert rows["known"] == [7] and rows["seen"] == [len({e for e in edges if int(e[1][1:]) < 6})]
        monkeypatch.undo()
