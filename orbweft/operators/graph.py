"""Property-graph operators over node and edge DataFrames.

Nodes have id, kind, name, parent and flags; edges have src, dst, kind and, where they matter, line and confidence.
Parallel edges are kept: each is one site. Iterative operators write each few rounds to the shared folder, so their
lineage stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweft.session import stored

#: The weight of an edge by kind; other kinds weigh .3.
WEIGHTS = {"calls": 1.0, "extends": 0.9, "implements": 0.9, "defines_route": 0.8, "passes": 0.7, "references": 0.5, "decorates": 0.4, "imports": 0.3, "tests": 0.2, "reads_config": 0.2, "contains": 0.15}
IMPACT_KINDS = ("calls", "references", "passes", "extends", "implements", "decorates", "defines_route", "imports")


def by_kind(kind: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(default))


#: So many rows of a written table are sent to every task; more are joined by a shuffle.
FEW = 1 << 20


def few(written: DataFrame, n: int | None = None) -> DataFrame:
    """A written table, marked to be sent to every task where its own count says that it is small."""
    return F.broadcast(written) if (written.count() if n is None else n) <= FEW else written


def load(nodes: DataFrame, edges: DataFrame, *, contains: bool = True, skip_tests: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, weight: edges between known nodes without self loops, and each node's edge from its parent.

    What is looked for are the ends that are no known node, among the distinct ends, so only those are shuffled; edges
    are not, unless such ends are many. ends may be given as edges with all the same ends that cost less to list.
    """
    known = nodes.where(~F.col("is_test")) if skip_tests else nodes
    out = edges.select("src", "dst", "kind", F.coalesce(edges["confidence"], F.lit(1.0)).alias("confidence") if "confidence" in edges.columns else F.lit(1.0).alias("confidence"))
    listed = (edges if ends is None else ends).select("src", "dst")
    if contains:
        owned = known.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("contains"), F.lit(1.0))
        out, listed = out.union(owned), listed.union(owned.select("src", "dst"))
    out = out.where("src <> dst")
    ends = listed.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("first")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("first")))).alias("e")).select("e.*")
    met = ends.groupBy("id").agg(F.max("first").alias("is_src"), F.max(~F.col("first")).alias("is_dst"))
    unknown = stored(met.join(known.select("id"), "id", "left_anti"), "unknown")
    for end in ("src", "dst"):
        bad = unknown.where(f"is_{end}").select(F.col("id").alias(end))
        if n := bad.count():
            out = out.join(few(bad, n), end, "left_anti")
    return out.select("src", "dst", "kind", (by_kind(F.col("kind"), WEIGHTS, 0.3) * F.col("confidence")).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, callers, callees; parallel edges count each, self loops do not.

    One aggregation over both ends of every edge, so each node's key is shuffled once.
    """
    e = edges.where("src <> dst")
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), (F.col("kind") == "calls").cast("int").alias("c")).union(e.select("src", F.lit(0), F.lit(1), (F.col("kind") == "calls").cast("int")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") * F.col("c")).alias("callers"), F.sum(F.col("o") * F.col("c")).alias("callees"))


def pagerank(nodes: DataFrame, edges: DataFrame, *, rounds: int = 40, damping: float = 0.85, tolerance: float | None = 1e-9, cut: int = 5, restart: DataFrame | None = None) -> DataFrame:
    """id, rank of every node; edges have src, dst, weight. With restart (id, share) the walk restarts there.

    The mass of nodes without out-edges is spread as the restart is. Edges are dealt by source once, merged per pair of
    nodes there and kept so on the executors' disks, to be dealt anew where an executor is lost; each round takes the
    ranks to them and adds up by target before the shuffle.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = edges.select("src", "dst", "weight").repartition(parts, "src").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    dealt = merged.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("p")).persist(StorageLevel.DISK_ONLY)
    base = nodes.select("id").join(dealt.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left")
    if restart is None:
        base = base.withColumn("share", F.lit(1.0 / n))
    else:
        base = base.join(restart, "id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    base = stored(base.select("id", F.coalesce("out", F.lit(False)).alias("out"), "share"), "base").repartition(parts, "id").persist(StorageLevel.DISK_ONLY)
    if tolerance is None:
        ranks = _terms(dealt, base, rounds, damping)
    else:
        ranks = base.select("id", "out", "share", F.col("share").alias("rank"))
        for k in range(1, rounds + 1):
            dangling = ranks.where("NOT out").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
            after = ranks.join(_moved(dealt, ranks, "rank"), "id", "left").crossJoin(F.broadcast(dangling)).select("id", "out", "share", ((1 - damping) * F.col("share") + damping * (F.coalesce("m", F.lit(0.0)) + F.col("d") * F.col("share"))).alias("rank"), F.col("rank").alias("before"))
            after = stored(after, "ranks")  # a round reads the ranks thrice, so unwritten rounds would multiply
            ranks = after.drop("before")
            if k % cut == 0 and after.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
                break
    dealt.unpersist()
    base.unpersist()
    return ranks.select("id", "rank")


def _moved(dealt: DataFrame, ranks: DataFrame, rank: str) -> DataFrame:
    """id, m: what one step of the walk brings to each node."""
    return dealt.join(ranks.select(F.col("id").alias("src"), rank), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col(rank) * F.col("p")).alias("m"))


def _terms(dealt: DataFrame, base: DataFrame, rounds: int, damping: float) -> DataFrame:
    """id, rank after exactly so many rounds, as the sum of the walk's powers.

    A round is rank' = c share + damping P rank, where the number c = 1 - damping + damping * (mass without out-edges).
    So the ranks are sums of share, damping P share, (damping P)^2 share and so on, each times the c of the round that
    brought it in, and the c follow from each term's own mass without out-edges. Terms hold only the nodes that they
    reach, and once one is empty so are all the later ones: a graph without cycles takes as many steps as its longest
    path, not as many as rounds.
    """
    spare = lambda d: d.where("NOT out").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
    terms, lost = [base.select("id", "out", F.col("share").alias("x")).where("x <> 0")], []
    lost.append(spare(terms[0]))
    while len(terms) <= rounds:
        moved = _moved(dealt, terms[-1], "x").join(base.select("id", "out"), "id").select("id", "out", (damping * F.col("m")).alias("x"))
        term = stored(moved.where("x <> 0"), "term")
        if term.isEmpty():
            break
        terms.append(term)
        lost.append(spare(term))
    lost += [0.0] * (rounds - len(lost))
    came: list[float] = []
    for k in range(rounds):
        came.append(1 - damping + damping * (lost[k] + sum(came[k - 1 - j] * lost[j] for j in range(k))))
    times = [came[rounds - 1 - j] if j < rounds else 1.0 for j in range(len(terms))]
    parts = base.select("id", (F.lit(times[0]) * F.col("share")).alias("x"))
    for term, c in zip(terms[1:], times[1:], strict=True):
        parts = parts.union(term.select("id", F.lit(c) * F.col("x")))
    return stored(parts.groupBy("id").agg(F.sum("x").alias("rank")), "ranks")


def both_ways(edges: DataFrame, back: float = 0.7) -> DataFrame:
    """Edges and their reverses at a lower weight, as a walk over relations of either direction needs."""
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * back).alias("weight")))


def callers(edges: DataFrame, ids: list[str], kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    return edges.where(F.col("dst").isin(ids) & F.col("kind").isin(list(kinds)))


def candidate_callers(unresolved: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Sites whose reference was left with candidates: a caller of each candidate at 1/n, .1 at least, not already an edge.

    Of targets and edges only those that are some site's candidate can matter; they are written first, and sent to every
    task up to a million, so that the sites times their candidates are not shuffled.
    """
    wanted = unresolved.select("candidates").distinct().select(F.explode("candidates").alias("dst")).distinct()
    known = stored(wanted.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi"), "known")
    known = few(known)
    seen = stored(edges.join(known, "dst", "left_semi").select(F.col("src").alias("scope"), "dst", "line").distinct(), "seen")
    sites = unresolved.select("scope", "line", "candidates", F.greatest(F.lit(0.1), F.round(1.0 / F.size("candidates"), 2)).alias("confidence")).withColumn("dst", F.explode("candidates")).drop("candidates")
    sites = sites.where("scope <> dst").join(known, "dst", "left_semi")
    return sites.join(few(seen), ["scope", "dst", "line"], "left_anti").select(F.col("scope").alias("src"), "dst", "line", "confidence")


def impact(edges: DataFrame, roots: DataFrame, *, depth: int = 3, kinds: tuple[str, ...] = IMPACT_KINDS) -> DataFrame:
    """id, depth, score of what depends on the roots (id, score of 0 or more): reverse steps, each node at its least depth
    with its best score there; a step multiplies by the edge's weight, and by .6 beyond the first.

    Edges are not merged before: a step takes those into the front alone, of which the best counts.
    """
    back = edges.where(F.col("kind").isin(list(kinds))).select("dst", "src", "weight")
    seen = roots.select("id", F.lit(0).alias("depth"), "score")
    front, n = seen, roots.count()
    for d in range(1, depth + 1):
        step = back.join(few(front.select(F.col("id").alias("dst"), "score"), n), "dst")
        reached = step.groupBy(F.col("src").alias("id")).agg(F.max(F.col("score") * F.col("weight") * (1.0 if d == 1 else 0.6)).alias("score"))
        front = stored(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "score"), "front")
        seen = seen.union(front)
        n = front.count()
        if not n:
            break
    return seen.where("depth > 0")


def closure(pairs: DataFrame, *, limit: int = 6) -> DataFrame:
    """child, ancestor, depth: every ancestor within limit steps at its least depth; cycles end by themselves.

    Each round takes only the steps from nodes that are parents themselves: without the leaves, which lead nowhere
    further, they are few enough as a rule to be sent to the pairs, whose few ancestors are hot keys.
    """
    step = stored(pairs.select("child", F.col("parent").alias("ancestor")).where("child <> ancestor").distinct(), "steps")
    out = front = step.withColumn("depth", F.lit(1))
    up = stored(step.join(step.select(F.col("ancestor").alias("child")).distinct(), "child", "left_semi").select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next")), "up")
    for d in range(2, limit + 1):
        front = front.join(up, "ancestor").select("child", F.col("next").alias("ancestor")).where("child <> ancestor").distinct()
        front = stored(front.join(out.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(d)), "closure")
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def scc(edges: DataFrame) -> DataFrame:
    """id, component of every node that lies on a cycle: least id of the nodes it reaches and that reach it.

    Trimming first drops what cannot be on a cycle; then minima travel forward and, within their reach, backward, which
    settles at least one component a round; the rest goes on until no edge is left. Minima are those of the ids' hashes,
    so that chains of cycles in the order of their ids do not settle one by one.
    """
    live = stored(edges.where("src <> dst").select("src", "dst").distinct(), "live")
    done = None
    while True:
        while True:  # nodes without an edge in or out are on no cycle
            n = live.count()
            live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            live = stored(live.select("src", "dst"), "live")
            if live.count() == n:
                break
        if not n:
            break
        color = _minima(live, live.select(F.col("src").alias("id"), F.struct(F.xxhash64("src").alias("hash"), F.col("src").alias("id")).alias("label")).distinct(), "src", "dst")
        own = live.join(color.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", "a")
        own = stored(own, "own")
        found = stored(_reach(own, color.where("id = label.id")), "found")
        done = found if done is None else done.union(found)
        live = live.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
    empty = edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    out = empty if done is None else done.select("id", F.col("label.id").alias("component"))
    sizes = out.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return out.join(sizes, "component").select("id", F.col("least").alias("component"))


def _minima(edges: DataFrame, labels: DataFrame, src: str, dst: str) -> DataFrame:
    labels = stored(labels, "labels")
    while True:
        sent = edges.join(labels.select(F.col("id").alias(src), "label"), src).groupBy(F.col(dst).alias("id")).agg(F.min("label").alias("m"))
        after = stored(labels.join(sent, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"), (F.col("m") < F.col("label")).alias("moved")), "labels")
        if after.where("moved").isEmpty():
            return after.select("id", "label")
        labels = after.select("id", "label")


def _reach(own: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that reach their color's root within the color."""
    seen = front = stored(roots.select("id", "label"), "reach")
    while True:
        back = own.join(front.select(F.col("id").alias("dst"), F.col("label").alias("a")), ["dst", "a"]).select(F.col("src").alias("id"), F.col("a").alias("label")).distinct()
        front = stored(back.join(seen, ["id", "label"], "left_anti"), "reach")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def shortest(edges: DataFrame, source: str, *, hops: int = 12) -> DataFrame:
    """id, cost, hops from source: relaxation by whole rounds, the cheapest cost of each node first, then fewest hops."""
    step = stored(edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")), "steps")
    best = edges.sparkSession.createDataFrame([(source, 0.0, 0)], "id string, cost double, hops int")
    for d in range(1, hops + 1):
        moved = step.join(best.select(F.col("id").alias("src"), F.col("cost").alias("so_far"), "hops"), "src")
        moved = moved.where(F.col("hops") == d - 1).select(F.col("dst").alias("id"), F.round(F.col("so_far") + F.col("cost"), 9).alias("cost"), (F.col("hops") + 1).alias("hops"))
        least = moved.union(best).groupBy("id").agg(F.min(F.struct("cost", "hops")).alias("m")).select("id", "m.cost", "m.hops")
        best = stored(least, "best")
        if best.where(F.col("hops") == d).isEmpty():
            break
    return best


#: What a step of a route costs by kind, beside 1; entering a node costs more the more nodes lead to it.
STEP = {"contains": 1.5, "imports": 2.5, "references": 1.2}
STRUCTURAL = ("contains", "calls", "extends", "implements")


def route(nodes: DataFrame, edges: DataFrame, start: str, end: str, *, directed: bool = False, hops: int = 12) -> list[dict] | None:
    """The cheapest way between two nodes as steps (id, kind, reversed), the first without a kind; None if there is none.

    Edges of structure are tried first, without modules on the way; then all edges; then tests and sections too. A node
    is entered at 1 + .6 log2(1 + its fan-in) times the step's cost, so a way through what everything uses is dear; the
    end costs nothing extra. Relaxation goes in whole rounds, and the way is read back from at most hops rows.
    """
    if nodes.where(F.col("id").isin(start, end)).select("id").distinct().count() < len({start, end}):
        return None
    if start == end:
        return [{"id": start, "kind": None, "reversed": False}]
    known = nodes.select("id", "kind", "is_test")
    into = edges.where("kind <> 'contains'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    enter = stored(known.join(into, "id", "left").select("id", (F.col("kind") == "module").alias("module"), (F.col("is_test") | F.col("kind").isin("test", "section")).alias("test"), (1 + 0.6 * F.log2(1 + F.coalesce("n", F.lit(0)))).alias("enter")), "enter")
    for structural, tests in ((True, False), (False, False), (True, True), (False, True)):
        found = _route(edges, enter, start, end, directed, hops, structural, tests)
        if found:
            return found
    return None


def _route(edges: DataFrame, enter: DataFrame, start: str, end: str, directed: bool, hops: int, structural: bool, tests: bool) -> list[dict] | None:
    own = edges.where(F.col("kind").isin(*STRUCTURAL)) if structural else edges
    ways = own.select("src", "dst", "kind", F.lit(False).alias("reversed"))
    if not directed:
        ways = ways.union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", F.lit(True)))
    ends = F.col("id").isin(start, end)
    open_ = F.lit(True) if tests else ~F.col("test")
    open_ = open_ & ~F.col("module") if structural else open_
    to = enter.where(ends | open_).select(F.col("id").alias("dst"), F.col("module").alias("m1"), F.when(F.col("id") == end, 1.0).otherwise(F.col("enter")).alias("enter"))
    of = enter.select(F.col("id").alias("src"), F.col("module").alias("m0"))
    base = F.when((F.col("kind") == "contains") & (F.col("m0") | F.col("m1")), 5.0).otherwise(by_kind(F.col("kind"), STEP, 1.0))
    step = ways.where("src <> dst").join(to, "dst").join(of, "src").select("src", "dst", F.struct((base * F.col("enter")).alias("cost"), "kind", "reversed").alias("s"))
    step = stored(step.groupBy("src", "dst").agg(F.min("s").alias("s")).select("src", "dst", "s.*"), "route")
    best = edges.sparkSession.createDataFrame([(start, 0.0, 0, None, None, False)], "id string, cost double, hops int, before string, kind string, reversed boolean")
    for d in range(1, hops + 1):
        front = best.where(F.col("hops") == d - 1).select(F.col("id").alias("src"), F.col("cost").alias("so_far"))
        moved = step.join(front, "src").select(F.col("dst").alias("id"), F.round(F.col("so_far") + F.col("cost"), 9).alias("cost"), F.lit(d).alias("hops"), F.col("src").alias("before"), "kind", "reversed")
        best = stored(best.union(moved).groupBy("id").agg(F.min(F.struct("cost", "hops", "before", "kind", "reversed")).alias("m")).select("id", "m.*"), "routes")
        if best.where(F.col("hops") == d).isEmpty():
            break
    out, at = [], end
    while at is not None:
        row = best.where(F.col("id") == at).first()
        if row is None:
            return None
        out.append({"id": at, "kind": row.kind, "reversed": row.reversed})
        at = row.before
    return out[::-1]


def callers_transitive(edges: DataFrame, roots: list[str], *, depth: int = 2, kinds: tuple[str, ...] = ("calls", "references", "passes", "decorates", "defines_route")) -> DataFrame:
    """src, dst, kind, line, depth: sites that refer to the roots, to the callers found so, and on; a node's sites are
    listed at the depth at which it is first met."""
    own = edges.where(F.col("kind").isin(list(kinds)) & (F.col("src") != F.col("dst"))).select("src", "dst", "kind", "line")
    seen = front = edges.sparkSession.createDataFrame([(r,) for r in roots], "id string")
    out = None
    for d in range(1, depth + 1):
        sites = stored(own.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("depth", F.lit(d)), "sites")
        out = sites if out is None else out.union(sites)
        front = stored(sites.select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        seen = seen.union(front)
    return out


def tests_for(edges: DataFrame, ids: list[str]) -> DataFrame:
    """id, test: the tests of each of the ids."""
    return edges.where((F.col("kind") == "tests") & F.col("dst").isin(ids)).select(F.col("dst").alias("id"), F.col("src").alias("test")).distinct()


def descendants(pairs: DataFrame, *, limit: int = 6) -> DataFrame:
    """ancestor, child, depth: the closure of (child, parent) seen from above."""
    return closure(pairs, limit=limit).select("ancestor", "child", "depth")


def community_report(members: DataFrame, *, top: int = 5, dirs: int = 3) -> DataFrame:
    """community, size, top_symbols, dirs, peripheral of communities whose members have community, id, rank, dir and aside:
    the best ranked, the commonest folders, and whether more than half are aside of the main code."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("rank"), "id"))
    best = members.withColumn("k", place).where(F.col("k") <= top).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("top_symbols"))
    counts = members.groupBy("community", "dir").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "dir"))
    common = counts.withColumn("k", place).where(F.col("k") <= dirs).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "dir"))), lambda x: x["dir"]).alias("dirs"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"), (F.avg(F.col("aside").cast("int")) > 0.5).alias("peripheral"))
    return sizes.join(best, "community").join(common, "community").select("community", "size", "top_symbols", "dirs", "peripheral")


def inherit_docs(members: DataFrame, supers: DataFrame, *, limit: int = 6) -> DataFrame:
    """id, doc, doc_from of undocumented members (id, parent, name, doc, ordinal): the nearest ancestor's member of that
    name with a doc of its own, at the same place among overloads or the last there."""
    place = F.row_number().over(Window.partitionBy("parent", "name").orderBy("ordinal", "id")) - 1
    m = members.withColumn("place", place)
    up = closure(supers, limit=limit).select(F.col("child").alias("parent"), F.col("ancestor"), "depth")
    source = m.where("doc IS NOT NULL AND doc <> ''").select(F.col("parent").alias("ancestor"), "name", F.col("id").alias("doc_from"), F.col("doc").alias("up_doc"), F.col("place").alias("up_place"))
    offers = m.where("doc IS NULL OR doc = ''").select("id", "parent", "name", "place").join(up, "parent").join(source, ["ancestor", "name"])
    rank = Window.partitionBy("id").orderBy("depth", "ancestor", F.abs(F.least(F.col("place"), F.col("up_place")) - F.col("place")), F.col("up_place").desc())
    return offers.where("up_place <= place").withColumn("k", F.row_number().over(rank)).where("k = 1").select("id", F.col("up_doc").alias("doc"), "doc_from", "depth")


def label_propagation(edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """id, community by synchronous label propagation on undirected weights; ties go to the least label."""
    und = stored(edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w")), "undirected")
    labels = und.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = und.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.round(F.sum("w"), 9).alias("v"))
        best = votes.groupBy("src").agg(F.max("v").alias("v")).join(votes, ["src", "v"]).groupBy(F.col("src").alias("id")).agg(F.min("label").alias("label"))
        labels = stored(best, "labels")
    return labels.select("id", F.col("label").alias("community"))


def louvain(edges: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """id, community by local moving and aggregation.

    Moving is sequential by nature and every gain depends on the move before, so it runs in one task over the merged
    edges (16 bytes an edge); a graph beyond one task's memory is not handled.
    """
    merged = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w")).withColumn("all", F.lit(1))

    def run(frame):
        import pandas as pd

        from orbweft.operators.louvain import communities

        found = communities(list(zip(frame["a"], frame["b"], frame["w"], strict=True)), resolution)
        return pd.DataFrame(sorted(found.items()), columns=["id", "community"])

    return merged.groupBy("all").applyInPandas(run, "id string, community long")
