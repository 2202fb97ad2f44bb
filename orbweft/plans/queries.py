"""The registry's queries: each operator over the driver's tables, with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbweft.functions import text as fn
from orbweft.operators import graph, relational, retrieval, search
from orbweft.plans import order_graph as og
from orbweft.plans import sample
from orbweft.plans.registry import ORACLES, QUERIES
from orbweft.session import stored, table


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# Aggregates and projections


@query(f"""WITH {og.NODES_SQL}, {og.EDGES_SQL}, e AS (SELECT * FROM edges WHERE src <> dst),
i AS (SELECT dst AS id, count(*) AS in_degree, CAST(count_if(kind = 'calls') AS BIGINT) AS callers FROM e GROUP BY 1),
o AS (SELECT src AS id, count(*) AS out_degree FROM e GROUP BY 1)
SELECT n.id, n.kind, n.name, in_degree, coalesce(out_degree, 0) AS out_degree, callers
FROM i JOIN nodes n USING (id) LEFT JOIN o USING (id) ORDER BY in_degree DESC, n.id LIMIT 20""")
def hubs_top20(spark, sf):
    """The nodes with the most edges into them."""
    d = graph.degrees(og.order_edges(spark, sf)).where("in_degree > 0")
    top = d.orderBy(F.desc("in_degree"), "id").limit(20)
    return og.order_nodes(spark, sf).join(F.broadcast(top), "id").select("id", "kind", "name", "in_degree", "out_degree", "callers")


@query(f"WITH {og.NODES_SQL} SELECT kind, count(*) AS n, CAST(count_if(is_test) AS BIGINT) AS tests, count(parent) AS owned FROM nodes GROUP BY kind")
def kind_counts(spark, sf):
    return og.order_nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_test").alias("tests"), F.count("parent").alias("owned"))


@query(f"WITH {og.EDGES_SQL} SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY kind")
def edge_kind_counts(spark, sf):
    return og.order_edges(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("SELECT o_orderpriority AS resolver, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS resolved FROM orders GROUP BY 1")
def resolver_cond_sum(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("resolver")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("resolved"))


@query(f"WITH {og.EDGES_SQL} SELECT count(*) AS sites, count(DISTINCT src || '>' || dst) AS pairs FROM edges WHERE kind = 'calls'")
def parallel_edges_kept(spark, sf):
    e = og.order_edges(spark, sf).where("kind = 'calls'")
    return e.groupBy("src", "dst").agg(F.count("*").alias("c")).agg(F.sum("c").alias("sites"), F.count("*").alias("pairs"))


@query(f"""WITH {og.EDGES_SQL}, e AS (SELECT * FROM edges WHERE src <> dst),
i AS (SELECT dst AS id, count(*) AS a, CAST(count_if(kind = 'calls') AS BIGINT) AS c FROM e GROUP BY 1), o AS (SELECT src AS id, count(*) AS a, CAST(count_if(kind = 'calls') AS BIGINT) AS c FROM e GROUP BY 1)
SELECT coalesce(i.id, o.id) AS id, coalesce(i.a, 0) AS in_degree, coalesce(o.a, 0) AS out_degree, coalesce(i.c, 0) AS callers, coalesce(o.c, 0) AS callees FROM i FULL JOIN o ON i.id = o.id""")
def degree_all(spark, sf):
    return graph.degrees(og.order_edges(spark, sf))


@query(f"""WITH {og.NODES_SQL}, {og.EDGES_SQL}, e AS (SELECT src, dst, kind FROM edges WHERE src <> dst UNION ALL SELECT parent, id, 'contains' FROM nodes WHERE parent IS NOT NULL AND NOT is_test)
SELECT e.kind, count(*) AS n, round(sum(CAST(CASE e.kind WHEN 'calls' THEN 1.0 WHEN 'references' THEN 0.5 WHEN 'imports' THEN 0.3 ELSE 0.15 END AS DOUBLE)), 6) AS weight
FROM e SEMI JOIN (SELECT id FROM nodes WHERE NOT is_test) a ON e.src = a.id SEMI JOIN (SELECT id FROM nodes WHERE NOT is_test) b ON e.dst = b.id GROUP BY 1""")
def graph_load(spark, sf):
    """The graph without test nodes, by kind of edge."""
    g = graph.load(og.order_nodes(spark, sf), og.order_edges(spark, sf), skip_tests=True, ends=og.order_edges(spark, sf, repeated=True))
    return g.groupBy("kind").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("weight"))


@query(f"WITH {og.EDGES_SQL} SELECT src, dst, line FROM edges WHERE dst = 'part:1' AND kind = 'calls'")
def callers_of_part(spark, sf):
    return graph.callers(og.order_edges(spark, sf), ["part:1"]).select("src", "dst", "line")


@query(f"WITH {og.EDGES_SQL} SELECT dst, line FROM edges WHERE src = 'order:7' AND kind = 'calls'")
def callees_of_order(spark, sf):
    return og.order_edges(spark, sf).where("src = 'order:7' AND kind = 'calls'").select("dst", "line")


@query(f"WITH {og.NODES_SQL} SELECT p.name AS parent, c.kind, count(*) AS n FROM nodes c JOIN nodes p ON c.parent = p.id GROUP BY ALL")
def members_of_nation(spark, sf):
    n = og.order_nodes(spark, sf)
    p = n.select(F.col("id").alias("parent"), F.col("name").alias("p"))
    return n.join(p, "parent").groupBy(F.col("p").alias("parent"), "kind").agg(F.count("*").alias("n"))


# Resolution


@query("""WITH c AS (SELECT p_name, list(p_partkey ORDER BY p_partkey)[1:8] AS ids, count(*) AS m FROM part GROUP BY 1),
u AS (SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT 'order:' || l_orderkey AS src, l_linenumber AS line, unnest(ids) AS t, greatest(0.1, round(1.0 / len(ids), 2)) AS confidence FROM u JOIN c USING (p_name) WHERE m > 1)
SELECT src, 'part:' || t AS dst, line, confidence FROM s ANTI JOIN lineitem l ON s.src = 'order:' || l.l_orderkey AND s.t = l.l_partkey AND s.line = l.l_linenumber""")
def candidate_callers(spark, sf):
    """Lineitems by part name only: each part of that name is a candidate, at 1/n."""
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    place = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    ids = part.where("p_name IS NOT NULL").select("p_name", "p_partkey", place.alias("k")).where("k <= 8")  # the first eight are the candidates
    names = ids.groupBy("p_name").agg(F.sort_array(F.collect_list("p_partkey")).alias("ids")).where(F.size("ids") > 1).select("p_name", F.transform("ids", lambda i: F.concat(F.lit("part:"), i.cast("string"))).alias("candidates"))
    names = graph.few(stored(names, "names"))
    refs = items.select("l_orderkey", "l_linenumber", "l_partkey").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(names, "p_name")
    unresolved = refs.select(og.ident("order", F.col("l_orderkey")).alias("scope"), F.col("l_linenumber").alias("line"), "candidates")
    calls = og.order_edges(spark, sf).where("kind = 'calls'")
    return graph.candidate_callers(unresolved, calls, part.select(og.ident("part", F.col("p_partkey")).alias("id")))


@query("SELECT p_name AS name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'unique' WHEN count(*) <= 8 THEN 'candidates' ELSE 'ambiguous' END AS resolver, min(p_partkey) AS first FROM part GROUP BY 1")
def unique_vs_ambiguous_names(spark, sf):
    n = F.count("*")
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(n.alias("n"), F.when(n == 1, "unique").when(n <= 8, "candidates").otherwise("ambiguous").alias("resolver"), F.min("p_partkey").alias("first"))


@query("""WITH r AS (SELECT p_partkey AS ref, p_brand, p_type, p_size FROM part),
t AS (SELECT ref, p_partkey AS target, 0 AS tier, 'scope' AS resolver, 1.0 AS confidence FROM r JOIN part USING (p_brand, p_type, p_size) WHERE ref <> p_partkey
UNION ALL SELECT ref, p_partkey, 1, 'import', 0.9 FROM r JOIN part USING (p_brand, p_type) WHERE ref <> p_partkey
UNION ALL SELECT ref, p_partkey, 2, 'unique', 0.7 FROM r JOIN (SELECT min(p_partkey) AS p_partkey, p_brand FROM part GROUP BY 2) USING (p_brand))
SELECT ref, target, tier, resolver, CAST(confidence AS DOUBLE) AS confidence FROM t QUALIFY tier = min(tier) OVER (PARTITION BY ref)""")
def tier_cascade(spark, sf):
    """Each part bound to others by the first tier that has any: brand, type and size; brand and type; brand."""
    part = table(spark, sf, "part")
    refs = part.select(F.col("p_partkey").alias("ref"), "p_brand", "p_type", "p_size")
    target = F.col("p_partkey").alias("target")
    tiers = [
        (part.select(target, "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], "scope", 1.0, False),
        (part.select(target, "p_brand", "p_type"), ["p_brand", "p_type"], "import", 0.9, False),
        (part.groupBy("p_brand").agg(F.min("p_partkey").alias("target")), ["p_brand"], "unique", 0.7, True),
    ]
    return relational.cascade(refs, tiers, "ref")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def builtin_anti(spark, sf):
    names = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return table(spark, sf, "events").select("event_id", "event_type").join(F.broadcast(names), "event_type", "left_anti").select("event_id", "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_parts(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def stale_vectors(spark, sf):
    return table(spark, sf, "embeddings").join(table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def left_join_defaults(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, sf, "customer").join(sums, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT l_returnflag || '|' || l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity <= 10 AND l_returnflag IN ('A', 'R') GROUP BY 1")
def filters_pushed(spark, sf):
    """Equality, list and range filters that reach the scan."""
    li = table(spark, sf, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") <= 10) & F.col("l_returnflag").isin("A", "R"))
    return li.groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CAST(count_if(ends_with(c_name, '7')) AS BIGINT) AS suffix, CAST(count_if(contains(c_name, '#0000001')) AS BIGINT) AS part, CAST(count_if(lower(c_mktsegment) = 'building') AS BIGINT) AS nocase, CAST(count_if(starts_with(c_name, 'Customer#0000000')) AS BIGINT) AS prefix FROM customer")
def like_forms(spark, sf):
    c = F.col("c_name")
    return table(spark, sf, "customer").agg(F.count_if(c.endswith("7")).alias("suffix"), F.count_if(c.contains("#0000001")).alias("part"), F.count_if(F.lower("c_mktsegment") == "building").alias("nocase"), F.count_if(c.startswith("Customer#0000000")).alias("prefix"))


# Ranges, windows, change tracking


@query("""WITH r AS (SELECT o_orderkey AS range_id, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 30 AS e FROM orders),
p AS (SELECT c_custkey AS point_id, 10000 + c_custkey % 1000 AS f, 10000 + c_custkey % 1000 + 1 AS t FROM customer)
SELECT point_id, range_id FROM p JOIN r ON s <= t AND e >= f QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY e - s, range_id) = 1""")
def range_overlap_innermost(spark, sf):
    """The narrowest order period that overlaps each customer's days."""
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("range_id"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 30).alias("end"))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), (10000 + F.col("c_custkey") % 1000).alias("from_"), (10001 + F.col("c_custkey") % 1000).alias("to_"))
    return relational.innermost(p, r, width=8)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current FROM events")
def fill_forward(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w).alias("current"))


@query("""WITH a AS (SELECT doc_id, strlen(text) AS size, sha1(text) AS mark FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN strlen(text) + 1 ELSE strlen(text) END AS size, sha1(CASE WHEN doc_id % 10 = 7 THEN text || '!' ELSE text END) AS mark FROM documents WHERE doc_id % 10 <> 4)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.mark <> b.mark THEN 'changed' WHEN a.size <> b.size THEN 'touched' ELSE 'same' END AS state
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def change_detect_full_outer(spark, sf):
    """A listing with changed, touched, missing and new documents against what is known."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    size, k = F.octet_length("text"), F.col("doc_id") % 10
    a = d.where(k != 3).select("doc_id", size.alias("size"), F.sha1("text").alias("mark"))
    b = d.where(k != 4).select("doc_id", F.when(k == 5, size + 1).otherwise(size).alias("size"), F.sha1(F.when(k == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("mark"))
    return relational.changes(a, b, "doc_id", "size", "mark")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf):
    return relational.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_name || '*' FROM customer WHERE c_custkey % 5 = 0")
def upsert_file(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return relational.upserted(c, c.where("c_custkey % 5 = 0").withColumn("c_name", F.concat("c_name", F.lit("*"))), "c_custkey")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t, t AS first, 1 AS session FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN e.t - r.t > 3600000000 OR e.t - r.first > 14400000000 THEN e.t ELSE r.first END, r.session + CAST(e.t - r.t > 3600000000 OR e.t - r.first > 14400000000 AS INT) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM r GROUP BY 1, 2""")
def debounce_sessions(spark, sf):
    """Bursts of each user's events: quiet for an hour, or four hours long; the next event begins the next."""
    return relational.sessions(table(spark, sf, "events"), "user_id", "ts", "event_id", gap_us=3_600_000_000, most_us=14_400_000_000)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS churn FROM events GROUP BY 1), s AS (SELECT *, sum(churn) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS total FROM d)
SELECT CAST(day AS VARCHAR) AS day, churn, CAST(total AS BIGINT) AS total, CAST(total // 500 > (total - churn) // 500 AS INT) AS refresh FROM s""")
def defer_counter(spark, sf):
    """Days whose churn brings the accumulated count over another 500, when analysis is due. One row a day is windowed."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("churn"))
    total = F.sum("churn").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    s = d.withColumn("total", total)
    return s.select(F.col("day").cast("string").alias("day"), "churn", "total", (F.floor(F.col("total") / 500) > F.floor((F.col("total") - F.col("churn")) / 500)).cast("int").alias("refresh"))


@query("""WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 97 = 0), d AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 101 = 0)
SELECT k FROM c UNION SELECT l_orderkey FROM lineitem SEMI JOIN d ON l_partkey = p UNION SELECT a.l_orderkey FROM lineitem a SEMI JOIN (SELECT l_partkey FROM lineitem SEMI JOIN c ON l_orderkey = k) x ON a.l_partkey = x.l_partkey""")
def affected_set(spark, sf):
    """Orders to look at again: changed, holding an edge to a deleted part, or sharing a part with a changed one."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    changed = table(spark, sf, "orders").where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("k"))
    gone = table(spark, sf, "part").where("p_partkey % 101 = 0").select(F.col("p_partkey").alias("l_partkey"))
    touched = li.join(changed, li.l_orderkey == changed.k, "left_semi").select("l_partkey").distinct()
    parts = gone.union(touched).distinct()
    return changed.union(li.join(parts, "l_partkey", "left_semi").select("l_orderkey")).distinct()


@query("""WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
SELECT p_partkey, p_brand FROM r ORDER BY k <= 8 DESC, p_retailprice DESC, p_partkey LIMIT 300""")
def floor_sample(spark, sf):
    """300 parts: eight of each brand at least, then the dearest."""
    return relational.floor_sample(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_partkey", floor=8, total=300).select("p_partkey", "p_brand")


@query("SELECT p_partkey AS id, round(p_retailprice * pow(0.92, least(row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) - 1, 6)), 6) AS score FROM part")
def dup_damp(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_retailprice").alias("score"))
    return retrieval.dup_damped(hits, "p_name").select("id", r6(F.col("score")).alias("score"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) - 1 AS overload FROM lineitem")
def overload_idx(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("overload"))


@query("""WITH d AS (SELECT c_nationkey AS community, c_mktsegment AS dir, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT community, string_agg(dir, ',' ORDER BY n DESC, dir) AS dirs FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, dir) AS k FROM d) WHERE k <= 3 GROUP BY 1""")
def top_dirs(spark, sf):
    d = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("dir")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "dir"))
    top = d.withColumn("k", k).where("k <= 3")
    return top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "dir"))), lambda x: x["dir"]), ",").alias("dirs"))


@query("""WITH t AS (SELECT DISTINCT p_brand AS community, p_partkey, unnest(string_split(p_name, ' ')) AS term, p_retailprice FROM part), s AS (SELECT community, term, sum(1 + p_retailprice / 1000) AS w FROM t GROUP BY 1, 2)
SELECT community, term, round(w, 6) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY community ORDER BY round(w, 6) DESC, term) <= 3""")
def label_tf(spark, sf):
    """The three heaviest words of each brand's part names."""
    t = table(spark, sf, "part").select(F.col("p_brand").alias("community"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"), "p_retailprice")
    s = t.groupBy("community", "term").agg(r6(F.sum(1 + F.col("p_retailprice") / 1000)).alias("weight"))
    k = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "term"))
    return s.withColumn("k", k).where("k <= 3").drop("k")


@query(f"WITH {og.TRADE_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(n) AS BIGINT) AS n FROM trade WHERE src <> dst GROUP BY 1, 2")
def comm_edges(spark, sf):
    return og.trade_edges(spark, sf).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("n"))


# Scalar functions


@query(r"""SELECT c_custkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS words
FROM (SELECT c_custkey, 'get' || c_name || '.HTTPServer_' || c_mktsegment AS s FROM customer)""")
def split_identifier(spark, sf):
    name = F.concat(F.lit("get"), "c_name", F.lit(".HTTPServer_"), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", fn.split_identifier(name).alias("words"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, array_to_string(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS path FROM pages")
def path_norm(spark, sf):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), fn.path_norm(path).alias("path"))


@query(r"SELECT p_partkey, regexp_matches(p_brand, '[a-z][A-Z]|[_$.]|[0-9]|^[A-Z].*[A-Z]') AS brand, regexp_matches(p_name, '[a-z][A-Z]|[_$.]|[0-9]|^[A-Z].*[A-Z]') AS name FROM part")
def code_shaped(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.code_shaped(F.col("p_brand")).alias("brand"), fn.code_shaped(F.col("p_name")).alias("name"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.2) AS BIGINT) AS tokens, substr(sha1('m' || chr(0) || text), 1, 20) AS hash, sha1(text) AS content FROM documents")
def est_tokens_and_hashes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", fn.est_tokens(t).cast("long").alias("tokens"), fn.text_hash(F.lit("m"), t).alias("hash"), F.sha1(t).alias("content"))


@query("""SELECT event_id, CASE WHEN s < 90 THEN CAST(CAST(round(s) AS BIGINT) AS VARCHAR) || 's ago' WHEN s < 5400 THEN CAST(CAST(round(s / 60) AS BIGINT) AS VARCHAR) || 'm ago' ELSE CAST(CAST(round(s / 3600) AS BIGINT) AS VARCHAR) || 'h ago' END AS age
FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1e6 AS s FROM events)""")
def age_bucket(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return e.crossJoin(F.broadcast(e.agg(F.max("t").alias("now")))).select("event_id", fn.age_text(F.round(F.col("now") - F.col("t"), 6)).alias("age"))


@query(r"""SELECT page_id, regexp_matches(lower(array_to_string(string_split(html, chr(10))[1:8], chr(10))), 'do not edit|auto-?generated|@generated|code generated') AS marked, contains(html, chr(0)) AS is_binary, list_max(list_transform(string_split(html, chr(10)), lambda x: length(x))) > 5000 AS dense FROM pages""")
def generated_content(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.lower(F.substring_index(html, "\n", 8)).rlike("do not edit|auto-?generated|@generated|code generated").alias("marked"), html.contains("\0").alias("is_binary"), (F.array_max(F.transform(F.split(html, "\n"), F.length)) > 5000).alias("dense"))


@query(r"""WITH x AS (SELECT page_id, lower(regexp_extract(url, '\.([a-z]+)/', 1)) AS ext FROM pages), l(ext, language) AS (VALUES ('com', 'commerce'), ('org', 'organisation'))
SELECT page_id, coalesce(language, 'unknown') AS language FROM x LEFT JOIN l USING (ext)""")
def lang_by_path(spark, sf):
    """A small table by extension, broadcast."""
    l = spark.createDataFrame([("com", "commerce"), ("org", "organisation")], "ext string, language string")  # noqa: E741
    p = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", r"\.([a-z]+)/", 1)).alias("ext"))
    return p.join(F.broadcast(l), "ext", "left").select("page_id", F.coalesce("language", F.lit("unknown")).alias("language"))


@query(r"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def html_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id", "href").agg(F.count("*").alias("n"))


# Retrieval

TERMS = ("the", "ment", "worthless")


def _bm25_sql() -> str:
    phrases = retrieval.phrases(list(TERMS))
    hit = lambda t, p: f"len(list_filter(w, lambda x: starts_with(x, '{t}')))" if p else f"len(list_filter(w, lambda x: x = '{t}'))"
    fs = ", ".join(f"{hit(t, p)} AS f{i}" for i, (t, p) in enumerate(phrases))
    ns = ", ".join(f"CAST(count_if(f{i} > 0) AS BIGINT) AS n{i}" for i in range(len(phrases)))
    s = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(len(phrases)))
    anyhit = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return rf"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents), h AS (SELECT id, len(w) AS dl, {fs} FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS a, {ns} FROM h), hits AS (SELECT id, {s} AS score FROM h, st WHERE {anyhit})"""


def _bm25(spark, sf):
    return retrieval.bm25(table(spark, sf, "documents"), "doc_id", {"text": 1.0}, retrieval.phrases(list(TERMS)))


@query(f"WITH {_bm25_sql()} SELECT id, round(score, 6) AS score FROM hits")
def bm25_docs(spark, sf):
    """Every document that any phrase hits, with its score."""
    return _bm25(spark, sf).select("id", r6(F.col("score")).alias("score"))


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM w GROUP BY 1)
SELECT term, df, round(greatest(0.15, ln(((SELECT count(*) FROM documents) + 1) / (df + 1))), 6) AS idf FROM d""")
def idf_terms(spark, sf):
    docs = table(spark, sf, "documents")
    d = docs.select("doc_id", F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").cast("double").alias("n")))
    return d.crossJoin(n).select("term", "df", r6(fn.idf(F.col("n"), F.col("df"))).alias("idf"))


@query(f"""WITH {_bm25_sql()}, s AS (SELECT id, least(10, score) + CASE WHEN contains(lower(text), 'ment') THEN 3 ELSE 0 END AS s, lang FROM hits JOIN documents ON id = doc_id)
SELECT id, round(s * CASE lang WHEN 'en' THEN 1.0 ELSE 0.85 END, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 50""")
def search_score(spark, sf):
    """The fifty best by capped BM25, coverage and a prior by language."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    s = _bm25(spark, sf).join(d, "id").withColumn("s", F.least(F.lit(10.0), "score") + F.when(F.lower("text").contains("ment"), 3).otherwise(0))
    return s.select("id", r6(F.col("s") * F.when(F.col("lang") == "en", 1.0).otherwise(0.85)).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("""SELECT p_partkey, p_name, p_brand FROM (SELECT *, CASE WHEN p_name = 'red widget' THEN 8 ELSE 0 END + CASE WHEN ends_with(p_name, 'widget') THEN 3 ELSE 0 END - CASE WHEN p_size > 40 THEN 4 ELSE 0 END AS s FROM part WHERE lower(p_name) LIKE '%widget')
ORDER BY s DESC, p_retailprice DESC, p_partkey LIMIT 8""")
def find_preferred(spark, sf):
    name = F.col("p_name")
    s = F.when(name == "red widget", 8).otherwise(0) + F.when(name.endswith("widget"), 3).otherwise(0) - F.when(F.col("p_size") > 40, 4).otherwise(0)
    return table(spark, sf, "part").where(F.lower(name).endswith("widget")).orderBy(s.desc(), F.desc("p_retailprice"), "p_partkey").limit(8).select("p_partkey", "p_name", "p_brand")


@query("SELECT sha1(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def near_exact_duplicates(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha1("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    query_vec = v.where("id = 0").first()
    if query_vec is None:
        return v.select("id", F.lit(0.0).alias("score")).limit(0)
    return retrieval.cosine_topk(v, list(query_vec.vec), 10).select("id", r6(F.col("score")).alias("score"))


@query(f"""SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) <= 10""")
def cosine_topk_batch(spark, sf):
    """Ten neighbours of every twentieth vector among all."""
    v = _vectors(spark, sf)
    return retrieval.cosine_topk_batch(v, v.where("id % 20 = 0"), 10).select("query", "id", r6(F.col("score")).alias("score"))


@query(f"""WITH t AS (SELECT a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) <= 10) SELECT la AS label, round(avg(CAST(la = lb AS INT)), 6) AS precision FROM t GROUP BY 1""")
def semantic_recall_by_label(spark, sf):
    v = _vectors(spark, sf)
    hits = retrieval.cosine_topk_batch(v, v.where("id % 20 = 0"), 10)
    a, b = v.select(F.col("id").alias("query"), F.col("label").alias("la")), v.select("id", F.col("label").alias("lb"))
    return hits.join(a, "query").join(b, "id").groupBy(F.col("la").alias("label")).agg(r6(F.avg((F.col("la") == F.col("lb")).cast("int"))).alias("precision"))


@query(f"""WITH {_bm25_sql()}, l AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM hits QUALIFY r <= 40),
s AS (SELECT b.vec_id AS id, row_number() OVER (ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id = 0 QUALIFY r <= 40)
SELECT coalesce(l.id, s.id) AS id, round(10 * (coalesce(1.0 / l.r, 0) + coalesce(0.8 / s.r, 0)), 6) AS score FROM l FULL JOIN s ON l.id = s.id""")
def rrf_fusion(spark, sf):
    """Forty lexical and forty semantic hits fused by reciprocal rank."""
    rank = lambda d: d.withColumn("s", F.round("score", 9)).orderBy(F.desc("s"), "id").limit(40).select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("rank"))
    v = _vectors(spark, sf)
    q = v.where("id = 0").first()
    semantic = retrieval.cosine_topk(v, list(q.vec), 60) if q else v.select("id", F.lit(0.0).alias("score")).limit(0)
    return retrieval.fuse(rank(_bm25(spark, sf)), rank(semantic)).select("id", r6(F.col("score")).alias("score"))


# Graph algorithms


def _pagerank_sql(rounds: int, restart: bool, edges: str = "whole") -> str:
    share = "CASE WHEN id = 'nation:0' THEN 1.0 ELSE 0.0 END" if restart else "1.0 / (SELECT count(*) FROM nation)"
    out = [f"b AS (SELECT id, {share} AS share, EXISTS (SELECT 1 FROM {edges} e WHERE e.src = x.id) AS has_out FROM (SELECT 'nation:' || n_nationkey AS id FROM nation) x)", f"p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM {edges})", "k0 AS (SELECT id, share AS rank FROM b)"]
    for i in range(rounds):
        out.append(f"k{i + 1} AS (SELECT b.id, 0.15 * share + 0.85 * (coalesce(m, 0) + share * (SELECT coalesce(sum(rank), 0) FROM k{i} JOIN b USING (id) WHERE NOT has_out)) AS rank FROM b LEFT JOIN (SELECT dst, sum(rank * p) AS m FROM p JOIN k{i} ON k{i}.id = p.src GROUP BY 1) z ON z.dst = b.id)")
    return ", ".join(out) + f" SELECT id, round(rank, 6) AS rank FROM k{rounds}"


def _nations(spark, sf):
    return table(spark, sf, "nation").select(og.ident("nation", F.col("n_nationkey")).alias("id"))


@query(f"WITH {og.TRADE_SQL}, {og.WHOLE_SQL}, {_pagerank_sql(10, False)}")
def pagerank_k10(spark, sf):
    ranks = graph.pagerank(_nations(spark, sf), og.whole_trade(og.trade_edges(spark, sf)), rounds=10, tolerance=None)
    return ranks.select("id", r6(F.col("rank")).alias("rank"))


@query(f"WITH {og.TRADE_SQL}, {og.WHOLE_SQL}, two AS (SELECT src, dst, weight FROM whole UNION ALL SELECT dst, src, weight * 0.7 FROM whole), m AS (SELECT src, dst, sum(weight) AS weight FROM two GROUP BY 1, 2), {_pagerank_sql(10, True, 'm')}")
def ppr_k10(spark, sf):
    """Ranks of a walk that restarts at one nation, along edges of either direction."""
    start = spark.createDataFrame([("nation:0", 1.0)], "id string, share double")
    ranks = graph.pagerank(_nations(spark, sf), graph.both_ways(og.whole_trade(og.trade_edges(spark, sf))), rounds=10, tolerance=None, restart=start)
    return ranks.select("id", r6(F.col("rank")).alias("rank"))


def _orders_pagerank_sql(rounds: int) -> str:
    out = [
        "e AS (SELECT src, dst, kind FROM edges WHERE src <> dst UNION ALL SELECT parent, id, 'contains' FROM nodes WHERE parent IS NOT NULL)",
        "g AS (SELECT src, dst, sum(CASE e.kind WHEN 'calls' THEN 1.0 WHEN 'references' THEN 0.5 WHEN 'imports' THEN 0.3 ELSE 0.15 END)::DOUBLE AS w FROM e SEMI JOIN nodes a ON e.src = a.id SEMI JOIN nodes b ON e.dst = b.id GROUP BY 1, 2)",
        "p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM g)",
        "b AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS share, id IN (SELECT src FROM p) AS has_out FROM nodes)",
        "k0 AS MATERIALIZED (SELECT id, share AS rank FROM b)",
    ]
    for i in range(rounds):
        out.append(f"d{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS d FROM k{i} JOIN b USING (id) WHERE NOT has_out), m{i} AS MATERIALIZED (SELECT dst AS id, sum(rank * p) AS m FROM p JOIN k{i} ON k{i}.id = p.src GROUP BY 1)")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT b.id, 0.15 * share + 0.85 * (coalesce(m, 0) + share * d) AS rank FROM b LEFT JOIN m{i} USING (id) CROSS JOIN d{i})")
    return ", ".join(out) + f" SELECT id, round(rank * (SELECT count(*) FROM nodes), 6) AS rank FROM k{rounds}"


@query(f"WITH {og.NODES_SQL}, {og.EDGES_SQL}, {_orders_pagerank_sql(10)}")
def pagerank_orders_k10(spark, sf):
    """Ranks over the orders graph, an edge for each lineitem, times the number of nodes."""
    nodes = og.order_nodes(spark, sf)
    ranks = graph.pagerank(nodes, graph.load(nodes, og.order_edges(spark, sf), ends=og.order_edges(spark, sf, repeated=True)), rounds=10, tolerance=None)
    return ranks.select("id", r6(F.col("rank") * nodes.count()).alias("rank"))


@query(f"""WITH {og.EDGES_SQL}, b AS (SELECT dst, src, max(CASE kind WHEN 'calls' THEN 1.0 WHEN 'references' THEN 0.5 ELSE 0.3 END) AS w FROM edges GROUP BY 1, 2),
d1 AS (SELECT src AS id, 1 AS depth, max(w) AS score FROM b WHERE dst = 'part:1' GROUP BY 1),
d2 AS (SELECT src AS id, 2 AS depth, max(score * w * 0.6) AS score FROM b JOIN d1 ON b.dst = d1.id WHERE src <> 'part:1' AND src NOT IN (SELECT id FROM d1) GROUP BY 1),
d3 AS (SELECT src AS id, 3 AS depth, max(score * w * 0.6) AS score FROM b JOIN d2 ON b.dst = d2.id WHERE src <> 'part:1' AND src NOT IN (SELECT id FROM d1 UNION SELECT id FROM d2) GROUP BY 1)
SELECT id, depth, round(score, 6) AS score FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)""")
def impact_depth3(spark, sf):
    """What depends on a part, three steps back."""
    e = og.order_edges(spark, sf, repeated=True).withColumn("weight", graph.by_kind(F.col("kind"), graph.WEIGHTS, 0.3))
    roots = spark.createDataFrame([("part:1", 1.0)], "id string, score double")
    return graph.impact(e, roots).select("id", "depth", r6(F.col("score")).alias("score"))


@query(f"""WITH RECURSIVE {og.NODES_SQL}, c AS (SELECT id AS child, parent AS ancestor, 1 AS depth FROM nodes WHERE parent IS NOT NULL
UNION ALL SELECT c.child, n.parent, c.depth + 1 FROM c JOIN nodes n ON c.ancestor = n.id WHERE n.parent IS NOT NULL AND c.depth < 6) SELECT child, ancestor, depth FROM c""")
def closure_containment(spark, sf):
    n = og.order_nodes(spark, sf).where("parent IS NOT NULL")
    return graph.closure(n.select(F.col("id").alias("child"), "parent"))


@query(f"""WITH RECURSIVE {og.TRADE_SQL}, {og.SPARSE_SQL}, r AS (SELECT src AS a, dst AS b FROM sparse UNION SELECT r.a, s.dst FROM r JOIN sparse s ON r.b = s.src)
SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1""")
def scc_trade(spark, sf):
    """Nations on cycles of their largest flows."""
    return graph.scc(og.sparse_trade(og.trade_edges(spark, sf)))


def _paths_sql(rounds: int) -> str:
    out = ["q AS (SELECT src, dst, round(1 + 100 / weight, 6) AS c FROM sparse)", "s0 AS (SELECT 'nation:0' AS id, 0.0::DOUBLE AS cost, 0 AS hops)"]
    for i in range(rounds):
        out.append(f"s{i + 1} AS (SELECT id, cost, hops FROM (SELECT * FROM s{i} UNION ALL SELECT q.dst, round(cost + c, 9), hops + 1 FROM s{i} JOIN q ON q.src = s{i}.id WHERE hops = {i}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, hops) = 1)")
    return ", ".join(out) + f" SELECT id, round(cost, 6) AS cost, hops FROM s{rounds}"


@query(f"WITH {og.TRADE_SQL}, {og.SPARSE_SQL}, {_paths_sql(12)}")
def shortest_path_trade(spark, sf):
    """The cheapest ways from one nation, twelve steps at most; large flows are short."""
    e = og.sparse_trade(og.trade_edges(spark, sf)).select("src", "dst", r6(1 + 100 / F.col("weight")).alias("cost"))
    return graph.shortest(e, "nation:0").select("id", r6(F.col("cost")).alias("cost"), "hops")


@query("""WITH m AS (SELECT 'c' || c_custkey AS id, 'nation:' || c_nationkey AS parent, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS doc, c_custkey AS ordinal FROM customer
UNION ALL SELECT 'r' || r_regionkey || ':' || s, 'region:' || r_regionkey, s, 'doc of ' || r_name, r_regionkey FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer)),
u AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS up FROM nation)
SELECT a.id, b.doc, b.id AS doc_from, 1 AS depth FROM m a JOIN u ON a.parent = u.child JOIN m b ON b.parent = u.up AND b.name = a.name WHERE a.doc IS NULL AND b.doc IS NOT NULL""")
def inherit_docs(spark, sf):
    """Customers without a text take that of their segment in the region."""
    c, r = table(spark, sf, "customer"), table(spark, sf, "region")
    members = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), og.ident("nation", F.col("c_nationkey")).alias("parent"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("doc"), F.col("c_custkey").alias("ordinal"))
    segments = F.broadcast(c.select(F.col("c_mktsegment").alias("s")).distinct())
    above = r.crossJoin(segments).select(F.concat(F.lit("r"), "r_regionkey", F.lit(":"), "s").alias("id"), og.ident("region", F.col("r_regionkey")).alias("parent"), F.col("s").alias("name"), F.concat(F.lit("doc of "), "r_name").alias("doc"), F.col("r_regionkey").cast("long").alias("ordinal"))
    supers = table(spark, sf, "nation").select(og.ident("nation", F.col("n_nationkey")).alias("child"), og.ident("region", F.col("n_regionkey")).alias("parent"))
    return graph.inherit_docs(stored(members.union(above), "members"), supers)


@query()
def louvain_trade(spark, sf):
    """Communities of nations by modularity."""
    return graph.louvain(og.whole_trade(og.trade_edges(spark, sf)))


@query()
def label_propagation_trade(spark, sf):
    return graph.label_propagation(og.whole_trade(og.trade_edges(spark, sf)))


@query(f"""WITH {_bm25_sql()}, r AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM hits QUALIFY rank <= 25), t AS (SELECT id, rank, CAST(ceil(length(text) / 3.2) AS BIGINT) AS tokens FROM r JOIN documents ON id = doc_id),
u AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM t) SELECT id, rank, tokens, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000 OR rank = 1""")
def explore_pack(spark, sf):
    """The best documents for a question that fit 4000 tokens; 25 rows are windowed."""
    top = _bm25(spark, sf).withColumn("s", F.round("score", 9)).orderBy(F.desc("s"), "id").limit(25)
    ranked = top.select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).cast("long").alias("rank"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), fn.est_tokens(F.col("text")).cast("long").alias("tokens"))
    return retrieval.pack(d.join(F.broadcast(ranked), "id"), 4000).select("id", "rank", "tokens", "used")


@query("""SELECT page_id, CAST(used AS BIGINT) AS used FROM (SELECT page_id, sum(strlen(html)) OVER (ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM pages ORDER BY page_id DESC LIMIT 5000)) WHERE used <= 500000""")
def viz_budget(spark, sf):
    """The latest pages whose bodies fit a budget; 5000 rows are windowed."""
    p = table(spark, sf, "pages").select("page_id", F.octet_length("html").alias("size")).orderBy(F.desc("page_id")).limit(5000)
    used = F.sum("size").over(Window.orderBy(F.desc("page_id")).rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("used", used).where("used <= 500000").select("page_id", "used")


@query("""SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal, lag(turn) OVER w AS parent, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_threads(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.lag("turn").over(w).alias("parent"), F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_user"))


@query(f"""WITH {og.EDGES_SQL}, e AS (SELECT src, dst, kind, line FROM edges WHERE kind IN ('calls', 'references') AND src <> dst), d1 AS (SELECT *, 1 AS depth FROM e WHERE dst = 'part:1'),
f AS (SELECT DISTINCT src FROM d1 WHERE src <> 'part:1') SELECT * FROM d1 UNION ALL SELECT e.*, 2 FROM e JOIN f ON e.dst = f.src""")
def callers_transitive(spark, sf):
    """Sites that call a part, and those that refer to the callers."""
    return graph.callers_transitive(og.order_edges(spark, sf), ["part:1"], depth=2)


@query("""WITH RECURSIVE u AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS ancestor FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
c AS (SELECT ancestor, child, 1 AS depth FROM u UNION ALL SELECT c.ancestor, u.child, c.depth + 1 FROM c JOIN u ON u.ancestor = c.child) SELECT ancestor, child, depth FROM c""")
def descendant_closure(spark, sf):
    """Everything below each region and nation."""
    n = table(spark, sf, "nation").select(og.ident("nation", F.col("n_nationkey")).alias("child"), og.ident("region", F.col("n_regionkey")).alias("parent"))
    c = table(spark, sf, "customer").select(og.ident("customer", F.col("c_custkey")), og.ident("nation", F.col("c_nationkey")))
    return graph.descendants(n.union(c))


@query("""WITH m AS (SELECT c_nationkey AS community, c_custkey AS id, c_acctbal AS rank, c_mktsegment AS dir, c_acctbal < 3000 AS aside FROM customer),
t AS (SELECT community, string_agg(id, ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY rank DESC, id) AS k FROM m) WHERE k <= 5 GROUP BY 1),
d AS (SELECT community, string_agg(dir, ',' ORDER BY n DESC, dir) AS dirs FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, dir) AS k FROM (SELECT community, dir, count(*) AS n FROM m GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1)
SELECT community, count(*) AS size, any_value(top) AS top_symbols, any_value(dirs) AS dirs, avg(CAST(aside AS INT)) > 0.5 AS peripheral FROM m JOIN t USING (community) JOIN d USING (community) GROUP BY 1""")
def community_report(spark, sf):
    """Size, leading customers, segments and share of small accounts of each nation."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("rank"), F.col("c_mktsegment").alias("dir"), (F.col("c_acctbal") < 3000).alias("aside"))
    r = graph.community_report(c)
    return r.withColumn("top_symbols", F.array_join(F.col("top_symbols").cast("array<string>"), ",")).withColumn("dirs", F.array_join("dirs", ","))


@query("SELECT o_orderpriority AS kind, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS fraction FROM orders GROUP BY 1")
def fraction_by_kind(spark, sf):
    """Share of finished orders by priority."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), r6(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("fraction"))


@query(r"""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS fqn, 'lib/' || p_brand || '/' || p_type AS file, p_type AS signature,
  trim(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM part)
SELECT id, concat_ws('. ', 'function ' || name, CASE WHEN words <> lower(name) THEN words END, CASE WHEN signature <> name THEN substr(trim(regexp_replace(signature, '\s+', ' ', 'g')), 1, 240) END, 'in Shop', array_to_string(string_split(file, '/')[-3:], '/')) AS text FROM s""")
def symbol_text(spark, sf):
    """Parts as symbols: what would be embedded of each."""
    p = table(spark, sf, "part")
    file = F.concat(F.lit("lib/"), "p_brand", F.lit("/"), "p_type")
    return p.select(F.col("p_partkey").alias("id"), fn.symbol_text(F.lit("function"), F.col("p_name"), F.concat("p_brand", F.lit("."), "p_name"), file, F.col("p_type"), F.lit(""), F.lit("Shop")).alias("text"))


def part_symbols(spark, sf):
    """Parts as symbols to search, and their calls as metrics."""
    p = table(spark, sf, "part")
    s = p.select(og.ident("part", F.col("p_partkey")).alias("id"), F.when(F.col("p_size") % 3 == 0, "class").otherwise("function").alias("kind"), F.translate("p_name", " ", "_").alias("name"), F.concat_ws(".", "p_brand", F.translate("p_name", " ", "_")).alias("fqn"), F.col("p_type").alias("signature"), F.when(F.col("p_size") > 25, F.concat(F.lit("the "), "p_name")).otherwise("").alias("doc"), F.concat(F.when(F.col("p_size") % 5 == 0, "docs/").otherwise("src/"), "p_brand", F.lit("/x.py")).alias("file"), (F.col("p_size") % 7 == 0).alias("is_test"), (F.col("p_size") % 2 == 0).alias("exported"), F.lit(False).alias("reopened"), F.lit(False).alias("inherited"), F.lit(None).cast("string").alias("parent"))
    calls = table(spark, sf, "lineitem").groupBy(og.ident("part", F.col("l_partkey")).alias("id")).agg(F.count("*").alias("callers"), F.sum("l_quantity").alias("pagerank"))
    return s, calls


@query()
def symbol_search(spark, sf):
    """The twenty parts that a question in words finds best."""
    return search.search(*part_symbols(spark, sf), "how are the small rings packed", limit=20).select("id", r6(F.col("score")).alias("score"))


@query(r"""WITH s AS (SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 1.3 ELSE 1.15 END * 3 + CASE WHEN p_size % 7 = 0 THEN -100 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 3 ELSE 0 END AS points,
  CASE WHEN p_size % 5 = 0 THEN 'docs/' ELSE 'src/' END || p_brand || '/x.py' AS file, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = p_partkey), 0) AS pr FROM part WHERE replace(p_name, ' ', '_') = 'small_ring')
SELECT id, CAST(row_number() OVER (ORDER BY points DESC, pr DESC, file, id) AS INT) AS place FROM s ORDER BY points DESC, pr DESC, file, id LIMIT 8""")
def find_symbol(spark, sf):
    """The eight parts most likely meant by a name that many have."""
    return search.find_symbols(*part_symbols(spark, sf), "small_ring")


# Source code: a small repository whose symbols and edges are told by hand


def _records(spark):
    from orbweft.session import ship
    from orbweft.sources.extract import extracted

    ship(spark)
    return stored(extracted(spark.createDataFrame(list(sample.FILES.items()), "path string, text string")), "records")


@query(sample.values(sample.SYMBOLS, "id, kind, start_line, end_line"))
def code_symbols(spark, sf):
    """Definitions of the sample repository."""
    from orbweft.sources import ir

    return ir.symbols(_records(spark)).where("kind <> 'module'").select("id", "kind", F.col("start_line").cast("int"), F.col("end_line").cast("int"))


@query(sample.values(sample.EDGES, "src, dst, kind, resolver, confidence"))
def code_edges(spark, sf):
    """References of the sample repository, resolved."""
    from orbweft.operators import resolve
    from orbweft.sources import ir

    records = _records(spark)
    imports = resolve.import_targets(ir.imports(records), records.select("path"))
    edges, _ = resolve.resolve(ir.references(records), ir.symbols(records), imports, ir.local_types(records))
    return edges.select("src", "dst", "kind", "resolver", "confidence").distinct()
