"""Relational operators that maintain and query the graph's tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweft.session import stored


def changes(known: DataFrame, listed: DataFrame, key: str, size: str, mark: str) -> DataFrame:
    """key, state of a listing against what is known: new, deleted, same, touched (equal hash) or changed."""
    a = known.select(F.col(key), F.col(size).alias("size_a"), F.col(mark).alias("mark_a"), F.lit(True).alias("in_a"))
    b = listed.select(F.col(key), F.col(size).alias("size_b"), F.col(mark).alias("mark_b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "deleted").when(F.col("mark_a") != F.col("mark_b"), "changed").when(F.col("size_a") != F.col("size_b"), "touched").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def upserted(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """base with every key of batch replaced by batch's rows."""
    return base.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and columns of each key's last row; one aggregation, combined before the shuffle."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in columns])


def innermost(points: DataFrame, ranges: DataFrame, *, width: int = 64) -> DataFrame:
    """point_id, range_id: the narrowest range (range_id, start, end) that overlaps each point's (from_, to_).

    Ranges are dealt into bins of the axis, so this is an equi-join whatever the ranges are. Equal points are looked up
    once, and of equal ranges only the least id can be the answer, so the join grows with the distinct ones.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    p = points.select("from_", "to_").distinct().withColumn("bin", bins(F.col("from_"), F.col("to_")))
    r = ranges.groupBy("start", "end").agg(F.min("range_id").alias("range_id")).withColumn("bin", bins(F.col("start"), F.col("end")))
    hits = p.join(r, "bin").where("start <= to_ AND end >= from_")
    best = hits.groupBy("from_", "to_").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "range_id")).alias("m"))
    return points.join(best, ["from_", "to_"]).groupBy("point_id").agg(F.min("m").alias("m")).select("point_id", "m.range_id")


def cascade(refs: DataFrame, tiers: list[tuple[DataFrame, list[str], str, float, bool]], ref: str, *, pairs: int = 4 << 20) -> DataFrame:
    """ref, target, tier, resolver, confidence: every target of the first tier that has any for the ref.

    refs hold ref and the join columns, one row each; tiers are (candidates with target and join columns, join columns,
    resolver, confidence, whether a ref may be its own target) in order; a tier may bind several targets. A tier looks
    only at refs that no earlier one has bound, which the candidates' counts by key tell without listing any pair, so
    the join makes just the rows of the result. A key with more than about pairs of them is dealt over several tasks.
    """
    spark = refs.sparkSession
    left, out = stored(refs.distinct(), "refs"), None
    for k, (found, on, resolver, confidence, own) in enumerate(tiers):
        keys = [F.col(c).isNotNull() for c in on]
        found = stored(found.where(reduce(and_, keys)).select(*on, "target").where("target IS NOT NULL").distinct(), "targets")
        counts = found.groupBy(*on).agg(F.count("*").alias("m"), F.min("target").alias("only"))
        bound = left.join(counts, on).where(F.lit(True) if own else (F.col("m") > 1) | (F.col("only") != F.col(ref)))
        bound = stored(bound.select(ref, *on), "bound")
        many = bound.groupBy(*on).agg(F.count("*").alias("n")).join(counts.select(*on, "m"), on)
        many = stored(many.select(*on, F.ceil(F.col("n") * F.col("m") / pairs).cast("int").alias("shares"), (F.col("n") * F.col("m")).alias("pairs")), "many")
        total = many.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        if total:
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // pairs))  # few rows, many pairs: not to be coalesced
            share = F.pmod(F.xxhash64(ref), F.col("shares")).cast("int").alias("share")
            mine = bound.join(many, on).select(ref, *on, share).repartition(n, *on, "share")
            theirs = found.join(many, on).select("target", *on, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).repartition(n, *on, "share")
            part = mine.join(theirs, [*on, "share"])
            part = part if own else part.where(F.col(ref) != F.col("target"))
            part = part.select(ref, "target", F.lit(k).alias("tier"), F.lit(resolver).alias("resolver"), F.lit(confidence).alias("confidence"))
            out = part if out is None else out.union(part)
            left = stored(left.join(bound.select(ref), ref, "left_anti"), "refs")
            if left.isEmpty():
                break
    if out is None:
        target = tiers[0][0].select("target") if tiers else refs.select(F.col(ref).alias("target"))
        out = refs.select(ref).limit(0).join(target, F.lit(False)).select(ref, "target", F.lit(0).alias("tier"), F.lit("").alias("resolver"), F.lit(0.0).alias("confidence"))
    return out


def sessions(events: DataFrame, key: str, ts: str, tie: str, *, gap_us: int, most_us: int) -> DataFrame:
    """key, session, start_us, end_us, n: bursts that end after a quiet gap, or where the next event is more than most_us
    after the first; that event begins the next burst, as in streaming.maintain.debounced.

    Where a burst begins depends on the one before, so a key's events pass through one task in order; it holds one burst.
    """
    import pyarrow as pa

    own = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie")).where("t IS NOT NULL")
    schema = pa.schema([("session", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n", pa.int64())])

    def run(batches):
        at, number, first, last, n = None, 0, 0, 0, 0
        for b in batches:
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n and (k != at or t - last > gap_us or t - first > most_us):
                    keys.append(at)
                    rows.append((number, first, last, n))
                    number, first, n = number + 1, t, 0
                if not n:
                    first = t
                if k != at or number == 0:
                    at, number = k, 1
                last, n = t, n + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["key", *schema.names])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), *(pa.array([c], pa.int64()) for c in (number, first, last, n))], ["key", *schema.names])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(own.schema["key"].dataType)
    out = own.select("key").schema.add("session", "long").add("start_us", "long").add("end_us", "long").add("n", "long")
    done = own.repartition("key").sortWithinPartitions("key", "t", "tie").select("key", "t").mapInArrow(run, out)
    return done.withColumnRenamed("key", key)


def floor_sample(rows: DataFrame, group: str, score: str, id_col: str, *, floor: int, total: int) -> DataFrame:
    """The best floor rows of each group, filled up to total by the best of the rest."""
    own = Window.partitionBy(group).orderBy(F.desc(score), id_col)
    ranked = rows.withColumn("k", F.row_number().over(own)).withColumn("must", F.col("k") <= floor)
    return ranked.orderBy(F.desc("must"), F.desc(score), id_col).limit(total).drop("k", "must")
