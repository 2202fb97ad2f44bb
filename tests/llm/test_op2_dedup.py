import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweft.llm import dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 500, 20000])
def test_filter_has_no_false_negative_and_few_positives(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    f = dedup.FuseFilter.build(keys)
    assert f.holds(keys).all()
    assert f.holds(np.random.default_rng(99).integers(0, 2**63, 50000, dtype=np.uint64)).mean() < 0.01


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    out = []
    for i, t in rows:
        text = (t or "").translate(low)
        ids = groups[text]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_plain_grouping(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100000), (8, "X" * 100000), (None, "ab"), (None, "alone"), (9, "z"), (9, "z"), (10, "q")]
    rows += [(i, f"copy {i % 7}") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("n", F.lit(0))
    got = sorted((tuple(r) for r in dedup.deduplicated(df, dedup.later_half(F.col("doc_id"))).collect()), key=str)
    assert got == plain(rows)
    assert dedup.deduplicated(df.limit(0), dedup.later_half(F.col("doc_id"))).count() == 0


def test_all_old_or_all_new(spark):
    rows = [(i, f"t{i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for incoming in (F.lit(True), F.lit(False)):
        assert sorted((tuple(r) for r in dedup.deduplicated(df, incoming).collect()), key=str) == plain(rows)


def test_kept_leaves_one_row_a_text(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "A", "s"), (3, "b", "s"), (3, "b", "t"), (None, "c", "s")], "doc_id long, text string, row string")
    got = dedup.kept(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.where("doc_id IS NOT NULL").collect()) == [(2, "A"), (3, "b")] and got.count() == 3


def test_kept_by_broadcast_and_by_shuffle(spark):
    rows = [(1, "a", {"k": 1}), (1, "a", {"k": 2}), (2, "b", None), (3, "B", None), (None, "b", None), (4, None, None), (5, "", None), (None, "z", None), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").selectExpr("*", "'x' AS digest", "1 AS n", "2 AS id", "3 AS row")
    for limit in (0, 100):
        got = sorted(((r.doc_id, r.text, r.m) for r in dedup.kept(df, limit).collect()), key=str)
        assert got == sorted([(1, "a", {"k": 1}), (3, "B", None), (5, "", None), (None, "z", None)], key=str)
        full = dedup.deduplicated(df, dedup.later_half(F.col("doc_id")), limit=limit).collect()
        assert len(full) == 9 and sum(r.kept for r in full) == 6


def test_snapshots_are_saved_and_several_are_met(spark, tmp_path):
    old = [spark.createDataFrame([(i, f"text {i % 40}") for i in range(k, k + 60)], "doc_id long, text string") for k in (0, 1000)]
    for k, df in enumerate(old):
        dedup.snapshot(dedup.keyed(df), 4 + k).save(f"{tmp_path}/{k}")
    snaps = [dedup.Snapshot.load(spark, f"{tmp_path}/{k}") for k in range(2)]
    assert [s.buckets for s in snaps] == [4, 5]
    new = spark.createDataFrame([(2000, "TEXT 3"), (2001, "new"), (2002, "new"), (5, "text 7")], "doc_id long, text string")
    got = {(r.keep_id, r.n) for r in dedup.against(dedup.grouped(dedup.keyed(new), 4), snaps).collect()}
    every = [*((i, f"text {i % 40}") for k in (0, 1000) for i in range(k, k + 60)), (2000, "text 3"), (5, "text 7")]
    want = {(max(i for i, t in every if t == x), sum(t == x for _, t in every)) for x in ("text 3", "text 7")} | {(2002, 2)}
    assert got == want
