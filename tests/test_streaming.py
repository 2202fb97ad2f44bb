import datetime as dt

from orbweft.streaming import maintain


def test_upserts_equal_the_last_version(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "table")
    schema = "file string, text string, version long"
    for k, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = maintain.upsert_stream(stream, spark, base, "file").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, k
    assert {(r.file, r.text) for r in maintain.current(spark, base).collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    assert maintain.current(spark, base).columns == ["file", "text", "version"]


def test_only_touched_parts_are_written(spark, tmp_path):
    src, base = tmp_path / "in", tmp_path / "table"
    for k in range(4):
        rows = [(f"f{i}", str(k)) for i in range(40 if k == 0 else 2)]
        spark.createDataFrame(rows, "file string, text string").coalesce(1).write.mode("append").parquet(str(src))
        q = maintain.upsert_stream(spark.readStream.schema("file string, text string").parquet(str(src)), spark, str(base), "file", parts=8).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    sizes = {v.name: len(list(v.glob("__part=*"))) for v in base.glob("v[0-9]*")}
    assert sizes["v0"] <= 8 and sizes["v3"] <= 2 and sum(sizes.values()) <= 12
    assert {r.file: r.text for r in maintain.current(spark, str(base)).collect()} == {f"f{i}": "3" if i < 2 else "0" for i in range(40)}


def test_debounce(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    rows = [("a", at(0)), ("a", at(100)), ("a", at(300)), ("a", at(1200)), ("a", at(60000)), ("b", at(10))] + [("c", at(300 * i)) for i in range(9)]
    spark.createDataFrame(rows, "file string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, at timestamp").parquet(str(tmp_path / "in"))
    q = maintain.debounced(stream, "file", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    base = int(t0.timestamp() * 1000)
    got = {(r.file, r.start_ms - base, r.n) for r in spark.table("bursts").collect()}
    assert {("a", 0, 3), ("a", 1200, 1), ("c", 0, 7)} <= got and all(r[2] <= 7 for r in got)


def test_affected(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    got = maintain.affected(f([("a.py",)], "file string"), f([("d.py",)], "file string"), f([("e.py", "d.py::x"), ("z.py", "q.py::x")], "file string, dst string"), f([("i.py", "a.py"), ("d.py", "a.py")], "file string, resolved string"), f([("u.py", "New"), ("v.py", "Old")], "file string, name string"), f([("New",)], "name string"))
    assert {r.file for r in got.collect()} == {"a.py", "e.py", "i.py", "u.py"}


def test_deferral():
    assert maintain.analysis_due(5, 10, True) == (False, 15) and maintain.analysis_due(5, 48, True) == (True, 0) and maintain.analysis_due(30, 0, True) == (True, 0) and maintain.analysis_due(1, 0, False) == (True, 0)
