from orbweft.sources import scip


def num(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def part(field, value):
    if isinstance(value, int):
        return num(field << 3) + num(value)
    value = value.encode() if isinstance(value, str) else value
    return num(field << 3 | 2) + num(len(value)) + value


def occurrence(line, symbol, roles=0):
    return part(2, part(1, b"".join(num(x) for x in (line, 0, 9))) + part(2, symbol) + (part(3, roles) if roles else b""))


F1, G1 = "scip-x npm pkg 1.0 `a.py`/f().", "scip-x npm pkg 1.0 `a.py`/G#run()."
INDEX = part(1, part(3, "root")) + part(2, part(1, "a.py") + occurrence(0, F1, 1) + occurrence(3, G1, 1) + occurrence(4, F1) + part(3, part(1, F1) + part(6, "f")))


def test_read(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(INDEX)
    got = {(r.path, r.display, r.is_definition, r.line) for r in scip.read(spark, str(tmp_path / "index.scip")).collect()}
    assert got == {("a.py", "f", True, 1), ("a.py", "run", True, 4), ("a.py", "f", False, 5)}


def test_descriptors():
    assert scip.descriptors(G1) == [("a.py", "namespace"), ("G", "type"), ("run", "method")]
    assert scip.descriptors("local 3") == []


def test_merge_replaces_and_is_idempotent(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(INDEX)
    o = scip.read(spark, str(tmp_path / "index.scip"))
    s = spark.createDataFrame([("a.py", "a.py", "a", "module", 1, 1), ("a.py", "a.py::f", "f", "function", 1, 2), ("a.py", "a.py::G.run", "run", "method", 4, 6)], "file string, id string, name string, kind string, start_line int, end_line int")
    e = spark.createDataFrame([("a.py::G.run", "other", "calls", "a.py", 5, "heuristic", 0.5), ("x", "y", "calls", "z", 1, "unique", 0.7)], "src string, dst string, kind string, file string, line int, resolver string, confidence double")
    once = scip.merged(e, s, o)
    want = {("a.py::G.run", "a.py::f", "scip", 1.0), ("x", "y", "unique", 0.7)}
    assert {(r.src, r.dst, r.resolver, r.confidence) for r in once.collect()} == want
    assert {(r.src, r.dst, r.resolver, r.confidence) for r in scip.merged(once, s, o).collect()} == want
