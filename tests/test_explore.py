import pytest
from hypothesis import given
from hypothesis import strategies as st

from orbweft.plans import explore


@pytest.mark.parametrize(
    ("question", "kind", "names"),
    [
        ("Who calls build_item?", "callers", ["build_item"]),
        ("where is `Store.save` used", "callers", ["Store.save"]),
        ("what breaks if I change Item?", "impact", ["Item"]),
        ("path from main to save", "path", ["main", "save"]),
        ("Where is Item defined?", "define", ["Item"]),
        ("How are imports resolved across files?", "explore", ["import", "resolv", "acros", "fil"]),
    ],
)
def test_intents(question, kind, names):
    got = explore.detect_intent(question)
    assert got.kind == kind and (got.names == names or kind == "explore")


@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 4000)), max_size=60), st.integers(50, 3000))
def test_pack_stays_within_the_hard_limit(sizes, budget):
    ranked = [{"id": str(i), "head": "h" * a, "body": "b" * b} for i, (a, b) in enumerate(sizes)]
    got, left = explore.pack(ranked, budget)
    assert len(got) + left == len(ranked) and len(got) <= explore.MOST
    assert sum(len(g["text"]) / 3.2 for g in got) <= explore.HARD * budget + len(got)
    assert [g["id"] for g in got] == [str(i) for i in range(len(got))]


def test_hoist():
    parent = {"C.m": "C", "C.k": "C"}
    assert explore.hoist(["C", "x", "C.m"], parent, {"x": 0, "C.m": 1, "C": 2}) == ["C.m", "C", "x"]
    assert explore.hoist(["C", "x", "C.m"], parent, {"C": 0, "x": 1, "C.m": 2}) == ["C", "x", "C.m"]
    assert explore.hoist(["C", "C.k", "C.m"], parent, {"C.m": 0, "C.k": 1, "C": 2}) == ["C.m", "C", "C.k"]
    assert explore.hoist(["C", "C.m"], parent, {}) == ["C.m", "C"]
    assert explore.hoist(["a", "b"], {}, {"a": 0, "b": 1}) == ["a", "b"]
