import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweft.llm import jaccard as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))), key=str)


def ours(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.joined(df).collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aAb É\t\n\x0b.ñ", max_size=40), max_size=6))
def test_sets_have_the_right_sizes(texts):
    import pyarrow as pa

    got = list(J.column_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    by = {}
    for t, s in zip(texts, got, strict=True):
        assert by.setdefault(J.class_of(s), shingles(t)) == shingles(t)


@settings(max_examples=200, deadline=None)
@given(st.text("aAb É\t\n.", max_size=80), st.integers(1, 9))
def test_long_texts_give_the_same_sets(text, step):
    import pyarrow as pa

    column = pa.array([text, None, text + " x", ""], pa.string())
    for a, b in zip(J.column_sets(column), J.column_sets(column, step), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_a_key_beyond_what_is_held_is_one_tile(spark):
    rows = spark.range(30_000).selectExpr("7L AS key", "0 AS salt", "id AS cls", "CAST(10 + id % 3 AS INT) AS n")
    more = spark.range(50).selectExpr("id % 5 + 8 AS key", "0 AS salt", "100000 + id AS cls", "10 AS n")
    got = J.tiles(rows.union(more), held_rows=4000).dropDuplicates(["tile", "cls"]).toPandas()
    big = got[got.cls < 30_000]
    assert big.tile.nunique() == 1 and big.cls.nunique() == 30_000
    assert sorted(got[got.cls >= 100_000].groupby("tile").size()) == [10] * 5


def test_salts_grow_with_the_postings():
    own = np.array([0, 1, 7, 8, 20], np.uint8)
    seen = np.stack([J.salt_of(own, int(c)) for c in np.random.default_rng(3).integers(-(2**62), 2**62, 4000)])
    assert [len(np.unique(x)) for x in seen.T[:4]] == [1, 1, 2, 4] and (seen[:, 0] == 0).all() and (seen[:, 1:] > 0).all()
    assert len(np.unique(seen[:, 4])) > 3000


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for n, m, k in ((10, 12, 5), (200, 240, 180), (1000, 900, 100), (65, 64, 60)):
        x = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:k], x[n : n + m - k]]))
        assert J.overlap_bound(J.bitmap(a), J.bitmap(b), len(a), len(b)) >= k


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.fixture
def corpus():
    rng = random.Random(11)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            rows.append((len(rows), " ".join(near(rng, base, rng.choice([0, 0, 1, 2, 3])))))
    for _ in range(150):  # a passage that many share
        rows.append((len(rows), " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 14, 16, 40]))])))
    rows += [(None, "a b c d e f g"), (None, "a b c d e f g"), (5000, "A b  c\td e f g"), (5001, None), (5002, ""), (5003, " \n"), (5004, "x"), (5005, "X"), (3, rows[3][1])]
    rows.append((6000, " ".join(f"v{i}" for i in range(30000))))
    rows.append((6001, " ".join(f"v{i}" for i in range(29000))))
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS cls", "2 AS root", "3 AS tile")
    assert ours(df.repartition(5)) == plain(corpus)


def test_small_levels_and_commonness(spark, corpus, monkeypatch):
    """The same with every tile in rounds and with common shingles salted."""
    monkeypatch.setattr(J, "SMALL", 1)
    monkeypatch.setattr(J, "COMMON", 4)
    assert ours(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)) == plain(corpus)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert ours(df) == [(1, 1, 1), (2, 1, 2)]
    assert ours(df.limit(0)) == []


def test_kept(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(4, text), (2, text + " more"), (7, None), (8, "other"), (None, "n")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in J.kept(df).collect()) == ["2", "7", "8", "None"]


def test_sets_are_kept_of_likely_pairs_alone(spark, monkeypatch):
    """Texts that share a passage meet in tiles; only those whose bitmaps allow a link have their sets written."""
    rng, kept = random.Random(5), []
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"u{rng.randrange(10**9)}" for _ in range(60)])) for i in range(60)]
    rows += [(100, rows[7][1] + " more"), (101, rows[7][1]), (102, None)]
    write = J.stored

    def stored(df, name, **more):
        out = write(df, name, **more)
        if "items" in out.columns:
            kept.extend(r.cls for r in out.select("cls").collect())
        return out

    monkeypatch.setattr(J, "stored", stored)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(df) == plain(rows)
    import pyarrow as pa

    likely = {J.class_of(s) for s in J.column_sets(pa.array([rows[7][1], rows[60][1]], pa.string()))}
    assert len(likely) == 2 and set(kept) == likely


def test_slots_are_found_again(spark):
    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame([(int(x),) for x in hashes[:1000]], "cls long")
    for bits in (16, J.FINE_BITS):
        got = J.among(J.slots_of(df, "cls", bits).value, hashes)
        assert got[:1000].all() and got[1000:].mean() < 1100 / (1 << bits) + 0.02
