import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweft.llm import language, quality
from orbweft.session import table

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = language.op3_language_svm(spark, SF).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df()
    m = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in m.doc_id]).all()
    held = m[m.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_language_edges(spark):
    rng = random.Random(2)
    words = {"en": "the and of to in is that for", "de": "der die und das ist nicht ein zu", "fr": "le la les des est une dans pour", "es": "el los las una para con por del"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(30)), k) for i, k in enumerate(list(words) * 30)]
    rows += [(None, "the and of", None), (900, None, "en"), (901, "", "fr"), (902, "123 !?", "de"), (903, "the " * 100000, None), (904, "der und das", None), (904, "der und das", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.0 AS score", "'x' AS lang_pred", "true AS held_out")
    got = language.identified(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[902].score == 0
    assert by[903].lang_pred == "en" and by[904].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out is False
    assert language.identified(df.limit(0)).count() == 0
    unlearned = language.identified(df.withColumn("lang", df.lang.substr(9, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) AS lang"))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}
    kept = language.kept(df)
    assert kept.columns == df.columns and 902 not in {r.doc_id for r in kept.collect()}


def test_margins_equal_those_of_the_shares():
    rng = np.random.default_rng(0)
    texts = ["", "ab", "Élan vital", "x" * 500, "the quick brown fox"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    m = language.Model(["a", "b"], ["a", "b"], [], rng.normal(size=(language.TERMS + 1, 2)).astype(np.float32), rng.normal(size=2))
    m.weights[-1] = 0
    want = language.shares(data, off) @ m.weights[:-1] + m.bias
    assert np.allclose(m.margins(data, off), want, atol=1e-4)


def test_quality_held_out_accuracy(spark):
    got = quality.op8_quality_neighbours(spark, SF).toPandas()
    m = got.merge(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df(), on="doc_id")
    held = m[m.held_out]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (held.predicted == held.quality).mean() > 0.93


def test_quality_edges(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (7001, ""), (7002, "a"), (7003, "!! " * 100000), (7003, "!! " * 100000)], "doc_id long, text string")).selectExpr("*", "1 AS score", "2 AS quality", "3 AS c")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    labels = labels.union(labels).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"))
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert 0 < by[7001].score < 1 and by[7001].score == by[None].score
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(docs, labels).columns == docs.columns


@pytest.mark.parametrize("texts", [["", "a", "ab", "a a a a", " lead lead", "x\ny", "Ab ab"]])
def test_counts_do_not_depend_on_the_batch(texts):
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = quality.counts(data, off)
    for i, r in enumerate(raw):
        alone = quality.counts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert (whole[i] == alone[0]).all(), texts[i]


def test_votes_are_those_of_a_plain_search(spark):
    """Each score once more, one document and one neighbour at a time; copies in the training set make ties."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    copies = docs.selectExpr("doc_id + 50000 AS doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.001", "labels").select("doc_id", "quality")
    labels = labels.union(labels.selectExpr("doc_id + 50000", "1 - quality"))
    docs = docs.union(copies)
    model = quality.train(docs, labels, ~language.held_out(F.col("doc_id"), 4, 2))
    rows = docs.collect()
    got = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    for r in rows[::7]:
        raw = (r.text or "").encode()
        c = quality.counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        q = (quality.weighted(c, model.idf) @ model.axes)[0]
        q /= max(float(np.linalg.norm(q)), 1e-12)
        alike = sorted(((-float(q @ v), k) for k, v in enumerate(model.vectors)))
        cut = alike[quality.NEIGHBOURS - 1][0]
        top = [k for s, k in alike if s < cut - 1e-6]
        tied = [k for s, k in alike if abs(s - cut) <= 1e-6]  # single precision may order these otherwise
        best = sorted(top + tied[: quality.NEIGHBOURS - len(top)])
        votes = [(max(0.0, float(q @ model.vectors[k])) ** 8 * model.weights[k], model.labels[k]) for k in best]
        total = sum(v for v, _ in votes)
        want = sum(v * y for v, y in votes) / total if total else model.prior
        slack = sum(sorted((max(0.0, float(q @ model.vectors[k])) ** 8 * model.weights[k] for k in tied), reverse=True)[: len(tied) // 2 + 1]) / total if total and len(tied) > quality.NEIGHBOURS - len(top) else 0
        assert abs(got[r.doc_id] - want) <= 1e-4 + slack


def test_ties_go_to_the_first():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [1.0, 1.0, 1.0, 1.0, 1.0], [0.1, 0.2, 0.3, 0.4, 0.5]], np.float32)
    assert [sorted(x) for x in quality.nearest(near, 2).tolist()] == [[0, 1], [0, 1], [3, 4]]


def test_rows_of_one_doc_id_are_learned_once(spark):
    df = spark.createDataFrame([(1, f"text {i}", "en") for i in range(500)] + [(2, "andere", "de")], "doc_id long, text string, lang string")
    got = language.sample(df, F.lit(True), 10, 20).collect()
    assert sorted((r.lang, r.text) for r in got) == [("de", "andere"), ("en", "text 0")]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50])
def test_long_texts_are_counted_in_slices(step):
    rng = random.Random(step)
    texts = ["abc", "aa aa aa", "  x x\nx", "É" * 40, "one two two  two Three", " ", "abcdefghijkl" * 9] + ["".join(rng.choice("aAé1 \n.ab ") for _ in range(rng.randrange(3, 120))) for _ in range(60)]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        off = np.array([0, len(data)])
        if len(data) > 2:
            assert (quality.long_counts(data, step) == quality.counts(data, off)[0]).all(), t
        assert (language.histogram(data, step) == np.bincount(language.terms(data, off), minlength=language.TERMS + 1)[:-1]).all(), t
    m = language.Model(["a", "b"], ["a", "b"], [], np.random.default_rng(0).normal(size=(language.TERMS + 1, 2)).astype(np.float32), np.zeros(2))
    m.weights[-1] = 0
    data = np.frombuffer(("word é " * 200_000).encode(), np.uint8)
    off = np.array([0, len(data)])
    assert len(data) > language.SLICE and np.allclose(m.margins(data, off), language.shares(data, off) @ m.weights[:-1] + m.bias, atol=1e-4)
    two = np.array([0, len(data), len(data)])
    assert np.allclose(m.margins(data, off)[0], m.margins(data, two)[0], atol=1e-4)


def _grown(fit) -> float:
    """MB by which this process's memory peaks while fit runs, beyond what it has before."""
    from pathlib import Path

    def kb(name):
        return int(Path("/proc/self/status").read_text().split(f"{name}:")[1].split()[0])

    Path("/proc/self/clear_refs").write_text("5")
    before = kb("VmRSS")
    fit()
    return (kb("VmHWM") - before) / 1024


def test_training_holds_its_sample_once():
    rng = np.random.default_rng(3)
    labels = sorted(["de", "en", "es", "fr"] * 400)
    x = rng.random((len(labels), language.TERMS), dtype=np.float32)  # 25 MB
    assert _grown(lambda: language.Model.fit(x, labels)) < 15
    c = rng.poisson(1.0, (quality.BAD + quality.GOOD, quality.TERMS)).astype(np.float32)  # 17 MB, as the matrix of its terms
    marks = np.repeat([0, 1], [quality.BAD, quality.GOOD])
    assert _grown(lambda: quality.Model.fit(c, marks, {0: 1, 1: 1})) < 60


def test_leading_axes_are_those_of_the_whole_decomposition():
    rng = np.random.default_rng(5)
    for n, rows in ((300, 400), (300, 20), (40, 400)):
        x = (rng.standard_normal((rows, n)) * 0.97 ** np.arange(n)).astype(np.float32)
        gram = x.T @ x
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        own = quality.leading(gram, 48)
        rank = min(48, n, rows)
        assert own.shape == (n, min(48, n)) and own.dtype == np.float32
        np.testing.assert_allclose(own.T @ own, np.eye(own.shape[1]), atol=1e-4)
        np.testing.assert_allclose(np.square(x @ own).sum(), values[::-1][:rank].sum(), rtol=1e-4)
        assert np.abs(np.linalg.svd(vectors[:, ::-1][:, :rank].T @ own)[1][:rank] - 1).max() < 1e-2
