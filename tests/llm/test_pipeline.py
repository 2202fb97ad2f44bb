import corpus_pipeline as C

from orbweft.llm import jaccard
from orbweft.session import stored, table

from .test_op4_jaccard import plain


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in C.STAGES] == ["language_id", "quality_classifier", "exact_dedup", "ngram_jaccard", "packing"]
    counts = [docs.count()]
    for _, stage in C.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.columns == before.columns
        assert docs.exceptAll(before).isEmpty()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[2] < counts[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(i == c for i, _, c in plain(rows))
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows}
    assert jaccard.joined(docs).where("doc_id <> component_id").isEmpty()


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_clashing_columns(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("*", "1 AS row", "2 AS id", "3 AS score", "'x' AS sha", "0 AS cls")
    for _, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.columns[-5:] == ["row", "id", "score", "sha", "cls"]
