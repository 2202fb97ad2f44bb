from pyspark.sql import functions as F

from orbweft.llm import language
from orbweft.session import table


def test_short_clean_documents_stay(spark, sf):
    short = [(9_000_001 + i, t, None) for i, t in enumerate(["Hi", "Yes.", "No", "Okay", "Go", "q", "Guten Tag", "A cat"])] + [(9_000_100, "123 !?", None)]
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(short, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language.kept(docs).collect()}
    assert {i for i, t, _ in short if i != 9_000_100} <= kept and 9_000_100 not in kept


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)}{chr(0x4E02 + 7 * k)} " * 9, f"x{k:02}") for k in range(70) for i in range(3 if k else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = {f"x{k:02}" for k in range(70)}
    model = language.train(docs, F.lit(True))
    assert set(model.languages) == every
    got = language.predictions(docs, model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(rows)
    few = language.sample(docs, F.lit(True), total=70).collect()
    assert {r.lang for r in few} == every and len(few) <= 140
