import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbweft.llm import hilbert, packing
from orbweft.session import stored

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    h = hilbert.curve_index(grid, bits)
    assert sorted(h) == list(range(1 << (bits * d)))
    assert (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_shards(spark, sf):
    got = hilbert.op6_hilbert_shards(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 16
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    order = got.sort_values(["shard", "slot"])
    assert order.curve.is_monotonic_increasing
    for r in got.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)


def test_shard_edges_and_pruning(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else "x" * i, None if i % 7 == 0 else "en", f"s{i % 3}") for i in range(40)] + [(None, "n", None, None), (3, "xxx", "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS curve", "2 AS size", "3 AS shard")
    placed = hilbert.sharded(df, 5)
    got = placed.collect()
    assert len(got) == 42 and {r.size for r in got if r.doc_id == 5} == {1}
    counts = defaultdict(list)
    for r in got:
        counts[r.shard].append(r.slot)
    assert sorted(map(len, counts.values())) == [8, 8, 8, 9, 9] and all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert hilbert.sharded(df.limit(0), 5).count() == 0
    assert hilbert.manifest(placed).agg({"rows": "sum"}).first()[0] == 42
    about = hilbert.write(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out/shards"))
    key = lambda r: str((r.doc_id, r.text, r.lang, r.source, r.curve, r.size, r.shard))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect())) and about.agg({"rows": "sum"}).first()[0] == 42
    assert spark.read.parquet(str(tmp_path / "out/manifest")).count() == 4


def test_shards_are_skipped_by_every_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = stored(hilbert.sharded(docs), "placed")
    about = stored(hilbert.manifest(placed), "about")
    rows = placed.toPandas()
    rare = rows.lang.value_counts().index[-1]
    seen = {"lang": (rare, rare), "doc_id": (100, 110), "size": (1, 60), "source": (rows.source.min(), rows.source.min())}
    for c, (low, high) in seen.items():
        kept = {r.shard for r in hilbert.wanted(about, **{c: (low, high)}).collect()}
        assert set(rows[(rows[c] >= low) & (rows[c] <= high)].shard) <= kept and len(kept) <= 12, (c, kept)
    kept = {r.shard for r in hilbert.wanted(about, lang=("en", "en")).collect()}
    assert kept == set(rows[rows.lang == "en"].shard) and len(kept) < 16
    assert len({r.shard for r in hilbert.wanted(about, lang=(rare, rare), doc_id=(100, 110)).collect()}) <= 8


def test_text_keys_keep_order(spark):
    words = ["", "a", "aa", "b", "é", "zz", "zzzzzzzz", "漢"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", hilbert.text_key(F.col("w")).alias("k"))
    got = {r.w: r.k for r in df.collect()}
    assert sorted(words, key=str.encode) == sorted(words, key=got.get) and len(set(got.values())) == len(words)


def check_packed(rows, texts, limits):
    library = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    want = defaultdict(int)
    for i, t in texts:
        want[i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for (i, ids), n in want.items():
        for r in by_doc[i]:
            if n == 1 and r.doc_tokens == len(ids) and sum(k[0] == i for k in want) == 1:
                assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for i, own in by_doc.items():
        if sum(n for k, n in want.items() if k[0] == i) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == own[0].doc_tokens
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
    return sum(r.length for r in rows) / (limits.tokens * len(by_seq))


def test_packing(spark, sf):
    rows = packing.op7_vector_packing(spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packed(rows, texts, packing.Limits()) > 0.95


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "漢字 ñ " * 5000), (5, "word " * 40000), (6, "a"), (6, "a"), (None, "b c")] + [(i, "t") for i in range(10, 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS length")
    check_packed(packing.documents_packed(df).collect(), texts, packing.Limits())
    assert packing.documents_packed(df.limit(0)).count() == 0


def test_three_limits_hold_at_once():
    rng = random.Random(4)
    limits = packing.Limits(tokens=100, segments=5, loss=40)
    packer, made, total = packing.Packer(limits, pool=32), [], 0
    for k in range(300):
        n = rng.choice([1, 3, 20, 60, 150])
        bears = np.array([rng.random() < 0.5 for _ in range(n)])
        total += n
        made += packer.add(k, np.arange(n, dtype=np.uint32), bears)
    made += packer.close()
    for s in made:
        assert sum(len(p.ids) for p in s) <= 100 and len(s) <= 5 and sum(p.loss for p in s) <= 40
    pieces = sorted((p.key, p.start, len(p.ids)) for s in made for p in s)
    assert sum(p[2] for p in pieces) == total
    assert all(b[1] == a[1] + a[2] for a, b in zip(pieces, pieces[1:], strict=False) if a[0] == b[0])


def test_tasks_without_pieces(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert len(packing.documents_packed(df.repartition(4)).collect()) == 2
    assert packing.documents_packed(df.where("doc_id > 9").repartition(3)).count() == 0
    assert list(packing.Packer().close()) == []


def test_ids_are_the_librarys():
    ids = packing.Ids(str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")))
    want = lambda t: ids.library.encode(t, add_special_tokens=False).ids
    for t in (" " * 10**6, " " * 10**6 + "x", "a" * 10**6, "a " * 300_000, "\n" * 10**5 + "b", "<|endoftext|> " * 20_000, "漢字。" * 50_000):
        assert ids(t)[:-1].tolist() == want(t)
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(" \n\t  ab'sté1,.<|>ende漢\x1c\x85\xa0oftext") for _ in range(rng.randrange(60)))
        for size in (1, 7, 1 << 16):
            assert [i for c in packing.chunks(t, size) for i in ids.part(c)] == want(t)


def test_loss_limit_of_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    limits = packing.Limits(tokens=256, segments=8, loss=64)
    more = spark.createDataFrame([(-1, 1, None, "x"), (-2, 1, "assistant", None), (-3, 1, "assistant", "y " * 900)], "conv_id long, turn long, role string, text string")
    rows = packing.conversations_packed(turns.union(more), limits).collect()
    ids = packing.Ids(str(P.path("byte_bpe_50k.json")), None)
    bears = defaultdict(int)
    for r in turns.union(more).collect():
        bears[r.conv_id, tuple(ids(r.text or ""))] += (r.role == "assistant") * 1
    known = {c: all(v for (k, _), v in bears.items() if k == c) for c, _ in bears}
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(len(ids(r.text or "")) for r in turns.union(more).collect())
    for own in by_seq.values():
        assert sum(r.length for r in own) <= 256 and len(own) <= 8
        assert sum(r.length for r in own if known[r.doc_id]) <= 64  # conversations of answers alone
    assert max(r.length for r in rows if r.doc_id == -3) == 64
