import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from orbweft.llm import files, order
from orbweft.session import folder, stored

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    assert sorted(order.permuted(np.arange(n), n)) == list(range(n))
    assert n < 10 or (order.permuted(np.arange(n), n) != order.permuted(np.arange(n), n, 7)).any()


def plain_slot(number, count, key):
    """The network and the walk for one number, with whole numbers of Python."""
    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    half = max(1, -(-max(count - 1, 1).bit_length() // 2))
    while True:
        left, right = number >> half, number % 2**half
        for r in range(order.ROUNDS):
            left, right = right, left ^ mix((right + mix(key + r)) % 2**64) % 2**half
        number = left << half | right
        if number < count:
            return number


def check(spark, docs, place, per_shard, key=order.KEY):
    """The files against the library's ids and a plain permutation."""
    library = Tokenizer.from_file(PATH)
    rows = order.materialised(docs, place, PATH, str(P.path("byte_bpe_50k.tiktoken")), key, per_shard).collect()
    read = dict(order.Reader(place).read())
    about = order.Reader(place).about
    assert sorted(read) == list(range(about["count"])) == sorted({r.slot for r in rows})
    by_doc, by_slot = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.shard == r.slot // per_shard and r.offset == r.slot % per_shard * 2 * order.LENGTH
        piece = read[r.slot][r.at : r.at + r.length]
        assert zlib.crc32(piece.astype("<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, piece.tolist()))
        by_slot[r.slot].append((r.at, r.length))
    for s, own in by_slot.items():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert not read[s][at:].any()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert set(want) == set(by_doc)
    for k, texts in want.items():
        if len(texts) == 1:
            got = sorted(by_doc[k])
            assert [i for _, p in got for i in p] == texts[0] and all(b[0] == a[0] + len(a[1]) for a, b in zip(got, got[1:], strict=False))
    return rows, read


def test_query_and_reader(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = folder(spark, "read")
    _, read = check(spark, docs, place, 7)
    for at in (0, 1, 6, 7, 20, len(read) - 1):
        got = list(order.Reader(place).read(at, 3))
        assert [s for s, _ in got] == list(range(at, len(read))) and all((ids == read[s]).all() for s, ids in got)
    assert not list(order.Reader(place).read(len(read)))
    whole = order.op5_training_order(spark, sf).toPandas()
    assert len(whole.groupby("slot")) == len(read) and whole.shard.max() == 0


@pytest.mark.parametrize("tasks", [1, 3])
def test_slots_are_those_of_a_plain_permutation(spark, tasks):
    docs = spark.createDataFrame([(i, "word " * random.Random(i).randrange(3000)) for i in range(120)], "doc_id long, text string").repartition(tasks)
    rows = stored(order.sequences(docs, PATH, None), "sequences")
    placed, n = order.ordered(rows)
    got = placed.select("task", "k", "number", "slot").collect()
    by = sorted((r.task, r.k) for r in got)
    assert n == len(got) and all(by.index((r.task, r.k)) == r.number and plain_slot(r.number, n, order.KEY) == r.slot for r in got)


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, "a b"), (3, "word " * 5000), (None, "x"), (2, "a b"), (4, ""), (5, " " * 10**6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS slot", "8 AS shard", "9 AS task", "'x' AS ids")
    got, _ = check(spark, df.repartition(9), f"file://{tmp_path}/a", 4)
    assert sum(r.length for r in got if r.doc_id == 2) == 6
    assert order.materialised(df.limit(0), f"file://{tmp_path}/e", PATH, None).count() == 0 and not list(order.Reader(f"file://{tmp_path}/e").read())
    assert files.open_fs("s3a://bucket/x?region=us-east-1")[1] == "bucket/x"


def test_a_draft_that_fails_leaves_nothing(tmp_path):
    with pytest.raises(ZeroDivisionError):
        files.publish(f"file://{tmp_path}/x.bin", lambda out: 1 / 0)
    assert not list(tmp_path.iterdir())
