import hashlib
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbweft.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))
LIBRARY, ENCODER, DECODER = Tokenizer.from_file(PATH), bpe.Encoder(PATH), bpe.Decoder(PATH)


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text).tolist() == ids
    assert "".join(DECODER.decode(ids, 7)) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=5000, deadline=None)
@given(st.text("abé ́'<|>endoftextΣ½1\n\x1c漢하", max_size=60))
@example("<'d1111111111111")
@example("\",t't>'\n ,<e'és>|'!!a")
def test_awkward_text(text):
    same(text)


@pytest.mark.parametrize("signs", ["abé ́'<|>endoftextΣ½1\n\x1c漢하", "'rvlsdmtRE!", "<|endoftext|>'s", "'!ᄀ각é", "😀'.a"])
def test_cut_anywhere(signs):
    """Whatever the text's parts, ids are those of the whole; without long runs of marks little is held."""
    rng = random.Random(signs)
    for k in range(400):
        text = "".join(rng.choice([*signs, "<|endoftext|>", "'ll"]) for _ in range(rng.randrange(200)))
        step = rng.choice([1, 3, 16, 50])
        got = b"".join(ENCODER.pieces(text[i : i + step] for i in range(0, len(text), step)))
        assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("part", ["😀", "'", "'r", "'ll", "!'s", "<", "<|endoftext|>", "漢", "하", "é", "a", "1", "x'y", "e\u0301"])
def test_what_is_held_is_bounded(part):
    text, most, cut = part * 40_000, 0, bpe.Encoder._cut

    class Watched(bpe.Encoder):
        def _cut(self, s):
            nonlocal most
            most = max(most, len(s))
            return cut(self, s)

    w = Watched(PATH)
    got = b"".join(w.pieces(text[i : i + 4096] for i in range(0, len(text), 4096)))
    assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert most <= 2 * 4096


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>a<|startoftext|> b", "a" * 30000, "thean" * 30000 + " x", "é" * 70000, "하" * 40000, "!" * 70000 + "a", "x" * 65530 + "'ll be", "a" * 65530 + "<|endoftext|>b"])
def test_long_and_marked(text):
    same(text)


def test_window_is_bounded_and_exact():
    rng = random.Random(5)
    for _ in range(20):
        data = "".join(rng.choice("thean") for _ in range(5000)).encode()
        one = bpe.WordTransducer(ENCODER.merges)
        ids = [*one.feed(data), *one.end()]
        m = ENCODER.merges
        assert ids == m.merge([*map(m.base.__getitem__, data[:-1]), m.last[data[-1]]])
        assert one.peak <= one.size


def test_window_over_the_whole_vocabulary():
    rng, m = random.Random(6), ENCODER.merges
    names = [t.removesuffix("</w>").encode() for t in ENCODER.names.values() if t.removesuffix("</w>").isascii()]
    for _ in range(150):
        data = b"".join(rng.choice(names) for _ in range(900))
        one = bpe.WordTransducer(m)
        assert [*one.feed(data), *one.end()] == m.merge([*map(m.base.__getitem__, data[:-1]), m.last[data[-1]]])
        assert one.peak <= one.size


def test_table(spark):
    rows = [(1, "Hello, World's end"), (2, None), (3, ""), (None, "x"), (1, "Hello, World's end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids_sha256")
    got = bpe.code_table(df, PATH).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    ids = LIBRARY.encode(rows[0][1], add_special_tokens=False).ids
    assert by[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert by[2].n_tokens == 0 == by[3].n_tokens and by[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.code_table(df.limit(0), PATH).count() == 0
    assert np.array(ENCODER.encode("x")).size == 1
