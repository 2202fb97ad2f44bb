import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from orbweft.llm import mpegts as M
from orbweft.llm import warc as W
from orbweft.session import stored


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 152, 153, 154, 160, 170, 334, 336, 338, 16384, 16385, 16525, 90000])
def test_stream_round_trip(n):
    raw = M.padded(random.Random(n).randbytes(n))
    got = M.demux(M.mux(raw))
    assert len(raw) % 64 == 0 and len(raw) >= 64 and got.payload == raw and got.jumps == 0
    assert [u[2] for u in got.units] == [k * M.TICKS for k in range(len(got.units))]
    assert [u[3] for u in got.units] == [k % M.GROUP == 0 for k in range(len(got.units))]
    assert got.programs == {M.PMT_PID: {M.MEDIA_PID: M.PRIVATE_TYPE}}


def test_damage_is_noticed():
    data = bytearray(M.mux(bytes(40000)))
    cut = M.demux(bytes(data[: 188 * 9] + data[188 * 10 :]))
    assert cut.jumps == 1 and [u[4] for u in cut.units].count(False) == 1
    twice = M.demux(bytes(data[: 188 * 10] + data[188 * 9 :]))
    assert twice.jumps == 0 and twice.payload == bytes(40000) and all(u[4] for u in twice.units)
    with pytest.raises(ValueError):
        M.demux(bytes(data[:-1]))
    broken = data[:]
    broken[8] ^= 1
    with pytest.raises(ValueError):
        M.demux(bytes(broken))


def packet(pid, counter, body, start=False, field=None, load=True):
    """One packet made by hand; field is the adaptation field after its length."""
    field = None if field is None and len(body) == 184 else field or b""
    if field is not None:
        fill = 183 - len(field) - len(body)
        field = bytes([len(field) + fill]) + (field or (b"\0" if fill else b"")) + b"\xff" * (fill - (not field and fill > 0))
    return bytes([0x47, start << 6 | pid >> 8, pid & 255, (field is not None) << 5 | load << 4 | counter & 15]) + (field or b"") + body


def section(table, ident, body):
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\0\0"
    crc = 0xFFFFFFFF
    for x in head + body:
        for k in range(7, -1, -1):
            crc = (crc << 1 ^ 0x04C11DB7 * ((crc >> 31) ^ (x >> k & 1))) & 0xFFFFFFFF
    return head + body + crc.to_bytes(4, "big")


def test_packets_of_another_maker():
    pat = section(0, 1, b"\0\0\xe0\x10" + b"\0\2\xe0\x20" + b"\0\3\xe0\x21")
    pmt = section(2, 2, b"\xe0\x50\xf0\x00" + b"\x06\xe0\x50\xf0\xb4" + bytes(180) + b"\x1b\xe0\x51\xf0\0")  # two packets
    other = section(2, 3, b"\xe0\x60\xf0\0" + b"\x0f\xe0\x60\xf0\0")
    full = lambda x: x.ljust(184, b"\xff")
    pes = lambda body, size=True: b"\0\0\1\xbd" + ((len(body) + 8) if size else 0).to_bytes(2, "big") + b"\x80\x80\5" + b"\x21\0\1\x0e\x11" + body
    one, two = pes(b"a" * 300), pes(b"b" * 50, False)
    pm = b"\0" + pmt
    data = [
        packet(0x50, 3, b"x" * 184),  # before any start
        packet(0, 7, full(b"\0" + pat), True),
        packet(0x20, 0, pm[:184], True),
        packet(0x21, 5, full(b"\0" + other), True),
        packet(0x20, 1, full(pm[184:])),
        packet(0x50, 4, one[:170], True, b"\x40"),
        packet(0x50, 4, b"", field=b"\0" * 183, load=False),  # no payload: the counter stays
        packet(0x60, 9, pes(b"c" * 20), True),
        packet(0x50, 5, one[170:]),
        packet(0x50, 5, one[170:]),  # sent twice
        packet(0x50, 11, two, True, b"\x80"),  # an announced jump
        packet(0x1FFF, 0, b"\xff" * 184),
    ]
    assert all(len(x) == 188 for x in data)
    got = M.demux(b"".join(data))
    assert got.programs == {0x20: {0x50: 6, 0x51: 0x1B}, 0x21: {0x60: 0x0F}} and got.jumps == 0
    assert got.payload == b"a" * 300 + b"b" * 50 + b"c" * 20
    assert [(u[0], u[1], u[3], u[4]) for u in got.units] == [(5, 300, True, True), (10, 50, False, True), (7, 20, False, True)]
    assert got.units[0][2] == 0x708  # the stamp above


def test_a_stream_is_entered_at_any_access_point():
    raw = random.Random(3).randbytes(64 * 5000)
    data = M.mux(raw)
    whole = M.demux(data)
    points = [k for k, u in enumerate(whole.units) if u[3]]
    assert points == list(range(0, len(whole.units), M.GROUP)) and len(points) > 3
    for k in points:
        rest = M.demux(data[(whole.units[k][0] - 2) * 188 :])  # the tables stand before it
        assert rest.payload == raw[k * M.UNIT :] and rest.jumps == 0 and [u[2] for u in rest.units] == [u[2] for u in whole.units[k:]]


def test_media_column(spark):
    rows = [(1, "text"), (2, None), (3, ""), (4, "é" * 100000), (5, "text"), (None, "x"), (5, "text"), (6, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS feature", "3 AS n_bytes")
    made = stored(M.streams(df), "media")
    media = {r.doc_id: r.media for r in made.collect()}
    all_rows = M.described(made).collect()
    got = {r.doc_id: r for r in all_rows}
    assert len(all_rows) == len(rows)
    for i, t in rows:
        raw = M.padded((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest())
        assert r.tail_crc32 == zlib.crc32(raw[-64:]) and r.media_sha256 == hashlib.sha256(media[i]).hexdigest() and r.media_bytes == len(media[i])
        assert sum(u.bytes for u in r.units) == len(raw) and [u.pts for u in r.units] == [k * M.TICKS for k in range(len(r.units))]
    assert got[1].media_sha256 == got[5].media_sha256 and got[1].feature == got[5].feature
    assert M.described(M.streams(df.limit(0))).count() == 0


def test_normaliser_gives_each_record_a_member():
    made = [W.page_record(i, f"http://x/{i}", random.Random(i).randbytes(i * 37 % 5000), "D", None) for i in range(60)]
    whole = io.BytesIO()
    W.gzip_whole(made, whole)
    for step in (1, 7, 1 << 20):
        out = io.BytesIO()
        index = list(W.normalise(io.BytesIO(whole.getvalue()), out)) if step > 1 else None
        if step == 1:
            assert [r.payload for r in W.records(io.BytesIO(whole.getvalue()), 13)] == [r.payload for r in made]
            continue
        assert gzip.decompress(out.getvalue()) == gzip.decompress(whole.getvalue())
        assert [W.read_at(out, x["offset"], x["length"]).payload for x in index] == [r.payload for r in made]
        assert [r.payload for r in W.records(io.BytesIO(out.getvalue()))] == [r.payload for r in made]
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(gzip.compress(made[5].encode()[:-9]))))


def test_records_of_other_makers_pass_as_they_are():
    parts = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nwarc-record-id: <urn:uuid:1>\r\ncontent-length: 4\r\n\r\nabcd\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type:request\r\nWARC-Concurrent-To: <urn:a>\r\nWARC-Concurrent-To: <urn:b>\r\nX-Long: one\r\n two\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Target-URI: http://x/\xff\xe9\r\nContent-Length: 8\r\n\r\n\r\n\r\nWARC\r\n\r\n",
    ]
    for source in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        out = io.BytesIO()
        index = list(W.normalise(io.BytesIO(source), out))
        assert [gzip.decompress(out.getvalue()[x["offset"] : x["offset"] + x["length"]]) for x in index] == parts
        assert [x["type"] for x in index] == ["warcinfo", "request", "metadata"] and [x["id"] for x in index] == ["<urn:uuid:1>", None, None]
    second = W.read_at(out, index[1]["offset"], index[1]["length"])
    assert [v for k, v in second.headers if k == "WARC-Concurrent-To"] == ["<urn:a>", "<urn:b>"] and second.get("x-long") == "one two" and second.version == "WARC/1.1"
    for bad in (b"HTTP/1.1 200\r\n\r\n", b"WARC/1.0\r\nA: b\r\n\r\n", parts[0].replace(b": 4", b": 3"), parts[0].replace(b": 4", b": x")):
        with pytest.raises(ValueError):
            list(W.records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(gzip.compress(b"".join(parts))[:-20])))


def test_inflated_pieces_are_bounded():
    data = bytes(200 << 20)
    sizes = [len(x) for x in W.inflate(io.BytesIO(gzip.compress(data, 1)), 1 << 20)]
    assert max(sizes) <= 1 << 20 and sum(sizes) == len(data)
    assert list(W.inflate(io.BytesIO(b""))) == []


def test_pages(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nEvil: 1", None), (4, "", ""), (5, "u", "é" * 50000), (0, "z", "x"), (0, "z", "x"), (None, "n", "x"), (None, "m", "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    got = W.read_members(W.spread(W.archived(df))).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert W.read_members(W.spread(W.archived(df.limit(0)))).count() == 0
    longer = {r.page_id: r.record_type for r in W.read_members(W.spread(W.archived(df, 2))).collect()}
    assert longer[1] == longer[2] == "response"
