"""Media columns as MPEG transport streams.

A payload is muxed into 188-byte packets: a program association table, a program map table and one elementary stream of
private data whose packetised units carry timestamps. Every fourth unit is a random-access point, and the tables stand
again before it, so a stream can be entered there. The reader parses the tables from sections of any number of packets,
checks the continuity counter of every PID, leaves out packets sent twice, reassembles the units from the payloads of
their packets and returns the payload with each unit's timestamp, place and random-access mark.

Defined results: null text is the empty text; every payload is padded with zero bytes to a positive multiple of 64, so
it has at least 64 bytes; equal texts give equal streams; repeated rows each give a row; an empty table gives an empty
result; other columns are not read. A stream with a bad sync byte, checksum or unit length raises ValueError; a jump of
a counter that no discontinuity mark announces is counted and its unit marked as broken; packets before the first
start of a unit belong to none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM = 0, 0x1000, 0x100, 1
#: Stream type of private data in packetised units, and its stream id.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
#: Payload bytes of a unit, units between random-access points, and 90 kHz ticks between units.
UNIT, GROUP, TICKS = 16384, 4, 3600


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0)
    return (whole := head + body) + struct.pack(">I", crc32_mpeg(whole))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    body = b"\0" + section
    return struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter & 15) + body + b"\xff" * (PACKET - 4 - len(body))


_PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(2, PROGRAM, struct.pack(">HH", 0xE000 | MEDIA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | MEDIA_PID, 0xF000))
#: The two table packets for each value of their counters.
TABLES = [_table_packet(PAT_PID, _PAT, k) + _table_packet(PMT_PID, _PMT, k) for k in range(16)]


def _stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1])


def _unit_header(size: int, pts: int) -> bytes:
    return b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_ID, size + 8, 0x80, 0x80, 5) + _stamp(pts)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The stream that stores payload."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        pts = k * TICKS
        if k % GROUP == 0:
            out.append(TABLES[k // GROUP % 16])
        data = _unit_header(len(piece := payload[at : at + unit]), pts) + piece
        first = struct.pack(">BBIH", 7, 0x10 | (0x40 if k % GROUP == 0 else 0), pts >> 1, (pts & 1) << 15 | 0x7E00)  # with the clock
        room = PACKET - 4 - len(first)
        n = 1 + max(0, -(-(len(data) - room) // (PACKET - 4)))
        grid = np.zeros((n, PACKET), np.uint8)
        grid[:, 0] = SYNC
        grid[:, 1] = MEDIA_PID >> 8
        grid[0, 1] |= 0x40
        grid[:, 2] = MEDIA_PID & 0xFF
        grid[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        grid[0, 3] |= 0x20
        raw = np.frombuffer(data, np.uint8)
        if n == 1:
            stuff = room - len(data)
            grid[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
            grid[0, 4] += stuff
            grid[0, 4 + len(first) : 4 + len(first) + stuff] = 0xFF
            grid[0, 4 + len(first) + stuff :] = raw
        else:
            grid[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
            grid[0, 4 + len(first) :] = raw[:room]
            full = n - 2
            grid[1 : 1 + full, 4:] = raw[room : room + full * (PACKET - 4)].reshape(full, PACKET - 4)
            rest = raw[room + full * (PACKET - 4) :]
            stuff = PACKET - 4 - len(rest)
            if stuff:
                grid[-1, 3] |= 0x20
                grid[-1, 4] = stuff - 1
                if stuff > 1:
                    grid[-1, 5] = 0
                    grid[-1, 6 : 4 + stuff] = 0xFF
            grid[-1, 4 + stuff :] = rest
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a stream holds."""

    payload: bytes = b""
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: list[tuple[int, int, int, bool, bool]] = field(default_factory=list)  # packet, bytes, timestamp, random access, whole
    packets: int = 0
    jumps: int = 0


def _sections(packets) -> Iterator[bytes]:
    """Whole sections of one PID's packets (start, payload), checked; a section may go on in any number of packets."""
    held: bytes | None = None
    for start, body in packets:
        if start:
            at = 1 + body[0]
            if held is not None:
                yield from _whole(held + body[1:at])[0]
            held = body[at:]
        elif held is not None:
            held += body
        if held is not None:
            done, held = _whole(held)
            yield from done


def _whole(data: bytes) -> tuple[list[bytes], bytes]:
    """Sections that data begins with, and what is left; bytes of ones fill a packet up."""
    done = []
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (struct.unpack(">H", data[1:3])[0] & 0xFFF)
        if len(data) < size:
            break
        if crc32_mpeg(data[:size]):
            raise ValueError("a table's checksum is wrong")
        done.append(data[:size])
        data = data[size:]
    return done, data


def demux(data: bytes) -> Stream:
    """Parse, check and reassemble a stream."""
    if len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    out = Stream(packets=len(grid))
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    start = (grid[:, 1] & 0x40) != 0
    adapted, loaded = (grid[:, 3] & 0x20) != 0, (grid[:, 3] & 0x10) != 0
    skip = np.where(adapted, grid[:, 4].astype(np.int32) + 1, 0) + 4
    marked = adapted & (grid[:, 4] > 0) & (grid[:, 5] & 0x80 != 0)  # a jump is announced

    def packets_of(p: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a PID's packets with payload, those sent twice left out, and where their counter jumps."""
        rows = np.flatnonzero((pid == p) & loaded)
        counters = grid[rows, 3] & 15
        again = np.zeros(len(rows), bool)
        for i in np.flatnonzero(counters[1:] == counters[:-1]) + 1:
            again[i] = not again[i - 1] and (grid[rows[i], 4:] == grid[rows[i - 1], 4:]).all()
        rows, counters = rows[~again], counters[~again]
        jump = np.concatenate([[False], (counters[1:] != (counters[:-1] + 1) & 15)]) & ~marked[rows]
        out.jumps += int(jump.sum())
        return rows, jump

    def sections_of(p: int) -> Iterator[bytes]:
        return _sections((start[i], grid[i, skip[i] :].tobytes()) for i in packets_of(p)[0])

    media: set[int] = set()
    for s in sections_of(PAT_PID):
        for number, at in struct.iter_unpack(">HH", s[8:-4]):
            if number:
                out.programs.setdefault(at & 0x1FFF, {})
    for at in out.programs:
        for s in sections_of(at):
            p = 12 + (struct.unpack(">H", s[10:12])[0] & 0xFFF)
            while p < len(s) - 4:
                kind, es, info = struct.unpack(">BHH", s[p : p + 5])
                out.programs[at][es & 0x1FFF] = kind
                media.add(es & 0x1FFF)
                p += 5 + (info & 0xFFF)
    pieces = []
    for es in sorted(media):
        rows, jump = packets_of(es)
        mine, own_skip = grid[rows], skip[rows]
        heads = np.flatnonzero(start[rows])
        for a, b in zip(heads, [*heads[1:], len(rows)][: len(heads)], strict=True):
            parts, own = [mine[a, own_skip[a] :]], own_skip[a + 1 : b]
            plain = int((own == 4).argmin()) if len(own) and not (own == 4).all() else len(own)
            parts.append(mine[a + 1 : a + 1 + plain, 4:].reshape(-1))
            parts += [mine[r, own_skip[r] :] for r in range(a + 1 + plain, b)]
            body = np.concatenate(parts).tobytes()
            if body[:3] != b"\0\0\1":
                raise ValueError("a unit lacks its start code")
            size, flags, extra = struct.unpack(">H", body[4:6])[0], body[7], body[8]
            if size and 6 + size != len(body) and not jump[a:b].any():
                raise ValueError("a unit's length is wrong")
            t, pts = body[9:14], -1  # a unit may lack a timestamp
            if flags & 0x80:
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            piece = body[9 + extra :]
            access = bool(adapted[rows[a]] and mine[a, 4] and mine[a, 5] & 0x40)
            out.units.append((int(rows[a]), len(piece), pts, access, not jump[a:b].any()))
            pieces.append(piece)
    out.payload = b"".join(pieces)
    return out


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


UNITS = "array<struct<packet:long,bytes:long,pts:long,random_access:boolean,whole:boolean>>"
SCHEMA = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units {UNITS}"


def streams(docs):
    """doc_id, n_bytes, media: every text as a stream; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            ids, sizes, made, size = [], [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py() or b""
                ids.append(doc_id)
                sizes.append(len(raw))
                made.append(mux(padded(raw)))
                size += len(made[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])
                    ids, sizes, made, size = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(stored_streams):
    """What the streams (doc_id, n_bytes, media) hold: digests of payload and stream, a feature, and the units with their
    timestamps and random-access points."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for b in batches:
            out = []
            for doc_id, n_bytes, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                media = media.as_py()
                got = demux(media)
                pts = [u[2] for u in got.units]
                feature = f"programs={len(got.programs)};packets={got.packets};units={len(pts)};access={sum(u[3] for u in got.units)};jumps={got.jumps};pts={pts[0]}-{pts[-1]}"
                row = {"doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(got.payload), "payload_sha256": hashlib.sha256(got.payload).hexdigest(), "tail_crc32": zlib.crc32(got.payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}
                out.append(row | {"units": [dict(zip(("packet", "bytes", "pts", "random_access", "whole"), u, strict=True)) for u in got.units]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return stored_streams.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def op9_mpegts_media(spark, sf_dir: str):
    """Every document stored as a transport stream and read back from where it is stored."""
    from orbweft.session import stored, table

    return described(stored(streams(table(spark, sf_dir, "documents")), "media", compression="zstd"))
