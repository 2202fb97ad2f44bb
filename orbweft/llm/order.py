"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot.

Documents are tokenised once and packed into sequences of one length, which are written and numbered: each task's
sequences follow those of the tasks before it. A balanced Feistel network over the next even power of two permutes the
numbers, and a number that lands at or beyond the count walks on until it lands within, so slots are a permutation of
the numbers that anyone with the key can compute. As slots are dense, the ranges of slots that tasks write are known
without sampling: one shuffle takes each sequence, unpadded, to the task of its range, which writes shards of rows of
one fixed size. Slot s is found at (s mod per_shard) * stride of shard s // per_shard, so reading goes on from any slot.

Ids are stored in WIDTH bytes; an id that they do not hold raises ValueError. A shard of PER_SHARD sequences has 16 MB;
larger corpora take a larger per_shard. The numbers, and with them the order, depend on the key and on how the input is
split into tasks; the sequences that one run has written keep their slots for good.

Defined results: null and empty texts are one end mark; repeated rows are examples of their own; sequences that the
packing leaves open are padded with zeros; an empty table, and a task without rows, gives no sequence; other columns
are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweft.llm.arrays import mix
from orbweft.llm.files import Draft, open_fs, publish
from orbweft.llm.packing import LENGTH, Ids, Limits, Packer
from orbweft.session import folder, stored, table

KEY, ROUNDS, PER_SHARD, WIDTH = 20240101, 4, 4096, 2
#: Tasks that write shards there are at most, each a run of shards; parts in which all shards are written.
TASKS, WAVES = 20_000, 2
_MADE: dict = {}

PIECES = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length")]))
ROWS = "task int, k long, ids binary, pieces array<struct<doc_id:long,start:long,length:long>>"


def permuted(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below count."""
    half = np.uint64(max(1, -(-max(count - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + mix(np.array([key + r], np.uint64))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, ranks: str | None, width: int = WIDTH, limits: Limits = Limits()) -> DataFrame:
    """task, k, ids, pieces of every sequence that a task packs, k from 0; ids are unpadded."""

    def run(batches):
        from pyspark import TaskContext

        if path not in _MADE:
            _MADE[path] = Ids(path, ranks)
        ids_of, packer, task = _MADE[path], Packer(limits), TaskContext.get().partitionId()

        def made():
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield from packer.add(key, ids_of(text.as_py() or ""))
            yield from packer.close()

        k, raw, pieces = 0, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([task] * len(raw), pa.int32()), pa.array(range(k - len(raw), k), pa.int64()), pa.array(raw, pa.binary()), pa.array(pieces, PIECES)], ["task", "k", "ids", "pieces"])

        for one in made():
            ids = np.concatenate([p.ids for p in one])
            if int(ids.max()) >> (8 * width):
                raise ValueError(f"an id takes more than {width} bytes")
            raw.append(ids.astype(f"<u{width}").tobytes())
            pieces.append([{"doc_id": p.key, "start": p.start, "length": len(p.ids)} for p in one])
            k += 1
            if len(raw) == 256:
                yield out()
                raw, pieces = [], []
        if raw:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def ordered(rows: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """number and slot of every row (task, k, ...) of a written table, and the count of rows."""
    starts, count = [], 0
    for task, n in sorted(map(tuple, rows.groupBy("task").count().collect())):  # one row a task
        starts.append((task, count))
        count += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "task int, first long"))

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), count, key))

    numbered = rows.join(first, "task").withColumn("number", F.col("first") + F.col("k")).drop("first")
    return numbered.withColumn("slot", slot("number")), count


WRITTEN = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "slot", "shard", "offset", "at", "ids_crc32")])


def written(rows: DataFrame, first: int, end: int, place: str, per_shard: int = PER_SHARD, width: int = WIDTH, length: int = LENGTH) -> DataFrame:
    """A row for each piece of slots from first to end, after its shard is written: where its sequence lies and how many
    ids come before it there. Both ends are multiples of per_shard."""
    shards = max(1, (end - first) // per_shard)
    tasks = min(shards, TASKS)
    shard = F.floor((F.col("slot") - first) / per_shard)
    here = rows.where((F.col("slot") >= first) & (F.col("slot") < end))
    cut = here.repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("slot")
    stride = width * length

    def run(batches):
        now, draft, held = -1, None, []
        try:
            for b in batches:
                for slot, ids, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if slot // per_shard != now:
                        if draft:
                            draft.publish()
                        now = slot // per_shard
                        draft = Draft(shard_path(place, now))
                    draft.out.write(ids.ljust(stride, b"\0"))
                    values, at = np.frombuffer(ids, f"<u{width}"), 0
                    for p in pieces:
                        crc = zlib.crc32(values[at : at + p["length"]].astype("<u4").tobytes())
                        held.append((p["doc_id"], p["start"], p["length"], slot, now, slot % per_shard * stride, at, crc))
                        at += p["length"]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=WRITTEN)
                    held = []
        except BaseException:
            if draft:
                draft.abandon()
            raise
        if draft:
            draft.publish()

    return cut.select("slot", "ids", "pieces").mapInArrow(run, ", ".join(f"{n} long" for n in WRITTEN.names))


def shard_path(place: str, shard: int) -> str:
    return f"{place}/shard-{shard:08d}.bin"


def materialised(docs: DataFrame, place: str, path: str, ranks: str | None, key: int = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """Write all sequences of docs in training order to place, with a manifest; the rows of written().

    Shards are written in WAVES runs, one after another, so that so much less is on its way between tasks at once.
    """
    rows, count = ordered(stored(sequences(docs, path, ranks), "sequences", compression="zstd"), key)
    shards = -(-count // per_shard)
    ends = [shards * w // WAVES * per_shard for w in range(WAVES + 1)]
    waves = [stored(written(rows, a, b, place, per_shard), "order") for a, b in zip(ends, ends[1:], strict=False) if a < b or not count]
    about = {"count": count, "per_shard": per_shard, "length": LENGTH, "width": WIDTH, "key": key}
    publish(f"{place}/order.json", lambda f: f.write(json.dumps(about).encode()))
    return functools.reduce(DataFrame.union, waves)


class Reader:
    """Sequences of a written order, one after another from any slot."""

    def __init__(self, place: str):
        self.place = place
        self.fs, self.path = open_fs(place)
        with self.fs.open_input_stream(f"{self.path}/order.json") as f:
            self.about = json.loads(f.read())

    def read(self, slot: int = 0, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """slot and padded ids of each sequence from slot on; step sequences are read at once."""
        per_shard, width, count = (self.about[k] for k in ("per_shard", "width", "count"))
        stride = width * self.about["length"]
        while slot < count:
            with self.fs.open_input_file(shard_path(self.path, slot // per_shard)) as f:
                end = min(count, (slot // per_shard + 1) * per_shard)
                f.seek(slot % per_shard * stride)
                while slot < end:
                    block = np.frombuffer(f.read(stride * min(step, end - slot)), f"<u{width}").reshape(-1, self.about["length"])
                    if not len(block):
                        raise ValueError(f"shard {slot // per_shard} ends before slot {slot}")
                    for ids in block:
                        yield slot, ids
                        slot += 1


def op5_training_order(spark, sf_dir: str) -> DataFrame:
    """All documents' sequences written in training order."""
    import public_tokenizers as P

    return materialised(table(spark, sf_dir, "documents"), folder(spark, "shards"), str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")))
