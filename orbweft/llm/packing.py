"""Vector bin packing of examples into training sequences.

Examples take room in three dimensions at once: tokens, segments and loss-bearing tokens. Bins are filled one by one;
the next piece is that which fits and has the largest dot product of its demand with the room left, both as shares of
the limits, so that a dimension that is scarce in the bin weighs less in the choice. Examples beyond a limit are cut.
Each task packs what it reads from a pool of bounded size, which is refilled before it runs low; what the last bins of
a task leave open is closed by cutting their pieces to fill one after another.

Defined results: null and empty texts are one end mark; repeated rows are examples of their own; pieces of equal demand
go in the order in which they came; a text of any length is tokenised part by part; an empty table, and a task without
rows, gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

END_MARK, LENGTH = 1, 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = LENGTH
    segments: int = 256
    loss: int = LENGTH


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    bears: np.ndarray  # whether each id bears loss
    total: int

    @property
    def loss(self) -> int:
        return int(self.bears.sum())

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.start, self.ids[:at], self.bears[:at], self.total), Piece(self.key, self.start + at, self.ids[at:], self.bears[at:], self.total)


def fits(piece: Piece, room_tokens: int, room_loss: int) -> int:
    """How many leading ids of a piece fit."""
    n = min(len(piece.ids), room_tokens)
    if piece.loss > room_loss:
        n = min(n, int(np.searchsorted(np.cumsum(piece.bears), room_loss, "right")))
    return n


class Packer:
    """Takes examples and yields full sequences, each a list of pieces."""

    def __init__(self, limits: Limits = Limits(), pool: int = 1024):
        self.limits, self.size = limits, pool
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Piece] = []

    def add(self, key, ids: np.ndarray, bears: np.ndarray | None = None) -> Iterator[list[Piece]]:
        bears = np.ones(len(ids), bool) if bears is None else bears
        rest = Piece(key, 0, ids, bears, len(ids))
        while len(rest.ids) > self.limits.tokens or rest.loss > self.limits.loss:
            head, rest = rest.cut(max(1, fits(rest, self.limits.tokens, self.limits.loss)))
            if len(head.ids) == self.limits.tokens:
                yield [head]
            else:
                self.pool.append(head)
        if len(rest.ids):
            self.pool.append(rest)
        if len(self.pool) >= self.size:
            yield from self._fill(self.size // 2)

    def _fill(self, keep: int) -> Iterator[list[Piece]]:
        pool = self.pool
        if not pool:  # a task that has read no row, or only full sequences
            return
        demand = np.array([[len(p.ids), 1, p.loss] for p in pool], float)
        share, free, left = demand / self.caps, np.ones(len(pool), bool), len(pool)
        while left > keep:
            room, chosen = self.caps.copy(), []
            while True:
                can = free & (demand <= room).all(1)
                if not can.any():
                    break
                worth = np.where(can, share @ (room / self.caps), -1.0)
                best = int(worth.argmax())
                chosen.append(pool[best])
                free[best] = False
                room -= demand[best]
            left -= len(chosen)
            yield chosen
        self.pool = [p for p, f in zip(pool, free, strict=True) if f]

    def close(self) -> Iterator[list[Piece]]:
        """The rest: good bins as they are, the pieces of the others one after another, cut where a limit is met."""
        loose: list[Piece] = []
        for made in list(self._fill(0)):
            if sum(len(p.ids) for p in made) >= 0.97 * self.limits.tokens:
                yield made
            else:
                loose += made
        now: list[Piece] = []
        tokens = loss = 0
        while loose:
            piece = loose.pop(0)
            n = fits(piece, self.limits.tokens - tokens, self.limits.loss - loss) if len(now) < self.limits.segments else 0
            if n == 0:
                yield now
                now, tokens, loss = [], 0, 0
                loose.insert(0, piece)
                continue
            if n < len(piece.ids):
                piece, rest = piece.cut(n)
                loose.insert(0, rest)
            now.append(piece)
            tokens, loss = tokens + n, loss + piece.loss
        if now:
            yield now


def packed_rows(sequences: Iterable[list[Piece]], first: int) -> Iterator[dict]:
    for k, pieces in enumerate(sequences):
        at = 0
        for p in pieces:
            yield {"doc_id": p.key, "start": p.start, "length": len(p.ids), "ids_crc32": zlib.crc32(p.ids.astype("<u4").tobytes()), "doc_tokens": p.total, "sequence_id": first + k, "offset": at}
            at += len(p.ids)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Where a text may be cut without a change of its ids: before a space or line break after a printable ASCII sign, as no
#: token of the byte-level pattern spans that place and none before it looks beyond it.
PLACE = re.compile("(?<=[!-~])[ \n\t]")
#: Characters tokenised at a time, where a text has such places.
CHUNK = 1 << 16


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of at least size characters, each of which begins where a cut changes nothing."""
    at = 0
    while len(text) - at > size:
        found = PLACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Ids:
    """Ids of texts by the byte-level file; parts within Latin-1 by the faster library of the same vocabulary.

    That library's matcher gives up on very long runs of spaces; such parts go to the other.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def part(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                text.encode("latin-1")
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except (UnicodeEncodeError, ValueError):  # the latter where the matcher gives up
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        """The text's ids and the end mark."""
        return np.concatenate([*map(self.part, chunks(text)), np.array([END_MARK], np.uint32)])


_MADE: dict = {}


def packed(docs, path: str, ranks: str | None = None, limits: Limits = Limits(), bears: str | None = None):
    """Pieces of every row of docs (doc_id, text); one pass, no shuffle.

    bears names a boolean column of docs that says whether the ids of a row bear loss; all do where it is not given.
    Sequence ids start with the task's number, so they are the same when a task runs again.
    """

    def run(batches):
        from pyspark import TaskContext

        if (path, ranks) not in _MADE:
            _MADE[path, ranks] = Ids(path, ranks)
        ids_of, packer = _MADE[path, ranks], Packer(limits)

        def sequences():
            for b in batches:
                for key, text, loss in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    ids = ids_of(text.as_py() or "")
                    yield from packer.add(key, ids, np.full(len(ids), loss))
            yield from packer.close()

        rows = []
        for row in packed_rows(sequences(), TaskContext.get().partitionId() << 33):
            rows.append(row)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    from pyspark.sql import functions as F

    loss = F.coalesce(docs[bears], F.lit(False)) if bears else F.lit(True)
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), loss.alias("bears"))
    return picked.mapInArrow(run, SCHEMA)


ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def documents_packed(docs):
    """Every id of a document bears loss, so here the loss limit is the token limit; conversations_packed has its own."""
    import public_tokenizers as P

    return packed(docs, str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")))


#: Limits of instruction data: half a sequence may bear loss.
TURNS = Limits(segments=64, loss=LENGTH // 2)


def conversations_packed(turns, limits: Limits = TURNS, answers: str = "assistant"):
    """Turns of conversations as examples whose ids bear loss where the role is that of answers.

    A row of turns is conv_id, turn, role, text; the result's doc_id is conv_id. Turns of a conversation are examples of
    their own, each closed by the end mark; a null role is not that of answers.
    """
    import public_tokenizers as P
    from pyspark.sql import functions as F

    rows = turns.select(turns["conv_id"].alias("doc_id"), turns["text"], F.coalesce(turns["role"] == answers, F.lit(False)).alias("bears"))
    return packed(rows, str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), limits, "bears")


def op7_vector_packing(spark, sf_dir: str):
    """All documents in sequences of at most 2048 tokens."""
    from orbweft.session import table

    return documents_packed(table(spark, sf_dir, "documents"))
