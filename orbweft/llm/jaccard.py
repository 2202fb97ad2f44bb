"""N-gram Jaccard join: size-banded tiles, bitmap bounds and exact intersection.

Texts are sets of 64-bit hashes of their distinct five-word shingles. Texts with the same set form a class, and only
classes are compared. Two sets that link must share one of the first n - ceil(0.8 n) + 1 shingles of each in any one
order of all shingles; the order here is (how common, hash), so that passages which many documents share come last. A
tile is what shares such a shingle, banded by size: a pair is looked at only if its sizes allow a link. Of each pair the
bits by which two hashed parity bitmaps differ bound the overlap from above; what passes is intersected exactly, on sets
made again from the texts, so that no set is kept of a class whose bitmaps refuse every pair.

Within a tile pairs are taken in rounds: each class has a level, drawn from its hash, and a round takes the pairs whose
higher level is the round's. Links found so far are contracted first, so classes already connected are never paired
again: a group of near copies costs a few pairs a member, whatever its size, while every pair that could join two
components is looked at in some round. All pairs of a group are never made, and no link between components is lost.

Defined results: words are runs of bytes other than space and tab to carriage return, A-Z in lower case; fewer than
five words make one shingle; null texts and texts without words have no shingle, link with nothing and are components
of their own; repeated rows belong to one class; a null doc_id is never a component's smallest unless it is the only
one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweft.llm.arrays import batch, flat, mix, runs
from orbweft.session import forget, stored, table

WORDS, PERCENT = 5, 80
#: Bytes hashed at a time; bytes within which repeats of a shingle are counted.
SLICE, WINDOW = 1 << 18, 1 << 24
#: A shingle is common from so many counted repeats on; commonness is kept in a table of fixed size.
COMMON, SLOT_BITS = 64, 20
#: Common shingles' postings are dealt to one task for each so many counted repeats, a power of two.
SALTED = 4096
#: Rows of one key that a task holds at once.
HELD = 1 << 17
#: Of classes, one in 16 ** level has that level, TOP at most; in tiles up to SMALL all have TOP.
STEP_BITS, TOP, SMALL = 4, 7, 32
#: Slots of the bitmaps that tell whose sets are made again, 2 MB each.
FINE_BITS = 24
#: Numbers of 64 bits of the bitmap that a tile's rows carry.
MARKS = 8

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = mix(np.arange(1, WORDS + 2, dtype=np.uint64) * _PRIME) | np.uint64(1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def raw_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial over the bytes of each word, its start and its end; words also part at the edges of texts."""
    n = len(data)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = edges[1:] > edges[:-1]
    a, b = edges[:-1][full], edges[1:][full] - 1
    first[a], last[b] = word[a], word[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return (total[ends] - total[starts]) * down[starts], starts, ends


def long_words(data: np.ndarray, step: int) -> np.ndarray:
    """Hash of every word of one text, taken in step bytes at a time; a word goes on over any number of steps."""
    out: list[np.ndarray] = []
    part, size = np.zeros(1, np.uint64), 0  # of the word that is open
    for i in range(0, len(data), step):
        piece = data[i : i + step]
        raw, starts, ends = raw_words(piece, np.array([0, len(piece)]))
        if size and (not len(raw) or starts[0] > 0):
            out.append(part)
            size = 0
        elif size:
            raw[0] = (part + raw[:1] * np.array([pow(int(_PRIME), size, 1 << 64)], np.uint64))[0]
            size += int(ends[0]) if len(raw) == 1 else 0
        if len(raw) and ends[-1] == len(piece):
            size = size if len(raw) == 1 and size else int(ends[-1] - starts[-1])
            part, raw = raw[-1:].copy(), raw[:-1]
        else:
            size = 0
        out.append(raw)
    if size:
        out.append(part)
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the number of words before each text."""
    raw, starts, _ = raw_words(data, off)
    return mix(raw), np.searchsorted(starts, off)


def shingle_sets(words: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles."""
    part = words * _PLACES[0]
    if len(words) >= WORDS:
        whole = part[: len(words) - WORDS + 1].copy()
        for k in range(1, WORDS):
            whole += words[k : len(words) - WORDS + 1 + k] * _PLACES[k]
        whole = mix(whole)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= WORDS:
            s = np.sort(whole[a : b - WORDS + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if n > WORDS else s
        elif n:
            yield mix((words[a:b] * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.array([n], np.uint64) * _PLACES[WORDS])
        else:
            yield words[:0]


def column_sets(column: pa.Array, slice_: int = SLICE) -> Iterator[np.ndarray]:
    data, off = flat(column)
    for a, b in runs(off, slice_):
        if off[b] - off[a] > slice_:  # one long text
            words = long_words(data[off[a] : off[b]], slice_)
            yield from shingle_sets(words, np.array([0, len(words)]))
        else:
            yield from shingle_sets(*word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a]))


def class_of(s: np.ndarray) -> int:
    """Digest of a set; 0 is that of the empty set."""
    if not len(s):
        return 0
    whole = mix(s ^ _PRIME).sum(keepdims=True, dtype=np.uint64) + np.array([len(s)], np.uint64) * _PLACES[1]
    return int((mix(whole) | np.uint64(1)).astype(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the hashes that fall on each bit; as many bits as the next power of two from the size, 64 at least."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def marks(s: np.ndarray) -> np.ndarray:
    """The same for a fixed number of bits, as MARKS numbers of 64."""
    odd = np.bincount((s & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(bool)).view(">i8").astype(np.int64)


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """The overlap of two sets cannot exceed this: every differing bit takes a hash that only one of them has."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int((x ^ y).sum())) // 2


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def scan(texts: DataFrame) -> DataFrame:
    """doc_id, n, cls, home of every row; and key, n of shingles that repeat within a window (is_doc false).

    home is a hash of the text by which sets_of() finds the texts of a class again.
    """
    schema = pa.schema([("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("home", pa.int64())])

    def run(batches):
        window: dict[int, np.ndarray] = {}
        size = 0

        def repeats():
            keys = np.concatenate(list(window.values()))
            window.clear()
            keys.sort()
            key, n = np.unique(keys[1:][keys[1:] == keys[:-1]], return_counts=True)
            return batch(schema, np.zeros(len(key), bool), pa.nulls(len(key), pa.int64()), n + 1, key.view(np.int64), pa.nulls(len(key), pa.int64()))

        for b in batches:
            n, cls = [], []
            for s in column_sets(b.column(1)):
                n.append(len(s))
                cls.append(c := class_of(s))
                if len(s) and c not in window:  # a copy says nothing new
                    window[c] = s
                    size += 6 * len(s)
                    if size >= WINDOW:
                        yield repeats()
                        size = 0
            yield batch(schema, np.ones(len(n), bool), b.column(0), n, cls, b.column(2))
        if window:
            yield repeats()

    return texts.select("*", F.xxhash64("text")).mapInArrow(run, "is_doc boolean, doc_id long, n long, cls long, home long")


def common_levels(repeats: DataFrame) -> np.ndarray:
    """For each slot of the hash space how common its commonest shingle is; a table of fixed size."""
    slot = F.shiftrightunsigned("cls", 64 - SLOT_BITS)
    level = F.floor(F.log2(F.col("n") / COMMON)) + 1
    found = repeats.groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select(slot.cast("int").alias("slot"), level.cast("int").alias("level"))
    rows = found.groupBy("slot").agg(F.max("level").alias("level")).toPandas()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[rows["slot"].to_numpy(np.int64)] = rows["level"].to_numpy(np.uint8)
    return out


def salt_of(own: np.ndarray, cls: int) -> np.ndarray:
    """0 for shingles that are not common, else one of as many numbers as tasks share the shingle's postings."""
    many = np.int64(1) << np.clip(own.astype(np.int64) - SALTED.bit_length() + COMMON.bit_length(), 0, 30)
    return np.where(own > 0, 1 + (cls >> 24) % many, 0).astype(np.int32)


def prefixes(texts: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """key, salt, cls, n of the shingles by which a class may be found."""
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()), ("n", pa.int32())])
    sent = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        level = sent.value
        for b in batches:
            seen: set[int] = set()
            keys, salts, classes, sizes = [], [], [], []
            for s in column_sets(b.column(1)):
                n = len(s)
                if not n or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                k = n - -(-percent * n // 100) + 1
                own = level[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                if own.any():
                    pick = np.argsort(own, kind="stable")[:k]
                    s, own = s[pick], own[pick]
                else:
                    s, own = s[:k], own[:k]
                keys.append(s)
                salts.append(salt_of(own, c))
                classes.append(np.full(len(s), c))
                sizes.append(np.full(len(s), n, np.int32))
            if keys:
                yield batch(schema, np.concatenate(keys).astype(np.int64), np.concatenate(salts), np.concatenate(classes), np.concatenate(sizes))

    return texts.mapInArrow(run, "key long, salt int, cls long, n int")


def tiles(postings: DataFrame, percent: int = PERCENT, held_rows: int = HELD) -> DataFrame:
    """tile, cls, n of the classes that share a shingle and whose sizes form a band; tiles of the same classes are one.

    Within a key classes come by size, and a tile ends where the next size is too large for any link. A key whose rows
    one task does not hold at once, or whose rows are dealt to several tasks, is one tile of all its classes.
    """
    schema = pa.schema([("tile", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())])

    def cut(key, salt, cls, n, seen):
        other = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        new = np.concatenate([[True], other | (cls[1:] != cls[:-1])])
        key, salt, cls, n = key[new], salt[new], cls[new], n[new]
        other = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        gap = (salt[1:] == 0) & (100 * n[:-1].astype(np.int64) < percent * n[1:])  # no link reaches over it
        starts = np.flatnonzero(np.concatenate([[True], other | gap]))
        size = np.diff([*starts, len(key)])
        salted = salt[starts] > 0
        tile = np.where(salted, mix(key[starts].astype(np.uint64)), mix(np.add.reduceat(mix(cls.astype(np.uint64)), starts))).astype(np.int64)
        keep = (size > 1) | salted
        _, first = np.unique(tile, return_index=True)
        once = np.zeros(len(starts), bool)
        once[first] = True
        keep &= once | salted
        for i in np.flatnonzero(keep & ~salted):
            if tile[i] in seen:
                keep[i] = False
            else:
                seen.add(tile[i])
        if len(seen) > 1 << 18:
            seen.clear()
        each = np.repeat(keep, size)
        return batch(schema, np.repeat(tile, size)[each], cls[each], n[each])

    def run(batches):
        held, seen, large = [], set(), None
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(part[0]):
                continue
            if large is not None:  # what is left of a key whose first rows have gone out as a tile
                part[1] = np.where(part[0] == large, np.maximum(part[1], 1), part[1])
            held.append(part)
            rows = sum(len(p[0]) for p in held)
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
            if last:
                yield cut(*(c[:last] for c in whole), seen)
                held = [[c[last:] for c in whole]]
            elif rows > held_rows:  # a key beyond what is held at once is one tile of all its classes
                large = whole[0][0]
                whole[1] = np.maximum(whole[1], 1)
                yield cut(*whole, seen)
                held = []
        if held:
            yield cut(*(np.concatenate(c) for c in zip(*held, strict=True)), seen)

    dealt = postings.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "cls")
    return dealt.mapInArrow(run, "tile long, cls long, n int")


def signatures(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, bits and marks of the wanted classes, once from each task that has them.

    A table of fixed size screens texts where they are read; what passes by chance costs room, not results.
    """
    sent = slots_of(wanted)
    names = [f"mark{i}" for i in range(MARKS)]
    schema = pa.schema([("cls", pa.int64()), ("bits", pa.binary()), *[(n, pa.int64()) for n in names]])

    def run(batches):
        marked = np.unpackbits(sent.value).view(bool)
        seen: set[int] = set()
        for b in batches:
            cls, bits, own = [], [], []
            for s in column_sets(b.column(1)):
                c = class_of(s)
                if not c or c in seen or not marked[(c & (1 << 64) - 1) >> (64 - SLOT_BITS)]:
                    continue
                seen.add(c)
                cls.append(c)
                bits.append(bitmap(s))
                own.append(marks(s))
            if len(seen) > 1 << 18:
                seen.clear()
            if cls:
                yield batch(schema, cls, bits, *np.stack(own, 1))

    return texts.mapInArrow(run, "cls long, bits binary, " + ", ".join(f"{n} long" for n in names))


def slots_of(hashes: DataFrame, column: str = "cls", slot_bits: int = SLOT_BITS):
    """A bitmap of fixed size over the first bits of a column of hashes, sent to the executors."""
    slot = F.shiftrightunsigned(column, 64 - slot_bits)
    found = np.zeros(1 << slot_bits, bool)
    found[hashes.select(slot.cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    return hashes.sparkSession.sparkContext.broadcast(np.packbits(found))


def among(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes, signed numbers of 64 bits, have their slot of a packed bitmap set."""
    slot = hashes.view(np.uint64) >> np.uint64(64 - (len(packed).bit_length() + 2))
    return (packed[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def sets_of(texts: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, items of the classes of pairs, made again from the texts, once from each task that has them; written.

    One bitmap tells of which rows the texts are taken in hand, another whose sets are kept; what passes by chance costs
    time and room, not results.
    """
    schema = pa.schema([("cls", pa.int64()), ("items", pa.binary())])
    wanted = slots_of(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))), "cls", FINE_BITS)

    def at(batches):
        for b in batches:
            yield b.filter(pa.array(among(wanted.value, b.column(0).to_numpy()))).select([1])

    homes = slots_of(rows.mapInArrow(at, "home long"), "home", FINE_BITS)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(among(homes.value, b.column(0).to_numpy())))
            cls, items, size = [], [], 0
            for s in column_sets(b.column(1)):
                c = class_of(s)
                if not c or c in seen or not among(wanted.value, np.array([c]))[0]:
                    continue
                seen.add(c)
                cls.append(c)
                items.append(s.tobytes())
                size += s.nbytes
                if size > 1 << 23:
                    yield batch(schema, cls, items)
                    cls, items, size = [], [], 0
            if len(seen) > 1 << 18:
                seen.clear()
            if cls:
                yield batch(schema, cls, items)

    out = stored(texts.select(F.xxhash64("text"), "text").mapInArrow(run, "cls long, items binary"), "items")
    wanted.destroy()
    homes.destroy()
    return out


def of_pairs(pairs: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """a, b and column of both. What is known of other classes is left where it is read, but for chance."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    sent = slots_of(wanted)

    def screen(batches):
        marked = np.unpackbits(sent.value).view(bool)
        for x in batches:
            slot = (x.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            yield x.filter(pa.array(marked[slot]))

    near = known.select("cls", column).mapInArrow(screen, f"cls long, {column} binary")
    own = near.groupBy("cls").agg(F.first(column).alias(column))
    left, right = (own.select(F.col("cls").alias(k), F.col(column).alias(f"of_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b")


def bounded(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those pairs a, b, n_a, n_b whose bitmaps allow a link."""

    def run(batches):
        for x in batches:
            keep = []
            for n, m, p, q in zip(*(x.column(i).to_pylist() for i in range(2, 6)), strict=True):
                most = overlap_bound(p, q, n, m)
                keep.append(100 * most >= percent * (n + m - most))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return of_pairs(pairs, known, "bits").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those pairs a, b that link, by exact intersection."""

    def run(batches):
        for x in batches:
            keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return of_pairs(pairs, known, "items").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """node, root of every node of links: alternating large and small stars, each round written to the shared folder.

    Minima are aggregated before they are joined back, so a node with very many links is no task's burden.
    """
    edges = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "edges")
        forget(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    forget(edges)
    return out


def level(cls: Column) -> Column:
    """0 for 15 classes in 16, 1 for 15 in 16 of the others, and so on up to TOP."""
    h, out = F.xxhash64(cls), F.lit(0)
    for k in range(1, TOP + 1):
        out = F.when(F.pmod(h, F.lit(1 << (STEP_BITS * k))) == 0, k).otherwise(out)
    return out


def links_of(texts: DataFrame, rows: DataFrame, repeats: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """node, root of the classes that link with another; None where no two share a shingle. rows: cls, home of the texts.

    A written table is deleted as soon as the one that replaces it is written.
    """
    shared = stored(tiles(prefixes(texts, common_levels(repeats), percent), percent), "shared")
    once = shared.dropDuplicates(["tile", "cls"])
    sizes = once.groupBy("tile").agg(F.count("*").alias("m")).where("m > 1")
    members = once.join(sizes, "tile").withColumn("level", F.when(F.col("m") <= SMALL, TOP).otherwise(level(F.col("cls"))))
    members = stored(members.select("tile", "cls", "n", "level", (F.col("m") > SMALL).alias("large")), "tiles")
    forget(shared)
    if members.isEmpty():
        forget(members)
        return None
    known = stored(signatures(texts, members), "signatures")
    names = [f"mark{i}" for i in range(MARKS)]
    marked = stored(members.join(known.groupBy("cls").agg(*[F.min(n).alias(n) for n in names]), "cls"), "marked")
    forget(members)
    large = marked.where("large")
    top = large.agg(F.max("level")).first()[0] or 0
    links = roots = open_ = None
    left = marked.withColumn("root", F.col("cls"))
    for now in range(top, -1, -1):
        if now < top:  # tiles that are small or within one component are done with
            left = large
            if roots is not None:
                left = left.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
                left = left.withColumn("root", F.coalesce("root", "cls"))
                several = left.groupBy("tile").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("tile")
                left = left.join(several, "tile")
            else:
                left = left.withColumn("root", F.col("cls"))
            if open_ is not None:
                forget(open_)
            left = open_ = stored(left.select("tile", "cls", "n", "level", "root", *names), "open")
            if left.isEmpty():
                break
        first = left.where((F.col("level") >= now) if now == top else (F.col("level") == now)).select(F.col("level").alias("level_x"), "tile", F.col("cls").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"), *[F.col(k).alias(f"{k}_x") for k in names])
        other = left.select("tile", F.col("cls").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("root_y"), F.col("level").alias("level_y"), *[F.col(k).alias(f"{k}_y") for k in names])
        # A link needs an overlap of percent / (100 + percent) of both sizes; differing bits bound it from above.
        apart = sum((F.bit_count(F.col(f"{k}_x").bitwiseXOR(F.col(f"{k}_y"))) for k in names[1:]), F.bit_count(F.col(f"{names[0]}_x").bitwiseXOR(F.col(f"{names[0]}_y"))))
        both = F.col("n_x") + F.col("n_y")
        alike = (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & ((100 + percent) * (both - apart) >= 2 * percent * both)
        pairs = first.join(other, "tile").where((F.col("root_x") != F.col("root_y")) & alike & ((F.col("level_y") < F.col("level_x")) | ((F.col("level_y") == F.col("level_x")) & (F.col("x") < F.col("y")))))
        up = F.col("x") < F.col("y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(up, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(up, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b")).distinct()
        pairs = stored(pairs, "pairs")
        likely = stored(bounded(pairs, known, percent), "likely")
        forget(pairs)
        if likely.isEmpty():
            forget(likely)
            continue
        sets = sets_of(texts, rows, likely)
        found = stored(verified(likely, sets, percent), "links")
        forget(likely, sets)
        if not found.isEmpty():
            merged = components(found if links is None else links.union(found))
            if roots is not None:
                forget(roots)
            roots = merged
            links = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        forget(found)
    forget(marked, known, *([open_] if open_ is not None else []))
    return roots


def joined(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = stored(scan(texts), "classes")
    rows = seen.where("is_doc").select("doc_id", "n", "cls")
    roots = links_of(texts, seen.where("is_doc").select("cls", "home"), seen.where("NOT is_doc"), percent)
    if roots is not None:
        rows = rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    root = F.coalesce(F.col("root"), F.col("cls")) if roots is not None else F.col("cls")
    rows = rows.select("doc_id", "n", "cls", root.alias("root"))
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("low"), F.count("*").alias("size")).where("size > 1")
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class_id"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when each component keeps its smallest doc_id, with their columns.

    A doc_id that several rows have stays with all of them if any of them is its component's smallest.
    """
    found = joined(docs)
    gone = found.where("component_id IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("component_id") < F.col("doc_id")).cast("int")).alias("g")).where("g = 1").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents joined on five-word shingles at a similarity of 0.8."""
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (
  SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
), c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c.root, n.doc_id) AS component_id FROM n LEFT JOIN c ON n.doc_id = c.doc_id
"""
