"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge list admits a *sufficient lookahead* L: once L further symbols of a word have been seen, nothing that follows
can change the tokens before them. Merging runs in rank order, so a difference between two continuations moves left
only through a chain of rules of rising rank in which each rule's right operand is what the rule before it makes or
takes away; L is the longest such chain, measured in symbols, and is computed from the list (``MergeList.lookahead``).
The encoder keeps one window of a word, merges it, emits the tokens that end L or more symbols before its end and goes
on from there. Every word goes through this transducer; ids of short words are kept and looked up when they come again.
Memory is bounded by the window and the table of kept words, whatever the length of a text or word; the one thing held
whole is a run of combining marks or Hangul vowels and finals, as its normal form depends on all of it. The decoder is
a state machine that takes ids and emits text as soon as its bytes form whole characters.

Defined results: null text is the empty text, which has no tokens; repeated rows each give their own row; an empty
table gives an empty result; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

END = "</w>"
#: Characters of a text that are taken in at a time.
CHUNK = 1 << 16
#: Words and other runs between spaces kept with their ids in a generation; each Python worker has two.
CACHE = 1 << 19
#: A full stop or comma after a word becomes a run of its own, so that the word is looked up as elsewhere.
STOPS = re.compile("(?<=[a-zß-öø-ÿ])([.,])(?=[ \n]|$)")
#: Spaces of Python that the pattern below takes for other characters.
ODD = re.compile("[\x1c-\x1f]")
SPACES = frozenset(" \n\t")
#: Characters before the end of what is held among which a place to cut is sought; longer words are not kept.
LONG = 2048
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)", re.IGNORECASE | re.ASCII)
#: ASCII signs that an apostrophe after them continues; the sign that ends a mark is none of them.
SIGNS = frozenset("!\"#$%&'()*+,-./:;<=?@[\\]^_`{|}~")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Words:
    """What a word is, for given classes of letters, numbers and spaces; and what an open word goes on with."""

    def __init__(self, letters: str, numbers: str, spaces: str):
        signs = f"[^{spaces}{letters}{numbers}]+"
        self.all = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|{signs}").findall
        self.more = {"L": re.compile(f"[{letters}]+"), "P": re.compile(signs)}

    def open_kind(self, word: str) -> str | None:
        """What may follow within this word: letters, signs or, after a contraction or a number, nothing."""
        return next((k for k, p in self.more.items() if p.fullmatch(word)), None)


def latin_words() -> Words:
    """For texts within Latin-1."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return Words(kinds["L"], kinds["N"], re.escape("\t\n\x0b\x0c\r \x85\xa0"))


def any_words() -> Words:
    """For any text, with the classes as the tokenizers library has them; Unicode versions differ between matchers."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = []
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        split = pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True)
        kinds.append("".join(f"{re.escape(t[0])}-{re.escape(t[-1])}" for t, _ in split.pre_tokenize_str(every)))
    return Words(*kinds)


def starts_anew(c: str) -> bool:
    """Whether no normal form joins this character to those before it."""
    return c < "\x80" or not (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or "\u1160" <= c <= "\u11ff" or "\U00016d40" <= c <= "\U00016d7f")


class MergeList:
    """Vocabulary and merges of a BPE file of the tokenizers library."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str | None):
        self.vocab, self.suffix = vocab, suffix or ""
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        for rank, (a, b) in enumerate(pairs):
            self.rules.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.rank_of = {pair: rank for pair, (rank, _) in self.rules.items()}
        self.made = [vocab[a + b] for a, b in pairs]
        self.lookahead = self._lookahead(pairs)
        chars = byte_chars()
        self.base = [vocab.get(c, -1) for c in chars]
        self.last = [vocab.get(c + self.suffix, -1) for c in chars]

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        size = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        reach: dict[str, int] = {}  # of rules so far that take this token as left operand or make it
        most = 1
        for a, b in pairs:
            far = max(size(a) + size(b), size(a) + reach.get(b, 0))
            for t in (a, a + b):
                if far > reach.get(t, 0):
                    reach[t] = far
            most = max(most, far)
        return most + 1  # the last symbol of a word is known only at its end

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank and leftmost first."""
        if len(ids) > 96:
            return self._merge_long(ids)
        rank_of, made, none = self.rank_of, self.made, len(self.made)
        ranks = [rank_of.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of.get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of.get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rules = len(ids), self.rules
        ids, after, before = list(ids), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rules.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        return [t for t in ids if t >= 0]


class WordTransducer:
    """Ids of one word whose bytes arrive in pieces; memory is bounded by the window."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self.m = merges
        self.size = max(window or 4 * merges.lookahead, 2 * merges.lookahead)
        self.held: int | None = None
        self.window: list[int] = []
        self.peak = 0

    def feed(self, data: bytes) -> Iterator[int]:
        if not data:
            return
        symbol, at = self.m.base.__getitem__, 0
        if self.held is not None:
            self.window.append(symbol(self.held))
        self.held = data[-1]
        while (until := at + self.size - len(self.window)) < len(data):
            self.window += map(symbol, data[at:until])
            at = until
            yield from self._stable()
        self.window += map(symbol, data[at:-1])

    def _stable(self) -> Iterator[int]:
        self.peak = max(self.peak, len(self.window))
        tokens, at, until = self.m.merge(self.window), 0, len(self.window) - self.m.lookahead
        for t in tokens:
            width = self.m.widths[t]
            if at + width > until:
                break
            at += width
            yield t
        self.window = self.window[at:]

    def end(self) -> Iterator[int]:
        if self.held is not None:
            self.window.append(self.m.last[self.held])
            yield from self.m.merge(self.window)
        self.held, self.window = None, []


class Encoder:
    """Encodes texts as the tokenizers library does for a word-level BPE file: NFC, lower case, words, merges.

    ``pieces`` is the streaming form; ``encode`` joins it. Words met before are looked up.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = MergeList(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        names = {i: t for t, i in model["vocab"].items()}
        suffix = self.merges.suffix
        self.merges.widths = {i: len(t.removesuffix(suffix) if suffix else t) for i, t in names.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = names | {i: t for t, i in self.special.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.mark_len = max(map(len, self.special), default=1)
        self.latin = latin_words()
        self.runs = _Kept(self._run)

    @functools.cached_property
    def any(self) -> Words:
        return any_words()

    @functools.cached_property
    def normal(self):
        from tokenizers import normalizers

        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))), "<u4")

    def pieces(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Little-endian ids of the text that the chunks make up, as soon as they are stable."""
        rest, word = "", None
        for chunk in chunks:
            rest += chunk
            cut = self._cut(rest)
            out, word = self._take(rest[:cut], word, rest[cut : cut + 1] in SPACES)
            rest = rest[cut:]
            yield from out
        out, _ = self._take(rest, word, True)
        yield from out

    def _cut(self, s: str) -> int:
        """Where s may be cut so that marks, normal forms and words before it no longer change.

        A space is such a place if no mark can span it. Without one, any character that begins a normal form, unless a
        mark spans the place or a contraction begins just before it; the word that is open there goes on after it.
        """
        for i in range(len(s) - self.mark_len, max(0, len(s) - LONG), -1):
            if s[i] in SPACES:
                return i
        for i in range(len(s) - max(self.mark_len, 8), max(2, len(s) - LONG), -1):
            if starts_anew(s[i]) and not self._spans(s, i):
                return i
        return 0

    def _spans(self, s: str, i: int) -> bool:
        """Whether a mark or a contraction may begin before i and end after it."""
        if any(s.find(m, max(0, i - len(m) + 1), i + len(m) - 1) >= 0 for m in self.special):
            return True
        if s[i - 1] == "'":
            return s[i - 2] not in SIGNS and CONTRACTION.match(s, i - 1) is not None
        return s[i - 2] == "'" and CONTRACTION.match(s, i - 2) is not None

    def _take(self, s: str, word: WordTransducer | None, closed: bool) -> tuple[list[bytes], WordTransducer | None]:
        """Ids of s; word is the pre-token that is open where s begins, or the one that is open where it ends."""
        out: list[bytes] = []
        parts: list = [s]
        if self.marks and "<" in s and (found := self.marks.search(s)):
            parts, at = [], 0
            for found in self.marks.finditer(s):
                parts += [s[at : found.start()], self.special[found[0]]]
                at = found.end()
            parts.append(s[at:])
        for k, part in enumerate(parts):
            if isinstance(part, int):
                word = self._close(word, out)
                out.append(part.to_bytes(4, "little"))
                continue
            word = self._plain(part, word, out, not closed and k == len(parts) - 1)
        if closed:
            word = self._close(word, out)
        return out, word

    def _close(self, word: WordTransducer | None, out: list[bytes]) -> None:
        if word is not None:
            out.append(np.array(list(word.end()), "<u4").tobytes())

    def _plain(self, s: str, word, out: list[bytes], open_end: bool):
        if not s:
            return word
        try:
            s.encode("latin-1")
            words, s = self.latin, s.lower()
        except UnicodeEncodeError:
            words, s = self.any, self.normal(s)
        if word is None and not open_end and not ODD.search(s):
            out.append(b"".join(map(self.runs.__getitem__, STOPS.sub(r" \1", s).split())))
            return None
        if word is not None:
            if head := words.more[word.kind].match(s):
                out.append(np.array(list(word.feed(head[0].encode())), "<u4").tobytes())
                if open_end and head.end() == len(s):
                    return word
                s = s[head.end() :]
            word = self._close(word, out)
        found = words.all(s)
        if open_end and found and s.endswith(found[-1]) and (kind := words.open_kind(found[-1])):
            tail = found.pop().encode()
            word = WordTransducer(self.merges)
            word.kind = kind
            out += map(self._word, found)
            out.append(np.array(list(word.feed(tail)), "<u4").tobytes())
            return word
        out += map(self._word, found)
        return word

    def _word(self, word: str) -> bytes:
        one = WordTransducer(self.merges)
        ids = [*one.feed(word.encode()), *one.end()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        """Ids of what stands between two spaces, in lower case."""
        if run.isascii():
            found = [run] if run.isalpha() else self.latin.all(run)
        else:
            found = self.any.all(run)
        return b"".join(map(self._word, found))


class _Kept(dict):
    """Ids of keys met before, as little-endian bytes, in two generations: a full one becomes the old one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Decoder:
    """Text of ids that arrive in pieces.

    Files without a decoder give token strings joined by spaces; byte-level files give the text of the tokens' bytes,
    in which a character is emitted once its last byte is there and bad bytes become U+FFFD.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if self.bytewise:
            back = {c: b for b, c in enumerate(byte_chars())}
            as_bytes = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        else:
            as_bytes = str.encode
        self.table = [as_bytes(names.get(i, "")) for i in range(max(names) + 1)]

    def start(self) -> tuple[bool, codecs.IncrementalDecoder]:
        return True, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, state, ids: list[int], last: bool = False):
        """(state, text) after ids."""
        first, machine = state
        glue = b"" if self.bytewise else b" "
        data = glue.join(map(self.table.__getitem__, ids))
        if ids and not first:
            data = glue + data
        return (first and not ids, machine), machine.decode(data, last)

    def decode(self, ids: list[int], step: int = 1 << 14) -> Iterator[str]:
        state = self.start()
        for i in range(0, len(ids), step):
            state, text = self.feed(state, ids[i : i + step])
            yield text
        yield self.feed(state, [], True)[1]


_MADE: dict = {}


def made(kind, path: str):
    """One encoder or decoder a worker and file."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def code_table(docs, path: str, *, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; one pass, no shuffle."""

    def run(batches):
        encoder, decoder = made(Encoder, path), made(Decoder, path)
        decimal = [str(i) for i in range(len(decoder.table))]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, digest, decoded = 0, hashlib.sha256(), hashlib.sha256()
                state = decoder.start()
                for data in encoder.pieces(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)):
                    if not data:
                        continue
                    ids = np.frombuffer(data, "<u4").tolist()
                    if n:
                        digest.update(b" ")
                    digest.update(" ".join(map(decimal.__getitem__, ids)).encode())
                    state, out = decoder.feed(state, ids)
                    decoded.update(out.encode())
                    n += len(ids)
                decoded.update(decoder.feed(state, [], True)[1].encode())
                rows.append((n, digest.hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_codec(spark, sf_dir: str):
    """Every document encoded and decoded with the public word-level vocabulary."""
    import public_tokenizers

    from orbweft.session import table

    return code_table(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
