"""Language identification by hierarchical discrimination.

First the family of a text's language is decided, then one-versus-one linear support vector machines separate the
languages of that family and vote. All of them are linear in the shares of a text's letter n-grams, so a whole text is
scored in one pass over its bytes: each n-gram adds its weights, and no vector of the text is ever made.

Training takes a bounded sample, by a hash of doc_id, of those rows that may be learned from: PER_LANGUAGE texts of each
language or, where languages are so many that this would exceed TOTAL texts, an equal share of TOTAL, one at least. Every
language that has such a row is learned. Of rows with one doc_id and language the least text is taken. Every other row
is only predicted; of languages, or families, that tie, the first by name wins.

Defined results: null texts and texts without a letter are ``und`` with score 0; where nothing can be learned every
text is ``und``; rows whose language is null are predicted but not learned from; a null doc_id is not held out and not
learned from; repeated rows are predicted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweft.llm.arrays import flat, runs
from orbweft.session import table

#: Families by language code; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
PER_LANGUAGE, TOTAL = 400, 400 * 64
#: Hashed n-grams; bytes scored at a time.
TERMS, SLICE = 4096, 1 << 20
UNKNOWN = "und"


def family_of(language: str) -> str:
    return next((f for f, own in FAMILIES.items() if language.split("-")[0].lower() in own), language)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case as far as Latin-1 goes, all else that is ASCII as a space."""
    out = _FOLD[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hashed trigram for every byte of the texts; TERMS where it would leave its text."""
    x = folded(data).astype(np.uint32)
    n = len(x)
    code = np.full(n, TERMS, np.int64)
    if n > 2:
        h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        code[:-2] = (h >> np.uint32(20)).astype(np.int64)
        for k in (1, 2):
            edge = off[1:] - k
            code[edge[(edge >= off[:-1])]] = TERMS
    return code


def sliced(size: int, step: int):
    """Parts of one text, each with the byte before it and the two after it: from, to, and where its own bytes lie."""
    for a in range(0, size, step):
        low = max(0, a - 1)
        yield low, min(size, a + step + 2), a - low, min(step, size - a)


def histogram(data: np.ndarray, step: int = SLICE) -> np.ndarray:
    """Number of times one text has each hashed n-gram, taken in step bytes at a time."""
    out = np.zeros(TERMS + 1, np.int64)
    for low, high, at, n in sliced(len(data), step):
        out += np.bincount(terms(data[low:high], np.array([0, high - low]))[at : at + n], minlength=TERMS + 1)
    return out[:TERMS]


def shares(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of each hashed n-gram, a row a text."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float32)
    if n == 1 and len(data) > SLICE:
        got = histogram(data)
        out[0] = got / max(1, got.sum())
        return out
    code = terms(data, off)
    for i in range(n):
        got = np.bincount(code[off[i] : off[i + 1]], minlength=TERMS + 1)[:TERMS]
        out[i] = got / max(1, got.sum())
    return out


def svm(x: list[tuple[np.ndarray, np.ndarray]], c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps. x: parts of the examples, a row each, and
    the signs of their rows; the parts are read where they lie, so that the sample is held once."""
    n, d = sum(len(sign) for _, sign in x), x[0][0].shape[1]

    def forth(part, v):
        return part @ v[:d] + v[d]

    def back(parts):
        out = np.zeros(d + 1, np.float32)
        for (part, _), u in zip(x, parts, strict=True):
            out[:d] += u @ part
            out[d] += u.sum()
        return out

    v = np.ones(d + 1, np.float32)
    for _ in range(20):
        v = back([forth(part, v) for part, _ in x])
        v /= np.linalg.norm(v)
    rate = np.float32(1.0 / (1.0 + 2 * c / n * np.linalg.norm(back([forth(part, v) for part, _ in x]))))
    w = ahead = np.zeros(d + 1, np.float32)
    for k in range(steps):
        step = ahead - rate * (ahead - np.float32(2 * c / n) * back([sign * np.maximum(0, 1 - sign * forth(part, ahead)) for part, sign in x]))
        ahead = step + np.float32(k / (k + 3)) * (step - w)
        w = step
    return w[:-1], float(w[-1])


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each column; x itself becomes what lies between, over the root of its width."""
    mean, spread = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    if len(x):
        x.mean(0, out=mean)
        x -= mean
        for i in range(0, x.shape[1], 256):
            spread[i : i + 256] = np.sqrt(np.square(x[:, i : i + 256]).mean(0))
    spread += np.float32(1e-4)
    x /= spread
    x /= np.float32(np.sqrt(x.shape[1]))
    return mean, spread


@dataclass
class Model:
    """Weights (TERMS + 1, columns) and biases: a column for each family, then one for each pair within a family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        """labels in order; x is overwritten."""
        languages = sorted(set(labels))
        families = sorted({family_of(k) for k in languages})
        mean, spread = standardised(x)
        own = {k: x[bisect.bisect_left(labels, k) : bisect.bisect_right(labels, k)] for k in languages}
        pairs = [p for f in families for p in itertools.combinations([k for k in languages if family_of(k) == f], 2)]
        weights = np.zeros((TERMS + 1, len(families) + len(pairs)), np.float32)
        bias = np.zeros(weights.shape[1])
        for k, yes in enumerate([*({j: family_of(j) == f for j in languages} for f in families), *({a: True, b: False} for a, b in pairs)]):
            if k < len(families) and len(families) == 1:
                bias[k] = 1.0
                continue
            w, b = svm([(own[j], np.full(len(own[j]), 1.0 if good else -1.0, np.float32)) for j, good in yes.items()])
            w = w / spread / np.sqrt(TERMS)
            weights[:TERMS, k], bias[k] = w, b - float(mean @ w)
        return cls(languages, families, pairs, weights, bias)

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) == 2 and len(data) > SLICE:  # one long text
            got = histogram(data)
            return (got @ self.weights[:TERMS].astype(np.float64) / max(1, got.sum()) + self.bias)[None]
        code = terms(data, off)
        count = np.diff(np.concatenate([[0], np.cumsum(code < TERMS)])[off])
        out = np.empty((len(off) - 1, len(self.bias)))
        for k in range(out.shape[1]):
            total = np.zeros(len(code) + 1)
            np.cumsum(self.weights[code, k], out=total[1:], dtype=np.float64)
            out[:, k] = np.diff(total[off]) / np.maximum(count, 1) + self.bias[k]
        return out

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the family with the largest margin, then the votes of its pairs."""
        n, f = len(margins), len(self.families)
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        best = margins[:, :f].argmax(1)
        votes = np.zeros((n, len(self.languages)))
        for j, k in enumerate(self.languages):
            own = [(i, a == k) for i, (a, b) in enumerate(self.pairs) if k in (a, b)]
            won = [sure(margins[:, f + i] * (1 if yes else -1)) for i, yes in own]
            votes[:, j] = np.where(best == self.families.index(family_of(k)), np.mean(won, 0) if won else 1.0, -1.0)
        pick = votes.argmax(1)
        return pick, sure(margins[np.arange(n), best]) * votes[np.arange(n), pick]


def held_out(doc_id: Column, parts: int, one: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == one, F.lit(False))


def sample(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> DataFrame:
    """lang and text of a bounded sample of every language; the row with the least hash of each is always in it."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = rows.groupBy("lang").agg(F.count("*"), F.min(place)).collect()
    each = max(1, min(per_language, total // max(1, len(counts))))
    most = docs.sparkSession.createDataFrame([(lang, max(least, min(1.0, each / n))) for lang, n, least in counts], "lang string, most double")
    chosen = rows.select("lang", "doc_id", "text", place.alias("place")).join(F.broadcast(most), "lang").where("place <= most")
    return chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, allowed: Column) -> Model:
    def run(batches):
        for b in batches:
            data, off = flat(b.column(1))
            for i, j in runs(off, SLICE):
                x = shares(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([zlib.compress(r, 1) for r in x], pa.binary())], ["lang", "x"])

    rows = sample(docs, allowed).mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.empty((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(r.x), np.float32)
    return Model.fit(x, [r.lang for r in rows])


def predictions(docs: DataFrame, model: Model, keep: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns keep of docs with the predicted language and score of text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    names = [*keep, pred, score]
    width = len(keep)
    schema = ready.select(*keep, F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def run(batches):
        m = sent.value
        known = np.array(m.languages or [UNKNOWN], object)
        for b in batches:
            n = b.num_rows
            language, value = np.full(n, UNKNOWN, object), np.zeros(n)
            if m.languages:
                letter = b.column(width + 1).to_numpy(zero_copy_only=False).astype(bool)
                data, off = flat(b.column(width))
                for i, j in runs(off, SLICE):
                    pick, sure = m.predict(m.margins(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                    language[i:j] = np.where(letter[i:j], known[pick], UNKNOWN)
                    value[i:j] = np.where(letter[i:j], np.clip(sure, 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(language, pa.string()), pa.array(value)], names)

    return ready.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = train(rows, ~F.col("held_out"))
    return predictions(rows, model, ["doc_id", "held_out"])


def op3_language_svm(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identified(table(spark, sf_dir, "documents"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known, with their columns. A text without letters goes; one with
    letters stays, however short it is and whatever its score."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows, F.lit(True))
    if not model.languages:
        return docs
    out = predictions(rows, model, ["row"])
    return out.where(F.col("lang_pred") != UNKNOWN).select("row.*")
