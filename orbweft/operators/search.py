"""Symbol search: exact names, BM25 over six fields, coverage by rarity and priors, as one ranking.

Symbols have id, kind, name, fqn, signature, doc, file, is_test, exported, reopened (a block that reopens a type) and
inherited (its doc comes from elsewhere); metrics have id, pagerank (rank times number of symbols), callers. What a
question asks for is bounded by its words, so counts of names and terms are one row, broadcast to one more scan; what is
windowed are the hits.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweft.functions import text as fn
from orbweft.operators import retrieval
from orbweft.operators.graph import by_kind

#: Priors of a kind, and further priors where the question asks how something behaves; others have 1.
KINDS = {"class": 1.3, "interface": 1.25, "struct": 1.25, "trait": 1.25, "enum": 1.1, "function": 1.15, "method": 1.1, "constructor": 0.9, "route": 1.2, "module": 0.6, "section": 0.6, "test": 0.5, "variable": 0.8, "constant": 0.85, "field": 0.7, "property": 0.85, "enum_member": 0.6, "config_key": 0.9, "type_alias": 1.0, "namespace": 0.6}
ASKED = {"property": 0.78, "field": 0.78, "variable": 0.8, "constant": 0.8, "enum_member": 0.8, "class": 0.86, "interface": 0.86, "struct": 0.86, "trait": 0.86, "enum": 0.86, "type_alias": 0.86}
#: Points of a name that is exact or differs in case, share of a plain word, most symbols of a name.
EXACT, ALIKE, PLAIN, AMBIGUOUS = 22.0, 10.0, 0.35, 200
#: Weights of the fields.
FIELDS = {"name": 6.0, "split_name": 4.0, "fqn": 2.0, "signature": 1.5, "doc": 1.0, "file": 0.8}
#: Factors of tests, reopened blocks, peripheral paths, inherited docs.
TEST, REOPENED, PERIPHERAL, INHERITED = 0.35, 0.5, 0.6, 0.85
#: Kinds whose repeats of a name say nothing new.
REDUNDANT = ("namespace", "module", "section")
NAME = re.compile(r"[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*|\$[\w$]*(?:\.[^\W\d][\w$]*)*")


@dataclass
class Question:
    text: str
    terms: list[str]
    idents: list[str]
    quoted: set[str]

    @property
    def behavioural(self) -> bool:
        return is_question(self.text, len(self.terms))


def is_question(text: str, terms: int) -> bool:
    """Whether a text of three terms or more begins as a question about behaviour."""
    lead = "how|what|where|why|when|which|who|whose|does|do|did|is|are|can|could|should|would|explain|describe"
    return terms >= 3 and re.match(rf"\s*(?:{lead})\b", text, re.I) is not None


def asked(text: str) -> Question:
    """A question's terms, the names it holds and those it marks as code by quotes."""
    idents = [t for t in NAME.findall(text) if re.search(r"[A-Z_.]", t) or len(t) >= 4]
    quoted = {n.lower() for m in re.findall(r"[`'\"]([^`'\"]{1,80})[`'\"]", text) for n in NAME.findall(m)}
    return Question(text, retrieval.query_terms(text), list(dict.fromkeys(idents)), quoted)


def search(symbols: DataFrame, metrics: DataFrame, question: str, *, limit: int = 20, kinds: list[str] | None = None, path: str | None = None, tests: bool = False, platform_root: bool = False, semantic: DataFrame | None = None) -> DataFrame:
    """id, score of the best symbols; with semantic (id, rank) fused by reciprocal rank. Ties by fqn, then id."""
    q = asked(question)
    if not q.terms and not q.idents:
        return symbols.select("id", F.lit(0.0).alias("score")).limit(0)
    rows = symbols.withColumn("split_name", fn.split_identifier(F.col("name")))
    rows = rows.withColumn("__name", F.lower(F.concat_ws(" ", "name", "split_name"))).withColumn("__full", F.concat_ws(" ", "__name", F.lower("fqn"), F.lower("signature")))
    # Exact names: of code-shaped words, or of any where the question is a word or two.
    names = []
    for ident in q.idents:
        last, dotted = ident.rsplit(".", 1)[-1], "." in ident
        coded = code_shaped(ident) or ident.lower() in q.quoted
        if coded or len(q.terms) <= 2:
            hit = (F.col("fqn") == ident) | F.col("fqn").endswith("." + ident) if dotted else F.lower("name") == last.lower()
            exact = (F.col("name") == last) | (F.col("fqn") == ident)
            names.append((hit, exact, 1.0 if coded else PLAIN))
    held = lambda t: F.exists(retrieval.tokens(F.col("__name")), lambda w: w.startswith(t))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    stats = rows.agg(F.count("*").alias("__n"), *[count(h).alias(f"__m{i}") for i, (h, _, _) in enumerate(names)], *[count(held(t)).alias(f"__d{i}") for i, t in enumerate(q.terms)])
    words = list(dict.fromkeys([*q.terms, *(i.lower() for i in q.idents if "." not in i)]))
    scored = retrieval.bm25(rows, "id", FIELDS, retrieval.phrases(words)).orderBy(F.desc("score"), "id").limit(max(60, 6 * limit))
    lexical = scored.select("id", F.least(F.lit(10.0), "score").alias("__bm25"))  # a few rows
    x = rows.crossJoin(F.broadcast(stats)).join(F.broadcast(lexical), "id", "left")
    bonus, named = F.lit(0.0), F.lit(False)
    for i, (hit, exact, share) in enumerate(names):
        m = F.col(f"__m{i}")
        counts = F.coalesce(hit, F.lit(False)) & (m <= AMBIGUOUS)
        bonus = bonus + F.when(counts, F.when(exact, EXACT).otherwise(ALIKE) * share / (1 + F.log2(m))).otherwise(0.0)
        named = named | counts
    x = x.where(named | F.col("__bm25").isNotNull())
    total = F.lit(0.0)
    cover = {c: F.lit(0.0) for c in ("__full", "__name")}
    every = F.lit(True)
    for i, t in enumerate(q.terms):
        weight = fn.idf(F.col("__n"), F.col(f"__d{i}"))
        total = total + weight
        for c in cover:
            cover[c] = cover[c] + F.when(F.col(c).contains(t), weight).otherwise(0.0)
        every = every & F.col("__name").contains(t)
    score = bonus + F.coalesce(F.col("__bm25"), F.lit(0.0)) * F.when(F.col("inherited"), INHERITED).otherwise(1.0)
    if q.terms:
        score = score + cover["__full"] / total * 3 + cover["__name"] / total * 3.5
        if len(q.terms) >= 2:
            score = score + F.when(every, 2.0).otherwise(0.0)
    if kinds:
        x = x.where(F.col("kind").isin(kinds))
    if path:
        x = x.where(F.col("file").startswith(path))
    if not tests:
        score = score * F.when(F.col("is_test") | (F.col("kind") == "test"), TEST).otherwise(1.0)
    score = score * by_kind(F.col("kind"), KINDS, 1.0)
    if q.behavioural:
        score = score * by_kind(F.col("kind"), ASKED, 1.0)
    score = score * F.when(F.col("reopened"), REOPENED).otherwise(1.0) * F.when(fn.peripheral(F.col("file"), platform_root), PERIPHERAL).otherwise(1.0)
    x = x.select("id", "kind", "fqn", "reopened", "doc", score.alias("__s")).join(metrics.select("id", "pagerank", "callers"), "id", "left")
    known = F.log1p(F.coalesce("pagerank", F.lit(0.0))) * 0.8 + F.log1p(F.coalesce("callers", F.lit(0))) * 0.3
    x = x.withColumn("score", F.col("__s") + known + F.when(F.length("doc") > 0, 0.3).otherwise(0.0))
    out = damped(x).select("id", "fqn", "score")
    if semantic is not None:
        top = out.orderBy(F.desc("score"), "fqn", "id").limit(2 * max(20, limit))
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "fqn", "id"))
        return retrieval.fuse(top.select("id", rank.alias("rank")), semantic).orderBy(F.desc("score"), "id").limit(limit)
    return out.orderBy(F.desc("score"), "fqn", "id").limit(limit).select("id", "score")


def damped(hits: DataFrame) -> DataFrame:
    """Hits with each repeat of an fqn below the best one at a lower score: halved where repeats say nothing new."""
    before = F.least(F.row_number().over(Window.partitionBy("fqn").orderBy(F.desc("score"), "id")) - 1, F.lit(6))
    factor = F.when(F.col("reopened") | F.col("kind").isin(*REDUNDANT), 0.5).otherwise(0.92)
    return hits.withColumn("score", F.col("score") * F.pow(factor, before))


def code_shaped(word: str) -> bool:
    return re.search(r"[_$.\d]|[a-z][A-Z]|^[A-Z].*[A-Z]", word) is not None


def find_symbols(symbols: DataFrame, metrics: DataFrame, text: str, *, limit: int = 8) -> DataFrame:
    """id, place of the symbols that a user's text names: an id; a name within a file; an exact fqn or name; a name in
    other case or the end of an fqn; else what a search finds. The first of these that has any decides."""
    t = text.strip()
    stages = [(F.col("id") == t, F.lit(0))]
    m = re.fullmatch(r"(.+?)::?(.+)", t)
    if m and re.search(r"[/.]", m[1]):
        stages.append((F.col("file").contains(m[1]) & ((F.col("fqn") == m[2]) | (F.col("name") == m[2])), F.lit(0)))
    stages.append(((F.col("fqn") == t) | ((F.col("name") == t) & (F.col("kind") != "module")), F.when(F.col("fqn") == t, 8).otherwise(0)))
    stages.append((((F.lower("name") == t.lower()) | F.lower("fqn").endswith("." + t.lower())) & (F.col("kind") != "module"), F.lit(0)))
    stage = functools.reduce(lambda found, k: found.when(stages[k][0], k), range(1, len(stages)), F.when(stages[0][0], 0))
    bonus = functools.reduce(lambda found, k: found.when(F.col("stage") == k, stages[k][1]), range(1, len(stages)), F.when(F.col("stage") == 0, stages[0][1]))
    hits = symbols.withColumn("stage", stage).where("stage IS NOT NULL")
    first = hits.agg(F.min("stage")).first()[0]
    if first is None:
        found = search(symbols, metrics, t, limit=limit).join(symbols.select("id", "fqn"), "id")
        return found.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "fqn", "id")).alias("place"))
    hits = hits.where(F.col("stage") == first).withColumn("points", preference() + bonus)
    ranked = hits.join(metrics.select("id", "pagerank"), "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    top = ranked.orderBy(F.desc("points"), F.desc("pagerank"), "file", "id").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("points"), F.desc("pagerank"), "file", "id")).alias("place"))


def preference() -> Column:
    """How likely a symbol of some name is the one that is meant, by its kind and place."""
    minus = lambda test, points: F.when(test, -float(points)).otherwise(0.0)
    return (
        minus(F.col("is_test") | (F.col("kind") == "test"), 100)
        + F.when(F.col("exported"), 5.0).otherwise(0.0)
        + by_kind(F.col("kind"), KINDS, 1.0) * 3
        + minus(F.col("reopened"), 4)
        + minus((F.col("kind") == "section") | F.col("file").endswith(".md"), 6)
        + minus(fn.peripheral(F.col("file")), 3)
    )


def relations(edges: DataFrame, symbols: DataFrame, ids: list[str], *, each: int = 6) -> DataFrame:
    """id, way (in or out), kind, other, line: up to each edges of a kind and way of the symbols, surest first."""
    named = symbols.select(F.col("id").alias("other"), F.col("fqn").alias("other_fqn"))
    ways = [edges.where(F.col(a).isin(ids)).select(F.col(a).alias("id"), F.lit(w).alias("way"), "kind", F.col(b).alias("other"), "line", F.coalesce("confidence", F.lit(1.0)).alias("confidence")) for a, b, w in (("dst", "src", "in"), ("src", "dst", "out"))]
    best = ways[0].union(ways[1]).groupBy("id", "way", "kind", "other").agg(F.max("confidence").alias("confidence"), F.min("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("id", "way", "kind").orderBy(F.desc("confidence"), "other"))
    return best.withColumn("k", place).where(F.col("k") <= each).join(named, "other", "left").select("id", "way", "kind", "other", "other_fqn", "line", "confidence")


def edges_among(edges: DataFrame, ids: list[str]) -> DataFrame:
    """src, dst, kind, line: one edge of each kind between symbols of a pack."""
    return edges.where(F.col("src").isin(ids) & F.col("dst").isin(ids) & (F.col("src") != F.col("dst"))).groupBy("src", "dst", "kind").agg(F.min("line").alias("line"))


def near_names(symbols: DataFrame, text: str, *, limit: int = 5) -> DataFrame:
    """id, name, distance of what a name that is not found may have meant: least edit distance, a third of it at most."""
    d = F.levenshtein(F.lower("name"), F.lit(text.lower()))
    return symbols.where(F.col("kind") != "module").select("id", "name", d.alias("distance")).where(F.col("distance") <= max(1, len(text) // 3)).orderBy("distance", "name", "id").limit(limit)
