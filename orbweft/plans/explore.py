"""Answering questions about a graph: what is asked, which symbols matter, and a pack of them within a token budget."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweft.operators import graph, retrieval

NAME = r"`?([A-Za-z_][\w.$:]*)`?(?:\(\))?"
#: Members kept however large; share of the budget that bodies may take; hard limit; symbols at most.
ALWAYS, BODIES, HARD, MOST = 3, 0.55, 1.05, 25


@dataclass
class Intent:
    """callers, impact, path, define or explore, with the names it is about."""

    kind: str
    names: list[str] = field(default_factory=list)


def detect_intent(question: str) -> Intent:
    """What a question asks; one that fits no form is free text."""
    q = question.strip().rstrip("?").strip()
    forms = [
        ("path", rf"(?:path|route|way|connection)\s+(?:from|between)\s+{NAME}\s+(?:to|and)\s+{NAME}$"),
        ("path", rf"how\s+(?:does|is|do)\s+{NAME}\s+(?:reach|get to|connect(?:ed)? to|lead to)\s+{NAME}$"),
        ("callers", rf"(?:who|what)\s+(?:calls|uses|invokes|references)\s+{NAME}$"),
        ("callers", rf"(?:callers|usages|users)\s+of\s+{NAME}$"),
        ("callers", rf"where\s+is\s+{NAME}\s+(?:called|used|invoked|referenced)$"),
        ("impact", rf"(?:what\s+(?:breaks|happens|is affected)\s+if\s+(?:I\s+)?(?:change|remove|rename|delete)|impact\s+of(?:\s+changing)?|blast\s+radius\s+of)\s+{NAME}$"),
        ("define", rf"(?:where\s+is|what\s+is|show(?:\s+me)?|define)\s+{NAME}(?:\s+defined)?$"),
    ]
    for kind, form in forms:
        if m := re.fullmatch(form, q, re.I):
            return Intent(kind, list(m.groups()))
    return Intent("explore", retrieval.query_terms(question))


def seeds(hits: DataFrame, limit: int = 12) -> DataFrame:
    """id, share: the best hits (id, rank) as where a walk restarts, each by its reciprocal rank."""
    top = hits.where(F.col("rank") <= limit).select("id", (1.0 / F.col("rank")).alias("s"))
    return top.crossJoin(F.broadcast(top.agg(F.sum("s").alias("t")))).select("id", (F.col("s") / F.col("t")).alias("share"))


def related(nodes: DataFrame, edges: DataFrame, hits: DataFrame, *, rounds: int = 25, keep: int = 40) -> DataFrame:
    """id, rank of the nodes nearest to the hits by a walk along edges of either direction; ties by id."""
    ranks = graph.pagerank(nodes, graph.both_ways(edges), rounds=rounds, restart=seeds(hits), tolerance=1e-9)
    top = ranks.where("rank > 1e-7").orderBy(F.desc("rank"), "id").limit(keep)
    rows = sorted(((r.rank, r.id) for r in top.collect()), key=lambda x: (-x[0], x[1]))  # keep rows at most
    return nodes.sparkSession.createDataFrame([(i, k) for k, (_, i) in enumerate(rows, 1)], "id string, rank int")


def pack(ranked: list[dict], budget: int) -> tuple[list[dict], int]:
    """(symbols with their text, how many are left out) of a ranking (id, head, body): heads of the best, bodies of as
    many as their share of the budget allows; the first few come whatever their size, the hard limit aside."""
    cost = lambda s: -(-len(s) * 10 // 32)
    out, used, bodies = [], 0, 0
    for r in ranked:
        if len(out) >= MOST:
            break
        head, body = cost(r["head"]), cost(r.get("body") or "")
        if used + head > budget and len(out) >= ALWAYS or used + head > HARD * budget:
            break
        whole = body and bodies + body <= BODIES * budget and used + head + body <= budget
        out.append({"id": r["id"], "text": r["head"] + ("\n" + r["body"] if whole else "")})
        used, bodies = used + head + (body if whole else 0), bodies + (body if whole else 0)
    return out, len(ranked) - len(out)


def hoist(order: list[str], parent: dict[str, str], rank: dict[str, int]) -> list[str]:
    """The order with the best-ranked member of each class right before it, where the search ranked that member no lower.

    parent names the class of each member; rank is the place in the search's own ranking, of those that it found.
    """
    place = lambda x: rank.get(x, len(rank) + 1)
    out, at = list(order), 0
    while at < len(out):
        liked = [m for m in out[at + 1 :] if parent.get(m) == out[at] and place(m) <= place(out[at])]
        if liked:
            best = min(liked, key=place)
            out.remove(best)
            out.insert(at, best)
            at += 1
        at += 1
    return out


def overview(symbols: DataFrame, edges: DataFrame, *, hubs: int = 15) -> dict[str, DataFrame]:
    """Counts by kind, language and provenance, the most used symbols, routes, and import cycles."""
    degree = graph.degrees(edges)
    cycles = graph.scc(edges.where("kind = 'imports' AND confidence >= 1").select("src", "dst"))
    return {
        "kinds": symbols.groupBy("kind").count(),
        "languages": symbols.where("kind = 'module'").groupBy("language").count(),
        "resolvers": edges.groupBy("resolver").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")),
        "hubs": symbols.where("NOT is_test").join(degree, "id").orderBy(F.desc("in_degree"), "id").limit(hubs).select("id", "kind", "in_degree", "callers"),
        "routes": symbols.where("kind = 'route'").select("id", "name", "file"),
        "cycles": cycles.groupBy("component").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("files")),
    }
