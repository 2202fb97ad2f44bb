"""Code-index files in the SCIP protobuf format: a wire reader, symbol descriptors, and the merge into the graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffix of a descriptor and what it names.
SUFFIXES = {"/": "namespace", "#": "type", ".": "term", "().": "method", "[]": "type_parameter", "()": "parameter", ":": "meta", "!": "macro"}
DEFINITION_ROLE = 1
OCCURRENCES = "path string, symbol string, is_definition boolean, line int, column int, display string"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number runs on too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: numbers as they are, the rest as bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("a field runs past its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield tag >> 3, value


def packed(data: bytes | int) -> list[int]:
    if isinstance(data, int):
        return [data]
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def documents(index: bytes) -> Iterator[tuple[str, list[dict]]]:
    """Path and occurrences of every document of an index."""
    for number, value in fields(index):
        if number != 2:
            continue
        path, occurrences, names = "", [], {}
        for n, v in fields(value):
            if n == 1:
                path = v.decode()
            elif n == 2:
                o = {"range": [], "symbol": "", "roles": 0}
                for k, x in fields(v):
                    if k == 1:
                        o["range"] += packed(x)
                    elif k == 2:
                        o["symbol"] = x.decode()
                    elif k == 3:
                        o["roles"] = x
                occurrences.append(o)
            elif n == 3:
                s = {k: x for k, x in fields(v)}
                if 1 in s and 6 in s:
                    names[s[1].decode()] = s[6].decode()
        for o in occurrences:
            o["display"] = names.get(o["symbol"], "")
        yield path, occurrences


def descriptors(symbol: str) -> list[tuple[str, str]]:
    """(name, kind) of each descriptor of a global symbol; a local one has none."""
    if symbol.startswith("local "):
        return []
    rest = re.sub(r"^(?:(?:[^ ]|  )* ){4}", "", symbol)
    out = []
    for m in re.finditer(r"\[(`(?:[^`]|``)*`|[\w$+-]+)\]|\((`(?:[^`]|``)*`|[\w$+-]+)\)|(`(?:[^`]|``)*`|[\w$+-]+)(\((?:[\w$+-]*)\)\.|[/#.:!])", rest):
        name = next(filter(None, m.group(1, 2, 3)))
        suffix = "[]" if m[1] else "()" if m[2] else "()." if m[4].startswith("(") else m[4]
        out.append((name.strip("`").replace("``", "`"), SUFFIXES[suffix]))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of the index files at path; a file is one task's work."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for data in f["content"]:
                rows = []
                for doc, occurrences in documents(bytes(data)):
                    rows += [(doc, o["symbol"], bool(o["roles"] & DEFINITION_ROLE), (o["range"] or [0])[0] + 1, (o["range"] or [0, 0])[1], o["display"] or (descriptors(o["symbol"]) or [("", "")])[-1][0]) for o in occurrences]
                yield pd.DataFrame(rows, columns=["path", "symbol", "is_definition", "line", "column", "display"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, OCCURRENCES)


def merged(edges: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """edges with those that the index proves: a definition is the symbol of its file, line and name; a reference becomes
    an edge of confidence 1 from the innermost symbol around it and replaces other edges of its source, kind and line.

    Doing it again changes nothing.
    """
    own = symbols.select("file", "id", "name", "kind", "start_line", "end_line")
    defs = occurrences.where("is_definition").select(F.col("path").alias("file"), "symbol", F.col("line").alias("start_line"), F.col("display").alias("name"))
    known = defs.join(own.select("file", "start_line", "name", "id", "kind"), ["file", "start_line", "name"]).groupBy("symbol").agg(F.min(F.struct("id", "kind")).alias("m")).select("symbol", F.col("m.id").alias("dst"), F.col("m.kind").alias("dst_kind"))
    refs = occurrences.where("NOT is_definition").select(F.col("path").alias("file"), "symbol", "line").distinct().join(known, "symbol")
    around = refs.join(own.where("kind <> 'module'").select("file", "id", "start_line", "end_line"), "file").where("start_line <= line AND end_line >= line")
    inner = around.groupBy("file", "symbol", "line", "dst", "dst_kind").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), "id")).alias("m")).select("file", "symbol", "line", F.col("m.id").alias("src"))
    placed = refs.join(inner, ["file", "symbol", "line"], "left").select(F.coalesce("src", "file").alias("src"), "dst", "dst_kind", "file", "line")
    kind = F.when(F.col("dst_kind").isin("function", "method", "constructor"), "calls").otherwise("references")
    proven = placed.where("src <> dst").select("src", "dst", kind.alias("kind"), "file", "line", F.lit("scip").alias("resolver"), F.lit(1.0).alias("confidence")).distinct()
    rest = edges.where("resolver <> 'scip'").join(proven.select("src", "kind", "line").distinct(), ["src", "kind", "line"], "left_anti")
    return rest.select(proven.columns).unionByName(proven)
