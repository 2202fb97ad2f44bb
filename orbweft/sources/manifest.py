"""Project manifests: what import sources mean in a repository, as rows of a prefix and where it leads.

Read are path aliases of tsconfig.json and jsconfig.json, names of workspace packages in package.json, modules of go.mod
and namespaces of composer.json. A manifest holds for files in its folder and below, workspace packages everywhere.
"""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("tsconfig.json", "jsconfig.json", "package.json", "go.mod", "composer.json")
ROWS = "kind string, folder string, prefix string, target string"


def jsonc(text: str) -> dict:
    """JSON with comments and trailing commas; what cannot be read is empty."""
    string = r'"(?:\\.|[^"\\])*"'
    bare = re.sub(rf"({string})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
    bare = re.sub(rf"({string})|,(?=\s*[}}\]])", lambda m: m[1] or "", bare)
    try:
        found = json.loads(bare)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _join(*parts: str) -> str:
    path = posixpath.normpath(posixpath.join(*parts))
    return "" if path == "." else path


def facts(path: str, text: str) -> list[tuple[str, str, str, str]]:
    """kind, folder, prefix, target of one manifest."""
    folder, name = posixpath.split(path)
    if name == "go.mod":
        m = re.search(r"^module\s+(\S+)", text, re.M)
        return [("go", folder, m[1].strip('"'), folder)] if m else []
    data = jsonc(text)
    if name == "package.json":
        own = data.get("name")
        return [("package", "", own, folder)] if isinstance(own, str) and own else []
    if name == "composer.json":
        spaces = (data.get("autoload") or {}).get("psr-4") or {}
        return [("php", folder, k.strip("\\").replace("\\", "/"), _join(folder, v if isinstance(v, str) else v[0])) for k, v in spaces.items() if v]
    options = data.get("compilerOptions") or {}
    base = _join(folder, options.get("baseUrl") or ".")
    return [("alias", folder, k.removesuffix("*").rstrip("/"), _join(base, v[0].removesuffix("*").rstrip("/") or ".")) for k, v in (options.get("paths") or {}).items() if v and k != "*"]


def read(files: DataFrame) -> DataFrame:
    """kind, folder, prefix, target of all manifests among files (path, text)."""

    def run(frames):
        for f in frames:
            rows = [x for p, t in zip(f["path"], f["text"], strict=True) for x in facts(p, t or "")]
            yield pd.DataFrame(rows, columns=["kind", "folder", "prefix", "target"])

    named = F.element_at(F.split("path", "/"), -1).isin(*NAMES)
    return files.where(named).select("path", "text").mapInPandas(run, ROWS)


LANGUAGES = {"alias": ("javascript", "typescript", "tsx", "vue", "svelte"), "package": ("javascript", "typescript", "tsx", "vue", "svelte"), "go": ("go",), "php": ("php",)}


def mapped(imports: DataFrame, manifest: DataFrame) -> DataFrame:
    """file, pos, path of imports (file, pos, language, source) that a manifest's prefix begins: the source as a path from
    the root, by the nearest manifest and its longest prefix. Sources meet prefixes by their leading segments."""
    source = F.when(F.col("language") == "php", F.translate("source", "\\", "/")).otherwise(F.col("source"))
    parts = F.split(source, "/")
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    x = imports.where(~F.col("source").startswith(".")).select("file", "pos", "language", source.alias("whole"), heads.alias("prefix"))
    test = F.lit(False)
    for kind, languages in LANGUAGES.items():
        test = test | ((F.col("kind") == kind) & F.col("language").isin(*languages))
    x = x.join(manifest, "prefix").where(test & ((F.col("folder") == "") | F.col("file").startswith(F.concat("folder", F.lit("/")))))
    rest = F.expr("substring(whole, length(prefix) + 2)")
    path = F.concat_ws("/", F.when(F.col("target") != "", F.col("target")), F.when(rest != "", rest))
    return x.groupBy("file", "pos").agg(F.max_by(path, F.struct(F.length("folder"), F.length("prefix"), "target")).alias("path"))
