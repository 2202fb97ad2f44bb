"""Extractors: source text to one file's record, dispatched by language and run with mapInPandas."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from orbweft.sources.extract.base import Collector
from orbweft.sources.ir import FILE_IR

_LOADED = False


def registry() -> dict:
    """language -> extract(text, Collector)."""
    from orbweft.sources.extract import base, braces, data, python

    global _LOADED
    if not _LOADED:
        for module in (python, data, braces):
            module.register(base.EXTRACTORS)
        _LOADED = True
    return base.EXTRACTORS


#: Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "md": "markdown", "mdx": "markdown", "markdown": "markdown", "sql": "sql", "ddl": "sql", "pgsql": "sql", "yml": "yaml", "yaml": "yaml", "mk": "make", "make": "make", "mak": "make",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "vue": "vue", "svelte": "svelte",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "groovy": "groovy", "gradle": "groovy", "gvy": "groovy", "go": "go", "rs": "rust", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "php": "php", "cs": "csharp",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cu": "cpp", "cuh": "cpp", "m": "objc", "mm": "objc", "swift": "swift", "dart": "dart",
    "sh": "bash", "bash": "bash", "zsh": "bash", "lua": "lua", "ex": "elixir", "exs": "elixir", "zig": "zig", "sol": "solidity", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "fs": "fsharp", "fsx": "fsharp", "fsi": "fsharp", "jl": "julia", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell", "tf": "terraform", "tfvars": "terraform", "hcl": "terraform",
}


def language_of(path: str, head: str = "") -> str | None:
    """Language by file name; a header with Objective-C's marks is that, and a Makefile needs no extension."""
    name = path.rsplit("/", 1)[-1]
    if re.fullmatch(r"(GNU)?[Mm]akefile(\..*)?", name):
        return "make"
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext == "h" and re.search(r"^\s*@(interface|protocol|class|end)\b|^#import\b", head, re.M):
        return "objc"
    return LANGUAGES.get(ext)


def extract(path: str, text: str) -> dict | None:
    """The record of one file; None where no extractor knows it or the text is binary."""
    language = language_of(path, text[:4096])
    run = registry().get(language)
    if run is None or "\0" in text:
        return None
    c = Collector(path, language, text)
    run(text, c)
    c.reparent()
    return c.record(hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest())


def extracted(files: DataFrame) -> DataFrame:
    """One record for every known file of files (path, text); one pass, files are independent."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [r for p, t in zip(f["path"], f["text"], strict=True) if t is not None and (r := extract(p, t))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("path", "language", "hash", "doc", "error_pct", "is_test", "definitions", "refs", "imports", "local_types")])

    return files.select("path", "text").mapInPandas(run, FILE_IR)
