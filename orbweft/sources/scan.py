"""Listing repositories: files with ignore rules, size bounds and languages; and diffs as changed ranges."""

from __future__ import annotations

import os
import re
from pathlib import PurePosixPath

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweft.functions.text import generated_name

MAX_BYTES = 1_500_000
#: Ignore lines that hold in every repository, before its own.
DEFAULTS = (
    ".git/", ".hg/", ".svn/", "node_modules/", "bower_components/", "vendor/", "dist/", "build/", "out/", "target/", ".next/", ".nuxt/", ".output/", ".turbo/", ".cache/", "coverage/",
    "__pycache__/", ".venv/", "venv/", "env/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", ".idea/", ".vscode/", "site/assets/", "public/assets/", "static/js/", "storybook-static/",
    "*.min.js", "*.min.css", "*.map", "*.bundle.js", "*.bundle.css", "vendor.js", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.generated.*", "*.pb.go", "*_pb2.py", "*.d.ts",
)


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, negated) of one ignore line; None for blanks and comments."""
    line = line.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\") if line.startswith(("!", "\\")) else line
    only_dirs = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in line.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + r"/.+", i + 3
        elif body[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return rf"^{'' if anchored else '(?:.*/)?'}{out}{'/.+' if only_dirs else '(?:/.*)?'}$", negated


def ignored(path: F.Column, rules: list[tuple[str, str]]) -> F.Column:
    """Whether the last of the rules (folder, line) that match a path ignores it; a folder's rules hold below it."""
    out = F.lit(False)
    for folder, line in rules:
        if (p := ignore_pattern(line)) is None:
            continue
        pattern, negated = p
        prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
        below = path.startswith(prefix) if prefix else F.lit(True)
        out = F.when(below & F.substring(path, len(prefix) + 1, 1 << 20).rlike(pattern), not negated).otherwise(out)
    return out


def forced(path: F.Column, rules: list[tuple[str, str]]) -> F.Column:
    """Whether a negated rule takes a path in, whatever its name says."""
    taken = [(folder, line[1:]) for folder, line in rules if line.startswith("!") and not line.startswith("!!")]
    return ignored(path, taken)


def inside(fs: pafs.FileSystem, top: str, path: str) -> bool:
    """Whether a file of a local repository lies within it, links followed."""
    if not isinstance(fs, pafs.LocalFileSystem):
        return True
    return os.path.realpath(path).startswith(os.path.realpath(top) + os.sep)


def scan(spark: SparkSession, root: str, *, max_bytes: int = MAX_BYTES, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """path, size, modified, text of a repository's readable files.

    The listing comes first, as Spark's readers leave out names with a leading dot; sizes and names are filtered before
    any content is read, and contents are read by the executors. Ignore files add to the rules given and to DEFAULTS. Names
    of built or generated files are left out unless a rule takes them in; links that lead out of the repository are not
    followed.
    """
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"
    fs, top = pafs.FileSystem.from_uri(uri)
    top = top.rstrip("/") + "/"
    found = [f for f in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if f.is_file and inside(fs, top, f.path)]
    listed = [(f.path.removeprefix(top), f.size, f.mtime) for f in sorted(found, key=lambda f: f.path)]
    all_rules = [*(("", x) for x in DEFAULTS), *(rules or [])]
    for path, _, _ in sorted(listed, key=lambda x: (x[0].count("/"), x[0])):
        if path.rsplit("/", 1)[-1] == ".gitignore":
            folder = str(PurePosixPath(path).parent)
            with fs.open_input_stream(top + path) as f:
                all_rules += [("" if folder == "." else folder, x) for x in f.read().decode("utf-8", "replace").splitlines()]
    base = spark.createDataFrame(listed, "path string, size long, modified timestamp")
    path = F.col("path")
    named = generated_name(path) & ~forced(path, all_rules)
    kept = base.where((F.col("size") > 0) & (F.col("size") <= max_bytes) & ~ignored(path, all_rules) & ~named)

    def read(frames):
        own, below = pafs.FileSystem.from_uri(uri)
        for f in frames:
            text = []
            for path in f["path"]:
                with own.open_input_stream(f"{below.rstrip('/')}/{path}", compression=None) as source:
                    text.append(source.read().decode("utf-8", "replace"))
            yield f.assign(text=text)

    return kept.mapInPandas(read, "path string, size long, modified timestamp, text string")


def diff_ranges(lines: DataFrame) -> DataFrame:
    """file, start, end of every hunk of a unified diff without context, given as (pos, line).

    The file named last before a hunk is the hunk's: a window carries it forward.
    """
    named = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1)
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    at = lines.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), named), ignorenulls=True).over(Window.orderBy("pos")))
    h = at.where(F.col("line").rlike(hunk) & (F.col("file") != "/dev/null"))
    start, n = F.regexp_extract("line", hunk, 1).cast("int"), F.regexp_extract("line", hunk, 2)
    size = F.when(n == "", 1).otherwise(n.cast("int"))
    return h.select("file", start.alias("start"), F.greatest(start, start + size - 1).alias("end"))


def changed_symbols(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id of the innermost symbol of every changed range, or of its module where none covers it."""
    r = ranges.withColumn("hunk", F.struct("file", "start", "end"))
    inner = r.join(symbols.where("kind <> 'module'").select("file", "id", "start_line", "end_line"), "file").where("start_line <= end AND end_line >= start")
    best = inner.groupBy("hunk").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), "id")).alias("m")).select("hunk", "m.id")
    return r.join(best, "hunk", "left").select(F.coalesce("id", "file").alias("id")).distinct()
