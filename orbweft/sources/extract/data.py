"""Markdown, SQL, YAML and Make, by scanners of their own."""

from __future__ import annotations

import re

from orbweft.sources.extract.base import Collector, clean_comment


def register(extractors: dict) -> None:
    extractors |= {"markdown": markdown, "sql": sql, "yaml": yaml, "make": make}


def markdown(text: str, c: Collector) -> None:
    """Sections by heading, nested by level; links to files as imports, code words as mentions."""
    fence, stack = None, []
    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        if m := re.match(r"\s*(```+|~~~+)", line):
            fence = None if fence and line.strip().startswith(fence) else fence or m[1]
            continue
        if fence:
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            level = len(m[1])
            stack = [s for s in stack if s[0] < level]
            if not c.doc and level == 1:
                c.doc = m[2]
            fqn = c.define("section", m[2], stack[-1][1] if stack else None, no, signature=line, doc=next((x.strip() for x in lines[no : no + 4] if x.strip() and not x.startswith("#")), ""))
            stack.append((level, fqn))
            continue
        scope = stack[-1][1] if stack else None
        for target in re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s#]+)[^)]*\)", line):
            if not re.match(r"[a-z]+:", target):
                c.bring(target, no)
        for word in re.findall(r"`([A-Za-z_][\w.]*(?:\(\))?)`", line):
            word = word.removesuffix("()")
            c.refer("mention", word.rsplit(".", 1)[-1], scope, no, word.rpartition(".")[0])


#: What each created object of SQL is.
SQL_KINDS = {"TABLE": "struct", "VIEW": "struct", "INDEX": "variable", "SEQUENCE": "variable", "FUNCTION": "function", "PROCEDURE": "function", "TRIGGER": "function", "TYPE": "type_alias", "SCHEMA": "namespace"}
_HEAD = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNIQUE\s+|MATERIALIZED\s+)*(TABLE|VIEW|INDEX|SEQUENCE|FUNCTION|PROCEDURE|TRIGGER|TYPE|SCHEMA)\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`\[\]$]+)", re.I)
_NOT_COLUMN = {"PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "KEY", "INDEX", "EXCLUDE", "LIKE"}


def masked(text: str) -> str:
    """text with comments and strings blanked, same length and lines; bodies between dollar quotes stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", blank, text, flags=re.S)


def statements(text: str) -> list[tuple[int, int]]:
    """Spans between semicolons outside dollar quotes, parentheses and BEGIN ... END."""
    out, start, depth, quote = [], 0, 0, None
    for m in re.finditer(r"\$\w*\$|[();]|\bBEGIN\b(?!\s*;)|\bCASE\b|\bEND\b", text, re.I):
        t = m[0].upper()
        if quote:
            quote = None if t == quote else quote
        elif t.startswith("$"):
            quote = t
        elif t in ("(", "BEGIN", "CASE"):
            depth += 1
        elif t in (")", "END"):
            depth = max(0, depth - 1)
        elif depth == 0:
            out.append((start, m.start()))
            start = m.end()
    out.append((start, len(text)))
    return [s for s in out if text[s[0] : s[1]].strip()]


def _bare(name: str) -> str:
    return re.sub(r'["`\[\]]', "", name)


def sql(text: str, c: Collector) -> None:
    plain = masked(text)
    at = lambda i: text.count("\n", 0, i) + 1
    made: dict[str, str] = {}
    for a, b in statements(plain):
        body, raw = plain[a:b], text[a:b]
        a += len(body) - len(body.lstrip())
        line, end = at(a), at(b)
        lead = re.match(r"(?:\s*--[^\n]*\n|\s*/\*.*?\*/)+", raw, re.S)
        if m := _HEAD.search(body):
            what, full = m[1].upper(), _bare(m[2])
            name, kind = full.rsplit(".", 1)[-1], SQL_KINDS[m[1].upper()]
            meta = {"sql": what.lower()} | ({"schema": full.rpartition(".")[0]} if "." in full else {})
            if what == "TYPE" and re.search(r"\bAS\s+ENUM\b", body, re.I):
                kind = "enum"
            elif what == "TYPE" and re.search(r"\bAS\s*\(", body, re.I):
                kind = "struct"
            fqn = made[full.lower()] = c.define(kind, name, None, line, end, raw.strip().split("(")[0], clean_comment(lead[0]) if lead else "", meta=meta, fqn=full)
            if kind == "enum":
                for v in re.findall(r"'((?:[^']|'')*)'", raw[m.end() :]):
                    c.define("enum_member", v, fqn, line)
            if what in ("TABLE", "TYPE") and kind == "struct" and "(" in body[m.end() :]:
                _columns(body, raw, body.index("(", m.end()), fqn, a, at, c)
            if what in ("INDEX", "TRIGGER") and (on := re.search(r"\bON\s+([\w.\"]+)", body[m.end() :], re.I)):
                c.refer("value", _bare(on[1]).rsplit(".", 1)[-1], fqn, line)
            if what in ("VIEW", "FUNCTION", "PROCEDURE", "TRIGGER"):
                _touches(body[m.end() :], fqn, line, c)
        elif m := re.match(r"\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?([\w.\"]+)\s+ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+([\w()]+)", body, re.I):
            if m[2].upper() not in _NOT_COLUMN:
                table = made.get(_bare(m[1]).lower())
                c.define("field", m[2], table, line, declared_type=m[3])
            c.refer("value", _bare(m[1]).rsplit(".", 1)[-1], None, line)
        elif m := re.match(r"\s*COMMENT\s+ON\s+(\w+)\s+([\w.\"]+)\s+IS\s+'((?:[^']|'')*)'", raw, re.I):
            for d in c.definitions:
                if d["fqn"].lower() == _bare(m[2]).lower():
                    d["doc"] = m[3].replace("''", "'")
        else:
            _touches(body, None, line, c)
            if m := re.match(r"\s*(?:DROP|TRUNCATE)\s+(?:TABLE|VIEW)?\s*(?:IF\s+EXISTS\s+)?([\w.\"]+)", body, re.I):
                c.refer("value", _bare(m[1]).rsplit(".", 1)[-1], None, line)


def _columns(body: str, raw: str, opens: int, fqn: str, a: int, at, c: Collector) -> None:
    depth, start, parts = 0, opens + 1, []
    for i in range(opens, len(body)):
        if body[i] == "(":
            depth += 1
        elif body[i] == ")":
            depth -= 1
        if (body[i] == "," and depth == 1) or depth == 0:
            parts.append((start, i))
            start = i + 1
        if depth == 0:
            break
    base = a - (len(body) - len(body.lstrip()))
    for s, e in parts:
        words = body[s:e].split()
        line = at(base + s + len(body[s:e]) - len(body[s:e].lstrip()))
        if len(words) >= 2 and words[0].upper() not in _NOT_COLUMN:
            kind = re.match(r"\s*\S+\s+(\w+(?:\s*\([^)]*\))?)", raw[s:e])
            meta = {"primaryKey": "true"} if re.search(r"PRIMARY\s+KEY", body[s:e], re.I) else None
            c.define("field", _bare(words[0]), fqn, line, signature=raw[s:e], declared_type=kind[1] if kind else words[1], meta=meta)
        for target in re.findall(r"\bREFERENCES\s+([\w.\"]+)", body[s:e], re.I):
            c.refer("value", _bare(target).rsplit(".", 1)[-1], fqn, line)


def _touches(body: str, scope: str | None, line: int, c: Collector) -> None:
    for m in re.finditer(r"\b(?:FROM|JOIN|INTO|UPDATE)\s+(?!SELECT\b|SET\b|ONLY\b)([A-Za-z_][\w.\"]*)", body, re.I):
        c.refer("value", _bare(m[1]).rsplit(".", 1)[-1], scope, line + body.count("\n", 0, m.start()))
    for m in re.finditer(r"\b([a-z_]\w*)\s*\(", body):
        c.refer("call", m[1], scope, line + body.count("\n", 0, m.start()))


def yaml(text: str, c: Collector) -> None:
    """Workflow jobs, services, paths and resources, by the keys at the top."""
    stack: list[tuple[int, str]] = []
    top = set(re.findall(r"^(\w[\w-]*):", text, re.M))
    shape = "workflow" if {"on", "jobs"} <= top else "compose" if "services" in top else "openapi" if top & {"openapi", "swagger"} else "resource" if {"apiVersion", "kind"} <= top else "pipeline" if "stages" in top else "none"
    for no, line in enumerate(text.split("\n"), 1):
        if not (m := re.match(r"(\s*)(?:- )?([\w./{}$-]+|\"[^\"]+\"):\s*(.*)$", line)) or line.lstrip().startswith("#"):
            continue
        indent, key, value = len(m[1]), m[2].strip('"'), m[3].strip().strip("\"'")
        stack = [s for s in stack if s[0] < indent]
        path = [s[1] for s in stack]
        if shape == "workflow" and path == ["jobs"] or shape == "pipeline" and not path and key not in ("stages", "variables", "include", "default"):
            c.define("function", key, None, no, signature=line)
        elif shape == "compose" and path == ["services"]:
            c.define("struct", key, None, no, signature=line)
        elif shape == "openapi" and path[:1] == ["paths"] and len(path) == 2 and key in ("get", "put", "post", "delete", "patch"):
            c.define("route", f"{key.upper()} {path[1]}", None, no, meta={"method": key.upper(), "path": path[1]})
        elif shape == "resource" and path == ["metadata"] and key == "name":
            c.define("struct", value, None, no)
        elif not path and shape == "none":
            c.define("field", key, None, no, signature=line)
        owner = next((p for p in path[1:2]), None) if shape in ("workflow", "compose") else None
        if key == "needs" or path[-1:] == ["depends_on"]:
            for n in re.findall(r"[\w-]+", value or key):
                c.refer("value", n, owner, no)
        if key == "uses" and value.startswith("./") or key == "env_file":
            c.bring(value, no)
        for name in re.findall(r"\$\{\{\s*(?:secrets|env|vars)\.(\w+)|\$\{(\w+)[:}]", line):
            c.refer("config", name[0] or name[1], owner, no)
        stack.append((indent, key))


def make(text: str, c: Collector) -> None:
    """Targets with their prerequisites, variables and includes."""
    scope, note = None, ""
    for no, line in enumerate(text.split("\n"), 1):
        if line.startswith("#"):
            note = clean_comment(line)
        elif m := re.match(r"-?s?include\s+(.+)", line):
            for p in m[1].split():
                if "$" not in p:
                    c.bring(p, no)
        elif m := re.match(r"(?:export\s+|override\s+)?([A-Za-z_]\w*)\s*(?:\?|:|\+|::)?=", line):
            c.define("variable", m[1], None, no, signature=line)
            scope = None
        elif (m := re.match(r"([^\s:#=][^:=#]*):(?!=)([^=]*)$", line)) and not line.startswith("."):
            for t in m[1].split():
                if "%" not in t:
                    scope = c.define("function", t, None, no, signature=line, doc=note)
            for p in m[2].split("##")[0].split():
                if re.fullmatch(r"[\w.-]+", p):
                    c.refer("call", p, scope, no)
            note = ""
        elif line.startswith("\t"):
            for v in re.findall(r"\$[({](\w+)[)}]", line):
                c.refer("value", v, scope, no)
            for t in re.findall(r"\$\(MAKE\)\s+([\w-]+)", line):
                c.refer("call", t, scope, no)
        if not line.startswith("#"):
            note = "" if line.strip() else note
