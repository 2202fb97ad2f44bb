"""Languages without a parser at hand, by lexical rules: definitions by pattern, scopes by braces or indentation.

This is of lower fidelity than a parser: error_pct is 1 where any file is read this way, so that quality reports count
it. Strings and comments are blanked first; a language is a row of patterns.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from orbweft.sources.extract.base import Collector, clean_comment

_CLASS = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "protocol": "interface", "object": "class", "record": "class", "actor": "class", "mixin": "trait", "contract": "class", "library": "class", "module": "namespace", "namespace": "namespace", "union": "struct", "type": "type_alias", "defmodule": "namespace", "impl": "class", "extension": "class"}


@dataclass
class Language:
    """types: keywords that open a type; function: a pattern with a group name; imports: patterns with a group source."""

    types: str
    function: str
    imports: tuple[str, ...] = ()
    variable: str = ""
    comment: str = "//"
    nested: str = "braces"
    env: str = ""
    route: str = ""
    supers: str = r"(?:extends|implements|:|<|with)\s+([\w.,\s<>:]+)"
    test: str = ""
    keywords: frozenset = field(default_factory=lambda: frozenset("if for while switch catch return sizeof new typeof await function def fn func match when unless until elif else do super this self in and or not lambda case throw throws yield assert print require include import".split()))


_C_FN = r"^[ \t]*(?:[\w:*&<>,~\[\]]+[ \t*&]+)+(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|throws\s+[\w.,\s]+)?\s*(?:->\s*[\w:<>]+\s*)?(?:where[^{]*)?\{"
_JVM_IMPORT = (r"^\s*import\s+(?:static\s+)?(?P<source>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?",)
_JS = Language("class|interface|enum|namespace|type", r"(?:function\s*\*?\s*(?P<name>\w+)\s*\(|(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::\s*[\w<>\[\]|. ]+)?=>|\w+\s*=>)|^[ \t]+(?:public |private |protected |static |async |get |set |readonly )*(?P<name3>\w+)\s*\([^;{}()]*\)\s*(?::\s*[\w<>\[\]|. ]+)?\s*\{)", (r"import\s+(?:type\s+)?(?P<what>[^'\";]*?)\s*(?:from\s*)?['\"](?P<source>[^'\"]+)['\"]", r"(?:const|let|var)\s+(?P<what>[\w{},\s:]+?)\s*=\s*require\(\s*['\"](?P<source>[^'\"]+)['\"]", r"export\s+(?P<what>[^'\";]*?)\s*from\s*['\"](?P<source>[^'\"]+)['\"]"), r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=", env=r"process\.env\.(\w+)|process\.env\[['\"](\w+)", route=r"\b\w+\.(get|post|put|delete|patch)\(\s*['\"](/[^'\"]*)['\"]\s*,\s*(?:[\w.]+\s*,\s*)*(\w+)?", test=r"\b(?:it|test|describe)\(\s*['\"]([^'\"]+)")
_JAVA = Language("class|interface|enum|record", _C_FN, _JVM_IMPORT, env=r"getenv\(\"(\w+)", route=r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"()", test=r"@Test\b[^(]*?void\s+(\w+)")
_KOTLIN = Language("class|interface|object|enum class", r"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\(", _JVM_IMPORT, r"^\s*(?:private |const |override |lateinit )*va[lr]\s+(?P<name>\w+)", env=r"getenv\(\"(\w+)", supers=r":\s*([\w.,\s<>()]+)\{")

#: Patterns by language; the regular parts of each language's grammar.
LANGUAGES: dict[str, Language] = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS, "java": _JAVA, "kotlin": _KOTLIN,
    "groovy": Language("class|interface|enum|trait", r"\b(?:def|void|static|public|private|\w+)\s+(?P<name>\w+)\s*\([^;{}]*\)\s*\{", _JVM_IMPORT, env=r"getenv\(['\"](\w+)"),
    "scala": Language("class|trait|object|enum", r"\bdef\s+(?P<name>\w+)", _JVM_IMPORT, r"^\s*(?:private |lazy |implicit |override )*va[lr]\s+(?P<name>\w+)"),
    "csharp": Language("class|interface|struct|enum|record|namespace", _C_FN, (r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<source>[\w.]+)\s*;",), env=r"GetEnvironmentVariable\(\"(\w+)", route=r"\[Http(Get|Post|Put|Delete|Patch)\(\"([^\"]*)\"\)\]()"),
    "c": Language("struct|enum|union", _C_FN, (r"^\s*#\s*include\s*[\"<](?P<source>[^\">]+)",), env=r"getenv\(\"(\w+)"),
    "cpp": Language("class|struct|enum|union|namespace", _C_FN, (r"^\s*#\s*include\s*[\"<](?P<source>[^\">]+)",), env=r"getenv\(\"(\w+)", test=r"\bTEST(?:_F)?\(\s*\w+\s*,\s*(\w+)"),
    "objc": Language("@interface|@protocol|@implementation|struct|enum", r"^[-+]\s*\([^)]*\)\s*(?P<name>\w+)", (r"^\s*[#@]\s*(?:import|include)\s*[\"<]?(?P<source>[^\">;]+)",)),
    "go": Language("struct|interface", r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", (r"^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<source>[\w./-]+)\"\s*$",), r"^(?:var|const)\s+(?P<name>\w+)", env=r"Getenv\(\"(\w+)", route=r"\.(?:HandleFunc|Handle|(GET|POST|PUT|DELETE|PATCH))\(\s*\"([^\"]*)\"\s*,\s*(\w+)", test=r"^func\s+(Test\w+)"),
    "rust": Language("struct|enum|trait|impl|mod|union", r"\bfn\s+(?P<name>\w+)", (r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+)(?:::\{(?P<what>[^}]*)\})?(?:\s+as\s+(?P<alias>\w+))?",), r"^\s*(?:pub\s+)?(?:const|static)\s+(?P<name>\w+)", env=r"env::var\(\"(\w+)|env!\(\"(\w+)", supers=r"\bfor\s+([\w:]+)", test=r"#\[test\]\s*(?:async\s+)?fn\s+(\w+)"),
    "swift": Language("class|struct|enum|protocol|extension|actor", r"\bfunc\s+(?P<name>\w+)", (r"^\s*import\s+(?P<source>[\w.]+)",), r"^\s*(?:public |private |static )*(?:let|var)\s+(?P<name>\w+)", supers=r":\s*([\w.,\s]+)\{", env=r"environment\[\"(\w+)"),
    "dart": Language("class|mixin|enum|extension", _C_FN, (r"^\s*(?:import|export)\s+'(?P<source>[^']+)'(?:\s+as\s+(?P<alias>\w+))?",), env=r"fromEnvironment\('(\w+)"),
    "php": Language("class|interface|trait|enum|namespace", r"\bfunction\s+&?(?P<name>\w+)\s*\(", (r"^\s*use\s+(?P<source>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", r"(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<source>[^'\"]+)"), r"^\s*(?:const|define\(\s*['\"])\s*(?P<name>\w+)", env=r"(?:getenv|env)\(['\"](\w+)", route=r"Route::(get|post|put|delete|patch)\(\s*['\"]([^'\"]*)['\"]()"),
    "solidity": Language("contract|interface|library|struct|enum", r"\bfunction\s+(?P<name>\w+)\s*\(", (r"^\s*import\s+(?:[^'\"]*from\s+)?['\"](?P<source>[^'\"]+)",), r"^\s*(?:\w+)\s+constant\s+(?P<name>\w+)", supers=r"\bis\s+([\w,\s]+)"),
    "zig": Language("struct|enum|union", r"\bfn\s+(?P<name>\w+)\s*\(", (r"const\s+(?P<alias>\w+)\s*=\s*@import\(\"(?P<source>[^\"]+)\"",), r"^(?:pub\s+)?(?:const|var)\s+(?P<name>\w+)", test=r"^test\s+\"([^\"]+)"),
    "terraform": Language("", r"^(?:resource|data)\s+\"\w+\"\s+\"(?P<name>\w+)\"|^(?:variable|output|module|provider)\s+\"(?P<name2>[\w-]+)\"", (r"^\s*source\s*=\s*\"(?P<source>\.[^\"]+)",), comment="#"),
    "powershell": Language("class|enum", r"^\s*function\s+(?P<name>[\w-]+)", (r"^\s*(?:Import-Module|\.)\s+(?P<source>[\w./\\-]+\.psm?1)",), comment="#", env=r"\$env:(\w+)"),
    "bash": Language("", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?", (r"^\s*(?:source|\.)\s+[\"']?(?P<source>[\w./-]+)",), r"^(?:export\s+|readonly\s+)?(?P<name>[A-Z_]\w*)=", comment="#", env=r"\$\{(\w+):[-?]"),
    "ruby": Language("class|module", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)", (r"^\s*require(?:_relative)?\s+['\"](?P<source>[^'\"]+)",), r"^\s*(?P<name>[A-Z][A-Z_0-9]+)\s*=", comment="#", nested="end", env=r"ENV(?:\.fetch\()?\[?['\"](\w+)", route=r"^\s*(get|post|put|delete|patch)\s+['\"]([^'\"]*)['\"]()", supers=r"<\s*([\w:]+)"),
    "lua": Language("", r"\bfunction\s+(?:[\w.]+[.:])?(?P<name>\w+)\s*\(", (r"(?:local\s+(?P<alias>\w+)\s*=\s*)?require\s*\(?\s*['\"](?P<source>[^'\"]+)",), r"^local\s+(?P<name>\w+)\s*=", comment="--", nested="end", env=r"getenv\(['\"](\w+)"),
    "elixir": Language("defmodule|defprotocol", r"^\s*defp?\s+(?P<name>[\w?!]+)", (r"^\s*(?:alias|import|use|require)\s+(?P<source>[\w.]+)(?:,\s*as:\s*(?P<alias>\w+))?",), comment="#", nested="end", env=r"get_env\(\"(\w+)", test=r"^\s*test\s+\"([^\"]+)"),
    "julia": Language("struct|module|mutable struct|abstract type", r"^\s*function\s+(?P<name>[\w!]+)|^(?P<name2>[\w!]+)\([^)]*\)\s*=[^=]", (r"^\s*(?:using|import)\s+(?P<source>[\w.]+)", r"include\(\"(?P<source>[^\"]+)"), r"^const\s+(?P<name>\w+)", comment="#", nested="end", env=r"ENV\[\"(\w+)"),
    "haskell": Language("data|newtype|class|type", r"^(?P<name>[a-z_][\w']*)\s*::", (r"^import\s+(?:qualified\s+)?(?P<source>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?",), comment="--", nested="none", supers=r"deriving\s*\(?([\w,\s]+)"),
    "ocaml": Language("type|module|class", r"^\s*(?:let|and)\s+(?:rec\s+)?(?P<name>[a-z_][\w']*)", (r"^\s*(?:open|include)\s+(?P<source>[\w.]+)",), comment="(*", nested="none"),
    "fsharp": Language("type|module|namespace", r"^\s*(?:let|member)\s+(?:rec |inline |private |\w+\.)*(?P<name>\w+)", (r"^\s*open\s+(?P<source>[\w.]+)",), comment="//", nested="none"),
}


def register(extractors: dict) -> None:
    for name in LANGUAGES:
        extractors[name] = lambda text, c, name=name: extract(text, c, LANGUAGES[name])
    for name in ("vue", "svelte"):
        extractors[name] = component


def component(text: str, c: Collector) -> None:
    """A single-file component: a class of the file's name, its scripts, and the components that its markup uses."""
    name = c.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    top = c.define("class", name, None, 1, text.count("\n") + 1, f"<{name}>")
    rest, at = text, line_table(text)
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S | re.I):
        extract("\n" * text.count("\n", 0, m.start(1)) + m[1], c, _JS, outer=top)
        rest = rest.replace(m[0], re.sub(r"[^\n]", " ", m[0]))
    for m in re.finditer(r"<([A-Z]\w*)\b", rest):
        c.refer("value", m[1], top, at(m.start()))


def line_table(text: str):
    """A function from a place in text to its line, from 1."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    return lambda i: bisect.bisect_right(starts, i)


def pairs_of(bare: str) -> dict[int, int]:
    """The place of the brace that closes each brace."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def blanked(text: str, comment: str) -> str:
    """text with comments blanked, and strings too, of the same length."""
    out = re.escape(comment) + (r".*?\*\)" if comment == "(*" else r"[^\n]*")
    marks = [out, r"/\*.*?\*/"] if comment in ("//", "(*") else [out if comment != "#" else r"(?<![\w$&{])#(?!include|import|define|\[)[^\n]*"]
    return re.sub("|".join(marks), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def extract(text: str, c: Collector, lang: Language, outer: str | None = None) -> None:
    c.errors = max(c.errors, 1)
    code = blanked(text, lang.comment)
    bare = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n]){2,}'|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    lines, at = text.split("\n"), line_table(text)
    closes = pairs_of(bare) if lang.nested == "braces" else {}
    found: list[tuple[int, str, str, re.Match]] = []
    if lang.types:
        words = "|".join(sorted(map(re.escape, lang.types.split("|")), key=len, reverse=True))
        for m in re.finditer(rf"(?<![\w.@])({words})\s+(?:class\s+)?(?:<[^>]*>\s*)?(\w[\w.:\\]*)", bare):
            kind = _CLASS.get(m[1].split()[0].lstrip("@").replace("mutable", "struct").replace("abstract", "interface").replace("implementation", "class").replace("defprotocol", "interface").replace("data", "struct").replace("newtype", "struct").replace("mod", "namespace") if m[1] not in _CLASS else m[1], "class")
            if m[2] not in lang.keywords and not re.match(r"\s*[=)]?=", bare[m.end() : m.end() + 3] if kind != "type_alias" else ""):
                found.append((m.start(), kind, m[2], m))
    if lang is LANGUAGES.get("go"):
        found = [(m.start(), "interface" if m[2] == "interface" else "struct" if m[2] == "struct" else "type_alias", m[1], m) for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(\w+)", bare, re.M)]
    for m in re.finditer(lang.function, bare, re.M):
        name = next((m[g] for g in ("name", "name2", "name3") if g in m.re.groupindex and m[g]), None)
        if name and name not in lang.keywords:
            found.append((m.start(), "function", name, m))
    if lang.variable:
        taken = {f[2] for f in found}
        for m in re.finditer(lang.variable, bare, re.M):
            if m["name"] not in taken:
                taken.add(m["name"])
                found.append((m.start(), "constant" if m["name"].isupper() else "variable", m["name"], m))
    found.sort(key=lambda f: f[0])
    scopes: list[tuple[int, int, str, str]] = []
    open_: list[tuple[int, int, str, str]] = []  # those that may hold what follows, as found goes by place
    for _, kind, name, m in found:
        no = at(m.start() + len(m[0]) - len(m[0].lstrip()))
        end = _end(bare, m, lang, lines, no, at, closes)
        open_ = [s for s in open_ if no <= s[1]]
        owner = max((s for s in open_ if s[0] < m.start()), key=lambda s: s[0], default=None)
        parent = owner[2] if owner else outer
        inner = owner is not None and owner[3] in ("class", "interface", "struct", "enum", "trait")
        if kind == "function" and inner:
            kind = "constructor" if name in ("constructor", "__construct", "init", "initialize", owner[2].rsplit(".", 1)[-1]) else "method"
        if kind in ("variable", "constant") and owner and not inner:
            continue
        kind = "field" if kind == "variable" and inner else kind
        if kind == "function" and "recv" in m.re.groupindex and m["recv"]:
            kind, parent = "method", re.sub(r"[*\[].*|[^\w*\[ ].*", "", m["recv"].split()[-1].lstrip("*"))
        if re.match(r"(?:Test|test_)", name) and c.is_test and kind in ("function", "method"):
            kind = "test"
        head = lines[no - 1]
        doc = []
        for k in range(no - 2, -1, -1):
            if not re.match(r"\s*(//|/?\*|#|--|;|%)", lines[k]) or lines[k].lstrip().startswith("#include"):
                break
            doc.insert(0, lines[k])
        meta = {"reopens": name} if re.match(r"\s*(?:\w+\s+)*(impl|extension)\b", m[0]) else None
        modifiers = re.findall(r"\b(public|private|protected|static|async|abstract|final|override|const|virtual|pub|export)\b", head.split("(")[0])
        hidden = "private" in modifiers or name.startswith("_") or lang is LANGUAGES["rust"] and "pub" not in modifiers or lang is LANGUAGES["go"] and not name[:1].isupper()
        fqn = c.define(kind, name, parent, no, end, head, clean_comment("\n".join(doc)), modifiers, not hidden, None, meta)
        scopes.append((m.start(), end, fqn, kind))
        open_.append(scopes[-1])
        if kind in ("class", "interface", "struct", "enum", "trait") and (s := re.match(r"[^{;\n]*?" + lang.supers, _head(bare, m.end(2) if m.re.groups > 1 else m.end()))):
            for base in re.findall(r"[A-Z]\w*", re.sub(r"<[^<>]*>", "", s[1])):
                c.refer("implements" if "implements" in s[0].split(base)[0] else "extends", base, fqn, no)
    around = [outer] * (len(lines) + 2)  # of scopes that hold a line, the one that begins last; of those the first found
    for _, (start, end, fqn, kind) in sorted(enumerate(scopes), key=lambda x: (x[1][0], -x[0])):
        if kind not in ("variable", "constant", "field"):
            first = at(start)
            around[first : end + 1] = [fqn] * max(0, end + 1 - first)
    scope_of = around.__getitem__
    for pattern in lang.imports:
        for m in re.finditer(pattern, code, re.M):
            g = m.groupdict()
            what = g.get("what") or ""
            names = [(x.split(" as ")[0].strip(), x.split(" as ")[1].strip() if " as " in x else "") for x in re.sub(r"^[^{]*\{|\}.*$", "", what, flags=re.S).split(",") if x.strip()] if "{" in what or pattern.startswith(r"^\s*(?:pub") else []
            alias = g.get("alias") or (re.sub(r"\*\s*as\s*|[,{].*", "", what).strip() if what and not what.startswith("{") else "")
            c.bring(g["source"], at(m.start()), alias, "reexport" if m[0].startswith("export") else "static", names, "*" in what or not names)
    lead = set()
    for f in found:
        lead.add(f[3].start(next((g for g in ("name", "name2", "name3") if g in f[3].re.groupindex and f[3][g]), 0)))
    for m in re.finditer(r"(new\s+)?((?:[\w$]+(?:\.|::|->|\?\.))*)([\w$]+)\s*\(", bare):
        if m[3] in lang.keywords or m.start(3) in lead or not re.match(r"[A-Za-z_$]", m[3]):
            continue
        no = at(m.start(3))
        arity = None if bare[m.end() : m.end() + 1] != ")" else 0
        c.refer("new" if m[1] or not m[2] and m[3][:1].isupper() else "call", m[3], scope_of(no), no, re.sub(r"(\.|::|->|\?\.)$", "", m[2]), arity)
    for m in re.finditer(r"(?:\b(\w+)\s*:\s*([A-Z]\w*)|\b([A-Z]\w*)(?:<[^<>]*>)?\s+(\w+)\s*[=;,)])", bare):
        c.typed(scope_of(at(m.start())), m[1] or m[4], m[2] or m[3], "annotation")
    for m in re.finditer(r"\b(?:let|const|var|val|auto|\w+)\s+(\w+)\s*:?=\s*(?:new\s+|&)?([A-Z]\w*)\s*[({]", bare):
        c.typed(scope_of(at(m.start())), m[1], m[2], "new")
    if lang.env:
        for m in re.finditer(lang.env, code):
            no = at(m.start())
            c.refer("config", next(filter(None, m.groups())), scope_of(no), no)
    if lang.route:
        for m in re.finditer(lang.route, code, re.M):
            verb = (m[1] or "ANY").upper()
            c.define("route", f"{verb} {m[2]}", None, at(m.start()), meta={"method": verb, "path": m[2]} | ({"handler": m[3]} if m[3] else {}))
    if lang.test:
        for m in re.finditer(lang.test, code, re.M):
            if not any(d["name"] == m[1] for d in c.definitions):
                c.define("test", m[1], None, at(m.start()))


def _head(bare: str, start: int) -> str:
    """What stands before the next brace, and a brace."""
    end = bare.find("{", start)
    return bare[start : end if end >= 0 else len(bare)] + "{"


_STOP = re.compile(r";|\n\s*\n")


def _end(bare: str, m: re.Match, lang: Language, lines: list[str], no: int, at, closes: dict[int, int]) -> int:
    """Last line of what m opens."""
    if lang.nested == "braces":
        opens = bare.find("{", m.end() - 1)
        if opens < 0 or _STOP.search(bare, m.end() - 1, opens):
            return no
        return at(closes[opens]) if opens in closes else len(lines)
    indent = len(lines[no - 1]) - len(lines[no - 1].lstrip())
    for k in range(no, len(lines)):
        if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
            return k + 1 if lang.nested == "end" and lines[k].strip().startswith("end") else k
    return len(lines)
