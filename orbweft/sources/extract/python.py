"""Python, by the standard library's parser."""

from __future__ import annotations

import ast

from orbweft.sources.extract.base import Collector

HTTP = {"get", "post", "put", "delete", "patch", "head", "options", "route", "websocket"}


def register(extractors: dict) -> None:
    extractors["python"] = extract


def extract(text: str, c: Collector) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        c.errors = 100
        return
    c.doc = ast.get_docstring(tree) or ""
    Walker(c).body(tree.body, None, None, False)


def dotted(node) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, ast.Call):
        return "super" if isinstance(node.func, ast.Name) and node.func.id == "super" else dotted(node.func)
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    return ""


class Walker:
    def __init__(self, c: Collector):
        self.c = c

    def body(self, nodes, scope, owner, typing_only) -> None:
        for n in nodes:
            self.statement(n, scope, owner, typing_only)

    def statement(self, n, scope, owner, typing_only) -> None:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(n, scope, owner)
        elif isinstance(n, ast.ClassDef):
            self.klass(n, scope)
        elif isinstance(n, ast.Import):
            for a in n.names:
                self.c.bring(a.name, n.lineno, a.asname or a.name.split(".")[0], "type" if typing_only else "static", namespace=True)
        elif isinstance(n, ast.ImportFrom):
            if n.module != "__future__":
                self.c.bring(n.module or "", n.lineno, kind="type" if typing_only else "static", names=[(a.name, a.asname or "") for a in n.names], level=n.level)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            self.assign(n, scope, owner)
        elif isinstance(n, ast.If):
            guarded = typing_only or dotted(n.test).endswith("TYPE_CHECKING")
            self.expression(n.test, scope)
            self.body(n.body, scope, owner, guarded)
            self.body(n.orelse, scope, owner, typing_only)
        else:
            for _, value in ast.iter_fields(n):
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, ast.stmt):
                        self.statement(x, scope, owner, typing_only)
                    elif isinstance(x, ast.ExceptHandler):
                        if x.type:
                            self.expression(x.type, scope)
                        self.body(x.body, scope, owner, typing_only)
                    elif isinstance(x, ast.match_case):
                        self.body(x.body, scope, owner, typing_only)
                    elif isinstance(x, ast.AST):
                        self.expression(x, scope)

    def function(self, n, scope, owner) -> None:
        marks = [dotted(d) for d in n.decorator_list]
        last = [m.rsplit(".", 1)[-1] for m in marks]
        kind = "method" if owner else "function"
        if owner and n.name == "__init__":
            kind = "constructor"
        elif {"property", "cached_property", "setter", "getter"} & set(last):
            kind = "property"
        elif n.name.startswith("test_") and self.c.is_test:
            kind = "test"
        modifiers = [m for m, yes in (("async", isinstance(n, ast.AsyncFunctionDef)), ("static", "staticmethod" in last), ("classmethod", "classmethod" in last), ("abstract", "abstractmethod" in last), ("overload", "overload" in last), ("private", n.name.startswith("_") and not n.name.endswith("__"))) if yes]
        returns = f" -> {ast.unparse(n.returns)}" if n.returns else ""
        fqn = self.c.define(kind, n.name, scope, n.lineno, n.end_lineno, f"def {n.name}({ast.unparse(n.args)}){returns}", ast.get_docstring(n), modifiers, not n.name.startswith("_"), ast.unparse(n.returns) if n.returns else None, {"fixture": "true"} if "fixture" in last else None)
        for d, mark in zip(n.decorator_list, marks, strict=True):
            if isinstance(d, ast.Call) and "." in mark and mark.rsplit(".", 1)[-1] in HTTP and d.args and isinstance(d.args[0], ast.Constant):
                verb = mark.rsplit(".", 1)[-1].upper()
                self.c.define("route", f"{'ANY' if verb == 'ROUTE' else verb} {d.args[0].value}", None, d.lineno, meta={"method": verb, "path": str(d.args[0].value), "handler": fqn})
            self.c.refer("decorator", last[marks.index(mark)], fqn, d.lineno, mark.rpartition(".")[0])
            if isinstance(d, ast.Call):
                for a in [*d.args, *(k.value for k in d.keywords)]:
                    self.expression(a, fqn)
        a = n.args
        for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]:
            if p.annotation:
                self.types(p.annotation, fqn)
                if name := dotted(p.annotation):
                    self.c.typed(fqn, p.arg, name.rsplit(".", 1)[-1], "annotation")
        for d in [*a.defaults, *filter(None, a.kw_defaults)]:
            self.expression(d, fqn)
        if n.returns:
            self.types(n.returns, fqn)
        self.body(n.body, fqn, None, False)

    def klass(self, n, scope) -> None:
        bases = [dotted(b) for b in n.bases]
        tails = {b.rsplit(".", 1)[-1] for b in bases}
        kind = "interface" if tails & {"Protocol", "ABC"} else "enum" if any(t.endswith("Enum") or t == "Enum" for t in tails) else "class"
        marks = [dotted(d) for d in n.decorator_list]
        fqn = self.c.define(kind, n.name, scope, n.lineno, n.end_lineno, f"class {n.name}({', '.join(bases)})", ast.get_docstring(n), ["dataclass"] if any(m.endswith("dataclass") for m in marks) else [], not n.name.startswith("_"))
        for b in bases:
            if b:
                self.c.refer("extends", b.rsplit(".", 1)[-1], fqn, n.lineno, b.rpartition(".")[0])
        for m in marks:
            self.c.refer("decorator", m.rsplit(".", 1)[-1], fqn, n.lineno, m.rpartition(".")[0])
        self.body(n.body, fqn, kind, False)

    def assign(self, n, scope, owner) -> None:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target]
        for t in targets:
            if isinstance(t, ast.Name) and (owner or scope is None):
                kind = "enum_member" if owner == "enum" else "field" if owner else "constant" if t.id.isupper() else "variable"
                noted = ast.unparse(n.annotation) if isinstance(n, ast.AnnAssign) else None
                if noted and noted.endswith("TypeAlias"):
                    kind = "type_alias"
                self.c.define(kind, t.id, scope, n.lineno, n.end_lineno, ast.unparse(n) if n.end_lineno == n.lineno else t.id, exported=not t.id.startswith("_"), declared_type=noted)
            made = n.value if isinstance(n.value, ast.Call) else None
            name = t.id if isinstance(t, ast.Name) else dotted(t) if isinstance(t, ast.Attribute) else ""
            if name and isinstance(n, ast.AnnAssign):
                self.c.typed(scope, name, dotted(n.annotation).rsplit(".", 1)[-1], "annotation")
            elif name and made and (cls := dotted(made.func).rsplit(".", 1)[-1])[:1].isupper():
                self.c.typed(scope, name, cls, "field" if "." in name else "constructor_call")
            if isinstance(t, (ast.Attribute, ast.Subscript)):
                self.expression(t.value, scope)
        if isinstance(n, ast.AnnAssign):
            self.types(n.annotation, scope)
        if n.value is not None:
            self.expression(n.value, scope)

    def types(self, node, scope) -> None:
        for x in ast.walk(node):
            name = x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else ""
            if name[:1].isupper():
                self.c.refer("type", name, scope, node.lineno)

    def expression(self, node, scope) -> None:
        if isinstance(node, ast.Call):
            name, arity = dotted(node.func), len(node.args) + len(node.keywords)
            head, _, tail = name.rpartition(".")
            if tail in ("getenv",) or name.endswith("environ.get"):
                if node.args and isinstance(node.args[0], ast.Constant):
                    self.c.refer("config", str(node.args[0].value), scope, node.lineno)
            elif tail:
                self.c.refer("new" if not head and tail[:1].isupper() else "call", tail, scope, node.lineno, head, arity)
            if isinstance(node.func, ast.Attribute):
                self.expression(node.func.value, scope)
            elif not isinstance(node.func, ast.Name):
                self.expression(node.func, scope)
            for a in [*node.args, *(k.value for k in node.keywords)]:
                self.value(a, scope)
        elif isinstance(node, ast.Subscript):
            if dotted(node.value).endswith("environ") and isinstance(node.slice, ast.Constant):
                self.c.refer("config", str(node.slice.value), scope, node.lineno)
            self.expression(node.value, scope)
            self.expression(node.slice, scope)
        elif isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            for x in node.elts:
                self.value(x, scope)
        elif isinstance(node, ast.Dict):
            for x in [*filter(None, node.keys), *node.values]:
                self.value(x, scope)
        else:
            for x in ast.iter_child_nodes(node):
                self.expression(x, scope)

    def value(self, node, scope) -> None:
        if isinstance(node, ast.Name):
            self.c.refer("value", node.id, scope, node.lineno)
        else:
            self.expression(node.value if isinstance(node, ast.Starred) else node, scope)
