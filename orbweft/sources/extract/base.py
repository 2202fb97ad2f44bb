"""What extractors share: the collector of a file's facts and the registry."""

from __future__ import annotations

import re

EXTRACTORS: dict = {}
TEST_FILE = re.compile(r"(^|/)(tests?|testing|__tests__|specs?)/|(^|/)test_[^/]*$|(_test|[._-]spec|\.test|Tests?)\.[^/.]+$|(^|/)conftest\.py$")


class Collector:
    """Definitions, references, imports and local types of one file, in the order they are met."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.doc, self.errors = path, language, "", 0
        self.is_test = bool(TEST_FILE.search(path))
        self.definitions: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.local_types: list[dict] = []

    def define(self, kind, name, parent=None, line=1, end=None, signature="", doc="", modifiers=(), exported=True, declared_type=None, meta=None, fqn=None) -> str:
        fqn = fqn or (f"{parent}.{name}" if parent else name)
        self.definitions.append({"kind": kind, "name": name, "fqn": fqn, "parent": parent, "ordinal": len(self.definitions), "start_line": line, "end_line": end or line, "signature": one_line(signature), "doc": doc or "", "modifiers": " ".join(modifiers), "exported": exported, "declared_type": declared_type, "meta": meta})
        return fqn

    def refer(self, kind, name, scope=None, line=1, qualifier="", arity=None) -> None:
        if name:
            self.refs.append({"kind": kind, "name": name, "qualifier": qualifier, "scope": scope, "line": line, "arity": arity})

    def bring(self, source, line=1, alias="", kind="static", names=(), namespace=False, level=0) -> None:
        self.imports.append({"source": source, "alias": alias, "kind": kind, "names": [{"name": n, "alias": a} for n, a in names], "namespace": namespace, "line": line, "relative_level": level})

    def typed(self, scope, name, type_, via) -> None:
        self.local_types.append({"scope": scope, "name": name, "type": type_, "via": via})

    def reparent(self) -> None:
        """Members of a reopened block go to the type of that name in the same file, unless it lies within the block."""
        own = {d["fqn"]: d for d in self.definitions}
        moved = {}
        for d in self.definitions:
            if (d["meta"] or {}).get("reopens"):
                target = next((t for t in self.definitions if t["name"] == d["meta"]["reopens"] and t is not d and not (t["meta"] or {}).get("reopens")), None)
                if target and not target["fqn"].startswith(d["fqn"] + "."):
                    moved[d["fqn"]] = target["fqn"]
        for d in self.definitions:
            if d["parent"] in moved and d["parent"] in own:
                d["parent"] = moved[d["parent"]]

    def record(self, digest: str) -> dict:
        return {"path": self.path, "language": self.language, "hash": digest, "doc": self.doc, "error_pct": min(100, self.errors), "is_test": self.is_test, "definitions": self.definitions, "refs": self.refs, "imports": self.imports, "local_types": self.local_types}


def one_line(text: str, size: int = 240) -> str:
    s = re.sub(r"\s+", " ", text or "").strip()
    return s if len(s) <= size else s[: size - 1] + "…"


def clean_comment(text: str) -> str:
    """A comment without its markers."""
    lines = [re.sub(r"^\s*(/\*\*?|\*/|\*|///?!?|#+|--+|;+|%+)\s?|\s*\*/\s*$", "", x) for x in text.strip().splitlines()]
    return "\n".join(lines).strip()
