"""A small repository, with what extraction and resolution must find in it, told by hand."""

from __future__ import annotations

FILES = {
    "app/models.py": '''class Base:
    def touch(self):
        pass


class Item(Base):
    def __init__(self, name):
        self.name = name

    def refresh(self):
        self.touch()
        return normalise_name(self.name)
''',
    "app/helpers.py": '''def normalise_name(text):
    return text.strip()
''',
    "app/__init__.py": '''from app.models import Item
''',
    "app/service.py": '''import os
from app import Item
from app.helpers import normalise_name
from requests import fetch_page


def build_item(name):
    item = Item(normalise_name(name))
    item.refresh()
    fetch_page(name)
    return register_all(build_item)


def register_all(callback):
    return os.environ["APP_TIMEOUT"]
''',
    "tests/test_service.py": '''from app.service import build_item


def test_build():
    assert build_item("a")
''',
    "jvm/Shop.java": '''class Shop extends Store {
  void open() {
    restock();
  }
}
''',
    "jvm/Store.java": '''class Store {
  void restock() { }
}
''',
    "web/cart.ts": '''export function addAll(a: number, b: number) { return a + b; }
''',
    "web/main.ts": '''import { addAll } from './cart';
export function boot() { return addAll(1, 2); }
''',
}
#: id, kind, start, end of every symbol but the modules.
SYMBOLS = [
    ("app/models.py::Base", "class", 1, 3),
    ("app/models.py::Base.touch", "method", 2, 3),
    ("app/models.py::Item", "class", 6, 12),
    ("app/models.py::Item.__init__", "constructor", 7, 8),
    ("app/models.py::Item.refresh", "method", 10, 12),
    ("app/helpers.py::normalise_name", "function", 1, 2),
    ("app/service.py::build_item", "function", 7, 11),
    ("app/service.py::register_all", "function", 14, 15),
    ("tests/test_service.py::test_build", "test", 4, 5),
    ("jvm/Shop.java::Shop", "class", 1, 5),
    ("jvm/Shop.java::Shop.open", "method", 2, 4),
    ("jvm/Store.java::Store", "class", 1, 3),
    ("jvm/Store.java::Store.restock", "method", 2, 2),
    ("web/cart.ts::addAll", "function", 1, 1),
    ("web/main.ts::boot", "function", 2, 2),
]
#: src, dst, kind, resolver, confidence of every edge.
EDGES = [
    ("app/models.py::Item", "app/models.py::Base", "extends", "scope", 1.0),
    ("app/models.py::Item.refresh", "app/models.py::Base.touch", "calls", "receiver", 1.0),
    ("app/models.py::Item.refresh", "app/helpers.py::normalise_name", "calls", "unique", 0.7),
    ("app/__init__.py", "app/models.py", "imports", "import", 1.0),
    ("app/service.py", "app/__init__.py", "imports", "import", 1.0),
    ("app/service.py", "app/helpers.py", "imports", "import", 1.0),
    ("app/service.py::build_item", "app/models.py::Item", "calls", "import", 1.0),
    ("app/service.py::build_item", "app/helpers.py::normalise_name", "calls", "import", 1.0),
    ("app/service.py::build_item", "app/models.py::Item.refresh", "calls", "receiver", 0.9),
    ("app/service.py::build_item", "app/service.py::register_all", "calls", "scope", 1.0),
    ("app/service.py::register_all", "env::APP_TIMEOUT", "reads_config", "structural", 1.0),
    ("tests/test_service.py", "app/service.py", "imports", "import", 1.0),
    ("tests/test_service.py::test_build", "app/service.py::build_item", "calls", "import", 1.0),
    ("tests/test_service.py::test_build", "app/service.py::build_item", "tests", "structural", 1.0),
    ("jvm/Shop.java::Shop", "jvm/Store.java::Store", "extends", "scope", 0.95),
    ("jvm/Shop.java::Shop.open", "jvm/Store.java::Store.restock", "calls", "receiver", 0.95),
    ("web/main.ts", "web/cart.ts", "imports", "import", 1.0),
    ("web/main.ts::boot", "web/cart.ts::addAll", "calls", "import", 1.0),
]


def values(rows: list[tuple], names: str) -> str:
    """SQL of a table of the rows."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::INT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"
