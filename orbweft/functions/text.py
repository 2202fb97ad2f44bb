"""Scalar functions over identifiers, paths and source text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_identifier(name: Column) -> Column:
    """Words of a camel, snake, acronym or dotted identifier, in lower case, with single spaces."""
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(s, r"[^A-Za-z0-9]+", " ")))


def simple_type(name: Column) -> Column:
    """A type without generics, pointers or path."""
    s = F.regexp_replace(F.regexp_replace(name, r"<.*|\[.*", ""), r"[*&?\s]+", "")
    return F.element_at(F.split(s, r"\.|::|/"), -1)


def one_line(text: Column, size: int = 240) -> Column:
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size - 1), F.lit("…"))).otherwise(s)


def code_shaped(word: Column) -> Column:
    """Whether a word looks like code: an inner capital, an underscore, a dollar, a digit or a dot."""
    return word.rlike(r"[a-z][A-Z]|[_$.]|[0-9]|^[A-Z].*[A-Z]")


def est_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.2)


def text_hash(model: Column, text: Column) -> Column:
    """First 20 hex digits of the SHA-1 of model, a zero byte and text."""
    return F.substring(F.sha1(F.concat(model, F.lit("\0"), text)), 1, 20)


def path_norm(path: Column) -> Column:
    """A path with . and .. resolved; what would climb above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(done, "/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def age_text(seconds: Column) -> Column:
    return F.when(seconds < 90, F.concat(F.round(seconds).cast("long").cast("string"), F.lit("s ago"))).when(seconds < 5400, F.concat(F.round(seconds / 60).cast("long").cast("string"), F.lit("m ago"))).otherwise(F.concat(F.round(seconds / 3600).cast("long").cast("string"), F.lit("h ago")))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency of a query term, .15 at least."""
    return F.greatest(F.lit(0.15), F.log((n + 1) / (df + 1)))


def generated_name(path: Column) -> Column:
    """Whether a path names built, minified or generated code: its folder, its suffix, a bundler's prefix, or a suffix that
    looks like a hash, which is one that is not letters of a word alone."""
    file = F.element_at(F.split(path, "/"), -1)
    script = file.rlike(r"(?i)\.(m?js|cjs|css)$")
    suffix = F.regexp_extract(file, r"(?i)[.-]([A-Za-z0-9_-]{6,})\.(?:m?js|cjs|css)$", 1)
    built = file.rlike(r"(?i)\.(min|bundle)\.\w+$|^(chunk|vendors?|runtime|polyfills?)[-.]") | ((suffix != "") & ~suffix.rlike(r"(?i)^[a-z]+$"))
    return path.rlike(r"(^|/)(generated|__generated__)/") | file.rlike(r"(?i)\.(g|freezed|pb)\.dart$|\.designer\.cs$") | (script & built)


def generated_text(text: Column, path: Column) -> Column:
    """Whether the first eight lines say so, or a script has lines no one writes."""
    head = F.substring_index(text, "\n", 8)
    lines = F.transform(F.split(text, "\n"), F.length)
    dense = path.rlike(r"\.[cm]?jsx?$") & ((F.array_max(lines) > 5000) | (F.length(text) / F.size(lines) > 400))
    return F.lower(head).rlike("do not edit|auto-?generated|@generated|code generated") | dense


def test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__|specs?|testing)/|(^|/)test_[^/]*$|[._-](test|spec)\.[^/]+$|_test\.[^/]+$|(^|/)conftest\.py$")


#: Folders and names of code that is not what a repository is about; (?i) as letters' case does not count.
ASIDE = r"(?i)(^|/)([^/]*(demos?|fixtures?)[^/]*|docs?|benchmarks?|bench|vendor|third_party|extras?|support|metrics|proto|website|www|migrations?)/|(^|/)db/migrate/|\.migration\.[^/]+$"
RUNNERS = r"(^|/)[Rr]unner/"
PLATFORMS = r"(?i)^(android|ios|macos|linux|windows|web)/"


def peripheral(path: Column, platform_root: bool = False) -> Column:
    """Whether a path is aside of the code a repository is about: docs, demos, vendored code, migrations, runners; with
    platform_root also the folders of platforms. A folder of examples is, unless a package is named so: after a domain's
    first part, or under a JVM source root."""
    package = r"(?i)((?:^|/)src/[^/]+/(?:java|kotlin|scala)/|(?:^|/)(?:com|org|net|io|dev|app|me)/)[^/]*(?:examples?|samples?)[^/]*/"
    shown = F.regexp_replace(path, package, "$1_/")
    found = path.rlike(ASIDE) | path.rlike(RUNNERS) | shown.rlike(r"(?i)(^|/)[^/]*(examples?|samples?)[^/]*/")
    return found | path.rlike(PLATFORMS) if platform_root else found


def fmt_symbol(kind: Column, fqn: Column, file: Column, start: Column, end: Column, signature: Column) -> Column:
    """One line that names a symbol: kind, fqn, place and signature if that says more."""
    more = F.when((F.length(signature) > 0) & (signature != fqn), F.concat(F.lit("  "), one_line(signature))).otherwise(F.lit(""))
    return F.concat(kind, F.lit(" "), fqn, F.lit(" ("), file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"), more)


def symbol_text(kind: Column, name: Column, fqn: Column, file: Column, signature: Column, doc: Column, parent_fqn: Column) -> Column:
    """What is embedded for a symbol: kind and name, its words, signature, doc, parent and the end of its path; a module's
    name, the words of its path, doc and path. Signatures have 240 characters of it at most, docs 300."""
    flat = lambda c, n: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)
    said = F.when(F.length(doc) > 0, flat(doc, 300))
    words = lambda c: F.when((split_identifier(c) != "") & (split_identifier(c) != F.lower(name)), split_identifier(c))
    tail = F.array_join(F.slice(F.split(file, "/"), F.greatest(F.size(F.split(file, "/")) - 2, F.lit(1)), 3), "/")
    shape = F.when((F.length(signature) > 0) & (signature != fqn) & (signature != name), flat(signature, 240))
    inside = F.when(parent_fqn != file, F.concat(F.lit("in "), parent_fqn))
    module = F.concat_ws(". ", F.concat(F.lit("module "), name), words(F.regexp_replace(file, r"\.[^.]+$", "")), said, file)
    other = F.concat_ws(". ", F.concat(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" "), name), words(name), shape, said, inside, tail)
    return F.when(kind == "module", module).otherwise(other)
