"""Reference resolution: each reference is bound by the first tier of joins that finds a definition.

Every tier is one equi-join with a provenance and a confidence; a tier may bind several definitions. What no tier binds
keeps up to eight candidates. Names with very many definitions are joined on (name, language family), and AQE splits
what is left of their skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweft.session import stored

CLASS_KINDS = ("class", "interface", "struct", "enum", "trait", "type_alias")
CALLABLE_KINDS = ("function", "method", "constructor", "macro", "test")
PASSABLE_KINDS = ("function", "method", "constructor")
CANDIDATES, SHORT = 8, 4
#: Member names too common to bind by name alone; a list of our own.
COMMON = ("get", "set", "add", "run", "name", "type", "value", "data", "close", "open", "read", "write", "init", "main", "test", "update", "remove", "delete", "next", "keys", "values", "items", "push", "pop", "map", "filter", "find", "size", "length", "toString", "equals")
#: Names that two of the languages bring with them; a list of our own.
BUILTINS = {"python": ("print", "len", "range", "str", "int", "dict", "list", "set", "tuple", "isinstance", "super", "open", "sorted", "enumerate", "zip", "map", "filter", "min", "max", "sum", "any", "all", "getattr", "setattr", "hasattr", "type", "repr", "bool", "float", "bytes", "Exception", "ValueError", "TypeError", "KeyError"), "javascript": ("console", "Promise", "Object", "Array", "String", "Number", "JSON", "Math", "Map", "Set", "Date", "Error", "require", "parseInt", "setTimeout")}
SELF = ("self", "this", "super", "cls", "@", "Self", "parent", "static")
#: Languages in which a bare name within a class means its members before the file's own.
IMPLICIT = ("java", "kotlin", "scala", "csharp", "swift", "ruby", "cpp", "dart", "objc", "groovy", "powershell")
#: Files that a name is followed through where one exports what it has from another.
CHAIN = 6


def family(language: Column) -> Column:
    """Languages whose names can refer to each other's."""
    return F.when(language.isin("javascript", "typescript", "tsx", "vue", "svelte"), "js").when(language.isin("java", "kotlin", "scala", "groovy"), "jvm").when(language.isin("c", "cpp", "objc"), "c").otherwise(language)


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports with paths: where each import's file may be, in order of preference."""
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    up = F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - F.col("relative_level") + 1, F.lit(0))), "/")
    module = F.translate("source", ".", "/")
    join = lambda a, b: F.when((a == "") | (b == ""), F.concat(a, b)).otherwise(F.concat(a, F.lit("/"), b))
    heads = F.when(F.col("relative_level") > 0, F.array(up)).otherwise(F.array(F.lit(""), F.lit("src"), F.lit("lib"), F.lit("python"), F.lit("app")))
    stem = F.transform(heads, lambda h: join(h, module))
    python = F.flatten(F.transform(stem, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))
    under = F.flatten(F.transform(stem, lambda s: F.transform("names", lambda n: F.concat(s, F.when(s == "", "").otherwise("/"), n["name"], F.lit(".py")))))
    rel = F.when(F.col("source").startswith("."), _norm(join(folder, F.col("source")))).otherwise(F.col("source"))
    plain = F.regexp_replace(rel, r"\.[cm]?jsx?$", "")
    script = F.concat(F.array(rel), F.transform(F.array(*map(F.lit, (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js"))), lambda e: F.concat(plain, e)), F.transform(F.array(*map(F.lit, (".ts", ".tsx", ".js"))), lambda e: F.concat(F.lit("src/"), plain, e)))
    local = F.array(_norm(join(folder, F.col("source"))), F.col("source"), *[F.concat(F.lit(h), F.col("source")) for h in ("include/", "src/", "inc/", "lib/")])
    nest = F.transform(F.array(*map(F.lit, ("", "src/main/java/", "src/main/kotlin/", "src/main/scala/", "src/", "app/src/main/java/"))), lambda h: F.concat(h, F.regexp_replace(F.translate("source", ".", "/"), r"/\*$", "")))
    jvm = F.flatten(F.transform(nest, lambda s: F.array(*[F.concat(s, F.lit(e)) for e in (".java", ".kt", ".scala", ".groovy")])))
    rust = F.transform(F.array(*map(F.lit, ("", "src/"))), lambda h: F.concat(h, F.regexp_replace(F.regexp_replace("source", r"^(crate|self|super)::", ""), "::", "/"), F.lit(".rs")))
    dots = lambda ext, *roots: F.array(*[F.concat(F.lit(r), F.translate("source", ".", "/"), F.lit(ext)) for r in roots])
    paths = (
        F.when(F.col("language") == "python", F.concat(python, under))
        .when(family(F.col("language")) == "js", script)
        .when(family(F.col("language")) == "jvm", jvm)
        .when(F.col("language") == "rust", rust)
        .when(F.col("language") == "lua", F.concat(dots(".lua", "", "lua/", "src/", "lib/"), dots("/init.lua", "", "lua/")))
        .when(F.col("language") == "haskell", dots(".hs", "", "src/", "app/", "lib/"))
        .when(F.col("language") == "ruby", F.array(*[F.concat(h, F.lit(".rb")) for h in (_norm(join(folder, F.col("source"))), F.concat(F.lit("lib/"), F.col("source")), F.col("source"))]))
        .when(F.col("language") == "markdown", F.array(_norm(join(folder, F.col("source"))), F.concat(_norm(join(folder, F.col("source"))), F.lit("/README.md"))))
        .otherwise(local)
    )
    return imports.withColumn("paths", paths)


def _norm(path: Column) -> Column:
    from orbweft.functions.text import path_norm

    return path_norm(path)


def import_targets(imports: DataFrame, files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """imports with resolved: the first of the paths that exists, those that the project's manifests (sources.manifest)
    name before all others; null where none does. A folder that a manifest names stands for its first file."""
    key = ["file", "pos"]
    each = import_candidates(imports).select(*key, F.lit(1).alias("late"), F.posexplode("paths").alias("k", "path"))
    known = files.select("path")
    if manifest is not None:
        from orbweft.sources.manifest import mapped

        to = mapped(imports, manifest)
        own = imports.join(to.withColumnRenamed("path", "__to"), key)
        there = import_candidates(own.withColumn("source", F.col("__to"))).select(*key, "__to", "language", "paths")
        index = F.array(*[F.concat("__to", F.lit(e)) for e in ("/src/index.ts", "/src/index.tsx", "/src/index.js", "/lib/index.js", "/index.mjs", ".php")])
        paths = F.concat("paths", F.when(F.col("language") == "go", F.array().cast("array<string>")).otherwise(index))
        each = each.union(there.select(*key, F.lit(0).alias("late"), F.posexplode(paths).alias("k", "path")))
        first = known.groupBy(F.regexp_replace("path", r"/?[^/]*$", "").alias("__to")).agg(F.min(F.when(F.col("path").endswith(".go"), F.col("path"))).alias("path"))
        each = each.union(own.where("language = 'go'").join(first, "__to").select(*key, F.lit(0).alias("late"), F.lit(0).alias("k"), "path"))
    first = each.join(known, "path").groupBy(*key).agg(F.min_by("path", F.struct("late", "k", "path")).alias("resolved"))
    return imports.join(first, key, "left")


def bindings(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name, target of what imports bring into a file: named symbols, wildcards and submodules.

    What a file has from another it exports in turn, where it defines no such name itself; chains end after CHAIN files.
    """
    top = symbols.where("parent = file AND kind <> 'module'").select(F.col("file").alias("resolved"), F.col("name").alias("member"), F.col("id").alias("target"))
    known = imports.where("resolved IS NOT NULL")
    named = known.select("file", "resolved", F.explode("names").alias("n")).select("file", "resolved", F.col("n.name").alias("member"), F.when(F.col("n.alias") != "", F.col("n.alias")).otherwise(F.col("n.name")).alias("name"))
    offered, before, found = top, -1, None
    for _ in range(CHAIN):
        one = named.where("member <> '*'").join(offered, ["resolved", "member"]).select("file", "name", "target")
        star = named.where("member = '*'").select("file", "resolved").join(offered, "resolved").select("file", F.col("member").alias("name"), "target")
        found = stored(one.union(star).distinct(), "bound")
        now = found.count()
        if now == before:
            break
        before = now
        passed = found.select(F.col("file").alias("resolved"), F.col("name").alias("member"), "target")
        offered = top.union(passed.join(top.select("resolved", "member"), ["resolved", "member"], "left_anti"))
    whole = known.where("alias <> ''").select("file", F.col("alias").alias("name"), F.col("resolved").alias("target"))
    return found.union(whole).distinct()


def external(imports: DataFrame) -> DataFrame:
    """file, name of what imports bring in from outside the repository."""
    out = imports.where("resolved IS NULL")
    named = out.select("file", F.explode("names").alias("n")).select("file", F.when(F.col("n.alias") != "", F.col("n.alias")).otherwise(F.col("n.name")).alias("name"))
    return named.union(out.where("alias <> ''").select("file", F.col("alias").alias("name"))).where("name <> '*'").distinct()


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame, local_types: DataFrame, supers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved). imports carry resolved. Edges: src, dst, kind, file, line, resolver, confidence.

    supers are the extends and implements edges; where they are not given they are resolved first, by the same tiers.
    """
    if supers is None:
        own = refs.where("kind IN ('extends', 'implements')")
        supers, _ = resolve(own, symbols, imports, local_types, symbols.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("extends").alias("kind")).limit(0))
    refs = stored(refs.withColumn("ref", F.concat_ws("|", "file", F.col("pos").cast("string"))).withColumn("family", family(F.col("language"))), "refs")
    symbols = stored(symbols, "symbols")
    imports = stored(imports, "imports")
    defs = symbols.where("kind NOT IN ('module', 'section', 'route', 'config_key')").withColumn("family", family(F.col("language")))
    bound = stored(bindings(imports, symbols), "bound")
    bare, dotted = refs.where("qualifier = ''"), refs.where("qualifier <> ''")
    member = symbols.where("parent IS NOT NULL").select(F.col("parent").alias("owner"), "name", F.col("id").alias("target"), F.col("kind").alias("def_kind"))
    chain = stored(scope_chain(symbols), "chain")
    parts: list[DataFrame] = []
    take = lambda df, tier, resolver, confidence: parts.append(df.select("ref", "target", F.lit(float(tier)).alias("tier"), F.lit(resolver).alias("resolver"), F.lit(float(confidence)).alias("confidence")))

    # Innermost enclosing scope, class levels left out.
    near = bare.join(chain.where("NOT class_like"), bare.scope == chain.inner).join(member, ["owner", "name"])
    least = near.groupBy("ref").agg(F.min("depth").alias("depth"))
    near = near.join(least, ["ref", "depth"])
    late = F.col("language").isin(*IMPLICIT) & (F.col("owner") == F.col("file"))  # members come before the file's own
    take(near.where(~late), 0, "scope", 1.0)
    take(near.where(late), 0.6, "scope", 1.0)
    # Members of the class around, for self-qualified names.
    mine = dotted.where(F.col("qualifier").isin(*SELF)).join(chain.where("class_like"), dotted.scope == chain.inner)
    closure = stored(owners(symbols, supers), "owners")
    hits = mine.join(closure.withColumnRenamed("cls", "owner"), "owner").join(member.withColumnRenamed("owner", "via"), ["via", "name"])
    least = hits.groupBy("ref").agg(F.min("up").alias("up"))
    take(hits.join(least, ["ref", "up"]), 0, "receiver", 1.0)
    # Members of a class around, own or inherited, that a bare name means.
    around = bare.where(F.col("language").isin(*IMPLICIT)).join(chain.where("class_like"), bare.scope == chain.inner)
    hits = around.join(closure.withColumnRenamed("cls", "owner"), "owner").join(member.withColumnRenamed("owner", "via"), ["via", "name"])
    fits = F.when(F.col("kind").isin("value", "mention"), F.col("def_kind").isin(*PASSABLE_KINDS)).when(F.col("kind").isin("type", "extends", "implements", "new"), F.col("def_kind").isin(*CLASS_KINDS)).otherwise(F.lit(True))
    hits = hits.where(fits)
    least = hits.groupBy("ref").agg(F.min(F.struct("depth", "up")).alias("m")).select("ref", "m.*")
    take(hits.join(least, ["ref", "depth", "up"]), 0.5, "receiver", 0.95)
    # What imports bring in, by name and through a module's alias.
    take(bare.join(bound, ["file", "name"]), 1, "import", 1.0)
    via = dotted.join(bound.select("file", F.col("name").alias("qualifier"), F.col("target").alias("owner")), ["file", "qualifier"]).join(member, ["owner", "name"])
    take(via, 1, "import", 1.0)
    # The same folder's top level, in languages that share it.
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    tops = defs.where("parent = file").select(folder(F.col("file")).alias("folder"), "family", "name", F.col("id").alias("target"))
    take(bare.where(F.col("language").isin("go", "java", "kotlin", "scala", "swift", "terraform")).withColumn("folder", folder(F.col("file"))).join(tops, ["folder", "family", "name"]), 2, "scope", 0.95)
    # The type of the receiver.
    types = local_types.groupBy("file", "scope", "name").agg(F.max_by("type", "pos").alias("type"))
    cls = defs.where(F.col("kind").isin(*CLASS_KINDS)).select(F.col("name").alias("type"), "family", F.col("id").alias("cls"))
    head = dotted.withColumn("receiver", F.col("qualifier"))
    typed = head.join(types.select("file", "scope", F.col("name").alias("receiver"), "type"), ["file", "scope", "receiver"]).join(cls, ["type", "family"]).join(closure, "cls").join(member.withColumnRenamed("owner", "via"), ["via", "name"])
    least = typed.groupBy("ref").agg(F.min("up").alias("up"))
    take(typed.join(least, ["ref", "up"]), 2, "receiver", 0.9)
    # A container named by the qualifier.
    static = dotted.withColumn("type", F.element_at(F.split("qualifier", r"\.|::"), -1)).join(cls, ["type", "family"]).join(member.withColumnRenamed("owner", "cls"), ["cls", "name"])
    several = static.groupBy("ref").agg(F.countDistinct("target").alias("m"))
    take(static.join(several.where("m = 1"), "ref"), 3, "unique", 0.8)
    # A name that one exported definition of the family has.
    builtin = F.lit(False)
    for language, names in BUILTINS.items():
        builtin |= (F.col("language") == language) & F.col("name").isin(*names)
    loose = refs.where((F.length("name") >= SHORT) & ~F.col("name").isin(*COMMON) & ~builtin)
    outside = stored(external(imports), "external")
    by = lambda k: outside.select("file", F.col("name").alias(k))
    loose = loose.where("qualifier = ''").join(by("name"), ["file", "name"], "left_anti").unionByName(loose.where("qualifier <> ''").join(by("qualifier"), ["file", "qualifier"], "left_anti"))
    named = defs.where("exported").groupBy("name", "family").agg(F.count("*").alias("m"), F.min("id").alias("target"))
    alone = loose.join(named.where("m = 1"), ["name", "family"])
    kinds = defs.select(F.col("id").alias("target"), F.col("kind").alias("def_kind"))
    alone = alone.join(kinds, "target").where(~F.col("ref").isNull() & (F.col("kind").isin("mention", "value") | ~F.col("kind").isin("call") | F.col("def_kind").isin(*CALLABLE_KINDS, *CLASS_KINDS)))
    take(alone.where("qualifier = ''"), 4, "unique", 0.7)
    take(alone.where("qualifier <> ''"), 5, "heuristic", 0.5)
    # A text's mention of a name that one exported definition of any language has.
    only = defs.where("exported").groupBy("name").agg(F.count("*").alias("m"), F.min("id").alias("target")).where("m = 1")
    take(loose.where("kind = 'mention'").join(only, "name"), 4, "unique", 0.7)
    # Of several, the one in an imported file.
    many = defs.where("exported").select("name", "family", F.col("id").alias("target"), F.col("file").alias("resolved"))
    take(loose.join(many, ["name", "family"]).join(imports.where("resolved IS NOT NULL").select("file", "resolved").distinct(), ["file", "resolved"]), 5, "heuristic", 0.6)

    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = stored(found, "found")
    first = found.groupBy("ref").agg(F.min("tier").alias("tier"))
    best = stored(found.join(first, ["ref", "tier"]).groupBy("ref", "target").agg(F.max(F.struct("confidence", "resolver")).alias("m")), "bindings")
    edge = refs.where("kind <> 'config'").join(best, "ref").join(kinds, "target", "left")
    passes = (F.col("kind") == "value") & F.col("def_kind").isin(*PASSABLE_KINDS)
    kind = F.when(F.col("kind").isin("call", "new"), "calls").when(F.col("kind").isin("extends", "implements"), F.col("kind")).when(F.col("kind") == "decorator", "decorates").when(passes, "passes").otherwise("references")
    edges = edge.where("scope <> target").select(F.col("scope").alias("src"), F.col("target").alias("dst"), kind.alias("kind"), "file", "line", "m.resolver", "m.confidence").dropDuplicates(["src", "dst", "kind", "line"])
    edges = stored(edges, "edges")
    brought = imports.where("resolved IS NOT NULL AND resolved <> file").select(F.col("file").alias("src"), F.col("resolved").alias("dst"), F.lit("imports").alias("kind"), "file", "line", F.lit("import").alias("resolver"), F.when(F.col("kind") == "type", 0.9).otherwise(1.0).alias("confidence"))
    config = refs.where("kind = 'config'").select(F.col("scope").alias("src"), F.concat(F.lit("env::"), "name").alias("dst"), F.lit("reads_config").alias("kind"), "file", "line", F.lit("structural").alias("resolver"), F.lit(1.0).alias("confidence"))
    routes = symbols.where("kind = 'route' AND meta['handler'] IS NOT NULL").select(F.col("id").alias("src"), "file", F.col("start_line").alias("line"), F.element_at(F.split(F.col("meta")["handler"], r"\."), -1).alias("name"))
    handled = routes.join(defs.select("file", "name", F.col("id").alias("dst")), ["file", "name"]).select("src", "dst", F.lit("defines_route").alias("kind"), "file", "line", F.lit("structural").alias("resolver"), F.lit(1.0).alias("confidence"))
    tests = edges.join(symbols.where("is_test OR kind = 'test'").select(F.col("id").alias("src")), "src", "left_semi").join(symbols.where("NOT is_test").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("tests").alias("kind"), "file", "line", F.lit("structural").alias("resolver"), F.lit(1.0).alias("confidence")).distinct()
    left = loose.where("kind <> 'config'").join(best.select("ref"), "ref", "left_anti")
    order = Window.partitionBy("name", "family").orderBy("file", "ordinal")
    named8 = defs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= CANDIDATES).groupBy("name", "family").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("candidates"))
    unresolved = left.join(named8, ["name", "family"]).select("file", "scope", "kind", "name", "qualifier", "line", "candidates")
    return edges.unionByName(brought).unionByName(config.distinct()).unionByName(handled).unionByName(tests), unresolved


def scope_chain(symbols: DataFrame) -> DataFrame:
    """inner, owner, depth, class_like: every scope around each scope, itself first, however deep.

    A scope that is its own ancestor, which no extractor makes, ends the chain after as many steps as there are symbols.
    """
    s = symbols.select("id", "parent", F.col("kind").isin(*CLASS_KINDS).alias("class_like"))
    up = s.select(F.col("id").alias("owner"), F.col("parent").alias("above"), F.col("class_like").alias("c"))
    out = front = s.select(F.col("id").alias("inner"), F.col("id").alias("owner"), F.lit(0).alias("depth"), "class_like", "parent")
    most, d = s.count(), 0
    while d < most:
        d += 1
        above = front.where("parent IS NOT NULL").select("inner", F.col("parent").alias("owner")).join(up, "owner")
        front = stored(above.select("inner", "owner", F.lit(d).alias("depth"), F.col("c").alias("class_like"), F.col("above").alias("parent")), "scopes")
        if front.isEmpty():
            break
        out = out.union(front)
    return out.drop("parent")


def owners(symbols: DataFrame, supers: DataFrame | None, limit: int = 6) -> DataFrame:
    """cls, via, up: each class and, by extends and implements edges, its ancestors with their distance."""
    own = symbols.where(F.col("kind").isin(*CLASS_KINDS)).select(F.col("id").alias("cls"), F.col("id").alias("via"), F.lit(0).alias("up"))
    if supers is None:
        return own
    from orbweft.operators.graph import closure

    up = closure(supers.where("kind IN ('extends', 'implements')").select(F.col("src").alias("child"), F.col("dst").alias("parent")), limit=limit)
    return own.union(up.select(F.col("child").alias("cls"), F.col("ancestor").alias("via"), F.col("depth").alias("up")))
