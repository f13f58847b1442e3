"""Graphs of Python sources: references, and the calls, bases and imports that they resolve to.

One pass over the sources gives flat references. Resolving a name is a set of candidates (a module and a name in it, with
a level), an equi-join with the definitions, and the first level that has one; what has none is external.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values
WEIGHTS = {"import": 0.5, "inheritance": 1.5, "call": 1.0}
PRIORITY = {"import": 0, "inheritance": 1, "call": 2}

REFERENCES = "path string, module string, kind string, scope string, cls string, name string, target string, line long"


def module_of(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def dotted(node: ast.AST) -> str | None:
    """`a.b.c` of names and attributes; a call or subscript before the last name leaves `?.name`; None for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        before = dotted(node.value)
        return f"{before}.{node.attr}" if before else f"?.{node.attr}"
    return dotted(node.value) if isinstance(node, ast.Subscript) else None


def scan_references(path: str, text: str) -> list[tuple]:
    """Rows of (path, module, kind, scope, cls, name, target, line): functions, classes, bases, calls, imports and exports."""
    module, out = module_of(path), []

    def put(kind, scope, cls, name, target, node):
        out.append((path, module, kind, scope, cls, name, target, node.lineno))

    def walk(node: ast.AST, scope: str, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, owner = scope, cls
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
                is_class = isinstance(child, ast.ClassDef)
                put("class" if is_class else "function", scope, cls, inner, None, child)
                owner = inner if is_class else cls
                for base in child.bases if is_class else ():
                    if name := dotted(base):
                        put("base", inner, owner, None, name, child)
            elif isinstance(child, ast.Call):
                if name := dotted(child.func):
                    put("call", scope, cls, None, name, child)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    put("import", scope, cls, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], child)
                    put("module", scope, cls, None, a.name, child)
            elif isinstance(child, ast.ImportFrom) and child.module:
                put("module", scope, cls, None, child.module, child)
                for a in child.names:
                    put("import", scope, cls, a.asname or a.name, f"{child.module}:{a.name}", child)
            elif isinstance(child, ast.Assign) and not scope and any(isinstance(t, ast.Name) and t.id == "__all__" for t in child.targets):
                for x in getattr(child.value, "elts", []):
                    if isinstance(x, ast.Constant):
                        put("export", "", None, str(x.value), None, child)
            walk(child, inner, owner)

    walk(ast.parse(text), "", None)
    return out


def references(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """All references of Python sources; one that does not parse, or is null, gives none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, t in zip(pdf[path], pdf[text], strict=True):
                try:
                    out += scan_references(p, t or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["path", "module", "kind", "scope", "cls", "name", "target", "line"])

    return files.select(path, text).mapInPandas(run, REFERENCES)


def definitions(refs: DataFrame) -> DataFrame:
    """(id, path, module, qualname, kind, line) of functions and classes; of equal ids the first by line."""
    rows = refs.where(F.col("kind").isin("function", "class")).groupBy("path", "module", F.col("name").alias("qualname")).agg(F.min_by(F.struct("kind", "line"), "line").alias("_d"))
    return rows.select(F.concat("path", F.lit(":"), "qualname").alias("id"), "path", "module", "qualname", "_d.kind", "_d.line")


def _candidate(level: int, module: Column, name: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), module.alias("m"), name.alias("q")))


def resolved(refs: DataFrame, kind: str) -> DataFrame:
    """(src, dst, path, line, level) of calls or bases: self, then enclosing scopes, the module, and imports; level 5 is external."""
    defs = definitions(refs).select(F.col("module").alias("_m"), F.col("qualname").alias("_q"), "id")
    bound = refs.where("kind = 'import'").groupBy("path", F.col("name").alias("_head")).agg(F.max("target").alias("_bound"))
    rows = refs.where(F.col("kind") == kind).withColumn("_at", F.monotonically_increasing_id())
    parts = F.split("target", r"\.")
    rows = rows.withColumns({"_head": parts[0], "_rest": F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "."), "_bare": F.size(parts) == 1})
    rows = rows.join(bound, ["path", "_head"], "left")
    from_module, attr = F.substring_index("_bound", ":", 1), F.when(F.contains("_bound", F.lit(":")), F.element_at(F.split("_bound", ":"), -1))
    scopes = F.split("scope", r"\.")
    enclosing = F.transform(F.sequence(F.lit(1), F.greatest(F.size(scopes), F.lit(1))), lambda k: F.struct((F.lit(2) - k / 1000).alias("level"), F.col("module").alias("m"), F.concat_ws(".", F.slice(scopes, 1, k), F.col("_head")).alias("q")))
    own = F.array(
        _candidate(0, F.col("module"), F.concat_ws(".", "cls", "_rest"), (F.col("_head") == "self") & F.col("cls").isNotNull()),
        _candidate(2, F.col("module"), F.col("target"), F.lit(True)),
        _candidate(3, from_module, attr, F.col("_bare") & attr.isNotNull()),
        _candidate(4, from_module, F.concat_ws(".", attr, "_rest"), ~F.col("_bare") & F.col("_bound").isNotNull()),
    )
    own = F.transform(F.array_compact(own), lambda c: F.struct(c["level"].cast("double").alias("level"), c["m"].alias("m"), c["q"].alias("q")))
    inside = F.transform(enclosing, lambda c: F.struct(c["level"].cast("double").alias("level"), c["m"].alias("m"), c["q"].alias("q")))
    options = F.concat(own, F.when(F.col("_bare") & (F.col("scope") != ""), inside).otherwise(F.slice(inside, 1, 0)))
    found = rows.select("_at", F.explode(options).alias("_c")).join(defs, (F.col("_c.m") == F.col("_m")) & (F.col("_c.q") == F.col("_q")))
    best = found.groupBy("_at").agg(F.min_by(F.struct("id", "_c.level"), F.struct("_c.level", "id")).alias("_b"))
    outside = F.when(F.col("_head") == "self", F.col("_rest")).when(F.col("_bound").isNull(), F.element_at(parts, -1)).otherwise(F.concat_ws(".", F.translate("_bound", ":", "."), F.when(~F.col("_bare"), F.col("_rest"))))
    src = F.concat("path", F.lit(":"), F.when(F.col("scope") == "", "<module>").otherwise(F.col("scope")))
    out = rows.join(best, "_at", "left")
    return out.select(src.alias("src"), F.coalesce("_b.id", F.concat(F.lit("external:"), outside)).alias("dst"), "path", "line", F.when(F.col("_b").isNull(), 5).otherwise(F.ceil("_b.level")).cast("int").alias("level"))


def import_edges(refs: DataFrame) -> DataFrame:
    """(src, dst, module): paths that import each other, distinct and never themselves; dst is null where no source is that module."""
    modules = refs.select(F.col("path").alias("dst"), F.col("module").alias("_m")).distinct()
    rows = refs.where("kind = 'module'").select(F.col("path").alias("src"), F.col("target").alias("module")).distinct()
    out = rows.join(modules, F.col("module") == F.col("_m"), "left").drop("_m")
    return out.where(F.col("dst").isNull() | (F.col("src") != F.col("dst"))).select("src", "dst", "module")


def edges(refs: DataFrame) -> DataFrame:
    """(src, dst, type, weight) of calls, bases and imports, one of each pair, of the first type."""
    from orrery.operators import graph

    parts = [import_edges(refs).where("dst IS NOT NULL").select("src", "dst", F.lit("import").alias("type"))]
    parts += [resolved(refs, kind).select("src", "dst", F.lit(name).alias("type")) for kind, name in (("base", "inheritance"), ("call", "call"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return graph.first_edges(rows.withColumn("weight", weight[F.col("type")]), PRIORITY)


def used_by_tests(refs: DataFrame) -> DataFrame:
    """(id): definitions that sources with `test` in their path call or import."""
    tests = refs.where(F.lower("path").contains("test"))
    called = resolved(refs, "call").where(F.lower("path").contains("test")).select(F.col("dst").alias("id"))
    imported = tests.where("kind = 'import' AND target LIKE '%:%'").select(F.substring_index("target", ":", 1).alias("module"), F.element_at(F.split("target", ":"), -1).alias("qualname")).distinct()
    named = definitions(refs).join(imported, ["module", "qualname"], "left_semi").select("id")
    return called.where("NOT startswith(id, 'external:')").union(named).distinct()


def dispatched(refs: DataFrame) -> DataFrame:
    """(id): visit_ and leave_ methods of classes with a base whose last name holds Visitor, or that call visit or generic_visit."""
    defs = definitions(refs).where("kind = 'function'").withColumn("_class", F.regexp_extract("id", r"^(.*)\.[^.:]+$", 1))
    methods = defs.where(F.element_at(F.split("qualname", r"\."), -1).rlike("^(visit|leave)_"))
    by_base = resolved(refs, "base").where(F.element_at(F.split("dst", ":"), -1).contains("Visitor")).select(F.col("src").alias("_class"))
    own = refs.where((F.col("kind") == "call") & F.element_at(F.split("target", r"\."), -1).isin("generic_visit", "visit") & F.col("cls").isNotNull()).select(F.concat("path", F.lit(":"), "cls").alias("_class"))
    return methods.join(by_base.union(own).distinct(), "_class", "left_semi").select("id")


def dead_code(refs: DataFrame) -> DataFrame:
    """(id, line, reason) of functions that nothing calls; reason is why one is not taken for dead: test, dispatch or special."""
    functions = definitions(refs).where("kind = 'function'")
    called = resolved(refs, "call").select(F.col("dst").alias("id")).distinct()
    last = F.element_at(F.split("qualname", r"\."), -1)
    rows = functions.join(called, "id", "left_anti").join(dispatched(refs).withColumn("_d", F.lit(True)), "id", "left")
    reason = F.when(F.lower("path").contains("test"), "test").when(F.col("_d"), "dispatch").when(last.rlike("^__.*__$"), "special")
    return rows.select("id", "line", reason.alias("reason"))


def dead_api(refs: DataFrame) -> DataFrame:
    """(id, line): names of __all__ that are functions or classes, and that nothing calls."""
    exported = refs.where("kind = 'export'").select("path", F.col("name").alias("qualname")).distinct()
    called = resolved(refs, "call").select(F.col("dst").alias("id")).distinct()
    return definitions(refs).join(exported, ["path", "qualname"], "left_semi").join(called, "id", "left_anti").select("id", "line")


def never_executed(refs: DataFrame, seen: DataFrame, id_: str = "id") -> DataFrame:
    """(id): functions that a run has not seen."""
    return definitions(refs).where("kind = 'function'").join(seen.select(F.col(id_).alias("id")).distinct(), "id", "left_anti").select("id")


def looked_up(nodes: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """(name, id, level): for each wanted name the node of that id, else of that qualified name, else whose qualified name ends in it; externals last."""
    q = F.element_at(F.split("id", ":"), -1)
    outside = F.when(F.col("id").startswith("external:"), 10).otherwise(0)
    keyed = nodes.select("id", F.explode(F.array(F.struct(F.lit(0).alias("l"), F.col("id").alias("k")), F.struct(F.lit(1).alias("l"), q.alias("k")), F.struct(F.lit(2).alias("l"), F.element_at(F.split(q, r"\."), -1).alias("k")))).alias("_k"), outside.alias("_o"))
    keyed = keyed.select("id", F.col("_k.k").alias(name), (F.col("_k.l") + F.col("_o")).alias("level"))
    best = wanted.select(name).distinct().join(keyed, name).groupBy(name).agg(F.min_by(F.struct("id", "level"), F.struct("level", "id")).alias("_b"))
    return wanted.select(name).distinct().join(best, name, "left").select(name, "_b.id", "_b.level")


def impact(all_edges: DataFrame, nodes: DataFrame, wanted: DataFrame, name: str = "name", most: int = 50, depth: int = 10) -> DataFrame:
    """(name, id, n_dependants, max_depth, truncated, dependants): what depends on each wanted symbol; at most `most` ids are listed, all are counted. A name that no node has stays with nulls."""
    from orrery.operators import graph

    found = looked_up(nodes, wanted, name)
    reached = graph.reach(all_edges, found.where("id IS NOT NULL").select("id"), depth, backward=True)
    place = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "node"))
    rows = reached.withColumn("_r", place).groupBy("origin").agg(F.count("*").alias("n_dependants"), F.max("depth").alias("max_depth"), F.bool_or("truncated").alias("truncated"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "node")))).alias("_l"))
    out = found.join(rows, F.col("id") == F.col("origin"), "left")
    return out.select(name, "id", F.when(F.col("id").isNotNull(), F.coalesce("n_dependants", F.lit(0))).alias("n_dependants"), "max_depth", "truncated", F.transform("_l", lambda x: x["node"]).alias("dependants"))
