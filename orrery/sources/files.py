"""Files as tables: pruned listings, languages, JSON-lines logs, change logs, Markdown registries and Python sources."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions.constants import PHI

# fixed values
EXCLUDED = [".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist"]
LANGUAGES = {"py": "python", "lean": "lean", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "c_sharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "lua": "lua", "jl": "julia", "r": "r", "sh": "bash", "sql": "sql", "hs": "haskell", "ml": "ocaml", "ex": "elixir", "erl": "erlang"}


def listing(spark: SparkSession, folder: str, glob: str = "*", excluded: list[str] | None = None, content: bool = True) -> DataFrame:
    """path, size, modified and (if wanted) text of the files below a folder, less those under an excluded folder or one ending in .egg-info. The file source itself passes over names that begin with a dot or underscore below a folder, and over empty files."""
    names = EXCLUDED if excluded is None else excluded
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    kept = files.where(~F.exists(parts, lambda p: p.isin(names) | p.endswith(".egg-info"))) if names else files
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.decode("content", "UTF-8").alias("text")] if content else []))


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """language by extension, null where there is none."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.withColumn("language", F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))))


def unsupported(files: DataFrame) -> DataFrame:
    return with_language(files).where("language IS NULL").select("path", F.lit("no analyser for the extension").alias("reason"))


def event_log(spark: SparkSession, path: str, schema: str, kind: str = "type", vocabulary: list[str] | None = None) -> DataFrame:
    """JSON lines; corrupt ones and types outside the vocabulary are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if vocabulary is None else rows.where(F.col(kind).isin(vocabulary))


def change_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """commit, ts, subject, file, added, removed from `commit|ISO time|subject` lines, each followed by its `added<TAB>removed<TAB>file` rows in the same text; binary rows are skipped."""
    entry = F.explode(F.split(F.col(text), r"\n(?=[0-9a-f]{7,40}\|)")).alias("e")
    one = lines.select(entry).select(F.split("e", "\n").alias("l")).select(F.split(F.element_at("l", 1), r"\|", 3).alias("h"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("row"))
    c = F.split("row", "\t")
    return one.where(F.col("row").rlike(r"^\d+\t\d+\t")).select(F.col("h")[0].alias("commit"), F.to_timestamp(F.col("h")[1]).alias("ts"), F.col("h")[2].alias("subject"), c[2].alias("file"), c[0].cast("long").alias("added"), c[1].cast("long").alias("removed"))


def markdown_rows(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """section, cells of the pipe tables of Markdown texts; ruler rows are left out, and `malformed` marks rows of another width than the table's first."""
    lines = texts.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line", "l"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keep).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(F.when(F.col("l").rlike(r"^#+\s"), F.regexp_replace("l", r"^#+\s*", "")), ignorenulls=True).over(w))
    cells = F.transform(F.split(F.regexp_replace(F.trim("l"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.where(F.trim("l").startswith("|") & ~F.col("l").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).withColumn("cells", cells)
    first = F.first(F.size("cells")).over(Window.partitionBy(*keep, "section").orderBy("line"))
    return rows.withColumn("malformed", F.size("cells") != first).select(*keep, "section", "line", "cells", "malformed")


def imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, module) of lines that begin with import or from ... import."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*(?:import|from)\s+([\w.]+)"), 1)
    return files.select(path, F.explode(F.array_distinct(found)).alias("module"))


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.BoolOp, ast.comprehension, ast.Assert)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _is_open(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "open"


def scan_source(text: str) -> tuple[list[tuple], list[tuple]]:
    """Functions (name, line, kappa, n_args, n_lines, depth, cyclomatic) inner before outer, and notes (line, level, rule)."""
    items: list[tuple] = []
    notes: list[tuple] = []

    def walk(node: ast.AST, above: tuple[ast.AST, ...], nested: int) -> tuple[int, int, int]:
        """Nodes, depth of control and branches of a subtree; `nested` counts loops, conditions and functions around it."""
        loop = isinstance(node, (ast.For, ast.While))
        if loop and nested >= 2:
            notes.append((node.lineno, "CRITICAL" if nested >= 3 else "WARNING", "LILITH"))
        if _is_open(node) and not (isinstance(above[-1], ast.withitem) or (len(above) > 1 and isinstance(above[-2], ast.With))):
            notes.append((node.lineno, "WARNING", "SUTURE"))
        inner = nested + (loop or isinstance(node, (ast.If, ast.FunctionDef)))
        parts = [walk(child, (*above[-2:], node), inner) for child in ast.iter_child_nodes(node)]
        size = 1 + sum(p[0] for p in parts)
        deepest = max((p[1] for p in parts), default=0)
        branches = isinstance(node, _BRANCHES) + sum(p[2] for p in parts)
        if isinstance(node, _FUNCTIONS):
            lines = (node.end_lineno or node.lineno) - node.lineno + 1
            items.append((node.name, node.lineno, size, len(node.args.args), lines, deepest, 1 + branches))
            if len(node.args.args) > 5:
                notes.append((node.lineno, "WARNING", "SOUVERAINETE"))
        return size, deepest + (loop or isinstance(node, (ast.If, ast.With))), branches

    walk(ast.parse(text), (ast.Module(),), 0)
    return items, notes


def python_items(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per function of each Python source: path, item, line, kappa (syntax nodes), n_args, n_lines, max_depth, cyclomatic, fib_dist, notes of the file.

    A source that does not parse gives one row with a null item and the reason.
    """
    from orrery.functions.exprs import nearest_fibonacci

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, t in zip(pdf[path], pdf[text], strict=True):
                try:
                    items, notes = scan_source(t or "")
                    told = [f"{line}:{level}:{rule}" for line, level, rule in sorted(notes)]
                    out += [(p, *x, told, None) for x in items]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((p, None, None, None, None, None, None, None, [], type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "item", "line", "kappa", "n_args", "n_lines", "max_depth", "cyclomatic", "notes", "failed"]).astype({c: "Int64" for c in ("line", "kappa", "n_args", "n_lines", "max_depth", "cyclomatic")})

    rows = files.select(path, text).mapInPandas(run, "path string, item string, line long, kappa long, n_args long, n_lines long, max_depth long, cyclomatic long, notes array<string>, failed string")
    return rows.withColumn("fib_dist", F.abs(F.col("n_lines") - nearest_fibonacci("n_lines")) / PHI)


def python_totals(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """By source: path, n_classes, n_imports, n_lines, n_comments (lines), and notes as (line, level, rule); none of these for one that does not parse."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, t in zip(pdf[path], pdf[text], strict=True):
                lines = (t or "").splitlines()
                try:
                    nodes = list(ast.walk(ast.parse(t or "")))
                    _, notes = scan_source(t or "")
                except (SyntaxError, ValueError, RecursionError):
                    out.append((p, None, None, len(lines), None, []))
                    continue
                count = lambda *kinds: sum(isinstance(n, kinds) for n in nodes)
                told = [{"line": line, "level": level, "rule": rule} for line, level, rule in sorted(notes)]
                out.append((p, count(ast.ClassDef), count(ast.Import, ast.ImportFrom), len(lines), sum(x.lstrip().startswith("#") for x in lines), told))
            yield pd.DataFrame(out, columns=["path", "n_classes", "n_imports", "n_lines", "n_comments", "notes"]).astype({c: "Int64" for c in ("n_classes", "n_imports", "n_lines", "n_comments")})

    return files.select(path, text).mapInPandas(run, "path string, n_classes long, n_imports long, n_lines long, n_comments long, notes array<struct<line: long, level: string, rule: string>>")


def size_rule(items: DataFrame) -> DataFrame:
    """Functions of more than 55 lines that are more than 10 lines from a Fibonacci number."""
    from orrery.functions.exprs import nearest_fibonacci

    return items.where((F.col("n_lines") > 55) & (F.abs(F.col("n_lines") - nearest_fibonacci("n_lines")) > 10))


def kappas(spark: SparkSession, text: str) -> DataFrame:
    """Weights from a literal such as "10,10,1000"."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), r"\s*,\s*")).alias("ordinal", "k")).select("ordinal", F.col("k").cast("double").alias("kappa"))
