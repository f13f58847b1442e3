"""What changed between two states: lost, gained, renamed, drifted; observations in order of salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.constants import SALIENCE


def keyed(symbols: DataFrame, file: str = "file", name: str = "name", line: str = "line") -> DataFrame:
    """The key of a symbol: file and name; later ones of a repeated name add their line."""
    order = F.row_number().over(Window.partitionBy(file, name).orderBy(line))
    return symbols.withColumn("key", F.when(order == 1, F.concat_ws("::", file, name)).otherwise(F.concat_ws("::", file, name, F.col(line).cast("string"))))


def snapshot(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One full outer join: change is lost, gained, changed or same; with values of both sides."""
    a = before.select(*keys, *[F.col(v).alias(f"before_{v}") for v in values], F.lit(True).alias("_a"))
    b = after.select(*keys, *[F.col(v).alias(f"after_{v}") for v in values], F.lit(True).alias("_b"))
    moved = F.lit(False)
    for v in values:
        moved |= ~F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    change = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "gained").when(moved, "changed").otherwise("same")
    return a.join(b, keys, "full_outer").withColumn("change", change).drop("_a", "_b")


def manifest_delta(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    both = snapshot(before, after, [path], [digest])
    return both.withColumn("change", F.when(F.col("change") == "gained", "added").when(F.col("change") == "lost", "removed").when(F.col("change") == "changed", "modified").otherwise("unchanged"))


def edges_changed(before: DataFrame, after: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Broken edges (with whether their source is gone from all edges) and new ones."""
    a, b = before.select(src, dst).distinct(), after.select(src, dst).distinct()
    alive = b.select(F.col(src).alias("_alive")).distinct()
    broken = a.join(b, [src, dst], "left_anti").join(alive, F.col(src) == F.col("_alive"), "left")
    broken = broken.select(src, dst, F.lit("broken").alias("change"), F.col("_alive").isNull().alias("source_gone"))
    return broken.unionByName(b.join(a, [src, dst], "left_anti").select(src, dst, F.lit("new").alias("change"), F.lit(False).alias("source_gone")))


def renames(lost: DataFrame, gained: DataFrame, file: str = "file", name: str = "name", line: str = "line", within: int = 10) -> DataFrame:
    """Probable renames: lost and gained names of one file within `within` lines, each used once, greedily in order of the lost line.

    The choice is sequential within a file; a file's lost and gained symbols are what one task holds.
    """
    a = lost.select(F.col(file).alias("file"), F.lit(0).alias("side"), F.col(name).alias("name"), F.col(line).cast("long").alias("line"))
    b = gained.select(F.col(file).alias("file"), F.lit(1).alias("side"), F.col(name).alias("name"), F.col(line).cast("long").alias("line"))

    def match(pdf):
        import pandas as pd

        old = sorted(pdf[pdf.side == 0][["name", "line"]].itertuples(index=False, name=None))
        new = sorted(pdf[pdf.side == 1][["line", "name"]].itertuples(index=False, name=None))
        used, out = set(), []
        for old_name, at in old:
            best = min(((abs(n - at), n, k) for k, (n, x) in enumerate(new) if k not in used and x != old_name and abs(n - at) <= within), default=None)
            if best:
                used.add(best[2])
                out.append((pdf.file.iloc[0], old_name, at, new[best[2]][1], best[1]))
        return pd.DataFrame(out, columns=["file", "old_name", "old_line", "new_name", "new_line"])

    return a.unionByName(b).groupBy("file").applyInPandas(match, "file string, old_name string, old_line long, new_name string, new_line long")


def drift(before: DataFrame, after: DataFrame, keys: list[str], value: str, top: int = 12, least: float = 1e-9) -> DataFrame:
    """The `top` largest changes of a value (a top-k report)."""
    both = before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), keys)
    moved = both.withColumn("delta", F.col("after") - F.col("before")).where(F.abs("delta") > least)
    return moved.orderBy(F.abs("delta").desc(), *keys).limit(top)


def snapshot_verdict(new_holes: Column, holes_in_new: Column, lost: Column, broken: Column, instrument: Column) -> Column:
    """A degraded instrument outweighs a degradation, which any of the four hard signals makes."""
    hard = (new_holes > 0) | (holes_in_new > 0) | (lost > 0) | (broken > 0)
    return F.when(instrument, "INSTRUMENT DÉGRADÉ").when(hard, "DÉGRADATION DÉTECTÉE").otherwise("STABLE")


def observations(before: DataFrame, after: DataFrame) -> DataFrame:
    """The detectors over states (file, name, line, h_statement, h_body, n_body_lines, hole, is_axiom): kind, file, name, line, salience.

    One full outer join and an array of the detectors that fire; duplicates (a name in two files or
    more afterwards) come from an aggregation. In order of salience, kind and name.
    """
    names = ["line", "h_statement", "h_body", "n_body_lines", "hole", "is_axiom"]
    a = before.select("file", "name", *[F.col(c).alias(f"a_{c}") for c in names], F.lit(True).alias("_a"))
    b = after.select("file", "name", *[F.col(c).alias(f"b_{c}") for c in names], F.lit(True).alias("_b"))
    both = a.join(b, ["file", "name"], "full_outer")
    c = F.col
    common, new, gone = c("_a") & c("_b"), c("_a").isNull(), c("_b").isNull()
    stated = c("a_h_statement") != c("b_h_statement")
    kinds = [
        (common & stated, "enonce_change"),
        (common & stated & (c("a_n_body_lines") >= 5) & (c("b_n_body_lines") <= 2), "effondrement_preuve"),
        (common & ~stated & (c("a_h_body") != c("b_h_body")), "corps_change"),
        ((common & c("b_hole") & ~c("a_hole")) | (new & ~c("b_is_axiom") & c("b_hole")), "nouveau_sorry"),
        (new & c("b_is_axiom"), "nouvel_axiome"),
        (new & ~c("b_is_axiom") & ~c("b_hole"), "symbole_gagne"),
        (gone, "symbole_perdu"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for x, k in kinds]))
    single = both.select(F.explode(found).alias("kind"), "file", "name", F.coalesce("b_line", "a_line").cast("long").alias("line"))
    double = after.groupBy("name").agg(F.count_distinct("file").alias("n"), F.array_join(F.sort_array(F.collect_set("file")), ", ").alias("file"), F.min("line").cast("long").alias("line")).where("n >= 2")
    rows = single.unionByName(double.select(F.lit("doublon").alias("kind"), "file", "name", "line"))
    weight = F.create_map(*[F.lit(x) for kv in SALIENCE.items() for x in kv])
    return rows.withColumn("salience", weight[c("kind")]).orderBy(F.desc("salience"), "kind", "name", "file")
