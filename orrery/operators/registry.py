"""Registries of hypotheses, obstructions and work items: resolution, probes, connections, checks.

Substring joins go through an equi-join on n-grams: a name of n characters or more occurs in a text only
where its first n characters do, so the join meets on those and then looks at the whole name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

GRAM = 4


def occurrences(texts: DataFrame, names: DataFrame, text: str, name: str, fold: bool = True) -> DataFrame:
    """Rows of texts joined with the names (of GRAM characters or more) that they contain; no cross join."""
    t, n = (F.lower(text), F.lower(name)) if fold else (F.col(text), F.col(name))
    grams = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))  # one pass over the text
    left = texts.withColumn("_g", F.explode(grams))
    right = names.where(F.length(name) >= GRAM).withColumn("_h", F.substring(n, 1, GRAM))
    return left.join(right, (F.col("_g") == F.col("_h")) & t.contains(n)).drop("_g", "_h").distinct()


def attached(obstructions: DataFrame, nodes: DataFrame, title: str, key: str, node: str) -> DataFrame:
    """(title, node, how): an obstruction's exact key first, else nodes whose name its title contains; unmatched ones stay with a null node."""
    exact = obstructions.join(nodes.select(node), F.col(key) == F.col(node)).select(title, node, F.lit("exact").alias("how"))
    rest = obstructions.join(exact.select(title).distinct(), title, "left_anti")
    inside = occurrences(rest.select(title), nodes.select(node), title, node).select(title, node, F.lit("contains").alias("how"))
    none = rest.select(title).join(inside.select(title).distinct(), title, "left_anti").select(title, F.lit(None).cast("string").alias(node), F.lit("none").alias("how"))
    return exact.unionByName(inside).unionByName(none)


def by_priority(candidates: list[DataFrame], name: str, target: str) -> DataFrame:
    """(name, target, level): for each name the targets of the first table that has any; of several the first in order."""
    rows = reduce(DataFrame.unionByName, [c.select(name, target, F.lit(k).alias("level")) for k, c in enumerate(candidates)])
    order = Window.partitionBy(name).orderBy("level", target)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def probe(hypotheses: DataFrame, holes: str, wanted: list, rank: Column, name: str) -> DataFrame:
    """Hypotheses whose holes meet the wanted ones, in order of rank and name."""
    return hypotheses.where(F.arrays_overlap(holes, F.array(*map(F.lit, wanted)))).withColumn("rank", rank).orderBy("rank", name)


def zone_counts(items: DataFrame, hole: str, zone: str, zones: list[str], holes: DataFrame | None = None) -> DataFrame:
    """Counts by zone for each hole; holes of the dimension without items have zeros."""
    out = items.groupBy(hole).pivot(zone, zones).agg(F.count(F.lit(1)))
    out = out if holes is None else holes.select(hole).distinct().join(out, hole, "left")
    return out.fillna(0, zones)


def connected(items: DataFrame, key: str, normal: str, head: str, tokens: str) -> DataFrame:
    """(a, b, why): pairs that share their normal form, else their head, else a token; a union of equi-joins, a < b."""

    def pairs(on: Column, why: int) -> DataFrame:
        side = items.select(key, on.alias("_v")).where("_v IS NOT NULL").distinct()
        return side.alias("s").join(side.alias("t"), (F.col("s._v") == F.col("t._v")) & (F.col(f"s.{key}") < F.col(f"t.{key}"))).select(F.col(f"s.{key}").alias("a"), F.col(f"t.{key}").alias("b"), F.lit(why).alias("why"))

    rows = pairs(F.col(normal), 0).unionByName(pairs(F.col(head), 1)).unionByName(pairs(F.explode(tokens), 2))
    names = F.array(F.lit("equal"), F.lit("head"), F.lit("token"))
    return rows.groupBy("a", "b").agg(F.min("why").alias("why")).withColumn("why", names[F.col("why")])


def unjustified(modules: DataFrame, entries: DataFrame, module: str, text: str, kind: str, vocabulary: list[str], least: int = 20) -> DataFrame:
    """(module, problem): modules without entry, entries without module, texts too short, kinds outside the vocabulary."""
    both = modules.select(module, F.lit(True).alias("_m")).join(entries.select(module, text, kind, F.lit(True).alias("_e")), module, "full_outer")
    problems = F.array_compact(F.array(
        F.when(F.col("_e").isNull(), "no entry"),
        F.when(F.col("_m").isNull(), "no module"),
        F.when(F.col("_e") & (F.length(F.trim(F.coalesce(text, F.lit("")))) < least), "text too short"),
        F.when(F.col("_e") & ~F.coalesce(F.col(kind).isin(vocabulary), F.lit(False)), "unknown kind"),
    ))
    return both.select(module, F.explode(problems).alias("problem"))


def spec_errors(specs: DataFrame, name: str, body: str, imports: str, required: list[str]) -> DataFrame:
    """Specifications with the array of their errors: missing fields, bad or repeated names, unbalanced brackets, holes, no import."""
    count = lambda c: F.length(body) - F.length(F.translate(F.col(body), c, ""))
    repeated = F.count("*").over(Window.partitionBy(name)) > 1
    checks = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), f"missing {c}") for c in required]
    checks += [F.when(~F.col(name).rlike(r"^[A-Za-z_][\w'.]*$"), "bad name"), F.when(repeated, "repeated name")]
    checks += [F.when(count(a) != count(b), f"unbalanced {a}{b}") for a, b in ("()", "[]", "{}")]
    checks += [F.when(F.col(body).rlike(r"\b(sorry|admit)\b"), "hole"), F.when(F.coalesce(F.size(imports), F.lit(0)) < 1, "no import")]
    return specs.withColumn("errors", F.array_compact(F.array(*checks)))


def orphan_quotes(lines: DataFrame, text: str) -> DataFrame:
    """Lines with an odd number of double quotes, escaped ones and comments aside."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r"#.*$", "")
    return lines.where((F.length(bare) - F.length(F.translate(bare, '"', ""))) % 2 == 1)


def stale(index: DataFrame, now: DataFrame, path: str = "path", modified: str = "modified") -> DataFrame:
    """(path, action): what an index by path and time must insert, refresh or delete."""
    a, b = index.select(path, F.col(modified).alias("_a")), now.select(path, F.col(modified).alias("_b"))
    both = a.join(b, path, "full_outer")
    action = F.when(F.col("_b").isNull(), "delete").when(F.col("_a").isNull(), "insert").when(F.col("_a") != F.col("_b"), "refresh")
    return both.select(path, action.alias("action")).where("action IS NOT NULL")


def attributed(profile: DataFrame, functions: DataFrame, short: str, qualified: str) -> DataFrame:
    """Measured short names joined to every qualified homonym; names without one stay with a null, marked."""
    named = functions.select(F.element_at(F.split(qualified, r"\."), -1).alias(short), qualified)
    return profile.join(named, short, "left").withColumn("known", F.col(qualified).isNotNull())


def ranked_mirrors(mirrors: DataFrame, latency: str, name: str) -> DataFrame:
    return mirrors.orderBy(F.col(latency).asc_nulls_last(), name)


def severity(checks: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """The worst of OK, DÉGRADÉ and EN PANNE by key."""
    order = F.array(F.lit("OK"), F.lit("DÉGRADÉ"), F.lit("EN PANNE"))
    return checks.groupBy(*keys).agg(F.max(F.array_position(order, F.col(verdict))).alias("_s")).select(*keys, F.element_at(order, F.greatest(F.lit(1), F.col("_s")).cast("int")).alias(verdict))
