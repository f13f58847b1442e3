"""Graphs as edge tables (src uses dst): degrees, reach, levels, routes, ranks and diffusion.

Loops are driver loops of joins over tables in the shared folder, bounded by a number of rounds and
ended by an empty frontier; what comes to the driver is whether a frontier is empty.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; only a local session that has none set gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the folder of spark.checkpoint.dir, which cuts lineage."""
    path = folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def first_edges(edges: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One edge per (src, dst), of the first type by priority; no edges to itself."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("type")], F.lit(len(priority)))
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min_by(F.struct("type", "weight"), F.struct(rank, "type")).alias("e")).select("src", "dst", "e.type", "e.weight")


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_out, fan_in over distinct edges."""
    e = edges.select("src", "dst").distinct()
    sides = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return sides.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def density(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges and edges over nodes squared: one row."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("v")).union(e.select("dst")).agg(F.count_distinct("v").alias("n_nodes"))
    return e.agg(F.count("*").alias("n_edges")).crossJoin(nodes).withColumn("density", F.col("n_edges") / (F.col("n_nodes") * F.col("n_nodes")))


def coupling(edges: DataFrame, group: DataFrame, node: str, by: str) -> DataFrame:
    """Ca, Ce and instability Ce / (Ca + Ce) of groups: distinct groups outside that use it, or that it uses."""
    g = group.select(F.col(node).alias("_n"), F.col(by).alias("_g"))
    pairs = edges.select("src", "dst").distinct().join(g.withColumnRenamed("_g", "a"), F.col("src") == F.col("_n")).drop("_n").join(g.withColumnRenamed("_g", "b"), F.col("dst") == F.col("_n")).select("a", "b").where("a <> b").distinct()
    sides = pairs.select(F.col("a").alias("grp"), F.lit(0).alias("ca"), F.lit(1).alias("ce")).union(pairs.select("b", F.lit(1), F.lit(0)))
    return sides.groupBy("grp").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce")).withColumn("instability", F.col("ce") / (F.col("ca") + F.col("ce")))


def reach(edges: DataFrame, sources: DataFrame, depth: int | None = 10, backward: bool = False) -> DataFrame:
    """(origin, node, depth, path) of nodes reached from each source within `depth` steps (None: as far as it goes), the source left out.

    Level by level: the frontier is joined to the edges, nodes seen before are dropped by an anti join, and
    of equally short paths the first in order is kept. `truncated` says that the bound cut the search.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = _kept(edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).where("_from <> _to").distinct(), "edges")
    start = sources.select(F.col(sources.columns[0]).alias("origin")).distinct()
    frontier = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"), F.array(F.col("origin").cast("string")).alias("path"))
    seen = frontier
    levels: list[DataFrame] = []
    for k in itertools.count(1):
        step = frontier.join(e, F.col("node") == F.col("_from")).select("origin", F.col("_to").alias("node"), F.lit(k).alias("depth"), F.concat("path", F.array(F.col("_to").cast("string"))).alias("path"))
        step = step.groupBy("origin", "node").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        step = _kept(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti"), "level")
        if step.isEmpty():
            step = None
            break
        if depth is not None and k > depth:
            break
        levels.append(step)
        seen = seen.unionByName(step)
        frontier = step
    out = levels[0] if levels else frontier.where("false")
    for level in levels[1:]:
        out = out.unionByName(level)
    cut = start.select("origin", F.lit(False).alias("truncated")) if step is None else start.join(step.select("origin").distinct().withColumn("_cut", F.lit(True)), "origin", "left").select("origin", F.coalesce("_cut", F.lit(False)).alias("truncated"))
    return out.join(cut, "origin")


def levels(edges: DataFrame, nodes: DataFrame | None = None, most: int | None = None, acyclic: bool = False) -> DataFrame:
    """(node, level) by peeling nodes without incoming edges; nodes on or behind a cycle get level null, or raise where the graph must be `acyclic`.

    It ends when no free node is left; with more than `most` levels, where that is given, it raises.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    left = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct() if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    out = None
    left = _kept(left, "left")
    for k in itertools.count():
        free = _kept(left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(k)), "free")
        if free.isEmpty():
            break
        if k == most:
            raise ValueError("the graph has more levels than the bound")
        out = free if out is None else out.unionByName(free)
        left = _kept(left.join(free.select("node"), "node", "left_anti"), "left")
        e = _kept(e.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "edges")
    if acyclic and not left.isEmpty():
        raise ValueError(f"the graph has a cycle: {sorted(str(r[0]) for r in left.limit(10).collect())}")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def routes(edges: DataFrame, sources: DataFrame, forbidden: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(node, routes): exact counts of routes from the sources, by levels, as decimal(38, 0); more digits raise. A cycle raises."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    if forbidden is not None:
        gone = forbidden.select(F.col(forbidden.columns[0]).alias("_x"))
        e = e.join(gone, F.col("src") == F.col("_x"), "left_anti").join(gone, F.col("dst") == F.col("_x"), "left_anti")
    e = _kept(e, "edges")
    now = sources.select(F.col(sources.columns[0]).alias("node"), F.lit(1).cast("decimal(38,0)").alias("routes"))
    total = now
    for _ in range(most):
        step = now.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum("routes").cast("decimal(38,0)").alias("routes"))
        now = _kept(step.select(F.col("dst").alias("node"), "routes"), "routes")
        if now.isEmpty():
            return total.groupBy("node").agg(F.sum("routes").cast("decimal(38,0)").alias("routes"))
        total = total.unionByName(now)
    raise ValueError("the graph has a cycle or a route longer than the bound")


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int | None = None, keep_every: int = 5, tol: float = 1e-8, most: int = 200) -> DataFrame:
    """(node, rank); ranks flow along edges, and what ends at nodes without edges is spread evenly.

    Rounds go on until the ranks' absolute changes sum to less than `tol`, `most` at most; or `rounds` of them without that test.
    """
    e = edges.select("src", "dst").distinct()
    e = _kept(e.join(e.groupBy("src").agg(F.count("*").alias("_out")), "src"), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    sinks = nodes.join(e.select(F.col("src").alias("node")).distinct().withColumn("_has", F.lit(True)), "node", "left").select("node", F.col("_has").isNull().alias("sink"))
    sinks = _kept(sinks, "nodes")
    n = sinks.count()
    ranks = sinks.select("node", "sink", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(most if rounds is None else rounds):
        lost = F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank")).otherwise(0.0)), F.lit(0.0))
        spread = ranks.agg(lost.alias("_lost"))  # one row
        got = ranks.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        before, ranks = ranks, sinks.join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(spread)).select("node", "sink", ((1 - alpha) / n + alpha * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / n)).alias("rank"))
        if rounds is None or (k + 1) % keep_every == 0:
            ranks = _kept(ranks, "ranks")
        if rounds is None:
            change = ranks.join(before.select("node", F.col("rank").alias("_before")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_before")))).first()[0]
            if (change or 0.0) < tol:
                break
    return ranks.select("node", "rank")


def diffuse(edges: DataFrame, alpha: float = 0.5, steps: int = 8, keep_every: int = 4) -> DataFrame:
    """(node, density): starts from in-degrees; each step f becomes (1 - alpha) f + alpha mean of f over successors, sinks stay."""
    e = _kept(edges.select("src", "dst").distinct(), "edges")
    density_ = degrees(e).select("node", F.col("fan_in").cast("double").alias("f"))
    for k in range(steps):
        mean = e.join(density_.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.avg("f").alias("m"))
        density_ = density_.join(mean, F.col("node") == F.col("src"), "left").select("node", F.coalesce((1 - alpha) * F.col("f") + alpha * F.col("m"), F.col("f")).alias("f"))
        if (k + 1) % keep_every == 0:
            density_ = _kept(density_, "density")
    return density_.withColumnRenamed("f", "density")


def matvec(edges: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """(src, value): sums of the values of distinct successors."""
    v = values.select(F.col(node).alias("dst"), F.col(value).alias("_v"))
    return edges.select("src", "dst").distinct().join(v, "dst").groupBy("src").agg(F.sum("_v").alias(value))


def unused(nodes: DataFrame, edges: DataFrame, node: str, reasons: dict | None = None) -> DataFrame:
    """Nodes that no edge leads to, with the first reason (name -> condition) that excuses them."""
    why = F.lit(None).cast("string")
    for name, condition in reversed(list((reasons or {}).items())):
        why = F.when(condition, F.lit(name)).otherwise(why)
    used = edges.select(F.col("dst").alias("_used")).distinct()
    return nodes.join(used, F.col(node) == F.col("_used"), "left_anti").withColumn("reason", why)


def layered_count(sizes: DataFrame, size: str) -> DataFrame:
    """Routes through complete layers: the exact product of their sizes as text digits are bounded to 38."""
    product = F.aggregate(F.collect_list(F.col(size).cast("decimal(38,0)")), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    return sizes.agg(product.alias("routes"))


def resolved(names: DataFrame, candidates: list[tuple[DataFrame, str]], name: str) -> DataFrame:
    """For each name its match in the first candidate table that has it: (name, target, level), level null when none has."""
    out = names.select(name).distinct()
    union = None
    for k, (table, target) in enumerate(candidates):
        part = table.groupBy(name).agg(F.min(target).cast("string").alias("target")).withColumn("level", F.lit(k))
        union = part if union is None else union.unionByName(part)
    first = F.row_number().over(Window.partitionBy(name).orderBy("level"))
    best = union.withColumn("_r", first).where("_r = 1").drop("_r")
    return out.join(best, name, "left")


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def closure(edges: DataFrame, backward: bool = False) -> DataFrame:
    """(origin, node) of everything that each node reaches, in as many steps as it takes, itself left out; path doubling, so rounds grow with the logarithm of the longest path."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    known = _kept(edges.select(F.col(a).alias("origin"), F.col(b).alias("node")).where("origin <> node").distinct(), "closure")
    n = known.count()
    while True:
        longer = known.join(known.select(F.col("origin").alias("node"), F.col("node").alias("_to")), "node").select("origin", F.col("_to").alias("node")).where("origin <> node")
        known = _kept(known.union(longer).distinct(), "closure")
        before, n = n, known.count()
        if n == before:
            return known


def cascade(edges: DataFrame, modified: DataFrame) -> DataFrame:
    """(node, why): the modified nodes, and all that depends on them directly or not."""
    changed = modified.select(F.col(modified.columns[0]).alias("node")).distinct()
    behind = reach(edges, changed, None, backward=True).select("node").distinct().join(changed, "node", "left_anti")
    return changed.withColumn("why", F.lit("modified")).unionByName(behind.withColumn("why", F.lit("dependant")))


def dependency_order(edges: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, place, node): what each wanted node needs among known ones, in an order that puts needs first; alphabetical where there is a cycle."""
    names = known.select(F.col(known.columns[0]).alias("node")).distinct()
    need = reach(edges, wanted, None).select("origin", "node").join(names, "node", "left_semi")
    need = _kept(need.union(wanted.select(F.col(wanted.columns[0]).alias("node"), F.col(wanted.columns[0]).alias("origin"))).select("origin", "node").distinct(), "need")
    pair = lambda c: F.concat_ws("\x00", "origin", c)
    inside = need.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node").join(need.select("origin", F.col("node").alias("dst")), ["origin", "dst"])
    at = levels(inside.select(pair("dst").alias("src"), pair("node").alias("dst")), need.select(pair("node").alias("node")))
    at = at.select(F.split("node", "\x00")[0].alias("origin"), F.split("node", "\x00")[1].alias("node"), "level")
    cyclic = F.max(F.col("level").isNull()).over(Window.partitionBy("origin"))
    return at.withColumn("_c", cyclic).select(F.col("origin").alias("name"), F.row_number().over(Window.partitionBy("origin").orderBy(F.when(F.col("_c"), 0).otherwise(F.col("level")), "node")).alias("place"), "node")


def routes_without(layers: DataFrame, layer: str, node: str, removable: Column) -> DataFrame:
    """(node, routes, delta): routes through complete layers when one removable node is left out; exact, as decimal(38, 0).

    Routes are the product of the layers' sizes; without a node its layer is one smaller. A layer that is left empty parts the graph:
    routes through the layers before it and routes through those after it are both counted.
    """
    sizes = layers.groupBy(layer).agg(F.count_distinct(node).cast("decimal(38,0)").alias("_n"))
    product = lambda xs: F.aggregate(xs, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    all_ = sizes.agg(F.collect_list(F.struct(F.col(layer).alias("l"), F.col("_n").alias("n"))).alias("_all"))  # one row, an entry per layer
    rows = layers.where(removable).select(layer, node).distinct().crossJoin(F.broadcast(all_))
    own = F.filter("_all", lambda s: s["l"] == F.col(layer))[0]["n"]

    def side(which) -> Column:
        some = F.filter("_all", which)
        return F.when(F.size(some) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(product(F.transform(some, lambda s: s["n"])))

    smaller = product(F.transform("_all", lambda s: F.when(s["l"] == F.col(layer), s["n"] - 1).otherwise(s["n"]).cast("decimal(38,0)")))
    parted = (side(lambda s: s["l"] < F.col(layer)) + side(lambda s: s["l"] > F.col(layer))).cast("decimal(38,0)")
    after = F.when(own > 1, smaller).otherwise(parted)
    before = product(F.transform("_all", lambda s: s["n"]))
    return rows.select(node, after.alias("routes"), (after - before).cast("decimal(38,0)").alias("delta"))


def golden_routes(frame: DataFrame, k: str) -> DataFrame:
    """routes: binary routes of length k without two ones in a row, the Fibonacci number k + 2, exact up to 38 digits; a negative length raises."""
    pair = F.struct(F.lit(1).cast("decimal(38,0)").alias("a"), F.lit(1).cast("decimal(38,0)").alias("b"))
    steps = F.sequence(F.lit(0), F.greatest(F.col(k), F.lit(0)).cast("int"))
    found = F.aggregate(steps, pair, lambda p, i: F.when(i == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] + p["b"]).cast("decimal(38,0)").alias("b"))))
    return frame.withColumn("routes", F.when(F.col(k) < 0, F.raise_error(F.lit("a length is negative")).cast("decimal(38,0)")).otherwise(found["b"]))
