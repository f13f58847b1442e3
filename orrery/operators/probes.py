"""Probes of a registry of hypotheses: zones, routes, obstructions, verdicts in titles, dossiers, ledgers by mechanism, and checks of state.

Mechanisms are rows, and a probe of many mechanisms is one join on the holes that they share with hypotheses and obstructions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.constants import PHI_INV
from orrery.operators.ledger import entropy_of

# fixed values
STATUSES = ["DÉMONTRÉ", "CONDITIONNEL", "ÉVIDENCE", "EN-COURS", "CONJECTURAL", "RÉFUTÉ", "ÉLIMINÉ", "ARCHIVÉ", "NOMMÉ", "POINTEUR", "PARAMÈTRE"]
NORMAL = {
    "DÉMONTRÉE": "DÉMONTRÉ", "DÉMONTRÉES": "DÉMONTRÉ", "CONDITIONNELLE": "CONDITIONNEL", "CONDITIONNELLES": "CONDITIONNEL", "NOMMÉE": "NOMMÉ", "NOMMÉES": "NOMMÉ", "RÉFUTÉE": "RÉFUTÉ", "RÉFUTÉES": "RÉFUTÉ",
    "ÉLIMINÉE": "ÉLIMINÉ", "ÉLIMINÉES": "ÉLIMINÉ", "ARCHIVÉE": "ARCHIVÉ", "PROUVÉE": "DÉMONTRÉ", "PROUVÉ": "DÉMONTRÉ", "LEVÉE": "ÉLIMINÉ",
}
LIFTED = ["DÉMONTRÉ", "ÉLIMINÉ"]
LEAST_REASON = 10


def normal_status(text: Column | str) -> Column:
    """The first status among a text's words in capitals, in its canonical form; an empty string where there is none."""
    table = F.create_map(*[F.lit(x) for kv in {**{s: s for s in STATUSES}, **NORMAL}.items() for x in kv])
    words = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("([A-ZÀ-Þ-]+)"), 1)
    return F.coalesce(F.get(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda s: s.isNotNull()), F.lit(0)), F.lit(""))


def status_after_arrow(cell: str) -> Column:
    """The latest status of a cell: the one after its last arrow."""
    return normal_status(F.element_at(F.split(cell, "→"), -1))


def zone(status: str, source: str, worksites: str) -> Column:
    s = F.col(status)
    named = F.when(F.col(source).startswith("journal §12"), "NON-ATTAQUÉ").when((F.size(worksites) == 0) & F.col(source).isin("table §1", "faisabilité §4"), "NON-ATTAQUÉ").otherwise("CONDITIONNEL")
    return (
        F.when(s == "DÉMONTRÉ", "DÉMONTRÉ").when(s.isin("RÉFUTÉ", "ÉLIMINÉ"), "RÉFUTÉ").when(s == "NON-ATTAQUÉ", "NON-ATTAQUÉ").when(s == "CONDITIONNEL", "CONDITIONNEL")
        .when((s == "NOMMÉ") | s.startswith("NOMMÉ "), named).when(s.isin("EN-COURS", "CONJECTURAL", "ÉVIDENCE"), "CONDITIONNEL").otherwise(s)
    )


def _meeting(mechanisms: DataFrame, items: DataFrame, holes: str) -> DataFrame:
    """(mechanism, item columns) for items that share a hole with a mechanism, each once; the mechanism itself is left out."""
    m = mechanisms.select("mechanism", F.explode(holes).alias("_h")).distinct()
    rows = items.select(F.struct(*items.columns).alias("_i"), F.explode(F.array_distinct(holes)).alias("_h"))
    return m.join(rows, "_h").select("mechanism", "_i").distinct().select("mechanism", "_i.*")


def probe_route(mechanisms: DataFrame, hypotheses: DataFrame, rank: str = "rank", name: str = "name", holes: str = "holes", status: str = "status", source: str = "source", worksites: str = "worksites") -> DataFrame:
    """The route of each mechanism: hypotheses that serve a hole of its own, with place by (rank, name), lifted, and zone; not lifted ones are the distance, those of zone NON-ATTAQUÉ the unexplored ground."""
    rows = _meeting(mechanisms, hypotheses, holes).where(F.lower(name) != F.lower("mechanism"))
    rows = rows.withColumns({"lifted": F.col(status).isin(LIFTED), "zone": zone(status, source, worksites)})
    rows = rows.withColumn("unexplored", ~F.col("lifted") & (F.col("zone") == "NON-ATTAQUÉ"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("mechanism").orderBy(rank, name)))


def pertinent(found: DataFrame, known: DataFrame, identifier: str = "identifier", excluded: tuple = ("sSup", "sorryAx", "sorry", "axioms")) -> DataFrame:
    """Harvested identifiers that count: known ones, those that name a hypothesis, conjecture, assumption or data, and those found twice or more; each once with n."""
    rows = found.where(~F.col(identifier).isin(*excluded)).groupBy(identifier).agg(F.count("*").alias("n"))
    rows = rows.join(known.select(F.col(known.columns[0]).alias(identifier)).distinct().withColumn("_k", F.lit(True)), identifier, "left")
    return rows.where(F.col("_k") | F.col(identifier).rlike("Hypothes|Conjecture|Assumption") | F.col(identifier).endswith("Data") | (F.col("n") >= 2)).select(identifier, "n")


def probe_obstructions(mechanisms: DataFrame, obstructions: DataFrame, holes: str = "holes", title: str = "title") -> DataFrame:
    """(mechanism, obstruction columns, how): obstructions that share a hole, and those whose title holds the mechanism's name."""
    from orrery.operators.registry import occurrences

    shared = _meeting(mechanisms, obstructions, holes).withColumn("how", F.lit("hole"))
    named = occurrences(obstructions, mechanisms.select("mechanism"), title, "mechanism", fold=False).select("mechanism", *obstructions.columns)
    rest = named.join(shared.select("mechanism", title), ["mechanism", title], "left_anti").withColumn("how", F.lit("title"))
    return shared.unionByName(rest)


def refutations(entries: DataFrame, body: str = "body", worksite: str = "worksite") -> DataFrame:
    """(worksite, identifier, status): identifiers whose own verdict, attached by colon, dash or comma, is RÉFUTÉ or ÉLIMINÉ."""
    pattern = F.lit("(`[^`]{3,80}?`\\s*[:—–,-]\\s*\\*{0,2}[A-ZÀ-Þ][A-ZÀ-Þ-]*)")
    rows = entries.select(worksite, F.explode(F.regexp_extract_all(body, pattern, 1)).alias("_p"))
    out = rows.select(worksite, F.trim(F.regexp_extract("_p", "`([^`]+)`", 1)).alias("identifier"), normal_status(F.regexp_replace("_p", "^`[^`]+`", "")).alias("status"))
    return out.where(F.col("status").isin("RÉFUTÉ", "ÉLIMINÉ")).distinct()


def versions(obstructions: DataFrame, title: str = "title") -> DataFrame:
    """(title, version, status) of `version X STATUS` in titles; X in lower case, and X without a known status gives nothing."""
    found = F.regexp_extract_all(title, F.lit("((?i)version\\s+[a-zà-ÿ]+\\s+[A-ZÀ-Þ][A-ZÀ-Þ-]*)"), 1)
    rows = obstructions.select(title, F.explode(found).alias("_v"))
    words = F.split("_v", "\\s+")
    return rows.select(title, F.lower(words[1]).alias("version"), normal_status(words[2]).alias("status")).where("status <> ''")


def verdict_scope(obstructions: DataFrame, route: DataFrame, title: str = "title", name: str = "name") -> DataFrame:
    """(mechanism, title, node, scope): where a double verdict belongs: to the mechanism, to nodes of its route that its title names (H-numbers and names in back quotes), else off the route."""
    keys = F.array_distinct(F.concat(F.regexp_extract_all(title, F.lit("(?<![A-Za-z0-9_])(H\\d+[a-z]?)(?![A-Za-z0-9_])"), 1), F.transform(F.regexp_extract_all(title, F.lit("`([^`]+)`"), 1), lambda x: F.trim(x))))
    rows = obstructions.select("mechanism", title, F.explode(keys).alias("_k"))
    k, m = F.lower("_k"), F.lower("mechanism")
    own = rows.where((F.length("_k") >= 4) & (k.contains(m) | m.contains(k))).select("mechanism", title, F.col("mechanism").alias("node"), F.lit("mecanisme").alias("scope"))
    named = route.select("mechanism", F.col(name).alias("node"), F.lower(name).alias("_l"))
    nodes = rows.withColumn("_l", k).join(named, ["mechanism", "_l"]).select("mechanism", title, "node", F.lit("noeud").alias("scope"))
    placed = own.union(nodes).distinct()
    off = rows.select("mechanism", title).distinct().join(placed.select("mechanism", title), ["mechanism", title], "left_anti").select("mechanism", title, F.lit("").alias("node"), F.lit("hors_route").alias("scope"))
    return placed.union(off)


def same_parse(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: counts and order-free hashes of two independent passes, and whether they agree."""
    side = lambda f, t: f.agg(F.count("*").alias(f"n_{t}"), F.coalesce(F.sum(F.pmod(F.xxhash64(*sorted(f.columns)), F.lit(1 << 31)).cast("decimal(38,0)")), F.lit(0)).alias(f"_{t}"))
    both = side(first, "first").crossJoin(side(second, "second"))  # one row each
    return both.select("n_first", "n_second", ((F.col("n_first") == F.col("n_second")) & (F.col("_first") == F.col("_second"))).alias("agree"))


def ledgers(route: DataFrame, kills: DataFrame, weight: str = "weight", name: str = "name", step: str = "step") -> DataFrame:
    """(mechanism, step, killed, entropy, gain): a ledger for each mechanism, step null for the start. Nodes of equal name count once.

    A node dies at its mechanism's first kill of it; sums of what lives after a step are suffix sums over the mechanism's steps.
    """
    w = F.col(weight).cast("double")
    masses = route.groupBy("mechanism", name).agg(F.max(w).alias("_w")).where("_w > 0")
    death = kills.groupBy("mechanism", name).agg(F.min(step).cast("long").alias("_t"))
    by = masses.join(death, ["mechanism", name], "left").groupBy("mechanism", "_t").agg(F.sum("_w").alias("m"), F.sum(F.col("_w") * F.log2("_w")).alias("x"), F.count("*").alias("killed"))
    steps = kills.select("mechanism", F.col(step).cast("long").alias("_t")).distinct()
    none = steps.select("mechanism", "_t", F.lit(0.0).alias("m"), F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("killed"))
    rows = by.unionByName(none).groupBy("mechanism", "_t").agg(*[F.sum(c).alias(c) for c in ("m", "x", "killed")])
    later = Window.partitionBy("mechanism").orderBy(F.col("_t").asc_nulls_last()).rowsBetween(1, Window.unboundedFollowing)
    after = rows.select("mechanism", "_t", "killed", entropy_of(F.coalesce(F.sum("m").over(later), F.lit(0.0)), F.coalesce(F.sum("x").over(later), F.lit(0.0))).alias("entropy")).where("_t IS NOT NULL")
    start = rows.groupBy("mechanism").agg(F.sum("m").alias("m"), F.sum("x").alias("x")).select("mechanism", F.lit(None).cast("long").alias("_t"), F.lit(0).cast("long").alias("killed"), entropy_of(F.col("m"), F.col("x")).alias("entropy"))
    before = F.lag("entropy").over(Window.partitionBy("mechanism").orderBy(F.col("_t").asc_nulls_first()))
    return start.unionByName(after).select("mechanism", F.col("_t").alias("step"), "killed", "entropy", F.coalesce(before - F.col("entropy"), F.lit(0.0)).alias("gain"))


def collapse_costs(route: DataFrame, weight: str = "weight", zone_: str = "zone", name: str = "name", positive: tuple = ("DÉMONTRÉ", "CONDITIONNEL")) -> DataFrame:
    """(mechanism, cost, ratio): entropy over zones less entropy over the two sides that `positive` makes, and its ratio to 1 - H(PHI_INV)."""
    import math

    h = -(PHI_INV * math.log2(PHI_INV) + (1 - PHI_INV) * math.log2(1 - PHI_INV))
    masses = route.groupBy("mechanism", name, zone_).agg(F.max(F.col(weight).cast("double")).alias("_w")).groupBy("mechanism", zone_).agg(F.sum("_w").alias("m")).where("m > 0")
    sides = masses.groupBy("mechanism", F.col(zone_).isin(*positive).alias("_p")).agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.log2("m")).alias("x"))
    out = sides.groupBy("mechanism").agg(F.sum("s").alias("t"), F.sum("x").alias("x"), F.sum(F.col("s") * F.log2("s")).alias("y"))
    cost = (F.col("y") - F.col("x")) / F.col("t")
    return out.select("mechanism", cost.alias("cost"), (cost / (1 - h)).alias("ratio"))


def attention(route: DataFrame, kills: DataFrame, obstructions: DataFrame, weight: str = "weight", name: str = "name", zone_: str = "zone") -> DataFrame:
    """The attention list: mechanisms by cost of collapse, then by entropy taken, then by name, with their numbers of nodes and obstructions."""
    books = ledgers(route, kills, weight, name).groupBy("mechanism").agg(F.max(F.when(F.col("step").isNull(), F.col("entropy"))).alias("h_first"), F.min_by("entropy", F.coalesce(-F.col("step"), F.lit(1 << 60))).alias("h_last"))
    n = route.groupBy("mechanism").agg(F.count_distinct(name).alias("n_nodes"))
    o = obstructions.groupBy("mechanism").agg(F.count("*").alias("n_obstructions"))
    rows = n.join(books, "mechanism", "left").join(collapse_costs(route, weight, zone_, name), "mechanism", "left").join(o, "mechanism", "left")
    rows = rows.select("mechanism", "n_nodes", F.coalesce("n_obstructions", F.lit(0)).alias("n_obstructions"), F.coalesce(F.col("h_first") - F.col("h_last"), F.lit(0.0)).alias("gain"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    return rows.orderBy(F.round("cost", 9).desc(), F.round("gain", 9).desc(), "mechanism")


def explorer(route: DataFrame, name: str = "name", zone_: str = "zone", rank: str = "rank") -> DataFrame:
    """(mechanism, name, band, x, y, next): grid places by band of rank, and the chain of the route; y is the place in the band."""
    order = Window.partitionBy("mechanism").orderBy(rank, name)
    return route.select("mechanism", name, F.col(rank).alias("band"), F.col(zone_).alias("zone"), (F.dense_rank().over(Window.partitionBy("mechanism").orderBy(rank)) - 1).alias("x"), (F.row_number().over(Window.partitionBy("mechanism", rank).orderBy(name)) - 1).alias("y"), F.lead(name).over(order).alias("next"))


def dossier(holes: DataFrame, dependants: DataFrame, hypotheses: DataFrame, name: str = "name") -> DataFrame:
    """(name, found, n_occurrences, n_dependants, work): of each asked hole its occurrences (name, file, hole), dependants by file, and work items, each once by (item, place)."""
    seen = holes.where("file IS NOT NULL").groupBy(name).agg(F.count("*").alias("n_occurrences"), F.max("hole").alias("hole"))
    after = holes.select(name, "file").distinct().join(dependants, "file").groupBy(name).agg(F.count_distinct("dependant").alias("n_dependants"))
    work = hypotheses.select(F.explode("holes").alias("hole"), F.col("item"), F.col("place")).distinct().groupBy("hole").agg(F.count("*").alias("work"))
    out = holes.select(name).distinct().join(seen, name, "left").join(after, name, "left").join(work, "hole", "left")
    return out.select(name, F.when(F.col("n_occurrences").isNull(), "INTROUVABLE").otherwise("TROUVÉ").alias("found"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_occurrences", "n_dependants", "work")])


def blind_spots(frame: DataFrame, n: str = "n") -> DataFrame:
    """The nine blind spots of a profile of n items, a row each: id and status."""
    always = {"C1": "NON_COUVERT", "C2": "NON_COUVERT", "C4": "NON_COUVERT", "C5": "NON_COUVERT", "C6": "NON_COUVERT", "C8": "NON_COUVERT", "C9": "COUVERT"}
    rows = [F.struct(F.lit(k).alias("id"), F.lit(v).alias("status")) for k, v in always.items()]
    rows += [F.struct(F.lit("C3").alias("id"), F.when(F.col(n) >= 5, "PARTIEL").otherwise("NON_COUVERT").alias("status")), F.struct(F.lit("C7").alias("id"), F.when(F.col(n) >= 3, "COUVERT").otherwise("DÉGRADÉ").alias("status"))]
    return frame.select("*", F.explode(F.array(*rows)).alias("_b")).select(*frame.columns, "_b.id", "_b.status")


def vetoes(decisions: DataFrame, reason: str = "reason", name: str = "name") -> DataFrame:
    """Decisions with valid: a reason of LEAST_REASON characters, blanks around aside, and a named observation."""
    return decisions.withColumn("valid", (F.length(F.trim(F.coalesce(reason, F.lit("")))) >= LEAST_REASON) & F.col(name).isNotNull())


def prescriptive(texts: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Texts that hold one of the forbidden words, case aside, with the first of them in order of the list."""
    low = F.lower(text)
    return texts.withColumn("word", F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words])).where("word IS NOT NULL")


def chained(state: DataFrame, orphan: Column, live: Column, again: list[str], note: str = "chained") -> DataFrame:
    """A frozen mission's items go on: where the mission is an orphan without a live process, items of the statuses `again` become A-REPRENDRE with a note."""
    go = orphan & ~live & F.col("status").isin(*again)
    return state.withColumns({"note": F.when(go, F.concat_ws(" | ", F.when(F.col("note") != "", F.col("note")), F.lit(note))).otherwise(F.col("note")), "status": F.when(go, "A-REPRENDRE").otherwise(F.col("status"))})


def footprints(log: DataFrame, agent: str = "agent", ts: str = "t", kind: str = "type", failed: tuple = ("exception",)) -> DataFrame:
    """One row per agent with a failure: its time, and the last call and the last result before it."""
    rows = log.withColumn("_f", F.max(F.when(F.col(kind).isin(*failed), F.col(ts))).over(Window.partitionBy(agent))).where(F.col("_f").isNotNull() & (F.col(ts) <= F.col("_f")))
    last = lambda k: F.max_by(F.when(F.col(kind) == k, F.col("msg")), F.when(F.col(kind) == k, F.col(ts)))
    return rows.groupBy(agent).agg(F.max("_f").alias("failed_at"), last("appel").alias("last_call"), last("resultat").alias("last_result"))


def without_log(footprints_: DataFrame, log: DataFrame, agent: str = "agent") -> DataFrame:
    """Agents that left a footprint and have no entry in the log."""
    return footprints_.select(agent).distinct().join(log.select(agent).distinct(), agent, "left_anti")


def perimeter(covered: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """(path, side): files that a snapshot lacks (missing), and those that it has and are gone (orphan)."""
    a, b = covered.select(path).distinct(), present.select(path).distinct()
    return b.join(a, path, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, path, "left_anti").withColumn("side", F.lit("orphan")))


def stale_versions(files: DataFrame, version: str, path: str = "path", text: str = "text") -> DataFrame:
    """(path, told): versions `(vX.Y.Z` in a source's first string that differ from the given one."""
    head = F.regexp_extract(text, '(?s)^\\s*(?:#[^\\n]*\\n\\s*)*(?:"""(.*?)"""|\'\'\'(.*?)\'\'\')', 0)
    return files.select(path, F.explode(F.regexp_extract_all(head, F.lit(r"\(v(\d+\.\d+\.\d+)"), 1)).alias("told")).where(F.col("told") != version)


def instrument_health(reference: DataFrame, now: DataFrame, path: str = "path") -> DataFrame:
    """(extension, n_files): extensions that the reference state has and that nothing analyses now; none is health."""
    ext = lambda f: f.select(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("extension")).where("extension <> ''")
    return ext(reference).groupBy("extension").agg(F.count("*").alias("n_files")).join(ext(now).distinct(), "extension", "left_anti")


def baseline(quadrants: DataFrame, top: DataFrame, name: str = "name") -> DataFrame:
    """(name, quadrant, finding): what the quadrants add to a list of the slowest: cases that it cannot tell apart, and bottlenecks outside of it."""
    rows = quadrants.join(top.select(F.col(top.columns[0]).alias(name)).distinct().withColumn("_top", F.lit(True)), name, "left")
    finding = F.when(F.col("quadrant") == "GROSSE_FROIDE", "large and cold").when(F.col("quadrant") == "PETITE_CHAUDE", "small and hot").when((F.col("quadrant") == "GOULOT") & F.col("_top").isNull(), "bottleneck outside")
    return rows.withColumn("finding", finding).where("finding IS NOT NULL").select(name, "quadrant", "finding")


def duplicated(before: DataFrame, after: DataFrame, name: str = "name", path: str = "file", excluded: tuple = ()) -> DataFrame:
    """(name, n_files, existed): names that two files or more define now; existed says that two or more did before. Files under an excluded prefix take no part."""
    ok = ~F.coalesce(*[F.when(F.col(path).startswith(p), True) for p in excluded], F.lit(False)) if excluded else F.lit(True)
    n = lambda f: f.where(ok).groupBy(name).agg(F.count_distinct(path).alias("n_files"))
    old = n(before).select(name, (F.col("n_files") >= 2).alias("existed"))
    return n(after).where("n_files >= 2").join(old, name, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def symbol_map(symbols: DataFrame, holes: DataFrame, dependants: DataFrame, churn: DataFrame) -> DataFrame:
    """Symbols (file, name, line, kappa) with hole (mode says whether the sensor applies), dependants and churn of their file, neutral where a sensor has nothing, their score and its place."""
    rows = symbols.join(holes.select("file", "name", "line", F.col("hole").alias("_h")), ["file", "name", "line"], "left")
    rows = rows.join(dependants.select("file", F.col("n").alias("_d")), "file", "left").join(churn.select("file", F.col("n").alias("_c")), "file", "left")
    rows = rows.select(*symbols.columns, F.coalesce("_h", F.lit(False)).alias("hole"), F.when(F.col("_h").isNull(), "non_applicable").otherwise("analyseur").alias("mode"), F.coalesce("_d", F.lit(0)).alias("dependants"), F.coalesce("_c", F.lit(0)).alias("churn"))
    score = F.log1p("kappa") + F.when(F.col("hole"), 3.0).otherwise(0.0) + F.log1p("dependants") + 0.5 * F.log1p("churn")
    return rows.withColumn("score", score)


def attack_first(mapped: DataFrame, top: int) -> DataFrame:
    """The `top` symbols with holes, by score (a top-k report)."""
    return mapped.where("hole").orderBy(F.round("score", 9).desc(), "file", "line").limit(top)


def churned(changes: DataFrame, now: Column, days: int = 30, file: str = "file", ts: str = "ts", merge: str = "merge") -> DataFrame:
    """(file, n): commits of the last days that touch a file, merges aside."""
    return changes.where((F.col(ts) >= now - F.make_dt_interval(F.lit(days))) & ~F.col(merge)).groupBy(file).agg(F.count_distinct("commit").alias("n"))


def validated(entries: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """A registry by key after updates: of each key the highest version; updates that do not raise it are left out, and a repeated version of one key raises."""
    rows = entries.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    twice = F.count("*").over(Window.partitionBy(key, version, "_u")) > 1
    rows = rows.withColumn("_x", F.when(twice, F.raise_error(F.lit("a version of a key stands twice")).cast("boolean")))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc(), "_u"))
    return rows.withColumn("_r", best).where("_r = 1 AND _x IS NULL").drop("_r", "_u", "_x")


def coupling_most(edges: DataFrame, nodes: DataFrame, node: str = "id", file: str = "file") -> DataFrame:
    """(file, most): the greatest number of distinct neighbours, in both directions, of a node of each file."""
    e = edges.select("src", "dst").distinct()
    near = e.select(F.col("src").alias(node), F.col("dst").alias("_o")).union(e.select("dst", "src")).distinct().groupBy(node).agg(F.count("*").alias("_n"))
    return nodes.join(near, node, "left").groupBy(file).agg(F.max(F.coalesce("_n", F.lit(0))).alias("most"))


def peaks(signal: DataFrame, keys: list[str], at: str, value: str, extent: float, n: int = 6, share: float = 0.35) -> DataFrame:
    """(keys, frequency, value): local maxima above a share of the largest value, the centre aside; of equal frequencies the strongest, the n strongest of a key."""
    own = Window.partitionBy(*keys)
    order = own.orderBy(at)
    rows = signal.select(*keys, at, F.col(value).alias("_v"), F.lag(value).over(order).alias("_a"), F.lead(value).over(order).alias("_b"), F.max(value).over(own).alias("_m"), F.floor(F.count("*").over(own) / 2).alias("_c"))
    top = rows.where((F.col("_v") > share * F.col("_m")) & (F.col("_v") >= F.col("_a")) & (F.col("_v") >= F.col("_b")) & (F.col(at) != F.col("_c")))
    found = top.groupBy(*keys, F.round(F.abs(F.col(at) - F.col("_c")) / (2.0 * extent), 6).alias("frequency")).agg(F.max("_v").alias(value))
    return found.withColumn("_r", F.row_number().over(own.orderBy(F.desc(value), "frequency"))).where(F.col("_r") <= n).drop("_r")


def telemetry(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, the seven fields of a telemetry file, and error: why one is no object of JSON."""
    # fixed values
    fields = ["decls_done", "current_decl", "term_table_size", "str_table_size", "bytes_written", "dedup_hits", "timestamp_ms"]
    kinds = ", ".join(f"{f} {'string' if f == 'current_decl' else 'long'}" for f in fields)
    parsed = F.try_parse_json(text)
    row = F.from_json(text, kinds)
    error = F.when(parsed.isNull(), "invalid JSON").when(~F.trim(text).startswith("{"), "not an object")
    return texts.select(path, *[F.when(error.isNull(), row[f]).alias(f) for f in fields], error.alias("error"))


def congruential(spark, n: int, seed: int = 20261007, most: int = 20_000, giant: float = 200_000.0) -> DataFrame:
    """(ordinal, kappa): n weights by the linear congruential generator, the first of them a giant; the k-th state in closed form, by squaring, so that rows need no predecessor."""
    # fixed values
    a, c, bits = 1_664_525, 1_013_904_223, 32
    ids = spark.range(n).withColumnRenamed("id", "ordinal")
    mask = F.lit((1 << bits) - 1)
    low = lambda x, y: (x.bitwiseAND(F.lit(0xFFFF)) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)
    value, step_a, step_c = F.lit(seed).cast("long"), a, c
    for bit in range(max(1, n.bit_length())):
        moved = (low(value, F.lit(step_a).cast("long")) + F.lit(step_c)).bitwiseAND(mask)
        value = F.when(F.shiftright(F.col("ordinal") + 1, bit).bitwiseAND(F.lit(1)) == 1, moved).otherwise(value)
        step_a, step_c = step_a * step_a % (1 << bits), (step_a * step_c + step_c) % (1 << bits)
        ids = ids.withColumn(f"_s{bit}", value)
        value = F.col(f"_s{bit}")
    return ids.select("ordinal", F.when(F.col("ordinal") == 0, giant).otherwise((1 + value % most).cast("double")).alias("kappa"))
