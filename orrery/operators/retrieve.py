"""Retrieval: inverse document frequencies, overlap scores, ranked and contextual search, budgeted chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.operators import perf


def tokenized(docs: DataFrame, doc: str, text: str, pattern: str = r"[^a-z0-9À-ɏ]+") -> DataFrame:
    """(doc, token): the distinct lower-case tokens of each document."""
    return docs.select(doc, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), pattern))).alias("token")).where("token <> ''")


def idf(tokens: DataFrame, doc: str, n_docs: int, unique: bool = False) -> DataFrame:
    """(token, df, idf): ln(N/df) / ln N, from 0 for a token of all documents to 1 for one of a single document; 0 where N <= 1.

    Where ids are `unique`, (doc, token) rows are distinct, and only a sum by token is shuffled.
    """
    counts = tokens.groupBy("token").agg((F.count("*") if unique else F.count_distinct(doc)).alias("df"))
    value = F.log(n_docs / F.col("df")) / F.log(F.lit(float(n_docs))) if n_docs > 1 else F.lit(0.0)
    return counts.withColumn("idf", value)


#: Distinct tokens of queries that are broadcast to the documents.
BROADCAST_TOKENS = 200_000


def overlap_topk(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int, n_docs: int, unique: bool = False) -> DataFrame:
    """The k documents of largest summed IDF overlap with each query (a top-k report).

    Postings of tokens that no query holds are dropped where they arise, if the queries' tokens are few enough to be
    broadcast, before anything is shuffled. Tokens of all documents (idf 0) add nothing and are left out of the join, which meets on the
    token; sums are partial before the shuffle.
    """
    wanted = tokenized(queries, query, text)
    needed = wanted.select("token").distinct()
    n = needed.limit(BROADCAST_TOKENS + 1).count()
    tokens = tokenized(docs, doc, text).join(F.broadcast(needed) if n <= BROADCAST_TOKENS else needed, "token", "left_semi")  # at most BROADCAST_TOKENS rows
    weights = idf(tokens, doc, n_docs, unique).where("idf > 0")
    weighted = wanted.join(weights.select("token", "idf"), "token")
    scores = tokens.join(weighted, "token").groupBy(query, doc).agg(F.sum("idf").alias("score"), F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), doc))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_context(docs: DataFrame, doc: str, text: str, pattern: str, around: int = 2, regex: bool = True) -> DataFrame:
    """(doc, line, hit, before, after): matching lines, from 1, with up to `around` neighbours on either side. Case does not matter."""
    lines = docs.select(doc, F.split(F.col(text), "\n").alias("_l"))
    at = lines.select(doc, "_l", F.posexplode("_l").alias("_p", "hit"))
    match = F.col("hit").rlike("(?i)" + pattern) if regex else F.lower("hit").contains(pattern.lower())
    start = F.greatest(F.lit(0), F.col("_p") - around)
    before = F.slice("_l", start + 1, F.col("_p") - start)
    after = F.slice("_l", F.col("_p") + 2, F.lit(around))
    return at.where(match).select(doc, (F.col("_p") + 1).alias("line"), "hit", F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))


def ranked_search(symbols: DataFrame, name: str, weight: str, text: str) -> DataFrame:
    """Names that contain the text: exact first, then as a prefix, then within; of equal rank the heaviest."""
    low = F.lower(name)
    rank = F.when(low == text.lower(), 0).when(low.startswith(text.lower()), 1).otherwise(2)
    return symbols.where(low.contains(text.lower())).withColumn("rank", rank).orderBy("rank", F.desc(weight), name)


def declaration_score(same_module: Column, in_closure: Column, cited: Column, head_idf: Column, overlap: Column, heads: Column) -> Column:
    one = F.lit(1.0)
    return F.when(same_module, one).otherwise(0.0) + F.when(in_closure, 0.5).otherwise(0.0) + F.when(cited, one).otherwise(0.0) + 2 * head_idf + F.least(F.lit(3.0), overlap) + F.least(F.lit(2.0), heads)


def chains(nodes: DataFrame, links: DataFrame, node: str, cost: str, most: int, budget: float, beam: int, top: int) -> DataFrame:
    """The `top` chains of linked nodes by (length, -cost): each costs the sum of its nodes and C(n, 2) times the median cost, within the budget.

    Level by level; a level keeps its `beam` cheapest prefixes, and `truncated` says that some level had more.
    """
    middle = perf.median(nodes, cost) or 0.0
    price = nodes.select(F.col(node).alias("_n"), F.col(cost).cast("double").alias("_c"))
    level = price.select(F.array("_n").alias("chain"), F.col("_c").alias("total"))
    out, cut = None, False
    for n in range(1, most + 1):
        fee = n * (n - 1) / 2 * middle
        inside = level.where(F.col("total") + fee <= budget)
        kept = inside.orderBy("total", F.array_join(F.col("chain").cast("array<string>"), "\x00")).limit(beam + 1).collect()
        cut |= len(kept) > beam
        kept = kept[:beam]
        if not kept:
            break
        level = nodes.sparkSession.createDataFrame(kept, inside.schema)
        part = level.select("chain", (F.col("total") + fee).alias("cost"), F.lit(n).alias("length"))
        out = part if out is None else out.unionByName(part)
        grown = level.withColumn("_last", F.element_at("chain", -1)).join(links.select(F.col("src").alias("_last"), F.col("dst").alias("_n")).distinct(), "_last").join(price, "_n")
        level = grown.where(~F.array_contains("chain", F.col("_n"))).select(F.concat("chain", F.array("_n")).alias("chain"), (F.col("total") + F.col("_c")).alias("total"))
    if out is None:
        return level.select("chain", F.col("total").alias("cost"), F.size("chain").alias("length")).limit(0).withColumn("truncated", F.lit(cut))
    return out.orderBy(F.desc("length"), "cost", F.array_join(F.col("chain").cast("array<string>"), "\x00")).limit(top).withColumn("truncated", F.lit(cut))
