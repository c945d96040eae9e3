"""The candidate filter: matched communities, narrow topics, their tags and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import keyword_match
from .graph import touching
from .partition import best_matches, drop_small, users_only


def counterparts(source: DataFrame, target: DataFrame, min_size: int = 11) -> DataFrame:
    """Best match in target of each source community (users only, small ones dropped); none without overlap."""
    a, b = (drop_small(users_only(p), min_size) for p in (source, target))
    return best_matches(a, b).select(
        F.col("a_comm").alias("source_comm_id"), F.col("a_size").alias("source_comm_size"), F.col("b_comm").alias("best_target_comm_id"), F.col("b_size").alias("best_target_comm_size"), F.col("jaccard").alias("best_jaccard_score"), "resolution"
    )


def echo_chambers(matches: DataFrame, rt_entropy: DataFrame, reply_entropy: DataFrame, jaccard: float = 0.4, quantile: float = 0.25) -> DataFrame:
    """Matches above the Jaccard threshold whose entropy lies below the quantile (over all resolutions) in both graphs.

    Each step's quantile is that of the whole entropy table of its graph.
    """

    def narrow(rows: DataFrame, entropy: DataFrame, key: str, name: str) -> DataFrame:
        e = entropy.select("resolution", F.col("community").alias(key), F.col("entropy").alias(name))
        cut = entropy.agg(F.percentile("entropy", quantile).alias("cut")).withColumn("one", F.lit(1))  # one row
        e = e.withColumn("one", F.lit(1)).join(F.broadcast(cut), "one").where(F.col(name) < F.col("cut")).drop("one", "cut")
        return rows.join(e, ["resolution", key])

    kept = matches.where(F.col("best_jaccard_score") > jaccard)
    kept = narrow(kept, rt_entropy, "source_comm_id", "rt_entropy")
    return narrow(kept, reply_entropy, "best_target_comm_id", "reply_entropy")


def top_tags(candidates: DataFrame, membership: DataFrame, user_tags: DataFrame, tag_text: DataFrame | None = None, n: int = 500) -> DataFrame:
    """(resolution, community, rank, tag, tag_text, count): each candidate's commonest tags, all candidates in one job."""
    keys = ["resolution", "community"]
    members = membership.join(candidates.select(*keys).distinct(), keys, "left_semi").select(*keys, "name")
    used = touching(user_tags, members, tuple(keys)).groupBy(*keys, F.col("dst").alias("tag")).agg(F.sum("weight").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "tag")
    top = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if tag_text is None:
        return top.withColumn("tag_text", F.expr("substring(tag, 3)"))
    return top.join(tag_text.select("tag", "tag_text"), "tag", "left").fillna("N/A", ["tag_text"])


def keyword_candidates(tags: DataFrame, keywords: list[str], threshold: int = 5000) -> DataFrame:
    """(resolution, community, matching): candidates whose matching tags are used `threshold` times or more."""
    hits = tags.groupBy("resolution", "community").agg(F.sum(F.when(keyword_match("tag_text", keywords), F.col("count")).otherwise(0)).alias("matching"))
    return hits.where(F.col("matching") >= threshold)


def jaccard_trends(matches: DataFrame) -> DataFrame:
    return matches.groupBy("resolution").agg(F.avg("best_jaccard_score").alias("mean"), F.median("best_jaccard_score").alias("median"), F.max("best_jaccard_score").alias("max"), F.count("*").alias("n"))


def centrality_summary(candidates: DataFrame, membership: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Per candidate: nodes, edges, and the Gini of in-degree, PageRank and betweenness in its own subgraph."""
    from ..plans.checkpoint import written
    from .graph import betweenness, pagerank
    from .stats import gini

    members = membership.join(candidates.select("resolution", "community").distinct(), ["resolution", "community"], "left_semi")
    key = F.concat_ws("|", F.format_string("%.1f", "resolution"), F.col("community").cast("string"))
    own = members.select(key.alias("candidate"), "name")
    end = lambda c, i: own.select(F.col("name").alias(c), F.col("candidate").alias(f"k{i}"))
    inner = edges.join(end("src", 1), "src").join(end("dst", 2), "dst").where(F.col("k1") == F.col("k2"))
    inner = written(inner.select(F.col("k1").alias("candidate"), "src", "dst", "weight").groupBy("candidate", "src", "dst").agg(F.sum("weight").alias("weight")))
    # All candidates' subgraphs side by side: one PageRank over disjoint copies, scaled back to each copy.
    apart = lambda c: F.concat_ws("\u0001", "candidate", c)
    ranks = pagerank(inner.select(apart("src").alias("src"), apart("dst").alias("dst"), "weight"), rounds)
    ranks = ranks.select(F.split("name", "\u0001")[0].alias("candidate"), F.col("pagerank"))
    degrees = own.join(inner.groupBy("candidate", F.col("dst").alias("name")).agg(F.sum("weight").alias("d")), ["candidate", "name"], "left").fillna(0, ["d"])
    between = betweenness(inner, "candidate")
    out = own.groupBy("candidate").agg(F.countDistinct("name").alias("n_nodes"))
    for values, value, name in ((degrees, "d", "gini_in_degree"), (ranks, "pagerank", "gini_pagerank"), (between, "betweenness", "gini_betweenness")):
        out = out.join(gini(values, value, ("candidate",)).withColumnRenamed("gini", name), "candidate", "left")
    return out.join(inner.groupBy("candidate").agg(F.count("*").alias("n_edges")), "candidate", "left").fillna(0, ["n_edges"])
