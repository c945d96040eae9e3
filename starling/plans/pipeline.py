"""Whole runs: posts to edges, edges to communities, partitions to candidates. Parts are written by the sinks; failures fail the run."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import resolutions
from ..operators import community, edges, funnel, partition, stats, text
from ..schemas import Relation
from ..sources import readers, sinks
from .config import CommunityConfig, Config, FunnelConfig, GraphConfig, TextConfig


def relations_of(c: GraphConfig) -> list[Relation]:
    flags = {Relation.RETWEET: c.retweet, Relation.USER_HASHTAG: c.user_hashtag, Relation.HASHTAG_PAIR: c.hashtag_cooccurrences, Relation.RESPONSE: c.response, Relation.MENTION: c.mention}
    return [r for r, on in flags.items() if on]


def build_edges(posts: DataFrame, c: GraphConfig) -> dict[str, DataFrame]:
    """edges, node_map and (if wanted) tweet_edges of the posts in the configured range."""
    day = lambda s: datetime.strptime(s, "%d/%m/%Y") if s else None
    posts = readers.scan(posts, day(c.start), day(c.end))
    method = None if c.method == "full" else c.method
    out = {"edges": edges.edges(posts, relations_of(c), method, c.zone), "node_map": edges.node_map(posts)}
    if c.tweet_retweet:
        out["tweet_edges"] = edges.tweet_edges(posts)
    return out


def detect(edge_list: DataFrame, c: CommunityConfig) -> DataFrame:
    """Membership of all configured resolutions (or slices)."""
    grid = resolutions(c.low, c.high, c.number_of_resolutions)
    if c.temporal:
        out = None
        for g in grid:
            own = community.incremental(edge_list, g, c.lambda_temporal, c.cap_bonus)
            own = own.withColumn("resolution", F.lit(g))
            out = own if out is None else out.unionByName(own)
        return out
    objective = "modularity" if c.algorithm == "combo" else "cpm"
    found = community.communities(edge_list, grid, objective)
    if c.algorithm == "hierarchical":
        h = c.hierarchical
        base = found.where(F.format_string("%.1f", "resolution") == h.community_col_name).select("name", "community")
        return community.hierarchical(edge_list, base, grid, h.top_k, h.min_size if h.collapse_nodes else 1)
    return found


def shortlist(rt: DataFrame, reply: DataFrame, rt_tags: DataFrame, reply_tags: DataFrame, c: FunnelConfig) -> dict[str, DataFrame]:
    """matches, candidates, their top tags and keyword hits; rt and reply are memberships with type, *_tags user-tag edges."""
    matches = funnel.counterparts(rt, reply, c.min_comm_size)
    entropy = [stats.community_tag_entropy(tags, m, c.min_comm_size) for tags, m in ((rt_tags, rt), (reply_tags, reply))]
    found = funnel.echo_chambers(matches, *entropy, c.jaccard_threshold, c.entropy_quantile)
    tags = funnel.top_tags(found.select("resolution", F.col("source_comm_id").alias("community")), partition.users_only(rt), rt_tags, n=c.top_n)
    out = {"matches": matches, "candidates": found, "top_tags": tags}
    if c.keywords:
        out["keyword_hits"] = funnel.keyword_candidates(tags, c.keywords, c.keyword_threshold)
    return out


def texts(posts: DataFrame, membership: DataFrame, c: TextConfig) -> DataFrame:
    return text.community_texts(posts, membership, c.indexes)


def run(spark: SparkSession, config: Config) -> None:
    """Execute the configured parts one after another."""
    if config.graph.to_execute:
        made = build_edges(readers.posts(spark, config.graph.source, config.graph.fmt), config.graph)
        sinks.by_relation(made["edges"], f"{config.graph.output}/edges")
        for name in made.keys() - {"edges"}:
            made[name].write.mode("overwrite").parquet(f"{config.graph.output}/{name}")
    if config.community.to_execute:
        e = spark.read.parquet(config.community.edges).select("src", "dst", "weight")
        detect(e, config.community).write.mode("overwrite").parquet(config.community.output)
    if config.text.to_execute:
        members = spark.read.parquet(config.community.output).where(F.format_string("%.1f", "resolution") == config.text.community_col_name)
        members = members.withColumn("type", F.when(F.col("name").startswith("h:"), "h").otherwise("u"))
        texts(readers.posts(spark, config.text.source), members, config.text).write.mode("overwrite").json(config.text.output)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run the configured parts of the interaction graph pipeline.")
    parser.add_argument("--properties", required=True, help="JSON configuration file")
    run(SparkSession.builder.appName("starling").getOrCreate(), Config.load(parser.parse_args(args).properties))


if __name__ == "__main__":
    main()
