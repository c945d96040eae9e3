"""Posts to typed, weighted, optionally bucketed edge lists and node maps.

Each relation is an expression that gives an array of (src, dst) for a post;
all wanted relations are exploded in one pass over the posts and summed with a
map-side combine: one shuffle, whatever the number of relations. Nodes are
natural keys with a kind prefix (u user id, h tag, m screen name, t post), so
ids of different kinds never collide.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket as bucket_of
from ..functions.scalar import epoch, pairs, reply_target, tag_list
from ..schemas import MapKind, Relation

SUMMED = (Relation.RETWEET, Relation.USER_HASHTAG, Relation.HASHTAG_PAIR, Relation.RESPONSE, Relation.MENTION)


def user(c: str) -> Column:
    return F.concat(F.lit("u:"), F.col(c).cast("string"))


def _ends(src: Column, dst: Column) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"))


def _one(src: Column, dst: Column) -> Column:
    """One edge, or none if an end is null."""
    return F.filter(F.array(_ends(src, dst)), lambda e: e["src"].isNotNull() & e["dst"].isNotNull())


def relation(kind: Relation, drop_empty: bool = False, distinct_tags: bool = False) -> Column:
    """Array of the (src, dst) that a post gives to a relation."""
    tags = tag_list("hashtagEntities", drop_empty)
    author = user("user.id")
    if kind == Relation.RETWEET:
        return _one(author, user("retweeted_status.user.id"))
    if kind == Relation.USER_HASHTAG:
        return F.filter(F.transform(tags, lambda t: _ends(author, F.concat(F.lit("h:"), t))), lambda e: e["src"].isNotNull())
    if kind == Relation.HASHTAG_PAIR:
        both = pairs(tags, distinct_tags)
        name = lambda t: F.concat(F.lit("h:"), t)
        return F.concat(F.transform(both, lambda p: _ends(name(p["a"]), name(p["b"]))), F.transform(both, lambda p: _ends(name(p["b"]), name(p["a"]))))
    if kind == Relation.RESPONSE:
        return _one(author, F.concat(F.lit("u:"), reply_target("in_reply_to_user_id").cast("string")))
    if kind == Relation.MENTION:
        return F.filter(F.transform(tag_list("userMentionEntities", drop_empty), lambda t: _ends(author, F.concat(F.lit("m:"), t))), lambda e: e["src"].isNotNull())
    raise ValueError(f"{kind!r} is not a summed relation")


def labelled(kind: Relation, **options) -> Column:
    """Array of the (rel, src, dst) of a relation."""
    return F.transform(relation(kind, **options), lambda e: F.struct(F.lit(int(kind)).alias("rel"), e["src"].alias("src"), e["dst"].alias("dst")))


def exploded(posts: DataFrame, relations: Iterable[Relation] = SUMMED, method: str | None = None, zone: str = "UTC", **options) -> DataFrame:
    """(rel, src, dst[, bucket]) before the sum."""
    arrays = [labelled(Relation(r), **options) for r in relations]
    extra = [bucket_of("created_at", method, zone).alias("bucket")] if method else []
    return posts.select(F.explode(F.concat(*arrays)).alias("e"), *extra).select("e.rel", "e.src", "e.dst", *[c for c in ("bucket",) if method])


def edges(posts: DataFrame, relations: Iterable[Relation] = SUMMED, method: str | None = None, zone: str = "UTC", **options) -> DataFrame:
    """Edge list with the number of occurrences as weight; per bucket if a method (day, week) is given."""
    keys = ["rel", "src", "dst", *(["bucket"] if method else [])]
    return exploded(posts, relations, method, zone, **options).groupBy(*keys).agg(F.count("*").alias("weight"))


def tweet_edges(posts: DataFrame) -> DataFrame:
    """Post to repeated post with both times; of repeated pairs the latest counts."""
    rows = posts.where(F.col("retweeted_status").isNotNull()).select(
        F.concat(F.lit("t:"), F.col("id")).alias("src"), F.concat(F.lit("t:"), F.col("retweeted_status.id")).alias("dst"), epoch("created_at").alias("t_src"), epoch("retweeted_status.created_at").alias("t_dst")
    )
    return rows.groupBy("src", "dst").agg(F.max(F.struct("t_src", "t_dst")).alias("t")).select(F.lit(int(Relation.TWEET_RETWEET)).alias("rel"), "src", "dst", "t.t_src", "t.t_dst")


def node_map(posts: DataFrame, counted: bool = False) -> DataFrame:
    """Distinct (original, node, map_type) of users, repeated users, posts and tags; if counted, with their number as weight."""
    row = lambda original, prefix, kind: F.struct(original.cast("string").alias("original"), F.concat(F.lit(prefix), original.cast("string")).alias("node"), F.lit(int(kind)).alias("map_type"))
    tags = F.transform(tag_list("hashtagEntities"), lambda t: row(t, "h:", MapKind.HASHTAG))
    fixed = F.array(row(F.col("user.id"), "u:", MapKind.USER_ID), row(F.col("retweeted_status.user.id"), "u:", MapKind.RETWEETED_USER_ID), F.when(F.col("retweeted_status").isNotNull(), row(F.col("id"), "t:", MapKind.TWEET_ID)), row(F.col("retweeted_status.id"), "t:", MapKind.TWEET_ID))
    rows = posts.select(F.explode(F.concat(fixed, tags)).alias("x")).where(F.col("x.original").isNotNull()).select("x.*")
    return rows.groupBy("original", "node", "map_type").agg(F.count("*").alias("weight")) if counted else rows.dropDuplicates()


def screen_names(posts: DataFrame) -> DataFrame:
    """(screen_name, user_id): the name a user had first."""
    return posts.where(F.col("user.screen_name").isNotNull()).groupBy(F.col("user.id").alias("user_id")).agg(F.min_by("user.screen_name", F.struct("created_at", "id")).alias("screen_name")).select(F.lower("screen_name").alias("screen_name"), "user_id")


def resolve_mentions(edge_list: DataFrame, names: DataFrame) -> DataFrame:
    """Mention edges with the mentioned user's id where the name is known."""
    known = names.groupBy(F.concat(F.lit("m:"), F.col("screen_name")).alias("dst")).agg(F.min("user_id").alias("user_id"))
    return edge_list.join(known, "dst", "left").withColumn("dst", F.coalesce(F.concat(F.lit("u:"), F.col("user_id")), F.col("dst"))).groupBy("rel", "src", "dst").agg(F.sum("weight").alias("weight"))


def multigraph(*edge_lists: DataFrame) -> DataFrame:
    """Concatenation of edge lists."""
    out = edge_lists[0]
    for e in edge_lists[1:]:
        out = out.unionByName(e)
    return out


def merged(*edge_lists: DataFrame) -> DataFrame:
    """Edge lists joined by node name, weights of equal edges added."""
    return multigraph(*edge_lists).groupBy("rel", "src", "dst").agg(F.sum("weight").alias("weight"))


def vertices(edge_list: DataFrame) -> DataFrame:
    """(name, type) of all ends; the type comes from the key's prefix (u for users and screen names, h for tags)."""
    names = edge_list.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return names.select("name", F.when(F.col("name").startswith("h:"), "h").when(F.col("name").startswith("t:"), "t").otherwise("u").alias("type"))


def type_conflicts(vertex_tables: DataFrame) -> DataFrame:
    """Names that carry more than one type; empty for graphs that can be merged."""
    return vertex_tables.groupBy("name").agg(F.countDistinct("type").alias("types")).where(F.col("types") > 1)
