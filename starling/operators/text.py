"""Texts of communities: selection, distinctive terms and diverse ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import conditional_text
from ..plans.checkpoint import written


def community_texts(posts: DataFrame, membership: DataFrame, communities: list[int], compat: bool = False) -> DataFrame:
    """(community, user, text, type) of posts by users of the chosen communities."""
    text, kind = conditional_text(compat)
    users = membership.where((F.col("type") == "u") & F.col("community").isin(communities)).select("name", "community").distinct()
    rows = posts.select(F.concat(F.lit("u:"), F.col("user.id")).alias("name"), text.alias("text"), kind.alias("type"))
    return rows.join(users, "name").select("community", F.col("name").alias("user"), "text", "type")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def class_terms(texts: DataFrame, cls: str, text: str = "text", k: int = 10) -> DataFrame:
    """(class, term, tf, score, rank): class TF-IDF, tf * ln(1 + mean class size / frequency of the term)."""
    words = texts.select(F.col(cls).alias("class"), F.explode(terms(F.col(text))).alias("term"))
    tf = words.groupBy("class", "term").agg(F.count("*").alias("tf"))
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = tf.agg((F.sum("tf") / F.countDistinct("class")).alias("a")).withColumn("one", F.lit(1))  # one row
    scored = tf.join(f, "term").withColumn("one", F.lit(1)).join(F.broadcast(mean), "one")
    # Rounded before ranking, so that equal scores tie alike in every engine.
    scored = scored.select("class", "term", "tf", F.round(F.col("tf") * F.ln(1 + F.col("a") / F.col("f")), 6).alias("score"))
    order = Window.partitionBy("class").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_originals(membership: DataFrame, node_map: DataFrame) -> DataFrame:
    """membership with the original name of each node; a node of several kinds has one of each name."""
    names = node_map.select(F.col("node").alias("name"), "original").distinct()
    return membership.join(names, "name")


def diverse(vectors: DataFrame, cls: str = "label", vector: str = "embedding", ident: str = "vec_id", k: int = 5, diversity: float = 0.3) -> DataFrame:
    """(class, id, rank): maximal marginal relevance to each class's centroid over all of its vectors.

    Each of the k steps is a grouped maximum over all vectors that are left, so
    nothing but the vector chosen last meets its class; scores are rounded to
    nine digits, so that equal ones tie alike everywhere (to the smaller id).
    """
    v = vectors.select(F.col(cls).alias("class"), F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    centre = v.select("class", F.posexplode("x").alias("i", "c")).groupBy("class", "i").agg(F.avg("c").alias("c"))
    centre = centre.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    left = v.join(centre, "class").withColumn("long", F.sqrt(dot(F.col("x"), F.col("x"))))
    left = written(left.select("class", "id", "x", "long", (dot(F.col("x"), F.col("centre")) / (F.col("long") * F.sqrt(dot(F.col("centre"), F.col("centre"))))).alias("near"), F.lit(0.0).alias("worst")))
    out = None
    for rank in range(1, k + 1):
        score = F.round((1 - diversity) * F.col("near") - diversity * F.col("worst"), 9)
        best = written(left.groupBy("class").agg(F.max_by(F.struct("id", "x", "long"), F.struct(score, -F.col("id"))).alias("p")).select("class", "p.*"))
        found = best.select("class", "id", F.lit(rank).alias("rank"))
        out = found if out is None else out.unionByName(found)
        if rank < k:
            like = dot(F.col("x"), F.col("px")) / (F.col("long") * F.col("plong"))
            left = left.join(best.select("class", F.col("id").alias("pid"), F.col("x").alias("px"), F.col("long").alias("plong")), "class").where(F.col("id") != F.col("pid"))
            left = left.withColumn("worst", like if rank == 1 else F.greatest("worst", like)).select("class", "id", "x", "long", "near", "worst")
    return out
