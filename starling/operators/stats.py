"""Inequality, entropy and boundary statistics of communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gini(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient per key: sum((2i - n - 1) x) / (n sum x) over ascending ranks; all zero or all equal gives 0.

    Values are counted first and ranks taken over different values, so equal
    values, however many, are one row.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("x"))
    ranked = counted.withColumn("last", upto)
    # Ranks last-c+1 .. last share x: their sum is c * (2 * last - c + 1) / 2.
    agg = ranked.groupBy(*keys).agg(F.sum(F.col("x") * F.col("c") * (2 * F.col("last") - F.col("c") + 1)).alias("w"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum("c").alias("n"))
    return agg.select(*keys, F.when(F.col("s") == 0, 0.0).otherwise(F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def size_cdf(sizes: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Empirical distribution: each value with its rank over n (equal values keep separate ranks), as ranges of ranks."""
    counted = sizes.groupBy(*keys, value).agg(F.count("*").alias("c"))
    last = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(*keys))
    out = counted.withColumn("last", last).withColumn("n", n).withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("c") + 1, F.col("last"))))
    return out.select(*keys, value, "rank", (F.col("rank") / F.col("n")).alias("cdf"))


def coverage(edges: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of edge weight inside communities. labels: (keys, name, community)."""
    j = labelled(edges, labels, keys)
    return j.groupBy(*keys).agg((F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("coverage"))


def labelled(edges: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges with the communities (c1, c2) of both ends."""
    end = lambda name, c: labels.select(*keys, F.col("name").alias(name), F.col("community").alias(c))
    own = [k for k in keys if k in edges.columns]
    return edges.join(end("src", "c1"), ["src", *own]).join(end("dst", "c2"), ["dst", *keys])


def ei_index(edges: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per community: size, internal weight (each end counts), external weight, and (E - I) / (E + I), 0 without edges."""
    j = labelled(edges, labels, keys)
    ends = j.select(*keys, "weight", (F.col("c1") == F.col("c2")).alias("inside"), F.explode(F.array("c1", "c2")).alias("community"))
    w = ends.groupBy(*keys, "community").agg(F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).alias("internal_weight"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("weight"))).alias("external_weight"))
    sizes = labels.groupBy(*keys, "community").agg(F.count("*").alias("size"))
    out = sizes.join(w, [*keys, "community"], "left").fillna(0, ["internal_weight", "external_weight"])
    e, i = F.col("external_weight"), F.col("internal_weight")
    return out.select(*keys, "community", "size", "internal_weight", "external_weight", F.when(e + i == 0, 0.0).otherwise((e - i) / (e + i)).alias("ei_index"))


def conductance(edges: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per community: cut weight over the smaller of its volume and the rest's; null if that is 0."""
    j = labelled(edges, labels, keys)
    ends = j.select(*keys, "weight", (F.col("c1") != F.col("c2")).alias("crosses"), F.explode(F.array("c1", "c2")).alias("community"))
    w = ends.groupBy(*keys, "community").agg(F.sum(F.when(F.col("crosses"), F.col("weight")).otherwise(0)).alias("cut"), F.sum("weight").alias("volume"))
    total = w.groupBy(*keys).agg(F.sum("volume").alias("all")) if keys else w.agg(F.sum("volume").alias("all"))
    w = w.join(total, list(keys)) if keys else w.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    side = F.least("volume", F.col("all") - F.col("volume"))
    return w.select(*keys, "community", "cut", "volume", F.when(side > 0, F.col("cut") / side).alias("conductance"))


def conductance_summary(values: DataFrame, sizes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, size-weighted mean and median of conductance."""
    j = values.where(F.col("conductance").isNotNull()).join(sizes, [*keys, "community"])
    return j.groupBy(*keys).agg(F.avg("conductance").alias("mean"), (F.sum(F.col("conductance") * F.col("size")) / F.sum("size")).alias("weighted_mean"), F.median("conductance").alias("median"))


def tag_entropy(usages: DataFrame, keys: Sequence[str] = (), normalise: bool = True) -> DataFrame:
    """Per community: users, usages, different tags, entropy of tag shares and share of the commonest tag.

    usages: (keys, community, name, tag, weight). Entropy in bits, over the log
    of the number of tags if normalised; a single tag has entropy 0.
    """
    k = [*keys, "community"]
    per_tag = usages.groupBy(*k, "tag").agg(F.sum("weight").alias("w"))
    total = per_tag.groupBy(*k).agg(F.sum("w").alias("total"), F.count("*").alias("tags"), F.max("w").alias("most"))
    p = F.col("w") / F.col("total")
    h = per_tag.join(total, k).groupBy(*k).agg((-F.sum(p * F.log2(p))).alias("bits"))
    users = usages.groupBy(*k).agg(F.countDistinct("name").alias("n_users"))
    bits = F.greatest(F.lit(0.0), F.col("bits"))
    entropy = F.when(F.col("tags") <= 1, 0.0).otherwise(bits / F.log2("tags") if normalise else bits)
    return total.join(h, k).join(users, k).select(*k, "n_users", F.col("total").alias("n_tag_usages"), F.col("tags").alias("n_unique_tags"), entropy.alias("entropy"), (F.col("most") / F.col("total")).alias("dominant_share"))


def community_tag_entropy(user_tags: DataFrame, membership: DataFrame, min_size: int = 11, normalise: bool = True, active_users: bool = True) -> DataFrame:
    """tag_entropy for communities of at least min_size users; user_tags: (src, dst, weight), membership with type.

    Communities without usages are left out if active_users, else kept with null entropy and their number of members.
    """
    keys = ["resolution", "community"]
    users = membership.where(F.col("type") == "u")
    big = users.groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") >= min_size)
    tags = membership.groupBy(*keys).agg(F.count_if(F.col("type") != "u").alias("n_tag_nodes"))
    own = users.join(big, keys, "left_semi").select(*keys, "name")
    usages = own.join(user_tags.select(F.col("src").alias("name"), F.col("dst").alias("tag"), "weight"), "name")
    e = tag_entropy(usages, ("resolution",), normalise)
    out = big.join(e, keys, "inner" if active_users else "left").join(tags, keys)
    return out if active_users else out.withColumn("n_users", F.col("members"))


def entropy_summary(entropy: DataFrame, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    return entropy.groupBy(*keys).agg(F.avg("entropy").alias("mean_entropy"), F.median("entropy").alias("median_entropy"), F.max("entropy").alias("max_entropy"), F.count("entropy").alias("n"))


def lowest_entropy(entropy: DataFrame, n: int = 100, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("entropy", "community")
    return entropy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
