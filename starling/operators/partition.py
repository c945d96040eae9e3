"""Comparing partitions of the same nodes, for every graph pair and resolution at once.

Everything follows from the contingency table, a join on the node and a count:
only label pairs that occur are ever looked at, and its size does not depend on
the number of label pairs that could occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import written

NOISE = -1


def users_only(membership: DataFrame, kind: str = "u") -> DataFrame:
    return membership.where(F.lower("type") == kind)


def with_sizes(membership: DataFrame, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """Each row with the size of its community."""
    sizes = membership.groupBy(*keys, "community").agg(F.count("*").alias("size"))
    return membership.join(sizes, [*keys, "community"])


def collapse_small(membership: DataFrame, min_size: int, keys: Sequence[str] = ("resolution",), noise: int = NOISE) -> DataFrame:
    """Members of communities below min_size get the noise label."""
    return with_sizes(membership, keys).withColumn("community", F.when(F.col("size") < min_size, F.lit(noise).cast("long")).otherwise(F.col("community"))).drop("size")


def drop_small(membership: DataFrame, min_size: int, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    return with_sizes(membership, keys).where(F.col("size") >= min_size).drop("size")


def top_communities(membership: DataFrame, k: int, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """(keys, community, size, rank): the k largest communities, ties to the smaller label."""
    sizes = membership.groupBy(*keys, "community").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "community")
    return sizes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def contingency(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """(keys, l1, l2, n) over the nodes that both partitions have."""
    x = a.select(*keys, "name", F.col("community").alias("l1"))
    y = b.select(*keys, "name", F.col("community").alias("l2"))
    return x.join(y, [*keys, "name"]).groupBy(*keys, "l1", "l2").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def similarity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("resolution",), exclude_noise: bool = False) -> DataFrame:
    """NMI (arithmetic mean), ARI and variation of information, per key.

    vi_nats and vi_bits use one unit each; vi_mixed subtracts twice the mutual
    information in nats from entropies in bits, as published tables do.
    """
    if exclude_noise:
        a, b = (p.where(F.col("community") != NOISE) for p in (a, b))
    # Label pairs and the labels of both sides are counted by one grouped sum over grouping sets, so no label, the noise
    # label either, brings its pairs into one task; all measures are sums over these counts.
    c = contingency(a, b, keys)
    sets = [(*keys, "l1", "l2"), (*keys, "l1"), (*keys, "l2")]
    c = c.groupingSets(sets, *keys, "l1", "l2").agg(F.sum("n").cast("double").alias("n"), F.grouping("l1").alias("no1"), F.grouping("l2").alias("no2"))
    n, of = F.col("n"), {"": (F.col("no1") == 0) & (F.col("no2") == 0), "1": F.col("no2") == 1, "2": F.col("no1") == 1}
    t = c.groupBy(*keys).agg(
        F.sum(F.when(of[""], n)).cast("long").alias("total"),
        *(F.sum(F.when(which, n * F.ln(n))).alias(f"x{i}") for i, which in of.items()),
        *(F.sum(F.when(which, n * (n - 1) / 2)).alias(f"s{i}") for i, which in of.items()),
        *(F.count_if(of[i]).alias(f"k{i}") for i in ("1", "2")),
    )
    total = F.col("total").cast("double")
    h1, h2 = (F.greatest(F.lit(0.0), F.ln(total) - F.col(x) / total) for x in ("x1", "x2"))
    mi = (F.col("x") - F.col("x1") - F.col("x2")) / total + F.ln(total)
    t = t.withColumns({"both": h1 + h2, "mi": F.greatest(F.lit(0.0), mi), "expected": F.col("s1") * F.col("s2") / _pairs(F.col("total")), "middle": (F.col("s1") + F.col("s2")) / 2})
    nats = F.col("both") - 2 * F.col("mi")
    bits = F.lit(1.0) / F.ln(F.lit(2.0))
    return t.select(
        *keys,
        F.col("total").alias("n_common"),
        F.col("k1").alias("n_comms_1"),
        F.col("k2").alias("n_comms_2"),
        F.when((F.col("k1") == 1) & (F.col("k2") == 1), 1.0).when(F.col("both") == 0, 1.0).otherwise(2 * F.col("mi") / F.col("both")).alias("nmi"),
        F.when((F.col("total") < 2) | (F.col("middle") == F.col("expected")), 1.0).otherwise((F.col("s") - F.col("expected")) / (F.col("middle") - F.col("expected"))).alias("ari"),
        F.greatest(F.lit(0.0), nats).alias("vi_nats"),
        F.greatest(F.lit(0.0), nats * bits).alias("vi_bits"),
        (F.col("both") * bits - 2 * F.col("mi")).alias("vi_mixed"),
    )


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """(keys, a_comm, a_size, b_comm, b_size, common, jaccard) of communities that share a node; sizes count all members."""
    sizes = lambda p, l, n: p.groupBy(*keys, F.col("community").alias(l)).agg(F.count("*").alias(n))  # noqa: E731, E741
    c = contingency(a, b, keys).withColumnsRenamed({"l1": "a_comm", "l2": "b_comm", "n": "common"})
    c = c.join(sizes(a, "a_comm", "a_size"), [*keys, "a_comm"]).join(sizes(b, "b_comm", "b_size"), [*keys, "b_comm"])
    return c.select(*keys, "a_comm", "a_size", "b_comm", "b_size", "common", (F.col("common") / (F.col("a_size") + F.col("b_size") - F.col("common"))).alias("jaccard"))


def best_matches(a: DataFrame, b: DataFrame, k: int = 1, keys: Sequence[str] = ("resolution",), without_overlap: bool = False) -> DataFrame:
    """The k most similar communities of b for each of a; ties to the smaller label.

    Communities that share no node are left out; with ``without_overlap`` they
    fill up to k, at a Jaccard of 0 and by label.
    """
    order = Window.partitionBy(*keys, "a_comm").orderBy(F.desc("jaccard"), "b_comm")
    best = overlaps(a, b, keys).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not without_overlap:
        return best
    best = written(best)
    sizes = lambda p, l, n: p.groupBy(*keys, F.col("community").alias(l)).agg(F.count("*").alias(n))  # noqa: E731, E741
    have = sizes(a, "a_comm", "a_size").join(best.groupBy(*keys, "a_comm").agg(F.collect_set("b_comm").alias("own")), [*keys, "a_comm"], "left")
    few = have.withColumn("own", F.coalesce("own", F.array().cast("array<bigint>"))).where(F.size("own") < k)
    # A community with fewer than k overlaps misses at most k of the first 2k - 1 labels.
    first = Window.partitionBy(*keys).orderBy("b_comm")
    labels = sizes(b, "b_comm", "b_size").withColumn("r", F.row_number().over(first)).where(F.col("r") < 2 * k)
    labels = labels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b_comm", "b_size"))).alias("labels"))
    other = F.slice(F.filter("labels", lambda x: ~F.array_contains("own", x["b_comm"])), 1, k - F.size("own"))
    rest = few.join(F.broadcast(labels), list(keys)).select(*keys, "a_comm", "a_size", F.size("own").alias("before"), F.posexplode(other).alias("i", "b"))
    rest = rest.select(*keys, "a_comm", "a_size", "b.b_comm", "b.b_size", F.lit(0).cast("long").alias("common"), F.lit(0.0).alias("jaccard"), (F.col("before") + F.col("i") + 1).alias("rank"))
    return best.unionByName(rest)


def top_matches_wide(a: DataFrame, b: DataFrame, k: int = 3, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """One row for each community of a: b_comm_i, jaccard_i, b_size_i for i up to k, communities without overlap included."""
    wide = best_matches(a, b, k, keys, without_overlap=True).groupBy(*keys, "a_comm", "a_size").pivot("rank", list(range(1, k + 1)))
    out = wide.agg(F.first("b_comm").alias("b_comm"), F.first("jaccard").alias("jaccard"), F.first("b_size").alias("b_size"))
    return out.select(*keys, "a_comm", "a_size", *(F.col(f"{i}_{c}").alias(f"{c}_{i}") for i in range(1, k + 1) for c in ("b_comm", "jaccard", "b_size")))


def match_summary(a: DataFrame, b: DataFrame, top: int = 500, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """Mean, median and maximum of the best Jaccard among the largest communities, both ways; a community without overlap counts 0."""

    def largest(p):
        return p.join(top_communities(p, top, keys).select(*keys, "community"), [*keys, "community"], "left_semi")

    a, b = largest(a), largest(b)

    def one_way(x, y, tag, n):
        best = best_matches(x, y, 1, keys).select(*keys, F.col("a_comm").alias("community"), "jaccard")
        rows = x.select(*keys, "community").distinct().join(best, [*keys, "community"], "left").fillna(0.0, ["jaccard"])
        return rows.groupBy(*keys).agg(F.avg("jaccard").alias(f"mean_jaccard_{tag}"), F.median("jaccard").alias(f"median_jaccard_{tag}"), F.max("jaccard").alias(f"max_jaccard_{tag}"), F.count("*").alias(n))

    return one_way(a, b, "1to2", "n_comms_1").join(one_way(b, a, "2to1", "n_comms_2"), list(keys))


def stability(membership: DataFrame) -> DataFrame:
    """(resolution, nmi_prev): NMI of each resolution's partition with that of the resolution before."""
    steps = membership.select("resolution").distinct().withColumn("before", F.lag("resolution").over(Window.orderBy("resolution")))  # a row for each resolution
    now = membership.join(F.broadcast(steps.where(F.col("before").isNotNull())), "resolution")
    before = membership.select(F.col("resolution").alias("before"), "name", "community")
    return similarity(now.select("before", "name", "community"), before, ("before",)).join(steps, "before").select("resolution", F.col("nmi").alias("nmi_prev"))


def size_stats(membership: DataFrame, keys: Sequence[str] = ("resolution",)) -> DataFrame:
    """Number, mean, median and maximum of community sizes, and the share with ten members or fewer."""
    sizes = membership.groupBy(*keys, "community").agg(F.count("*").alias("size"))
    return sizes.groupBy(*keys).agg(F.count("*").alias("count"), F.avg("size").alias("mean"), F.median("size").alias("median"), F.max("size").alias("max"), F.avg((F.col("size") <= 10).cast("double")).alias("share_small"))


def pair_analysis(a: DataFrame, b: DataFrame, pair: str, min_size: int = 11, keys: Sequence[str] = ("resolution",), users: bool = True) -> DataFrame:
    """Similarity, numbers, mean sizes and Gini of two partitions on their common users, small communities as noise."""
    from .stats import gini

    if users:
        a, b = users_only(a), users_only(b)
    names = a.select(*keys, "name").join(b.select(*keys, "name"), [*keys, "name"], "left_semi")
    a, b = (p.join(names, [*keys, "name"], "left_semi").select(*keys, "name", "community") for p in (a, b))
    if min_size > 1:
        a, b = collapse_small(a, min_size, keys), collapse_small(b, min_size, keys)
    a, b = written(a), written(b)  # read three times each
    out = similarity(a, b, keys)
    for p, tag in ((a, "base"), (b, "aug")):
        sizes = p.groupBy(*keys, "community").agg(F.count("*").cast("double").alias("x"))
        out = out.join(sizes.groupBy(*keys).agg(F.avg("x").alias(f"mean_size_{tag}")), list(keys)).join(gini(sizes, "x", keys).withColumnRenamed("gini", f"gini_{tag}"), list(keys))
    return out.withColumn("pair", F.lit(pair)).withColumnsRenamed({"n_comms_1": "n_comms_base", "n_comms_2": "n_comms_aug"})


def wide(membership: DataFrame, resolutions: Sequence[float]) -> DataFrame:
    """One row per node, one column per resolution; a missing label is the text null."""
    labels = [f"{r:.1f}" for r in resolutions]
    p = membership.withColumn("r", F.format_string("%.1f", "resolution")).groupBy("name", "type").pivot("r", labels).agg(F.first(F.col("community").cast("string")))
    return p.select("name", "type", *(F.coalesce(F.col(f"`{c}`"), F.lit("null")).alias(c) for c in labels))


def long(wide_table: DataFrame) -> DataFrame:
    """The reverse of ``wide``; empty and null labels are left out."""
    labels = [c for c in wide_table.columns if c.replace(".", "", 1).isdigit()]
    out = wide_table.unpivot(["name", "type"], [F.col(f"`{c}`").alias(c) for c in labels], "r", "label")
    out = out.select(F.col("r").cast("double").alias("resolution"), "name", "type", F.expr("try_cast(try_cast(label AS DOUBLE) AS BIGINT)").alias("community"))
    return out.where(F.col("community").isNotNull())
