"""Partitions over time: slices, label inheritance, tenure and the bonus for staying together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import week_label


def weekly_slices(edges: DataFrame, zone: str = "UTC") -> DataFrame:
    """(slice, src, dst, weight): bucketed edges summed by the ISO week of their bucket, read in the bucket's zone."""
    return edges.groupBy(week_label("bucket", zone).alias("slice"), "src", "dst").agg(F.sum("weight").alias("weight"))


def daily_slices(edges: DataFrame, first_days: int | None = None, zone: str = "UTC") -> DataFrame:
    """(slice, src, dst, weight) by day, rows as they are; only the first active days if a number is given."""
    day = F.to_date(F.from_utc_timestamp("bucket", zone) if zone != "UTC" else F.col("bucket"))
    out = edges.withColumn("slice", day)
    if first_days is None:
        return out.select("slice", "src", "dst", "weight")
    days = out.select("slice").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("slice")))  # a row for each day
    return out.join(F.broadcast(days.where(F.col("n") <= first_days).select("slice")), "slice", "left_semi").select("slice", "src", "dst", "weight")


def inherit_labels(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, community, label): new names for current communities.

    Each takes the label of the previous community it shares most nodes with
    (ties: the smaller label); of several that ask for one label the one with
    the largest overlap gets it (ties: the smaller community). The others are
    numbered from the largest previous label on, in the order of their names.
    """
    p = previous.select(*keys, "name", F.col("community").alias("label"))
    c = current.select(*keys, "name", "community")
    both = c.join(p, [*keys, "name"]).groupBy(*keys, "community", "label").agg(F.count("*").alias("n"))
    asks = both.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "community").orderBy(F.desc("n"), "label"))).where(F.col("r") == 1)
    gets = asks.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "label").orderBy(F.desc("n"), "community"))).where(F.col("r") == 1).select(*keys, "community", "label")
    every = c.select(*keys, "community").distinct().join(gets, [*keys, "community"], "left")
    last = p.groupBy(*keys).agg(F.max("label").alias("last")) if keys else p.agg(F.max("label").alias("last"))
    every = every.join(last, list(keys), "left") if keys else every.withColumn("one", F.lit(1)).join(F.broadcast(last.withColumn("one", F.lit(1))), "one")
    fresh = F.row_number().over(Window.partitionBy(*keys, F.col("label").isNull()).orderBy("community"))
    return every.select(*keys, "community", F.coalesce("label", F.coalesce("last", F.lit(-1)) + fresh).alias("label"))


def tenure(membership: DataFrame) -> DataFrame:
    """(name, slice, community, tenure): how many slices in a row a node has kept its label; a slice without it starts anew."""
    order = membership.select("slice").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("slice")))  # a row for each slice
    m = membership.select("name", "slice", "community").join(F.broadcast(order), "slice")
    run = F.col("i") - F.row_number().over(Window.partitionBy("name", "community").orderBy("i"))
    m = m.withColumn("run", run)
    return m.select("name", "slice", "community", F.row_number().over(Window.partitionBy("name", "community", "run").orderBy("i")).alias("tenure"))


def with_bonus(edges: DataFrame, previous: DataFrame, lam: float = 0.1, cap: float = 1.0) -> DataFrame:
    """Edges whose ends were in one community before weigh min(lam * (1 + shorter tenure), cap) more. previous: (name, community, tenure)."""
    end = lambda name, i: previous.select(F.col("name").alias(name), F.col("community").alias(f"c{i}"), F.col("tenure").alias(f"t{i}"))
    j = edges.join(end("src", 1), "src", "left").join(end("dst", 2), "dst", "left")
    bonus = F.when(F.col("c1") == F.col("c2"), F.least(lam * (1 + F.least("t1", "t2")), F.lit(cap))).otherwise(0.0)
    return j.withColumn("bonus", bonus).withColumn("weight", F.col("weight") + F.col("bonus")).select(*edges.columns, "bonus")


def date_maps(membership: DataFrame) -> DataFrame:
    """(name, labels): a map from slice to label for each node; as long as the number of slices."""
    return membership.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slice", "community")))).alias("labels"))
