"""Writers: edge lists by relation, partitions, snapshots, slices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


def by_relation(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per relation, so that a reader of one relation opens no other."""
    edges.write.mode(mode).partitionBy("rel").parquet(path)


def partition_table(membership: DataFrame, resolutions: list[float], path: str) -> None:
    """Wide CSV with header: name, type, a column per resolution; missing labels as null text."""
    from ..operators.partition import wide

    wide(membership, resolutions).write.mode("overwrite").option("header", True).csv(path)


def snapshot(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    vertices.write.mode(mode).parquet(f"{path}/vertices")
    edges.write.mode(mode).parquet(f"{path}/edges")


def slices(membership: DataFrame, path: str) -> None:
    """Partitioned by slice; a rerun replaces the slices it has and no others."""
    membership.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)


def stamped(df: DataFrame, folder: str, name: str, fmt: str = "csv", now: datetime | None = None) -> str:
    """Write to <folder>/<name>_<time> and return the path."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    path = f"{folder}/{name}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    writer = df.write
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return path


def with_default(df: DataFrame, default: str = "null") -> DataFrame:
    """All columns as text, nulls as the default word."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(default)).alias(c) for c in df.columns))
