"""Edge lists and label tenure on streams; results equal those of the batch plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edges import SUMMED, labelled
from ..schemas import Relation

#: Weeks begin on Mondays; windows count from Thursday 1970-01-01.
WEEK_START = "4 days"


def bucketed(posts: DataFrame, method: str = "week", relations=SUMMED, delay: str = "1 day", **options) -> DataFrame:
    """(rel, src, dst, bucket, weight) by UTC day or week; posts later than the delay are dropped, as the watermark says."""
    if method not in ("day", "week"):
        raise ValueError(f"unsupported bucket {method!r}: day or week")
    arrays = [labelled(Relation(r), **options) for r in relations]
    rows = posts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    rows = rows.select("created_at", F.explode(F.concat(*arrays)).alias("e"))
    span = F.window("created_at", "1 week", "1 week", WEEK_START) if method == "week" else F.window("created_at", "1 day")
    out = rows.groupBy(span.alias("w"), "e.rel", "e.src", "e.dst").agg(F.count("*").alias("weight"))
    return out.select("rel", "src", "dst", F.col("w.start").alias("bucket"), "weight")


def drained(posts: DataFrame, path: str, method: str = "week", relations=SUMMED, delay: str = "1 day", **options) -> DataFrame:
    """All that a stream of posts has now, appended to files under path (with its checkpoint beside them) and read back; buckets that the watermark has not passed wait in the state for the next run."""
    rows = bucketed(posts, method, relations, delay, **options)
    rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/edges").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return posts.sparkSession.read.schema(rows.schema).parquet(f"{path}/edges")


def tenure_stream(membership: DataFrame) -> DataFrame:
    """(name, slice, community, tenure) for a stream of (name, slice long, community): labels kept over slices in a row; state is one row per node."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, label, kept = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("slice")
        out = []
        for s, c in zip(rows["slice"], rows["community"], strict=True):
            kept = kept + 1 if label == c and last is not None and s == last + 1 else 1
            last, label = int(s), int(c)
            out.append((key[0], last, label, kept))
        state.update((last, label, kept))
        yield pd.DataFrame(out, columns=["name", "slice", "community", "tenure"])

    return membership.groupBy("name").applyInPandasWithState(step, "name string, slice long, community long, tenure int", "last long, label long, kept int", "append", GroupStateTimeout.NoTimeout)
