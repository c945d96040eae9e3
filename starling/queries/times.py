"""Queries on partitions over time and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.scalar import week_label
from ..operators import community as C
from ..operators import edges as E
from ..operators import temporal as T
from ..schemas import Relation
from .build import ALL_SQL, P
from .registry import query, rounded

#: A label per user and week, bound to the week's first event.
WEEKLY_SQL = "wk AS (SELECT 'u:' || user_id AS name, strftime(ts, '%G-W%V') AS slice, CAST(min(event_id) % 3 AS BIGINT) AS community FROM events GROUP BY ALL)"


def weekly(spark, sf):
    e = B.table(spark, sf, "events").select(F.concat(F.lit("u:"), F.col("user_id")).alias("name"), week_label("ts").alias("slice"), "event_id")
    return e.groupBy("name", "slice").agg((F.min("event_id") % 3).cast("long").alias("community"))


@query(f"""WITH {WEEKLY_SQL}, o AS (SELECT slice, row_number() OVER (ORDER BY slice) AS i FROM (SELECT DISTINCT slice FROM wk)),
x AS (SELECT wk.*, i, i - row_number() OVER (PARTITION BY name, community ORDER BY i) AS run FROM wk JOIN o USING (slice))
SELECT name, slice, community, CAST(row_number() OVER (PARTITION BY name, community, run ORDER BY i) AS INTEGER) AS tenure FROM x""")
def tenure(spark, sf):
    return T.tenure(weekly(spark, sf))


@query(f"""WITH {B.MEMBERSHIP_SQL}, p AS (SELECT name, community AS label FROM membership WHERE graph = 'R' AND round(resolution * 10) = 1), c AS (SELECT name, community FROM membership WHERE graph = 'P' AND round(resolution * 10) = 4),
ov AS (SELECT community, label, count(*) AS n FROM c JOIN p USING (name) GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, label) AS r FROM ov),
g AS (SELECT community, label, row_number() OVER (PARTITION BY label ORDER BY n DESC, community) AS r FROM a WHERE r = 1), k AS (SELECT d.community, g.label FROM (SELECT DISTINCT community FROM c) d LEFT JOIN (SELECT * FROM g WHERE r = 1) g USING (community)),
l AS (SELECT max(label) AS last FROM p)
SELECT community, CAST(coalesce(label, last + row_number() OVER (PARTITION BY label IS NULL ORDER BY community)) AS BIGINT) AS label FROM k, l""")
def label_overlap(spark, sf):
    m = B.membership(spark, sf)
    before = B.graph(m, "R").where(F.col("resolution") == 0.1).select("name", "community")
    now = B.graph(m, "P").where(F.col("resolution") == 0.4).select("name", "community")
    return T.inherit_labels(before, now)


@query(f"""WITH {ALL_SQL}, g AS (SELECT src, dst, count(*) AS weight FROM raw WHERE rel = 0 GROUP BY ALL),
pv AS (SELECT DISTINCT 'u:' || user_id AS name, user_id % 4 AS community, CAST(user_id % 6 + 1 AS BIGINT) AS tenure FROM events)
SELECT src, dst, round(weight + b, 6) AS weight, round(b, 6) AS bonus FROM (SELECT g.*, CASE WHEN a.community = b.community THEN least(0.1 * (1 + least(a.tenure, b.tenure)), 0.5) ELSE 0 END AS b FROM g LEFT JOIN pv a ON src = a.name LEFT JOIN pv b ON dst = b.name)""")
def temporal_bonus(spark, sf):
    g = E.edges(B.posts(spark, sf), [Relation.RETWEET]).select("src", "dst", "weight")
    before = B.table(spark, sf, "events").select(F.concat(F.lit("u:"), F.col("user_id")).alias("name"), (F.col("user_id") % 4).alias("community"), (F.col("user_id") % 6 + 1).alias("tenure")).distinct()
    return rounded(T.with_bonus(g, before, 0.1, 0.5), "weight", "bonus")


@query(f"WITH {ALL_SQL} SELECT strftime(created_at, '%G-W%V') AS slice, src, dst, count(*) AS weight FROM raw WHERE rel IN (0, 4) GROUP BY ALL")
def weekly_slices(spark, sf):
    return T.weekly_slices(E.edges(B.posts(spark, sf), [Relation.RETWEET, Relation.RESPONSE], method="week"))


@query(f"""WITH {ALL_SQL}, d AS (SELECT created_at::DATE AS slice, rel, src, dst, count(*) AS weight FROM raw WHERE rel = 0 GROUP BY ALL), f AS (SELECT slice FROM (SELECT DISTINCT slice FROM d) ORDER BY slice LIMIT 5)
SELECT CAST(slice AS VARCHAR) AS slice, src, dst, weight FROM d WHERE slice IN (SELECT slice FROM f)""")
def first_active_days(spark, sf):
    return T.daily_slices(E.edges(B.posts(spark, sf), [Relation.RETWEET], method="day"), 5).withColumn("slice", F.col("slice").cast("string"))


@query(f"WITH {WEEKLY_SQL} SELECT name, len(list(slice)) AS n_slices, min(slice) AS first_slice, arg_min(community, slice) AS first_label FROM wk GROUP BY ALL")
def date_maps(spark, sf):
    m = T.date_maps(weekly(spark, sf))
    keys = F.map_keys("labels")
    return m.select("name", F.size("labels").cast("long").alias("n_slices"), F.array_min(keys).alias("first_slice"), F.col("labels")[F.array_min(keys)].alias("first_label"))


@query(f"WITH {P} SELECT 0 AS rel, 'u:' || uid AS src, 'u:' || rt_uid AS dst, date_trunc('week', created_at) AS bucket, count(*) AS weight FROM posts WHERE rt_uid IS NOT NULL GROUP BY ALL")
def streaming_edges(spark, sf):
    """The weekly edges by a stream over the bound posts: each week is appended to files once the watermark has passed it."""
    from ..plans.checkpoint import new_path
    from ..streaming.edges import drained

    source, out = new_path(spark, "posts"), new_path(spark, "weeks")
    rows = B.posts(spark, sf)
    rows.write.parquet(source)
    # A post without edges, long after all others, closes the last week.
    last = rows.agg(F.max("created_at").alias("t"))
    end = last.select(*(((F.col("t") + F.expr("INTERVAL 60 DAYS")) if f.name == "created_at" else F.lit(-1 if f.name == "in_reply_to_user_id" else None)).cast(f.dataType).alias(f.name) for f in rows.schema))
    end.write.mode("append").parquet(source)
    return drained(spark.readStream.schema(rows.schema).parquet(source), out, "week", [Relation.RETWEET], delay="7 days").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query()
def leiden_incremental(spark, sf):
    g = E.edges(B.posts(spark, sf), [Relation.RETWEET, Relation.RESPONSE], method="week")
    return C.incremental(T.weekly_slices(g), 0.3, 0.05, 0.5)


@query(f"WITH {WEEKLY_SQL}, f AS (SELECT min(slice) AS s FROM wk) SELECT name, slice, CASE WHEN slice = s THEN community + 10 ELSE community END AS community FROM wk, f")
def slices_round_trip(spark, sf):
    """Labels stored by slice; a rerun of the first one replaces it and no other."""
    from ..plans.checkpoint import new_path
    from ..sources import sinks

    path, own = new_path(spark, "slices"), weekly(spark, sf)
    sinks.slices(own, path)
    first = own.agg(F.min("slice").alias("slice"))
    sinks.slices(own.join(F.broadcast(first), "slice", "left_semi").withColumn("community", F.col("community") + 10), path)
    return spark.read.schema("name string, community long, slice string").parquet(path).select("name", "slice", "community")


def per_slice_sql(relations: str) -> str:
    return f"""WITH {ALL_SQL}, g AS (SELECT strftime(created_at, '%G-W%V') AS slice, src, dst FROM raw WHERE rel IN ({relations})), v AS (SELECT slice, src AS name FROM g UNION SELECT slice, dst FROM g)
SELECT slice, count(*) AS n_rows, count(*) AS n_nodes FROM v GROUP BY slice"""


@query(per_slice_sql("0, 4"))
def leiden_incremental_nodes(spark, sf):
    """Each node of a slice has one label in it."""
    return leiden_incremental(spark, sf).groupBy("slice").agg(F.count("*").alias("n_rows"), F.countDistinct("name").alias("n_nodes"))


@query(per_slice_sql("0"))
def leiden_multislice_nodes(spark, sf):
    return leiden_multislice(spark, sf).groupBy("slice").agg(F.count("*").alias("n_rows"), F.countDistinct("name").alias("n_nodes"))


@query()
def leiden_multislice(spark, sf):
    g = E.edges(B.posts(spark, sf), [Relation.RETWEET], method="week")
    return C.multislice(T.weekly_slices(g), [0.5])
