"""Test tables read as posts, memberships and tag usages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Resolutions of the bound partitions: i / 10, with 3 + i communities.
STEPS = range(1, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as posts: a view repeats the event before it, a click replies to its user, a purchase mentions them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    p = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
    j = e.join(p, "event_id", "left")
    prev = F.col("p_user").isNotNull()
    user = lambda c: F.struct(F.col(c).alias("id"), F.concat(F.lit("User"), F.col(c)).alias("screen_name"))
    return j.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat("event_type", F.lit(" by "), "user_id").alias("text"),
        user("user_id").alias("user"),
        F.concat("event_type", F.lit("|K"), F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("hashtagEntities"),
        F.when((F.col("event_type") == "click") & prev, F.col("p_user")).otherwise(F.lit(-1)).alias("in_reply_to_user_id"),
        F.when((F.col("event_type") == "purchase") & prev, F.concat(F.lit("User"), F.col("p_user"))).alias("userMentionEntities"),
        F.when((F.col("event_type") == "view") & prev, F.struct((F.col("event_id") - 1).alias("id"), user("p_user").alias("user"), F.col("p_ts").alias("created_at"), F.concat(F.lit("by "), F.col("p_user")).alias("text"))).alias("retweeted_status"),
    )


POSTS_SQL = """
posts AS (
  SELECT e.event_id AS id, e.user_id AS uid, e.ts AS created_at, e.event_type,
         lower(e.event_type || '|K' || regexp_extract(e.props, '"k": *([0-9]+)', 1)) AS tags,
         CASE WHEN e.event_type = 'view' THEN p.event_id END AS rt_id, CASE WHEN e.event_type = 'view' THEN p.user_id END AS rt_uid,
         CASE WHEN e.event_type = 'view' THEN p.ts END AS rt_at, CASE WHEN e.event_type = 'click' THEN p.user_id END AS reply_to,
         CASE WHEN e.event_type = 'purchase' THEN lower('User' || p.user_id) END AS mention
  FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 1
)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions (graphs R and P) of the users of events, and R+H with tag nodes, over ten resolutions."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    tags = table(spark, sf_dir, "events").select(F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long").alias("k")).distinct()
    res = (F.col("i") / 10).alias("resolution")
    m = F.col("i") + 3
    # Ten rows, a fixed number.
    u = users.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)).cast("array<bigint>")))
    t = tags.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)).cast("array<bigint>")))
    name = F.concat(F.lit("u:"), F.col("user_id")).alias("name")
    row = lambda g, c, n=name, k="u": (F.lit(g).alias("graph"), res, n, F.lit(k).alias("type"), c.cast("long").alias("community"))
    a = u.select(*row("R", F.col("user_id") % m))
    b = u.select(*row("P", F.floor(F.col("user_id") / 7) % m))
    h = u.select(*row("R+H", F.when(F.col("user_id") % 5 == 0, (F.col("user_id") + 1) % m).otherwise(F.col("user_id") % m)))
    th = t.select(*row("R+H", F.col("k") % m, F.concat(F.lit("h:k"), F.col("k")).alias("name"), "h"))
    return a.unionByName(b).unionByName(h).unionByName(th)


MEMBERSHIP_SQL = """
steps AS (SELECT i, i / 10.0::DOUBLE AS resolution, i + 3 AS m FROM (SELECT unnest(range(1, 11)) AS i)),
users AS (SELECT DISTINCT user_id FROM events),
ks AS (SELECT DISTINCT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
membership AS (
  SELECT 'R' AS graph, resolution, 'u:' || user_id AS name, 'u' AS type, user_id % m AS community FROM users, steps
  UNION ALL SELECT 'P', resolution, 'u:' || user_id, 'u', (user_id // 7) % m FROM users, steps
  UNION ALL SELECT 'R+H', resolution, 'u:' || user_id, 'u', CASE WHEN user_id % 5 = 0 THEN (user_id + 1) % m ELSE user_id % m END FROM users, steps
  UNION ALL SELECT 'R+H', resolution, 'h:k' || k, 'h', k % m FROM ks, steps
)"""


def graph(membership: DataFrame, name: str) -> DataFrame:
    return membership.where(F.col("graph") == name).drop("graph")


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, community, tag, weight): customers of a nation use the brands they buy."""
    c, o, li, p = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.concat(F.lit("u:"), F.col("c_custkey")).alias("name"), F.col("c_nationkey").cast("long").alias("community"), F.lower("p_brand").alias("tag"), F.lit(1).cast("long").alias("weight"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): customers to suppliers by line."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.groupBy(F.concat(F.lit("c:"), F.col("o_custkey")).alias("src"), F.concat(F.lit("s:"), F.col("l_suppkey")).alias("dst")).agg(F.count("*").alias("weight"))


def trade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, community): the nation of each customer and supplier."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("name"), F.col("c_nationkey").cast("long").alias("community")).unionByName(
        s.select(F.concat(F.lit("s:"), F.col("s_suppkey")).alias("name"), F.col("s_nationkey").cast("long").alias("community"))
    )


TRADE_SQL = """
tedges AS (
  SELECT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), tlabels AS (
  SELECT 'c:' || c_custkey AS name, CAST(c_nationkey AS BIGINT) AS community FROM customer
  UNION ALL SELECT 's:' || s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier
)"""
