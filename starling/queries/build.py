"""Queries on building edge lists, maps and tag usages from posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import scalar
from ..operators import edges as E
from ..operators import graph as G
from ..operators import stats, text
from ..plans.checkpoint import new_path
from ..schemas import Relation
from ..sources import readers, sinks
from .registry import query, rounded

P = B.POSTS_SQL
ALL_SQL = f"""{P},
tagged AS (SELECT id, uid, created_at, unnest(string_split(tags, '|')) AS tag FROM posts),
tagpairs AS (
  SELECT a.id, a.created_at, a.tag AS t1, b.tag AS t2 FROM tagged a JOIN tagged b ON a.id = b.id AND a.tag < b.tag
),
raw AS (
  SELECT 0 AS rel, 'u:' || uid AS src, 'u:' || rt_uid AS dst, created_at FROM posts WHERE rt_uid IS NOT NULL
  UNION ALL SELECT 2, 'u:' || uid, 'h:' || tag, created_at FROM tagged
  UNION ALL SELECT 3, 'h:' || t1, 'h:' || t2, created_at FROM tagpairs
  UNION ALL SELECT 3, 'h:' || t2, 'h:' || t1, created_at FROM tagpairs
  UNION ALL SELECT 4, 'u:' || uid, 'u:' || reply_to, created_at FROM posts WHERE reply_to IS NOT NULL
  UNION ALL SELECT 5, 'u:' || uid, 'm:' || mention, created_at FROM posts WHERE mention IS NOT NULL
)"""


#: Rows of a table for each part where a step needs parts of a bounded size.
ROWS_A_PART = 1_000_000


def one_relation(rel: int) -> str:
    return f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, count(*) AS weight FROM raw WHERE rel = {rel} GROUP BY ALL"


@query(one_relation(0))
def edges_retweet(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.RETWEET])


@query(one_relation(4))
def edges_reply(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.RESPONSE])


@query(one_relation(5))
def edges_mention(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.MENTION])


@query(one_relation(2))
def edges_user_tag(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.USER_HASHTAG])


@query(one_relation(3))
def edges_tag_pairs(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.HASHTAG_PAIR])


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, count(*) AS weight FROM raw GROUP BY ALL")
def multigraph(spark, sf):
    return E.edges(B.posts(spark, sf))


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, 2 * count(*) AS weight FROM raw WHERE rel IN (0, 4) GROUP BY ALL")
def merged_graphs(spark, sf):
    p = B.posts(spark, sf)
    both = E.edges(p, [Relation.RETWEET, Relation.RESPONSE])
    return E.merged(both, E.edges(p, [Relation.RETWEET]), E.edges(p, [Relation.RESPONSE]))


@query("""
WITH ranked AS (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL)
SELECT 'h:' || least(a.l_partkey::VARCHAR, b.l_partkey::VARCHAR) AS src, 'h:' || greatest(a.l_partkey::VARCHAR, b.l_partkey::VARCHAR) AS dst, count(*) AS weight
FROM ranked a JOIN ranked b ON a.l_orderkey = b.l_orderkey AND a.l_partkey::VARCHAR < b.l_partkey::VARCHAR GROUP BY ALL
""")
def tag_cooccurrence(spark, sf):
    """Parts bought together, as tags of an order."""
    rows = B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    # Parts of a fixed number of rows: a task's memory does not grow with the table. Pairs stay numbers until they are counted.
    parts = max(1, -(-rows.count() // ROWS_A_PART))
    baskets = rows.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("tags"))
    kind = dict(rows.dtypes)["l_partkey"]
    both = baskets.select(F.explode(scalar.pairs("tags", distinct=True)).alias("p")).select(F.col("p.a").cast(kind).alias("a"), F.col("p.b").cast(kind).alias("b"))
    counted = both.repartition(4 * parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return counted.select(F.concat(F.lit("h:"), F.col("a")).alias("src"), F.concat(F.lit("h:"), F.col("b")).alias("dst"), "weight")


@query(f"WITH {P} SELECT 1 AS rel, 't:' || id AS src, 't:' || rt_id AS dst, epoch_us(created_at) / 1e6 AS t_src, epoch_us(rt_at) / 1e6 AS t_dst FROM posts WHERE rt_id IS NOT NULL")
def tweet_retweet_edges(spark, sf):
    return E.tweet_edges(B.posts(spark, sf))


@query(f"""WITH {P}
SELECT DISTINCT CAST(uid AS VARCHAR) AS original, 'u:' || uid AS node, 0 AS map_type FROM posts
UNION SELECT CAST(rt_uid AS VARCHAR), 'u:' || rt_uid, 1 FROM posts WHERE rt_uid IS NOT NULL
UNION SELECT CAST(id AS VARCHAR), 't:' || id, 2 FROM posts WHERE rt_id IS NOT NULL
UNION SELECT CAST(rt_id AS VARCHAR), 't:' || rt_id, 2 FROM posts WHERE rt_id IS NOT NULL
UNION SELECT t, 'h:' || t, 3 FROM (SELECT unnest(string_split(tags, '|')) AS t FROM posts)
""")
def node_map(spark, sf):
    return E.node_map(B.posts(spark, sf))


@query(f"WITH {ALL_SQL} SELECT DISTINCT name, CASE WHEN name LIKE 'h:%' THEN 'h' ELSE 'u' END AS type FROM (SELECT src AS name FROM raw UNION ALL SELECT dst FROM raw)")
def vertices(spark, sf):
    return E.vertices(E.edges(B.posts(spark, sf)))


@query(f"WITH {P} SELECT 5 AS rel, 'u:' || uid AS src, 'u:' || substr(mention, 5) AS dst, count(*) AS weight FROM posts WHERE mention IS NOT NULL GROUP BY ALL")
def resolved_mentions(spark, sf):
    p = B.posts(spark, sf)
    return E.resolve_mentions(E.edges(p, [Relation.MENTION]), E.screen_names(p))


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, date_trunc('day', created_at) AS bucket, count(*) AS weight FROM raw GROUP BY ALL")
def edges_daily(spark, sf):
    return E.edges(B.posts(spark, sf), method="day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, date_trunc('week', created_at) AS bucket, count(*) AS weight FROM raw GROUP BY ALL")
def edges_weekly(spark, sf):
    return E.edges(B.posts(spark, sf), method="week").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT event_id, strftime(ts, '%G-W%V') AS week, epoch_us(ts) / 1e6 AS seconds FROM events")
def week_label(spark, sf):
    return B.table(spark, sf, "events").select("event_id", scalar.week_label("ts").alias("week"), scalar.epoch("ts").alias("seconds"))


@query("""
SELECT e.user_id, min(e.event_id) AS first_event, arg_min(e.event_type, e.event_id) AS first_type
FROM events e WHERE e.user_id % 3 = 0 GROUP BY e.user_id""")
def first_per_user(spark, sf):
    """Point lookups: the first event of each wanted user."""
    e = B.table(spark, sf, "events")
    wanted = e.where(F.col("user_id") % 3 == 0).select("user_id").distinct()
    first = readers.first_per_key(e, "user_id", F.struct("event_id", "event_type"), "event_id", wanted)
    return first.select(F.col("key").alias("user_id"), F.col("value.event_id").alias("first_event"), F.col("value.event_type").alias("first_type"))


@query("SELECT min(ts) AS first_at, max(ts) AS last_at, CAST(date_diff('day', min(ts)::DATE, max(ts)::DATE) AS BIGINT) AS days, count(*) FILTER (len(string_split(props, ':')) > 1) AS with_props FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")
def range_scan(spark, sf):
    """A range on time, pushed to the scan, and a summary of what it has."""
    from datetime import datetime

    e = B.table(spark, sf, "events").withColumnRenamed("ts", "created_at")
    e = e.where((F.col("created_at") >= F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")))
    return e.agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.datediff(F.max("created_at"), F.min("created_at")).cast("long").alias("days"), F.count_if(F.size(F.split("props", ":")) > 1).alias("with_props"))


@query(f"""WITH {P} SELECT id, CASE WHEN rt_id IS NOT NULL THEN 'by ' || rt_uid ELSE event_type || ' by ' || uid END AS text,
CASE WHEN rt_id IS NOT NULL THEN 'retweet' ELSE 'normal' END AS type FROM posts""")
def conditional_text(spark, sf):
    content, kind = scalar.conditional_text()
    return B.posts(spark, sf).select("id", content.alias("text"), kind.alias("type"))


@query(f"""WITH {P} SELECT uid % 4 AS community, 'u:' || uid AS user, CASE WHEN rt_id IS NOT NULL THEN 'by ' || rt_uid ELSE event_type || ' by ' || uid END AS text,
CASE WHEN rt_id IS NOT NULL THEN 'retweet' ELSE 'normal' END AS type FROM posts WHERE uid % 4 IN (1, 3)""")
def community_texts(spark, sf):
    members = B.graph(B.membership(spark, sf), "R").where(F.col("resolution") == 0.1)
    return text.community_texts(B.posts(spark, sf), members, [1, 3])


@query("""
WITH w AS (SELECT role AS class, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: t <> '')) AS term FROM conversations),
tf AS (SELECT class, term, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY ALL),
a AS (SELECT sum(tf)::DOUBLE / count(DISTINCT class) AS a FROM tf),
s AS (SELECT class, term, tf, round(tf * ln(1 + a / f), 6) AS score FROM tf JOIN f USING (term), a),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY score DESC, term) AS INTEGER) AS rank FROM s)
SELECT class, term, tf, score, rank FROM r WHERE rank <= 10""")
def ctfidf_terms(spark, sf):
    return text.class_terms(B.table(spark, sf, "conversations"), "role")


def mmr_sql(k: int = 5) -> str:
    unit = "list_inner_product(v.x, p.x) / (v.l * p.l)"
    steps = ["s0 AS (SELECT class, id, x, l, near, 0.0::DOUBLE AS worst FROM v)", "c0 AS (SELECT class, id, x, l FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(0.7 * near, 9) DESC, id) AS r FROM s0) WHERE r = 1)"]
    for i in range(1, k):
        worst = unit if i == 1 else f"greatest(v.worst, {unit})"
        steps.append(f"s{i} AS (SELECT v.class, v.id, v.x, v.l, v.near, {worst} AS worst FROM s{i - 1} v JOIN c{i - 1} p ON v.class = p.class WHERE v.id <> p.id)")
        steps.append(f"c{i} AS (SELECT class, id, x, l FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(0.7 * near - 0.3 * worst, 9) DESC, id) AS r FROM s{i}) WHERE r = 1)")
    out = " UNION ALL ".join(f"SELECT class, id, CAST({i + 1} AS INTEGER) AS rank FROM c{i}" for i in range(k))
    return f"""WITH e AS (SELECT label AS class, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT class, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM e), m AS (SELECT class, i, avg(c) AS c FROM u GROUP BY ALL),
z AS (SELECT class, list(c ORDER BY i) AS z FROM m GROUP BY class),
v AS (SELECT class, id, x, sqrt(list_inner_product(x, x)) AS l, list_inner_product(x, z) / sqrt(list_inner_product(x, x) * list_inner_product(z, z)) AS near FROM e JOIN z USING (class)), {", ".join(steps)} {out}"""


@query(mmr_sql())
def mmr_rank(spark, sf):
    return text.diverse(B.table(spark, sf, "embeddings"))


@query(f"""WITH {ALL_SQL}, g AS (SELECT rel, src, dst, count(*) AS weight FROM raw GROUP BY ALL),
d AS (SELECT name, count(*) AS d FROM (SELECT src AS name FROM g WHERE rel IN (0, 2, 4, 5) UNION ALL SELECT dst FROM g WHERE rel IN (0, 4, 5)) GROUP BY ALL),
low AS (SELECT name FROM d WHERE d < 11)
SELECT CAST(rel AS INTEGER) AS rel, src, dst, weight FROM g WHERE src NOT IN (SELECT name FROM low) AND dst NOT IN (SELECT name FROM low)""")
def degree_filter(spark, sf):
    return G.degree_filter(E.edges(B.posts(spark, sf)))


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, count(*) AS weight FROM raw WHERE rel IN (0, 4) AND CAST(substr(src, 3) AS BIGINT) % 2 = 0 AND CAST(substr(dst, 3) AS BIGINT) % 2 = 0 GROUP BY ALL")
def induced_edges(spark, sf):
    g = E.edges(B.posts(spark, sf), [Relation.RETWEET, Relation.RESPONSE])
    members = E.vertices(g).where(F.expr("CAST(substr(name, 3) AS BIGINT) % 2 = 0"))
    return G.induced(g, members).select("rel", "src", "dst", "weight")


@query(f"""WITH {ALL_SQL}, s AS (SELECT strftime(created_at, '%G-W%V') AS slice, src, dst, count(*) AS weight FROM raw WHERE rel IN (0, 2) GROUP BY ALL)
SELECT slice, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY weight DESC, src, dst) AS r FROM s) WHERE r <= 20""")
def top_edges_per_slice(spark, sf):
    from ..operators.temporal import weekly_slices

    g = E.edges(B.posts(spark, sf), [Relation.RETWEET, Relation.USER_HASHTAG], method="week")
    return G.top_edges(weekly_slices(g), 20).select("slice", "src", "dst", "weight")


ENTROPY_SQL = """
usage AS (SELECT 'u:' || c_custkey AS name, CAST(c_nationkey AS BIGINT) AS community, lower(p_brand) AS tag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
t AS (SELECT community, tag, count(*) AS w FROM usage GROUP BY ALL),
s AS (SELECT community, sum(w) AS total, count(*) AS tags, max(w) AS most FROM t GROUP BY ALL),
h AS (SELECT community, -sum(w::DOUBLE / total * log2(w::DOUBLE / total)) AS bits FROM t JOIN s USING (community) GROUP BY ALL),
u AS (SELECT community, count(DISTINCT name) AS n_users FROM usage GROUP BY ALL),
entropy AS (SELECT community, n_users, CAST(total AS BIGINT) AS n_tag_usages, tags AS n_unique_tags, CASE WHEN tags <= 1 THEN 0.0 ELSE greatest(0.0, bits) / log2(tags) END AS entropy, most::DOUBLE / total AS dominant_share FROM s JOIN h USING (community) JOIN u USING (community))"""


@query(f"WITH {ENTROPY_SQL} SELECT community, n_users, n_tag_usages, n_unique_tags, round(entropy, 6) AS entropy, round(dominant_share, 6) AS dominant_share FROM entropy")
def tag_entropy(spark, sf):
    return rounded(stats.tag_entropy(B.order_tags(spark, sf)), "entropy", "dominant_share")


@query("""
SELECT l_returnflag AS tag, count(*) AS n, round(sum(CASE WHEN regexp_matches(l_linestatus, '(?i)o|x') THEN l_quantity ELSE 0 END), 6) AS matching FROM lineitem GROUP BY ALL""")
def keyword_sum(spark, sf):
    hit = scalar.keyword_match("l_linestatus", ["o", "x"])
    return rounded(B.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"), F.sum(F.when(hit, F.col("l_quantity")).otherwise(0.0)).alias("matching")), "matching")


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, count(*) AS weight FROM raw GROUP BY ALL")
def edge_file_round_trip(spark, sf):
    """All relations written as headerless CSV and read by the tolerant edge reader."""
    path = new_path(spark, "edges")
    sinks.append_csv(E.edges(B.posts(spark, sf)), path)
    return readers.edge_file(spark, path)


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, count(*) AS weight FROM raw WHERE rel = 2 GROUP BY ALL")
def relation_partitions(spark, sf):
    """Edges stored in a folder for each relation; reading one relation opens only its folder."""
    path = new_path(spark, "relations")
    sinks.by_relation(E.edges(B.posts(spark, sf)), path)
    return spark.read.parquet(path).where(F.col("rel") == 2).select("rel", "src", "dst", "weight")


@query(f"WITH {B.MEMBERSHIP_SQL} SELECT resolution, name, type, community FROM membership WHERE graph = 'R'")
def partition_file_round_trip(spark, sf):
    path = new_path(spark, "partition")
    sinks.partition_table(B.graph(B.membership(spark, sf), "R"), [i / 10 for i in B.STEPS], path)
    return readers.partition_file(spark, path)


@query(f"WITH {P} SELECT DISTINCT 'h:' || t AS tag, t AS tag_text FROM (SELECT unnest(string_split(tags, '|')) AS t FROM posts)")
def tag_dictionary(spark, sf):
    path = new_path(spark, "map")
    sinks.append_csv(E.node_map(B.posts(spark, sf)), path)
    return readers.tag_dictionary(spark, path)


@query("SELECT min(event_id) AS low, max(event_id) AS high, CAST(count(DISTINCT event_id // 1000) AS BIGINT) AS chunks FROM events")
def id_chunks(spark, sf):
    e = B.table(spark, sf, "events")
    return readers.id_chunks(e, "event_id", 1000).agg(F.min("start").alias("low"), (F.max("end") - 1).alias("high"), F.count("*").alias("chunks"))


@query(f"WITH {P} SELECT id, event_type || ' by ' || uid AS text FROM posts ORDER BY md5('42:' || id), id LIMIT 100")
def sampled_posts(spark, sf):
    """A seeded sample of exactly 100 posts."""
    return readers.sample(B.posts(spark, sf), 100, key="id").select("id", "text")


@query(f"""WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst,
  CAST(timezone('UTC', timezone('Europe/Rome', date_trunc('week', timezone('Europe/Rome', timezone('UTC', created_at))))) AS TIMESTAMP) AS bucket, count(*) AS weight FROM raw GROUP BY ALL""")
def edges_weekly_rome(spark, sf):
    """Weeks that begin on Mondays in Rome, as instants."""
    return E.edges(B.posts(spark, sf), method="week", zone="Europe/Rome").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, CAST(timezone('UTC', timezone('Europe/Rome', date_trunc('day', timezone('Europe/Rome', timezone('UTC', created_at))))) AS TIMESTAMP) AS bucket, count(*) AS weight FROM raw GROUP BY ALL")
def edges_daily_rome(spark, sf):
    return E.edges(B.posts(spark, sf), method="day", zone="Europe/Rome").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"""WITH {P}, rows AS (
SELECT CAST(uid AS VARCHAR) AS original, 'u:' || uid AS node, 0 AS map_type FROM posts
UNION ALL SELECT CAST(rt_uid AS VARCHAR), 'u:' || rt_uid, 1 FROM posts WHERE rt_uid IS NOT NULL
UNION ALL SELECT CAST(id AS VARCHAR), 't:' || id, 2 FROM posts WHERE rt_id IS NOT NULL
UNION ALL SELECT CAST(rt_id AS VARCHAR), 't:' || rt_id, 2 FROM posts WHERE rt_id IS NOT NULL
UNION ALL SELECT t, 'h:' || t, 3 FROM (SELECT unnest(string_split(tags, '|')) AS t FROM posts))
SELECT original, node, map_type, count(*) AS weight FROM rows GROUP BY ALL""")
def counted_node_map(spark, sf):
    return E.node_map(B.posts(spark, sf), counted=True)


@query(f"""WITH {P}, {B.MEMBERSHIP_SQL}, n AS (SELECT DISTINCT 'u:' || uid AS node, CAST(uid AS VARCHAR) AS original FROM posts)
SELECT m.resolution, m.community, m.name, n.original FROM membership m JOIN n ON m.name = n.node WHERE m.graph = 'R' AND round(m.resolution * 10) IN (1, 5)""")
def labelled_originals(spark, sf):
    """Communities joined to the node map: what each member was called before."""
    members = B.graph(B.membership(spark, sf), "R").where(F.col("resolution").isin(0.1, 0.5))
    return text.with_originals(members, E.node_map(B.posts(spark, sf))).select("resolution", "community", "name", "original")


@query(f"WITH {ALL_SQL}, g AS (SELECT src, dst, count(*) AS weight FROM raw WHERE rel = 0 GROUP BY ALL), v AS (SELECT name FROM (SELECT src AS name FROM g UNION SELECT dst FROM g) ORDER BY name LIMIT 100) SELECT src, dst, weight FROM g WHERE src IN (SELECT name FROM v) AND dst IN (SELECT name FROM v)")
def first_vertices(spark, sf):
    """The subgraph of the first hundred nodes by name."""
    return G.first_vertices(E.edges(B.posts(spark, sf), [Relation.RETWEET]).select("src", "dst", "weight"), 100)


@query(f"WITH {ALL_SQL} SELECT CAST(rel AS INTEGER) AS rel, src, dst, count(*) AS weight FROM raw WHERE rel IN (0, 4) GROUP BY ALL")
def csv_rows_round_trip(spark, sf):
    """Edges in a stamped CSV with a header, read by schema."""
    folder = new_path(spark, "stamped")
    path = sinks.stamped(E.edges(B.posts(spark, sf), [Relation.RETWEET, Relation.RESPONSE]), folder, "edges")
    return readers.csv_rows(spark, path, "rel int, src string, dst string, weight long", header=True)


@query(f"WITH {ALL_SQL}, g AS (SELECT rel, src, dst, count(*) AS weight FROM raw GROUP BY ALL) SELECT CASE WHEN src LIKE 'h:%' THEN 'h' ELSE 'u' END AS type, count(DISTINCT src) AS n_sources, CAST(sum(weight) AS BIGINT) AS weight FROM g GROUP BY ALL")
def snapshot_round_trip(spark, sf):
    """Vertices and edges as a snapshot; the edges of each kind of node, read from it."""
    path = new_path(spark, "snapshot")
    e = E.edges(B.posts(spark, sf))
    sinks.snapshot(E.vertices(e), e, path)
    v, e = readers.snapshot(spark, path)
    return e.join(v, e["src"] == v["name"]).groupBy("type").agg(F.countDistinct("src").alias("n_sources"), F.sum("weight").alias("weight"))


@query(f"WITH {P} SELECT id, uid AS user_id, created_at, rt_id FROM posts")
def ejson_round_trip(spark, sf):
    """Posts written as extended JSON, with their times as {{"$date": ...}}, and read back."""
    path = new_path(spark, "ejson")
    stamp = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("$date"))
    p = B.posts(spark, sf).select("id", stamp("created_at").alias("created_at"), "text", "user", F.when(F.col("retweeted_status").isNotNull(), F.struct(F.col("retweeted_status.id").alias("id"), stamp("retweeted_status.created_at").alias("created_at"))).alias("retweeted_status"))
    p.write.json(path)
    return readers.ejson_posts(spark, path).select("id", F.col("user.id").alias("user_id"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("retweeted_status.id").alias("rt_id"))


@query("""SELECT o_orderkey AS id, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS day, strptime(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') AS instant,
'0.' || (o_orderkey % 10) AS resolution, CAST(o_custkey AS VARCHAR) AS community FROM orders""")
def parsed_texts(spark, sf):
    """Days, instants and report names read from texts."""
    o = B.table(spark, sf, "orders")
    day, instant = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.concat(F.lit("out/candidate_res0."), F.col("o_orderkey") % 10, F.lit("_comm"), F.col("o_custkey"), F.lit(".csv"))
    resolution, community = scalar.report_name(name)
    return o.select(F.col("o_orderkey").alias("id"), scalar.parse_day(day).cast("timestamp_ntz").alias("day"), scalar.parse_instant(instant).cast("timestamp_ntz").alias("instant"), resolution.alias("resolution"), community.alias("community"))
