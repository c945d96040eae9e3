"""Queries on comparing partitions, community statistics and the candidate filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import edges as E
from ..operators import funnel, partition, stats
from ..plans.checkpoint import written
from ..schemas import Relation
from .build import ALL_SQL, ENTROPY_SQL
from .registry import query, rounded

M = B.MEMBERSHIP_SQL


def users(spark, sf, name):
    return B.graph(B.membership(spark, sf), name)


@query(f"""WITH {M}, s AS (SELECT graph, resolution, community, count(*) AS n FROM membership GROUP BY ALL)
SELECT graph, resolution, count(*) AS count, round(avg(n), 6) AS mean, round(median(n), 6) AS median, max(n) AS max, round(avg(CASE WHEN n <= 10 THEN 1.0 ELSE 0.0 END), 6) AS share_small FROM s GROUP BY ALL""")
def size_stats(spark, sf):
    return rounded(partition.size_stats(B.membership(spark, sf), ("graph", "resolution")), "mean", "median", "share_small")


@query("""WITH s AS (SELECT c_nationkey AS community, count(*) AS size FROM customer GROUP BY ALL)
SELECT size, row_number() OVER (ORDER BY size) AS rank, round(row_number() OVER (ORDER BY size)::DOUBLE / count(*) OVER (), 6) AS cdf FROM s""")
def size_cdf(spark, sf):
    sizes = B.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size"))
    return rounded(stats.size_cdf(sizes, "size"), "cdf")


@query("""WITH s AS (SELECT c_custkey, CAST(c_nationkey * 5 + c_custkey % 7 AS BIGINT) AS community FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY community) AS size FROM s)
SELECT 1 AS resolution, 'u:' || c_custkey AS name, CASE WHEN size < 10 THEN -1 ELSE community END AS community FROM n""")
def collapse_small(spark, sf):
    m = B.table(spark, sf, "customer").select(F.lit(1).alias("resolution"), F.concat(F.lit("u:"), F.col("c_custkey")).alias("name"), (F.col("c_nationkey") * 5 + F.col("c_custkey") % 7).cast("long").alias("community"))
    return partition.collapse_small(m, 10).select("resolution", "name", "community")


@query(f"""WITH {M}, s AS (SELECT resolution, community, count(*) AS size FROM membership WHERE graph = 'R' GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY resolution ORDER BY size DESC, community) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def topk_communities(spark, sf):
    return partition.top_communities(users(spark, sf, "R"), 3)


def similarity_sql(a: str, b: str, keys: str = "resolution") -> str:
    return f"""
cont AS (SELECT {keys}, a.community AS l1, b.community AS l2, count(*) AS n FROM {a} a JOIN {b} b USING ({keys}, name) GROUP BY ALL),
r1 AS (SELECT {keys}, l1, sum(n) AS n1 FROM cont GROUP BY ALL), r2 AS (SELECT {keys}, l2, sum(n) AS n2 FROM cont GROUP BY ALL),
tot AS (SELECT {keys}, sum(n) AS total FROM cont GROUP BY ALL),
mi AS (SELECT {keys}, sum(n::DOUBLE / total * ln(n::DOUBLE * total::DOUBLE / (n1::DOUBLE * n2::DOUBLE))) AS mi, sum(n::DOUBLE * (n - 1) / 2) AS s, max(total) AS total FROM cont JOIN r1 USING ({keys}, l1) JOIN r2 USING ({keys}, l2) JOIN tot USING ({keys}) GROUP BY ALL),
e1 AS (SELECT {keys}, -sum(n1::DOUBLE / total * ln(n1::DOUBLE / total)) AS h1, sum(n1::DOUBLE * (n1::DOUBLE - 1) / 2) AS s1, count(*) AS k1 FROM r1 JOIN tot USING ({keys}) GROUP BY ALL),
e2 AS (SELECT {keys}, -sum(n2::DOUBLE / total * ln(n2::DOUBLE / total)) AS h2, sum(n2::DOUBLE * (n2::DOUBLE - 1) / 2) AS s2, count(*) AS k2 FROM r2 JOIN tot USING ({keys}) GROUP BY ALL),
sim AS (SELECT {keys}, CAST(total AS BIGINT) AS n_common, k1 AS n_comms_1, k2 AS n_comms_2,
  CASE WHEN h1 + h2 = 0 THEN 1.0 ELSE 2 * mi / (h1 + h2) END AS nmi,
  CASE WHEN (s1 + s2) / 2 = s1 * s2 / (total::DOUBLE * (total::DOUBLE - 1) / 2) THEN 1.0 ELSE (s - s1 * s2 / (total::DOUBLE * (total::DOUBLE - 1) / 2)) / ((s1 + s2) / 2 - s1 * s2 / (total::DOUBLE * (total::DOUBLE - 1) / 2)) END AS ari,
  greatest(0.0, h1 + h2 - 2 * mi) AS vi_nats, greatest(0.0, (h1 + h2 - 2 * mi) / ln(2)) AS vi_bits, (h1 + h2) / ln(2) - 2 * mi AS vi_mixed
  FROM mi JOIN e1 USING ({keys}) JOIN e2 USING ({keys}))"""


SIM_COLUMNS = "n_common, n_comms_1, n_comms_2, round(nmi, 6) AS nmi, round(ari, 6) AS ari, round(vi_nats, 6) AS vi_nats, round(vi_bits, 6) AS vi_bits, round(vi_mixed, 6) AS vi_mixed"
SIDES = "pa AS (SELECT * FROM membership WHERE graph = 'R'), pb AS (SELECT * FROM membership WHERE graph = 'P')"
SIM_NAMES = ("nmi", "ari", "vi_nats", "vi_bits", "vi_mixed")


@query(f"WITH {M}, {SIDES}, {similarity_sql('pa', 'pb')} SELECT resolution, {SIM_COLUMNS} FROM sim")
def nmi_ari_vi(spark, sf):
    return rounded(partition.similarity(users(spark, sf, "R"), users(spark, sf, "P")), *SIM_NAMES)


@query(f"""WITH {M}, pa AS (SELECT resolution AS r0, name, community FROM membership WHERE graph = 'R'),
x AS (SELECT a.r0 AS resolution, a.name, b.community FROM pa a JOIN pa b ON a.name = b.name AND round(a.r0 * 10) = round(b.r0 * 10) + 1),
y AS (SELECT r0 AS resolution, name, community FROM pa), {similarity_sql('x', 'y')} SELECT resolution, round(nmi, 6) AS nmi_prev FROM sim""")
def stability_prev(spark, sf):
    return rounded(partition.stability(users(spark, sf, "R")), "nmi_prev")


@query(f"""WITH {M}, {SIDES}, na AS (SELECT *, count(*) OVER (PARTITION BY resolution, community) AS z FROM pa), nb AS (SELECT *, count(*) OVER (PARTITION BY resolution, community) AS z FROM pb),
ca AS (SELECT resolution, name, CASE WHEN z < 13 THEN -1 ELSE community END AS community FROM na), cb AS (SELECT resolution, name, CASE WHEN z < 13 THEN -1 ELSE community END AS community FROM nb),
{similarity_sql('ca', 'cb')},
ga AS (SELECT resolution, n1 AS x, row_number() OVER (PARTITION BY resolution ORDER BY n1) AS i, count(*) OVER (PARTITION BY resolution) AS k FROM r1),
gb AS (SELECT resolution, n2 AS x, row_number() OVER (PARTITION BY resolution ORDER BY n2) AS i, count(*) OVER (PARTITION BY resolution) AS k FROM r2),
ha AS (SELECT resolution, avg(x::DOUBLE) AS m, sum((2 * i - k - 1) * x::DOUBLE) / (max(k) * sum(x::DOUBLE)) AS g FROM ga GROUP BY ALL), hb AS (SELECT resolution, avg(x::DOUBLE) AS m, sum((2 * i - k - 1) * x::DOUBLE) / (max(k) * sum(x::DOUBLE)) AS g FROM gb GROUP BY ALL)
SELECT 'R vs P' AS pair, resolution, n_common, n_comms_1 AS n_comms_base, n_comms_2 AS n_comms_aug, round(nmi, 6) AS nmi, round(ari, 6) AS ari, round(vi_nats, 6) AS vi_nats, round(vi_bits, 6) AS vi_bits, round(vi_mixed, 6) AS vi_mixed,
round(ha.m, 6) AS mean_size_base, round(hb.m, 6) AS mean_size_aug, round(ha.g, 6) AS gini_base, round(hb.g, 6) AS gini_aug FROM sim JOIN ha USING (resolution) JOIN hb USING (resolution)""")
def pair_filtered(spark, sf):
    out = partition.pair_analysis(users(spark, sf, "R"), users(spark, sf, "P"), "R vs P", min_size=13)
    return rounded(out, *SIM_NAMES, "mean_size_base", "mean_size_aug", "gini_base", "gini_aug")


OVER = """
sa AS (SELECT resolution, community AS a_comm, count(*) AS a_size FROM pa GROUP BY ALL), sb AS (SELECT resolution, community AS b_comm, count(*) AS b_size FROM pb GROUP BY ALL),
ov AS (SELECT resolution, a.community AS a_comm, b.community AS b_comm, count(*) AS common FROM pa a JOIN pb b USING (resolution, name) GROUP BY ALL),
jac AS (SELECT resolution, a_comm, a_size, b_comm, b_size, common, common::DOUBLE / (a_size + b_size - common) AS jaccard FROM ov JOIN sa USING (resolution, a_comm) JOIN sb USING (resolution, b_comm)),
rk AS (SELECT *, row_number() OVER (PARTITION BY resolution, a_comm ORDER BY jaccard DESC, b_comm) AS r FROM jac)"""


@query(f"WITH {M}, {SIDES}, {OVER} SELECT a_comm AS source_comm_id, a_size AS source_comm_size, b_comm AS best_target_comm_id, b_size AS best_target_comm_size, round(jaccard, 6) AS best_jaccard_score, resolution FROM rk WHERE r = 1")
def jaccard_best(spark, sf):
    return rounded(funnel.counterparts(users(spark, sf, "R"), users(spark, sf, "P"), 1), "best_jaccard_score")


ALL_PAIRS = """
sa AS (SELECT resolution, community AS a_comm, count(*) AS a_size FROM pa GROUP BY ALL), sb AS (SELECT resolution, community AS b_comm, count(*) AS b_size FROM pb GROUP BY ALL),
ov AS (SELECT resolution, a.community AS a_comm, b.community AS b_comm, count(*) AS common FROM pa a JOIN pb b USING (resolution, name) GROUP BY ALL),
jac AS (SELECT resolution, a_comm, a_size, b_comm, b_size, coalesce(common, 0)::DOUBLE / (a_size + b_size - coalesce(common, 0)) AS jaccard FROM sa JOIN sb USING (resolution) LEFT JOIN ov USING (resolution, a_comm, b_comm)),
rk AS (SELECT *, row_number() OVER (PARTITION BY resolution, a_comm ORDER BY jaccard DESC, b_comm) AS r FROM jac)"""


@query(f"""WITH {M}, {SIDES}, {ALL_PAIRS} SELECT resolution, a_comm, a_size,
max(b_comm) FILTER (r = 1) AS b_comm_1, round(max(jaccard) FILTER (r = 1), 6) AS jaccard_1, max(b_size) FILTER (r = 1) AS b_size_1,
max(b_comm) FILTER (r = 2) AS b_comm_2, round(max(jaccard) FILTER (r = 2), 6) AS jaccard_2, max(b_size) FILTER (r = 2) AS b_size_2,
max(b_comm) FILTER (r = 3) AS b_comm_3, round(max(jaccard) FILTER (r = 3), 6) AS jaccard_3, max(b_size) FILTER (r = 3) AS b_size_3 FROM rk WHERE r <= 3 GROUP BY ALL""")
def jaccard_topk(spark, sf):
    return rounded(partition.top_matches_wide(users(spark, sf, "R"), users(spark, sf, "P"), 3), "jaccard_1", "jaccard_2", "jaccard_3")


@query(f"""WITH {M}, {SIDES}, {OVER}, f AS (SELECT resolution, avg(jaccard) AS a, median(jaccard) AS m, max(jaccard) AS x, count(*) AS n FROM rk WHERE r = 1 GROUP BY ALL),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY resolution, b_comm ORDER BY jaccard DESC, a_comm) AS r2 FROM jac), g AS (SELECT resolution, avg(jaccard) AS a, median(jaccard) AS m, max(jaccard) AS x, count(*) AS n FROM rk2 WHERE r2 = 1 GROUP BY ALL)
SELECT resolution, round(f.a, 6) AS mean_jaccard_1to2, round(f.m, 6) AS median_jaccard_1to2, round(f.x, 6) AS max_jaccard_1to2, f.n AS n_comms_1,
round(g.a, 6) AS mean_jaccard_2to1, round(g.m, 6) AS median_jaccard_2to1, round(g.x, 6) AS max_jaccard_2to1, g.n AS n_comms_2 FROM f JOIN g USING (resolution)""")
def jaccard_summary(spark, sf):
    out = partition.match_summary(users(spark, sf, "R"), users(spark, sf, "P"))
    return rounded(out, *(f"{s}_jaccard_{w}" for s in ("mean", "median", "max") for w in ("1to2", "2to1")))


@query(f"WITH {M}, {SIDES}, {OVER} SELECT resolution, round(avg(jaccard), 6) AS mean, round(median(jaccard), 6) AS median, round(max(jaccard), 6) AS max, count(*) AS n FROM rk WHERE r = 1 GROUP BY ALL")
def jaccard_trends(spark, sf):
    return rounded(funnel.jaccard_trends(funnel.counterparts(users(spark, sf, "R"), users(spark, sf, "P"), 1)), "mean", "median", "max")


def gini_sql(source: str, value: str) -> str:
    return f"SELECT round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM (SELECT {value}::DOUBLE AS x, row_number() OVER (ORDER BY {value}) AS i, count(*) OVER () AS n FROM ({source}))"


@query(gini_sql("SELECT count(*) AS c FROM customer GROUP BY c_nationkey", "c"))
def gini_sizes(spark, sf):
    return rounded(stats.gini(B.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c")), "c"), "gini")


@query(gini_sql("SELECT count(*) AS c FROM orders GROUP BY o_custkey", "c"))
def gini_degree(spark, sf):
    return rounded(stats.gini(B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("c")), "c"), "gini")


T = B.TRADE_SQL


@query(f"WITH {T} SELECT round(sum(CASE WHEN a.community = b.community THEN weight ELSE 0 END)::DOUBLE / sum(weight), 6) AS coverage FROM tedges JOIN tlabels a ON src = a.name JOIN tlabels b ON dst = b.name")
def coverage(spark, sf):
    return rounded(stats.coverage(B.trade_edges(spark, sf), B.trade_labels(spark, sf)), "coverage")


ENDS = "le AS (SELECT a.community AS c1, b.community AS c2, weight FROM tedges JOIN tlabels a ON src = a.name JOIN tlabels b ON dst = b.name), ends AS (SELECT c1 AS community, c1 = c2 AS inside, weight FROM le UNION ALL SELECT c2, c1 = c2, weight FROM le)"


@query(f"""WITH {T}, {ENDS}, z AS (SELECT community, count(*) AS size FROM tlabels GROUP BY ALL), w AS (SELECT community, sum(CASE WHEN inside THEN weight ELSE 0 END) AS i, sum(CASE WHEN inside THEN 0 ELSE weight END) AS e FROM ends GROUP BY ALL)
SELECT community, size, CAST(coalesce(i, 0) AS BIGINT) AS internal_weight, CAST(coalesce(e, 0) AS BIGINT) AS external_weight, round(CASE WHEN coalesce(i + e, 0) = 0 THEN 0.0 ELSE (e - i)::DOUBLE / (e + i) END, 6) AS ei_index FROM z LEFT JOIN w USING (community)""")
def ei_index(spark, sf):
    return rounded(stats.ei_index(B.trade_edges(spark, sf), B.trade_labels(spark, sf)), "ei_index")


@query(f"""WITH {T}, {ENDS}, w AS (SELECT community, sum(CASE WHEN inside THEN 0 ELSE weight END) AS cut, sum(weight) AS volume FROM ends GROUP BY ALL), a AS (SELECT sum(volume) AS t FROM w)
SELECT community, CAST(cut AS BIGINT) AS cut, CAST(volume AS BIGINT) AS volume, round(cut::DOUBLE / nullif(least(volume, t - volume), 0), 6) AS conductance FROM w, a""")
def conductance(spark, sf):
    return rounded(stats.conductance(B.trade_edges(spark, sf), B.trade_labels(spark, sf)), "conductance")


@query(f"""WITH {T}, {ENDS}, w AS (SELECT community, sum(CASE WHEN inside THEN 0 ELSE weight END) AS cut, sum(weight) AS volume FROM ends GROUP BY ALL), a AS (SELECT sum(volume) AS t FROM w),
c AS (SELECT community, cut::DOUBLE / nullif(least(volume, t - volume), 0) AS v FROM w, a), z AS (SELECT community, count(*) AS size FROM tlabels GROUP BY ALL)
SELECT round(avg(v), 6) AS mean, round(sum(v * size) / sum(size), 6) AS weighted_mean, round(median(v), 6) AS median FROM c JOIN z USING (community) WHERE v IS NOT NULL""")
def conductance_summary(spark, sf):
    labels = B.trade_labels(spark, sf)
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    return rounded(stats.conductance_summary(stats.conductance(B.trade_edges(spark, sf), labels), sizes), "mean", "weighted_mean", "median")


@query(f"WITH {ENTROPY_SQL} SELECT round(avg(entropy), 6) AS mean_entropy, round(median(entropy), 6) AS median_entropy, round(max(entropy), 6) AS max_entropy, count(entropy) AS n FROM entropy")
def entropy_summary(spark, sf):
    return rounded(stats.entropy_summary(stats.tag_entropy(B.order_tags(spark, sf)), ()), "mean_entropy", "median_entropy", "max_entropy")


@query(f"WITH {ENTROPY_SQL}, r AS (SELECT community, round(entropy, 6) AS entropy FROM entropy), k AS (SELECT *, CAST(row_number() OVER (ORDER BY entropy, community) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 5")
def lowest_entropy(spark, sf):
    e = rounded(stats.tag_entropy(B.order_tags(spark, sf)), "entropy").select("community", "entropy").withColumn("one", F.lit(1))
    return stats.lowest_entropy(e, 5, ("one",)).drop("one")


COMMUNITY_ENTROPY = f"""{ALL_SQL}, {M},
utags AS (SELECT src AS name, dst AS tag, count(*) AS weight FROM raw WHERE rel = 2 GROUP BY ALL),"""


def entropy_of(graph: str, out: str) -> str:
    return f"""
{out}_m AS (SELECT * FROM membership WHERE graph = '{graph}'), {out}_b AS (SELECT resolution, community, count(*) AS members FROM {out}_m WHERE type = 'u' GROUP BY ALL HAVING count(*) >= 5),
{out}_n AS (SELECT resolution, community, count(*) FILTER (type <> 'u') AS n_tag_nodes FROM {out}_m GROUP BY ALL),
{out}_u AS (SELECT resolution, community, name, tag, weight FROM {out}_m JOIN {out}_b USING (resolution, community) JOIN utags USING (name) WHERE type = 'u'),
{out}_t AS (SELECT resolution, community, tag, sum(weight) AS w FROM {out}_u GROUP BY ALL),
{out}_s AS (SELECT resolution, community, sum(w) AS total, count(*) AS tags, max(w) AS most FROM {out}_t GROUP BY ALL),
{out}_h AS (SELECT resolution, community, -sum(w::DOUBLE / total * log2(w::DOUBLE / total)) AS bits FROM {out}_t JOIN {out}_s USING (resolution, community) GROUP BY ALL),
{out}_c AS (SELECT resolution, community, count(DISTINCT name) AS n_users FROM {out}_u GROUP BY ALL),
{out} AS (SELECT resolution, community, members, n_users, CAST(total AS BIGINT) AS n_tag_usages, tags AS n_unique_tags, round(CASE WHEN tags <= 1 THEN 0.0 ELSE greatest(0.0, bits) / log2(tags) END, 6) AS entropy, round(most::DOUBLE / total, 6) AS dominant_share, n_tag_nodes
  FROM {out}_b JOIN {out}_s USING (resolution, community) JOIN {out}_h USING (resolution, community) JOIN {out}_c USING (resolution, community) JOIN {out}_n USING (resolution, community))"""


def user_tags(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.USER_HASHTAG])


def entropies(tags, members, name):
    return rounded(stats.community_tag_entropy(tags, B.graph(members, name), 5), "entropy", "dominant_share")


@query(f"WITH {COMMUNITY_ENTROPY} {entropy_of('R+H', 'ent')} SELECT * FROM ent")
def community_entropy(spark, sf):
    return entropies(user_tags(spark, sf), B.membership(spark, sf), "R+H")


FUNNEL = f"""{COMMUNITY_ENTROPY} {entropy_of('R', 'ea')}, {entropy_of('P', 'eb')}, {SIDES}, {OVER},
qa AS (SELECT quantile_cont(entropy, 0.6) AS q FROM ea), qb AS (SELECT quantile_cont(entropy, 0.6) AS q FROM eb),
cand AS (SELECT a_comm AS source_comm_id, a_size AS source_comm_size, b_comm AS best_target_comm_id, b_size AS best_target_comm_size, round(jaccard, 6) AS best_jaccard_score, rk.resolution, ea.entropy AS rt_entropy, eb.entropy AS reply_entropy
  FROM rk JOIN ea ON ea.resolution = rk.resolution AND ea.community = a_comm JOIN eb ON eb.resolution = rk.resolution AND eb.community = b_comm, qa, qb
  WHERE r = 1 AND jaccard > 0.1 AND ea.entropy < qa.q AND eb.entropy < qb.q)"""


def candidates(tags, members):
    matches = funnel.counterparts(B.graph(members, "R"), B.graph(members, "P"), 1)
    return rounded(funnel.echo_chambers(matches, entropies(tags, members, "R"), entropies(tags, members, "P"), 0.1, 0.6), "best_jaccard_score")


def inputs(spark, sf):
    """Tag usages and memberships, written once: the funnel reads them several times."""
    return written(user_tags(spark, sf)), written(B.membership(spark, sf))


@query(f"WITH {FUNNEL} SELECT * FROM cand")
def echo_funnel(spark, sf):
    return candidates(*inputs(spark, sf))


TOP_TAGS = f"""{FUNNEL}, ck AS (SELECT DISTINCT resolution, source_comm_id AS community FROM cand),
ut AS (SELECT resolution, community, tag, CAST(sum(weight) AS BIGINT) AS count FROM ck JOIN pa USING (resolution, community) JOIN utags USING (name) GROUP BY ALL),
tt AS (SELECT resolution, community, tag, substr(tag, 3) AS tag_text, count, CAST(row_number() OVER (PARTITION BY resolution, community ORDER BY count DESC, tag) AS INTEGER) AS rank FROM ut)"""


def tags_of_candidates(spark, sf):
    tags, members = inputs(spark, sf)
    chosen = written(candidates(tags, members).select("resolution", F.col("source_comm_id").alias("community")))
    return funnel.top_tags(chosen, B.graph(members, "R"), tags, n=20)


@query(f"WITH {TOP_TAGS} SELECT * FROM tt WHERE rank <= 20")
def top_tags(spark, sf):
    return tags_of_candidates(spark, sf).select("resolution", "community", "tag", "tag_text", "count", "rank")


@query(f"WITH {TOP_TAGS} SELECT resolution, community, tag, CASE WHEN tag_text LIKE 'k%' THEN tag_text ELSE 'N/A' END AS tag_text, count, rank FROM tt WHERE rank <= 20")
def top_tags_named(spark, sf):
    """With the texts of a tag dictionary that lacks some tags."""
    tags, members = inputs(spark, sf)
    chosen = candidates(tags, members).select("resolution", F.col("source_comm_id").alias("community"))
    names = E.node_map(B.posts(spark, sf)).where(F.col("original").startswith("k") & (F.col("map_type") == 3)).select(F.col("node").alias("tag"), F.col("original").alias("tag_text"))
    return funnel.top_tags(chosen, B.graph(members, "R"), tags, names, n=20).select("resolution", "community", "tag", "tag_text", "count", "rank")


@query(f"WITH {TOP_TAGS} SELECT resolution, community, CAST(sum(CASE WHEN regexp_matches(tag_text, '(?i)ERR|view') THEN count ELSE 0 END) AS BIGINT) AS matching FROM tt WHERE rank <= 20 GROUP BY ALL HAVING matching >= 10")
def keyword_candidates(spark, sf):
    return funnel.keyword_candidates(tags_of_candidates(spark, sf), ["ERR", "view"], 10)


@query(f"WITH {M} SELECT name, type, " + ", ".join(f"coalesce(CAST(max(community) FILTER (round(resolution * 10) = {i}) AS VARCHAR), 'null') AS \"{i / 10:.1f}\"" for i in B.STEPS) + " FROM membership WHERE graph = 'R+H' GROUP BY ALL")
def membership_wide(spark, sf):
    return partition.wide(users(spark, sf, "R+H"), [i / 10 for i in B.STEPS])


@query(f"WITH {M} SELECT resolution, name, type, community FROM membership WHERE graph = 'R+H'")
def membership_long(spark, sf):
    return partition.long(partition.wide(users(spark, sf, "R+H"), [i / 10 for i in B.STEPS]))


@query()
def centrality_summary(spark, sf):
    chosen = partition.top_communities(users(spark, sf, "R").where(F.col("resolution") == 0.1), 4).select("resolution", "community")
    return funnel.centrality_summary(chosen, users(spark, sf, "R"), E.edges(B.posts(spark, sf), [Relation.RETWEET]))
