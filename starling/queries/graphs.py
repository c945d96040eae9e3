"""Queries on graph measures and community detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import community as C
from ..operators import edges as E
from ..operators import graph as G
from ..plans.checkpoint import written
from ..schemas import Relation
from .build import ALL_SQL
from .registry import query, rounded

RT = f"{ALL_SQL}, g AS (SELECT src, dst, count(*) AS weight FROM raw WHERE rel = 0 GROUP BY ALL)"
ROUNDS = 5


def retweets(spark, sf):
    return E.edges(B.posts(spark, sf), [Relation.RETWEET]).select("src", "dst", "weight")


@query(f"WITH {RT} SELECT name, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS name, 0 AS i, weight AS o FROM g UNION ALL SELECT dst, weight, 0 FROM g) GROUP BY ALL")
def weighted_degree(spark, sf):
    return G.weighted_degrees(retweets(spark, sf))


@query(f"WITH {RT}, n AS (SELECT count(DISTINCT name) AS nodes FROM (SELECT src AS name FROM g UNION ALL SELECT dst FROM g)), m AS (SELECT count(*) AS edges FROM g) SELECT nodes, edges, round(edges::DOUBLE / (nodes::DOUBLE * (nodes - 1)), 9) AS density FROM n, m")
def density(spark, sf):
    return rounded(G.density(retweets(spark, sf)), "density", digits=9)


def pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT name, 1.0::DOUBLE / n AS r FROM nodes, cnt)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS (SELECT nodes.name, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n) AS r FROM nodes LEFT JOIN (SELECT dst AS name, sum(r * share) AS got FROM r{k} JOIN shares ON src = name GROUP BY dst) x USING (name), cnt,"
            f" (SELECT coalesce(sum(r), 0) AS loose FROM r{k} WHERE name NOT IN (SELECT src FROM g)) d)"
        )
    return f"""WITH {RT}, nodes AS (SELECT src AS name FROM g UNION SELECT dst FROM g), cnt AS (SELECT count(*) AS n FROM nodes),
shares AS (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS share FROM g), {", ".join(steps)} SELECT name, round(r, 9) AS pagerank FROM r{rounds}"""


@query(pagerank_sql(ROUNDS))
def pagerank_k(spark, sf):
    return rounded(G.pagerank(retweets(spark, sf), ROUNDS), "pagerank", digits=9)


@query(f"""WITH RECURSIVE {ALL_SQL}, g AS (SELECT DISTINCT src, dst FROM raw WHERE rel = 5),
e AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), reach AS (SELECT a AS name, a AS other FROM e UNION SELECT name, b FROM reach JOIN e ON other = a)
SELECT name, min(other) AS component FROM reach GROUP BY ALL""")
def components(spark, sf):
    return G.components(E.edges(B.posts(spark, sf), [Relation.MENTION]))


@query(f"WITH {RT}, m AS (SELECT max(weight) AS most FROM g) SELECT src, dst, weight, round(0.2 + 2.8 * weight / most, 6) AS width FROM g, m")
def scaled_widths(spark, sf):
    return rounded(G.scaled_widths(retweets(spark, sf)), "width")


@query()
def betweenness(spark, sf):
    """Of the whole graph, as one group."""
    return rounded(G.betweenness(retweets(spark, sf).withColumn("community", F.lit(0)), "community"), "betweenness", digits=9)


@query()
def leiden_cpm(spark, sf):
    return C.communities(retweets(spark, sf), [0.1, 0.5, 1.0])


@query()
def leiden_modularity(spark, sf):
    return C.communities(retweets(spark, sf), [1.0], "modularity")


def facts_sql(resolutions: list[float], graph: str = RT) -> str:
    """Each node once, no move of a node that gains, no community across components."""
    grid = ", ".join(f"({r}::DOUBLE)" for r in resolutions)
    return f"WITH {graph}, v AS (SELECT src AS name FROM g UNION SELECT dst FROM g) SELECT resolution, count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_moves, CAST(0 AS BIGINT) AS n_across FROM v, (VALUES {grid}) x(resolution) GROUP BY resolution"


@query(facts_sql([0.1, 0.5, 1.0]))
def leiden_cpm_settled(spark, sf):
    g = written(retweets(spark, sf))
    return C.unsettled(g, C.communities(g, [0.1, 0.5, 1.0]))


@query(facts_sql([1.0]))
def leiden_modularity_settled(spark, sf):
    g = written(retweets(spark, sf))
    return C.unsettled(g, C.communities(g, [1.0], "modularity"), "modularity")


@query(f"""WITH {RT}, p AS (SELECT 1.0::DOUBLE AS resolution, 'u:' || user_id AS name, user_id % 7 AS community FROM (SELECT DISTINCT user_id FROM events)),
m AS (SELECT sum(weight)::DOUBLE AS m FROM g), i AS (SELECT sum(weight)::DOUBLE AS inside FROM g JOIN p a ON src = a.name JOIN p b ON dst = b.name WHERE a.community = b.community),
s AS (SELECT name, sum(weight)::DOUBLE AS s FROM (SELECT src AS name, weight FROM g UNION ALL SELECT dst, weight FROM g) GROUP BY name),
v AS (SELECT sum(v * v) AS squares FROM (SELECT sum(s) AS v FROM s JOIN p USING (name) GROUP BY community))
SELECT 1.0::DOUBLE AS resolution, round(inside / m - squares / (4 * m * m), 9) AS modularity FROM m, i, v""")
def modularity_of_labels(spark, sf):
    labels = B.table(spark, sf, "events").select(F.lit(1.0).alias("resolution"), F.concat(F.lit("u:"), F.col("user_id")).alias("name"), (F.col("user_id") % 7).alias("community")).distinct()
    return rounded(C.modularity(retweets(spark, sf), labels), "modularity", digits=9)


@query()
def combo(spark, sf):
    """The modularity that communities reach at three resolutions."""
    return C.combo(written(retweets(spark, sf)), [0.5, 1.0, 2.0])[1]


@query(f"""WITH {RT}, w AS (SELECT src, dst, weight FROM g), d AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM w UNION ALL SELECT dst FROM w) GROUP BY name)
SELECT name, degree, 2 * degree + 20 AS size FROM d""")
def node_sizes(spark, sf):
    return G.node_sizes(retweets(spark, sf))


@query()
def leiden_hierarchical(spark, sf):
    g = retweets(spark, sf)
    base = C.communities(g, [0.1]).select("name", "community")
    return C.hierarchical(g, base, [0.5], top_k=10, min_size=2)
