import itertools
import random

import numpy as np
import pytest

from starling.operators import community as C
from starling.operators import graph as G

E = "src string, dst string, weight long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_betweenness_of_a_path():
    got = G.brandes([("a", "b", 1.0), ("b", "c", 1.0)])
    assert got == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_betweenness_against_all_paths():
    random.seed(3)
    nodes = "abcdefg"
    edges = [(a, b, float(random.randint(1, 3))) for a in nodes for b in nodes if a != b and random.random() < 0.4]
    weight = {(a, b): w for a, b, w in edges}
    want = dict.fromkeys({x for e in edges for x in e[:2]}, 0.0)
    for s, t in itertools.permutations(sorted(want), 2):
        paths = [(s, *mid, t) for n in range(len(want) - 1) for mid in itertools.permutations([x for x in want if x not in (s, t)], n)]
        cost = {p: sum(weight[e] for e in zip(p, p[1:], strict=False)) for p in paths if all(e in weight for e in zip(p, p[1:], strict=False))}
        if cost:
            best = [p for p in cost if cost[p] == min(cost.values())]
            for p in best:
                for v in p[1:-1]:
                    want[v] += 1 / len(best)
    n = len(want)
    got = G.brandes(edges)
    assert all(got[v] == pytest.approx(want[v] / ((n - 1) * (n - 2))) for v in want)


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("a", "d", 3)], E)
    r = {x.name: x.pagerank for x in G.pagerank(e, 20).collect()}
    assert sum(r.values()) == pytest.approx(1)
    assert r["d"] > r["b"]


def test_components(spark):
    e = spark.createDataFrame([("b", "a", 1), ("c", "b", 1), ("x", "y", 1)], E)
    assert rows(G.components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_touching_takes_an_edge_once_per_key(spark):
    e = spark.createDataFrame([("a", "b", 1), ("c", "a", 1), ("c", "d", 1)], E)
    m = spark.createDataFrame([(0, "a"), (0, "b")], "community long, name string")
    assert rows(G.touching(e, m, ("community",))) == [(0, "a", "a", "b", 1), (0, "a", "c", "a", 1)]


def cliques(k=5):
    a = [(f"a{i}", f"a{j}", 1) for i in range(k) for j in range(i)]
    return a + [(s.replace("a", "b"), d.replace("a", "b"), 1) for s, d, _ in a] + [("a0", "b0", 1)]


@pytest.mark.parametrize("objective", ["cpm", "modularity"])
def test_two_cliques(spark, objective):
    got = C.communities(spark.createDataFrame(cliques(), E), [0.5 if objective == "cpm" else 1.0], objective)
    assert {(r.name[0], r.community) for r in got.collect()} == {("a", 0), ("b", 1)}


def random_edges(seed, n=60):
    rng = np.random.default_rng(seed)
    return [(f"n{a:02d}", f"n{b:02d}", int(rng.integers(1, 4))) for a in range(n) for b in range(n) if a != b and rng.random() < (0.12 if a % 5 == b % 5 else 0.01)]


@pytest.mark.parametrize(("objective", "gammas", "warm"), [("cpm", [0.1, 0.5], True), ("modularity", [1.0], False)])
def test_where_a_component_is_solved_does_not_show(spark, objective, gammas, warm):
    own = [*random_edges(4, 24), *cliques(4)]
    e = spark.createDataFrame(own, E)
    start = spark.createDataFrame([(f"n{i:02d}", i % 7) for i in range(0, 24, 2)], "name string, community long") if warm else None
    whole = C.communities(e, gammas, objective, start=start)
    assert rows(C.communities(e, gammas, objective, start=start, local_edges=0)) == rows(whole)
    n = len({x for s, d, _ in own for x in (s, d)})
    assert {(r.n_nodes, r.n_moves, r.n_across) for r in C.unsettled(e, whole, objective).collect()} == {(n, 0, 0)}
    singles = whole.selectExpr("resolution", "name", "xxhash64(name) AS community")
    assert {r.n_moves > 0 for r in C.unsettled(e, singles, objective).collect()} == {True}


def test_a_start_that_is_best_already_stays(spark):
    e = spark.createDataFrame(cliques(), E)
    start = spark.createDataFrame([(f"{c}{i}", 5 if c == "a" else 3) for c in "ab" for i in range(5)], "name string, community long")
    for local in (0, 10**6):
        assert {(r.name[0], r.community) for r in C.communities(e, [0.5], start=start, local_edges=local).collect()} == {("a", 0), ("b", 1)}


def test_hashes_agree(spark):
    names = ["a", "é", "n01", "x" * 100]
    df = spark.createDataFrame([(x,) for x in names], "name string")
    assert [r[0] for r in df.select(C.hashed(df.name, 42)).collect()] == C.hashes(names, 42).tolist()


def test_modularity_of_two_cliques(spark):
    found, reached = C.combo(spark.createDataFrame(cliques(), E), [1.0])
    e = [("ab".index(s[0]) * 5 + int(s[1]), "ab".index(d[0]) * 5 + int(d[1]), float(w)) for s, d, w in cliques()]
    m = sum(w for *_, w in e)
    assert reached.first().modularity == pytest.approx(20 / m - 2 * (m / (2 * m)) ** 2)
    assert found.count() == 10


def test_leiden_reaches_the_optimum_of_small_graphs():
    rng = np.random.default_rng(1)
    for _ in range(5):
        n = 7
        edges = [(a, b, 1.0) for a in range(n) for b in range(a) if rng.random() < 0.45]
        best = max(C.quality(n, edges, np.array(p), 0.4) for p in partitions(n))
        got = C.quality(n, edges, C.leiden(n, edges, 0.4), 0.4)
        assert got >= best - 0.65


def partitions(n):
    def grow(p, k):
        if len(p) == n:
            yield p
            return
        for c in range(k + 1):
            yield from grow([*p, c], max(k, c + 1))

    yield from grow([], 0)


def test_planted_partition_is_found():
    rng = np.random.default_rng(2)
    n, k = 120, 4
    truth = np.arange(n) % k
    edges = [(a, b, 1.0) for a in range(n) for b in range(a) if rng.random() < (0.5 if truth[a] == truth[b] else 0.02)]
    label = C.leiden(n, edges, 0.15)
    together = lambda x: x[:, None] == x[None, :]
    assert (together(label) == together(truth)).mean() > 0.98


def test_incremental_keeps_labels(spark):
    e = [("w1", s, d, w) for s, d, w in cliques()] + [("w2", s, d, w) for s, d, w in cliques()]
    got = C.incremental(spark.createDataFrame(e, "slice string, " + E), 0.5)
    second = {(r.name[0], r.community, r.tenure) for r in got.where("slice = 'w2'").collect()}
    assert second == {("a", 0, 2), ("b", 1, 2)}


def test_components_of_all_mentions(spark):
    from starling import bindings as B
    from starling.operators import edges
    from starling.queries import QUERIES
    from starling.schemas import Relation

    sf = "/root/testdata/sf0.001"
    above: dict[str, str] = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for r in edges.edges(B.posts(spark, sf), [Relation.MENTION]).select("src", "dst").distinct().collect():
        a, b = sorted((root(r.src), root(r.dst)))
        above[b] = a
    assert rows(QUERIES["components"](spark, sf)) == sorted((x, root(x)) for x in above)


def test_incremental_query_takes_every_week(spark):
    from starling.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    weeks = {r.week for r in QUERIES["week_label"](spark, sf).select("week").distinct().collect()}
    got = {r.slice for r in QUERIES["leiden_incremental"](spark, sf).select("slice").distinct().collect()}
    assert len(weeks) > 4 and got == weeks


def test_betweenness_of_parts_and_of_a_group_above_the_limit(spark, monkeypatch):
    e = spark.createDataFrame([(g, f"{g}{a}", f"{g}{b}", 1 + (a + b) % 3) for g, n in (("s", 6), ("t", 9)) for a in range(n) for b in range(n) if a != b and (a * b + a) % 3], "community string, src string, dst string, weight long")
    whole = {(r.community, r.name): r.betweenness for r in G.betweenness(e, "community").collect()}
    monkeypatch.setattr(G, "SOURCES_EDGES", 4)
    parts = {(r.community, r.name): r.betweenness for r in G.betweenness(e, "community").collect()}
    assert parts == pytest.approx(whole)
    some = {(r.community, r.name): r.betweenness for r in G.betweenness(e, "community", limit=30).collect()}
    assert {k for k, v in some.items() if v is None} == {k for k in whole if k[0] == "t"} and all(some[k] == pytest.approx(whole[k]) for k in whole if k[0] == "s")


def test_betweenness_by_levels_is_brandes():
    rng = np.random.default_rng(5)
    for top in (1, 3):
        edges = sorted({(int(a), int(b)): float(rng.integers(1, top + 1)) for a, b in rng.integers(0, 30, (120, 2))}.items())
        ids = {x: i for i, x in enumerate(sorted({x for e, _ in edges for x in e}))}
        rows = [(ids[a], ids[b], w) for (a, b), w in edges]
        want = G.brandes(rows)
        columns = [np.array(c) for c in zip(*rows, strict=True)]
        assert sum(G.by_levels(*columns, (i, 3)) for i in range(3)) == pytest.approx([want[i] for i in range(len(want))])
    assert G.by_levels(*columns[:2], 1 / np.sqrt(1 + np.arange(len(rows)))) is None


def test_betweenness_has_no_cap_of_its_own():
    import inspect

    assert inspect.signature(G.betweenness).parameters["limit"].default is None


def test_modularity_needs_few_rounds(monkeypatch):
    """Random edges: big communities, so moves that share none are few."""
    rng = np.random.default_rng(6)
    calls, old = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or old(*a, **k))
    n = 600
    u, v, w, s = C.columns(n, rng.integers(0, n, 8000), rng.integers(0, n, 8000), np.ones(8000))
    mass, rate = C.masses(s, 1.0, "modularity", s.sum() / 2)
    order = np.argsort(np.concatenate([u, v]), kind="stable")
    both = [np.concatenate(x)[order] for x in ((u, v), (v, u), (w, w))]
    calls.clear()
    C.climb(np.arange(n), *both, mass, rate, C.hashes(range(n), 42))
    assert len(calls) < 1000
