"""Graph filters, degrees, components and centralities on edge tables (src, dst, weight)."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import written


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (name)."""
    own = members.select("name").distinct()
    return edges.join(own.withColumnRenamed("name", "src"), "src", "left_semi").join(own.withColumnRenamed("name", "dst"), "dst", "left_semi").select(*edges.columns)


def first_vertices(edges: DataFrame, n: int) -> DataFrame:
    """The subgraph of the n first nodes by name."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return induced(edges, names.orderBy("name").limit(n))


def touching(edges: DataFrame, members: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, edge) for edges with an end among members; if both are, the source counts. Two equi-joins instead of an OR."""
    own = members.select(*keys, "name").distinct()
    by_src = edges.join(own.withColumnRenamed("name", "src"), "src").withColumn("name", F.col("src"))
    by_dst = edges.join(own.withColumnRenamed("name", "dst"), "dst").withColumn("name", F.col("dst"))
    by_dst = by_dst.join(own.withColumnRenamed("name", "src"), ["src", *keys], "left_anti")
    columns = [*keys, "name", *edges.columns]
    return by_src.select(*columns).unionByName(by_dst.select(*columns))


def degree_filter(edges: DataFrame, least: int = 11) -> DataFrame:
    """Edges without ends of degree below `least`. Rows count, not weights; both ends count for user relations (0, 4, 5), the source for 2, none for 1 and 3; nodes that never count stay."""
    counted = edges.select(F.explode(F.when(F.col("rel").isin(0, 4, 5), F.array("src", "dst")).when(F.col("rel") == 2, F.array("src")).otherwise(F.array().cast("array<string>"))).alias("name"))
    low = counted.groupBy("name").agg(F.count("*").alias("d")).where(F.col("d") < least).select("name")
    return edges.join(low.withColumnRenamed("name", "src"), "src", "left_anti").join(low.withColumnRenamed("name", "dst"), "dst", "left_anti").select(*edges.columns)


def top_edges(edges: DataFrame, k: int, keys: tuple[str, ...] = ("slice",)) -> DataFrame:
    """The k heaviest edges of each slice, ties by ends."""
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "src", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def weighted_degrees(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(name, in_degree, out_degree): sums of weights; members without edges get 0."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")), F.struct(F.col("dst").alias("name"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")))).alias("e"))
    out = ends.groupBy("e.name").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return out if members is None else members.select("name").distinct().join(out, "name", "left").fillna(0, ["in_degree", "out_degree"])


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges between different pairs, m / (n (n - 1))."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("name")).agg(F.countDistinct("name").alias("nodes"))
    m = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    both = n.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
    size = F.col("nodes").cast("double")
    return both.withColumn("density", F.when(size > 1, F.col("edges") / (size * (size - 1))).otherwise(0.0))


def pagerank(edges: DataFrame, rounds: int = 30, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Weighted PageRank by a fixed number of rounds; ranks of nodes without out-links spread evenly. Lineage is cut every few rounds."""
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = written(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    names = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    nodes = written(names.join(out.select(F.col("src").alias("name"), F.lit(True).alias("linked")), "name", "left").fillna(False, ["linked"]))
    n = nodes.count()
    if n == 0:
        return nodes.select("name", F.lit(0.0).alias("pagerank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for step in range(rounds):
        got = ranks.join(shares, F.col("name") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0)).alias("loose"))  # one row
        ranks = ranks.join(got, F.col("name") == F.col("dst"), "left").withColumn("one", F.lit(1)).join(F.broadcast(loose.withColumn("one", F.lit(1))), "one")
        ranks = ranks.select("name", "linked", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if step % every == every - 1:
            ranks = written(ranks)
    return ranks.select("name", F.col("rank").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """(name, component): the least name reachable, by label steps over neighbours and over labels until no label moves; each round is written out."""
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("name")).agg(F.least("src", F.min("dst")).alias("label")))
    while True:
        near = both.join(labels, F.col("dst") == F.col("name")).groupBy(F.col("src").alias("name")).agg(F.min("label").alias("near"))
        step = labels.join(near, "name").select("name", "label", F.least("label", "near").alias("next"))
        # A label that is itself a node with a smaller label: jump there.
        jump = step.select(F.col("name").alias("via"), F.col("next").alias("far"))
        moved = written(step.join(jump, F.col("next") == F.col("via"), "left").select("name", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")))
        labels = moved.select("name", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            break
    return labels.withColumnRenamed("label", "component")


def betweenness(edges: DataFrame, key: str, weight_mode: str = "distance", limit: int | None = None) -> DataFrame:
    """(key, name, betweenness) within each group of directed edges, normalised by (n-1)(n-2).

    weight_mode: the weight is a distance, its inverse is one, or none. Every group
    is solved whole, whatever its size; each of its tasks holds its edges as
    numbers. Only if a caller sets a limit, nodes of groups with more edges have null.
    """
    if weight_mode not in ("distance", "inverse", "none"):
        raise ValueError(f"unsupported weight mode {weight_mode!r}")
    from .community import numbered

    e = edges.groupBy(key, "src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    e = written(e)
    sizes = written(e.groupBy(key).agg(F.count("*").alias("n")))
    solved = sizes if limit is None else sizes.where(F.col("n") <= limit)
    names = e.select(F.col(key).alias("resolution"), F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("leader", F.col("name"))
    ids = written(numbered(written(names)).select(F.col("resolution").alias(key), "name", F.col("community").alias("id")))
    end = lambda c, x: ids.select(key, F.col("name").alias(c), F.col("id").alias(x))
    own = e.join(end("src", "a"), [key, "src"]).join(end("dst", "b"), [key, "dst"]).select(key, "a", "b", "weight")
    # The paths from a source are a task's work: a group's sources are dealt into parts, each of which gets the group's edges.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(SOURCES_EDGES))).cast("int")
    work = own.join(solved, key).withColumn("parts", F.least(parts, F.lit(64))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        length = {"distance": lambda w: w, "inverse": lambda w: 1.0 / w, "none": lambda w: np.ones(len(w))}[weight_mode](pdf["weight"].to_numpy())
        own = (int(pdf["part"].iloc[0]), int(pdf["parts"].iloc[0]))
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        scores = by_levels(a, b, length, own)
        if scores is None:
            found = brandes(list(zip(a.tolist(), b.tolist(), length.tolist(), strict=True)), own)
            scores = np.array([found[x] for x in range(len(found))])
        return pd.DataFrame({key: pdf[key].iloc[0], "id": np.arange(len(scores)), "betweenness": scores})

    found = work.select(key, "a", "b", "weight", "part", "parts").groupBy(key, "part").applyInPandas(solve, f"{key} {dict(e.dtypes)[key]}, id long, betweenness double")
    found = found.groupBy(key, "id").agg(F.sum("betweenness").alias("betweenness"))
    return ids.join(found, [key, "id"], "left").select(key, "name", "betweenness")


#: Graphs of at most this many lengths, all multiples of the least, are searched level by level.
LENGTHS = 16


def by_levels(a: np.ndarray, b: np.ndarray, length: np.ndarray, part: tuple[int, int] = (0, 1)) -> np.ndarray | None:
    """As ``brandes`` on nodes 0.. that all have an edge; None if lengths are too many or no multiples of the least."""
    n = int(max(a.max(), b.max())) + 1
    steps = length / length.min()
    whole = np.round(steps).astype(np.int64)
    if (whole != steps).any() or len(np.unique(whole)) > LENGTHS:
        return None
    lists = {}
    for w in np.unique(whole).tolist():
        x, y = (c[whole == w].astype(np.int32) for c in (a, b))
        out, back = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        lists[w] = (np.searchsorted(x[out], np.arange(n + 1)), y[out], np.searchsorted(y[back], np.arange(n + 1)), x[back])

    def spans(first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = first[ids + 1] - first[ids]
        return np.repeat(ids, count), np.repeat(first[ids] - np.cumsum(count) + count, count) + np.arange(count.sum())

    score = np.zeros(n)
    for source in range(part[0], n, part[1]):
        dist, paths, links = np.full(n, -1), np.zeros(n), []
        dist[source], paths[source] = 0, 1.0
        fronts, times = {0: np.array([source])}, set(lists)
        while times:
            t = min(times)
            times.discard(t)
            free = np.flatnonzero(dist < 0)
            met = []
            for w, (first, dst, start, src) in lists.items():
                front = fronts.get(t - w)
                if front is None:
                    continue
                if (first[front + 1] - first[front]).sum() <= (start[free + 1] - start[free]).sum():
                    x, at = spans(first, front)
                    y = dst[at]
                    kept = dist[y] < 0
                else:
                    y, at = spans(start, free)
                    x = src[at]
                    kept = dist[x] == t - w
                met.append((x[kept], y[kept]))
            x, y = (np.concatenate(c) for c in zip(*met, strict=True)) if met else (free[:0], free[:0])
            if len(x):
                paths += np.bincount(y, paths[x], n)
                new = np.flatnonzero(np.bincount(y, minlength=n))
                dist[new], fronts[t] = t, new
                links.append((x, y))
                times |= {t + w for w in lists}
        share = np.zeros(n)
        for x, y in reversed(links):
            share += np.bincount(x, paths[x] / paths[y] * (1 + share[y]), n)
        share[source] = 0.0
        score += share
    return score * (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0)


#: Edges of a group for each part that its sources are dealt into.
SOURCES_EDGES = 500


def brandes(edges: list[tuple[str, str, float]], part: tuple[int, int] = (0, 1)) -> dict[str, float]:
    """Shortest-path betweenness of a directed graph with positive lengths (Brandes 2001); part (i, k): what every k-th source from i on adds."""
    out: dict[str, list[tuple[str, float]]] = defaultdict(list)
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    for s, d, w in edges:
        if s != d:
            out[s].append((d, w))
    score = dict.fromkeys(nodes, 0.0)
    for source in nodes[part[0] :: part[1]]:
        paths, dist, before = {source: 1.0}, {}, defaultdict(list)
        order, heap, best = [], [(0.0, source)], {source: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for w, length in out[v]:
                new = d + length
                if w not in dist and (w not in best or new < best[w] - 1e-12):
                    best[w], paths[w], before[w] = new, paths[v], [v]
                    heapq.heappush(heap, (new, w))
                elif w not in dist and abs(new - best[w]) <= 1e-12:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != source:
                score[w] += share[w]
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {v: x * scale for v, x in score.items()}


def node_sizes(edges: DataFrame, per_edge: int = 2, least: int = 20) -> DataFrame:
    """(name, degree, size): drawing sizes, least + per_edge * number of edges."""
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    return degrees.withColumn("size", per_edge * F.col("degree") + least)


def scaled_widths(edges: DataFrame, low: float = 0.2, span: float = 2.8) -> DataFrame:
    """Drawing widths: low + span * weight / largest weight."""
    most = edges.agg(F.max("weight").alias("most")).withColumn("one", F.lit(1))
    return edges.withColumn("one", F.lit(1)).join(F.broadcast(most), "one").withColumn("width", F.lit(low) + F.lit(span) * F.col("weight") / F.col("most")).drop("one", "most")
