"""Community detection: Leiden for CPM and modularity, hierarchical, multislice and incremental.

One algorithm, in rounds. In a round nodes look at the weight to each
neighbouring community (and at one of their own) and propose their best move. The
moves of a share of the nodes, drawn anew each round by bits of a hash of the
name, are made together if that raises the quality; if not, a smaller share is
tried, and at last only moves that share no community are made, whose gains add
up. The share follows what moves gain together. The next round looks at nodes that
proposed a move and at neighbours of those moved, and at all nodes once these have
none. Either way the quality rises, so the
rounds end where no move of any node gains anything. Then each community is refined
from single nodes by the same rounds inside it, the parts become the nodes of a
smaller graph, and so on until nothing merges; all of it is done again from the
result until that stays as it is.

An optimal community never spans connected components, so a graph is split into
components first. Components up to ``local_edges`` edges are solved on arrays, in
a task for each resolution; larger ones by the same rounds on DataFrames, all resolutions at
once. Both take the same steps, so where a component is solved does not show in
the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import written
from .graph import components
from .temporal import inherit_labels, tenure, with_bonus

#: A move must gain more than this; values are rounded to as many digits before they are compared.
LEAST, DIGITS = 1e-9, 9
#: Length of a node's hash, of which each turn reads ten bits.
BITS = 60
#: Shares of nodes that are tried: 1/2, 1/4 and so on, so many.
SHARES = 10
#: Components up to this many edges are solved on arrays: about 100 bytes an edge.
ARRAY_EDGES = 16_000_000


def hashes(names, seed: int) -> np.ndarray:
    """As ``hashed`` on a column."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"{seed}:{x}".encode(), seed=42) & (1 << BITS) - 1 for x in names], np.int64)


def hashed(name, seed: int):
    return F.xxhash64(F.concat(F.lit(f"{seed}:"), name.cast("string"))).bitwiseAND(F.lit((1 << BITS) - 1))


def value(label: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, mass: np.ndarray, rate: float) -> float:
    """Quality up to a constant; edges in both directions, without loops."""
    return float(w[label[u] == label[v]].sum() / 2 - rate / 2 * (np.bincount(label, mass) ** 2).sum())


def chosen(bits, turn: int, k: int):
    """Whether a node is in a share of 1 / 2 ** (k + 1), another one each turn; Python's ints are arrays' and columns' alike."""
    return ((bits >> (turn * 7 % 50)) + turn * 619) % 1024 < 1024 >> (k + 1)


def near(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the edges of ids stand."""
    count = first[ids + 1] - first[ids]
    return np.repeat(first[ids] - np.cumsum(count) + count, count) + np.arange(count.sum())


def climb(label: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, mass: np.ndarray, rate: float, bits: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rounds of moves until none gains; edges in both directions, sorted by u. Labels are numbers of nodes, or n more for a community that a node opened."""
    n, turn, k, changed = len(mass), 0, 0, False
    first = np.searchsorted(u, np.arange(n + 1))
    scope = None
    while True:
        heavy, members = np.bincount(label, mass, 2 * n), np.bincount(label, minlength=2 * n)
        looked = np.arange(n) if scope is None else scope
        at = slice(None) if scope is None else near(first, scope)
        keys = u[at].astype(np.int64) * (2 * n) + label[v[at]]
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        to = np.add.reduceat(w[at][order], head) if len(head) else np.zeros(0)
        del order
        node, c = np.divmod(keys[head], 2 * n)
        own = label[node] == c
        worth = np.round(to - rate * mass[node] * (heavy[c] - np.where(own, mass[node], 0)), DIGITS)
        stay = np.round(-rate * mass * (heavy[label] - mass), DIGITS)
        stay[node[own]] = worth[own]
        node, c, worth = node[~own], c[~own], worth[~own]
        best, target = np.full(n, -np.inf), label.copy()
        if len(node):
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            best[node[head]] = np.maximum.reduceat(worth, head)
            top = np.flatnonzero(worth == best[node])[::-1]
            target[node[top]] = c[top]  # of equals the least community, as it is written last
        alone = np.zeros(n, bool)
        alone[looked] = (members[n + looked] == 0) & (members[label[looked]] > 1) & (best[looked] < 0)
        best[alone], target[alone] = 0.0, (n + np.arange(n))[alone]
        gain = np.round(best - stay, DIGITS)
        movers = gain > LEAST
        if not movers.any():
            if scope is None:
                return label, changed
            scope = None
            continue
        changed, made = True, None
        while k < SHARES:
            active = movers & chosen(bits, turn, k)
            turn += 1
            if not active.any():
                break
            new = np.where(active, target, label)
            at = near(first, np.flatnonzero(active))
            x, y = u[at], v[at]
            inside = (w[at] * np.where(active[y], 0.5, 1.0) * ((new[x] == new[y]).astype(float) - (label[x] == label[y]))).sum()
            then = np.bincount(new, mass, 2 * n)
            rise = float(inside - rate / 2 * ((then - heavy) * (then + heavy)).sum())
            k = paced(k, rise, float(gain[active].sum()))
            if rise > LEAST:
                made = active
                break
        if made is None:
            # Moves that are the best one of both communities they touch.
            m = np.flatnonzero(movers)
            m = m[np.lexsort((m, bits[m], -gain[m]))]
            rank, least = np.arange(len(m)), np.full(2 * n, len(m))
            for side in (label[m], target[m]):
                np.minimum.at(least, side, rank)
            m = m[(least[label[m]] == rank) & (least[target[m]] == rank)]
            made = np.zeros(n, bool)
            made[m] = True
            k = max(k - 1, 0)
        label = np.where(made, target, label)
        k = min(k, SHARES - 1)
        again = movers
        again[v[near(first, np.flatnonzero(made))]] = True
        scope = np.flatnonzero(again)


def paced(k: int, rise: float, hoped: float) -> int:
    """The next share: a smaller one if moves made together gain far less than each alone, a larger one if they gain nearly as much."""
    return k + 1 if rise < 0.5123 * hoped or rise <= LEAST else max(k - 1, 0) if rise > 0.8317 * hoped else k


def named(label: np.ndarray) -> np.ndarray:
    """Each community by its first node."""
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    return first[at]


def solve(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, mass: np.ndarray, rate: float, bits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels by first nodes; u < v without loops."""
    order = np.argsort(np.concatenate([u, v]), kind="stable")
    both = tuple(np.concatenate(x)[order] for x in ((u, v), (v, u), (w, w)))
    del order
    flat = named(label)
    while True:
        of, (x, y, z), m, h, label = np.arange(n), both, mass, bits, flat
        settled = True
        while True:
            label, changed = climb(label, x, y, z, m, rate, h)
            settled &= not changed
            flat = named(label[of])
            inner = label[x] == label[y]
            fine = named(climb(np.arange(len(m)), x[inner], y[inner], z[inner], m, rate, h)[0])
            lead, at = np.unique(fine, return_inverse=True)
            if len(lead) == len(m):
                break
            keys, back = np.unique(at[x].astype(np.int64) * len(lead) + at[y], return_inverse=True)
            z = np.bincount(back, z, len(keys))
            x, y = keys // len(lead), keys % len(lead)
            x, y, z = x[x != y], y[x != y], z[x != y]
            m, h, label, of = np.bincount(at, m), h[lead], named(label[lead]), at[of]
        if settled:
            return flat


def arrays(n: int, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u < v with summed weights, and the strength of each node (loops count twice)."""
    e = np.array(edges, float).reshape(-1, 3)
    return columns(n, e[:, 0].astype(int), e[:, 1].astype(int), e[:, 2])


def columns(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``arrays``, of whole columns."""
    keys = np.minimum(a, b) * n + np.maximum(a, b)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    w = np.add.reduceat(weight[order], head) if len(head) else np.zeros(0)
    small = np.int32 if n < 2**31 else np.int64
    u, v = (x.astype(small) for x in np.divmod(keys[head], max(n, 1)))
    strength = np.bincount(u, w, n) + np.bincount(v, w, n)
    return u[u != v], v[u != v], w[u != v], strength


def masses(strength: np.ndarray, gamma: float, objective: str, total: float) -> tuple[np.ndarray, float]:
    """What a community's size is measured in, and what its square costs."""
    if objective not in ("cpm", "modularity"):
        raise ValueError(f"unsupported objective {objective!r}")
    return (np.ones(len(strength)), gamma) if objective == "cpm" else (strength, gamma / (2 * total) if total else 0.0)


def leiden(n: int, edges: list[tuple[int, int, float]], gamma: float = 1.0, objective: str = "cpm", seed: int = 42, start: np.ndarray | None = None) -> np.ndarray:
    """Labels 0.. of the nodes, numbered by each community's first node (after Traag et al. 2019)."""
    u, v, w, strength = arrays(n, edges)
    mass, rate = masses(strength, gamma, objective, strength.sum() / 2)
    label = solve(n, u, v, w, mass, rate, hashes(range(n), seed), np.arange(n) if start is None else np.asarray(start))
    return np.unique(label, return_inverse=True)[1]


def quality(n: int, edges: list[tuple[int, int, float]], label: np.ndarray, gamma: float = 1.0, objective: str = "cpm") -> float:
    """Weight inside communities less gamma for each pair of nodes in one (or what modularity expects of it)."""
    u, v, w, strength = arrays(n, edges)
    mass, rate = masses(strength, gamma, objective, strength.sum() / 2)
    label = np.unique(np.asarray(label), return_inverse=True)[1]
    loops = sum(x for a, b, x in edges if a == b)
    return loops + value(label, *(np.concatenate(x) for x in ((u, v), (v, u), (w, w))), mass, rate) + float(rate / 2 * (mass**2).sum())


def undirected(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return edges.groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").cast("double").alias("weight"))


def communities(edges: DataFrame, gammas: list[float] = (1.0,), objective: str = "cpm", seed: int = 42, start: DataFrame | None = None, local_edges: int = ARRAY_EDGES) -> DataFrame:
    """(resolution, name, community) for every end of edges (src, dst, weight) and every resolution.

    A community is numbered by the rank of its least member among all least
    members. start: (name, community) to begin from.
    """
    masses(np.zeros(0), 1.0, objective, 0.0)
    e = written(undirected(edges))
    parts = written(components(e))
    e = written(e.join(parts.withColumnRenamed("name", "src"), "src"))
    sizes = e.groupBy("component").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > local_edges).select("component"))
    total = e.agg(F.sum("weight").alias("t")).first().t or 0.0
    # Tasks get numbers of nodes in the order of names, never the names.
    own = parts.join(large, "component", "left_anti")
    ids = written(numbered(own.select(F.lit(0).alias("resolution"), "name", F.col("name").alias("leader"))).select("name", F.col("community").alias("id")))
    nodes = own.join(ids, "name")
    if start is not None:
        nodes = nodes.join(start.select("name", F.col("community").alias("label")), "name", "left")
    else:
        nodes = nodes.withColumn("label", F.lit(None).cast("long"))
    end = lambda c, x: ids.select(F.col("name").alias(c), F.col("id").alias(x))
    rows = e.join(large, "component", "left_anti").join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    each = F.explode(F.array(*(F.lit(float(g)) for g in dict.fromkeys(gammas)))).alias("resolution")
    nodes = nodes.select("component", each, "id", hashed(F.col("name"), seed).alias("bits"), "label")
    rows = rows.select("component", each, "a", "b", "weight")

    def solved_whole(who: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        who = who.sort_values("id")
        names, n, gamma = who["id"].to_numpy(), len(who), float(who["resolution"].iloc[0])
        small = columns(n, np.searchsorted(names, pdf["a"].to_numpy()), np.searchsorted(names, pdf["b"].to_numpy()), pdf["weight"].to_numpy())
        del pdf
        u, v, w, strength = small
        begin, known = np.arange(n) + 2 * n, who["label"].notna().to_numpy()
        if known.any():
            begin[known] = pd.factorize(who["label"][known])[0]
        mass, rate = masses(strength, gamma, objective, total)
        label = solve(n, u, v, w, mass, rate, who["bits"].to_numpy(), begin)
        return pd.DataFrame({"resolution": gamma, "id": names, "lead": names[label]})

    keys = ["component", "resolution"]
    found = nodes.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(solved_whole, "resolution double, id long, lead long")
    found = written(found).join(ids, "id").join(end("leader", "lead"), "lead").select("resolution", "name", "leader")
    if not large.isEmpty():
        found = found.unionByName(spread(e.join(large, "component"), gammas, objective, seed, total, start))
    return numbered(written(found))


def numbered(solved: DataFrame) -> DataFrame:
    """Leaders to numbers 0.. in the order of their names, per resolution, without sorting members in one task."""
    leaders = solved.select("resolution", "leader").distinct()
    spread_out = leaders.repartitionByRange("resolution", "leader").withColumn("part", F.spark_partition_id())
    spread_out = written(spread_out)
    counts = spread_out.groupBy("resolution", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("resolution").orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("resolution", "part").orderBy("leader"))
    numbers = spread_out.withColumn("r", rank).join(before, ["resolution", "part"]).select("resolution", "leader", (F.col("before") + F.col("r") - 1).alias("community"))
    return solved.join(numbers, ["resolution", "leader"]).select("resolution", "name", F.col("community").cast("long").alias("community"))


def proposals(nodes: DataFrame, edges: DataFrame, n: int, scope: DataFrame | None = None) -> DataFrame:
    """The best move of each node (in scope: resolution, id) that gains: (resolution, id, mass, bits, label, target, gain). nodes: (resolution, id, mass, bits, rate, label); edges both ways, without loops, of all resolutions or with a column resolution."""
    by = ["resolution"] if "resolution" in edges.columns else []
    heavy = nodes.groupBy("resolution", "label").agg(F.sum("mass").alias("heavy"), F.count("*").alias("members"))
    labels = nodes.select("resolution", F.col("id").alias("dst"), F.col("label").alias("c"))
    near = edges.join(labels, [*by, "dst"])
    if scope is not None:
        near = near.join(scope.withColumnRenamed("id", "src"), ["resolution", "src"], "left_semi")
    near = near.groupBy("resolution", F.col("src").alias("id"), "c").agg(F.sum("weight").alias("to"))
    node = nodes.join(heavy, ["resolution", "label"])
    if scope is not None:
        node = node.join(scope, ["resolution", "id"], "left_semi")
    opened = heavy.where(F.col("label") >= n).select("resolution", (F.col("label") - n).alias("id"), F.lit(True).alias("opened"))
    stay = F.round(-F.col("rate") * F.col("mass") * (F.col("heavy") - F.col("mass")), DIGITS)
    node = node.join(opened, ["resolution", "id"], "left").select("resolution", "id", "mass", "bits", "rate", "label", stay.alias("stay"), ((F.col("members") > 1) & F.col("opened").isNull()).alias("free"))
    options = near.join(node.select("resolution", "id", "mass", "rate", "label"), ["resolution", "id"]).join(heavy.select("resolution", F.col("label").alias("c"), "heavy"), ["resolution", "c"])
    own = F.col("c") == F.col("label")
    worth = F.round(F.col("to") - F.col("rate") * F.col("mass") * (F.col("heavy") - F.when(own, F.col("mass")).otherwise(0.0)), DIGITS)
    options = options.groupBy("resolution", "id").agg(F.max(F.when(own, worth)).alias("own"), F.max(F.when(~own, F.struct(worth.alias("v"), (-F.col("c")).alias("c")))).alias("best"))
    j = node.join(options, ["resolution", "id"], "left")
    alone = F.col("free") & (F.coalesce(F.col("best.v"), F.lit(-1.0)) < 0)
    j = j.withColumn("target", F.when(alone, F.col("id") + n).otherwise(-F.col("best.c")))
    gain = F.round(F.when(alone, 0.0).otherwise(F.col("best.v")) - F.coalesce("own", "stay"), DIGITS)
    return j.withColumn("gain", gain).where(F.col("gain") > LEAST).select("resolution", "id", "mass", "bits", "label", "target", "gain")


def qualities(nodes: DataFrame, edges: DataFrame) -> dict[float, float]:
    """Quality of each resolution, up to a constant."""
    by = ["resolution"] if "resolution" in edges.columns else []
    end = lambda c, x: nodes.select("resolution", F.col("id").alias(c), F.col("label").alias(x))
    inside = edges.join(end("src", "a"), [*by, "src"]).join(end("dst", "b"), ["resolution", "dst"]).where(F.col("a") == F.col("b")).groupBy("resolution").agg(F.sum("weight").alias("w"))
    cost = nodes.groupBy("resolution", "label").agg(F.sum("mass").alias("m"), F.max("rate").alias("rate")).groupBy("resolution").agg(F.sum(F.col("rate") / 2 * F.col("m") * F.col("m")).alias("cost"))
    return {r.resolution: (r.w or 0.0) / 2 - r.cost for r in cost.join(inside, "resolution", "left").collect()}  # a row for each resolution


def climbed(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, set[float]]:
    """``climb`` on DataFrames: nodes with their last labels, and the resolutions in which one moved."""
    quality, changed = qualities(nodes, edges), set()
    turn, k = dict.fromkeys(quality, 0), dict.fromkeys(quality, 0)
    by = ["resolution"] if "resolution" in edges.columns else []
    made = lambda m: written(nodes.join(m.select("resolution", "id", "target"), ["resolution", "id"], "left").withColumn("label", F.coalesce("target", "label")).drop("target"))
    of = lambda df, some: df.where(F.col("resolution").isin(list(some)))
    whole, scope = set(quality), nodes.select("resolution", "id")  # resolutions in which all nodes are looked at
    while scope is not None:
        moves = written(proposals(nodes, edges, n, scope))
        pending, idle, apart, moved, new, all_good = set(turn), set(), set(), None, None, False
        while pending:
            part = F.lit(False)
            for q in pending:
                part = part | ((F.col("resolution") == q) & (((F.shiftright("bits", turn[q] * 7 % 50) + turn[q] * 619) % 1024) < 1024 >> (k[q] + 1)))
            found = {x.resolution: x.g for x in of(moves, pending).groupBy("resolution").agg(F.sum(F.when(part, F.col("gain"))).alias("g")).collect()}
            idle |= pending - set(found)
            pending &= set(found)
            changed |= pending
            for q in pending:
                turn[q] += 1
            hoped = {q: g for q, g in found.items() if g is not None}
            apart |= pending - set(hoped)
            if not hoped:
                break
            batch = moves.where(part)
            new = made(batch)
            better = qualities(new, edges)
            good = set()
            for q in hoped:
                rise = better[q] - quality[q]
                k[q] = paced(k[q], rise, hoped[q])
                if rise > LEAST:
                    good.add(q)
                    quality[q], k[q] = better[q], min(k[q], SHARES - 1)
                elif k[q] == SHARES:
                    apart.add(q)
            if good:
                done = of(batch, good).select("resolution", "id", "target")
                moved = done if moved is None else moved.unionByName(done)
                all_good = good == set(hoped) and moved is done
            pending -= good | apart
        if apart:
            rest, rank = of(moves, apart), F.struct("gain", (-F.col("bits")).alias("b"), (-F.col("id")).alias("i"))
            sides = rest.select("resolution", F.explode(F.array("label", "target")).alias("c"), rank.alias("rank")).groupBy("resolution", "c").agg(F.max("rank").alias("most"))
            side = lambda c, sides=sides: sides.select("resolution", F.col("c").alias(c), F.col("most").alias(f"{c}_most"))
            alone = rest.withColumn("rank", rank).join(side("label"), ["resolution", "label"]).join(side("target"), ["resolution", "target"]).where((F.col("rank") == F.col("label_most")) & (F.col("rank") == F.col("target_most")))
            alone = written(alone.select("resolution", "id", "target", "gain"))
            for x in alone.groupBy("resolution").agg(F.sum("gain").alias("g")).collect():
                quality[x.resolution] += x.g
                k[x.resolution] = min(max(k[x.resolution] - 1, 0), SHARES - 1)
            alone = alone.drop("gain")
            moved = alone if moved is None else moved.unionByName(alone)
        # Next: all that proposed a move and the neighbours of those moved; all nodes where these have none.
        fresh = idle - whole
        for q in idle & whole:
            del turn[q]
        scope = None
        if moved is not None:
            nodes = new if new is not None and not apart and all_good else made(moved)
            around = edges.join(moved.select("resolution", F.col("id").alias("src")), [*by, "src"]).select("resolution", F.col("dst").alias("id"))
            scope = moves.select("resolution", "id").unionByName(around).distinct()
        if fresh:
            every = of(nodes, fresh).select("resolution", "id")
            scope = every if scope is None else scope.unionByName(every)
        whole = fresh
    return nodes, changed


def spread(edges: DataFrame, gammas: list[float], objective: str, seed: int, total: float, start: DataFrame | None) -> DataFrame:
    """(resolution, name, leader): ``solve`` on DataFrames, for all resolutions and components at once.

    Each pair of them is a problem of its own, with its own number in the column
    resolution; there are few, as these components are large.
    """
    names = edges.select("component", F.explode(F.array("src", "dst")).alias("name")).distinct()
    ids = written(numbered(names.select(F.lit(0).alias("resolution"), "name", F.col("name").alias("leader"))).select("name", F.col("community").alias("id")))
    n = ids.count()
    end = lambda c, x: ids.select(F.col("name").alias(c), F.col("id").alias(x))
    e = edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b", "weight")
    flat = written(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")))
    strength = flat.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"))
    both = written(flat.where(F.col("src") != F.col("dst")))
    grid = F.array(*(F.lit(float(g)) for g in gammas))
    mass = F.lit(1.0) if objective == "cpm" else F.col("strength")
    base = names.join(ids, "name").join(strength, "id").select("component", "name", "id", hashed(F.col("name"), seed).alias("bits"), mass.alias("mass"))
    if start is not None:
        base = base.join(start.select("name", "community"), "name", "left")
        least = base.where(F.col("community").isNotNull()).groupBy("component", "community").agg(F.min("id").alias("first"))
        base = base.join(least, ["component", "community"], "left").select("component", "id", "bits", "mass", F.coalesce("first", "id").alias("label"))
    else:
        base = base.select("component", "id", "bits", "mass", F.col("id").alias("label"))
    base = base.join(base.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", "bits", "mass", "label", "least", F.posexplode(grid).alias("g", "gamma"))
    base = written(base.select((F.col("least") * len(gammas) + F.col("g")).alias("resolution"), "id", "bits", "mass", "label", (F.col("gamma") if objective == "cpm" else F.col("gamma") / F.lit(2 * total or 1.0)).alias("rate")))
    by_first = lambda x: x.join(x.groupBy("resolution", "label").agg(F.min("id").alias("first")), ["resolution", "label"]).withColumn("label", F.col("first")).drop("first")
    done = None
    left = {x.resolution for x in base.select("resolution").distinct().collect()}
    while left:
        nodes, level, of, settled = base, both, base.select("resolution", "id", F.col("id").alias("node")), set(left)
        live = set(left)
        while live:
            nodes, moved = climbed(nodes, level, n)
            settled -= moved
            nodes = written(by_first(nodes))
            at = nodes.select("resolution", F.col("id").alias("node"), "label")
            result = written(of.join(at, ["resolution", "node"]).select("resolution", "id", "node", "label"))
            # Refinement: the same rounds from single nodes, over edges inside communities.
            by = ["resolution"] if "resolution" in level.columns else []
            side = lambda c, x, nodes=nodes: nodes.select("resolution", F.col("id").alias(c), F.col("label").alias(x))
            inner = level.join(side("src", "x"), [*by, "src"]).join(side("dst", "y"), ["resolution", "dst"]).where(F.col("x") == F.col("y"))
            inner = written(inner.select("resolution", "src", "dst", "weight"))
            fine, _ = climbed(written(nodes.withColumn("label", F.col("id"))), inner, n)
            fine = written(by_first(fine).select("resolution", "id", F.col("label").alias("lead")))
            merged = {r.resolution for r in fine.where(F.col("id") != F.col("lead")).select("resolution").distinct().collect()}
            live &= merged
            if not live:
                break
            part = lambda c, x, fine=fine: fine.select("resolution", F.col("id").alias(c), F.col("lead").alias(x))
            level = written(level.join(part("src", "x"), [*by, "src"]).join(part("dst", "y"), ["resolution", "dst"]).where(F.col("x") != F.col("y")).groupBy("resolution", F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.sum("weight").alias("weight")))
            grown = nodes.join(fine, ["resolution", "id"])
            heavy = grown.groupBy("resolution", "lead").agg(F.sum("mass").alias("mass"))
            nodes = grown.where(F.col("id") == F.col("lead")).drop("mass").join(heavy, ["resolution", "lead"])
            nodes = written(by_first(nodes.select("resolution", "id", "bits", "rate", "mass", "label")))
            of = written(of.join(fine.select("resolution", F.col("id").alias("node"), "lead"), ["resolution", "node"]).select("resolution", "id", F.col("lead").alias("node")))
        base = written(by_first(base.drop("label").join(result.select("resolution", "id", "label"), ["resolution", "id"])))
        ended = base.where(F.col("resolution").isin(list(settled))) if settled else None
        if ended is not None:
            done = ended if done is None else done.unionByName(ended)
            left -= settled
            base = written(base.where(~F.col("resolution").isin(list(settled))))
    real = F.element_at(grid, (F.col("resolution") % len(gammas) + 1).cast("int")).alias("resolution")
    out = done.join(ids, "id").select(real, "name", "label")
    return out.join(ids.select(F.col("id").alias("label"), F.col("name").alias("leader")), "label").select("resolution", "name", "leader")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(resolution, modularity) of memberships (resolution, name, community): the share of weight inside less what strengths alone would give, times the resolution."""
    e = undirected(edges)
    end = lambda c, x: membership.select("resolution", F.col("name").alias(c), F.col("community").alias(x))
    inside = e.join(end("src", "a"), "src").join(end("dst", "b"), ["resolution", "dst"]).groupBy("resolution").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    strength = e.select(F.explode(F.array("src", "dst")).alias("name"), "weight").groupBy("name").agg(F.sum("weight").alias("s"))
    volumes = membership.join(strength, "name").groupBy("resolution", "community").agg(F.sum("s").alias("v")).groupBy("resolution").agg(F.sum(F.col("v") * F.col("v")).alias("squares"))
    return inside.join(volumes, "resolution").select("resolution", (F.col("inside") / F.col("total") - F.col("resolution") * F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("modularity"))


def combo(edges: DataFrame, gammas: list[float] = (1.0,), **options) -> tuple[DataFrame, DataFrame]:
    """Modularity optimised by moves, merges and splits of whole communities, and the modularity reached: (membership, (resolution, modularity))."""
    found = written(communities(edges, gammas, "modularity", **options))
    return found, modularity(edges, found)


def unsettled(edges: DataFrame, membership: DataFrame, objective: str = "cpm") -> DataFrame:
    """(resolution, n_nodes, n_moves, n_across): nodes, moves of single nodes that would raise the quality, and communities that span components. The last two are 0 in every result of ``communities``."""
    e = written(undirected(edges))
    total = e.agg(F.sum("weight").alias("t")).first().t or 1.0
    names = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct().select(F.lit(0).alias("resolution"), "name", F.col("name").alias("leader"))
    ids = written(numbered(written(names)).select("name", F.col("community").alias("id")))
    n = ids.count()
    end = lambda c, x: ids.select(F.col("name").alias(c), F.col("id").alias(x))
    one = e.join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b", "weight")
    flat = written(one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")))
    strength = flat.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"))
    mass, rate = (F.lit(1.0), F.col("resolution")) if objective == "cpm" else (F.col("strength"), F.col("resolution") / F.lit(2 * total))
    nodes = membership.join(ids, "name").join(strength, "id")
    first = nodes.groupBy("resolution", "community").agg(F.min("id").alias("label"))
    nodes = written(nodes.join(first, ["resolution", "community"]).select("resolution", "name", "community", "id", mass.alias("mass"), F.lit(0).cast("long").alias("bits"), rate.alias("rate"), "label"))
    moves = proposals(nodes, flat.where(F.col("src") != F.col("dst")), n).groupBy("resolution").agg(F.count("*").alias("n_moves"))
    across = nodes.join(components(e), "name").groupBy("resolution", "community").agg(F.countDistinct("component").alias("k")).groupBy("resolution").agg(F.count_if(F.col("k") > 1).alias("n_across"))
    counts = nodes.groupBy("resolution").agg(F.countDistinct("name").alias("n_nodes"))
    return counts.join(across, "resolution").join(moves, "resolution", "left").select("resolution", "n_nodes", F.coalesce("n_moves", F.lit(0).cast("long")).alias("n_moves"), "n_across")


def hierarchical(edges: DataFrame, membership: DataFrame, gammas: list[float], top_k: int = 500, min_size: int = 30, **options) -> DataFrame:
    """Communities of the subgraph of the top_k communities that have at least min_size members."""
    from .graph import induced
    from .partition import collapse_small, top_communities

    kept = collapse_small(membership.withColumn("one", F.lit(1)), min_size, ("one",)).where(F.col("community") != -1)
    best = top_communities(kept, top_k, ("one",)).select("community")
    return communities(induced(edges, kept.join(best, "community", "left_semi")), gammas, **options)


def multislice(edges: DataFrame, gammas: list[float], coupling: float = 0.1, **options) -> DataFrame:
    """(resolution, slice, name, community): all slices at once, each node tied to itself in the next slice it occurs in. edges: (slice, src, dst, weight)."""
    key = lambda c: F.concat_ws("\u0001", F.col("slice").cast("string"), F.col(c))
    inner = edges.select(key("src").alias("src"), key("dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    names = edges.select(F.col("slice").cast("string").alias("slice"), F.explode(F.array("src", "dst")).alias("name")).distinct()
    after = names.withColumn("next", F.lead("slice").over(Window.partitionBy("name").orderBy("slice"))).where(F.col("next").isNotNull())
    ties = after.select(F.concat_ws("\u0001", "slice", "name").alias("src"), F.concat_ws("\u0001", "next", "name").alias("dst"), F.lit(coupling).alias("weight"))
    found = communities(inner.unionByName(ties), gammas, **options)
    parts = F.split("name", "\u0001")
    return found.select("resolution", parts[0].alias("slice"), parts[1].alias("name"), "community")


def incremental(edges: DataFrame, gamma: float = 0.06, lam: float = 0.02, cap: float = 0.30, max_edges: int | None = None, max_slices: int | None = None, **options) -> DataFrame:
    """(name, slice, community, tenure), slice after slice: begin from the labels before, favour those who stayed together, carry labels on.

    Slices follow one another by nature; each is written before the next.
    """
    from .graph import top_edges

    if max_edges is not None:
        edges = top_edges(edges, max_edges)
    slices = [r.slice for r in edges.select("slice").distinct().orderBy("slice").collect()]  # a row for each week or day
    previous, out = None, None
    for s in slices[:max_slices]:
        own = edges.where(F.col("slice") == s).select("src", "dst", "weight")
        if previous is not None:
            own = with_bonus(own.withColumn("weight", F.col("weight").cast("double")), previous, lam, cap).drop("bonus")
        found = communities(own, [gamma], start=None if previous is None else previous.select("name", "community"), **options).select("name", "community")
        if previous is not None:
            labels = inherit_labels(previous, found)
            found = found.join(labels, "community").select("name", F.col("label").cast("long").alias("community"))
            kept = previous.select("name", F.col("community").alias("before"), "tenure")
            found = found.join(kept, "name", "left").select("name", "community", F.when(F.col("community") == F.col("before"), F.col("tenure") + 1).otherwise(1).alias("tenure"))
        else:
            found = found.withColumn("tenure", F.lit(1))
        found = written(found.select("name", F.lit(str(s)).alias("slice"), "community", F.col("tenure").cast("int").alias("tenure")))
        previous = found
        out = found if out is None else out.unionByName(found)
    return out


__all__ = ["combo", "communities", "hierarchical", "incremental", "leiden", "modularity", "multislice", "quality", "tenure", "unsettled"]
