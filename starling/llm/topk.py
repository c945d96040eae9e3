"""Exact top-k inner products by no-random-access aggregation (NRA).

Vectors are packed into blocks; each dimension of a block is a sorted list of
(row, component), and one more list has the rows' squared lengths. A query reads
the lists of a block in steps, each list from the end that raises its score (the
largest components for a positive weight, the smallest for a negative one), and
only ever adds what a step reads. Of a row it then knows the part of the score
from the components that were read. What is unread of it adds no more than the
components at which the lists stand, and lies within the product of the unread
lengths of row and query (Cauchy and Schwarz): these make the upper and the lower
bound of the score. Reading stops when no
row outside a few can reach the k-th best lower bound; their final scores are
resolved exactly. Lists that never close are read to the end, which makes every
bound exact, so the answer does not depend on the data.

Query vectors are packed too and sent to the vectors, which stay where they are,
in broadcasts of at most ``QUERY_BYTES``; each block returns at most k rows for a
query.

Defined results: vectors that are null, or hold a null or non-finite component
(also one that is not finite any more after scaling), and rows with a null id
take no part; only vectors of equal dimension meet; a query's own row is left
out, other rows with its id are not; repeated vectors all count; ties go to the
smaller id; an empty table gives no rows; other columns are ignored. Scores are
exact as long as they stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize

BLOCK_ROWS = 8192
#: Shares of the lists at which the bounds are looked at.
DEPTHS = (0.5, 0.625, 0.6875, 0.75, 0.8125, 0.875, 0.9375, 1.0)
#: Queries whose bounds a task holds at once, and bytes of query vectors in one broadcast.
QUERIES_AT_ONCE = 256
QUERY_BYTES = 64 << 20


def scaled(rows: pa.Array, factor: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indexes of the rows that take part, and their components as integers in doubles."""
    keep, out = [], []
    for i, v in enumerate(rows.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        x = np.floor(np.asarray(v, np.float64) * factor)
        if np.isfinite(x).all():
            keep.append(i)
            out.append(x)
    return np.array(keep, np.int64), out


def blocks(vectors: DataFrame, id_col: str, vector_col: str, factor: float, rows: int) -> DataFrame:
    """(block, dim, ids, components): packed vectors, at most `rows` in a block."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("components", pa.binary())])

    def packed(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dim):
            nonlocal at
            own = waiting.pop(dim)
            at += 1
            ids, x = np.array([i for i, _ in own], "<i8"), np.array([x for _, x in own], "<f8").reshape(len(own), dim)
            return pa.RecordBatch.from_arrays([pa.array([at - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, x in zip(*scaled(batch.column(1), factor), strict=True):
                if ids[i] is None:
                    continue
                waiting.setdefault(len(x), []).append((ids[i], x))
                if len(waiting[len(x)]) == rows:
                    yield flush(len(x))
        for dim in list(waiting):
            yield flush(dim)

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")), packed, "block long, dim int, ids binary, components binary")


class Lists:
    """The sorted lists of a block, one for each dimension: rows in ascending order of their components, and these."""

    def __init__(self, x: np.ndarray):
        self.n, self.dim = x.shape
        self.rows = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.rows, axis=0)
        self.lengths = np.einsum("ij,ij->i", x, x)

    def read(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """What the entries start..end (counted from the top, then from the bottom) add: components of rows, zero where nothing was read, and where something was."""
        found, seen = np.zeros((self.n, 2 * self.dim), self.values.dtype), np.zeros((self.n, 2 * self.dim), self.values.dtype)
        for side, part in ((0, slice(self.n - end, self.n - start)), (1, slice(start, end))):
            at = slice(side * self.dim, (side + 1) * self.dim)
            np.put_along_axis(found[:, at], self.rows[part], self.values[part], axis=0)
            np.put_along_axis(seen[:, at], self.rows[part], 1, axis=0)
        return found, seen


def search(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, depths=DEPTHS, reads: list | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (row of q): its number, positions and scores of its k best rows of x; own[i] is the row to leave out, or -1. reads, if given, gets the entries of each list that each query read."""
    # Whole numbers below 2^24 are exact in single precision.
    small = max((np.abs(q).max(axis=0, initial=0) * np.abs(x).max(axis=0, initial=0)).sum(), (x * x).sum(axis=1).max(initial=0), (q * q).sum(axis=1).max(initial=0)) < 2**24
    kind = np.float32 if small else np.float64
    q, x = q.astype(kind), x.astype(kind)
    lists, out = Lists(x), []
    for first in range(0, len(q), QUERIES_AT_ONCE):
        rows = np.arange(first, min(len(q), first + QUERIES_AT_ONCE))
        known = np.zeros((3, len(rows), lists.n), kind)  # of the score, and of the squared lengths of query and row
        done, read = 0, np.zeros((lists.n, 2 * lists.dim), kind)
        for depth in depths:
            end = max(done, 1, int(lists.n * depth))
            found, seen = lists.read(done, end)
            own_q = q[rows]
            weights = np.hstack([np.maximum(own_q, 0), np.minimum(own_q, 0)])
            known[0] += weights @ found.T
            known[1] += (weights * weights) @ seen.T
            # A list without weight says nothing: its components count as known.
            known[2] += (weights != 0).astype(kind) @ (found * found).T
            done = end
            read += seen
            # Where the lists stand: no unread component adds more.
            stands = weights * np.hstack([lists.values[lists.n - end], lists.values[end - 1]])
            most = known[0] + (stands.sum(axis=1)[:, None] - stands @ read.T)
            closed = []
            for i, query in enumerate(rows):
                can = np.arange(lists.n) if end == lists.n else candidates(known[:, i], most[i], q[query], lists.lengths, own[query], k)
                if end == lists.n or len(can) <= max(4 * k, lists.n // 100):
                    closed.append(i)
                    score = known[0, i, can] if end == lists.n else x[can] @ q[query]
                    out.append((int(query), *top(score.astype(np.float64), can, ids, own[query], k)))
                    if reads is not None:
                        reads.append(end)
            if closed:
                still = np.setdiff1d(np.arange(len(rows)), closed)
                rows, known = rows[still], known[:, still]
            if not len(rows):
                break
    return out


def candidates(known: np.ndarray, most: np.ndarray, q: np.ndarray, lengths: np.ndarray, own: int, k: int) -> np.ndarray:
    """Rows whose upper bound reaches the k-th best lower bound."""
    rest = np.sqrt(np.maximum(0, np.dot(q, q) - known[1].astype(np.float64)) * np.maximum(0, lengths - known[2].astype(np.float64)))
    rest = rest * (1 + 1e-9) + 1e-6
    low = known[0] - rest
    if own >= 0:
        low[own] = -np.inf
    if len(low) - (own >= 0) <= k:
        return np.arange(len(low))
    least = np.partition(low, len(low) - k)[len(low) - k]
    return np.flatnonzero(np.minimum(known[0] + rest, most + 1e-6) >= least)


def top(score: np.ndarray, can: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = can != own
    score, can = score[keep], can[keep]
    if len(score) > k:
        few = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, can = score[few], can[few]
    order = np.lexsort((ids[can], -score))[:k]
    return can[order], score[order]


def query_blocks(packed: DataFrame, every: int, rows: int) -> DataFrame:
    """(q_block, dim, places, q_ids, q_components): the vectors whose id is divisible by `every`, packed anew; places are (block, row) of each."""
    one = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("components", pa.binary())])

    def chosen(batches):
        for batch in batches:
            for block, dim, ids, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<f8").reshape(-1, dim)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array([dim] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(ids[at]), pa.array([x[i].tobytes() for i in at], pa.binary())], schema=one)

    asked = materialize(arrow_map(packed, chosen, "block long, dim int, row long, id long, components binary"))
    parts = max(1, -(-asked.count() // rows))
    schema = pa.schema([("q_block", pa.int64()), ("dim", pa.int32()), ("places", pa.binary()), ("q_ids", pa.binary()), ("q_components", pa.binary())])

    def packing(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            for block, dim, row, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.setdefault(dim, []).append((block, row, i, x))
        for dim, own in waiting.items():
            for first in range(0, len(own), rows):
                part = own[first : first + rows]
                at += 1
                values = (np.array([(b, r) for b, r, _, _ in part], "<i8").tobytes(), np.array([i for _, _, i, _ in part], "<i8").tobytes(), b"".join(x for *_, x in part))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], schema=schema)

    return materialize(arrow_map(asked.repartition(parts), packing, "q_block long, dim int, places binary, q_ids binary, q_components binary"))


FOUND = pa.schema([("q_block", pa.int64()), ("q_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows for each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    packed = materialize(blocks(vectors, id_col, vector_col, factor, rows))
    asked = query_blocks(packed, every, rows)

    def scored(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["components"], "<f8").reshape(-1, dim)
                places, q_ids, q = np.frombuffer(row["places"], "<i8").reshape(-1, 2), np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_components"], "<f8").reshape(-1, dim)
                own = np.where(places[:, 0] == row["block"], places[:, 1], -1)
                columns: list[list] = [[] for _ in FOUND]
                for i, can, score in search(q, own, ids, x, k):
                    for to, v in zip(columns, ([row["q_block"]] * len(can), [i] * len(can), [q_ids[i]] * len(can), ids[can], score.astype(np.int64)), strict=True):
                        to.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.types, strict=True)], schema=FOUND)

    # The query set goes to all rows, in blocks; a share of the query blocks at a time, so that no broadcast grows with the table.
    sizes = asked.select("q_block", F.length("q_components").alias("n")).orderBy("q_block").collect()  # a row for each `rows` queries
    shares: list[tuple[list, int]] = [([], 0)]
    for r in sizes:
        if shares[-1][1] and shares[-1][1] + r.n > QUERY_BYTES:
            shares.append(([], 0))
        shares[-1] = ([*shares[-1][0], r.q_block], shares[-1][1] + r.n)
    best = None
    for own, _ in shares:
        work = packed.join(F.broadcast(asked.where(F.col("q_block").isin(own))), "dim")
        found = arrow_map(work, scored, "q_block long, q_row long, query_id long, vec_id long, score long")
        best = found if best is None else best.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
