"""Best-fit packing of documents into token sequences of fixed capacity.

The instance is the histogram of piece lengths (at most ``capacity`` rows), so
its size does not depend on the corpus. ``plan`` shrinks it by Martello and
Toth's dominance criterion: a small set of pieces is fixed as one sequence when
any other way to fill the rest of its largest piece's sequence could be traded
for it without needing more sequences. What is left is packed best-fit
decreasing, on counts: all pieces of a length that meet equally full sequences
are placed in one step. The plan is a list of runs; a piece finds its place
from its length and its rank among pieces of that length, which is a prefix sum
over (length, partition) counts, so no length class is gathered in one task.

Defined results: null or empty texts are documents of their closing id alone;
repeated rows are packed once each; ties are broken by partition and position;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .tokens import WordEncoder

CLOSURE_BYTES = 1 << 20
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece; nth is its rank among the pieces of its length in its partition (part)."""

    def pieces(batches):
        from pyspark import TaskContext

        encoder, part = WordEncoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        closing = end_id.to_bytes(4, "little")
        step = capacity * 4
        for batch in batches:
            rows: list[list] = [[] for _ in PIECES]
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                raw += closing
                for k, at in enumerate(range(0, len(raw), step)):
                    own = raw[at : at + step]
                    n = len(own) // 4
                    for to, x in zip(rows, (doc, k, at // 4, n, zlib.crc32(own), part, seen[n]), strict=True):
                        to.append(x)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, PIECES.types, strict=True)], schema=PIECES)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), pieces, PIECES_SQL)


class Plan:
    """Runs of placements: (length, first rank, sequence of the first, pieces in each sequence, offset of the first)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.ranks: dict[int, int] = defaultdict(int)

    def place(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.ranks[length], sequence, each, offset))
        self.ranks[length] += pieces

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def reduce(plan: Plan, left: np.ndarray) -> None:
    """Fix dominating sets; left[length] is the number of pieces still to place."""
    c = plan.capacity

    def fix(sets: int, a: int, b: int = 0) -> None:
        at = plan.open(sets)
        if a == b:
            plan.place(a, 2 * sets, at, 2, 0)
        else:
            plan.place(a, sets, at, 1, 0)
            if b:
                plan.place(b, sets, at, 1, a)
                left[b] -= sets
        left[a] -= sets * (2 if a == b else 1)
        plan.fixed += sets

    if left[c]:
        fix(int(left[c]), c)
    # A pair that fills a sequence exactly dominates every other set with either of its pieces.
    for a in range(c - 1, (c - 1) // 2, -1):
        b = c - a
        if sets := int(left[a] // 2 if a == b else min(left[a], left[b])):
            fix(sets, a, b)
    a = c
    while a := int(max(np.flatnonzero(left[:a]), default=0)):
        while left[a]:
            room = c - a
            partners = [int(x) for x in np.flatnonzero(left[: room + 1]) if x != a or left[a] > 1]
            if not partners:  # nothing fits beside it
                fix(int(left[a]), a)
                break
            best = partners[-1]
            if best < room and reachable(partners, room) >> (best + 1):
                break  # two or more pieces may fill the room better than the best partner
            fix(int(left[a] // 2 if a == best else min(left[a], left[best])), a, best)
        if a * 2 <= c:
            break


def reachable(lengths: list[int], room: int) -> int:
    """Bit s is set if two or more pieces of these lengths (each as often as wanted) can add up to s, s at most room."""
    mask = (1 << (room + 1)) - 1
    one = sum(1 << x for x in lengths)
    two = 0
    for x in lengths:
        two |= one << x
    two &= mask
    while True:
        more = two
        for x in lengths:
            more |= (more << x) & mask
        if more == two:
            return two
        two = more


def best_fit(plan: Plan, left: np.ndarray) -> None:
    """Best-fit decreasing on counts; room[r] holds ranges of sequences with r places left."""
    c = plan.capacity
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms = 0  # bit r: some sequence has r places left

    def leave(r: int, at: int, n: int) -> None:
        nonlocal rooms
        if r and n:
            room[r].append((at, n))
            rooms |= 1 << r

    for length in range(c, 0, -1):
        n = int(left[length])
        while n:
            tighter = rooms >> length
            if tighter:
                r = length + (tighter & -tighter).bit_length() - 1
                at, have = room[r].pop()
                if not room[r]:
                    rooms &= ~(1 << r)
            else:
                r, have = c, -(-n // (c // length))
                at = plan.open(have)
            each = r // length
            full = min(have, n // each)
            if full:
                plan.place(length, full * each, at, each, c - r)
                leave(r - each * length, at, full)
                n -= full * each
            rest = min(n, each) if full < have else 0
            if rest:
                plan.place(length, rest, at + full, rest, c - r)
                leave(r - rest * length, at + full, 1)
                n -= rest
            leave(r, at + full + bool(rest), have - full - bool(rest))
        left[length] = 0




def plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = Plan(capacity)
    reduce(out, left)
    best_fit(out, left)
    return out


def place(pieces: DataFrame, made: Plan) -> DataFrame:
    """Give each ranked piece (columns of PIECES, rank) its sequence and offset."""
    runs = np.array(made.runs or [(0, 0, 0, 1, 0)], np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # A run for each length and class of room: at most capacity squared, whatever the corpus. Small ones go with the task, larger ones are broadcast.
    shared = pieces.sparkSession.sparkContext.broadcast(runs) if runs.nbytes > CLOSURE_BYTES else None
    runs = None if shared else runs

    def placed(batches, runs=runs):
        runs = shared.value if shared else runs
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            first = np.searchsorted(runs[:, 0], length, "left")
            last = np.searchsorted(runs[:, 0], length, "right")
            low, high = first.copy(), last - 1
            while (low < high).any():  # the last run of the length that begins at or before the rank
                mid = (low + high + 1) // 2
                up = runs[mid, 1] <= rank
                low, high = np.where(up, mid, low), np.where(up, high, mid - 1)
            run = runs[low]
            t = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(run[:, 2] + t // run[:, 3]), pa.array(run[:, 4] + t % run[:, 3] * length)], schema=PLACED)

    return arrow_map(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), placed, PLACED_SQL)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents (doc_id, text) and return where each piece lies."""
    pieces = materialize(cut(docs, tokenizer, capacity, end_id))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    return place(ranked, plan(histogram, capacity))
