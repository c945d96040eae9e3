"""N-gram Jaccard join: a size-aware join of shingle sets, and the groups it links.

Small (light) sets are joined by subsets of fixed sizes: a set within the
threshold shares its whole intersection, so each light set gives out the hashes
of all subsets that an intersection can be (itself without at most d shingles).
Sets that meet in a subset link if its size suffices for theirs, so nothing has
to be looked up; in a bucket all links run over its smallest set.

Large (heavy) sets are joined over inverted lists. In any order of all shingles,
two sets within the threshold share one of their first d + 1; the order puts
shingles that many documents hold last, so most lists are short. The lists of
other shingles are scanned in one pass over sorted entries: short lists give
their pairs at once (at most SHORT of them for each row). In long lists each
set first meets a few well connected sets (stars), which finds groups of copies
in comparisons in proportion to their size; then the pairs of a list that no
chain of links connects yet. A pair must fit by size and places in its lists,
by a signature of 512 bits and by longer bitmaps, none of which rules out a true
link, and is then compared exactly on its whole sets.

The boundary between light and heavy sets is where the cost, summed over the
histogram of set sizes, is least: subsets given out against list entries and
their comparisons. Sets are 64-bit fingerprints of shingles. Equal sets are one
node, known by a fingerprint of the whole set; ids only matter for the output.

Defined results: null texts and texts without words have an empty set and link
with nothing; a text of fewer words than a shingle is one shingle; rows with a
null id link with nothing and have a null component; repeated rows are each
returned, and rows that share an id but not their text are judged by their own
text, so they can have different components; an empty table gives no rows;
other columns, whatever their names, are ignored by ``groups`` and kept by
``deduplicated``, of whose repeated rows (same id and text) one stays.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, fresh, heavy_keys, in_filter, join_hot, materialize, mix64, tidy
from .components import components

CACHE_WORDS = 400_000
#: Shingles that are put last in the order, at most; the bound of what reaches the driver for it is that of a bit filter.
FREQUENT = 1 << 20
LEAST_FREQUENT = 8
#: Shingles a task gathers before it counts them.
GATHER = 2_000_000
#: Longs in a signature, and stars besides the one around the most connected set.
SIGNATURE = 8
STARS = 4
#: Lists of up to this many sets give out their pairs while they are scanned.
SHORT = 16


class Shingler:
    """Sets of shingle fingerprints: sorted, distinct 64-bit values."""

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = mix64(h[:n] + np.uint64(k))
        for j in range(1, k):
            out = mix64(out + h[j : j + n])
        return np.unique(out)


def name_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


class Rule:
    """Two sets link if den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def missing(self, n: int) -> int:
        """Members of a set of n that a partner can lack, at most."""
        return (self.den - self.num) * n // self.den

    def largest(self, n: int) -> int:
        """Size of the largest partner of a set of n."""
        return self.den * n // self.num

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, i) for i in range(self.missing(n) + 1))

    def boundary(self, sizes: dict[int, int], repeated: float) -> int:
        """Largest light size, by cost; repeated: share of shingles that occur again, so of list entries that lead to a comparison."""
        most = max([n for n in range(1, 200) if self.missing(self.largest(n)) <= 2], default=0)
        best, cost = 0, 0.0
        least = cost
        for n in range(1, most + 1):
            scan = (self.missing(n) + 1) * (1 + repeated * n)
            cost += sizes.get(n, 0) * (self.subsets(n) - scan)
            # Sets just above the boundary give out subsets too, to meet the light ones.
            border = sum(sizes.get(m, 0) * self.subsets(m) for m in range(n + 1, self.largest(n) + 1))
            if cost + border < least:
                best, least = n, cost + border
        return best

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def bitmap(own: np.ndarray) -> bytes:
    """One bit for each residue of the members, at least twice as many bits as members."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def signature(own: np.ndarray) -> list[int]:
    """One bit of SIGNATURE longs for each residue of the members."""
    out = np.zeros(64 * SIGNATURE, np.uint8)
    out[(own % np.uint64(64 * SIGNATURE)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<i8").tolist()


def may_link(rule: Rule, a: int, b: int, x: np.ndarray, y: np.ndarray) -> bool:
    """False only if the bitmaps show that too many members differ; a, b: sizes."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    common = -(-rule.num * (a + b) // (rule.num + rule.den))
    return int(np.bitwise_count(x & ~y).sum()) <= a - common and int(np.bitwise_count(y & ~x).sum()) <= b - common


def subset_names(own: np.ndarray, lack: int) -> list[np.ndarray]:
    """Names of the subsets without 0, 1, .. `lack` members."""
    parts = mix64(own + np.uint64(0x51ED2701))
    with np.errstate(over="ignore"):
        total = parts.sum(dtype=np.uint64)
        out = []
        for i in range(lack + 1):
            gone = np.array([total]) if i == 0 else total - parts if i == 1 else np.array([total - parts[list(c)].sum(dtype=np.uint64) for c in combinations(range(len(own)), i)], np.uint64)
            out.append(mix64(gone + np.uint64(len(own) - i)))
    return out


def survey(texts: DataFrame, k: int) -> DataFrame:
    """(kind, key, n): kind 0, a set size and its documents; kind 1, a shingle that occurs again in a task's documents and how often; kind 2, all shingles."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def surveyed(batches):
        shingles, sizes, held, waiting, total = Shingler(k), {}, [], 0, 0

        def again():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(np.ones(keep.sum(), np.int32)), pa.array(keys[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], schema=schema)

        for batch in batches:
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                sizes[len(own)] = sizes.get(len(own), 0) + 1
                held.append(own)
                waiting += len(own)
            total += sum(map(len, held)) if waiting > GATHER else 0
            if waiting > GATHER:
                yield again()
                held, waiting = [], 0
        total += waiting
        if waiting:
            yield again()
        rows = [(0, n, c) for n, c in sizes.items()] + [(2, 0, total)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return arrow_map(texts, surveyed, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where((F.col("kind") != 1) | (F.col("n") >= LEAST_FREQUENT))


BEGUN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("lists", pa.list_(pa.int64())), ("quiet", pa.int64()), ("subsets", pa.list_(pa.int64())), ("bitmap", pa.binary()), ("sign", pa.list_(pa.int64()))])
BEGUN_SQL = "doc_id long, key long, n long, name long, lists array<long>, quiet long, subsets array<long>, bitmap binary, sign array<long>"


def beginnings(texts: DataFrame, k: int, rule: Rule, frequent: np.ndarray, light: int) -> DataFrame:
    """Each document's set by name; where a task meets a set first, also its list entries (the first `quiet` of them are not frequent) or subsets, and what candidates are compared by."""

    def flat(own: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)))

    def begun(batches):
        shingles, met = Shingler(k), set()
        for batch in batches:
            sizes, names, lists, quiet, subsets, maps, signs = [], [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = shingles(text)
                n = len(own)
                name = name_of(own) if n else 0
                entries, parts, rare = own[:0], own[:0], 0
                if doc is not None and name not in met:
                    met.add(name)
                    near = rule.missing(n) or rule.largest(n) > n  # else only equal sets link
                    if n > light and near:
                        often = in_filter(frequent, own)
                        need = rule.missing(n) + 1
                        entries = own[~often][:need]
                        rare = len(entries)
                        entries = np.concatenate([entries, own[often][: need - rare]])
                    if n and n <= rule.largest(light) and near:
                        parts = np.concatenate(subset_names(own, rule.missing(n)))
                sizes.append(n)
                names.append(name)
                lists.append(entries)
                quiet.append(rare)
                subsets.append(parts)
                maps.append(bitmap(own) if len(entries) else None)
                signs.append(signature(own) if len(entries) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), flat(lists), pa.array(quiet, pa.int64()), flat(subsets), pa.array(maps, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], schema=BEGUN)

    return arrow_map(texts, begun, BEGUN_SQL)


def full_sets(texts: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(doc_id, name, members) of the documents whose hashed id passes the filter."""
    schema = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("members", pa.binary())])

    def sets(batches):
        shingles = Shingler(k)
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(wanted, batch.column(2).to_numpy().view(np.uint64))))
            own = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], schema=schema)

    return arrow_map(texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).where(F.col("doc_id").isNotNull()), sets, "doc_id long, name long, members binary")


def compared(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link, compared on whole sets (name, members)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    left = sets.select(F.col("name").alias("a"), F.col("members").alias("own"))
    right = sets.select(F.col("name").alias("b"), F.col("members").alias("other"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "own", "other")

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                together = np.sort(np.concatenate([x, y]), kind="stable")
                keep.append(rule.links(int((together[1:] == together[:-1]).sum()), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], schema=schema)

    return arrow_map(both, linked, "a long, b long")


def classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): each row of docs (doc_id, key: a hash of its text, n, name), and for each set (name) the class it is in (a name)."""
    rule = Rule(num, den)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    # The order of shingles and the boundary.
    seen = materialize(survey(texts.select("doc_id", "text"), k))
    sizes = {r.key: r.n for r in seen.where((F.col("kind") == 0) & (F.col("key") < 200)).collect()}
    again = seen.where(F.col("kind") == 1)
    steps = {r.p: r.c for r in again.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}
    least, many = 63, 0
    while least > 0 and many + steps.get(least - 1, 0) <= FREQUENT:
        least -= 1
        many += steps.get(least, 0)
    totals = {r.kind: r.n for r in seen.where(F.col("kind") > 0).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    light = rule.boundary(sizes, totals.get(1, 0) / max(1, totals.get(2, 0)))
    frequent = bit_filter(again.where(F.col("n") >= 2**least), "key")
    begun = materialize(beginnings(texts, k, rule, frequent, light))
    links = light_links(begun, rule).unionByName(heavy_links(texts, begun, k, rule))
    found = materialize(components(links))
    sets = found.select(F.col("node").alias("name"), F.col("component").alias("class")).unionByName(found.select(F.col("component").alias("name"), F.col("component").alias("class")).distinct())
    return begun.select("doc_id", "key", "n", "name"), sets


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    rows, sets = classes(docs, k, num, den)
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    least = rows.where(real).groupBy("name").agg(F.min("doc_id").alias("least")).join(sets, "name", "left").withColumn("class", F.coalesce("class", "name"))
    best = least.groupBy("class").agg(F.min("least").alias("component_id"))
    known = least.join(best, "class").select("name", "component_id")
    out = join_hot(rows.where(real), known, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # Empty sets are their own components.
    return out.unionByName(rows.where(~real).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def light_links(begun: DataFrame, rule: Rule) -> DataFrame:
    own = begun.where(F.size("subsets") > 0).select("name", "n", F.posexplode("subsets").alias("at", "part"))
    lack = F.when(F.col("at") == 0, 0).when(F.col("at") <= F.col("n"), 1).otherwise(2)
    own = own.select("name", "n", "part", (F.col("n") - lack).alias("size")).distinct()
    first = own.groupBy("part", "size").agg(F.min(F.struct("n", "name")).alias("first"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c")
    met = own.join(first, ["part", "size"]).where((F.col("name") != F.col("first.name")) & (rule.den * F.col("size") >= rule.num * (F.col("n") + F.col("first.n") - F.col("size"))))
    return met.select(F.col("name").alias("a"), F.col("first.name").alias("b")).distinct()


SCANNED = pa.schema([("a", pa.int64()), ("n_a", pa.int64()), ("b", pa.int64()), ("n_b", pa.int64()), ("entry", pa.int64()), ("at", pa.int64())])


def scan(entries: DataFrame, rule: Rule) -> DataFrame:
    """Inverted lists (entry, name, n, at), scanned in order of their entries: pairs (a, b) of short lists, and the rows (a, entry, at) of long ones."""

    def fits(n, m, at, at2):
        common = -(-rule.num * (n + m) // (rule.num + rule.den))
        return (np.minimum(n, m) * rule.den >= np.maximum(n, m) * rule.num) & (at <= n - common) & (at2 <= m - common)

    def taken(x: np.ndarray, known_long: list[int]):
        """x: rows of whole lists, or of lists that are known as long."""
        entry, name, n, at = x.T
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        size = np.diff(np.concatenate([first, [len(entry)]]))
        c = np.repeat(size, size)
        far = (c > SHORT) | np.isin(entry, known_long)
        out = [np.column_stack([name[far], n[far], name[far], n[far], entry[far], at[far]])]
        few = np.flatnonzero((c > 1) & ~far)
        for d in range(1, SHORT):
            i = few[few + d < len(entry)]
            i = i[entry[i] == entry[i + d]]
            if not len(i):
                break
            j = i + d
            ok = fits(n[i], n[j], at[i], at[j])
            i, j = i[ok], j[ok]
            zero = np.zeros(len(i), np.int64)
            out.append(np.column_stack([name[i], n[i], name[j], n[j], zero, zero - 1]))  # names ascend within a list
        x = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in x.T], schema=SCANNED)

    def scanned(batches):
        held, known_long = np.zeros((0, 4), np.int64), []
        for batch in batches:
            x = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            if not len(x):
                continue
            same = np.zeros(len(x), bool)  # a set that several tasks met
            same[1:] = (x[1:, 0] == x[:-1, 0]) & (x[1:, 1] == x[:-1, 1])
            x = x[~same]
            last = int(np.searchsorted(x[:, 0], x[-1, 0], "left"))
            if len(x) - last > SHORT or x[-1, 0] in known_long:  # the last list may go on, but is known as long
                known_long = [*known_long[-1:], int(x[-1, 0])]
                yield taken(x, known_long)
                held = x[:0]
            else:
                if last:
                    yield taken(x[:last], known_long)
                held = x[last:]
        if len(held):
            yield taken(held, known_long)

    # Entries that are not frequent have short lists, so that no task gets many rows for one.
    return arrow_map(entries.select("entry", "name", "n", "at").repartition("entry").sortWithinPartitions("entry", "name"), scanned, "a long, n_a long, b long, n_b long, entry long, at long")


def heavy_links(texts: DataFrame, begun: DataFrame, k: int, rule: Rule) -> DataFrame:
    entries = begun.where(F.size("lists") > 0).select("name", "n", "quiet", F.posexplode("lists").alias("at", "entry")).withColumn("at", F.col("at").cast("long"))
    found = materialize(scan(entries.where(F.col("at") < F.col("quiet")), rule))
    tidy(begun.sparkSession)
    near = found.where(F.col("at") < 0).select("a", "b", "n_a", "n_b")
    # Frequent entries that two different sets have: counted where the rows are, then joined.
    loud = entries.where(F.col("at") >= F.col("quiet")).select("entry", "name", "n", "at")
    shared = loud.groupBy("entry").agg(F.min("name").alias("x"), F.max("name").alias("y")).where(F.col("x") < F.col("y")).select("entry")
    far = found.where(F.col("at") >= 0).select("entry", F.col("a").alias("name"), F.col("n_a").alias("n"), "at")
    lists = materialize(join_hot(loud, shared, "entry").unionByName(far).distinct())
    hot = heavy_keys(lists, "entry")
    # Sets of n and m members share `common` at least, so that one of the first n - common + 1 entries is shared.
    common = lambda n, m: F.ceil(rule.num * (n + m) / (rule.num + rule.den))
    fits = lambda n, m, at, at2: (F.least(n, m) * rule.den >= F.greatest(n, m) * rule.num) & (at <= n - common(n, m)) & (at2 <= m - common(n, m))
    pair = lambda x, y, n, m: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(x < y, n).otherwise(m).alias("n_a"), F.when(x < y, m).otherwise(n).alias("n_b"))
    # Stars: each set against the most connected set that leads a list of it, and against others drawn among well connected ones.
    lengths = lists.groupBy("entry").agg(F.count("*").alias("c"))
    shares = join_hot(lists, lengths, "entry", hot).groupBy("name").agg(F.sum("c").alias("c"))
    scored = lists.join(shares, "name")
    lead = lambda k: F.struct(F.when(F.lit(k) == 0, F.col("c")).otherwise(F.floor(F.log2("c"))).alias("c"), F.xxhash64(F.lit(k), F.col("name")).alias("h"), "name", "n", "at")
    tops = scored.groupBy("entry").agg(*(F.max(lead(k)).alias(f"t{k}") for k in range(STARS + 1)))
    met = join_hot(lists, tops, "entry", hot).select("name", "n", "at", F.posexplode(F.array(*(f"t{k}" for k in range(STARS + 1)))).alias("k", "top"))
    met = met.where((F.col("name") != F.col("top.name")) & fits(F.col("n"), F.col("top.n"), F.col("at"), F.col("top.at")))
    star = met.groupBy("name", "k").agg(F.max("top").alias("top"), F.first("n").alias("n")).select(*pair(F.col("name"), F.col("top.name"), F.col("n"), F.col("top.n")))
    links = materialize(verified(near.unionByName(star).distinct(), begun, texts, k, rule))
    if lists.isEmpty():
        return links
    # What is left: pairs of a long list that no chain of links connects. One of them at least is outside the part that holds most of the list.
    parts = components(links)
    lists = lists.join(parts, F.col("name") == F.col("node"), "left").select("entry", "at", "name", "n", F.coalesce("component", "name").alias("part"))
    major = lists.groupBy("entry", "part").agg(F.count("*").alias("c")).groupBy("entry").agg(F.max(F.struct("c", "part")).alias("m"), F.count("*").alias("p")).where(F.col("p") > 1).select("entry", F.col("m.part").alias("major"))
    lists = materialize(join_hot(lists, major, "entry", hot).join(signs(begun), "name"))
    other = lists.select("entry", *(F.col(c).alias(f"{c}2") for c in ("at", "name", "n", "part", "sign")))
    once = (F.col("part") != F.col("part2")) & ((F.col("part2") == F.col("major")) | (F.col("name") < F.col("name2")))
    alike = near_signs("sign", "sign2", F.col("n"), F.col("n2"), common)
    rest = lists.where(F.col("part") != F.col("major")).join(other, "entry").where(once & fits(F.col("n"), F.col("n2"), F.col("at"), F.col("at2")) & alike)
    rest = rest.select(*pair(F.col("name"), F.col("name2"), F.col("n"), F.col("n2"))).distinct()
    return links.unionByName(verified(rest, begun, texts, k, rule, signed=True))


def signs(begun: DataFrame) -> DataFrame:
    return begun.where(F.col("sign").isNotNull()).groupBy("name").agg(F.first("sign").alias("sign"))


def near_signs(x: str, y: str, n, m, common):
    differ = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(SIGNATURE)), F.lit(0))
    return (differ(x, y) <= n - common(n, m)) & (differ(y, x) <= m - common(n, m))


def verified(pairs: DataFrame, begun: DataFrame, texts: DataFrame, k: int, rule: Rule, signed: bool = False) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link: those whose signatures and bitmaps allow it are compared on whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not signed:
        own = signs(begun)
        common = lambda n, m: F.ceil(rule.num * (n + m) / (rule.num + rule.den))
        side = lambda key, x: own.select(F.col("name").alias(key), F.col("sign").alias(x))
        pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(near_signs("x", "y", F.col("n_a"), F.col("n_b"), common)).select("a", "b", "n_a", "n_b")
    pairs = materialize(pairs)
    tidy(begun.sparkSession)
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    maps = materialize(begun.where(F.col("bitmap").isNotNull()).select("name", "doc_id", "bitmap").join(ends, "name", "left_semi").groupBy("name").agg(F.min(F.struct("doc_id", "bitmap")).alias("m")).select("name", "m.doc_id", "m.bitmap"))
    side = lambda key, m: maps.select(F.col("name").alias(key), F.col("bitmap").alias(m))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "n_a", "n_b", "x", "y")

    def allowed(batches):
        for batch in batches:
            keep = [may_link(rule, n, m, np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    likely = materialize(arrow_map(both, allowed, "a long, b long"))
    ends = likely.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    ids = materialize(maps.select("name", "doc_id").join(ends, "name", "left_semi"))
    if ids.isEmpty():
        return likely
    wanted = bit_filter(ids.select(F.xxhash64("doc_id").alias("h")), "h")
    # One document of each set is read again; rows that repeat it give the same members.
    sets = full_sets(texts, k, wanted).join(ids.withColumnRenamed("doc_id", "of"), "name").where(F.col("doc_id") == F.col("of")).groupBy("name").agg(F.first("members").alias("members"))
    sets = materialize(sets)
    tidy(begun.sparkSession)
    return compared(likely, sets, rule)


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each linked group (the least id) and all that link with nothing; columns of docs.

    Only rows whose id may be that of a row to leave out (a fixed-size filter of
    hashed ids) go through an exact join; all others pass where they are.
    """
    rows, sets = classes(docs, k, num, den)
    rows = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "key").agg(F.first("n").alias("n"), F.first("name").alias("name"), F.count("*").alias("times"))
    least = rows.where(F.col("n") > 0).groupBy("name").agg(F.min(F.struct("doc_id", "key")).alias("least")).join(sets, "name", "left").withColumn("class", F.coalesce("class", "name"))
    best = least.groupBy("class").agg(F.min("least").alias("best"))
    kept = materialize(best.select("best.doc_id", "best.key").unionByName(rows.where(F.col("n") == 0).select("doc_id", "key")))
    gone = rows.where(F.col("times") > 1).select("doc_id").unionByName(rows.select("doc_id", "key").join(kept, ["doc_id", "key"], "left_anti").select("doc_id"))
    doubtful = bit_filter(gone.select(F.xxhash64("doc_id").alias("h")), "h")

    @F.arrow_udf("boolean")
    def may_go(h: pa.Array) -> pa.Array:
        return pa.array(in_filter(doubtful, h.to_numpy().view(np.uint64)))

    mark, own, key = fresh(docs, "mark"), fresh(docs, "own"), fresh(docs, "key")
    own_id = F.col("doc_id").cast("long")
    marked = docs.withColumn(mark, may_go(F.coalesce(F.xxhash64(own_id), F.lit(0).cast("long"))))
    sure = marked.where(~F.col(mark) | own_id.isNull()).drop(mark)
    some = marked.where(F.col(mark) & own_id.isNotNull()).withColumn(own, own_id).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    some = some.join(kept.select(F.col("doc_id").alias(own), F.col("key").alias(key)), [own, key], "left_semi").dropDuplicates([own, key])
    return sure.unionByName(some.select(*docs.columns))
