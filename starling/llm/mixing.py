"""Mixing sources to target weights by capped water-filling.

The wanted total is shared among sources by weight; a source stops at
``max_epochs`` times its own size and its excess is shared among the others by
weight, until none is above its cap. In the order of cap / weight the sources
at their cap come first, so one pass of running sums finds the level; the sums
run inside ranges of sources, whose totals are added up first.

A target of r epochs takes every document floor(r) times, and a seeded part of
the documents once more: documents lie in an order drawn from a hash of seed and
id, and are taken until the fraction is reached. The order is found in two
steps, a histogram of ``BUCKETS`` hash ranges per source (summed where the rows
are) and a running sum inside the one range where the fraction ends, so no task
sorts a source. What a document needs to know is one row per source, which is
broadcast up to ``FEW_SOURCES`` rows; beyond, only the rows of hot sources are.
The document at the end is taken for the words still missing:
what a source gives differs from its target by less than a word.

Only DataFrame functions are used. Defined results: null texts have size 0;
null is the last source; a null id is an id of its own; repeated rows are
taken each for itself; a table without words or rows has target 0 and takes
nothing; extra columns, whatever their names, are ignored by ``mix`` and stay
in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before_each, fresh, join_hot, materialize

FEW_SOURCES = 10_000

BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hashed(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def bucket(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 3), 16, 10).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...], epochs: float, cap: float) -> DataFrame:
    """(source, source_size) -> with target; a source's weight is taken in turn from `weights`, by code point, null last."""
    by_name = [F.col("source").asc_nulls_last()]
    s = before_each(sources, by_name, nth=F.lit(1))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")).drop("nth")
    s = materialize(before_each(s, [(F.col("source_size") / F.col("w")).asc(), *by_name], before=F.col("source_size"), weight_before=F.col("w")))
    whole = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weight"))  # one row
    # What each unit of weight still gets when the sources before are at their caps; the first that stays below its cap sets the level of all after it.
    s = s.join(F.broadcast(whole)).withColumn("unit", (epochs * F.col("total") - cap * F.col("before")) / (F.col("weight") - F.col("weight_before")))
    level = s.agg(F.min(F.when(F.col("w") * F.col("unit") <= cap * F.col("source_size"), F.struct(F.col("before").alias("b"), F.col("unit").alias("u"))))["u"].alias("level"))
    target = F.least(cap * F.col("source_size"), F.coalesce(F.col("w") * F.col("level"), cap * F.col("source_size")))
    return s.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def source_key(source: Column) -> Column:
    """Not null, and different for every source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def shares(sized: DataFrame, weights: tuple[int, ...], epochs: float, cap: float) -> DataFrame:
    """sized (source, bucket, size) -> for each source (key): its size, target, whole epochs, and where the fraction ends (edge bucket, words before it)."""
    counts = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    plan = targets(counts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("part", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")).withColumn("key", source_key(F.col("source"))).drop("source")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    upto = counts.withColumn("before", before).select(source_key(F.col("source")).alias("_key"), "bucket", "n", "before")
    ends = plan.join(upto, (F.col("key") == F.col("_key")) & (F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("n")), "left")
    return materialize(ends.select("key", "source_size", "target", "whole", "part", F.coalesce("bucket", F.lit(-1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")))


def meet(rows: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """rows with the columns of ends as one struct, `ends`."""
    one = ends.select(F.col("key").alias(key), F.struct(*(c for c in ends.columns if c != "key")).alias(fresh(rows, "ends")))
    return rows.join(F.broadcast(one), key) if ends.count() <= FEW_SOURCES else join_hot(rows, one, key)


def missing(edge: DataFrame, order: list[str]) -> Column:
    """For rows (key, size, part, before) of the ranges where fractions end: the words taken of each, as long as some are missing."""
    own = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("part") - F.col("before") - (F.sum("size").over(own) - F.col("size"))
    return F.greatest(F.lit(0), F.least(F.col("size"), left))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each document."""
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    sized = sized.withColumn("md5", hashed(F.col("doc_id"), seed)).withColumn("bucket", bucket(F.col("md5"))).withColumn("key", source_key(F.col("source")))
    placed = meet(sized, "key", shares(sized, weights, epochs, cap)).select(*sized.columns, "ends.*")
    out = ["doc_id", "size", "source", "source_size", "target"]
    rest = placed.where(F.col("bucket") != F.col("edge")).select(*out, (F.col("whole") * F.col("size") + F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0)).alias("taken"))
    # One range in 4096 of each source.
    edge = placed.where(F.col("bucket") == F.col("edge"))
    return rest.unionByName(edge.select(*out, (F.col("whole") * F.col("size") + missing(edge, ["md5", "size", "doc_id"])).alias("taken")))


def mixed(docs: DataFrame, length_col: str | None = "n_chars", weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixture itself: each document as often as it is taken, the last time for the words still missing; columns of docs.

    Texts stay where they are, but for those in the ranges where fractions end.
    """
    names = docs.columns
    key, m, taken, left, n, other, own_m = (fresh(docs, x) for x in ("key", "m", "taken", "left", "size", "other", "own"))
    md5 = hashed(F.col("doc_id"), seed)
    ends = shares(docs.select("source", bucket(md5).alias("bucket"), words(F.col("text")).alias("size")), weights, epochs, cap)
    sized = docs.withColumn(key, source_key(F.col("source"))).withColumn(m, F.struct(words(F.col("text")).alias("size"), md5.alias("md5"), F.col("doc_id").alias("id")))
    rows = meet(sized, key, ends)
    end = rows.columns[-1]
    size, at, edge = F.col(f"{m}.size"), bucket(F.col(f"{m}.md5")), F.col(f"{end}.edge")
    sure = rows.where(at != edge).withColumn(taken, F.col(f"{end}.whole") * size + F.when(at < edge, size).otherwise(0))
    # Rows of one id and size are told apart by their number.
    nth = F.row_number().over(Window.partitionBy(key, f"{m}.md5", f"{m}.size").orderBy(F.xxhash64("text")))
    some = materialize(rows.where(at == edge).withColumn(m, F.struct(f"{m}.size", f"{m}.md5", F.col(f"{m}.id").alias("id"), nth.alias("nth"))))
    own = some.select(F.col(key).alias("key"), f"{m}.*", f"{end}.part", f"{end}.before")
    more = own.select(F.col("key").alias(other), F.struct("size", "md5", "id", "nth").alias(own_m), missing(own, ["md5", "size", "id", "nth"]).alias(taken))
    some = some.join(more, (F.col(key) == F.col(other)) & F.col(m).eqNullSafe(F.col(own_m))).withColumn(taken, F.col(f"{end}.whole") * size + F.col(taken))
    rows = sure.select(*names, taken, size.alias(n)).unionByName(some.select(*names, taken, size.alias(n))).where(F.col(taken) > 0)
    size = F.col(n)
    copies = F.ceil(F.col(taken) / size).cast("int")
    rows = rows.withColumn(left, F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.col(taken) - i * size)))
    text = F.when(F.col(left) >= size, F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, F.greatest(F.lit(1), F.col(left)).cast("int")), " "))
    rows = rows.withColumn("text", text)
    if length_col in names:
        rows = rows.withColumn(length_col, F.when(F.col(left) >= size, F.col(length_col)).otherwise(F.length("text")).cast(docs.schema[length_col].dataType))
    return rows.select(*names)


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS md5 FROM documents
), b AS (SELECT *, CAST('0x' || substr(md5, 1, 3) AS INTEGER) AS bucket FROM d
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), l AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before,
         CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, encode(source) ASC NULLS LAST)
), u AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * before) / rest AS unit FROM l
), v AS (SELECT *, (SELECT unit FROM u WHERE w * unit <= 2.0::DOUBLE * source_size ORDER BY before, unit LIMIT 1) AS level FROM u
), t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(w * level, 2.0::DOUBLE * source_size)) AS target FROM v
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT b.*, p.source_size, p.target, p.whole, CAST(round(p.target) AS BIGINT) - p.whole * p.source_size AS part,
         CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.bucket, b.md5, b.size, b.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - b.size AS ahead
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size, part - ahead)) AS BIGINT) AS taken FROM r
"""
