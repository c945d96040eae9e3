"""Readers: posts, edge files, partitions, tag dictionaries, graph snapshots; explicit schemas, tolerant of bad rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import any_present, ejson_date

#: The nested fields that the edge builders need.
FIELDS = ("id", "created_at", "text", "user.id", "user.screen_name", "hashtagEntities", "userMentionEntities", "in_reply_to_user_id", "retweeted_status.id", "retweeted_status.created_at", "retweeted_status.text", "retweeted_status.user.id", "retweeted_status.user.screen_name")


def posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Posts with the full nested schema; columnar formats read only the fields that a plan uses."""
    return spark.read.format(fmt).schema(schemas.POST).load(path)


def ejson_posts(spark: SparkSession, path: str) -> DataFrame:
    """Extended JSON, where times are {"$date": ...}."""
    instant = "struct<`$date`: string>"
    raw = schemas.POST.replace("created_at timestamp", f"created_at {instant}").replace("created_at: timestamp", f"created_at: {instant}")
    df = spark.read.schema(raw).json(path)
    inner = F.col("retweeted_status").withField("created_at", ejson_date("retweeted_status.created_at")).withField("user", F.col("retweeted_status.user").withField("created_at", ejson_date("retweeted_status.user.created_at")))
    return df.withColumn("created_at", ejson_date("created_at")).withColumn("user", F.col("user").withField("created_at", ejson_date("user.created_at"))).withColumn("retweeted_status", F.when(F.col("retweeted_status").isNotNull(), inner))


def mongo_posts(spark: SparkSession, uri: str, database: str, collection: str) -> DataFrame:
    """Posts from MongoDB; needs Spark's MongoDB connector on the class path, which pushes filters and fields down."""
    return spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection).schema(schemas.POST).load()


def scan(df: DataFrame, start: datetime | None = None, end: datetime | None = None, present: tuple[str, ...] = (), fields: tuple[str, ...] | None = None) -> DataFrame:
    """Range on created_at [start, end), rows with any of the fields present, projection. Order is not needed: buckets are found by value."""
    if start is not None:
        df = df.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("created_at") < F.lit(end))
    if present:
        df = df.where(any_present(*present))
    return df.select(*fields) if fields else df


def date_chunks(start: datetime, end: datetime, days: int = 2) -> Iterator[tuple[datetime, datetime]]:
    """[a, b) ranges that cover [start, end)."""
    while start < end:
        nxt = min(start + timedelta(days=days), end)
        yield start, nxt
        start = nxt


def id_chunks(df: DataFrame, column: str, size: int) -> DataFrame:
    """(start, end): [start, end) ranges of a numeric column that cover its least and largest value, both included; made where they are used, however many."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.range(0).select(F.col("id").alias("start"), F.col("id").alias("end"))
    steps = df.sparkSession.range((high - low) // size + 1)
    start = F.lit(low) + F.col("id") * size
    return steps.select(start.alias("start"), F.least(start + size, F.lit(high + 1)).alias("end"))


def sample(df: DataFrame, n: int, seed: int = 42, arrays: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """n random rows, drawn alike for a seed and row contents (or the key, by the MD5 of seed and key); null arrays become empty."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))) if key else F.xxhash64(F.lit(seed), F.to_json(F.struct("*")))
    drawn = df.withColumn("_order", order)
    out = drawn.orderBy("_order", *([key] if key else [])).limit(n).drop("_order")
    for a in arrays:
        out = out.withColumn(a, F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)))
    return out


def first_per_key(df: DataFrame, key: Column | str, value: Column | str, order: Column | str, keys: DataFrame | None = None) -> DataFrame:
    """(key, value) of the earliest row of each key, of the given keys only."""
    rows = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"), (F.col(order) if isinstance(order, str) else order).alias("o"))
    if keys is not None:
        rows = rows.join(keys.select(F.col(keys.columns[0]).alias("key")).distinct(), "key", "left_semi")
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min_by("value", F.struct("o", "value")).alias("value"))


def _text_rows(spark: SparkSession, paths, n: int, sep: str) -> DataFrame:
    """Lines of exactly n fields; others are left out."""
    import re

    parts = spark.read.text(paths).select(F.split("value", re.escape(sep)).alias("f"))
    return parts.where(F.size("f") == n)


def edge_file(spark: SparkSession, paths, sep: str = ",", bucketed: bool = False) -> DataFrame:
    """rel, src, dst[, bucket], weight of headerless files; malformed rows are left out."""
    rows = _text_rows(spark, paths, 5 if bucketed else 4, sep)
    number = lambda i, kind: F.col("f")[i].try_cast("double").try_cast(kind)
    out = rows.select(number(0, "int").alias("rel"), F.trim(F.col("f")[1]).alias("src"), F.trim(F.col("f")[2]).alias("dst"), *([F.col("f")[3].try_cast("double").alias("bucket")] if bucketed else []), number(4 if bucketed else 3, "bigint").alias("weight"))
    return out.dropna()


def tweet_edge_file(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    rows = _text_rows(spark, paths, 5, sep)
    out = rows.select(F.col("f")[0].try_cast("int").alias("rel"), F.col("f")[1].alias("src"), F.col("f")[2].alias("dst"), F.col("f")[3].try_cast("double").alias("t_src"), F.col("f")[4].try_cast("double").alias("t_dst"))
    return out.dropna()


def partition_file(spark: SparkSession, path: str) -> DataFrame:
    """A wide partition file (id, name, type, one column per resolution) in long form."""
    from ..operators.partition import long

    return long(spark.read.option("header", True).csv(path))


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, tag_text) of a node map file's tag rows; one text for each tag."""
    rows = spark.read.schema("original string, node string, map_type int").csv(path)
    return rows.where(F.col("map_type") == int(schemas.MapKind.HASHTAG)).groupBy(F.col("node").alias("tag")).agg(F.max("original").alias("tag_text"))


def csv_rows(spark: SparkSession, paths, schema: str, header: bool = False) -> DataFrame:
    return spark.read.option("mode", "DROPMALFORMED").csv(paths, schema=schema, header=header)


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) written by sinks.snapshot."""
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
