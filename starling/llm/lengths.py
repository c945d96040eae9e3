"""Exact histogram of encoded lengths, and what it answers for every context limit.

Each task counts its documents by encoded length and sends one row per length;
suffix sums over the summed histogram give, for each limit, the documents that
fit, the documents cut, the tokens kept when longer documents are cut at the
limit, and the share of documents at or below it (so every exact quantile).
Sums run in two levels (blocks of lengths, then inside a block), so no task
orders all lengths.

Defined results: null or empty texts have length 0 and count; repeated rows
count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .tokens import WordEncoder

BLOCK = 256


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens, n_docs) of the column text."""
    schema = pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def counted(batches):
        encoder, counts = WordEncoder(tokenizer), Counter()
        for batch in batches:
            counts.update(len(x) // 4 for x in encoder.encode(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    parts = arrow_map(docs.select(F.col("text").cast("string")), counted, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs, taken as context limit: documents and tokens up to it, above it, and kept when cutting there."""
    hist = materialize(hist)  # read twice below
    rows = hist.withColumn("block", F.expr(f"n_tokens div {block}")).withColumn("n_sum", F.col("n_docs") * F.col("n_tokens"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_sum").alias("t"))
    upto = Window.orderBy("block")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", (F.sum("d").over(upto) - F.col("d")).alias("d0"), (F.sum("t").over(upto) - F.col("t")).alias("t0"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy("n_tokens")
    out = rows.join(blocks, "block").withColumn("docs_within", F.col("d0") + F.sum("n_docs").over(within)).withColumn("tokens_within", F.col("t0") + F.sum("n_sum").over(within))
    docs_above = F.col("all_docs") - F.col("docs_within")
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_within",
        docs_above.alias("docs_above"),
        (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_above"),
        (F.col("tokens_within") + docs_above * F.col("n_tokens")).alias("truncated_tokens"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("docs_within") / F.col("all_docs")).alias("share_within"),
    )


def quantile(answers: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents does not exceed."""
    row = answers.where(F.col("share_within") >= q).agg(F.min("context_limit").alias("x")).first()
    return row.x


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at the limit, any limit."""
    return hist.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")).alias("x")).first().x or 0
