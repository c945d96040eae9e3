"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and all rows that the stage before kept;
all but the last return the columns of ``documents`` and any others there are. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starling.llm import mixing, packing, pii, similarity, toxicity
from starling.llm.common import materialize, table
from starling.llm.queries import word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go; null and empty texts stay, and without labels of both classes all rows do."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the least id stays; of rows with equal id and text, one. Rows without words or without an id link with nothing."""
    return similarity.deduplicated(docs, k=5, num=80, den=100)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain or disguised, become the names of their kinds, and n_chars is counted anew; null texts stay null, every row stays."""
    return pii.redact(docs, "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out towards their target weights; null is a source, and rows without words are in no mixture."""
    return mixing.mixed(docs, weights=(5, 2, 1), epochs=1.5, cap=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048; a null or empty text is a piece of its closing id alone."""
    return packing.pack(docs, word_tokenizer(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained dictionaries, component search and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
