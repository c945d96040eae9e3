"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def word_tokenizer() -> str:
    """The default vocabulary file."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer(), capacity=2048, end_id=0)


@query
def op3_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lengths import histogram, limits

    return limits(histogram(table(spark, sf_dir, "documents"), word_tokenizer()))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import digests

    return digests(table(spark, sf_dir, "documents"))


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, factor=256.0)


ORACLES["op4_exact_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.nth, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.nth <> c.nth AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=1.5, cap=2.0).drop("source")


def _op6_sql() -> str:
    from .mixing import MIX_SQL

    return MIX_SQL


ORACLES["op6_mixing"] = _op6_sql()


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similarity import groups

    return groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import RULES, judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def _op5_sql() -> str:
    from .urlfilter import judge_sql

    return judge_sql()


ORACLES["op5_url_filter"] = _op5_sql()


ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 90 * (u.n + v.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
