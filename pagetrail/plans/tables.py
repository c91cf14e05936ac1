"""The given tables in the shapes that the operators take, and the same shapes as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as book pages: page, lang, book, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "lang", F.col("source").alias("book"), "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, lang, pos, word: lower-case runs of letters, two at least."""
    return T.tokenize(sections(spark, sf_dir).select("page", "lang", F.lower("text").alias("text")), "text", pattern=r"\p{L}+", min_len=2)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries: query_id, pos, word."""
    return T.tokenize(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("text")), "text", pattern=r"\p{L}+", min_len=2)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a score log: session, event_id, ts, t (seconds), speaker, page, current_page, score, triggered."""
    e = table(spark, sf_dir, "events")
    page = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("t"), F.col("event_type").alias("speaker"), page.alias("page"), "value", F.least(F.col("value") / 50.0, F.lit(1.0)).alias("score"), (F.col("value") > 60).alias("triggered"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as page vectors: id, page, v (doubles)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("page"), F.col("embedding").cast("array<double>").alias("v"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


TOK = r"""tok AS (SELECT doc_id AS page, lang, w AS word, p AS pos FROM (
    SELECT doc_id, lang, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (
        SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) >= 2) AS ws FROM documents)))"""
ASK = r"""ask AS (SELECT item_id AS query_id, w AS word, p AS pos FROM (
    SELECT item_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (
        SELECT item_id, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) >= 2) AS ws FROM benchmark)))"""
POST = "post AS (SELECT word, page FROM tok GROUP BY word, page), df AS (SELECT word, count(*) AS df FROM post GROUP BY word)"
LOG = """log AS (SELECT user_id AS session_id, event_id, ts, epoch_us(ts) / 1000000.0 AS t, event_type AS speaker, CAST(json_extract(props, '$.k') AS INTEGER) AS page,
    value, least(value / 50.0, 1.0) AS score, value > 60 AS triggered FROM events)"""
VEC = "vec AS (SELECT vec_id AS id, label AS page, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
