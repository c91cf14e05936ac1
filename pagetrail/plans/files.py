"""Queries of the readers and writers: tables are written in the formats that they read, into the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.sources import files as S
from pagetrail.streaming.flows import folder

from .registry import query
from .tables import LOG, entries, sections, table


@query("SELECT event_id, event_type AS kind, value FROM events WHERE event_id % 10 <> 0")
def a2_read_jsonl(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    line = F.when(F.col("event_id") % 10 == 0, "{ damaged").otherwise(F.to_json(F.struct("event_id", "kind", "value")))
    e.select(line.alias("value")).write.text(at := folder(spark))
    return S.read_jsonl(spark, at, "event_id long, kind string, value double")


@query("SELECT source AS book, doc_id AS page FROM documents")
def a1_read_json_artifact(spark, d):
    rows = sections(spark, d).groupBy("book").agg(F.to_json(F.collect_list(F.struct("book", "page"))).alias("value"))
    rows.select("value").repartition(F.xxhash64("value")).write.text(at := folder(spark), lineSep="\n")
    lines = S.read_json_artifact(spark, f"{at}-missing", "book string, page long")
    return lines.unionByName(spark.read.schema("book string, page long").json(at))


@query("SELECT doc_id, source FROM documents WHERE trim(text) <> ''")
def a3_load_table(spark, d):
    return S.load_table(spark, f"{d}/documents.parquet", non_empty="text", order_by="doc_id").select("doc_id", "source")


@query(f"WITH {LOG} SELECT page, t AS timestamp, score AS confidence FROM log")
def a6_read_alignment(spark, d):
    e = entries(spark, d).select("page", F.col("t").alias("timestamp"), F.col("score").alias("confidence"))
    line = F.when(F.col("page") % 5 == 0, F.concat(F.lit("# page "), F.col("page").cast("string"), F.lit("\n"))).otherwise("")
    e.select(F.concat(line, F.concat_ws(",", *[F.col(c).cast("string") for c in e.columns])).alias("value")).write.text(at := folder(spark))
    return S.read_alignment_csv(spark, at)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a11_write_result(spark, d):
    S.write_result(table(spark, d, "documents").select("doc_id", "lang"), at := folder(spark), partition_by=("lang",))
    return spark.read.parquet(at).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
