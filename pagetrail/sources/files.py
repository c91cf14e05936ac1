"""Readers and writers: JSON artefacts, JSON lines, dictionaries, page lines, alignments, fingerprints."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _or_empty(spark: SparkSession, read, schema) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_json_artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or object; a missing or damaged file gives no rows."""
    parsed = _or_empty(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True), schema)
    return parsed


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON object a line; blank and damaged lines are skipped."""
    return _or_empty(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), schema)


def load_table(spark: SparkSession, path: str, *, non_empty: str | None = None, order_by: str | None = None, **jdbc: str) -> DataFrame:
    """A Parquet folder, or a table over JDBC where ``url`` is given, without rows whose ``non_empty`` column is blank."""
    df = spark.read.format("jdbc").options(dbtable=path, **jdbc).load() if "url" in jdbc else spark.read.parquet(path)
    df = df.where(F.trim(F.coalesce(non_empty, F.lit(""))) != "") if non_empty else df
    return df.orderBy(order_by) if order_by else df


def parse_dictionary(lines: DataFrame, *, pdf_id: str = "manual_dictionary") -> DataFrame:
    """Lines ``word,phonetic`` or ``word,english,phonetic`` as distinct lower-case pairs; a heading and blanks are dropped."""
    c = F.split("line", ",")
    at = lambda i: F.lower(F.trim(F.get(c, F.lit(i))))
    pairs = lines.select(at(0).alias("armenian"), F.when(F.size(c) >= 3, at(2)).otherwise(at(1)).alias("phonetic"))
    heading = F.col("armenian").contains("armenian") & F.col("phonetic").contains("phonetic")
    kept = pairs.where((F.col("armenian") != "") & (F.col("phonetic") != "") & ~heading).distinct()
    return kept.select(F.lit(pdf_id).alias("pdf_id"), "armenian", "phonetic", F.lit(1).alias("occurrences"), F.lit(1.0).alias("confidence"))


def read_dictionary_csv(spark: SparkSession, path: str, *, pdf_id: str = "manual_dictionary") -> DataFrame:
    return parse_dictionary(_or_empty(spark, lambda: spark.read.text(path).withColumnRenamed("value", "line"), "line string"), pdf_id=pdf_id)


def parse_page_lines(lines: DataFrame) -> DataFrame:
    """``page_number, armenian_text, english_text`` from lines ``number|text|english`` (``doc, pos, line``) of two parts at least; a
    missing number is the running number of the document's good lines."""
    from pyspark.sql import Window

    c = F.split("line", r"\|")
    good = lines.where(F.size(c) >= 2).withColumn("_n", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    return good.select("doc", F.coalesce(F.trim(F.get(c, F.lit(0))).try_cast("int"), F.col("_n")).alias("page_number"), F.trim(F.get(c, F.lit(1))).alias("armenian_text"), F.coalesce(F.trim(F.get(c, F.lit(2))), F.lit("")).alias("english_text"))


def read_alignment_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "page int, timestamp double, confidence double"
    return _or_empty(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path, comment="#"), schema)


def default_if_zero(col: Column, default) -> Column:
    """The column, or the default where it is null or 0."""
    return F.coalesce(F.nullif(col, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def load_fingerprints(raw: DataFrame) -> DataFrame:
    """Fingerprints as rows: page 1, source ``training_data``, start 0, confidence 0.8 where they are null or 0, and the end by the end
    time, else the duration, else 60."""
    end = default_if_zero(F.col("endTime"), default_if_zero(F.col("duration"), 60.0))
    return raw.select(default_if_zero(F.col("pageNumber"), 1).alias("page_number"), F.to_json("features").alias("fingerprint_data"), F.coalesce(F.nullif("source", F.lit("")), F.lit("training_data")).alias("audio_source"), F.coalesce("startTime", F.lit(0.0)).alias("timestamp_start"), end.alias("timestamp_end"), default_if_zero(F.col("confidence"), 0.8).alias("confidence"), F.lit(True).alias("confirmed"))


def write_result(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
