"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Words are maximal runs of bytes other than the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset one is made, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagetrail-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder, in a folder for each value of ``by``, and read it back.

    Later steps then recover from the written table instead of from an executor's memory.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of ``at`` below the partition, as monotonically_increasing_id has them.
ROW_BITS = 33


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, written in the given order, with ``at``: a long that grows along it; ``at >> ROW_BITS`` is the range that a row lies in.

    Ranges are cut by a sample and sorted each in its task, with spill. Rows that the order can't tell apart are dealt by a salt, so that
    a third of all rows may be equal.
    """
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [*order, F.col("_salt").asc()]
    return cut(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("at", F.monotonically_increasing_id()))


def numbered(placed: DataFrame, key: str) -> DataFrame:
    """What :func:`in_order` gave, with ``idx``, the place of a row among those of its (never null) ``key``, and ``n``, their number.

    The rows of a key lie side by side, so a range's first row and the rows in earlier ranges tell each place; the table of those has a
    row for each key and range.
    """
    part = F.shiftright("at", ROW_BITS).alias("_part")
    firsts = placed.groupBy(key, part).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    along, whole = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    firsts = firsts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(along), F.lit(0))).withColumn("n", F.sum("_rows").over(whole))
    return placed.withColumn("_part", F.shiftright("at", ROW_BITS)).join(firsts, [key, "_part"]).withColumn("idx", F.col("_ahead") + F.col("at") - F.col("_first")).drop("_part", "_first", "_rows", "_ahead")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most ``rows`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: Rows that a Python worker holds as objects at once, beside the Arrow batch they come from.
PIECE = 256
#: Bytes of an Arrow batch: a batch is held by the executor and by its worker. Spark's own setting, where it has Spark's default.
BATCH, BATCH_DEFAULT, BATCH_SETTING = "4m", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small: sets BATCH_SETTING unless the user has."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, BATCH)
    return df


def let_go() -> None:
    """Give memory that a Python worker no longer uses back to the system, so that it doesn't lie there through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def per_row(rows: DataFrame, make: Callable[[], Callable[..., dict[str, list]]], fresh: str, *, passed: Sequence[str] = ("doc_id",), piece: int = PIECE) -> DataFrame:
    """``rows`` with the columns ``passed`` as they were and the columns ``fresh`` (a DDL string) computed in Python, a row for a row.

    ``make`` is called once a task and gives a function that takes a list of values for each other column, at most ``piece`` of them,
    and returns a list for each fresh column; what it holds on to beyond the task it lets go in a method ``done``, if it has one.
    Passed columns stay in Arrow, so that large or null ids come through unchanged.
    """
    new = StructType.fromDDL(fresh)
    schema = StructType([StructField(c, rows.schema[c].dataType) for c in passed] + list(new))
    arrow, used = to_arrow_schema(schema), [c for c in rows.columns if c not in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for i in range(0, batch.num_rows, piece):
                part = batch.slice(i, piece)
                told = compute(*(part.column(c).to_pylist() for c in used))
                columns = [part.column(f.name).cast(f.type) if f.name in passed else pa.array(told[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        getattr(compute, "done", lambda: None)()
        pa.default_memory_pool().release_unused()

    return small_batches(rows).select(*passed, *used).mapInArrow(run, schema)
