"""Streams with built-in operators: windows, dedupe, late rows, debouncing, running summaries; and a runner for what is available."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagetrail.operators.tables import shared_dir


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; see :func:`pagetrail.operators.tables.shared_dir`."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, and give what it wrote: appended rows, or the last complete result."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    w = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").start(f"{at}/rows")
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def chunk_stream(stream: DataFrame, *, length: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows of each session: rows and mean value."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", watermark).groupBy(w, "session_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))


def dedupe(stream: DataFrame, *, id: str, ttl: str, refresh: bool = False, tie: str | None = None) -> DataFrame:
    """Repeats of an id within ``ttl`` dropped. With ``refresh`` each repeat extends the time, as a cache that is touched does; then
    ``ttl`` is in seconds of the column ``t``, and in a micro-batch all rows of an id are taken by ``t``, equal ones by ``tie``."""
    if not refresh:
        return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([id])
    life = float(ttl.split()[0])

    def once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else float("-inf")
        b = pd.concat(list(batches)).sort_values(["t", tie] if tie else "t", kind="stable")  # an id's rows come in parts, in no order
        t = b["t"].to_numpy()
        ends = np.fmax.accumulate(np.r_[until, t + life])  # a null time ends nothing
        state.update((float(ends[-1]),))
        yield b[t >= ends[:-1]]

    return stream.groupBy(id).applyInPandasWithState(once, stream.schema, "until double", "append", GroupStateTimeout.NoTimeout)


def split_late(stream: DataFrame, *, since: Column) -> tuple[DataFrame, DataFrame]:
    """Rows from ``since`` on, and counts of the others by reason."""
    reason = F.when(F.col("ts").isNull(), "invalid").when(F.col("ts") < since, "stale")
    return stream.where(reason.isNull()), stream.where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def debounce(stream: DataFrame, *, key: str, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Items of a key gathered until it is quiet for ``gap``."""
    return stream.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("event_id")).alias("items"))


def debounce_with_bypass(stream: DataFrame, *, key: str, gap_sec: float, bypass: str, watermark: str = "1 hour") -> DataFrame:
    """Items (``ts, t`` in seconds, ``event_id``) of a key gathered until it is quiet for ``gap_sec``: ``key, t, n, items``. An item for
    which the column ``bypass`` holds, or without a key, waits for nothing: what its key has gathered goes first, then it goes alone.
    A buffer that is still open goes when the watermark has passed its gap."""
    kind = stream.schema[key].dataType.simpleString()
    item = stream.schema["event_id"].dataType.simpleString()

    def gather(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = json.loads(state.get[0]) if state.exists else [], []

        def flush(items: list) -> None:
            if items:
                out.append((group[0], items[0][0], len(items), [i for _, i in items]))

        if state.hasTimedOut:
            flush(held)
            held = []
        else:
            rows = pd.concat([b for b in batches]).sort_values(["t", "event_id"])
            for t, i, alone in zip(rows["t"], rows["event_id"], rows[bypass], strict=True):
                if held and t >= held[-1][0] + gap_sec:
                    flush(held)
                    held = []
                if alone or pd.isna(group[0]):
                    flush(held)
                    held = []
                    flush([(float(t), i)])
                else:
                    held.append((float(t), int(i) if isinstance(i, np.integer) else i))
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(int((held[-1][0] + gap_sec) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "t", "n", "items"])

    used = stream.withWatermark("ts", watermark).select(key, "ts", "t", "event_id", bypass)
    return used.groupBy(key).applyInPandasWithState(gather, f"{key} {kind}, t double, n long, items array<{item}>", "items string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_session_summary(stream: DataFrame) -> DataFrame:
    return stream.groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("triggered").alias("triggered"), F.avg("score").alias("avg"), F.min("score").alias("min"), F.max("score").alias("max"))


def latest_state(stream: DataFrame, *, key: str, state: str, lo: int, hi: int) -> DataFrame:
    """The state of each key at its latest time, within a range."""
    return stream.groupBy(key).agg(F.max_by(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(state))), F.struct("ts", "event_id")).alias("state"))
