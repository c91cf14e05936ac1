"""Scans over the ordered rows of a key that may hold all rows: slices in parallel, what passes their borders by a second small step.

:func:`placed` deals rows in order over ranges of (key, order); a range is a slice, and a key's rows may fill many. Within a slice a scan
is a window; across slices only the first (last) key of each slice can have something to take over, so that what is carried is a row a
slice at most, and is broadcast. Chains of choices, each of which decides where the next one may be, are followed by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.operators.tables import cut


def _ranged(df: DataFrame, key: str, order: list[str], slices: int | None) -> DataFrame:
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    return dealt.withColumn("_at", F.monotonically_increasing_id())


def placed(df: DataFrame, key: str, order: list[str], *, slices: int | None = None) -> DataFrame:
    """``df`` with ``_at``, which grows with (key, order) and tells rows apart, written once into the shared folder.

    Rows equal in key and order stand in any order, but in one; they are one slice, so give an order that tells rows apart.
    """
    return cut(_ranged(df, key, order, slices))


def _slice() -> Column:
    return F.shiftright("_at", 33)  # the partition's part of monotonically_increasing_id


def carry(df: DataFrame, key: str, value: Column, name: str, *, backward: bool = False, inclusive: bool = True) -> DataFrame:
    """The last non-null ``value`` of the key up to each row of a :func:`placed` table; the next one with ``backward``. Without
    ``inclusive`` the row's own value doesn't count. A null key is a key of its own."""
    at = F.desc("_at") if backward else F.asc("_at")
    x = df.withColumn("_slice", _slice()).withColumn("_v", value)
    w = Window.partitionBy("_slice", key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    last = F.min_by if backward else F.max_by
    ends = x.groupBy(key, "_slice").agg(last("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    order = F.desc("_slice") if backward else F.asc("_slice")
    before = F.last("_end", True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    over = ends.select(F.col(key).alias("_key"), F.col("_slice").alias("_from"), before.alias("_over")).where("_over is not null")
    x = x.withColumn(name, F.last("_v", True).over(w))
    x = x.join(F.broadcast(over), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_from")), "left")
    return x.withColumn(name, F.coalesce(name, "_over")).drop("_slice", "_v", "_key", "_from", "_over")


def running_sum(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """The sum of the key's values up to each row of a :func:`placed` table, itself included; null counts as 0."""
    x = df.withColumn("_slice", _slice()).withColumn("_v", F.coalesce(value, F.lit(0)))
    w = Window.partitionBy("_slice", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = x.groupBy(key, "_slice").agg(F.sum("_v").alias("_end"))
    before = F.sum("_end").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    over = ends.select(F.col(key).alias("_key"), F.col("_slice").alias("_from"), before.alias("_over")).where("_over is not null")
    x = x.withColumn(name, F.sum("_v").over(w))
    x = x.join(F.broadcast(over), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_from")), "left")
    return x.withColumn(name, F.col(name) + F.coalesce("_over", F.lit(0))).drop("_slice", "_v", "_key", "_from", "_over")


def exponential(df: DataFrame, key: str, order: list[str], value: str, name: str, *, alpha: float, slices: int | None = None) -> DataFrame:
    """``key``, ``order`` and ``name``: the exponential average of the key's ordered values (no nulls), which starts at the first one.

    A slice works as if its first row began the key, and also gives the weight that an earlier average would have; the difference is
    added once the ends of the slices before are known.
    """
    kept = df.select(key, *order, F.col(value).cast("double").alias("_value"))
    told = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in (key, *order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = run  # no key is equal to it
        e = weight = head = 0.0
        for b in batches:
            rows = []
            for k, v in zip(b[key], b["_value"], strict=True):
                if k == at or (pd.isna(k) and pd.isna(at)):
                    e, weight = alpha * v + (1 - alpha) * e, weight * (1 - alpha)
                else:
                    at, e, weight, head = k, v, 1 - alpha, v
                rows.append((e, weight, head))
            yield b.drop(columns="_value").assign(**dict(zip(("_e", "_weight", "_head"), zip(*rows, strict=True), strict=True)))

    x = cut(_ranged(kept, key, order, slices).mapInPandas(run, f"{told}, _at long, _e double, _weight double, _head double"))
    x = x.withColumn("_slice", _slice())
    ends = x.groupBy(key, "_slice").agg(F.max_by(F.struct("_e", "_weight", "_head"), "_at").alias("_end"))
    many = ends.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n > 1")

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, e = [], None
        for s, fresh, weight, head in pdf.sort_values("_slice")[["_slice", "_e", "_weight", "_head"]].itertuples(index=False):
            if e is not None:
                rows.append((s, e))
            e = fresh + (weight * (e - head) if e is not None else 0.0)
        return pd.DataFrame(rows, columns=["_from", "_over"]).assign(_key=pdf[key].iloc[0])

    flat = many.select(key, "_slice", "_end.*")
    carried = flat.groupBy(key).applyInPandas(over, f"_from long, _over double, _key {kept.schema[key].dataType.simpleString()}")  # a row a slice at most
    x = x.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_from")), "left")
    return x.select(key, *order, (F.col("_e") + F.coalesce(F.col("_weight") * (F.col("_over") - F.col("_head")), F.lit(0.0))).alias(name))


def reached(nodes: DataFrame) -> DataFrame:
    """``at`` of the nodes (``at, next, head``) that chains of ``next`` from the heads lead through, the heads included.

    Pointer doubling: table k holds 2^k steps at once, until no chain is that long; from the longest jumps down, what is found jumps
    once more. A chain of n nodes takes 2 log2(n) joins, all on ``at``, which is never hot. Chains of different heads must not meet.
    """
    jumps = [cut(nodes.where("next is not null").select("at", "next"))]
    while True:
        a, b = jumps[-1], jumps[-1].select(F.col("at").alias("next"), F.col("next").alias("_further"))
        twice = cut(a.join(b, "next").select("at", F.col("_further").alias("next")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    found = nodes.where("head").select("at")
    for j in reversed(jumps):
        found = cut(found.unionByName(found.join(j, "at").select(F.col("next").alias("at"))))
    return found
