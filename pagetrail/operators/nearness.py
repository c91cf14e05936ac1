"""Near items dropped as a serial store drops them: in order of id, each against those kept so far.

Only near cells meet. Every item is at home in the cell of its nearest pivot, in a ring of its distance from it; one that asks visits the
cells and rings in which, by the triangle inequality, something within the radius can be at home. Where the radius is so wide that an item
would visit more cells than there are blocks of items, all are one cell, and blocks meet. Choices are made in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import ITEM_BLOCK, TILE, scores
from .tables import cut

#: Pivots at most, and items a pivot below that: the pivots' vectors go into each task.
MOST_PIVOTS, SHARE = 1024, 256
#: What distances may be off by, absolute and relative.
SLACK = 1e-6
#: Rows of a block that asks, and that one batch of visits passes on.
QUERY_BLOCK, PASSED = 16_384, 8192
#: Parts that the copies of one vector are dealt to.
SALT = 16


def pivots(items: DataFrame) -> np.ndarray:
    """At most MOST_PIVOTS vectors, by the hash of their ids; which ones they are changes the work and not the result."""
    n = min(MOST_PIVOTS, max(1, items.count() // SHARE))
    rows = items.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
    return np.array([r.v for r in rows], float)


def at_home(items: DataFrame, centres: np.ndarray, radius: float) -> DataFrame:
    """``items`` (``id, v``) with their ``cell`` and ``ring``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = 1 / scores(np.stack(b["v"].to_numpy()), centres, "l2") - 1
                cell = d.argmin(1)
                yield b.assign(cell=cell.astype("int32"), ring=np.floor(d[np.arange(len(b)), cell] / radius).astype("int64"))

    return items.mapInPandas(run, "id long, v array<double>, cell int, ring long")


def _reached(mat: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, ...]:
    """Rows and the cells that they visit, with the first ring and the number of rings of each.

    What is at home in a cell has no nearer pivot, so the cell's pivot is at most twice the radius farther than the item's own nearest
    one; and its distance from the pivot differs from the item's by the radius at most.
    """
    d = 1 / scores(mat, centres, "l2") - 1
    slack = SLACK * (1 + d)
    row, cell = np.nonzero(d - slack <= d.min(1, keepdims=True) + 2 * radius)
    at, off = d[row, cell], slack[row, cell]
    lo = np.maximum(np.floor((at - off - radius) / radius), 0).astype("int64")
    return row, cell, lo, np.floor((at + off + radius) / radius).astype("int64") - lo + 1


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return (b.iloc[at : at + TILE] for b in batches for at in range(0, len(b), TILE))


def visited(items: DataFrame, centres: np.ndarray, radius: float) -> int:
    """How many rows :func:`visits` has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _tiles(batches):
            yield pd.DataFrame({"n": [int(_reached(np.stack(b["v"].to_numpy()), centres, radius)[3].sum())]})

    return items.select("v").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def visits(items: DataFrame, centres: np.ndarray, radius: float) -> DataFrame:
    """A row for each ``cell`` and ``ring`` in which something within ``radius`` of an item can be at home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _tiles(batches):
            row, cell, lo, n = _reached(np.stack(b["v"].to_numpy()), centres, radius)
            each = np.repeat(np.arange(len(row)), n)
            ring = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            ids, vs = b["id"].to_numpy(), b["v"].to_numpy()
            for k in range(0, len(each), PASSED):
                part = each[k : k + PASSED]
                yield pd.DataFrame({"id": ids[row[part]], "v": vs[row[part]], "cell": cell[part].astype("int32"), "ring": ring[k : k + PASSED]})

    return items.mapInPandas(run, "id long, v array<double>, cell int, ring long")


def met_blocks(asking: DataFrame, home: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the blocks ``cell, ring, a, b`` that they meet in; a cell of any size is dealt to as many as it takes."""
    key = ["cell", "ring"]
    sizes = asking.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("_na")).join(home.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ITEM_BLOCK).alias("_nb")), key)
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = asking.join(sizes, key).withColumn("a", mine("_na")).withColumn("b", every("_nb")).drop("_na", "_nb")
    right = home.join(sizes, key).withColumn("b", mine("_nb")).withColumn("a", every("_na")).drop("_na", "_nb")
    return left, right


def smallest_met(asking: DataFrame, home: DataFrame, min_score: float) -> DataFrame:
    """``id, other``: the smallest smaller id at home within the score, for those that have one; a block passes on a row an item at most."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": []})
        left, right = left.sort_values("id"), right.sort_values("id")
        ids, others, mat, held = left["id"].to_numpy(), right["id"].to_numpy(), np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        told = [(ids[:0], others[:0])]
        for at in range(0, len(ids), TILE):
            rest, lo, size = np.arange(at, min(at + TILE, len(ids))), 0, TILE
            while len(rest) and lo < len(others) and others[lo] < ids[rest[-1]]:  # upwards, until each has met one
                near = (scores(mat[rest], held[lo : lo + size], "l2").round(9) >= min_score) & (others[None, lo : lo + size] < ids[rest, None])
                hit = near.any(1)
                told.append((ids[rest[hit]], others[lo + near[hit].argmax(1)]))
                rest, lo, size = rest[~hit], lo + size, min(2 * size, 4096)
        return pd.DataFrame(dict(zip(("id", "other"), map(np.concatenate, zip(*told, strict=True)), strict=True)))

    left, right = met_blocks(asking, home)
    key = ("cell", "ring", "a", "b")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(work, "id long, other long").groupBy("id").agg(F.min("other").alias("other"))


def serial_near_duplicates(items: DataFrame, *, min_score: float = 0.95) -> DataFrame:
    """``id, duplicate_of`` of the dropped items: what a store keeps that takes items (``id, v``) in order of id and drops one that is
    within ``min_score`` (1 / (1 + Euclidean distance)) of a kept one; ``duplicate_of`` is the smallest such.

    Equal vectors share their fate and go as one. In a round an item asks for the smallest id within reach that isn't dropped: with none it
    is kept, with a kept one it is dropped, else it waits. Ids in no order take some log(n) rounds; a path whose ids ascend along it takes
    as many as half its length. Later rounds only ask for what waits. Items without a vector, and empty tables, give no rows.
    """
    if not 0 < min_score < 1:
        raise ValueError("min_score must be between 0 and 1")
    radius = (1 / (min_score - 1e-9) - 1) * (1 + SLACK) + SLACK
    held = cut(items.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v")))
    groups = cut(held.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "v", "n"))
    waiting = groups.select("id", "v")
    centres = pivots(waiting)
    told = held.sparkSession.createDataFrame([], "id long, duplicate_of long")
    if not len(centres):
        return told
    n = waiting.count()
    one = visited(waiting, centres, radius) > n * (-(-n // QUERY_BLOCK) + -(-n // ITEM_BLOCK))
    everywhere = lambda x: x.select(F.col("id").alias("id"), F.col("v").alias("v"), F.lit(0).alias("cell"), F.lit(0).cast("long").alias("ring"))  # noqa: E731  # new names, as both sides may be one table
    home = everywhere(waiting) if one else cut(at_home(waiting, centres, radius))
    kept = None
    while True:
        asking = everywhere(waiting) if one else visits(waiting, centres, radius)
        met = cut(waiting.join(smallest_met(asking, home, min_score), "id", "left"))
        new = met.where("other is null").select("id")
        kept = cut(new if kept is None else kept.unionByName(new))
        asked = met.where("other is not null").join(kept.select(F.col("id").alias("other"), F.lit(True).alias("_kept")), "other", "left")
        asked = cut(asked)
        gone = asked.where("_kept").select("id", F.col("other").alias("duplicate_of"))
        told = told.unionByName(gone)
        waiting = asked.where("_kept is null").select("id", "v")
        if waiting.isEmpty():
            break
        home = cut(home.join(gone.select("id"), "id", "left_anti"))
    told = cut(told)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    lead = groups.join(told.withColumnRenamed("duplicate_of", "_of"), "id", "left").where("n > 1").select(F.col("v"), F.coalesce("_of", "id").alias("_of"), salt.alias("_salt"))
    copies = held.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(lead, ["v", "_salt"])
    copies = copies.where(F.col("_of") != F.col("id")).select("id", F.col("_of").alias("duplicate_of"))
    alone = told.join(groups.where("n = 1").select("id"), "id", "left_semi")
    return alone.unionByName(copies)
