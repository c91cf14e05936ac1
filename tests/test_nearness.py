"""Near items dropped in rounds, over cells of pivots, against the serial loop; and how much of all pairs meets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.operators import nearness


def serial(rows, least):
    kept, out = [], {}
    for i, v in sorted(rows, key=lambda x: x[0]):
        near = [k for k, w in kept if round(1 / (1 + float(np.linalg.norm(np.subtract(v, w)))), 9) >= least]
        if near:
            out[i] = min(near)
        else:
            kept.append((i, v))
    return out


def clustered(n, centres, spread, seed):
    r = random.Random(seed)
    mids = [[r.gauss(0, 1) for _ in range(6)] for _ in range(centres)]
    rows = [(i, [x + r.gauss(0, spread) for x in r.choice(mids)]) for i in range(n)]
    copied = [(n + i, rows[r.randrange(n)][1]) for i in range(n // 5)]
    rows = rows + copied
    ids = [i for i, _ in rows]
    r.shuffle(ids)
    return [(i, v) for i, (_, v) in zip(ids, rows, strict=True)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(nearness, "SHARE", 12)
    monkeypatch.setattr(nearness, "QUERY_BLOCK", 16)
    monkeypatch.setattr(nearness, "ITEM_BLOCK", 16)


@pytest.mark.parametrize(("least", "spread"), [(0.95, 0.02), (0.8, 0.1), (0.5, 0.5)])
def test_as_the_serial_loop(spark, small, least, spread):
    rows = clustered(240, 12, spread, 7)
    want = serial(rows, least)
    assert len(want) > 40
    got = nearness.serial_near_duplicates(spark.createDataFrame(rows, "id long, v array<double>"), min_score=least).collect()
    assert len(got) == len(want)
    assert {r.id: r.duplicate_of for r in got} == want


def test_a_path_waits_for_its_start(spark, small):
    rows = [(i, [0.1 * i, 0.0]) for i in range(7)]
    want = serial(rows, 0.9)
    got = nearness.serial_near_duplicates(spark.createDataFrame(rows, "id long, v array<double>"), min_score=0.9).collect()
    assert {r.id: r.duplicate_of for r in got} == want == {1: 0, 3: 2, 5: 4}


def test_few_blocks_of_all_pairs_meet(spark, small):
    rows = clustered(400, 30, 0.01, 11)
    df = spark.createDataFrame(rows, "id long, v array<double>").dropDuplicates(["v"])
    radius = 1 / 0.95 - 1
    centres = nearness.pivots(df)
    home, asking = nearness.at_home(df, centres, radius), nearness.visits(df, centres, radius)
    left, right = nearness.met_blocks(asking, home)
    key = ["cell", "ring", "a", "b"]
    pairs = left.groupBy(key).count().join(right.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert 0 < pairs < df.count() ** 2 / 5


def test_edges(spark, small):
    df = spark.createDataFrame([(1, None), (5, [1.0]), (2, [1.0]), (9, [1.0])], "id long, v array<double>")
    assert sorted(map(tuple, nearness.serial_near_duplicates(df).collect())) == [(5, 2), (9, 2)]
    assert nearness.serial_near_duplicates(df.where("id = 1")).count() == 0
    with pytest.raises(ValueError, match="between"):
        nearness.serial_near_duplicates(df, min_score=1)


def test_a_wide_radius_makes_no_more_rows_than_blocks_do(spark, small, monkeypatch):
    """Where every item could meet something in every cell, no vector is copied to all of them."""
    rows = clustered(240, 12, 0.5, 5)
    want, asked = serial(rows, 0.2), []
    met = nearness.smallest_met
    monkeypatch.setattr(nearness, "ITEM_BLOCK", 64)
    monkeypatch.setattr(nearness, "smallest_met", lambda asking, home, least: (asked.append(asking.count()), met(asking, home, least))[1])
    got = nearness.serial_near_duplicates(spark.createDataFrame(rows, "id long, v array<double>"), min_score=0.2).collect()
    assert {r.id: r.duplicate_of for r in got} == want
    assert max(asked) <= len(rows)
