"""Scans in slices and chains by pointer doubling against plain loops; one key holds most rows and fills many slices."""

import random

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import gateway, joins, scans, sequences


def points(spark, n=240, seed=3):
    r = random.Random(seed)
    rows = [(1 if r.random() < 0.8 else r.choice([2, 3, None]), i, round(r.random() * 50, 1), r.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "recording long, id long, t double, value double")


def by_key(rows, order):
    out = {}
    for x in sorted(rows, key=order):
        out.setdefault(x[0], []).append(x)
    return out


def test_one_key_fills_many_slices(spark):
    rows, df = points(spark)
    p = scans.placed(df, "recording", ["t", "id"], slices=6)
    hot = p.where("recording = 1").select(F.shiftright("_at", 33).alias("s")).distinct().count()
    assert hot >= 4
    assert p.count() == len(rows)


@pytest.mark.parametrize("slices", [1, 7])
def test_carry_and_sum(spark, slices):
    rows, df = points(spark)
    p = scans.placed(df, "recording", ["t", "id"], slices=slices)
    v = F.when(F.col("id") % 5 == 0, F.col("id"))
    x = scans.carry(p, "recording", v, "last")
    x = scans.carry(x, "recording", v, "next", backward=True)
    x = scans.carry(x, "recording", F.col("id"), "before", inclusive=False)
    x = scans.running_sum(x, "recording", F.col("id"), "total")
    got = {r.id: (r.last, r.next, r.before, r.total) for r in x.collect()}
    for held in by_key(rows, lambda x: (x[2], x[1])).values():
        ids = [x[1] for x in held]
        for i, k in enumerate(ids):
            last = next((j for j in reversed(ids[: i + 1]) if j % 5 == 0), None)
            nxt = next((j for j in ids[i:] if j % 5 == 0), None)
            assert got[k] == (last, nxt, ids[i - 1] if i else None, sum(ids[: i + 1]))


@pytest.mark.parametrize("slices", [1, 7])
def test_exponential_mean(spark, slices):
    rows, df = points(spark)
    got = {r.id: r.smooth for r in sequences.smooth(df, alpha=0.25, slices=slices).collect()}
    for held in by_key(rows, lambda x: (x[2], x[1])).values():
        e = None
        for _, k, _, v in held:
            e = v if e is None else 0.25 * v + 0.75 * e
            assert got[k] == pytest.approx(e, abs=1e-12)


def test_exponential_mean_of_nothing(spark):
    _, df = points(spark, 0)
    assert sequences.smooth(df, alpha=0.25).count() == 0


@pytest.mark.parametrize("slices", [1, 7])
def test_points_apart(spark, slices):
    rows, df = points(spark)
    got = sorted((r.recording or 0, r.timestamp) for r in sequences.greedy_apart(df.select("recording", F.col("t").alias("timestamp"), "id"), min_gap=1.5, slices=slices).collect())
    want = []
    for key, held in by_key(rows, lambda x: (x[2], x[1])).items():
        last = None
        for _, _, t, _ in held:
            if last is None or t >= last + 1.5:
                want.append((key or 0, t))
                last = t
    assert got == sorted(want)


def test_points_apart_edges(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (2, None)], "recording long, timestamp double")
    assert [tuple(r) for r in sequences.greedy_apart(df, min_gap=1).collect()] == [(1, 2.0)]
    assert sequences.greedy_apart(df.limit(0), min_gap=1).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        sequences.greedy_apart(df, min_gap=0)


def test_no_group_function_in_the_plans(spark):
    _, df = points(spark, 20)
    kept = sequences.greedy_apart(df.select("recording", F.col("t").alias("timestamp")), min_gap=1)
    labels = df.select("recording", F.col("t").alias("time"), "id", F.lit("a").alias("label"))
    packed = gateway.pack_by_tokens(df.select(F.col("recording").alias("conv_id"), F.col("id").alias("turn"), F.lit("word").alias("text")), max_tokens=3)
    for x in (kept, sequences.sustained_changes(labels), packed):
        assert "InPandas" not in x._jdf.queryExecution().toString()


def test_sustained_changes(spark):
    r = random.Random(5)
    rows = [(k, float(i), i, r.choice(["a", "a", "a", "b", "b", "silence"])) for k in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "recording long, time double, id long, label string")
    want = []
    for k in (1, 2):
        held, last = [x for x in rows if x[0] == k], None
        for i, x in enumerate(held):
            if x[3] == "silence":
                continue
            if last is None:
                last = x[3]
            elif x[3] != last and len(held[i + 1 : i + 3]) == 2 and all(y[3] in (x[3], "silence") for y in held[i + 1 : i + 3]):
                want.append((k, x[1], last, x[3]))
                last = x[3]
    assert len(want) > 5
    assert sorted(map(tuple, sequences.sustained_changes(df).collect())) == sorted(want)


@pytest.mark.parametrize("slices", [1, 6])
def test_packing(spark, slices):
    r = random.Random(9)
    rows = [(1 if r.random() < 0.8 else 2, i, r.choice([None, "", "x" * r.randrange(1, 60), "y" * 90])) for i in range(160)]
    rows += [(3, 0, ""), (3, 1, "z" * 400), (3, 2, ""), (3, 3, "a")]
    got = gateway.pack_by_tokens(spark.createDataFrame(rows, "conv_id long, turn long, text string"), max_tokens=20, slices=slices)
    want = []
    for key, held in by_key(rows, lambda x: (x[0], x[1])).items():
        chunk = used = 0
        for _, turn, text in held:
            n = -(-len(text or "") // 4)
            if used and used + n > 20:
                chunk, used = chunk + 1, 0
            used += n
            want.append((key, turn, n, chunk))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("slices", [1, 6])
def test_as_of_and_nearest(spark, slices):
    rows, df = points(spark)
    marks = [(k, round(i * 3.3, 1), i) for k in (1, 2, None) for i in range(1, 15)]
    m = spark.createDataFrame(marks, "recording long, t double, page int")
    page = {r.id: r.expected_page for r in joins.asof_page(df, m, slices=slices).collect()}
    near = {r.id: r.marker_page for r in joins.nearest_marker(df, m, slices=slices).collect()}
    for k, i, t, _ in rows:
        own = [(x, p) for key, x, p in marks if key == k]
        before = [p for x, p in own if x <= t]
        assert page[i] == (before[-1] if before else None)
        assert near[i] == (min(own, key=lambda x: (abs(x[0] - t), x[0]))[1] if own else None)


def test_timeline_is_the_same_in_slices(spark):
    r = random.Random(12)
    rows = [(1 if r.random() < 0.8 else 2, t, i, r.random()) for i, t in enumerate(sorted(r.sample(range(20_000), 60)))]
    df = spark.createDataFrame(rows, "recording long, timestamp_ms long, page int, value double")
    one, many = ({(x.recording, x.frame): (x.page_number, round(x.value, 12), x.is_boundary) for x in sequences.canonical_timeline(df, tail_ms=500, slices=n).collect()} for n in (1, 9))
    assert one == many
    for k in (1, 2):
        own = [x for x in rows if x[0] == k]
        for (_, a, page, _), (_, b, _, _) in zip(own, own[1:], strict=False):
            for f in range(-(-a // 100), -(-b // 100)):
                assert many[k, f][0] == page
                assert many[k, f][2] == (f == -(-a // 100))
