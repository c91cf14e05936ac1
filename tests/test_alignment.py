"""Placing on a timeline against whole-timeline simulations, in one go and over a restart."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from pagetrail.streaming import alignment as a
from pagetrail.streaming import transcripts as t
from pagetrail.streaming.flows import run_available

ROWS = "session_id long, id long, ts timestamp, v array<double>"
HOP, N = 0.1, 900


def recording(scale):
    rng = np.random.default_rng(4)
    frames = np.cumsum(rng.normal(size=(N, 15)), axis=0) * np.array([scale] * 13 + [0.001, 0.1])
    line = a.Timeline(frames, [(0, 1), (120, 2), (260, 3), (380, 4), (600, 5), (750, 6)], HOP)
    rows, pick = [], random.Random(1)
    for s in range(3):
        begun, k = 1_700_000_000 + s, 0
        for i in range(0, N + 40, 2):
            at = min(N - 1, max(0, i + pick.randint(-3, 3) + 5 * s))
            v = None if i == 300 else (frames[at] + rng.normal(size=15) * 0.05 * (0.001 if s == 2 else 1) * np.array([1] * 13 + [0.01, 1])).tolist()
            rows.append((s, k, begun + i * HOP, v))
            k += 1
    return line, rows


def cost(line, v, i):
    f = line.frames[i]
    w = [2.0] * 4 + [1.5] * 4 + [1.0] * 5
    return math.sqrt(sum(w[k] * (v[k] - f[k]) ** 2 for k in range(13)) / 13) + abs(v[13] - f[13]) * 100 * 0.5 + abs(v[14] - f[14]) / 10 * 0.3


def aligned(line, rows):
    first, turned, page, smooth, seen, places, costs, out = rows[0][0], rows[0][0], 1, None, [], [], [], []
    for n, (now, v) in enumerate(rows, 1):
        if n < 50:
            continue
        smooth = list(v) if smooth is None else [0.2 * x + 0.8 * y for x, y in zip(v, smooth, strict=True)]
        seen.append(smooth)
        if len(seen) < 15:
            continue
        mean = [sum(x) / 15 for x in zip(*seen[-15:], strict=True)]
        due = math.floor((now - first) / HOP + 1e-9)
        # the whole timeline, of which only the band counts
        whole = [cost(line, mean, i) + 0.1 * abs(i - due) if abs(i - due) <= 50 else math.inf for i in range(N)]
        least = min(whole)
        places.append(next(i for i, c in enumerate(whole) if c <= least + 1e-9) if least < math.inf else due)
        costs.append(least)
        position, mid = (sum(x[-20:]) / len(x[-20:]) for x in (places, costs))
        conf = max(0, min(100, 100 - 2 * mid))
        there = [p for f, p in line.pages if position >= f][-1]
        if there > page and conf >= 70 and mid < 50 and now - turned >= max(2, 0.3 * 750 * HOP / 5):
            page, turned = there, now
        out.append((page, round(position, 5), round(conf, 5)))
    return out


def believed(line, rows):
    first, turned, page, belief, seen, out = rows[0][0], rows[0][0], 1, [1 / 100] * 100 + [0.0] * (N - 100), [], []
    for now, v in rows:
        seen.append(v)
        mean = [sum(x) / len(x) for x in zip(*seen[-5:], strict=True)]
        due = math.floor((now - first) / HOP + 1e-9)
        band = range(max(0, due - 300), min(N - 1, due + 300) + 1)
        new = [0.0] * N
        for i in band:
            new[i] = math.exp(-cost(line, mean, i) / 15) * math.exp(-abs(i - due) / 100 * 0.5)
        for i in band:
            if belief[i] > 0.01:
                for d in range(-5, 11):
                    if i + d in band:
                        new[i + d] += belief[i] * 0.3 * (1.0 if d == 1 else 0.8 if d == 0 else 0.6 / d if d > 1 else 0.3)
        total = sum(new)
        belief = [x / total for x in new] if total else new
        best = max(range(N), key=lambda i: (round(math.log(belief[i]), 9) if belief[i] else -math.inf, -i))
        conf = min(100, belief[best] * 500)
        there = [p for f, p in line.pages if best >= f][-1]
        if there > page and now - turned >= max(2, 0.25 * 750 * HOP / 5) and conf > 15:
            page, turned = there, now
        out.append((page, float(best), round(conf, 5)))
    return out


def by_session(df):
    out = {}
    for r in df.orderBy("session_id", "ts").collect():
        out.setdefault(r.session_id, []).append((r.page, round(r.position, 5), round(r.confidence, 5)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, k, dt.datetime.fromtimestamp(now), v) for s, k, now, v in rows], ROWS)


@pytest.mark.parametrize(("machine", "plain"), [("aligner", aligned), ("belief", believed)])
def test_equals_simulation_over_a_restart(spark, tmp_path, machine, plain):
    line, rows = recording({"aligner": 0.3, "belief": 12.0}[machine])
    own = lambda s: [(dt.datetime.fromtimestamp(now).timestamp(), v) for k, _, now, v in rows if k == s and v is not None]
    want = {s: plain(line, own(s)) for s in range(3)}
    assert by_session(a.place_batch(frame(spark, rows), line, machine=machine)) == want
    assert max(p for p, *_ in want[0]) >= 4
    spark.conf.set(t.ROCKS, t.PROVIDER)
    for keep in (lambda k: k < 200, lambda k: k >= 200):
        frame(spark, [r for r in rows if keep(r[1])]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        q = a.place_stream(stream, line, machine=machine).writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    assert by_session(spark.read.parquet(f"{tmp_path}/out")) == want


def test_no_rows_and_far_sounds(spark):
    line, _ = recording(0.3)
    assert a.place_batch(frame(spark, []), line).count() == 0
    far = [(0, i, 1_700_000_000 + i * HOP, [1e6] * 15) for i in range(3)]
    got = a.place_batch(frame(spark, far), line, machine="belief").collect()
    assert len(got) == 3 and all(math.isfinite(r.confidence) for r in got)


@pytest.mark.parametrize("machine", ["aligner", "belief"])
def test_timeline_over_a_megabyte_in_a_stream(spark, tmp_path, machine):
    """A stream's tasks get a timeline that Spark won't send with the code."""
    short, rows = recording(0.3)
    rows = [r for r in rows if r[0] == 0]
    line = a.Timeline(np.vstack([short.frames, np.full((20_000, short.frames.shape[1]), 50.0)]), short.pages, HOP)
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    got = by_session(run_available(a.place_stream(stream, line, machine=machine)))
    assert got == by_session(a.place_batch(frame(spark, rows), line, machine=machine)) and len(got[0]) > 100
