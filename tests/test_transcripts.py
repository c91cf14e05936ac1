"""Following transcripts: the matcher and the decisions against a plain simulation, and a stream that is stopped and goes on."""

import datetime as dt
import math
import pickle
import random

import pytest

from pagetrail.streaming import transcripts as t
from pagetrail.streaming.flows import run_available

WORDS = [a + b for a in ("lor", "mer", "pea", "hol", "glo", "spi", "fat", "son") for b in ("d", "cy", "ce", "ly", "ry", "rit")]
ROWS = "session_id long, id long, ts timestamp, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def simulated(windows, rows):
    """What the rule says for one session's ``(seconds, text)`` rows, word by word."""
    windows = sorted(windows)
    weight = lambda w: math.log((len(windows) + 1) / (sum(w in ws for *_, ws in windows) + 1)) + 1
    same = lambda a, b: a in b or b in a or distance(a, b) <= 2
    page, window, turned, good, last, streak, buffer, out, seen = 1, 0, -1e18, -1e18, 1, 0, [], [], -1e18
    for now, text in rows:
        if now - seen > 1800:
            page, window, turned, good, last, streak, buffer = 1, 0, -1e18, -1e18, 1, 0, []
        if not text or text in ("[silence]", "[error]"):
            continue
        seen = now
        buffer = [x for x in [*buffer, (now, text)] if now - x[0] <= 12]
        live = [w for w in " ".join(x for _, x in buffer).lower().split() if len(w) > 2]
        lost = now - good >= 15
        best = (page, window, 0.0)
        for p, i, ws in windows:
            if not page <= p <= page + (12 if lost else 3) or (p == page and i < window):
                continue
            got = sum(weight(w) for w in live if any(same(w, x) for x in ws))
            score = round(got / (sum(map(weight, live)) or 1) * 100 * {page + 1: 0.5, page: 0.8}.get(p, 1.0), 9)
            if score > best[2]:
                best = (p, i, score)
        if best[2] >= 55:
            good = now
        if best[0] == page and best[1] > window and best[2] > 45:
            window = best[1]
        if page < best[0] <= page + (12 if lost else 3):
            streak, last = (streak + 1 if best[0] == last else 1), best[0]
            near = best[0] == page + 1
            if best[2] >= (45 if near else 50) and streak >= (2 if near else 3) and now - turned >= 2.5:
                page, window, turned, streak = best[0], best[1], now, 0
        elif best[0] != page:
            streak, last = 0, best[0]
        out.append((now, page, window, round(best[2], 6)))
    return out


def story(seed):
    rng = random.Random(seed)
    letters = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9)))
    book = {p: [letters() for _ in range(20)] for p in range(1, 25)}
    windows = [(p, i, tuple(ws[7 * i : 7 * i + 14])) for p, ws in book.items() for i in range(3)]
    rows = []
    for s in range(4):
        now, p, place = 1_700_000_000 + rng.randint(0, 50), 1, 0
        for k in range(60):
            now += rng.choice([1, 2, 3, 5]) + (4000 if k == 45 and s == 1 else 0)
            ws = [w if rng.random() > 0.2 else w[1:] + rng.choice("xy") for w in book[p][place : place + 7]]
            rows.append((s, k, now, rng.choice([" ".join(ws)] * 9 + ["[silence]", "", None])))
            place += 7
            if place >= 20:
                p, place = min(24, p + rng.choice([1, 1, 1, 2, 5])), 0
    return windows, rows


@pytest.fixture(scope="module")
def told():
    windows, rows = story(3)
    return windows, rows, {s: simulated(windows, [(now, x) for k, _, now, x in rows if k == s]) for s in range(4)}


def rows_by_session(df):
    out = {}
    for r in df.orderBy("session_id", "ts").collect():
        out.setdefault(r.session_id, []).append((r.ts.timestamp(), r.page, r.window_index, round(r.confidence, 6)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, k, dt.datetime.fromtimestamp(now), x) for s, k, now, x in rows], ROWS)


def test_batch_equals_simulation(spark, told):
    windows, rows, want = told
    got = rows_by_session(t.follow_batch(frame(spark, rows), t.Book(windows)))
    assert got == want and max(p for _, p, *_ in want[0]) > 3


def test_stream_goes_on_after_a_stop(spark, told, tmp_path):
    """The first half of every session, a stop, and the rest from the same checkpoint: the same rows as in one go."""
    windows, rows, want = told
    spark.conf.set(t.ROCKS, t.PROVIDER)
    for part, keep in (("a", lambda k: k < 31), ("b", lambda k: k >= 31)):
        frame(spark, [r for r in rows if keep(r[1])]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        q = t.follow_transcripts(stream, t.Book(windows), watermark="2 hours").writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    assert rows_by_session(spark.read.parquet(f"{tmp_path}/out")) == want


def test_no_windows_and_no_rows(spark):
    assert t.follow_batch(frame(spark, []), t.Book([])).count() == 0
    assert t.Book([]).best("some words", 1, 0, True) == (1, 0, 0.0, 0, 2)
    with pytest.raises(ValueError, match="at most"):
        t.MOST_WINDOWS, most = 1, t.MOST_WINDOWS
        try:
            t.read_book(spark.createDataFrame([(1, 0, ["a"]), (2, 0, ["b"])], "page long, window_index int, words array<string>"))
        finally:
            t.MOST_WINDOWS = most


def test_book_over_a_megabyte_in_a_stream(spark, told, tmp_path):
    """A stream's tasks get a book that Spark won't send with the code: far pages with long words don't change the rows."""
    windows, rows, want = told
    rows, far = [r for r in rows if r[0] == 0], [(1000 + k, 0, [f"q{k:05d}" + "zxj" * 200]) for k in range(2000)]
    alone, book = t.Book(windows), t.Book([*windows, *far])
    assert len(pickle.dumps(alone)) < 1 << 20 < len(pickle.dumps(book))
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    got = rows_by_session(run_available(t.follow_transcripts(stream, book, watermark="2 hours")))
    assert got == rows_by_session(t.follow_batch(frame(spark, rows), book)) and len(got[0]) == len(want[0])
