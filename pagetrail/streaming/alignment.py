"""Placing a recording on a timeline of frames as it comes in: banded alignment and a belief filter, as stateful streams.

A timeline has a feature vector for each frame and the frames at which pages begin. Observations are ``session_id, id, ts, v`` with a
vector of the same kind: up to 13 coefficients, then loudness and crossings where there are 15 numbers or more. Both machines expect the
frame that the time since the session's first row says and look at a band around it; of the state only what the next row needs is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .transcripts import PROVIDER, ROCKS, Sent

OUT = "session_id long, ts timestamp, page int, position double, confidence double, cost double, turned boolean"
#: Frames of a timeline at most: they go into each task, with the NUMBERS of them that distances take, eight bytes each.
MOST_FRAMES = 2_000_000
COEFFICIENTS, NUMBERS = 13, 15
WEIGHTS = np.array([2.0] * 4 + [1.5] * 4 + [1.0] * 5)


class Timeline:
    """Frames ``hop`` seconds apart, and ``pages``: the frame at which each begins, with its number, in order."""

    def __init__(self, frames: np.ndarray, pages: list[tuple[int, int]], hop: float) -> None:
        self.frames, self.pages, self.hop = np.asarray(frames, float), sorted(pages), hop

    def gap(self, share: float) -> float:
        """Seconds between turns: a share of the mean time of a page, two at least."""
        n = len(self.pages) - 1
        return max(2.0, share * (self.pages[-1][0] - self.pages[0][0]) * self.hop / n) if n > 0 else 2.0

    def page_at(self, frame: float) -> int | None:
        found = [page for at, page in self.pages if frame >= at]
        return found[-1] if found else None

    def distance(self, v: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """From a vector to the frames lo to hi: weighted coefficients, loudness and crossings."""
        part = self.frames[lo : hi + 1]
        n = min(COEFFICIENTS, part.shape[1], len(v))
        out = np.sqrt(((part[:, :n] - v[:n]) ** 2 * WEIGHTS[:n]).sum(1) / n)
        if part.shape[1] >= 15 and len(v) >= 15:
            out = out + np.abs(part[:, 13] - v[13]) * 50 + np.abs(part[:, 14] - v[14]) / 10 * 0.3
        return out


def read_timeline(frames: DataFrame, *, hop: float) -> Timeline:
    """From ``frame, page, v``: frames in order, and the pages that begin where the number changes. MOST_FRAMES at most."""
    rows = frames.select("frame", "page", F.slice("v", 1, NUMBERS).alias("v")).limit(MOST_FRAMES + 1).collect()
    if len(rows) > MOST_FRAMES:
        raise ValueError(f"a timeline has {MOST_FRAMES} frames at most")
    rows.sort(key=lambda r: r["frame"])
    pages = [(i, r["page"]) for i, r in enumerate(rows) if i == 0 or rows[i - 1]["page"] != r["page"]]
    return Timeline(np.array([r["v"] for r in rows]).reshape(len(rows), -1), pages, hop)


class Aligner:
    """Banded alignment: the smoothed sound against the band, each frame off costing OFFSET more; the mean of the last places decides."""

    STATE = "n int, first double, turned double, page int, smooth array<double>, recent array<array<double>>, places array<double>, costs array<double>"
    WARM_UP, ALPHA, RECENT, BAND, OFFSET, LAST = 50, 0.2, 15, 50, 0.1, 20
    SURE, COST, SHARE = 70.0, 50.0, 0.3

    def start(self, now: float) -> dict:
        return {"n": 0, "first": now, "turned": now, "page": 1, "smooth": [], "recent": [], "places": [], "costs": []}

    def step(self, line: Timeline, s: dict, now: float, v: np.ndarray) -> tuple | None:
        """None while warming up."""
        s["n"] += 1
        if s["n"] < self.WARM_UP:
            return None
        smooth = v if not len(s["smooth"]) else self.ALPHA * v + (1 - self.ALPHA) * np.asarray(s["smooth"])
        s["smooth"], s["recent"] = smooth.tolist(), [*s["recent"], smooth.tolist()][-self.RECENT :]
        if len(s["recent"]) < self.RECENT:
            return None
        expected = math.floor((now - s["first"]) / line.hop + 1e-9)
        lo, hi = max(0, expected - self.BAND), min(len(line.frames) - 1, expected + self.BAND)
        place, cost = expected, math.inf
        if lo <= hi:
            costs = line.distance(np.mean(s["recent"], axis=0), lo, hi) + self.OFFSET * np.abs(np.arange(lo, hi + 1) - expected)
            place, cost = lo + int(costs.round(9).argmin()), float(costs.min())
        s["places"], s["costs"] = [*s["places"], float(place)][-self.LAST :], [*s["costs"], cost][-self.LAST :]
        position, mean = sum(s["places"]) / len(s["places"]), sum(s["costs"]) / len(s["costs"])
        confidence = max(0.0, min(100.0, 100 - 2 * mean))
        page = line.page_at(position) or s["page"]
        turned = page > s["page"] and confidence >= self.SURE and mean < self.COST and now - s["turned"] >= line.gap(self.SHARE)
        if turned:
            s["page"], s["turned"] = page, now
        return s["page"], position, confidence, mean, turned


class Belief:
    """A belief over frames: how well each fits, less by time, and a part of the belief from up to ten frames before to five after it.

    Kept as logarithms of the band alone, so that sounds unlike all frames don't underflow.
    """

    STATE = "first double, turned double, page int, recent array<array<double>>, low int, belief array<double>"
    BAND, START, RECENT, BACK, AHEAD, CARRY, HELD, SURE, SHARE = 300, 100, 5, 5, 10, 0.3, 0.01, 15.0, 0.25

    def start(self, now: float) -> dict:
        return {"first": now, "turned": now, "page": 1, "recent": [], "low": -1, "belief": []}

    def weight(self, delta: int) -> float:
        return 1.0 if delta == 1 else 0.8 if delta == 0 else 0.6 / delta if delta > 1 else 0.3

    def step(self, line: Timeline, s: dict, now: float, v: np.ndarray) -> tuple | None:
        n = len(line.frames)
        if s["low"] < 0:
            first = min(self.START, n)
            s["low"], s["belief"] = 0, [-math.log(first)] * first
        s["recent"] = [*s["recent"], v.tolist()][-self.RECENT :]
        expected = math.floor((now - s["first"]) / line.hop + 1e-9)
        lo, hi = max(0, expected - self.BAND), min(n - 1, expected + self.BAND)
        best, p = 0, 0.0
        if lo <= hi:
            away = np.abs(np.arange(lo, hi + 1) - expected)
            fresh = -line.distance(np.mean(s["recent"], axis=0), lo, hi) / 15 - away / 100 * 0.5
            old, at = np.exp(np.asarray(s["belief"], float)), s["low"] + np.arange(len(s["belief"]))
            known = (old > self.HELD) & (at >= lo) & (at <= hi)
            carried = np.zeros(hi - lo + 1)
            for delta in range(-self.BACK, self.AHEAD + 1):
                to = at[known] + delta
                fits = (to >= lo) & (to <= hi)
                carried[to[fits] - lo] += old[known][fits] * self.CARRY * self.weight(delta)
            with np.errstate(divide="ignore"):
                told = np.logaddexp(fresh, np.log(carried))
            told -= np.logaddexp.reduce(told)
            best = lo + int(told.round(9).argmax())
            p = float(np.exp(told.max()))
            s["low"], s["belief"] = lo, told.tolist()
        else:
            s["low"], s["belief"] = 0, []
        confidence = min(100.0, 500 * p)
        page = line.page_at(best) or 1
        turned = page > s["page"] and now - s["turned"] >= line.gap(self.SHARE) and confidence > self.SURE
        if turned:
            s["page"], s["turned"] = page, now
        return s["page"], float(best), confidence, -math.log(p) if p > 0 else 999.0, turned


MACHINES = {"aligner": Aligner, "belief": Belief}


def _placed(machine, line: Timeline, s: dict | None, rows: pd.DataFrame) -> tuple[dict | None, pd.DataFrame]:
    out = []
    for r in rows.sort_values(["ts", "id"]).itertuples():
        if r.v is None or not len(r.v):
            continue
        now = r.ts.timestamp()
        s = s or machine.start(now)
        told = machine.step(line, s, now, np.asarray(r.v, float))
        if told:
            out.append((r.session_id, r.ts, *told))
    return s, pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


class Placer(StatefulProcessor):
    def __init__(self, machine, line: Sent) -> None:
        self.machine, self.line = machine, line

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("place", self.machine.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.machine.STATE.split(", ")]
        s = dict(zip(names, map(_plain, self.state.get()), strict=True)) if self.state.exists() else None
        s, out = _placed(self.machine, self.line.value, s, pd.concat(list(rows)))
        if s:
            self.state.update(tuple(s[n] for n in names))
        yield out

    def close(self) -> None:
        pass


def _plain(x):
    return [_plain(y) for y in x] if isinstance(x, (list, tuple, np.ndarray)) else x


def place_stream(stream: DataFrame, line: Timeline, *, machine: str = "aligner") -> DataFrame:
    """Where each row of a stream lies on the timeline: OUT. Rows without a vector are passed over; while the aligner warms up there are no
    rows. In a micro-batch a session's rows are taken by time and id. Sets the session's state store to RocksDB."""
    stream.sparkSession.conf.set(ROCKS, PROVIDER)
    rows = stream.select("session_id", "id", "ts", F.slice("v", 1, NUMBERS).alias("v"))
    return rows.groupBy("session_id").transformWithStateInPandas(Placer(MACHINES[machine](), Sent(stream.sparkSession, line)), OUT, "Append", "None")


def place_batch(rows: DataFrame, line: Timeline, *, machine: str = "aligner") -> DataFrame:
    """The same over a finished table; each session is one group."""
    kind = MACHINES[machine]()
    held = rows.select("session_id", "id", "ts", "v").where(F.col("ts").isNotNull())
    return held.groupBy("session_id").applyInPandas(lambda pdf: _placed(kind, line, None, pdf)[1], OUT)
