"""Page tracking by session: one state machine with profiles, run in batch or as a stateful stream.

A row is an observation: ``session_id, ts`` (seconds), ``speaker, rms`` and ``scores``, how well it fits pages 1 to n (an array made
natively before, by whatever scores are wanted). The profile ``tracker`` also wants the speaker expected on each page, as ``speakers``
in the config: a list by page. The state is a small dict kept as JSON. The page never decreases.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id long, ts double, page int, changed boolean, confidence double, reason string, jumped boolean"

#: ahead: pages looked at; gate: score that turns the page; gap: seconds between turns; the rest by profile.
PROFILES = {
    "tracker": {"ahead": 3, "gate": 0.75, "gap": 3.0, "speaker": 0.3, "quiet": 0.005},
    "smart": {"ahead": 5, "gate": 0.7, "gap": 3.0, "bonus": 0.3},
    "word_buffer": {"ahead": 10, "gate": 0.6, "gap": 2.0, "buffer": 5},
    "double_gate": {"ahead": 10, "gate": 0.5, "confirm": 0.7, "gap": 2.0},
    "sensitivity": {"ahead": 15, "gate": 0.4, "gap": 2.0},
    "discriminative": {"ahead": 5, "gate": 0.5, "gap": 4.0, "warm_up": 40, "alpha": 0.25, "recent": 10, "margin": 0.08, "hits": 5},
    "transcript": {"ahead": 3, "gate": 0.45, "gap": 2.5, "streak": 2, "resync": 15.0, "wide": 12},
    "coordinator": {"ahead": 4, "gate": 0.6, "gap": 3.0, "streak": 2},
    "aligner": {"ahead": 6, "gate": 0.5, "gap": 0.0, "last": 20, "cost": 0.1},
    "belief": {"ahead": 10, "back": 5, "gap": 0.0, "carry": 0.3, "gate": 0.15},
}


def start() -> dict:
    return {"page": 1, "turn": None}


def _best(scores: np.ndarray, page: int, ahead: int) -> tuple[int, float]:
    window = scores[page : page + ahead]
    if not len(window):
        return page, 0.0
    i = int(np.argmax(window))
    return page + 1 + i, float(window[i])


def explained(score: float, changed: bool) -> str:
    """Why a page turn was taken, by score tier."""
    tier = "strong match" if score > 0.9 else "match" if score > 0.75 else "weak match"
    return (f"speaker change, {tier}" if score > 0.9 else "speaker change") if changed else tier


def _tracked(p: dict, s: dict, ts: float, speaker: str, rms: float, x: np.ndarray) -> tuple[int, float, str]:
    """Looks ahead when the speaker is not the one expected on the page, or it is quiet; speakers as expected add their share."""
    page, speakers = s["page"], p.get("speakers") or []
    expected = lambda n: (speakers[n - 1] if n <= len(speakers) else None) or "unknown"
    changed = speaker != expected(page)
    if not changed and rms >= p["quiet"]:
        return page, 0.0, "no change"
    ahead = range(page + 1, min(page + p["ahead"], len(x)) + 1)
    scores = [p["speaker"] * (speaker == expected(n)) + (1 - p["speaker"]) * float(x[n - 1]) for n in ahead]
    if not scores or max(scores) <= p["gate"]:
        return page, max(scores, default=0.0), "below the gate"
    best = max(scores)
    s["page"], s["turn"] = page + 1 + scores.index(best), ts
    return s["page"], best, explained(best, changed)


def _discriminated(p: dict, s: dict, ts: float, x: np.ndarray) -> tuple[int, float, str]:
    """Turns to a page that was clearly better than the others ahead often enough, by the mean of the last smoothed scores."""
    page, s["n"], s["from"] = s["page"], s.get("n", 0) + 1, s.get("from", ts)
    if s["n"] < p["warm_up"]:
        return page, 0.0, "warming up"
    old = s.get("smooth")
    smooth = x if old is None else p["alpha"] * x + (1 - p["alpha"]) * np.asarray(old)
    s["smooth"], s["recent"] = smooth.tolist(), [*s.get("recent", []), smooth.tolist()][-p["recent"] :]
    if len(s["recent"]) < p["recent"]:
        return page, 0.0, "gathering"
    ahead = np.mean(s["recent"], axis=0)[page : page + p["ahead"]]
    if not len(ahead):
        return page, 0.0, "last page"
    order = np.argsort(-ahead, kind="stable")
    cand, best = page + 1 + int(order[0]), float(ahead[order[0]])
    margin = best - float(ahead[order[1]]) if len(ahead) > 1 else best
    hits = s.setdefault("hits", {})
    clear = margin >= p["margin"] * (1 if cand == page + 1 else 1.5) and best >= p["gate"]
    if clear:
        hits[str(cand)] = hits.get(str(cand), 0) + 1
    else:
        s["hits"] = hits = {k: max(0, n - 1) for k, n in hits.items()}
    since = ts - (s["from"] if s["turn"] is None else s["turn"])
    if not clear or since < p["gap"] or hits[str(cand)] < p["hits"]:
        return page, margin, "hits" if clear else "no clear page"
    s["page"], s["turn"], s["hits"], s["recent"], s["smooth"] = cand, ts, {}, [], None
    return cand, best, "score"


def step(profile: str, p: dict, s: dict, ts: float, speaker: str, rms: float, scores: list[float]) -> tuple[int, float, str]:
    """The page, confidence and reason after one observation; updates the state."""
    x, page = np.asarray(scores, float), s["page"]
    if profile == "discriminative":
        return _discriminated(p, s, ts, x)
    if s["turn"] is not None and ts - s["turn"] < p["gap"]:
        return page, 0.0, "cooldown"
    if profile == "tracker":
        return _tracked(p, s, ts, speaker, rms, x)
    cand, score = _best(x, page, p["ahead"])
    reason = "score"
    if profile == "smart":
        near = x[page : page + p["ahead"]] + p["bonus"] * np.exp(-np.arange(1, len(x[page : page + p["ahead"]]) + 1) / 3)
        cand, score = (page + 1 + int(near.argmax()), min(1.0, float(near.max()))) if len(near) else (page, 0.0)
    elif profile == "word_buffer":
        s["buffer"] = [*s.get("buffer", []), cand][-p["buffer"] :]
        if s["buffer"].count(cand) * 2 <= p["buffer"]:
            return page, score, "undecided"
    elif profile == "double_gate":
        ready, s["ready"] = s.get("ready"), cand if score > p["gate"] else None
        if ready != cand or score <= p["confirm"]:
            return page, score, "gate"
    elif profile == "transcript":
        since = ts - (s["turn"] if s["turn"] is not None else s.setdefault("first", ts))
        if since > p["resync"]:
            cand, score = _best(x, page, p["wide"])
            reason = "resync"
        s["streak"] = s.get("streak", 0) + 1 if cand == s.get("last") else 1
        s["last"] = cand
        if s["streak"] < p["streak"] + (since > p["resync"]):
            return page, score, "streak"
    elif profile == "coordinator":
        agree = score >= p["gate"] and cand == s.get("last")
        s["last"], s["streak"] = cand, s.get("streak", 0) + 1 if agree else 0
        if s["streak"] < p["streak"]:
            return page, score, "agreement"
    elif profile == "aligner":
        lo, hi = max(0, page - 1 - p["ahead"]), min(len(x), page + p["ahead"])
        cost = 1 - x[lo:hi] + p["cost"] * np.abs(np.arange(lo, hi) - (page - 1))
        cand = lo + 1 + int(cost.argmin())
        s["costs"] = [*s.get("costs", []), float(cost.min())][-p["last"] :]
        score = 1 - sum(s["costs"]) / len(s["costs"])
    elif profile == "belief":
        b = np.asarray(s.get("belief") or np.full(len(x), 1 / max(len(x), 1)))
        w = p["back"] + p["ahead"] + 1
        carried = np.convolve(b, np.full(w, 1 / w))[p["back"] : p["back"] + len(b)]
        b = x * (p["carry"] * carried + (1 - p["carry"]) * np.exp(-np.abs(np.arange(len(x)) - (page - 1)) / 10))
        b = b / b.sum() if b.sum() > 0 else np.full(len(x), 1 / max(len(x), 1))
        s["belief"] = b.round(9).tolist()
        cand, score = int(b.argmax()) + 1, min(1.0, 5 * float(b.max()))
    if cand > page and score > p["gate"]:
        s["page"], s["turn"], s["buffer"] = cand, ts, []
        return cand, score, reason
    return page, score, "below the gate"


def _run(profile: str, params: dict, state: dict, pdf: pd.DataFrame, since: float | None = None) -> pd.DataFrame:
    rows = []
    for r in pdf.sort_values(["ts", "id"]).itertuples():
        before = state["page"]
        page, conf, why = step(profile, params, state, r.ts, r.speaker, r.rms, r.scores)
        rows.append((r.session_id, r.ts, page, page != before, conf, why, page > before + 1))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])


def _params(profile: str, config: dict | None) -> dict:
    return PROFILES[profile] | (config or {})


def track_batch(obs: DataFrame, *, profile: str = "tracker", config: dict | None = None) -> DataFrame:
    """The same decisions over a finished table; each session is one group."""
    p = _params(profile, config)
    return obs.groupBy("session_id").applyInPandas(lambda pdf: _run(profile, p, start(), pdf), OUT)


def track_pages(stream: DataFrame, *, profile: str = "tracker", config: dict | None = None) -> DataFrame:
    """A decision for each observation of a stream, in order of time within each micro-batch; state by session."""
    p = _params(profile, config)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else start()
        held = [b for b in batches if len(b)]
        if held:
            out = _run(profile, p, s, pd.concat(held))
            state.update((json.dumps(s),))
            yield out

    return stream.groupBy("session_id").applyInPandasWithState(update, OUT, "s string", "append", GroupStateTimeout.NoTimeout)


