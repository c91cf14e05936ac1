"""Following a book by what is heard: a stateful stream of transcripts, with a text buffer, fuzzy windows, streaks and resynchronisation.

Texts said lately are kept in a list state, the place in a value state, and an event-time timer clears both once a session is over. What
is matched is the buffer's text against the windows of the pages ahead, by the rule of :func:`pagetrail.operators.matching.score_windows`.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagetrail.operators.joins import within_edits
from pagetrail.operators.matching import AHEAD, AHEAD_LOST

OUT = "session_id long, ts timestamp, page int, window_index int, confidence double, matched_words int, total_words int, turned boolean, resync boolean"
#: Windows of a book at most: they go into each task, some 200 bytes a window.
MOST_WINDOWS = 200_000
#: Seconds: how long a text counts, between two page turns, without a good match until the place counts as lost, and of silence after
#: which a session is over.
BUFFER, GAP, LOST, IDLE = 12.0, 2.5, 15.0, 1800.0
#: Percent: a good match, and a later window of the same page. By step (the next page, or further): streak and percent of a turn.
GOOD, SAME_PAGE = 55.0, 45.0
TURN = {True: (2, 45.0), False: (3, 50.0)}
SILENT = ("", "[silence]", "[error]")
#: Letters up to which a live word finds the book's words by deletions; longer ones are compared with all long words.
SHORT = 12
#: Words whose matches a task keeps.
MEMO = 50_000


def shortened(word: str) -> set[str]:
    """The word, and what is left without one or two of its letters: words within two edits share one of these."""
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word, *one, *(x[:i] + x[i + 1 :] for x in one for i in range(len(x)))}


class Book:
    """Windows ``(page, window_index, words)`` in order, and which of their words a live word matches."""

    def __init__(self, windows: Iterable[tuple[int, int, Iterable[str]]]) -> None:
        rows = sorted((p, i, sorted(set(w))) for p, i, w in windows)
        self.words = sorted({w for _, _, ws in rows for w in ws})
        at = {w: i for i, w in enumerate(self.words)}
        self.seen = Counter(w for _, _, ws in rows for w in ws)
        self.windows = [(p, i, frozenset(map(at.get, ws))) for p, i, ws in rows]
        self.starts: dict[int, int] = {}
        for k, (p, _, _) in enumerate(self.windows):
            self.starts.setdefault(p, k)
        self.memo: dict[str, frozenset[int]] = {}
        self.short: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for x in shortened(w) if len(w) <= SHORT + 2 else ():
                self.short.setdefault(x, []).append(i)
        self.long = [i for i, w in enumerate(self.words) if len(w) > SHORT - 2]
        self.at, self.longest = at, max(map(len, self.words), default=0)
        self.line = "\n".join(["", *self.words, ""])
        self.begins = list(accumulate((len(w) + 1 for w in self.words), initial=0))

    def idf(self, word: str) -> float:
        return math.log((len(self.windows) + 1) / (self.seen.get(word, 0) + 1)) + 1

    def matches(self, word: str) -> frozenset[int]:
        """Words that are equal, hold it, are held by it or are within two edits."""
        if word not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            n = len(word)
            near = {i for x in shortened(word) for i in self.short.get(x, ())} if n <= SHORT else self.long
            found = {i for i in near if abs(len(self.words[i]) - n) <= 2 and within_edits(word, self.words[i], 2)}
            self.memo[word] = frozenset(found.union(self.inside(word), self.around(word)))
        return self.memo[word]

    def inside(self, word: str) -> Iterator[int]:
        """Words that it holds: by its parts, or where these are more than the words by each word."""
        n = len(word)
        if n * min(n, self.longest) > len(self.words):
            return (i for i, w in enumerate(self.words) if w in word)
        return (self.at[x] for i in range(n) for j in range(i + 1, min(n, i + self.longest) + 1) if (x := word[i:j]) in self.at)

    def around(self, word: str) -> Iterator[int]:
        """Words that hold it: found in all words in a line."""
        k = self.line.find(word)
        while k >= 0:
            i = bisect_right(self.begins, k - 1) - 1
            yield i
            k = self.line.find(word, self.begins[i + 1])  # from the next word's line break on

    def ahead(self, page: int, window: int, most: int) -> Iterator[tuple[int, int, frozenset[int]]]:
        for p in range(page, page + most + 1):
            k = self.starts.get(p)
            while k is not None and k < len(self.windows) and self.windows[k][0] == p:
                if p > page or self.windows[k][1] >= window:
                    yield self.windows[k]
                k += 1

    def best(self, text: str, page: int, window: int, lost: bool) -> tuple[int, int, float, int, int]:
        """Page, window, confidence, matched and all live words; the first best, and the current place where nothing matches."""
        live = [w for w in text.lower().split() if len(w) > 2]
        said = [(self.matches(w), self.idf(w)) for w in live]
        total = sum(x for _, x in said) or 1.0
        out = (page, window, 0.0, 0)
        for p, i, words in self.ahead(page, window, AHEAD_LOST if lost else AHEAD):
            hits = [x for found, x in said if not found.isdisjoint(words)]
            confidence = round(sum(hits) / total * 100 * (0.5 if p == page + 1 else 0.8 if p == page else 1.0), 9)
            if confidence > out[2]:
                out = (p, i, confidence, len(hits))
        return *out, len(live)


def start() -> dict:
    return {"page": 1, "window": 0, "turned": -math.inf, "good": -math.inf, "last": 1, "streak": 0, "seen": -math.inf}


def step(book: Book, s: dict, said: list[tuple[float, str]], now: float, text: str) -> tuple | None:
    """What one transcript leads to; updates the place ``s`` and the buffer. None of silence, which changes nothing."""
    if now - s["seen"] > IDLE:
        s.update(start())
        said.clear()
    if text.strip() in SILENT:
        return None
    s["seen"] = now
    said.append((now, text))
    said[:] = [x for x in said if now - x[0] <= BUFFER]
    lost = now - s["good"] >= LOST
    page, window, confidence, matched, total = book.best(" ".join(x for _, x in said), s["page"], s["window"], lost)
    if confidence >= GOOD:
        s["good"] = now
    turned = False
    if page == s["page"] and window > s["window"] and confidence > SAME_PAGE:
        s["window"] = window
    if s["page"] < page <= s["page"] + (AHEAD_LOST if lost else AHEAD):
        s["streak"], s["last"] = (s["streak"] + 1 if page == s["last"] else 1), page
        streak, least = TURN[page == s["page"] + 1]
        if confidence >= least and s["streak"] >= streak and now - s["turned"] >= GAP:
            s.update(page=page, window=window, turned=now, streak=0)
            turned = True
    elif page != s["page"]:
        s["streak"], s["last"] = 0, page
    return s["page"], s["window"], confidence, matched, total, turned, lost


def _followed(book: Book, s: dict, said: list, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["ts", "id"]).itertuples():
        told = step(book, s, said, r.ts.timestamp(), r.text or "")
        if told:
            out.append((r.session_id, r.ts, *told))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def read_book(windows: DataFrame) -> Book:
    """The windows ``page, window_index, words`` of one book, MOST_WINDOWS at most."""
    rows = windows.select("page", "window_index", "words").limit(MOST_WINDOWS + 1).collect()
    if len(rows) > MOST_WINDOWS:
        raise ValueError(f"a book has {MOST_WINDOWS} windows at most")
    return Book(map(tuple, rows))


class Sent:
    """A value that the tasks of a stateful stream get by a broadcast, however large it is.

    Spark loads such a stream's processor on the driver too, where no broadcast is there: a processor that Spark itself broadcasts, over
    1 MB, fails there, as does one that holds a broadcast. So the broadcast goes along pickled, and is looked up at first use.
    """

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.sent = spark.sparkContext.broadcast(value)

    def __getstate__(self) -> dict:
        return {"packed": pickle.dumps(self.sent)}

    @property
    def value(self):
        if "sent" not in vars(self):
            self.sent = pickle.loads(self.packed)
        return self.sent.value


class Follower(StatefulProcessor):
    """State of a session: ``said``, a list of times and texts, and ``place``, the dict of :func:`start`. The book is sent."""

    def __init__(self, book: Sent) -> None:
        self.book = book

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "t double, text string")
        self.place = handle.getValueState("place", "page int, window int, turned double, good double, last int, streak int, seen double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows))
        s = dict(zip(start(), self.place.get(), strict=True)) if self.place.exists() else start()
        said = [tuple(x) for x in self.said.get()] if self.said.exists() else []
        out = _followed(self.book.value, s, said, held)
        self.place.update(tuple(s.values()))
        self.said.put(said) if said else self.said.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if math.isfinite(s["seen"]):
            self.handle.registerTimer(int((s["seen"] + IDLE) * 1000) + 1)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.said.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


ROCKS, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow_transcripts(stream: DataFrame, book: Book, *, watermark: str = "1 hour") -> DataFrame:
    """The place after each transcript of a stream ``session_id, id, ts, text``: OUT.

    Within a micro-batch a session's rows are taken by time and id; rows later than the watermark are dropped. A session that is silent for
    IDLE seconds starts anew, whether its state was cleared by the timer or not. Null, empty and silent texts change nothing and have no
    row. Sets the session's state store to RocksDB, which list state and timers need.
    """
    stream.sparkSession.conf.set(ROCKS, PROVIDER)
    rows = stream.select("session_id", "id", "ts", "text").withWatermark("ts", watermark)
    return rows.groupBy("session_id").transformWithStateInPandas(Follower(Sent(stream.sparkSession, book)), OUT, "Append", "EventTime")


def follow_batch(rows: DataFrame, book: Book) -> DataFrame:
    """The same over a finished table; each session is one group."""
    return rows.select("session_id", "id", "ts", "text").where(F.col("ts").isNotNull()).groupBy("session_id").applyInPandas(lambda pdf: _followed(book, start(), [], pdf), OUT)
