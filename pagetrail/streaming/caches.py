"""What a stream keeps of each key: a cache of ids with a time to live and a size, and the items that wait for a reply.

Both hold a bounded number of entries a key in RocksDB state, evict by count, and write back only what a batch changed.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .transcripts import PROVIDER, ROCKS


class Seen:
    """Ids of one key, least recently touched first; with a size of 0 nothing is remembered, with a time of 0 nothing expires."""

    def __init__(self, ttl: float, most: int, held: Iterable[tuple[str, float]] = ()) -> None:
        self.ttl, self.most, self.at = ttl, most, OrderedDict(held)

    def repeated(self, id: str, now: float) -> bool:
        """Whether the id was seen within its time; a hit renews it, a miss stores it and evicts what is too old or too many."""
        known = self.at.pop(id, None)
        self.at[id] = now
        if known is not None and (self.ttl <= 0 or now - known < self.ttl):
            return True
        for k in [k for k, t in self.at.items() if 0 < self.ttl < now - t]:
            del self.at[k]
        while len(self.at) > self.most:
            self.at.popitem(last=False)
        return False


class Once(StatefulProcessor):
    """Map state ``seen``: id to its time and its place in the order of touches; ``touches`` numbers those."""

    def __init__(self, id: str, time: str, ttl: float, most: int) -> None:
        self.id, self.time, self.ttl, self.most = id, time, ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "t double, place long")
        self.touches = handle.getValueState("touches", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values([self.time, self.id], kind="stable")
        old = {k[0]: tuple(v) for k, v in self.seen.iterator()} if self.seen.exists() else {}
        n = self.touches.get()[0] if self.touches.exists() else 0
        cache = Seen(self.ttl, self.most, ((k, t) for k, (t, _) in sorted(old.items(), key=lambda x: x[1][1])))
        place, fresh = {k: p for k, (_, p) in old.items()}, []
        for id, now in zip(held[self.id], held[self.time], strict=True):
            if pd.isna(id) or not id:
                fresh.append(True)
                continue
            fresh.append(not cache.repeated(id, float(now)))
            n += 1
            place[id] = n
        for k in old.keys() - cache.at.keys():
            self.seen.removeKey((k,))
        for k, t in cache.at.items():
            if old.get(k) != (t, place[k]):
                self.seen.updateValue((k,), (t, place[k]))
        self.touches.update((n,))
        yield held[fresh]

    def close(self) -> None:
        pass


def dedupe_capped(stream: DataFrame, *, scope: str, id: str, time: str, ttl: float, most: int) -> DataFrame:
    """Rows of a stream whose ``id`` (a string) wasn't seen in its ``scope`` within ``ttl`` seconds of the column ``time``, a number.

    A scope remembers ``most`` ids at most and forgets the one touched longest ago; a repeat touches. Rows without an id, or with an empty
    one, pass. Within a micro-batch a scope's rows are taken by time and id.
    """
    stream.sparkSession.conf.set(ROCKS, PROVIDER)
    return stream.groupBy(scope).transformWithStateInPandas(Once(id, time, ttl, most), stream.schema, "Append", "None")


def waiting(pending: deque, rows: Iterable[tuple[int, bool]]) -> Iterator[tuple[int, list[int]]]:
    """For each reply what has waited for it, oldest first; ``pending`` forgets its oldest when it is full, and all at a reply."""
    for item, reply in rows:
        if reply:
            yield item, list(pending)
            pending.clear()
        else:
            pending.append(item)


class Pending(StatefulProcessor):
    """List state ``items``: what has come since the key's last reply."""

    def __init__(self, key: str, item: str, time: str, reply: str, most: int) -> None:
        self.key, self.item, self.time, self.reply, self.most = key, item, time, reply, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "item long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values([self.time, self.item])
        pending = deque((x[0] for x in self.items.get()) if self.items.exists() else (), self.most)
        told = list(waiting(pending, ((int(i), r is not None and not pd.isna(r) and bool(r)) for i, r in zip(held[self.item], held[self.reply], strict=True))))
        self.items.put([(x,) for x in pending]) if pending else self.items.clear()
        if told:
            yield pd.DataFrame({self.key: [key[0]] * len(told), self.item: [x for x, _ in told], "history": pd.Series([x for _, x in told], dtype=object)})

    def close(self) -> None:
        pass


def pending_history(stream: DataFrame, *, key: str, item: str, time: str, reply: str, most: int = 50) -> DataFrame:
    """A row for each reply of a stream: ``key``, ``item`` (the reply's, a long) and ``history``, the last ``most`` items since the reply
    before it. A null ``reply`` is none. Within a micro-batch a key's rows are taken by time and item."""
    stream.sparkSession.conf.set(ROCKS, PROVIDER)
    rows = stream.select(key, item, time, reply)
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Pending(key, item, time, reply, most), f"{key} {kind}, {item} long, history array<long>", "Append", "None")
