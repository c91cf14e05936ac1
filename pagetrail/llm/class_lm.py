"""LM scoring with Brown class-based bigrams: exchange clustering, class transitions and word emissions.

All counts come from all training documents. Every word that occurs ``LEAST`` times in them is clustered; rarer words, and with them
those that no training document holds, are one class of their own, and the end of a text is another. Pairs of neighbours are added up in
Spark, dealt by word to buckets; a sweep over the buckets gives each word the class of the largest exchange gain against the current
class table. The tasks get the words' hashes, order and classes as arrays, 13 bytes a clustered word, and the scoring ones their logarithms, 16
more. Words meet by their 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let_go, per_row, small_batches, text_or_empty
from .toxicity import remainder

#: Occurrences from which on a word is clustered. On held-out texts 3 scores better than 50 (README).
LEAST = 3
#: Words up to which that holds (29 bytes each in a scoring task, 116 MB); with more of them the least count is the next that fits.
HEAD = 4_000_000
CLASSES = 48
#: Pairs of neighbours that a bucket of words holds, about: a task has those of one in Python.
BUCKET = 750_000
#: Pairs that a row or batch between Spark and Python holds, about: 8 bytes each in a row of a bucket, 12 in a batch before.
ROW = 50_000
#: A sweep over all words that raises the log likelihood by less than this share of it is the last.
RISE = 5e-4
#: The smallest share of words that is tried when more at once make the pairs no likelier.
SMALLEST = 1 / 64
#: Counts of a class beside a word up to which gains are matrix products, and words whose gains a task holds at once.
FEW, AT_ONCE = 4, 512
#: Added to each class transition.
ALPHA = 0.1
#: Distinct words whose counts a task holds before it passes them on, and tokens whose pairs it holds.
FLUSH, TOKENS = 200_000, 700_000
#: Tokens whose pairs are added up for a bucket in one task; with more, they are first added up in as many parts.
MERGED = 500_000_000
HELD_OUT = 1


def words(text: str) -> list[bytes]:
    """Bytes between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def word_id(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (h >> 63 << 64)


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` of a table with a column ``text``; none of null or empty texts, or of an empty table."""

    def told(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
                if len(seen) > FLUSH:
                    yield told(seen)
                    seen = Counter()
        yield told(seen)
        del seen
        let_go()

    return small_batches(texts).where("text is not null").select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(out: np.ndarray, into: np.ndarray, own: np.ndarray, cls: np.ndarray, table: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What each word (a row of class counts after it and before it, and its count after itself) brings in each class, once it is taken out
    of its own; nothing in the first and last, which the end of a text and rare words have. ``near`` is ``small_gains(table)``."""
    left, right, diag = table.sum(1), table.sum(0), np.diag(table)
    at = np.arange(len(cls))
    total, home = np.zeros(out.shape), np.zeros(len(cls))
    for vec, side, other, small in ((out, table, into, near[0]), (into, table.T, out, near[1])):
        i, c = np.nonzero(vec)
        n, a = vec[i, c], cls[i]
        base = side[a, c] - n - np.where(c == a, other[i, a] + own[i], 0)
        home += np.bincount(i, _xlogx(base + n) - _xlogx(base), len(cls))
        with_own, rest = vec[at, cls], vec.copy()
        rest[at, cls] = 0
        for n in range(1, FEW + 1):
            total += (rest == n).astype(float) @ small[n]
        i, c = np.nonzero(rest > FEW)
        if len(i):
            n = rest[i, c]
            got = small[np.minimum(n, len(small) - 1).astype(int), c]
            anew = np.flatnonzero(n >= len(small))
            base = side[:, c[anew]].T
            got[anew] = _xlogx(base + n[anew, None]) - _xlogx(base)
            first = np.flatnonzero(np.diff(i, prepend=-1))
            total[i[first]] += np.add.reduceat(got, first, axis=0)
        j = np.flatnonzero(with_own)
        base = side[:, cls[j]].T - other[j]
        total[j] += _xlogx(base + with_own[j, None]) - _xlogx(base)
    total[at, cls] = home
    after, before, s = out.sum(1), into.sum(1), own[:, None]

    def less(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each word, with ``n`` taken out of its class, and its ``_xlogx``."""
        rows, logs = np.repeat(x[None], len(cls), 0), np.repeat(_xlogx(x)[None], len(cls), 0)
        rows[at, cls] -= n
        logs[at, cls] = _xlogx(rows[at, cls])
        return rows, logs

    d, log = less(diag, out[at, cls] + into[at, cls] + own)
    total += _xlogx(d + out + into + s) - _xlogx(d + out) - _xlogx(d + into) + log
    for x, n in ((left, after), (right, before)):
        x, log = less(x, n + own)
        total -= _xlogx(x + n[:, None] + s) - log
    total[:, [0, -1]] = -np.inf
    return total


def small_gains(table: np.ndarray, most: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """``[n, c, b]``: what n more pairs of class b with c bring, for n below ``most``; with b first and with c first."""
    n = np.arange(most)[:, None, None]
    return _xlogx(table.T + n) - _xlogx(table.T), _xlogx(table + n) - _xlogx(table)


def likelihood(table: np.ndarray) -> float:
    """The part of the pairs' log likelihood that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


class _Seen(dict):
    """Word to place in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


class Heads:
    """The clustered words' hashes, most frequent first; the two units after them are rare words and the end of a text."""

    def __init__(self, ids: np.ndarray) -> None:
        self.order = np.argsort(ids, kind="stable").astype(np.int32)
        self.sorted = ids[self.order]
        self.rare, self.end, self.units = len(ids), len(ids) + 1, len(ids) + 2

    def units_of(self, seen: _Seen) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the unit of each word, in the order of first sight."""
        ids = np.fromiter(map(word_id, seen), np.int64, len(seen))
        if not self.rare:
            return ids, np.full(len(ids), self.rare, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, ids), self.rare - 1)
        return ids, np.where(self.sorted[at] == ids, self.order[at], self.rare).astype(np.int32)


AFTER, BEFORE = 0, 1
_PARTS = "bucket int, side int, x binary, u binary, n binary"
_STATIC = "bucket int, words binary, own binary, start binary, u binary, n binary"


def neighbours(texts: DataFrame, heads: Heads, buckets: int, *, salts: int = 1) -> DataFrame:
    """Rows for each bucket of units (those with this remainder): units, their pairs with themselves, and where their pairs with units
    after them and before them start (two places a unit) in the lists of neighbours and counts. A unit lies in one row; a row ends
    with the unit that brings its pairs to ``ROW``, so that it stays small in the executor, in Arrow and in Parquet.

    Rare words and ends do not move: of theirs only the pairs among each other are held. With ``salts`` over 1 the findings of the
    tasks are first added up in so many parts a bucket, so that no task gets a frequent word's pairs from all of them.
    """

    shared, units, rare, end = texts.sparkSession.sparkContext.broadcast(heads), heads.units, heads.rare, heads.end
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def flush(seen: _Seen, held: list[int]) -> Iterator[pa.RecordBatch]:
        unit = shared.value.units_of(seen)[1]
        unit[0] = end
        path = unit[np.array(held, np.int32)]
        key, n = np.unique(path[:-1].astype(np.int64) * units + path[1:], return_counts=True)
        a, b, n = (key // units).astype(np.int32), (key % units).astype(np.int32), n.astype(np.int32)
        del key, path
        for side, x, u in ((AFTER, a, b), (BEFORE, b, a)):
            at = np.flatnonzero((x < rare) | (u >= rare))
            at = at[np.argsort(x[at] % buckets, kind="stable")]
            rows, size = [], 0
            for part in np.split(at, np.flatnonzero(np.diff(x[at] % buckets)) + 1):
                if len(part):
                    rows.append((int(x[part[0]] % buckets), side, x[part].tobytes(), u[part].tobytes(), n[part].tobytes()))
                    size += len(part)
                if size >= ROW:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = _Seen({b" ": 0}), [0]  # a space is no word: it stands for the ends of texts
        for batch in batches:
            for t in batch.column(0):
                held += map(seen.__getitem__, words(t.as_py()))
                held.append(0)
                if len(held) > TOKENS:
                    yield from flush(seen, held)
                    seen, held = _Seen({b" ": 0}), [0]
        if len(held) > 1:
            yield from flush(seen, held)
        del seen, held
        let_go()

    def added(found: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units, their neighbours on this side, sorted by both, and counts."""
        here = [s == side for s in found.column("side").to_pylist()]
        x, u, n = (np.frombuffer(b"".join(v.as_buffer() for v in itertools.compress(found.column(c), here)), np.int32) for c in ("x", "u", "n"))
        key = x.astype(np.int64) * units + u
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[first], np.add.reduceat(n, first).astype(np.int32) if len(first) else n
        return (key // units).astype(np.int32), (key % units).astype(np.int32), n

    def combine(found: pa.Table) -> pa.Table:
        bucket = found.column("bucket")[0].as_py()
        return pa.Table.from_batches([told([(bucket, side, *(v.tobytes() for v in added(found, side))) for side in (AFTER, BEFORE)])])

    def gather(found: pa.Table) -> pa.Table:
        bucket, sides = found.column("bucket")[0].as_py(), [added(found, side) for side in (AFTER, BEFORE)]
        held = np.union1d(sides[AFTER][0], sides[BEFORE][0])
        own = np.zeros(len(held), np.int64)
        x, u, n = sides[AFTER]
        own[np.searchsorted(held, x[x == u])] = n[x == u]
        sides = [(2 * np.searchsorted(held, x[x != u]) + side, u[x != u], n[x != u]) for side, (x, u, n) in enumerate(sides)]
        slot, u, n = (np.concatenate(v) for v in zip(*sides, strict=True))
        order = np.argsort(slot, kind="stable")
        u, n, start = u[order], n[order], np.searchsorted(slot[order], np.arange(2 * len(held) + 1))
        rows, edge = [], np.flatnonzero(np.diff(start[:-1:2] // ROW)) + 1
        for i, j in itertools.pairwise([0, *edge.tolist(), len(held)]):
            at = slice(start[2 * i], start[2 * j])
            rows.append((bucket, *(v.tobytes() for v in (held[i:j], own[i:j], start[2 * i : 2 * j + 1] - start[2 * i], u[at], n[at]))))
        del slot, u, n, order, sides
        let_go()
        names = [c.split()[0] for c in _STATIC.split(", ")]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if k else pa.int32()) for k, v in enumerate(row)], names) for row in rows])

    parts = small_batches(texts).select("text").mapInArrow(pairs, _PARTS)
    if salts > 1:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("x", "u"), F.lit(salts)))
        parts = salted.groupBy("bucket", "salt").applyInArrow(combine, _PARTS)
    return parts.groupBy("bucket").applyInArrow(gather, _STATIC)


class _Bucket:
    """A row of ``neighbours``, read."""

    def __init__(self, row: dict) -> None:
        self.units, self.u, self.n = (np.frombuffer(row[c], np.int32) for c in ("words", "u", "n"))
        self.own, self.start = (np.frombuffer(row[c], np.int64) for c in ("own", "start"))

    def table(self, cls: np.ndarray, classes: int) -> np.ndarray:
        """Pairs of classes, the unit's first."""
        width, rare = np.diff(self.start), len(cls) - 2
        a, c = np.repeat(np.repeat(cls[self.units], 2), width), cls[self.u]
        after = np.repeat(np.tile([True, False], len(self.units)), width)
        cell = a[after].astype(np.int64) * classes + c[after]
        out = np.bincount(cell, self.n[after], classes * classes)
        still = np.flatnonzero(~after & (self.u >= rare))
        still = still[np.repeat(np.repeat(self.units < rare, 2), width)[still]]  # pairs that only the mover holds
        out += np.bincount(c[still].astype(np.int64) * classes + a[still], self.n[still], classes * classes)
        return out + np.bincount(cls[self.units].astype(np.int64) * (classes + 1), self.own, classes * classes)

    def choose(self, cls: np.ndarray, table: np.ndarray, near, part: float, turn: int, classes: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Units that move and their new classes, and how many would: the share ``part`` may in this turn."""
        moved, to, wants, least = [], [], 0, max(1e-6, 1e-12 * abs(likelihood(table)))
        for lo in range(0, len(self.units), AT_ONCE):
            units = self.units[lo : lo + AT_ONCE]
            first = self.start[2 * lo : 2 * (lo + len(units)) + 1]
            slot = np.repeat(np.arange(2 * len(units)), np.diff(first))
            dense = np.bincount(slot * classes + cls[self.u[first[0] : first[-1]]], self.n[first[0] : first[-1]], 2 * len(units) * classes).reshape(len(units), 2, classes)
            a = cls[units].astype(int)
            g = gains(dense[:, AFTER], dense[:, BEFORE], self.own[lo : lo + AT_ONCE].astype(float), a, table, near)
            best, at = g.argmax(1), np.arange(len(units))
            go = (g[at, best] > g[at, a] + least) & (a > 0) & (a < classes - 1)
            wants += int(go.sum())
            if part < 1:
                mixed = (units.astype(np.uint64) * np.uint64(64) + np.uint64(turn % 64)) * np.uint64(0x9E3779B97F4A7C15)
                go &= (mixed >> np.uint64(40)).astype(float) < part * 2**24
            moved.append(units[go])
            to.append(best[go].astype(np.uint8))
        return np.concatenate(moved), np.concatenate(to), wants


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bucket]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Bucket({c: b.column(c)[i].as_buffer() for c in ("words", "own", "start", "u", "n")})
        del b
    let_go()


def class_table(static: DataFrame, cls: np.ndarray, *, classes: int = CLASSES) -> np.ndarray:
    """How often each class follows each; added up in Spark."""

    shared = static.sparkSession.sparkContext.broadcast(cls)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes)
        for bucket in _buckets(batches):
            total += bucket.table(shared.value, classes)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell], pa.float64())], ["cell", "n"])

    out = np.zeros(classes * classes)
    for cell, n in static.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    shared.destroy()
    return out.reshape(classes, classes)


def cluster(static: DataFrame, units: int, *, classes: int = CLASSES, sweeps: int | None = None, rise: float = RISE) -> tuple[np.ndarray, np.ndarray]:
    """A class for each unit, and the class table: the exchange over all clustered words.

    The end of a text has class 0 and rare words have the last to themselves; the others are dealt out in turn at first. In a sweep all
    words choose at once. Choices that together make the pairs no likelier are taken back, and half as many words may move in the next
    sweep, else twice as many. Ends when no word would move, when a sweep raises the log likelihood by less than ``rise`` of it (0: never
    for that), or after ``sweeps`` sweeps: some words may then still have a better class.
    """
    cls = (1 + np.arange(units) % (classes - 2)).astype(np.uint8)
    cls[units - 2 :] = classes - 1, 0

    def chooser(shared, part: float, turn: int):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cls, table = shared.value
            near = small_gains(table)
            for bucket in _buckets(batches):
                moved, to, wants = bucket.choose(cls, table, near, part, turn, classes)
                yield pa.RecordBatch.from_arrays([pa.array([moved.tobytes()], pa.binary()), pa.array([to.tobytes()], pa.binary()), pa.array([wants], pa.int64())], ["moved", "cls", "wants"])

        return choose

    table, part = class_table(static, cls, classes=classes), 1.0
    for turn in itertools.count() if sweeps is None else range(sweeps):
        shared = static.sparkSession.sparkContext.broadcast((cls, table))
        told = static.mapInArrow(chooser(shared, part, turn), "moved binary, cls binary, wants long").collect()  # five bytes a word at most
        shared.destroy()
        if not sum(r["wants"] for r in told):
            break
        then = cls.copy()
        for r in told:
            then[np.frombuffer(r["moved"], np.int32)] = np.frombuffer(r["cls"], np.uint8)
        if (then == cls).all():
            part = min(1.0, 2 * part)
            continue
        fresh = class_table(static, then, classes=classes)
        old, new = likelihood(table), likelihood(fresh)
        if new > old:
            cls, table = then, fresh
            if new - old < rise * part * abs(old):
                break
            part = min(1.0, 2 * part)
        elif rise and part <= SMALLEST:
            break
        else:
            part /= 2
    return cls, table


def _head(counts: DataFrame, least: int, most: int) -> DataFrame:
    """``id, n`` of the words that occur ``least`` times, or as often as it takes to be ``most`` words."""
    by_count = counts.where(F.col("n") >= least).groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    total = 0
    for r in by_count.toLocalIterator():  # a row for each count that occurs: about the root of twice the tokens at most
        total += r["words"]
        if total > most:
            least = r["n"] + 1
            break
    return counts.where(F.col("n") >= least).select(F.xxhash64("word").alias("id"), "n")


def class_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT, least: int = LEAST, head: int = HEAD, classes: int = CLASSES, sweeps: int | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from rows whose crc32(id) mod 5 is not ``held_out``. ``base_score`` is the smoothed unigram's log10 probability, ``score``
    the class bigram's: of each token's class after the class before it (the end of a text before the first), times the word's share
    of its class; the class of rare words keeps one half count for unknown words. A null or empty text is its end alone. Repeated rows
    count as often as they occur; null ids are one id, and stay null. Without training rows nothing is known: N and V are 0. An empty
    table gives an empty result. Other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("held_out", remainder(F.col("doc_id")) == held_out)
    train = texts.where("not held_out")
    counts = cut(count_words(train))
    all_n, kinds, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first() + (train.count(),)
    top = cut(_head(counts, least, head)).toArrow()
    ids, top_n = top.column("id").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((ids, -top_n))
    ids, top_n = ids[order], top_n[order]
    heads = Heads(ids)
    tokens = int(all_n) + ends
    static = cut(neighbours(train, heads, max(4, math.ceil(2 * tokens / BUCKET)), salts=math.ceil(tokens / MERGED)))
    cls, steps = cluster(static, heads.units, classes=classes, sweeps=sweeps)

    jump = np.log10((steps + ALPHA) / (steps.sum(1, keepdims=True) + ALPHA * classes))
    total, distinct = tokens, kinds + (ends > 0)
    under = float(np.log10(total + 0.5 * (distinct + 1)))
    heads_n, heads_kinds = np.bincount(cls[: heads.rare], top_n, classes), np.bincount(cls[: heads.rare], minlength=classes)
    logs = np.concatenate((np.log10(top_n + 0.5), [0.0, np.log10(ends + 0.5)]))  # rare words' own logarithms come later
    emit = np.concatenate((logs[: heads.rare] - np.log10(np.maximum(heads_n + 0.5 * heads_kinds, 0.5))[cls[: heads.rare]] if heads.rare else [], [-np.log10(all_n - top_n.sum() + 0.5 * (kinds - heads.rare + 1)), 0.0]))

    shared = docs.sparkSession.sparkContext.broadcast((heads, cls, logs, emit))

    def make():
        heads, cls, logs, emit = shared.value

        def read(texts):
            seen, path, cuts = _Seen({b" ": 0}), [], []
            for t in texts:
                path += map(seen.__getitem__, words(t))
                path.append(0)
                cuts.append(len(path))
            ids, unit = heads.units_of(seen)
            unit[0] = heads.end
            at = unit[np.array(path)]
            c = cls[at].astype(np.int64)
            steps = jump[np.concatenate(([0], c[:-1])), c]
            first = np.concatenate(([0], cuts[:-1])).astype(int)
            rare, place = at == heads.rare, np.array(path)
            known = np.add.reduceat((~rare & ((at != heads.end) | (ends > 0))).astype(np.int64), first)
            out = {"n_tokens": np.diff(cuts, prepend=0), "n_known": known, "base_score": np.add.reduceat(logs[at] - under, first), "score": np.add.reduceat(emit[at] + steps, first), "rest": []}
            for a, b in zip(first.tolist(), cuts, strict=True):
                x, n = np.unique(place[a:b][rare[a:b]], return_counts=True)
                out["rest"].append([{"id": i, "n": k} for i, k in zip(ids[x].tolist(), n.tolist(), strict=True)])
            return out

        read.done = let_go
        return read

    seen = cut(per_row(texts, make, "n_tokens long, n_known long, base_score double, score double, rest array<struct<id:long,n:long>>", passed=("doc_id", "held_out")).withColumn("_row", F.monotonically_increasing_id()))
    shared.destroy()
    rest = seen.select("_row", F.inline("rest"))
    floor = int(top_n[-1]) if heads.rare else None
    tail = counts if floor is None else counts.where(F.col("n") < floor)
    met = rest.join(tail.select(F.xxhash64("word").alias("id"), F.col("n").alias("c")), "id", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")
    met = met.groupBy("_row").agg(F.sum(log).alias("log"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("more"))
    out = seen.drop("rest").join(met, "_row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))
