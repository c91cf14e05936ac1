"""Suffix-array dedup over a prefix-free parse: every byte that a long enough string repeated elsewhere covers is removed.

A rolling hash triggers phrase borders: each place belongs to the smallest gram hash of the next ``SPAN`` grams, and a phrase is a run
of places with the same one. Equal strings of ``LENGTH`` bytes therefore meet the same triggers at the same places, wherever they stand.
The parse of a text is its sequence of phrases. The dictionary holds each distinct phrase with the ``LENGTH`` bytes that follow it once.

Suffixes need to be ordered only up to ``LENGTH`` bytes, and of that order only neighbours that are equal so far count. So places are
not ranked one by one: a phrase in context that the dictionary holds twice settles all its places at once; a phrase whose trigger
occurs nowhere else rules out the places that need it; and only the places of what is left (near the borders of repeats) are compared as
suffixes of dictionary phrases, with the phrases of the same trigger. Spark shuffles hashes of triggers, phrases and border places; of
texts only those with places to compare or to remove. Strings count as equal when two independent 64-bit hashes of theirs are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, per_row, small_batches, text_or_empty
from .exact_dedup import bits_for, flag, key_filter
from .near_dedup import mix

LENGTH = 400
GRAM = 64
SPAN = 96
#: Words that a run of repeated triggers covers to count as a passage of over 50 words, whose ends hold no trigger for some 25 bytes each.
PASSAGE = 36
#: Texts whose findings a worker gathers before it passes them on.
PIECE = 64

_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240201, 20240202)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.lru_cache(maxsize=2)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Rolling:
    """Hashes of any part of a text from sums of its prefixes; ``which`` of two."""

    def __init__(self, data: bytes, which: int = 0) -> None:
        n = len(data)
        power, self.inverse = _powers(which, 1 << max(16, (n + 1).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[which][np.frombuffer(data, np.uint8)] * power[:n])))

    def parts(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        size = (hi - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + size)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _both(data: bytes, first: Rolling, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of parts of a text."""
    return first.parts(lo, hi), Rolling(data, 1).parts(lo, hi)


def _slide(x: np.ndarray, size: int, least) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    k = 1
    while 2 * k <= size:
        x = least(x[:-k], x[k:])
        k *= 2
    return least(x[: len(x) - (size - k)], x[size - k :]) if k < size else x


def triggers(roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of GRAM + SPAN bytes at least: the place's trigger for every place, and the places and hashes of the triggers."""
    v = roll.grams(GRAM)
    low = _slide(v, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, low, pad)), SPAN, np.maximum) == v)
    return low, at, v[at]


def passages(data: bytes, at: np.ndarray, known: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Stretches from the first to the last trigger of runs of known triggers, of ``words`` words at least."""
    edge = np.diff(np.concatenate(([False], known, [False])).astype(np.int8))
    out = [(int(at[i]), int(at[j - 1]) + GRAM) for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return [(lo, hi) for lo, hi in out if len(data[lo:hi].split()) >= words]


def phrases(low: np.ndarray, known: np.ndarray, size: int, length: int) -> list[np.ndarray]:
    """First and last places of the phrases, cut to places all of whose triggers are in ``known``, and the phrases' triggers."""
    start = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    stop = np.concatenate((start[1:], [len(low)]))
    lone = ~np.isin(low[start], known)
    reach = length - GRAM - SPAN + 1
    dead = np.zeros(len(low) + 1, np.int32)
    np.add.at(dead, np.maximum(start[lone] - reach, 0), 1)
    np.add.at(dead, stop[lone], -1)
    alive = np.cumsum(dead)[: size - length + 1] == 0
    border = np.zeros(len(low) + 1, bool)
    border[start] = True
    edge = np.concatenate(([True], border[1 : len(alive)] | (alive[1:] != alive[:-1])))
    lo = np.flatnonzero(edge)
    hi = np.concatenate((lo[1:], [len(alive)])) - 1
    keep = alive[lo]
    return [lo[keep], hi[keep], low[lo[keep]]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("t"), text.cast("binary").alias("data"))


def _with_lists(texts: DataFrame, lists: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Texts that may have a list, joined with it (null without one), and those that have none for certain.

    A Bloom filter of the lists' keys, sized from their number (128 MB at most), decides; so only texts with lists and a few others
    shuffle.
    """
    lists = cut(lists)
    bits = bits_for(lists.count())
    held = flag(texts, key_filter(lists, F.xxhash64("k", "t"), bits), F.xxhash64("k", "t"), bits)
    met = held.where("_maybe").drop("_maybe").join(lists, ["k", "t"], "left")
    return met, held.where("not _maybe").drop("_maybe").withColumn(column, F.lit(None).cast(lists.schema[column].dataType))


def _from_texts(texts: DataFrame, work, told: str) -> DataFrame:
    """``k, t`` and the arrays ``told`` that ``work`` makes of a text and what comes with it, a row for each element."""
    names, given = [x.split()[0] for x in told.split(", ")], [c for c in texts.columns if c not in ("doc_id", "k", "t")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), PIECE):
                part = b.iloc[i : i + PIECE]
                found = [work(bytes(x[0]), *x[1:]) for x in part[given].itertuples(index=False, name=None)]
                sizes = [len(x[0]) for x in found]
                if sum(sizes):
                    arrays = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"k": np.repeat(part["k"].to_numpy(), sizes), "t": np.repeat(part["t"].to_numpy(), sizes)} | {n: a.view(np.int64) if a.dtype == np.uint64 else a for n, a in zip(names, arrays, strict=True)})
        pa.default_memory_pool().release_unused()

    return small_batches(texts).select("k", "t", *given).mapInPandas(run, f"k long, t long, {told}")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two tables ``k, t, lo, hi`` about the text with this key (id, or the smallest long for a null id; and a hash of the text).

    The first: a string of ``length`` bytes at each place from lo to hi also starts elsewhere; every such place is in a row. The
    second: passages, stretches in which every trigger (one in some 48 bytes) also occurs elsewhere, of PASSAGE words at least. The
    triggers tell where a passage is but not its last bytes, and not that what is between two of them is equal: an estimate.
    """
    if length < 2 * (GRAM + SPAN):
        raise ValueError(f"length must be at least {2 * (GRAM + SPAN)}")
    texts = _keyed(docs, id_col, text_col).where(F.octet_length("data") >= GRAM + SPAN)

    def parse(data):
        found, n = np.unique(triggers(Rolling(data))[2], return_counts=True)
        return np.arange(len(found), dtype=np.int32), found, 1 + (n > 1)

    parsed = cut(_from_texts(texts, parse, "i int, h long, n long"))
    again = cut(parsed.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    met = cut(parsed.join(again, "h").select("k", "t", "i"))
    lists = met.groupBy("k", "t").agg(F.collect_set("i").alias("known"))

    def context(data, known):
        roll = Rolling(data)
        low, at, v = triggers(roll)
        known = np.unique(v)[np.asarray(known)]
        shown = np.array(passages(data, at, np.isin(v, known), PASSAGE), np.int64).reshape(-1, 2)
        lo, hi, h = phrases(low, known, len(data), length) if len(data) >= length else (np.zeros(0, np.int64),) * 3
        c, d = _both(data, roll, lo, hi + length) if len(lo) else (np.zeros(0, np.uint64),) * 2
        none = np.zeros(len(shown), np.int64)
        return *(np.concatenate((a.view(np.int64), b)) for a, b in ((lo, shown[:, 0]), (hi, shown[:, 1]), (h, none), (c, none), (d, none))), np.repeat([False, True], [len(lo), len(shown)])

    held = _with_lists(texts, lists, "known")[0].where("known is not null").select("k", "t", "data", "known")
    held = cut(_from_texts(held, context, "lo long, hi long, h long, c long, d long, passage boolean"))
    shown, held = held.where("passage").select("k", "t", "lo", "hi"), held.where("not passage").drop("passage")
    classes = cut(held.groupBy("c", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "t", "lo", "hi", "h")).alias("one")))
    settled = held.join(classes.where("n > 1").select("c", "d"), ["c", "d"]).select("k", "t", "lo", "hi")
    lone = classes.where("n = 1").select("one.*")
    asked = lone.select("h").distinct()
    others = classes.where("n > 1").select("one.*").join(asked, "h", "left_semi")
    places = cut(lone.withColumn("open", F.lit(1)).unionByName(others.withColumn("open", F.lit(0))).select("k", "t", "lo", "hi", "open"))
    lists = places.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi", "open")).alias("places"))

    def compare(data, parts):
        at = np.concatenate([np.arange(p["lo"], p["hi"] + 1) for p in parts])
        open_ = np.concatenate([np.full(p["hi"] - p["lo"] + 1, p["open"]) for p in parts])
        return np.where(open_ == 1, at, -1), *_both(data, Rolling(data), at, at + length)

    held = _with_lists(texts, lists, "places")[0].where("places is not null").select("k", "t", "data", "places")
    suffixes = cut(_from_texts(held, compare, "at long, w long, x long"))
    equal = cut(suffixes.groupBy("w", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "x"))
    single = suffixes.where("at >= 0").join(equal, ["w", "x"]).select("k", "t", "at")
    island = F.col("at") - F.dense_rank().over(Window.partitionBy("k", "t").orderBy("at"))
    runs = single.withColumn("_g", island).groupBy("k", "t", "_g").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).drop("_g")
    return settled.unionByName(runs), shown


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>, n_passages long"


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For every row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans, n_passages``.

    A text is its UTF-8 bytes (null: none). Each byte that is covered by a ``length``-byte string which also starts anywhere else, in
    the same text or in another, is removed; overlaps count and all strings are judged on the input. Shorter texts keep all bytes.
    ``kept`` holds the other bytes, which may cut characters. ``n_passages`` counts passages of over 50 words that seem to occur
    elsewhere too, some of them shorter than ``length``; see :func:`repeated_spans`. Rows that repeat id and text are each other's
    repeats. Null ids take part and stay null; an empty table gives an empty result; other columns play no part.
    """
    spans, shown = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length)
    spans = cut(spans.withColumn("passage", F.lit(False)).unionByName(shown.withColumn("passage", F.lit(True))))
    lists = spans.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi", "passage")).alias("places"))

    def removed(data: bytes, parts: list) -> tuple:
        gone, at, kept = [], 0, []
        for lo, hi in sorted((p["lo"], p["hi"] + length) for p in parts if not p["passage"]):
            if gone and lo <= gone[-1][1]:
                gone[-1][1] = max(gone[-1][1], hi)
            else:
                gone.append([lo, hi])
        for lo, hi in gone:
            kept.append(data[at:lo])
            at = hi
        rest = b"".join([*kept, data[at:]])
        return len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest, [{"start": lo, "stop": hi} for lo, hi in gone], sum(p["passage"] for p in parts)

    names = [x.split()[0] for x in OUT.split(", ")]

    def make():
        return lambda data, places: dict(zip(names, zip(*(removed(x, p or []) for x, p in zip(data, places, strict=True)), strict=True), strict=True))

    met, rest = _with_lists(_keyed(docs, id_col, text_col), lists, "places")
    return per_row(met.select("doc_id", "data", "places").unionByName(rest.select("doc_id", "data", "places")), make, OUT, piece=PIECE)
