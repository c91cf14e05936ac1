"""Near-dedup: banded MinHash for candidates, odd sketches to sift them, whole shingle sets to confirm.

Equal sets are one node. Members of a band's bucket are compared with its smallest member, in rounds: a node meets one such member of
each component that it isn't in yet, and what is linked is contracted, so candidates grow with members and not with their square. Where
that leaves a bucket with several components, its members are compared across components in bounded blocks, first by sketches, then on
the whole sets of those that the sketches leave: every pair of different texts that share a bucket is then either in one component or
was compared. An odd sketch folds the MinHash samples into a parity bitmap; the population count of two sketches' XOR estimates their
similarity closely near 1, and only pairs far below the threshold by it are left out before the exact test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .class_lm import words
from .common import broadcast_if, cut, per_row, small_batches, text_or_empty
from .components import components

BANDS, ROWS = 48, 6
SKETCH_BITS = 512
#: An estimate below threshold - SLACK rules a pair out: over five standard deviations of the estimate at the threshold.
SLACK = 0.22
#: Rounds in which nodes meet the smallest members of their buckets; more only leave less to the blocks.
ROUNDS = 2
#: Ids up to which a list of candidates is broadcast (16 bytes each); a longer one is joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a block of sketches, and members and shingles of a block of sets; two blocks are compared in memory.
SKETCHES = 4096
BLOCK = 512
BLOCK_SHINGLES = 1 << 19

_MUL = np.random.default_rng(20240101).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(20240102).integers(1, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(20240103).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``size`` words; of the whole text if it has fewer words; none without words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = min(size, len(w))
    total = np.full(len(w) - n + 1, np.uint64(n) * _STEP[15], np.uint64)
    for i in range(n):
        total += mix(h[i : len(w) - n + 1 + i] * _STEP[i])
    return np.unique(mix(total))


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _MUL
        part ^= part >> np.uint64(32)
        np.minimum(best, part.min(0), out=best)
    return best


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Samples folded into SKETCH_BITS parities, as 64-bit words."""
    at = mix(mins + _SALT) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros(BANDS, np.uint64)
    table = mins.reshape(BANDS, ROWS)
    for i in range(ROWS):
        keys = mix(keys * _STEP[7] + table[:, i])
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _STEP[8]).view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """XOR population count up to which a pair's estimated similarity is at least ``threshold - SLACK``."""
    apart = 2 * BANDS * ROWS * (1 - max(0.0, threshold - SLACK))
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-2 * apart / SKETCH_BITS)))


def signatures(rows: DataFrame, *, size: int) -> DataFrame:
    """``doc_id, n, set_key, bands, sketch`` of rows of ``doc_id, text``; all but the first two are null for a text without words."""

    def make():
        def sign(texts):
            out = {"n": [], "set_key": [], "bands": [], "sketch": []}
            for text in texts:
                s = shingle_set(text, size)
                m = samples(s) if len(s) else None
                told = (len(s), None, None, None) if m is None else (len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(m), odd_sketch(m))
                for column, value in zip(out.values(), told, strict=True):
                    column.append(value)
            return out

        return sign

    return per_row(rows, make, "n long, set_key binary, bands array<long>, sketch array<long>")


def _sets(rows: DataFrame, *, size: int) -> DataFrame:
    """``id, s``: the whole sets of rows of ``doc_id, text``."""

    def make():
        return lambda texts: {"s": [shingle_set(t, size).view(np.int64) for t in texts]}

    return per_row(rows, make, "s array<long>", piece=64).withColumnRenamed("doc_id", "id")


def _differing(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _confirm(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs ``a, b`` of nodes whose sets are similar enough."""
    s = nodes.select("doc_id", "sketch", "n")
    left = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
    both = left.join(s.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    likely = cut(both.where(fits & (_differing(F.col("sa"), F.col("sb")) <= most_differing_bits(percent / 100))).select("a", "b", "na", "nb"))
    sets = _wanted(rows, likely.select(F.col("a").alias("id")).union(likely.select("b")), size)
    joined = likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("xb")), "b")
    joined = joined.withColumn("both", F.size(F.array_intersect("xa", "xb")))
    return joined.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _wanted(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id, s``: the whole sets of the rows with these ids, one a row id."""
    ids = cut(ids.select(F.col("id").alias("doc_id")).distinct())
    return cut(_sets(rows.join(broadcast_if(ids, BROADCAST_IDS), "doc_id", "left_semi"), size=size)).dropDuplicates(["id"])


def _sifted(comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of different components, of side 0 with side 1 or, where there is one side, within it, that their sizes and
    sketches do not rule out; in pieces."""
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(n)), np.arange(len(n)))
    most = most_differing_bits(percent / 100)
    for i in range(0, len(left), 64):
        a = left[i : i + 64]
        low, high = np.minimum(n[a][:, None], n[right][None]), np.maximum(n[a][:, None], n[right][None])
        ok = (comp[a][:, None] != comp[right][None]) & (100 * low >= percent * high)
        if not side.any():
            ok &= a[:, None] < right[None]
        x, y = np.nonzero(ok)
        x, y = a[x], right[y]
        for j in range(0, len(x), 1 << 16):
            p, q = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
            near = np.bitwise_count(sketch[p] ^ sketch[q]).sum(1) <= most
            yield p[near], q[near]


def _spanning(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different components, no more than connect the same rows. Many pairs are counted at once by a product of
    incidence matrices."""
    found = [np.stack(x, 1) for x in _sifted(comp, n, sketch, side, percent)]
    pairs = np.concatenate(found) if found else np.zeros((0, 2), int)
    if not len(pairs):
        return []
    shared = None
    if len(pairs) > 4 * len(ids):
        flat = np.concatenate(sets)
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        if (times > 1).sum() * len(ids) <= 20_000_000:
            m = np.zeros((len(ids), int((times > 1).sum())), np.float32)
            keep = times[place] > 1
            m[np.repeat(np.arange(len(ids)), [len(s) for s in sets])[keep], column[place[keep]]] = 1
            shared = (m @ m.T)[pairs[:, 0], pairs[:, 1]]
    root, out = {c: c for c in comp.tolist()}, []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for k, (x, y) in enumerate(pairs.tolist()):
        a, b = find(int(comp[x])), find(int(comp[y]))
        if a == b:
            continue
        both = int(shared[k]) if shared is not None else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (n[x] + n[y] - both):
            root[a] = b
            out.append((int(ids[x]), int(ids[y])))
    return out


def _in_groups(rows: DataFrame, keys: list[str], told: str, work) -> DataFrame:
    """``work(group)`` for each group of rows with equal keys, in sorted partitions, a group at a time: for many small groups."""
    names = [x.split()[0] for x in told.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            found = work(pd.concat(held, ignore_index=True)) if sum(map(len, held)) > 1 else []
            if len(found):
                yield pd.DataFrame(found, columns=names)

        for b in batches:
            k = b[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(held[-1][keys].iloc[-1]) != tuple(b[keys].iloc[lo]):
                    yield from flush()
                    held = []
                held.append(b.iloc[lo:hi])
        if held:
            yield from flush()

    return small_batches(rows).repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInPandas(run, told)


def _links_across(apart: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Links ``a, b`` between components (``center, doc_id, comp`` of buckets that hold several): at least those that connect the same nodes.

    Members of such buckets form families: the components of components that share buckets. A family is dealt into blocks. Every two
    blocks of sketches meet in one group, which tells for each member in which blocks of sets it has partners left; only there its set
    goes. No pair becomes a row unless it is a link that joins two components, and no group grows with the family.
    """
    family = components(apart.select(F.col("center").alias("a"), F.col("comp").alias("b")))
    members = apart.select("doc_id", "comp").distinct().join(family.select(F.col("node").alias("comp"), F.col("comp").alias("family")), "comp")
    members = members.join(nodes.select("doc_id", "sketch", "n").dropDuplicates(["doc_id"]), "doc_id")
    fine = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = members.groupBy("family").agg(fine.alias("fine"), F.ceil(F.count(F.lit(1)) / SKETCHES).cast("int").alias("blocks"))
    dealt = cut(members.join(blocks, "family").withColumn("i", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("f", F.pmod(F.xxhash64("doc_id", F.lit(1)), "fine").cast("int")))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("family", F.least("i", "j").alias("b0"), F.greatest("i", "j").alias("b1"), "i", "f", "doc_id", "comp", "n", "sketch")

    def sift(g: pd.DataFrame) -> list[tuple[int, int]]:
        side, f, ids = (g["i"] != g["b0"]).to_numpy().astype(int), g["f"].to_numpy().astype(np.int64), g["doc_id"].to_numpy()
        found: set[int] = set()
        for x, y in _sifted(g["comp"].to_numpy(), g["n"].to_numpy(), np.stack(g["sketch"].to_numpy()).view(np.uint64), side, percent):
            found.update(np.unique(np.concatenate((x << 32 | f[y], y << 32 | f[x]))).tolist())
        return [(int(ids[k >> 32]), k & 0xFFFFFFFF) for k in found]

    asked = cut(_in_groups(met, ["family", "b0", "b1"], "doc_id long, g int", sift).distinct())
    sets = _wanted(rows, asked.select(F.col("doc_id").alias("id")), size).withColumnRenamed("id", "doc_id")
    full = asked.join(dealt.select("doc_id", "family", "comp", "f", "n", "sketch"), "doc_id").join(sets, "doc_id")
    full = full.select("family", F.least("f", "g").alias("b0"), F.greatest("f", "g").alias("b1"), "f", "doc_id", "comp", "n", "sketch", "s")

    def compare(g: pd.DataFrame) -> list[tuple[int, int]]:
        side = (g["f"] != g["b0"]).to_numpy().astype(int)
        return _spanning(g["doc_id"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy(), np.stack(g["sketch"].to_numpy()).view(np.uint64), [np.asarray(x) for x in g["s"]], side, percent)

    return _in_groups(full, ["family", "b0", "b1"], "a long, b long", compare)


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components ``node, comp`` after further links ``a, b``, which are contracted to links between the components so far."""
    if comp is None:
        return components(links)
    at = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    ends = links.join(at, "a", "left").join(at.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    over = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    over = over.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    moved = comp.join(over, F.col("comp") == F.col("was"), "full")
    # nodes that had no component are their own so far
    return cut(moved.select(F.coalesce("node", "was").alias("node"), F.coalesce("now", "comp").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked when their sets of ``size``-word runs have 100 * intersection >= ``percent`` * union; A-Z are lower-cased, and a
    text with fewer words is one run. Null and empty texts have no set and no link. ``component_id`` is the smallest id that links
    reach; ``kept`` is whether it is the row's own. Rows with a null id get a null component and are kept; rows that repeat an id are
    one document. An empty table gives an empty result; other columns play no part. A pair exactly at 80 percent shares a bucket with
    probability 1 - 4e-7, a closer one with more.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = cut(signatures(rows, size=size))
    known = signed.where("n > 0 and doc_id is not null")
    classes = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    nodes = cut(known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    banded = nodes.select("doc_id", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").drop("high")
    members = cut(banded.join(full, "key"))
    comp = placed = None
    for turn in range(ROUNDS):
        if comp is None:
            pairs = members.where("doc_id <> low").groupBy(F.col("doc_id").alias("b")).agg(F.min("low").alias("a"))
        else:
            pairs = placed.where("comp <> center").groupBy(F.col("doc_id").alias("b"), "center").agg(F.min("low").alias("a")).drop("center")
        links = cut(_confirm(pairs, nodes, rows, percent, size))
        comp = _merged(comp, links)
        at = comp.select(F.col("node").alias("low"), F.col("comp").alias("center"))
        placed = members.join(comp, F.col("doc_id") == F.col("node"), "left").join(at, "low", "left")
        placed = cut(placed.select("key", "low", "doc_id", F.coalesce("comp", "doc_id").alias("comp"), F.coalesce("center", "low").alias("center")))
    split = placed.where("comp <> center").select("key").distinct()
    apart = cut(placed.join(split, "key").select("center", "doc_id", "comp").distinct())
    comp = _merged(comp, cut(_links_across(apart, nodes, rows, percent, size)))
    told = classes.join(comp, F.col("rep") == F.col("node"), "left").where("copies > 1 or comp is not null").select(F.col("set_key").alias("_key"), F.coalesce("comp", "rep").alias("comp"))
    out = signed.join(cut(told), F.col("set_key") == F.col("_key"), "left")
    comp_id = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.col("doc_id").eqNullSafe(comp_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, as they were: of each component the one with the smallest id.

    Rows with a null id, and null or empty texts, stay; rows that repeat an id stay or go together. An empty table gives an empty
    result; other columns, whatever their names, are passed on.
    """
    gone = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, percent=percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(broadcast_if(gone, BROADCAST_IDS), F.col("row")[id_col] == F.col("gone"), "left_anti").select("row.*")
