"""Joins of the library: as-of, nearest and range joins as equi-joins or windows, fusions, upserts, overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import few
from .scans import carry, placed
from .tables import cut


def lookup_postings(asked: DataFrame, post: DataFrame) -> DataFrame:
    """``query_id, page, hits``: distinct query words met with postings."""
    return asked.select("query_id", "word").distinct().join(post, "word").groupBy("query_id", "page").agg(F.count(F.lit(1)).alias("hits"))


def asof_page(points: DataFrame, page_times: DataFrame, *, by: str = "recording", slices: int | None = None) -> DataFrame:
    """``points`` with the page whose start is the last at or before them: one ordered scan over both sides in slices, no range join."""
    both = points.select(by, "t", "id", F.lit(None).cast("int").alias("_page"), F.lit(1).alias("_p"))
    both = both.unionByName(page_times.select(by, "t", F.lit(None).cast("long").alias("id"), F.col("page").alias("_page"), F.lit(0).alias("_p")))
    x = carry(placed(both, by, ["t", "_p", "_page", "id"], slices=slices), by, F.col("_page"), "expected_page")
    return x.where("_p = 1").select(by, "t", "id", "expected_page")


def time_window_candidates(points: DataFrame, page_times: DataFrame, *, by: str = "recording", window_sec: float = 30) -> DataFrame:
    """Pages from the current one on that start within the window of a point, by equi-join of time buckets; ``time_boost`` is exp(-d/10)."""
    bucket = F.floor(F.col("t") / window_sec)
    near = points.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    pages = page_times.select(by, F.col("t").alias("page_t"), "page", F.floor(F.col("t") / window_sec).alias("_b"))
    out = near.join(pages, [by, "_b"]).where((F.abs(F.col("page_t") - F.col("t")) <= window_sec) & (F.col("page") >= F.col("current_page")))
    out = out.withColumn("time_diff", F.abs(F.col("page_t") - F.col("t")))
    return out.select("id", by, "page", "time_diff", F.exp(-F.col("time_diff") / 10).alias("time_boost"))


def page_window_candidates(obs: DataFrame, *, back: int, ahead: int, max_page: int = 183) -> DataFrame:
    """A row for each page from ``current_page - back`` to ``current_page + ahead`` within the book."""
    lo, hi = F.greatest(F.lit(1), F.col("current_page") - back), F.least(F.lit(max_page), F.col("current_page") + ahead)
    return obs.withColumn("page", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))


def nearest_marker(frames: DataFrame, markers: DataFrame, *, by: str = "recording", slices: int | None = None) -> DataFrame:
    """Each frame's nearest marker, the earlier of equally near ones; found by scans in slices."""
    both = frames.select(by, "t", "id", F.lit(None).cast("double").alias("mt"), F.lit(None).cast("int").alias("mp"), F.lit(1).alias("_p"))
    both = both.unionByName(markers.select(by, "t", F.lit(None).cast("long").alias("id"), F.col("t").alias("mt"), F.col("page").alias("mp"), F.lit(0).alias("_p")))
    mark = F.when(F.col("mt").isNotNull(), F.struct("mt", "mp"))
    x = placed(both, by, ["t", "_p", "mp", "id"], slices=slices)
    x = carry(carry(x, by, mark, "prev"), by, mark, "next", backward=True)
    dp, dn = F.col("t") - F.col("prev.mt"), F.col("next.mt") - F.col("t")
    late = dp.isNull() | (dn < dp)
    return x.where("_p = 1").select(by, "id", F.when(late, F.col("next.mp")).otherwise(F.col("prev.mp")).alias("marker_page"), F.when(late, dn).otherwise(dp).alias("distance"))


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    return words.join(known.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def missing_pages(entries: DataFrame, n_pages: int) -> DataFrame:
    return entries.sparkSession.range(1, n_pages + 1).withColumnRenamed("id", "page").join(entries.select(F.col("page").cast("long")), "page", "left_anti")


def vocabulary_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words of both sides with their counts."""
    n = lambda df, name: df.groupBy("word").agg(F.count(F.lit(1)).alias(name))
    out = n(left, "left_count").join(n(right, "right_count"), "word")
    return out.withColumn("total", F.col("left_count") + F.col("right_count"))


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    tagged = left.select("word", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("word", F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = tagged.groupBy("word").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(F.count_if((F.col("l") + F.col("r")) == 2).alias("in_both"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))


def merge_fingerprints(sources: DataFrame, *, priority: list[str]) -> DataFrame:
    """One row a page: the source of highest priority, with the duration of the next that has one."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    w = Window.partitionBy("page").orderBy(F.when(rank > 0, rank).otherwise(999), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = Window.partitionBy("page").orderBy(F.when(rank > 0, rank).otherwise(999), "source")
    return sources.withColumn("_d", F.first("duration", ignorenulls=True).over(w)).withColumn("_n", F.row_number().over(n)).where("_n = 1").withColumn("duration", F.coalesce("duration", "_d")).drop("_d", "_n")


def fuse_candidates(page_scores: DataFrame, word_scores: DataFrame, temporal: DataFrame) -> DataFrame:
    """All candidate pages of a query; a missing page or word score is 0, a missing temporal score 0.3."""
    key = ["query_id", "page"]
    out = page_scores.join(word_scores, key, "full").join(temporal, key, "full")
    return out.select(*key, *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("page_score", 0.0), ("word_score", 0.0), ("temporal_score", 0.3))])


def align_audio_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Every word of a page with the page's segment; confidence falls with the root of the words, times are spread evenly."""
    n = F.count(F.lit(1)).over(Window.partitionBy("page"))
    w = words.withColumn("n", n)
    out = w.join(segments, "page")
    return out.select("word", "page", "pos", F.least(0.7 / F.sqrt("n"), F.lit(0.8)).alias("confidence"), (F.col("start") + (F.col("pos") - 1) * F.col("duration") / F.col("n")).alias("est_start"), (F.col("duration") / F.col("n")).alias("est_duration"))


#: Words and keys up to which they are broadcast (some 60 bytes each).
KEYS = 1_000_000
#: Pairs whose shorter word has at most so many letters meet by deletions, longer ones by segments, which are then selective.
SHORT = 6
#: Letters of a key by which a word is found inside another, and of the pieces that long words are cut into.
GRAM, PIECE = 8, 248


def _deletions(df: DataFrame, word: str, max_dist: int) -> DataFrame:
    """A word, and the word without each set of at most ``max_dist`` of its characters: words within the distance share one."""
    one = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    level, out = F.array(F.col(word)), F.array(F.col(word))
    for _ in range(max_dist):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: x != ""), one)))
        out = F.array_union(out, level)
    return df.where(F.length(word) <= SHORT + max_dist).select(word, F.explode(out).alias("_key"))


def _segments(size: Column, max_dist: int) -> list[tuple[Column, Column]]:
    """First letters and lengths of the ``max_dist + 1`` segments of a word of this size: lengths differ by one at most, longer ones last."""
    parts, at, out = max_dist + 1, F.lit(1), []
    for i in range(parts):
        length = F.floor(size / parts) + F.when(size % parts >= parts - i, 1).otherwise(0)
        out.append((at, length))
        at = at + length
    return out


def _segment_key(word: Column, size: Column, i: int, at: Column, length: Column) -> Column:
    return F.xxhash64(F.substring(word, at.cast("int"), length.cast("int")), size, F.lit(i))


def _owned(df: DataFrame, word: str, max_dist: int) -> DataFrame:
    """A word of more than SHORT letters with a key for each of its segments."""
    w, size = F.col(word), F.length(word)
    keys = [_segment_key(w, size, i, at, length) for i, (at, length) in enumerate(_segments(size, max_dist))]
    return df.where(size > SHORT).select(word, F.explode(F.array(*keys)).alias("_key"))


def _sought(df: DataFrame, word: str, max_dist: int) -> DataFrame:
    """A word with the keys under which any word within ``max_dist`` edits has a segment.

    Of ``max_dist + 1`` segments one is free of edits, with at most ``i`` edits left of the i-th (from 0) and the others right of it. So
    it starts at most ``i`` places off, and at most ``max_dist - i`` off when counted from the words' ends: a few places for each size.
    """
    w, own, keys = F.col(word), F.length(word), []
    for more in range(-max_dist, max_dist + 1):
        size = own - more  # of the other word
        for i, (at, length) in enumerate(_segments(size, max_dist)):
            for shift in range(max(-i, more - (max_dist - i)), min(i, more + max_dist - i) + 1):
                start = at + shift
                fits = (size > SHORT) & (start >= 1) & (start + length <= own + 1)
                keys.append(F.when(fits, _segment_key(w, size, i, start, length)))
    found = F.explode(F.array_distinct(F.array_compact(F.array(*keys))))
    return df.where(own > SHORT).select(word, found.alias("_key"))


def _shared(a: str, i: int, b: str, j: int) -> int:
    """Letters that two words have in common from these places on: doubled steps, then halved ones, each a comparison of slices."""
    if a[i : i + 1] != b[j : j + 1]:
        return 0
    n, step = 0, 64
    while step:
        if i + n + step <= len(a) and j + n + step <= len(b) and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, step * 2
        else:
            step //= 2
    return n


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether two long words are within ``most`` edits: for each number of edits, the furthest place on each diagonal."""
    goal, reach = len(b) - len(a), {0: _shared(a, 0, b, 0)}
    for _ in range(most):
        if reach.get(goal, -1) >= len(a):
            break
        fresh: dict[int, int] = {}
        for d, i in reach.items():
            for e, k in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if k <= len(a) and 0 <= k + e <= len(b):
                    fresh[e] = max(fresh.get(e, -1), k)
        reach = {d: i + _shared(a, i, b, i + d) for d, i in fresh.items()}
    return reach.get(goal, -1) >= len(a)


def _long_within(a: str, b: str, most: int) -> Column:
    @F.pandas_udf("boolean")
    def compare(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([within_edits(x, y, most) for x, y in zip(left, right, strict=True)], dtype=bool)

    return compare(a, b)


def _near(x: DataFrame, y: DataFrame, a: str, b: str, max_dist: int) -> DataFrame:
    """Pairs of words within ``max_dist`` edits."""
    short = _deletions(y, b, max_dist).join(few(_deletions(x, a, max_dist), KEYS), "_key").select(a, b)
    long = _sought(y, b, max_dist).join(few(_owned(x, a, max_dist), KEYS), "_key").select(a, b)
    within = F.abs(F.length(a) - F.length(b)) <= max_dist
    least = F.least(F.length(a), F.length(b))
    found = short.unionByName(long.where(least <= PIECE)).where(within & (F.levenshtein(a, b, max_dist) >= 0))
    # the built-in distance takes time by the product of the lengths
    vast = _sought(y.where(F.length(b) > PIECE), b, max_dist).join(_owned(x.where(F.length(a) > PIECE), a, max_dist), "_key").select(a, b).where(within).distinct()
    return found.unionByName(vast.where(_long_within(a, b, max_dist)))


def _grams(text: Column, lengths: list[int]) -> Column:
    """Hashes of all parts of these lengths, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.xxhash64(F.substring(text, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.array(*map(of, lengths))))


def _contained(outer: DataFrame, inner: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of words of which ``b`` is a part of ``a``: found by the first GRAM letters of ``b`` (all of a shorter one) among the parts of ``a``.

    A word has GRAM keys a letter at most. Longer words are cut into overlapping pieces, whose keys carry a hash of the word in place of
    the word; what was found by them meets the words again and is compared.
    """
    inner = inner.where(F.length(b) > 0)
    lengths = sorted(r[0] for r in inner.select(F.least(F.length(b), F.lit(GRAM))).distinct().collect())  # GRAM numbers at most
    if not lengths:
        return outer.select(a, F.lit("").alias(b)).limit(0).select("left_word", "right_word")
    most = PIECE + GRAM - 1
    keyed = few(inner.select(b, F.xxhash64(F.substring(b, 1, GRAM)).alias("_key")), KEYS)
    plain = outer.where(F.length(a).between(1, most)).select(a, F.explode(_grams(F.col(a), lengths)).alias("_key"))
    found = plain.join(keyed, "_key").where(F.contains(a, b)).select("left_word", "right_word")
    long = outer.where(F.length(a) > most)
    if long.isEmpty():
        return found
    pieces = long.select(F.xxhash64(a).alias("_a"), F.length(a).alias("_n"), F.explode(F.transform(F.sequence(F.lit(1), F.length(a), F.lit(PIECE)), lambda i: F.substring(F.col(a), i, F.lit(most)))).alias("_piece"))
    parts = pieces.select("_a", "_n", F.explode(_grams(F.col("_piece"), lengths)).alias("_key"))
    met = parts.join(inner.select(F.xxhash64(b).alias("_b"), F.length(b).alias("_m"), F.xxhash64(F.substring(b, 1, GRAM)).alias("_key")), "_key")
    met = met.where("_m <= _n").select("_a", "_b").distinct()
    met = met.join(long, F.col("_a") == F.xxhash64(a)).join(inner, F.col("_b") == F.xxhash64(b))
    return found.unionByName(met.where(F.contains(a, b)).select("left_word", "right_word"))


def fuzzy_join(left: DataFrame, right: DataFrame, *, max_dist: int = 2, contains: bool = True) -> DataFrame:
    """Pairs of words that are equal, of which one holds the other, or that are within ``max_dist`` edits; each pair once.

    Short words meet by shared deletions, longer ones by a shared segment near its place, and words inside others by their first letters.
    All candidates are compared. Keys grow in proportion to a word's letters. The distinct words are
    written once, as every way of meeting reads them. Null words match nothing; the empty word matches words of up
    to ``max_dist`` letters and is part of none. No cross join.
    """
    x = cut(left.select(F.col("word").alias("left_word")).where("left_word is not null").distinct())
    y = cut(right.select(F.col("word").alias("right_word")).where("right_word is not null").distinct())
    n = left.sparkSession.sparkContext.defaultParallelism  # a written list of words is small, but every word makes many keys
    x, y = x.repartition(n, "left_word"), y.repartition(n, "right_word")
    pairs = _near(x, y, "left_word", "right_word", max_dist)
    if contains:
        pairs = pairs.unionByName(_contained(x, y, "left_word", "right_word")).unionByName(_contained(y, x, "right_word", "left_word"))
    return pairs.distinct()


def search_substrings(asked: DataFrame, page_words: DataFrame, *, points: int = 10) -> DataFrame:
    """``query_id, page, score`` of pages in whose words the asked words are found, inside of longer ones too: ``points`` for each asked word.

    ``asked``: query_id, word, where a repeated word counts again; ``page_words``: page, word, words without blanks. Distinct words of both
    sides meet first, then the pages of what was found. Null and empty words are found nowhere.
    """
    post = page_words.select("page", F.col("word").alias("left_word")).where("left_word <> ''").distinct()
    n = asked.where("word <> ''").groupBy("query_id", F.col("word").alias("right_word")).agg(F.count(F.lit(1)).alias("_n"))
    parallel = asked.sparkSession.sparkContext.defaultParallelism
    x = cut(post.select("left_word").distinct()).repartition(parallel, "left_word")
    y = cut(n.select("right_word").distinct()).repartition(parallel, "right_word")
    pages = _contained(x, y, "left_word", "right_word").join(post, "left_word").select("right_word", "page").distinct()
    return pages.join(n, "right_word").groupBy("query_id", "page").agg((F.sum("_n") * points).alias("score"))


#: Asked pages that a task holds with their words; cells of a table of pages by asked pages, and postings met at once.
ASKED_BLOCK, CELLS = 16_384, 1 << 20


def page_overlap(asked: DataFrame, post: DataFrame, *, block: int = ASKED_BLOCK) -> DataFrame:
    """Shared distinct words of each asked page with every other page (``word, page`` both, distinct rows).

    Pages go with their words past blocks of asked pages, and pairs are counted where they meet: no pair is shuffled or held, as there may
    be as many as asked pages times pages.
    """
    known = cut(asked.where("word is not null").select("word").distinct().withColumn("_w", F.monotonically_increasing_id()))
    words = lambda x: x.where("page is not null").join(few(known), "word").groupBy("page").agg(F.collect_list("_w").alias("ws"))
    left, right = cut(words(asked)), words(post)
    kinds = [x.schema["page"].dataType.simpleString() for x in (left, right)]
    blocks = max(1, -(-left.count() // block))
    parts = max(1, -(-int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    own = lambda n: F.pmod(F.xxhash64("page"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    told = lambda x, side: x.select(F.lit(side).alias("side"), F.col("page").cast("long").alias("page"), "ws", "a", "b")
    both = told(left.withColumn("a", own(blocks)).withColumn("b", every(parts)), 0).unionByName(told(right.withColumn("b", own(parts)).withColumn("a", every(blocks)), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "side")])
            edges = np.flatnonzero((np.diff(where) != 0).any(0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                a, b, side = where[:, lo].tolist()
                if (a, b) != at:
                    at, held, index = (a, b), [], None
                pages, lists = batch.column("page").to_numpy()[lo:hi], batch.column("ws").slice(lo, hi - lo)
                flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                if side == 0:
                    held.append((pages, flat, sizes))
                    continue
                if index is None:
                    index = _by_word(held)
                yield from _overlaps(index, pages, flat, sizes)

    dealt = both.repartition(blocks * parts, "a", "b").sortWithinPartitions("a", "b", "side")
    out = dealt.mapInArrow(run, "page_a long, page_b long, shared long")
    return out.select(*[F.col(c).cast(k).alias(c) for c, k in zip(("page_a", "page_b"), kinds, strict=True)], "shared")


def _by_word(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Asked pages; words in order, where each one's pages begin, and the places of these pages."""
    pages, flat, sizes = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
    place = np.repeat(np.arange(len(pages), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    words, begins = np.unique(flat[order], return_index=True)
    return pages, words, np.r_[begins, len(flat)], place[order]


def _overlaps(index: tuple[np.ndarray, ...], pages: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    asked, words, begins, places = index
    if not len(asked):
        return
    ends, step = np.r_[0, np.cumsum(sizes)], max(1, CELLS // len(asked))
    for lo in range(0, len(pages), step):
        some = pages[lo : lo + step]
        ws = flat[ends[lo] : ends[lo + len(some)]]
        row = np.repeat(np.arange(len(some)), sizes[lo : lo + len(some)])
        k = np.minimum(np.searchsorted(words, ws), len(words) - 1)
        known = words[k] == ws
        k, row = k[known], row[known]
        table = np.zeros(len(some) * len(asked), np.int64)
        n = begins[k + 1] - begins[k]
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // CELLS)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(k)], strict=True):  # a common word has all asked pages
            m = n[i:j]
            each = np.repeat(np.arange(i, j), m)
            met = places[begins[k[each]] + np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)]
            table += np.bincount(row[each] * len(asked) + met, minlength=len(table))
        found = np.flatnonzero(table)
        page_a, page_b = asked[found % len(asked)], some[found // len(asked)]
        other = page_a != page_b
        yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (page_a, page_b, table[found])], names=["page_a", "page_b", "shared"])


def words_for_recordings(recordings: DataFrame, page_times: DataFrame, tokens: DataFrame) -> DataFrame:
    """Words of the pages that start within each recording.

    Only words of such pages are shuffled; where these are few, a recording's words are added up where its pages are, without a shuffle.
    """
    covered = cut(recordings.join(page_times, "recording").where("t <= duration").select("recording", "page").distinct())
    own = tokens.join(few(covered.select("page").distinct()), "page", "left_semi")
    counted = cut(own.groupBy("page", "word").agg(F.count(F.lit(1)).alias("n")))  # a page's word is one row in the join
    dealt = covered.repartition(int(covered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "recording")
    return dealt.join(few(counted, KEYS), "page").groupBy("recording", "word").agg(F.sum("n").alias("count"))


def upsert_by_key(current: DataFrame, updates: DataFrame, *, keys: list[str], update_cols: list[str], version_col: str) -> DataFrame:
    """``current`` with the newest update of each key: listed columns replaced, unknown keys inserted."""
    newest = updates.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version_col), *[F.desc(c) for c in update_cols]))).where("_n = 1").drop("_n")
    u = newest.select(*keys, *[F.col(c).alias(f"_{c}") for c in current.columns if c not in keys], F.lit(True).alias("_hit"))
    joined = current.withColumn("_old", F.lit(True)).join(u, keys, "full")
    pick = [F.when(F.col("_hit") & (F.col("_old").isNull() | F.lit(c in update_cols)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c not in keys]
    return joined.select(*keys, *pick).select(*current.columns)


def delete_cascade(parent: DataFrame, children: DataFrame, *, parent_key: str, fk: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    return parent.join(gone, F.col(parent_key) == F.col("_id"), "left_anti"), children.join(gone, F.col(fk) == F.col("_id"), "left_anti")
