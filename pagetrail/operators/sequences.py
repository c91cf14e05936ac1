"""Sequence operators: segments, change points, smoothing, interpolation, windows, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.operators.scans import carry, exponential, placed, reached


def text_windows(tokens: DataFrame, *, size: int = 14, step: int = 7, min_words: int = 4, min_len: int = 3) -> DataFrame:
    """Sliding windows of a page's longer words; windows under ``min_words`` are dropped unless they are the whole page."""
    kept = tokens.where(F.length("word") >= min_len)
    pages = kept.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("ws"))
    last = F.when(F.size("ws") <= size, F.lit(0)).otherwise(F.size("ws") - 1)
    w = pages.select("page", "ws", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start_offset"))
    w = w.withColumn("words", F.slice("ws", F.col("start_offset") + 1, F.lit(size))).withColumn("window_index", F.floor(F.col("start_offset") / step).cast("int"))
    return w.where((F.size("words") >= min_words) | (F.size("ws") <= size)).select("page", "window_index", "words", "start_offset")


def page_segments(page_times: DataFrame, *, cap: float = 60) -> DataFrame:
    """Each page's start, end (the next start; for the last one the average duration later) and duration, capped."""
    w = Window.partitionBy("recording").orderBy("start", "page")
    nxt = F.lead("start").over(w)
    gap = F.avg(F.col("_next") - F.col("start")).over(Window.partitionBy("recording"))
    out = page_times.withColumn("_next", nxt).withColumn("end", F.coalesce("_next", F.col("start") + F.coalesce(gap, F.lit(cap))))
    return out.select("recording", "page", "start", "end", F.least(F.col("end") - F.col("start"), F.lit(cap)).alias("duration"))


def change_points(timeline: DataFrame, *, ignore: str = "silence") -> DataFrame:
    """Times at which the label differs from the one before, without the ignored label."""
    w = Window.partitionBy("recording").orderBy("time", "id")
    said = timeline.where(F.col("label") != ignore).withColumn("from_label", F.lag("label").over(w))
    return said.where("from_label <> label").select("recording", "time", "from_label", F.col("label").alias("to_label"))


def sustained_changes(timeline: DataFrame, *, hold: int = 2, ignore: str = "silence") -> DataFrame:
    """Changes whose new label holds (or is silence) for the next ``hold`` points, against the label last accepted.

    The first label that isn't silence starts the sequence. After any point that holds, its label is the accepted one, whether it was a
    change or not; so what a point is compared with is the point before it that holds, or the recording's first.
    """
    w = Window.partitionBy("recording").orderBy("time", "id")
    held = F.lit(True)
    for i in range(1, hold + 1):
        nxt = F.lead("label", i).over(w)
        held = held & F.coalesce((nxt == F.col("label")) | (nxt == ignore), F.lit(False))
    flagged = timeline.withColumn("held", held).where(F.col("label") != ignore)
    flagged = flagged.withColumn("first", F.row_number().over(w) == 1).where("held or first")
    changed = flagged.withColumn("from_label", F.lag("label").over(w)).where("from_label <> label")
    return changed.select("recording", "time", "from_label", F.col("label").alias("to_label"))


def greedy_apart(points: DataFrame, *, min_gap: float, slices: int | None = None) -> DataFrame:
    """Of ordered points (``recording, timestamp``) those at least ``min_gap`` after the last kept one; of equal times the first kept.

    Each point's successor is the first point from ``min_gap`` later on; the kept ones are the chain of a recording's first point.
    Points without a time are not kept.
    """
    if min_gap <= 0:
        raise ValueError("min_gap must be above 0")
    others = [c for c in points.columns if c not in ("recording", "timestamp")]
    p = placed(points.where("timestamp is not null"), "recording", ["timestamp", *others], slices=slices)
    here = p.select("recording", F.col("timestamp").alias("_t"), F.lit(1).alias("_kind"), F.col("_at").alias("_id"))
    asked = p.select("recording", (F.col("timestamp") + min_gap).alias("_t"), F.lit(0).alias("_kind"), F.col("_at").alias("_id"))
    both = placed(here.unionByName(asked), "recording", ["_t", "_kind", "_id"], slices=slices)
    nexts = carry(both, "recording", F.when(F.col("_kind") == 1, F.col("_id")), "next", backward=True)
    links = nexts.where("_kind = 0").select(F.col("_id").alias("at"), F.when(F.col("next") > F.col("_id"), F.col("next")).alias("next"))
    heads = p.groupBy("recording").agg(F.min("_at").alias("at")).select("at", F.lit(True).alias("head"))
    kept = reached(links.join(heads, "at", "left").withColumn("head", F.coalesce("head", F.lit(False))))
    return p.join(kept.withColumnRenamed("at", "_at"), "_at", "left_semi").select(points.columns)


def energy_dips(envelope: DataFrame, *, theta: float = 0.001, drop: float = 0.5, min_gap: float = 3) -> DataFrame:
    """Dips (loud five before, now under half, rising five later) and falls (loud average before, now quiet), thinned by ``min_gap``."""
    return greedy_apart(dip_candidates(envelope, theta=theta, drop=drop), min_gap=min_gap)


def dip_candidates(envelope: DataFrame, *, theta: float = 0.001, drop: float = 0.5) -> DataFrame:
    w = Window.partitionBy("recording").orderBy("timestamp")
    e = envelope.withColumn("before", F.lag("rms", 5).over(w)).withColumn("after", F.lead("rms", 5).over(w)).withColumn("avg", F.avg("rms").over(w.rowsBetween(-5, -1)))
    dip = (F.col("before") > theta) & (F.col("rms") < drop * F.col("before")) & (F.col("after") > 1.2 * F.col("rms"))
    fall = (F.col("avg") > theta) & (F.col("rms") < theta)
    kind = F.when(dip, "dip").when(fall, "fall")
    return e.withColumn("type", kind).where("type is not null").select("recording", "timestamp", "type", "before", F.col("rms").alias("at"), "after")


def smooth(frames: DataFrame, *, alpha: float | None = None, last_n: int | None = None, slices: int | None = None) -> DataFrame:
    """``value`` as a mean of the last frames, or as an exponential average over a recording's ordered values (no nulls)."""
    if last_n:
        w = Window.partitionBy("recording").orderBy("t", "id").rowsBetween(-(last_n - 1), 0)
        return frames.withColumn("smooth", F.avg("value").over(w))

    return exponential(frames, "recording", ["t", "id"], "value", "smooth", alpha=alpha, slices=slices).select("recording", "id", "smooth")


def vote_last(preds: DataFrame) -> DataFrame:
    """The majority of the last three predictions; without one, the first of the window."""
    w = Window.partitionBy("recording").orderBy("t", "id")
    a, b = F.lag("page", 2).over(w), F.lag("page", 1).over(w)
    p = F.col("page")
    return preds.withColumn("voted_page", F.when(b == p, p).when(a == p, p).otherwise(F.coalesce(a, b, p)))


def interpolate_page_times(transitions: DataFrame, *, n_pages: int) -> DataFrame:
    """Transitions spread over pages 2 to ``n_pages``; pages between known ones by line, later ones by average time a page.

    ``transitions``: recording, timestamp. Page 1 starts at 0; of transitions on one page the first counts.
    """
    w = Window.partitionBy("recording")
    t = transitions.withColumn("i", F.row_number().over(w.orderBy("timestamp")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    known = t.select("recording", F.round(2 + F.col("i") * (n_pages - 1) / F.col("n")).cast("int").alias("page"), "timestamp").where(F.col("page") <= n_pages).groupBy("recording", "page").agg(F.min("timestamp").alias("known"))
    grid = t.select("recording").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(n_pages))))
    g = grid.join(known, ["recording", "page"], "left").withColumn("known", F.when(F.col("page") == 1, F.lit(0.0)).otherwise(F.col("known")))
    mark = F.when(F.col("known").isNotNull(), F.struct("page", "known"))
    o = w.orderBy("page")
    g = g.withColumn("p", F.last(mark, True).over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q", F.first(mark, True).over(o.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("p.known") + (F.col("q.known") - F.col("p.known")) * (F.col("page") - F.col("p.page")) / (F.col("q.page") - F.col("p.page"))
    later = F.col("p.known") / F.col("p.page") * F.col("page")
    stamp = F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("q").isNotNull(), between).otherwise(later)
    kind = F.when(F.col("page") == 1, "start").when(F.col("known").isNotNull(), "detected").when(F.col("q").isNotNull(), "interpolated").otherwise("extrapolated")
    return g.select("recording", F.col("page").alias("pageNumber"), stamp.alias("timestamp"), kind.alias("source"))


def trigger_rules(page_words: DataFrame, *, k: int = 5) -> DataFrame:
    """For each page the first words and speaker of the next one (``book, page, words, speaker``)."""
    w = Window.partitionBy("book").orderBy("page")
    out = page_words.withColumn("next_page", F.lead("page").over(w)).withColumn("trigger_words", F.slice(F.lead("words").over(w), 1, k)).withColumn("trigger_speaker", F.lead("speaker").over(w))
    return out.where("next_page is not null").select("book", F.col("page").alias("current_page"), "next_page", "trigger_words", "trigger_speaker", F.coalesce(F.col("trigger_speaker") != F.col("speaker"), F.lit(False)).alias("speaker_changes"))


def canonical_timeline(markers: DataFrame, *, hop_ms: int = 100, tail_ms: int = 10_000, slices: int | None = None) -> DataFrame:
    """Frames of each recording: page as of the frame, the nearest marker's value faded by exp(-d/2000), and boundary frames.

    Every marker spreads its own frames up to the next one, which a scan in slices finds; of equal times the smaller page goes first.
    """
    m = placed(markers.select("recording", "timestamp_ms", "page", "value"), "recording", ["timestamp_ms", "page", "value"], slices=slices)
    m = carry(m, "recording", F.struct("timestamp_ms", "value"), "_next", backward=True, inclusive=False)
    m = m.withColumn("_nt", F.col("_next.timestamp_ms")).withColumn("_nv", F.col("_next.value"))
    first, last = F.ceil(F.col("timestamp_ms") / hop_ms), F.ceil(F.coalesce(F.col("_nt"), F.col("timestamp_ms") + tail_ms) / hop_ms) - 1
    f = m.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last))).withColumn("ms", F.col("frame") * hop_ms)
    dp, dn = F.col("ms") - F.col("timestamp_ms"), F.col("_nt") - F.col("ms")
    late = F.coalesce(dn < dp, F.lit(False))
    dist = F.when(late, dn).otherwise(dp)
    return f.select("recording", "frame", F.col("ms").alias("timestamp_ms"), F.col("page").alias("page_number"), (F.when(late, F.col("_nv")).otherwise(F.col("value")) * F.exp(-dist / 2000)).alias("value"), (F.col("frame") == first).alias("is_boundary"))


def speech_segments(frames: DataFrame, *, theta: float = 0.001, shortest: float = 0.1, longest: float = 5.0) -> DataFrame:
    """Runs of speech of 0.1 to 5 s: one starts at a loud frame and ends where two of the next three frames are silent.

    ``frames``: recording, time, energy. The end is a native window; runs are islands between ends.
    """
    w = Window.partitionBy("recording").orderBy("time")
    quiet = F.sum(F.when(F.col("energy") <= theta, 1).otherwise(0)).over(w.rowsBetween(0, 2))
    f = frames.withColumn("ends", (F.col("energy") <= theta) & (quiet >= 2)).withColumn("block", F.sum(F.col("ends").cast("int")).over(w))
    loud = f.where("energy > {}".format(theta))
    out = loud.groupBy("recording", "block").agg(F.min("time").alias("start"), F.max("time").alias("end")).withColumn("duration", F.col("end") - F.col("start"))
    return out.where(F.col("duration").between(shortest, longest)).select("recording", "start", "end", "duration")


def assign_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segment i of n gets word floor(i / n * m) of the recording's m words (``recording, pos, word``)."""
    w = Window.partitionBy("recording")
    s = segments.withColumn("i", F.row_number().over(w.orderBy("start")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    x = words.withColumn("m", F.count(F.lit(1)).over(w)).withColumn("j", F.row_number().over(w.orderBy("pos")) - 1)
    m = x.select("recording", "m").distinct()
    s = s.join(m, "recording").withColumn("j", F.floor(F.col("i") * F.col("m") / F.col("n")).cast("int"))
    return s.join(x.select("recording", "j", F.col("word").alias("likely_word")), ["recording", "j"]).select("recording", "start", "likely_word")


def estimate_page_times(pages: DataFrame, *, total_sec: float) -> DataFrame:
    """Pages in order, each with an equal share of the time."""
    w = Window.partitionBy("book")
    p = pages.withColumn("i", F.row_number().over(w.orderBy("page")) - 1).withColumn("each", total_sec / F.count(F.lit(1)).over(w))
    return p.select("book", "page", (F.col("i") * F.col("each")).alias("start"), ((F.col("i") + 1) * F.col("each")).alias("end"))
