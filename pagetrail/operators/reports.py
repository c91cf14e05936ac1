"""Reports on score logs, predictions, signals and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarize_sessions(entries: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """A row a session: averages of all, triggered and other scores, extremes, pages never matched (best under 0.5), overconfident pages
    (best over 0.95, never triggered), and a recommendation. Pages are summed up first, then sessions."""
    pages = entries.groupBy("session_id", "page").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("triggered"), F.col("score")).otherwise(0.0)).alias("ts"), F.count_if("triggered").alias("tn"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    out = pages.groupBy("session_id").agg(
        (F.sum("s") / F.sum("n")).alias("avg_all"),
        F.when(F.sum("tn") > 0, F.sum("ts") / F.sum("tn")).alias("avg_triggered"),
        F.when(F.sum(F.col("n") - F.col("tn")) > 0, F.sum(F.col("s") - F.col("ts")) / F.sum(F.col("n") - F.col("tn"))).alias("avg_not_triggered"),
        F.max("hi").alias("max_score"), F.min("lo").alias("min_score"),
        F.count_if(F.col("hi") < 0.5).alias("never_matched"), F.count_if((F.col("hi") > 0.95) & (F.col("tn") == 0)).alias("overconfident"))
    tip = F.when(F.col("never_matched") > 5, "retrain missing pages").when(F.col("avg_all") > threshold, "raise the threshold").when(F.col("avg_all") < threshold / 2, "lower the threshold").otherwise("keep")
    return out.withColumn("recommendation", tip)


def weak_strong_pages(entries: DataFrame) -> DataFrame:
    out = entries.groupBy("session_id", "page").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("attempts"), F.count_if("triggered").alias("triggered"), F.countDistinct("speaker").alias("speakers"))
    weak = (F.col("avg_score") < 0.5) | ((F.col("attempts") > 2) & (F.col("triggered") == 0))
    return out.withColumn("grade", F.when(weak, "weak").when(F.col("avg_score") > 0.8, "strong").otherwise("fair"))


def failure_modes(entries: DataFrame) -> DataFrame:
    """Counts and shares of failure modes; a missing one follows from the trigger and the score."""
    mode = F.coalesce("failure_mode", F.when(F.col("triggered"), "ok").when(F.col("score") < 0.3, "no_match").when(F.col("score") < 0.6, "low_confidence").otherwise("threshold_not_met"))
    out = entries.groupBy("session_id", mode.alias("mode")).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("pct", 100 * F.col("count") / F.sum("count").over(Window.partitionBy("session_id")))


def speaker_stats(entries: DataFrame) -> DataFrame:
    out = entries.groupBy("speaker").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("triggered").alias("triggers"), F.avg("score").alias("avg_score"))
    return out.withColumn("share", F.col("chunks") / F.sum("chunks").over(Window.partitionBy()))


def accuracy_report(pred: DataFrame) -> DataFrame:
    """Tested, exact, within 2 and 5 pages, and average error of ``actual, predicted``."""
    e = F.abs(F.col("actual") - F.col("predicted"))
    return pred.agg(F.count(F.lit(1)).alias("tested"), F.count_if(e == 0).alias("exact"), F.count_if(e <= 2).alias("within2"), F.count_if(e <= 5).alias("within5"), F.avg(e).alias("avg_error"))


def confusion_pairs(pred: DataFrame) -> DataFrame:
    return pred.where("actual <> predicted").groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))


def calibration_report(results: DataFrame) -> DataFrame:
    """Average confidence and counts by how far off results are, with the sure wrong and the unsure right ones."""
    e = F.abs(F.col("actual") - F.col("predicted"))
    bucket = F.when(e == 0, "correct").when(e <= 2, "close").otherwise("wrong")
    return results.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"), F.count_if((F.col("confidence") > 0.8) & (e > 0)).alias("sure_wrong"), F.count_if((F.col("confidence") < 0.6) & (e == 0)).alias("unsure_right"))


def error_types(results: DataFrame) -> DataFrame:
    e = F.abs(F.col("actual") - F.col("predicted"))
    kind = F.when(F.col("time_diff") > 25, "timing").when((F.col("confidence") < 0.7) & (e <= 2), "low confidence, near").when(e == 1, "off by one").otherwise("other")
    return results.where("actual <> predicted").groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("count"))


def floor_percentiles(df: DataFrame, col: str, *, by: tuple[str, ...] = (), ps: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact order statistics at place floor(n * p) of each group, with min, max and mean. Groups rank by a window; without groups the
    values are counted first, so that only distinct values are ranked."""
    part = Window.partitionBy(*by)
    counted = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(part.orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    r = counted.withColumn("_hi", upto).withColumn("_n", F.sum("_k").over(part))
    at = lambda p: F.min(F.when(F.col("_hi") > F.floor(F.col("_n") * p), F.col(col))).alias(f"p{round(p * 100)}")
    return r.groupBy(*by).agg(F.min(col).alias("min"), F.max(col).alias("max"), (F.sum(F.col(col) * F.col("_k")) / F.sum("_k")).alias("avg"), *[at(p) for p in ps])


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    bin_ = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        bin_ = F.when(F.col(col) < edges[i], i).otherwise(bin_)
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def score_spread(scores: DataFrame) -> DataFrame:
    """Per ``id``: extremes, mean, counts from 0.9 to 0.5, and whether scores never rise with ``distance``."""
    w = Window.partitionBy("id").orderBy("distance", F.desc("score"))
    s = scores.withColumn("_falls", F.coalesce(F.lag("score").over(w) >= F.col("score"), F.lit(True)))
    return s.groupBy("id").agg(F.max("score").alias("max"), F.min("score").alias("min"), F.avg("score").alias("avg"), *[F.count_if(F.col("score") >= x / 100).alias(f"n{x}") for x in (90, 80, 70, 60, 50)], F.bool_and("_falls").alias("monotone"))


def average_vectors(df: DataFrame, by: list[str], *, vec: str, scalars: tuple[str, ...] = (), skip_zero: bool = True) -> DataFrame:
    """Element-wise mean vector of each group, in parts that combine before the shuffle, and means of scalars without zeros."""
    mean = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)) if skip_zero else F.col(c)).alias(c)
    flat = df.select(*by, F.posexplode(vec).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_x"))
    v = flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vec))
    return v.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in scalars]), by)


def merge_by_word(patterns: DataFrame) -> DataFrame:
    """Patterns of one word merged: mean signature, confidence min(1.2 * mean, 0.95), sources in order."""
    v = average_vectors(patterns, ["word"], vec="signature")
    c = patterns.groupBy("word").agg(F.least(1.2 * F.avg("confidence"), F.lit(0.95)).alias("confidence"), F.sort_array(F.collect_set("source")).alias("learned_from"))
    return v.drop("n").join(c, "word")


#: Seconds within which durations count as equal where a signature is missing.
NEAR_DURATION = 0.2
FOLDED = "word string, v array<double>, duration double, phonemes string, confidence double, frequency long, contexts array<struct<before:string,after:string>>, learned_from array<string>"


def fold_patterns(store: DataFrame, new: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """New patterns folded into the store in the order of ``ord``: the first of the same word that matches gains frequency, the mean of
    both confidences, the context if it is new, and the source; others are added with frequency 1 and a confidence of 0.5 if they
    bring none.

    Both have ``word, ord, v, duration, phonemes, confidence, frequency, contexts, learned_from``. Signatures match by a cosine over the
    threshold; where one is null, by equal phonemes and durations within 0.2. A word is one group, as folding is serial.
    """
    import numpy as np
    import pandas as pd

    names = [x.split()[0] for x in FOLDED.split(", ")]

    def match(a, b) -> bool:
        if a.v is not None and b.v is not None:
            x, y = np.asarray(a.v), np.asarray(b.v)
            n = np.linalg.norm(x) * np.linalg.norm(y)
            return bool(n) and float(x @ y) / n > threshold
        return a.phonemes == b.phonemes and abs(a.duration - b.duration) < NEAR_DURATION

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in pdf.sort_values(["new", "ord"]).itertuples():
            hit = next((k for k in kept if match(k[0], r)), None) if r.new else None
            contexts, sources = list(r.contexts if r.contexts is not None else ()), list(r.learned_from if r.learned_from is not None else ())
            if hit is None:
                sure = 0.5 if r.new and not r.confidence > 0 else r.confidence
                kept.append((r, {"confidence": sure, "frequency": 1 if r.new else r.frequency, "contexts": contexts, "learned_from": sources}))
                continue
            old = hit[1]
            old["frequency"] += 1
            old["confidence"] = (old["confidence"] + r.confidence) / 2
            old["contexts"] += [c for c in contexts if c not in old["contexts"]]
            old["learned_from"] += sources
        return pd.DataFrame([{"word": r.word, "v": r.v, "duration": r.duration, "phonemes": r.phonemes, **told} for r, told in kept], columns=names)

    both = store.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    return both.groupBy("word").applyInPandas(fold, FOLDED)


def pattern_stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("word").alias("unique_words"), F.sum("frequency").alias("total_frequency"), F.avg("confidence").alias("avg_confidence"))


def speaker_profiles(features: DataFrame, cols: list[str]) -> DataFrame:
    """Means and population variances of features in each recording, averaged over recordings for each speaker."""
    by = features.groupBy("recording", "speaker").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{k}") for c in cols for k, f in (("mean", F.avg), ("var", F.var_pop))])
    return by.groupBy("speaker").agg(F.sum("n").alias("n"), *[F.avg(f"{c}_{k}").alias(f"{c}_{k}") for c in cols for k in ("mean", "var")])


def transition_counts(markers: DataFrame) -> DataFrame:
    """``from_page, to_page, count, prob`` of steps in each session, in time order."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    steps = markers.withColumn("to_page", F.lead("page").over(w)).where("to_page is not null").groupBy(F.col("page").alias("from_page"), "to_page").agg(F.count(F.lit(1)).alias("count"))
    return steps.withColumn("prob", F.col("count") / F.sum("count").over(Window.partitionBy("from_page")))


def most_likely_next(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """The commonest next page of each page, the smaller of equals; the page after it where nothing is known."""
    w = Window.partitionBy("from_page").orderBy(F.desc("count"), "to_page")
    best = edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("from_page").alias("page"), "to_page")
    return pages.select("page").distinct().join(best, "page", "left").select("page", F.coalesce("to_page", F.col("page") + 1).alias("next_page"))


def dwell_times(markers: DataFrame) -> DataFrame:
    """Average time on each page until the next marker of the session."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    return markers.withColumn("_d", F.lead("t").over(w) - F.col("t")).groupBy("page").agg(F.avg("_d").alias("avg_dwell")).where("avg_dwell is not null")


def page_durations(page_times: DataFrame, *, max_gap: float | None = None) -> DataFrame:
    w = Window.partitionBy("recording").orderBy("t", "page")
    gap = page_times.withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap is not null")
    gap = gap.where((F.col("gap") > 0) & (F.col("gap") < max_gap)) if max_gap else gap
    return gap.groupBy("recording").agg(F.avg("gap").alias("avg"), F.min("gap").alias("min"), F.max("gap").alias("max"))


def calibrate(pairs: DataFrame, *, min_pairs: int = 3) -> DataFrame:
    """Offsets and scales of a device from paired pages (``phone, mic`` vectors): mean difference, and 1 plus the sum of ratios (of phone
    values over 0.001) before dividing by the pairs. None with fewer pairs than ``min_pairs``."""
    n = pairs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pairs)
    z = pairs.select(F.posexplode(F.arrays_zip("phone", "mic")).alias("i", "z")).select("i", "z.phone", "z.mic")
    out = z.groupBy("i").agg(F.sum(F.col("mic") - F.col("phone")).alias("d"), F.sum(F.when(F.abs("phone") > 0.001, F.col("mic") / F.col("phone")).otherwise(0.0)).alias("r"))
    return out.join(F.broadcast(n)).select("i", (F.col("d") / F.col("n")).alias("offset"), ((1 + F.col("r")) / F.col("n")).alias("scale"), "n")


def apply_calibration(features: DataFrame, profile: DataFrame, *, vec: str = "v") -> DataFrame:
    p = profile.groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "offset", "scale"))).alias("_p"))
    return features.join(F.broadcast(p)).withColumn(vec, F.zip_with(vec, "_p", lambda x, q: (x + q["offset"]) * q["scale"])).drop("_p")


def source_drift(a: DataFrame, b: DataFrame, *, feature: str, flag_at: float) -> DataFrame:
    """Shift of a feature's mean between two sources, the share of its whole range that both cover, and whether the shift is large."""
    s = lambda df, k: df.agg(F.avg(feature).alias(f"m{k}"), F.min(feature).alias(f"lo{k}"), F.max(feature).alias(f"hi{k}"))
    x = s(a, 1).join(F.broadcast(s(b, 2)))
    both = F.greatest(F.lit(0.0), F.least("hi1", "hi2") - F.greatest("lo1", "lo2"))
    return x.select(F.lit(feature).alias("feature"), (F.col("m2") - F.col("m1")).alias("shift"), (both / (F.greatest("hi1", "hi2") - F.least("lo1", "lo2"))).alias("overlap"), (F.abs(F.col("m2") - F.col("m1")) > flag_at).alias("flag"))


def dictionary_score(entries: DataFrame, *, n_pages: int) -> DataFrame:
    """Coverage of pages (40), words a page against 20 (30), keywords on more than 3 pages (20 less one each), completeness (10)."""
    pages = entries.agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("n"), F.count_if((F.col("word") != "") & (F.col("lang") != "")).alias("full"))
    hot = entries.select("word", "page").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df")).agg(F.count_if(F.col("df") > 3).alias("conflicts"))
    x = pages.join(F.broadcast(hot))
    cover, dense = 40 * F.least(F.lit(1.0), F.col("pages") / n_pages), 30 * F.least(F.lit(1.0), F.col("n") / F.col("pages") / 20)
    keys, full = F.greatest(F.lit(0.0), 20.0 - F.col("conflicts")), 10 * F.col("full") / F.col("n")
    return x.select(cover.alias("coverage"), dense.alias("density"), keys.alias("keywords"), full.alias("completeness"), (cover + dense + keys + full).alias("score"))


def regression_gate(sessions: DataFrame, baseline: DataFrame, *, max_drop: float = 0.05) -> DataFrame:
    """The latest session against the latest baseline row (``ts, avg, missed``): accepted unless the average falls by more than
    ``max_drop`` or more pages are missed."""
    new = sessions.agg(F.max_by(F.struct("avg", "missed"), F.struct("ts", "session_id")).alias("n"))
    base = baseline.agg(F.max_by(F.struct("avg", "missed"), F.struct("ts", "session_id")).alias("b"))
    x = new.join(F.broadcast(base)).select(F.col("b.avg").alias("base_avg"), F.col("n.avg").alias("new_avg"), F.col("b.missed").alias("base_missed"), F.col("n.missed").alias("new_missed"))
    return x.withColumn("accepted", (F.col("new_avg") >= F.col("base_avg") * (1 - max_drop)) & (F.col("new_missed") <= F.col("base_missed")))


def text_coverage(sections: DataFrame, *, least: int = 10) -> DataFrame:
    """Per language: pages with more than ``least`` characters, their share, average length, distinct words, empty pages."""
    s = sections.withColumn("n", F.length(F.trim("text")))
    base = s.groupBy("lang").agg(F.count_if(F.col("n") > least).alias("pages"), (F.count_if(F.col("n") > least) / F.count(F.lit(1))).alias("pct"), F.avg(F.when(F.col("n") > least, F.col("n"))).alias("avg_chars"), F.count_if(F.col("n") <= least).alias("empty_pages"))
    words = s.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("unique_words"))
    return base.join(words, "lang", "left")


def session_overview(markers: DataFrame, *, first: int = 10) -> DataFrame:
    """Markers, extremes and the first distinct pages of each session."""
    return markers.groupBy("session_id").agg(F.count(F.lit(1)).alias("count"), F.min("page").alias("min_page"), F.max("page").alias("max_page"), F.slice(F.sort_array(F.collect_set("page")), 1, first).alias("pages"))


def cross_source_words(words: DataFrame) -> DataFrame:
    """Words on two pages or more, with the mean number of sources a page (``word, page, source``)."""
    per = words.distinct().groupBy("word", "page").agg(F.count(F.lit(1)).alias("s"))
    return per.groupBy("word").agg(F.count(F.lit(1)).alias("pages"), F.avg("s").alias("avg_sources")).where("pages >= 2")


def source_difference(fps: DataFrame, a: str, b: str) -> DataFrame:
    p = fps.where(F.col("source").isin(a, b)).groupBy("page").pivot("source", [a, b]).agg(F.first("value"))
    return p.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("page", F.abs(F.col(a) - F.col(b)).alias("difference"))


def time_histogram(df: DataFrame, col: str, *, buckets: int = 10, total: float) -> DataFrame:
    return df.groupBy(F.least(F.lit(buckets - 1), F.floor(F.col(col) / (total / buckets))).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def chunk_diagnostics(chunks: DataFrame, *, now) -> DataFrame:
    """Per session: chunks, samples, time covered, mean size of the last ten, and whether one came in the last 5 seconds before ``now``."""
    w = Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("event_id"))
    r = chunks.withColumn("_n", F.row_number().over(w))
    return r.groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("samples").alias("samples"), (F.max("t") - F.min("t")).alias("duration"), F.avg(F.when(F.col("_n") <= 10, F.col("samples"))).alias("avg_last10"), (F.max("t") > now - 5).alias("receiving"))
