"""Queries of the reports over events (score log), documents and embeddings."""

from __future__ import annotations


from pyspark.sql import functions as F

from pagetrail.operators import reports as R

from .registry import query
from .tables import LOG, TOK, VEC, entries, sections, tokens, vectors

_R = lambda df, n, *cols: df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


def _signed(x, n):
    """``x`` rounded, with its sign where it becomes zero, as in SQL."""
    return F.signum(x) * F.round(F.abs(x), n)


@query(f"""WITH {LOG}, p AS (SELECT session_id, page, max(score) AS hi, count(*) FILTER (triggered) AS tn FROM log GROUP BY ALL), q AS (SELECT session_id, count(*) FILTER (hi < 0.5) AS never_matched, count(*) FILTER (hi > 0.95 AND tn = 0) AS overconfident FROM p GROUP BY session_id),
    s AS (SELECT session_id, avg(score) AS a, avg(score) FILTER (triggered) AS b, avg(score) FILTER (NOT triggered) AS c, max(score) AS max_score, min(score) AS min_score FROM log GROUP BY session_id)
    SELECT session_id, round(a + 1e-9, 5) AS avg_all, round(b + 1e-9, 5) AS avg_triggered, round(c + 1e-9, 5) AS avg_not_triggered, max_score, min_score, never_matched, overconfident, CASE WHEN never_matched > 5 THEN 'retrain missing pages' WHEN a > 0.85 THEN 'raise the threshold' WHEN a < 0.425 THEN 'lower the threshold' ELSE 'keep' END AS recommendation FROM s JOIN q USING (session_id)""")
def d7_summarize_sessions(spark, d):
    out = R.summarize_sessions(entries(spark, d))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("avg_all", "avg_triggered", "avg_not_triggered")})


@query(f"""WITH {LOG}, p AS (SELECT session_id, page, avg(score) AS a, count(*) AS attempts, count(*) FILTER (triggered) AS triggered, count(DISTINCT speaker) AS speakers FROM log GROUP BY ALL)
    SELECT session_id, page, round(a, 5) AS avg_score, attempts, triggered, speakers, CASE WHEN a < 0.5 OR (attempts > 2 AND triggered = 0) THEN 'weak' WHEN a > 0.8 THEN 'strong' ELSE 'fair' END AS grade FROM p""")
def d8_weak_strong_pages(spark, d):
    return _R(R.weak_strong_pages(entries(spark, d)), 5, "avg_score")


@query(f"""WITH {LOG}, m AS (SELECT session_id, CASE WHEN speaker = 'error' THEN 'microphone' WHEN triggered THEN 'ok' WHEN score < 0.3 THEN 'no_match' WHEN score < 0.6 THEN 'low_confidence' ELSE 'threshold_not_met' END AS mode FROM log)
    SELECT session_id, mode, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY session_id), 4)::DOUBLE AS pct FROM m GROUP BY session_id, mode""")
def d9_failure_modes(spark, d):
    e = entries(spark, d).withColumn("failure_mode", F.when(F.col("speaker") == "error", "microphone"))
    return _R(R.failure_modes(e), 4, "pct")


@query(f"WITH {LOG} SELECT speaker, count(*) AS chunks, count(*) FILTER (triggered) AS triggers, round(avg(score), 5) AS avg_score, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM log GROUP BY speaker")
def d10_speaker_stats(spark, d):
    return _R(_R(R.speaker_stats(entries(spark, d)), 5, "avg_score"), 6, "share")


_PRED = f"{LOG}, pr AS (SELECT page AS actual, page + (event_id % 7 - 3)::INT AS predicted, score AS confidence, value AS time_diff FROM log)"


def _pred(spark, d):
    return entries(spark, d).select(F.col("page").alias("actual"), (F.col("page") + F.col("event_id") % 7 - 3).cast("int").alias("predicted"), F.col("score").alias("confidence"), F.col("value").alias("time_diff"))


@query(f"WITH {_PRED} SELECT count(*) AS tested, count(*) FILTER (actual = predicted) AS exact, count(*) FILTER (abs(actual - predicted) <= 2) AS within2, count(*) FILTER (abs(actual - predicted) <= 5) AS within5, round(avg(abs(actual - predicted)), 6) AS avg_error FROM pr")
def d11_accuracy_report(spark, d):
    return _R(R.accuracy_report(_pred(spark, d)), 6, "avg_error")


@query(f"WITH {_PRED} SELECT actual, predicted, count(*) AS count FROM pr WHERE actual <> predicted GROUP BY ALL")
def d11_confusion_pairs(spark, d):
    return R.confusion_pairs(_pred(spark, d))


@query(f"""WITH {_PRED}, x AS (SELECT *, abs(actual - predicted) AS e FROM pr) SELECT CASE WHEN e = 0 THEN 'correct' WHEN e <= 2 THEN 'close' ELSE 'wrong' END AS bucket, count(*) AS count, round(avg(confidence), 5) AS avg_confidence,
    count(*) FILTER (confidence > 0.8 AND e > 0) AS sure_wrong, count(*) FILTER (confidence < 0.6 AND e = 0) AS unsure_right FROM x GROUP BY 1""")
def d12_calibration_report(spark, d):
    return _R(R.calibration_report(_pred(spark, d)), 5, "avg_confidence")


@query(f"""WITH {_PRED}, x AS (SELECT *, abs(actual - predicted) AS e FROM pr WHERE actual <> predicted) SELECT CASE WHEN time_diff > 25 THEN 'timing' WHEN confidence < 0.7 AND e <= 2 THEN 'low confidence, near' WHEN e = 1 THEN 'off by one' ELSE 'other' END AS type, count(*) AS count FROM x GROUP BY 1""")
def d12_error_types(spark, d):
    return R.error_types(_pred(spark, d))


@query(f"""WITH {LOG}, r AS (SELECT speaker, value, row_number() OVER (PARTITION BY speaker ORDER BY value) AS n, count(*) OVER (PARTITION BY speaker) AS c FROM log)
    SELECT speaker, min(value) AS min, max(value) AS max, round(avg(value), 5) AS avg, {', '.join(f'max(value) FILTER (n = floor(c * {p}) + 1) AS p{round(p * 100)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM r GROUP BY speaker""")
def d13_floor_percentiles(spark, d):
    return _R(R.floor_percentiles(entries(spark, d), "value", by=("speaker",)), 5, "avg")


@query(f"WITH {LOG} SELECT CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS bin, count(*) AS count FROM log GROUP BY 1")
def d13_histogram(spark, d):
    return R.histogram(entries(spark, d), "value", [10, 50, 100])


@query(f"""WITH {LOG}, l AS (SELECT session_id AS id, score, coalesce(lag(score) OVER (PARTITION BY session_id ORDER BY page, score DESC) >= score, true) AS f FROM log)
    SELECT id, max(score) AS max, min(score) AS min, round(avg(score), 5) AS avg, {', '.join(f'count(*) FILTER (score >= {x / 100}) AS n{x}' for x in (90, 80, 70, 60, 50))}, bool_and(f) AS monotone FROM l GROUP BY id""")
def d14_score_spread(spark, d):
    return _R(R.score_spread(entries(spark, d).select(F.col("session_id").alias("id"), F.col("page").alias("distance"), "score")), 5, "avg")


_AVG = f"{VEC}, ex AS (SELECT page, unnest(v) AS x, unnest(range(64)) AS i, id FROM vec), av AS (SELECT page, i, avg(x) AS x FROM ex GROUP BY ALL)"


@query(f"WITH {_AVG}, s AS (SELECT page, count(*) AS n, round(avg(CASE WHEN id % 3 <> 0 THEN id % 3 END), 5) AS k FROM vec GROUP BY page) SELECT page, list(round(x, 5) ORDER BY i) AS v, n, k FROM av JOIN s USING (page) GROUP BY page, n, k")
def d15_average_vectors(spark, d):
    out = R.average_vectors(vectors(spark, d).withColumn("k", F.col("id") % 3), ["page"], vec="v", scalars=("k",))
    return out.select("page", F.transform("v", lambda x: _signed(x, 5)).alias("v"), "n", F.round("k", 5).alias("k"))


@query(f"""WITH {_AVG}, c AS (SELECT page, round(least(1.2 * avg(id % 10 / 10), 0.95), 5)::DOUBLE AS confidence, list_sort(list(DISTINCT 's' || id % 4)) AS learned_from FROM vec GROUP BY page)
    SELECT 'w' || page AS word, list(round(x, 5) ORDER BY i) AS signature, confidence, learned_from FROM av JOIN c USING (page) GROUP BY ALL""")
def d16_merge_by_word(spark, d):
    p = vectors(spark, d).select(F.concat(F.lit("w"), F.col("page").cast("string")).alias("word"), F.col("v").alias("signature"), (F.col("id") % 10 / 10).alias("confidence"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    out = R.merge_by_word(p)
    return out.select("word", F.transform("signature", lambda x: _signed(x, 5)).alias("signature"), F.round("confidence", 5).alias("confidence"), "learned_from")


@query()
def d17_fold_patterns(spark, d):
    v = vectors(spark, d)
    text = lambda c: c.cast("string")
    context = F.array(F.struct(text(F.col("id") % 3).alias("before"), text(F.col("id") % 2).alias("after")))
    p = v.select(F.concat(F.lit("w"), text(F.col("page"))).alias("word"), F.col("id").alias("ord"), F.when(F.col("id") % 7 > 0, F.col("v")).alias("v"), (F.col("id") % 9 / 10).alias("duration"), text(F.col("id") % 2).alias("phonemes"),
                 (F.col("id") % 10 / 10).alias("confidence"), F.lit(1).cast("long").alias("frequency"), context.alias("contexts"), F.array(F.concat(F.lit("s"), text(F.col("id") % 4))).alias("learned_from"))
    return R.fold_patterns(p.where("ord % 5 = 0"), p.where("ord % 5 <> 0"), threshold=0.3)


@query(f"WITH {VEC} SELECT count(*) AS total, count(DISTINCT page) AS unique_words, sum(id % 7)::BIGINT AS total_frequency, round(avg(id % 10 / 10), 5) AS avg_confidence FROM vec")
def d17_pattern_stats(spark, d):
    v = vectors(spark, d).select(F.col("page").alias("word"), (F.col("id") % 7).alias("frequency"), (F.col("id") % 10 / 10).alias("confidence"))
    return _R(R.pattern_stats(v), 5, "avg_confidence")


@query(f"""WITH {LOG}, b AS (SELECT session_id, speaker, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM log GROUP BY ALL) SELECT speaker, sum(n)::BIGINT AS n, round(avg(m), 4) AS value_mean, round(avg(v), 3) AS value_var FROM b GROUP BY speaker""")
def d18_speaker_profiles(spark, d):
    return _R(_R(R.speaker_profiles(entries(spark, d).withColumnRenamed("session_id", "recording"), ["value"]), 4, "value_mean"), 3, "value_var")


_STEP = f"{LOG}, st AS (SELECT page AS from_page, lead(page) OVER w AS to_page, lead(t) OVER w - t AS dw FROM log WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)), ed AS (SELECT from_page, to_page, count(*) AS count FROM st WHERE to_page IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_STEP} SELECT from_page, to_page, count, round(count / sum(count) OVER (PARTITION BY from_page), 6)::DOUBLE AS prob FROM ed")
def d19_transition_counts(spark, d):
    return _R(R.transition_counts(entries(spark, d)), 6, "prob")


@query(f"WITH {_STEP}, b AS (SELECT from_page, to_page, row_number() OVER (PARTITION BY from_page ORDER BY count DESC, to_page) AS n FROM ed) SELECT page, coalesce(to_page, page + 1)::INT AS next_page FROM (SELECT DISTINCT page FROM log) LEFT JOIN b ON from_page = page AND n = 1")
def d19_most_likely_next(spark, d):
    e = entries(spark, d)
    return R.most_likely_next(R.transition_counts(e), e)


@query(f"WITH {_STEP} SELECT from_page AS page, round(avg(dw), 3) AS avg_dwell FROM st WHERE dw IS NOT NULL GROUP BY from_page")
def d19_dwell_times(spark, d):
    return _R(R.dwell_times(entries(spark, d)), 3, "avg_dwell")


@query(f"WITH {LOG}, g AS (SELECT session_id AS recording, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, page) AS gap FROM log) SELECT recording, round(avg(gap), 3) AS avg, round(min(gap), 3) AS min, round(max(gap), 3) AS max FROM g WHERE gap > 0 AND gap < 50000 GROUP BY recording")
def d20_page_durations(spark, d):
    return _R(R.page_durations(entries(spark, d).withColumnRenamed("session_id", "recording"), max_gap=50000), 3, "avg", "min", "max")


_CAL = f"{VEC}, pr AS (SELECT a.v AS phone, b.v AS mic FROM vec a JOIN vec b ON b.id = a.id + 1 WHERE a.id % 2 = 0), z AS (SELECT unnest(phone) AS p, unnest(mic) AS m, unnest(range(64)) AS i FROM pr), cal AS (SELECT i, avg(m - p) AS offset_, (1 + sum(CASE WHEN abs(p) > 0.001 THEN m / p ELSE 0 END)) / count(*) AS scale FROM z GROUP BY i)"


def _device(spark, d):
    v = vectors(spark, d)
    return v.where("id % 2 = 0").select("id", F.col("v").alias("phone")).join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("mic")), "id")


@query(f"WITH {_CAL} SELECT i::INT AS i, round(offset_, 6) AS off, round(scale, 4) AS scale FROM cal")
def d21_calibrate(spark, d):
    return R.calibrate(_device(spark, d)).select("i", F.round("offset", 6).alias("off"), F.round("scale", 4).alias("scale"))


@query(f"WITH {_CAL}, f AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM vec) SELECT id, round(sum((x + offset_) * scale), 3) AS total FROM f JOIN cal USING (i) GROUP BY id")
def d21_apply_calibration(spark, d):
    out = R.apply_calibration(vectors(spark, d), R.calibrate(_device(spark, d)))
    return out.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(f"""WITH {LOG}, a AS (SELECT avg(value) AS m, min(value) AS lo, max(value) AS hi FROM log WHERE speaker = 'click'), b AS (SELECT avg(value) AS m, min(value) AS lo, max(value) AS hi FROM log WHERE speaker = 'view')
    SELECT 'value' AS feature, round(b.m - a.m, 5) AS shift, round(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)), 6) AS overlap, abs(b.m - a.m) > 0.5 AS flag FROM a, b""")
def d22_source_drift(spark, d):
    e = entries(spark, d)
    return _R(_R(R.source_drift(e.where("speaker = 'click'"), e.where("speaker = 'view'"), feature="value", flag_at=0.5), 5, "shift"), 6, "overlap")


@query(f"""WITH {TOK}, t AS (SELECT * FROM tok), h AS (SELECT count(*) AS c FROM (SELECT word FROM t GROUP BY word HAVING count(DISTINCT page) > 3)), x AS (SELECT 40 * least(1.0, count(DISTINCT page) / 183) AS a, 30 * least(1.0, count(*) / count(DISTINCT page) / 20) AS b, 10.0 AS e FROM t)
    SELECT a AS coverage, b AS density, greatest(0, 20 - c)::DOUBLE AS keywords, e::DOUBLE AS completeness, round(a + b + greatest(0, 20 - c) + e, 5)::DOUBLE AS score FROM x, h""")
def d23_dictionary_score(spark, d):
    return _R(R.dictionary_score(tokens(spark, d), n_pages=183), 5, "score")


_GATE = f"{LOG}, p AS (SELECT session_id, page, max(score) AS hi FROM log GROUP BY ALL), m AS (SELECT session_id, count(*) FILTER (hi < 0.5) AS missed FROM p GROUP BY session_id), s AS (SELECT session_id, max(t) AS ts, avg(score) AS avg FROM log GROUP BY session_id), g AS (SELECT * FROM s JOIN m USING (session_id))"


@query(f"""WITH {_GATE}, n AS (SELECT * FROM g WHERE session_id % 2 = 0 ORDER BY ts DESC, session_id DESC LIMIT 1), b AS (SELECT * FROM g WHERE session_id % 2 = 1 ORDER BY ts DESC, session_id DESC LIMIT 1)
    SELECT round(b.avg, 6) AS base_avg, round(n.avg, 6) AS new_avg, b.missed AS base_missed, n.missed AS new_missed, n.avg >= b.avg * 0.95 AND n.missed <= b.missed AS accepted FROM n, b""")
def d24_regression_gate(spark, d):
    e = entries(spark, d)
    missed = e.groupBy("session_id", "page").agg(F.max("score").alias("hi")).groupBy("session_id").agg(F.count_if(F.col("hi") < 0.5).alias("missed"))
    s = e.groupBy("session_id").agg(F.max("t").alias("ts"), F.avg("score").alias("avg")).join(missed, "session_id")
    return _R(R.regression_gate(s.where("session_id % 2 = 0"), s.where("session_id % 2 = 1")), 6, "base_avg", "new_avg")


@query(r"""WITH s AS (SELECT lang, length(trim(text)) AS n, text FROM documents), w AS (SELECT lang, count(DISTINCT x) AS unique_words FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS x FROM documents) GROUP BY lang)
    SELECT s.lang, count(*) FILTER (n > 10) AS pages, round(count(*) FILTER (n > 10) / count(*), 6) AS pct, round(avg(n) FILTER (n > 10), 4) AS avg_chars, count(*) FILTER (n <= 10) AS empty_pages, any_value(unique_words) AS unique_words FROM s JOIN w ON w.lang = s.lang GROUP BY s.lang""")
def d25_text_coverage(spark, d):
    return _R(_R(R.text_coverage(sections(spark, d)), 6, "pct"), 4, "avg_chars")


@query(f"WITH {LOG} SELECT session_id, count(*) AS count, min(page) AS min_page, max(page) AS max_page, list_sort(list(DISTINCT page))[1:10] AS pages FROM log GROUP BY session_id")
def d26_session_overview(spark, d):
    return R.session_overview(entries(spark, d))


@query(f"WITH {LOG}, p AS (SELECT session_id, page, count(DISTINCT speaker) AS s FROM log GROUP BY ALL) SELECT session_id AS word, count(*) AS pages, round(avg(s), 6) AS avg_sources FROM p GROUP BY session_id HAVING count(*) >= 2")
def d27_cross_source_words(spark, d):
    return _R(R.cross_source_words(entries(spark, d).select(F.col("session_id").alias("word"), "page", F.col("speaker").alias("source"))), 6, "avg_sources")


@query(f"WITH {LOG}, a AS (SELECT page, max(value) AS v FROM log WHERE speaker = 'click' GROUP BY page), b AS (SELECT page, max(value) AS v FROM log WHERE speaker = 'view' GROUP BY page) SELECT page, round(abs(a.v - b.v), 5) AS difference FROM a JOIN b USING (page)")
def d27_source_difference(spark, d):
    fps = entries(spark, d).groupBy("page", F.col("speaker").alias("source")).agg(F.max("value").alias("value"))
    return _R(R.source_difference(fps, "click", "view"), 5, "difference")


@query(f"WITH {LOG} SELECT least(9, floor(value / 10))::INT AS bucket, count(*) AS count FROM log GROUP BY 1")
def d28_time_histogram(spark, d):
    return R.time_histogram(entries(spark, d), "value", buckets=10, total=100.0)


@query(f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, event_id DESC) AS n, max(t) OVER () AS now FROM log)
    SELECT session_id, count(*) AS chunks, sum(page)::BIGINT AS samples, round(max(t) - min(t), 3) AS duration, round(avg(page) FILTER (n <= 10), 4) AS avg_last10, max(t) > 1706659200 - 5 AS receiving FROM r GROUP BY session_id""")
def d29_chunk_diagnostics(spark, d):
    out = R.chunk_diagnostics(entries(spark, d).withColumn("samples", F.col("page")), now=F.lit(1706659200.0))
    return _R(_R(out, 3, "duration"), 4, "avg_last10")


