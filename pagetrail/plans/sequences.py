"""Queries of the sequence operators over events as timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.operators import sequences as Q

from .registry import query
from .tables import LOG, TOK, entries, tokens


def _timeline(spark, d):
    """Events as labelled points; errors are silence."""
    e = entries(spark, d)
    label = F.when(F.col("speaker") == "error", "silence").when(F.col("speaker").isin("view", "signup"), "choir").otherwise("deacon")
    return e.select(F.col("session_id").alias("recording"), F.col("t").alias("time"), F.col("event_id").alias("id"), label.alias("label"))


_TL = f"{LOG}, tl AS (SELECT session_id AS recording, t AS time, event_id AS id, CASE WHEN speaker = 'error' THEN 'silence' WHEN speaker IN ('view', 'signup') THEN 'choir' ELSE 'deacon' END AS label FROM log)"


@query(f"""WITH {LOG}, s AS (SELECT session_id AS recording, page, t AS start, lead(t) OVER (PARTITION BY session_id ORDER BY t, page) AS nx FROM log), g AS (SELECT *, coalesce(nx, start + coalesce(avg(nx - start) OVER (PARTITION BY recording), 20000)) AS e FROM s)
    SELECT recording, page, start, round(e, 3) AS "end", round(least(e - start, 20000), 3)::DOUBLE AS duration FROM g""")
def e1_page_segments(spark, d):
    times = entries(spark, d).select(F.col("session_id").alias("recording"), "page", F.col("t").alias("start"))
    return Q.page_segments(times, cap=20000.0).select("recording", "page", "start", F.round("end", 3).alias("end"), F.round("duration", 3).alias("duration"))


@query(f"WITH {_TL}, c AS (SELECT recording, time, lag(label) OVER (PARTITION BY recording ORDER BY time, id) AS from_label, label AS to_label FROM tl WHERE label <> 'silence') SELECT * FROM c WHERE from_label <> to_label")
def e2_change_points(spark, d):
    return Q.change_points(_timeline(spark, d))


@query(f"""WITH RECURSIVE {_TL}, h AS (SELECT *, lead(label, 1) OVER w AS a, lead(label, 2) OVER w AS b FROM tl WINDOW w AS (PARTITION BY recording ORDER BY time, id)),
    p AS (SELECT recording, time, label, coalesce(a IN (label, 'silence') AND b IN (label, 'silence'), false) AS held, row_number() OVER (PARTITION BY recording ORDER BY time, id) AS n FROM h WHERE label <> 'silence'),
    k AS (SELECT recording, time, label, row_number() OVER (PARTITION BY recording ORDER BY n) AS n FROM p WHERE held OR n = 1), c AS (SELECT recording, time, lag(label) OVER (PARTITION BY recording ORDER BY n) AS from_label, label AS to_label FROM k) SELECT * FROM c WHERE from_label <> to_label""")
def e3_sustained_changes(spark, d):
    return Q.sustained_changes(_timeline(spark, d))


def _envelope(spark, d):
    return entries(spark, d).select(F.col("session_id").alias("recording"), F.col("t").alias("timestamp"), F.col("value").alias("rms"))


_DIPS = f"""{LOG}, e AS (SELECT session_id AS recording, t AS timestamp, value AS rms, lag(value, 5) OVER w AS before, lead(value, 5) OVER w AS after,
    avg(value) OVER (PARTITION BY session_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM log WINDOW w AS (PARTITION BY session_id ORDER BY t)),
    k AS (SELECT *, CASE WHEN before > 20 AND rms < 0.5 * before AND after > 1.2 * rms THEN 'dip' WHEN m > 20 AND rms < 20 THEN 'fall' END AS type FROM e),
    dips AS (SELECT recording, timestamp, type, before, rms AS "at", after FROM k WHERE type IS NOT NULL)"""


@query(f"WITH {_DIPS} SELECT * FROM dips")
def e4_dip_candidates(spark, d):
    return Q.dip_candidates(_envelope(spark, d), theta=20.0)


@query(f"""WITH RECURSIVE {_DIPS}, one AS (SELECT * FROM dips QUALIFY row_number() OVER (PARTITION BY recording, timestamp ORDER BY type, before, "at", after) = 1),
    nx AS MATERIALIZED (SELECT a.recording, a.timestamp, b.timestamp AS nxt FROM one a ASOF JOIN one b ON a.recording = b.recording AND a.timestamp + 36000 <= b.timestamp),
    chain AS (SELECT recording, min(timestamp) AS timestamp FROM one GROUP BY recording UNION ALL SELECT nx.recording, nx.nxt FROM chain JOIN nx USING (recording, timestamp))
    SELECT one.* FROM one JOIN chain USING (recording, timestamp)""")
def e4_energy_dips(spark, d):
    return Q.energy_dips(_envelope(spark, d), theta=20.0, min_gap=36000)


def _frames(spark, d):
    return entries(spark, d).select(F.col("session_id").alias("recording"), "t", F.col("event_id").alias("id"), "value", "page")


@query(f"WITH {LOG} SELECT session_id AS recording, event_id AS id, round(avg(value) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) AS smooth FROM log")
def e5_moving_mean(spark, d):
    return Q.smooth(_frames(spark, d), last_n=10).select("recording", "id", F.round("smooth", 5).alias("smooth"))


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT session_id, event_id, value, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS n FROM log),
    r AS (SELECT session_id, event_id, n, value AS e FROM o WHERE n = 1 UNION ALL SELECT o.session_id, o.event_id, o.n, 0.25 * o.value + 0.75 * r.e FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)
    SELECT session_id AS recording, event_id AS id, round(e + 1e-9, 5)::DOUBLE AS smooth FROM r""")
def e5_exponential_mean(spark, d):
    return Q.smooth(_frames(spark, d), alpha=0.25).select("recording", "id", F.round(F.col("smooth") + 1e-9, 5).alias("smooth"))


@query(f"""WITH {LOG}, p AS (SELECT session_id AS recording, event_id AS id, page // 20 AS p, lag(page // 20, 2) OVER w AS a, lag(page // 20, 1) OVER w AS b FROM log WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))
    SELECT recording, id, (CASE WHEN b = p THEN p WHEN a = p THEN p ELSE coalesce(a, b, p) END)::BIGINT AS voted_page FROM p""")
def e6_vote_last(spark, d):
    f = _frames(spark, d).withColumn("page", F.floor(F.col("page") / 20))
    return Q.vote_last(f).select("recording", "id", "voted_page")


_TR = f"{LOG}, tr AS (SELECT session_id AS recording, t - 1704067200 AS timestamp FROM log WHERE speaker = 'click')"


@query(f"""WITH {_TR}, i AS (SELECT recording, timestamp, row_number() OVER (PARTITION BY recording ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY recording) AS n FROM tr), k AS (SELECT recording, round(2 + i * 29 / n)::INT AS page, min(timestamp) AS k FROM i GROUP BY ALL HAVING round(2 + i * 29 / n) <= 30),
    k2 AS (SELECT recording, page, min(k) AS k FROM k GROUP BY ALL), g AS (SELECT recording, page FROM (SELECT DISTINCT recording FROM tr), (SELECT unnest(range(1, 31))::INT AS page)), m AS (SELECT g.recording, g.page, CASE WHEN g.page = 1 THEN 0 ELSE k END AS k FROM g LEFT JOIN k2 USING (recording, page)),
    w AS (SELECT *, last_value(CASE WHEN k IS NOT NULL THEN page END IGNORE NULLS) OVER p AS pp, last_value(k IGNORE NULLS) OVER p AS pk, first_value(CASE WHEN k IS NOT NULL THEN page END IGNORE NULLS) OVER q AS qp, first_value(k IGNORE NULLS) OVER q AS qk FROM m WINDOW p AS (PARTITION BY recording ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY recording ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT recording, page AS "pageNumber", round(CASE WHEN k IS NOT NULL THEN k WHEN qp IS NOT NULL THEN pk + (qk - pk) * (page - pp) / (qp - pp) ELSE pk / pp * page END, 3)::DOUBLE AS timestamp, CASE WHEN page = 1 THEN 'start' WHEN k IS NOT NULL THEN 'detected' WHEN qp IS NOT NULL THEN 'interpolated' ELSE 'extrapolated' END AS source FROM w""")
def e10_interpolate(spark, d):
    t = entries(spark, d).where("speaker = 'click'").select(F.col("session_id").alias("recording"), (F.col("t") - 1704067200).alias("timestamp"))
    return Q.interpolate_page_times(t, n_pages=30).withColumn("timestamp", F.round("timestamp", 3))


@query(f"""WITH {TOK}, l AS (SELECT page, lang, list(word ORDER BY pos) AS ws FROM tok GROUP BY page, lang), n AS (SELECT lang AS book, page AS current_page, lead(page) OVER w AS next_page, lead(ws) OVER w AS nw, 's' || page % 3 AS sp, 's' || lead(page) OVER w % 3 AS ns FROM l WINDOW w AS (PARTITION BY lang ORDER BY page))
    SELECT book, current_page, next_page, nw[1:5] AS trigger_words, ns AS trigger_speaker, ns <> sp AS speaker_changes FROM n WHERE next_page IS NOT NULL""")
def e11_trigger_rules(spark, d):
    pages = tokens(spark, d).groupBy(F.col("lang").alias("book"), "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return Q.trigger_rules(pages.withColumn("speaker", F.concat(F.lit("s"), (F.col("page") % 3).cast("string"))))


def _markers(spark, d):
    e = entries(spark, d).where("speaker = 'click'")
    return e.select(F.col("session_id").alias("recording"), F.floor((F.col("t") - 1704067200) / 100).alias("timestamp_ms"), "page", "value")


@query(f"""WITH {LOG}, m AS (SELECT session_id AS recording, floor((t - 1704067200) / 100)::BIGINT AS ms0, page, value FROM log WHERE speaker = 'click'), n AS (SELECT *, lead(ms0) OVER w AS nt, lead(value) OVER w AS nv FROM m WINDOW w AS (PARTITION BY recording ORDER BY ms0, page)),
    r AS (SELECT *, ceil(ms0 / 100)::BIGINT AS f0, ceil(coalesce(nt, ms0 + 1000) / 100)::BIGINT - 1 AS f1 FROM n), f AS (SELECT *, unnest(range(f0, f1 + 1)) AS frame FROM r)
    SELECT recording, frame, frame * 100 AS timestamp_ms, page AS page_number, round(CASE WHEN coalesce(nt - frame * 100 < frame * 100 - ms0, false) THEN nv * exp(-(nt - frame * 100) / 2000) ELSE value * exp(-(frame * 100 - ms0) / 2000) END, 5) AS value, frame = f0 AS is_boundary FROM f""")
def e12_canonical_timeline(spark, d):
    return Q.canonical_timeline(_markers(spark, d), tail_ms=1000).withColumn("value", F.round("value", 5))


_SEG = f"""{LOG}, q AS (SELECT session_id AS recording, t AS time, value AS e, sum(CASE WHEN value <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS quiet FROM log), b AS (SELECT *, sum(CASE WHEN e <= 20 AND quiet >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY time ROWS UNBOUNDED PRECEDING) AS block FROM q),
    s AS (SELECT recording, min(time) AS start, max(time) AS stop FROM b WHERE e > 20 GROUP BY recording, block), seg AS (SELECT recording, start, stop, stop - start AS duration FROM s WHERE stop - start BETWEEN 100 AND 200000)"""


def _segments(spark, d):
    f = entries(spark, d).select(F.col("session_id").alias("recording"), F.col("t").alias("time"), F.col("value").alias("energy"))
    return Q.speech_segments(f, theta=20.0, shortest=100.0, longest=200000.0)


@query(f'WITH {_SEG} SELECT recording, start, stop AS "end", round(duration, 3) AS duration FROM seg')
def e13_speech_segments(spark, d):
    return _segments(spark, d).withColumn("duration", F.round("duration", 3))


@query(f"""WITH {_SEG}, {TOK}, sg AS (SELECT recording, start, row_number() OVER (PARTITION BY recording ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY recording) AS n FROM seg), x AS (SELECT page AS recording, word, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS j, count(*) OVER (PARTITION BY page) AS m FROM tok)
    SELECT sg.recording, start, word AS likely_word FROM sg JOIN x ON x.recording = sg.recording AND j = floor(i * m / n)""")
def e13_assign_words(spark, d):
    return Q.assign_words(_segments(spark, d), tokens(spark, d).select(F.col("page").alias("recording"), "pos", "word"))


@query("SELECT source AS book, doc_id AS page, round((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * (5234.0 / count(*) OVER (PARTITION BY source)), 4)::DOUBLE AS start, round(row_number() OVER (PARTITION BY source ORDER BY doc_id) * (5234.0 / count(*) OVER (PARTITION BY source)), 4)::DOUBLE AS \"end\" FROM documents")
def e14_estimate_times(spark, d):
    from .tables import sections

    out = Q.estimate_page_times(sections(spark, d).select("book", "page"), total_sec=5234.0)
    return out.select("book", "page", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


