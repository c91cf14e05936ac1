"""Queries of the scores and matchers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetrail.functions import scoring as S
from pagetrail.functions import text as T
from pagetrail.operators import corpus as C
from pagetrail.operators import decisions as D
from pagetrail.operators import joins as J
from pagetrail.operators import matching as M
from pagetrail.operators.tables import cut

from .registry import query
from .tables import ASK, LOG, POST, TOK, VEC, entries, questions, sections, table, tokens, vectors

_NEXT = f"{VEC}, pairs AS (SELECT a.id, a.page AS pa, b.page AS pb, a.v AS a, b.v AS b, list_cosine_similarity(a.v, b.v) AS c FROM vec a JOIN vec b ON b.id = a.id + 1)"


def _pairs(spark, d):
    v = vectors(spark, d)
    return v.select("id", F.col("page").alias("pa"), F.col("v").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("page").alias("pb"), F.col("v").alias("b")), "id").withColumn("c", S.cosine(F.col("a"), F.col("b")))


@query(f"""WITH {_NEXT}, n AS (SELECT *, list_dot_product(a, b) AS ab, sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) AS nn FROM pairs)
    SELECT id, round(c, 5) AS strict, round((c + 1) / 2, 5) AS unit, round(ab / (nn + 1e-4), 5) AS eps, round(100 * list_cosine_similarity(a[1:13], b[1:13]), 3) AS pct13 FROM n""")
def f1_cosine(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("id", *[F.round(S.cosine(a, b, variant=v), 3 if v == "pct13" else 5).alias(v) for v in ("strict", "unit", "eps", "pct13")])


@query(f"""WITH {_NEXT}, x AS (SELECT id, c, abs(a[1] - b[1]) AS r, abs(a[2] - b[2]) AS z, abs(pa - pb) AS g FROM pairs)
    SELECT id, round(0.6 * c + 0.2 * exp(-100 * r) + 0.2 * exp(-z / 50), 5) AS basic,
    round(CASE WHEN c < 0.3 THEN 0 ELSE least(1, 0.7 * c + 0.15 * exp(-50 * r) + 0.15 * exp(-z / 100) + CASE WHEN g <= 1 THEN 0.15 WHEN g <= 3 THEN 0.05 ELSE 0 END) END, 5)::DOUBLE AS live,
    round((0.6 * c + 0.2 * greatest(0, 1 - r * 10) + 0.1 * greatest(0, 1 - z / 1000)) / 0.9, 5) AS linear, round(0.7 * c + 0.15 * greatest(0, 1 - r) + 0.15 * greatest(0, 1 - z), 5) AS relative FROM x""")
def f2_fingerprint_score(spark, d):
    r, z = F.abs(F.get("a", F.lit(0)) - F.get("b", F.lit(0))), F.abs(F.get("a", F.lit(1)) - F.get("b", F.lit(1)))
    return _pairs(spark, d).select("id", *[F.round(S.fingerprint_score(F.col("c"), r, z, profile=p, page=F.col("pa"), current=F.col("pb")), 5).alias(p) for p in ("basic", "live", "linear", "relative")])


_RARITY = "CASE WHEN df <= 3 THEN 10 WHEN df <= 10 THEN 3 ELSE 1 END"


def _match_sql(where: str = "", boost: str = "1.0") -> str:
    return f"""sc AS (SELECT query_id, page, sum({_RARITY})::DOUBLE * any_value({boost}) AS score FROM (SELECT DISTINCT query_id, word FROM ask) JOIN df USING (word) JOIN post USING (word) GROUP BY query_id, page),
    rk AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, page)),
    mt AS (SELECT query_id, page, score, rank::INT AS rank, first_value(CASE WHEN second > 0 THEN score / second ELSE 10.0 END) OVER (PARTITION BY query_id ORDER BY rank) AS confidence FROM rk)"""


@query(f"WITH {TOK}, {ASK}, {POST}, {_match_sql()} SELECT query_id, page, score, round(confidence, 6) AS confidence, rank FROM mt WHERE rank <= 5")
def f3_match_text(spark, d):
    return M.match_text(questions(spark, d), C.postings(tokens(spark, d))).select("query_id", "page", "score", F.round("confidence", 6).alias("confidence"), "rank")


@query(f"""WITH {TOK}, {ASK}, {POST}, {_match_sql(boost='CASE WHEN page = query_id * 7 + 1 THEN 10.0 WHEN page = query_id * 7 THEN 2.0 ELSE 1.0 END')} SELECT query_id, page, score, round(confidence, 6) AS confidence, rank FROM mt WHERE rank <= 5""")
def f3_match_text_in_sequence(spark, d):
    current = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7).alias("current_page"))
    return M.match_text(questions(spark, d), C.postings(tokens(spark, d)), current=current).select("query_id", "page", "score", F.round("confidence", 6).alias("confidence"), "rank")


_WIN = f"""{TOK}, lw AS (SELECT page, list(word ORDER BY pos) AS ws FROM tok WHERE length(word) > 2 GROUP BY page), win AS (SELECT page, i AS start_offset, i // 7 AS window_index, ws[i + 1 : i + 14] AS words FROM lw, unnest(range(0, CASE WHEN len(ws) <= 14 THEN 1 ELSE len(ws) END, 7)) AS u(i)),
    wins AS (SELECT * FROM win WHERE len(words) >= 4 OR (start_offset = 0 AND len((SELECT ws FROM lw WHERE lw.page = win.page)) <= 14))"""


#: DuckDB's distance counts bytes: a byte for each letter that the given words have.
_BYTES = "translate({}, 'àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123')"


@query(f"""WITH {_WIN}, {ASK}, ww AS (SELECT DISTINCT page, window_index, unnest(words) AS word FROM wins), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT page, window_index FROM ww)),
    df AS (SELECT word, count(*) AS df FROM ww GROUP BY word), said AS (SELECT query_id, word, count(*) AS k FROM ask WHERE length(word) > 2 GROUP BY query_id, word),
    live AS (SELECT said.*, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM said LEFT JOIN df USING (word), n), whole AS (SELECT query_id, sum(k) AS total_words, sum(k * idf) AS total FROM live GROUP BY query_id),
    ahead AS (SELECT item_id AS query_id, page, window_index, word AS held FROM benchmark JOIN ww ON page BETWEEN item_id * 7 AND item_id * 7 + 12 WHERE page > item_id * 7 OR window_index >= 2),
    pairs AS (SELECT DISTINCT live.word, held FROM live JOIN ahead USING (query_id)),
    near AS (SELECT word, held FROM pairs WHERE contains(held, word) OR contains(word, held)
        OR (abs(length(held) - length(word)) <= 2 AND levenshtein({_BYTES.format("held")}, {_BYTES.format("word")}) <= 2)),
    hit AS (SELECT DISTINCT ahead.query_id, live.word, page, window_index FROM ahead JOIN near USING (held) JOIN live ON live.query_id = ahead.query_id AND live.word = near.word),
    got AS (SELECT query_id, page, window_index, sum(k)::BIGINT AS matched_words, sum(k * idf) AS got FROM hit JOIN live USING (query_id, word) GROUP BY query_id, page, window_index),
    sc AS (SELECT query_id, page, window_index, matched_words, round(100 * got / total * CASE page - query_id * 7 WHEN 1 THEN 0.5 WHEN 0 THEN 0.8 ELSE 1.0 END, 4) AS confidence FROM got JOIN whole USING (query_id)),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, page, window_index) = 1)
    SELECT item_id AS query_id, coalesce(page, item_id * 7) AS page, coalesce(window_index, 2)::INT AS window_index, coalesce(matched_words, 0) AS matched_words, coalesce(total_words, 0)::BIGINT AS total_words, coalesce(confidence, 0) AS confidence
    FROM benchmark LEFT JOIN best ON best.query_id = item_id LEFT JOIN whole ON whole.query_id = item_id""")
def f4_match_windows(spark, d):
    """Each passage as live words at page 7 x its number, window 2, its place lost: the best window ahead."""
    from pagetrail.operators.sequences import text_windows

    w = text_windows(tokens(spark, d)).select("page", "window_index", F.explode("words").alias("word"))
    current = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7).alias("current_page"), F.lit(2).alias("current_window"))
    return M.match_windows(questions(spark, d).where(F.length("word") > 2), w, current, resync=True, digits=4).withColumn("confidence", F.round("confidence", 4))


def _grams(df, key):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return df.select(key, words.alias("ws")).select(key, F.explode(T.ngrams(F.col("ws"), 2)).alias("gram"))


@query(f"""WITH {TOK}, {ASK}, g AS (SELECT DISTINCT page, word || ' ' || nxt AS gram FROM (SELECT page, word, lead(word) OVER (PARTITION BY page ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL),
    q AS (SELECT DISTINCT query_id, word || ' ' || nxt AS gram FROM (SELECT query_id, word, lead(word) OVER (PARTITION BY query_id ORDER BY pos) AS nxt FROM ask) WHERE nxt IS NOT NULL), t AS (SELECT query_id, count(*) AS total FROM q GROUP BY query_id),
    m AS (SELECT query_id, page, count(*) AS matched FROM q JOIN g USING (gram) GROUP BY ALL) SELECT query_id, page, matched, total, round(matched / total, 6) AS score FROM m JOIN t USING (query_id) WHERE matched > 1""")
def f5_match_ngrams(spark, d):
    asked = _grams(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")
    return M.match_ngrams(asked, _grams(sections(spark, d), "page")).where("matched > 1").withColumn("score", F.round("score", 6))


@query(f"""WITH {TOK}, {ASK}, g AS (SELECT DISTINCT page, word || ' ' || nxt AS gram FROM (SELECT page, word, lead(word) OVER (PARTITION BY page ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL),
    q AS (SELECT query_id, word || ' ' || nxt AS gram FROM (SELECT query_id, word, lead(word) OVER (PARTITION BY query_id ORDER BY pos) AS nxt FROM ask) WHERE nxt IS NOT NULL), t AS (SELECT query_id, count(*) AS total FROM q GROUP BY query_id),
    m AS (SELECT query_id, page, count(DISTINCT gram) AS matched FROM q JOIN g USING (gram) WHERE page BETWEEN query_id * 3 AND query_id * 3 + 40 GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, page) = 1)
    SELECT item_id AS query_id, coalesce(page, item_id * 3)::BIGINT AS page, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total, coalesce(round(matched / total, 6), 0)::DOUBLE AS score FROM benchmark LEFT JOIN b ON b.query_id = item_id LEFT JOIN t ON t.query_id = item_id""")
def f5_match_ngrams_ahead(spark, d):
    """Each passage at page 3 x its number: the best of that page and the forty after it."""
    asked = _grams(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")
    current = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).cast("long").alias("current_page"))
    return M.match_ngrams_ahead(asked, _grams(sections(spark, d), "page"), current, look_ahead=40).withColumn("score", F.round("score", 6))


@query(f"""WITH {TOK}, {ASK}, {POST}, q AS (SELECT DISTINCT query_id, word FROM ask WHERE pos <= 10), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id), h AS (SELECT query_id, page, count(*) AS hits FROM q JOIN post USING (word) GROUP BY ALL)
    SELECT query_id, page, hits, round(hits / n, 6) AS confidence FROM h JOIN n USING (query_id) WHERE hits >= 2""")
def f6_match_counts(spark, d):
    return M.match_counts(questions(spark, d), C.postings(tokens(spark, d)), first_n=10).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {TOK}, {ASK}, q AS (SELECT query_id, word, count(*) AS n FROM ask WHERE length(word) > 2 GROUP BY ALL), pw AS (SELECT DISTINCT page, word FROM tok), v AS (SELECT DISTINCT word FROM pw), a AS (SELECT DISTINCT word FROM q),
    c AS (SELECT v.word AS outer_word, a.word FROM v JOIN a ON contains(v.word, a.word)), h AS (SELECT DISTINCT c.word, page FROM c JOIN pw ON pw.word = c.outer_word)
    SELECT query_id, page, sum(n)::BIGINT * 10 AS score FROM q JOIN h USING (word) GROUP BY query_id, page""")
def f6_search_substrings(spark, d):
    return J.search_substrings(questions(spark, d).where(F.length("word") > 2), tokens(spark, d))


_TPL = f"""{VEC}, sc AS (SELECT o.id AS obs_id, 'w' || t.page AS word, max({{s}}) AS score FROM vec o, vec t WHERE o.id % 50 = 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, word)::INT AS rank FROM sc)"""


def _templates(spark, d):
    """Every vector as a template; those with an id divisible by 50 ask."""
    v = vectors(spark, d)
    return v.where("id % 50 = 0").select("id", "v"), v.select("id", "v", F.concat(F.lit("w"), F.col("page").cast("string")).alias("word"), (F.col("id") % 100).cast("double").alias("extra"))


@query(f"WITH {_TPL.format(s='round(0.8 * list_cosine_similarity(o.v, t.v) + 0.2 * exp(-10 * abs(o.v[1] - t.v[1])), 6)')} SELECT * FROM rk WHERE rank <= 5")
def f7_recognize_words(spark, d):
    def score(a, b, extra):
        return 0.8 * M.scores(a, b, "cosine") + 0.2 * np.exp(-10 * np.abs(a[:, :1] - b[:, 0]))

    return M.score_templates(*_templates(spark, d), score)


@query(f"WITH {_TPL.format(s='round(0.5 * list_cosine_similarity(o.v, t.v) + 0.2 * greatest(0, 1 - abs(o.v[1] - t.v[1])) + 0.2 * list_cosine_similarity(o.v[1:12], t.v[1:12]) + least(t.id % 100 / 100, 0.1), 6)')} SELECT * FROM rk WHERE rank <= 5 AND score > 0.3")
def f8_match_patterns(spark, d):
    def score(a, b, extra):
        return 0.5 * M.scores(a, b, "cosine") + 0.2 * np.maximum(0, 1 - np.abs(a[:, :1] - b[:, 0])) + 0.2 * M.scores(a[:, :12], b[:, :12], "cosine") + np.minimum(extra / 100, 0.1)

    return M.score_templates(*_templates(spark, d), score).where("score > 0.3")


@query(f"""WITH {TOK}, {ASK}, {POST}, r AS (SELECT query_id AS obs_id, word, least(pos / 100.0, 1.0) AS score FROM ask) SELECT obs_id, page, count(*) AS matches, round(avg(score) + 1e-9, 4) AS avg_confidence, round(count(*) * sum(score) / (count(*) + 1) + 1e-9, 4) AS score
    FROM r JOIN post USING (word) GROUP BY obs_id, page""")
def f9_words_to_pages(spark, d):
    r = questions(spark, d).select(F.col("query_id").alias("obs_id"), "word", F.least(F.col("pos") / 100, F.lit(1.0)).alias("score"))
    out = M.words_to_pages(r, C.postings(tokens(spark, d)))
    return out.select("obs_id", "page", "matches", F.round(F.col("avg_confidence") + 1e-9, 4).alias("avg_confidence"), F.round(F.col("score") + 1e-9, 4).alias("score"))


_LAG = f"{LOG}, lg AS (SELECT *, lag(page) OVER w AS prev, lag(value) OVER w AS pv FROM log WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))"


def _lagged(spark, d):
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    return entries(spark, d).withColumn("prev", F.lag("page").over(w)).withColumn("pv", F.lag("value").over(w))


_TIER = "CASE WHEN prev IS NULL THEN 1.0 WHEN abs(page - prev) = 1 THEN 1.0 WHEN abs(page - prev) <= 3 THEN 0.9 WHEN abs(page - prev) <= 10 THEN 0.7 ELSE 0.3 END"


@query(f"WITH {_LAG} SELECT event_id, {_TIER}::DOUBLE AS tier FROM lg")
def f10_temporal_tier(spark, d):
    return _lagged(spark, d).select("event_id", S.temporal_tier(F.col("page"), F.col("prev")).alias("tier"))


@query(f"WITH {_LAG} SELECT event_id, round(0.3 * score + 0.5 * page / 100 + 0.2 * {_TIER}, 6)::DOUBLE AS score FROM lg")
def f11_fuse(spark, d):
    return _lagged(spark, d).select("event_id", F.round(S.fuse(F.col("score"), F.col("page") / 100, S.temporal_tier(F.col("page"), F.col("prev"))), 6).alias("score"))


@query(f"""WITH {_LAG}, x AS (SELECT event_id, value AS c, pv AS e FROM lg) SELECT event_id, CASE WHEN e IS NULL OR e <= 0 THEN 1.0 WHEN abs(c - e) / e > 0.5 THEN 0.3 WHEN abs(c - e) / e > 0.3 THEN 0.6 WHEN abs(c - e) / e > 0.15 THEN 0.8 WHEN abs(c - e) / e < 0.05 THEN 1.1 ELSE 1.0 END::DOUBLE AS factor FROM x""")
def f12_duration_factor(spark, d):
    return _lagged(spark, d).select("event_id", S.duration_factor(F.col("value"), F.col("pv")).alias("factor"))


@query(f"""WITH {_LAG}, e AS (SELECT prev AS from_page, page AS to_page, count(*) / sum(count(*)) OVER (PARTITION BY prev) AS prob FROM lg WHERE prev IS NOT NULL GROUP BY prev, page)
    SELECT event_id, round(1 + 10 * coalesce(prob, 1e-5) + 1e-9, 6)::DOUBLE AS temporal_boost, round(score * (1 + 10 * coalesce(prob, 1e-5)) + 1e-9, 6)::DOUBLE AS final_score FROM lg LEFT JOIN e ON e.from_page = prev AND e.to_page = page""")
def f13_apply_transitions(spark, d):
    from pagetrail.operators.reports import transition_counts

    edges = transition_counts(entries(spark, d).select("session_id", "page", "t", "event_id"))
    out = D.apply_transitions(_lagged(spark, d), edges)
    return out.select("event_id", F.round(F.col("temporal_boost") + 1e-9, 6).alias("temporal_boost"), F.round(F.col("final_score") + 1e-9, 6).alias("final_score"))


@query(f"""WITH {_LAG}, x AS (SELECT event_id, 0.6 * score + 0.4 * page / 100 AS b, page - prev AS g FROM lg)
    SELECT event_id, round(greatest(0, least(1, CASE WHEN g = 1 THEN b + 0.1 WHEN g = 2 THEN b + 0.05 WHEN g < 0 THEN b * 0.1 WHEN g > 5 THEN b * 0.3 WHEN g >= 3 THEN b * greatest(0.3, 1 - 0.1 * g) ELSE b END)), 6)::DOUBLE AS final_score FROM x""")
def f14_sequential_adjust(spark, d):
    out = S.sequential_adjust(F.col("score"), F.col("page") / 100, F.col("page") - F.col("prev"))
    return _lagged(spark, d).select("event_id", F.round(out, 6).alias("final_score"))


@query(f"WITH {LOG} SELECT event_id, CASE WHEN page / 1000.0 < 0.002 THEN 'silence' WHEN value / 10 > 5 THEN 'choir' WHEN value / 10 > 1.5 THEN 'deacon' ELSE 'celebrant' END AS speaker FROM log")
def f15_speaker_class(spark, d):
    return entries(spark, d).select("event_id", S.speaker_class(F.col("value") / 10, F.col("page") / 1000, profile="fine").alias("speaker"))


@query(f"""WITH {_NEXT} SELECT id, round(greatest(0, least(100, 100 * (1 - abs(a[1] - b[1])))), 4) AS confidence,
    round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) ** 2 / i))) + 10 * abs(a[1] - b[1]) + 5 * abs(a[2] - b[2]), 5) AS distance, round(CASE WHEN pb > 0 THEN greatest(0, 1 - abs(pa - pb) / pb) ELSE 0.5 END, 5)::DOUBLE AS timing FROM pairs""")
def f16_feature_distance(spark, d):
    r, z = F.abs(F.get("a", F.lit(0)) - F.get("b", F.lit(0))), F.abs(F.get("a", F.lit(1)) - F.get("b", F.lit(1)))
    return _pairs(spark, d).select("id", F.round(S.feature_confidence(r), 4).alias("confidence"), F.round(S.frame_distance(F.col("a"), F.col("b"), r, z), 5).alias("distance"), F.round(S.timing_score(F.col("pa"), F.col("pb")), 5).alias("timing"))


@query(f"""WITH {ASK}, l AS (SELECT query_id, list(word ORDER BY pos) AS ws FROM ask GROUP BY query_id), x AS (SELECT query_id, ws[greatest(1, len(ws) - 9) : len(ws)] AS recent, ws[1:5] AS trig FROM l)
    SELECT query_id, len(list_filter(trig, lambda t: len(list_filter(recent, lambda r: contains(r, t) OR contains(t, r))) > 0)) AS match_count FROM x""")
def f17_trigger_match(spark, d):
    q = questions(spark, d).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("ws"))
    return D.trigger_match(q.select("query_id", "ws", F.slice("ws", 1, 5).alias("triggers"))).select("query_id", F.col("match_count").cast("long").alias("match_count"))


_SIGNALS = f"""{LOG}, x AS (SELECT session_id, event_id, t, page AS current_page, CASE WHEN value > 20 THEN page + 1 END AS trigger_page, value AS trigger_confidence,
    CASE WHEN event_id % 3 > 0 THEN page + 1 + (event_id % 7 = 0)::INT END AS fp_page, CASE WHEN speaker <> 'error' THEN 2 * value END AS fp_confidence, CASE WHEN event_id % 5 > 1 THEN page + 1 END AS ng_page, value / 2 AS ng_confidence, event_id % 6 AS ng_matches FROM log),
    y AS (SELECT *, current_page + 1 AS nxt, coalesce(trigger_page = current_page + 1, false) AS tr, coalesce(fp_page = current_page + 1, false) AS fp, coalesce(ng_page = current_page + 1, false) AS ng,
        fp_page IS NOT NULL AND ng_page IS NOT NULL AND fp_page <> ng_page AS differ, fp_page IS NULL AND ng_page IS NULL AS held FROM x),
    z AS (SELECT *, (tr AND trigger_confidence >= 60) OR fp_confidence IS NULL OR (tr AND (fp OR ng)) AS early FROM y),
    s AS (SELECT *, NOT early AND fp AND ng AS agree, sum((NOT early AND NOT (fp AND ng) AND (differ OR held))::INT) OVER (PARTITION BY session_id ORDER BY t, event_id) AS ended FROM z),
    u AS (SELECT *, last_value(CASE WHEN agree THEN nxt END IGNORE NULLS) OVER (PARTITION BY session_id, ended ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    v AS (SELECT *, sum((agree AND before IS NOT NULL AND before <> nxt)::INT) OVER (PARTITION BY session_id, ended ORDER BY t, event_id) AS other FROM u),
    w AS (SELECT *, sum(agree::INT) OVER (PARTITION BY session_id, ended, other ORDER BY t, event_id) AS run FROM v)"""


@query(f"""WITH {_SIGNALS}, r AS (SELECT *, CASE WHEN tr AND trigger_confidence >= 60 THEN 'trigger_match' WHEN fp_confidence IS NULL AND ng AND ng_confidence >= 20 THEN 'ngram_only_mode' WHEN fp_confidence IS NULL THEN 'ngram_only_insufficient'
    WHEN tr AND (fp OR ng) THEN 'trigger_confirmed' WHEN fp AND ng AND run >= 2 THEN 'both_agree' WHEN fp AND ng THEN 'agreement_pending' WHEN differ THEN 'disagreement' WHEN fp AND fp_confidence >= 45 THEN 'fingerprint_strong'
    WHEN ng AND ng_matches >= 4 THEN 'ngram_strong' WHEN held THEN 'both_hold' ELSE 'uncertain' END AS reason FROM w), a AS (SELECT *, reason IN ('trigger_match', 'ngram_only_mode', 'trigger_confirmed', 'both_agree', 'fingerprint_strong', 'ngram_strong') AS turn FROM r)
    SELECT event_id, CASE WHEN turn THEN 'turn' ELSE 'hold' END AS action, CASE WHEN turn THEN nxt END AS target_page, reason, reason IN ('trigger_confirmed', 'both_agree', 'agreement_pending', 'both_hold') AS agreement FROM a""")
def f18_coordinate(spark, d):
    """Signals made of the log, two agreements in a row for a turn."""
    e, page = entries(spark, d), F.col("page")
    x = e.select("session_id", "event_id", "t", page.alias("current_page"), F.when(F.col("value") > 20, page + 1).alias("trigger_page"), F.col("value").alias("trigger_confidence"),
                 F.when(F.col("event_id") % 3 > 0, page + 1 + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("fp_page"), F.when(F.col("speaker") != "error", 2 * F.col("value")).alias("fp_confidence"),
                 F.when(F.col("event_id") % 5 > 1, page + 1).alias("ng_page"), (F.col("value") / 2).alias("ng_confidence"), (F.col("event_id") % 6).alias("ng_matches"))
    return D.coordinate(x, agreements=2).select("event_id", "action", "target_page", "reason", "agreement")


@query(f"""WITH {TOK}, {ASK}, {POST}, sg AS (SELECT page, word FROM post JOIN df USING (word) WHERE df <= 3), sc AS (SELECT query_id, page, sum({_RARITY})::DOUBLE * any_value(CASE WHEN page = query_id * 7 + 1 THEN 10.0 WHEN page = query_id * 7 THEN 2.0 ELSE 1.0 END) AS score FROM (SELECT DISTINCT query_id, word FROM ask) JOIN df USING (word) JOIN post USING (word) GROUP BY ALL),
    r AS (SELECT query_id, page, count(*) AS rare FROM (SELECT DISTINCT query_id, word FROM ask) JOIN sg USING (word) GROUP BY ALL), s2 AS (SELECT query_id, page, score * (1 + coalesce(rare, 0)) AS score FROM sc LEFT JOIN r USING (query_id, page)),
    rk AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM s2 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, page))
    SELECT query_id, page, score, rank::INT AS rank FROM rk WHERE rank <= 5""")
def f19_multi_signal(spark, d):
    asked = questions(spark, d)
    post = cut(C.postings(tokens(spark, d).join(M.few(asked.select("word").distinct()), "word", "left_semi")))  # other words match nothing
    rare = post.join(C.document_frequency(post).where("df <= 3"), "word").select("page", "word")
    current = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7).alias("current_page"))
    return M.multi_signal_match(asked, post, rare, current=current).select("query_id", "page", "score", "rank")


@query()
def f20_noise_sweep(spark, d):
    return D.noise_sweep(vectors(spark, d), levels=(0.05, 0.1, 0.2, 0.3), seed=7)


@query(f"WITH {TOK}, {ASK}, {POST}, {_match_sql()}, m AS (SELECT * FROM mt WHERE rank = 1) SELECT count(*) AS tested, count(*) FILTER (confidence >= 1.5) AS sure, round(avg(score), 4) AS avg_score FROM m")
def e7_margin_summary(spark, d):
    best = M.match_text(questions(spark, d), C.postings(tokens(spark, d)), k=1)
    return best.agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("confidence") >= 1.5).alias("sure"), F.round(F.avg("score"), 4).alias("avg_score"))


@query(f"WITH {LOG} SELECT session_id, event_id, value, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, event_id)::INT AS rank FROM log QUALIFY rank <= 5")
def e7_top_k(spark, d):
    return M.top_k(entries(spark, d).select("session_id", "event_id", "value"), by=["session_id"], score="value", k=5, tie=["event_id"])


@query(f"WITH {TOK}, {POST}, r AS (SELECT page, word, df, row_number() OVER (PARTITION BY page ORDER BY df, word)::INT AS rank FROM post JOIN df USING (word)) SELECT * FROM r WHERE rank <= 3")
def e8_rarest_words(spark, d):
    return M.rarest_words(C.postings(tokens(spark, d)))


@query(f"WITH {_WIN} SELECT page, window_index, start_offset, words FROM wins")
def e9_text_windows(spark, d):
    from pagetrail.operators.sequences import text_windows

    return text_windows(tokens(spark, d)).select("page", F.col("window_index").cast("long").alias("window_index"), F.col("start_offset").cast("long").alias("start_offset"), "words")
