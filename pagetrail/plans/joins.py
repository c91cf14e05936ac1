"""Queries of the joins and of the readers' parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.operators import corpus as C
from pagetrail.operators import joins as J
from pagetrail.operators.matching import best_self_match
from pagetrail.sources import files as S

from .registry import query
from .tables import ASK, LOG, POST, TOK, VEC, entries, messages, questions, table, tokens, vectors


@query(f"WITH {TOK}, {ASK}, {POST} SELECT query_id, page, count(*) AS hits FROM (SELECT DISTINCT query_id, word FROM ask) JOIN post USING (word) GROUP BY query_id, page")
def c1_lookup_postings(spark, d):
    return J.lookup_postings(questions(spark, d), C.postings(tokens(spark, d)))


def _points(spark, d):
    e = entries(spark, d)
    return e.where("speaker <> 'click'").select(F.col("session_id").alias("recording"), "t", F.col("event_id").alias("id"), F.col("page").alias("current_page"))


def _starts(spark, d):
    return entries(spark, d).where("speaker = 'click'").select(F.col("session_id").alias("recording"), "t", "page")


_PTS = f"{LOG}, pts AS (SELECT session_id AS recording, t, event_id AS id, page AS current_page FROM log WHERE speaker <> 'click'), st AS (SELECT session_id AS recording, t, page FROM log WHERE speaker = 'click')"


@query(f"WITH {_PTS} SELECT recording, pts.t, id, st.page AS expected_page FROM pts ASOF LEFT JOIN st USING (recording, t)")
def c2_asof_page(spark, d):
    return J.asof_page(_points(spark, d), _starts(spark, d))


@query(f"""WITH {_PTS} SELECT id, recording, page, round(abs(st.t - pts.t), 4) AS time_diff, round(exp(-abs(st.t - pts.t) / 10000), 6) AS boost
    FROM pts JOIN st USING (recording) WHERE abs(st.t - pts.t) <= 30000 AND page >= current_page""")
def c3_time_window(spark, d):
    out = J.time_window_candidates(_points(spark, d), _starts(spark, d), window_sec=30000)
    return out.select("id", "recording", "page", F.round("time_diff", 4).alias("time_diff"), F.round(F.exp(-F.col("time_diff") / 10000), 6).alias("boost"))


@query(f"WITH {_PTS} SELECT id, unnest(range(greatest(1, current_page - 3), least(99, current_page + 20) + 1))::INT AS page FROM pts")
def c4_page_window(spark, d):
    return J.page_window_candidates(_points(spark, d), back=3, ahead=20, max_page=99).select("id", "page")


@query(f"""WITH {_PTS}, c AS (SELECT recording, id, page, abs(st.t - pts.t) AS dist, row_number() OVER (PARTITION BY id ORDER BY abs(st.t - pts.t), st.t) AS r FROM pts JOIN st USING (recording))
    SELECT recording, id, page AS marker_page, round(dist, 4) AS distance FROM c WHERE r = 1""")
def c5_nearest_marker(spark, d):
    return J.nearest_marker(_points(spark, d), _starts(spark, d)).withColumn("distance", F.round("distance", 4)).where("marker_page is not null")


@query(f"WITH {TOK}, {ASK} SELECT word, count(*) AS count FROM ask WHERE word NOT IN (SELECT word FROM tok WHERE lang = 'en') GROUP BY word")
def c6_unknown_words(spark, d):
    return J.unknown_words(questions(spark, d), tokens(spark, d).where("lang = 'en'"))


@query("SELECT range AS page FROM range(1, 184) WHERE range NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def c6_missing_pages(spark, d):
    return J.missing_pages(table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("page")), 183)


@query(f"""WITH {TOK}, a AS (SELECT word, count(*) AS left_count FROM tok WHERE lang = 'en' GROUP BY word), b AS (SELECT word, count(*) AS right_count FROM tok WHERE lang = 'fr' GROUP BY word)
    SELECT word, left_count, right_count, left_count + right_count AS total FROM a JOIN b USING (word)""")
def c7_vocabulary_overlap(spark, d):
    t = tokens(spark, d)
    return J.vocabulary_overlap(t.where("lang = 'en'"), t.where("lang = 'fr'"))


@query(f"""WITH {TOK}, a AS (SELECT DISTINCT word FROM tok WHERE lang = 'en'), b AS (SELECT DISTINCT word FROM tok WHERE lang = 'fr')
    SELECT count(*) FILTER (a.word IS NOT NULL AND b.word IS NOT NULL) AS in_both, count(*) FILTER (b.word IS NULL) AS only_left, count(*) FILTER (a.word IS NULL) AS only_right FROM a FULL JOIN b ON a.word = b.word""")
def c7_overlap_counts(spark, d):
    t = tokens(spark, d)
    return J.overlap_counts(t.where("lang = 'en'"), t.where("lang = 'fr'"))


_SRC = f"{LOG}, src AS (SELECT page, speaker AS source, max(value) AS score, CASE WHEN speaker = 'click' THEN NULL ELSE min(value) END AS duration FROM log GROUP BY page, speaker)"


@query(f"""WITH {_SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(list_position(['click', 'view', 'error'], source), 999), source) AS n FROM src)
    SELECT page, source, score, coalesce(duration, (SELECT arg_min(s.duration, s.n) FROM r s WHERE s.page = r.page AND s.duration IS NOT NULL)) AS duration FROM r WHERE n = 1""")
def c8_merge_fingerprints(spark, d):
    src = entries(spark, d).groupBy("page", F.col("speaker").alias("source")).agg(F.max("value").alias("score"), F.min("value").alias("duration"))
    return J.merge_fingerprints(src.withColumn("duration", F.when(F.col("source") != "click", F.col("duration"))), priority=["click", "view", "error"])


@query(f"""WITH {LOG}, a AS (SELECT session_id AS query_id, page, max(score) AS page_score FROM log WHERE speaker = 'click' GROUP BY ALL), b AS (SELECT session_id AS query_id, page, max(score) AS word_score FROM log WHERE speaker = 'view' GROUP BY ALL),
    c AS (SELECT session_id AS query_id, page, max(score) AS temporal_score FROM log WHERE speaker = 'error' GROUP BY ALL), k AS (SELECT query_id, page FROM a UNION SELECT query_id, page FROM b UNION SELECT query_id, page FROM c)
    SELECT query_id, page, coalesce(page_score, 0.0) AS page_score, coalesce(word_score, 0.0) AS word_score, coalesce(temporal_score, 0.3)::DOUBLE AS temporal_score FROM k LEFT JOIN a USING (query_id, page) LEFT JOIN b USING (query_id, page) LEFT JOIN c USING (query_id, page)""")
def c9_fuse_candidates(spark, d):
    e = entries(spark, d)
    of = lambda kind, name: e.where(F.col("speaker") == kind).groupBy(F.col("session_id").alias("query_id"), "page").agg(F.max("score").alias(name))
    return J.fuse_candidates(of("click", "page_score"), of("view", "word_score"), of("error", "temporal_score"))


@query(f"""WITH {VEC}, refs AS (SELECT page AS ref_page, id AS ref_id, v AS rv FROM vec),
    s AS (SELECT vec.id, vec.page, ref_page, list_cosine_similarity(v, rv) AS c, row_number() OVER (PARTITION BY vec.id ORDER BY round(list_cosine_similarity(v, rv), 9) DESC, ref_id) AS r FROM vec, refs WHERE vec.id % 50 = 0 AND ref_id <> vec.id)
    SELECT id, ref_page AS best_page, round(c, 5) AS score, abs(ref_page - page) AS page_error FROM s WHERE r = 1""")
def c10_best_self_match(spark, d):
    v = vectors(spark, d)
    return best_self_match(v.where("id % 50 = 0"), v).withColumn("score", F.round("score", 5))


_SEG = f"{LOG}, seg AS (SELECT page, min(value) AS start, max(value) AS duration FROM log GROUP BY page)"


@query(f"""WITH {TOK}, {_SEG}, n AS (SELECT page, count(*) AS n FROM tok GROUP BY page) SELECT word, tok.page, pos::INT AS pos, round(least(0.7 / sqrt(n), 0.8), 3) AS confidence, start + (pos - 1) * duration / n AS est_start, duration / n AS est_duration
    FROM tok JOIN n ON n.page = tok.page JOIN seg ON seg.page = tok.page""")
def c13_align_words(spark, d):
    seg = entries(spark, d).groupBy("page").agg(F.min("value").alias("start"), F.max("value").alias("duration"))
    out = J.align_audio_words(seg, tokens(spark, d).select("page", "pos", "word"))
    return out.select("word", "page", "pos", F.round("confidence", 3).alias("confidence"), "est_start", "est_duration")


@query()
def c14_fuzzy_join(spark, d):
    """All words of the questions with all words of the pages: too slow in SQL, tested against brute force."""
    return J.fuzzy_join(questions(spark, d), tokens(spark, d))


@query(f"WITH {TOK}, {POST} SELECT a.page AS page_a, b.page AS page_b, count(*) AS shared FROM post a JOIN post b ON a.word = b.word AND a.page <> b.page WHERE a.page % 50 = 0 GROUP BY 1, 2")
def c15_page_overlap(spark, d):
    post = C.postings(tokens(spark, d))
    return J.page_overlap(post.where("page % 50 = 0"), post)


@query(f"""WITH {TOK}, {LOG}, rec AS (SELECT session_id AS recording, avg(t) AS duration FROM log GROUP BY session_id), c AS (SELECT DISTINCT recording, page FROM log JOIN rec ON session_id = recording WHERE t <= duration),
    n AS (SELECT page, word, count(*) AS n FROM tok GROUP BY ALL) SELECT recording, word, sum(n)::BIGINT AS count FROM c JOIN n USING (page) GROUP BY recording, word""")
def c16_words_for_recordings(spark, d):
    e = entries(spark, d).withColumnRenamed("session_id", "recording")
    return J.words_for_recordings(e.groupBy("recording").agg(F.avg("t").alias("duration")), e.select("recording", "t", "page"), tokens(spark, d).select("page", "word"))


@query("""WITH u AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS n FROM orders), b AS (SELECT c_custkey, c_acctbal FROM u WHERE n = 1), c AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.c_acctbal, c.c_acctbal) AS c_acctbal FROM c FULL JOIN b ON b.c_custkey = c.c_custkey""")
def a8_upsert(spark, d):
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate")
    return J.upsert_by_key(table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal"), updates, keys=["c_custkey"], update_cols=["c_acctbal"], version_col="o_orderdate")


_GONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN ({_GONE})")
def a10_delete_cascade(spark, d):
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return J.delete_cascade(orders, lines, parent_key="o_orderkey", fk="l_orderkey", ids=orders.where("o_orderstatus = 'P'").select("o_orderkey"))[1]


@query("SELECT DISTINCT 'book' AS pdf_id, lower(trim(p_name)) AS armenian, lower(trim(p_type)) AS phonetic, 1 AS occurrences, 1.0::DOUBLE AS confidence FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT 'book', lower(trim(p_name)), lower(trim(p_brand)), 1, 1.0::DOUBLE FROM part WHERE p_partkey % 2 = 1")
def a4_dictionary(spark, d):
    p = table(spark, d, "part")
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(",", F.concat(F.lit(" "), "p_name"), "p_brand", F.upper("p_type"))).otherwise(F.concat_ws(",", "p_name", "p_brand"))
    return S.parse_dictionary(p.select(line.alias("line")), pdf_id="book")


@query("""WITH g AS (SELECT conv_id AS doc, turn, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 3 <> 2)
    SELECT doc, CASE WHEN turn % 3 = 0 THEN turn + 10 ELSE n END::INT AS page_number, 'line ' || turn AS armenian_text, CASE WHEN turn % 3 = 0 THEN 'eng' ELSE '' END AS english_text FROM g""")
def a5_page_lines(spark, d):
    turn = F.col("turn").cast("string")
    line = F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") + 10).cast("string"), F.lit("| line "), turn, F.lit(" |eng"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("x| line "), turn)).otherwise("no parts")
    return S.parse_page_lines(messages(spark, d).select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), line.alias("line")))


@query("""SELECT coalesce(nullif(l_linenumber - 1, 0), 1)::INT AS page_number, coalesce(nullif(l_returnflag, 'A'), 'training_data') AS audio_source, l_discount AS timestamp_start,
    coalesce(nullif(l_tax, 0), nullif(l_discount, 0), 60.0)::DOUBLE AS timestamp_end, coalesce(nullif(l_discount, 0), 0.8)::DOUBLE AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""")
def a9_load_fingerprints(spark, d):
    li = table(spark, d, "lineitem")
    raw = li.select((F.col("l_linenumber") - 1).alias("pageNumber"), F.struct(F.col("l_quantity").alias("rms")).alias("features"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("source"), F.col("l_discount").alias("startTime"), F.col("l_tax").alias("endTime"), F.col("l_discount").alias("duration"), F.col("l_discount").alias("confidence"))
    return S.load_fingerprints(raw).groupBy("page_number", "audio_source", "timestamp_start", "timestamp_end", "confidence").agg(F.count(F.lit(1)).alias("n"))


