"""Queries of the streaming operators: events are read as a stream, all that is there is run, and the result is a table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetrail.streaming import caches as C
from pagetrail.streaming import flows as S
from pagetrail.streaming import tracking as K

from .registry import query
from .tables import LOG, entries, table


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    page = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("t"), F.col("event_type").alias("speaker"), page.alias("page"), "value", F.least(F.col("value") / 50.0, F.lit(1.0)).alias("score"), (F.col("value") > 60).alias("triggered"))


@query(f"WITH {LOG} SELECT session_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(avg(value), 5) AS avg_value FROM log GROUP BY ALL")
def h1_tumbling(spark, d):
    out = S.run_available(S.chunk_stream(_stream(spark, d), length="6 hours"), mode="complete")
    return out.select("session_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("avg_value", 5).alias("avg_value"))


@query(f"""WITH {LOG}, w AS (SELECT session_id, value, time_bucket(INTERVAL 3 HOUR, ts) - unnest([INTERVAL 0 HOUR, INTERVAL 3 HOUR]) AS start FROM log) SELECT session_id, start, count(*) AS n, round(avg(value), 5) AS avg_value FROM w GROUP BY ALL""")
def h1_sliding(spark, d):
    out = S.run_available(S.chunk_stream(_stream(spark, d), length="6 hours", slide="3 hours"), mode="complete")
    return out.select("session_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("avg_value", 5).alias("avg_value"))


def _observations(df):
    """Scores fall off from the observed page."""
    scores = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda p: F.col("score") * F.exp(-F.abs(p - F.col("page")) / 3))
    return df.select("session_id", F.col("event_id").alias("id"), F.col("t").alias("ts"), "speaker", (F.col("page") / 1000).alias("rms"), scores.alias("scores"))


def _speakers(spark, d):
    """The commonest speaker of each page of the book (100 pages): what the tracker expects there."""
    n = entries(spark, d).where("page between 1 and 100").groupBy("page", "speaker").agg(F.count(F.lit(1)).alias("n"))
    found = {r["page"]: r["speaker"] for r in n.groupBy("page").agg(F.max_by("speaker", F.struct("n", "speaker")).alias("speaker")).collect()}
    return [found.get(p) for p in range(1, 101)]


def _track(profile):
    def run(spark, d):
        config = {"speakers": _speakers(spark, d)} if profile == "tracker" else None
        return S.run_available(K.track_pages(_observations(_stream(spark, d)), profile=profile, config=config))

    run.__name__ = f"h{'2' if profile == 'tracker' else '3' if profile in ('smart', 'word_buffer', 'double_gate', 'sensitivity') else {'discriminative': 4, 'transcript': 5, 'coordinator': 6, 'aligner': 7, 'belief': 8}[profile]}_track_{profile}"
    return run


for _profile in K.PROFILES:
    query()(_track(_profile))


@query()
def h5_follow_transcripts(spark, d):
    """Every conversation as a session of transcripts, four seconds apart, through the book whose pages are the benchmark's passages."""
    from pagetrail.functions import text as X
    from pagetrail.operators.sequences import text_windows
    from pagetrail.streaming import transcripts

    passages = table(spark, d, "benchmark").select((F.col("item_id") + 1).cast("int").alias("page"), F.lower("text").alias("text"))
    book = transcripts.read_book(text_windows(X.tokenize(passages, "text", pattern=r"\p{L}+", min_len=2)))
    said = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parquet*")  # a file or a folder
    said = said.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.timestamp_seconds(1_700_000_000 + 4 * F.col("turn")).alias("ts"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), " ").alias("text"))
    return S.run_available(transcripts.follow_transcripts(said, book)).withColumn("confidence", F.round("confidence", 6))


def _played(spark, d):
    """All vectors, in order of page and id, as a timeline of frames a tenth of a second apart; and the same played three times with noise."""
    from pagetrail.streaming import alignment

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("page"), F.col("embedding").cast("array<double>").alias("v"))
    line = alignment.read_timeline(v.select(F.struct("page", "id").alias("frame"), "page", "v"), hop=0.1)
    places = spark.createDataFrame([(page, at) for at, page in line.pages], "page long, at long")  # a row a page
    frames = v.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy("id")) - 1).join(places, "page").select("id", (F.col("at") + F.col("_n")).alias("frame"))
    heard = spark.readStream.schema(table(spark, d, "embeddings").schema).parquet(f"{d}/embeddings.parquet*").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    unit = lambda i: F.pmod(F.xxhash64("id", "session_id", i), F.lit(10_000)) / 5_000 - 1
    heard = heard.join(frames, "id").withColumn("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    heard = heard.withColumn("v", F.transform("v", lambda x, i: x * (1 + 0.05 * F.col("session_id") * unit(i)))).withColumn("ts", F.timestamp_millis(1_700_000_000_000 + 100 * F.col("frame")))
    return heard, line


def _place(machine):
    def run(spark, d):
        from pagetrail.streaming import alignment

        heard, line = _played(spark, d)
        out = S.run_available(alignment.place_stream(heard, line, machine=machine))
        return out.select("session_id", "ts", "page", F.round("position", 4).alias("position"), F.round("confidence", 4).alias("confidence"), "turned")

    run.__name__ = f"{'h7_align' if machine == 'aligner' else 'h8_believe'}_timeline"
    return run


for _machine in ("aligner", "belief"):
    query()(_place(_machine))


@query("SELECT DISTINCT event_type, user_id FROM events")
def h9_dedupe(spark, d):
    s = _stream(spark, d).select("speaker", "session_id", "ts", F.concat_ws("|", "speaker", "session_id").alias("id"))
    out = S.run_available(S.dedupe(s, id="id", ttl="400 days"))
    return out.select(F.col("speaker").alias("event_type"), F.col("session_id").alias("user_id"))


@query(f"""WITH {LOG}, g AS (SELECT event_id, session_id, t, lag(t) OVER (PARTITION BY session_id ORDER BY t) AS p FROM log) SELECT event_id, session_id FROM g WHERE p IS NULL OR t >= p + 7200""")
def h9_dedupe_refreshed(spark, d):
    s = _stream(spark, d).select("session_id", "event_id", "t")
    return S.run_available(S.dedupe(s, id="session_id", ttl="7200 seconds", refresh=True, tie="event_id")).select("event_id", "session_id")


@query(f"""WITH {LOG}, x AS (SELECT event_id, session_id, t, speaker || '-' || page % 5 AS id, row_number() OVER (PARTITION BY session_id ORDER BY t, speaker || '-' || page % 5) AS n FROM log),
    p AS (SELECT *, lag(n) OVER (PARTITION BY session_id, id ORDER BY n) AS before, lag(t) OVER (PARTITION BY session_id, id ORDER BY n) AS was FROM x),
    others AS (SELECT p.event_id, count(DISTINCT x.id) AS k FROM p JOIN x ON x.session_id = p.session_id AND x.n > p.before AND x.n < p.n GROUP BY p.event_id)
    SELECT event_id, session_id FROM p LEFT JOIN others USING (event_id) WHERE before IS NULL OR t - was >= 400000 OR coalesce(k, 0) >= 4""")
def h9_dedupe_capped(spark, d):
    """Kinds of event by user, each user's cache of four ids and 400,000 seconds."""
    s = _stream(spark, d).select("session_id", "event_id", "t", F.concat("speaker", F.lit("-"), (F.col("page") % 5).cast("string")).alias("id"))
    return S.run_available(C.dedupe_capped(s, scope="session_id", id="id", time="t", ttl=400_000, most=4)).select("event_id", "session_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def h10_accepted(spark, d):
    return S.run_available(S.split_late(_stream(spark, d), since=F.expr("TIMESTAMP '2024-01-10 00:00:00 UTC'"))[0]).select("event_id")


@query("SELECT 'stale' AS reason, count(*) AS count FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def h10_rejected(spark, d):
    return S.run_available(S.split_late(_stream(spark, d), since=F.expr("TIMESTAMP '2024-01-10 00:00:00 UTC'"))[1], mode="complete")


@query(f"""WITH {LOG}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 5 HOUR THEN 1 ELSE 0 END AS new FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT session_id, min(ts) AS start, count(*) AS n, list(event_id ORDER BY event_id) AS items FROM s GROUP BY session_id, k""")
def h11_debounce(spark, d):
    out = S.run_available(S.debounce(_stream(spark, d), key="session_id", gap="5 hours"), mode="complete")
    return out.select("session_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "items")


@query(f"""WITH {LOG}, g AS (SELECT *, speaker = 'error' AS alone, lag(t) OVER w AS before, lag(speaker = 'error') OVER w AS after_alone FROM log WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR alone OR after_alone OR t >= before + 18000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS later FROM g)
    SELECT session_id, min(t) AS t, count(*) AS n, list(event_id ORDER BY t, event_id) AS items FROM s GROUP BY session_id, k HAVING bool_or(alone) OR max(later) IS NOT NULL AND bool_and(later IS NOT NULL) OR max(t) + 18000 < (SELECT max(t) - 3600 FROM log)""")
def h11_debounce_bypass(spark, d):
    """Errors go at once; what is open at the end of the stream stays open."""
    s = _stream(spark, d).withColumn("alone", F.col("speaker") == "error")
    return S.run_available(S.debounce_with_bypass(s, key="session_id", gap_sec=18000, bypass="alone"))


@query(f"WITH {LOG} SELECT session_id, count(*) AS chunks, count(*) FILTER (triggered) AS triggered, round(avg(score) + 1e-9, 5) AS avg, min(score) AS min, max(score) AS max FROM log GROUP BY session_id")
def h13_session_summary(spark, d):
    return S.run_available(S.stream_session_summary(_stream(spark, d)), mode="complete").withColumn("avg", F.round(F.col("avg") + 1e-9, 5))


@query(f"WITH {LOG} SELECT session_id, greatest(1, least(50, arg_max(page, ts))) AS state FROM log GROUP BY session_id")
def h14_latest_state(spark, d):
    return S.run_available(S.latest_state(_stream(spark, d), key="session_id", state="page", lo=1, hi=50), mode="complete")


@query(f"""WITH {LOG}, x AS (SELECT session_id, event_id, t, speaker = 'purchase' AS reply FROM log), g AS (SELECT *, coalesce(sum(reply::INT) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM x),
    h AS (SELECT session_id, k, list(event_id ORDER BY t, event_id) FILTER (NOT reply) AS ids, max(event_id) FILTER (reply) AS event_id FROM g GROUP BY session_id, k)
    SELECT session_id, event_id, coalesce(ids[-5:], []) AS history FROM h WHERE event_id IS NOT NULL""")
def h15_pending_history(spark, d):
    """The last five events of each user that came since the purchase before, at each purchase."""
    s = _stream(spark, d).withColumn("reply", F.col("speaker") == "purchase")
    return S.run_available(C.pending_history(s, key="session_id", item="event_id", time="t", reply="reply", most=5))
