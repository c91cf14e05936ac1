"""Queries of conversation, log and retrieval analytics over conversations, events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.operators import gateway as G
from pagetrail.operators.matching import vector_topk
from pagetrail.operators.nearness import serial_near_duplicates

from .registry import query
from .tables import ASK, LOG, TOK, VEC, entries, messages, questions, table, tokens, vectors


def _usage(spark, d):
    """Line items as usage: every third under other names, some with a logged cost."""
    li = table(spark, d, "lineitem")
    q, t = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    names = F.when(t % 3 == 0, F.create_map(F.lit("input"), q, F.lit("output"), t)).when(t % 3 == 1, F.create_map(F.lit("prompt_tokens"), q, F.lit("completion_tokens"), t, F.lit("total_tokens"), q + t + 1)).otherwise(F.create_map(F.lit("inputTokens"), q, F.lit("cacheRead"), t))
    cost = F.when(F.col("l_tax") > 0.04, F.col("l_tax")).when(F.col("l_tax") == 0, F.lit(-1.0))
    return li.select(F.col("l_orderkey").alias("session_id"), "l_linenumber", F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), names.alias("usage"), cost.alias("cost"))


def _prices(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model")).distinct().where("provider <> 'R'").select("provider", "model", F.lit(1.0).alias("input"), F.lit(2.0).alias("output"), F.lit(0.5).alias("cache_read"), F.lit(0.25).alias("cache_write"))


_USE = """u0 AS (SELECT l_orderkey AS session_id, l_linenumber, l_shipdate AS ts, l_returnflag AS provider, l_linestatus AS model, CAST(l_quantity AS BIGINT) AS input, CASE WHEN l_linenumber % 3 <> 2 THEN l_linenumber::BIGINT END AS output,
    CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber::BIGINT END AS cache_read, NULL::BIGINT AS cache_write, CAST(l_quantity AS BIGINT) + l_linenumber + CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END AS total, CASE WHEN l_tax > 0.04 THEN l_tax WHEN l_tax = 0 THEN -1.0 END AS cost FROM lineitem),
    u AS (SELECT *, CASE WHEN cost >= 0 THEN cost WHEN provider <> 'R' THEN (input * 1.0::DOUBLE + coalesce(output, 0) * 2.0::DOUBLE + coalesce(cache_read, 0) * 0.5::DOUBLE) / 1e6 END AS cost_total FROM u0)"""


@query(f"WITH {_USE} SELECT session_id, l_linenumber, input, output, cache_read, cache_write, total FROM u")
def i1_normalize_usage(spark, d):
    return G.normalize_usage(_usage(spark, d)).select("session_id", "l_linenumber", "input", "output", "cache_read", "cache_write", "total")


def _costed(spark, d):
    return G.with_cost(G.normalize_usage(_usage(spark, d)), _prices(spark, d))


@query(f"WITH {_USE} SELECT session_id, l_linenumber, round(cost_total, 9) AS cost_total FROM u")
def i2_with_cost(spark, d):
    return _costed(spark, d).select("session_id", "l_linenumber", F.round("cost_total", 9).alias("cost_total"))


@query(f"WITH {_USE} SELECT CAST(ts AS DATE) AS date, coalesce(sum(total), 0)::BIGINT AS tokens, round(coalesce(sum(cost_total), 0), 4) AS total_cost, count(*) FILTER (cost_total IS NULL) AS missing_cost FROM u WHERE ts >= TIMESTAMP '2001-01-01' - INTERVAL 90 DAY GROUP BY ROLLUP (CAST(ts AS DATE))")
def i3_daily_cost(spark, d):
    out = G.daily_cost(_costed(spark, d), days=90, now=F.expr("TIMESTAMP_NTZ '2001-01-01'"))
    return out.withColumn("total_cost", F.round("total_cost", 4))


@query(f"WITH {_USE} SELECT session_id, sum(total)::BIGINT AS tokens, round(sum(cost_total), 3) AS total_cost, max(ts) AS last_activity FROM u GROUP BY session_id")
def i4_session_cost(spark, d):
    return G.session_cost(_costed(spark, d)).withColumn("total_cost", F.round("total_cost", 3))


@query("SELECT o_orderkey AS session_id, o_orderpriority AS label, o_orderdate AS updated FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'ur') AND o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 2000000 MINUTE ORDER BY updated DESC, session_id LIMIT 40")
def i5_list_sessions(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.concat_ws(":", "o_orderstatus", F.lit("x")).alias("key"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("updated"))
    return G.list_sessions(s, kind="O", search="ur", active_minutes=2_000_000, limit=40, now=F.expr("TIMESTAMP_NTZ '2000-06-01'")).select("session_id", "label", "updated")


@query("""WITH s AS (SELECT o_orderkey::VARCHAR AS session_id, o_orderpriority AS label, 'order of ' || o_custkey AS subject, o_orderdate AS updated, CASE WHEN o_custkey % 4 = 0 THEN 'group' END AS chat_type, 'customer' || o_custkey % 10 AS parent,
    CASE WHEN o_orderkey = 7 THEN 'global' ELSE 'agent:' || o_orderstatus || ':' || CASE WHEN o_orderkey % 3 = 0 THEN 'web:channel:' ELSE 'web:' END || o_orderkey END AS key FROM orders)
    SELECT key, CASE WHEN chat_type = 'group' OR contains(key, ':channel:') THEN 'group' ELSE 'direct' END AS kind, label AS display_name, updated FROM s
    WHERE key LIKE 'agent:O:%' AND parent = 'customer3' AND label = '2-HIGH' AND (contains(lower(label), '13') OR contains(subject, '13') OR contains(session_id, '13') OR contains(lower(key), '13')) AND updated >= TIMESTAMP '2000-06-01' - INTERVAL 2000000 MINUTE""")
def i5_filter_sessions(spark, d):
    text = lambda c: F.col(c).cast("string")
    rest = F.concat(F.lit("agent:"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, ":web:channel:").otherwise(":web:"), text("o_orderkey"))
    s = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") == 7, "global").otherwise(rest).alias("key"), text("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("order of "), text("o_custkey")).alias("subject"),
        F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("origin_label"), F.concat(F.lit("customer"), (F.col("o_custkey") % 10).cast("string")).alias("spawned_by"),
        F.when(F.col("o_custkey") % 4 == 0, "group").alias("chat_type"), F.col("o_orderdate").alias("updated"),
    )
    out = G.filter_sessions(s, agent="o", label=" 2-HIGH ", spawned_by="customer3", search="13", active_minutes=2_000_000, now=F.expr("TIMESTAMP_NTZ '2000-06-01'"))
    return out.select("key", "kind", "display_name", "updated")


_TITLE = "CASE WHEN length({t}) <= 60 THEN {t} ELSE (CASE WHEN 60 - length(regexp_extract(substr({t}, 1, 60), '([^ ]*)$', 1)) - 1 > 36 THEN rtrim(substr({t}, 1, 60 - length(regexp_extract(substr({t}, 1, 60), '([^ ]*)$', 1)) - 1), ' ') ELSE substr({t}, 1, 60) END) || '…' END"


@query(f"WITH m AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS f, arg_max(text, turn) AS l FROM conversations GROUP BY conv_id) SELECT conv_id, {_TITLE.format(t='f')} AS title, {_TITLE.format(t='l')} AS last_preview FROM m")
def i6_session_titles(spark, d):
    return G.session_titles(messages(spark, d), max_len=60)


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'only ' || role WHEN 1 THEN 'block ' || role END AS text FROM conversations")
def i7_extract_text(spark, d):
    r = F.col("role")
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    blocks = F.to_json(F.array(block("image", F.lit("")), block("text", F.concat(F.lit("block "), r))))
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("only "), r)).when(F.col("turn") % 3 == 1, blocks).otherwise("[]")
    return messages(spark, d).select("conv_id", "turn", G.extract_text(content).alias("text"))


@query("""WITH u AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role FROM u WHERE k < 2 OR (k = 2 AND role = 'user')""")
def i8_last_user_turns(spark, d):
    return G.last_user_turns(messages(spark, d), n=2).select("conv_id", "turn", "role")


_TOKENS = "ceil(length(coalesce(text, '')) / 4)::BIGINT"


@query(f"""WITH RECURSIVE m AS (SELECT conv_id, turn, {_TOKENS} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), r AS (SELECT conv_id, turn, tokens, n, 0 AS chunk, tokens AS used FROM m WHERE n = 1
    UNION ALL SELECT m.conv_id, m.turn, m.tokens, m.n, CASE WHEN r.used > 0 AND r.used + m.tokens > 300 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used > 0 AND r.used + m.tokens > 300 THEN m.tokens ELSE r.used + m.tokens END FROM r JOIN m ON m.conv_id = r.conv_id AND m.n = r.n + 1)
    SELECT conv_id, turn, tokens, chunk::BIGINT AS chunk FROM r""")
def i9_pack_by_tokens(spark, d):
    return G.pack_by_tokens(messages(spark, d), max_tokens=300)


@query(f"""WITH m AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations), s AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(t) OVER (PARTITION BY conv_id) AS a FROM m)
    SELECT conv_id, turn, CASE WHEN a > 0 THEN least(2, floor(b * 3 / a)) ELSE 0 END::INT AS part FROM s""")
def i9_split_by_share(spark, d):
    return G.split_by_share(messages(spark, d), parts=3)


@query(f"""WITH m AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations), s AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 300 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS k FROM m)
    SELECT conv_id, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS dropped, coalesce(sum(t) FILTER (k), 0)::BIGINT AS kept_tokens FROM s GROUP BY conv_id""")
def i9_prune_to_budget(spark, d):
    return G.prune_to_budget(messages(spark, d), max_tokens=300)


@query(f"WITH a AS (SELECT conv_id, avg({_TOKENS}) * 1.2 / 1000 AS a FROM conversations GROUP BY conv_id) SELECT conv_id, round(CASE WHEN a > 0.1 THEN greatest(0.15, 0.4 - least(2 * a, 0.25)) ELSE 0.4 END, 6)::DOUBLE AS ratio FROM a")
def i9_adaptive_ratio(spark, d):
    return G.adaptive_ratio(messages(spark, d), context=1000).withColumn("ratio", F.round("ratio", 6))


_CALLS = """m AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' AND length(text) % 3 > 0 THEN 'toolResult' ELSE role END AS role, CASE WHEN turn % 3 > 0 THEN ['c' || turn // 4, 'c' || (turn // 4 + 1)] ELSE [] END AS ids, 'c' || turn // 4 AS rid FROM conversations),
    r AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM m),
    c AS (SELECT conv_id, span, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM r WHERE role = 'assistant'),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY span, place) = 1 AS first FROM c),
    t AS (SELECT r.conv_id, r.span, rid AS id, turn, text, bool_or(first) AS opens, bool_or(f.id IS NOT NULL) AS called FROM r LEFT JOIN f ON f.conv_id = r.conv_id AND f.span = r.span AND f.id = rid WHERE role = 'toolResult' GROUP BY ALL),
    k AS (SELECT *, coalesce(opens, false) AND row_number() OVER (PARTITION BY conv_id, span, id ORDER BY turn) = 1 AS kept FROM t)"""


def _calls(spark, d):
    """Some user rows as tool results, and calls in some assistant rows."""
    turn, name = F.col("turn"), lambda n: F.concat(F.lit("c"), n.cast("long").cast("string"))
    ids = F.when(turn % 3 > 0, F.array(name(F.floor(turn / 4)), name(F.floor(turn / 4) + 1)))
    role = F.when((F.col("role") == "user") & (F.length("text") % 3 > 0), "toolResult").otherwise(F.col("role"))
    return messages(spark, d).select("conv_id", "turn", role.alias("role"), ids.alias("call_ids"), F.when(role == "toolResult", name(F.floor(turn / 4))).alias("result_id"), "text")


@query(f"""WITH {_CALLS}, o AS (SELECT f.conv_id, f.span, 1 AS g, f.place, turn AS source_turn, 'toolResult' AS role, f.id AS result_id, coalesce(text, '{G.MISSING_RESULT}') AS text, turn IS NULL AS synthetic
        FROM f LEFT JOIN (SELECT * FROM k WHERE kept) k ON k.conv_id = f.conv_id AND k.span = f.span AND k.id = f.id WHERE first
        UNION ALL SELECT conv_id, span, CASE role WHEN 'assistant' THEN 0 ELSE 2 END, 0, turn, role, NULL, text, false FROM r WHERE role <> 'toolResult')
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY span, g, place, source_turn) - 1 AS turn, source_turn, role, result_id, text, synthetic FROM o""")
def i10_repaired_messages(spark, d):
    return G.repaired_messages(_calls(spark, d))


@query(f"""WITH {_CALLS}, n AS (SELECT conv_id, count(*) FILTER (called AND NOT kept) AS duplicates, count(*) FILTER (NOT called) AS orphans, count(*) FILTER (kept) AS kept FROM k GROUP BY conv_id),
    a AS (SELECT conv_id, count(*) FILTER (first) AS asked FROM f GROUP BY conv_id),
    v AS (SELECT conv_id, count(DISTINCT span) AS moved FROM k SEMI JOIN (SELECT conv_id, span FROM r WHERE role NOT IN ('assistant', 'toolResult')) x USING (conv_id, span) WHERE kept GROUP BY conv_id)
    SELECT conv_id, coalesce(asked, 0) - coalesce(kept, 0) AS added, coalesce(duplicates, 0) AS duplicates, coalesce(orphans, 0) AS orphans, coalesce(moved, 0) AS moved
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN v USING (conv_id)""")
def i10_repair_tool_results(spark, d):
    return G.repair_tool_results(_calls(spark, d))


@query()
def i11_chunk_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"), limit=1000)).alias("chunk_no", "chunk"))


@query(r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS ws FROM documents), c AS (SELECT id, ws, unnest(range(0, greatest(0, len(ws) - 81) + 1, 320)) AS s FROM w WHERE len(ws) > 0) SELECT id, (s // 320)::INT AS chunk_no, array_to_string(ws[s + 1 : s + 400], ' ') AS text FROM c""")
def i11_token_chunks(spark, d):
    return G.token_chunks(table(spark, d, "documents"), id_col="doc_id", text_col="text")


@query(f"""WITH {VEC}, s AS (SELECT a.id AS query_id, b.id AS item_id, 1 / (1 + list_distance(a.v, b.v)) AS s FROM vec a, vec b WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INT AS rank FROM s) SELECT query_id, item_id, round(s, 5) AS score, rank FROM r WHERE rank <= 5 AND s >= 0.3""")
def i12_vector_search(spark, d):
    v = vectors(spark, d)
    return G.vector_search(v.where("id % 50 = 0"), v, k=5, min_score=0.3).withColumn("score", F.round("score", 5))


_BM = f"""{TOK}, {ASK}, tf AS (SELECT page, word, count(*) AS tf FROM tok GROUP BY ALL), ln_ AS (SELECT page, count(*) AS len FROM tok GROUP BY page), st AS (SELECT count(*) AS n, avg(len) AS al FROM ln_), d2 AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
    bm AS (SELECT query_id, page, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS bm25 FROM (SELECT DISTINCT query_id, word FROM ask) JOIN d2 USING (word) JOIN tf USING (word) JOIN ln_ USING (page), st GROUP BY query_id, page)"""


def _bm25(spark, d):
    return G.bm25(questions(spark, d), tokens(spark, d)).withColumn("bm25", F.round("bm25", 6))


@query(f"WITH {_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, page) AS n FROM bm) SELECT query_id, page, round(bm25 + 1e-9, 4) AS bm25 FROM r WHERE n <= 10")
def i13_bm25(spark, d):
    return G.last_n(_bm25(spark, d), key="query_id", order=[F.desc("bm25"), F.asc("page")], n=10).withColumn("bm25", F.round(F.col("bm25") + 1e-9, 4))


@query(f"""WITH {_BM}, {VEC}, t AS (SELECT query_id, page, 1.0 / n AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, page) AS n FROM bm) WHERE n <= 24),
    v AS (SELECT query_id, page, s AS v FROM (SELECT a.id AS query_id, b.id AS page, 1 / (1 + list_distance(a.v, b.v)) AS s, row_number() OVER (PARTITION BY a.id ORDER BY 1 / (1 + list_distance(a.v, b.v)) DESC, b.id) AS n FROM vec a, vec b WHERE a.id IN (SELECT item_id FROM benchmark)) WHERE n <= 24),
    x AS (SELECT query_id, page, round(0.7 * coalesce(v, 0) + 0.3 * coalesce(t, 0), 6)::DOUBLE AS score FROM t FULL JOIN v USING (query_id, page)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page)::INT AS rank FROM x WHERE score >= 0.35) SELECT * FROM r WHERE rank <= 6""")
def i13_hybrid_search(spark, d):
    v = vectors(spark, d)
    near = vector_topk(v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("id")).distinct(), "id", "left_semi"), v, k=24, metric="l2").select("query_id", F.col("item_id").alias("page"), "score")
    return G.hybrid_search(_bm25(spark, d), near).withColumn("score", F.round("score", 6))


@query(f"""WITH {VEC}, s AS (SELECT a.id, b.id AS o, 1 / (1 + list_distance(a.v, b.v)) AS s FROM vec a, vec b WHERE b.id < a.id) SELECT id, min(o) AS duplicate_of FROM s WHERE round(s, 9) >= 0.5 GROUP BY id""")
def i14_near_duplicates(spark, d):
    return G.near_duplicate_items(vectors(spark, d), min_score=0.5)


@query(f"""WITH RECURSIVE {VEC}, o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM vec),
    near AS (SELECT a.id, list(b.id) AS ids FROM vec a, vec b WHERE b.id < a.id AND round(1 / (1 + list_distance(a.v, b.v)), 9) >= 0.46 GROUP BY a.id),
    x AS MATERIALIZED (SELECT o.n, o.id, coalesce(near.ids, []) AS ids FROM o LEFT JOIN near USING (id)),
    r AS (SELECT n, id, [id] AS kept, NULL::BIGINT AS duplicate_of FROM x WHERE n = 1
        UNION ALL SELECT x.n, x.id, CASE WHEN len(list_intersect(r.kept, x.ids)) > 0 THEN r.kept ELSE list_append(r.kept, x.id) END, list_min(list_intersect(r.kept, x.ids)) FROM r JOIN x ON x.n = r.n + 1)
    SELECT id, duplicate_of FROM r WHERE duplicate_of IS NOT NULL""")
def i14_serial_near_duplicates(spark, d):
    return serial_near_duplicates(vectors(spark, d), min_score=0.46)


#: Users' turns with what people say about themselves put before some.
_SAID = "CASE turn % 8 WHEN 0 THEN concat('I prefer ', substr(text, 1, 60)) WHEN 2 THEN concat('always ', substr(text, 1, 60)) WHEN 4 THEN concat('We will use it, my plan is ', substr(text, 1, 60)) ELSE text END"
_MET = " OR ".join(f"regexp_matches(lower(text), '{x}')" for x in G.TRIGGERS)
_CATEGORY = " ".join(f"WHEN regexp_matches(t, '{x}') THEN '{name}'" for name, x in G.CATEGORIES)


@query(rf"""WITH m AS (SELECT conv_id, turn, role, {_SAID} AS text FROM conversations), g AS (SELECT conv_id, turn, lower(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m
        WHERE role = 'user' AND length(text) BETWEEN 10 AND 500 AND NOT contains(text, '<relevant-memories>') AND NOT (starts_with(text, '<') AND contains(text, '</')) AND NOT (contains(text, '**') AND contains(text, chr(10) || '-'))
            AND len(regexp_extract_all(text, '{G.EMOJI}')) <= 3 AND ({_MET}))
    SELECT conv_id, turn, CASE {_CATEGORY} ELSE 'other' END AS category FROM g WHERE n <= 3""")
def i15_capture(spark, d):
    return G.capture(messages(spark, d).withColumn("text", F.expr(_SAID)))


@query()
def i16_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '(password=)[^ \t\n\r\f\v]+', '\1***', 'g') AS text FROM documents")
def i16_redact_fixed(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact_fixed(F.col("text")).alias("text"))


@query(r"""SELECT page_id, l[1:3] AS links FROM (SELECT page_id, list_filter(regexp_extract_all(regexp_replace(url || ' see [x](http://a.b/c) and http://127.0.0.1/x ' || url || ' https://e.org/' || page_id, '\[[^\]]*\]\([^)]*\)', ' ', 'g'), 'https?://[^ \t\n\r\f\v<>"'']+'), lambda u: NOT contains(u, '://127.0.0.1')) AS l0, CASE WHEN len(l0) > 0 AND l0[1] = l0[2] THEN list_append(l0[1:1], l0[3]) ELSE l0 END AS l FROM pages)""")
def i17_extract_links(spark, d):
    u = F.col("url")
    text = F.concat(u, F.lit(" see [x](http://a.b/c) and http://127.0.0.1/x "), u, F.lit(" https://e.org/"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", T.extract_links(text).alias("links"))


def _log_lines(spark, d):
    e = entries(spark, d)
    js = F.to_json(F.struct(F.col("ts").cast("string").alias("time"), F.upper("speaker").alias("level"), F.col("session_id").cast("string").alias("subsystem"), F.concat(F.lit("value "), F.col("page").cast("string")).alias("message")))
    return e.select("session_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 10 == 0, "not json").otherwise(js).alias("line"), "page")


@query(f"WITH {LOG} SELECT event_id AS pos, upper(speaker) AS level, CAST(session_id AS VARCHAR) AS subsystem, 'value ' || page AS message FROM log WHERE event_id % 10 <> 0")
def i18_parse_logs(spark, d):
    return G.parse_logs(_log_lines(spark, d)).select("pos", "level", "subsystem", "message")


@query(f"""WITH {LOG}, l AS (SELECT session_id, event_id AS pos, repeat('x', 20 + page) AS line FROM log), r AS (SELECT *, row_number() OVER w AS n, sum(strlen(line) + 1) OVER w AS b FROM l WINDOW w AS (PARTITION BY session_id ORDER BY pos DESC)) SELECT session_id, pos FROM r WHERE n = 1 OR (n <= 30 AND b <= 1000)""")
def i18_tail(spark, d):
    lines = _log_lines(spark, d).withColumn("line", F.expr("repeat('x', 20 + page)"))
    return G.tail(lines, by="session_id", n=30, max_bytes=1000).select("session_id", "pos")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey AS job_id, o_orderkey AS run_id, o_orderdate AS ts FROM r WHERE n <= 3")
def i19_job_runs(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("started").alias("action"))
    return G.job_runs(r, limit=3).select("job_id", "run_id", "ts")


@query("SELECT o_orderkey, CASE WHEN 500000 < o_custkey * 1000 THEN o_custkey * 1000 ELSE o_custkey * 1000 + greatest(1, ceil((500000 - o_custkey * 1000) / (o_orderkey % 900 + 100)))::BIGINT * (o_orderkey % 900 + 100) END AS next_ms FROM orders")
def i19_next_run(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.next_run(F.col("o_orderkey") % 900 + 100, F.col("o_custkey") * 1000, F.lit(500000)).alias("next_ms"))


@query("""WITH m AS (SELECT o_custkey AS conv_id, o_orderkey AS id, o_orderdate AS created, o_orderstatus AS s FROM orders), p AS (SELECT conv_id, id FROM m WHERE s = 'P' ORDER BY created, id LIMIT 5),
    h AS (SELECT conv_id, id, created, row_number() OVER (PARTITION BY conv_id ORDER BY created, id) AS n FROM m WHERE s = 'F') SELECT p.id AS pending_id, coalesce((SELECT list(h.id ORDER BY h.n) FROM h WHERE h.conv_id = p.conv_id AND h.n <= 20), []) AS history FROM p""")
def i20_pending(spark, d):
    s = F.col("o_orderstatus")
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.when(s == "P", "pending").when(s == "F", "delivered").otherwise("processing").alias("status"))
    return G.pending_with_history(m)


@query("WITH r AS (SELECT conv_id, turn, sum(strlen(coalesce(text, '')) + 1) OVER w AS b, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn FROM r WHERE b <= 1500 OR n = 1")
def i21_cap_by_bytes(spark, d):
    return G.cap_by_bytes(messages(spark, d).withColumn("pos", F.col("turn")), by="conv_id", max_bytes=1500).select("conv_id", "turn")


@query("SELECT user_id AS relay, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def i22_metrics_snapshot(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("relay"), F.col("event_type").alias("kind"))
    return G.metrics_snapshot(e, ["click", "view", "error"])


@query("""WITH e AS (SELECT event_type AS label, value FROM events WHERE value IS NOT NULL), b AS (SELECT unnest([-1e300, 0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]) AS lo, unnest([0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000, 1e300]) AS hi),
    c AS (SELECT label, lo, count(*) FILTER (value > lo AND value <= hi) AS n FROM e, b GROUP BY label, lo), h AS (SELECT label, list(n ORDER BY lo) AS bucket_counts FROM c GROUP BY label)
    SELECT label, count(*) AS count, round(sum(value), 2) AS sum, any_value(bucket_counts) AS bucket_counts FROM e JOIN h USING (label) GROUP BY label""")
def i22_duration_histograms(spark, d):
    return G.histograms(table(spark, d, "events"), label="event_type", value="value").withColumn("sum", F.round("sum", 2))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 100) || chr(10) || '…' || chr(10) || right(text, 50) ELSE text END AS text FROM conversations")
def i23_trim_tool_output(spark, d):
    return G.trim_tool_output(messages(spark, d), head=100, tail_=50, max_chars=200).select("conv_id", "turn", "text")


@query("""WITH m AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS c FROM conversations), s AS (SELECT *, sum(c) OVER (PARTITION BY conv_id) - 1500 AS over_, coalesce(sum(CASE WHEN role = 'assistant' THEN c ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m)
    SELECT conv_id, turn, role = 'assistant' AND b < over_ AS cleared FROM s""")
def i23_clear_over_ratio(spark, d):
    return G.clear_over_ratio(messages(spark, d), window_chars=3000, ratio=0.5).select("conv_id", "turn", "cleared")


def _daily(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("cost"))).alias("breakdowns"))


@query("SELECT o_orderpriority AS model, round(sum(o_totalprice), 2) AS total_cost FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2000-01-01' - 365 GROUP BY o_orderpriority")
def i24_cost_by_model(spark, d):
    return G.cost_by_model(_daily(spark, d), days=365, today=F.expr("DATE '2000-01-01'")).withColumn("total_cost", F.round("total_cost", 2))


@query("WITH x AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS model, sum(o_totalprice) AS c FROM orders GROUP BY ALL) SELECT model, date FROM x ORDER BY date DESC, c DESC, model LIMIT 1")
def i24_current_model(spark, d):
    return G.current_model(_daily(spark, d))


@query("SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS cost FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def i24_latest_day_cost(spark, d):
    return G.latest_day_cost(_daily(spark, d), "5-LOW").withColumn("cost", F.round("cost", 2))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def i25_session_log_stats(spark, d):
    return G.session_log_stats(messages(spark, d))


@query("SELECT unnest([role, 'tool' || turn % 4]) AS tool, count(*) AS count FROM conversations GROUP BY 1")
def i25_tool_usage(spark, d):
    return G.tool_usage(messages(spark, d).select(F.array("role", F.concat(F.lit("tool"), (F.col("turn") % 4).cast("string"))).alias("tools")))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'the')")
def i25_search_messages(spark, d):
    return G.search_messages(messages(spark, d), "The", role="assistant")


@query("""WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), n AS (SELECT *, CASE WHEN p IS NULL OR CAST(ts - INTERVAL 4 HOUR AS DATE) <> CAST(p - INTERVAL 4 HOUR AS DATE) OR ts > p + INTERVAL 600 MINUTE THEN 1 ELSE 0 END AS new FROM e)
    SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM n""")
def h12_sessionize(spark, d):
    return G.sessionize(table(spark, d, "events"), key="user_id", ts="ts", idle_minutes=600).select("event_id", "session_no")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def h15_last_n(spark, d):
    return G.last_n(table(spark, d, "events"), key="user_id", order=[F.desc("ts"), F.desc("event_id")], n=50).select("user_id", "event_id")
