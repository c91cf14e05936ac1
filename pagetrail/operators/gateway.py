"""Conversation, log and retrieval analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import few, smallest_near, top_k, vector_topk
from .scans import carry, placed, reached, running_sum
from .tables import cut

# Names under which usage is logged.
USAGE_NAMES = {
    "input": ("input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens"),
    "output": ("output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
    "cache_read": ("cacheRead", "cache_read", "cache_read_input_tokens", "cached_tokens"),
    "cache_write": ("cacheWrite", "cache_write", "cache_creation_input_tokens"),
    "total": ("total", "totalTokens", "total_tokens"),
}


def normalize_usage(df: DataFrame, *, usage: str = "usage") -> DataFrame:
    """A map of usage numbers under any of their names as five columns; without a total, the sum of the others."""
    cols = {k: F.coalesce(*[F.col(usage)[n] for n in names]) for k, names in USAGE_NAMES.items()}
    parts = [F.coalesce(cols[k], F.lit(0)) for k in ("input", "output", "cache_read", "cache_write")]
    total = F.coalesce(cols["total"], parts[0] + parts[1] + parts[2] + parts[3])
    return df.select(*[c for c in df.columns if c != usage], *[cols[k].alias(k) for k in list(cols)[:4]], total.alias("total"))


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """The logged cost where it is there and not negative, else tokens times price per million, else null (prices are a small list)."""
    p = prices.select("provider", "model", *[F.col(c).alias(f"p_{c}") for c in ("input", "output", "cache_read", "cache_write")])
    x = usage.join(F.broadcast(p), ["provider", "model"], "left")
    priced = sum((F.coalesce(c, F.lit(0)) * F.col(f"p_{c}") for c in ("input", "output", "cache_read", "cache_write")), F.lit(0.0)) / 1e6
    return x.withColumn("cost_total", F.when(F.col("cost") >= 0, F.col("cost")).otherwise(priced)).drop(*[f"p_{c}" for c in ("input", "output", "cache_read", "cache_write")])


def daily_cost(usage: DataFrame, *, days: int, now: Column) -> DataFrame:
    """Tokens, cost and rows without a cost, by UTC day since ``now`` less ``days``, with a total row (null date)."""
    kept = usage.where(F.col("ts").isNotNull() & (F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")))
    return kept.withColumn("date", F.to_date("ts")).rollup("date").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_total"), F.lit(0.0)).alias("total_cost"), F.count_if(F.col("cost_total").isNull()).alias("missing_cost"))


def session_cost(usage: DataFrame) -> DataFrame:
    return usage.groupBy("session_id").agg(F.sum("total").alias("tokens"), F.sum("cost_total").alias("total_cost"), F.max("ts").alias("last_activity"))


def list_sessions(sessions: DataFrame, *, kind: str | None = None, search: str | None = None, active_minutes: int | None = None, limit: int | None = None, now: Column | None = None) -> DataFrame:
    """Sessions (``session_id, key, label, updated``) by filters, latest first; the kind is the key's first part."""
    s = sessions.withColumn("kind", F.element_at(F.split("key", ":"), 1))
    if kind:
        s = s.where(F.col("kind") == kind)
    if search:
        s = s.where(F.lower("label").contains(search.lower()) | F.lower("key").contains(search.lower()))
    if active_minutes is not None:
        s = s.where(F.col("updated") >= now - F.expr(f"INTERVAL {active_minutes} MINUTES"))
    return s.orderBy(F.desc("updated"), "session_id").limit(limit) if limit else s


def session_kind(key: Column, chat_type: Column) -> Column:
    """global, unknown, group (by chat type, or a group or channel in the key) or direct."""
    group = chat_type.isin("group", "channel") | key.contains(":group:") | key.contains(":channel:")
    return F.when(key.isin("global", "unknown"), key).when(F.coalesce(group, F.lit(False)), "group").otherwise("direct")


def filter_sessions(sessions: DataFrame, *, agent: str = "", label: str = "", spawned_by: str = "", search: str = "", active_minutes: float | None = None, limit: float | None = None, include_global: bool = False, include_unknown: bool = False, now: Column | None = None) -> DataFrame:
    """Sessions with their kind and name to display, latest first, by the filters that are set.

    ``sessions``: key, session_id, label, subject, display_name, origin_label, spawned_by, chat_type, updated. A key of an agent is
    ``agent:<id>:<rest>``; ids are compared without case. The global and the unknown session are left out unless asked for, and belong to
    no agent and no parent. A search looks into the name, label, subject, session id and key; blank filters are none. Minutes and limits
    are whole and at least 1. Sessions that were never updated come last and are not active. Ties go to the smaller key.
    """
    key, s = F.col("key"), sessions
    odd = key.isin("global", "unknown")
    for name, kept in (("global", include_global), ("unknown", include_unknown)):
        if not kept:
            s = s.where(key != name)
    if agent.strip():
        parts = F.split(key, ":")
        s = s.where((F.lower(parts[0]) == "agent") & (F.size(parts) > 2) & (F.lower(F.trim(F.get(parts, F.lit(1)))) == agent.strip().lower()))
    if spawned_by:
        s = s.where(~odd & (F.col("spawned_by") == spawned_by))
    if label.strip():
        s = s.where(F.col("label") == label.strip())
    s = s.withColumn("kind", session_kind(key, F.col("chat_type"))).withColumn("display_name", F.coalesce("display_name", "label", "origin_label"))
    if search.strip():
        fields = [F.coalesce(F.lower(F.col(c).cast("string")).contains(search.strip().lower()), F.lit(False)) for c in ("display_name", "label", "subject", "session_id", "key")]
        s = s.where(fields[0] | fields[1] | fields[2] | fields[3] | fields[4])
    if active_minutes is not None:
        s = s.where(F.col("updated") >= now - F.expr(f"INTERVAL {max(1, int(active_minutes // 1))} MINUTES"))
    order = [F.desc_nulls_last("updated"), F.asc("key")]
    return s.orderBy(*order).limit(max(1, int(limit // 1))) if limit is not None else s.orderBy(*order)


def title(text: Column, max_len: int) -> Column:
    """At most ``max_len`` characters, cut at the last space if that is beyond 60 % of them."""
    head = F.substring(text, 1, max_len)
    space = F.length(head) - F.length(F.regexp_extract(head, r"([^ ]*)$", 1))
    cut = F.when(space - 1 > 0.6 * max_len, F.rtrim(F.substring(head, F.lit(1), space - 1))).otherwise(head)
    return F.when(F.length(text) <= max_len, text).otherwise(F.concat(cut, F.lit("…")))


def session_titles(messages: DataFrame, *, max_len: int = 60) -> DataFrame:
    """Title from the first user message and preview of the last message of each conversation."""
    return messages.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first"), F.max_by("text", "turn").alias("last")).select("conv_id", title(F.col("first"), max_len).alias("title"), title(F.col("last"), max_len).alias("last_preview"))


def extract_text(content: Column) -> Column:
    """The text of content that is a JSON string, or an array of blocks whose first text block counts; else the content as it is."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (F.trim(b["text"]) != ""))
    return F.when(content.startswith("["), F.get(texts, F.lit(0))["text"]).otherwise(content)


def last_user_turns(messages: DataFrame, *, n: int) -> DataFrame:
    """Messages from the n-th last user message on."""
    after = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    m = messages.withColumn("_u", after)
    keep = (F.col("_u") < n) | ((F.col("_u") == n) & (F.col("role") == "user"))
    return m.where(keep).drop("_u")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up: a stand-in for a tokenizer."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def pack_by_tokens(messages: DataFrame, *, max_tokens: int, slices: int | None = None) -> DataFrame:
    """Messages of a conversation in order, packed greedily into chunks of at most ``max_tokens``; a larger one is a chunk of its own.

    Where a chunk that starts at a message would end follows from running sums alone; chunks are the chain of a conversation's first
    message. Of equal turns the smaller message goes first.
    """
    m = placed(messages.select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens")), "conv_id", ["turn", "tokens"], slices=slices)
    m = cut(carry(running_sum(m, "conv_id", F.col("tokens"), "_sum"), "conv_id", F.col("_at"), "_after", backward=True, inclusive=False))
    full = F.struct(F.col("_sum"), F.col("tokens"), F.col("_at").alias("at"), F.col("_after").alias("after"))
    ends = m.select("conv_id", F.col("_sum").alias("_x"), F.lit(0).alias("_kind"), F.col("_at").alias("_id"), F.lit(None).cast("long").alias("_before"), full.alias("_end"))
    before = F.col("_sum") - F.col("tokens")
    asked = m.select("conv_id", (before + max_tokens).alias("_x"), F.lit(1).alias("_kind"), F.col("_at").alias("_id"), before.alias("_before"), F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"))
    # the first message whose running sum is beyond the budget starts the next chunk, or ends this one if nothing but it is in it
    both = placed(ends.unionByName(asked), "conv_id", ["_x", "_kind", "_id"], slices=slices)
    found = carry(both, "conv_id", F.col("_end"), "_next", backward=True).where("_kind = 1")
    alone = F.col("_next._sum") - F.col("_next.tokens") <= F.col("_before")
    links = found.select(F.col("_id").alias("at"), F.when(alone, F.col("_next.after")).otherwise(F.col("_next.at")).alias("next"))
    heads = m.groupBy("conv_id").agg(F.min("_at").alias("at")).select("at", F.lit(True).alias("head"))
    starts = reached(links.join(heads, "at", "left").withColumn("head", F.coalesce("head", F.lit(False))))
    starts = starts.select(F.col("at").alias("_at"), F.lit(1).alias("_start"))
    out = running_sum(m.join(starts, "_at", "left"), "conv_id", F.col("_start"), "chunk")
    return out.select("conv_id", "turn", "tokens", (F.col("chunk") - 1).alias("chunk"))


def split_by_share(messages: DataFrame, *, parts: int = 2) -> DataFrame:
    """The part of each message: its middle's share of the conversation's tokens."""
    w = Window.partitionBy("conv_id")
    m = messages.withColumn("tokens", token_estimate(F.col("text")))
    before = F.coalesce(F.sum("tokens").over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tokens").over(w)
    return m.select("conv_id", "turn", F.when(total > 0, F.least(F.lit(parts - 1), F.floor(before * parts / total))).otherwise(0).cast("int").alias("part"))


def prune_to_budget(messages: DataFrame, *, max_tokens: int) -> DataFrame:
    """The newest messages whose tokens fit the budget, always the last one; older ones are only counted."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = messages.withColumn("tokens", token_estimate(F.col("text"))).withColumn("_s", F.sum("tokens").over(w)).withColumn("_n", F.row_number().over(w))
    keep = (F.col("_s") <= max_tokens) | (F.col("_n") == 1)
    return m.groupBy("conv_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"), F.sum(F.when(keep, F.col("tokens")).otherwise(0)).alias("kept_tokens"))


def adaptive_ratio(messages: DataFrame, *, context: int, base: float = 0.4, least: float = 0.15) -> DataFrame:
    """The share of a context that a chunk may take: smaller where the average message is large."""
    a = messages.groupBy("conv_id").agg((F.avg(token_estimate(F.col("text"))) * 1.2 / context).alias("a"))
    return a.select("conv_id", F.when(F.col("a") > 0.1, F.greatest(F.lit(least), base - F.least(2 * F.col("a"), F.lit(base - least)))).otherwise(base).alias("ratio"))


# The row that calls results, the row that has one, and the text of a result that was never stored.
ASSISTANT, RESULT = "assistant", "toolResult"
MISSING_RESULT = "[clawdbot] missing tool result in session history; inserted synthetic error result for transcript repair."


def _spans(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages with the number of their span (an assistant row and what follows it; 0 before the first); the spans' calls, each with its place
    and whether its id was called before; and results, each with whether its span calls it, calls it first, and has an earlier one."""
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "result_id", "text")
    rows = messages.withColumn("span", F.sum((F.col("role") == ASSISTANT).cast("long")).over(along))
    calls = rows.where(F.col("role") == ASSISTANT).select("conv_id", "span", F.posexplode("call_ids").alias("place", "id")).where("id is not null")
    seen = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("span", "place"))
    calls = calls.withColumn("first", seen == 1)
    own = calls.groupBy("conv_id", "span", "id").agg(F.max("first").alias("_first"))
    results = rows.where(F.col("role") == RESULT).select("conv_id", "span", F.col("result_id").alias("id"), "turn", "text")
    results = results.join(own, ["conv_id", "span", "id"], "left")
    nth = F.row_number().over(Window.partitionBy("conv_id", "span", "id").orderBy("turn", "text"))
    return rows, calls, results.withColumn("kept", F.coalesce("_first", F.lit(False)) & (nth == 1)).withColumn("called", F.col("_first").isNotNull())


def repaired_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, source_turn, role, result_id, text, synthetic``: conversations in which every call's result follows its assistant row.

    ``messages`` has ``conv_id, turn, role, call_ids, result_id, text``; ``call_ids`` (of assistant rows) and ``result_id`` (of tool results)
    may be null. A span is an assistant row and all rows up to the next. The first result of a called id in its span moves behind the
    assistant row, in order of the calls, and before the span's other rows; a call without one gets a synthetic result. An id that was
    called before gets no second result, and all other results go: repeats, those of no call of their span, and those without an id. New
    turns count from 0. Rows of one turn are taken by role, id and text; conversations without rows have none.
    """
    rows, calls, results = _spans(messages)
    kept = results.where("kept").select("conv_id", "span", "id", F.col("turn").alias("source_turn"), F.col("text").alias("_text"))
    answers = calls.where("first").join(kept, ["conv_id", "span", "id"], "left")
    known = F.col("_text").isNotNull() | F.col("source_turn").isNotNull()
    answers = answers.select("conv_id", "span", F.lit(1).alias("_group"), F.col("place").cast("long").alias("_place"), "source_turn", F.lit(RESULT).alias("role"), F.col("id").alias("result_id"), F.when(known, F.col("_text")).otherwise(F.lit(MISSING_RESULT)).alias("text"), (~known).alias("synthetic"))
    others = rows.where(F.col("role") != RESULT)
    group = F.when(F.col("role") == ASSISTANT, 0).otherwise(2)
    others = others.select("conv_id", "span", group.alias("_group"), F.lit(0).cast("long").alias("_place"), F.col("turn").alias("source_turn"), "role", F.lit(None).cast("string").alias("result_id"), "text", F.lit(False).alias("synthetic"))
    along = Window.partitionBy("conv_id").orderBy("span", "_group", "_place", "source_turn", "role", "text")
    return others.unionByName(answers).withColumn("turn", (F.row_number().over(along) - 1).cast("long")).select("conv_id", "turn", "source_turn", "role", "result_id", "text", "synthetic")


def repair_tool_results(messages: DataFrame) -> DataFrame:
    """``conv_id, added, duplicates, orphans, moved``: synthetic results, results dropped because their id has one already, results dropped because
    their span doesn't call them, and spans in which a result moves before other rows. Columns as in :func:`repaired_messages`."""
    rows, calls, results = _spans(messages)
    count = lambda when: F.coalesce(F.count_if(when), F.lit(0))
    told = results.groupBy("conv_id").agg(count(F.col("called") & ~F.col("kept")).alias("duplicates"), count(~F.col("called")).alias("orphans"), count("kept").alias("_kept"))
    asked = calls.groupBy("conv_id").agg(count("first").alias("_asked"))
    met = results.where("kept").select("conv_id", "span").distinct()
    rest = rows.where(~F.col("role").isin(ASSISTANT, RESULT)).select("conv_id", "span").distinct()
    moved = met.join(rest, ["conv_id", "span"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("moved"))
    out = messages.select("conv_id").distinct().join(told, "conv_id", "left").join(asked, "conv_id", "left").join(moved, "conv_id", "left").na.fill(0)
    return out.select("conv_id", (F.col("_asked") - F.col("_kept")).alias("added"), "duplicates", "orphans", "moved")


def token_chunks(df: DataFrame, *, id_col: str, text_col: str, tokens: int = 400, overlap: int = 80) -> DataFrame:
    """Chunks of words that overlap; the last chunk reaches the end."""
    w = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.col(text_col), F.lit(r"\S+"), F.lit(0)).alias("ws")).where(F.size("ws") > 0)
    last = F.greatest(F.lit(0), F.size("ws") - overlap - 1)
    c = w.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(tokens - overlap))))
    return c.select("id", (F.col("start") / (tokens - overlap)).cast("int").alias("chunk_no"), F.array_join(F.slice("ws", F.col("start") + 1, F.lit(tokens)), " ").alias("text"))


def vector_search(queries: DataFrame, items: DataFrame, *, k: int = 5, min_score: float = 0.5) -> DataFrame:
    """The k nearest items of each query by 1 / (1 + Euclidean distance), from ``min_score`` on; exact, in blocks."""
    return vector_topk(queries, items, k=k, metric="l2").where(F.col("score") >= min_score)


def bm25(asked: DataFrame, tokens: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, page, bm25``: term counts by page, document frequencies, lengths; distinct query words."""
    words = few(asked.select("word").distinct())
    tf = tokens.join(words, "word", "left_semi").groupBy("page", "word").agg(F.count(F.lit(1)).alias("tf"))  # asked words alone shuffle
    length = tokens.groupBy("page").agg(F.count(F.lit(1)).alias("len"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    x = asked.select("query_id", "word").distinct().join(df, "word").join(tf, "word").join(length, "page").join(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return x.groupBy("query_id", "page").agg(F.sum(part).alias("bm25"))


def hybrid_search(text_scores: DataFrame, vector_scores: DataFrame, *, k: int = 6, min_score: float = 0.35, weights: tuple[float, float] = (0.7, 0.3), multiplier: int = 4) -> DataFrame:
    """Vector and text candidates (k times 4 each) fused: 0.7 vector + 0.3 text, the text score from the place in BM25 order, 1 / (1 + place)."""
    t = top_k(text_scores, by=["query_id"], score="bm25", k=k * multiplier, tie=["page"]).select("query_id", "page", (1 / F.col("rank")).alias("t"))
    v = top_k(vector_scores, by=["query_id"], score="score", k=k * multiplier, tie=["page"]).select("query_id", "page", F.col("score").alias("v"))
    x = t.join(v, ["query_id", "page"], "full").withColumn("score", weights[0] * F.coalesce("v", F.lit(0.0)) + weights[1] * F.coalesce("t", F.lit(0.0)))
    return top_k(x.where(F.col("score") >= min_score), by=["query_id"], score="score", k=k, tie=["page"]).select("query_id", "page", "score", "rank")


# What marks a message as worth remembering, and its categories in order.
TRIGGERS = (
    r"zapamatuj si|pamatuj|remember", r"preferuji|radši|nechci|prefer", r"rozhodli jsme|budeme používat", r"\+\d{10,}", r"[\w.-]+@[\w.-]+\.\w+",
    r"můj\s+\w+\s+je|je\s+můj", r"my\s+\w+\s+is|is\s+my", r"i (like|prefer|hate|love|want|need)", r"always|never|important",
)
CATEGORIES = (("preference", r"prefer|radši|like|love|hate|want"), ("decision", r"rozhodli|decided|will use|budeme"), ("entity", r"\+\d{10,}|@[\w.-]+\.\w+|is called|jmenuje se"), ("fact", r"is|are|has|have|je|má|jsou"))
EMOJI = r"[\x{1F300}-\x{1F9FF}]"


def capture(messages: DataFrame, *, per_conversation: int = 3) -> DataFrame:
    """Messages of users worth remembering: 10 to 500 characters with a trigger, no recalled context, markup, list with bold text, or more
    than three emoji; with a category; the first three of each conversation."""
    text, low = F.col("text"), F.lower("text")
    listed = text.contains("**") & text.contains("\n-")
    good = F.length(text).between(10, 500) & ~text.contains("<relevant-memories>") & ~(text.startswith("<") & text.contains("</")) & ~listed & (F.regexp_count(text, F.lit(EMOJI)) <= 3)
    met = F.lit(False)
    for trigger in TRIGGERS:
        met = met | low.rlike(trigger)
    cat = F.lit("other")
    for name, words in reversed(CATEGORIES):
        cat = F.when(low.rlike(words), name).otherwise(cat)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.where((F.col("role") == "user") & good & met).withColumn("category", cat).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_conversation).select("conv_id", "turn", "category")


def near_duplicate_items(items: DataFrame, *, min_score: float = 0.95) -> DataFrame:
    """``id, duplicate_of``: the smallest id among all items whose score with this one reaches the minimum, if smaller than its own.

    A batch rule: unlike a serial store, an item can be a duplicate of one that is itself dropped.
    """
    return smallest_near(items, min_score=min_score).withColumnRenamed("other", "duplicate_of")


def delete_by_query(found: DataFrame, items: DataFrame, *, sure: float = 0.9) -> DataFrame:
    """``items`` without those that a query names for certain: its only hit (``query_id, item_id, score``), with a score above ``sure``."""
    single = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id"), F.max("score").alias("score"))
    gone = single.where((F.col("n") == 1) & (F.col("score") > sure)).select(F.col("item_id").alias("_gone")).distinct()
    return items.join(gone, F.col("id") == F.col("_gone"), "left_anti")


def parse_logs(lines: DataFrame) -> DataFrame:
    """``time, level, subsystem, message`` from JSON lines; what isn't JSON is dropped."""
    j = F.from_json("line", "time string, level string, subsystem string, message string", {"mode": "PERMISSIVE"})
    return lines.withColumn("j", j).where(F.col("j.time").isNotNull()).select("pos", "j.*")


def tail(lines: DataFrame, *, by: str, n: int = 500, max_bytes: int = 250_000) -> DataFrame:
    """The last ``n`` lines of each file within ``max_bytes``, the newest always."""
    w = Window.partitionBy(by).orderBy(F.desc("pos"))
    x = lines.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(F.octet_length("line") + 1).over(w))
    return x.where((F.col("_n") == 1) | ((F.col("_n") <= n) & (F.col("_b") <= max_bytes))).drop("_n", "_b")


def job_runs(runs: DataFrame, *, job_id=None, limit: int = 200) -> DataFrame:
    """The newest finished runs of each job, or of one."""
    ok = runs.where("action = 'finished'")
    ok = ok.where(F.col("job_id") == job_id) if job_id is not None else ok
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("run_id"))
    return ok.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def next_run(every_ms: Column, anchor_ms: Column, now_ms: Column) -> Column:
    """The first time after now that is a whole number of intervals after the anchor; the anchor itself if it is still to come."""
    steps = F.greatest(F.lit(1), F.ceil((now_ms - anchor_ms) / every_ms))
    return F.when(now_ms < anchor_ms, anchor_ms).otherwise(anchor_ms + steps * every_ms)


def pending_with_history(messages: DataFrame, *, n: int = 5, history: int = 20) -> DataFrame:
    """The n oldest pending messages, each with the first delivered messages of its conversation."""
    pend = messages.where("status = 'pending'").orderBy("created", "id").limit(n).select("conv_id", F.col("id").alias("pending_id"))
    w = Window.partitionBy("conv_id").orderBy("created", "id")
    done = messages.where("status = 'delivered'").join(F.broadcast(pend.select("conv_id").distinct()), "conv_id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= history)
    hist = done.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("history"))
    return pend.join(hist, "conv_id", "left").select("pending_id", F.coalesce("history", F.array().cast("array<long>")).alias("history"))


def cap_by_bytes(items: DataFrame, *, by: str, max_bytes: int) -> DataFrame:
    """The newest items (``pos, text``) whose bytes and separators fit, one at least."""
    w = Window.partitionBy(by).orderBy(F.desc("pos"))
    x = items.withColumn("_b", F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).over(w)).withColumn("_n", F.row_number().over(w))
    return x.where((F.col("_b") <= max_bytes) | (F.col("_n") == 1)).drop("_b", "_n")


def metrics_snapshot(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.groupBy("relay").pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0)


#: Upper bounds of a histogram's buckets; the last bucket has none.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def histograms(events: DataFrame, *, label: str, value: str, bounds: tuple = BOUNDS) -> DataFrame:
    """``label, count, sum, bucket_counts``: a histogram of the values of each label, a value in the first bucket whose bound it does not
    exceed. Null values are left out."""
    edges = [None, *bounds, None]
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col(value) > lo) & (F.lit(True) if hi is None else F.col(value) <= hi)
    counts = F.array(*[F.count_if(inside(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    return events.where(F.col(value).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), counts.alias("bucket_counts"))


def trim_tool_output(messages: DataFrame, *, head: int, tail_: int, max_chars: int) -> DataFrame:
    t = F.col("text")
    cut = F.concat(F.substring(t, 1, head), F.lit("\n…\n"), F.substring(t, -tail_, tail_))
    return messages.withColumn("text", F.when(F.length(t) > max_chars, cut).otherwise(t))


def clear_over_ratio(messages: DataFrame, *, window_chars: int, ratio: float) -> DataFrame:
    """The oldest tool outputs cleared until a conversation's characters are within the ratio of the window: a cut of a prefix sum."""
    w = Window.partitionBy("conv_id")
    m = messages.withColumn("_c", F.length(F.coalesce("text", F.lit(""))))
    over = F.sum("_c").over(w) - window_chars * ratio
    tool = F.when(F.col("role") == "assistant", F.col("_c")).otherwise(0)
    before = F.sum(tool).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.col("role") == "assistant") & (F.coalesce(before, F.lit(0)) < over)
    return m.withColumn("cleared", clear).drop("_c")


def cost_by_model(daily: DataFrame, *, days: int | None = None, today: Column | None = None) -> DataFrame:
    """Costs by model over ``date, breakdowns`` (array of model and cost), the last days only if given."""
    kept = daily.where(F.col("date") > F.date_sub(today, days)) if days else daily
    return kept.select(F.explode("breakdowns").alias("b")).where(F.col("b.cost").isNotNull() & F.col("b.model").isNotNull()).groupBy(F.col("b.model").alias("model")).agg(F.sum("b.cost").alias("total_cost"))


def current_model(daily: DataFrame) -> DataFrame:
    """The dearest model of the latest day that has a breakdown."""
    x = daily.select("date", F.explode("breakdowns").alias("b")).groupBy("date", F.col("b.model").alias("model")).agg(F.sum("b.cost").alias("cost"))
    return x.orderBy(F.desc("date"), F.desc("cost"), "model").limit(1).select("model", "date")


def latest_day_cost(daily: DataFrame, model: str) -> DataFrame:
    x = daily.select("date", F.explode("breakdowns").alias("b")).where(F.col("b.model") == model).groupBy("date").agg(F.sum("b.cost").alias("cost"))
    return x.orderBy(F.desc("date")).limit(1)


def session_log_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def tool_usage(messages: DataFrame) -> DataFrame:
    return messages.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("count"))


def search_messages(messages: DataFrame, phrase: str, *, role: str | None = None) -> DataFrame:
    hit = messages.where(F.lower("text").contains(phrase.lower()))
    return (hit.where(F.col("role") == role) if role else hit).select("conv_id", "turn", "text")


def sessionize(df: DataFrame, *, key: str, ts: str, idle_minutes: int | None = None, reset_hour: int = 4) -> DataFrame:
    """``session_no`` of each row: a new session after an idle gap, and after the daily reset hour (UTC)."""
    w = Window.partitionBy(key).orderBy(ts, *[c for c in ("event_id",) if c in df.columns])
    day = F.to_date(F.col(ts) - F.expr(f"INTERVAL {reset_hour} HOURS"))
    new = F.lag(ts).over(w).isNull() | (day != F.to_date(F.lag(ts).over(w) - F.expr(f"INTERVAL {reset_hour} HOURS")))
    if idle_minutes:
        new = new | (F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {idle_minutes} MINUTES"))
    return df.withColumn("_new", new.cast("int")).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def last_n(df: DataFrame, *, key: str, order: list, n: int = 50) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


