"""Matching by words and by vectors, with ranks and confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import document_frequency, rarity_weight
from .tables import cut


def top_k(scored: DataFrame, *, by: list[str], score: str, k: int = 5, tie: list[str]) -> DataFrame:
    """The ``k`` best rows of each group, ties by ``tie`` ascending, with ``rank``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_margin(scored: DataFrame, *, by: list[str], score: str, tie: list[str], mode: str = "ratio") -> DataFrame:
    """Adds ``confidence`` from the two best scores of a group: their ratio (10 without a second), or min(top + difference, 1)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    second = F.lead(score).over(w)
    value = F.coalesce(F.when(second > 0, F.col(score) / second), F.lit(10.0)) if mode == "ratio" else F.least(2 * F.col(score) - F.coalesce(second, F.lit(0.0)), F.lit(1.0))
    return scored.withColumn("_c", value).withColumn("_n", F.row_number().over(w)).withColumn("confidence", F.first("_c").over(w)).drop("_c", "_n")


#: Words up to which a list of them is broadcast.
FEW = 200_000


def few(words: DataFrame, rows: int = FEW) -> DataFrame:
    """``words``, to be broadcast if there are at most ``rows`` of them."""
    return F.broadcast(words) if words.limit(rows + 1).count() <= rows else words


def _rarity_scores(asked: DataFrame, post: DataFrame, current: DataFrame | None) -> DataFrame:
    """``query_id, page, score`` of :func:`match_text`, all pages."""
    post = post.join(few(asked.select("word").distinct()), "word", "left_semi")  # other words are dropped before they shuffle
    weight = document_frequency(post).select("word", rarity_weight(F.col("df")).alias("weight"))
    hits = asked.select("query_id", "word").distinct().join(weight, "word").join(post, "word")
    scored = hits.groupBy("query_id", "page").agg(F.sum("weight").cast("double").alias("score"))
    if current is not None:
        scored = scored.join(current, "query_id", "left")
        boost = F.when(F.col("page") == F.col("current_page") + 1, 10.0).when(F.col("page") == F.col("current_page"), 2.0).otherwise(1.0)
        scored = scored.withColumn("score", F.col("score") * boost).drop("current_page")
    return scored


def match_text(asked: DataFrame, post: DataFrame, *, current: DataFrame | None = None, k: int = 5) -> DataFrame:
    """``query_id, page, score, confidence, rank``: sums of rarity weights of shared words, the next page times 10 and the current times 2
    where ``current`` (query_id, current_page) says so. One shuffle by word, one by query and page, one by query."""
    scored = _rarity_scores(asked, post, current)
    return top_k(with_margin(scored, by=["query_id"], score="score", tie=["page"]), by=["query_id"], score="score", k=k, tie=["page"])


def match_counts(asked: DataFrame, post: DataFrame, *, min_hits: int = 2, first_n: int | None = None) -> DataFrame:
    """Pages with ``min_hits`` shared words; confidence is the share of the query's (first) distinct words."""
    if first_n:
        asked = asked.where(F.col("pos") <= first_n)
    words = asked.select("query_id", "word").distinct()
    total = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = words.join(post, "word").groupBy("query_id", "page").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= min_hits)
    return hits.join(total, "query_id").select("query_id", "page", "hits", (F.col("hits") / F.col("n")).alias("confidence"))


def match_ngrams(transcripts: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of each transcript's distinct grams that a page holds: ``query_id, page, matched, total, score`` from ``gram`` rows."""
    asked = transcripts.select("query_id", "gram").distinct()
    total = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    met = asked.join(pages.select("page", "gram").distinct(), "gram").groupBy("query_id", "page").agg(F.count(F.lit(1)).alias("matched"))
    return met.join(total, "query_id").withColumn("score", F.col("matched") / F.col("total"))


def match_ngrams_ahead(transcripts: DataFrame, pages: DataFrame, current: DataFrame, *, look_ahead: int = 1) -> DataFrame:
    """The first page from ``current_page`` to ``look_ahead`` further that holds the most of a transcript's distinct grams.

    A row for each row of ``current`` (``query_id, current_page``): query_id, page, matched, total, score, where ``total`` counts every gram,
    repeats too, and the score is matched / total. Without a match, or without grams, it is the current page with a score of 0.
    """
    total = transcripts.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    ask = transcripts.select("query_id", "gram").distinct().join(current.select("query_id", "current_page"), "query_id")
    ask = ask.withColumn("page", F.explode(F.sequence("current_page", F.col("current_page") + look_ahead)))
    held = pages.select(F.col("page").cast(ask.schema["page"].dataType).alias("page"), "gram").distinct()
    met = ask.join(held, ["page", "gram"]).groupBy("query_id", "page").agg(F.count(F.lit(1)).alias("matched"))
    best = met.groupBy("query_id").agg(F.max_by(F.struct("page", "matched"), F.struct("matched", -F.col("page"))).alias("b"))
    out = current.select("query_id", "current_page").join(best, "query_id", "left").join(total, "query_id", "left")
    matched, n = F.coalesce("b.matched", F.lit(0).cast("long")), F.coalesce("total", F.lit(0).cast("long"))
    score = F.when(n > 0, matched / n).otherwise(0.0)
    return out.select("query_id", F.coalesce("b.page", "current_page").alias("page"), matched.alias("matched"), n.alias("total"), score.alias("score"))


def mapped_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``words`` with ``word`` replaced where the dictionary (``word, mapped``, a row a word) has one that isn't empty."""
    known = dictionary.where("mapped <> ''").select("word", F.col("mapped").alias("_mapped"))
    return words.join(known, "word", "left").withColumn("word", F.coalesce("_mapped", "word")).select(words.columns)


def grams_held(transcripts: DataFrame, pages: DataFrame, current: DataFrame) -> DataFrame:
    """``query_id, matches, total``: how many of a transcript's grams, repeats too, its current page holds; a row for each of ``current``."""
    n = transcripts.groupBy("query_id", "gram").agg(F.count(F.lit(1)).alias("_n"))
    total = n.groupBy("query_id").agg(F.sum("_n").alias("total"))
    ask = n.join(current.select("query_id", F.col("current_page").alias("page")), "query_id")
    held = pages.select(F.col("page").cast(ask.schema["page"].dataType).alias("page"), "gram").distinct()
    met = ask.join(held, ["page", "gram"]).groupBy("query_id").agg(F.sum("_n").alias("matches"))
    none = F.lit(0).cast("long")
    return current.select("query_id").join(met, "query_id", "left").join(total, "query_id", "left").select("query_id", F.coalesce("matches", none).alias("matches"), F.coalesce("total", none).alias("total"))


def window_weights(windows: DataFrame) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1 for the words of text windows (``page, window_index, word``), N counting windows."""
    n = windows.select("page", "window_index").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = windows.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("word", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


#: How far ahead windows are looked at: pages after the current one, normally and when the place was lost.
AHEAD, AHEAD_LOST = 3, 12


def score_windows(live: DataFrame, windows: DataFrame, current: DataFrame, *, resync: bool = False) -> DataFrame:
    """``query_id, page, window_index, matched_words, total_words, confidence`` of the windows ahead that match any live word.

    ``live`` has ``query_id, pos, word``, ``windows`` has ``page, window_index, word`` and ``current`` says ``query_id, current_page,
    current_window``. A live word counts each time that it was said, and matches a window that has a word which is equal, holds it, is
    held by it or is within two edits. Confidence is the share of the live words' weight that matches, in percent, times 0.5 on the next page
    and 0.8 on the current one, of which only windows from the current one on count. Queries without live words have no rows.
    """
    from .joins import fuzzy_join  # which takes this module's helpers

    windows = cut(windows.select("page", "window_index", "word").distinct())
    said = live.where(F.col("word") != "").groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))
    unseen = F.ln(windows.select("page", "window_index").distinct().count() + F.lit(1.0)) + 1
    said = cut(said.join(window_weights(windows), "word", "left").withColumn("idf", F.coalesce("idf", unseen)))
    whole = said.groupBy("query_id").agg(F.sum("n").alias("total_words"), F.sum(F.col("n") * F.col("idf")).alias("_all"))
    steps = F.sequence(F.col("current_page"), F.col("current_page") + (AHEAD_LOST if resync else AHEAD))
    ahead = current.select("query_id", "current_page", "current_window", F.explode(steps).alias("page"))
    near = windows.join(ahead.select("page").distinct(), "page", "left_semi")
    pairs = fuzzy_join(said.select("word"), near.select("word")).select(F.col("left_word").alias("word"), F.col("right_word").alias("_held"))
    asked = said.select("query_id", "word").join(pairs, "word")
    met = ahead.join(near.withColumnRenamed("word", "_held"), "page").where((F.col("page") != F.col("current_page")) | (F.col("window_index") >= F.col("current_window")))
    met = met.join(asked, ["query_id", "_held"]).select("query_id", "current_page", "page", "window_index", "word").distinct()
    got = met.join(said, ["query_id", "word"]).groupBy("query_id", "current_page", "page", "window_index").agg(F.sum("n").alias("matched_words"), F.sum(F.col("n") * F.col("idf")).alias("_got"))
    gap = F.col("page") - F.col("current_page")
    bias = F.when(gap == 1, 0.5).when(gap == 0, 0.8).otherwise(1.0)
    return got.join(whole, "query_id").select("query_id", "page", "window_index", "matched_words", "total_words", (100 * F.col("_got") / F.col("_all") * bias).alias("confidence"))


def match_windows(live: DataFrame, windows: DataFrame, current: DataFrame, *, resync: bool = False, digits: int = 9) -> DataFrame:
    """The best window of every row of ``current``: the first in order of page and window of those with the highest confidence, compared
    to ``digits`` places. Without a match it is the current one, with a confidence of 0."""
    scored = score_windows(live, windows, current, resync=resync)
    order = F.struct(F.round("confidence", digits), -F.col("page"), -F.col("window_index"))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("page", "window_index", "matched_words", "confidence"), order).alias("b"))
    total = live.where(F.col("word") != "").groupBy("query_id").agg(F.count(F.lit(1)).alias("total_words"))
    out = current.join(best, "query_id", "left").join(total, "query_id", "left")
    pick = lambda c, other: F.coalesce(F.col("b")[c], other)
    return out.select("query_id", pick("page", F.col("current_page")).alias("page"), pick("window_index", F.col("current_window")).alias("window_index"), pick("matched_words", F.lit(0)).cast("long").alias("matched_words"), F.coalesce("total_words", F.lit(0)).cast("long").alias("total_words"), pick("confidence", F.lit(0.0)).alias("confidence"))


def words_to_pages(recognized: DataFrame, post: DataFrame) -> DataFrame:
    """Pages of recognised words: matches times the sum of confidences over matches + 1."""
    met = recognized.join(post, "word").groupBy("obs_id", "page").agg(F.count(F.lit(1)).alias("matches"), F.avg("score").alias("avg_confidence"), F.sum("score").alias("_s"))
    return met.withColumn("score", F.col("matches") * F.col("_s") / (F.col("matches") + 1)).drop("_s")


#: Rows of a block of queries and of items, and of queries compared at once.
QUERY_BLOCK, ITEM_BLOCK, TILE = 4096, 32_768, 128


def _met(queries: DataFrame, items: DataFrame, work, told: str, *, more: tuple[str, ...] = ()) -> DataFrame:
    """``work(query ids, vectors, item ids, vectors)``, and the items' columns ``more``, for every block of queries with every block of items: both are dealt by a shuffle,
    so that neither is ever whole in a task, on the driver or in a broadcast. Rows without a vector play no part."""
    own = lambda x, cols: x.where("v is not null").select(*[F.col(c).alias(c) for c in cols])  # noqa: E731  # new names, as both may be one table
    q, i = own(queries, ("id", "v")), own(items, ("id", "v", *more))
    nq, ni = (max(1, -(-x.count() // size)) for x, size in ((q, QUERY_BLOCK), (i, ITEM_BLOCK)))
    names = [x.split()[0] for x in told.split(", ")]
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("a", place(nq)).withColumn("b", every(ni))
    i = i.withColumn("b", place(ni)).withColumn("a", every(nq))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        return work(left["id"].to_numpy(), np.stack(left["v"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), *(right[c].to_numpy() for c in more))

    return q.groupBy("a", "b").cogroup(i.groupBy("a", "b")).applyInPandas(run, told)


def score_templates(obs: DataFrame, templates: DataFrame, score, *, k: int = 5, digits: int = 6) -> DataFrame:
    """The ``k`` best words of each observation: ``obs_id, word, score, rank``, a word's score being its best template's.

    ``obs`` has ``id, v`` and ``templates`` has ``id, v, word, extra``; ``score(vectors, template vectors, extras)`` gives a matrix.
    All templates are compared, in dealt blocks, and only the ``k`` best words of each block shuffle. Ties go to the smaller word.
    """

    def work(ids, mat, item_ids, item_mat, words, extra):
        words = words.astype(str)
        order = np.lexsort((item_ids, words))
        words, item_mat, extra, rows = words[order], item_mat[order], extra[order], []
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        for at in range(0, len(ids), TILE):
            s = np.maximum.reduceat(score(mat[at : at + TILE], item_mat, extra).round(digits), first, axis=1)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows.append(pd.DataFrame({"obs_id": np.repeat(ids[at : at + TILE], best.shape[1]), "word": words[first][best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(rows)

    met = _met(obs, templates, work, "obs_id long, word string, score double", more=("word", "extra"))
    best = met.groupBy("obs_id", "word").agg(F.max("score").alias("score"))
    return top_k(best, by=["obs_id"], score="score", k=k, tie=["word"])


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    d, na, nb = a @ b.T, np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if metric == "cosine":
        return np.divide(d, na[:, None] * nb, out=np.zeros_like(d), where=(na[:, None] * nb) > 0)
    return 1 / (1 + np.sqrt(np.maximum(na[:, None] ** 2 + nb**2 - 2 * d, 0)))


def vector_topk(queries: DataFrame, items: DataFrame, *, k: int = 5, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """``query_id, item_id, score, rank``: all queries against all items (``id, v``), in blocks of matrix products of which only the ``k``
    best of each query shuffle. With ``digits`` scores are rounded before they are compared; ties go to the smaller item."""

    def work(ids, mat, item_ids, item_mat):
        order = np.argsort(item_ids, kind="stable")
        item_ids, item_mat, rows = item_ids[order], item_mat[order], []
        for at in range(0, len(ids), TILE):
            s = scores(mat[at : at + TILE], item_mat, metric)
            s = s if digits is None else s.round(digits)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + TILE], best.shape[1]), "item_id": item_ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(rows)

    return top_k(_met(queries, items, work, "query_id long, item_id long, score double"), by=["query_id"], score="score", k=k, tie=["item_id"])


def smallest_near(items: DataFrame, *, min_score: float) -> DataFrame:
    """``id, other``: the smallest smaller id within ``min_score`` (1 / (1 + Euclidean distance)), for items that have one. All pairs are
    compared in blocks and none is capped; a block passes on one row an item at most."""

    def work(ids, mat, item_ids, item_mat):
        order = np.argsort(item_ids, kind="stable")
        item_ids, item_mat, rows = item_ids[order], item_mat[order], []
        for at in range(0, len(ids), TILE):
            near = (scores(mat[at : at + TILE], item_mat, "l2").round(9) >= min_score) & (item_ids[None] < ids[at : at + TILE, None])
            hit = np.flatnonzero(near.any(1))
            rows.append(pd.DataFrame({"id": ids[at : at + TILE][hit], "other": item_ids[near[hit].argmax(1)]}))
        return pd.concat(rows)

    return _met(items, items, work, "id long, other long").groupBy("id").agg(F.min("other").alias("other"))


def best_self_match(asked: DataFrame, items: DataFrame) -> DataFrame:
    """For each asked item the most similar other item, and how many pages off it is."""
    near = vector_topk(asked, items, k=2, digits=9).where("item_id <> query_id").drop("rank")
    best = top_k(near, by=["query_id"], score="score", k=1, tie=["item_id"])
    pages = items.select(F.col("id").alias("item_id"), F.col("page").alias("best_page"))
    out = best.join(pages, "item_id").join(asked.select(F.col("id").alias("query_id"), "page"), "query_id")
    return out.select(F.col("query_id").alias("id"), "best_page", "score", F.abs(F.col("best_page") - F.col("page")).alias("page_error"))


def rarest_words(post: DataFrame, *, k: int = 3) -> DataFrame:
    df = document_frequency(post)
    w = Window.partitionBy("page").orderBy("df", "word")
    return post.join(df, "word").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("page", "word", "df", "rank")


def multi_signal_match(asked: DataFrame, post: DataFrame, signatures: DataFrame, *, current: DataFrame, k: int = 5) -> DataFrame:
    """Rarity matching with the learned next page, times 1 + the query's words among the page's rare ones (``page, word``)."""
    scored = _rarity_scores(asked, post, current)
    rare = asked.select("query_id", "word").distinct().join(signatures, "word").groupBy("query_id", "page").agg(F.count(F.lit(1)).alias("rare"))
    out = scored.join(rare, ["query_id", "page"], "left").withColumn("score", F.col("score") * (1 + F.coalesce("rare", F.lit(0)))).drop("rare")
    best = top_k(out, by=["query_id"], score="score", k=max(2, k), tie=["page"]).drop("rank")  # confidence takes the two best
    return top_k(with_margin(best, by=["query_id"], score="score", tie=["page"]), by=["query_id"], score="score", k=k, tie=["page"])
