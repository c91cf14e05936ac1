"""Decisions on scored candidates: transitions, triggers, the coordinator, robustness to noise, serial decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import scoring as S

from .matching import vector_topk


def apply_transitions(scored: DataFrame, edges: DataFrame, *, prev: str = "prev", default: float = 1e-5) -> DataFrame:
    """Scores times 1 + 10 times the probability of the step from the previous page; unseen steps have the default."""
    e = edges.select(F.col("from_page").alias(prev), F.col("to_page").alias("page"), "prob")
    out = scored.join(e, [prev, "page"], "left").withColumn("temporal_boost", S.temporal_boost(F.col("prob"), default=default))
    return out.withColumn("final_score", F.col("score") * F.col("temporal_boost"))


def trigger_match(tokens: DataFrame, *, last: int = 10, hits: int = 3, share: float = 0.6) -> DataFrame:
    """How many triggers occur in, or hold, one of the last words; enough of them suggest the next page (``ws``, ``triggers``)."""
    recent = F.slice("ws", F.greatest(F.lit(1), F.size("ws") - last + 1), F.lit(last))
    met = F.filter("triggers", lambda t: F.exists(F.col("_recent"), lambda r: r.contains(t) | t.contains(r)))
    out = tokens.withColumn("_recent", recent).withColumn("match_count", F.size(met)).withColumn("confidence", F.col("match_count") / F.greatest(F.size("triggers"), F.lit(1)))
    return out.withColumn("advance", (F.col("match_count") >= hits) | (F.col("confidence") >= share)).drop("_recent")


#: In percent, and matches: what one signal needs alone, and agreements in a row that turn a page.
FINGERPRINT, NGRAMS, TRIGGER, NGRAMS_ONLY, AGREEMENTS = 45.0, 2, 60.0, 20.0, 1


def coordinate(signals: DataFrame, *, by: str = "session_id", order: tuple[str, ...] = ("t", "event_id"), fingerprint: float = FINGERPRINT, ngrams: int = NGRAMS, trigger: float = TRIGGER, alone: float = NGRAMS_ONLY, agreements: int = AGREEMENTS) -> DataFrame:
    """``action`` (turn or hold), ``target_page``, ``reason`` and ``agreement`` of each row, from what three signals suggest.

    Rows have ``current_page``, the suggested ``trigger_page``, ``fp_page`` and ``ng_page`` (null: none), their confidences in percent
    (``trigger_confidence``, ``fp_confidence`` (null: no fingerprints at all), ``ng_confidence``) and ``ng_matches`` on the next page. Only the
    next page is ever turned to. The first rule that holds decides: a sure trigger; without fingerprints n-grams alone; a trigger that
    another signal confirms; both others agree, ``agreements`` times in a row; they differ (hold); a strong fingerprint; strong n-grams;
    else hold. A row of agreements ends where both hold or differ, or agree on another page.
    """
    nxt = F.col("current_page") + 1
    on = lambda c: F.coalesce(F.col(c) == nxt, F.lit(False))
    tr, fp, ng, sure = on("trigger_page"), on("fp_page"), on("ng_page"), F.coalesce(F.col("trigger_confidence"), F.lit(0.0)) >= trigger
    none, early = F.col("fp_confidence").isNull(), (tr & sure) | F.col("fp_confidence").isNull() | (tr & (fp | ng))
    both, differ = fp & ng, F.coalesce(F.col("fp_page") != F.col("ng_page"), F.lit(False))
    strong_fp, strong_ng = fp & (F.col("fp_confidence") >= fingerprint), ng & (F.coalesce(F.col("ng_matches"), F.lit(0)) >= 2 * ngrams)
    held = F.col("fp_page").isNull() & F.col("ng_page").isNull()
    # agreements in a row: counted from the last row that ends them, or that agrees on another page
    along = Window.partitionBy(by).orderBy(*order)
    out = signals.withColumn("_both", ~early & both).withColumn("_end", F.sum((~early & ~both & (differ | held)).cast("int")).over(along))
    last = F.last(F.when(F.col("_both"), nxt), ignorenulls=True).over(Window.partitionBy(by, "_end").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_other", (F.col("_both") & (F.coalesce(last, nxt) != nxt)).cast("int"))
    out = out.withColumn("_other", F.sum("_other").over(Window.partitionBy(by, "_end").orderBy(*order)))
    out = out.withColumn("_row", F.sum(F.col("_both").cast("int")).over(Window.partitionBy(by, "_end", "_other").orderBy(*order)))
    rules = [
        (tr & sure, True, "trigger_match", False),
        (none & ng & (F.coalesce(F.col("ng_confidence"), F.lit(0.0)) >= alone), True, "ngram_only_mode", False),
        (none, False, "ngram_only_insufficient", False),
        (tr & (fp | ng), True, "trigger_confirmed", True),
        (both & (F.col("_row") >= agreements), True, "both_agree", True),
        (both, False, "agreement_pending", True),
        (differ, False, "disagreement", False),
        (strong_fp, True, "fingerprint_strong", False),
        (strong_ng, True, "ngram_strong", False),
        (held, False, "both_hold", True),
    ]
    told = F.struct(F.lit(False).alias("turn"), F.lit("uncertain").alias("reason"), F.lit(False).alias("agreement"))
    for when, turn, reason, agrees in reversed(rules):
        told = F.when(when, F.struct(F.lit(turn).alias("turn"), F.lit(reason).alias("reason"), F.lit(agrees).alias("agreement"))).otherwise(told)
    out = out.withColumn("_told", told).withColumn("action", F.when(F.col("_told.turn"), "turn").otherwise("hold"))
    out = out.withColumn("target_page", F.when(F.col("_told.turn"), nxt)).withColumn("reason", F.col("_told.reason")).withColumn("agreement", F.col("_told.agreement"))
    return out.drop("_both", "_end", "_other", "_row", "_told")


def noise_sweep(fingerprints: DataFrame, *, levels: tuple[float, ...], seed: int) -> DataFrame:
    """``level, detected, correct``: page averages found again from vectors with hash noise of each level (share of each number)."""
    centre = fingerprints.select("page", F.posexplode("v").alias("i", "x")).groupBy("page", "i").agg(F.avg("x").alias("x")).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("ref"))
    kinds = len(levels)
    noisy = fingerprints.select("id", "page", "v", F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("_l", "level"))
    unit = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(10_000)) / 5_000 - 1
    noisy = noisy.withColumn("v", F.transform("v", lambda x, i: x * (1 + F.col("level") * unit(i)))).withColumn("id", F.col("id") * kinds + F.col("_l"))
    best = vector_topk(noisy.select("id", "v"), centre.select(F.col("page").alias("id"), F.col("ref").alias("v")), k=1, digits=9)
    told = noisy.select(F.col("id").alias("query_id"), "level", "page").join(best, "query_id")
    return told.groupBy("level").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("page") == F.col("item_id")).alias("correct"))


def sequential_decode(candidates: DataFrame, edges: dict[tuple[int, int], float], *, default: float = 1e-5) -> DataFrame:
    """The serial winner of each step of a recording: best ``score`` times the boost from the winner before it.

    ``candidates``: recording, step, page, score, a few pages a step. Steps of one recording depend on each other, so each recording is
    one group; recordings run in parallel. Ties go to the smaller page.
    """

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, prev = [], None
        for step, part in pdf.sort_values(["step", "page"]).groupby("step", sort=True):
            best = max(((s * (1 + 10 * edges.get((prev, int(p)), default)) if prev is not None else s, -int(p)) for p, s in zip(part["page"], part["score"], strict=True)))
            prev = -best[1]
            rows.append((pdf["recording"].iloc[0], step, prev, best[0]))
        return pd.DataFrame(rows, columns=["recording", "step", "page", "score"])

    return candidates.groupBy("recording").applyInPandas(decode, "recording long, step long, page int, score double")
