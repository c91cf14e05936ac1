"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Keys are ranges of ``BUCKETS`` buckets within each source; the bucket totals give distributed
prefix sums. A source's budget is spent on whole epochs first, then on its documents in key order: those in buckets before the one
where the budget ends are taken by comparing buckets, without a shuffle, and only the rows of that one bucket are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, cut, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
#: Key ranges a source: a bucket holds about one 4096th of a source's rows, also of one that has a third of all.
BUCKETS = 4096
MOST_EPOCHS = 3
#: Sources up to which their table of cuts is broadcast (some 100 bytes each); with more, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    row = docs.select(F.struct("*").alias("_row"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_row")[id_col].cast("string"), F.lit(""))).cast("binary"))
    out = row.select("_row", F.col("_row")[id_col].alias("_id"), F.col("_row")[source_col].cast("string").alias("_source"), word_count(text_or_empty(F.col("_row")[text_col])).alias("_size"), key.alias("_key"))
    return out.withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))


def source_targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``_source, source_size, target`` from rows of ``_source, _size``.

    Sources by code point, null last, take the weights in turn and share all words; targets stop at ``most`` times their source's
    size and the excess goes to the others by weight. In the order of cap over weight, once a source is below its cap all later
    ones are, and one level (words per weight) serves them. Works on one row a source.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    totals = totals.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), place).cast("long"))
    order = Window.orderBy(most * F.col("source_size") / F.col("w"), F.col("_source").asc_nulls_last())
    whole = Window.partitionBy()
    t = totals.withColumn("_n", F.row_number().over(order))
    before = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0)))
    t = t.withColumn("_weights", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("_capped", most * F.col("source_size") * F.col("_weights") <= F.col("w") * F.col("_left"))
    t = t.withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct("_n", "_left", "_weights"))).over(whole))
    target = F.when(F.col("_capped"), (most * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("_level._left")).cast("double") / F.col("_level._weights"))
    return t.select("_source", "source_size", target.alias("target"))


def _cuts(sizes: DataFrame, weights: tuple, most: int) -> DataFrame:
    """A row a source: its target, whole epochs, and the bucket in which the rest of its budget ends, with what is left for it there."""
    targets = source_targets(sizes, weights=weights, most=most)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_epochs", F.least(epochs, F.lit(most))).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    totals = sizes.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    along = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    ends = totals.alias("b").join(targets.alias("t"), F.col("b._source").eqNullSafe(F.col("t._source"))).where("_before <= _rest and _rest < _before + _sum")
    ends = ends.select(F.col("b._source").alias("_source"), F.col("_bucket").alias("_end"), (F.col("_rest") - F.col("_before")).alias("_room"))
    out = targets.alias("t").join(ends.alias("e"), F.col("t._source").eqNullSafe(F.col("e._source")), "left")
    return out.select(F.col("t._source").alias("_of"), "source_size", "target", "_epochs", F.coalesce("_end", F.lit(-1)).alias("_end"), F.coalesce("_room", F.lit(0)).alias("_room"))


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    told = rows.join(cuts, F.col("_source").eqNullSafe(F.col("_of")))
    whole = told.where("_bucket <> _end").withColumn("_more", F.when(F.col("_bucket") < F.col("_end"), F.col("_size")).otherwise(0))
    along = Window.partitionBy("_source").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    last = told.where("_bucket = _end").withColumn("_more", F.greatest(F.lit(0), F.least("_size", F.col("_room") - F.coalesce(F.sum("_size").over(along), F.lit(0)))))
    return whole.unionByName(last).withColumn("taken", (F.col("_epochs") * F.col("_size") + F.col("_more")).cast("long"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for every row of ``docs``.

    ``size`` counts words (null text: 0). ``taken`` counts the words that the mix takes, repeats counted: whole epochs, then whole
    documents in key order, then as many words of one last document as the budget still holds, so that a source's taken words are its
    rounded target exactly. No document gives more than ``most`` times its size. Equal keys (repeated ids) go in id order; the order of
    rows that repeat both is open and changes no total. A null source is a source. Empty documents take 0; an empty table gives none.
    Extra columns play no part.
    """
    sizes = cut(_keyed(docs, id_col, source_col, text_col, seed).drop("_row"))
    cuts = broadcast_if(cut(_cuts(sizes, weights, most)), BROADCAST_SOURCES)
    return _taken(sizes, cuts).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken", F.col("_source").alias("source"))


def _head(text: Column, words: Column) -> Column:
    """The first ``words`` words of ``text`` with the white space between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", length_col: str = "n_chars", weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each once for every epoch that takes it, none if nothing is taken.

    The one document a source at which the budget ends gives its first words only; where there is a column ``length_col`` it is set to
    the new length. Documents without words are kept once, as they cost no budget.
    """
    keyed = _keyed(docs, id_col, source_col, text_col, seed)
    sizes = cut(keyed.drop("_row"))
    cuts = broadcast_if(cut(_cuts(sizes, weights, most)), BROADCAST_SOURCES)
    rows = _taken(keyed, cuts)
    copies = (F.col("taken") + F.col("_size") - 1) / F.greatest("_size", F.lit(1))
    rows = rows.withColumn("_copies", F.when(F.col("_size") == 0, 1).otherwise(F.floor(copies)).cast("int")).where("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    words = F.col("taken") - (F.col("_copy") - 1) * F.col("_size")
    part = (words < F.col("_size")) & (F.col("_size") > 0)
    text = F.when(part, _head(F.col("_row")[text_col], words)).otherwise(F.col("_row")[text_col])
    fresh = {text_col: text}
    if length_col in docs.columns:
        fresh[length_col] = F.when(part, F.length(text).cast(docs.schema[length_col].dataType)).otherwise(F.col("_row")[length_col])
    return rows.select(*[fresh.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
