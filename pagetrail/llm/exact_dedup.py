"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts, for every text's hash, how many rows set each of its two bits of a blocked Bloom filter, and keeps the bits that two
or more rows set. Counts are combined in each task first, so that what it sends are a few bytes for each of its distinct bits and no
rows. (Bitmaps of the tasks could be merged instead only with a pair of bitmaps for each bit of a row number, as an OR of bits can't tell
one row from two: more bytes.) Pass 2 tests each row against the kept bits. A row that fails the test has no equal and passes straight
through; only the others shuffle, where a SHA-256 of the whole text decides. A false positive costs a shuffled row and never changes a
result. The filter is sized from the number of rows, up to 128 MB; beyond some 67 million rows the hashes are dealt to as many parts as it
takes, each with a filter of its own, and rows are tested part after part. The report reads its rows' hashes and digests for that, which
are written by part; dropping rows reads whole rows once for each part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Bits of one block: what bitmap_construct_agg packs into one binary.
BLOCK_BITS = 1 << 15
#: Bits a row, of which a row sets two, and the largest filter.
BITS_A_ROW = 16
MOST_BITS = 1 << 30
#: Texts with a larger share of the rows than one in so many are joined by broadcast: there are fewer than that.
HOT = 10_000


#: Bits of the hash that choose a part: those between the block's and the positions'.
PART_SHIFT, MOST_PARTS = 15, 1 << 15


def parts_for(rows: int, most_bits: int = MOST_BITS) -> int:
    """Parts of the hashes, so that a filter of ``most_bits`` has BITS_A_ROW bits for each row of a part."""
    return min(MOST_PARTS, max(1, -(-BITS_A_ROW * rows // most_bits)))


def _part(h: Column, parts: int) -> Column:
    return (F.shiftrightunsigned(h, PART_SHIFT).bitwiseAND(F.lit(MOST_PARTS - 1)) % parts).cast("int")


def bits_for(rows: int) -> int:
    """Bits of a filter for so many rows: a power of two."""
    return min(MOST_BITS, max(BLOCK_BITS, 1 << (BITS_A_ROW * max(rows, 1) - 1).bit_length()))


def _bits(h: Column, blocks: int) -> Column:
    """A block, and two bit positions in it, from disjoint parts of one 64-bit hash."""
    at = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BLOCK_BITS - 1))
    return F.struct(h.bitwiseAND(F.lit(blocks - 1)).cast("int").alias("block"), at(30).cast("int").alias("b1"), at(46).cast("int").alias("b2"))


def repeated_bits(texts: DataFrame, *, filter_bits: int, text_col: str = "text") -> DataFrame:
    """Pass 1: ``block, bitmap`` of the bits that at least two rows set.

    Counts are combined before the shuffle, so that a text with a third of the rows sends a few rows a task. The result has at most
    ``filter_bits / 32768`` rows of 4096 bytes, ``filter_bits / 8`` bytes in all, however large the input: it can be broadcast.
    """
    if filter_bits < BLOCK_BITS or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two, 32768 at least")
    return _twice(texts.select(_bits(F.xxhash64(text_or_empty(text_col)), filter_bits // BLOCK_BITS).alias("h")))


def _twice(hit: DataFrame) -> DataFrame:
    bits = hit.select("h.block", F.explode(F.array_distinct(F.array("h.b1", "h.b2"))).alias("bit"))
    twice = bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) for i in range(8)]), bit % 8) > 0


def flag(rows: DataFrame, bits: DataFrame, h: Column, filter_bits: int) -> DataFrame:
    """``rows`` with ``_maybe``: false proves that the hash isn't in the filter. The filter has a fixed size and is broadcast."""
    hit = rows.withColumn("_h", _bits(h, filter_bits // BLOCK_BITS))
    joined = hit.join(F.broadcast(bits), F.col("_h.block") == bits["block"], "left")
    both = _is_set(F.col("bitmap"), F.col("_h.b1")) & _is_set(F.col("bitmap"), F.col("_h.b2"))
    return joined.select(*rows.columns, F.coalesce(both, F.lit(False)).alias("_maybe"))


def key_filter(keys: DataFrame, h: Column, filter_bits: int) -> DataFrame:
    """A filter that holds the hash of every row of ``keys``: ``block, bitmap``, of ``filter_bits / 8`` bytes at most."""
    bits = keys.select(_bits(h, filter_bits // BLOCK_BITS).alias("h"))
    bits = bits.select("h.block", F.explode(F.array("h.b1", "h.b2")).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap"))


def maybe_repeated(docs: DataFrame, bits: DataFrame, *, filter_bits: int, text_col: str = "text") -> DataFrame:
    """Pass 2: the rows of ``docs`` as a struct ``_row``, with ``_maybe``: false proves that no other row has this text."""
    rows = docs.select(F.struct("*").alias("_row"))
    return flag(rows, bits, F.xxhash64(text_or_empty(F.col("_row")[text_col])), filter_bits).select("_row", "_maybe")


def _sha(text: Column) -> Column:
    return F.sha2(text_or_empty(text), 256)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None, hot: int = HOT, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty, and empty texts equal each other. Of equal texts the largest id stays (null ids are smallest; ids that
    are null throughout give ``keep_id`` null and ``kept`` true). Rows that repeat both id and text are counted in ``group_size`` and
    share one decision. Other columns, whatever their names, play no part. An empty table gives an empty result. Texts with more than
    one row in ``hot`` meet their group by broadcast, so that no task gets all rows of such a text.
    """
    n = docs.count()
    parts, h = parts_for(n, most_bits), F.xxhash64(text_or_empty(text_col))
    filter_bits = filter_bits or min(most_bits, bits_for(-(-n // parts)))
    if parts == 1:
        bits = repeated_bits(docs, text_col=text_col, filter_bits=filter_bits)
        marked = maybe_repeated(docs, bits, text_col=text_col, filter_bits=filter_bits)
        rows = cut(marked.select(F.col("_row")[id_col].alias("doc_id"), _sha(F.col("_row")[text_col]).alias("text_sha256"), "_maybe"))
    else:
        told = docs.select(F.col(id_col).alias("doc_id"), _sha(F.col(text_col)).alias("text_sha256"), h.alias("_h"))
        told = cut(told.withColumn("_p", _part(F.col("_h"), parts)), by="_p")
        rows = _by_parts(told, F.col("_h"), parts, filter_bits, lambda part: part.select("doc_id", "text_sha256", "_maybe"))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    alone = rows.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = rows.where("_maybe")
    groups = cut(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    large = F.col("group_size") > max(1000, again.count() // hot)
    often = groups.where(large)  # fewer than ``hot`` rows
    told = again.join(F.broadcast(often), "text_sha256")
    rest = again.join(F.broadcast(often.select("text_sha256")), "text_sha256", "left_anti").join(groups.where(~large), "text_sha256")
    told = told.unionByName(rest)
    return alone.unionByName(told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")).select(*columns)


def _by_parts(rows: DataFrame, h: Column, parts: int, filter_bits: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``keep`` makes of the rows of each part (a column ``_p``), flagged by the part's own filter; a part is written before the next one's
    filter is broadcast."""
    out = None
    for p in range(parts):
        part = rows.where(F.col("_p") == p)
        bits = _twice(part.select(_bits(h, filter_bits // BLOCK_BITS).alias("h")))
        told = cut(keep(flag(part, bits, h, filter_bits)))
        out = told if out is None else out.unionByName(told)
    return out


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were: of equal texts the one with the largest id, and of rows that repeat
    both the one whose columns, written as JSON, have the largest SHA-256; rows that are equal throughout are one. Other edge cases as in
    :func:`exact_duplicates`. Of a text that repeats, a task sends one row on, however many it has."""
    n = docs.count()
    parts = parts_for(n, most_bits)
    filter_bits = filter_bits or min(most_bits, bits_for(-(-n // parts)))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_h", F.xxhash64(text_or_empty(F.col("_row")[text_col])))
    if parts == 1:
        marked = flag(rows, cut(_twice(rows.select(_bits(F.col("_h"), filter_bits // BLOCK_BITS).alias("h")))), F.col("_h"), filter_bits)
        return marked.where("not _maybe").select("_row.*").unionByName(_largest(marked, id_col, text_col))
    told = rows.withColumn("_p", _part(F.col("_h"), parts))
    stays = lambda part: part.where("not _maybe").select("_row.*").unionByName(_largest(part, id_col, text_col))
    return _by_parts(told, F.col("_h"), parts, filter_bits, stays)


def _largest(marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = F.col("_row")
    order = F.struct(row[id_col].alias("id"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("tie"))
    return marked.where("_maybe").groupBy(_sha(row[text_col])).agg(F.max_by("_row", order).alias("_row")).select("_row.*")
