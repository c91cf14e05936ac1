"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled ``(level, key, place)``, so that every parent has a greater label than its children. A forward sweep visits the nodes
in label order: each sends its digest, addressed to its parent's label, into a priority queue, and what the queue delivers under a label
is all that a parent needs. The queue is external and Spark's own: messages are shuffled by label and sorted by child, spilling as they
must, and all labels of a level are the queue's least, so one delivery takes a whole level. A reversed sweep goes down the same labels:
a parent sends each child the suffix of its proof (the siblings on the way from there to the root). A level has a sixteenth of the rows
of the one below, groups have at most ``fan`` rows whatever the key, and no key's rows meet in one task.

Sources have a tree each; their roots, in order of source, are the leaves of one more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order, numbered

#: Children of a node at most.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value, so that fields can't run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256, in lower-case hex, of the fields put together."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _digests(children: Column) -> Column:
    return F.transform(children, lambda c: c["digest"])


def _deliver(nodes: DataFrame, fan: int, carried: Sequence[str]) -> DataFrame:
    """One delivery of the queue: the parents of ``key, idx, n, digest``, each with all of its children in order.

    ``n`` is the number of a key's nodes on the level. A key's lone node has nothing to be hashed with: its digest goes up as it is.
    """
    message = F.struct(F.col("idx").alias("at"), "digest", *carried)
    label = F.floor(F.col("idx") / fan).cast("long").alias("idx")
    got = nodes.groupBy("key", label).agg(F.first("n").alias("_below"), F.sort_array(F.collect_list(message)).alias("children"))
    digest = F.when(F.col("_below") == 1, F.col("children")[0]["digest"]).otherwise(F.sha2(F.array_join(_digests(F.col("children")), ""), 256))
    return got.select("key", "idx", F.ceil(F.col("_below") / fan).cast("long").alias("n"), (F.col("_below") == 1).alias("alone"), digest.alias("digest"), "children")


def forward(leaves: DataFrame, *, fan: int = FAN, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The levels over ``key, idx, n, digest``: parents with their children, up to one node a key. Columns ``carried`` stay in the leaves' messages.

    Each level is written before the next begins; there are as many as the largest key's rows have digits to the base ``fan``.
    """
    levels = [cut(_deliver(leaves, fan, carried))]
    while not (rising := levels[-1].where("n > 1")).isEmpty():
        levels.append(cut(_deliver(rising, fan, ())))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``key, digest``: the node that remains of every key."""
    out = levels[0].where("n = 1").select("key", "digest")
    for level in levels[1:]:
        out = out.union(level.where("n = 1").select("key", "digest"))
    return out


def backward(levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """The leaves' messages, each with ``proof``, from ``start``: ``key, mark, proof`` of every root.

    A proof is an array of what stands left and right of a node among its siblings, from its own level up. ``mark`` is passed on as it is.
    """
    reached = None
    for level in reversed(levels):
        told = level.where("n = 1").join(start, "key")
        if reached is not None:
            told = told.unionByName(level.where("n > 1").join(reached, ["key", "idx"]))
        child = told.select("key", "mark", "alone", "proof", _digests(F.col("children")).alias("_all"), F.posexplode("children").alias("_place", "child"))
        beside = F.struct(F.array_join(F.slice("_all", F.lit(1), F.col("_place")), "").alias("left"), F.array_join(F.slice("_all", F.col("_place") + 2, F.lit(1 << 20)), "").alias("right"))
        proof = F.when(F.col("alone"), F.col("proof")).otherwise(F.concat(F.array(beside), F.col("proof"))).alias("proof")
        reached = child.select("key", F.col("child.at").alias("idx"), "mark", "child", proof)
        if level is not levels[0]:
            reached = reached.drop("child")
    return reached


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", key_col: str = "source", fan: int = FAN, also: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof`` for every row of ``docs``, and the columns ``also`` computed from it.

    A leaf is the digest of the row's ``fields``; leaves of a source ascend by id (null first), and rows of one id by leaf digest, so
    that rows which repeat id and fields have equal leaves in neighbouring places, each with its own proof. A null source is a source of
    its own and comes first, before the empty one. A source's lone leaf is its subroot, and a lone subroot the root. Null and empty texts
    are fields like others and differ. Other columns, whatever their names, play no part. An empty table gives an empty result.
    """
    also = also or {}
    key = F.coalesce(F.concat(F.lit("s"), F.col(key_col).cast("string")), F.lit("")).alias("key")
    leaves = docs.select(key, F.col(id_col).alias("doc_id"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(k) for k, c in also.items()])
    placed = in_order(leaves, F.col("key").asc(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc())
    levels = forward(numbered(placed, "key"), fan=fan, carried=("doc_id", *also))
    tops = in_order(roots(levels).select(F.col("key").alias("_source"), "digest"), F.col("_source").asc())
    above = forward(numbered(tops.withColumn("key", F.lit("")), "key"), fan=fan, carried=("_source",))
    root = roots(above).select("digest").head()  # one row, of 64 characters
    start = docs.sparkSession.range(1).select(F.lit("").alias("key"), F.lit("").alias("mark"), F.array().cast(PROOF).alias("proof"))
    start = backward(above, start).select(F.col("child._source").alias("key"), F.col("child.digest").alias("mark"), "proof")
    told = backward(levels, start)
    return told.select("child.doc_id", F.col("child.digest").alias("leaf"), F.col("mark").alias("subroot"), F.lit(root["digest"] if root else "").alias("root"), "proof", *[F.col("child")[k].alias(k) for k in also])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, beside: F.sha2(F.concat(beside["left"], digest, beside["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level and left to right; of nothing where a leaf has none."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def verify_tampered(docs: DataFrame, *, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", key_col: str = "source", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, after tampering with the texts of some.

    Where 5 divides the unsigned crc32 of the id in decimal, A-Z of the text become lower case before its leaf is folded with the
    original siblings; ``verified`` tells whether that leads to the root. Rows with null ids are left alone. Edge cases as in
    :func:`manifest`.
    """
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(hit, leaf_digest([lower if c == text_col else F.col(c) for c in fields]))
    told = manifest(docs, fields=fields, id_col=id_col, key_col=key_col, fan=fan, also={"_changed": changed})
    told = told.withColumn("folded_root", fold(F.coalesce("_changed", "leaf"), F.col("proof")))
    return told.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
