"""Merkle manifest against trees built one node at a time."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pagetrail.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(field, (row[0], row[3], row[2], row[4], text)))


def tree(digests, fan):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def way(levels, i, fan):
    out = []
    for level in levels[:-1]:
        a = i // fan * fan
        out.append((level[a:i], level[i + 1 : a + fan]))
        i //= fan
    return out


def expected(rows, fan=16):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {k: tree([leaf(r, r[1]) for r in by[k]], fan) for k in order}
    top = tree([trees[k][-1][0] for k in order], fan)
    out = []
    for j, k in enumerate(order):
        for i, r in enumerate(by[k]):
            steps = way(trees[k], i, fan) + way(top, j, fan)
            x = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                x = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in steps:
                x = h(*left, x, *right)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h(*(d for a, b in steps for d in a + b)), x, x == top[-1][0]))
    return out


def told(df):
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()]


@pytest.mark.parametrize("fan", [16, 3])
def test_manifest_equals_brute_force(spark, fan):
    rows = [(i, f"Text {i} É", "en", f"s{i % 3}", i) for i in range(300)] + [(1000 + i, f"A{i}", None, "alone", None) for i in range(1)]
    rows += [(None, None, None, None, None), (None, "X", "de", None, 1), (5, "", "", "", 0), (5, "", "", "", 0), (5, "Other", "fr", "s0", 2), (-3, "ÄB", "de", "ß", 2)]
    rows += [(7, "Same", "en", "s1", 4)] * 40 + [(-i, "Q", "en", f"one {i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("n", F.lit(1)).withColumn("root", F.lit("r")).repartition(5)
    key = lambda r: tuple(map(repr, r))
    assert sorted(told(m.verify_tampered(df, fan=fan)), key=key) == sorted(expected(rows, fan), key=key)


def test_small_tables(spark):
    assert m.verify_tampered(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, "Text", "en", "s", 4)]
    row = told(m.verify_tampered(spark.createDataFrame(one, SCHEMA)))
    assert row == expected(one) and row[0][1] == row[0][2] == row[0][3] and row[0][4] == h()


def test_proofs_fold_to_the_root(spark):
    rows = [(i, "x" * i * 1000, "en", f"s{i % 2}", i) for i in range(50)]
    got = m.manifest(spark.createDataFrame(rows, SCHEMA)).withColumn("again", m.fold(F.col("leaf"), F.col("proof"))).collect()
    assert {r["again"] for r in got} == {got[0]["root"]} and len(got) == 50


def test_no_key_meets_in_one_group(spark):
    """Groups are runs of ``fan`` nodes: the plan groups by key and place, never by key alone."""
    rows = [(i, "t", "en", "hot", 1) for i in range(400)]
    placed = spark.createDataFrame(rows, SCHEMA).select(F.col("source").alias("key"), "doc_id", F.lit("d").alias("digest"), F.col("doc_id").alias("idx"), F.lit(400).alias("n"))
    levels = m.forward(placed)
    assert [x.count() for x in levels] == [25, 2, 1] and max(len(r["children"]) for r in levels[0].collect()) == 16
