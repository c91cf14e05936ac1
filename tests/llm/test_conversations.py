"""Conversation repair against a brute-force search over edits."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from pagetrail.llm import conversations as c


@pytest.fixture(autouse=True, scope="module")
def ranges(spark):
    """Small tables keep all ranges, so that long conversations are cut into chunks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


sys.setrecursionlimit(40_000)
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """The cheapest edits of ``(initial, fault)`` rows and of equal ones the least letters, by trying all."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        out = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if inserted < 2:
            for r in "ua":
                if (last, r) in follows:
                    cost, rest = best(i, r, inserted + 1)
                    out.append((cost + 5, "I" + rest))
        if i < len(rows):
            initial, fault = rows[i]
            cost, rest = best(i + 1, last, 0)
            out.append((cost + 2, "D" + rest))
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                if (last, initial) in follows:
                    cost, rest = best(i + 1, initial, 0)
                    out.append((cost + more, "K" + rest))
                for r in "ua":
                    if (last, r) in follows:
                        cost, rest = best(i + 1, r, 0)
                        out.append((cost + 1 + more, "R" + rest))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def expected(rows):
    """The contract's columns for the damaged rows of one conversation, in order."""
    space = " \t\n\v\f\r"
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(space)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "k")
        seen.add((role, text))
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in rows]
    cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
    turns = [t for t, _, _ in rows if t is not None]
    kept, i = [], 0
    for letter in audit:
        due = "user" if not kept or kept[-1][0][0] in "sa" else "assistant"
        if letter == "I":
            kept.append((due, ""))
            continue
        if letter != "D":
            kept.append((rows[i][1] if letter == "K" else due, rows[i][2]))
        i += 1
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k[0]) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost if rows else 0, "audit": audit if rows else "",
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def rows_of(seed, convs, most):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(convs)]:
        turn = rng.randint(-2, 2)
        for _ in range(rng.randint(1, most)):
            text = rng.choice(["a.", "b!", "c", " \n", "", None, "long text? ", "zwölf é.", f"t{rng.random()}."])
            out.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return out


@pytest.mark.parametrize(("seed", "convs", "most"), [(1, 40, 9), (2, 3, 60), (3, 0, 500)])
def test_repair_equals_brute_force(spark, seed, convs, most):
    rows = rows_of(seed, convs, most)
    # in as many ranges as the session has shuffle partitions, so that the long conversations are cut into chunks
    df = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit(1)).withColumn("at", F.lit("x"))
    got = {r["conv_id"]: r.asDict() for r in c.repair_damaged(df.repartition(3)).collect()}
    by = {r[0]: [] for r in rows}
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == {"conv_id": conv, **expected(in_order(own))}


def test_chunks_of_one_conversation(spark):
    """A conversation over several ranges: chunks are cut, and the result doesn't change."""
    rows = [(7, i, random.Random(i).choice(["user", "assistant", "system"]), f"text {i % 90}{'.' if i % 7 else ''}") for i in range(600)]
    repair = c.Repair(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert repair.chunks.count() > 1
    got = repair.rows().orderBy("at", "step").collect()
    want = expected(in_order([r[1:] for r in rows]))
    assert "".join(r["edit"] for r in got) == want["audit"] and sum(r["cost"] for r in got) == want["cost"]
    kept = [f"{r['role']}:{r['text']}" for r in got if r["edit"] != "D"]
    assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == want["repaired_sha256"]
    assert repair.report().head().asDict() == {"conv_id": 7, **{k: want[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")}}


def test_powers_and_runs():
    for symbol in ("uk", "ak", "sk", "ok", "ut", "at", "ub", "sd", "ot"):
        v = c.END
        for n in range(1, 40):
            v = c.step(symbol, v)
            assert c.applied(c.run_matrix(symbol, n, c.UNIT), c.END) == v
    assert c.collapsed(iter(["uk", "uk", "ak"])) == [("uk", 2), ("ak", 1)]


def test_no_rows_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair_damaged(empty).count() == 0
    conv = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = c.repair_damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)).head().asDict()
    assert row == {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_long_runs_and_texts(spark):
    """One long run is advanced by powers; a very long text passes through."""
    rows = [(1, i, "user", f"{i}.") for i in range(3000)] + [(2, 0, "user", "x" * 3_000_000 + ".")]
    got = {r["conv_id"]: r for r in c.repair_damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    by = {1: [], 2: []}
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    assert got[2].asDict() == {"conv_id": 2, **expected(by[2])}
    runs = c.collapsed(iter(["uk"] * 2_000))
    assert c.costs_at(runs, c.END)[0][0] == cheapest((("u", "k"),) * 200)[0] * 10
    assert got[1]["duplicate"] > 0 and len(got[1]["audit"]) >= len(by[1])
