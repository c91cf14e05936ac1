"""Personal data: base spans against the plain patterns, and planted spans that only the model can find."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetrail.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, own):
    digits = re.sub("[^0-9]", "", own)
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or (kind == "phone" and 10 <= len(digits) <= 15) or (kind == "ip" and all(int(x) <= 255 for x in own.split(".")))


def plain(text):
    found = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
    return [(pii.KINDS[k], lo, hi) for lo, k, hi in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", "@", ".", "-", "+", "1", "25", "256", "0001", " ", "(", ")", "é", "_", "%", "a@b.c", "4111 1111 1111 1111", "1.2.3.4", "+49 30 1234567", "x@y", "\n"]), max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 100_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, "(" * 100_000, " at" * 60_000, "a" * 100_000 + "@b"])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.base_spans(text), pii.proposals(text)
    assert time.time() - began < 8


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + str(x) for x in range(10) if valid("card", d + str(x)))

    def span():
        return rng.choice([f"{word()}.{digits(2)}@mail{rng.randint(0, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card(), f"+1 ({digits(3)}) 555-{digits(4)}", digits(16), f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(5)}"])

    return [(i, " ".join([word() for _ in range(20)] + [span()] + [word() for _ in range(10)] + [span()] * rng.randint(0, 1))) for i in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus(1, 700)
    planted = {1000: "write to peter.22 [at] mail4 [dot] example [dot] com today", 1001: "here 83[.]12[.]7[.]200 answers", 1002: "so call 00 1 (415) 555-2671 now", 1003: "paid by 4111.1111.1111.1111 then"}
    clean = {2000: "Licensed under version 2.0 of the licence, on 12.10.2024 at 17:30", 2001: "in 1999 the 300 men of 20 towns", 2002: "paid by 4111.1111.1111.1112 then", 2003: "", 2004: None}
    rows += [*planted.items(), *clean.items(), (None, "mail a@b.co"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "'x' AS kind")
    return rows, {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}, df, planted, clean


def test_model_adds_what_rules_miss(found):
    rows, got, _, planted, clean = found
    assert all(len(got[i]["added"]) == 1 and got[i]["base"] == [] for i in planted), {i: got[i]["added"] for i in planted}
    assert got[1000]["redacted"] == "write to <EMAIL> today" and got[1001]["redacted"] == "here <IP> answers"
    assert not any(got[i]["added"] or got[i]["base"] for i in clean)
    assert got[2003]["redacted"] == got[2004]["redacted"] == "" and got[None]["redacted"] == "mail <EMAIL>"


def test_base_spans_stay(found):
    rows, got, df, _, _ = found
    for i, text in rows:
        assert [(s["kind"], s["start"], s["stop"]) for s in got[i]["base"]] == plain(text or "")
    told = {r["doc_id"]: r for r in pii.personal_data_digests(df).collect()}
    for i, r in told.items():
        every = sorted([*got[i]["base"], *got[i]["added"]], key=lambda s: (s["start"], pii.KINDS.index(s["kind"])))
        assert r["spans"] == ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in every) and r["n_added"] == len(got[i]["added"])


def test_without_examples_nothing_is_added(spark):
    df = spark.createDataFrame([(1, "00 1 (415) 555-2671"), (2, "a@b.co")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert got[1]["added"] == [] and len(got[2]["base"]) == 1
    assert pii.personal_data_digests(df.limit(0)).count() == 0


def test_fit_reads_every_row_and_every_example_of_a_text(spark):
    rows = spark.range(6500).selectExpr("id AS doc_id", "concat('call +1 415 ', 1000000 + id) AS text")
    assert pii.training_examples(rows).where("label = 1").select("h").distinct().count() == 6500
    whole = " ".join(text for _, text in corpus(1, 700))
    df = spark.createDataFrame([(1, whole), (2, "here 83[.]12[.]7[.]200 answers"), (3, "paid by 4111.1111.1111.1112 then")], "doc_id long, text string")
    got = {r["doc_id"]: r["added"] for r in pii.find_personal_data(df).collect()}
    assert [s["kind"] for s in got[2]] == ["ip"] and got[3] == []
