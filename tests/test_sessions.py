"""Filters of sessions on a hand-made table: kinds, agents, parents, names, searches, times and limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import gateway

NOW = dt.datetime(2024, 5, 1, 12)
SCHEMA = "key string, session_id string, label string, subject string, display_name string, origin_label string, spawned_by string, chat_type string, updated timestamp_ntz"
ROWS = [
    ("global", "g0", "Work", None, None, None, "agent:main:a", None, NOW),
    ("unknown", "u0", None, None, None, None, None, None, NOW),
    ("agent:Main:a", "s1", "Work", "Budget", None, "from web", None, "direct", NOW - dt.timedelta(minutes=5)),
    ("agent:main:web:group:7", "s2", None, None, None, "Lobby", "agent:main:a", None, NOW - dt.timedelta(minutes=90)),
    ("agent:other:b", "s3", None, None, "Plans", None, "agent:main:a", "channel", None),
    ("plain", "s4", "Work", None, None, None, None, None, NOW - dt.timedelta(minutes=5)),
]


@pytest.mark.parametrize(
    ("how", "keys"),
    [
        ({}, ["agent:Main:a", "plain", "agent:main:web:group:7", "agent:other:b"]),
        ({"include_global": True, "include_unknown": True, "limit": 2}, ["global", "unknown"]),
        ({"agent": " MAIN "}, ["agent:Main:a", "agent:main:web:group:7"]),
        ({"agent": "main", "include_global": True}, ["agent:Main:a", "agent:main:web:group:7"]),
        ({"spawned_by": "agent:main:a", "include_global": True}, ["agent:main:web:group:7", "agent:other:b"]),
        ({"label": " Work "}, ["agent:Main:a", "plain"]),
        ({"search": " BUDG "}, ["agent:Main:a"]),
        ({"search": "lobby"}, ["agent:main:web:group:7"]),
        ({"search": "plans"}, ["agent:other:b"]),
        ({"search": "s4"}, ["plain"]),
        ({"search": "from web"}, []),
        ({"search": " ", "label": " ", "agent": " "}, ["agent:Main:a", "plain", "agent:main:web:group:7", "agent:other:b"]),
        ({"active_minutes": 60.9}, ["agent:Main:a", "plain"]),
        ({"limit": 0}, ["agent:Main:a"]),
    ],
)
def test_filters(spark, how, keys):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = gateway.filter_sessions(df, now=F.lit(NOW).cast("timestamp_ntz"), **how).collect()
    assert [r.key for r in got] == keys


def test_kinds_and_names(spark):
    got = gateway.filter_sessions(spark.createDataFrame(ROWS, SCHEMA), include_global=True, include_unknown=True).collect()
    assert {r.key: (r.kind, r.display_name) for r in got} == {
        "global": ("global", "Work"), "unknown": ("unknown", None), "agent:Main:a": ("direct", "Work"), "agent:main:web:group:7": ("group", "Lobby"),
        "agent:other:b": ("group", "Plans"), "plain": ("direct", "Work"),
    }


def test_no_sessions(spark):
    assert gateway.filter_sessions(spark.createDataFrame([], SCHEMA), search="x").count() == 0
