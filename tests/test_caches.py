"""Caches with a size and items that wait for a reply, as streams over several micro-batches, against plain loops."""

import random
from collections import deque

import pytest

from pagetrail.streaming import caches, flows


def feed(spark, folder, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize(("ttl", "most"), [(1, 5), (40, 3), (0, 4), (15, 0)])
def test_cache_by_the_rule(ttl, most):
    r, now, cache, plain = random.Random(ttl), 0.0, caches.Seen(ttl, most), []
    for _ in range(400):
        now += r.random() * 4
        id = r.choice("abcdefg")
        at = dict(plain).get(id)
        want = at is not None and (ttl <= 0 or now - at < ttl)
        plain = [x for x in plain if x[0] != id] + [(id, now)]
        if not want:
            plain = [x for x in plain if ttl <= 0 or now - x[1] <= ttl]
            plain = plain[-most:] if most else []
        assert cache.repeated(id, now) == want
        assert list(cache.at.items()) == plain


def test_dedupe_over_batches(spark, tmp_path):
    r, n, batches = random.Random(4), 0, []
    for k in range(4):
        batches.append([])
        for _ in range(40):
            n += 1
            batches[k].append((r.choice([1, 1, 1, 2]), n, float(n), r.choice([*"abcdef", "", None])))
    rows = feed(spark, str(tmp_path / "in"), batches, "scope long, n long, t double, id string")
    got = sorted(x.n for x in flows.run_available(caches.dedupe_capped(rows, scope="scope", id="id", time="t", ttl=30, most=3)).collect())
    seen, want = {1: caches.Seen(30, 3), 2: caches.Seen(30, 3)}, []
    for scope, k, t, id in sum(batches, []):
        if not id or not seen[scope].repeated(id, t):
            want.append(k)
    assert got == want
    assert len(want) < n


def test_pending_over_batches(spark, tmp_path):
    r, n, batches = random.Random(6), 0, []
    for k in range(3):
        batches.append([])
        for _ in range(30):
            n += 1
            batches[k].append((r.choice(["a", "a", "b", None]), n, float(n), r.choice([True, False, False, False, None])))
    rows = feed(spark, str(tmp_path / "in"), batches, "who string, n long, t double, reply boolean")
    out = flows.run_available(caches.pending_history(rows, key="who", item="n", time="t", reply="reply", most=3))
    got = {x.n: (x.who, list(x.history)) for x in out.collect()}
    held, want = {}, {}
    for who, k, _, reply in sum(batches, []):
        q = held.setdefault(who, deque(maxlen=3))
        if reply:
            want[k] = (who, list(q))
            q.clear()
        else:
            q.append(k)
    assert got == want
