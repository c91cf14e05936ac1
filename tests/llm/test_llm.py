"""Training-data operators against brute force, round trips and held-out accuracy, with nulls, repeats, clashing columns and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pagetrail.llm import class_lm, exact_dedup, gif, licenses, mixing, near_dedup, queries, repeats, sentencepiece_fst, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    """Documents with extra columns whose names clash with those of results and of internal steps."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


#: Names of results and of internal steps.
CLASHING = ["kept", "_row", "row", "k", "t", "size", "_id", "_gone", "gone", "id", "data", "places", "_maybe", "_sha", "_keep", "_source", "_size", "_key", "_bucket", "_family", "_fold", "_x", "score", "label", "word", "rest", "component_id", "media", "frames"]


def sentences(rng, n, words=None):
    words = words or [a + b for a in ("ka", "lo", "mi", "tur", "en") for b in ("ra", "sto", "ne", "pil")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)
    base = sentences(rng, 120, [f"w{i}" for i in range(900)])
    near = base.split()
    near[60] = "changed"
    rows = [(1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, None), (5, "", "b"), (6, "one two", "c"), (7, "one two", "c"), (8, sentences(rng, 200), "a"), (9, base.upper(), "a"), (10, "ein  \n zwei\tdrei vier", "a")]
    rows += [(20 + i, sentences(rng, rng.randint(1, 60)), rng.choice("abc")) for i in range(40)]
    return make(spark, [*rows, (8, rows[7][1], "a")])


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [(1, "x", "a")]).where("doc_id < 0")


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert gif.read_back(gif.to_gif(none)).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert licenses.scan_licences(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert sentencepiece_fst.round_trip(none).count() == 0
    assert repeats.cut_repeats(none).count() == 0
    assert class_lm.class_scores(none).count() == 0


LARGE = 2**53 + 1


@pytest.fixture(scope="module")
def odd(spark):
    """Ids beyond 2^53 beside null ids, null and empty texts, repeated rows, a very long text, ties."""
    rng = random.Random(21)
    long = sentences(rng, 60_000)
    rows = [(LARGE, "one two three four five", "a"), (LARGE + 2, "one two three four five", "a"), (None, "one two three four five", "b"), (None, None, None), (LARGE + 4, None, "a"), (LARGE + 6, "", None), (LARGE + 8, long, "a"), (None, long + " x", "b"), (LARGE + 8, long, "a"), (7, "seven", "c")]
    return make(spark, rows).coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x))


def test_ids_beside_nulls(odd, spark):
    want, labels = ids(odd), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert LARGE in want and None in want
    results = {
        "gif": gif.read_back(gif.to_gif(odd)),
        "exact": exact_dedup.exact_duplicates(odd),
        "tokens": token_counts.count_tokens(odd),
        "near": near_dedup.near_duplicates(odd),
        "toxicity": toxicity.score_toxicity(odd, labels),
        "licences": licenses.scan_licences(odd),
        "mixing": mixing.mix_sources(odd),
        "pieces": sentencepiece_fst.round_trip(odd),
        "encoded": sentencepiece_fst.encode_documents(odd),
        "repeats": repeats.cut_repeats(odd),
        "lm": class_lm.class_scores(odd),
    }
    for name, df in results.items():
        assert ids(df) == want, name
    near = {(r.doc_id, r.component_id, r.kept) for r in results["near"].collect()}
    assert {(LARGE, LARGE, True), (LARGE + 2, LARGE, False), (None, None, True), (LARGE + 4, LARGE + 4, True), (LARGE + 6, LARGE + 6, True)} <= near
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in results["exact"].collect()}
    assert {(LARGE, LARGE + 2, 3, False), (LARGE + 2, LARGE + 2, 3, True), (None, LARGE + 2, 3, False), (LARGE + 8, LARGE + 8, 2, True)} <= exact


def test_filters_pass_on_all_columns(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (exact_dedup.drop_exact_duplicates(odd), near_dedup.drop_near_duplicates(odd), toxicity.drop_toxic(odd, labels), mixing.mixed_documents(odd)):
        assert df.columns == odd.columns and df.where("_id = '_id' and _gone = '_gone'").count() == df.count() > 0
    assert sorted(map(str, ids(near_dedup.drop_near_duplicates(odd)))) == sorted(map(str, [LARGE, None, None, LARGE + 4, LARGE + 6, LARGE + 8, LARGE + 8, None, 7]))
    base = [f"w{i}" for i in range(100)]
    near = make(spark, [(5, " ".join(base), "a"), (3, " ".join([*base[:-1], "x"]), "a"), (4, " ".join([*base[:40], "x", *base[41:]]), "a"), (9, " ".join([*base[:20], "x", *base[21:60], "y", *base[61:]]), "a"), (8, " ".join(f"v{i}" for i in range(100)), "a")])
    assert ids(near_dedup.drop_near_duplicates(near)) == [3, 8]  # by runs of five words: 9 and 5 have 86 of 106 in common


def test_frames(spark):
    def frame(samples, control, delay):
        return b"\x21\xf9\x04" + bytes([control, delay, 0, 0, 0]) + b"\x2c\0\0\0\0\2\0\1\0\0\x08" + gif._blocks(gif.lzw_encode(bytes(samples)))

    head = b"GIF89a\2\0\1\0\xf7\0\0" + bytes(v for i in range(256) for v in (i, 0, 255 - i))
    data = head + frame([200, 8], 1 << 2, 5) + frame([0, 70], 3 << 2 | 1, 7) + frame([0, 0], 1, 9) + b"\x3b"
    media = spark.createDataFrame([(LARGE, data), (None, data[:-20]), (2, None), (3, b""), (4, b"no gif")], "doc_id long, media binary").withColumn("frame_no", F.lit("x"))
    got = gif.decode_frames(media.coalesce(1)).collect()
    mine = sorted((r for r in got if r.doc_id == LARGE), key=lambda r: r.frame_no)
    assert [(r.start_ms, r.delay_ms, r.disposal, r.whole) for r in mine] == [(0, 50, 1, True), (50, 70, 3, True), (120, 90, 0, True)]
    assert [bytes(r.rgb) for r in mine] == [bytes([200, 0, 55, 8, 0, 247]), bytes([200, 0, 55, 70, 0, 185]), bytes([200, 0, 55, 8, 0, 247])]
    assert [r.hist_red for r in mine] == [[1, 0, 0, 0, 0, 0, 1, 0], [0, 0, 1, 0, 0, 0, 1, 0], [1, 0, 0, 0, 0, 0, 1, 0]]
    assert mine[0].hist_green == [2, 0, 0, 0, 0, 0, 0, 0] and {r.doc_id for r in got} == {LARGE, None}
    assert gif.decode_frames(media.where("false")).count() == 0


def test_gif_round_trip(some):
    got = {(r.doc_id, r.payload_sha256) for r in gif.read_back(gif.to_gif(some)).collect()}
    for r in some.collect():
        data = (r.text or "").encode()
        assert (r.doc_id, hashlib.sha256(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")).hexdigest()) in got


@pytest.mark.parametrize("size", [64, 64 * 1023, 64 * 1025, 64 * 5000])
def test_gif_codes(size):
    data = np.random.default_rng(size).integers(0, 7 if size > 64_000 else 256, size).astype(np.uint8).tobytes()
    assert b"".join(f["area"][:, :, 0].tobytes() for f in gif.gif_frames(gif.encode_gif(data))) == data


def test_gif_disposal_and_transparency():
    def frame(samples, control):
        return b"\x21\xf9\x04" + bytes([control, 5, 0, 0, 0]) + b"\x2c\0\0\0\0\2\0\1\0\0\x08" + gif._blocks(gif.lzw_encode(bytes(samples)))

    head = b"GIF89a\2\0\1\0\xf7\0\0" + bytes(v for i in range(256) for v in (i, 0, i))
    data = head + frame([9, 8], 1 << 2) + frame([0, 7], 3 << 2 | 1) + frame([0, 0], 1) + b"\x3b"
    frames = [(f["rgb"][0, :, 0].tolist(), f["start_ms"]) for f in ({**f, "rgb": f["rgb"].copy()} for f in gif.gif_frames(data))]
    assert frames == [([9, 8], 0), ([9, 7], 50), ([9, 8], 100)]
    assert list(gif.gif_frames(b"no gif")) == []
    assert len(list(gif.gif_frames(data[:-20]))) >= 2


def test_exact_dedup(some, spark):
    rows = some.collect()
    by = Counter(r.text or "" for r in rows)
    top = {}
    for r in rows:
        top[r.text or ""] = max(top.get(r.text or "", -1), r.doc_id)
    assert [exact_dedup.bits_for(n) for n in (0, 1, 2048, 2049, 10**10)] == [1 << 15, 1 << 15, 1 << 15, 1 << 16, 1 << 30]
    for bits in (1 << 15, None):
        got = exact_dedup.exact_duplicates(some, filter_bits=bits).collect()
        want = sorted((r.doc_id, top[r.text or ""], by[r.text or ""], r.doc_id == top[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
        assert sorted(map(tuple, got)) == want
    copies = make(spark, [(i, "the same" if i % 3 == 0 else f"other {i}", "a") for i in range(6000)])
    hot = exact_dedup.exact_duplicates(copies).where("text_sha256 = sha2('the same', 256)")
    assert {tuple(r[1:3]) for r in hot.collect()} == {(5997, 2000)} and hot.where("kept").count() == 1
    kept = exact_dedup.drop_exact_duplicates(some)
    assert kept.columns == some.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(top.values()))


def test_exact_dedup_in_parts(spark):
    """A small filter makes parts of the hashes; decisions stay the same, and only rows that repeat are flagged."""
    rows = [(i, f"text {i % 400}" if i % 3 else f"own {i}", f"s{i % 2}", i) for i in range(6000)] + [(None, "x", "s", 1), (None, "x", "t", 2), (None, None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert exact_dedup.parts_for(10**10) == 150 and exact_dedup.parts_for(10**6) == 1
    one, many = (sorted(map(repr, exact_dedup.exact_duplicates(df, most_bits=b).collect())) for b in (1 << 30, 1 << 15))
    assert exact_dedup.parts_for(6003, 1 << 15) == 3 and one == many
    one, many = (sorted(map(repr, exact_dedup.drop_exact_duplicates(df, most_bits=b).collect())) for b in (1 << 30, 1 << 15))
    assert one == many and len(one) == len({t or "" for _, t, *_ in rows})
    told = df.withColumn("_h", F.xxhash64("text")).withColumn("_p", exact_dedup._part(F.col("_h"), 3))
    flagged = exact_dedup._by_parts(told, F.col("_h"), 3, 1 << 15, lambda part: part.select("text", "_maybe")).groupBy("_maybe").agg(F.count_if(F.col("text").startswith("own")).alias("own"), F.count("*").alias("n")).collect()
    assert {r["_maybe"]: r["own"] for r in flagged}[True] < 250 and {r["_maybe"]: r["n"] for r in flagged}[True] > 3900


def test_exact_dedup_ties_do_not_depend_on_order(spark):
    rows = [(1, "same", f"o{i}", i) for i in range(20)] + [(None, "other", f"o{i}", None) for i in range(5)]
    stay = [sorted(map(repr, exact_dedup.drop_exact_duplicates(spark.createDataFrame(r, "doc_id long, text string, source string, n_chars long").repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert stay[0] == stay[1] and len(stay[0]) == 2



def test_tokens_match_the_library(some):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.default_path())
    want = sorted((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False))) for r in some.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(some).collect()) == want


def test_tokens_of_huge_texts():
    counter = token_counts.Counter(token_counts.default_path(), chunk=1000, overlap=300)
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "é", " don't", "<|endoftext|>", "<|endof", "text|>", "123", "x" * 400, " " * 350, "日本", "\t", "!?", "​"]
    for k in range(60):
        text = "".join(rng.choice(parts[:10] if k % 3 else parts) for _ in range(rng.randint(500, 2500)))
        assert counter.count([text])[0] == len(counter.tok.encode(text, add_special_tokens=False))
    assert counter.widened


def brute_components(rows, size=4):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_dedup(some, spark):
    got = near_dedup.near_duplicates(some).collect()
    want = brute_components(some.collect())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):  # copies with edits: some pairs are linked through others only
        w = base[:]
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(w), "a"))
    df = make(spark, rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == brute_components(df.collect())


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    x = int(np.bitwise_count((near_dedup.odd_sketch(near_dedup.samples(a)) ^ near_dedup.odd_sketch(near_dedup.samples(b))).view(np.uint64)).sum())
    k, n = near_dedup.BANDS * near_dedup.ROWS, near_dedup.SKETCH_BITS
    assert abs(1 + n / (4 * k) * math.log(1 - 2 * x / n) - 900 / 1100) < 0.1


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        w = sentences(rng, rng.randint(20, 60)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vexbag", "vexbags", "glorp", "Glorp!", "gl0rp"]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(toxic)))
    docs = make(spark, [*rows, (9000, None, "a"), (9001, "", "a")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == 702 and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    one = toxicity.score_toxicity(docs, lab.where("toxic = 0")).collect()
    assert {r.score for r in one} == {0.0}


def test_licences(spark):
    rng = random.Random(6)
    texts = [(f"{sentences(rng, 30)}\n{t}\n{sentences(rng, 5)}", f) for f, n in licenses.NOTICES.items() for t in n] + [(sentences(rng, 40), "unknown") for _ in range(30)]
    docs = make(spark, [(i, t, "a") for i, (t, _) in enumerate(texts)] + [(900, None, "a"), (901, "", "a")])
    got = {r.doc_id: r for r in licenses.scan_licences(docs).collect()}
    right = sum(got[i].family == f for i, (_, f) in enumerate(texts))
    assert right / len(texts) > 0.95
    assert got[900].family == "unknown" and got[900].n_paragraphs == 0 and not got[901].confirmed
    assert all(got[i].confirmed for i, (_, f) in enumerate(texts) if f != "unknown" and got[i].family == f)


def test_wrapped_and_several_licences(spark):
    import textwrap

    rng = random.Random(16)
    mit, bsd = licenses.NOTICES["mit"][1], licenses.NOTICES["bsd"][0]
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 44))
    both = f"{sentences(rng, 30)}\n\n{wrap(mit, '# ')}\n#\n{wrap(bsd, ' * ')}"
    inside = f"{sentences(rng, 200)} {mit} {sentences(rng, 200)}"
    docs = make(spark, [(1, wrap(mit, "// "), "a"), (2, both, "a"), (3, textwrap.fill(inside, 72), "a"), *((10 + i, sentences(rng, 40), "a") for i in range(20))])
    got = {r.doc_id: r for r in licenses.scan_licences(docs).collect()}
    sure = {i: {(x.family, x.paragraph_no) for x in r.notices if x.confirmed} for i, r in got.items()}
    assert sure[1] == {("mit", 0)} and sure[2] == {("mit", 1), ("bsd", 2)} and ("mit", 0) in sure[3]
    assert (got[1].family, got[1].confirmed, got[1].n_paragraphs, got[2].n_paragraphs) == ("mit", True, 1, 3)
    assert all(r.n_notices == len(r.notices) for r in got.values())


def test_licences_of_altered_notices(spark):
    """Notices with words left out, replaced and wrapped, beside ordinary and legal-looking paragraphs: families found, and the unknown
    class's probability against its share."""
    import textwrap

    rng = random.Random(17)
    other = "the of and to in is for on with as by at from this that agreement party shall terms service may not use data privacy policy notice".split()
    texts = []
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            for _ in range(2):
                w = [x if rng.random() > 0.04 else rng.choice(other) for x in notice.split() if rng.random() > 0.03]
                texts.append((family, textwrap.fill(f"{' '.join(w)} {sentences(rng, 6)}", 60)))
    texts += [("unknown", " ".join(rng.choice(other) for _ in range(rng.randint(5, 60)))) for _ in range(100)] + [("unknown", sentences(rng, 40)) for _ in range(100)]
    docs = make(spark, [(i, t, "a") for i, (_, t) in enumerate(texts)])
    ordinary = make(spark, [(i, sentences(rng, 30), "a") for i in range(100)])
    got = {r.doc_id: r for r in licenses.scan_licences(docs, licenses.fit_licences(ordinary)).collect()}
    right = sum(got[i].family == f for i, (f, _) in enumerate(texts)) / len(texts)
    assert right > 0.9
    assert sum(got[i].family == "unknown" for i, (f, _) in enumerate(texts) if f == "unknown") / 200 > 0.95
    unknown = np.array([got[i].probability if got[i].family == "unknown" else 1 - got[i].probability for i in range(len(texts))])
    truth = np.array([f == "unknown" for f, _ in texts])
    bins = np.minimum((unknown * 5).astype(int), 4)
    assert sum(abs(unknown[bins == b].mean() - truth[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any()) < 0.1


def test_mixing(some):
    got = mixing.mix_sources(some).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6
    for taken, target, size in by.values():
        assert abs(taken - target) <= 0.5 + 1e-9 and target <= 3 * size + 1e-9
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_sources(some).collect()))
    mixed = mixing.mixed_documents(some)
    assert mixed.columns == some.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert words == {s: t for s, (t, _, _) in by.items() if t} | {s: 0 for s, n in words.items() if not n}


def test_sentencepiece_matches_the_library(some):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_path())
    t = sentencepiece_fst.Transducer(sentencepiece_fst.default_path())
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "the", "ing", "\n", "é", "日", "🙂", "1", "▁", "Hello", "    ", "\t", "\xa0", "ﬁ"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert t.encode(text).tolist() == sp.encode(text)
        assert t.decode(sp.encode(text)) == sp.decode(sp.encode(text))
    got = {r.doc_id: r for r in sentencepiece_fst.round_trip(some).collect()}
    for r in some.collect():
        assert got[r.doc_id].n_tokens == len(sp.encode(r.text or ""))
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def model(pieces, *, bpe, fallback=True, charsmap=b"", prefix=True, squeeze=True):
    """A model file by hand: pieces of text, score and kind."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, data: number(k << 3 | 2) + number(len(data)) + data
    flag = lambda k, v: number(k << 3) + number(v)
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    body = b"".join(field(1, field(1, p.encode()) + number(2 << 3 | 5) + np.float32(s).tobytes() + flag(3, k)) for p, s, k in own + pieces)
    return body + field(2, flag(3, 2 if bpe else 1) + flag(35, int(fallback))) + field(3, field(1, b"hand") + (field(2, charsmap) if charsmap else b"") + flag(3, int(prefix)) + flag(4, int(squeeze)) + flag(5, 1))


@pytest.mark.parametrize("bpe", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("mapped", [True, False])
def test_other_models_match_the_library(bpe, fallback, mapped):
    rng = random.Random(11)
    letters = "abcd▁é"
    texts = {*letters} | {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(60)} | {"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    texts = sorted(texts)
    rng.shuffle(texts)
    pieces = [(t, -float(i + 1) if bpe else -rng.uniform(1, 12), 1) for i, t in enumerate(texts)] + [("<own>", 0.0, 4), ("ab<", 0.0, 4)]
    charsmap = b""
    if mapped:
        fields = dict(sentencepiece_fst._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()))
        charsmap = dict(sentencepiece_fst._fields(fields[3]))[2]
    data = model(pieces, bpe=bpe, fallback=fallback, charsmap=charsmap)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    t = sentencepiece_fst.Transducer(data)
    parts = ["a", "b", "c", "d", "ab", "cd", "abc", " ", "  ", "é", "日", "\n", "<own>", "ab<", "<ow", "A", "Ｂ", "ﬁ", "\u3000", "①"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert t.encode(text).tolist() == sp.encode(text), text
        assert t.decode(sp.encode(text)) == sp.decode(sp.encode(text)), text


def test_long_and_many_parts(spark):
    rng = random.Random(13)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_path())
    texts = ["x" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(5000)), " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(20_000)), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece_fst.encode_documents(df).collect()}
    assert all(got[i].token_ids == sp.encode(t or "") and got[i].n_tokens == len(got[i].token_ids) for i, t in enumerate(texts))
    columns = df.select("text", sentencepiece_fst.encode_column(F.col("text")).alias("e")).select("text", sentencepiece_fst.decode_column(F.col("e")).alias("d"))
    assert all(r.d == (r.text or "") for r in columns.collect())
    t = sentencepiece_fst.Transducer(sentencepiece_fst.default_path())
    assert all(t._bpe_many([p]) == [t._ids(p)] for p in texts[2].split()[:2000])


def brute_repeats(rows, size=400):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[p : p + size] for p in range(len(data) - size + 1))
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if seen[data[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é") for _ in range(2500))
    rows = [(1, base), (2, base[:1500] + "X" + base[1501:]), (3, "a" * 900), (4, "ab" * 500 + base[100:520]), (5, base[2000:2300]), (6, base[1900:2350]), (7, None), (8, ""), (9, "from " * 200), (10, "zz" + base[700:1101] + "q" + base[700:1100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("z")).withColumn("t", F.lit(1)).withColumn("places", F.lit(2))
    got = repeats.cut_repeats(df).collect()
    assert {r.doc_id: tuple(r[1:5]) for r in got} == brute_repeats(rows)
    passage = sentences(rng, 70, [f"w{i}" for i in range(900)])[:385]  # shorter than a removed string
    alone = [sentences(rng, 80, [f"{c}{i}" for i in range(900)]) for c in "xyz"]
    df2 = spark.createDataFrame([(1, f"{alone[0]} {passage}"), (2, f"{passage} {alone[1]}"), (3, alone[2]), (None, passage)], "doc_id long, text string")
    got = {r.doc_id: (r.n_passages, r.n_removed) for r in repeats.cut_repeats(df2).collect()}
    assert len(passage.split()) > 50 and got == {1: (1, 0), 2: (1, 0), 3: (0, 0), None: (1, 0)}
    twice = repeats.cut_repeats(df.where("doc_id = 1").union(df.where("doc_id = 1"))).collect()
    assert [r.n_removed for r in twice] == [len(base.encode())] * 2


def brute_lm(rows, least, alpha=class_lm.ALPHA):
    """With three classes the classes are given: the end, words that occur ``least`` times, and the others."""
    toks = lambda t: (t or "").encode().lower().split()
    train = [toks(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    ends, n = len(train), sum(c.values()) + len(train)
    v = len(c) + (ends > 0)
    of = lambda w: 0 if w is None else 1 if c[w] >= least else 2
    steps = np.zeros((3, 3))
    for t in train:
        path = [0, *map(of, t), 0]
        np.add.at(steps, (path[:-1], path[1:]), 1)
    jump = (steps + alpha) / (steps.sum(1, keepdims=True) + alpha * 3)
    heads = [k for k in c.values() if k >= least]
    rare = [k for k in c.values() if k < least]
    share = lambda w: (c[w] + 0.5) / (sum(heads) + 0.5 * len(heads) if c[w] >= least else sum(rare) + 0.5 * (len(rare) + 1))
    out = []
    for i, t in rows:
        w = [*toks(t), None]
        count = lambda x: ends if x is None else c[x]
        base = sum(math.log10((count(x) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        got, last = 0.0, 0
        for x in w:
            got += math.log10(jump[last, of(x)]) + (0.0 if x is None else math.log10(share(x)))
            last = of(x)
        out.append((i, len(w), sum(count(x) > 0 for x in w), n, base, got))
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[4]))


@pytest.mark.parametrize("least", [1, 4, 10_000])
def test_class_scores(some, least):
    got = class_lm.class_scores(some, least=least, classes=3).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (r[0] is None, r[0], r[4]))
    want = brute_lm([(r.doc_id, r.text) for r in some.collect()], least)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4:] for r in got] == [pytest.approx(r[4:]) for r in want]


def test_most_heads(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), n) for i, n in enumerate([9, 7, 7, 5, 5, 5, 1])], "word binary, n long")
    for least, most, want in ((1, 100, 7), (5, 100, 6), (1, 6, 6), (1, 5, 3), (1, 2, 1), (1, 0, 0)):
        assert class_lm._head(counts, least, most).count() == want


def test_words_are_clustered_by_exchange(spark):
    rng = random.Random(12)
    left, right = ([f"{c}{i}same" for i in range(700)] for c in "lr")
    texts = [" ".join(rng.choice(left if i % 2 else right) for i in range(60)) for _ in range(80)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    n = Counter(w for t in texts for w in t.encode().split())
    seen = sorted(w for w, k in n.items() if k >= 2)
    ids = sorted(map(class_lm.word_id, seen))
    heads = class_lm.Heads(np.array(ids, np.int64))
    place = {i: p for p, i in enumerate(ids)}
    unit = lambda w: place.get(class_lm.word_id(w), heads.rare)
    pairs = np.zeros((heads.units, heads.units))
    for t in texts:
        path = [heads.end, *map(unit, t.encode().split()), heads.end]
        np.add.at(pairs, (path[:-1], path[1:]), 1)
    static = class_lm.cut(class_lm.neighbours(train, heads, 5))
    salted = class_lm.neighbours(train, heads, 5, salts=3)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, static.collect()))
    cls, table = class_lm.cluster(static, heads.units, classes=4)

    def score(a):
        one = np.eye(4)[a]
        return one.T @ pairs @ one

    assert (score(cls) == table).all() and cls[heads.end] == 0 and cls[heads.rare] == 3 and set(cls[: heads.rare]) == {1, 2}
    start = (1 + np.arange(heads.units) % 2).astype(int)
    start[heads.rare :] = 3, 0
    assert class_lm.likelihood(table) > class_lm.likelihood(score(start))
    own = np.diag(pairs).copy()
    rest, one = pairs - np.diag(own), np.eye(4)[cls]
    g = class_lm.gains(rest @ one, rest.T @ one, own, cls.astype(int), table, class_lm.small_gains(table))
    for p in range(0, heads.rare, 25):
        b = cls.copy()
        b[p] = 3 - cls[p]
        assert class_lm.likelihood(score(b)) - class_lm.likelihood(table) == pytest.approx(g[p, b[p]] - g[p, cls[p]], abs=1e-6)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    base = sentences(rng, 100, [f"w{i}" for i in range(500)])
    near = base.split()
    near[50] = "other"
    rows = [(1, base, "a"), (2, base, "a"), (3, " ".join(near), "b")] + [(10 + i, sentences(rng, 30, [f"v{j}" for j in range(800)]), rng.choice("ab")) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    # Brute force: nothing is toxic; of equal texts the largest id; of near copies by five words the smallest; the mix by its SQL.
    last = {}
    for i, t, s in rows:
        last[t] = max(last.get(t, (-1,)), (i, t, s))
    unequal = [SimpleNamespace(doc_id=i, text=t, source=s) for i, t, s in last.values()]
    comp = brute_components(unequal, size=5)
    kept = {r.doc_id: r.text for r in unequal if comp[r.doc_id][1] == r.doc_id}
    assert set(kept) & {1, 2, 3} == {2} and ids(spark.read.parquet(f"{tmp_path}/near_dedup")) == sorted(kept)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_path())
    want = []
    for doc, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLES['op7_mixing']})").fetchall():
        words = kept[doc].split(" ")
        assert len(words) == size
        want += [(doc, tuple(sp.encode(kept[doc])))] * (taken // size)
        want += [(doc, tuple(sp.encode(" ".join(words[: taken % size]))))] * bool(taken % size)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "token_ids", "n_tokens"}
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in got.collect()) == sorted(want)


def test_pipeline_edges(spark, tmp_path, odd):
    import corpus_pipeline

    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(["vexbag", "glorp"]) if i % 4 == 0 and j % 9 == 3 else f"w{rng.randrange(300)}" for j in range(40)), "a") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)
    for name, table in (("plain", docs), ("empty", docs.where("false")), ("odd", odd.select("doc_id", "text", "lang", "source", "n_chars"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    left = toxicity.drop_toxic(docs, spark.read.parquet(f"{tmp_path}/plain/labels.parquet"))
    assert ids(left) == [i for i in range(400) if i % 4]  # toxic documents go, clean ones stay
    assert {i for i in ids(corpus_pipeline.run(spark, f"{tmp_path}/plain"))} <= set(ids(left))
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert LARGE + 8 in ids(corpus_pipeline.run(spark, f"{tmp_path}/odd"))


def test_pairs_lie_in_small_rows_whatever_the_bucket_holds(spark):
    grid = [[f"{a}{i}" for i in range(400)] for a in "xy"]
    text = " ".join(f"{a} {b}" for a in grid[0] for b in grid[1])
    train = spark.createDataFrame([(text,)], "text string")
    seen = sorted(map(class_lm.word_id, {w.encode() for g in grid for w in g}))
    heads = class_lm.Heads(np.array(seen, np.int64))
    rows = class_lm.neighbours(train, heads, 1).collect()
    units = np.concatenate([np.frombuffer(r.words, np.int32) for r in rows])
    assert sorted(units) == [*range(len(seen)), heads.end][: len(units)] and len(units) >= len(seen)
    assert max(sum(map(len, r[1:])) for r in rows) < 1e6 < sum(len(r.u) for r in rows)
    place = {i: p for p, i in enumerate(seen)}
    path = [heads.end, *(place[class_lm.word_id(w.encode())] for w in text.split()), heads.end]
    cls = (np.arange(heads.units) % 5).astype(np.uint8)
    want = np.zeros((5, 5))
    np.add.at(want, (cls[path[:-1]], cls[path[1:]]), 1)
    assert (sum(class_lm._Bucket(r.asDict()).table(cls, 5) for r in rows).reshape(5, 5) == want).all()


def test_a_bucket_of_frequent_words_takes_bounded_memory():
    import tracemalloc

    units, classes, per = 8192, 48, 46
    rng = np.random.default_rng(3)
    words = np.arange(units, dtype=np.int32)
    start = np.arange(2 * units + 1) * per
    u = np.concatenate([rng.choice(units, per, replace=False) for _ in range(2 * units)]).astype(np.int32)
    n = rng.integers(1, 90, len(u)).astype(np.int32)
    bucket = class_lm._Bucket({"words": words.tobytes(), "own": np.ones(units, np.int64).tobytes(), "start": start.tobytes(), "u": u.tobytes(), "n": n.tobytes()})
    cls = (1 + np.arange(units + 2) % (classes - 2)).astype(np.uint8)
    cls[-2:] = classes - 1, 0
    table = bucket.table(cls, classes).reshape(classes, classes)
    tracemalloc.start()
    moved, to, wants = bucket.choose(cls, table, class_lm.small_gains(table), 1.0, 0, classes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(moved) == len(to) == wants > 0 and most < 60e6
