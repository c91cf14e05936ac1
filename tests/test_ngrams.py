"""Words inside words; n-grams matched in a range of pages against a plain loop; dictionary words; grams held by a page."""

import random

from pagetrail.operators import joins, matching


def test_first_best_page_in_range(spark):
    r = random.Random(2)
    grams = [f"g{i}" for i in range(12)]
    pages = [(p, r.choice(grams)) for p in range(1, 20) for _ in range(6)]
    asked = [(q, r.choice(grams)) for q in range(30) for _ in range(5)]
    current = [(q, r.randrange(1, 22)) for q in range(32)]  # the last two say nothing, some are at the end of the book
    got = matching.match_ngrams_ahead(spark.createDataFrame(asked, "query_id long, gram string"), spark.createDataFrame(pages, "page int, gram string"), spark.createDataFrame(current, "query_id long, current_page long"), look_ahead=3)
    held, want = {}, {}
    for p, g in pages:
        held.setdefault(p, set()).add(g)
    for q, at in current:
        said, best = [g for k, g in asked if k == q], (at, 0)
        for p in range(at, at + 4):
            n = len(set(said) & held.get(p, set()))
            if n > best[1]:
                best = (p, n)
        want[q] = (*best, len(said), best[1] / len(said) if said else 0.0)
    assert {x.query_id: (x.page, x.matched, x.total, x.score) for x in got.collect()} == want


def test_dictionary_and_held_grams(spark):
    words = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, None)], "query_id long, word string")
    known = spark.createDataFrame([("a", "x"), ("b", ""), ("z", "y")], "word string, mapped string")
    assert sorted(str(r.word) for r in matching.mapped_words(words, known).collect()) == ["None", "b", "c", "x"]
    asked = spark.createDataFrame([(1, "x b"), (1, "x b"), (1, "b c"), (2, "q")], "query_id long, gram string")
    pages = spark.createDataFrame([(5, "x b"), (5, "x b"), (6, "b c")], "page int, gram string")
    current = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "query_id long, current_page long")
    got = {r.query_id: (r.matches, r.total) for r in matching.grams_held(asked, pages, current).collect()}
    assert got == {1: (2, 3), 2: (0, 1), 3: (0, 0)}


def test_words_inside_words(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    pages = [(p, word(r.randrange(1, 30))) for p in range(12) for _ in range(4)] + [(99, ""), (99, None)]
    asked = [(q, word(r.randrange(1, 9))) for q in range(10) for _ in range(4)] + [(50, ""), (50, None), (51, "c")]
    got = joins.search_substrings(spark.createDataFrame(asked, "query_id long, word string"), spark.createDataFrame(pages, "page long, word string"))
    want = {}
    for q, w in asked:
        for p in {p for p, x in pages if w and x and w in x}:
            want[q, p] = want.get((q, p), 0) + 10
    assert {(x.query_id, x.page): x.score for x in got.collect()} == want
