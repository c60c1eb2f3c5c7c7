"""Passages of any length and number against a plain substring search."""

import random

from docsearch_spark.operators import passages
from docsearch_spark.operators.passages import passage_matches


def searched(docs, items):
    norm = {d: " ".join((t or "").split()) for d, t in docs}
    return {(i, d) for i, p in items if (q := " ".join((p or "").split())) for d, t in norm.items() if q in t}


def found(spark, docs, items):
    out = passage_matches(spark.createDataFrame(docs, "d long, t string"), "d", "t",
                          spark.createDataFrame(items, "i long, p string"), "i", "p").collect()
    pairs = [(r["item_id"], r["doc_id"]) for r in out]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_a_hundred_thousand_short_passages(spark):
    rng = random.Random(3)
    letters = "abcdeé日"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for d in range(60)] + [(99, None)]
    items = []
    for i in range(100_000):
        n = rng.randrange(1, 12)
        p = "".join(rng.choice(letters) for _ in range(n))
        items.append((i, p if rng.random() < 0.7 else p[:n // 2] + "  " + p[n // 2:]))
    want = searched(docs, items)
    assert found(spark, docs, items) == want and len(want) > 10_000


def test_short_and_long_passages_together(spark):
    docs = [(1, "the cat sat on the mat"), (2, "concatenate  the\nmat"), (3, ""), (4, "x" * 5000 + " end")]
    items = [(1, "cat"), (2, "the mat"), (3, "at sat on the m"), (4, "a"), (5, " "), (6, None), (7, "nowhere"),
             (8, "x" * 4000), (9, "x" * 5001), (10, "cat"), (11, "e th"), (12, "x end")]
    assert found(spark, docs, items) == searched(docs, items)
    assert found(spark, docs, items[4:6]) == set()


def test_only_wanted_runs_leave_the_documents(spark):
    texts = [(1, "abcab cab" * 300), (2, "xyz𝒳é日"), (3, ""), (4, None), (5, "q" * 3), (6, "bca")]
    docs = spark.createDataFrame(texts, "doc_id long, t string")
    grams = ["bca", "cab ", "é日", "q", "𝒳", "none", "ab"]
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string")
    want = sorted((d, g) for d, t in texts for g in grams if g in (t or ""))
    assert sorted(map(tuple, passages.offered_grams(docs, wanted, [1, 2, 3, 4]).collect())) == want
    counts = {r["gram"]: r["n"] for r in passages.offered_grams(docs, wanted, [1, 2, 3, 4], count=True).collect()}
    assert counts == {g: sum(x == g for _, x in want) for g in grams if any(x == g for _, x in want)}
    assert passages.wanted_buckets(wanted).sum() <= len(grams)


def test_only_wanted_runs_of_words_leave_the_documents(spark):
    """Documents offered a row for every run of every length."""
    rng = random.Random(4)
    words = ["a", "bb", "é日", "𝒳", "no", "x" * 40]
    texts = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for d in range(200)] + [(500, None)]
    runs = [(n, " ".join(rng.choice(words) for _ in range(n))) for n in (1, 2, 3, 5, 8) for _ in range(3)]
    anchors = passages.run_anchors(spark.createDataFrame(sorted(set(runs)), "len int, t string")).collect()
    assert len({r["anchor"] for r in anchors}) == len(set(runs))
    got = passages.offered_anchors(
        spark.createDataFrame(texts, "doc_id long, t string").coalesce(1),
        spark.createDataFrame([(r["anchor"],) for r in anchors], "anchor long"), [1, 2, 3, 5, 8]).collect()
    want = {(d, r["len"], r["anchor"]) for d, t in texts for r in anchors if f" {r['t']} " in f" {t} "}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_passages_of_many_lengths_in_repeated_documents(spark):
    rng = random.Random(6)
    words = ["ab", "c", "é", "日本", "de", "fgh"]
    docs = [(d, "  ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for d in range(80)]
    items = []
    for i in range(300):
        t = " ".join(docs[rng.randrange(80)][1].split())
        a = rng.randrange(len(t) + 1)
        items.append((i, t[a:a + rng.randrange(60)]))
    want = searched(docs, items)
    assert found(spark, docs, items) == want and len(want) > 300
