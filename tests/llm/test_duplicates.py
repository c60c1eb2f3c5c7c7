"""Exact dedup, Jaccard join, substring dedup, containment searches."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import components, contained, exact, repeats
from llm_helpers import EDGE_ROWS, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsearch_spark.llm import containment, decontaminate, licenses, quotient, recompress, vertical

SF001 = "/root/testdata/sf0.001"
EDGE = [(d, t) for d, t, *_ in EDGE_ROWS]


def near_copies(n=60, seed=2):
    """A group of near copies around the threshold, others, and a passage that all hold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    docs = []
    for i in range(n):
        if i % 3:
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))]
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    return docs


@pytest.fixture(scope="module")
def small(spark):
    docs = near_copies()
    return docs, spark.createDataFrame(docs, "doc_id bigint, text string")


# ---- counting quotient filters

@settings(max_examples=60, deadline=None)
@given(parts=st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=40), max_size=5),
       bits=st.integers(14, 30))
def test_filters_pack_and_merge_losslessly(parts, bits):
    packed = []
    for part in parts:
        p, c = np.unique(np.array(part, np.uint64), return_counts=True)
        filters = quotient.pack(p, c, bits)
        packed += [dict(zip(filters, row)) for row in zip(*filters.values())]
    want = Counter(x for part in parts for x in part)
    got = Counter()
    for block in {r["block"] for r in packed}:
        prints, counts = quotient.merge([quotient.unpack(r, bits) for r in packed if r["block"] == block])
        assert list(prints) == sorted(prints)
        got.update(dict(zip(prints.tolist(), counts.tolist())))
    assert got == want


def test_exact_dedup_edge_rows(edge):
    got = rows(quotient.exact_dedup(edge))
    want = exact(EDGE)
    assert {d: (r.keep_id, r.group_size, r.kept, r.text_sha256) for d, r in got.items()} == want
    assert want[0][0] == want[1][0] == 1  # the longer original stays
    assert quotient.exact_dedup(edge.limit(0)).count() == 0


def test_exact_dedup_of_one_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.col("id").cast("string")).alias("text"))
    got = quotient.exact_dedup(docs).groupBy("group_size").count().collect()
    assert {r.group_size: r["count"] for r in got} == {1000: 1000, 1: 2000}


# ---- Jaccard join

def test_components_equal_brute_force(small, edge):
    docs, df = small
    assert {d: (r.n_shingles, r.component_id) for d, r in rows(vertical.similar_components(df)).items()} \
        == components(docs)
    assert {d: (r.n_shingles, r.component_id) for d, r in rows(vertical.similar_components(edge)).items()} \
        == components(EDGE)
    assert vertical.similar_components(edge.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    """Neighbours link, others do not: labels must travel the whole chain."""
    stream = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(stream[5 * i:5 * i + 84])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = components(docs)
    assert len({c for _, c in want.values()}) < 3
    got = rows(vertical.similar_components(df))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want


def test_repeated_rows_give_no_false_links(spark):
    """Half-equal pairs, both sides twice; then documents with a second text."""
    def some(n, name):
        return [f"{name}x{i}" for i in range(n)]

    ones = [(k, " ".join(some(49, f"both{k}") + some(55, f"a{k}"))) for k in range(12)]
    twos = [(100 + k, " ".join(some(49, f"both{k}") + some(55, f"b{k}"))) for k in range(12)]
    near = [(200, ones[0][1] + " more"), (201, None), (201, ""), (201, " \n")]
    docs = ones + ones + twos + twos + near
    want = components(docs)
    assert want[0][1] == want[200][1] == 0 and want[100][1] == 100
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartitionByRange(8, "doc_id")
    got = vertical.similar_components(df).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, n, c) for d, (n, c) in want.items()}
    # the longest text tells the document
    second = spark.createDataFrame([(0, "short text"), (300, "short text"), (100, " " * 5000)],
                                   "doc_id bigint, text string")
    got = vertical.similar_components(df.unionByName(second)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, c) for d, (_, c) in want.items()} | {(300, 300)}
    assert sorted(r.n_shingles for r in got if r.doc_id == 0) == [1, 100, 100]


# ---- substring dedup

@settings(max_examples=80, deadline=None)
@given(core=st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=13, max_size=40),
       before=st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=8),
       after=st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=8),
       other=st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=8))
def test_equal_windows_have_equal_anchors(core, before, after, other):
    parse = recompress.Parse([before + core + after, other, other + core, core])
    at, key = parse.anchors()
    seen = {}
    for t, k in zip(at, key):
        assert seen.setdefault(tuple(parse.words[t:t + recompress.WINDOW]), k) == k


def test_substring_dedup_equals_brute_force(small, spark, edge):
    docs, df = small
    full = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for given_docs, frame in ((docs, df), (EDGE, edge),
                              (full, spark.createDataFrame(full, "doc_id bigint, text string"))):
        got = rows(recompress.remove_repeats(frame).withColumn("sha", F.sha2("kept", 256)))
        assert {d: (r.n_words, r.n_removed, r.sha) for d, r in got.items()} == repeats(given_docs)
    assert recompress.remove_repeats(edge.limit(0)).count() == 0


def plain_rows(data, size=recompress.WINDOW):
    """(doc, words, removed, kept) of each row, judged on its own text."""
    split = [(d, (t or "").encode().split()) for d, t in data]
    first = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            if d is not None:
                first[tuple(w[i:i + size])] = min(d, first.get(tuple(w[i:i + size]), d))
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        yield d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


def test_rows_with_one_doc_id_are_judged_each_on_its_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rng = random.Random(9)
    parts = [a, b, c, "x y z", ""] + [" ".join(f"{x}{i}" for i in range(14)) for x in "defg"]
    many = [(rng.choice([1, 1, 2, 3, 5, None]), " ".join(rng.choice(parts) for _ in range(rng.randrange(4))))
            for _ in range(60)]
    for data in ([(1, a), (5, a), (5, b), (6, f"{c} {b}")],
                 [(1, f"{a} {c}"), (5, f"x y z {a}"), (5, b)],
                 [(2, a), (2, a), (1, f"{a} x"), (2, None)], many):
        df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
        got = recompress.remove_repeats(df).collect()
        assert Counter(map(tuple, got)) == Counter(plain_rows(data))


def test_intervals_by_shuffle_give_the_same(small, monkeypatch):
    docs, df = small
    monkeypatch.setattr(recompress, "SENT_INTERVALS", -1)
    got = rows(recompress.remove_repeats(df))
    assert {d: r.n_removed for d, r in got.items()} == {d: r[1] for d, r in repeats(docs).items()}


# ---- containment

def test_bands_guarantee_the_collision_probability():
    n = containment.bands_for(80, 1e-4)
    least = 0.8 * 0.5 / 2.1
    assert (1 - least) ** n <= 1e-4 < (1 - least) ** (n - 1)


def test_decontamination_equals_brute_force(small, spark, edge):
    docs, df = small
    rng = random.Random(8)
    items = [(0, docs[1][1]), (1, " ".join(docs[3][1].split()[5:40])), (2, None), (3, ""), (4, "w1 w2"),
             (5, "word"), (6, " ".join(docs[1][1].split()[:30]) + " other words at the end")]
    long = " ".join(rng.choice(["p", "q", "r", "s"]) + str(rng.randrange(99)) for _ in range(5000))
    docs = docs + [(900, long + " " + items[1][1] + " " + long), (901, "word"), (902, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got.collect()} == contained(docs, items)
    assert (900, 1) in contained(docs, items)
    got = decontaminate.contaminated(edge, bench.withColumn("score", F.lit(1)))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(contained(EDGE, items))
    assert decontaminate.contaminated(edge.limit(0), bench).count() == 0
    assert decontaminate.contaminated(edge, bench.limit(0)).count() == 0


def test_containment_of_repeated_rows_and_rows_without_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    docs = spark.createDataFrame(
        [(1, a), (1, a), (None, a), (None, "x y z " + b), (2, "nothing of it is in here")],
        "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, a), (7, a), (7, b), (None, b), (8, a), (9, None)],
                                  "item_id bigint, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert all(r.n_shingles == r.n_found == 8 and r.containment == 1.0 for r in got)
    found = Counter((r.doc_id, r.item_id) for r in got)
    assert found == {(1, 7): 1, (1, 8): 1, (None, 7): 2, (None, 8): 1, (None, None): 1}
    scanned = licenses.scan(docs, bench.select(F.col("item_id").cast("string"), "text")).collect()
    assert Counter((r.doc_id, r.license) for r in scanned) == {
        (d, i if i is None else str(i)): n for (d, i), n in found.items()}
    assert licenses.scan(docs.limit(0), licenses.templates(spark)).count() == 0
    assert licenses.scan(docs, licenses.templates(spark).limit(0)).count() == 0


def test_planted_passages_are_all_retrieved(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(5, 90))))
             for i in range(400)]
    docs = []
    for i, t in items:  # whole, or with as many changed words as still leave 80 % of the shingles
        w = t.split()
        if len(w) > 34:
            w[rng.randrange(5, len(w) - 5)] = "changed"
        around = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(3000))]
        at = rng.randrange(len(around) + 1)
        docs.append((i, " ".join(around[:at] + w + around[at:])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                     spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got.collect()} == contained(docs, items)


def test_license_scan(spark, edge):
    mit = licenses.TEMPLATES["mit-permission"]
    words = mit.split()
    words[10] = "changed"
    docs = spark.createDataFrame([
        (1, "intro\n" + mit.upper().replace(",", " ;") + " outro"), (2, " ".join(words)),
        (3, " ".join(words[:40])), (4, "Code. Released under the MIT license!"), (5, None), (6, "")],
        "doc_id bigint, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs, licenses.templates(spark)).collect()}
    assert set(got) == {(1, "mit-permission"), (2, "mit-permission"), (4, "mit-line")}
    assert got[1, "mit-permission"].containment == 1.0 and got[1, "mit-permission"].first_word == 1
    assert got[2, "mit-permission"].containment < 1.0
    assert licenses.scan(edge, licenses.templates(spark)).count() == 0


def test_native_operators_run_no_python(spark):
    bench = decontaminate.benchmark_items(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for df in (decontaminate.contaminated(docs, bench), licenses.scan(docs, licenses.templates(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
