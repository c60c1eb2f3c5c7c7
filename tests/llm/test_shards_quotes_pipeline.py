"""Karmarkar-Karp shards, quotation linking, the pipeline and the contract."""

import random
import zlib

import numpy as np
from brute import components, contained, exact
from llm_helpers import EDGE_ROWS, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from docsearch_spark.llm import langid, quotes, sharding

SF001 = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 1000), min_size=1, max_size=60), shards=st.integers(2, 6))
def test_differencing_places_every_group_once(sizes, shards):
    places = sharding.difference(([s] + [0] * (shards - 1) for s in sizes), shards)
    assert all(sorted(p) == list(range(shards)) for p in places)
    totals = [0] * shards
    for s, p in zip(sizes, places):
        totals[p[0]] += s
    assert sum(totals) == sum(sizes)
    assert max(totals) - min(totals) <= max(sizes)


def test_differencing_beats_largest_first():
    rng = random.Random(4)
    sizes = [int(rng.lognormvariate(7, 1)) for _ in range(2000)]
    totals = [0] * 16
    for s, p in zip(sizes, sharding.difference(([s] + [0] * 15 for s in sizes), 16)):
        totals[p[0]] += s
    greedy = [0] * 16
    for s in sorted(sizes, reverse=True):
        greedy[int(np.argmin(greedy))] += s
    assert max(totals) - min(totals) <= max(greedy) - min(greedy)
    assert max(totals) - min(totals) <= 2


def test_levels_of_buckets_balance_whole_groups(spark, monkeypatch):
    """130 buckets, then 33, 9, 3 and 1; one group larger than a shard, and null doc_ids."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 20)
    monkeypatch.setattr(sharding, "BUCKET_VECTORS", 4)
    rng = random.Random(8)
    data = [(None if i % 50 == 0 else i, f"text {i} " + "x" * int(rng.lognormvariate(4, 1))) for i in range(2600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = sharding.shard(df).collect()
    assert len(out) == len(data) and {r.shard for r in out} <= set(range(16))
    totals = [0] * 16
    for r in out:
        totals[r.shard] += r.size
    assert max(totals) - min(totals) <= max(r.size for r in out)
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    big = df.unionByName(spark.createDataFrame([(9000 + i, "same " * 100_000) for i in range(3)], df.schema))
    out = sharding.shard(big).collect()
    assert len({r.shard for r in out if r.doc_id and r.doc_id >= 9000}) == 1
    totals = [0] * 16
    for r in out:
        totals[r.shard] += r.size
    assert sorted(totals)[-1] == 3 * 500_001  # the group is alone, the rest is even
    assert sorted(totals)[-2] - min(totals) <= max(r.size for r in out if r.size < 500_000)


def test_shards_of_edge_rows_and_many_buckets(spark, edge, monkeypatch):
    got = rows(sharding.shard(edge))
    text = {d: t or "" for d, t, *_ in EDGE_ROWS}
    assert {d: (r.size, r.text_crc32) for d, r in got.items()} == {
        d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in text.items()}
    assert got[10].shard == got[11].shard and got[2].shard == got[3].shard
    assert sharding.shard(edge.limit(0)).count() == 0
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 20)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    out = sharding.op7_shards(spark, SF001).collect()
    totals, slots = [0] * 16, [[] for _ in range(16)]
    for r in out:
        totals[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(out) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(totals) - min(totals) <= 0.1 * sum(totals) / 16  # buckets of a few groups each


def test_shards_of_whole_table_are_a_byte_apart(spark):
    out = sharding.op7_shards(spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()
    totals = [r["sum(size)"] for r in out]
    assert len(totals) == 16 and max(totals) - min(totals) <= 1


THREAD = [
    (1, 0, "u", "Hello world\nThis is line two"),
    (1, 1, "a", "I answer here.\n\nSecond para of answer."),
    (1, 2, "u", "On Monday, u wrote:\n> Hello world\n> This is line two\nmy reply to first"),
    (1, 3, "a", "> > Hello world\n> > This is line two\n> my reply   to FIRST\nok"),
    (1, 4, "u", ">Second para of answer.\nyes"),
    (2, 0, "u", None),
    (2, 2, "u", "> unknown\n"),
    (None, 1, "x", "a"),
    (2, None, "x", "b"),
]


def test_quotes_link_and_order(spark):
    df = spark.createDataFrame(THREAD, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(df).collect()}
    assert len(got) == len(THREAD)
    assert [(got[1, t].parent_turn, got[1, t].level, got[1, t].position) for t in range(5)] == [
        (None, 0, 0), (0, 1, 1), (0, 1, 2), (2, 2, 3), (1, 2, 4)]
    assert got[1, 2].own_text == "my reply to first" and got[1, 3].own_text == "ok"
    assert (got[1, 3].n_passages, got[1, 3].n_linked, got[1, 3].max_depth) == (2, 2, 2)
    assert got[2, 2].n_linked == 0 and got[2, 2].own_text == "" and got[2, 2].root_turn == 2
    assert got[None, 1].position == 0 and got[2, None].level == 0
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_reply_order_of_one_long_conversation(spark):
    rng = random.Random(6)
    lines = [f"message number {i} says {rng.random()}" for i in range(300)]
    parent = {i: rng.randrange(i) for i in range(1, 300)}
    data = [(7, i, "r", (f"> {lines[parent[i]]}\n" if i else "") + lines[i]) for i in range(300)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    got = rows(quotes.reply_ordered(df), "turn")
    assert {t: got[t].parent_turn for t in parent} == parent
    level = {0: 0}
    for i in range(1, 300):
        level[i] = level[parent[i]] + 1
    assert {t: r.level for t, r in got.items()} == level
    order = sorted(level, key=lambda t: (level[t], t))
    assert [got[t].position for t in order] == list(range(300))
    assert all(got[t].own_text == lines[t] for t in got)


def sure(row):
    """Mean probability of the words' labels."""
    return (sum(s["p"] * (s["end"] - s["start"]) for s in row.spans)
            / sum(s["end"] - s["start"] for s in row.spans))


def test_mixed_languages_stay(spark):
    """Texts of three or more languages in equal parts, which no language dominates."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    parts = {}
    for r in docs.where("lang is not null and text is not null").orderBy("doc_id").collect():
        words = r.text.split()
        if len(words) >= 20:
            parts.setdefault(r.lang, []).append(" ".join(words[:20]))
    n = min(5, min(map(len, parts.values())))
    mixed = [(100_000 + i, " ".join(texts[i] for texts in parts.values())) for i in range(n)]
    assert len(parts) >= 3
    extra = spark.createDataFrame(mixed, "doc_id long, text string")
    out = corpus_pipeline.language(spark, docs.unionByName(extra, allowMissingColumns=True), SF001)
    assert {d for d, _ in mixed} <= {r.doc_id for r in out.collect()}


def test_leaks_without_doc_id_go(spark):
    import corpus_pipeline
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, "before " + item), (None, "clean words that stand in no item at all"),
                                  (5, item + " after"), (6, None), (None, None)], "doc_id long, text string")
    out = corpus_pipeline.leaks(spark, docs, SF001)
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == [
        ("None", "clean words that stand in no item at all")]
    assert out.count() == 3 and out.columns == docs.columns


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    found = rows(langid.identify(docs))
    left = [(r.doc_id, r.text) for r in docs.collect()
            if found[r.doc_id].lang_pred != langid.UNKNOWN and sure(found[r.doc_id]) >= corpus_pipeline.MIN_CONFIDENCE]
    kept = exact(left)
    left = [(d, t) for d, t in left if kept[d][2]]
    groups = components(left)
    left = [(d, t) for d, t in left if groups[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    leaked = {d for d, _ in contained(left, items)}
    want = {d for d, _ in left if d not in leaked}
    got = rows(corpus_pipeline.run(spark, SF001))
    assert set(got) == want and leaked


def test_stages_keep_the_columns_and_survive_edge_rows(spark, edge):
    import corpus_pipeline
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF001).count() == 0
        docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {1, 5, 7, 8, 9, 10}


def test_registered_queries():
    import __spark_entry__ as entry
    queries = entry.queries()
    assert "pipeline" in queries
    assert all(any(k.startswith(f"op{n}_") for k in queries) for n in range(1, 11))
