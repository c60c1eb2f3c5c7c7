"""Grounding, index maintenance, streaming ingest, file sources, driver contract."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sf_paths import SF001
from docsearch_spark.operators import ground as G
from docsearch_spark.operators import index as IX
from docsearch_spark.sources import files as FS
from docsearch_spark.sources.html import html_to_text

HITS_SCHEMA = ("query_id long, rank int, chunk_id string, doc_id string, source_path string, "
               "chunk_index int, content string, score double")


def hits_df(spark):
    rows = [(1, r, f"c{r}", f"d{r}", f"/p/{r}.md", 0, f"content {r}. More.", 1.0 - r / 10) for r in range(1, 12)]
    return spark.createDataFrame(rows, HITS_SCHEMA)


def test_prompt_text_exact(spark):
    h = hits_df(spark).filter("rank <= 2")
    q = spark.createDataFrame([(1, "What?")], "query_id long, question string")
    p = G.build_prompts(q, h).first()
    block = "\n\n---\n\n".join(f"[S{i}] (chunk_id=c{i}, file=/p/{i}.md)\ncontent {i}. More." for i in (1, 2))
    want = (f"Question: What?\n\nUse ONLY the sources below. If the answer is not in the sources, say you cannot "
            f"find it in the documents.\n\nSources:\n{block}\n\nAnswer concisely. After each sentence or claim "
            f"that uses a source, add a citation like [S1] or [S2] matching the source label.")
    assert p["user"] == want and p["system"] == G.SYSTEM_PROMPT and p["n_sources"] == 2


def test_citations_numeric_order_and_text_match(spark):
    h = hits_df(spark)
    a = spark.createDataFrame([(1, "x [S10] y [S2][S2] [S01] [S0] [S99] [S1]")], "query_id long, answer string")
    labels = a.select(G.citation_labels("answer")).first()[0]
    assert sorted(labels) == sorted(set(re.findall(r"\[S(\d+)\]", "x [S10] y [S2][S2] [S01] [S0] [S99] [S1]")))
    got = [r["chunk_id"] for r in G.resolve_citations(a, h).orderBy("cite_pos").collect()]
    assert got == ["c1", "c2", "c10"]


def test_empty_context_and_response(spark):
    h = hits_df(spark).filter("rank <= 3")
    q = spark.createDataFrame([(1, "q"), (2, "no hits")], "query_id long, question string")
    a = G.extractive_answers(h)
    r = {x["query_id"]: x for x in G.assemble_responses(q, h, a).collect()}
    assert r[2]["answer"] == G.NO_CONTEXT_ANSWER and r[2]["citations"] == [] and r[2]["retrieved"] == []
    assert r[1]["answer"] == "content 1. [S1]" and [c["chunk_id"] for c in r[1]["citations"]] == ["c1"]
    assert [x["chunk_id"] for x in r[1]["retrieved"]] == ["c1", "c2", "c3"]


def test_chat_history_pairs(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
            (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (1, 6, "user", "q4")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: [(x["question"], x["answer"]) for x in r["history"]]
           for r in G.chat_history(c).collect()}
    assert got == {1: [], 3: [("q1", "a1")], 4: [("q1", "a1")], 6: [("q1", "a1"), ("q3", "a3")]}


def test_assemble_fragments(spark):
    f = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "doc long, p int, t string")
    assert G.assemble_fragments(f, "doc", "p", "t", "\n").first()["text"] == "a\nb\n"
    assert G.assemble_fragments(f, "doc", "p", "t", "").first()["text"] == "ab"


def test_html_to_text(spark):
    html = ('<html><head><style>p{x}</style><script>var t="</p>";</script></head><body><!-- c -->'
            '<nav>Menu</nav><p>Tom &amp; Jerry &copy; &middot; &quot;hi&quot; &amp;lt;</p></body></html>')
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text("h")).first()[0] == 'Menu Tom & Jerry © · "hi" &lt;'


def test_replace_by_document_keeps_empty(spark):
    old = spark.createDataFrame([("a", 0, "old a"), ("b", 0, "old b"), ("c", 0, "old c")],
                                "doc_id string, chunk_index int, content string")
    new_docs = spark.createDataFrame([("a", "/a", "new a text"), ("b", "/b", "   ")],
                                     "doc_id string, source_path string, text string")
    new = IX.chunk_documents(new_docs).select("doc_id", "chunk_index", "content")
    got = sorted((r["doc_id"], r["content"]) for r in IX.replace_by_document(old, new).collect())
    assert got == [("a", "new a text"), ("b", "old b"), ("c", "old c")]
    purged = IX.replace_by_document(old, new, new_docs, purge_empty=True)
    assert sorted(r["doc_id"] for r in purged.collect()) == ["a", "c"]


def test_check_constraints(spark):
    c = spark.createDataFrame([("x", "d", "p", 0, "t"), ("x", "d", None, 1, "t"), ("y", None, "p", 2, "t")],
                              "chunk_id string, doc_id string, source_path string, chunk_index int, content string")
    r = IX.check_constraints(c).first()
    assert r["null_source_path"] == 1 and r["null_doc_id"] == 1 and r["dup_ids"] == 1 and r["dup_rows"] == 2


def test_ingest_summary(spark):
    docs = spark.createDataFrame([("a", "/a", "x " * 700), ("b", "/b", " ")],
                                 "doc_id string, source_path string, text string")
    s = IX.ingest_summary(docs, IX.chunk_documents(docs)).first()
    assert (s["files_processed"], s["chunks_written"]) == (2, 2)
    assert s["message"] == "Ingested 2 file(s), 2 chunk(s)."


def test_write_and_reingest(spark, tmpdir_path):
    docs = spark.createDataFrame([(i, f"/p/{i}", f"text of doc {i} " * 50) for i in range(20)],
                                 "doc_id long, source_path string, text string")
    path = os.path.join(tmpdir_path, "index")
    IX.write_index(IX.build_index(docs, n_buckets=4, dense=False), path)
    before = sorted(tuple(r) for r in spark.read.parquet(path).filter("doc_id <> 3")
                    .select("chunk_id", "content", "bucket").collect())
    changed = spark.createDataFrame([(3, "/p/3", "brand new words")], "doc_id long, source_path string, text string")
    IX.reingest(spark, path, changed, os.path.join(tmpdir_path, "stage"), n_buckets=4)
    after = spark.read.parquet(path)
    assert [r[0] for r in after.filter("doc_id = 3").select("content").collect()] == ["brand new words"]
    assert sorted(tuple(r) for r in after.filter("doc_id <> 3").select("chunk_id", "content", "bucket")
                  .collect()) == before


def test_streaming_ingest_keeps_newest_and_touches_few_buckets(spark, tmpdir_path):
    from docsearch_spark.sources.files import list_names
    from docsearch_spark.streaming import ingest as D

    def land(n, rows):
        spark.createDataFrame(rows, "doc_id long, source_path string, text string, version long") \
            .write.parquet(os.path.join(tmpdir_path, f"landing{n}"))
        # a checkpoint of its own each time: the stream starts anew, the index goes on
        D.start_incremental_ingest(spark, os.path.join(tmpdir_path, f"landing{n}"), root,
                                   os.path.join(tmpdir_path, f"ck{n}"), n_buckets=8, dim=8).awaitTermination()
        return sorted((r["doc_id"], r["content"]) for r in D.current_index(spark, root).collect())

    root = os.path.join(tmpdir_path, "idx")
    assert D.current_index(spark, root) is None
    first = [(i, f"/{i}", f"text {i}", 5) for i in range(40)]
    land(0, first)
    old = D._live(spark, root, 0)
    want = dict((i, f"text {i}") for i in range(40))
    want[2] = "two new"
    assert land(1, [(2, "/2", "two mid", 6), (2, "/2", "two new", 7)]) == sorted(want.items())
    new = D._live(spark, root, 1)
    assert sum(old[b] != new[b] for b in new) == 1  # one document, one bucket
    assert land(2, [(2, "/2", "two old", 6)]) == sorted(want.items())  # older, lands last
    want[99] = "late document"
    assert land(3, [(99, "/99", "late document", 1)]) == sorted(want.items())
    assert "embedding" in D.current_index(spark, root).columns
    live = set(D._live(spark, root, D._commits(spark, root)[-1]).values())
    assert len(D._commits(spark, root)) == 2 and len(live) == len(new)
    kept = [f"{root}/data/{c}/{b}" for c in list_names(spark, f"{root}/data")
            for b in list_names(spark, f"{root}/data/{c}") if b.startswith("bucket=")]
    assert live <= set(kept) and len(kept) <= len(live) + 1


def test_a_replayed_batch_commits_nothing(spark, tmpdir_path):
    from docsearch_spark.streaming import ingest as D
    batch = spark.createDataFrame([(1, "/1", "one", 1), (2, "/2", "two", 1)],
                                  "doc_id long, source_path string, text string, version long")
    assert D.merge_batch(batch, tmpdir_path, 1200, 200, 8, 2)
    before = D._commits(spark, tmpdir_path)
    assert D.merge_batch(batch, tmpdir_path, 1200, 200, 8, 2) == []
    assert D._commits(spark, tmpdir_path) == before


def test_provider_answers_are_matched_by_index(spark):
    import numpy as np
    from docsearch_spark.operators import embed
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(150)], "id long, t string")
    a = embed.embed_with_provider(df, "t", lambda: embed.HashedBowProvider(16)).collect()
    b = embed.embed_with_provider(df, "t", lambda: embed.OutOfOrderProvider(16)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    for response in ([(0, [1.0])], [(0, [1.0]), (0, [2.0])], np.zeros((3, 1))):
        with pytest.raises(ValueError):
            embed.in_request_order(response, 2, "p")
    with pytest.raises(ValueError):
        embed.same_provider(embed.HashedBowProvider(16), embed.HashedBowProvider(32))


def test_html_character_references(spark):
    from docsearch_spark.sources.html import html_to_text
    page = "<p>it&#8217;s &mdash; A&apos;s &#x41;&amp;lt; &unknown; &amp;amp;</p><!-- x --><script>&lt;</script>"
    got = spark.createDataFrame([(page,), (None,), ("plain",)], "h string").select(html_to_text("h").alias("t"))
    assert [r["t"] for r in got.collect()] == ["it\u2019s \u2014 A's A&lt; &unknown; &amp;", "", "plain"]


def test_passages_equal_contains(spark):
    from docsearch_spark.operators.passages import passage_matches
    docs = [(1, "the quick  brown fox jumps over the lazy dog"), (2, "xthe quick brown foxy"), (3, None), (4, "fox"),
            (5, "a b c d e f g h i j k l m n")]
    items = [(1, "the quick brown fox"), (2, "fox"), (3, "quick brown"), (4, " "), (5, None),
             (6, "b c d e f g h i j k l m"), (7, "b c x"), (8, "he quick brown fo")]
    got = passage_matches(spark.createDataFrame(docs, "d long, t string"), "d", "t",
                          spark.createDataFrame(items, "i long, p string"), "i", "p")
    norm = lambda x: " ".join((x or "").split())
    want = {(i, d) for i, p in items for d, t in docs if norm(p) and norm(p) in norm(t)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_newest_version_per_document(spark):
    b = spark.createDataFrame([(1, "/1", "a5", 5), (1, "/1", "a2", 2), (2, "/2", "b3", 3)],
                              "doc_id long, source_path string, text string, version long")
    got = sorted((r["doc_id"], r["text"]) for r in IX.newest_version(b).collect())
    assert got == [(1, "a5"), (2, "b3")]


def test_scan_and_route(spark, tmpdir_path):
    root = tmpdir_path
    files = {"B.MD": b"# Title\n", "sub/c.markdown": b"c", "d.csv": b"x", "e.txt": b"a\xffb",
             "f.txt": b"a\xe2\x82b", ".hid.txt": b"h", "_und.md": b"u", "g.pdf": b"%PDF"}
    for name, data in files.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    f = FS.scan_documents(spark, root)
    paths = [r["path"] for r in f.collect()]
    names = [p.rsplit("/", 1)[-1] for p in paths]
    assert set(names) == {"B.MD", "c.markdown", "e.txt", "f.txt", "g.pdf"}
    text, pdf, rejected = FS.route_by_type(f)
    decoded = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in text.collect()}
    assert decoded["e.txt"] == b"a\xffb".decode("utf-8", errors="replace")
    assert len(decoded["f.txt"]) == len(b"a\xe2\x82b".decode("utf-8", errors="replace"))
    assert pdf.count() == 1 and rejected.count() == 0
    assert FS.scan_documents(spark, os.path.join(root, "missing")).count() == 0
    with pytest.raises(ValueError):
        FS.scan_documents(spark, os.path.join(root, "d.csv"))


def test_report_roundtrip_and_series(spark, tmpdir_path):
    from docsearch_spark.operators import report as P
    rep = spark.createDataFrame(
        [("a", {"Recall@1": 0.1, "Recall@3": 0.2, "Recall@x": 9.0}, {"NDCG@1": 0.3, "NDCG@3": 0.4},
          {"MAP@1": 0.1}, {"P@1": 0.5, "P@3": 0.2}, 0.5, 2, "n", {"corpus_size": "3"}),
         ("", {"Recall@1": 0.6}, {"NDCG@1": 0.7}, {}, {}, 0.1, 1, "n", {})],
        "dataset string, recall_at_k map<string,double>, ndcg_at_k map<string,double>, "
        "map_at_k map<string,double>, precision_at_k map<string,double>, mrr double, num_queries int, "
        "notes string, extra map<string,string>")
    FS.write_report(rep.filter("dataset = 'a'"), os.path.join(tmpdir_path, "run_a.json"))
    FS.write_report(rep.filter("dataset = ''"), os.path.join(tmpdir_path, "run_b.json"))
    back = FS.read_reports(spark, [os.path.join(tmpdir_path, "run_a.json"), os.path.join(tmpdir_path, "run_b.json")])
    stem = F.regexp_extract("path", r"([^/]+)\.json/[^/]*$", 1)
    back = back.withColumn("run", stem).withColumn("label", P.run_label(F.lit(None).cast("string"), F.col("dataset"),
                                              F.concat(stem, F.lit(".json"))))
    assert sorted(r["label"] for r in back.collect()) == ["a", "run_b"]
    s = P.explode_metrics(back, label_col="label")
    assert sorted(r["k"] for r in s.filter("run = 'run_a' AND metric_map = 'recall_at_k'").collect()) == [1, 3]
    pairs = P.paired_series(s, "recall_at_k", "ndcg_at_k")
    assert sorted((r["run"], r["k"]) for r in pairs.collect()) == [
        ("run_a", 1), ("run_a", 3), ("run_b", 1)]
    mp = P.paired_series(s, "map_at_k", "precision_at_k")
    assert mp.count() == 0  # axes [1] and [1, 3] differ
    order = back.select("run", F.when(F.col("run") == "run_a", 0).otherwise(1).alias("ord"))
    comp = P.compare_runs(s, order)
    assert sorted(set(r["run"] for r in comp.collect())) == ["run_a"]  # run_b has axis [1] only


def test_runs_with_one_label_stay_apart(spark):
    from docsearch_spark.operators import report as P
    s = spark.createDataFrame([(r, "scifact", m, k, float(k + n)) for n, r in enumerate(("x", "y"))
                               for m in ("recall_at_k", "ndcg_at_k") for k in (1, 3)],
                              "run string, label string, metric_map string, k int, value double")
    order = spark.createDataFrame([("x", 0), ("y", 1)], "run string, ord int")
    assert P.paired_series(s, "recall_at_k", "ndcg_at_k").count() == 4
    assert P.compare_runs(s, order).count() == 8
    wide = P.compare_runs_wide(s, order, ["x", "y"]).filter("metric_map = 'ndcg_at_k'").orderBy("k").collect()
    assert [(r["k"], r["x"], r["y"]) for r in wide] == [(1, 1.0, 2.0), (3, 3.0, 4.0)]
    assert P.compare_runs(s.filter("run = 'x'"), order.filter("run = 'x'")).count() == 0


def test_driver_contract(spark):
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "chunk_index", "score"]
    assert df.count() == 5 * spark.read.parquet(f"{SF001}/benchmark.parquet").count()
