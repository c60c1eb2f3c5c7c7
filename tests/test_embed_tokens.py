"""The embedder cuts tokens from bytes as Spark's pattern would; hits meet chunks without moving them."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docsearch_spark.functions.text import tokens
from docsearch_spark.operators import embed

DIM = 97
EDGES = [None, "", " . ", "İSTANBUL ΣΑΣ", "a_b-c9", "́x½", "😀a😀", "é.ÉÈ;ñ", "٣٤ x", "\x00a\x7fb"]


def some_texts(n):
    rng = random.Random(5)
    ranges = [(32, 127), (0x80, 0x250), (0x250, 0xD7FF), (0xE000, 0x10000), (0x10000, 0x110000)]
    return EDGES + ["".join(chr(rng.randrange(*rng.choice(ranges[:1] * 4 + ranges))) for _ in range(rng.randrange(50)))
                    for _ in range(n)]


def vector(words):
    out = np.zeros(DIM)
    for w in words:
        out[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % DIM] += 1
    return out / (np.linalg.norm(out) or 1)


def test_embeds_the_tokens_of_sparks_pattern(spark):
    df = spark.createDataFrame(list(enumerate(some_texts(3000))), "id int, t string").repartition(3)
    want = {r["id"]: vector(r["w"]) for r in df.select("id", tokens("t").alias("w")).collect()}
    got = embed.embed_sparse(df, "t", DIM).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["sv_idx"] == np.flatnonzero(want[r["id"]]).tolist()
        assert np.allclose(r["sv_val"], want[r["id"]][r["sv_idx"]], rtol=1e-12)


def test_no_pattern_is_run_over_the_texts(spark):
    """Cutting tokens was a list of strings a text, made in Spark and handed to Python."""
    df = spark.createDataFrame([(1, "a b")], "id int, t string")
    plan = embed.embed_sparse(df, "t", DIM)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_sliced_arrays_and_only_ascii():
    held = pa.array(["x", "one Two", "", None, "Zwei-drei"]).slice(1)
    of, words = embed.cut_tokens(held, lambda codes: codes > 0)
    assert of.tolist() == [0, 0, 3, 3] and words.to_pylist() == ["one", "Two", "Zwei", "drei"]
    of, words = embed.cut_tokens(pa.array([], pa.string()), None)
    assert not len(of) and not len(words)


def test_provider_counts_as_a_loop_over_the_texts():
    regex = pytest.importorskip("regex")
    texts = some_texts(500)
    got = embed.HashedBowProvider(DIM).embed(texts)
    want = [vector(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())) for t in texts]
    assert np.allclose(got, want, rtol=1e-12)


def test_few_hits_are_sent_to_the_chunks(spark, monkeypatch):
    """text_topk shuffled every chunk's content to join a few hits."""
    from docsearch_spark.plans import catalog
    from sf_paths import SF001
    plans = {}
    real = catalog.materialize

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(catalog, "materialize", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # the hits' size, not the chunks'
    try:
        catalog.text_topk(spark, SF001, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["hits"] and "SortMergeJoin" not in plans["hits"]
