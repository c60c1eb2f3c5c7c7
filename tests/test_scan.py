import random

from pyspark.sql import functions as F

from docsearch_spark.operators import scan


def plain_positions(rows):
    """(conv, turn) -> (is_pair, answer, n_history, history_chars), one list at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv and r[2] not in (None, "system")), key=lambda r: r[1])
        n = chars = 0
        for i, (_, turn, role, text) in enumerate(turns):
            if role != "user":
                continue
            after = turns[i + 1] if i + 1 < len(turns) else None
            pair = after is not None and after[2] == "assistant"
            out[conv, turn] = (pair, after[3] if pair else None, n, chars)
            if pair:
                n += 1
                chars += len(text or "") + len(after[3] or "")
    return out


def test_chat_positions_equal_plain_version_for_any_block_size(spark):
    rnd = random.Random(3)
    rows = [(conv, turn, rnd.choice(["user", "user", "assistant", "assistant", "system", None, "tool"]),
             rnd.choice([None, "", "a", "word " * rnd.randint(1, 5), "é😀"]))
            for conv, n in ((1, 90), (2, 1), (3, 7), (None, 12), (4, 40)) for turn in range(n)]
    c = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn(
        "extra", F.lit(1)).repartition(3)
    want = plain_positions(rows)
    for size in (1, 7, 1000):
        got = {(r.conv_id, r.turn): (r.is_pair, r.answer, r.n_history, r.history_chars)
               for r in scan.chat_positions(c, block_rows=size).collect()}
        assert got == want, size


def test_offsets_cut_the_assembled_text(spark):
    parts = [("a", i, None if i % 4 == 1 else "x" * (i % 6)) for i in range(50)] + [("b", 0, ""), ("c", None, "é")]
    f = spark.createDataFrame(parts, "doc string, p int, t string")
    got = scan.fragment_offsets(f, "doc", "p", "t", "--", block_rows=8).collect()
    assert len(got) == len(parts)
    for doc in "abc":
        whole = "--".join(t or "" for d, _, t in parts if d == doc)
        for r in got:
            if r.doc == doc:
                assert whole[r.start:r.start + r.n_chars] == r.t


def test_empty_tables(spark):
    assert scan.chat_positions(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert scan.fragment_offsets(spark.createDataFrame([], "d long, p int, t string"), "d", "p", "t").count() == 0


def test_one_conversation_of_a_million_turns_is_many_tasks(spark):
    n = 1_000_000
    c = spark.range(n).select(
        F.lit(7).alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.col("id").cast("string").alias("text"))
    rows = scan.blocked(c, "conv_id", "turn", 100_000)
    sizes = [r["count"] for r in rows.groupBy(scan.BLOCK).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < n / 4  # the windows work on (conversation, block)
    got = scan.chat_positions(c, block_rows=100_000)
    assert got.filter((F.col("n_history") != F.col("turn") / 2) | ~F.col("is_pair")
                      | (F.col("answer") != (F.col("turn") + 1).cast("string"))).count() == 0
    assert got.count() == n // 2
