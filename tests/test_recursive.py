"""The recursive splitter against a plain version that builds its pieces as strings."""

import random

import pytest

from docsearch_spark.operators.recursive import chunk_recursive, split_text


def plain(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[level], separators[level + 1:]
    if separator:
        first, *others = text.split(separator)
        parts = [p for p in [first, *[separator + x for x in others]] if p]
    else:
        parts = list(text)
    out, small = [], []

    def pack():
        held = []
        for part in small:
            if sum(map(len, held)) + len(part) > size and held:
                out.append("".join(held).strip())
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                    held.pop(0)
            held.append(part)
        out.append("".join(held).strip())
        small.clear()

    for part in parts:
        if len(part) < size:
            small.append(part)
        else:
            pack()
            out.extend(plain(part, size, overlap, finer))
    pack()
    return [c for c in out if c]


def texts(seed, count):
    rng = random.Random(seed)
    atoms = ["a", "bc", " ", " ", "\n", "\n\n", "\n\n\n", "é", "日本", "word", "\t", "\x1c"]
    for _ in range(count):
        yield "".join(rng.choice(atoms + ["x" * rng.randrange(60)]) for _ in range(rng.randrange(120)))


def test_equal_to_the_plain_version_on_many_texts():
    rng = random.Random(2)
    for text in texts(1, 1500):
        size = rng.randrange(2, 40)
        overlap = rng.randrange(0, size)
        assert split_text(text, size, overlap) == plain(text, size, overlap), (text, size, overlap)


def test_chunks_of_rows_keep_other_columns(spark):
    data = [(i, t, "x") for i, t in enumerate(texts(5, 200))] + [(900, None, "n"), (901, " \n ", "n"), (902, "", "n")]
    df = spark.createDataFrame(data, "doc_id int, text string, content2 string")
    got = {}
    for r in chunk_recursive(df, "text", 20, 5).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
        assert len(r["content"]) <= 20 and r["chunk_index"] == len(got[r["doc_id"]]) - 1
    assert got == {d: c for d, t, _ in data if (c := plain(t or "", 20, 5))}
    with pytest.raises(ValueError):
        chunk_recursive(df, "text", 10, 10)


def test_long_texts_take_linear_time():
    import time

    def seconds(n):
        text = ("word and more " * 40 + "\n") * n
        t = time.perf_counter()
        split_text(text, 500, 50)
        return time.perf_counter() - t

    seconds(10)
    assert seconds(2000) < 40 * max(seconds(200), 0.005)
