"""Entropy balancing, fill-in-middle and collocations against plain-Python versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import EDGE_ROWS, rows

from docsearch_spark.llm import balance, collocations, infill

SF001 = "/root/testdata/sf0.001"
ROW = "doc_id bigint, text string, lang string, source string"


# ---------------------------------------------------------------- fill-in-middle

def infilled(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


MARKED = [(100, "has <S> inside"), (101, "ends in <"), (102, "<P"), (103, "a<S"), (104, "<M>"), (105, "<<<S<P"),
          (106, "é<é>日本"), (107, "<" * 50)]


def test_infill_equals_the_definition(spark, edge, monkeypatch):
    monkeypatch.setattr(infill, "PIECE_BYTES", 7)
    extra = spark.createDataFrame([(d, t, None, None) for d, t in MARKED], ROW)
    docs = edge.select("doc_id", "text", "lang", "source").unionByName(extra)
    want = {d: infilled(d, t) for d, t in [(r[0], r[1]) for r in EDGE_ROWS] + MARKED}
    text = {d: t for d, t in [(r[0], r[1]) for r in EDGE_ROWS] + MARKED}
    got = rows(infill.digests(infill.output_pieces(docs)))
    assert {d: tuple(r)[1:5] for d, r in got.items()} == {d: w[:4] for d, w in want.items()}
    assert all(got[d].output_sha256 == sha(want[d][4]) and got[d].restored_sha256 == sha(text[d]) for d in want)
    whole = rows(infill.assembled(infill.output_pieces(docs)))
    assert {d: r.output for d, r in whole.items()} == {d: w[4] for d, w in want.items()}
    assert infill.digests(infill.output_pieces(edge.limit(0))).count() == 0


def test_infill_of_repeated_rows_and_null_ids(spark):
    data = [(1, "a b c d e f")] * 3 + [(1, "other text here")] * 2 + [(None, "no id at all"), (None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.form, r.output_sha256, r.restored_sha256)
                  for r in infill.digests(infill.output_pieces(df)).collect())
    assert got == Counter((d, infilled(d, t)[1], sha(infilled(d, t)[4]), sha(t)) for d, t in data)


@settings(max_examples=200, deadline=None)
@given(parts=st.tuples(*[st.text(alphabet="<PSM>a", max_size=12)] * 3), form=st.sampled_from(["psm", "spm"]),
       size=st.integers(1, 5))
def test_reader_tells_every_byte_of_any_pieces(parts, form, size):
    if any(m.decode() in "".join(parts) for m in infill.MARKS):
        return
    out = b"".join(infill.MARKS[k] + parts[k].encode() for k in infill.ORDER[form])
    reader, found = infill.Reader(form), [b"", b"", b""]
    for i in range(0, len(out), size):
        for part, data in reader.feed(out[i:i + size]):
            found[part] += data
    assert found == [p.encode() for p in parts]


# ---------------------------------------------------------------- entropy mix

def plain_targets(total):
    """Targets by sources in order, None last."""
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    held, rest = {}, sum(total.values())
    while True:
        free = sum(w for s, w in weight.items() if s not in held)
        over = {s: 3.0 * total[s] for s, w in weight.items()
                if s not in held and w * rest > 3 * total[s] * free}
        if not over:
            return {s: held.get(s, weight[s] * rest / free if free else 0.0) for s in order}
        held |= over
        rest -= sum(over.values())


def plain_rates(sizes, target):
    """Rates min(3, exp(l * size)) that sum to ``target`` words, by bisection."""
    x = np.array([s for s in sizes if s], float)
    if not len(x):
        return {s: 1.0 for s in sizes}
    lo, hi = -50 / x.min(), math.log(3) / x.min()
    for _ in range(200):
        mid = (lo + hi) / 2
        if (x * np.minimum(3, np.exp(mid * x))).sum() < target:
            lo = mid
        else:
            hi = mid
    return {s: float(min(3.0, math.exp(hi * s))) for s in sizes}


def check_mix(out, source):
    groups = defaultdict(list)
    for r in out:
        groups[source[r.doc_id]].append(r)
    total = {s: sum(r["size"] for r in g) for s, g in groups.items()}
    want = plain_targets(total)
    for s, g in groups.items():
        assert g[0].source_size == total[s] and g[0].target == pytest.approx(want[s], rel=1e-12)
        rates = plain_rates([r["size"] for r in g], want[s])
        assert all(r.rate == pytest.approx(rates[r["size"]], rel=1e-5, abs=1e-9) for r in g)
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in g)
        largest = max(r["size"] for r in g)
        assert abs(sum(r.taken for r in g) - want[s]) <= largest
        if len(g) >= 30:  # enough documents to make up the rest
            assert abs(sum(r.taken for r in g) - want[s]) <= 0.01 * want[s] + 1


def test_mix_equals_bisection_on_edge_rows(spark, edge):
    out = balance.mix(edge).collect()
    assert len(out) == len(EDGE_ROWS)
    check_mix(out, {r[0]: r[3] for r in EDGE_ROWS})
    assert balance.mix(edge.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None), (2, " ", "en", "x")], ROW)
    assert {(r["size"], r.target, r.taken) for r in balance.mix(blank).collect()} == {(0, 0.0, 0)}


def test_mix_with_a_hot_source_and_caps(spark, monkeypatch):
    monkeypatch.setattr(balance, "BLOCK_SIZES", 16)
    monkeypatch.setattr(balance, "BLOCK_ROWS", 5)
    rng = random.Random(11)
    data = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "ä", None, "tiny"]) if i % 50 else "tiny"
        data.append((i, " ".join(["w"] * min(3000, int(rng.lognormvariate(3, 1.5)))), "en", source))
    df = spark.createDataFrame(data, ROW).repartition(5)
    out = balance.mix(df).collect()
    check_mix(out, {d: s for d, _, _, s in data})
    again = {r.doc_id: (r.taken, r.rate) for r in balance.mix(df.repartition(3)).collect()}
    assert {r.doc_id: (r.taken, r.rate) for r in out} == again


def test_mix_counts_repeated_rows_as_documents(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "x")] * 5 + [(2, "a", "en", "y")] * 4, ROW)
    out = balance.mix(df).collect()
    # y weighs 2: its share of 19 words is above 3 * 4
    assert sorted({(r.doc_id, r.source_size, r.target) for r in out}) == [(1, 15, 7.0), (2, 4, 12.0)]
    assert sum(r.taken for r in out if r.doc_id == 2) == 12
    assert sum(r.taken for r in out if r.doc_id == 1) == 6


# ---------------------------------------------------------------- collocations

def plain_collocations(docs, least, top=2000):
    out = {}
    per = defaultdict(list)
    for lang, text in docs:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            per[lang or "und"].append(re.findall(r"[^\x20\x09]+", piece))
    for lang, pieces in per.items():
        f = Counter(tuple(w[i:i + k]) for w in pieces for k in range(1, 5) for i in range(len(w) - k + 1))
        n = sum(map(len, pieces))
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * f[q] >= 80 * a for q in f if f[q] >= least and len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out[lang, i + 1] = (p.decode(), -a, left, right, n, -score)
    return out


def random_docs(seed, count):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c\x01", "c", "É", "é", "The", "x" * 40]
    for _ in range(count):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", ", ", "\n"])
                       for _ in range(rng.randrange(12)))
        yield rng.choice(["en", "en", None, "de"]), text


@pytest.mark.parametrize("least, top", [(3, 2000), (12, 10)])
def test_collocations_equal_brute_force(spark, least, top):
    data = list(random_docs(least, 600)) + [("en", None), (None, ""), ("fr", "...")]
    df = spark.createDataFrame([(t, lang, i) for i, (lang, t) in enumerate(data)],
                               "text string, lang string, f int").repartition(6)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score)
           for r in collocations.collocations(df, least=least, top=top).collect()}
    assert got == plain_collocations(data, least, top) and got


def test_collocations_of_edge_tables(spark, edge):
    docs = [(r[2], r[1]) for r in EDGE_ROWS]
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score)
           for r in collocations.collocations(edge).collect()}
    assert got == plain_collocations(docs, 30)
    assert collocations.collocations(edge.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(windows=st.lists(st.lists(st.sampled_from(["a", "b", "a\x01", "aa"]), min_size=1, max_size=4), min_size=1,
                        max_size=60), cuts=st.lists(st.integers(0, 60), max_size=3), least=st.integers(1, 5))
def test_runs_of_any_partitions_sum_to_the_counts(windows, cuts, least):
    stream = sorted(("en", "".join(w + " " for w in x), 1) for x in windows)
    got = Counter()
    borders = sorted({0, len(stream), *[min(c, len(stream)) for c in cuts]})
    for a, b in zip(borders, borders[1:]):
        for _, phrase, n in collocations.count_runs(iter(stream[a:b]), least):
            got[phrase] += n
    want = Counter("".join(w + " " for w in x[:k]) for x in windows for k in range(1, len(x) + 1))
    assert {p: n for p, n in got.items() if n >= least} == {p: n for p, n in want.items() if n >= least}


def test_cut_scores_are_exact_beyond_64_bits():
    a = 10 ** 17
    # both cuts score 999999 after flooring (a double would say 1000000): the first counts
    assert collocations.lowest_cut(a, [a + 1, a + 2], [a, a]) == (999999, a + 1, a)
    assert collocations.lowest_cut(a, [a, a * 3], [a, a]) == (500000, a * 3, a)
    assert collocations.lowest_cut(1, [5, 5], [5, 5]) == (200000, 5, 5)


def test_registered_results_have_the_contract_columns(spark):
    import __spark_entry__ as entry
    queries = entry.queries()
    mixed = queries["op11_entropy_mix"](spark, SF001)
    assert dict(mixed.dtypes) | {"target": "double", "taken": "bigint", "source_size": "bigint"} == dict(mixed.dtypes)
    check_mix(mixed.collect(), {r.doc_id: r.source for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()})
    assert queries["op13_collocations"](spark, SF001).columns == [
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"]
