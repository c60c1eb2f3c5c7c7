"""Language ID, lattice scores and byte-level BPE."""

import hashlib
import itertools
import math
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import base_scores
from llm_helpers import EDGE_ROWS, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from docsearch_spark.llm import bpe, langid, lattice

SF01 = "/root/testdata/sf0.01"


# ---- byte-level BPE

@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.load_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_equals_tiktoken_on_any_text(codec, text):
    ours, theirs = codec
    ids = ours.encode(text)
    assert list(array("I", ids)) == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_bpe_equals_tiktoken_on_long_unbroken_runs(codec):
    ours, theirs = codec
    rng = random.Random(5)
    for text in ("a" * 5000, "".join(rng.choice("abcdetion") for _ in range(5000)), "🙂" * 400):
        assert list(array("I", ours.encode(text))) == theirs.encode_ordinary(text)


def test_bpe_query_on_edge_rows(edge, codec):
    got = rows(bpe.tokenize(edge))
    for d, text, *_ in EDGE_ROWS:
        ids = codec[1].encode_ordinary(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.tokenize(edge.limit(0)).count() == 0


# ---- language ID

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    labels, lengths = 3, (3, 1, 4)
    scores = rng.normal(size=(sum(lengths), labels)) * 2
    first = np.zeros(len(scores), bool)
    first[np.cumsum((0, *lengths[:-1]))] = True
    trans, start = rng.normal(size=(labels, labels)), rng.normal(size=labels)
    want, at, pairs = [], 0, np.zeros((labels, labels))
    for n in lengths:
        part, own, two, total = scores[at:at + n], np.zeros((n, labels)), np.zeros((labels, labels)), 0.0
        for y in itertools.product(range(labels), repeat=n):
            w = math.exp(start[y[0]] + sum(part[i, y[i]] for i in range(n))
                         + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            for i in range(n):
                own[i, y[i]] += w
            for i in range(1, n):
                two[y[i - 1], y[i]] += w
        want.append(own / total)
        pairs += two / total
        at += n
    for piece in (1, 2, 3, 5, 64):
        p = langid.marginals(scores, first, trans, start, piece)
        assert np.allclose(p, np.concatenate(want))
    assert np.allclose(langid.pair_marginals(scores, p, first, trans, start), pairs)


def test_language_id_on_held_out_rows(spark):
    got = langid.op1_language_id(spark, SF01)
    lang = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    out = got.join(lang, "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_code_switched_text_gets_spans_of_both_languages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.train(docs.where("lang IN ('en', 'de')"))
    texts = {r.lang: r.text for r in docs.where("length(text) BETWEEN 500 AND 900 AND lang IN ('en', 'de')")
             .orderBy("doc_id").collect()}
    a, b = texts["en"].split()[:40], texts["de"].split()[:40]
    mixed = spark.createDataFrame([(1, " ".join(a + b))], "doc_id bigint, text string")
    spans = langid.label(mixed, model).first().spans
    by_word = [s.lang for s in spans for _ in range(s.start, s.end)]
    assert len(by_word) == 80
    assert by_word[:40].count("en") >= 36 and by_word[40:].count("de") >= 36


def test_a_run_without_spaces_counts_whole():
    """The ends of a long run are of one language, all between of another."""
    en = "the quick brown fox jumps over lazy dogs while this water with them thought".split()
    de = "der schnelle braune fuchs springt über zwölf faule hunde während dieses wasser".split()
    rng = random.Random(6)

    def some(words, n):
        return [rng.choice(words) for _ in range(n)]

    model = langid.fit([(lang, some(words, 16)) for lang, words in (("en", en), ("de", de)) for _ in range(60)])
    run = "".join(some(en, 14)) + "".join(some(de, 200)) + "".join(some(en, 14))
    found = langid.Labeller(model).label([run, "the " + run + " fox", " ".join(en), "." * 100])
    assert found[0][0] == "de" and found[0][1] > 0.7
    assert [(x["start"], x["end"], x["lang"]) for x in found[0][2]] == [(0, 1, "en"), (0, 1, "de"), (0, 1, "en")]
    assert found[1][0] == "de"
    assert [(x["start"], x["end"], x["lang"]) for x in found[1][2]] == [(0, 2, "en"), (1, 2, "de"), (1, 3, "en")]
    assert found[2][0] == "en" and found[3][0] == langid.UNKNOWN
    parts, owner = langid.positions("a " + run)
    assert "".join(parts[1:]) == run and owner == [0] + [1] * (len(parts) - 1)


def test_language_id_edge_rows(edge):
    got = rows(langid.identify(edge))
    assert len(got) == len(EDGE_ROWS)
    for d in (2, 3, 4, 6):
        assert (got[d].lang_pred, got[d].score, got[d].spans) == (langid.UNKNOWN, 0.0, [])
    assert got[5].lang_pred in ("en", "fr")
    assert langid.identify(edge.limit(0)).count() == 0
    untrained = rows(langid.label(edge, langid.train(edge.limit(0))))
    assert {r.lang_pred for r in untrained.values()} == {langid.UNKNOWN}


# ---- lattice scores

def test_lattice_sum_and_expected_uses_equal_enumeration():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba"] + [""] * 256
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(len(pieces))))
    table = lattice.Lattice(pieces, log_p, list(range(8, 264)))
    number = {p: i for i, p in enumerate(pieces) if p}
    words = ["abab", "a", "bbaba", "éab", ""]

    def ways(rest):
        if not rest:
            yield []
        for n in range(1, len(rest) + 1):
            head = [number[rest[:n]]] if rest[:n] in number else \
                [8 + b for b in rest[0].encode()] if n == 1 else None
            if head is not None:
                for tail in ways(rest[n:]):
                    yield head + tail

    counts = np.array([3.0, 1.0, 2.0, 5.0, 1.0])
    whole = np.array([-4.0, -np.inf, -2.0, -np.inf, -np.inf])
    want_uses, want_kept = np.zeros(len(pieces)), np.zeros(len(words))
    for k, w in enumerate(words):
        all_ways = list(ways("▁" + w))
        weights = np.array([np.exp(log_p[way].sum()) for way in all_ways])
        assert np.isclose(table.log_sums([w])[0], np.log(weights.sum()))
        total = weights.sum() + np.exp(whole[k])
        want_kept[k] = counts[k] * np.exp(whole[k]) / total
        for way, x in zip(all_ways, weights):
            for i in way:
                want_uses[i] += counts[k] * x / total
    uses, kept = table.expected(words, counts, whole)
    assert np.allclose(uses, want_uses) and np.allclose(kept, want_kept)


def test_lattice_lookup_hands_on_only_pieces():
    """All places of all lengths were handed on and searched for pieces again, forwards and backwards."""
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("▁abcé") for _ in range(rng.randrange(1, 7))) for _ in range(1500)}) + [""] * 256
    by_byte = list(range(len(pieces) - 256, len(pieces)))
    table = lattice.Lattice(pieces, np.log(np.full(len(pieces), 1 / len(pieces))), by_byte)
    words = ["".join(rng.choice("abcéx") for _ in range(rng.randrange(9))) for _ in range(300)]
    number = {p: i for i, p in enumerate(pieces) if p}
    met = 0
    for rows, codes in table.groups(words):
        first, longer, _, _ = table.arcs(codes)
        for k, i in enumerate(rows):
            w = lattice.MARK + words[i]
            assert [number.get(x, table.none) for x in w] == first[:, k].tolist()
        for size, by_start in enumerate(longer, 2):
            for start, (hit, ids, _) in enumerate(by_start):
                texts = [(lattice.MARK + words[i])[start:start + size] for i in rows]
                assert [(k, number[t]) for k, t in enumerate(texts) if t in number] == list(zip(hit, ids))
                met += len(hit)
    assert met > 1000


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def test_lattice_base_scores_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want = base_scores(docs, held)
    got = rows(lattice.op4_lattice_score(spark, SF01))
    assert len(got) == len(want)
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(d))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_every_round_sees_every_word(spark):
    """More distinct words than any fixed sample would hold: EM over all of them, in plain numpy."""
    pieces = ["▁", *"abcdefghijklmnop", "▁ab", "cd", "fgh", "no", "kl"] + [""] * 256
    by_byte = list(range(len(pieces) - 256, len(pieces)))
    log_p = np.log(np.random.default_rng(4).dirichlet(np.ones(len(pieces))))
    names = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnop", repeat=5), 0, 1 << 20, 13)]
    c = np.array([1 + i % 3 for i in range(len(names))], float)
    ends, line_mass = 500, 20.0
    weights, mass, own = log_p + math.log(0.5), c.sum() + ends, np.where(c > 1, (c - 0.8) / 2, 0.0)
    for _ in range(7):
        with np.errstate(divide="ignore"):
            uses, kept = lattice.Lattice(pieces, weights, by_byte).expected(names, c, np.log(own / mass))
        own, uses = np.maximum(0.0, kept - lattice.DISCOUNT), uses + lattice.PIECE_PRIOR
        mass = uses.sum() + own.sum() + line_mass + ends + 1
        weights = np.log(uses / mass)
    words = spark.createDataFrame(list(zip(names, c.astype(int).tolist())), "word string, c bigint")
    got, wholes, total = lattice.learn(words, ends, line_mass, pieces, log_p.tolist(), by_byte)
    assert len(names) > 80_000 and math.isclose(total, mass, rel_tol=1e-9)
    assert np.allclose(got, weights, atol=1e-9)
    assert math.isclose(sum(r.uses for r in wholes.collect()), own.sum(), rel_tol=1e-9, abs_tol=1e-6)


def test_lattice_prefers_text_to_noise(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    text = docs.where("doc_id = 28").first().text[:400]
    rng = random.Random(3)
    letters = list(text)
    rng.shuffle(letters)
    probe = spark.createDataFrame([(-1, text.replace("\n", " ") + " x"), (-2, "".join(letters) + " x")],
                                  "doc_id bigint, text string")
    from pyspark.sql import functions as F
    got = rows(lattice.score_documents(docs.unionByName(probe), F.col("doc_id") >= 0,
                                       lattice.public_pieces()))
    assert got[-1].score / got[-1].n_tokens > got[-2].score / got[-2].n_tokens


def test_lattice_edge_rows(edge):
    got = rows(lattice.score_documents(edge, ~lattice.held_out(), lattice.public_pieces()))
    want = base_scores([(d, t) for d, t, *_ in EDGE_ROWS], held)
    for d, (n, known, total, base) in want.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total)
        assert math.isclose(got[d].base_score, base, rel_tol=1e-9)
        assert math.isfinite(got[d].score)
    assert got[2].score == got[3].score == got[4].score  # the end token alone
    assert lattice.score_documents(edge.limit(0), ~lattice.held_out(), lattice.public_pieces()).count() == 0
