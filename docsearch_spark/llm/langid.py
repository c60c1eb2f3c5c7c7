"""Operator 1: word-level language ID with a linear-chain conditional random field.

Words are white-space runs; a run of more than ``LONG`` characters (text without
spaces) is cut into consecutive parts, each a position of the chain like a word, in
fitting and in labelling. A word's features are its affixes, its letter
n-grams (both hashed), and lexicon features (languages whose frequent words hold
it). Together with learned start and transition weights they score label
sequences; forward-backward gives every word's marginal for every language, so a
code-switched text gets a label per word. Runs of equal labels are the spans, told
by words; a long run whose parts differ stands in the spans of each. A text's language is the one with the largest sum of marginals over words that
have a letter, and its score is that sum's share.

Fitting. Documents with a non-null label train. The sample is bounded:
``SAMPLE_WORDS`` words of each label, taken as windows of ``WINDOW`` words from
documents drawn by a hash of the key. Windows of different labels are spliced to
sequences, from which the model learns transitions. AdaGrad on the exact
gradient (marginals minus observed) fits the weights on the driver; the model's
size is fixed by ``BUCKETS`` and the number of labels, not by the data.

Labelling is narrow: each task labels its own rows, whole texts, no shuffle. All
texts of a batch form one chain, cut into equal pieces that are worked on side
by side: each piece's transfer matrix is multiplied up, the pieces' entry
messages follow from those, then all pieces run forward and backward. That is
exact, and its cost does not depend on how long single texts are.

Defined cases: null text, or a text without letters: ``und`` with score 0.0 and
no spans; ties go to the label that sorts first; without any training row every
text is ``und``; with one label only, that label; repeated rows are labelled
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import documents, short_batches, sliced

UNKNOWN = "und"
#: Words of each label that the model is fitted on, and words of one window.
SAMPLE_WORDS = 24_000
WINDOW = 16
#: Characters of a part of a long run.
LONG = 62
#: Hash buckets of the affix and n-gram features.
BUCKETS = 1 << 16
#: Words of a training sequence, sequences of a step, and passes over the sample.
SEQUENCE, STEP, PASSES = 48, 32, 4
#: A lexicon holds the words seen this often with one label.
LEXICON_COUNT = 3
#: Steps of a piece of the chain, and entries of a task's table of scored words.
PIECE = 256
CACHE_WORDS = 150_000
CACHE_GRAMS = 100_000
#: Words scored side by side.
STEP_WORDS = 20_000
EDGE = "\"'`.,;:!?()[]{}<>|*#%&$~_-+=/\\…«»„“”‚‘’¿¡"


def bare_form(word: str) -> str:
    """Lower case, without the signs around it."""
    return word.lower().strip(EDGE)


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def positions(text: str) -> tuple[list[str], list[int] | None]:
    """(words and parts of long runs, the word of each; None: all are words)."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG:
        return words, None
    parts: list[str] = []
    owner: list[int] = []
    for i, w in enumerate(words):
        inner = w.strip(EDGE) if len(w) > LONG else w
        cut = [w] if len(inner) <= LONG else [inner[k:k + LONG] for k in range(0, len(inner), LONG)]
        parts += cut
        owner += [i] * len(cut)
    return parts, owner


class Grams(dict):
    """n-gram -> hash bucket, computed once; a full table starts afresh."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= CACHE_GRAMS:
            self.clear()
        bucket = self[gram] = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def word_features(word: str, grams: Grams) -> list[int]:
    """Hashed affixes and n-grams of a lower-cased word without edge signs."""
    w = f"^{word}$"
    n = len(w)
    parts = [f"a{w[:k]}" for k in (2, 3, 4)] + [f"z{w[-k:]}" for k in (2, 3, 4)]
    ids = [grams[x] for x in parts]
    ids += [grams[w[i:i + 2]] for i in range(n - 1)]
    ids += [grams[w[i:i + 3]] for i in range(n - 2)]
    return ids


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray = field(repr=False)      # BUCKETS x L
    lexicon: dict[str, list[int]] = field(repr=False)
    lex_weights: np.ndarray                      # label of the lexicon x L
    plain: np.ndarray                            # weights of a word without letters
    trans: np.ndarray                            # L x L
    start: np.ndarray

    def emission(self, words: list[str], grams: Grams) -> np.ndarray:
        """Scores of each word (lower case, no edge signs) for each label."""
        out = np.zeros((len(words), len(self.labels)))
        flat: list[int] = []
        cuts: list[int] = []
        rows: list[int] = []
        for i, w in enumerate(words):
            if not has_letter(w):
                out[i] = self.plain
                continue
            rows.append(i)
            cuts.append(len(flat))
            flat += word_features(w, grams)
            for lang in self.lexicon.get(w, ()):
                out[i] += self.lex_weights[lang]
        if rows:
            out[rows] += np.add.reduceat(self.weights[flat], cuts, axis=0)
        return out


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray,
              start: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """P(label | text) of every word; ``first`` marks the words that open a text.

    Message vectors are kept normalised, so long texts neither under- nor overflow.
    """
    n, labels = scores.shape
    if not n:
        return scores
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    move = np.exp(trans - trans.max())
    begin = np.exp(start - start.max())
    pieces = -(-n // piece)
    pad = pieces * piece - n
    psi = np.concatenate([psi, np.ones((pad, labels))]).reshape(pieces, piece, labels)
    # padding opens texts of its own, so that it says nothing about the last word
    opens = np.concatenate([first, np.ones(pad, bool)]).reshape(pieces, piece)
    opens_at = [np.flatnonzero(opens[:, s]) for s in range(piece)]

    # transfer matrix of each piece
    carry = np.broadcast_to(np.eye(labels), (pieces, labels, labels)).copy()
    for s in range(piece):
        nxt = carry @ move
        if len(opens_at[s]):
            nxt[opens_at[s]] = carry[opens_at[s]].sum(axis=2, keepdims=True) * begin
        nxt *= psi[:, s, None, :]
        nxt /= nxt.max(axis=(1, 2), keepdims=True)
        carry = nxt
    # messages that enter each piece from the left and from the right
    left = np.empty((pieces, labels))
    right = np.empty((pieces, labels))
    message = np.full(labels, 1.0 / labels)
    for c in range(pieces):
        left[c] = message
        message = message @ carry[c]
        message /= message.sum()
    message = np.ones(labels)
    for c in range(pieces - 1, -1, -1):
        right[c] = message
        message = carry[c] @ message
        message /= message.sum()
    alpha = np.empty_like(psi)
    a = left
    for s in range(piece):
        nxt = a @ move
        if len(opens_at[s]):
            nxt[opens_at[s]] = a[opens_at[s]].sum(axis=1, keepdims=True) * begin
        nxt *= psi[:, s]
        a = alpha[:, s] = nxt / nxt.sum(axis=1, keepdims=True)
    b = right
    for s in range(piece - 1, -1, -1):
        alpha[:, s] *= b
        weighted = psi[:, s] * b
        nxt = weighted @ move.T
        if len(opens_at[s]):
            nxt[opens_at[s]] = 1.0
        b = nxt / nxt.sum(axis=1, keepdims=True)
    out = alpha.reshape(-1, labels)[:n]
    return out / out.sum(axis=1, keepdims=True)


def fit(windows: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Fit on (label, words) windows spliced to code-switched sequences."""
    labels = sorted({lang for lang, _ in windows})
    L, number = len(labels), {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    windows = sorted((lang, [bare_form(w) for w in words]) for lang, words in windows)
    grams = Grams()
    counts: dict[str, Counter] = {lang: Counter() for lang in labels}
    for lang, words in windows:
        counts[lang].update(words)
    lexicon: dict[str, list[int]] = {}
    for lang in labels:
        for w, c in counts[lang].items():
            if c >= LEXICON_COUNT and w:
                lexicon.setdefault(w, []).append(number[lang])
    model = Model(labels, np.zeros((BUCKETS, L)), lexicon, np.zeros((L, L)),
                  np.zeros(L), np.zeros((L, L)), np.zeros(L))
    if L < 2:
        return model
    squares = [np.full_like(x, 1e-2) for x in
               (model.weights, model.lex_weights, model.plain, model.trans, model.start)]
    feats: dict[str, tuple] = {}

    def of(w: str) -> tuple:
        if w not in feats:
            feats[w] = (word_features(w, grams), lexicon.get(w, ())) if has_letter(w) else ((), None)
        return feats[w]

    def update(x: np.ndarray, grad: np.ndarray, square: np.ndarray, rate: float = 0.2) -> None:
        square += grad * grad
        x -= rate * grad / np.sqrt(square)

    for _ in range(PASSES):
        tokens: list[str] = []
        gold: list[int] = []
        for k in rng.permutation(len(windows)):
            lang, words = windows[k]
            tokens += words
            gold += [number[lang]] * len(words)
        for at in range(0, len(tokens), SEQUENCE * STEP):
            part, y = tokens[at:at + SEQUENCE * STEP], np.array(gold[at:at + SEQUENCE * STEP])
            first = np.zeros(len(part), bool)
            first[::SEQUENCE] = True
            scores = model.emission(part, grams)
            p = marginals(scores, first, model.trans, model.start, SEQUENCE)
            # pair marginals from the conditional of two neighbours
            inner = np.flatnonzero(~first)
            diff = p.copy()
            diff[np.arange(len(y)), y] -= 1
            flat: list[int] = []
            owner: list[int] = []
            lex_f: list[int] = []
            lex_o: list[int] = []
            bare: list[int] = []
            for i, w in enumerate(part):
                f, lex = of(w)
                if lex is None:
                    bare.append(i)
                    continue
                flat += f
                owner += [i] * len(f)
                lex_f += lex
                lex_o += [i] * len(lex)
            if flat:
                rows, where = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(rows), L))
                np.add.at(grad, where, diff[owner])
                w, s = model.weights[rows], squares[0][rows]
                update(w, grad, s)
                model.weights[rows], squares[0][rows] = w, s
            grad = np.zeros((L, L))
            np.add.at(grad, lex_f, diff[lex_o])
            update(model.lex_weights, grad, squares[1])
            update(model.plain, diff[bare].sum(axis=0), squares[2])
            pair = pair_marginals(scores, p, first, model.trans, model.start)
            np.add.at(pair, (y[inner - 1], y[inner]), -1)
            update(model.trans, pair, squares[3])
            update(model.start, diff[first].sum(axis=0), squares[4])
    return model


def pair_marginals(scores: np.ndarray, p: np.ndarray, first: np.ndarray,
                   trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expected label bigrams within texts (texts of one length, as in fitting)."""
    n, labels = scores.shape
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    move, begin = np.exp(trans - trans.max()), np.exp(start - start.max())
    opens = np.flatnonzero(first)
    total = np.zeros((labels, labels))
    longest = max(np.diff(np.r_[opens, n]))
    alive, alpha = opens, psi[opens] * begin
    alpha /= alpha.sum(axis=1, keepdims=True)
    for s in range(1, longest):
        keep = (alive + s < n) & ~first[np.minimum(alive + s, n - 1)]
        alive, alpha = alive[keep], alpha[keep]
        if not len(alive):
            break
        at = alive + s
        ahead = alpha @ move * psi[at]
        # P(i, j) = alpha_i move_ij psi_j beta_j, and beta_j = p_j / (alpha move psi)_j
        ratio = p[at] / np.maximum(ahead, 1e-300)
        total += np.einsum("ni,ij,nj->ij", alpha, move, psi[at] * ratio)
        alpha = ahead / ahead.sum(axis=1, keepdims=True)
    return total


class Labeller:
    """Labels batches of texts within one Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self._fresh()

    def _fresh(self) -> None:
        self.index: dict[str, int] = {}   # word as it stands -> row of its bare form
        self.forms: dict[str, int] = {}   # bare form -> row
        self.grams = Grams()
        self.scores = np.zeros((0, len(self.model.labels)))
        self.letters = np.zeros(0, bool)

    def _rows(self, words: list[str]) -> np.ndarray:
        """The row of each word in the tables of scores."""
        if len(self.index) > CACHE_WORDS:
            self._fresh()
        index, forms = self.index, self.forms
        fresh = []
        for w in set(words):
            if w not in index:
                form = bare_form(w)
                row = forms.get(form)
                if row is None:
                    row = forms[form] = len(forms)
                    fresh.append(form)
                index[w] = row
        if fresh:
            self.scores = np.concatenate([self.scores, *(self.model.emission(fresh[i:i + STEP_WORDS], self.grams)
                                                         for i in range(0, len(fresh), STEP_WORDS))])
            self.letters = np.concatenate([self.letters, np.array([has_letter(w) for w in fresh], bool)])
        return np.array([index[w] for w in words], np.int64)

    def label(self, texts: list[str | None]) -> list[tuple]:
        """(label, score, spans) of each text."""
        cut = [positions(t or "") for t in texts]
        split = [parts for parts, _ in cut]
        rows = self._rows([w for words in split for w in words])
        ends = np.cumsum([len(w) for w in split])
        first = np.zeros(len(rows), bool)
        first[[e - len(w) for e, w in zip(ends, split) if w]] = True
        p = marginals(self.scores[rows], first, self.model.trans, self.model.start)
        letters = self.letters[rows]
        best = p.argmax(axis=1)
        change = first.copy()
        change[1:] |= best[1:] != best[:-1]
        runs = np.flatnonzero(change)
        # sums over a text, and over a run, as differences of running sums
        mass = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * letters[:, None], axis=0)])
        sure = np.r_[0.0, np.cumsum(p.max(axis=1))]
        out, labels = [], self.model.labels
        for e, (words, owner) in zip(ends, cut):
            s = e - len(words)
            total = mass[e] - mass[s]
            if not letters[s:e].any():
                out.append((UNKNOWN, 0.0, []))
                continue
            k = int(total.argmax())
            a, b = np.searchsorted(runs, [s, e])
            stops = np.r_[runs[a + 1:b], e]
            spans = [{"start": int(x - s), "end": int(y - s), "lang": labels[best[x]],
                      "p": float((sure[y] - sure[x]) / (y - x))} for x, y in zip(runs[a:b], stops)]
            if owner is not None:  # from positions to words
                for span in spans:
                    span["start"], span["end"] = owner[span["start"]], owner[span["end"] - 1] + 1
            out.append((labels[k], float(min(1.0, max(0.0, total[k] / total.sum()))), spans))
        return out


SPANS = "array<struct<start:int,end:int,lang:string,p:double>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                ("lang", pa.string()), ("p", pa.float64())]))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_words: int = SAMPLE_WORDS) -> Model:
    """Fit on a bounded sample of ``df``'s rows with a label (see the module)."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # about enough documents for the words wanted, at one window each, with a margin
    wanted = 2 * sample_words // WINDOW
    share = F.lit(0.0)
    for name in sorted(totals):
        share = F.when(F.col("lang") == name, wanted / totals[name]).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share * (1 << 40))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: dict[str, list] = {"lang": [], "words": [], "at": []}
            for r in batch.to_pylist():
                words, _ = positions(r["text"])
                if words:
                    h = zlib.crc32(r["id"].encode() if r["id"] else b"")
                    s = h % max(1, len(words) - WINDOW + 1)
                    out["lang"].append(r["lang"])
                    out["words"].append(words[s:s + WINDOW])
                    out["at"].append(h)
            yield pa.record_batch({"lang": pa.array(out["lang"], pa.string()),
                                   "words": pa.array(out["words"], pa.list_(pa.string())),
                                   "at": pa.array(out["at"], pa.int64())})

    windows = drawn.mapInArrow(cut, "lang string, words array<string>, at bigint")
    held: Counter = Counter()
    chosen = []
    bound = 2 * wanted * max(1, len(totals))  # rows that reach the driver at most
    for r in sorted(windows.limit(bound).collect(), key=lambda r: (r["at"], r["words"])):
        if held[r["lang"]] < sample_words:
            held[r["lang"]] += len(r["words"])
            chosen.append((r["lang"], [w[:200] for w in r["words"]]))
    return fit(chosen)


def label(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans): spans are runs of words with one label."""
    short_batches(df.sparkSession)
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    # a worker keeps the value of a broadcast from task to task, and its scored words with it
    shipped = src.sparkSession.sparkContext.broadcast({"model": vars(model)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shipped.value
        labeller = kept.get("labeller") or kept.setdefault("labeller", Labeller(Model(**kept["model"])))
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            if labeller.model.labels:
                found = labeller.label(texts)
            else:
                found = [(UNKNOWN, 0.0, [])] * len(texts)
            yield pa.record_batch({"key": batch.column("key"),
                                   "lang_pred": pa.array([f[0] for f in found], pa.string()),
                                   "score": pa.array([f[1] for f in found], pa.float64()),
                                   "spans": pa.array([f[2] for f in found], SPAN_TYPE)})

    return (src.mapInArrow(run, f"key {kind}, lang_pred string, score double, spans {SPANS}")
            .withColumnRenamed("key", key))


def held_out(key: str = "doc_id") -> Column:
    """True for the third of the documents that training never sees."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(df: DataFrame) -> DataFrame:
    """Train on the rows of ``df`` that are not held out, label every row."""
    model = train(df.where(~held_out()))
    return label(df, model)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))
