"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities and counts of a lexicon (a short fixed list of insults, and words that the labelled sample shows to be
signs), the same after look-alike characters are undone, insults near a second person, capitals, punctuation, digits,
drawn-out letters, obfuscated words, lengths. Learned from a bounded sample of labelled rows (PER_LABEL of each label);
near copies in it count once as evidence for a word. A part of the sample that the trees don't see calibrates them, each label
with the weight it has among all labelled rows. Scoring reads each text once and shuffles nothing.

Nulls: a null text counts as empty; empty texts get a score as well. Null labels and doc_ids aren't learned from. Each
row is judged on its own text. An empty table gives no row; if a label is missing from the sample every score is its mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost, isotonic
from .common import map_arrow, record, slices, texts_of, written
from .language_id import summed
from .sampling import per_class
from .textvec import LOWER, SPACE, Words

#: Labelled rows of a label that are learned from, at most (twice that as a hard bound); words that are learned, at most.
PER_LABEL, LEARNED = 3000, 100
THRESHOLD = 0.3

# A short list of common insults, and second persons of some languages.
INSULTS = "idiot idiots moron morons stupid dumb loser losers trash garbage scum clown pathetic worthless disgusting fool jerk freak pig creep imbecile coward ugly filthy vermin bastard".split()
SECOND = "you your yours yourself u ur du dich dir dein tu te toi ton vous votre usted ustedes ti tus".split()

_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 0x80 for b in range(256)])
_LEET = LOWER.copy()
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _LEET[ord(_a)] = ord(_b)
_LEET_SPACE = np.array([not (chr(b).isascii() and chr(b).isalpha() or b >= 0x80) for b in range(256)])
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def word_hashes(words: list[str]) -> np.ndarray:
    w = Words(*texts_of(pa.array(words, pa.string())), lower=True, space=~_WORD)
    return np.unique(w.hashes())


@dataclass
class Lexicon:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.weights[at], 0.0)


def lexicon(words: list[np.ndarray], kinds: np.ndarray, labels: np.ndarray, most: int = LEARNED) -> Lexicon:
    """The fixed list, and words by which toxic kinds of texts stand out; texts of one kind (near copies) count once."""
    seed = word_hashes(INSULTS)
    table = {int(h): 2.0 for h in seed}
    per = [set(), set()]
    for w, kind, y in zip(words, kinds.tolist(), labels.tolist(), strict=True):
        per[y].update((int(h), kind) for h in w)
    n = [len(set(kinds[labels == y].tolist())) for y in (0, 1)]
    if all(n):
        df = [np.unique(np.array([h for h, _ in p], np.uint64), return_counts=True) for p in per]
        clean = dict(zip(df[0][0].tolist(), df[0][1].tolist(), strict=True))
        rows = []
        for h, c in zip(df[1][0].tolist(), df[1][1].tolist(), strict=True):
            p = (c + clean.get(h, 0) + 1) / (n[0] + n[1])
            z = (c - n[1] * p) / np.sqrt(n[1] * p * max(1e-9, 1 - p))
            odds = np.log((c + 0.5) / (n[1] + 1)) - np.log((clean.get(h, 0) + 0.5) / (n[0] + 1))
            if c >= 8 and z >= 6 and odds > 1.5:
                rows.append((-z, h, float(odds)))
        table |= {h: odds for _, h, odds in sorted(rows)[:most]}
    keys = np.array(sorted(table), np.uint64)
    return Lexicon(keys, np.array([table[int(k)] for k in keys]))


def features(column: pa.Array, words: Lexicon) -> np.ndarray:
    """A row of dense features for each text."""
    data, offsets = texts_of(column)
    n = len(offsets) - 1
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(np.float64)
    plain = Words(data, offsets, lower=True, space=~_WORD)
    hashes, text, count = plain.hashes(), plain.text_of(), plain.counts().astype(np.float64)
    weight = words(hashes)
    hit = weight > 0
    you = np.isin(hashes, word_hashes(SECOND))
    near = np.zeros(len(hashes), bool)
    for d in (1, 2, 3):
        same = text[d:] == text[:-d]
        near[d:] |= you[:-d] & same
        near[:-d] |= you[d:] & same
    leet = Words(_LEET[data], offsets, space=_LEET_SPACE)
    leet_hit = words(leet.hashes()) > 0
    tokens = Words(data, offsets)
    letter, digit, mark = _WORD[data] & ~((data >= 0x30) & (data <= 0x39)), (data >= 0x30) & (data <= 0x39), _MARKS[data]
    upper = (data >= 0x41) & (data <= 0x5A)
    inside = np.zeros(len(data), bool)  # a mark or digit between two letters
    inside[1:-1] = (mark | digit)[1:-1] & letter[:-2] & letter[2:]
    drawn = np.zeros(len(data), bool)
    drawn[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    words_n = np.maximum(count, 1)
    caps = summed((np.add.reduceat(upper, tokens.starts) == tokens.ends - tokens.starts).astype(np.float64) if tokens.n else np.zeros(0), tokens.first)
    hits = np.bincount(text, hit, n) if len(text) else np.zeros(n)
    weights = np.bincount(text, weight, n) if len(text) else np.zeros(n)
    close = np.bincount(text, hit & near, n) if len(text) else np.zeros(n)
    seconds = np.bincount(text, you, n) if len(text) else np.zeros(n)
    undone = summed(leet_hit.astype(np.float64), leet.first)
    return np.stack([np.log1p(count), size / words_n, hits, hits / words_n, weights, weights / words_n, close, close / words_n, seconds / words_n, np.maximum(undone - hits, 0), undone / words_n, per_text(upper) / size, caps / words_n, per_text(data == 0x21) / size, per_text(data == 0x3F) / size, per_text(mark) / size, per_text(digit) / size, per_text(inside) / words_n, per_text(drawn) / words_n, per_text(~SPACE[data]) / size], 1)


@dataclass
class Model:
    words: Lexicon
    trees: Trees
    places: np.ndarray
    values: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        return np.round(np.interp(self.trees.margin(features(column, self.words)), self.places, self.values), 6)


def _kinds(w: Words, hashes: np.ndarray) -> list[int]:
    """Of each text the least hash of its four-word shingles, which near copies share."""
    grams, whole = w.grams(hashes, 4), w.whole(4)
    out = []
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        own = grams[lo:hi][whole[lo:hi]]
        out.append(int((own.min() if len(own) else hashes[lo:hi].sum(dtype=np.uint64)) >> np.uint64(1)))
    return out


def _evidence():
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("kind", pa.int64()), ("words", pa.binary())])

    def each(batch):
        for part in slices(batch, "text"):
            w = Words(*texts_of(part.column("text")), lower=True, space=~_WORD)
            h = w.hashes()
            own = [np.unique(h[lo:hi]).tobytes() for lo, hi in zip(w.first[:-1], w.first[1:], strict=True)]
            yield record(out, part.column("doc_id").cast(pa.int64()), part.column("toxic"), _kinds(w, h), own)

    return each


def _dense(table: Lexicon):
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("kind", pa.int64()), ("dense", pa.binary())])

    def each(batch):
        for part in slices(batch, "text"):
            w = Words(*texts_of(part.column("text")), lower=True, space=~_WORD)
            yield record(out, part.column("doc_id").cast(pa.int64()), part.column("toxic"), _kinds(w, w.hashes()), [row.tobytes() for row in features(part.column("text"), table)])

    return each


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 5) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1). The sample is drawn from labels alone, so that only its few rows meet the texts, by broadcast."""
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample, counts = per_class(labels, "toxic", "doc_id", per_label, seed)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    sample = written(sample, "labelled-sample")
    got = sorted(map_arrow(sample, _evidence, "doc_id long, toxic int, kind long, words binary").collect(), key=tuple)
    y = np.array([r["toxic"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        mean = float(y.mean()) if len(y) else 0.0
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), Trees(1, 0.0), np.array([0.0]), np.array([mean]))
    words = [np.frombuffer(r["words"], np.uint64) for r in got]
    kinds = np.array([r["kind"] for r in got], np.int64)
    fits = np.random.Generator(np.random.PCG64(seed)).random(len(y)) < 0.7
    if len(set(y[fits].tolist())) < 2 or len(set(y[~fits].tolist())) < 2:
        fits = np.ones(len(y), bool)
    tests = ~fits if not fits.all() else fits
    table = lexicon([w for w, f in zip(words, fits, strict=True) if f], kinds[fits], y[fits])
    rows = map_arrow(sample, lambda: _dense(table), "doc_id long, toxic int, kind long, dense binary").collect()
    x = np.array([np.frombuffer(r["dense"], np.float64) for r in sorted(rows, key=tuple)])
    weight = np.where(y == 1, counts.get(1, 1) / max(1, (y == 1).sum()), counts.get(0, 1) / max(1, (y == 0).sum()))
    weight = weight / weight.mean()
    trees = boost(x[fits], y[fits].astype(np.float64), weight[fits])
    return Model(table, trees, *isotonic(trees.margin(x[tests]), y[tests].astype(np.float64), weight[tests]))


def with_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text) plus score; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(part.column("text")))], names=[*part.schema.names, "score"])

        return each

    return map_arrow(kept, make, kept.withColumn("score", F.lit(0.0)).schema)
