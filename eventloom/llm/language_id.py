"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are runs of 1 to 4 bytes of the text with ASCII letters lower-cased and all other ASCII one space; none has a
space inside. Each is hashed to a row of a table of embeddings; a text is the mean of its rows, and a linear softmax over
it gives the languages. Both are trained together by stochastic gradient descent in numpy on a bounded sample
of labelled texts (PER_LANGUAGE of each language, whole texts). On a part of the sample that training doesn't see, a
temperature is fitted and the score below which a prediction is rejected: that of one right prediction in a thousand, 0.5 at most.
For use, embeddings and softmax are multiplied out to one table of logits, broadcast (its size is BUCKETS x languages).

Nulls: a null text and one without a letter are `und` with score 0 and rejected. A null label or doc_id isn't learned
from. Each row is judged on its own text, so repeated rows don't matter. An empty table gives no row. If nothing can be
learned, every text is `und`. Extra columns are kept by with_language().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, record, slices, texts_of, tidy
from .sampling import per_class

BUCKETS_BITS, DIM, LENGTHS = 15, 16, (1, 2, 3, 4)
#: Labelled texts of a language that are learned from, at most (twice that as a hard bound).
PER_LANGUAGE = 1200
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def subwords(column: pa.Array):
    """For each length: bucket of each subword, and where each text's subwords begin (n+1 places)."""
    data, offsets = texts_of(column)
    data = _FOLD[data]
    size = len(data)
    blank = data == 0x20
    stop = np.repeat(offsets[1:], np.diff(offsets))
    value = np.zeros(size, np.uint32)
    inner = np.zeros(size, bool)
    for n in range(1, max(LENGTHS) + 1):
        if size < n:
            break
        m = size - n + 1
        value = value[:m] | data[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))
        if n > 2:
            inner = inner[:m] | blank[n - 2 : size - 1]
        else:
            inner = inner[:m]
        if n in LENGTHS:
            good = ~inner & (np.arange(n, m + n) <= stop[:m])
            good &= ~blank[:m] if n == 1 else ~(blank[:m] & blank[n - 1 :])
            at = np.flatnonzero(good)
            hashed = (value[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x85EBCA6B)
            yield (hashed >> np.uint32(32 - BUCKETS_BITS)).astype(np.int64), np.searchsorted(at, offsets)


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = texts_of(column)
    ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))])
    found = np.diff(ascii_letter[offsets]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], dtype=np.float64)
    return out


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # languages x buckets, divided by the temperature
    bias: np.ndarray
    reject_below: float

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        n = len(column)
        letters = has_letter(column)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for buckets, first in subwords(column):
            count += np.diff(first)
            for c in range(len(self.languages)):
                total[:, c] += summed(self.logits[c][buckets], first)
        z = total / np.maximum(count, 1)[:, None] + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = np.where(letters, np.round(p[np.arange(n), best], 6), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score, ~letters | (score < self.reject_below)


class Bags:
    """The buckets of each text and their shares, held in three arrays."""

    def __init__(self, buckets: pa.ChunkedArray, shares: pa.ChunkedArray):
        ends = np.cumsum(pc.binary_length(buckets).to_numpy()) // 2
        self.first = np.concatenate([[0], ends]).astype(np.int64)
        whole = lambda column, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(data, kind) for chunk in column.chunks for data in [texts_of(chunk)[0]]]])
        self.buckets, self.shares = whole(buckets, np.uint16), whole(shares, np.float32)

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[i], self.first[i + 1])
        return self.buckets[own].astype(np.int64), self.shares[own].astype(np.float64)


def train(bags: Bags, labels: np.ndarray, languages: list[str], seed: int = 7, epochs: int = 12, rate: float = 0.5) -> Model:
    """bags: in a fixed order; a fifth of them calibrates."""
    size, rng = len(languages), np.random.Generator(np.random.PCG64(seed))
    table = rng.normal(0, 0.1, (1 << BUCKETS_BITS, DIM))
    heads, bias = np.zeros((DIM, size)), np.zeros(size)
    order = rng.permutation(len(bags))
    tests, fits = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 10 * size else (order, order)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(fits), 16):
            part = rng.permutation(fits)[:16] if lo == 0 and len(fits) <= 16 else fits[lo : lo + 16]
            grads = []
            for i in part.tolist():
                buckets, share = bags[i]
                x = share @ table[buckets]
                z = x @ heads + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                grads.append((buckets, share, x, p))
            old = heads.copy()
            for buckets, share, x, p in grads:
                heads -= step * np.outer(x, p)
                bias -= step * 0.1 * p
                table[buckets] -= 20 * step * share[:, None] * (old @ p)
        fits = rng.permutation(fits)
    logits = heads.T @ table.T
    raw = np.array([logits[:, b] @ s + bias for b, s in (bags[i] for i in tests.tolist())])
    truth = labels[tests]

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((raw - raw.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    loss = {t: -np.log(np.maximum(probabilities(t)[np.arange(len(tests)), truth], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    t = min(loss, key=loss.get)
    p = probabilities(t)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    reject = min(0.5, float(right[len(right) // 1000])) if len(right) else 0.5
    return Model(languages, np.ascontiguousarray(logits / t), bias / t, reject)


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 7) -> Model:
    """rows: doc_id, text, lang; those with a null lang, doc_id or text aren't learned from."""
    rows = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sample, counts = per_class(rows, "lang", "doc_id", per_language, seed)
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros(0), 1.0)
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary()), ("shares", pa.binary())])

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                found = list(subwords(part.column("text")))
                buckets, shares = [], []
                for i in range(part.num_rows):
                    own = np.concatenate([b[f[i] : f[i + 1]] for b, f in found] or [np.zeros(0, np.int64)])
                    b, n = np.unique(own, return_counts=True)
                    buckets.append(b.astype(np.uint16).tobytes())
                    shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
                yield record(out, part.column("doc_id").cast(pa.int64()), part.column("lang"), buckets, shares)

        return each

    got = map_arrow(sample, make, "doc_id long, lang string, buckets binary, shares binary").where("length(buckets) > 0").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("buckets", "ascending")])
    if not got.num_rows:
        return Model([], np.zeros((0, 1)), np.zeros(0), 1.0)
    number = {lang: i for i, lang in enumerate(languages)}
    bags, labels = Bags(got.column("buckets"), got.column("shares")), np.array([number[lang] for lang in got.column("lang").to_pylist()], np.int64)
    del got
    tidy(rows.sparkSession)
    return train(bags, labels, languages, seed)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred, score and rejected. A column of docs with one of these names is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected")
    shape = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                lang, score, rejected = held.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

        return each

    return map_arrow(kept, make, shape)
