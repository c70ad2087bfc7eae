"""Benchmark decontamination: approximate occurrences of test items in documents, by the pigeonhole principle.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lower-cased. An item of m words may differ from a passage by
e = min(rate * m, m / PIECE - 1) words (inserted, left out or changed). Cut into e + 1 pieces, at least one piece of it
stands unchanged in such a passage. Every document is searched for the first words of all pieces at once; a piece that
is there in full gives a place, where Myers' bit-parallel algorithm finds the least distance of the item to any passage.

Items come in blocks of bounded size, each broadcast in turn, so that any number of items can be taken. Documents are
read once a block, nothing is shuffled, and what Python holds is a slice of a few megabytes of texts.

Nulls: null and empty texts, and documents without a word, are clean; items without a word match nothing. Each row is
judged on its own text, so repeated rows and a null doc_id do no harm. An empty table gives no row. Extra columns
are kept, but for those named as the result's, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, record, slices, texts_of
from .textvec import Words

#: Share of an item's words that may differ; words of a piece at least.
RATE, PIECE = 0.15, 4
#: Items and bytes of items in a block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
NOT_WORD = np.array([not (chr(b).isascii() and chr(b).isalnum() or b >= 0x80) for b in range(256)])


def words_of(column: pa.Array) -> Words:
    return Words(*texts_of(column), lower=True, space=NOT_WORD)


def budget(m: int, rate: float = RATE, piece: int = PIECE) -> int:
    return max(0, min(int(rate * m), m // piece - 1))


def myers(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least distance of a pattern (masks: the places of each symbol, as bits) to a passage of text, and where such a passage first ends."""
    ones, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text, 1):
        eq = masks.get(symbol, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        right, left = down | (~(d | up) & ones), up & d
        score += bool(right & high) - bool(left & high)
        right, left = (right << 1) & ones, (left << 1) & ones  # a passage may begin anywhere: nothing is shifted in
        up, down = left | (~(x | right) & ones), right & x
        if score < best:
            best, end = score, j
    return best, end


class Index:
    """Items of a block, and where their pieces begin, by the hash of a piece's first words."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, piece: int = PIECE):
        found = words_of(pa.array([t for _, t in items], pa.string()))
        hashes = found.hashes()
        self.ids, self.words, self.budgets = [], [], []
        pieces: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, (item_id, _) in enumerate(items):
            w = hashes[found.first[i] : found.first[i + 1]]
            m = len(w)
            if not m:
                continue
            e, k = budget(m, rate, piece), len(self.ids)
            self.ids.append(item_id)
            self.words.append(w)
            self.budgets.append(e)
            cuts = [m * p // (e + 1) for p in range(e + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                q = min(piece, hi - lo)
                one = Words.grams(w[lo : lo + q], q)[0]
                pieces.setdefault(q, []).append((int(one), k, lo, hi))
        self.grams = {}
        for q, rows in pieces.items():
            keys = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.grams[q] = seen, keys[order], np.array([rows[i][1:] for i in order], np.int64)
        self.masks: dict[int, dict[int, int]] = {}
        self.done: dict[tuple[int, bytes], tuple[int, int]] = {}

    def distance(self, k: int, window: np.ndarray) -> tuple[int, int]:
        key = k, window.tobytes()
        if key not in self.done:
            if k not in self.masks:
                masks: dict[int, int] = {}
                for i, w in enumerate(self.words[k].tolist()):
                    masks[w] = masks.get(w, 0) | 1 << i
                self.masks[k] = masks
            if len(self.done) > 50_000:
                self.done.clear()
            self.done[key] = myers(self.masks[k], len(self.words[k]), window.tolist())
        return self.done[key]

    def search(self, column: pa.Array) -> dict[int, dict[int, tuple[int, int]]]:
        """For each row with a hit: for each item, its least distance and the word after the passage."""
        text = words_of(column)
        hashes = text.hashes()
        out: dict[int, dict[int, tuple[int, int]]] = {}
        done = set()
        for q, (seen, keys, places) in self.grams.items():
            grams = text.grams(hashes, q)
            at = np.flatnonzero(seen[(grams & np.uint64(0xFFFF)).astype(np.int64)] & text.whole(q))
            lo, hi = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            rows = np.searchsorted(text.first, at, side="right") - 1
            for j, a, b, row in zip(at.tolist(), lo.tolist(), hi.tolist(), rows.tolist(), strict=True):
                for k, p, stop in places[a:b].tolist():
                    w, begin, end = self.words[k], int(text.first[row]), int(text.first[row + 1])
                    if j + stop - p > end or (row, k, j - p) in done or not np.array_equal(hashes[j : j + stop - p], w[p:stop]):
                        continue
                    done.add((row, k, j - p))
                    e = self.budgets[k]
                    lo_word = max(begin, j - p - e)
                    d, stop_at = self.distance(k, hashes[lo_word : min(end, j - p + len(w) + e)])
                    if d <= e:
                        hit = d, lo_word + stop_at - begin
                        mine = out.setdefault(row, {})
                        mine[self.ids[k]] = min(mine.get(self.ids[k], hit), hit)
        return out


def blocks(benchmark: DataFrame, most_items: int = BLOCK_ITEMS, most_bytes: int = BLOCK_BYTES):
    """Items (item_id, text) in blocks of bounded size, in the order in which Spark yields them."""
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if len(block) >= most_items or size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, piece: int = PIECE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs (with a string column text) plus item_ids (array<long>, ascending), distances and ends (arrays beside it: word after the passage)."""
    spark = docs.sparkSession
    docs = docs.drop("__hits", "item_ids", "distances", "ends")
    hits = "array<struct<item: bigint, distance: int, end: int>>"
    found = docs.withColumn("__hits", F.array().cast(hits))
    kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
    for block in blocks(benchmark, block_items):
        held = spark.sparkContext.broadcast(block)

        def make(held=held):
            index = Index(held.value, rate, piece)

            def each(batch):
                spot = batch.schema.get_field_index("__hits")
                for part in slices(batch, "text"):
                    got = index.search(part.column("text"))
                    before = part.column(spot).to_pylist()
                    after = [sorted(old + [{"item": k, "distance": d, "end": z} for k, (d, z) in got.get(i, {}).items()], key=lambda h: h["item"]) for i, old in enumerate(before)]
                    columns = part.columns
                    columns[spot] = pa.array(after, kind)
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

            return each

        found = map_arrow(found, make, found.schema)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__hits.item").alias("item_ids"), F.col("__hits.distance").alias("distances"), F.col("__hits.end").alias("ends"))
