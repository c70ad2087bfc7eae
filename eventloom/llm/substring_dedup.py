"""Substring dedup by seed and extend: passages of `span` words or more that an earlier document has as well are taken out.

Seeds: the least q-gram hash of each window of `span` words is its anchor (winnowing), so that equal windows have equal
anchors, and about one q-gram in (span - q) / 2 is one. Anchors are joined across documents, and those of two
documents or more are shared. Extension: each occurrence of a shared anchor is extended both ways to every window that it
is the anchor of; a window's fingerprint (128 bits, of all its words) is matched with the least document that has it. Runs of matched
windows are the maximal repeats, and all their words go. No two occurrences are ever paired: hot anchors and hot windows are
aggregated where they are read, so a passage that all documents share costs a row a task.

Nulls: a null text is empty and has no word. A null doc_id is neither a source nor loses words. Rows repeated with one doc_id are
one document, whose windows are those of all its rows: none is a source for another; each loses what lesser doc_ids have of its
own words. Places of words belong to a row's doc_id and text. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, dropped, longs, map_arrow, record, slices, texts_of, written
from .textvec import Words

SPAN, GRAM = 50, 20


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i that has so many."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Windows:
    """All windows of `span` words of some texts: first word, text, anchor; and on demand the fingerprints."""

    def __init__(self, column: pa.Array, span: int, gram: int):
        self.words = w = Words(*texts_of(column))
        self.span = span
        self.hashes = w.hashes()
        self.others = None
        least = window_least(w.grams(self.hashes, gram)[: max(0, w.n - gram + 1)], span - gram + 1)
        good = w.whole(span)
        self.at = np.flatnonzero(good[: len(least)])
        self.anchor = least[self.at]
        self.text = np.searchsorted(w.first, self.at, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, anchor) of neighbouring windows."""
        if not len(self.at):
            return self.text, self.anchor
        new = np.concatenate([[True], (self.text[1:] != self.text[:-1]) | (self.anchor[1:] != self.anchor[:-1])])
        return self.text[new], self.anchor[new]

    def prints(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the chosen windows; the second goes over hashes of the words that share nothing with the first's."""
        if self.others is None:
            self.others = self.words.hashes(second=True)
        one = self.words.grams(self.hashes, self.span)[self.at[chosen]]
        return one, self.words.grams(self.others, self.span)[self.at[chosen]]


def _anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    out = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64())])

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                text, anchor = Windows(part.column("text"), span, gram).anchors()
                yield record(out, longs(anchor), *(part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "th")))

        return each

    return map_arrow(docs, make, "anchor long, doc_id long, th long")


def _windows(marked: DataFrame, span: int, gram: int) -> DataFrame:
    """Fingerprints of the windows under the shared anchors (column anchors) of each text, with their first words."""
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32())])

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                found = Windows(part.column("text"), span, gram)
                lists = part.column("anchors")
                shared = lists.flatten().to_numpy().view(np.uint64)
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                # (text, anchor) pairs as one number each: ranks of anchors times texts
                ranks, rank = np.unique(shared, return_inverse=True)
                place = np.minimum(np.searchsorted(ranks, found.anchor), max(0, len(ranks) - 1))
                hit = (ranks[place] == found.anchor) if len(ranks) else np.zeros(len(found.at), bool)
                n = max(1, len(ranks))
                chosen = hit & np.isin(found.text * n + place, of * n + rank)
                one, two = found.prints(chosen)
                text = found.text[chosen]
                start = found.at[chosen] - found.words.first[text]
                yield record(out, longs(one), longs(two), *(part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "th")), start.astype(np.int32))

        return each

    return map_arrow(marked, make, "k1 long, k2 long, doc_id long, th long, start int")


def merged(starts: list[int], span: int) -> list[int]:
    """Sorted first words of windows as disjoint ranges: begin, end, begin, end ..."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = max(out[-1], s + span)
        else:
            out += [s, s + span]
    return out


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, th (a hash of the row's text) and ranges (array<int>: begin, end, begin, end ... in words) of all maximal repeats
    of passages of lesser doc_ids."""
    docs = keyed(docs).where("doc_id IS NOT NULL")
    anchors = written(_anchors(docs, span, gram), "anchors")
    shared = written(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared-anchors")
    marks = written(anchors.join(shared, "anchor", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors")), "marks")
    dropped(anchors, shared)
    marked = docs.join(sized(marks, "anchors", 8), ["doc_id", "th"]).select("doc_id", "th", "text", "anchors")
    windows = _windows(marked, span, gram)
    first = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k1", "k2", "lo")
    first = written(first, "repeated-windows")
    late = windows.join(first, ["k1", "k2"]).where("doc_id > lo").select("doc_id", "th", "start")
    lists = late.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("ranges", pa.list_(pa.int32()))])

    def make():
        def each(batch):
            yield record(out, batch.column("doc_id"), batch.column("th"), [merged(s, span) for s in batch.column("starts").to_pylist()])

        return each

    found = written(map_arrow(lists, make, "doc_id long, th long, ranges array<int>"), "ranges")
    dropped(marks, first)
    return found


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def sized(side: DataFrame, column: str, width: int) -> DataFrame:
    """side (a written table) with a broadcast hint if its rows and the arrays in column are within BROADCAST_BYTES."""
    n, inside = side.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    return F.broadcast(side) if n * 56 + (inside or 0) * width <= BROADCAST_BYTES else side


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, one space between) of every row of docs."""
    found = keyed(docs).join(sized(repeats(docs, span, gram), "ranges", 4), ["doc_id", "th"], "left").select("doc_id", "text", "ranges")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                rows = []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n, kept, at = len(words), [], 0
                    for lo, hi in zip((ranges or [])[::2], (ranges or [])[1::2], strict=True):
                        kept += words[at:lo]
                        at = max(at, min(hi, n))
                    kept += words[at:]
                    rows.append((n, n - len(kept), b" ".join(kept).decode()))
                yield record(out, part.column("doc_id"), *map(list, zip(*rows, strict=True)))

        return each

    return map_arrow(found, make, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
