"""LM scoring by online logistic context mixing.

A text is its tokens: words (A-Z lower-cased) and one end. A token is predicted in two steps.

Repeats: where the two tokens before it stood together earlier in the text, the token that followed them there last is predicted, and
one decision says whether it comes again. Its probability depends on how many such predictions have just come true in a row and on how many
the text has had: the text's own history, kept up token by token, so order and repetition count. The table of these probabilities is that
of all training texts' decisions.

Spelling: any other token is coded byte by byte with a closing space, a byte as eight binary decisions. Predictors give each decision a
probability by counts under hashed contexts: the word so far with the context before the word and with the script cue alone, and the last
bytes with the cue, all counted over all training tokens. The context before a word is the cue (the last non-ASCII character before it, dealt into
CUES classes: it says which language a text is in) and the class of the word before it (short words, which tell most about what follows,
by a hash; all others and none are one). Logits of the predictors are summed with weights from a set that a gate chooses (how well the
longest context is known, and the place in the word); the sum is refined by an adaptive table of the gate's own experience. Weights and refinement
are learned online, over all training tokens, each left out of its own counts of the word so far, in minibatches; tasks learn apart and their
weights are averaged by the tokens they saw. Every byte of a word is spelled: what follows its first PIECE bytes is in the table as pieces of as many, each with
the beginning it stands after, so that its decisions are those of the whole word; a word without end takes no more memory than many words.

The spelling of a token depends on the token and the context before it alone, so the corpus is first counted into a table of (context, word) with
training counts, which is the model's training set and all that is spelled. It is sorted by word and cut into chunks of bounded bytes. Words of
one beginning are neighbours, so a chunk has all counts of the beginnings within it; those that reach over its first or last word are
added up over the chunks and joined to each. A text's score is a sum over its tokens: of the most frequent ones by a table of HEAD entries
that is broadcast, of the others by a join on the pair. What is gathered and joined grows with the corpus and is never sampled. Tokens of one
text are told apart by 64-bit hashes, and the joined pairs by these and the word's length, first, middle and last byte.

base_score is the unigram model with 0.1 added to each count; bits_per_byte is the score in bits for each byte of the text (its end counts as
one). Nulls: a null text is empty and has its end alone. A null doc_id is scored, but neither learned from nor held out. Rows
repeated with one doc_id are learned from and scored each. An empty table gives no row; without training tokens every decision is even.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from hashlib import blake2b
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, longs, map_arrow, map_batches, record, slices, texts_of, written
from .textvec import Words, mix, powers, random64

#: Script cues; classes of the word before; bytes of a word that has a class of its own, at most.
CUES, CLASSES, SHORT = 16, 8, 3
#: (context, word) pairs in the broadcast score table.
HEAD = 3 << 19
#: (context, word) pairs of a chunk, and bytes to spell in it, at most; pairs of a task; bytes of a word that are spelled at a time.
CHUNK, CHUNK_BYTES, TASK, PIECE = 8192, 1 << 17, 100_000, 1024
#: Bytes of a word that are spelled: all, as no text is longer.
LONG = 1 << 31
#: Predictors that are counted by chunk, without tables: word so far with context, with cue.
TREES = 2
#: log2 of the slots of the other predictors: last 3 bytes with cue, last 2 bytes with cue.
BITS = (19, 18)
GATES = 8 * 4
#: Cells of the repeat decision: predictions that came true in a row, and log2 of those made in the text.
ROWS, MADE = 16, 8
STEPS = 33  # of the refinement, over logits from -8 to 8
END = b"\n"
_BYTE = random64(23, 256)
_END = 0x5DEECE66D  # stands for the hash of a text's end
_BASE = 0x9E3779B97F4A7C15  # of the hash of a word so far
#: A piece in the vocabulary: a space, which begins no word, hash and length of the word so far, the three bytes before, last one first; then its bytes.
HEADER = 1 + 8 + 8 + 3


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct value, in their order, and the number of each place's value."""
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


# --- tokens ---------------------------------------------------------------------------------------------------------


def cues_at(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The cue at byte places: 0, or the class of the last non-ASCII character before it in its text."""
    is_lead = data >= 0xC0
    leads = np.flatnonzero(is_lead)
    if not len(leads):
        return np.zeros(len(places), np.int64)
    ahead = np.zeros(len(data) + 1, np.int32)
    np.cumsum(is_lead, out=ahead[1:])
    last = ahead[places] - 1
    spot = leads[np.maximum(last, 0)]
    code = data[spot].astype(np.int64) * 256 + data[np.minimum(spot + 1, len(data) - 1)]
    return np.where((last >= 0) & (spot >= offsets[text]), 1 + code * 40503 % 65521 % (CUES - 1), 0)


class Tokens:
    """All tokens of some texts: text, context (column cue), and a key of context and word; texts' ends come after all words."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(*texts_of(column), lower=True)
        n = len(w.offsets) - 1
        self.text = np.concatenate([w.text_of(), np.arange(n)])
        self.hash = np.concatenate([w.hashes(), np.full(n, _END, np.uint64)])
        # of each token: the token before it in its text, or -1
        before = np.concatenate([np.arange(w.n) - 1, w.first[1:] - 1])
        before[before < w.first[:-1][self.text]] = -1
        sizes = w.ends - w.starts
        kind = np.where(sizes <= SHORT, 1 + (self.hash[: w.n] >> np.uint64(40)) % np.uint64(CLASSES - 1), np.uint64(0)).astype(np.int64)
        self.cue = cues_at(w.data, w.offsets, np.concatenate([w.starts, w.offsets[1:]]), self.text)
        if w.n:
            self.cue += CUES * np.where(before >= 0, kind[before], 0)
        self.key = mix(self.hash * np.uint64(31) + self.cue.astype(np.uint64))

    def shapes(self) -> np.ndarray:
        """The second part of each token's key."""
        shapes = np.concatenate([shapes_of(self.words), np.zeros(len(self.words.offsets) - 1, np.uint64)])
        return shapes * np.uint64(CUES * CLASSES) + self.cue.astype(np.uint64)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each token's repeat decision (-1: none is made), and whether the prediction comes true."""
        w, n = self.words, len(self.words.offsets) - 1
        # tokens in the order of their texts, each text's end after its words
        place = np.concatenate([np.arange(w.n) + self.text[: w.n], w.first[1:] + np.arange(n)])
        h, t = np.empty(len(place), np.uint64), np.empty(len(place), np.int64)
        h[place], t[place] = self.hash, self.text
        begin = w.first[:-1] + np.arange(n)
        at = np.flatnonzero(np.arange(len(h)) - begin[t] >= 2)
        key = mix(h[at - 2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[at - 1] + np.uint64(7))) + t[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        slot = (key >> np.uint64(64 - max(10, min(23, 3 + len(key).bit_length())))).astype(np.int64)
        twice = np.bincount(slot)[slot] > 1 if len(slot) else np.zeros(0, bool)
        at, key = at[twice], key[twice]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        now, then = at[order[same + 1]], at[order[same]]
        earlier = np.full(len(h), -1, np.int64)
        earlier[now] = then
        made = np.flatnonzero(earlier >= 0)
        true = h[made] == h[earlier[made]]
        index = np.arange(len(made))
        first = np.searchsorted(t[made], t[made])  # the text's first decision
        missed = np.concatenate([[0], np.maximum.accumulate(np.where(true, 0, index + 1))])[:-1] if len(made) else index
        row = np.minimum(index - np.maximum(missed, first), ROWS - 1)
        tried = np.minimum(np.log2(index - first + 1).astype(np.int64), MADE - 1)
        cell, hit = np.full(len(h), -1, np.int64), np.zeros(len(h), bool)
        cell[made], hit[made] = row * MADE + tried, true
        return cell[place], hit[place]

    def pieces(self) -> tuple[np.ndarray, pa.Array]:
        """The pieces after the first PIECE bytes of words, as the vocabulary has them, and the token of each. The last one has the closing space, and may
        have no byte besides."""
        w, of, found = self.words, [], []
        for token in np.flatnonzero(w.ends - w.starts >= PIECE).tolist():
            word, so_far, power = w.data[w.starts[token] : w.ends[token]], 0, 1
            for at in range(PIECE, len(word) + 1, PIECE):
                so_far = (so_far + power * int((_BYTE[word[at - PIECE : at]] * powers(_BASE, PIECE)).sum(dtype=np.uint64))) % 2**64
                power = power * pow(_BASE, PIECE, 2**64) % 2**64
                of.append(token)
                found.append(b" " + so_far.to_bytes(8, "little") + at.to_bytes(8, "little") + word[at - 3 : at][::-1].tobytes() + word[at : at + PIECE].tobytes())
        return np.array(of, np.int64), pa.array(found, pa.binary())

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at the given tokens, as binary."""
        w = self.words
        is_word = at < w.n
        lengths = np.ones(len(at), np.int64)
        lengths[is_word] = (w.ends - w.starts)[at[is_word]]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = np.full(int(ends[-1]), END[0], np.uint8)
        begin = np.zeros(len(at), np.int64)
        begin[is_word] = w.starts[at[is_word]]
        spots = np.arange(int(ends[-1])) - np.repeat(ends[:-1] - begin, lengths)
        mine = np.repeat(is_word, lengths)
        data[mine] = w.data[spots[mine]]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def vocabulary(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word (or piece), cue, n_train and n_all of each pair; and cue, n_train, n_all of the repeat decision's cells: predictions that came true and those
    made, in training texts. docs: text, train."""
    out = pa.schema([("word", pa.binary()), ("cue", pa.int32()), ("n_train", pa.int64()), ("n_all", pa.int64())])

    def make():
        def each(batch):
            for part in slices(batch, "text", 6 << 20):
                found = Tokens(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)[found.text]
                first, kind = grouped(found.key)
                yield record(out, found.spelled(first), found.cue[first].astype(np.int32), np.bincount(kind, train, len(first)).astype(np.int64), np.bincount(kind, minlength=len(first)))
                token, pieces = found.pieces()
                if len(token):
                    yield record(out, pieces, found.cue[token].astype(np.int32), train[token].astype(np.int64), np.ones(len(token), np.int64))
                cell, hit = found.repeats()
                made = (cell >= 0) & train
                tried, true = np.bincount(cell[made], minlength=ROWS * MADE), np.bincount(cell[made & hit], minlength=ROWS * MADE)
                yield record(out, pa.nulls(ROWS * MADE, pa.binary()), np.arange(ROWS * MADE, dtype=np.int32), true, tried)

        return each

    rows = map_arrow(docs.select("text", "train"), make, "word binary, cue int, n_train long, n_all long")
    # a frequent word's rows are added up within the tasks first, and dealt by context as well
    table = written(rows.groupBy("word", "cue").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "vocabulary")
    return table.where("word IS NOT NULL"), table.where("word IS NULL").select("cue", "n_train", "n_all")


def chunked(vocab: DataFrame) -> DataFrame:
    """One row for each chunk of neighbours of the vocabulary: id; words, sizes, cues, n_train, n_all and c (training tokens of the word) of its
    pairs as bytes; how many words it has that occur in training, and how often they do; pieces are no words. All pairs of a word, CUES * CLASSES at most,
    are in one chunk."""
    parts = max(1, -(-vocab.count() // TASK))
    # a word's closing space counts in the order, so that all words of one beginning, to the bit, are neighbours
    order = F.concat("word", F.lit(b" "))
    out = pa.schema([("words", pa.binary())] + [(name, pa.binary()) for name in ("sizes", "cues", "n_train", "n_all", "c")] + [("kinds", pa.int64()), ("tokens", pa.int64())])

    def pack(batches):
        def full(table: pa.Table, begins: np.ndarray):
            data, offsets = _binary(table.column("word"))
            n_train, n_all = (table.column(name).to_numpy().astype(np.int64) for name in ("n_train", "n_all"))
            c = np.add.reduceat(np.where(is_piece(data, offsets), 0, n_train), begins)
            each = np.repeat(c, np.diff(np.append(begins, table.num_rows)))
            return record(out, [data.tobytes()], [np.diff(offsets).astype(np.int32).tobytes()], [table.column("cue").to_numpy().astype(np.uint8).tobytes()], *[[x.tobytes()] for x in (n_train, n_all, each)], [int((c > 0).sum())], [int(c.sum())])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < CHUNK and held.nbytes < CHUNK_BYTES:
                continue
            words = held.column("word").combine_chunks()
            begins = np.flatnonzero(np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]))
            # whole words alone: the last one may go on in the next batch
            bytes_to = np.cumsum(np.minimum(pc.binary_length(words).to_numpy(), PIECE) + 1)
            lo = 0
            while True:
                spent = int(bytes_to[lo - 1]) if lo else 0
                most = max(lo + 1, min(lo + CHUNK, int(np.searchsorted(bytes_to, spent + CHUNK_BYTES, side="right"))))
                if most >= held.num_rows:
                    break
                hi = int(begins[np.searchsorted(begins, most, side="right") - 1])  # the word that holds the bound goes on to the next chunk
                if hi <= lo:  # one word alone goes beyond it
                    after = np.searchsorted(begins, lo, side="right")
                    if after >= len(begins):
                        break
                    hi = int(begins[after])
                inside = begins[(begins >= lo) & (begins < hi)] - lo
                yield full(held.slice(lo, hi - lo), inside)
                lo = hi
            held = held.slice(lo)
        if held is not None and held.num_rows:
            words = held.column("word").combine_chunks()
            yield full(held, np.flatnonzero(np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])))

    ranged = vocab.select("word", "cue", "n_train", "n_all").repartitionByRange(parts, order).sortWithinPartitions(order, "cue")
    rows = map_batches(ranged, pack, "words binary, sizes binary, cues binary, n_train binary, n_all binary, c binary, kinds long, tokens long")
    return written(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


class Chunk:
    """A row of chunked(): its pairs, their decisions and, given the sums of edges(), all counts of the words so far."""

    def __init__(self, row: dict, train_only: bool = False):
        sizes = np.frombuffer(row["sizes"], np.int32)
        self.words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(row["words"])])
        self.cues = np.frombuffer(row["cues"], np.uint8).astype(np.int64)
        self.n_train, self.n_all, self.c = (np.frombuffer(row[name], np.int64) for name in ("n_train", "n_all", "c"))
        # beginnings of the first and the last word, which words of other chunks may have too
        self.rim = Decisions(self.words.take(pa.array([0, len(sizes) - 1])), self.cues[[0, -1]]).prefix if len(sizes) else np.zeros(0, np.uint64)
        if train_only:  # the others count for nothing
            seen = np.flatnonzero(self.n_train)
            self.words = self.words.take(pa.array(seen))
            self.cues, self.n_train, self.n_all, self.c = (x[seen] for x in (self.cues, self.n_train, self.n_all, self.c))
        self.decisions = d = Decisions(self.words, self.cues)
        self.n = d.weights(self.n_train)
        self.trees = []  # of each predictor: a decision of each of its contexts, the context of each decision, counts of both bits
        for c in d.contexts[:TREES]:
            first, kind = d.kinds(c)
            self.trees.append((first, kind, np.bincount(kind + len(first) * d.bit, self.n, 2 * len(first)).reshape(2, -1)))
        if row.get("e") is not None and len(row["e"]):
            key, n0, n1 = row["e"].view(np.uint64), row["e0"], row["e1"]
            order = np.argsort(key)
            for k, mine in enumerate(self.reach()):
                own = d.path(k, self.trees[k][0][mine])
                at = order[np.minimum(np.searchsorted(key, own, sorter=order), len(key) - 1)]
                same = key[at] == own
                self.trees[k][2][:, mine[same]] = np.stack([n0[at[same]], n1[at[same]]])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts that words of other chunks may have too, and their counts here: those whose word so far begins the first or last word."""
        key, counts = [], []
        for k, mine in enumerate(self.reach()):
            first, _, n = self.trees[k]
            key.append(self.decisions.path(k, first[mine]))
            counts.append(n[:, mine])
        return np.concatenate(key), np.concatenate(counts, 1)

    def reach(self) -> list[np.ndarray]:
        """Of each predictor, the contexts after a beginning of the first or last word."""
        near = np.isin(self.decisions.prefix, self.rim)
        return [np.flatnonzero(near[first // 8]) for first, _, _ in self.trees]

    def tree(self, out: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits of the predictors by the word so far, and how well the longest context is known; `out` leaves one token of each decision out."""
        logits, known = [], None
        for _, kind, counts in self.trees:
            n = counts.astype(np.float32)
            if out:
                bit = self.decisions.bit
                n0, n1 = n[0][kind], n[1][kind]
                n0, n1 = np.maximum(n0 - (1 - bit), 0), np.maximum(n1 - bit, 0)
                logits.append(stretch(n0, n1))
                known = knowledge(n0 + n1) if known is None else known
            else:
                logits.append(stretch(n[0], n[1])[kind])
                known = knowledge(n[0] + n[1])[kind] if known is None else known
        return logits, known


def frequent(rows: DataFrame, count: str, most: int, least_count: int = 1) -> DataFrame:
    """The rows of the highest counts, `most` at most: all counts from some step of a logarithmic scale on."""
    step = F.floor(F.log2(F.col(count)) * 8)
    rows = rows.where(F.col(count) >= least_count)
    steps = rows.groupBy(step.alias("s")).count().collect()
    total, least = 0, None
    for s, n in sorted(steps, reverse=True):
        total += n
        if total > most:
            break
        least = s
    return rows.where(step >= least) if least is not None else rows.limit(0)


# --- decisions ------------------------------------------------------------------------------------------------------


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.arange(7, -1, -1)
#: Of each byte: its bits, and what each of its decisions adds to a hashed context (the bits before it).
_BITS = (np.arange(256)[:, None] >> _SHIFT & 1).astype(np.int32)
_NODES = ((1 << np.arange(8)) | (np.arange(256)[:, None] >> (_SHIFT + 1))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) * _SPREAD


class Decisions:
    """The binary decisions of some (cue, word) pairs: bit, place in the word, and the slot in each predictor.

    All contexts depend on the cue and the word so far, so bytes after one beginning are decided once, however many words
    share it: of() gives the byte (eight decisions) of each byte of each word, and row its word.
    """

    def __init__(self, words: pa.Array, cues: np.ndarray):
        data, offsets = _binary(words)
        pieces = np.flatnonzero(is_piece(data, offsets))
        starts, lengths = offsets[:-1].copy(), np.diff(offsets)
        starts[pieces] += HEADER
        lengths[pieces] -= HEADER
        is_end = (lengths == 1) & (data[np.minimum(starts, max(0, len(data) - 1))] == END[0]) if len(data) else np.zeros(len(lengths), bool)
        sizes = np.where(is_end, 1, np.minimum(lengths + 1, PIECE))  # each word has its closing space, the longer ones in their last piece
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.row = row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(int(first[-1])) - first[row]
        symbol = np.full(len(row), 0x20, np.uint8)
        inside = place < lengths[row]
        symbol[inside] = data[(starts[row] + place)[inside]]
        values = _BYTE[symbol] * powers(_BASE, int(place.max(initial=0)) + 1)[place]
        if len(pieces):  # they go on from the word so far
            head = data[offsets[:-1][pieces][:, None] + np.arange(1, HEADER)]
            so_far, ahead, power = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.uint64)
            so_far[pieces], ahead[pieces] = head[:, :8].copy().view("<u8")[:, 0], head[:, 8:16].copy().view("<i8")[:, 0]
            power[pieces] = [pow(_BASE, n, 2**64) for n in ahead[pieces].tolist()]
            values *= power[row]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        base = sums[first[row]]
        if len(pieces):
            base -= so_far[row]
            within, place = place, place + ahead[row]
        cue = np.asarray(cues).astype(np.uint64)[row]
        spot = place.astype(np.uint64)
        one, self.of = grouped(mix(sums[1:] - base + spot * np.uint64(0xA24BAED4963EE407)) + (cue + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
        prefix = mix((sums[:-1] - base + spot)[one])
        cue, place, symbol_at = cue[one], place[one], symbol[one]
        before = []
        for k in range(1, 4):
            b = symbol[np.maximum(one - k, 0)].astype(np.uint64) + np.uint64(1)
            if len(pieces):
                early = np.flatnonzero((within[one] < k) & (ahead[row[one]] > 0))
                b[early] = head[np.searchsorted(pieces, row[one[early]]), 16 + k - 1 - within[one[early]]].astype(np.uint64) + np.uint64(1)
            before.append(np.where(place >= k, b, np.uint64(0)))
        b1, b2, b3 = before
        script = cue % np.uint64(CUES)
        self.symbol, self.prefix = symbol_at, prefix
        self.contexts = contexts = [mix(prefix + (cue + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)), mix(prefix + (script + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)), b1 | b2 << np.uint64(9) | b3 << np.uint64(18) | script << np.uint64(27), b1 | b2 << np.uint64(9) | script << np.uint64(18)]
        self.bit = _BITS[symbol_at].ravel()
        self.symbol, self.prefix = symbol_at, prefix
        self.contexts = contexts = [mix(prefix + (cue + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)), mix(prefix + (script + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)), b1 | b2 << np.uint64(9) | b3 << np.uint64(18) | script << np.uint64(27), b1 | b2 << np.uint64(9) | script << np.uint64(18)]
        shift = np.arange(7, -1, -1)
        self.bit = ((symbol_at[:, None] >> shift) & 1).ravel().astype(np.int32)
        self.step = np.repeat(np.minimum(place, 3).astype(np.uint8), 8)  # the place in the word, for the gate
        self.slots = [(self.path(k, None) >> np.uint64(64 - b)).astype(np.int32) for k, b in enumerate(BITS, TREES)]

    def path(self, k: int, at: np.ndarray | None) -> np.ndarray:
        """The hashed context of predictor k at some decisions, or at all: that of the byte, and the bits of the byte so far."""
        c = mix(self.contexts[k] + np.uint64(k * 7 + 1)) * _SPREAD
        if at is None:
            return (c[:, None] + _NODES[self.symbol]).ravel()
        byte, depth = np.divmod(at, 8)
        return c[byte] + _NODES[self.symbol[byte], depth]

    def kinds(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A decision of each distinct pair of a byte's context and its bits so far, and the number of that pair for each decision.

        Bytes in the order of context and value have pairs that begin where the one before differs."""
        order = np.argsort(context & np.uint64(0xFFFFFFFFFFFFFF00) | self.symbol.astype(np.uint64))
        c, value = context[order] >> np.uint64(8), self.symbol[order]
        new = np.ones((8, len(order)), bool)
        other, apart = c[1:] != c[:-1], value[1:] ^ value[:-1]
        for k in range(8):
            new[k, 1:] = other | ((apart >> (8 - k)) != 0) if k else other
        number = np.cumsum(new.ravel(), dtype=np.int32).reshape(8, -1) - 1
        kind = np.empty((len(order), 8), np.int32)
        kind[order] = number.T
        depth, spot = np.divmod(np.flatnonzero(new), len(order))
        return order[spot] * 8 + depth, kind.ravel()

    def weights(self, n: np.ndarray) -> np.ndarray:
        """How often each decision is made, if each word comes n times."""
        return np.repeat(np.bincount(self.of, n[self.row], len(self.bit) // 8), 8)


def is_piece(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each word of a vocabulary, none of which is empty, is a piece of one."""
    return data[offsets[:-1]] == 0x20


def _binary(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    _, where, data = words.buffers()
    offsets = np.frombuffer(where, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05))), -8, 8)


def knowledge(n: np.ndarray) -> np.ndarray:
    """0 to 7: how often a context was seen."""
    return np.minimum(np.floor(np.log2(n + 1)), 7).astype(np.uint8)


@dataclass
class Model:
    logits: list[np.ndarray]  # of each predictor with a table, by slot
    weights: np.ndarray  # gates x predictors
    refined: np.ndarray  # gates x STEPS: probabilities

    def mix(self, d: Decisions, tree: tuple[list[np.ndarray], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Inputs of each predictor, gate and logit of each decision; tree: the first inputs, and how well the longest context is known."""
        first, known = tree
        x = [*first, *[t[s] for t, s in zip(self.logits, d.slots, strict=True)]]
        gate = (known * np.uint8(4) + d.step).astype(np.intp)
        z = np.zeros(len(gate), np.float32)
        table = np.ascontiguousarray(self.weights.T, np.float32)
        for k, logit in enumerate(x):
            z += table[k].take(gate) * logit
        return x, gate, np.clip(z, -8, 8)

    def log10(self, chunk: Chunk) -> np.ndarray:
        """log10 probability of the spelling of each pair's word, given the context before it."""
        d = chunk.decisions
        _, gate, z = self.mix(d, chunk.tree(out=False))
        p = self.probabilities(gate, z)
        each = np.log10(np.where(d.bit == 1, p, 1 - p)).reshape(-1, 8).sum(1, dtype=np.float64)
        return np.bincount(d.row, each[d.of], len(chunk.words))

    def probabilities(self, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of a one: the mean of the mixed and the refined probability."""
        at = (z + np.float32(8)) * np.float32((STEPS - 1) / 16)
        lo = np.minimum(at.astype(np.intp), STEPS - 2)
        part = at - lo.astype(np.float32)
        table, spot = self.refined.astype(np.float32).ravel(), gate * STEPS + lo
        below, above = table.take(spot), table.take(spot + 1)
        return (1 / (1 + np.exp(-z)) + below + (above - below) * part) / 2


def even_refinement() -> np.ndarray:
    return np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (GATES, 1))


def chunks_of(batches):
    """The rows of chunked() and counted(), one at a time; lists as numpy arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                value = column[i]
                row[name] = (value.values.to_numpy() if value.is_valid else None) if pa.types.is_list(column.type) else value.as_py()
            yield row


# --- learning -------------------------------------------------------------------------------------------------------

BLOCK = 4096
#: Decisions of one gate in a step of learning, at least.
BATCH = 2048


def counted(chunks: DataFrame) -> tuple[list[np.ndarray], DataFrame]:
    """Counts (slots x 2) of the predictors by last bytes, over all training tokens, and the chunks with the sums of their edges.

    Tasks send blocks, which are added in a stream, and the edges of their chunks."""
    out = pa.schema([("block", pa.int32()), ("counts", pa.binary()), ("chunk", pa.int64()), ("context", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
    starts = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])

    def count(batches):
        table = np.zeros(2 * int(starts[-1]), np.int64)
        for row in chunks_of(batches):
            chunk = Chunk(row)
            d = chunk.decisions
            n = chunk.n.astype(np.int64)
            for at, slot in zip(starts, d.slots, strict=False):
                np.add.at(table, 2 * (at + slot) + d.bit, n)
            key, sums = chunk.edges()
            none = pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary())
            yield record(out, *none, np.full(len(key), row["chunk"]), longs(key), sums[0].astype(np.int64), sums[1].astype(np.int64))
        blocks = table.reshape(-1, BLOCK, 2)
        used = np.flatnonzero(blocks.any((1, 2)))
        for lo in range(0, len(used), 64):
            some = used[lo : lo + 64]
            yield record(out, some.astype(np.int32), [zlib.compress(blocks[i].tobytes(), 1) for i in some], *[pa.nulls(len(some), pa.int64())] * 4)

    sums_of = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def add(batches):
        held, sums = None, np.zeros((BLOCK, 2), np.int64)
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if block != held:
                    if held is not None:
                        yield record(sums_of, [held], [zlib.compress(sums.tobytes(), 1)])
                    held, sums = block, np.zeros((BLOCK, 2), np.int64)
                sums = sums + np.frombuffer(zlib.decompress(counts), np.int64).reshape(BLOCK, 2)
        if held is not None:
            yield record(sums_of, [held], [zlib.compress(sums.tobytes(), 1)])

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = written(map_batches(chunks, count, "block int, counts binary, chunk long, context long, n0 long, n1 long"), "counts")
    added = map_batches(sent.where("block IS NOT NULL").select("block", "counts").repartition(parts, "block").sortWithinPartitions("block"), add, "block int, counts binary")
    table = np.zeros((int(starts[-1]) // BLOCK, BLOCK, 2), np.int64)
    for row in added.collect():  # as many rows as the tables have blocks
        table[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64).reshape(BLOCK, 2)
    table = table.reshape(-1, 2)

    edges = sent.where("block IS NULL").select("chunk", "context", "n0", "n1")
    sums = edges.groupBy("context").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("chunks")).where("chunks > 1").drop("chunks")
    of_chunk = edges.select("chunk", "context").join(sums, "context").groupBy("chunk").agg(F.collect_list(F.struct("context", "n0", "n1")).alias("edges"))
    flat = of_chunk.select("chunk", F.col("edges.context").alias("e"), F.col("edges.n0").alias("e0"), F.col("edges.n1").alias("e1"))
    return [table[a:b] for a, b in zip(starts, starts[1:], strict=False)], written(chunks.join(flat, "chunk", "left"), "counted-chunks")


def _learn(chunks: DataFrame, model: Model) -> Model:
    """Weights and refinement, learned online over all training tokens."""
    held = chunks.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("seen", pa.float64()), ("weights", pa.binary()), ("refined", pa.binary())])

    def learn(batches):
        own = Model(held.value.logits, held.value.weights.copy(), held.value.refined)
        seen, table = 0.0, np.zeros(GATES * STEPS * 2)
        size = TREES + len(BITS)
        curved = np.tile(np.eye(size), (GATES, 1, 1))  # of the loss, so far
        # the task's pairs are about TASK; chunks come in a seeded order
        runs = list(chunks_of(batches))
        for at in np.random.Generator(np.random.PCG64(1)).permutation(len(runs)).tolist():
            chunk = Chunk(runs[at], train_only=True)
            if not len(chunk.cues):
                continue
            d, n = chunk.decisions, chunk.n
            x, gate, z = own.mix(d, chunk.tree(out=True))
            near = np.rint((z + 8) * ((STEPS - 1) / 16)).astype(np.int64)
            table += np.bincount((gate * STEPS + near) * 2 + d.bit, n, 2 * GATES * STEPS)
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            ends = np.searchsorted(gate[order], np.arange(GATES + 1))
            for g in np.flatnonzero(np.diff(ends)):
                mine = order[ends[g] : ends[g + 1]]
                steps = max(1, min(4, len(mine) // BATCH))
                for k in range(steps):  # online Newton steps of the gate's weights, each on decisions from all over the chunk
                    some = mine[k::steps]
                    xs, w = np.stack([v[some] for v in x]), n[some].astype(np.float32)
                    p = 1 / (1 + np.exp(-np.clip(own.weights[g].astype(np.float32) @ xs, -8, 8)))
                    curved[g] += np.einsum("in,jn->ij", xs * (w * p * (1 - p)), xs, dtype=np.float64)
                    own.weights[g] -= np.clip(np.linalg.solve(curved[g], np.einsum("in,n->i", xs, w * (p - d.bit[some]), dtype=np.float64)), -0.1, 0.1)
            seen += float(n.sum())
        yield record(out, [seen], [own.weights.tobytes()], [table.tobytes()])

    seen, weights, table = 0.0, np.zeros((GATES, TREES + len(BITS))), np.zeros((GATES, STEPS, 2))
    for row in map_batches(chunks, learn, "seen double, weights binary, refined binary").collect():  # a few kilobytes a task
        seen += row["seen"]
        weights += row["seen"] * np.frombuffer(row["weights"]).reshape(weights.shape)
        table += np.frombuffer(row["refined"]).reshape(table.shape)
    held.destroy()  # its copies on the executors' disks go at once
    if seen:
        prior = 20.0
        refined = (table[..., 1] + prior * even_refinement()) / (table.sum(-1) + prior)
        model = Model(model.logits, weights / seen, np.clip(refined, 1e-5, 1 - 1e-5))
    return model


def fit(chunks: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the chunks, with their edges' sums, that it is applied to."""
    low, chunks = counted(chunks)
    logits = [stretch(t[:, 0].astype(np.float32), t[:, 1].astype(np.float32)) for t in low]
    return _learn(chunks, Model(logits, np.full((GATES, TREES + len(BITS)), 0.3), even_refinement())), chunks


# --- scores ---------------------------------------------------------------------------------------------------------


def scored_vocabulary(chunks: DataFrame, model: Model) -> DataFrame:
    """k1, k2 (the key of the pair), n_all, c and logp (log10 probability of the spelling) of every pair."""
    held = chunks.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_all", pa.int64()), ("c", pa.int64()), ("logp", pa.float64())])

    def run(batches):
        for row in chunks_of(batches):
            chunk = Chunk(row)
            yield record(out, *map(longs, keys_of(chunk.words, chunk.cues)), chunk.n_all, chunk.c, held.value.log10(chunk))

    found = written(map_batches(chunks, run, "k1 long, k2 long, n_all long, c long, logp double"), "scored-vocabulary")
    held.destroy()
    return found


def keys_of(words: pa.Array, cues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of pairs, as Tokens has them; those of pieces are digests."""
    data, offsets = _binary(words)
    is_end = np.diff(offsets) == 1
    is_end[is_end] = data[offsets[:-1][is_end]] == END[0]
    hashes, shapes = np.full(len(words), _END, np.uint64), np.zeros(len(words), np.uint64)
    pieces = is_piece(data, offsets)
    if pieces.any():
        digests = [blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in np.flatnonzero(pieces).tolist()]
        hashes[pieces], shapes[pieces] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
        data, offsets = _binary(words.filter(pa.array(~pieces)))
    w, plain = Words(data, offsets), ~is_end & ~pieces
    hashes[plain], shapes[plain] = w.hashes(), shapes_of(w)
    return mix(hashes * np.uint64(31) + cues.astype(np.uint64)), shapes * np.uint64(CUES * CLASSES) + cues.astype(np.uint64)


def shapes_of(w: Words) -> np.ndarray:
    """Length, first, middle and last byte of each word: what must be alike besides the hash."""
    sizes = np.minimum(w.ends - w.starts, (1 << 24) - 1).astype(np.uint64)
    first, middle, last = (w.data[at].astype(np.uint64) for at in (w.starts, (w.starts + w.ends) // 2, w.ends - 1))
    return 1 + (sizes << np.uint64(24) | first << np.uint64(16) | middle << np.uint64(8) | last)


def repeat_table(cells: DataFrame) -> np.ndarray:
    """log10 probability of a miss and of a hit in each cell."""
    made, true = np.zeros(ROWS * MADE), np.zeros(ROWS * MADE)
    for r in cells.groupBy("cue").agg(F.sum("n_train").alias("true"), F.sum("n_all").alias("made")).collect():  # a row a cell
        made[r["cue"]], true[r["cue"]] = r["made"], r["true"]
    p = (true + 0.4) / (made + 0.8)
    return np.log10(np.stack([1 - p, p]))


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs (doc_id, text, train)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("train", F.lit(False)).alias("train"))
    vocab, cells = vocabulary(docs)
    chunks = chunked(vocab)
    total, kinds = chunks.agg(*[F.coalesce(F.sum(name), F.lit(0)) for name in ("tokens", "kinds")]).first()
    base = F.log10((F.col("c") + 0.1) / F.lit(total + 0.1 * (kinds + 1)))
    model, chunks = fit(chunks)
    table = scored_vocabulary(chunks, model).withColumn("base", base)
    dropped(chunks)
    top = frequent(table, "n_all", head).select("k1", "k2", "c", "logp", "base").toArrow()
    held = spark.sparkContext.broadcast((*_head(top), repeat_table(cells)))
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("logp", pa.float64())])

    def make():
        head_keys, head_known, head_base, head_logp, repeat = held.value

        def each(batch):
            for part in slices(batch, "text", 3 << 20):
                found = Tokens(part.column("text"))
                n, rows, ids = part.num_rows, part.column("row").to_numpy(), part.column("doc_id")
                # distinct pairs are looked up, ascending, and their values go to the tokens
                first, kind = grouped(found.key)
                keys = found.key[first]
                at = np.minimum(np.searchsorted(head_keys, keys), max(0, len(head_keys) - 1))
                in_head = head_keys[at] == keys if len(head_keys) else np.zeros(len(keys), bool)
                known, base, logp = (np.where(in_head, v[at], 0) if len(head_keys) else np.zeros(len(keys)) for v in (head_known, head_base, head_logp))
                cell, true = found.repeats()
                own = np.where(cell >= 0, repeat[true.astype(np.int64), cell], 0.0) + np.where(true, 0.0, logp[kind])
                token, pieces = found.pieces()
                if len(token):  # they are spelled with the first bytes of their words, and are no tokens
                    token, pieces = token[~true[token]], pieces.filter(pa.array(~true[token]))
                    m, none = len(token), np.zeros(len(token), np.int64)
                    yield record(out, rows[found.text[token]], pa.nulls(m, pa.int64()), *map(longs, keys_of(pieces, found.cue[token])), none, np.ones(m, np.int64), none, none, np.zeros(m), np.zeros(m))
                none, size = pa.nulls(n, pa.int64()), np.diff(found.words.offsets) + 1
                yield record(out, rows, ids, none, none, np.bincount(found.text, minlength=n), np.zeros(n, np.int64), size, np.bincount(found.text, known[kind], n).astype(np.int64), np.bincount(found.text, base[kind], n), np.bincount(found.text, own, n))
                rest = np.flatnonzero(~in_head[kind])
                if len(rest):
                    spot, of = grouped(mix(found.key[rest] + found.text[rest].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    count, left, spot = np.bincount(of, minlength=len(spot)), np.bincount(of, ~true[rest], len(spot)), rest[spot]
                    m, none = len(spot), np.zeros(len(spot), np.int64)
                    yield record(out, rows[found.text[spot]], pa.nulls(m, pa.int64()), longs(found.key[spot]), longs(found.shapes()[spot]), count, left.astype(np.int64), none, none, np.zeros(m), np.zeros(m))

        return each

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scan = written(map_arrow(numbered, make, "row long, doc_id long, k1 long, k2 long, n long, m long, bytes long, known long, base double, logp double"), "token-sums")
    whole = scan.where("k1 IS NULL").select("row", "doc_id", F.col("n").alias("n_tokens"), "bytes", "known", "base", "logp")
    tail = scan.where("k1 IS NOT NULL").select("row", "k1", "k2", "n", "m")
    least = table.select("k1", "k2", "c", "base", "logp")
    more = tail.join(least, ["k1", "k2"]).groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * F.col("base")).alias("base2"), F.sum(F.col("m") * F.col("logp")).alias("logp2"))
    joined = whole.join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    found = joined.select("doc_id", "n_tokens", plus("known", "known2").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), plus("logp", "logp2").alias("score"), "bytes")
    return found.withColumn("bits_per_byte", F.col("score") / F.lit(-log10(2)) / F.col("bytes")).drop("bytes")


def _head(top: pa.Table) -> tuple[np.ndarray, ...]:
    """Sorted keys of pairs, and known, base and logp beside them."""
    keys = top.column("k1").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (top.column("c").to_numpy() > 0)[order].astype(np.int64), top.column("base").to_numpy()[order], top.column("logp").to_numpy()[order]
