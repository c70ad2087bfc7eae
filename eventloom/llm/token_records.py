"""Token-ID / binary output: whole texts as framed binary records with an offset index.

A data file is a sequence of frames::

    u64 length of payload | u32 masked crc of those 8 bytes | payload | u32 masked crc of payload | 0x0A
    payload: u8 flags | i64 doc_id | token ids

little-endian throughout. Flags: 1 ids are 16 bits wide (else 32), 2 doc_id is null. The checksum is CRC-32,
rotated right by 15 bits plus 0xA282EAD8, so that a checksum stored beside checksums stays meaningful. Spark's own
text writer, with the frame's last byte as line separator, commits the files: they reach any store Spark writes to, and a
task that is run again after an executor is lost leaves no double rows. The offset index is a Parquet table beside them.

Records stand in ascending order of doc_id, then of a hash of the text. Files are dealt by that order and the row's number last, so
that rows of one doc_id, or of none, and even equal rows spread over as many files as they fill.

A text is encoded as the tokenizer's plain call does: the string of a special token in a text (here "<|endoftext|>") gives
that token. special_as_text=True takes such strings as ordinary text.

Nulls: a null text is empty and gets the end id alone; a null doc_id sorts first. Rows with one doc_id all stay. An empty table gives no
record. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, record, slices, small_side, texts_of, written
from .textvec import mix, powers, random64

SEPARATOR = "\n"
WIDE, NO_ID = 1, 2
#: Text bytes of a data file, about; files are read whole.
FILE_BYTES = 64 << 20
#: Pieces a task remembers with their ids before it starts anew.
CACHE_PIECES = 1_000_000
_HEAD, _BODY = struct.Struct("<QI"), struct.Struct("<Bq")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    payload = _BODY.pack(WIDE * narrow | NO_ID * (doc_id is None), doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


def frames(data: bytes):
    """(offset, length, doc_id, ids as uint32) of each record; ValueError where a checksum or a length is wrong."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + _HEAD.size > len(data):
            raise ValueError(f"record at {at}: cut off")
        size, crc = _HEAD.unpack_from(data, at)
        if masked_crc(data[at : at + 8]) != crc:
            raise ValueError(f"record at {at}: wrong checksum of its length")
        lo, hi = at + _HEAD.size, at + _HEAD.size + size
        if hi + 5 > len(data) or data[hi + 4] != 10:
            raise ValueError(f"record at {at}: cut off")
        if masked_crc(view[lo:hi]) != struct.unpack_from("<I", data, hi)[0]:
            raise ValueError(f"record at {at}: wrong checksum of its payload")
        flags, doc_id = _BODY.unpack_from(data, lo)
        ids = np.frombuffer(view[lo + _BODY.size : hi], "<u2" if flags & WIDE else "<u4").astype("<u4")
        yield at, hi + 5 - at, None if flags & NO_ID else doc_id, ids
        at = hi + 5


# Bytes that are no white space and begin none: ASCII alone, or lead bytes that no white space has.
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_ASCII_SPACE
_SOLID[0x80:0xC0] = False
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_PLAIN = _SOLID.copy()
_PLAIN[0x80:] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_BYTE = random64(31, 256)


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, at boundaries that byte-level BPE's rule for words always has: before a space that precedes
    a non-space; around a single line end between non-spaces; between an ASCII letter and a stop."""
    begin = np.zeros(len(data), bool)
    n = len(data)
    if n > 1:
        solid, plain, space = _SOLID[data], _PLAIN[data], data == 0x20
        begin[:-1] |= space[:-1] & solid[1:]
        begin[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
        line = data == 0x0A
        begin[1:] |= line[1:] & plain[:-1]
        if n > 2:
            begin[2:] |= line[1:-1] & plain[:-2] & solid[2:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        begin[last[space[last]]] = False  # a space at a text's end precedes nothing of it
        starts = offsets[:-1]
        second = starts[starts + 1 < n] + 1
        # marks that looked back over a text's start are gone with the next line: the start itself is a boundary
        begin[second[(data[second - 1] == 0x0A) & ~space[second]]] = False
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begin)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, as bytes.

    Texts are cut into pieces that the tokenizer would encode alike alone, and each distinct piece (by a 64-bit hash that binds its length) is
    encoded once by the tokenizer; the rest is gathered with numpy. New pieces that begin with a space are encoded many at a time, joined
    again, and told apart by the bytes their tokens stand for. The bytes that the gathered ids stand for are compared with the text; a
    text that differs, or that holds the string of an added token, is encoded by the tokenizer as a whole. A tokenizer that isn't byte-level without a normaliser encodes all texts as
    a whole.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content.encode() for t in added.values() if t.content and not (special_as_text and t.special)]
        rules = json.loads(self.tokenizer.to_str())
        split = rules.get("pre_tokenizer") or {}
        self.cuts = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        byte_of = _byte_of() if self.cuts else {}
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = token.encode() if i in added or not self.cuts else bytes(byte_of[c] for c in token)
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.spelled, self.spelled_at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.size) - self.size
        self.narrow = len(self.size) <= 1 << 16 and end_id < 1 << 16
        self.kind = np.dtype("<u2" if self.narrow else "<u4")
        self.end = end_id
        self.forget()

    def forget(self) -> None:
        """Keys of known pieces, ascending; and where each one's ids are in the store."""
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, self.kind)

    def unlike(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Texts whose ids don't stand for their bytes."""
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        bad = set(np.flatnonzero(np.diff(ends[first]) != np.diff(offsets)).tolist())
        if bad:
            return np.arange(len(offsets) - 1)  # places are shifted; all are made anew
        for lo in range(0, len(ids), 1 << 18):
            some = ids[lo : lo + (1 << 18)]
            n, begin = self.size[some], int(ends[lo])
            spots = np.arange(int(n.sum())) + np.repeat(self.spelled_at[some] - (ends[lo : lo + len(some)] - begin), n)
            wrong = np.flatnonzero(self.spelled[spots] != data[begin : begin + len(spots)])
            bad.update((np.searchsorted(offsets, begin + wrong, side="right") - 1).tolist())
        return np.array(sorted(bad), np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, self.kind) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        spaced = [i for i, x in enumerate(pieces) if x[:1] == b" " and len(x) > 1 and _PLAIN[x[1]] and _PLAIN[x[-1]]]
        alone = set(range(len(pieces))).difference(spaced)
        groups = [spaced[lo : lo + 2000] for lo in range(0, len(spaced), 2000)]
        for group, ids in zip(groups, self._ids([b"".join([pieces[i] for i in g]).decode() for g in groups]), strict=True):
            ends, stops = np.cumsum(self.size[ids]), np.cumsum([len(pieces[i]) for i in group])
            after = np.searchsorted(ends, stops) + 1
            if np.array_equal(ends[np.minimum(after, len(ends)) - 1], stops):
                for i, part in zip(group, np.split(ids, after[:-1]), strict=True):
                    out[i] = part
            else:
                alone.update(group)
        rest = sorted(alone)
        for i, ids in zip(rest, self._ids([pieces[i].decode() for i in rest]), strict=True):
            out[i] = ids
        return out

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """keys: ascending, none known."""
        found = self.ids_of(pieces)
        n = np.array([len(x) for x in found], np.int64)
        at = len(self.store) + np.cumsum(n) - n
        self.store = np.concatenate([self.store, *found])
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, spot, keys), np.insert(self.at, spot, at), np.insert(self.n, spot, n)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text and the end id, in the encoder's width."""
        data, offsets = texts_of(column)
        whole = data.tobytes()
        alone = set() if self.cuts else set(range(len(offsets) - 1))
        for mark in self.marks:
            at = whole.find(mark)
            while at >= 0:
                alone.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = whole.find(mark, at + 1)
        starts = pieces_of(data, offsets) if self.cuts else np.zeros(0, np.int64)
        ids, first = np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        if len(starts):
            lengths = np.diff(np.append(starts, len(data)))
            place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
            hashes = mix(np.add.reduceat(_BYTE[data] * powers(0x9E3779B97F4A7C15, int(lengths.max()))[place], starts) + lengths.astype(np.uint64))
            keys, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.keys) > CACHE_PIECES:
                self.forget()
            spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[spot] != keys) if len(self.keys) else np.arange(len(keys))
            if len(new):
                lo = starts[one[new]]
                self.learn(keys[new], [whole[a:b] for a, b in zip(lo.tolist(), (lo + lengths[one[new]]).tolist(), strict=True)])
                spot = np.searchsorted(self.keys, keys)
            at, n = self.at[spot][kind], self.n[spot][kind]
            sums = np.concatenate([[0], np.cumsum(n)])
            ids = self.store[np.repeat(at - sums[:-1], n) + np.arange(int(sums[-1]))]
            first = sums[np.searchsorted(starts, offsets)]
            alone.update(self.unlike(data, offsets, ids, first).tolist())
        end = np.array([self.end], self.kind).tobytes()
        raw, width = ids.tobytes(), self.kind.itemsize
        out = [raw[a:b] + end for a, b in zip((first[:-1] * width).tolist(), (first[1:] * width).tolist(), strict=True)]
        rest = sorted(alone)
        for i, found in zip(rest, self._ids([whole[offsets[i] : offsets[i + 1]].decode() for i in rest]), strict=True):
            out[i] = found.tobytes() + end
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(path: str, end_id: int, special_as_text: bool = False) -> Encoder:
    """One encoder a worker process, so that tasks in turn share the pieces it knows."""
    key = path, end_id, special_as_text
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES, special_as_text: bool = False) -> DataFrame:
    """Writes path/data and path/index in ascending doc_id order; gives the index.

    docs: doc_id long, text string. The index has file, record (its number in the file), doc_id, offset, length,
    n_tokens, ids_crc32, and before (tokens ahead of it in the file), all found by reading the files back.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"th": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, "doc_id", "th", "row").sortWithinPartitions("doc_id", "th", "row").select("doc_id", "text")
    out = pa.schema([("frame", pa.binary())])

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer, end_id, special_as_text)

        def each(batch):
            for part in slices(batch, "text", 4 << 20):
                found = zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True)
                yield record(out, [frame(i, x, encoder.narrow) for i, x in found])

        return each

    map_arrow(ordered, make, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(f"{path}/data")
    read_back(spark, f"{path}/data").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The index of the data files in path, every checksum verified."""
    out = pa.schema([("file", pa.string()), ("record", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("before", pa.int64())])

    def make():
        def each(batch):
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for n, (offset, length, doc_id, ids) in enumerate(frames(data.as_py())):
                    rows.append((file.rsplit("/", 1)[-1], n, doc_id, offset, length, len(ids), zlib.crc32(ids), before))
                    before += len(ids)
                if rows:
                    yield record(out, *map(list, zip(*rows, strict=True)))

        return each

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, make, "file string, record long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long, before long")


def file_number(file: Column) -> Column:
    """What orders data files: the task's number in their name, then the number of the task's file; both outgrow their padding."""
    return F.struct(*[F.regexp_extract(file, r"^part-(\d+)-.*?(?:-c(\d+))?(?:\.[^-]*)?$", k).cast("long") for k in (1, 2)], file)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start: the tokens of all records before it, over all files. One row a file goes to one task."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy(file_number(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select("file", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base")), "file-starts")
    return index.join(small_side(bases, 200), "file").withColumn("start", F.col("base") + F.col("before"))


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """doc_id and ids of all records in a seeded order: the index is shuffled, and each file cut at its offsets."""
    index = spark.read.parquet(f"{path}/index")
    spots = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "file", "record").alias("place"), "offset", "length"))).alias("spots"))
    files = spark.read.format("binaryFile").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    out = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def make():
        def each(batch):
            for spots, data in zip(batch.column("spots").to_pylist(), batch.column("content"), strict=True):
                data = data.as_py()
                got = [(s["place"], *next(frames(data[s["offset"] : s["offset"] + s["length"]]))[2:]) for s in spots]
                yield record(out, [g[0] for g in got], [g[1] for g in got], [g[2].tolist() for g in got])

        return each

    return map_arrow(files.join(spots, "file").select("spots", "content"), make, "place long, doc_id long, ids array<long>").orderBy("place", "doc_id").drop("place")
