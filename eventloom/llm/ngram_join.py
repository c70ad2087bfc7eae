"""N-gram Jaccard join: documents whose sets of word shingles are similar, by PartEnum signatures.

Words have A-Z lower-cased; a set holds the 64-bit hashes of all distinct shingles of n words, or of the whole sequence
where there are fewer words. Two sets link when 100 * intersection >= percent * union.

Sets are put in bands of size, such that similar sets lie in one band or in neighbours. Each band has a bound k on the
symmetric difference of such sets. The domain of shingles is dealt into n1 = k / 2 + 1 + spare groups of PARTS parts, so that
in spare + 1 groups at least two similar sets differ by one shingle at most, and agree on all parts of it but one. Every
choice of all parts but one is a signature, and similar sets share one. A signature of few shingles that
are rare says little: one of none would be shared by all long texts of a size. A set leaves out its signatures of fewer than WEAK such shingles, or else of none,
unless more than `spare` of its groups have one; spare grows with the groups, so that few sets must keep them. No link is lost by that: take the set of a pair that leaves out
more. It has `spare` such groups at most, so one of the spare + 1 groups is strong in it and, being equal, in the other.
Which shingles are common is told by a bounded sample of documents; any choice leaves the result the same.

Copies with one set are one class, known by the set's fingerprint, before anything else. In a bucket of one signature, all
classes are first compared with pivots, ROUNDS times, which settles most groups of near copies with a comparison or two each. Only
classes that are not yet known to be connected are then compared with each other, a hot bucket in blocks over many tasks.
Before any text is fetched, a sketch (how many shingles fall in each of some cells, the more the larger the set, whose differences add up to the symmetric
difference at most) rules out most pairs that aren't similar. Every link is verified on the whole sets: one text of each class that
shares a bucket is written once, goes to each pivot it is compared with, and sets are made there; a pivot of many
partners is dealt over several tasks. Tables are deleted as soon as a later one stands.

Nulls: a null text is empty; texts without words have no shingle, link with nothing and are components of their own. A
null doc_id links with nothing and gets a null component. Rows repeated with one doc_id are one document for
linking, whose links are those of all its rows; each row has its own number of shingles. An empty table gives no row. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, executors_tidy, longs, map_arrow, map_batches, record, slices, small_side, texts_of, tidy, written
from .graph import components
from .textvec import Words, mix

#: SPARE is the least number of spare groups, SPARE_SHARE their share of the groups that the bound alone needs.
PARTS, SPARE, SPARE_SHARE, WEAK = 3, 3, 0.2, 2
#: Rounds of comparisons with pivots, before what is left is compared pair by pair.
ROUNDS = 2
#: Pivots that a class is compared with in a round.
PIVOTS = 3
#: Cells of a sketch at least, and shingles for each cell of a larger one.
CELLS, PER_CELL = 256, 8
#: Partners of a pivot, and members of a block of a bucket, that one task compares.
PARTNERS, MEMBERS = 256, 2048
#: Documents of the sample that tells common shingles, those of them a common one is in, and common shingles, at most.
SAMPLE, COMMON, MOST_COMMON = 4000, 4, 1 << 17
#: Fingerprints that a task remembers, so that copies in it give signatures once.
SEEN = 1 << 18


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(*texts_of(column), lower=True)
    h = w.hashes()
    grams = w.grams(h, n)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(w.grams(h[lo:hi], hi - lo)[:1] if hi > lo else h[:0])
    return out


def fingerprint(shingles: np.ndarray, seed: int) -> int:
    return int(mix(np.array([mix(shingles + np.uint64(seed)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0])


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and the bound on the symmetric difference of a set in it and a set as large or larger."""
    first, bound, lo = [], [], 1
    while lo <= largest:
        hi = lo * 100 // percent
        first.append(lo)
        bound.append((hi + hi * 100 // percent) * (100 - percent) // (100 + percent))
        lo = hi + 1
    return np.array(first, np.int64), np.array(bound, np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of shingles by the highest bits of a hash; as many cells as the power of two that the size asks for."""
    cells = max(CELLS, 1 << max(0, (len(shingles) // PER_CELL).bit_length()))
    at = mix(shingles + np.uint64(5)) >> np.uint64(64 - cells.bit_length() + 1)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def sketches(column: list[bytes], cells: int) -> np.ndarray:
    """Sketches of one length as rows of so many cells, neighbours added up."""
    rows = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    return rows.reshape(len(column), cells, -1).sum(-1, dtype=np.int32)


def folded(column: list[bytes]) -> np.ndarray:
    """Sketches as rows of as many cells as the shortest has."""
    lengths = np.array([len(x) for x in column], np.int64)
    cells = int(lengths.min())
    out = np.zeros((len(column), cells), np.int32)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at] = sketches([column[i] for i in at.tolist()], cells)
    return out


def may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches (rows of cells) leave it open that sets are similar."""
    apart = np.abs(x - y).sum(-1)
    return (apart * (100 + percent) <= (n_x + n_y) * (100 - percent)) & (100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y))


def signatures(sets: list[np.ndarray], percent: int, common: np.ndarray | None = None, parts: int = PARTS, weak: int = WEAK) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all signatures of non-empty sets, in all bands they belong to."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, bound = bands(percent, int(sizes.max()))
    band = np.searchsorted(first, sizes, side="right") - 1
    shingles = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    spread, value = mix(shingles + np.uint64(1)), mix(shingles + np.uint64(2))
    rare = np.ones(len(shingles), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] != shingles
    owners, found = [], []
    for b in (band, band - 1):
        use = (b >= 0) & (sizes > 0)
        use[use] &= bound[b[use]] > 0  # without a difference only equal sets are similar, and those are one class
        least = bound[np.maximum(b, 0)] // 2 + 1
        spare = np.maximum(SPARE, (least * SPARE_SHARE).astype(np.int64))
        groups = np.where(use, least + spare, 0)
        start = np.concatenate([[0], np.cumsum(groups)])
        take = use[of]
        own = of[take]
        group = ((spread[take] >> np.uint64(32)) * groups[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        part = ((spread[take] & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cell = (start[own] + group) * parts + part
        total = int(start[-1])
        sums, counts = np.zeros(total * parts, np.uint64), np.bincount(cell, rare[take], minlength=total * parts).astype(np.int64)
        np.add.at(sums, cell, value[take])
        sums, counts = sums.reshape(total, parts), counts.reshape(total, parts)
        rest, left = sums.sum(1, dtype=np.uint64)[:, None] - sums, counts.sum(1)[:, None] - counts
        owner = np.repeat(np.arange(len(sets)), groups)
        keep = np.ones(left.shape, bool)
        for bar in range(1, weak + 1):  # the highest bar that few enough groups fail
            frail = left < bar
            few = np.bincount(owner, frail.any(1), len(sets)) <= spare
            keep &= ~(frail & few[owner][:, None])
        place = ((b[owner] << 40) + (np.arange(total) - start[owner]) * parts)[:, None] + np.arange(parts)
        owners.append(np.broadcast_to(owner[:, None], keep.shape)[keep])
        found.append(mix(rest + mix(place.astype(np.uint64)))[keep])
    return np.concatenate(owners), np.concatenate(found)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("sketch", pa.binary())])

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                yield record(out, part.column("doc_id"), part.column("th"), [len(s) for s in sets], longs(np.array([fingerprint(s, 3) for s in sets], np.uint64)), [sketch(s) for s in sets])

        return each

    return map_arrow(docs.select("doc_id", "text", "th"), make, "doc_id long, th long, n_shingles long, a long, sketch binary")


def _common(docs: DataFrame, sets: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles that are common in a sample of documents, sorted."""
    share = min(1.0, SAMPLE / max(1, sets.count()))
    place = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit((1 << 53) - 1))
    sample = docs.where(place < F.lit(int(share * (1 << 53)))).limit(2 * SAMPLE)
    out = pa.schema([("shingle", pa.int64())])

    def make():
        def each(batch):
            for part in slices(batch, "text"):
                yield record(out, longs(np.concatenate([*shingle_sets(part.column("text"), n), np.zeros(0, np.uint64)])))

        return each

    counts = map_arrow(sample.select("text"), make, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _signatures(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(common)
    out = pa.schema([("sig", pa.int64()), ("a", pa.int64())])

    def make():
        seen: set[int] = set()

        def each(batch):
            for part in slices(batch, "text"):
                fresh, prints = [], []
                for s in shingle_sets(part.column("text"), n):
                    a = fingerprint(s, 3)
                    if len(s) and a not in seen:
                        seen.add(a)
                        fresh.append(s)
                        prints.append(a)
                if len(seen) > SEEN:
                    seen.clear()
                if fresh:
                    owner, sig = signatures(fresh, percent, held.value)
                    yield record(out, longs(sig), longs(np.array(prints, np.uint64)[owner]))

        return each

    return map_arrow(docs.select("text"), make, "sig long, a long")


def _shared(rows: DataFrame) -> DataFrame:
    """(sig, a, pivot) of the signatures of two classes or more; pivot is the least of them. rows: sorted by sig and a."""
    out = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("pivot", pa.int64())])

    def run(batches):
        held: tuple[int, int, bool] | None = None  # the last row (sig, its pivot, whether the pivot's own row is out)
        last = None
        for batch in batches:
            sig, a = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (a[1:] != a[:-1])
            new[0] = (int(sig[0]), int(a[0])) != last
            last = int(sig[-1]), int(a[-1])
            sig, a = sig[new], a[new]
            if not len(sig):
                continue
            begins = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            lengths = np.diff(np.append(begins, len(sig)))
            pivot = a[begins]
            s, x, p = [], [], []
            goes_on = held is not None and held[0] == int(sig[0])
            if goes_on:
                pivot = pivot.copy()
                pivot[0] = held[1]
                if not held[2]:
                    s.append([held[0]])
                    x.append([held[1]])
                    p.append([held[1]])
            big = lengths > 1
            if goes_on:
                big[0] = True
            rows = np.repeat(big, lengths)
            s.append(sig[rows])
            x.append(a[rows])
            p.append(np.repeat(pivot, lengths)[rows])
            held = int(sig[-1]), int(pivot[-1]), bool(big[-1])
            yield record(out, *(np.concatenate(c).astype(np.int64) for c in (s, x, p)))

    return map_batches(rows, run, "sig long, a long, pivot long")


def _open_pairs(placed: DataFrame, classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (x, y) of classes of one bucket that aren't known to be connected and may be similar. placed: sig, a, root.

    A bucket is dealt into blocks of about MEMBERS, and each two blocks are compared by themselves, so no task holds more."""
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])
    open_ = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi")
    open_ = written(open_.select("sig", F.ceil(F.col("k") / MEMBERS).cast("int").alias("blocks")), "open-buckets")
    mixed = placed.join(open_, "sig").join(classes.select("a", "n", "sketch"), "a")
    own, other = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = mixed.withColumn("own", own).withColumn("other", other).select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "root", "n", "sketch")
    dealt = dealt.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def pairs(own, a, root, n, cells, cross: bool):
        step = 512
        for i in range(0, len(a), step):
            for j in range(i, len(a), step):
                rows, cols = np.s_[i : i + step], np.s_[j : j + step]
                good = root[rows, None] != root[None, cols]
                if cross:
                    good &= own[rows, None] != own[None, cols]
                if i == j:
                    good &= np.arange(good.shape[0])[:, None] < np.arange(good.shape[1])
                r, c = np.nonzero(good)
                for lo in range(0, len(r), 1 << 15):
                    u, v = i + r[lo : lo + (1 << 15)], j + c[lo : lo + (1 << 15)]
                    keep = may_link(cells[u], cells[v], n[u], n[v], percent)
                    x, y = a[u[keep]], a[v[keep]]
                    if len(x):
                        yield np.minimum(x, y), np.maximum(x, y)

    def fresh(found):
        """Batches without what this task gave just before."""
        seen: set[tuple[int, int]] = set()
        for x, y in found:
            new = [p for p in zip(x.tolist(), y.tolist(), strict=True) if p not in seen]
            seen.update(new)
            if new:
                yield record(out, *map(list, zip(*new, strict=True)))
            if len(seen) > 200_000:
                seen.clear()

    def run(batches):
        return fresh(search(batches))

    def search(batches):
        held: list[tuple] = []
        key_held = None

        def close():
            if len(held) and sum(len(h[0]) for h in held) > 1:
                own, a, root, n = (np.concatenate([h[k] for h in held]) for k in range(4))
                if (root != root[0]).any():
                    yield from pairs(own, a, root, n, folded([x for h in held for x in h[4]]), key_held[1] != key_held[2])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig, i, j, own, a, root, n = (batch.column(k).to_numpy() for k in range(7))
            cells = batch.column(7).to_pylist()
            begins = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for lo, hi in zip(begins, [*begins[1:], len(sig)], strict=True):
                key = int(sig[lo]), int(i[lo]), int(j[lo])
                if key != key_held:
                    yield from close()
                    held, key_held = [], key
                held.append((own[lo:hi], a[lo:hi], root[lo:hi], n[lo:hi], cells[lo:hi]))
        yield from close()

    return map_batches(dealt, run, "x long, y long").distinct()


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (x, y) whose sizes and sketches leave it open that they are similar."""
    x, y = (classes.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "xy")
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = [batch.column(c).to_pylist() for c in ("s_x", "s_y")]
                sizes = [batch.column(c).to_numpy() for c in ("n_x", "n_y")]
                lengths = np.array([[len(v) for v in c] for c in cells], np.int64)
                good = np.zeros(batch.num_rows, bool)
                for pair in np.unique(lengths, axis=1).T:
                    at = np.flatnonzero((lengths == pair[:, None]).all(0))
                    good[at] = may_link(*(sketches([c[i] for i in at.tolist()], int(pair.min())) for c in cells), *(n[at] for n in sizes), percent)
                yield record(out, batch.column("x").to_numpy()[good], batch.column("y").to_numpy()[good])

    both = pairs.join(x, "x").join(y, "y").select("x", "y", "n_x", "n_y", "s_x", "s_y")
    return map_batches(both, run, "x long, y long")


def _texts(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """a and text of one row of each asked class (a), or of equal rows."""
    wanted = written(classes.join(asked, "a").select(F.col("rep").alias("doc_id"), "th", "a"), "wanted")
    found = written(docs.join(small_side(wanted, 32), ["doc_id", "th"]).select("a", "text"), "class-texts", "zstd")
    dropped(wanted)
    return found


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Those of pairs (x, y: classes; a written table) that are similar. y is the pivot that texts of its partners are sent to."""
    shares = written(pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("shares")), "shares", rows=pairs.count())
    lead = shares.select(F.col("y").alias("a"), F.col("y").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("partner"))
    rest = pairs.join(shares, "y").select(F.col("x").alias("a"), F.col("y").alias("pivot"), F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("partner"))
    asked = written(lead.union(rest), "asked")
    sent = texts.join(small_side(asked, 32), "a").select("pivot", "share", "partner", "a", "text")
    sent = sent.repartition(parts, "pivot", "share").sortWithinPartitions("pivot", "share", "partner")
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def make():
        held: list = [None, None]  # the pivot and its set

        def each(batch):
            for part in slices(batch, "text"):
                pivots, partners, own = (part.column(c).to_pylist() for c in ("pivot", "partner", "a"))
                x, y = [], []
                for pivot, partner, a, s in zip(pivots, partners, own, shingle_sets(part.column("text"), n), strict=True):
                    if not partner:
                        held[:] = pivot, s
                        continue
                    if held[0] != pivot:
                        raise RuntimeError("a pivot without its text")
                    common = len(np.intersect1d(s, held[1], assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(held[1]) - common):
                        x.append(a)
                        y.append(pivot)
                if x:
                    yield record(out, x, y)

        return each

    found = written(map_arrow(sent, make, "x long, y long"), "found")
    dropped(shares, asked)
    return found


def _one_document(sets: DataFrame) -> DataFrame:
    """doc_id and first (the least class) of documents of several rows, and the class of each of their rows that has shingles."""
    some = F.when(F.col("n_shingles") > 0, F.col("a"))
    many = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(some).alias("first")).where("rows > 1 AND first IS NOT NULL")
    return written(many.select("doc_id", "first"), "repeated-ids")


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to, itself included) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = written(_sets(docs, n), "sets")
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("a").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")).select("a", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "n", "sketch"), "classes")
    common = _common(docs, sets, n)
    rows = _signatures(docs.where("doc_id IS NOT NULL"), n, percent, common).repartition(parts, "sig").sortWithinPartitions("sig", "a")
    buckets = written(_shared(rows).select("sig", "a"), "buckets")
    # the class in most buckets is the likely middle of a group of near copies: it is the pivot of each bucket it is in. Each
    # class is compared with the pivots it shares most signatures with that it isn't yet connected to, some rounds over
    degrees = written(buckets.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "degrees")
    texts = _texts(docs, classes, degrees.select("a"))
    ranked = written(buckets.join(degrees, "a"), "ranked")
    dropped(buckets, degrees)
    tidy(docs.sparkSession)
    executors_tidy(docs.sparkSession)
    # rows of one doc_id are one document, so their classes are linked
    repeated = _one_document(sets)
    links = written(full.join(small_side(repeated), "doc_id").where("a <> first").select(F.col("a").alias("x"), F.col("first").alias("y")).distinct(), "links")
    known, tried = components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), None
    dropped(links)
    for _ in range(ROUNDS):
        placed = written(ranked.join(known.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a")), "placed")
        # in a bucket of several components, the middle of the largest of them there
        sizes = placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("k", "a", "root")).alias("p"))
        tops = sizes.groupBy("sig").agg(F.max(F.struct("n", "p")).alias("best"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("sig", F.col("best.p").alias("p"))
        tops = written(tops.select("sig", F.col("p.a").alias("pivot"), F.col("p.root").alias("pivot_root")), "pivots")
        shared = placed.join(tops, "sig").where("root <> pivot_root").groupBy("a", "pivot").agg(F.count(F.lit(1)).alias("k"))
        if tried is not None:
            shared = shared.join(tried.select(F.col("x").alias("a"), F.col("y").alias("pivot")), ["a", "pivot"], "left_anti")
        # a class has as many pivots as signatures at most, and these are fewer than the words of its text
        most = F.slice(F.sort_array(F.collect_list(F.struct("k", "pivot")), asc=False), 1, PIVOTS)
        chosen = shared.groupBy("a").agg(most.alias("most")).select(F.col("a").alias("x"), F.explode("most.pivot").alias("y"))
        last, tried = tried, written(chosen if tried is None else tried.union(chosen), "tried")
        pairs = written(_may_link(tried if last is None else tried.join(last, ["x", "y"], "left_anti"), classes, percent), "pairs")
        dropped(placed, tops, last)
        known = _linked(known, _verified(pairs, texts, n, percent, parts))
        dropped(pairs)
        tidy(docs.sparkSession)
        executors_tidy(docs.sparkSession)
    # classes of one bucket that these links don't connect are compared with each other
    placed = written(ranked.join(known.withColumnRenamed("node", "a"), "a", "left").select("sig", "a", F.coalesce("root", "a").alias("root")), "placed")
    dropped(ranked, tried)
    pairs = written(_open_pairs(placed, classes, percent, parts), "open-pairs")
    known = _linked(known, _verified(pairs, texts, n, percent, parts))
    dropped(placed, pairs, texts)
    # a component's id is the least doc_id of its classes
    least = written(known.join(classes, known["node"] == classes["a"]).select("node", "root", "rep"), "roots")
    named = written(least.join(least.groupBy("root").agg(F.min("rep").alias("least")), "root").select(F.col("node").alias("a"), "least"), "named")
    named, old = written(classes.select("a", "rep").join(named, "a", "left").select("a", F.coalesce("least", "rep").alias("component_id")), "class-components"), named
    dropped(least, known, classes, old)
    tidy(docs.sparkSession)
    executors_tidy(docs.sparkSession)
    own = F.when(F.col("n_shingles") > 0, F.col("a")).otherwise(F.col("first"))  # a row without words has its document's links
    out = sets.where("doc_id IS NOT NULL").join(small_side(repeated), "doc_id", "left").withColumn("a", own).join(named, "a", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(sets.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _linked(known: DataFrame, more: DataFrame) -> DataFrame:
    """The components that known ones make with more links; what they replace is deleted."""
    if more.isEmpty():
        dropped(more)
        return known
    edges = known.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select(F.col("x").alias("u"), F.col("y").alias("v")))
    roots = components(edges)
    dropped(more, known)
    return roots
