"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to); the flow network has patterns
and sources, not documents. A pattern sends capacity (its size, once for each pass up to `repeats`) to the sources it belongs
to, each source takes its quota, and each further pass of a pattern costs more (a convex cost), so the flow repeats as little
and as evenly as it can. Sources that share no pattern are solved apart, by successive shortest paths; a source alone needs none. Then
documents are chosen: a pattern's flow to a source is so many whole passes over its documents and a part of one more, which goes to documents in
a seeded order up to the flow. Places in that order are hashes of doc_id and text, then of the row's number. The cut is found by histograms:
each holds SLOTS slots of the slot where the cut fell before, until that has few rows, so no task sees all documents of a pattern.

Texts are read once for their sizes: a table of patterns, sizes and places is written, and all else works on that. The driver gets one row a
pattern, PATTERNS at most; more is an error, and nothing is left out.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Documents of size 0 are taken as
nothing. Rows repeated with one doc_id count and are chosen each; of equal rows (doc_id and text) as many are taken as the cut asks for. An empty
table gives no row. Other columns are kept by mixed(), but for the names it adds.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, small_side, written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Bits of a slot number in a histogram of places, and of each of a place's two numbers.
SLOT_BITS, PLACE_BITS = 12, 60
#: Rows of a slot that one task orders; patterns that the driver solves for, at most.
FEW, PATTERNS = 100_000, 1_000_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null has none."""
    text = F.coalesce(text, F.lit(""))
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """share of all sizes dealt by weight; a source stops at `repeats` times its size and the rest is dealt again."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    active = [i for i in range(len(sizes)) if sizes[i] > 0]
    while active and left > 0:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] >= repeats * sizes[i]]
        if not full:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(full)]
    return out


def _flow_of_group(capacity: dict[tuple[int, ...], int], quota: Sequence[float], repeats: int = REPEATS) -> dict[tuple[tuple[int, ...], int], float]:
    """min_cost_flow by successive shortest paths, for sources numbered from 0 on."""
    patterns = sorted(p for p in capacity if p and capacity[p] > 0)
    n = 2 + len(patterns) + len(quota)
    head: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, c: float, w: int) -> None:
        for x, y, r, z in ((a, b, c, w), (b, a, 0.0, -w)):
            head[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)

    for i, p in enumerate(patterns):
        for k in range(repeats):
            arc(0, 2 + i, float(capacity[p]), 2 * k + 1)
        for s in p:
            arc(2 + i, 2 + len(patterns) + s, float("inf"), 0)
    for s, q in enumerate(quota):
        arc(2 + len(patterns) + s, 1, float(q), 0)
    rest = [0.0] * n  # potentials
    while True:
        far, by = [float("inf")] * n, [-1] * n
        far[0] = 0.0
        queue = [(0.0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in head[x]:
                if room[e] > 1e-9:
                    z = d + cost[e] + rest[x] - rest[to[e]]
                    if z < far[to[e]] - 1e-12:
                        far[to[e]], by[to[e]] = z, e
                        heapq.heappush(queue, (z, to[e]))
        if far[1] == float("inf"):
            break
        rest = [r + (f if f < float("inf") else 0) for r, f in zip(rest, far, strict=True)]
        path, x = [], 1
        while x:
            path.append(by[x])
            x = to[by[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    out = {}
    for i, p in enumerate(patterns):
        for e in head[2 + i]:
            s = to[e] - 2 - len(patterns)
            if s >= 0 and room[e ^ 1] > 1e-9:
                out[p, s] = room[e ^ 1]
    return out


def min_cost_flow(capacity: dict[tuple[int, ...], int], quota: Sequence[float], repeats: int = REPEATS) -> dict[tuple[tuple[int, ...], int], float]:
    """Flow from each pattern (sources it belongs to) to each source. The n-th pass over a pattern costs 2n - 1 a word; a
    quota that can't be met is met as far as it can."""
    root = list(range(len(quota)))

    def find(s: int) -> int:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for p in capacity:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    groups: dict[int, list[tuple[int, ...]]] = {}
    for p in sorted(p for p in capacity if p and capacity[p] > 0):
        groups.setdefault(find(p[0]), []).append(p)
    out = {}
    for patterns in groups.values():
        if len(patterns) == 1 and len(patterns[0]) == 1:
            p, s = patterns[0], patterns[0][0]
            if quota[s] > 0:
                out[p, s] = float(min(quota[s], repeats * capacity[p]))
            continue
        own = sorted({s for p in patterns for s in p})
        number = {s: i for i, s in enumerate(own)}
        found = _flow_of_group({tuple(number[s] for s in p): capacity[p] for p in patterns}, [quota[s] for s in own], repeats)
        out |= {(tuple(own[i] for i in p), own[s]): f for (p, s), f in found.items()}
    return out


def _digit(level: int) -> Column:
    """The slot of a place in the histogram of a level: twelve bits of the first number, then of the second."""
    each = PLACE_BITS // SLOT_BITS
    name, k = ("__place", level) if level < each else ("__place2", level - each)
    return F.shiftright(F.col(name), PLACE_BITS - SLOT_BITS * (k + 1)).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")


def cuts(sized: DataFrame, plan: DataFrame, few: int = FEW) -> DataFrame:
    """__cut, __last and __last2 of each pattern that is taken in part: its places up to these are. sized: __pattern, __size, __place, __place2.

    plan: __pattern, __part (words to take of one pass)."""
    each, levels = PLACE_BITS // SLOT_BITS, 2 * (PLACE_BITS // SLOT_BITS)
    inside = sized.where("__size > 0").join(small_side(plan.where("__part > 0").select("__pattern", F.col("__part").alias("__left")), 32), "__pattern")
    slots, hist = [], None
    for level in range(levels):
        slots.append(f"__s{level}")
        inside = inside.withColumn(slots[-1], _digit(level))
        hist = inside.groupBy("__pattern", "__left", *slots).agg(F.sum("__size").alias("__n"), F.count(F.lit(1)).alias("__rows"))
        ahead = F.sum("__n").over(Window.partitionBy("__pattern").orderBy(slots[-1])) - F.col("__n")
        # at most one slot of each pattern holds the cut: those before it are taken whole
        found = hist.withColumn("__before", ahead).where("__before < __left AND __before + __n >= __left")
        cut = written(found.select("__pattern", *slots, (F.col("__left") - F.col("__before")).alias("__left"), "__rows"), "cut-slots")
        inside = inside.drop("__left", *slots[:-1]).join(small_side(cut.select("__pattern", slots[-1], *[F.col(s) for s in slots[:-1]], "__left"), 128), ["__pattern", slots[-1]])
        if (cut.agg(F.max("__rows")).first()[0] or 0) <= few:
            break
    grouped = inside.groupBy("__pattern", "__place", "__place2").agg(F.sum("__size").alias("__n"), F.first("__left").alias("__left"))
    upto = F.sum("__n").over(Window.partitionBy("__pattern").orderBy("__place", "__place2"))
    # up to the document that comes nearest
    near = grouped.withColumn("__upto", upto).where(F.col("__upto") - F.col("__n") / 2 <= F.col("__left"))
    last = near.groupBy("__pattern").agg(F.max(F.struct("__place", "__place2")).alias("__at"))
    # where none of the slot is taken, all before it are
    begin = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for level, slot in enumerate(slots):
        begin[level // each] = begin[level // each] + F.col(slot).cast("long") * F.lit(1 << (PLACE_BITS - SLOT_BITS * (level % each + 1)))
    found = cut.select("__pattern", begin[0].alias("__b"), begin[1].alias("__b2")).join(last, "__pattern", "left")
    return written(found.select("__pattern", F.lit(True).alias("__cut"), F.coalesce("__at.__place", "__b").alias("__last"), F.coalesce(F.col("__at.__place2"), F.col("__b2") - 1).alias("__last2")), "cuts")


def passes(docs: DataFrame, sized: DataFrame, wanted: Sequence[tuple[int, float, int]], repeats: int, few: int = FEW) -> DataFrame:
    """docs (__pattern int, __some boolean: whether it has words, __place and __place2 long) plus __times: how often each is taken.

    sized: these columns and __size of docs, written. wanted: (pattern, words to take, words there are)."""
    spark = docs.sparkSession
    whole = lambda flow, size: min(repeats, floor(flow / size + 1e-12)) if size else 0
    rows = [(p, whole(flow, size), max(0.0, flow - whole(flow, size) * size) if size else 0.0) for p, flow, size in wanted]
    plan = written(few_rows(spark, rows, "__pattern int, __whole int, __part double"), "plan")
    bounds = written(plan.join(cuts(sized, plan, few), "__pattern", "left"), "bounds")
    out = docs.join(small_side(bounds, 48), "__pattern", "left")
    upto = (F.col("__place") < F.col("__last")) | ((F.col("__place") == F.col("__last")) & (F.col("__place2") <= F.col("__last2")))
    more = F.when(F.col("__part") <= 0, False).when(F.col("__cut").isNull(), True).otherwise(upto)
    times = F.coalesce("__whole", F.lit(0)) + F.coalesce(more, F.lit(False)).cast("int")
    return out.withColumn("__times", F.when(F.col("__some"), F.least(times, F.lit(repeats))).otherwise(0)).drop(*[c for c in bounds.columns if c != "__pattern"])


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17, sources: Column | None = None, keep: Sequence[str] | None = None, few: int = FEW) -> DataFrame:
    """docs plus size, source_size, target, taken (words, repeats counted) and times.

    sources: array<string> of a document's sources (its column source alone by default). source_size and target are sums
    over a document's sources. keep: the columns of docs to keep (all by default); those named are written with the sizes, and docs isn't read again.
    """
    names = F.array(F.col("source").cast("string")) if sources is None else F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources)))
    low = F.lit((1 << PLACE_BITS) - 1)
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text")).bitwiseAND(low)
    place2 = F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).bitwiseAND(low)
    kept = docs.drop("size", "source_size", "target", "taken", "times")
    kept = kept.select(*[F.col(f"`{c}`") for c in (kept.columns if keep is None else keep)]) if keep is not None else kept
    own = {"__names": names, "__place": place, "__place2": place2}
    narrow = docs.withColumns(own | {"__size": word_count(F.col("text"))}).select(*([F.col(f"`{c}`") for c in keep] if keep is not None else []), *own, "__size")
    narrow = written(narrow.withColumn("__some", F.col("__size") > 0), "sizes")
    found = narrow.groupBy("__names").agg(F.sum("__size").alias("n")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    patterns = {tuple(r["__names"]): r["n"] for r in found if r["__names"] is not None}
    every = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(every)}
    numbered = {p: tuple(sorted(number[s] for s in p)) for p in patterns}
    order = sorted(patterns, key=numbered.get)
    sizes = [0] * len(every)
    for p in order:
        for s in numbered[p]:
            sizes[s] += patterns[p]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(every))], share, repeats)
    total: dict[tuple[int, ...], float] = {}
    for (p, _), f in min_cost_flow({numbered[p]: patterns[p] for p in order}, goal, repeats).items():
        total[p] = total.get(p, 0.0) + f
    spark = docs.sparkSession
    rows = [(list(p), i, sum(sizes[s] for s in numbered[p]), float(sum(goal[s] for s in numbered[p]))) for i, p in enumerate(order)]
    table = written(few_rows(spark, rows, "__of array<string>, __pattern int, __source_size long, __target double"), "patterns")
    width = 64 + max((sum(len(s or "") for s in p) for p in order), default=0)
    patterned = lambda rows: rows.join(small_side(table, width), F.col("__names").eqNullSafe(F.col("__of")), "left").drop("__names", "__of")
    if keep is None:
        # sizes are counted again only where they are asked for
        base = kept.withColumns(own | {"__size": word_count(F.col("text")), "__some": F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    else:
        base = narrow
    chosen = passes(patterned(base), patterned(narrow.select("__names", "__place", "__place2", "__size")), [(i, total.get(numbered[p], 0.0), patterns[p]) for i, p in enumerate(order)], repeats, few)
    out = chosen.withColumns({"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": (F.col("__size") * F.col("__times")).cast("long"), "times": F.col("__times")})
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], "size", "source_size", "target", "taken", "times")
