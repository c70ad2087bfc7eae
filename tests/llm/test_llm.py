"""The ten operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import textwrap
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, graph, language_id, license_scan, lm_scoring, mixing, ngram_join, substring_dedup, textvec, token_records, toxicity
from eventloom.llm.common import texts_of
from eventloom.llm.decontaminate import budget, decontaminate, myers
from eventloom.llm.exact_dedup import exact_dedup
from eventloom.llm.graph import components
from eventloom.llm.queries import tokenizer_path
from eventloom.llm.sampling import crc_part

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, row string, h string, item_ids string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "."]) for _ in range(n))


def rows():
    """Near copies, exact copies, shared passages, and every odd row there is."""
    rng = random.Random(4)
    base, passage = text(rng, 150), text(rng, 70)
    out = [(i, text(rng, rng.randrange(20, 200)), "en") for i in range(30)]
    for i in range(30, 45):
        words = base.split()
        for _ in range(i - 30):
            words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en"))
    out += [(i, text(rng, 40) + " " + passage + " " + text(rng, 30), "en") for i in range(45, 55)]
    out += [(i, base.upper() if i % 2 else base, "en") for i in range(55, 60)]
    out += [(60, None, "en"), (61, "", None), (62, "  \n\t ", "en"), (63, "é", "fr"), (64, "Élan ÉTÉ", "fr"), (65, "élan ÉTÉ", None), (66, "12 $$ ...", None), (67, text(rng, 20_000), "en"), (68, "one two", "en"), (69, "one two three", "en"), (70, "One TWO", "en")]
    out += [(30, base, "en"), (None, base, "en"), (None, None, None), (5, out[5][1], "en")]
    return [(i, t, lang, None if i is None or i % 7 == 0 else f"s{i % 3}", None, "x", "y", "z", None, "k") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def words_of(t):
    return (t or "").encode().split()


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


# --- shared parts


def test_words_and_grams():
    texts = ["", "a b", None, " \n", "a b c d", "é ü  x", "a b c d e"]
    w = textvec.Words(*texts_of(pa.array(texts)))
    assert [[w.word(k) for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))] == [words_of(t) for t in texts]
    h = w.hashes()
    g, ok = w.grams(h, 4), w.whole(4)
    assert g[w.first[4]] == g[w.first[6]] and ok[w.first[4]] and not ok[w.first[4] + 1]
    assert len(set(h.tolist())) == len({x for t in texts for x in words_of(t)})


def test_window_least():
    v = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for width in (1, 2, 3, 7):
        assert substring_dedup.window_least(v, width).tolist() == [min(v[i : i + width]) for i in range(len(v) - width + 1)]
    assert len(substring_dedup.window_least(v, 8)) == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (20, 5), (30, 9), *((100 + i, 101 + i) for i in range(20))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 20: 2, 8: 8, 9: 8, 30: 8, **{100 + i: 100 for i in range(21)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_write_few_files(spark, monkeypatch):
    """Each file starts processes in the JVM that writes it, so small tables are one file each, and stars take no round of their own."""
    made = []

    def kept(df, name, *a, **b):
        out = common.written(df, name, *a, **b)
        made.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(graph, "written", kept)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
        assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(i, 0) for i in range(301)}
        assert max(files for _, files in made) == 1
        made.clear()
        stars = spark.createDataFrame([(i % 3, i) for i in range(3, 300)], "u long, v long")
        assert {(r["node"], r["root"]) for r in components(stars).collect()} == {(i, i % 3) for i in range(300)}
        assert [name for name, _ in made] == ["edges", "components"]
        monkeypatch.setattr(common, "FILE_ROWS", 100)
        made.clear()
        assert components(chain).where("root = 0").count() == 301
        assert max(files for _, files in made) == 6  # of 600 rows at most
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_mixing_starts_no_workers(spark, docs, monkeypatch):
    """The driver's tables of the mix go by Arrow; a list would start Python workers in each executor, which stay."""
    kinds, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: kinds.append(type(data)) or make(self, data, *a, **b))
    assert mixing.mixed(docs).count() == docs.count()
    assert kinds and set(kinds) == {pa.Table}
    rows = [(["a", None], 1, 2, 0.5), ([], 2, 3, 1.0)]
    assert [tuple(r) for r in common.few_rows(spark, rows, "a array<string>, b int, c long, d double").orderBy("b").collect()] == rows
    assert common.few_rows(spark, [], "a int").collect() == []


def test_executors_give_heap_back(spark):
    assert common.executors_tidy(spark) is None  # a local run has no executors
    assert len(spark.range(0, 2, 1, 2).selectExpr("java_method('java.lang.System', 'gc')").collect()) == 2


# --- 1 licences


def test_driver_lets_go_each_round(spark, monkeypatch):
    """Each round of stars gives the driver's memory back, Arrow's with it."""
    pool, calls = pa.default_memory_pool(), []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: calls.append(1) or pool)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(7)}
    assert len(calls) >= 2


def test_license_scan(spark):
    data = [(1, "Some words here.\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "nothing at all"), (4, None), (5, ""), (6, "RELEASED under the mit LICENSE"), (None, "Licensed under CC BY-NC 4.0."), (1, "Some words here.\nReleased under the MIT License.\nmore")]
    got = license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string").withColumn("license", F.lit("clash"))).collect()
    by = {r["doc_id"]: (r["license"], r["dice"], r["n_units"]) for r in got}
    assert len(got) == len(data)
    assert by == {1: ("MIT", 1.0, 1), 2: ("Apache-2.0", 1.0, 1), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, 0), 6: ("MIT", 1.0, 1), None: ("CC-BY-NC-4.0", 1.0, 1)}


def test_license_passages(spark):
    """Notices wrapped over lines, or sharing a line, are found; their Dice is that of the best run of words."""
    rng = random.Random(1)
    data, want = [], {}
    for t, (name, notice) in enumerate(license_scan.TEMPLATES):
        wrapped = "\n".join(textwrap.wrap(notice, 30))
        data.append((t, "\n".join([text(rng, 9) for _ in range(40)] + [wrapped] + [text(rng, 9) for _ in range(40)])))
        want[t] = name
    data.append((100, "Some prose of a page and then a notice. Released under the MIT License. And then some more of the prose."))
    data.append((101, "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit the page."))
    data.append((102, "a page. Released under the MIT License. and\nb c d e f g. Licensed under CC BY-NC 4.0. h\nRedistribution of the work under it"))
    data.append((103, "one two Released under\nthe very MIT License three four"))
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(data)
    assert {i: (got[i]["license"], got[i]["dice"]) for i in want} == {i: (name, 1.0) for i, name in want.items()}
    assert all(got[i]["n_units"] >= 1 for i in want)
    assert [(got[i]["license"], got[i]["dice"], got[i]["n_units"]) for i in (100, 101)] == [("MIT", 1.0, 1), ("CC-BY-4.0", 1.0, 1)]
    assert (got[102]["licenses"], got[102]["n_units"]) == ("CC-BY-NC-4.0,MIT", 2)
    assert got[103]["license"] is None  # three of four bigrams in a run of five: 2 * 3 / 9


def test_license_dice_by_definition(docs, none):
    assert license_scan.license_scan(none).count() == 0
    assert {r["n_units"] for r in license_scan.license_scan(docs).collect()} == {0}


# --- 2 language


def test_language(spark, none):
    rng = random.Random(1)
    kinds = {"aa": "ba be bi bo".split(), "bb": "ku kö kü ky".split()}
    data = [(i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randrange(5, 60))), lang) for i in range(300) for lang in [rng.choice(list(kinds))]]
    data += [(None, "ba", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "123 --", None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = crc_part(F.col("doc_id"), 3) == 1
    model = language_id.fit(frame.where(~held))
    got = language_id.with_language(frame, model).collect()
    assert len(got) == len(data)
    test = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.98 * len(test)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got if r["doc_id"] in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in test) <= 1
    nothing = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.with_language(frame, nothing).collect()} == {"und"}
    assert language_id.with_language(none, model).count() == 0


# --- 3 token records


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def test_token_records_round_trip(spark, docs, none, tmp_path):
    path = str(tmp_path / "records")
    index = token_records.write_records(docs, path, tokenizer_path(), 2)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_records.with_starts(index).collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    want = sorted(docs.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    start, expected = 0, []
    for r, ids in zip(want, plain_ids([r["text"] for r in want]), strict=True):
        expected.append((r[0] is not None, r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    shuffled = token_records.read_shuffled(spark, path, 3).collect()
    assert Counter((r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in shuffled) == Counter((e[1], e[4]) for e in expected)
    empty = token_records.write_records(none, str(tmp_path / "none"), tokenizer_path(), 2)
    assert token_records.with_starts(empty).count() == 0


@pytest.mark.parametrize("odd", ["", " ", "a", " a", "a ", "a  b", "a\n\n b", "x.\nY z", "it's 'll we'll", "é è ñ", "<|endoftext|> a", "a b 　c", "x\0y a", "1 22 a1b2!", "a.\n\nb", "a\n\n\nb", "\n\nb", "\nb", "a \n b", "a\n b", "a,\nb. c", "a\u00a0.b", "日本.\n語", "é,b", " \n", "a\r\nb", "a\n\u3000b"])
def test_encoder_is_the_tokenizer(odd):
    encoder = token_records.encoder_of(tokenizer_path(), 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(pa.array(["x\n", odd, "\ny", None]))] == [x.tolist() for x in plain_ids(["x\n", odd, "\ny", None])]


def test_special_tokens_and_wrong_pieces():
    texts = ["<|endoftext|> a </s>", "x <|endoftext|><|endoftext|>", "<|endoftext", "|> é"]
    encoder = token_records.Encoder(tokenizer_path(), 2)
    ids = lambda found: [np.frombuffer(x, "<u2").tolist() for x in found]
    assert ids(encoder.encode(pa.array(texts))) == [x.tolist() for x in plain_ids(texts)]
    assert ids(encoder.encode(pa.array(texts)))[0][0] == 50256
    assert 50256 not in ids(token_records.Encoder(tokenizer_path(), 2, special_as_text=True).encode(pa.array(texts)))[0]
    # a piece that a clash of hashes would give wrong ids shows by its bytes
    plain = ["one two three", "four five"]
    want = ids(encoder.encode(pa.array(plain)))
    encoder.store[encoder.at[0]] ^= 1
    encoder.store[encoder.at[-1]] ^= 1
    assert ids(encoder.encode(pa.array([*plain, *texts]))) == [*want, *[x.tolist() for x in plain_ids(texts)]]


def test_files_in_the_order_of_their_numbers(spark):
    names = [f"part-{i:05d}-9b2e-4c00-c000.txt" for i in (0, 9, 99_999, 100_000, 100_001, 1_000_000)] + [f"part-1000001-9b2e-c{k:03d}.snappy.txt" for k in (0, 999, 1000)]
    index = spark.createDataFrame([(f, 10, b) for f in names[::-1] for b in (0, 10)], "file string, n_tokens long, before long")
    got = {(r["file"], r["before"]): r["start"] for r in token_records.with_starts(index).collect()}
    assert got == {(f, b): 20 * k + b for k, f in enumerate(names) for b in (0, 10)}


def test_equal_rows_fill_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(7 if i % 3 else None, "same words " * 20) for i in range(3000)], "doc_id long, text string").repartition(4)
    index = token_records.with_starts(token_records.write_records(docs, str(tmp_path / "r"), tokenizer_path(), 2, file_bytes=100_000))
    rows = sorted(index.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 1000 + [7] * 2000
    assert [r["start"] for r in rows] == [i * rows[0]["n_tokens"] for i in range(3000)]
    assert max(Counter(r["file"] for r in rows).values()) < 1500


def test_frames_find_damage():
    data = b"".join(token_records.frame(*f) + b"\n" for f in ((7, b"\1\0\2\0", True), (None, b"", False)))
    assert [(o, d, ids.tolist()) for o, _, d, ids in token_records.frames(data)] == [(0, 7, [1, 2]), (30, None, [])]
    for spot in (0, 9, 22, len(data) - 2):
        with pytest.raises(ValueError):
            list(token_records.frames(data[:spot] + bytes([data[spot] ^ 1]) + data[spot + 1 :]))


# --- 4 toxicity


def test_toxicity(spark, none):
    rng = random.Random(2)
    data, labels = [], []
    for i in range(600):
        words = text(rng, rng.randrange(10, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["moron", "Scum", "m0ron", "garblewort"])
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 50 else 1))
    data += [(700, None), (701, ""), (None, "you moron")]
    labels += [(700, None), (None, 1), (9999, 1)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(frame, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(data)
    wrong = [i for i in range(600) if (got[i] >= 0.3) != (i % 4 == 0)]
    assert len(wrong) <= 6
    assert got[None] >= 0.3 and got[700] == got[701] < 0.3
    assert toxicity.with_toxicity(none, model).count() == 0
    flat = toxicity.fit(frame, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.with_toxicity(frame, flat).collect()} == {1.0}


# --- 5 mixing


def test_targets():
    assert mixing.targets([100, 100], [5, 2], 1.5) == [200.0, 100.0]
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 1.5)[0] == 20.0
    assert sum(mixing.targets([10, 1000, 1000], [5, 2, 1], 1.5)) == pytest.approx(1.5 * 2010)
    assert mixing.targets([], [], 1.5) == [] and mixing.targets([0, 0], [1, 1], 1.5) == [0.0, 0.0]


def test_flow_on_overlap():
    flow = mixing.min_cost_flow({(0,): 100, (1,): 100, (0, 1): 100}, [150, 250])
    assert sum(f for (p, s), f in flow.items() if s == 0) == pytest.approx(150)
    assert sum(f for (p, s), f in flow.items() if s == 1) == pytest.approx(250)
    passes = {p: sum(f for (q, _), f in flow.items() if q == p) / 100 for p in ((0,), (1,), (0, 1))}
    assert max(passes.values()) <= 2
    # convex costs: no pattern is read twice while another that could serve is read less than once
    cost = sum(min(x, 1) * 100 + 3 * max(0, x - 1) * 100 for x in passes.values())
    assert cost == pytest.approx(300 + 3 * 100)


def poured(sizes, weights, share, most):
    """Targets by pouring: the level at which min(level * weight, most * size) sums up to the share, by bisection over fractions."""
    goal = Fraction(share) * sum(sizes)
    low, high = Fraction(0), Fraction(most * max(sizes, default=0) + 1)
    if sum(most * n for n in sizes) <= goal:
        return [float(most * n) for n in sizes]
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * w, most * n) for n, w in zip(sizes, weights, strict=True)) < goal:
            low = level
        else:
            high = level
    return [float(min(high * w, most * n)) for n, w in zip(sizes, weights, strict=True)]


def test_targets_by_pouring():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 10, 500, 9000]) for _ in range(rng.randrange(1, 8))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(poured(sizes, weights, 1.5, 2))


@pytest.mark.parametrize("few", [1, 20, 10**6])
def test_mixing_repeated_rows(spark, few):
    """Rows of one doc_id, and equal rows, are taken each, up to the target; every depth of histogram gives the same."""
    data = [(i, "w " * (1 + i % 9), "a") for i in range(400)] + [(5, "same " * 7, "b")] * 300 + [(6, "v " * (1 + i), "c") for i in range(50)] + [(None, "u u", None)] * 40
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3).withColumns({c: F.lit("clash") for c in ("left", "last", "n", "before", "__left", "k")})
    got = mixing.mixed(frame, few=few).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    order = ["a", "b", "c", None]
    sizes = [sum(len(words_of(t)) for _, t, s in data if s == x) for x in order]
    for x, n, g in zip(order, sizes, poured(sizes, [5, 2, 1, 5], 1.5, 2), strict=True):
        assert {(r["source_size"], round(r["target"], 6)) for r in by[x]} == {(n, round(g, 6))}
        assert abs(sum(r["taken"] for r in by[x]) - g) <= max(r["size"] for r in by[x])
    assert {r["left"] for r in got} == {"clash"}
    narrow = mixing.mixed(frame, few=few, keep=["doc_id", "last"]).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in narrow) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_flow_of_many_sources():
    capacity = {(i,): 10 for i in range(20_000)}
    flow = mixing.min_cost_flow(capacity, [15.0] * 20_000)
    assert len(flow) == 20_000 and set(flow.values()) == {15.0}


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    again = {(r["doc_id"], r["text"], r["taken"]) for r in mixing.mixed(docs.repartition(2)).collect()}
    assert {(r["doc_id"], r["text"], r["taken"]) for r in got} == again
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words_of(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    goal = poured(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    for s, n, g in zip(order, sizes, goal, strict=True):
        assert {r["source_size"] for r in by[s]} == {n} and [r["target"] for r in by[s]] == pytest.approx([g] * len(by[s]))
        largest = max(r["size"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - g) <= largest
    assert mixing.mixed(none).count() == 0


def test_mixing_overlapping_sources(spark):
    data = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(300)]
    got = mixing.mixed(spark.createDataFrame(data, "doc_id long, text string, of array<string>"), weights=(1,), share=1.0, sources=F.col("of")).collect()
    assert {r["source_size"] for r in got if r["of"] == ["a"]} == {2000}
    assert sum(r["taken"] for r in got) == 3000 + 1000 or sum(r["taken"] for r in got) <= 6000


# --- 6 n-gram join


def brute_components(data, n, percent):
    sets = defaultdict(list)
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in root:
        for j in root:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(docs, n, percent):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ngram_join.similar_components(docs, n, percent).collect()
    assert len(got) == len(data)
    want = brute_components(data, n, percent)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}


def test_ngram_join_repeated_ids(spark):
    """Rows of one doc_id with different texts are one document: its links are those of all its rows."""
    rng = random.Random(12)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    data = [(3, a), (5, a), (5, b), (7, b), (5, ""), (8, ""), (9, c), (11, c + " more"), (11, b + " more"), (20, None), (20, None), (None, a)]
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()]
    want = brute_components(data, 5, 80)
    assert want == {3: 3, 5: 3, 7: 3, 8: 8, 9: 3, 11: 3, 20: 20}
    assert Counter(got) == Counter((i, want.get(i)) for i, _ in data)


def test_ngram_join_blocks(spark, monkeypatch):
    """Hot buckets in blocks, and pivots of many partners in shares, give the same."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 3)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    rng = random.Random(5)
    core = text(rng, 120).split()
    data = []
    for i in range(60):
        w = list(core)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for rounds in (0, 2):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(frame, 3, 80).collect()}
        assert got == brute_components(data, 3, 80)


def test_ngram_join_empty(none):
    assert ngram_join.similar_components(none).count() == 0


def test_signatures_lose_no_pair():
    rng = np.random.Generator(np.random.PCG64(3))
    for trial in range(300):
        percent, n = int(rng.integers(50, 96)), int(rng.integers(2, 400 if trial % 10 else 9000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        common = np.sort(rng.choice(a, len(a) // 2, replace=False)) if trial % 2 else None
        limit = len(a) * (100 - percent) // 100
        drop = int(rng.integers(0, limit + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, limit - drop + 1)))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        owner, sig = ngram_join.signatures([a, b], percent, common)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
        x, y = ngram_join.folded([ngram_join.sketch(s) for s in (a, b)])
        assert ngram_join.may_link(x[None], y[None], np.array([len(a)]), np.array([len(b)]), percent)[0]


# --- 7 substrings


def brute_substrings(rows, span):
    """By definition, for rows (doc_id, text): as many (doc_id, n_words, n_removed, kept_sha256)."""
    rows = [(i, words_of(t)) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in rows:
        if i is not None:
            for s in range(len(w) - span + 1):
                key = tuple(w[s : s + span])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, w in rows:
        gone = set()
        for s in range(len(w) - span + 1 if i is not None else 0):
            if first[tuple(w[s : s + span])] < i:
                gone.update(range(s, s + span))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def digests(frame):
    return Counter(tuple(r) for r in substring_dedup.digest(substring_dedup.without_repeats(frame)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_substring_dedup(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = digests(docs)
    assert got == brute_substrings(rows, 50)
    assert sum(k[2] > 0 for k in got) > 10
    assert substring_dedup.without_repeats(none).count() == 0


def test_substring_dedup_repeated_ids(spark):
    """Several texts under one doc_id: each row loses its own words alone, and none is a source for another of its doc_id."""
    rng = random.Random(11)
    p, q = text(rng, 60), text(rng, 55)
    rows = [(1, p + " x"), (5, text(rng, 9) + " " + p + " a"), (5, text(rng, 80)), (5, q), (5, q + " again"), (7, q), (7, q), (8, "no " * 49), (None, p), (9, None), (9, p + " " + p)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_substrings(rows, 50)


# --- 8 language model


def test_lm_scores(docs, none):
    train = docs.withColumn("train", crc_part(F.col("doc_id"), 10) != 0)
    got = lm_scoring.score(train).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in docs.collect()]
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n = sum(c.values())
    z = n + 0.1 * (len(c) + 1)
    want = Counter((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(log10((c[x] + 0.1) / z) for x in w), 6)) for i, w in tokens)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    long = next(r for r in got if r["doc_id"] == 67)
    assert long["score"] > long["base_score"] * 1.3
    assert lm_scoring.score(none.withColumn("train", F.lit(True))).count() == 0


def test_lm_is_a_distribution():
    """Each decision's two probabilities add to one, so that those of all bytes after a beginning do."""
    rng = np.random.Generator(np.random.PCG64(5))
    model = lm_scoring.Model([rng.normal(0, 2, 1 << b).astype(np.float32) for b in lm_scoring.BITS], rng.normal(0.3, 0.3, (lm_scoring.GATES, lm_scoring.TREES + len(lm_scoring.BITS))), np.sort(rng.random((lm_scoring.GATES, lm_scoring.STEPS)), 1))
    for beginning in (b"", b"ab", b"\xc3"):
        words = [beginning + bytes([b]) for b in range(256) if bytes([b]) not in (b" ", b"\n")] + [beginning or lm_scoring.END]
        n = np.ones(len(words), np.int64)
        row = {"words": b"".join(words), "sizes": np.array([len(w) for w in words], np.int32).tobytes(), "cues": (n * 3).astype(np.uint8).tobytes(), **{k: n.tobytes() for k in ("n_train", "n_all", "c")}}
        chunk = lm_scoring.Chunk(row)
        _, gate, z = model.mix(chunk.decisions, chunk.tree(out=False))
        p = model.probabilities(gate, z).astype(np.float64)
        assert ((0 < p) & (p < 1)).all()
        each = np.log10(np.where(chunk.decisions.bit == 1, p, 1 - p)).reshape(-1, 8).sum(1)
        ends = np.cumsum(np.bincount(chunk.decisions.row)) - 1  # closing spaces; the byte before each is the one that differs
        spot = np.where(np.array(words) == lm_scoring.END, ends, ends - 1)
        spot[-1] = ends[-1]
        logs = each[chunk.decisions.of[spot]]
        assert (10.0**logs).sum() <= 1 + 1e-4 and (beginning or (10.0**logs).sum() == pytest.approx(1 - 10.0 ** _byte_log(model, b" ", row), abs=1e-3))


def _byte_log(model, byte, row):
    """log10 probability of a closing space where the first byte of a word stands, by the same contexts."""
    words = [bytes([b]) for b in range(256) if bytes([b]) not in (b" ", b"\n")] + [lm_scoring.END]
    chunk = lm_scoring.Chunk(row)
    d = chunk.decisions
    _, gate, z = model.mix(d, chunk.tree(out=False))
    p = model.probabilities(gate, z).astype(np.float64)
    first = d.of[np.concatenate([[0], np.cumsum(np.bincount(d.row))[:-1]])]
    # the decisions of a space share their beginnings with those of bytes 0x20 to 0x2F; the last three differ from "!" in one bit
    bang = first[words.index(b"!")]
    node = p[bang * 8 : bang * 8 + 8]
    bits = [int(x) for x in f"{ord('!'):08b}"]
    logs = [np.log10(q if b else 1 - q) for q, b in zip(node[:7], bits[:7], strict=True)]
    return sum(logs) + np.log10(1 - node[7])


def brute_decisions(word, context):
    """(bit, contexts of the four predictors, place) of each decision of a word, by definition."""
    spelled = word if word == b"\n" or len(word) >= lm_scoring.LONG else word + b" "
    script = context % lm_scoring.CUES
    for i, byte in enumerate(spelled[: lm_scoring.LONG]):
        so_far = spelled[:i]
        for k in range(8):
            node = byte >> (8 - k), k
            yield byte >> (7 - k) & 1, [(0, context, so_far, node), (1, script, so_far, node), (2, script, so_far[-3:], node), (3, script, so_far[-2:], node)], i


def brute_tokens(t):
    """Tokens of a text with the context before each, and the repeat decision as (run, made, true) or None, token by token."""
    data = low(t).encode()
    words, at = [], 0
    for w in data.split():
        at = data.index(w, at)
        words.append((w, at))
        at += len(w)
    words.append((b"\n", len(data)))
    out, followed, run, made, before = [], {}, 0, 0, []
    for w, at in words:
        leads = [i for i in range(at) if data[i] >= 0xC0]
        cue = 1 + (data[leads[-1]] * 256 + data[leads[-1] + 1]) * 40503 % 65521 % (lm_scoring.CUES - 1) if leads else 0
        if before and len(before[-1]) <= lm_scoring.SHORT:
            h = textvec.Words(*texts_of(pa.array([before[-1].decode()]))).hashes()[0]
            cue += lm_scoring.CUES * (1 + int(h >> np.uint64(40)) % (lm_scoring.CLASSES - 1))
        decision, key = None, tuple(before[-2:])
        if len(key) == 2:
            if key in followed:
                true = followed[key] == w
                decision = min(run, lm_scoring.ROWS - 1), min(int(np.log2(made + 1)), lm_scoring.MADE - 1), true
                run, made = (run + 1 if true else 0), made + 1
            followed[key] = w
        before.append(w)
        out.append((w, cue, decision))
    return out


def test_lm_score_by_definition(spark, monkeypatch):
    """The score is that of plain loops over tokens, bytes and bits, with the weights and the refinement that were learned."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 9)
    kept = {}
    fit = lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda chunks: kept.setdefault("fit", fit(chunks)))
    rng = random.Random(31)
    words = ["the", "of", "Cat", "caté", "dog", "über", "x", "a" * 40, "\u0416\u0436", "123"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(24)] + ["the cat sat " * 9, None, "", "zz " + "q" * 1500, "\tof\nof  of of of of"]
    train = [i % 4 != 0 for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean").repartition(3)
    for head in (lm_scoring.HEAD, 0, 5):
        kept.clear()
        got = {r["doc_id"]: r for r in lm_scoring.score(frame, head=head).collect()}
        model = kept["fit"][0]
        counts, cells = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for t, x in zip(texts, train, strict=True):
            for w, cue, decision in brute_tokens(t) if x else []:
                for bit, contexts, _ in brute_decisions(w, cue):
                    for c in contexts:
                        counts[c][bit] += 1
                if decision:
                    cells[decision[:2]][decision[2]] += 1

        def spelling(w, cue):
            total = max(0, len(w) - lm_scoring.LONG + 1) * log10(1 / 257)
            for bit, contexts, place in brute_decisions(w, cue):
                logits = [min(8, max(-8, np.log((counts[c][1] + 0.05) / (counts[c][0] + 0.05)))) for c in contexts]
                known = min(7, int(np.log2(sum(counts[contexts[0]]) + 1)))
                gate = known * 4 + min(place, 3)
                z = min(8, max(-8, sum(a * b for a, b in zip(model.weights[gate], logits, strict=True))))
                at = (z + 8) * (lm_scoring.STEPS - 1) / 16
                lo = min(int(at), lm_scoring.STEPS - 2)
                refined = model.refined[gate, lo] * (1 - at + lo) + model.refined[gate, lo + 1] * (at - lo)
                p = (1 / (1 + np.exp(-z)) + refined) / 2
                total += log10(p if bit else 1 - p)
            return total

        for i, t in enumerate(texts):
            want = 0.0
            for w, cue, decision in brute_tokens(t):
                if decision:
                    miss, hit = cells[decision[:2]]
                    q = (hit + 0.4) / (hit + miss + 0.8)
                    want += log10(q if decision[2] else 1 - q)
                if not (decision and decision[2]):
                    want += spelling(w, cue)
            assert got[i]["score"] == pytest.approx(want, rel=2e-4, abs=1e-3), i
            assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] / log10(2) / (len((t or "").encode()) + 1))


def test_lm_pieces_are_the_whole_word(monkeypatch):
    """Decisions of a word's pieces, one after the other, are those of the word spelled at once."""
    rng = random.Random(6)
    data = ["".join(rng.choice("abcdé語") for _ in range(n)) for n in (300, 4000, 1)] + ["x" * 1023, "y" * 1024, "z" * 2048, "w" * 2049]
    cues = np.array([0, 19, 3, 1, 40, 127, 5])
    tokens = lm_scoring.Tokens(pa.array([" ".join(data)]))
    token, pieces = tokens.pieces()
    assert Counter(token.tolist()) == {i: len(w.encode()) // 1024 for i, w in enumerate(data) if len(w.encode()) >= 1024}
    words = tokens.spelled(np.arange(len(data)))
    order = np.argsort(np.concatenate([np.arange(len(data)), token]), kind="stable")
    cut = lm_scoring.Decisions(pa.concat_arrays([words, pieces]).take(pa.array(order)), np.concatenate([cues, cues[token]])[order])
    monkeypatch.setattr(lm_scoring, "PIECE", 1 << 20)
    whole = lm_scoring.Decisions(words, cues)
    assert len(whole.of) == sum(len(w.encode()) + 1 for w in data)
    for k in range(4):
        assert (whole.contexts[k][whole.of] == cut.contexts[k][cut.of]).all()
    for name in ("bit", "step"):
        one, other = (getattr(d, name).reshape(-1, 8)[d.of] for d in (whole, cut))
        assert (one == other).all()


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 0])
def test_lm_reads_long_words_to_their_ends(spark, head):
    """A text without spaces counts to its last byte: what was learned there is likelier than what wasn't. Its pieces are no tokens."""
    rng = random.Random(9)
    beginning, known, other = ("".join(rng.choice(x) for _ in range(n)) for x, n in (("abcd", 3000), ("efgh", 900), ("ijkl", 900)))
    data = [(i, beginning + known, True) for i in range(3)] + [(3, "ijkl lkji", True), (4, beginning + known, False), (5, beginning + other, False), (6, beginning + known[:-1] + "z", False)]
    got = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(data, "doc_id long, text string, train boolean").repartition(2), head=head).collect()}
    assert got[4]["score"] > got[6]["score"] > got[5]["score"] + 100
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for i, r in got.items() if i != 3} == {(2, 2, 9), (2, 1, 9)}
    z = 9 + 0.1 * 5
    assert got[4]["base_score"] == pytest.approx(log10(3.1 / z) + log10(4.1 / z))
    assert got[5]["base_score"] == pytest.approx(log10(0.1 / z) + log10(4.1 / z))


def test_lm_order_counts(spark):
    """The same words in another order, or said again, score otherwise."""
    rng = random.Random(2)
    line = text(rng, 30)
    shuffled = line.split()
    rng.shuffle(shuffled)
    data = [(i, "the " + text(rng, 60), True) for i in range(30)] + [(100, line, False), (101, " ".join(shuffled), False), (102, line + " " + line, False)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(data, "doc_id long, text string, train boolean")).collect()}
    assert got[102] > 1.7 * got[100]


def test_lm_counts_every_pair(spark, monkeypatch):
    """Each chunk's counts of the words so far are those over all training tokens, however rare and wherever chunks and tasks end."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 7)
    rng = random.Random(8)
    stems = ["a", "ab", "ab!", "ab\x01", "abc", "éa", "ü", "b"]
    texts = [("é " if i % 3 else "") + " ".join(rng.choice(stems) + rng.choice(["", "x", "xy", str(rng.randrange(60))]) for _ in range(20)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(3)
    vocab, _ = lm_scoring.vocabulary(docs)
    want = [Counter(), Counter()]
    for r in vocab.where("n_train > 0").collect():
        word, n = bytes(r["word"]), r["n_train"]
        spelled = word if word == lm_scoring.END else word + b" "
        for i, byte in enumerate(spelled):
            for bit in range(8):
                for k, cue in enumerate((r["cue"], r["cue"] % lm_scoring.CUES)):
                    want[k][cue, spelled[:i], byte >> (8 - bit), byte >> (7 - bit) & 1, bit] += n
    assert sum(n < 4 for n in want[0].values()) > 100
    chunks = lm_scoring.counted(lm_scoring.chunked(vocab))[1]
    found, pairs = [{}, {}], 0
    for row in lm_scoring.chunks_of(chunks.toArrow().to_batches()):
        chunk = lm_scoring.Chunk(row)
        pairs += len(chunk.words)
        d, words = chunk.decisions, chunk.words.to_pylist()
        at = Counter()
        for row, one in zip(d.row.tolist(), d.of.tolist(), strict=True):
            spelled = words[row] if words[row] == lm_scoring.END else words[row] + b" "
            i = at[row]
            at[row] += 1
            for bit in range(8):
                for k, cue in enumerate((int(chunk.cues[row]), int(chunk.cues[row]) % lm_scoring.CUES)):
                    _, kind, counts = chunk.trees[k]
                    for b in (0, 1):
                        key = cue, spelled[:i], spelled[i] >> (8 - bit), b, bit
                        assert found[k].setdefault(key, counts[b, kind[one * 8 + bit]]) == counts[b, kind[one * 8 + bit]]
    assert pairs == vocab.count() and chunks.count() > 10
    for k in (0, 1):
        assert {key: n for key, n in found[k].items() if n} == dict(want[k])


def test_lm_rare_words_are_learned(spark):
    """A word seen twice in training is likelier than one of the same letters that never was."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    twice, never = [name() for _ in range(2000)], [name() for _ in range(500)]
    data = [(i, " ".join(twice[i % 100 * 20 : i % 100 * 20 + 20]), True) for i in range(200)] + [(200, " ".join(never), False)]
    model, chunks = lm_scoring.fit(lm_scoring.chunked(lm_scoring.vocabulary(spark.createDataFrame(data, "doc_id long, text string, train boolean"))[0]))
    word_of = {}
    for row in lm_scoring.chunks_of(chunks.toArrow().to_batches()):
        chunk = lm_scoring.Chunk(row)
        word_of |= dict(zip(lm_scoring.keys_of(chunk.words, chunk.cues)[0].view(np.int64).tolist(), chunk.words.to_pylist(), strict=True))
    logp = {word_of[r["k1"]].decode(): r["logp"] for r in lm_scoring.scored_vocabulary(chunks, model).collect()}
    assert np.mean([logp[w] for w in twice]) > np.mean([logp[w] for w in never]) + 1


# --- 9 exact dedup


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(docs, none, bits):
    got = exact_dedup(docs, hash_bits=bits, most=64).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[low(r["text"])].append(r["doc_id"])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact_dedup(none).count() == 0


# --- 10 decontamination


def edit_distance(item, passage_text):
    """Least distance of item to any passage, by the plain recurrence."""
    last = [0] * (len(passage_text) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(passage_text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return min(last)


def test_myers_is_the_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        other = [rng.randrange(6) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            other[5:5] = item[: len(item) * 2 // 3]
        masks = {}
        for i, x in enumerate(item):
            masks[x] = masks.get(x, 0) | 1 << i
        assert myers(masks, len(item), other)[0] == min(edit_distance(item, other), len(item))


def test_decontaminate(spark, docs, none):
    import re

    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate([3, 8, 20, 40, 40, 60])] + [(90, None), (91, ""), (92, "?!")]
    data = [(100, "x y " + items[1][1].upper() + " z"), (101, items[3][1]), (103, "nothing"), (104, None), (105, items[0][1] + "."), (None, items[2][1])]
    for i, (k, edits) in enumerate([(2, 2), (3, 5), (4, 6), (5, 8), (5, 20)]):
        w = items[k][1].split()
        for e in range(edits):
            spot = rng.randrange(len(w))
            if e % 3 == 0:
                w[spot] = "edit"
            elif e % 3 == 1:
                w.insert(spot, "new")
            else:
                del w[spot]
        data.append((200 + i, text(rng, 30) + " " + " ".join(w) + " " + text(rng, 30)))
    frame = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, item_ids string")
    got = {r["doc_id"]: (r["item_ids"], r["distances"]) for r in decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_items=4).collect()}
    for i, t in data:
        words = re.findall(r"[a-z0-9]+", low(t))
        want = [(k, d) for k, item in items[:6] for w in [re.findall(r"[a-z0-9]+", item)] for d in [edit_distance(w, words)] if d <= budget(len(w))]
        assert list(zip(*got[i], strict=True)) == want, i
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r["item_ids"]) for r in decontaminate(docs, bench).collect()} == {()}
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(frame, bench.limit(0)).where("size(item_ids) > 0").count() == 0
