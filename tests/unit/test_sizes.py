"""What large tables need: batches worked out at once, bounded memory, and time for each row; with the results of the row's own functions."""

import json
import random
import time

import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from eventloom.functions import grok
from eventloom.functions.codecs import lz4_block
from eventloom.functions.crypto import attempt, crypt, crypt_many, sizes_of
from eventloom.functions.parsers import SYSLOG_5424, syslog
from eventloom.functions.patterns import python
from eventloom.functions.registry import FUNCTIONS, arrow
from eventloom.plans.api import remap
from eventloom.plans.typed import ANY, INT, STRING, Typed

from test_functions import CIPHERS


def plain(x):
    return (type(x), str(x)) if isinstance(x, Exception) else x


def test_ciphers_of_a_batch_are_those_of_its_rows():
    r = random.Random(1)
    rows = [(b"x", "AES-128-CFB", b"short", bytes(16)), (b"x", "AES-128-CFB", bytes(16), b"short"), (b"x", "NONE", b"", b"")]
    for name in CIPHERS:
        k, i = sizes_of(name)
        keys = [r.randbytes(k) for _ in range(2)]
        rows += [(r.randbytes(n), name, r.choice(keys), r.choice([r.randbytes(i), b"\xff" * i])) for n in (0, 1, 15, 16, 17, 33, 64, 65, 130)]
    r.shuffle(rows)
    sealed = [attempt(crypt, *row, True) for row in rows]
    assert [plain(x) for x in crypt_many(rows, True)] == [plain(x) for x in sealed]
    for cut in (lambda b: b, lambda b: b[:-1], lambda b: b[:-1] + b"\7", lambda b: b[:5]):
        again = [(cut(x) if isinstance(x, bytes) else b"z", *row[1:]) for x, row in zip(sealed, rows, strict=True)]
        assert [plain(x) for x in crypt_many(again, False)] == [plain(attempt(crypt, *row, False)) for row in again]


@pytest.mark.parametrize("name", ["AES-256-CFB", "AES-256-CBC-PKCS7", "CHACHA20-POLY1305"])
def test_ciphers_of_a_batch_take_less_time(name):
    k, i = sizes_of(name)
    rows = [(b"Customer#%09d" % n, name, bytes(k), bytes(i)) for n in range(2000)]
    crypt_many(rows[:1], True)
    began = time.process_time()
    crypt_many(rows, True)
    at_once = time.process_time() - began
    began = time.process_time()
    for row in rows[:200]:
        crypt(*row, True)
    assert at_once < 10 * (time.process_time() - began) / 5


def test_batches_of_long_texts_have_few_rows(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(0, 400, 1, 1).select(F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string")).alias("text"))
    remap(long, ".a = 1")
    rows = arrow(None, INT, Typed(STRING, F.col("text")), many=lambda some: [len(some)] * len(some))
    assert long.select(rows.col.alias("n")).agg(F.max("n")).first()[0] < 100


@pytest.mark.parametrize("given, kept", [("1m", "1m"), ("2048", "2048"), ("64MB", str(4 << 20))])
def test_smaller_bounds_of_a_session_are_kept(spark, given, kept):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, given)
    try:
        remap(spark.range(1), ".a = 1")
        assert spark.conf.get(key).rstrip("b") == kept
    finally:
        spark.conf.unset(key)


def test_lz4_copies_that_run_into_themselves():
    for text in (b"a" * 5000, b"abc" * 999 + b"z", bytes(range(256)) * 3 + b"xyxyx" * 77):
        block = pa.Codec("lz4_raw").compress(text, asbytes=True)
        assert lz4_block(block, len(text)) == text


def sieved(text, pattern, one, many):
    """What sieve() gave before, match by match."""
    out, at = "", 0
    for start, end in [m.span() for m in python(pattern).finditer(text)] + [(len(text), len(text))]:
        gap = len(text[at:start].encode())
        out += ("" if not gap else one if gap == 1 else many) + text[start:end]
        at = end
    return out


TEXTS = ["", "a", "Z", "abc def", "ab\n\nC d", "é", "aéb", "a😀😀b", "[x]-y^z&&w|~", "tail Éß", "x\u2028y", "0-9 A_b.c\\d", "ǅ ſ K"]


@pytest.mark.parametrize("pattern", ["[a-z ]", "[a-z ]+", "[^a-z ]", "[0-9A-F.,é]", r"[\w.]", r"[^\s\]]+", "[a-z&&[aeiou]]", "[a-z--[aeiou]]", "ab|c", "a?", "(a)b", "[-a]", "[a-]", "(?i)[a-c]", "[k-]"])
def test_sieve_by_classes(spark, pattern):
    df = spark.createDataFrame(pd.DataFrame({"t": TEXTS}))
    for one, many in (("", ""), ("*", "<>"), ("", "$1")):
        out = remap(df, f".a = sieve(.t, r'{pattern}', replace_single: \"{one}\", replace_repeated: \"{many}\")").collect()
        assert {r.t: r.a for r in out} == {t: sieved(t, pattern, one, many) for t in TEXTS}


def test_sieve_of_a_plain_class_needs_no_python(spark, capsys):
    remap(spark.createDataFrame(pd.DataFrame({"t": TEXTS})), ".a = sieve(.t, r'[a-z ]')").select("a").explain()
    assert "Python" not in capsys.readouterr().out


def per_row(run, text):
    run(text)
    began = time.process_time()
    for _ in range(500):
        run(text)
    return time.process_time() - began


def run_of(monkeypatch, name, *args):
    """The Python function of a function's Arrow node."""
    got = []
    monkeypatch.setattr(grok, "arrow", lambda run, *_: got.append(run) or Typed(STRING, F.lit("")))
    FUNCTIONS[name].lower(None, Typed(STRING, None), *args)
    return got[0]


def test_grok_filters_read_their_arguments_once(spark, monkeypatch):
    rule = '%{date("yyyy-MM-dd"):f} %{data:g:array("[]", ",", integer)} %{data::keyvalue}'
    run = run_of(monkeypatch, "parse_groks", Typed(ANY, None, const=[rule]), None, None)
    assert json.loads(run("2020-03-01 [1,2] k=v")) == {"f": 1583020800000, "g": [1, 2], "k": "v"}
    monkeypatch.setattr(grok, "date_layout", None)
    monkeypatch.setattr(grok, "arguments", None)
    assert json.loads(run("2020-02-30 [1,x] k=5")) == {"k": 5}


def test_grok_takes_no_more_than_some_matches_a_row(spark, monkeypatch):
    run = run_of(monkeypatch, "parse_groks", Typed(ANY, None, const=["%{integer:bad}", "%{word:kind} %{integer:user.id} %{data::keyvalue}"]), None, None)
    match = regex.compile(r"\A(\w+) (\d+) (.*?)\Z").match
    assert per_row(run, "purchase 55 k=v") < 40 * per_row(match, "purchase 55 k=v")


def test_syslog_patterns_are_made_once():
    assert json.loads(syslog('<165>1 - h a 7 - [x k="a\\"b"] m')) == {"facility": "local4", "severity": "notice", "version": 1, "hostname": "h", "appname": "a", "procid": 7, "x": {"k": 'a"b'}, "message": "m"}
    assert SYSLOG_5424('1 - - - - - [a b="' + "\\\\" * 5000 + "x") is None


@pytest.mark.parametrize("text, want", [('{"a": "x"}', "x"), ('{"a": null}', None), ('{"a": 5}', None), ('{"b": 1}', None), ("[1]", None)])
def test_fields_of_variants(spark, text, want):
    df = spark.createDataFrame(pd.DataFrame({"t": [text]}))
    row = remap(df, "o = parse_json!(.t)\n.s, .err = string(o.a)\n.q = o.\"it's\"", status=False).first()
    assert (row.s or None) == want and (row.err is None) == (want is not None) and row.q is None


def test_fields_of_variants_are_looked_up_by_path(spark, capsys):
    remap(spark.createDataFrame(pd.DataFrame({"t": ["{}"]})), "o = parse_json!(.t)\n.s = string!(o.a)").select("s").explain()
    assert "map<string,variant>" not in (plan := capsys.readouterr().out) and "MapType" not in plan
