"""Programs on single events: what they give, and what doesn't compile."""

import time

import pytest
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError, parse
from eventloom.plans.api import evaluate, remap, search, warnings

GOOD = [
    (".a + 1", {"a": 1}, 2), (".a = .b.c", {"b": {"c": 5}}, 5), ("to_string(1.0)", {}, "1"),
    ("x = [1, 2, 3]\nfilter(x) -> |i, v| { v > 1 }", {}, [2, 3]), ('upcase("a") + "b"', {}, "Ab"), ('parse_json!(.x).a[0]', {"x": '{"a":[7]}'}, 7),
    ('if .a == 1 { "x" } else { 2 }', {"a": 1}, "x"), ("total = 0\nfor_each([1, 2, 3]) -> |i, v| { total = total + v }\ntotal", {}, 6),
    ('map_values({"a": 1, "b": 2}) -> |v| { v * 2 }', {}, {"a": 2, "b": 4}), ("9223372036854775807 + 1", {}, -9223372036854775808),
    ("del(.a)\n.", {"a": 1, "b": 2}, {"b": 2}), (".a.b[1] = 3\n.", {}, {"a": {"b": [None, 3]}}), ("return 5", {}, 5), ('"{" + "a" + "\\u{41}"', {}, "{aA"),
    ("ok, err = to_int(.x)\nok", {"x": "q"}, 0), ('to_int("x") ?? 7', {}, 7), ("null || 3", {}, 3), ("1 == 1.0", {}, True), ('"ab" * 2', {}, "abab"),
    ('x = {"a": {"b": 1}}\nx.a.c = 2\nx', {}, {"a": {"b": 1, "c": 2}}), ("[1, 2][-1]", {}, 2), ("# note\n1 # more", {}, 1), ("(1; 2)", {}, 2), ("7 / 2", {}, 3.5),
    ('compact({"a": null, "b": "", "c": 1, "d": []})', {}, {"c": 1}), ('unnest!(.a)', {"a": [1, 2]}, [{"a": 1}, {"a": 2}]),
    ('parse_regex!("ab12", r\'(?P<x>[a-z]+)(?P<y>\\d+)(?P<z>q)?\')', {}, {"x": "ab", "y": "12", "z": None}),
    ('decode_base64!("aGk")', {}, "hi"), ('encode_json({"b": 1.0, "a": "x"})', {}, '{"a":"x","b":1.0}'), ('redact("abc 12", filters: [r\'\\d+\'])', {}, "abc [REDACTED]"),
    ('parse_xml!("<a b=\\"1\\"><c>2</c><c>x</c></a>")', {}, {"a": {"@b": 1, "c": [2, "x"]}}), ('parse_groks!("2021 x", ["%{integer:a} %{word:b.c}"])', {}, {"a": 2021, "b": {"c": "x"}}),
]
BAD = [("to_int(.x)", 100), (".a = to_int(\"x\")", 103), ("upcase(1)", 110), ("nope()", 105), ("x", 701), ("upcase!(\"a\")", 620), ("upcase(\"a\") ?? 1", 651), ("1 < 2 < 3", 650), ("!1", 660), ("ok, err = 1", 104), ("upcase()", 107), ("upcase(nope: 1)", 108), ("if 1 { 2 }", 102), ('"a', 202), ("for = 1", 205), ("match(\"a\", r'(?=x)')", 101)]


@pytest.mark.parametrize("program, event, want", GOOD, ids=[g[0][:40] for g in GOOD])
def test_result(spark, program, event, want):
    got = evaluate(spark, program, event)
    assert got["status"] in ("ok", "returned") and got["result"] == want


@pytest.mark.parametrize("program, code", BAD, ids=[b[0] for b in BAD])
def test_compile_errors(spark, program, code):
    with pytest.raises(CompileError) as e:
        evaluate(spark, program, {"x": "1"})
    assert e.value.code == code


def test_syntax_errors():
    for source in ("1 +", "{", "[1", "a b", "if true", ". =", "x = "):
        with pytest.raises(CompileError):
            parse(source)


def test_failed_rows_keep_their_event(spark):
    df = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "id long, t string")
    got = {r["id"]: r for r in remap(df, ".n = to_int!(.t)\n.id = .id + 10").collect() if r["id"]}
    assert got[11]["n"] == 7 and got[11]["_status"] == "ok"
    assert got[2]["_status"] == "error" and got[2]["n"] is None and "invalid digit" in got[2]["_message"]
    dropped = remap(df, ".n = to_int!(.t)", on_failure="drop")
    assert dropped.columns == ["id", "t", "n"] and dropped.count() == 2


def test_plan_is_one_projection(spark):
    df = spark.range(10).withColumn("t", F.col("id").cast("string"))
    plan = remap(df, '.a = upcase(.t) + "x"\n.b = .a + "y"')._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 1.0).withColumn("w", F.lit("x")).write.parquet(f"{tmp_path}/t")
    plan = search(spark.read.parquet(f"{tmp_path}/t"), "@v:>50").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,50.0)]" in plan or "GreaterThan(v" in plan
    assert "w:string" not in plan


@pytest.mark.parametrize("program", [".a = 1", ".a.b = 1", "del(.a)", ". = {}", "del(.a.b)", "%m = 1", ".c.x.y = 1", "del(.c)", "x, .a = to_int(\"1\")", ".a |= {}"])
def test_read_only_paths(spark, program):
    df = spark.createDataFrame([("x",)], "z string").withColumns({"a": F.struct(F.lit(1).alias("b")), "c": F.struct(F.lit(1).alias("x"))})
    with pytest.raises(CompileError) as e:
        remap(df, program, read_only=[".a.b", "%m", ".c.*"])
    assert e.value.code == 315


def test_paths_beside_read_only_ones(spark):
    df = spark.createDataFrame([("x", 1)], "z string, n long").withColumn("a", F.struct(F.lit(1).alias("b")))
    got = remap(df, ".a.c = .a.b\n.n = 2\nx = .a.b", read_only=[".a.b", ".z"]).first()
    assert got["a"]["c"] == 1 and got["n"] == 2
    with pytest.raises(ValueError):
        remap(df, ".n = 2", read_only=["n + 1"])


@pytest.mark.parametrize("program, hint", [("upcsae(.a)", "upcase"), ("x_total = 1\nx_totl", "x_total"), ("upcase(vaule: .a)", "value")])
def test_suggestions(spark, program, hint):
    with pytest.raises(CompileError, match=f'did you mean "{hint}"'):
        evaluate(spark, program, {"a": "1"})


@pytest.mark.parametrize("program, want", [
    (".a = 1\n.b", []), ("5\n.a = 1", ["unused literal"]), ("upcase(\"a\")\n.a = 1\n.", ["unused result of function call"]), ("x = 1\n.a = 2\n.", ["unused variable x"]),
    ("_x = 1\n.a = 2\n.", []), ("x = 1\n.a = x\n.", []), ("if .a { 1 + 2 }\n.b = 1\n.", ["unused expression"]), ("del(.a)\nassert!(true)\n.", []), ("x = {}\nx.y = 1\n.a = x.y\n.", []),
    ("for_each([1]) -> |i, v| { .n = v }\n.", []), ("{ .x\n .y = 1 }\n.", ["unused query"]), ("x = 1\nx |= {}\n.", []),
])
def test_warnings(program, want):
    assert [w.message for w in warnings(program)] == want


def test_tally_of_many_words(spark):
    """The sorted array is made once, so that thousands of words take no more than a moment."""
    words = [f"w{i % 1700}" for i in range(5000)]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    began = time.time()
    got = remap(df, 'w = split(.t, " ")\nn = tally!(w)\n.n = n.w3\n.m = tally_value(w, "w1699")\n.k = length(n)').first()
    assert (got["n"], got["m"], got["k"]) == (3, 2, 1700) and time.time() - began < 20


def test_log_lines_match_once(spark):
    """A line with the mark itself, a line that doesn't match, and one that ends in a line end are as any other."""
    line = '10.0.0.1 - bob [10/Oct/2020:13:55:36 +0000] "GET /a{} HTTP/1.0" 200 23'
    df = spark.createDataFrame([(1, line.format("")), (2, line.format("\x01x")), (3, "none"), (4, line.format("") + "\n"), (5, "a\x01b"), (6, None)], "i long, l string")
    got = {r["i"]: r for r in remap(df, "o, .err = parse_common_log(.l)\n.p = o.path\n.s = o.status\n.u = o.identity").collect()}
    assert [(got[i]["p"], got[i]["s"], got[i]["u"]) for i in (1, 2, 4)] == [("/a", 200, None), ("/a\x01x", 200, None), ("/a", 200, None)]
    assert got[3]["err"] == got[5]["err"] == "failed parsing common log line"
    plan = remap(df, "o = parse_common_log!(.l)\n.p = o.path\n.s = o.status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(l") == 1
