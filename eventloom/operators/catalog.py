"""Queries over the driver's tables, one or more for each operator and function, with the SQL that gives the same rows.

A query is a table, a program, the columns kept, and SQL. Functions without a counterpart in SQL are queried by round trips
(decode of encode) or on lines made from columns, so that SQL knows the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.plans.api import remap, search, unnest

# name, table, program, columns, SQL (None: rows alone can be checked)
PROGRAMS: list[tuple[str, str, str, str, str | None]] = [
    # language
    ("lang_arithmetic", "lineitem", ".a = .l_extendedprice * (1.0 - .l_discount)\n.b = .l_linenumber + 2 * .l_linenumber - 1\n.c = .l_quantity / 4\n.d = .l_linenumber * 1.5", "l_orderkey l_linenumber a b c d", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS a, l_linenumber + 2 * l_linenumber - 1 AS b, l_quantity / 4 AS c, l_linenumber * 1.5::DOUBLE AS d FROM lineitem"),
    ("lang_comparison", "orders", '.a = .o_totalprice >= 100000.0\n.b = .o_orderstatus == "F"\n.c = .o_orderpriority < "3"\n.d = .o_custkey != 5', "o_orderkey a b c d", "SELECT o_orderkey, o_totalprice >= 100000 AS a, o_orderstatus = 'F' AS b, o_orderpriority < '3' AS c, o_custkey <> 5 AS d FROM orders"),
    ("lang_logic", "events", '.a = .value > 50.0 && .event_type == "error"\n.b = .value > 100.0 || !(.user_id > 5)\n.c = null || .event_type', "event_id a b c", "SELECT event_id, value > 50 AND event_type = 'error' AS a, value > 100 OR NOT (user_id > 5) AS b, event_type AS c FROM events"),
    ("lang_if", "events", '.bucket = if .value > 150.0 { "high" } else if .value > 50.0 { "mid" } else { "low" }\nif .event_type == "error" { .flag = true\n .value = 0.0 }', "event_id bucket flag value", "SELECT event_id, CASE WHEN value > 150 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS bucket, CASE WHEN event_type = 'error' THEN true END AS flag, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS value FROM events"),
    ("lang_variables", "customer", 'x = .c_acctbal * 2.0\ny = { z = x + 1.0\n z }\n.y = y\n.t = to_string(.c_custkey) + "-" + .c_name', "c_custkey y t", "SELECT c_custkey, c_acctbal * 2 + 1 AS y, c_custkey || '-' || c_name AS t FROM customer"),
    ("lang_template", "customer", 'n = .c_name\ns = .c_mktsegment\n.t = "{{ n }} of {{ s }}"', "c_custkey t", "SELECT c_custkey, c_name || ' of ' || c_mktsegment AS t FROM customer"),
    ("lang_objects", "customer", '.o = {"name": .c_name, "money": {"bal": .c_acctbal}}\n.name = .o.name\n.bal = .o.money.bal\n.o.extra = .c_nationkey\n.n = .o.extra\n. |= {"k": .c_custkey}', "k name bal n", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_nationkey AS n FROM customer"),
    ("lang_arrays", "customer", 'a = [.c_custkey, .c_nationkey, 7]\na[4] = 9\n.first = a[0]\n.last = a[-1]\n.gap = a[3]\n.none = a[9]', "c_custkey first last gap none", "SELECT c_custkey, c_custkey AS first, 9 AS last, NULL::BIGINT AS gap, NULL::BIGINT AS none FROM customer"),
    ("lang_error_coalesce", "events", ".k = to_int(parse_json!(.props).k) ?? -1", "event_id k", "SELECT event_id, coalesce(CAST(props->>'k' AS BIGINT), 0) AS k FROM events"),
    ("lang_error_assign", "events", '.n, .err = to_int(.event_type)', "event_id n err", "SELECT event_id, 0 AS n, 'Invalid integer \"' || event_type || '\": invalid digit found in string' AS err FROM events"),
    ("lang_abort", "events", 'if .event_type == "error" { abort "bad" }\n.seen = true', "event_id seen _status _message", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE true END AS seen, CASE WHEN event_type = 'error' THEN 'aborted' ELSE 'ok' END AS _status, CASE WHEN event_type = 'error' THEN 'bad' END AS _message FROM events"),
    ("lang_return", "events", 'if .value > 100.0 { return "big" }\n.small = true', "event_id small _status", "SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE true END AS small, CASE WHEN value > 100 THEN 'returned' ELSE 'ok' END AS _status FROM events"),
    ("lang_fail", "events", '.n = to_int!(replace(.event_type, "error", "5"))', "event_id n _status", "SELECT event_id, CASE WHEN event_type = 'error' THEN 5 END AS n, CASE WHEN event_type = 'error' THEN 'ok' ELSE 'error' END AS _status FROM events"),
    ("lang_metadata", "events", "%seen = .user_id + 1\n.m = %seen", "event_id m", "SELECT event_id, user_id + 1 AS m FROM events"),
    ("lang_numbers", "region", ".a = 1_000_000\n.b = 2_0.5 + .r_regionkey\n.c = 1e3", "r_regionkey a b c", "SELECT r_regionkey, 1000000 AS a, 20.5::DOUBLE + r_regionkey AS b, 1000.0::DOUBLE AS c FROM region"),
    ("lang_merge_assign", "customer", 'o = {"a": 1, "b": {"x": 1}}\no |= {"a": .c_custkey, "b": {"y": 2}}\n.a = o.a\n.n = length(o.b)\n.o = {"k": 1}\n.o |= {"l": .c_nationkey}\n.l = .o.l\n.k = .o.k', "c_custkey a n l k", "SELECT c_custkey, c_custkey AS a, 1 AS n, c_nationkey AS l, 1 AS k FROM customer"),
    ("lang_noop_target", "events", '_, .err = to_int(.event_type)\n.n, _ = to_int(to_string(.user_id))', "event_id err n", "SELECT event_id, 'Invalid integer \"' || event_type || '\": invalid digit found in string' AS err, user_id AS n FROM events"),
    ("conv_regex", "documents", '.a = match(.text, to_regex!("[0-9]{3}"))\n_, .err = to_regex("(")\n.err = .err != null', "doc_id a err", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS a, true AS err FROM documents"),
    ("grok_matchers", "pages", 'g = parse_groks!("u.x-1 " + .url + " \\"q s\\" /a/b.c 10.0.0.1:80 end of line", ["%{user:u} %{uri:url} %{qs:q} %{path:p} %{hostPort:hp}%{space}%{greedyData:rest}"])\n.u = string!(g.u)\n.url2 = string!(g.url)\n.q = string!(g.q)\n.p = string!(g.p)\n.hp = string!(g.hp)\n.rest = string!(g.rest)', "page_id u url2 q p hp rest", "SELECT page_id, 'u.x-1' AS u, url AS url2, '\"q s\"' AS q, '/a/b.c' AS p, '10.0.0.1:80' AS hp, 'end of line' AS rest FROM pages"),
    ("grok_filters", "events", 'g = parse_groks!("5. 1.5e2 7 ABC def 2020-03-01 [1,2," + to_string(.user_id) + "] TRUE k=" + .event_type, ["%{number:a} %{numberExt:b} %{integer:c:scale(10)} %{word:d:lowercase} %{word:e:uppercase} %{date(\\"yyyy-MM-dd\\"):f} %{data:g:array(\\"[]\\", \\",\\", integer)} %{boolean:h} %{data::keyvalue}"])\n.a = to_float!(g.a)\n.b = to_float!(g.b)\n.c = to_int!(g.c)\n.d = string!(g.d)\n.e = string!(g.e)\n.f = int!(g.f)\n.g = int!(g.g[2])\n.h = bool!(g.h)\n.k = string!(g.k)', "event_id a b c d e f g h k", "SELECT event_id, 5.0::DOUBLE AS a, 150.0::DOUBLE AS b, 70 AS c, 'abc' AS d, 'DEF' AS e, 1583020800000 AS f, user_id AS g, true AS h, event_type AS k FROM events"),
    # strings
    ("str_case", "part", ".a = upcase(.p_name)\n.b = downcase(.p_brand)", "p_partkey a b", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b FROM part"),
    ("str_contains", "documents", '.a = contains(.text, "the")\n.b = contains(.text, "THE", case_sensitive: false)\n.c = contains_all(.text, ["the", "and"])', "doc_id a b c", "SELECT doc_id, contains(text, 'the') AS a, contains(lower(text), 'the') AS b, contains(text, 'the') AND contains(text, 'and') AS c FROM documents"),
    ("str_prefix_suffix", "part", '.a = starts_with(.p_type, "ECONOMY")\n.b = ends_with(.p_name, "1", case_sensitive: false)\n.c = starts_with(.p_brand, "brand#1", case_sensitive: false)', "p_partkey a b c", "SELECT p_partkey, starts_with(p_type, 'ECONOMY') AS a, ends_with(lower(p_name), '1') AS b, starts_with(lower(p_brand), 'brand#1') AS c FROM part"),
    ("str_truncate", "documents", '.a = truncate(.text, 20, suffix: "...")\n.n = strlen(.text)\n.b = length(.text)', "doc_id a n b", "SELECT doc_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS a, length(text) AS n, strlen(text) AS b FROM documents"),
    ("str_split_join", "documents", '.n = length(split(.text, " "))\n.j = join(split(.text, " ", limit: 3), "|")', "doc_id n j", "SELECT doc_id, len(string_split(text, ' ')) AS n, CASE WHEN len(string_split(text, ' ')) <= 3 THEN replace(text, ' ', '|') ELSE string_split(text, ' ')[1] || '|' || string_split(text, ' ')[2] || '|' || array_to_string(string_split(text, ' ')[3:], ' ') END AS j FROM documents"),
    ("str_replace", "documents", ".a = replace(.text, \"e\", \"3\")\n.b = replace(.text, r'[aeiou]+', \"_\")\n.c = replace(.text, r'(?P<x>[a-z])(?P<y>[a-z])', \"$y$x\")", "doc_id a b c", "SELECT doc_id, replace(text, 'e', '3') AS a, regexp_replace(text, '[aeiou]+', '_', 'g') AS b, regexp_replace(text, '([a-z])([a-z])', '\\2\\1', 'g') AS c FROM documents"),
    ("str_replace_with", "customer", ".a = replace_with(.c_name, r'[0-9]+') -> |m| { \"<\" + m.string + \">\" }", "c_custkey a", "SELECT c_custkey, regexp_replace(c_name, '([0-9]+)', '<\\1>', 'g') AS a FROM customer"),
    ("str_match", "documents", ".a = match(.text, r'\\d{3}')\n.b = match_any(.text, [r'zzz', r'[0-9]@'])", "doc_id a b", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS a, regexp_matches(text, 'zzz|[0-9]@') AS b FROM documents"),
    ("str_match_array", "conversations", 'w = split(.text, " ")\n.a = match_array(w, r\'^[a-c]\')\n.b = match_array(w, r\'.\', all: true)', "conv_id turn a b", "SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[a-c]'))) > 0 AS a, len(list_filter(string_split(text, ' '), lambda x: x = '' OR NOT regexp_matches(x, '[^\\n]'))) = 0 AS b FROM conversations"),
    ("str_find", "documents", '.a = find(.text, "e")\n.b = find(.text, "zzzz")', "doc_id a b", "SELECT doc_id, CASE WHEN instr(text, 'e') > 0 THEN strlen(substr(text, 1, instr(text, 'e') - 1)) END AS a, NULL::BIGINT AS b FROM documents"),
    ("str_slice", "customer", ".a = slice!(.c_name, 1, 5)\n.b = slice!(.c_name, -3)", "c_custkey a b", "SELECT c_custkey, substr(c_name, 2, 4) AS a, right(c_name, 3) AS b FROM customer"),
    ("str_paths", "pages", 'p = replace(.url, r\'^[a-z]+://\', "/")\n.a = basename!(p)\n.b = length(split_path!(p))', "page_id a b", "WITH p AS (SELECT page_id, rtrim(regexp_replace(url, '^[a-z]+://', '/'), '/') AS p FROM pages) SELECT page_id, string_split(p, '/')[-1] AS a, 1 + len(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.')) AS b FROM p"),
    ("str_dirname", "customer", '.a = dirname!("/x/" + .c_name)\n.b = dirname!(.c_name)', "c_custkey a b", "SELECT c_custkey, '/x' AS a, '.' AS b FROM customer"),
    ("str_casing", "customer", '.a = snakecase(.c_mktsegment + " seg")\n.b = kebabcase("one_two")\n.c = camelcase("one_two-three")\n.d = pascalcase("one two")\n.e = screamingsnakecase("oneTwo")', "c_custkey a b c d e", "SELECT c_custkey, lower(c_mktsegment) || '_seg' AS a, 'one-two' AS b, 'oneTwoThree' AS c, 'OneTwo' AS d, 'ONE_TWO' AS e FROM customer"),
    ("str_strip", "customer", '.a = strip_whitespace("  " + .c_name + "\\t\\n")\n.b = strip_ansi_escape_codes("\\u{1b}[31m" + .c_name + "\\u{1b}[0m")', "c_custkey a b", "SELECT c_custkey, c_name AS a, c_name AS b FROM customer"),
    ("str_entropy", "customer", '.a = round(shannon_entropy("aab"), 6)\n.b = shannon_entropy("abcd", segmentation: "codepoint")\n.c = shannon_entropy("ab", segmentation: "grapheme")', "c_custkey a b c", "SELECT c_custkey, 0.918296::DOUBLE AS a, 2.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM customer"),
    ("str_sieve", "documents", ".a = sieve(.text, r'[a-z ]')", "doc_id a", "SELECT doc_id, regexp_replace(text, '[^a-z ]', '', 'g') AS a FROM documents"),
    ("str_redact", "documents", ".a = redact(.text, filters: [r'[0-9]+'])\n.b = redact(.text, filters: [r'[a-z]+@[a-z]+'], redactor: {\"type\": \"text\", \"replacement\": \"X\"})", "doc_id a b", "SELECT doc_id, regexp_replace(text, '[0-9]+', '[REDACTED]', 'g') AS a, regexp_replace(text, '[a-z]+@[a-z]+', 'X', 'g') AS b FROM documents"),
    # numbers
    ("num_rounding", "lineitem", ".a = abs(.l_quantity - 30.0)\n.b = ceil(.l_extendedprice / 7)\n.c = floor(.l_extendedprice / 7)\n.d = round(.l_extendedprice / 7)\n.e = floor(.l_extendedprice, precision: 1)", "l_orderkey l_linenumber a b c d e", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 30) AS a, ceil(l_extendedprice / 7) AS b, floor(l_extendedprice / 7) AS c, floor(l_extendedprice / 7 + 0.5) AS d, floor(l_extendedprice * 10) / 10 AS e FROM lineitem"),
    ("num_mod", "orders", ".a = mod(.o_orderkey, 7)\n.b, .err = mod(.o_orderkey, .o_custkey - .o_custkey)", "o_orderkey a b err", "SELECT o_orderkey, o_orderkey % 7 AS a, 0 AS b, 'can''t calculate remainder of zero' AS err FROM orders"),
    ("num_format", "orders", ".a = format_int!(.o_orderkey, 16)\n.b = format_number(.o_orderkey * 1000, grouping_separator: \",\")\n.c = format_number(.o_orderkey, scale: 2)\n.d = format_int!(.o_orderkey, 2)", "o_orderkey a b c d", "SELECT o_orderkey, lower(to_hex(o_orderkey)) AS a, format('{:,}', o_orderkey * 1000) AS b, o_orderkey || '.00' AS c, bin(o_orderkey) AS d FROM orders"),
    ("num_parse", "orders", '.a = parse_int!(to_string(.o_orderkey))\n.b = parse_int!(format_int!(.o_orderkey, 16), 16)\n.c = parse_float!(to_string(.o_totalprice))\n.d, .err = parse_int("x1")', "o_orderkey a b c d err", "SELECT o_orderkey, o_orderkey AS a, o_orderkey AS b, o_totalprice AS c, 0 AS d, 'could not parse integer' AS err FROM orders"),
    ("num_haversine", "customer", "h = haversine(0.0, 0.0, 10.0, 10.0)\n.b = h.bearing\n.d = h.distance", "c_custkey b d", "SELECT c_custkey, 44.561::DOUBLE AS b, 1568.5227233::DOUBLE AS d FROM customer"),
    # time, conversion, coercion
    ("time_format", "orders", '.a = format_timestamp(.o_orderdate, "%Y-%m-%d %H:%M:%S")\n.b = format_timestamp(.o_orderdate, "%d/%b/%Y %j")\n.c = to_unix_timestamp(.o_orderdate)\n.d = to_unix_timestamp(.o_orderdate, unit: "milliseconds")', "o_orderkey a b c d", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%d/%b/%Y %j') AS b, epoch(o_orderdate)::BIGINT AS c, epoch_ms(o_orderdate) AS d FROM orders"),
    ("time_zone", "orders", '.a = format_timestamp(.o_orderdate, "%Y-%m-%d %H:%M %z", timezone: "Asia/Tokyo")', "o_orderkey a", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || ' +0900' AS a FROM orders"),
    ("time_parse", "orders", '.t = parse_timestamp!(format_timestamp(.o_orderdate, "%d/%m/%Y %H:%M:%S"), format: "%d/%m/%Y %H:%M:%S")\n.u = from_unix_timestamp(to_unix_timestamp(.o_orderdate))\n.e, .err = parse_timestamp("nope", format: "%Y")', "o_orderkey t u err", "SELECT o_orderkey, o_orderdate AS t, o_orderdate AS u, 'Invalid timestamp \"nope\": input contains invalid characters' AS err FROM orders"),
    ("time_now", "region", ".a = now() > t'2020-01-01T00:00:00Z'", "r_regionkey a", "SELECT r_regionkey, true AS a FROM region"),
    ("conv_syslog", "nation", ".a = to_syslog_level!(mod(.n_nationkey, 8))\n.b = to_syslog_severity!(.a)\n.c = to_syslog_facility!(mod(.n_nationkey, 24))\n.d = to_syslog_facility_code!(.c)", "n_nationkey a b d", "SELECT n_nationkey, ['emerg','alert','crit','err','warning','notice','info','debug'][n_nationkey % 8 + 1] AS a, n_nationkey % 8 AS b, n_nationkey % 24 AS d FROM nation"),
    ("coerce_int", "events", '.a = to_int(.value)\n.b = to_int!(to_string(.user_id))\n.c = to_int(.value > 100.0)\n.d = to_int(.ts)\n.e = to_int(null)', "event_id a b c d e", "SELECT event_id, trunc(value)::BIGINT AS a, user_id AS b, (value > 100)::BIGINT AS c, floor(epoch(ts))::BIGINT AS d, 0 AS e FROM events"),
    ("coerce_float", "events", '.a = to_float(.user_id)\n.b = to_float!(to_string(.value))\n.c = to_float(true)', "event_id a b c", "SELECT event_id, user_id::DOUBLE AS a, value AS b, 1.0::DOUBLE AS c FROM events"),
    ("coerce_bool", "events", '.a = to_bool(.user_id)\n.b = to_bool!("yes")\n.c, .err = to_bool(.event_type)', "event_id a b c err", "SELECT event_id, user_id <> 0 AS a, true AS b, false AS c, 'Invalid boolean value \"' || event_type || '\"' AS err FROM events"),
    ("coerce_string", "events", '.a = to_string(.user_id)\n.b = to_string(.value > 1.0)\n.c = to_string(null)\n.d = to_string(2.0)', "event_id a b c d", "SELECT event_id, user_id::VARCHAR AS a, CASE WHEN value > 1 THEN 'true' ELSE 'false' END AS b, '' AS c, '2' AS d FROM events"),
    ("parse_sizes", "nation", '.a = parse_duration!(to_string(.n_nationkey) + "m30s", unit: "s")\n.b = parse_bytes!(to_string(.n_nationkey) + "KiB", unit: "B")', "n_nationkey a b", "SELECT n_nationkey, (n_nationkey * 60 + 30)::DOUBLE AS a, (n_nationkey * 1024)::DOUBLE AS b FROM nation"),
    # types
    ("type_tests", "events", '.a = is_string(.event_type)\n.b = is_integer(.value)\n.c = is_float(.value)\n.d = is_timestamp(.ts)\n.e = is_null(.none)\n.f = is_array([1])\n.g = is_object({})\n.h = is_boolean(true)\n.i = is_regex(r\'x\')', "event_id a b c d e f g h i", "SELECT event_id, true AS a, false AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i FROM events"),
    ("type_tests_dynamic", "events", 'k = parse_json!(.props).k\n.a = is_integer(k)\n.b = is_string(k)\n.c = is_null(k)\n.d = is_object(parse_json!(.props))', "event_id a b c d", "SELECT event_id, (props->>'k') IS NOT NULL AS a, false AS b, (props->>'k') IS NULL AS c, true AS d FROM events"),
    ("type_asserts", "events", '.a = int(parse_json!(.props).k) ?? -5\n.b = string!(.event_type)\n.c = float!(.value)\n.d = timestamp!(.ts)\n.e = bool!(true)\n.f = array!([1])\n.g = object!({"x": 1})\n.i = length(.f)', "event_id a b c d e i", "SELECT event_id, coalesce((props->>'k')::BIGINT, -5) AS a, event_type AS b, value AS c, ts AS d, true AS e, 1 AS i FROM events"),
    ("type_empty", "documents", '.a = is_empty(.text)\n.b = is_nullish(" - ")\n.c = is_nullish("-")\n.d = is_empty([])\n.e = is_json(.text)', "doc_id a b c d", "SELECT doc_id, text = '' AS a, false AS b, true AS c, true AS d FROM documents"),
    ("type_json", "events", '.a = is_json(.props)\n.b = is_json(.props, variant: "object")\n.c = is_json(.event_type)', "event_id a b c", "SELECT event_id, true AS a, true AS b, false AS c FROM events"),
    ("type_tagged", "events", '.a = tag_types_externally({"u": .user_id, "t": .event_type})\n.u = .a.u.integer\n.t = .a.t.string\n.d = type_def(.user_id)', "event_id u t d", "SELECT event_id, user_id AS u, event_type AS t, '{\"integer\": true}' AS d FROM events"),
    ("type_schema", "events", '.a = validate_json_schema!(.props, s\'{"type": "object"}\')\n.b, .err = validate_json_schema(.props, s\'{"type": "array"}\')', "event_id a b", "SELECT event_id, true AS a, false AS b FROM events"),
    # arrays, objects, enumeration, paths
    ("arr_basic", "events", 'a = [.user_id, 1, 2]\n.n = length(append(a, [3, 4]))\n.p = push(a, .event_id)[-1]\n.q = length(pop(a))\n.u = length(unique([1, 1, .user_id]))\n.i = includes(a, 2)', "event_id n p q u i", "SELECT event_id, 5 AS n, event_id AS p, 2 AS q, CASE WHEN user_id = 1 THEN 1 ELSE 2 END AS u, true AS i FROM events"),
    ("arr_chunks_zip", "customer", '.c = length(chunks!(.c_name, 4))\nz = zip!([.c_custkey, 2], [3, 4, 5])\n.z = z[0][1]\n.n = length(z)', "c_custkey c z n", "SELECT c_custkey, ceil(strlen(c_name) / 4.0)::BIGINT AS c, 3 AS z, 2 AS n FROM customer"),
    ("arr_tally", "conversations", 'w = split(.text, " ")\n.n = tally_value(w, "the")\n.t = tally!(w).the', "conv_id turn n t", "SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x = 'the')) AS n, nullif(len(list_filter(string_split(text, ' '), lambda x: x = 'the')), 0) AS t FROM conversations"),
    ("arr_filter_map", "embeddings", 'v = map_values(.embedding) -> |x| { abs(x) }\n.n = length(filter(v) -> |i, x| { x > 0.5 })', "vec_id n", "SELECT vec_id, len(list_filter(embedding, lambda x: abs(x::DOUBLE) > 0.5)) AS n FROM embeddings"),
    ("arr_fold", "conversations", 'n = 0\nfor_each(split(.text, " ")) -> |i, w| { n = n + strlen(w) }\n.n = n', "conv_id turn n", "SELECT conv_id, turn, length(replace(text, ' ', '')) AS n FROM conversations"),
    ("obj_keys", "customer", 'o = {"b": .c_custkey, "a": .c_nationkey}\n.k = join(keys(o), ",")\n.v = values(o)[0]\n.e = to_entries(o)[1].value\n.f = from_entries(to_entries(o)).a\n.n = length(o)', "c_custkey k v e f n", "SELECT c_custkey, 'a,b' AS k, c_nationkey AS v, c_custkey AS e, c_nationkey AS f, 2 AS n FROM customer"),
    ("obj_merge", "customer", 'o = merge({"a": {"x": 1, "y": 2}}, {"a": {"y": .c_custkey}}, deep: true)\n.x = o.a.x\n.y = o.a.y\n.z = ({"q": 1} | {"q": .c_nationkey}).q', "c_custkey x y z", "SELECT c_custkey, 1 AS x, c_custkey AS y, c_nationkey AS z FROM customer"),
    ("obj_map_keys", "customer", 'o = map_keys({"a": .c_custkey}) -> |k| { upcase(k) + "x" }\n.a = o.Ax', "c_custkey a", "SELECT c_custkey, c_custkey AS a FROM customer"),
    ("obj_from_array", "customer", 'o = object_from_array!([["a", "1"], ["b", .c_name]])\n.a = o.b\np = object_from_array!([.c_custkey, 2], ["k", "l"])\n.b = p.k', "c_custkey a b", "SELECT c_custkey, c_name AS a, c_custkey AS b FROM customer"),
    ("obj_flatten", "customer", 'o = flatten({"a": {"b": .c_custkey, "c": {"d": 1}}})\n.a = o."a.b"\nu = unflatten({"x.y": .c_name})\n.b = u.x.y\n.n = length(flatten([[1, 2], [3]]))', "c_custkey a b n", "SELECT c_custkey, c_custkey AS a, c_name AS b, 3 AS n FROM customer"),
    ("obj_compact", "customer", 'o = compact({"a": "", "b": .c_name})\n.n = length(o)\n.b = o.b', "c_custkey n b", "SELECT c_custkey, 1 AS n, c_name AS b FROM customer"),
    ("path_functions", "customer", 'o = {"a": {"b": .c_custkey}}\n.g = get!(o, ["a", "b"])\ns = set!(o, ["a", "c"], .c_name)\n.s = s.a.c\nr = remove!(o, ["a"])\n.n = length(r)\n.x = exists(.c_name)\n.y = exists(.nothing)\n.old = del(.c_name)\n.gone = exists(.c_name)', "c_custkey g s n x y old gone", "SELECT c_custkey, c_custkey AS g, c_name AS s, 0 AS n, true AS x, false AS y, c_name AS old, false AS gone FROM customer"),
    ("unnest_rows", "customer", '.parts = [.c_name, .c_mktsegment]\n. = unnest!(.parts)', "c_custkey parts", "SELECT c_custkey, c_name AS parts FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer"),
    # codecs
    ("codec_base", "customer", '.a = encode_base64(.c_name)\n.b = decode_base64!(.a)\n.c = encode_base16(.c_name)\n.d = decode_base16!(.c)\n.e = decode_base64!(encode_base64(.c_name, padding: false, charset: "url_safe"), charset: "url_safe")', "c_custkey a b c d e", "SELECT c_custkey, to_base64(c_name::BLOB) AS a, c_name AS b, lower(hex(c_name)) AS c, c_name AS d, c_name AS e FROM customer"),
    ("codec_gzip_zlib", "documents", ".a = decode_gzip!(encode_gzip(.text)) == .text\n.b = decode_zlib!(encode_zlib(.text)) == .text", "doc_id a b", "SELECT doc_id, true AS a, true AS b FROM documents"),
    ("codec_zstd_snappy_lz4", "documents", ".a = decode_zstd!(encode_zstd(.text)) == .text\n.b = decode_snappy!(encode_snappy!(.text)) == .text\n.c = decode_lz4!(encode_lz4(.text), prepended_size: true) == .text", "doc_id a b c", "SELECT doc_id, true AS a, true AS b, true AS c FROM documents"),
    ("codec_percent", "pages", ".a = decode_percent(encode_percent(.url))\n.b = encode_percent(\"a b?\")", "page_id a b", "SELECT page_id, url AS a, 'a%20b%3F' AS b FROM pages"),
    ("codec_charset_punycode", "documents", '.a = decode_charset!(encode_charset!(.text, "utf-16le"), "utf-16le") == .text\n.b = encode_punycode!("www.café.com")\n.c = decode_punycode!("www.xn--caf-dma.com")\n.d = decode_mime_q!("=?utf-8?b?SGVsbG8=?=")', "doc_id a b c d", "SELECT doc_id, true AS a, 'www.xn--caf-dma.com' AS b, 'www.café.com' AS c, 'Hello' AS d FROM documents"),
    ("codec_json", "events", '.a = encode_json({"u": .user_id, "t": .event_type})\n.b = encode_json([.user_id, null])\n.c = encode_json(2.0)', "event_id a b c", "SELECT event_id, '{\"t\":\"' || event_type || '\",\"u\":' || user_id || '}' AS a, '[' || user_id || ',null]' AS b, '2.0' AS c FROM events"),
    ("codec_lines", "events", '.a = encode_key_value!({"u": .user_id, "t": .event_type})\n.b = encode_logfmt!({"f": true, "t": .event_type + " x"})\n.c = encode_csv!([.event_type, "a,b"])', "event_id a b c", "SELECT event_id, 't=' || event_type || ' u=' || user_id AS a, 'f t=\"' || event_type || ' x\"' AS b, event_type || ',\"a,b\"' AS c FROM events"),
    # digests, ciphers
    ("hash_digests", "documents", '.a = md5(.text)\n.b = sha1(.text)\n.c = sha2(.text, variant: "SHA-256")', "doc_id a b c", "SELECT doc_id, md5(text) AS a, sha1(text) AS b, sha256(text) AS c FROM documents"),
    ("hash_fixed", "region", '.a = sha2("foo")\n.b = sha3("foo", variant: "SHA3-224")\n.c = xxhash("foo")\n.d = seahash("foobar")\n.e = crc!("foobar")\n.f = encode_base16(hmac("The quick brown fox jumps over the lazy dog", "key"))', "r_regionkey a b c d e f", "SELECT r_regionkey, 'd58042e6aa5a335e03ad576c6a9e43b41591bfd2077f72dec9df7930e492055d' AS a, 'f4f6779e153c391bbd29c95e72b0708e39d9166c7cea51d1f10ef58a' AS b, 3792637401 AS c, 5348458858952426560 AS d, '2666930069' AS e, 'f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8' AS f FROM region"),
    ("hash_text", "documents", '.a = sha2(.text, variant: "SHA-256")\n.b = hmac(.text, "k") == hmac(.text, "k", algorithm: "SHA-256")\n.c = strlen(encode_base16(hmac(.text, "k", algorithm: "SHA-512")))\n.d = sha3(.text, variant: "SHA3-256") != sha3(.text)', "doc_id a b c d", "SELECT doc_id, sha256(text) AS a, true AS b, 128 AS c, true AS d FROM documents"),
    ("cipher_round_trip", "customer", 'k = "01234567890123456789012345678912"\n.a = decrypt!(encrypt!(.c_name, "AES-256-CFB", k, "0123456789012345"), "AES-256-CFB", k, "0123456789012345")\n.b = decrypt!(encrypt!(.c_name, "CHACHA20-POLY1305", k, "012345678901"), "CHACHA20-POLY1305", k, "012345678901")\n.c = decrypt!(encrypt!(.c_name, "AES-256-CBC-PKCS7", k, "0123456789012345"), "AES-256-CBC-PKCS7", k, "0123456789012345")', "c_custkey a b c", "SELECT c_custkey, c_name AS a, c_name AS b, c_name AS c FROM customer"),
    ("random_values", "nation", '.a = is_boolean(random_bool())\nx = random_float!(1.0, 2.0)\n.b = x >= 1.0 && x < 2.0\ny = random_int!(5, 7)\n.c = y >= 5 && y < 7\n.d = length(random_bytes!(16))\n.e = match(uuid_v4(), r\'^[0-9a-f-]{36}$\')\n.f = match(uuid_v7(), r\'^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$\')', "n_nationkey a b c d e f", "SELECT n_nationkey, true AS a, true AS b, true AS c, 16 AS d, true AS e, true AS f FROM nation"),
    ("uuid_friendly", "region", '.a = uuid_from_friendly_id!("3s87yEvnmkiPBMHsj8bwwc")', "r_regionkey a", "SELECT r_regionkey, '7f41deed-d5e2-8b5e-7a13-ab4ff93cfad2' AS a FROM region"),
    # addresses
    ("ip_v4", "events", 'ip = "10." + to_string(mod(.event_id, 256)) + "." + to_string(mod(.user_id, 256)) + ".7"\n.a = ip_aton!(ip)\n.b = ip_ntoa!(.a) == ip\n.c = ip_cidr_contains!("10.0.0.0/9", ip)\n.d = ip_subnet!(ip, "/16")\n.e = is_ipv4(ip)\n.f = ip_to_ipv6!(ip)\n.g = ipv6_to_ipv4!(.f) == ip\n.h = ip_ntop!(ip_pton!(ip)) == ip', "event_id a b c d e f g h", "SELECT event_id, 167772160 + (event_id % 256) * 65536 + (user_id % 256) * 256 + 7 AS a, true AS b, event_id % 256 < 128 AS c, '10.' || event_id % 256 || '.0.0' AS d, true AS e, '::ffff:10.' || event_id % 256 || '.' || user_id % 256 || '.7' AS f, true AS g, true AS h FROM events"),
    ("ip_crypt", "nation", 'ip = "10.1.2." + to_string(.n_nationkey)\n.a = decrypt_ip!(encrypt_ip!(ip, "sixteen byte key", "aes128"), "sixteen byte key", "aes128") == ip\nk = "thirty-two bytes key for pfx use"\n.b = decrypt_ip!(encrypt_ip!(ip, k, "pfx"), k, "pfx") == ip\n.c = is_ipv6("2001:db8::1")\n.d = community_id!("1.2.3.4", "5.6.7.8", 6, source_port: 1122, destination_port: 3344)', "n_nationkey a b c d", "SELECT n_nationkey, true AS a, true AS b, true AS c, '1:wCb3OG7yAFWelaUydu0D+125CLM=' AS d FROM nation"),
    ("host_facts", "region", '.a = get_timezone_name!()\n.b = length(get_hostname!()) > 0\n.c = get_env_var("NO_SUCH_VARIABLE") ?? "none"', "r_regionkey a b c", "SELECT r_regionkey, 'UTC' AS a, true AS b, 'none' AS c FROM region"),
    # parsers
    ("parse_json_fields", "events", 'o = parse_json!(.props)\n.k = int(o.k) ?? null\n.d = is_object(parse_json!(.props, max_depth: 1))', "event_id k d", "SELECT event_id, (props->>'k')::BIGINT AS k, true AS d FROM events"),
    ("parse_key_values", "events", 'line = "user=" + to_string(.user_id) + " type=\\"" + .event_type + " x\\" flag"\no = parse_key_value!(line)\n.u = string!(o.user)\n.t = string!(o.type)\n.f = bool!(o.flag)\np = parse_logfmt!("a=" + .event_type)\n.l = string!(p.a)', "event_id u t f l", "SELECT event_id, user_id::VARCHAR AS u, event_type || ' x' AS t, true AS f, event_type AS l FROM events"),
    ("parse_common_log", "events", 'line = "10.0.0." + to_string(mod(.user_id, 256)) + " ident " + .event_type + " [" + format_timestamp(.ts, "%d/%b/%Y:%H:%M:%S %z") + "] \\"GET /x/" + to_string(.event_id) + " HTTP/1.1\\" 200 " + to_string(.user_id)\no = parse_common_log!(line)\n.host = o.host\n.user = o.user\n.t = o.timestamp\n.path = o.path\n.status = o.status\n.size = o.size', "event_id host user t path status size", "SELECT event_id, '10.0.0.' || user_id % 256 AS host, event_type AS user, date_trunc('second', ts) AS t, '/x/' || event_id AS path, 200 AS status, user_id AS size FROM events"),
    ("parse_apache_nginx", "events", 'head = "1.2.3.4 - " + .event_type + " [" + format_timestamp(.ts, "%d/%b/%Y:%H:%M:%S %z") + "] \\"GET / HTTP/1.0\\" 404 " + to_string(.user_id) + " \\"ref\\" \\"agent\\""\na = parse_apache_log!(head, format: "combined")\nn = parse_nginx_log!(head, "combined")\n.au = a.user\n.ar = a.referrer\n.ns = n.size\n.na = n.agent\n.nt = n.timestamp', "event_id au ar ns na nt", "SELECT event_id, event_type AS au, 'ref' AS ar, user_id AS ns, 'agent' AS na, date_trunc('second', ts) AS nt FROM events"),
    ("parse_glog_klog", "events", 'g = parse_glog!("I" + format_timestamp(.ts, "%Y%m%d %H:%M:%S") + ".411655 " + to_string(.event_id) + " main.c:9] " + .event_type)\n.l = g.level\n.i = g.id\n.m = g.message\n.y = g.line\nk = parse_klog!("E0505 17:59:40.692994   28133 x.go:70] hi")\n.kl = k.level', "event_id l i m y kl", "SELECT event_id, 'info' AS l, event_id AS i, event_type AS m, 9 AS y, 'error' AS kl FROM events"),
    ("parse_syslog", "events", 'o = parse_syslog!("<" + to_string(mod(.event_id, 184)) + ">1 2020-03-13T20:45:38.119Z host" + to_string(.user_id) + " app 2426 ID31 [ex@1 k=\\"v\\"] " + .event_type)\n.h = string!(o.hostname)\n.m = string!(o.message)\n.s = string!(o.severity)\n.v = int!(o.version)\n.x = string!(o."ex@1".k)\na = parse_linux_authorization!("Mar 5 2020 12:00:00 box sshd[5]: Failed")\n.p = int!(a.procid)', "event_id h m s v x p", "SELECT event_id, 'host' || user_id AS h, event_type AS m, ['emerg','alert','crit','err','warning','notice','info','debug'][event_id % 184 % 8 + 1] AS s, 1 AS v, 'v' AS x, 5 AS p FROM events"),
    ("parse_regexes", "customer", "o = parse_regex!(.c_name, r'(?P<head>[A-Za-z]+)#(?P<n>[0-9]+)')\n.h = o.head\n.n = o.n\n.all = length(parse_regex_all!(.c_name, r'(?P<d>[0-9])'))", "c_custkey h n all", "SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 1) AS h, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 2) AS n, length(regexp_replace(c_name, '[^0-9]', '', 'g')) AS all FROM customer"),
    ("parse_tokens_csv", "events", 't = parse_tokens!("a \\"" + .event_type + " y\\" [z] -")\n.a = t[1]\n.b = t[3]\nc = parse_csv!("x,\\"" + .event_type + ",1\\"")\n.c = c[1]', "event_id a b c", "SELECT event_id, event_type || ' y' AS a, NULL::VARCHAR AS b, event_type || ',1' AS c FROM events"),
    ("parse_urls", "pages", 'o = parse_url!(.url)\n.s = o.scheme\n.h = o.host\n.p = o.path\nq = parse_query_string("?a=1&b=" + .s)\n.q = string!(q.b)', "page_id s h p q", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS h, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS p, regexp_extract(url, '^([a-z]+)://', 1) AS q FROM pages"),
    ("parse_formats", "events", 'x = parse_xml!("<r a=\\"1\\"><t>" + .event_type + "</t></r>")\n.x = string!(x.r.t)\n.xa = int!(x.r."@a")\ny = parse_yaml!("t: " + .event_type + "\\nl:\\n  - 1\\n  - 2\\n")\n.y = string!(y.t)\n.l = length!(y.l)\nr = parse_ruby_hash!("{ :t => \\"" + .event_type + "\\", \\"n\\" => nil }")\n.r = string!(r.t)', "event_id x xa y l r", "SELECT event_id, event_type AS x, 1 AS xa, event_type AS y, 2 AS l, event_type AS r FROM events"),
    ("parse_vendor_lines", "events", 'v = parse_aws_vpc_flow_log!("2 123456789010 eni-1 172.31.16.139 172.31.16.21 " + to_string(.user_id) + " 22 6 20 4249 1418530010 1418530070 ACCEPT OK")\n.p = v.srcport\n.a = v.action\nc = parse_cef!("CEF:0|V|P|1|100|" + .event_type + "|5|src=1.1.1.1 msg=hi there")\n.n = string!(c.name)\n.m = string!(c.msg)\nw = parse_aws_cloudwatch_log_subscription_message!(s\'{"messageType":"DATA_MESSAGE","owner":"o","logGroup":"g","logStream":"s","subscriptionFilters":["f"],"logEvents":[{"id":"1","timestamp":1600110569039,"message":"m"}]}\')\n.w = w.log_events[0].message\ni = parse_influxdb!("cpu,host=A usage=" + to_string(.user_id) + " 1590488773254420000")\n.i = i[0].gauge.value', "event_id p a n m w i", "SELECT event_id, user_id AS p, 'ACCEPT' AS a, event_type AS n, 'hi there' AS m, 'm' AS w, user_id::DOUBLE AS i FROM events"),
    ("parse_alb_line", "region", 'o = parse_aws_alb_log!(s\'http 2018-07-02T22:23:00.186641Z app/my-loadbalancer/50dc6c495c0c9188 192.168.131.39:2817 10.0.0.1:80 0.000 0.001 0.000 200 200 34 366 "GET http://www.example.com:80/ HTTP/1.1" "curl/7.46.0" - - arn:aws:elasticloadbalancing:us-east-2:123456789012:targetgroup/my-targets/73e2d6bc24d8a067 "Root=1-58337364-23a8c76965a2ef7629b185e3" "-" "-" 0 2018-07-02T22:22:48.364000Z "forward" "-" "-" 10.0.0.1:80 200 "-" "-"\')\n.m = string!(o.request_method)\n.b = int!(o.sent_bytes)\n.h = string!(o.client_host)', "r_regionkey m b h", "SELECT r_regionkey, 'GET' AS m, 366 AS b, '192.168.131.39:2817' AS h FROM region"),
    ("parse_etld_agent", "region", 'e = parse_etld!("app.dev.co.uk", plus_parts: 1)\n.e = e.etld\n.p = e.etld_plus\nu = parse_user_agent("Mozilla/5.0 (Windows NT 10.0) Chrome/90.0 Safari/537.36")\n.b = string!(u.browser.family)\n.o = string!(u.os.family)\nc = parse_cbor!("\\u{01}")\n.c = int!(c)', "r_regionkey e p b o c", "SELECT r_regionkey, 'co.uk' AS e, 'dev.co.uk' AS p, 'Chrome' AS b, 'Windows 10' AS o, 1 AS c FROM region"),
    ("parse_groks", "events", 'o = parse_grok!("2020-10-02T23:22:12.223222Z info user " + to_string(.user_id), "%{TIMESTAMP_ISO8601:t} %{LOGLEVEL:l} %{WORD:w} %{INT:n}")\n.l = o.l\n.n = o.n\ng = parse_groks!(.event_type + " " + to_string(.user_id) + " k=v", ["%{integer:bad}", "%{word:kind} %{integer:user.id} %{data::keyvalue}"])\n.k = string!(g.kind)\n.i = int!(g.user.id)\n.v = string!(g.k)', "event_id l n k i v", "SELECT event_id, 'info' AS l, user_id::VARCHAR AS n, event_type AS k, user_id AS i, 'v' AS v FROM events"),
    # search and debugging
    ("search_function", "events", '.a = match_search_query({"message": "an " + .event_type + " came", "v": .value}, "error OR @v:>150")', "event_id a", "SELECT event_id, event_type = 'error' OR value > 150 AS a FROM events"),
    ("debug_functions", "events", '.a = assert!(.user_id >= 0, "negative")\n.b = assert_eq!(1, 1)\nlog(.event_type)\n.c, .err = assert(.user_id < 0, message: "not negative")', "event_id a b c err", "SELECT event_id, true AS a, true AS b, false AS c, 'not negative' AS err FROM events"),
]

SEARCHES: list[tuple[str, str, str]] = [
    ("search_terms", "error", "event_type = 'error'"),
    ("search_compare", "@value:>=100 AND -@user_id:[3 TO 7}", "value >= 100 AND NOT (user_id >= 3 AND user_id < 7)"),
    ("search_or_exists", "(@event_type:purchase OR @event_type:sign*) _exists_:@value", "(event_type = 'purchase' OR event_type LIKE 'sign%') AND value IS NOT NULL"),
    ("search_tags", "user:5 OR tags:\"type:error\"", "user_id = 5 OR event_type = 'error'"),
    ("search_wildcard", "@event_type:*ur*e NOT @user_id:1", "regexp_matches(event_type, '^.*ur.*e$') AND user_id <> 1"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain_times(df: DataFrame) -> DataFrame:
    """Times as the tables have them, without a zone."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def program_query(table: str, program: str, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_times(remap(read(spark, sf_dir, table), program).select(*columns.split()))

    return run


def search_query(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = read(spark, sf_dir, "events")
        tagged = events.withColumns({"message": F.col("event_type"), "tags": F.array(F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("type:"), "event_type"))})
        return search(tagged, query).select("event_id")

    return run


FLAGSHIP = '.k = to_int(parse_json!(.props).k) ?? 0\n.kind = upcase(.event_type)\n.bucket = if .value > 100.0 { "high" } else { "low" }\ndel(.props)\n.'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events remapped, then aggregated by plain DataFrame operations."""
    out = remap(read(spark, sf_dir, "events"), FLAGSHIP, status=False)
    return out.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))


def unnest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = remap(read(spark, sf_dir, "conversations"), '.words = split(.text, " ")').select("conv_id", "turn", "words")
    return unnest(words, "words")


def join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remap between two joins: enrichment is the host's, here Spark's."""
    orders = remap(read(spark, sf_dir, "orders"), '.year = format_timestamp(.o_orderdate, "%Y")').select("o_custkey", "o_totalprice", "year")
    customers = remap(read(spark, sf_dir, "customer"), ".segment = downcase(.c_mktsegment)").select("c_custkey", "segment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment", "year").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: program_query(table, program, columns) for name, table, program, columns, _ in PROGRAMS}
    found |= {name: search_query(q) for name, q, _ in SEARCHES}
    return found | {"flagship": flagship, "unnest_words": unnest_query, "enriched_join": join_query}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, _, _, _, sql in PROGRAMS if sql}
    found |= {name: f"SELECT event_id FROM events WHERE {where}" for name, _, where in SEARCHES}
    return found | {
        "flagship": "SELECT upper(event_type) AS kind, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS bucket, count(*) AS n, sum(coalesce((props->>'k')::BIGINT, 0))::BIGINT AS sum_k FROM events GROUP BY 1, 2",
        "unnest_words": "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS words FROM conversations",
        "enriched_join": "SELECT lower(c_mktsegment) AS segment, strftime(o_orderdate, '%Y') AS year, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    }
