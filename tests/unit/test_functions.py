"""Functions that SQL can't check: round trips, published test values, properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.functions import load
from eventloom.functions.crypto import AES, CRCS, chacha_poly, crc_of, crypt, sea, sizes_of
from eventloom.functions.json_schema import problems
from eventloom.functions.parsers import gathered, key_values, ruby_value, yaml_value
from eventloom.plans.api import evaluate

CIPHERS = [f"AES-{b}-{m}" for b in (128, 192, 256) for m in ("CFB", "OFB", "CTR", "CTR-LE", "CTR-BE", "CBC-PKCS7", "CBC-ANSIX923", "CBC-ISO7816", "CBC-ISO10126")] + ["AES-128-SIV", "AES-256-SIV", "CHACHA20-POLY1305", "XCHACHA20-POLY1305", "XSALSA20-POLY1305"]


def test_all_functions_are_there():
    assert len(load()) == 203


@pytest.mark.parametrize("name", CIPHERS)
def test_ciphers_round_trip(name):
    k, i = sizes_of(name)
    for data in (b"", b"x", b"0123456789abcdef", bytes(range(100))):
        sealed = crypt(data, name, bytes(range(k)), bytes(range(i)), True)
        assert crypt(sealed, name, bytes(range(k)), bytes(range(i)), False) == data
    with pytest.raises(ValueError):
        crypt(b"x", name, b"short", bytes(range(i)), True)


def test_published_values():
    assert AES(bytes(range(16))).encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert AES(bytes(range(32))).encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert chacha_poly(bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), b"", True)[-16:] != b""
    checks = {"CRC_32_ISO_HDLC": 0xCBF43926, "CRC_32_BZIP2": 0xFC891918, "CRC_32_ISCSI": 0xE3069283, "CRC_16_ARC": 0xBB3D, "CRC_16_XMODEM": 0x31C3, "CRC_16_MODBUS": 0x4B37, "CRC_16_KERMIT": 0x2189, "CRC_8_SMBUS": 0xF4, "CRC_8_MAXIM_DOW": 0xA1, "CRC_24_OPENPGP": 0x21CF02, "CRC_64_XZ": 0x995DC9BBDF1939FA, "CRC_64_ECMA_182": 0x6C40DF5F0B497347}
    for name, want in checks.items():
        assert crc_of(b"123456789", *CRCS[name]) == want, name
    assert sea(b"foobar") == 5348458858952426560


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=5), st.text("xyz 0.-", max_size=6), min_size=1, max_size=4))
def test_key_values_read_what_is_written(pairs):
    line = " ".join(f'{k}="{v}"' for k, v in pairs.items())
    assert gathered(key_values(line, "=", " ", False, True)) == pairs


def test_text_formats():
    assert yaml_value("a: 1\nb:\n  - x\n  - y: [1, 2]\nc: {d: e, f: \"g\"}\nt: |\n  one\n  two\n") == {"a": 1, "b": ["x", {"y": [1, 2]}], "c": {"d": "e", "f": "g"}, "t": "one\ntwo\n"}
    assert ruby_value('{ :a => 1, "b" => [nil, true, {c: 2.5}] }') == {"a": 1, "b": [None, True, {"c": 2.5}]}
    with pytest.raises(ValueError):
        ruby_value("{a")


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"enum": ["x"]}}, "additionalProperties": False}
    assert problems({"a": 3, "b": "x"}, schema, schema, False) == []
    for bad in ({}, {"a": 2}, {"a": "x"}, {"a": 3, "b": "y"}, {"a": 3, "c": 1}, []):
        assert problems(bad, schema, schema, False)


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"allOf": [{"properties": {"a": {"type": "integer"}}}], "unevaluatedProperties": False}, [{}, {"a": 1}, 5], [{"b": 1}, {"a": "x"}, {"a": 1, "b": 2}]),
        ({"anyOf": [{"required": ["a"], "properties": {"a": True}}, {"properties": {"b": {"const": 1}}}], "unevaluatedProperties": {"type": "null"}}, [{"a": 1, "b": 1}, {"b": 1, "c": None}], [{"a": 1, "b": 2}]),
        ({"if": {"properties": {"k": {"const": 1}}}, "then": {"properties": {"x": True}}, "unevaluatedProperties": False}, [{"k": 1, "x": 2}], [{"k": 2}, {"k": 1, "y": 2}]),
        ({"prefixItems": [{"type": "string"}], "contains": {"type": "integer"}, "unevaluatedItems": False}, [["a", 1], ["a", 1, 2]], [["a"], ["a", 1, "b"]]),
        ({"contains": {"const": 1}, "minContains": 2, "maxContains": 3}, [[1, 1], [1, 0, 1, 1.0]], [[1], [1, True], [1, 1, 1, 1]]),
        ({"contains": {"const": 1}, "minContains": 0}, [[], [2]], []),
        ({"dependentSchemas": {"a": {"required": ["b"]}}}, [{}, {"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
        ({"enum": [1, [0], {"x": False}]}, [1, 1.0, [0], {"x": False}], [True, [False], {"x": 0}]),
        ({"uniqueItems": True}, [[1, True], [0, False, "0"]], [[1, 1.0], [{"a": 1}, {"a": 1.0}]]),
        ({"$defs": {"n": {"$anchor": "node", "properties": {"next": {"$ref": "#node"}, "v": {"type": "integer"}}}}, "$ref": "#/$defs/n"}, [{"next": {"next": {"v": 1}}}], [{"next": {"next": {"v": "1"}}}]),
        ({"$id": "https://x.org/a", "$ref": "b", "$defs": {"b": {"$id": "b", "type": "string"}}}, ["s"], [1]),
        ({"allOf": [{"type": "string"}, {"maxLength": 2}], "$ref": "#/allOf/1"}, ["ab"], ["abc", 1]),
        ({"$dynamicAnchor": "t", "properties": {"c": {"items": {"$dynamicRef": "#t"}}}, "unevaluatedProperties": False}, [{"c": [{"c": []}]}], [{"c": [{"d": 1}]}]),
    ],
)
def test_json_schema_keywords(schema, good, bad):
    assert [v for v in good if problems(v, schema, schema, False)] == []
    assert [v for v in bad if not problems(v, schema, schema, False)] == []


def test_json_schema_reference_elsewhere():
    for ref in ("https://y.org/z", "#gone", "#/$defs/gone"):
        with pytest.raises(ValueError, match="Unresolvable"):
            problems(1, {"$ref": ref}, {"$ref": ref}, False)


@pytest.mark.parametrize("program, want", [('decode_gzip!(encode_gzip("héllo"))', "héllo"), ('decode_lz4!(encode_lz4("aaaaaaaaaaaaaaaaaaaab"), prepended_size: true)', "aaaaaaaaaaaaaaaaaaaab"), ('decrypt_ip!(encrypt_ip!("2001:db8::5", "sixteen byte key", "aes128"), "sixteen byte key", "aes128")', "2001:db8::5"), ('unflatten(flatten({"a": {"b": 1, "c": {"d": 2}}}))', {"a": {"b": 1, "c": {"d": 2}}})])
def test_round_trips(spark, program, want):
    assert evaluate(spark, program, {})["result"] == want


def test_network_is_gated(spark):
    with pytest.raises(Exception, match="network"):
        evaluate(spark, 'reverse_dns!("127.0.0.1")', {})
