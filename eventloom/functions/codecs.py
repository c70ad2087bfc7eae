"""Codecs. Bytes that aren't text are of kind binary; text goes in as its UTF-8 bytes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, BINARY, NULL, STRING, Kind, Typed, array_of, const, first_error, json_text, lossy, to_any, to_text

from .convert import fail
from .registry import arrow, fn, need_const


def raw(v: Typed) -> Column:
    """The bytes of a value; a string keeps even those that aren't UTF-8."""
    return v.col if v.kind == BINARY else v.col.cast("binary")


def as_bytes(v: Typed) -> Typed:
    return Typed(BINARY, raw(v), v.err, const=v.const.encode("utf-8", "replace") if isinstance(v.const, str) else v.const)


def text_of(b: bytes):
    return b.decode("utf-8", "replace")


def codec(name: str, run, returns: Kind, fallible: bool, signature: str = "value:str", error: str | None = None):
    @fn(name, signature)
    def lower(ctx, value: Typed, **options: Typed | None):
        o = {k: need_const(v, k) for k, v in options.items()}
        out = arrow(lambda b: run(bytes(b), **o), returns, as_bytes(value), error=error)
        return out if fallible else out.with_err(value.err)

    return lower


@fn("encode_base16", "value:str")
def encode_base16(ctx, value: Typed):
    return Typed(STRING, F.lower(F.hex(raw(value))), value.err)


@fn("decode_base16", "value:str")
def decode_base16(ctx, value: Typed):
    got = F.try_to_binary(value.col, F.lit("hex"))
    got = F.when(F.length(value.col) % 2 == 0, got)
    return Typed(STRING, got.cast("string"), fail(got.isNull() & value.col.isNotNull(), "unable to decode value from base16"))


def alphabet(v: Typed | None, name: str) -> bool:
    kind = need_const(v, name) or "standard"
    if kind not in ("standard", "url_safe"):
        raise CompileError(403, f"unknown charset: {kind}")
    return kind == "url_safe"


@fn("encode_base64", "value:str, padding?:bool=true, charset?:str=standard")
def encode_base64(ctx, value: Typed, padding: Typed, charset: Typed):
    c = F.regexp_replace(F.base64(raw(value)), "\r\n", "")
    if alphabet(charset, "charset"):
        c = F.translate(c, "+/", "-_")
    return Typed(STRING, c if padding.const else F.regexp_replace(c, "=+$", ""), value.err)


@fn("decode_base64", "value:str, charset?:str=standard")
def decode_base64(ctx, value: Typed, charset: Typed):
    bare = F.regexp_replace(value.col, "=+$", "")
    if alphabet(charset, "charset"):
        good = bare.rlike("^[A-Za-z0-9_-]*$")
        bare = F.translate(bare, "-_", "+/")
    else:
        good = bare.rlike("^[A-Za-z0-9+/]*$")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)).cast("int")))
    got = F.when(good & (F.length(bare) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    return Typed(STRING, got.cast("string"), fail(got.isNull() & value.col.isNotNull(), "unable to decode value from base64"))


@fn("decode_percent", "value:str")
def decode_percent(ctx, value: Typed):
    """%XX alone; + stays, and a lone % as well."""
    safe = F.regexp_replace(F.regexp_replace(value.col, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return Typed(STRING, F.url_decode(safe), value.err)


# ASCII characters that each set encodes, beside controls and non-ASCII.
_CONTROLS = "".join(map(chr, [*range(0x20), 0x7F]))
_FRAGMENT = _CONTROLS + ' "<>`'
_QUERY = _CONTROLS + ' "#<>'
_PATH = _QUERY + "?`{}"
_USERINFO = _PATH + "/:;=@[\\]^|"
_COMPONENT = _USERINFO + "$%&+,"
_FORM = _COMPONENT + "!'()~"
SETS = {"NON_ALPHANUMERIC": "".join(chr(c) for c in range(128) if not chr(c).isalnum()), "CONTROLS": _CONTROLS, "FRAGMENT": _FRAGMENT, "QUERY": _QUERY, "SPECIAL": _QUERY + "'", "PATH": _PATH, "USERINFO": _USERINFO, "COMPONENT": _COMPONENT, "WWW_FORM_URLENCODED": _FORM}


@fn("encode_percent", "value:str, ascii_set?:str=NON_ALPHANUMERIC")
def encode_percent(ctx, value: Typed, ascii_set: Typed):
    if ascii_set.const not in SETS:
        raise CompileError(403, f"unknown ASCII set: {ascii_set.const}")
    keep = {c for c in range(128) if chr(c) not in SETS[ascii_set.const]}
    out = arrow(lambda v: "".join(chr(b) if b in keep else f"%{b:02X}" for b in v.encode()), STRING, value)
    return out.with_err(value.err)


def _zlib(b, wbits):
    import zlib

    return zlib.decompress(b, wbits)


def _deflate(b, level, wbits):
    import zlib

    if level is not None and not 0 <= level <= 10:
        raise ValueError("compression level must be <= 10")
    c = zlib.compressobj(min(9, 6 if level is None else level), zlib.DEFLATED, wbits)
    return c.compress(b) + c.flush()


codec("decode_gzip", lambda b: text_of(_zlib(b, 31)), STRING, True, error="unable to decode value with Gzip decoder")
codec("decode_zlib", lambda b: text_of(_zlib(b, 15)), STRING, True, error="unable to decode value with Zlib decoder")
codec("encode_gzip", lambda b, compression_level: _deflate(b, compression_level, 31), BINARY, False, "value:str, compression_level?:int=6")
codec("encode_zlib", lambda b, compression_level: _deflate(b, compression_level, 15), BINARY, False, "value:str, compression_level?:int=6")


def _unzstd(b):
    import zstandard

    return text_of(zstandard.ZstdDecompressor().decompressobj().decompress(b))


def _zstd(b, compression_level):
    import zstandard

    return zstandard.ZstdCompressor(level=compression_level).compress(b)


codec("decode_zstd", _unzstd, STRING, True, error="unable to decode value with Zstd decoder")
codec("encode_zstd", _zstd, BINARY, False, "value:str, compression_level?:int=3")


def _arrow_codec(name):
    import pyarrow as pa

    return pa.Codec(name)


def lz4_block(data: bytes, most: int) -> bytes:
    """A raw LZ4 block, decoded."""
    out, i = bytearray(), 0
    while i < len(data):
        token = data[i]
        i += 1
        n = token >> 4
        if n == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        out += data[i : i + n]
        i += n
        if i >= len(data):
            break
        offset = data[i] | data[i + 1] << 8
        i += 2
        if not 0 < offset <= len(out):
            raise ValueError("unable to decode lz4 block data")
        n = (token & 15) + 4
        if token & 15 == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        at = len(out) - offset
        out += out[at : at + n] if n <= offset else (bytes(out[at:]) * -(-n // offset))[:n]  # a copy may run into what it writes
        if len(out) > most:
            raise ValueError("unable to decode lz4 block data: output too large")
    return bytes(out)


def _unlz4(b, buf_size, prepended_size):
    if b[:4] == b"\x04\x22\x4d\x18":
        return text_of(_lz4_frame(b))
    if prepended_size:
        n = int.from_bytes(b[:4], "little")
        return text_of(lz4_block(b[4:], n))
    return text_of(lz4_block(b, buf_size))


def _lz4_frame(b):
    import io

    import pyarrow as pa

    return pa.CompressedInputStream(io.BytesIO(b), "lz4").read()


def _lz4(b, prepend_size):
    import pyarrow as pa

    block = pa.Codec("lz4_raw").compress(b, asbytes=True)
    return len(b).to_bytes(4, "little") + block if prepend_size else block


codec("decode_lz4", _unlz4, STRING, True, "value:str, buf_size?:int=1000000, prepended_size?:bool=false", error="unable to decode value with lz4 decoder")
codec("encode_lz4", _lz4, BINARY, False, "value:str, prepend_size?:bool=true")


def _varint(b):
    n = shift = i = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n


codec("decode_snappy", lambda b: text_of(_arrow_codec("snappy").decompress(b, _varint(b), asbytes=True)), STRING, True, error="unable to decode value with Snappy decoder")
codec("encode_snappy", lambda b: _arrow_codec("snappy").compress(b, asbytes=True), BINARY, True, error="unable to encode value with Snappy encoder")


def _charset(label):
    import codecs

    # Web labels that Python names otherwise or maps to another set
    label = {"latin1": "cp1252", "iso-8859-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "windows-31j": "cp932", "x-sjis": "cp932", "shift_jis": "cp932", "euc-kr": "cp949", "gb2312": "gbk", "utf8": "utf-8"}.get(label.strip().lower(), label.strip().lower())
    return codecs.lookup(label).name


def charset(name: str, param: str, run, returns: Kind):
    @fn(name, f"value:str, {param}:str")
    def lower(ctx, value: Typed, **options: Typed):
        v = options[param]
        return arrow(lambda b, label: run(bytes(b), label), returns, as_bytes(value), v, error="Unknown charset")

    return lower


charset("decode_charset", "from_charset", lambda b, label: b.decode(_charset(label), "replace"), STRING)
charset("encode_charset", "to_charset", lambda b, label: b.decode().encode(_charset(label), "replace"), BINARY)


def _mime(v: str) -> str:
    import base64
    import quopri
    import re

    def word(label, how, text):
        b = quopri.decodestring(text.replace("_", " ").encode(), header=False) if how in "qQ" else base64.b64decode(text + "=" * (-len(text) % 4), validate=False)
        return b.decode(_charset(label) if label else "utf-8", "replace")

    p = r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?="
    if re.search(p, v):
        return re.sub(p, lambda m: word(*m.groups()), re.sub(r"(\?=)\s+(=\?)", r"\1\2", v))
    m = re.fullmatch(r"\??([^?]*)\?([bBqQ])\?([^?]*)(?:\?=)?", v)
    if m:
        return word(*m.groups())
    raise ValueError("unable to decode value with mime quoted-printable decoder")


@fn("decode_mime_q", "value:str")
def decode_mime_q(ctx, value: Typed):
    return arrow(_mime, STRING, value)


def _to_puny(v, validate):
    if validate:
        import unicodedata

        v = unicodedata.normalize("NFKC", v).lower()
    out = []
    for label in v.split("."):
        if label.isascii():
            out.append(label)
        else:
            out.append("xn--" + label.encode("punycode").decode())
    text = ".".join(out)
    if validate and any(len(x) > 63 or x.startswith("-") or x.endswith("-") for x in out):
        raise ValueError("unable to encode value to punycode")
    return text


def _from_puny(v, validate):
    out = [x[4:].encode().decode("punycode") if x.lower().startswith("xn--") else x for x in v.split(".")]
    if validate:
        for x, y in zip(v.split("."), out, strict=True):
            if x.lower().startswith("xn--") and y.isascii():
                raise ValueError("unable to decode value from punycode")
    return ".".join(out)


for _name, _run in (("encode_punycode", _to_puny), ("decode_punycode", _from_puny)):

    def _make(name=_name, run=_run):
        @fn(name, "value:str, validate?:bool=true")
        def lower(ctx, value: Typed, validate: Typed):
            check = bool(validate.const)
            return arrow(lambda v: run(v, check), STRING, value)

    _make()


@fn("encode_json", "value:any, pretty?:bool=false")
def encode_json(ctx, value: Typed, pretty: Typed):
    text = Typed(STRING, json_text(value), value.err)
    if not pretty.const:
        return text
    out = arrow(lambda v: json.dumps(json.loads(v), indent=2, ensure_ascii=False), STRING, text)
    return out.with_err(value.err)


@fn("encode_csv", "value:arr, delimiter?:str")
def encode_csv(ctx, value: Typed, delimiter: Typed | None):
    d = need_const(delimiter, "delimiter") or ","
    if len(d.encode()) != 1:
        raise CompileError(402, "delimiter must be a single character")
    if value.kind.elem.tag not in ("string", "null"):
        return Typed(STRING, F.lit(None).cast("string"), F.lit("all array items must be strings"))
    needs = lambda x: x.contains(d) | x.contains('"') | x.contains("\n") | x.contains("\r")
    cell = lambda x: F.when(needs(x), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = F.array_join(F.transform(value.col, cell), d)
    alone = (F.size(value.col) == 1) & (F.get(value.col, F.lit(0)) == "")
    return Typed(STRING, F.when(alone, '""').otherwise(line), F.when(F.lit(False), F.lit("")))


def encoded_pairs(ctx, value: Typed, order: list[str], kv: str, field: str, flags: bool) -> Typed:
    def quoted(c):
        # keys and values with blanks, quotes or delimiters are quoted, and quotes in them escaped
        needs = c.rlike(r'[\s"=]') | c.contains(kv) | c.contains(field) | (c == "")
        body = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        return F.when(needs, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(c)

    def leaves(v: Typed, prefix: str):
        for k, x in sorted(ctx.parts_of(v).items()):
            if x.parts is not None or x.kind.tag == "object":
                yield from leaves(x, f"{prefix}{k}.")
            else:
                yield prefix + k, x

    if value.kind.tag == "map":
        ks = F.array_sort(F.map_keys(value.col))
        first = F.array(*[F.lit(k) for k in order]).cast("array<string>")
        ks = F.concat(F.filter(first, lambda k: F.map_contains_key(value.col, k)), F.array_except(ks, first))
        cell = lambda k: F.concat(quoted(k), F.lit(kv), quoted(to_text(Typed(value.kind.elem, F.try_element_at(value.col, k)))))
        return Typed(STRING, F.array_join(F.transform(ks, cell), field), F.when(F.lit(False), F.lit("")))
    rows = dict(leaves(value, ""))
    cells = []
    for k in [*[k for k in order if k in rows], *[k for k in sorted(rows) if k not in order]]:
        v = rows[k]
        if v.kind.tag == "array":
            texts = F.transform(v.col, lambda x, i: F.concat(quoted(F.concat(F.lit(f"{k}."), i.cast("string"))), F.lit(kv), quoted(to_text(Typed(v.kind.elem, x)))))
            cells.append(F.array_join(texts, field))
        elif flags and v.kind.tag == "bool":
            cells.append(F.when(v.col, quoted(F.lit(k))))
        else:
            cells.append(F.concat(quoted(F.lit(k)), F.lit(kv), quoted(F.when(F.lit(v.kind.tag == "null"), F.lit("")).otherwise(to_text(v)))))
    return Typed(STRING, F.concat_ws(field, *cells) if cells else F.lit(""), F.when(F.lit(False), F.lit("")))


@fn("encode_key_value", "value:obj, fields_ordering?:arr, key_value_delimiter?:str==, field_delimiter?:str, flatten_boolean?:bool=false")
def encode_key_value(ctx, value: Typed, fields_ordering: Typed | None, key_value_delimiter: Typed | None, field_delimiter: Typed | None, flatten_boolean: Typed):
    return encoded_pairs(ctx, value, need_const(fields_ordering, "fields_ordering") or [], need_const(key_value_delimiter, "d") or "=", need_const(field_delimiter, "d") or " ", bool(flatten_boolean.const))


@fn("encode_logfmt", "value:obj, fields_ordering?:arr")
def encode_logfmt(ctx, value: Typed, fields_ordering: Typed | None):
    return encoded_pairs(ctx, value, need_const(fields_ordering, "fields_ordering") or [], "=", " ", True)


def message_class(desc_file: str, message_type: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    files = descriptor_pb2.FileDescriptorSet()
    with open(desc_file, "rb") as f:
        files.ParseFromString(f.read())
    pool = descriptor_pool.DescriptorPool()
    for x in files.file:
        pool.Add(x)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(message_type))


@fn("parse_proto", "value:str, desc_file:str, message_type:str")
def parse_proto(ctx, value: Typed, desc_file: Typed, message_type: Typed):
    """Needs the protobuf package on the executors, and the descriptor file at one path on all of them."""
    path, name = need_const(desc_file, "desc_file"), need_const(message_type, "message_type")

    def run(b):
        from google.protobuf import json_format

        return json_format.MessageToJson(message_class(path, name).FromString(bytes(b)), preserving_proto_field_name=True)

    return arrow(run, ANY, as_bytes(value))


@fn("encode_proto", "value:any, desc_file:str, message_type:str, allow_lossy_string_coercion?:bool=true")
def encode_proto(ctx, value: Typed, desc_file: Typed, message_type: Typed, allow_lossy_string_coercion: Typed):
    path, name = need_const(desc_file, "desc_file"), need_const(message_type, "message_type")

    def run(v):
        from google.protobuf import json_format

        return json_format.Parse(v, message_class(path, name)()).SerializeToString()

    return arrow(run, BINARY, Typed(STRING, json_text(value)))
