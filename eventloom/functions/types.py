"""Type assertions and tests, JSON validation, debugging."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, BOOL, NULL, STRING, Kind, Typed, array_of, const, first_error, json_text, map_of, object_kind, time_text

from .registry import arrow, fn, from_any, need_const, variant_tag

ASSERTS = {"string": "string", "int": "int", "float": "float", "bool": "bool", "timestamp": "time", "array": "array", "object": "object"}


def assertion(name: str, tag: str):
    @fn(name, "value:any")
    def run(ctx, value: Typed):
        own = {"map": "object", "binary": "string"}.get(value.kind.tag, value.kind.tag)
        if own == tag:
            return value.with_err(first_error(value.err, F.when(value.column().isNull(), F.lit(f"expected {Kind(tag)}, got null"))))
        if own == "any":
            return from_any(value, tag, name)
        kind = array_of(NULL) if tag == "array" else Kind("object", fields=()) if tag == "object" else Kind(tag)
        return Typed(kind, F.lit(None).cast("string") if tag in ("array", "object") else F.lit(None).cast(kind.sql()), F.lit(f"expected {Kind(tag)}, got {value.kind}"))

    return run


for _name, _tag in ASSERTS.items():
    assertion(_name, _tag)


def test(name: str, tags: tuple[str, ...], word: str):
    @fn(name, "value:any")
    def run(ctx, value: Typed):
        if value.kind.tag == "any":
            return Typed(BOOL, variant_tag(value.col) == word)
        if value.kind.tag not in tags:
            return Typed(BOOL, F.lit(False))
        return Typed(BOOL, F.lit(True) if value.parts is not None or value.kind.tag == "regex" else value.column().isNotNull())

    return run


for _name, _tags, _word in (("is_array", ("array",), "array"), ("is_boolean", ("bool",), "boolean"), ("is_float", ("float",), "float"), ("is_integer", ("int",), "integer"), ("is_object", ("object", "map"), "object"), ("is_string", ("string", "binary"), "string"), ("is_timestamp", ("time",), "timestamp"), ("is_regex", ("regex",), "regex")):
    test(_name, _tags, _word)


@fn("is_null", "value:any")
def is_null(ctx, value: Typed):
    if value.kind.tag == "null":
        return const(True)
    if value.kind.tag == "any":
        return Typed(BOOL, variant_tag(value.col) == "null")
    return Typed(BOOL, value.column().isNull() if value.parts is None else F.lit(False))


@fn("is_nullish", "value:any")
def is_nullish(ctx, value: Typed):
    if value.kind.tag == "null":
        return const(True)
    blank = lambda c: (c == "-") | c.rlike(r"(?U)^\s*$")
    if value.kind.tag == "any":
        tag = variant_tag(value.col)
        return Typed(BOOL, (tag == "null") | F.coalesce((tag == "string") & blank(F.try_variant_get(value.col, "$", "string")), F.lit(False)))
    if value.kind == STRING:
        return Typed(BOOL, F.coalesce(blank(value.col), F.lit(True)))
    return Typed(BOOL, value.column().isNull() if value.parts is None else F.lit(False))


@fn("is_empty", "value:any")
def is_empty(ctx, value: Typed):
    tag = value.kind.tag
    if tag == "string":
        return Typed(BOOL, value.col == "")
    if value.parts is not None or tag == "object":
        return Typed(BOOL, F.lit(not (value.parts if value.parts is not None else value.kind.fields)))
    if tag in ("array", "map"):
        return Typed(BOOL, F.size(value.col) == 0)
    if tag == "any":
        t = json_text(value)
        return Typed(BOOL, t.isin('""', "{}", "[]"))
    raise CompileError(110, "is_empty takes a string, an object or an array")


@fn("is_json", "value:str, variant?:str")
def is_json(ctx, value: Typed, variant: Typed | None):
    good = F.try_parse_json(value.col).isNotNull()
    kind = need_const(variant, "variant")
    if kind is not None:
        starts = {"object": r"\{", "array": r"\[", "string": '"', "number": "[-0-9]", "bool": "[tf]", "null": "n"}.get(kind)
        if starts is None:
            raise CompileError(403, f"invalid enum variant: {kind}")
        good = good & value.col.rlike(rf"^\s*{starts}")
    return Typed(BOOL, good, value.err)


@fn("tag_types_externally", "value:any")
def tag_types_externally(ctx, value: Typed):
    def tagged(v: Typed) -> Typed:
        tag = v.kind.tag
        if v.parts is not None or tag == "object":
            parts = {k: tagged(x) for k, x in ctx.parts_of(v).items()}
            return Typed(object_kind(parts), parts=parts)
        if tag == "array" and v.kind.elem != NULL:
            inner = lambda x: tagged(Typed(v.kind.elem, x))
            return Typed(array_of(tagged(Typed(v.kind.elem, F.lit(None))).kind), F.transform(v.col, lambda x: inner(x).column()))
        if tag == "null":
            return v
        if tag == "any":
            raise CompileError(110, "tag_types_externally takes values of a known kind")
        name = {"int": "integer", "bool": "boolean", "time": "timestamp", "binary": "string"}.get(tag, tag)
        inner = Typed(STRING, time_text(v.col)) if tag == "time" else v
        return Typed(object_kind({name: inner}), parts={name: inner})

    return tagged(value)


@fn("type_def", "value:any")
def type_def(ctx, value: Typed):
    def shape(k: Kind):
        if k.tag == "object":
            return {"object": {n: shape(x) for n, x in k.fields}}
        if k.tag == "array":
            return {"array": shape(k.elem)}
        if k.tag == "map":
            return {"object": shape(k.elem)}
        return {str(k): True}

    text = json.dumps(shape(value.kind), sort_keys=True)
    return Typed(STRING, F.lit(text), const=text)


@fn("assert", "condition:bool, message?:str")
def assert_(ctx, condition: Typed, message: Typed | None):
    text = message.col if message is not None else F.lit("assertion failed")
    return Typed(BOOL, condition.col, first_error(condition.err, F.when(~F.coalesce(condition.col, F.lit(False)), text)))


@fn("assert_eq", "left:any, right:any, message?:str")
def assert_eq(ctx, left: Typed, right: Typed, message: Typed | None):
    same = ctx.equal(left, right)
    text = message.col if message is not None else F.concat(F.lit("assertion failed: "), json_text(left), F.lit(" == "), json_text(right))
    return Typed(BOOL, same, F.when(~same, text))


@fn("log", "value:any, level?:str=info, rate_limit_secs?:int=1")
def log(ctx, value: Typed, level: Typed, rate_limit_secs: Typed):
    """Keeps the text as a column of the layer instead of a side effect, which a retried task would repeat."""
    if need_const(level, "level") not in ("trace", "debug", "info", "warn", "error"):
        raise CompileError(403, f"invalid enum variant: {level.const}")
    ctx.env.names["\0log"] = Typed(STRING, json_text(value))
    return const(None)


@fn("validate_json_schema", "value:str, schema_definition:str, ignore_unknown_formats?:bool=false")
def validate_json_schema(ctx, value: Typed, schema_definition: Typed, ignore_unknown_formats: Typed):
    """schema_definition is the path of a schema file the driver reads, or the schema itself."""
    source = need_const(schema_definition, "schema_definition")
    if not source.lstrip().startswith("{"):
        with open(source) as f:
            source = f.read()
    schema, lenient = json.loads(source), bool(ignore_unknown_formats.const)

    def run(v):
        from eventloom.functions.json_schema import problems

        found = problems(json.loads(v), schema, schema, lenient)
        if found:
            raise ValueError("JSON schema validation failed: " + found[0])
        return True

    return arrow(run, BOOL, value)
