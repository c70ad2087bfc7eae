"""Array, object, enumeration and path functions, closures included."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventloom.lang import syntax as s
from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, BOOL, INT, NULL, STRING, Kind, Typed, array_of, as_kind, bound, const, first_error, json_text, lossy, map_of, object_kind, object_of, to_any, unify, value

from .registry import arrow, fn, from_any, need_const, variant_tag


def entries(ctx, v: Typed) -> tuple[Kind, object]:
    """An object of any form as a map of one element kind."""
    if v.kind.tag == "map":
        return v.kind.elem, v.col
    if v.kind.tag == "any":
        m = from_any(v, "object", "object")
        return ANY, m.col
    parts = ctx.parts_of(v)
    kind = NULL
    for x in parts.values():
        kind = unify(kind, x.kind)
    if not parts or kind == NULL:
        kind = STRING if kind == NULL else kind
    if not parts:
        return kind, F.create_map().cast(f"map<string,{kind.sql()}>")
    pairs = [c for k, x in sorted(parts.items()) for c in (F.lit(k), as_kind(x, kind).column())]
    return kind, F.create_map(*pairs)


def array_and(v: Typed) -> Typed:
    return from_any(v, "array", "array") if v.kind.tag == "any" else v


@fn("append", "value:arr, items:arr")
def append(ctx, value: Typed, items: Typed):
    kind = unify(value.kind, items.kind)
    if kind.tag == "any":
        kind = array_of(ANY)
    return Typed(kind, F.concat(as_kind(value, kind).column(), as_kind(items, kind).column()), first_error(value.err, items.err))


@fn("push", "value:arr, item:any")
def push(ctx, value: Typed, item: Typed):
    elem = unify(value.kind.elem, item.kind)
    kind = array_of(elem)
    last = F.array(as_kind(item, elem).column()) if elem != NULL else F.array(F.lit(None))
    return Typed(kind, F.concat(as_kind(value, kind).column(), last), value.err)


@fn("pop", "value:arr")
def pop(ctx, value: Typed):
    return Typed(value.kind, F.slice(value.col, F.lit(1), F.greatest(F.size(value.col) - 1, F.lit(0))), value.err)


@fn("chunks", "value:str, chunk_size:int")
def chunks(ctx, value: Typed, chunk_size: Typed):
    n = need_const(chunk_size, "chunk_size")
    if n < 1:
        raise CompileError(402, '"chunk_size" must be at least 1 byte')
    b = F.encode(value.col, "UTF-8")
    size = F.octet_length(value.col)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / n), F.lit(0)).cast("int")), lambda i: lossy(F.substring(b, i * n + 1, F.lit(n))))
    return Typed(array_of(STRING), F.when(size == 0, F.array().cast("array<string>")).otherwise(cut), F.when(F.lit(False), F.lit("")))


@fn("zip", "array_0:arr, array_1?:arr")
def zip_(ctx, array_0: Typed, array_1: Typed | None):
    if array_1 is not None:
        elem = unify(array_0.kind.elem, array_1.kind.elem)
        a, b = as_kind(array_0, array_of(elem)).column(), as_kind(array_1, array_of(elem)).column()
        n = F.least(F.size(a), F.size(b))
        return Typed(array_of(array_of(elem)), F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)), F.when(F.lit(False), F.lit("")))
    inner = array_0.kind.elem
    if inner.tag != "array":
        raise CompileError(110, "zip takes arrays")
    n = F.coalesce(F.array_min(F.transform(array_0.col, lambda a: F.size(a))), F.lit(0))
    col = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.transform(array_0.col, lambda a: F.get(a, i)))).otherwise(F.array().cast(array_of(inner).sql()))
    return Typed(array_of(inner), col, F.when(F.lit(False), F.lit("")))


@fn("length", "value:any")
def length(ctx, value: Typed):
    tag = value.kind.tag
    if tag == "string":
        return Typed(INT, F.octet_length(value.col).cast("bigint"), value.err)
    if tag == "binary":
        return Typed(INT, F.octet_length(value.col).cast("bigint"), value.err)
    if value.parts is not None or tag == "object":
        return const(len(ctx.parts_of(value)))
    if tag in ("array", "map"):
        return Typed(INT, F.size(value.col).cast("bigint"), value.err)
    if tag == "any":
        t = variant_tag(value.col)
        got = F.when(t == "string", F.octet_length(F.try_variant_get(value.col, "$", "string"))).when(t == "array", F.size(F.try_variant_get(value.col, "$", "array<variant>"))).when(t == "object", F.size(F.try_variant_get(value.col, "$", "map<string,variant>")))
        return Typed(INT, got.cast("bigint"), first_error(value.err, F.when(got.isNull(), F.lit("expected string, object or array"))))
    raise CompileError(110, "length takes a string, an object or an array")


@fn("includes", "value:arr, item:any")
def includes(ctx, value: Typed, item: Typed):
    a, b = value.kind.elem, item.kind
    if a.tag == "any":
        want = json_text(item)
        return Typed(BOOL, F.exists(value.col, lambda x: json_text(Typed(ANY, x)).eqNullSafe(want)), value.err)
    if b == NULL:
        return Typed(BOOL, F.exists(value.col, lambda x: x.isNull()), value.err)
    if a != b:
        return Typed(BOOL, F.lit(False), value.err)
    return Typed(BOOL, F.exists(value.col, lambda x: x.eqNullSafe(item.column())), value.err)


@fn("unique", "value:arr")
def unique(ctx, value: Typed):
    if value.kind.elem == ANY:
        texts = F.array_distinct(F.transform(value.col, lambda x: F.to_json(x)))
        return Typed(value.kind, F.transform(texts, lambda t: F.parse_json(t)), value.err)
    if value.kind.elem.tag in ("map",):
        return arrow_json(value)
    return Typed(value.kind, F.array_distinct(value.col), value.err)


def arrow_json(v: Typed) -> Typed:
    texts = F.array_distinct(F.transform(v.col, lambda x: json_text(Typed(v.kind.elem, x))))
    return Typed(array_of(ANY), F.transform(texts, lambda t: F.parse_json(t)), v.err)


@fn("tally", "value:arr")
def tally(ctx, value: Typed):
    col, err = value.col, value.err
    if value.kind.elem == ANY:
        bad = F.exists(col, lambda x: F.schema_of_variant(x) != "STRING")
        err = first_error(err, F.when(bad, F.lit("all values must be strings")))
        col = F.transform(col, lambda x: F.try_variant_get(x, "$", "string"))
    elif value.kind.elem != STRING:
        return Typed(map_of(INT), F.lit(None).cast("map<string,bigint>"), F.lit("all values must be strings"))
    else:
        err = first_error(err, F.when(F.lit(False), F.lit("")))
    # a word's last place in sorted order, less that of the word before it, is its count
    last = lambda words: F.filter(F.transform(words, lambda x, i: F.struct(x.alias("k"), F.when(F.get(words, i + 1).eqNullSafe(x), F.lit(None).cast("int")).otherwise(i + 1).alias("e"))), lambda e: e["e"].isNotNull())
    counts = lambda ends: F.map_from_entries(F.transform(ends, lambda e, i: F.struct(e["k"], (e["e"] - F.coalesce(F.get(ends, i - 1)["e"], F.lit(0))).cast("bigint"))))
    return Typed(map_of(INT), bound(bound(F.array_sort(col), last), counts), err)


@fn("tally_value", "array:arr, value:any")
def tally_value(ctx, array: Typed, value: Typed):
    if array.kind.elem.tag != "any" and array.kind.elem != value.kind:
        return Typed(INT, F.lit(0).cast("bigint"), array.err)
    want = json_text(value) if array.kind.elem == ANY else value.column()
    same = (lambda x: json_text(Typed(ANY, x)).eqNullSafe(want)) if array.kind.elem == ANY else (lambda x: x.eqNullSafe(want))
    return Typed(INT, F.size(F.filter(array.col, same)).cast("bigint"), array.err)


@fn("keys", "value:obj")
def keys(ctx, value: Typed):
    if value.kind.tag == "map":
        return Typed(array_of(STRING), F.array_sort(F.map_keys(value.col)), value.err)
    return Typed(array_of(STRING), F.array(*[F.lit(k) for k in sorted(ctx.parts_of(value))]).cast("array<string>"), value.err)


@fn("values", "value:obj")
def values(ctx, value: Typed):
    kind, m = entries(ctx, value)
    return Typed(array_of(kind), F.transform(F.array_sort(F.map_keys(m)), lambda k: F.try_element_at(m, k)), value.err)


@fn("to_entries", "value:obj/arr")
def to_entries(ctx, value: Typed):
    if value.kind.tag == "array":
        return Typed(array_of(object_of(key=INT, value=value.kind.elem)), F.transform(value.col, lambda x, i: F.struct(i.cast("bigint").alias("key"), x.alias("value"))), value.err)
    kind, m = entries(ctx, value)
    return Typed(array_of(object_of(key=STRING, value=kind)), F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.try_element_at(m, k).alias("value"))), value.err)


@fn("from_entries", "value:arr")
def from_entries(ctx, value: Typed):
    elem = value.kind.elem
    if elem.tag == "any":
        objects = F.transform(value.col, lambda x: F.try_variant_get(x, "$", "map<string,variant>"))
        key = lambda e: F.coalesce(*[F.try_variant_get(F.try_element_at(e, F.lit(n)), "$", "string") for n in ("key", "Key", "name", "Name")])
        val = lambda e: F.coalesce(F.try_element_at(e, F.lit("value")), F.try_element_at(e, F.lit("Value")))
        pairs = F.filter(F.transform(objects, lambda e: F.struct(key(e).alias("k"), val(e).alias("v"))), lambda p: p["k"].isNotNull())
        return Typed(map_of(ANY), F.map_from_entries(pairs), value.err)
    if elem.tag != "object":
        return Typed(map_of(STRING), F.lit(None).cast("map<string,string>"), F.lit("expected an array of objects"))
    kinds = dict(elem.fields)
    k = next((n for n in ("key", "Key", "name", "Name") if n in kinds), None)
    v = next((n for n in ("value", "Value") if n in kinds), None)
    if k is None:
        raise CompileError(402, "entries have no key")
    vk = kinds[v] if v else STRING
    return Typed(map_of(vk), F.map_from_entries(F.transform(value.col, lambda e: F.struct(e.getField(k).cast("string"), e.getField(v) if v else F.lit(None).cast("string")))), value.err)


@fn("object_from_array", "values:arr, keys?:arr")
def object_from_array(ctx, values: Typed, keys: Typed | None):
    none = F.when(F.lit(False), F.lit(""))
    if keys is not None:
        pairs = F.zip_with(F.slice(values.col, F.lit(1), F.size(keys.col)), keys.col, lambda v, k: F.struct(k.alias("k"), v.alias("v")))
        return Typed(map_of(values.kind.elem), F.map_from_entries(F.filter(pairs, lambda p: p["k"].isNotNull())), none)
    inner = values.kind.elem
    if inner.tag != "array":
        raise CompileError(402, "object_from_array takes an array of pairs")
    if inner.elem == ANY:
        pairs = F.transform(values.col, lambda p: F.struct(F.try_variant_get(F.get(p, F.lit(0)), "$", "string").alias("k"), F.get(p, F.lit(1)).alias("v")))
    else:
        pairs = F.transform(values.col, lambda p: F.struct(F.get(p, F.lit(0)).cast("string").alias("k"), F.get(p, F.lit(1)).alias("v")))
    return Typed(map_of(inner.elem), F.map_from_entries(F.filter(pairs, lambda p: p["k"].isNotNull())), none)


@fn("merge", "to:obj, from:obj, deep?:bool=false")
def merge(ctx, to: Typed, from_: Typed, deep: Typed):
    def both(a: Typed, b: Typed) -> Typed:
        if a.kind.tag in ("map", "any") or b.kind.tag in ("map", "any"):
            ka, ma = entries(ctx, a)
            kb, mb = entries(ctx, b)
            kind = unify(ka, kb)
            x, y = as_kind(Typed(map_of(ka), ma), map_of(kind)).column(), as_kind(Typed(map_of(kb), mb), map_of(kind)).column()
            return Typed(map_of(kind), F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y), first_error(a.err, b.err))
        pa, pb = ctx.parts_of(a), ctx.parts_of(b)
        parts = dict(pa)
        for k, v in pb.items():
            inner = {"object", "map"}
            parts[k] = both(pa[k], v) if deep.const and k in pa and pa[k].kind.tag in inner and v.kind.tag in inner else v
        return Typed(object_kind(parts), parts=parts, err=first_error(a.err, b.err))

    return both(to, from_)


def body(ctx, closure: s.Closure, *values: Typed, name: str) -> Typed:
    out = ctx.call_closure(closure, *values)
    if out.err is not None:
        raise CompileError(100, f"the closure of {name} can fail")
    return out


@fn("filter", "value:obj/arr", closure=True)
def filter_(ctx, value: Typed, closure: s.Closure):
    def test(*vs):
        out = body(ctx, closure, *vs, name="filter")
        if out.kind.tag not in ("bool", "any"):
            raise CompileError(122, "the closure of filter must give a boolean")
        return F.coalesce(out.col if out.kind.tag == "bool" else F.try_variant_get(out.col, "$", "boolean"), F.lit(False))

    if value.kind.tag == "array":
        return Typed(value.kind, F.filter(value.col, lambda x, i: test(Typed(INT, i.cast("bigint")), Typed(value.kind.elem, x))), value.err)
    kind, m = entries(ctx, value)
    return Typed(map_of(kind), F.map_filter(m, lambda k, v: test(Typed(STRING, k), Typed(kind, v))), value.err)


@fn("map_values", "value:obj/arr, recursive?:bool=false", closure=True)
def map_values(ctx, value: Typed, recursive: Typed, closure: s.Closure):
    deep = bool(need_const(recursive, "recursive"))
    one = lambda v: body(ctx, closure, v, name="map_values")

    def inner(v: Typed) -> Typed:
        tag = v.kind.tag
        if deep and (tag in ("object", "map", "array")):
            v = over(v)
        return one(v)

    def over(v: Typed) -> Typed:
        tag = v.kind.tag
        if v.parts is not None or tag == "object":
            parts = {k: inner(x) for k, x in ctx.parts_of(v).items()}
            return Typed(object_kind(parts), parts=parts, err=v.err)
        kind = inner(Typed(v.kind.elem, F.lit(None).cast(v.kind.elem.sql()))).kind
        if tag == "array":
            return Typed(array_of(kind), F.transform(v.col, lambda x: as_kind(inner(Typed(v.kind.elem, x)), kind).column()), v.err)
        return Typed(map_of(kind), F.transform_values(v.col, lambda _, x: as_kind(inner(Typed(v.kind.elem, x)), kind).column()), v.err)

    return over(value)


@fn("map_keys", "value:obj, recursive?:bool=false", closure=True)
def map_keys(ctx, value: Typed, recursive: Typed, closure: s.Closure):
    """On an object of fields the closure must be known on the driver for each key; else the result is a map."""
    deep = bool(need_const(recursive, "recursive"))

    def renamed(v: Typed) -> Typed:
        kind, m = entries(ctx, v)
        if deep and kind.tag == "map":
            m = F.transform_values(m, lambda _, x: renamed(Typed(kind, x)).column())
        new = F.transform_keys(m, lambda k, _: F.coalesce(body(ctx, closure, Typed(STRING, k), name="map_keys").column(), F.lit("")))
        return Typed(map_of(kind), new, v.err)

    if deep and (value.parts is not None or value.kind.tag == "object"):
        parts = {k: renamed(x) if x.kind.tag in ("object", "map") else x for k, x in ctx.parts_of(value).items()}
        return renamed(Typed(object_kind(parts), parts=parts))
    return renamed(value)


@fn("for_each", "value:obj/arr", closure=True)
def for_each(ctx, value: Typed, closure: s.Closure):
    """The variables (and event fields) that the closure assigns are folded over the elements."""
    if value.kind.tag == "array":
        pairs = F.transform(value.col, lambda x, i: F.struct(i.cast("bigint").alias("k"), x.alias("v")))
        kinds = INT, value.kind.elem
    else:
        kind, m = entries(ctx, value)
        pairs = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("k"), F.try_element_at(m, k).alias("v")))
        kinds = STRING, kind
    # a dry run tells what is assigned, and in which kinds
    names, fields = dict(ctx.env.names), dict(ctx.env.event.parts or {})
    for _ in range(3):
        probe = ctx.env
        ctx.call_closure(closure, Typed(kinds[0], F.lit(None).cast(kinds[0].sql())), Typed(kinds[1], F.lit(None).cast(kinds[1].sql())))
        after = ctx.closed
        changed = [("n", k) for k, v in after.names.items() if k in probe.names and probe.names[k] is not v]
        changed += [("f", k) for k, v in (after.event.parts or {}).items() if (probe.event.parts or {}).get(k) is not v]
        if not changed:
            return const(None)
        held = {}
        for i, (what, k) in enumerate(changed):
            old = names.get(k) if what == "n" else fields.get(k, const(None))
            new = after.names[k] if what == "n" else after.event.parts[k]
            held[what, k] = (f"a{i}", unify(old.kind, new.kind) if old.kind != new.kind else old.kind, old)
    start = F.struct(*[as_kind(old, kind).column().alias(col) for col, kind, old in held.values()])

    def step(acc, pair):
        before = ctx.env
        ctx.env = before.copy()
        parts = dict(before.event.parts or {})
        for (what, k), (col, kind, _) in held.items():
            v = Typed(kind, acc.getField(col))
            if what == "n":
                ctx.env.names[k] = v
            else:
                parts[k] = v
        ctx.env.event = Typed(object_kind(parts), parts=parts)
        ctx.call_closure(closure, Typed(kinds[0], pair["k"]), Typed(kinds[1], pair["v"]))
        after, ctx.env = ctx.closed, before
        return F.struct(*[as_kind(after.names[k] if what == "n" else after.event.parts[k], kind).column().alias(col) for (what, k), (col, kind, _) in held.items()])

    folded = F.aggregate(pairs, start, step)
    parts = dict(ctx.env.event.parts or {})
    for (what, k), (col, kind, _) in held.items():
        v = Typed(kind, folded.getField(col))
        if what == "n":
            ctx.env.names[k] = v
        else:
            parts[k] = v
    if ctx.env.event.parts is not None:
        ctx.env.event = Typed(object_kind(parts), parts=parts)
    return const(None)


def drops(v: Typed, flags: dict) -> object:
    """Whether a value counts as empty."""
    c, tag = v.column() if v.kind != NULL else None, v.kind.tag
    out = F.lit(False)
    if tag == "null":
        return F.lit(bool(flags["null"]))
    if flags["null"] and v.parts is None:
        out = out | c.isNull()
    if tag == "string":
        if flags["string"]:
            out = out | F.coalesce(c == "", F.lit(False))
        if flags["nullish"]:
            out = out | F.coalesce((c == "-") | c.rlike(r"(?U)^\s*$"), F.lit(True))
    if tag == "array" and flags["array"] or tag == "map" and flags["object"]:
        out = out | F.coalesce(F.size(c) == 0, F.lit(False))
    if tag == "any":
        t = json_text(v)
        bad = [x for x, f in (("null", "null"), ('""', "string"), ("{}", "object"), ("[]", "array")) if flags[f]]
        out = out | t.isin(*bad) if bad else out
    return out


@fn("compact", "value:obj/arr, recursive?:bool=true, null?:bool=true, string?:bool=true, object?:bool=true, array?:bool=true, nullish?:bool=false")
def compact(ctx, value: Typed, recursive: Typed, null_: Typed, string: Typed, object_: Typed, array: Typed, nullish: Typed):
    flags = {"null": null_.const, "string": string.const, "object": object_.const, "array": array.const, "nullish": nullish.const}

    def inside(v: Typed) -> Typed:
        return over(v) if recursive.const and v.kind.tag in ("array", "map", "object") else v

    def over(v: Typed) -> Typed:
        if v.kind.tag == "array":
            if v.kind.elem == NULL:
                return v
            kind = inside(Typed(v.kind.elem, F.lit(None).cast(v.kind.elem.sql()))).kind
            return Typed(array_of(kind), F.filter(F.transform(v.col, lambda x: inside(Typed(v.kind.elem, x)).column()), lambda x: ~drops(Typed(kind, x), flags)), v.err)
        kind, m = entries(ctx, v)
        if recursive.const and kind.tag in ("array", "map"):
            m = F.transform_values(m, lambda _, x: inside(Typed(kind, x)).column())
        return Typed(map_of(kind), F.map_filter(m, lambda _, x: ~drops(Typed(kind, x), flags)), v.err)

    return over(value)


@fn("flatten", "value:obj/arr, separator?:str=., except?:arr")
def flatten(ctx, value: Typed, separator: Typed, except_: Typed | None):
    sep, keep = need_const(separator, "separator"), set(need_const(except_, "except") or [])
    if value.kind.tag == "array":
        v = value
        while v.kind.elem.tag == "array":
            v = Typed(v.kind.elem, F.flatten(v.col), v.err)
        return v

    def leaves(v: Typed, prefix: str):
        for k, x in ctx.parts_of(v).items():
            if k not in keep and (x.parts or x.kind.tag == "object" and x.kind.fields):
                yield from leaves(x, prefix + k + sep)
            else:
                yield prefix + k, x

    if value.kind.tag == "map":
        v = value
        if v.kind.elem.tag == "map":
            inner = v.kind.elem.elem
            pairs = F.flatten(F.transform(F.map_entries(v.col), lambda e: F.transform(F.map_entries(e["value"]), lambda f: F.struct(F.concat(e["key"], F.lit(sep), f["key"]), f["value"]))))
            return Typed(map_of(inner), F.map_from_entries(pairs), v.err)
        return v
    parts = dict(leaves(value, ""))
    return Typed(object_kind(parts), parts=parts, err=value.err)


@fn("unflatten", "value:obj, separator?:str=., recursive?:bool=true")
def unflatten(ctx, value: Typed, separator: Typed, recursive: Typed):
    sep, deep = need_const(separator, "separator"), bool(recursive.const)
    if value.kind.tag in ("map", "any"):
        raise CompileError(402, "unflatten takes an object of known fields here")

    def build(items: list[tuple[str, Typed]]) -> Typed:
        groups: dict[str, list[tuple[str | None, Typed]]] = {}
        for k, v in items:
            head, found, rest = k.partition(sep)
            groups.setdefault(head, []).append((rest if found else None, v))
        parts = {}
        for head, rows in groups.items():
            nested = [(r, v) for r, v in rows if r is not None]
            if nested:
                parts[head] = build(nested) if deep else Typed(object_kind(dict(nested)), parts=dict(nested))
            else:
                v = rows[-1][1]
                parts[head] = build(list(ctx.parts_of(v).items())) if deep and (v.parts is not None or v.kind.tag == "object") else v
        return Typed(object_kind(parts), parts=parts)

    return build(sorted(ctx.parts_of(value).items()))


@fn("unnest", "path:arr", raw=True)
def unnest(ctx, path: s.Node):
    """One copy of the root for each element of the array at the path, with the element in its place; assigned to `.` it makes rows."""
    if not isinstance(path, s.Query) or not path.path:
        raise CompileError(402, "unnest takes a path")
    root = ctx.env.event if path.root == "." else ctx.env.meta if path.root == "%" else ctx.expr(path.root)
    v = ctx.get(root, path.path)
    if v.kind.tag == "any":
        v = from_any(v, "array", "unnest")
    if v.kind.tag != "array":
        return Typed(array_of(STRING), F.lit(None).cast("array<string>"), F.lit("value is not an array"))

    def each(x):
        return ctx.insert(root, path.path, Typed(v.kind.elem, x))

    kind = object_kind(each(F.lit(None).cast(v.kind.elem.sql())).parts)
    return Typed(array_of(kind), F.transform(v.col, lambda x: each(x).column()), first_error(v.err, F.when(v.col.isNull(), F.lit("expected array, got null"))))


def target_of(ctx, node: s.Node):
    if not isinstance(node, (s.Query, s.Variable)):
        raise CompileError(402, "the argument must be a path")
    if isinstance(node, s.Variable):
        return ctx.env.names.get(node.name, const(None)), [], lambda v: ctx.env.names.__setitem__(node.name, v)
    if node.root == ".":
        return ctx.env.event, node.path, lambda v: setattr(ctx.env, "event", v)
    if node.root == "%":
        return ctx.env.meta, node.path, lambda v: setattr(ctx.env, "meta", v)
    if isinstance(node.root, s.Variable):
        return ctx.env.names.get(node.root.name, const(None)), node.path, lambda v: ctx.env.names.__setitem__(node.root.name, v)
    return ctx.expr(node.root), node.path, lambda v: None


@fn("del", "target:any, compact?:bool=false", raw=True)
def del_(ctx, target: s.Node, compact: s.Node | Typed | None = None):
    tight = isinstance(compact, s.Literal) and compact.value is True
    root, path, store = target_of(ctx, target)
    ctx.changing(target)
    old = ctx.get(root, path)
    if path:
        store(ctx.remove(root, path, tight))
    elif isinstance(target, s.Query):
        store(Typed(Kind("object", fields=()), parts={}))
    return old


@fn("exists", "field:any", raw=True)
def exists(ctx, field: s.Node):
    """A field of known kind exists where its column does; in a dynamic object, where the key is there."""
    root, path, _ = target_of(ctx, field)
    v = root
    for i, p in enumerate(path):
        tag = v.kind.tag
        if v.parts is not None or tag == "object":
            parts = ctx.parts_of(v)
            if p not in parts:
                return const(False)
        elif tag in ("map", "any") and isinstance(p, str):
            m = v.col if tag == "map" else F.try_variant_get(v.col, "$", "map<string,variant>")
            if i == len(path) - 1:
                return Typed(BOOL, F.coalesce(F.map_contains_key(m, F.lit(p)), F.lit(False)))
        elif tag in ("array", "any"):
            a = v.col if tag == "array" else F.try_variant_get(v.col, "$", "array<variant>")
            if i == len(path) - 1:
                return Typed(BOOL, F.coalesce(F.size(a) > p if p >= 0 else F.size(a) >= -p, F.lit(False)))
        else:
            return const(False)
        v = ctx.get(v, [p])
    return const(True)


def literal_path(path: Typed) -> list:
    got = need_const(path, "path")
    for p in got:
        if isinstance(p, bool) or not isinstance(p, (str, int)):
            raise CompileError(402, "path segment must be either string or integer")
    return got


@fn("get", "value:obj/arr, path:arr")
def get(ctx, value: Typed, path: Typed):
    if path.is_const:
        out = ctx.get(value, literal_path(path))
        return out.with_err(first_error(out.err, F.when(F.lit(False), F.lit(""))))
    kind, m = entries(ctx, value)
    if path.kind.elem != STRING:
        raise CompileError(402, "a dynamic path must be of strings")
    return Typed(kind, F.try_element_at(m, F.get(path.col, F.lit(0))), F.when(F.size(path.col) != 1, F.lit("a dynamic path has one segment here")))


@fn("set", "value:obj/arr, path:arr, data:any")
def set_(ctx, value: Typed, path: Typed, data: Typed):
    out = ctx.insert(value, literal_path(path), data)
    return out.with_err(F.when(F.lit(False), F.lit("")))


@fn("remove", "value:obj/arr, path:arr, compact?:bool=false")
def remove(ctx, value: Typed, path: Typed, compact: Typed):
    out = ctx.remove(value, literal_path(path), bool(compact.const))
    return replace(out, err=F.when(F.lit(False), F.lit("")))
