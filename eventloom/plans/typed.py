"""Typed expressions: a Catalyst column for the value, one for the error, and what is known of the kind."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "time": "timestamp", "null": "void", "any": "variant", "binary": "binary"}


@dataclass(frozen=True)
class Kind:
    """string, int, float, bool, time, null, binary (bytes that aren't text), any (VARIANT), regex; array and map of an element kind; object of fields."""

    tag: str
    elem: Kind | None = None
    fields: tuple[tuple[str, Kind], ...] | None = None

    def sql(self) -> str:
        if self.tag == "array":
            return f"array<{self.elem.sql()}>"
        if self.tag == "map":
            return f"map<string,{self.elem.sql()}>"
        if self.tag == "object":
            return "struct<" + ",".join(f"`{n}`:{k.sql()}" for n, k in self.fields) + ">"
        return SCALARS[self.tag]

    def __str__(self) -> str:
        if self.tag == "array":
            return f"array<{self.elem}>"
        if self.tag == "map":
            return "object"
        if self.tag == "object" and self.fields is not None:
            return "{ " + ", ".join(f"{n}: {k}" for n, k in self.fields) + " }"
        return {"int": "integer", "bool": "boolean", "time": "timestamp", "binary": "string"}.get(self.tag, self.tag)


STRING, INT, FLOAT, BOOL, TIME, NULL, ANY, BINARY, REGEX = (Kind(t) for t in ("string", "int", "float", "bool", "time", "null", "any", "binary", "regex"))


def array_of(kind: Kind) -> Kind:
    return Kind("array", kind)


def map_of(kind: Kind) -> Kind:
    return Kind("map", kind)


def object_of(**fields: Kind) -> Kind:
    return Kind("object", fields=tuple(fields.items()))


def kind_of(t: T.DataType) -> Kind:
    """The kind of a Spark type."""
    if isinstance(t, T.StructType):
        return Kind("object", fields=tuple((f.name, kind_of(f.dataType)) for f in t.fields))
    if isinstance(t, T.ArrayType):
        return array_of(kind_of(t.elementType))
    if isinstance(t, T.MapType):
        return map_of(kind_of(t.valueType))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(t, T.BinaryType):
        return BINARY
    if isinstance(t, T.VariantType):
        return ANY
    return NULL if isinstance(t, T.NullType) else STRING


NO_CONST = object()


@dataclass
class Typed:
    """A value. parts: an object whose fields stand in columns of their own. nullable: whether it may be null."""

    kind: Kind
    col: Column | None = None
    err: Column | None = None
    const: object = NO_CONST
    parts: dict[str, Typed] | None = None
    nullable: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def is_const(self) -> bool:
        return self.const is not NO_CONST

    def column(self) -> Column:
        if self.parts is not None:
            if not self.parts:
                return F.struct(F.lit(None).cast("string").alias("_empty"))
            return F.struct(*[v.column().cast(v.kind.sql()).alias(n) if v.kind.tag == "null" else v.column().alias(n) for n, v in sorted(self.parts.items())])
        return self.col

    def with_err(self, err: Column | None) -> Typed:
        return replace(self, err=err)


def value(kind: Kind, col: Column, *sources: Typed, nullable: bool = True, err: Column | None = None) -> Typed:
    """A value made of sources: it has an error where one of them has, before its own."""
    return Typed(kind, col, first_error(*[s.err for s in sources], err), nullable=nullable)


def bound(c: Column, use) -> Column:
    """use(c) with c made once, however often use takes it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def first_error(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def const(v: object) -> Typed:
    """A literal."""
    kind = NULL if v is None else BOOL if isinstance(v, bool) else INT if isinstance(v, int) else FLOAT if isinstance(v, float) else STRING
    return Typed(kind, F.lit(v).cast(kind.sql()) if v is not None else F.lit(None), const=v, nullable=v is None)


def object_kind(parts: dict[str, Typed]) -> Kind:
    return Kind("object", fields=tuple((n, v.kind) for n, v in sorted(parts.items())))


def lossy(b: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(b.cast("string"))


def float_text(x: Column) -> Column:
    """A double as the shortest decimal text without an exponent and without a trailing .0."""
    text = x.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    wide = F.regexp_replace(F.regexp_replace(F.format_string("%.0f", x), "^-0$", "-0"), "", "")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.", "")
    zeros = F.regexp_extract(text, r"E-([0-9]+)$", 1).cast("int")
    tiny = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), zeros - 1), F.regexp_replace(digits, "0+$", ""))
    return F.when(~text.contains("E"), plain).when(text.contains("E-"), tiny).otherwise(wide)


def time_text(t: Column) -> Column:
    """RFC 3339 in UTC with as many sub-second digits (0, 3, 6) as are needed."""
    head = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    tail = F.when(micros == 0, "").when(micros % 1000 == 0, F.format_string(".%03d", (micros / 1000).cast("long"))).otherwise(F.format_string(".%06d", micros))
    return F.concat(head, tail, F.lit("Z"))


def to_text(v: Typed) -> Column:
    """A scalar as text, null as the empty string."""
    tag, c = v.kind.tag, v.column()
    if tag == "null":
        return F.lit("")
    if tag == "float":
        c = float_text(c)
    elif tag == "time":
        c = time_text(c)
    elif tag == "any":
        c = F.when(F.is_variant_null(c), "").otherwise(F.try_variant_get(c, "$", "string"))
    elif tag == "binary":
        c = lossy(c)
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def jsonable(v: Typed) -> Column:
    """The value with times as text and bytes as text, so that to_json writes it as the language does."""

    def fix(kind: Kind, c: Column) -> Column:
        if kind.tag == "time":
            return time_text(c)
        if kind.tag == "binary":
            return lossy(c)
        if kind.tag == "array" and plain(kind.elem) is False:
            return F.transform(c, lambda x: fix(kind.elem, x))
        if kind.tag == "map" and plain(kind.elem) is False:
            return F.transform_values(c, lambda _, x: fix(kind.elem, x))
        if kind.tag == "object":
            if not kind.fields:
                return c
            return F.when(c.isNotNull(), F.struct(*[fix(k, c.getField(n)).cast("string").alias(n) if k.tag == "null" else fix(k, c.getField(n)).alias(n) for n, k in sorted(kind.fields)]))
        return c

    return fix(v.kind, v.column())


def plain(kind: Kind) -> bool:
    return kind.tag not in ("time", "binary", "object") and (kind.elem is None or plain(kind.elem))


def json_text(v: Typed) -> Column:
    """Compact JSON with keys in order; null is null."""
    tag = v.kind.tag
    if tag == "null":
        return F.lit("null")
    if tag in ("int", "bool"):
        return F.coalesce(v.column().cast("string"), F.lit("null"))
    if tag == "float":
        text = float_text(v.column())
        return F.coalesce(F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0"))), F.lit("null"))
    if tag in ("string", "time", "binary"):
        c = jsonable(v)
        quoted = F.to_json(F.array(c))
        return F.coalesce(F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)), F.lit("null"))
    if tag == "any":
        return F.coalesce(F.to_json(v.column()), F.lit("null"))
    if tag == "object" and not v.kind.fields:
        return F.lit("{}")
    if tag == "array" and v.kind.elem.tag == "null":
        return F.lit("[]") if v.const == [] else F.concat(F.lit("["), F.array_join(F.transform(v.column(), lambda _: F.lit("null")), ","), F.lit("]"))
    c = jsonable(v)
    body = F.to_json(F.to_variant_object(c)) if tag != "map" else F.to_json(F.to_variant_object(c))
    return F.coalesce(body, F.lit("null"))


def to_any(v: Typed) -> Typed:
    """The value as a VARIANT."""
    if v.kind.tag == "any":
        return v
    return Typed(ANY, F.parse_json(json_text(v)), v.err)


def unify(a: Kind, b: Kind) -> Kind:
    """A kind that holds values of both; any where they differ in more than being null."""
    if a == b:
        return a
    if a.tag == "null":
        return b
    if b.tag == "null":
        return a
    if a.tag == b.tag == "array":
        return array_of(unify(a.elem, b.elem))
    if a.tag == b.tag == "map":
        return map_of(unify(a.elem, b.elem))
    return ANY


def as_kind(v: Typed, kind: Kind) -> Typed:
    """v in a kind that unify() gave."""
    if v.kind == kind:
        return replace(v, col=v.column(), parts=None) if v.parts is not None else v
    if kind.tag == "any" and v.kind.tag != "null":
        return to_any(v)
    if v.kind.tag == "null" or v.kind.tag == "array" and v.kind.elem.tag == "null":
        return Typed(kind, v.column().cast(kind.sql()), v.err)
    if kind.tag == "any":
        return to_any(v)
    if kind.tag == "array":
        return Typed(kind, F.transform(v.column(), lambda x: as_kind(Typed(v.kind.elem, x), kind.elem).column()), v.err)
    if kind.tag == "map":
        return Typed(kind, F.transform_values(v.column(), lambda _, x: as_kind(Typed(v.kind.elem, x), kind.elem).column()), v.err)
    return Typed(kind, v.column().cast(kind.sql()), v.err)


def default_of(kind: Kind) -> Column:
    """What the value target gets when the call fails."""
    zero = {"string": F.lit(""), "int": F.lit(0).cast("bigint"), "float": F.lit(0.0), "bool": F.lit(False), "time": F.timestamp_seconds(F.lit(0)), "binary": F.lit(b"")}
    if kind.tag in zero:
        return zero[kind.tag]
    if kind.tag == "array":
        return F.array().cast(kind.sql())
    return F.lit(None).cast(kind.sql())
