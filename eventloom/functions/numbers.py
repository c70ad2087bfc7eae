"""Number and geography functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import FLOAT, INT, STRING, Typed, float_text, object_of, value

from .registry import fn, need_const


@fn("abs", "value:int/flt")
def abs_(ctx, value: Typed):
    if value.kind == INT:
        return Typed(INT, F.when(value.col < 0, F.try_subtract(F.lit(0).cast("bigint"), value.col)).otherwise(value.col), value.err)
    return Typed(FLOAT, F.abs(value.col), value.err)


def rounding(name: str, each):
    @fn(name, "value:int/flt, precision?:int=0")
    def run(ctx, value: Typed, precision: Typed):
        if value.kind == INT:
            return value
        scale = F.pow(F.lit(10.0), precision.col.cast("double"))
        return Typed(FLOAT, each(value.col * scale).cast("double") / scale, value.err)

    return run


def half_away(x):
    return F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")


rounding("ceil", lambda x: F.ceil(x))
rounding("floor", lambda x: F.floor(x))
rounding("round", half_away)


@fn("mod", "value:int/flt, modulus:int/flt")
def mod(ctx, value: Typed, modulus: Typed):
    zero = None if modulus.is_const and modulus.const != 0 else F.when(modulus.col == 0, F.lit("can't calculate remainder of zero"))
    if value.kind == modulus.kind == INT:
        return Typed(INT, F.try_mod(value.col, modulus.col), value.err if zero is None else zero)
    return Typed(FLOAT, F.try_mod(value.col.cast("double"), modulus.col.cast("double")), value.err if zero is None else zero)


@fn("format_int", "value:int, base?:int=10")
def format_int(ctx, value: Typed, base: Typed):
    b = need_const(base, "base")
    if not 2 <= b <= 36:
        return Typed(STRING, F.lit(None).cast("string"), F.lit(f"invalid base {b}: must be be between 2 and 36 (inclusive)"))
    if b == 10:
        return Typed(STRING, value.col.cast("string"), F.when(F.lit(False), F.lit("")))
    text = F.lower(F.conv(F.abs(value.col.cast("decimal(20,0)")).cast("string"), 10, b))
    return Typed(STRING, F.when(value.col < 0, F.concat(F.lit("-"), text)).otherwise(text), F.when(F.lit(False), F.lit("")))


@fn("format_number", "value:int/flt, scale?:int, decimal_separator?:str=., grouping_separator?:str")
def format_number(ctx, value: Typed, scale: Typed | None, decimal_separator: Typed, grouping_separator: Typed | None):
    n, dot, comma = need_const(scale, "scale"), need_const(decimal_separator, "decimal_separator"), need_const(grouping_separator, "grouping_separator")
    text = value.col.cast("string") if value.kind == INT else float_text(value.col)
    sign = F.when(text.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(text, "^-", "")
    whole, part = F.substring_index(bare, ".", 1), F.when(bare.contains("."), F.substring_index(bare, ".", -1)).otherwise("")
    if n is not None:
        part = F.rpad(F.substring(part, 1, n), n, "0") if n > 0 else F.lit("")
    if comma:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", comma.replace("\\", "\\\\").replace("$", "\\$"))
    return Typed(STRING, F.concat(sign, whole, F.when(part != "", F.concat(F.lit(dot), part)).otherwise("")), value.err)


@fn("parse_int", "value:str, base?:int")
def parse_int(ctx, value: Typed, base: Typed | None):
    b = need_const(base, "base")
    if b is not None and not 2 <= b <= 36:
        raise CompileError(402, f"invalid base {b}: must be be between 2 and 36 (inclusive)")
    sign = F.when(value.col.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(value.col, r"^[+-]", "")

    def digits(text, n):
        allowed = "0123456789abcdefghijklmnopqrstuvwxyz"[:n]
        good = F.lower(text).rlike(f"^[{allowed}]+$")
        number = text if n == 10 else F.conv(F.when(good & (F.length(text) <= 64), text), n, 10)
        return F.when(good, F.concat(sign, number).try_cast("decimal(38,0)").try_cast("bigint"))

    if b is not None:
        got = digits(bare, b)
    else:
        rest = F.substring(bare, F.lit(3), F.length(bare))
        got = F.when(bare.startswith("0b"), digits(rest, 2)).when(bare.startswith("0o"), digits(rest, 8)).when(bare.startswith("0x"), digits(rest, 16)).when(bare.rlike("^0."), digits(F.substring(bare, F.lit(2), F.length(bare)), 8)).otherwise(digits(bare, 10))
    return Typed(INT, got, F.when(got.isNull() & value.col.isNotNull(), F.lit("could not parse integer")))


@fn("haversine", "latitude1:flt/int, longitude1:flt/int, latitude2:flt/int, longitude2:flt/int, measurement_unit?:str=kilometers")
def haversine(ctx, latitude1: Typed, longitude1: Typed, latitude2: Typed, longitude2: Typed, measurement_unit: Typed):
    radius = {"kilometers": 6371.0088, "miles": 6371.0088 * 0.6213712}.get(need_const(measurement_unit, "measurement_unit"))
    if radius is None:
        raise CompileError(403, "invalid enum variant")
    la1, lo1, la2, lo2 = (F.radians(v.col.cast("double")) for v in (latitude1, longitude1, latitude2, longitude2))
    a = F.pow(F.sin((la2 - la1) / 2), F.lit(2.0)) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), F.lit(2.0))
    distance = half_away(2 * F.asin(F.sqrt(a)) * radius * 1e7) / 1e7
    bearing = F.degrees(F.atan2(F.sin(lo2 - lo1) * F.cos(la2), F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(lo2 - lo1)))
    bearing = half_away(F.pmod(bearing + 360.0, F.lit(360.0)) * 1e3) / 1e3
    parts = {"bearing": Typed(FLOAT, bearing), "distance": Typed(FLOAT, distance)}
    return Typed(object_of(bearing=FLOAT, distance=FLOAT), parts=parts)
