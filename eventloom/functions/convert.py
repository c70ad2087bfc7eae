"""Conversions, coercions and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import BOOL, FLOAT, INT, NULL, STRING, TIME, Kind, Typed, const, first_error, float_text, time_text, to_text

from .patterns import translated
from .registry import arrow, fn, need_const, variant_tag

INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def fail(cond: Column, *message) -> Column:
    return F.when(cond, F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in message]))


def saturated(x: Column) -> Column:
    """A double as a long, as near as it goes."""
    return F.when(x >= 9.223372036854775e18, F.lit(2**63 - 1)).when(x <= -9.223372036854775e18, F.lit(-(2**63))).otherwise(x.try_cast("bigint")).cast("bigint")


def by_variant(v: Typed, each: dict[str, Column], kind: Kind, what: str) -> Typed:
    """One of each by the kind of a VARIANT; another kind is an error."""
    tag = variant_tag(v.col)
    out, known = F.lit(None).cast(kind.sql()), F.lit(False)
    for name, c in each.items():
        out = F.when(tag == name, c).otherwise(out)
        known = known | (tag == name)
    bad = F.when(~known, F.concat(F.lit(f"unable to coerce "), tag, F.lit(f" into {what}"))).when(out.isNull(), F.lit(f"unable to coerce value into {what}"))
    return Typed(kind, out, first_error(v.err, bad))


def get(v: Typed, sql: str) -> Column:
    return F.try_variant_get(v.col, "$", sql)


def int_of_text(c: Column) -> Column:
    return F.when(c.rlike(INT_TEXT), c.try_cast("decimal(38,0)").try_cast("bigint"))


@fn("to_int", "value:any")
def to_int(ctx, value: Typed):
    tag, c = value.kind.tag, value.column()
    if tag == "any":
        return by_variant(value, {"integer": get(value, "bigint"), "float": saturated(get(value, "double")), "boolean": get(value, "boolean").cast("bigint"), "null": F.lit(0).cast("bigint"), "string": int_of_text(get(value, "string"))}, INT, "integer")
    if tag == "int":
        return value
    if tag == "float":
        return Typed(INT, saturated(c), value.err)
    if tag == "bool":
        return Typed(INT, c.cast("bigint"), value.err)
    if tag == "null":
        return const(0)
    if tag == "time":
        return Typed(INT, F.unix_seconds(c), value.err)
    if tag == "string":
        got = int_of_text(c)
        return Typed(INT, got, first_error(value.err, fail(got.isNull() & c.isNotNull(), 'Invalid integer "', c, '": invalid digit found in string')))
    return Typed(INT, F.lit(None).cast("bigint"), F.lit(f"unable to coerce {value.kind} into integer"))


@fn("to_float", "value:any")
def to_float(ctx, value: Typed):
    tag, c = value.kind.tag, value.column()
    text = lambda x: F.when(x.rlike(FLOAT_TEXT), x.try_cast("double"))
    if tag == "any":
        return by_variant(value, {"integer": get(value, "double"), "float": get(value, "double"), "boolean": get(value, "boolean").cast("double"), "null": F.lit(0.0), "string": text(get(value, "string"))}, FLOAT, "float")
    if tag in ("int", "bool"):
        return Typed(FLOAT, c.cast("double"), value.err)
    if tag == "float":
        return value
    if tag == "null":
        return const(0.0)
    if tag == "time":
        return Typed(FLOAT, F.unix_micros(c) / 1e6, value.err)
    if tag == "string":
        return Typed(FLOAT, text(c), first_error(value.err, fail(text(c).isNull() & c.isNotNull(), 'Invalid floating point number "', c, '": invalid float literal')))
    return Typed(FLOAT, F.lit(None).cast("double"), F.lit(f"unable to coerce {value.kind} into float"))


@fn("to_bool", "value:any")
def to_bool(ctx, value: Typed):
    tag, c = value.kind.tag, value.column()

    def text(x):
        low = F.lower(x)
        return F.when(low.isin("t", "true", "y", "yes"), True).when(low.isin("f", "false", "n", "no", "0"), False).when(x.rlike(INT_TEXT), int_of_text(x) != 0)

    if tag == "any":
        return by_variant(value, {"integer": get(value, "bigint") != 0, "float": get(value, "double") != 0, "boolean": get(value, "boolean"), "null": F.lit(False), "string": text(get(value, "string"))}, BOOL, "boolean")
    if tag == "bool":
        return value
    if tag in ("int", "float"):
        return Typed(BOOL, c != 0, value.err)
    if tag == "null":
        return const(False)
    if tag == "string":
        return Typed(BOOL, text(c), first_error(value.err, fail(text(c).isNull() & c.isNotNull(), 'Invalid boolean value "', c, '"')))
    return Typed(BOOL, F.lit(None).cast("boolean"), F.lit(f"unable to coerce {value.kind} into boolean"))


@fn("to_string", "value:any")
def to_string(ctx, value: Typed):
    tag = value.kind.tag
    if tag in ("array", "object", "map"):
        return Typed(STRING, F.lit(None).cast("string"), F.lit(f"unable to coerce {value.kind} into string"))
    if tag == "any":
        return by_variant(value, {"integer": get(value, "string"), "float": float_text(get(value, "double")), "boolean": get(value, "string"), "null": F.lit(""), "string": get(value, "string")}, STRING, "string")
    return Typed(STRING, to_text(value), value.err, nullable=False)


@fn("to_regex", "value:str")
def to_regex(ctx, value: Typed):
    if value.is_const:
        try:
            translated(value.const)
            wrong = F.when(F.lit(False), F.lit(""))
        except CompileError as e:
            wrong = F.lit(e.message)
        return Typed(Kind("regex"), None, wrong, const=value.const)
    return Typed(Kind("regex"), value.col, F.when(F.lit(False), F.lit("")))


@fn("from_unix_timestamp", "value:int, unit?:str=seconds")
def from_unix_timestamp(ctx, value: Typed, unit: Typed):
    each = {"seconds": F.timestamp_seconds, "milliseconds": F.timestamp_millis, "microseconds": F.timestamp_micros, "nanoseconds": None}
    name = need_const(unit, "unit")
    if name not in each:
        raise CompileError(403, f"invalid enum variant: {name}")
    if name == "nanoseconds":
        micros = ((value.col - F.pmod(value.col, F.lit(1000))) / 1000).cast("bigint")
        return Typed(TIME, F.timestamp_micros(micros), value.err)
    return Typed(TIME, each[name](value.col), value.err)


@fn("to_unix_timestamp", "value:ts, unit?:str=seconds")
def to_unix_timestamp(ctx, value: Typed, unit: Typed):
    each = {"seconds": F.unix_seconds, "milliseconds": F.unix_millis, "microseconds": F.unix_micros, "nanoseconds": lambda c: F.unix_micros(c) * 1000}
    name = need_const(unit, "unit")
    if name not in each:
        raise CompileError(403, f"invalid enum variant: {name}")
    return Typed(INT, each[name](value.col), value.err)


# syslog's facilities and severities, by code.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron local0 local1 local2 local3 local4 local5 local6 local7".split()
LEVELS = "emerg alert crit err warning notice info debug".split()
ALIASES = {"panic": 0, "error": 3, "warn": 4}


def lookup(keys, values, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(keys, values, strict=True) for x in pair]), c)


@fn("to_syslog_facility", "value:int")
def to_syslog_facility(ctx, value: Typed):
    got = lookup(range(24), FACILITIES, value.col.cast("int"))
    return Typed(STRING, got, fail(got.isNull() & value.col.isNotNull(), "facility code ", value.col, " not valid"))


@fn("to_syslog_facility_code", "value:str")
def to_syslog_facility_code(ctx, value: Typed):
    got = lookup(FACILITIES, range(24), value.col).cast("bigint")
    return Typed(INT, got, fail(got.isNull() & value.col.isNotNull(), "syslog facility '", value.col, "' not valid"))


@fn("to_syslog_level", "value:int")
def to_syslog_level(ctx, value: Typed):
    got = lookup(range(8), LEVELS, value.col.cast("int"))
    return Typed(STRING, got, fail(got.isNull() & value.col.isNotNull(), "severity level ", value.col, " not valid"))


@fn("to_syslog_severity", "value:str")
def to_syslog_severity(ctx, value: Typed):
    got = lookup([*LEVELS, *ALIASES], [*range(8), *ALIASES.values()], value.col).cast("bigint")
    return Typed(INT, got, fail(got.isNull() & value.col.isNotNull(), "syslog level ", value.col, " not valid"))


# strftime's specifiers as Java's pattern letters.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "z": "xx", "Z": "VV", "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS", ".f": "[.SSSSSSSSS][.SSSSSS][.SSS]", "%": "%", "n": "\n", "t": "\t", ":z": "xxx", "c": "EEE MMM d HH:mm:ss yyyy", "v": "d-MMM-yyyy", "x": "MM/dd/yy", "X": "HH:mm:ss", "r": "hh:mm:ss a", "k": "H", "l": "h", "-d": "d", "-m": "M", "-H": "H", "-I": "h", "-M": "m", "-S": "s"}


def java_format(pattern: str, parsing: bool = False) -> str | None:
    """strftime as a Java pattern; None where Java can't say it."""
    out, i, text = [], 0, ""

    def flush():
        nonlocal text
        if text:
            out.append("".join(f"'{t}'" if t.isalpha() else t if t not in "[]{}#'" else ("''" if t == "'" else f"'{t}'") for t in _runs(text)))
            text = ""

    while i < len(pattern):
        if pattern[i] != "%":
            text += pattern[i]
            i += 1
            continue
        key = next((k for k in sorted(STRFTIME, key=len, reverse=True) if pattern.startswith(k, i + 1)), None)
        if key is None:
            if pattern.startswith("+", i + 1):
                flush()
                out.append("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]xxx")
                i += 2
                continue
            return None
        flush()
        java = STRFTIME[key]
        if parsing:
            java = {"f": "[SSSSSSSSS][SSSSSS][SSS]", "z": "xx", "e": "d"}.get(key, java)
        elif key == "+":
            java = "xxx"
        out.append(java)
        i += 1 + len(key)
    flush()
    return "".join(out)


def _runs(text: str) -> list[str]:
    import re

    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def strftime(c: Column, pattern: str, zone: str | None) -> Column:
    """Text of a time; specifiers Java lacks (%s, %u, %w) are made of their own."""
    import re

    local = c if zone in (None, "UTC") else F.from_utc_timestamp(c, zone)
    pieces = []
    for part in re.split(r"(%s|%u|%w|%C|%V|%G|%U|%z|%:z|%Z|%P|%\+)", pattern):
        if part == "%s":
            pieces.append(F.unix_seconds(c).cast("string"))
        elif part == "%u":
            pieces.append((F.weekday(local) + 1).cast("string"))
        elif part == "%w":
            pieces.append((F.dayofweek(local) - 1).cast("string"))
        elif part == "%V":
            pieces.append(F.lpad(F.weekofyear(local).cast("string"), 2, "0"))
        elif part == "%G":
            pieces.append(F.extract(F.lit("YEAROFWEEK"), local).cast("string"))
        elif part == "%C":
            pieces.append(F.lpad(F.floor(F.year(local) / 100).cast("string"), 2, "0"))
        elif part == "%P":
            pieces.append(F.lower(F.date_format(local, "a")))
        elif part in ("%z", "%:z"):
            minutes = ((F.unix_seconds(local) - F.unix_seconds(c)) / 60).cast("int")
            m = F.abs(minutes)
            pieces.append(F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((m / 60).cast("int").cast("string"), 2, "0"), F.lit(":" if part == "%:z" else ""), F.lpad((m % 60).cast("string"), 2, "0")))
        elif part == "%+":
            pieces.append(F.regexp_replace(time_text(local), "Z$", "+00:00"))
        elif part == "%Z":
            pieces.append(F.lit(zone or "UTC"))
        elif part:
            java = java_format(part)
            if java is None:
                raise CompileError(402, f"invalid format {pattern!r}")
            pieces.append(F.date_format(local, java) if "[" not in java else F.date_format(local, java.split("[")[0] + ".SSSSSS"))
    return F.concat(*pieces) if pieces else F.lit("")


@fn("format_timestamp", "value:ts, format:str, timezone?:str")
def format_timestamp(ctx, value: Typed, format: Typed, timezone: Typed | None):
    return Typed(STRING, strftime(value.col, need_const(format, "format"), need_const(timezone, "timezone")), value.err)


def parsed_time(c: Column, pattern: str, zone: str | None) -> Column:
    """A time from text; null where it doesn't match."""
    if pattern == "%s":
        return F.timestamp_seconds(c.try_cast("bigint"))
    if pattern in ("%+",):
        return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)$"), c.try_cast("timestamp"))
    java = java_format(pattern, parsing=True)
    if java is None:
        raise CompileError(402, f"invalid format {pattern!r}")
    text = F.regexp_replace(c, r"(?i)(?<=[T ]\d\d:\d\d:\d\d)Z$", "+0000") if "xx" in java and "xxx" not in java else c
    if "xx" in java and "xxx" not in java:
        text = F.regexp_replace(text, r"([+-]\d\d):(\d\d)$", "$1$2")
    got = F.try_to_timestamp(text, F.lit(java))
    if zone not in (None, "UTC") and "x" not in java and "VV" not in java:
        got = F.to_utc_timestamp(got, zone)
    return got


@fn("parse_timestamp", "value:str/ts, format:str, timezone?:str")
def parse_timestamp(ctx, value: Typed, format: Typed, timezone: Typed | None):
    none = F.when(F.lit(False), F.lit(""))
    if value.kind == TIME:
        return Typed(TIME, value.col, none)
    got = parsed_time(value.col, need_const(format, "format"), need_const(timezone, "timezone"))
    return Typed(TIME, got, fail(got.isNull() & value.col.isNotNull(), 'Invalid timestamp "', value.col, '": input contains invalid characters'))


@fn("now", "")
def now(ctx):
    return Typed(TIME, F.current_timestamp(), nullable=False)


UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "cs": 1e-2, "ds": 1e-1, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}


@fn("parse_duration", "value:str, unit:str")
def parse_duration(ctx, value: Typed, unit: Typed):
    to = UNITS.get(need_const(unit, "unit"))
    if to is None:
        raise CompileError(403, f"unknown unit format: '{unit.const}'")
    token = r"([0-9]*\.?[0-9]+|[0-9]+\.?)\s*(ns|us|µs|ms|cs|ds|s|m|h|d|w)"
    numbers = F.regexp_extract_all(value.col, F.lit(token), F.lit(1))
    names = F.regexp_extract_all(value.col, F.lit(token), F.lit(2))
    table = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    total = F.aggregate(F.zip_with(numbers, names, lambda n, u: n.cast("double") * F.try_element_at(table, u) / to), F.lit(0.0), lambda a, x: a + x)
    good = value.col.rlike(f"^(?:{token})+$")
    return Typed(FLOAT, F.when(good, total), fail(~good, "unable to parse duration: '", value.col, "'"))


BINARY_SIZES = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6, "KB": 1, "kB": 1, "MB": 2, "GB": 3, "TB": 4, "PB": 5, "EB": 6}
DECIMAL_SIZES = {"B": 0, "kB": 1, "KB": 1, "MB": 2, "GB": 3, "TB": 4, "PB": 5, "EB": 6}


@fn("parse_bytes", "value:str, unit:str, base?:str=2")
def parse_bytes(ctx, value: Typed, unit: Typed, base: Typed):
    b = str(need_const(base, "base"))
    if b not in ("2", "10"):
        raise CompileError(403, f"invalid base: {b}")
    sizes = {k: float((1024 if b == "2" else 1000) ** n) for k, n in (BINARY_SIZES if b == "2" else DECIMAL_SIZES).items()}
    to = sizes.get(need_const(unit, "unit"))
    if to is None:
        raise CompileError(403, f"unknown unit format: '{unit.const}'")
    p = r"^([0-9]*\.?[0-9]+|[0-9]+\.?)\s*([A-Za-z]{1,3})$"
    factor = F.try_element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v)]), F.regexp_extract(value.col, p, 2))
    got = F.regexp_extract(value.col, p, 1).try_cast("double") * factor / to
    return Typed(FLOAT, got, fail(got.isNull() & value.col.isNotNull(), "unable to parse bytes: '", value.col, "'"))
