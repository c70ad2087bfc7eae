"""String functions."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, BOOL, FLOAT, INT, NULL, STRING, Kind, Typed, array_of, const, lossy, default_of, to_text, value

from .patterns import python, translated
from .registry import arrow, fn, from_any, need_const


def plain(v: Typed) -> Column:
    return v.column()


@fn("upcase", "value:str")
def upcase(ctx, value: Typed):
    return Typed(STRING, F.upper(value.col), value.err)


@fn("downcase", "value:str")
def downcase(ctx, value: Typed):
    return Typed(STRING, F.lower(value.col), value.err)


def folded(v: Typed, sensitive: Typed) -> Column:
    if sensitive.is_const:
        return v.col if sensitive.const else F.lower(v.col)
    return F.when(sensitive.col, v.col).otherwise(F.lower(v.col))


@fn("contains", "value:str, substring:str, case_sensitive?:bool=true")
def contains(ctx, value: Typed, substring: Typed, case_sensitive: Typed):
    return Typed(BOOL, F.contains(folded(value, case_sensitive), folded(substring, case_sensitive)), value.err)


@fn("starts_with", "value:str, substring:str, case_sensitive?:bool=true")
def starts_with(ctx, value: Typed, substring: Typed, case_sensitive: Typed):
    return Typed(BOOL, F.startswith(folded(value, case_sensitive), folded(substring, case_sensitive)), value.err)


@fn("ends_with", "value:str, substring:str, case_sensitive?:bool=true")
def ends_with(ctx, value: Typed, substring: Typed, case_sensitive: Typed):
    return Typed(BOOL, F.endswith(folded(value, case_sensitive), folded(substring, case_sensitive)), value.err)


@fn("contains_all", "value:str, substrings:arr, case_sensitive?:bool=true")
def contains_all(ctx, value: Typed, substrings: Typed, case_sensitive: Typed):
    text = folded(value, case_sensitive)
    if substrings.kind.elem.tag not in ("string", "null"):
        raise CompileError(110, "contains_all takes an array of strings")
    if substrings.kind.elem == NULL:
        return Typed(BOOL, F.lit(True))
    return Typed(BOOL, F.forall(substrings.col, lambda s: F.contains(text, folded(Typed(STRING, s), case_sensitive))), value.err)


@fn("strlen", "value:str")
def strlen(ctx, value: Typed):
    return Typed(INT, F.char_length(value.col).cast("bigint"), value.err)


@fn("truncate", "value:str, limit:int, suffix?:str=")
def truncate(ctx, value: Typed, limit: Typed, suffix: Typed | None):
    n = F.greatest(limit.col, F.lit(0)).cast("int")
    tail = suffix.col if suffix is not None else F.lit("")
    return Typed(STRING, F.when(F.char_length(value.col) > n, F.concat(F.substring(value.col, F.lit(1), n), tail)).otherwise(value.col), value.err)


SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@fn("strip_whitespace", "value:str")
def strip_whitespace(ctx, value: Typed):
    return Typed(STRING, F.regexp_replace(value.col, f"^{SPACE}+|{SPACE}+$(?![\\r\\n])", ""), value.err)


@fn("strip_ansi_escape_codes", "value:str")
def strip_ansi_escape_codes(ctx, value: Typed):
    return Typed(STRING, F.regexp_replace(value.col, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\^_])", ""), value.err)


@fn("join", "value:arr, separator?:str=")
def join(ctx, value: Typed, separator: Typed | None):
    sep = need_const(separator, "separator") or ""
    if value.kind.elem == ANY:
        texts = F.transform(value.col, lambda x: F.try_variant_get(x, "$", "string"))
        bad = F.exists(value.col, lambda x: F.schema_of_variant(x) != "STRING")
        return Typed(STRING, F.array_join(texts, sep), F.when(bad, F.lit("all array items must be strings")) if value.err is None else F.coalesce(value.err, F.when(bad, F.lit("all array items must be strings"))))
    if value.kind.elem.tag not in ("string", "null"):
        return Typed(STRING, F.lit(None).cast("string"), F.lit("all array items must be strings"))
    return Typed(STRING, F.array_join(value.col, sep), value.err)


@fn("split", "value:str, pattern:str/re, limit?:int")
def split(ctx, value: Typed, pattern: Typed, limit: Typed | None):
    n = need_const(limit, "limit")
    if n is not None and n <= 0:
        return Typed(array_of(STRING), F.array().cast("array<string>"), value.err)
    if pattern.kind.tag == "regex":
        p = translated(pattern.const).java
    elif pattern.is_const:
        p = re.escape(pattern.const).replace("\\\n", "\\n")
    else:
        return Typed(array_of(STRING), F.split(value.col, F.concat(F.lit(r"\Q"), pattern.col, F.lit(r"\E")), F.lit(n or -1)), value.err)
    if pattern.const == "":
        # an empty pattern parts all characters, with an empty text at both ends
        return Typed(array_of(STRING), F.concat(F.array(F.lit("")), F.split(value.col, "(?!^)"), F.array(F.lit(""))), value.err)
    return Typed(array_of(STRING), F.split(value.col, p, n or -1), value.err)


def replacement(text: str) -> str:
    """$1, ${name} and $$ of the language as Java's."""
    text = text.replace("\\", "\\\\")
    return re.sub(r"\$\$", r"\\$", text)


def java_replacement(pattern: str, text: str) -> str:
    names = dict(translated(pattern).names)
    out = re.sub(r"\$\$", "\0", text.replace("\\", "\\\\"))
    out = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: f"${m[1] or m[2]}" if (m[1] or m[2]).isdigit() else f"${names[m[1] or m[2]]}" if (m[1] or m[2]) in names else "", out)
    return out.replace("\0", "\\$")


@fn("replace", "value:str, pattern:str/re, with:str, count?:int=-1")
def replace(ctx, value: Typed, pattern: Typed, with_: Typed, count: Typed):
    n = need_const(count, "count")
    if n == 0:
        return value
    if pattern.kind.tag == "regex":
        text = need_const(with_, "with")
        if n < 0:
            return Typed(STRING, F.regexp_replace(value.col, translated(pattern.const).java, java_replacement(pattern.const, text)), value.err)
        p, source = None, pattern.const

        def run(v):
            new = re.sub(r"\$\{(\w+)\}|\$(\w+)|\$\$", lambda m: "$" if m[0] == "$$" else f"\\g<{m[1] or m[2]}>", text.replace("\\", "\\\\"))
            return python(source).sub(new, v, count=n)

        out = arrow(run, STRING, value)
        return out.with_err(value.err)
    if n < 0:
        return Typed(STRING, F.replace(value.col, pattern.col, with_.col), value.err)
    parts = F.split(value.col, F.concat(F.lit(r"\Q"), pattern.col, F.lit(r"\E")), F.lit(n + 1))
    return Typed(STRING, F.array_join(parts, with_.const) if with_.is_const else F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), lambda a, x: F.concat(a, with_.col, x)), value.err)


@fn("replace_with", "value:str, pattern:re, count?:int=-1", closure=True)
def replace_with(ctx, value: Typed, pattern: Typed, count: Typed, closure):
    """The closure sees {string, captures, named groups} of each match."""
    n, p = need_const(count, "count"), translated(pattern.const)
    whole = F.regexp_extract_all(value.col, F.lit(f"({p.java})"), F.lit(0))
    groups = [F.regexp_extract_all(value.col, F.lit(p.java), F.lit(g)) for g in range(1, p.groups + 1)]
    gaps = F.split(value.col, p.java, n + 1 if n >= 0 else -1)
    if n >= 0:
        whole = F.slice(whole, F.lit(1), F.lit(max(n, 1)))

    def each(text, i):
        caps = [F.get(g, i) for g in groups]
        parts = {"string": Typed(STRING, text), "captures": Typed(array_of(STRING), F.array(*caps) if caps else F.array().cast("array<string>"))}
        parts |= {name: Typed(STRING, caps[g - 1]) for name, g in p.names}
        out = ctx.call_closure(closure, Typed(Kind("object", fields=tuple((k, v.kind) for k, v in parts.items())), parts=parts))
        if out.err is not None:
            raise CompileError(100, "the closure of replace_with can fail")
        return F.coalesce(out.column(), F.lit(""))

    new = F.transform(whole, each)
    joined = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return Typed(STRING, value.col if n == 0 else joined, value.err)


@fn("match", "value:str, pattern:re")
def match(ctx, value: Typed, pattern: Typed):
    if not pattern.is_const:
        return Typed(BOOL, F.rlike(value.col, pattern.col), value.err)
    return Typed(BOOL, F.rlike(value.col, F.lit(translated(pattern.const).java)), value.err)


@fn("match_any", "value:str, patterns:arr")
def match_any(ctx, value: Typed, patterns: Typed):
    out = F.lit(False)
    for p in patterns.extra.get("items", []):
        if p.kind.tag != "regex":
            raise CompileError(110, "match_any takes regular expressions")
        out = out | F.rlike(value.col, F.lit(translated(p.const).java))
    return Typed(BOOL, out, value.err)


@fn("match_array", "value:arr, pattern:re, all?:bool=false")
def match_array(ctx, value: Typed, pattern: Typed, all: Typed):
    p = F.lit(translated(pattern.const).java)
    tag = value.kind.elem.tag
    if tag == "null":
        return Typed(BOOL, F.lit(bool(all.const)))
    if tag not in ("string", "any"):
        return Typed(BOOL, F.forall(value.col, lambda _: F.lit(False)) if all.const else F.lit(False), value.err)
    text = (lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))) if tag == "any" else (lambda x: x)
    test = lambda x: F.coalesce(F.rlike(text(x), p), F.lit(False))
    return Typed(BOOL, F.when(all.col, F.forall(value.col, test)).otherwise(F.exists(value.col, test)), value.err)


@fn("find", "value:str, pattern:str/re, from?:int=0")
def find(ctx, value: Typed, pattern: Typed, from_: Typed):
    """Byte index of the first match at or after a byte offset; null if there is none."""
    start = from_.col
    rest = lossy(F.substring(F.encode(value.col, "UTF-8"), (start + 1).cast("int"), F.octet_length(value.col)))
    if pattern.kind.tag == "regex":
        p = translated(pattern.const).java
        head = F.regexp_extract(rest, f"^((?s:.*?))(?:{p})", 1)
        hit = F.rlike(rest, F.lit(p))
        return Typed(INT, F.when(hit, (start + F.octet_length(head)).cast("bigint")), value.err)
    at = F.locate(pattern.const, rest) if pattern.is_const else F.position(pattern.col, rest)
    head = F.substring(rest, F.lit(1), at - 1)
    return Typed(INT, F.when(at > 0, (start + F.octet_length(head)).cast("bigint")), value.err)


@fn("slice", "value:str/arr, start:int, end?:int")
def slice_(ctx, value: Typed, start: Typed, end: Typed | None):
    array = value.kind.tag == "array"
    size = (F.size(value.col) if array else F.octet_length(value.col)).cast("bigint")
    lo = F.when(start.col < 0, start.col + size).otherwise(start.col)
    hi = size if end is None else F.when(end.col < 0, end.col + size).otherwise(F.least(end.col, size))
    bad = F.when((lo < 0) | (lo > size), F.concat(F.lit("'start' must be between '"), -size, F.lit("' and '"), size, F.lit("'"))).when(hi < lo, F.lit("'end' must be greater or equal to 'start'"))
    n = F.greatest(hi - lo, F.lit(0)).cast("int")
    lo1 = (F.greatest(lo, F.lit(0)) + 1).cast("int")
    col = F.slice(value.col, lo1, n) if array else lossy(F.substring(F.encode(value.col, "UTF-8"), lo1, n))
    return Typed(value.kind, F.when(bad.isNull(), col), F.coalesce(value.err, bad) if value.err is not None else bad)


@fn("basename", "value:str")
def basename(ctx, value: Typed):
    last = F.element_at(F.split(F.regexp_replace(value.col, "/+$", ""), "/"), -1)
    return Typed(STRING, F.when(~last.isin("", "..", "."), last), F.when(F.lit(False), F.lit("")))


@fn("dirname", "value:str")
def dirname(ctx, value: Typed):
    bare = F.regexp_replace(value.col, "(?<=.)/+$", "")
    head = F.regexp_replace(F.regexp_extract(bare, "^(.*)/[^/]*$", 1), "(?<=.)/+$", "")
    return Typed(STRING, F.when(value.col.rlike("^/+$"), "/").when(~bare.contains("/"), ".").when(head == "", "/").otherwise(head), F.when(F.lit(False), F.lit("")))


@fn("split_path", "value:str")
def split_path(ctx, value: Typed):
    parts = F.filter(F.split(value.col, "/"), lambda p: (p != "") & (p != "."))
    return Typed(array_of(STRING), F.when(value.col.startswith("/"), F.concat(F.array(F.lit("/")), parts)).when(value.col.startswith("./"), F.concat(F.array(F.lit(".")), parts)).otherwise(parts), F.when(F.lit(False), F.lit("")))


# The boundaries of words in names.
BOUNDARIES = {"lower_upper": r"(?<=\p{Ll})(?=\p{Lu})", "upper_lower": r"(?!)", "acronym": r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "lower_digit": r"(?<=\p{Ll})(?=\p{Nd})", "upper_digit": r"(?<=\p{Lu})(?=\p{Nd})", "digit_lower": r"(?<=\p{Nd})(?=\p{Ll})", "digit_upper": r"(?<=\p{Nd})(?=\p{Lu})"}
CASES = {"kebab-case": r"-", "snake_case": r"_", "SCREAMING_SNAKE": r"_", "camelCase": "(?<=[^\\p{Lu}])(?=\\p{Lu})", "PascalCase": "(?<=[^\\p{Lu}])(?=\\p{Lu})"}


def words_of(v: Typed, original: Typed | None, excluded: Typed | None) -> Column:
    case = need_const(original, "original_case")
    if case is not None:
        if case not in CASES:
            raise CompileError(403, f"invalid enum variant: {case}")
        return F.filter(F.split(v.col, CASES[case]), lambda w: w != "")
    without = set(need_const(excluded, "excluded_boundaries") or [])
    rules = [p for name, p in BOUNDARIES.items() if name not in without]
    return F.filter(F.split(v.col, "|".join([r"[\s_-]+", *rules])), lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def cased(name: str, make, sep: str, extra: str = ""):
    @fn(name, "value:str, original_case?:str" + extra)
    def run(ctx, value: Typed, original_case: Typed | None, excluded_boundaries: Typed | None = None):
        words = words_of(value, original_case, excluded_boundaries)
        return Typed(STRING, F.array_join(F.transform(words, make), sep), value.err)

    return run


cased("camelcase", lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capital(w)), "")
cased("pascalcase", lambda w, i: capital(w), "")
cased("kebabcase", lambda w, i: F.lower(w), "-")
cased("snakecase", lambda w, i: F.lower(w), "_", ", excluded_boundaries?:arr")
cased("screamingsnakecase", lambda w, i: F.upper(w), "_")


@fn("shannon_entropy", "value:str, segmentation?:str=byte")
def shannon_entropy(ctx, value: Typed, segmentation: Typed):
    how = need_const(segmentation, "segmentation")
    if how not in ("byte", "codepoint", "grapheme"):
        raise CompileError(403, f"invalid enum variant: {how}")

    def run(v):
        import math
        from collections import Counter

        import regex

        units = v.encode() if how == "byte" else v if how == "codepoint" else regex.findall(r"\X", v)
        return -sum(n / len(units) * math.log2(n / len(units)) for n in Counter(units).values()) + 0.0 if units else 0.0

    if how == "grapheme":
        return arrow(run, FLOAT, value).with_err(value.err)
    text = F.hex(F.encode(value.col, "UTF-8")) if how == "byte" else value.col
    units = F.sort_array(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1)) if how == "byte" else F.filter(F.split(text, ""), lambda x: x != ""))
    # in sorted order a unit's run ends where the next differs; runs give the counts
    ends = F.filter(F.transform(units, lambda x, i: F.when(F.get(units, i + 1).eqNullSafe(x), F.lit(None).cast("int")).otherwise(i + 1)), lambda e: e.isNotNull())
    counts = F.transform(ends, lambda e, i: e - F.coalesce(F.get(ends, i - 1), F.lit(0)))
    n = F.size(units)
    return Typed(FLOAT, F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))), value.err)


def refused(pattern: str) -> tuple[str, bool] | None:
    """For a pattern of one class of characters, the class of all others, and whether Java reads it as Python does; None for other patterns."""
    m = re.fullmatch(r"\[(\^?)((?:[^\[\]\\^&|~-]|[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|\\[wWdDsS.\]\[\\^-])+)\]\+?", pattern)
    if m is None or any(a > b for a, b in re.findall(r"(\w)-(\w)", m[2])):
        return None
    return f"[{'' if m[1] else '^'}{m[2]}]", m[2].isascii() and "\\" not in m[2]


@fn("sieve", "value:str, permitted_characters:re, replace_single?:str=, replace_repeated?:str=")
def sieve(ctx, value: Typed, permitted_characters: Typed, replace_single: Typed | None, replace_repeated: Typed | None):
    source = permitted_characters.const
    one, many = need_const(replace_single, "replace_single") or "", need_const(replace_repeated, "replace_repeated") or ""
    others = refused(source)
    if others and others[1] and not one and not many:
        return Typed(STRING, F.regexp_replace(value.col, f"{others[0]}+", ""), value.err)

    def gap(text):
        return one if len(text) == 1 and text.isascii() else many

    def run(v):
        if others:
            return python(others[0] + "+").sub(lambda m: gap(m[0]), v)
        out, at = [], 0
        for m in python(source).finditer(v):
            start, end = m.span()
            if start > at:
                out.append(gap(v[at:start]))
            out.append(m[0])
            at = end
        return "".join(out) + (gap(v[at:]) if at < len(v) else "")

    return arrow(run, STRING, value).with_err(value.err)


SSN = r"(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9]0|[1-9][1-9])-(?:000[1-9]|00[1-9]0|0[1-9]00|[1-9]000|[1-9]{4})"


@fn("redact", "value:str/obj/arr, filters:arr, redactor?:str/obj")
def redact(ctx, value: Typed, filters: Typed, redactor: Typed | None):
    patterns = []
    for f in filters.extra.get("items", []):
        kind = f.const if f.is_const else None
        if f.kind.tag == "regex":  # a pattern of one's own
            patterns.append(("regex", f.const))
        elif kind == "us_social_security_number" or isinstance(kind, dict) and kind.get("type") == "us_social_security_number":
            patterns.append(("regex", SSN))
        elif f.parts is not None and "patterns" in f.parts:
            for p in f.parts["patterns"].extra.get("items", []):
                patterns.append(("regex", p.const) if p.kind.tag == "regex" else ("text", p.const))
        else:
            raise CompileError(402, "invalid argument: unknown filter name")
    how = redactor.const if redactor is not None and redactor.is_const else "full"
    kind = how if isinstance(how, str) else how.get("type")
    text = "[REDACTED]" if kind == "full" else how.get("replacement", "[REDACTED]") if kind == "text" else None
    if kind not in ("full", "text", "sha2", "sha3"):
        raise CompileError(402, "invalid argument: unknown redactor")

    def one(c: Column) -> Column:
        for what, p in patterns:
            if text is not None:
                c = F.regexp_replace(c, translated(p).java, text.replace("\\", "\\\\").replace("$", "\\$")) if what == "regex" else F.replace(c, F.lit(p), F.lit(text))
        return c

    def deep(v: Typed) -> Typed:
        tag = v.kind.tag
        if v.parts is not None:
            return Typed(v.kind, parts={k: deep(x) for k, x in v.parts.items()})
        if tag == "string":
            return Typed(STRING, one(v.col), v.err)
        if tag == "array":
            return Typed(v.kind, F.transform(v.col, lambda x: deep(Typed(v.kind.elem, x)).column()), v.err)
        if tag == "map":
            return Typed(v.kind, F.transform_values(v.col, lambda _, x: deep(Typed(v.kind.elem, x)).column()), v.err)
        if tag == "object":
            return Typed(v.kind, parts={k: deep(x) for k, x in ctx.parts_of(v).items()})
        return v

    if text is None:
        import hashlib

        variant = (how.get("variant") if isinstance(how, dict) else None) or ("SHA-512/256" if kind == "sha2" else "SHA3-512")
        name = {"SHA-512/256": "sha512_256", "SHA-512/224": "sha512_224"}.get(variant, variant.lower().replace("sha3-", "sha3_").replace("sha-", "sha"))

        def run(v):
            import base64

            for what, p in patterns:
                v = python(p if what == "regex" else re.escape(p)).sub(lambda m: base64.b64encode(hashlib.new(name, m[0].encode()).digest()).decode(), v)
            return v

        if value.kind != STRING:
            raise CompileError(402, "a hash redactor takes strings here")
        return arrow(run, STRING, value).with_err(value.err)
    return deep(value)


@fn("parse_float", "value:str")
def parse_float(ctx, value: Typed):
    got = F.when(value.col.rlike(r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"), value.col.try_cast("double"))
    return Typed(FLOAT, got, F.when(got.isNull() & value.col.isNotNull(), F.lit("invalid float literal")))
