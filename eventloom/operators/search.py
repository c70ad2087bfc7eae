"""Search queries as one boolean column.

    error AND env:prod -host:web*        implicit AND; AND binds tighter than OR; - and NOT negate; ( ) group
    @status:>=500   @code:[200 TO 299}   comparisons and ranges
    _exists_:host   _missing_:@a.b       presence
    "two words"     name:a*b  f:(x OR y) phrases, prefixes and wildcards, several values of one field

@x is the event's field x, dots go down. A bare word looks in the default fields, at word boundaries. source, service, status, host,
trace_id, message, timestamp and tags are fields by that name; any other name is a tag `name:value` in the array tags. A missing field matches nothing, so negation
of a leaf on it is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, STRING, Typed, array_of, const, to_text

# Fields that bare words look in, and reserved names.
DEFAULT_FIELDS = ["message", "custom.error.message", "custom.error.stack", "custom.title", "_default_"]
RESERVED = ["host", "source", "status", "service", "trace_id", "message", "timestamp", "tags"]


@dataclass
class Term:
    field: str | None
    value: str
    how: str  # term phrase prefix wildcard exists missing compare range all none
    op: str = ""
    upper: str = ""
    ends: tuple[bool, bool] = (True, True)


_TOKEN = re.compile(r"""\s*(?:(\()|(\))|(AND\b|&&)|(OR\b|\|\|)|(NOT\b|!)|(-)(?=\S)|(\+)(?=\S)|((?:[^\s()"\\:\[\]{}<>=]|\\.)+):(?=\S)|("(?:[^"\\]|\\.)*")|([\[{])\s*(\S+)\s+TO\s+([^\s\]}]+)\s*([\]}])|((?:>=|<=|>|<)\s*(?:"[^"]*"|(?:[^\s()\\]|\\.)+))|((?:[^\s()"\\]|\\.)+))""")


def tokens(query: str) -> list[tuple[str, object]]:
    out, at = [], 0
    names = ("open", "close", "and", "or", "not", "not", "plus", "field", "phrase")
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m:
            raise CompileError(402, f"failed to parse query at {at}")
        g = m.groups()
        i = next(k for k, x in enumerate(g) if x is not None)
        if i < 9:
            out.append((names[i], g[i]))
        elif i == 9:
            out.append(("range", (g[9], g[10], g[11], g[12])))
        elif i == 13:
            out.append(("compare", g[13]))
        else:
            out.append(("word", g[14]))
        at = m.end()
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class Parser:
    def __init__(self, query: str):
        self.all, self.i = tokens(query), 0

    def peek(self) -> str:
        return self.all[self.i][0] if self.i < len(self.all) else "end"

    def query(self, field: str | None = None):
        parts = [self.conjunction(field)]
        while self.peek() == "or":
            self.i += 1
            parts.append(self.conjunction(field))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def conjunction(self, field):
        parts = [self.clause(field)]
        while self.peek() not in ("or", "close", "end"):
            if self.peek() == "and":
                self.i += 1
            parts.append(self.clause(field))
        return parts[0] if len(parts) == 1 else ("and", parts)

    def clause(self, field):
        kind = self.peek()
        if kind == "not":
            self.i += 1
            return "not", self.clause(field)
        if kind == "plus":
            self.i += 1
            return self.clause(field)
        if kind == "open":
            self.i += 1
            inner = self.query(field)
            if self.peek() != "close":
                raise CompileError(402, "failed to parse query: a parenthesis is open")
            self.i += 1
            return inner
        if kind == "field":
            name = unescaped(self.all[self.i][1])
            self.i += 1
            if name in ("_exists_", "_missing_"):
                what = self.all[self.i][1]
                self.i += 1
                return Term(unescaped(str(what).strip('"')), "", "exists" if name == "_exists_" else "missing")
            return self.clause(name)
        if kind == "end":
            raise CompileError(402, "failed to parse query: it ends too early")
        value = self.all[self.i][1]
        self.i += 1
        if kind == "range":
            a, lo, hi, b = value
            return Term(field, lo.strip('"'), "range", upper=hi.strip('"'), ends=(a == "[", b == "]"))
        if kind == "compare":
            m = re.match(r"(>=|<=|>|<)\s*(.*)", value, re.S)
            return Term(field, unescaped(m[2].strip('"')), "compare", m[1])
        if kind == "phrase":
            return Term(field, unescaped(value[1:-1]), "phrase")
        if value == "*":
            return Term(None, "", "all") if field in (None, "*") else Term(field, "", "exists")
        if re.fullmatch(r"(?:[^*?\\]|\\.)+\*", value):
            return Term(field, unescaped(value[:-1]), "prefix")
        if re.search(r"(?<!\\)[*?]", value):
            return Term(field, value, "wildcard")
        return Term(field, unescaped(value), "term")


def parse(query: str):
    if not query.strip():
        return Term(None, "", "all")
    p = Parser(query)
    tree = p.query()
    if p.peek() != "end":
        raise CompileError(402, "failed to parse query: a parenthesis is closed too often")
    return tree


def field_of(event: Typed, path: str) -> Typed | None:
    """The value at a dotted path; None where the schema has none."""
    v = event
    for part in path.split("."):
        if v.parts is not None:
            if part not in v.parts:
                return None
            v = v.parts[part]
        elif v.kind.tag == "object":
            kinds = dict(v.kind.fields)
            if part not in kinds:
                return None
            v = Typed(kinds[part], v.col.getField(part))
        elif v.kind.tag == "map":
            v = Typed(v.kind.elem, F.try_element_at(v.col, F.lit(part)))
        elif v.kind.tag == "any":
            v = Typed(ANY, F.try_element_at(F.try_variant_get(v.col, "$", "map<string,variant>"), F.lit(part)))
        else:
            return None
    return v


def wild(text: str) -> str:
    return "".join(".*" if x == "*" else "." if x == "?" else re.escape(unescaped(x)) for x in re.findall(r"\\.|.", text, re.S))


def predicate(query: str, event: Typed, sure: bool = False) -> Column:
    """The query as a filter's condition, null where a field is missing, so that comparisons are open to pushdown; sure: false instead."""
    return lowered(parse(query), event, sure)


def lowered(node, event: Typed, sure: bool) -> Column:
    if isinstance(node, tuple):
        how, inner = node
        if how == "not":
            return ~lowered(inner, event, True)
        cols = [lowered(x, event, sure) for x in inner]
        out = cols[0]
        for c in cols[1:]:
            out = out & c if how == "and" else out | c
        return out
    found = leaf(node, event)
    return F.coalesce(found, F.lit(False)) if sure else found


def leaf(t: Term, event: Typed) -> Column:
    if t.how in ("all", "none"):
        return F.lit(t.how == "all")
    if t.how == "missing":
        return ~F.coalesce(leaf(Term(t.field, "", "exists"), event), F.lit(False))
    if t.field is None or t.field == "*":
        out = None
        for name in DEFAULT_FIELDS:
            v = field_of(event, name)
            if v is not None:
                out = worded(t, v) if out is None else out | worded(t, v)
        return F.lit(False) if out is None else out
    if t.field.startswith("@"):
        v = field_of(event, t.field[1:])
        return F.lit(False) if v is None else on_value(t, v, numbers=True)
    if t.field == "tags":
        v = field_of(event, "tags")
        if v is None or v.kind.tag != "array":
            return F.lit(False)
        return (F.exists(v.col, lambda x: x == t.value)) if t.how in ("term", "phrase") else (F.exists(v.col, lambda x: on_text(t, x)))
    if t.field in RESERVED:
        v = field_of(event, t.field)
        return F.lit(False) if v is None else worded(t, v) if t.field == "message" else on_value(t, v, numbers=False)
    tags = field_of(event, "tags")
    if tags is None or tags.kind.tag != "array":
        return F.lit(False)
    if t.how == "exists":
        return (F.exists(tags.col, lambda x: (x == t.field) | x.startswith(t.field + ":")))
    head = len(t.field) + 2
    return (F.exists(tags.col, lambda x: x.startswith(t.field + ":") & on_text(t, F.substring(x, F.lit(head), F.length(x)))))


def worded(t: Term, v: Typed) -> Column:
    """A default field: matched at word boundaries."""
    if t.how == "exists":
        return v.column().isNotNull()
    if v.kind.tag not in ("string", "any"):
        return on_value(t, v, numbers=False)
    c = to_text(v)
    if t.how in ("term", "phrase"):
        return (c.rlike(r"\b" + re.escape(t.value) + r"\b"))
    if t.how == "prefix":
        return (c.rlike(r"\b" + re.escape(t.value)))
    if t.how == "wildcard":
        return (c.rlike(wild(t.value)))
    return on_value(t, v, numbers=False)


def on_value(t: Term, v: Typed, numbers: bool) -> Column:
    if t.how == "exists":
        return v.column().isNotNull() if v.kind.tag != "null" else F.lit(False)
    if v.kind.tag == "array":
        return (F.exists(v.col, lambda x: on_value(t, Typed(v.kind.elem, x), numbers)))
    if v.parts is not None or v.kind.tag in ("object", "map"):
        return F.lit(False)
    present = v.column().isNotNull()
    if t.how in ("compare", "range") and numbers:
        number = v.col if v.kind.tag in ("int", "float") else F.try_variant_get(v.col, "$", "double") if v.kind.tag == "any" else None
        if number is not None:
            return (bounded(t, number, True, F.when(present, to_text(v))))
    return present & on_text(t, v.col if v.kind.tag == "string" else to_text(v))


def on_text(t: Term, c: Column) -> Column:
    if t.how in ("term", "phrase"):
        return c == t.value
    if t.how == "prefix":
        return c.startswith(t.value)
    if t.how == "wildcard":
        return c.rlike("^(?s:" + wild(t.value) + ")$")
    if t.how == "exists":
        return c.isNotNull()
    return bounded(t, c, False, c)


def bounded(t: Term, c: Column, numeric: bool, text: Column) -> Column:
    """A comparison or a range; * is no bound. A bound that is no number is compared as text."""

    def one(op: str, bound: str) -> Column:
        left, right = text, F.lit(bound)
        if numeric:
            try:
                left, right = c, F.lit(float(bound)) if not re.fullmatch(r"[+-]?\d{1,18}", bound) else F.lit(int(bound))
            except ValueError:
                pass
        return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]

    if t.how == "compare":
        return one(t.op, t.value)
    out = c.isNotNull()
    if t.value != "*":
        out = out & one(">=" if t.ends[0] else ">", t.value)
    if t.upper != "*":
        out = out & one("<=" if t.ends[1] else "<", t.upper)
    return out
