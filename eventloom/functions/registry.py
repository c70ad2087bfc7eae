"""The registry of functions: signature, fallibility, and how a call becomes a typed column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, Kind, Typed, array_of, const, first_error, map_of

SHORT = {"str": "string", "int": "int", "flt": "float", "bool": "bool", "ts": "time", "re": "regex", "obj": "object", "arr": "array", "null": "null"}


@dataclass
class Param:
    name: str
    kinds: tuple[str, ...]  # () takes any
    required: bool
    default: object = None


@dataclass
class Function:
    name: str
    params: list[Param]
    lower: Callable[..., Typed]
    closure: bool = False
    raw: bool = False  # gets syntax nodes, not values


FUNCTIONS: dict[str, Function] = {}


def fn(name: str, signature: str = "", closure: bool = False, raw: bool = False):
    """Registers a function. signature: "value:str/int, limit?:int=3"; a value named like a parameter is passed on by that name."""
    params = []
    for part in filter(None, (p.strip() for p in signature.split(", "))):
        head, _, default = part.partition("=")
        n, _, kinds = head.partition(":")
        tags = () if kinds == "any" else tuple(SHORT[k] for k in kinds.split("/"))
        value: object = None
        if default:
            value = {"true": True, "false": False}.get(default, int(default) if default.lstrip("-").isdigit() else default)
        params.append(Param(n.rstrip("?"), tags, not n.endswith("?"), value))

    def add(lower):
        FUNCTIONS[name] = Function(name, params, lower, closure, raw)
        return lower

    return add


def fits(kind: Kind, tags: tuple[str, ...]) -> bool:
    tag = {"map": "object", "binary": "string"}.get(kind.tag, kind.tag)
    return not tags or tag in tags


def narrowed(v: Typed, tags: tuple[str, ...], where: str) -> Typed:
    """v as one of the tags: as it is, checked row by row if it is a VARIANT, else a compile error."""
    if fits(v.kind, tags) or v.kind.tag == "null":
        return v
    if v.kind.tag == "any":
        if len(tags) > 1 and "any-ok" not in tags and set(tags) <= {"int", "float"}:
            return from_any(v, "float", where)
        return from_any(v, tags[0], where)
    wanted = " or ".join(str(Kind(t)) for t in tags)
    raise CompileError(110, f"invalid argument type: {where} expects {wanted}, got {v.kind}")


def variant_tag(c: Column) -> Column:
    """The language's name of the kind of a VARIANT."""
    s = F.schema_of_variant(c)
    return F.when(c.isNull() | F.is_variant_null(c), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s == "BOOLEAN", "boolean").when(s.startswith("DOUBLE") | s.startswith("DECIMAL") | s.startswith("FLOAT"), "float").when(s.startswith("TIMESTAMP"), "timestamp").otherwise("string")


TARGETS = {"string": ("string", "string"), "int": ("integer", "bigint"), "float": ("float", "double"), "bool": ("boolean", "boolean"), "time": ("timestamp", "timestamp"), "array": ("array", "array<variant>"), "object": ("object", "map<string,variant>")}
# What the schema of a VARIANT of that kind is, or a pattern of it.
SCHEMAS = {"string": "^(?!OBJECT|ARRAY|BIGINT$|BOOLEAN$|DOUBLE|DECIMAL|FLOAT|TIMESTAMP|VOID$)", "int": "BIGINT", "float": "^(DOUBLE|DECIMAL|FLOAT)", "bool": "BOOLEAN", "time": "^TIMESTAMP", "array": "^ARRAY", "object": "^OBJECT"}


def from_any(v: Typed, tag: str, where: str) -> Typed:
    name, sql = TARGETS[tag]
    kind = array_of(ANY) if tag == "array" else map_of(ANY) if tag == "object" else Kind(tag)
    got, test = variant_tag(v.col), SCHEMAS[tag]
    s = F.coalesce(F.schema_of_variant(v.col), F.lit("VOID"))
    good = s == test if test.isalpha() else s.rlike(test)  # as got == name; short, since code of many fields stands in one compiled method
    err = F.when(~good, F.concat(F.lit(f"expected {name}, got "), got))
    return Typed(kind, F.when(good, F.try_variant_get(v.col, "$", sql)), first_error(v.err, err))


def need_const(v: Typed | None, what: str) -> object:
    if v is None:
        return None
    if not v.is_const:
        raise CompileError(401, f"expected a literal: {what}")
    return v.const


def arrow(run: Callable, returns: Kind, *args: Typed, error: str | None = None, many: Callable | None = None) -> Typed:
    """A total Python function of scalars as one Arrow node: run(*values) gives the value, or raises for the row's error.

    It is for what Catalyst can't express. The node sees batches; a row with a null argument gives null. Literals stay in the node, and rows of
    a batch with equal arguments are worked out once. many(rows) gives values and exceptions of a whole batch in place of run.
    """
    shape = returns.sql() if returns.tag != "any" else "string"
    fixed = {i: a.const for i, a in enumerate(args) if a.is_const and isinstance(a.const, (str, bytes, int, float))}
    sent = [i for i in range(len(args)) if i not in fixed] or [0]
    order = None if len(sent) == len(args) else [sent.index(i) if i in sent else len(sent) + i for i in range(len(args))]
    constants = tuple(fixed.get(i) for i in range(len(args)))

    def one(row: tuple):
        try:
            return run(*row)
        except Exception as e:  # the row's own error, part of the result
            return e

    def each(*columns: pd.Series) -> pd.DataFrame:
        made: dict = {}
        out: list = []
        todo: dict = {}
        for row in zip(*columns, strict=True):
            try:
                x = made.get(row, made)
            except TypeError:  # arrays can't be looked up
                x = None if any(x is None or x is pd.NaT for x in row) else one(placed(row))
            else:
                if x is made:
                    x = None if any(x is None or x is pd.NaT for x in row) else todo.setdefault(row, row) if many else one(placed(row))
                    made[row] = x
            out.append(x)
        if todo:
            found = dict(zip(todo, many([placed(row) for row in todo]), strict=True))
            out = [None if x is None else found[x] for x in out]
        failed = [isinstance(x, Exception) for x in out]
        errors = [(error or str(x) or type(x).__name__) if bad else None for x, bad in zip(out, failed, strict=True)] if any(failed) else [None] * len(out)
        values = [None if bad else x for x, bad in zip(out, failed, strict=True)]
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    def placed(row: tuple) -> tuple:
        if order is None:
            return row
        row = row + constants
        return tuple([row[i] for i in order])

    node = F.pandas_udf(each, f"value {shape}, error string")
    out = node(*[args[i].column() for i in sent])
    col = out.getField("value")
    if returns.tag == "any":
        col = F.try_parse_json(col)
    return Typed(returns, col, first_error(*[a.err for a in args], out.getField("error")))


def lit(v: object) -> Typed:
    return const(v)
