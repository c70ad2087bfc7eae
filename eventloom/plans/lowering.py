"""From syntax tree to DataFrame: each statement is one layer of columns, and nothing runs row by row.

Values are typed from the input schema on the driver. A null in an input column propagates as in SQL. A call that may fail has an
error column beside its value; the program must handle it by `!`, `??` or `value, error =`, else it doesn't compile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.registry import FUNCTIONS, from_any, narrowed, need_const, variant_tag
from eventloom.lang import syntax as s
from eventloom.lang.syntax import CompileError

from .typed import ANY, BOOL, FLOAT, INT, NULL, STRING, TIME, Kind, Typed, array_of, as_kind, const, default_of, first_error, kind_of, object_kind, time_text, to_any, to_text, unify, value


@dataclass
class Env:
    """What the names stand for at a place in the program."""

    event: Typed
    meta: Typed
    names: dict[str, Typed] = field(default_factory=dict)
    status: Column | None = None  # null while a row's program goes on
    message: Column | None = None
    result: Typed | None = None  # of return

    def copy(self) -> Env:
        return replace(self, names=dict(self.names))


def when_ok(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def locked(text: str) -> tuple[str, list[str | int], bool]:
    """A read-only path, ".a.b", "%a" or "." : its root, its steps, and whether what lies below it is read-only too (a path that ends in .* )."""
    deep = text.endswith(".*")
    text = text[:-2] if deep else text
    if text in ("", ".", "%"):
        return text or ".", [], deep
    [node] = s.parse(text).body
    if not isinstance(node, s.Query) or node.root not in (".", "%"):
        raise ValueError(f"not a path of the event or its metadata: {text}")
    return node.root, node.path, deep


class Lowering:
    def __init__(self, df: DataFrame, read_only: Sequence[str] = ()):
        self.df = df
        self.read_only = [locked(p) for p in read_only]
        self.n = 0
        self.known: dict[int, Column] = {}
        self.env = Env(Typed(NULL, parts={f.name: self.input(kind_of(f.dataType), f"`{f.name}`", f.dataType) for f in df.schema.fields}), Typed(NULL, parts={}))
        self.env.event.kind = object_kind(self.env.event.parts)
        self.inside = 0  # closures around the place: no layers there
        self.pure = True

    def input(self, kind: Kind, name: str, spark_type) -> Typed:
        c = F.col(name)
        simple = spark_type.simpleString()
        if kind == INT and simple != "bigint" or kind == FLOAT and simple != "double":
            c = c.cast(kind.sql())
        elif kind == TIME and simple != "timestamp":
            c = c.cast("timestamp")
        elif kind.tag == "array" and simple != kind.sql():
            c = c.cast(kind.sql())
        else:
            self.known[id(c)] = c
        return Typed(kind, c)

    # --- layers

    def hoisted(self, v: Typed) -> Typed:
        """v with its column and error in places of their own, so that later uses don't make them again; not inside a closure."""
        if self.inside or v.parts is not None or v.col is None or v.is_const:
            return v
        new: dict[str, Column] = {}

        def place(c: Column | None) -> Column | None:
            if c is None or id(c) in self.known:
                return c
            self.n += 1
            new[f"__v{self.n}"] = c
            out = F.col(f"__v{self.n}")
            self.known[id(out)] = out
            return out

        v = replace(v, col=place(v.col), err=place(v.err))
        if new:
            self.df = self.df.withColumns(new)
        return v

    def settle(self) -> None:
        """Gives each new column of the environment a place in the DataFrame, in one projection."""
        new: dict[str, Column] = {}

        def place(c: Column | None) -> Column | None:
            if c is None or id(c) in self.known:
                return c
            self.n += 1
            name = f"__v{self.n}"
            new[name] = c
            out = F.col(name)
            self.known[id(out)] = out
            return out

        def walk(v: Typed) -> Typed:
            if v.parts is not None:
                return replace(v, parts={k: walk(x) for k, x in v.parts.items()})
            if v.is_const or v.kind.tag in ("null", "regex"):
                return v
            return replace(v, col=place(v.col))

        env = self.env
        env.event, env.meta = walk(env.event), walk(env.meta)
        env.names = {k: walk(v) for k, v in env.names.items()}
        env.status, env.message = place(env.status), place(env.message)
        if env.result is not None:
            env.result = walk(env.result)
        if new:
            self.df = self.df.withColumns(new)

    def run(self, program: s.Block) -> Typed:
        result = const(None)
        for node in program.body:
            result = self.statement(node)
            self.env.names["\0result"] = result
            self.settle()
            result = self.env.names.pop("\0result")
        return result

    def statement(self, node: s.Node) -> Typed:
        v = self.expr(node)
        if v.err is not None:
            raise CompileError(100, "unhandled error: the expression can fail", node.at)
        return v

    def end(self, kind: str, cond: Column | None, message: Column | None) -> None:
        """Rows of cond stop here, if they still run."""
        env = self.env
        running = env.status.isNull() if env.status is not None else F.lit(True)
        stops = running & cond if cond is not None else running
        env.status = F.when(stops, F.lit(kind)).otherwise(env.status if env.status is not None else F.lit(None).cast("string"))
        env.message = F.when(stops, message if message is not None else F.lit(None).cast("string")).otherwise(env.message if env.message is not None else F.lit(None).cast("string"))

    # --- expressions

    def expr(self, node: s.Node) -> Typed:
        return getattr(self, f"on_{type(node).__name__.lower()}")(node)

    def sure(self, node: s.Node, code: int = 630) -> Typed:
        v = self.expr(node)
        if v.err is not None:
            raise CompileError(code, "fallible expression where it can't be", node.at)
        return v

    def on_literal(self, node: s.Literal) -> Typed:
        if node.kind == "regex":
            return Typed(Kind("regex"), None, const=node.value, nullable=False)
        if node.kind == "time":
            return Typed(TIME, F.lit(node.value).cast("timestamp"), nullable=False)
        return const(node.value)

    def on_template(self, node: s.Template) -> Typed:
        parts = [const(p) if isinstance(p, str) else self.expr(p) for p in node.parts]
        for p in parts:
            if p.kind != STRING:
                raise CompileError(610, "a template takes strings", node.at)
        return value(STRING, F.concat(*[to_text(p) for p in parts]), *parts, nullable=False)

    def on_variable(self, node: s.Variable) -> Typed:
        if node.name not in self.env.names:
            raise CompileError(701, f"call to undefined variable {node.name}{s.nearest(node.name, self.env.names)}", node.at)
        return self.env.names[node.name]

    def on_query(self, node: s.Query) -> Typed:
        base = self.env.event if node.root == "." else self.env.meta if node.root == "%" else self.expr(node.root)
        return self.get(base, node.path)

    def get(self, v: Typed, path: list[str | int]) -> Typed:
        """The value at a path; null where there is none."""
        for i, p in enumerate(path):
            tag = v.kind.tag
            if v.parts is not None:
                v = v.parts.get(p, const(None)) if isinstance(p, str) else const(None)
            elif tag == "object":
                kinds = dict(v.kind.fields)
                v = Typed(kinds[p], v.col.getField(p), v.err) if isinstance(p, str) and p in kinds else const(None).with_err(v.err)
            elif tag == "map":
                v = Typed(v.kind.elem, F.try_element_at(v.col, F.lit(p)), v.err) if isinstance(p, str) else const(None)
            elif tag == "array":
                v = Typed(v.kind.elem, F.try_element_at(v.col, F.lit(p + 1 if p >= 0 else p)), v.err) if isinstance(p, int) else const(None)
            elif tag == "any":
                v = self.hoisted(self.get_any(v, p))
            else:
                return const(None).with_err(v.err)
        return v

    def get_any(self, v: Typed, p: str | int) -> Typed:
        if isinstance(p, str) and p and not set(p) & set("'?"):
            return Typed(ANY, F.try_variant_get(v.col, f"$['{p}']", "variant"), v.err)
        if isinstance(p, str):
            return Typed(ANY, F.try_element_at(F.try_variant_get(v.col, "$", "map<string,variant>"), F.lit(p)), v.err)
        return Typed(ANY, F.try_element_at(F.try_variant_get(v.col, "$", "array<variant>"), F.lit(p + 1 if p >= 0 else p)), v.err)

    def on_array(self, node: s.Array) -> Typed:
        items = [self.sure(x) for x in node.items]
        kind = NULL
        for x in items:
            kind = unify(kind, x.kind)
        if not items:
            return Typed(array_of(NULL), F.array(), const=[], nullable=False)
        if kind.tag == "regex":  # patterns are known on the driver alone
            return Typed(array_of(kind), F.array(), const=[x.const for x in items], nullable=False, extra={"items": items})
        if any(x.kind.tag == "regex" or x.parts is not None and not x.is_const and "patterns" in x.parts for x in items):
            return Typed(array_of(STRING), F.array().cast("array<string>"), nullable=False, extra={"items": items})
        out = value(array_of(kind), F.array(*[as_kind(x, kind).column() for x in items]), *items, nullable=False)
        if all(x.is_const for x in items):
            out.const = [x.const for x in items]
        out.extra["items"] = items
        return out

    def on_object(self, node: s.Object) -> Typed:
        parts = {k: self.sure(x) for k, x in node.items.items()}
        out = Typed(object_kind(parts), parts=parts, nullable=False)
        if all(x.is_const for x in parts.values()):
            out.const = {k: x.const for k, x in parts.items()}
        return out

    def on_block(self, node: s.Block) -> Typed:
        outer = set(self.env.names)
        out = const(None)
        for i, x in enumerate(node.body):
            out = self.statement(x) if i < len(node.body) - 1 else self.expr(x)
        self.env.names = {k: v for k, v in self.env.names.items() if k in outer}
        return out

    def on_if(self, node: s.If) -> Typed:
        test = self.sure(node.test, 630)
        if test.kind.tag == "any":
            raise CompileError(102, "non-boolean predicate", node.at)
        if test.kind != BOOL:
            raise CompileError(102, "non-boolean predicate", node.at)
        cond = F.coalesce(test.col, F.lit(False))
        before = self.env
        self.env = then_env = before.copy()
        then = self.expr(node.then)
        then_env = self.env
        self.env = before.copy()
        other = self.expr(node.other) if node.other is not None else const(None)
        self.env = self.merge(cond, then_env, self.env, before)
        return self.choose(cond, then, other)

    def choose(self, cond: Column, a: Typed, b: Typed) -> Typed:
        if a is b:
            return a
        if a.parts is not None and b.parts is not None and set(a.parts) == set(b.parts):
            parts = {k: self.choose(cond, a.parts[k], b.parts[k]) for k in a.parts}
            return Typed(object_kind(parts), parts=parts, err=self.choose_err(cond, a.err, b.err))
        kind = unify(a.kind, b.kind)
        err = self.choose_err(cond, a.err, b.err)
        if kind == NULL:
            return Typed(NULL, F.lit(None), err, const=None)
        return Typed(kind, F.when(cond, as_kind(a, kind).column()).otherwise(as_kind(b, kind).column()), err, nullable=a.nullable or b.nullable)

    def choose_err(self, cond: Column, a: Column | None, b: Column | None) -> Column | None:
        if a is None and b is None:
            return None
        none = F.lit(None).cast("string")
        return F.when(cond, a if a is not None else none).otherwise(b if b is not None else none)

    def merge(self, cond: Column, a: Env, b: Env, before: Env) -> Env:
        out = before.copy()
        out.event, out.meta = self.merge_object(cond, a.event, b.event), self.merge_object(cond, a.meta, b.meta)
        for k in before.names:
            out.names[k] = self.choose(cond, a.names[k], b.names[k])
        none = F.lit(None).cast("string")
        if a.status is not before.status or b.status is not before.status:
            out.status = F.when(cond, a.status if a.status is not None else none).otherwise(b.status if b.status is not None else none)
            out.message = F.when(cond, a.message if a.message is not None else none).otherwise(b.message if b.message is not None else none)
        if a.result is not b.result:
            out.result = self.choose(cond, a.result or const(None), b.result or const(None))
        return out

    def merge_object(self, cond: Column, a: Typed, b: Typed) -> Typed:
        if a is b or a.parts is None or b.parts is None:
            return self.choose(cond, a, b)
        parts = {}
        for k in [*a.parts, *(k for k in b.parts if k not in a.parts)]:
            x, y = a.parts.get(k, const(None)), b.parts.get(k, const(None))
            parts[k] = self.merge_object(cond, x, y) if x.parts is not None and y.parts is not None else self.choose(cond, x, y)
        return Typed(object_kind(parts), parts=parts)

    def on_not(self, node: s.Not) -> Typed:
        v = self.expr(node.value)
        if v.kind.tag == "any":
            v = from_any(v, "bool", "!")
        if v.kind != BOOL:
            raise CompileError(660, f"non-boolean negation of {v.kind}", node.at)
        return value(BOOL, ~v.col, v)

    def on_binary(self, node: s.Binary) -> Typed:
        a = self.expr(node.left)
        if node.op == "??":
            if a.err is None:
                raise CompileError(651, "unnecessary error coalescing operation", node.at)
            b = self.expr(node.right)
            out = self.choose(a.err.isNull(), a.with_err(None), b.with_err(None))
            return out.with_err(None if b.err is None else F.when(a.err.isNotNull(), b.err))
        b = self.expr(node.right)
        return self.operate(node.op, a, b, node.at)

    def operate(self, op: str, a: Typed, b: Typed, at: int) -> Typed:
        ka, kb = a.kind.tag, b.kind.tag
        number = ("int", "float")
        if op == "||":
            if ka == "bool" and kb == "bool":
                return value(BOOL, F.coalesce(a.col, F.lit(False)) | F.coalesce(b.col, F.lit(False)), a, b)
            if ka == "null":
                return b
            test = a.column().isNotNull() & (a.col if ka == "bool" else F.lit(True))
            if ka == "any":
                test = test & ~F.is_variant_null(a.col) & ~F.coalesce(F.try_variant_get(a.col, "$", "boolean") == F.lit(False), F.lit(False)) if True else test
            out = self.choose(test, a.with_err(None), b.with_err(None))
            return out.with_err(first_error(a.err, b.err if b.err is None else F.when(~test, b.err)))
        if op == "&&":
            if ka == "null":
                return const(False)
            a, b = (x if x.kind.tag != "any" else from_any(x, "bool", "&&") for x in (a, b))
            if a.kind != BOOL or b.kind.tag not in ("bool", "null"):
                raise CompileError(610, f"can't apply an AND to types {a.kind} and {b.kind}", at)
            right = F.coalesce(b.col, F.lit(False)) if b.kind == BOOL else F.lit(False)
            return value(BOOL, F.coalesce(a.col, F.lit(False)) & right, a, b)
        if op in ("==", "!="):
            same = self.equal(a, b)
            return value(BOOL, same if op == "==" else ~same, a, b, nullable=False)
        if op in ("<", "<=", ">", ">="):
            if "any" in (ka, kb):
                a, b = self.alike(a, b)
                ka, kb = a.kind.tag, b.kind.tag
            if not (ka in number and kb in number or ka == kb and ka in ("string", "time")):
                return value(BOOL, F.lit(False), a, b, err=F.lit(f"can't compare {a.kind} {op} {b.kind}"))
            x, y = a.col, b.col
            return value(BOOL, {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], a, b)
        if op == "|":
            if a.parts is not None and b.parts is not None:
                parts = a.parts | b.parts
                return Typed(object_kind(parts), parts=parts, err=first_error(a.err, b.err))
            if not {ka, kb} <= {"object", "map", "any"}:
                raise CompileError(652, "only objects can be merged", at)
            return FUNCTIONS["merge"].lower(self, to=a, from_=b, deep=const(False))
        if "any" in (ka, kb):
            a, b = self.alike(a, b)
            ka, kb = a.kind.tag, b.kind.tag
        if op == "+" and {ka, kb} <= {"string", "null"} and "string" in (ka, kb):
            return value(STRING, F.concat(to_text(a), to_text(b)), a, b, nullable=False)
        if op == "*" and {ka, kb} == {"string", "int"}:
            text, n = (a, b) if ka == "string" else (b, a)
            return value(STRING, F.repeat(text.col, F.greatest(n.col, F.lit(0)).cast("int")), a, b)
        if ka not in number or kb not in number:
            raise CompileError(610, f"can't calculate {a.kind} {op} {b.kind}", at)
        if op == "/":
            zero = None if b.is_const and b.const != 0 else F.when(b.col == 0, F.lit("can't divide by zero"))
            return value(FLOAT, F.try_divide(a.col.cast("double"), b.col.cast("double")), a, b, err=zero)
        if ka == kb == "int":
            out = value(INT, wrapped(op, a.col, b.col), a, b)
        else:
            x, y = a.col.cast("double"), b.col.cast("double")
            out = value(FLOAT, {"+": x + y, "-": x - y, "*": x * y}[op], a, b)
        return out

    def alike(self, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        """A VARIANT beside a value of known kind takes that kind, with an error where it is another."""
        if a.kind.tag == "any" and b.kind.tag == "any":
            return from_any(a, "float", "operand"), from_any(b, "float", "operand")
        if a.kind.tag == "any":
            return self.number_or(a, b.kind.tag), b
        return a, self.number_or(b, a.kind.tag)

    def number_or(self, v: Typed, tag: str) -> Typed:
        if tag == "float":
            got = variant_tag(v.col)
            good = got.isin("integer", "float")
            return Typed(FLOAT, F.when(good, F.try_variant_get(v.col, "$", "double")), first_error(v.err, F.when(~good, F.concat(F.lit("expected float, got "), got))))
        return from_any(v, "string" if tag == "null" else tag, "operand")

    def equal(self, a: Typed, b: Typed) -> Column:
        ka, kb = a.kind.tag, b.kind.tag
        if ka == "null" or kb == "null":
            v = b if ka == "null" else a
            return F.lit(True) if v.kind.tag == "null" else v.column().isNull() | F.is_variant_null(v.col) if v.kind.tag == "any" else v.column().isNull()
        if ka == kb and ka not in ("any", "object", "array", "map") or {ka, kb} == {"int", "float"}:
            return a.column().eqNullSafe(b.column())
        if "any" in (ka, kb) or ka == kb:
            return json_of(a).eqNullSafe(json_of(b))
        return F.lit(False)

    # --- assignment

    def on_assign(self, node: s.Assign) -> Typed:
        if len(node.targets) == 2:
            v = self.expr(node.value)
            if v.err is None:
                raise CompileError(104, "unnecessary error assignment", node.at)
            if v.kind.tag == "regex":  # known when compiled, or never
                ok, err = v.with_err(None), Typed(STRING, v.err)
                for target, new in zip(node.targets, (ok, err), strict=True):
                    if target is not None:
                        self.put(target, new)
                return ok
            good = v.err.isNull()
            ok_kind = v.kind
            ok = Typed(ok_kind, F.when(good, as_kind(v, ok_kind).column()).otherwise(default_of(ok_kind))) if ok_kind != NULL else const(None)
            err = Typed(STRING, v.err)
            for target, new in zip(node.targets, (ok, err), strict=True):
                if target is not None:
                    self.put(target, new)
            return ok
        target = node.targets[0]
        v = self.expr(node.value)
        if v.err is not None:
            raise CompileError(103, "unhandled fallible assignment", node.at)
        if node.merge:
            v = self.operate("|", self.expr(target), v, node.at)
        if target is not None:
            self.put(target, v)
        return v

    def changing(self, target: s.Node) -> None:
        """An error if target, a part of it or what it is a part of may only be read."""
        if not isinstance(target, s.Query):
            return
        for root, path, deep in self.read_only:
            n = len(target.path)
            if root == target.root and (path[:n] == target.path or deep and target.path[: len(path)] == path):
                raise CompileError(315, "mutation of read-only value", target.at)

    def put(self, target: s.Node, v: Typed) -> None:
        self.changing(target)
        env = self.env
        returned = env.status is not None and self.may_return
        if isinstance(target, s.Variable):
            old = env.names.get(target.name)
            env.names[target.name] = v
            return
        if target.root == ".":
            new = self.insert(env.event, target.path, v)
            env.event = self.merge_object(env.status.isNull(), new, env.event) if returned else new
        elif target.root == "%":
            env.meta = self.insert(env.meta, target.path, v)
        else:
            name = target.root.name
            env.names[name] = self.insert(env.names.get(name, const(None)), target.path, v)

    may_return = False

    def insert(self, base: Typed, path: list[str | int], v: Typed) -> Typed:
        """base with v at path: parents are made, what isn't a container is replaced."""
        if not path:
            return v
        p, rest = path[0], path[1:]
        if isinstance(p, str):
            if base.kind.tag in ("map", "any") and base.parts is None:
                held = base if base.kind.tag == "map" else from_any(base, "object", "target")
                kind = unify(held.kind.elem, self.insert(self.get(base, [p]), rest, v).kind)
                inner = as_kind(self.insert(self.get(base, [p]), rest, v), kind).column()
                return Typed(Kind("map", kind), F.map_concat(F.map_filter(as_kind(replace(held, err=None), Kind("map", kind)).column(), lambda k, _: k != p), F.create_map(F.lit(p), inner)))
            parts = dict(self.parts_of(base))
            parts[p] = self.insert(parts.get(p, const(None)), rest, v)
            return Typed(object_kind(parts), parts=parts)
        if base.kind.tag == "array":
            inner = self.insert(self.get(base, [p]), rest, v)
            kind = unify(base.kind.elem, inner.kind)
            a, x = as_kind(base, array_of(kind)).column(), as_kind(inner, kind).column()
            null = F.lit(None).cast(kind.sql())
            size = F.size(a)
            if p >= 0:
                padded = F.concat(a, F.array_repeat(null, F.greatest(F.lit(p + 1) - size, F.lit(0)).cast("int")))
                return Typed(array_of(kind), F.transform(padded, lambda e, i: F.when(i == p, x).otherwise(e)))
            padded = F.concat(F.array_repeat(null, F.greatest(F.lit(-p) - size, F.lit(0)).cast("int")), a)
            return Typed(array_of(kind), F.transform(padded, lambda e, i: F.when(i == F.greatest(size + p, F.lit(0)), x).otherwise(e)))
        inner = self.insert(const(None), rest, v)
        if p >= 0:
            return Typed(array_of(inner.kind), F.array(*[F.lit(None).cast(inner.kind.sql())] * p, inner.column()))
        return Typed(array_of(inner.kind), F.array(inner.column(), *[F.lit(None).cast(inner.kind.sql())] * (-p - 1)))

    def parts_of(self, v: Typed) -> dict[str, Typed]:
        if v.parts is not None:
            return v.parts
        if v.kind.tag == "object":
            return {n: Typed(k, v.col.getField(n), v.err) for n, k in v.kind.fields}
        return {}

    def remove(self, base: Typed, path: list[str | int], compact: bool = False) -> Typed:
        if not path:
            return Typed(Kind("object", fields=()), parts={})
        p, rest = path[0], path[1:]
        if isinstance(p, str):
            if base.kind.tag == "map":
                return Typed(base.kind, F.map_filter(base.col, lambda k, _: k != p)) if not rest else base
            if base.kind.tag == "any":
                held = F.map_filter(F.try_variant_get(base.col, "$", "map<string,variant>"), lambda k, _: k != p)
                return Typed(ANY, F.coalesce(F.to_variant_object(held), base.col)) if not rest else base
            parts = dict(self.parts_of(base))
            if p not in parts:
                return base
            if rest:
                inner = self.remove(parts[p], rest, compact)
                if compact and inner.parts == {}:
                    del parts[p]
                else:
                    parts[p] = inner
            else:
                del parts[p]
            return Typed(object_kind(parts), parts=parts)
        if base.kind.tag == "array" and not rest:
            size = F.size(base.col)
            at = F.lit(p) if p >= 0 else size + p
            return Typed(base.kind, F.filter(base.col, lambda _, i: i != at))
        return base

    # --- calls and ends

    def on_abort(self, node: s.Abort) -> Typed:
        message = None
        if node.message is not None:
            v = self.sure(node.message, 631)
            message = to_text(v)
        self.end("aborted", None, message)
        return const(None)

    def on_return(self, node: s.Return) -> Typed:
        v = self.sure(node.value, 631)
        running = self.env.status.isNull() if self.env.status is not None else None
        old = self.env.result
        self.env.result = v if running is None or old is None else self.choose(running, v, old)
        self.end("returned", None, None)
        self.may_return = True
        return const(None)

    def on_call(self, node: s.Call) -> Typed:
        f = FUNCTIONS.get(node.name)
        if f is None:
            raise CompileError(105, f"call to undefined function {node.name}{s.nearest(node.name, FUNCTIONS)}", node.at)
        if f.closure and node.closure is None:
            raise CompileError(111, f"{node.name} needs a closure", node.at)
        given: dict[str, s.Node] = {}
        names = [p.name for p in f.params]
        for i, (name, arg) in enumerate(node.args):
            if name is None:
                free = [n for n in names if n not in given]
                if not free:
                    raise CompileError(106, f"wrong number of arguments for {node.name}", node.at)
                name = free[0] if i < len(names) else free[0]
            elif name not in names:
                raise CompileError(108, f"unknown function argument {name}{s.nearest(name, names)}", node.at)
            given[name] = arg
        args: dict[str, object] = {}
        for p in f.params:
            key = p.name + "_" if p.name in ("from", "with", "except", "class", "null", "object", "type") else p.name
            if p.name not in given:
                if p.required:
                    raise CompileError(107, f"missing function argument {p.name} of {node.name}", node.at)
                args[key] = None if p.default is None else const(p.default)
            elif f.raw:
                args[key] = given[p.name]
            else:
                v = self.expr(given[p.name])
                if v.err is not None and v.kind.tag != "any":
                    raise CompileError(630, f"fallible argument of {node.name}", node.at)
                if v.kind.tag == "any" or v.extra.get("heavy"):
                    v = self.hoisted(v)
                args[key] = narrowed(v, p.kinds, f"{node.name}({p.name})")
        if node.closure is not None:
            args["closure"] = node.closure
        out = f.lower(self, **args)
        if out.err is not None or out.kind.tag in ("any", "array", "map", "object"):
            out = self.hoisted(out)
        if node.bang:
            if out.err is None:
                raise CompileError(620, f"can't abort infallible function {node.name}", node.at)
            if self.inside:
                out.extra["bang"] = True
                return out.with_err(out.err)
            prefix = f'function call error for "{node.name}" at ({node.at}): '
            self.end("error", out.err.isNotNull(), F.concat(F.lit(prefix), out.err))
            return out.with_err(None)
        return out

    def call_closure(self, closure: s.Closure, *values: Typed) -> Typed:
        """The closure's value, its parameters bound; what it assigns stays inside."""
        before = self.env
        self.env = before.copy()
        self.inside += 1
        for name, v in zip(closure.params, values, strict=False):
            if name != "_":
                self.env.names[name] = v
        out = self.on_block(closure.body)
        self.inside -= 1
        self.closed, self.env = self.env, before
        return out


def json_of(v: Typed) -> Column:
    from .typed import json_text

    return json_text(v)


def wrapped(op: str, a: Column, b: Column) -> Column:
    """Integer arithmetic modulo 2**64: the quick way, and decimals where it overflows."""
    quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    x, y = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    wide = {"+": x + y, "-": x - y, "*": x * y}[op]
    two64, two63 = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    turned = (F.pmod(wide.cast("decimal(38,0)") + two63, two64) - two63).cast("bigint") if op != "*" else F.lit(None).cast("bigint")
    return F.coalesce(quick, F.when(a.isNotNull() & b.isNotNull(), turned))
