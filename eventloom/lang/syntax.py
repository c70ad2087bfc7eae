"""Lexer, syntax tree and parser of the remapping language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class CompileError(Exception):
    """A program that can't be compiled: code, message, and the offset in the source."""

    def __init__(self, code: int, message: str, at: int = 0):
        super().__init__(f"error[E{code}]: {message} (at {at})")
        self.code, self.message, self.at = code, message, at


def nearest(name: str, known, most: int = 2) -> str:
    """A hint at the known name that differs least from name, in letters left out, put in, changed or swapped; "" if none is near."""

    def distance(a: str, b: str) -> int:
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    row[-1] = min(row[-1], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    best = min(((distance(name, k), k) for k in known if abs(len(k) - len(name)) <= most), default=(most + 1, ""))
    return f', did you mean "{best[1]}"?' if best[0] <= most else ""


@dataclass
class Token:
    kind: str  # int float string raw regex time name op newline end
    value: object
    at: int
    space: bool = False  # white space before it


# Words that can't be names.
KEYWORDS = {"if", "else", "true", "false", "null", "abort", "return"}
RESERVED = set("as async await break case class const continue do each emit enum export extern fn for from goto impl import in let loop match mod move mut new pub ref self Self static struct super switch this throw trait try type unless until use var virtual void where while yield".split()) - {"match", "mod", "type", "new", "import", "from", "in", "do"}

_SPACE = re.compile(r"(?:[ \t\r]|\\\n|#[^\n]*)+")
_NUMBER = re.compile(r"\d[\d_]*(\.\d[\d_]*)?(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_OPS = ["??", "||", "&&", "==", "!=", "<=", ">=", "|=", "->", "=", "|", "<", ">", "+", "-", "*", "/", "!", "(", ")", "[", "]", "{", "}", ",", ":", ".", "%", ";", "?", "@"]
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "'": "'", "0": "\0", "{": "{", "}": "}"}


def unescape(text: str, at: int) -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c != "\\":
            out.append(c)
            i += 1
        elif i + 1 < len(text) and text[i + 1] == "u" and (m := re.match(r"u\{([0-9A-Fa-f]{1,6})\}", text[i + 1 :])):
            out.append(chr(int(m[1], 16)))
            i += 1 + len(m[0])
        elif i + 1 < len(text) and text[i + 1] == "\n":
            i += 2
            while i < len(text) and text[i].isspace():
                i += 1
        elif i + 1 < len(text) and text[i + 1] in _ESCAPES:
            out.append(_ESCAPES[text[i + 1]])
            i += 2
        else:
            raise CompileError(209, f"invalid escape character: \\{text[i + 1 : i + 2]}", at)
    return "".join(out)


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    i, space = 0, False

    def add(kind, value, at):
        nonlocal space
        out.append(Token(kind, value, at, space))
        space = False

    while i < len(source):
        if m := _SPACE.match(source, i):
            i, space = m.end(), True
            continue
        c = source[i]
        if c == "\n":
            add("newline", "\n", i)
            i, space = i + 1, True
        elif c == '"' or (c in "srt" and source[i + 1 : i + 2] == "'"):
            quote = '"' if c == '"' else "'"
            j = start = i + (1 if c == '"' else 2)
            while j < len(source) and source[j] != quote:
                j += 2 if source[j] == "\\" else 1
            if j >= len(source):
                raise CompileError(202, "unterminated literal", i)
            body = source[start:j]
            kind = {'"': "string", "s": "raw", "r": "regex", "t": "time"}[c]
            add(kind, body if kind == "string" else body.replace("\\'", "'"), i)
            i = j + 1
        elif m := _NUMBER.match(source, i) if c.isdigit() else None:
            text = m[0].replace("_", "")
            add("float" if m[1] or "e" in text.lower() else "int", float(text) if m[1] or "e" in text.lower() else int(text), i)
            i = m.end()
        elif m := _NAME.match(source, i):
            add("name", m[0], i)
            i = m.end()
        else:
            op = next((o for o in _OPS if source.startswith(o, i)), None)
            if op is None:
                raise CompileError(202, f"unexpected character {c!r}", i)
            add("op", op, i)
            i += len(op)
    out.append(Token("end", "", len(source)))
    return out


@dataclass
class Node:
    at: int = field(default=0, kw_only=True)


@dataclass
class Literal(Node):
    value: object
    kind: str


@dataclass
class Template(Node):
    parts: list[str | Variable]


@dataclass
class Query(Node):
    root: str | Node  # "." or "%" or an expression
    path: list[str | int]


@dataclass
class Variable(Node):
    name: str


@dataclass
class Array(Node):
    items: list[Node]


@dataclass
class Object(Node):
    items: dict[str, Node]


@dataclass
class Block(Node):
    body: list[Node]


@dataclass
class If(Node):
    test: Node
    then: Node
    other: Node | None


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Not(Node):
    value: Node


@dataclass
class Call(Node):
    name: str
    args: list[tuple[str | None, Node]]
    bang: bool
    closure: Closure | None


@dataclass
class Closure(Node):
    params: list[str]
    body: Block


@dataclass
class Assign(Node):
    targets: list[Node | None]  # one, or value and error; None for _
    value: Node
    merge: bool = False


@dataclass
class Abort(Node):
    message: Node | None


@dataclass
class Return(Node):
    value: Node


class Parser:
    def __init__(self, source: str):
        self.source, self.all, self.i = source, tokens(source), 0

    # --- helpers

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.all[min(self.i + n, len(self.all) - 1)]

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "op" and self.now.value in ops

    def is_word(self, word: str) -> bool:
        return self.now.kind == "name" and self.now.value == word

    def take(self) -> Token:
        self.i += 1
        return self.all[self.i - 1]

    def need(self, op: str) -> Token:
        if not self.is_op(op):
            raise CompileError(203, f"syntax error: expected {op!r}, got {self.now.value!r}", self.now.at)
        return self.take()

    def skip(self) -> None:
        while self.now.kind == "newline":
            self.take()

    def breaks(self) -> None:
        while self.now.kind == "newline" or self.is_op(";"):
            self.take()

    # --- statements

    def program(self) -> Block:
        body = self.statements("end")
        return Block(body)

    def statements(self, stop: str) -> list[Node]:
        body = []
        self.breaks()
        while not (self.now.kind == "end" or stop != "end" and self.is_op(stop)):
            body.append(self.statement())
            if not (self.now.kind in ("newline", "end") or self.is_op(";") or stop != "end" and self.is_op(stop)):
                raise CompileError(203, f"syntax error: unexpected {self.now.value!r}", self.now.at)
            self.breaks()
        return body

    def target(self) -> Node | None:
        if self.is_word("_"):
            self.take()
            return None
        node = self.postfix()
        if not isinstance(node, (Variable, Query)) or isinstance(node, Query) and not (node.root in (".", "%") or isinstance(node.root, Variable)):
            raise CompileError(203, "syntax error: not a target of an assignment", node.at)
        return node

    def statement(self) -> Node:
        return self.expression()

    def expression(self) -> Node:
        start, at = self.i, self.now.at
        if self.now.kind == "name" and self.now.value not in KEYWORDS or self.is_op(".", "%"):
            try:
                first = self.target()
                if self.is_op(",") :
                    self.take()
                    self.skip()
                    second = self.target()
                    if self.is_op("="):
                        self.take()
                        self.skip()
                        return Assign([first, second], self.expression(), at=at)
                elif self.is_op("=", "|="):
                    op = self.take().value
                    self.skip()
                    return Assign([first], self.expression(), op == "|=", at=at)
            except CompileError:
                pass
            self.i = start
        return self.binary(0)

    _LEVELS = [["??"], ["||", "&&"], ["==", "!="], [">", ">=", "<", "<="], ["|"], ["+", "-"], ["*", "/"]]

    def binary(self, level: int) -> Node:
        if level == len(self._LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            mark = self.i
            self.skip()
            if not self.is_op(*self._LEVELS[level]) or mark != self.i and self.now.value in ("-", "|"):
                self.i = mark
                return left
            op = self.take()
            self.skip()
            right = self.binary(level + 1)
            if level == 3 and isinstance(left, Binary) and left.op in self._LEVELS[3]:
                raise CompileError(650, "comparison operators can't be chained together", op.at)
            left = Binary(op.value, left, right, at=op.at)

    def unary(self) -> Node:
        if self.is_op("!"):
            at = self.take().at
            return Not(self.unary(), at=at)
        if self.is_op("-") and self.ahead().kind in ("int", "float"):
            at = self.take().at
            t = self.take()
            return Literal(-t.value, t.kind, at=at)
        return self.postfix()

    def path(self) -> list[str | int]:
        """Segments that follow a root, from a dot or bracket on, with no space between."""
        out: list[str | int] = []
        while not self.now.space and (self.is_op(".") and self.segment_follows() or self.is_op("[")):
            if self.is_op("."):
                self.take()
                out.append(self.segment())
            else:
                self.take()
                negative = self.is_op("-") and bool(self.take())
                if self.now.kind != "int":
                    raise CompileError(203, "syntax error: an index must be an integer", self.now.at)
                n = self.take().value
                out.append(-n if negative else n)
                self.need("]")
        return out

    def segment_follows(self) -> bool:
        t = self.ahead()
        return not t.space and (t.kind in ("name", "string", "int") or t.kind == "op" and t.value in ("@", "("))

    def segment(self) -> str:
        t = self.take()
        if t.kind == "string":
            return unescape(t.value, t.at)
        if t.kind == "op" and t.value == "@":
            return "@" + self.take().value
        if t.kind in ("name", "int"):
            text = str(t.value)
            while not self.now.space and (self.now.kind in ("name", "int") or self.is_op("@")):
                text += str(self.take().value)
            return text
        raise CompileError(203, f"syntax error: unexpected {t.value!r} in a path", t.at)

    def postfix(self) -> Node:
        at = self.now.at
        if self.is_op(".", "%"):
            root = self.take().value
            path: list[str | int] = []
            if not self.now.space and (self.now.kind in ("name", "string", "int") or self.is_op("@")):
                path.append(self.segment())
                path += self.path()
            elif not self.now.space and self.is_op("["):
                path += self.path()
            return Query(root, path, at=at)
        node = self.term()
        path = self.path()
        return Query(node, path, at=at) if path else node

    def term(self) -> Node:
        t = self.now
        if t.kind in ("int", "float"):
            self.take()
            return Literal(t.value, t.kind, at=t.at)
        if t.kind == "string":
            self.take()
            return self.template(t)
        if t.kind in ("raw", "regex", "time"):
            self.take()
            return Literal(t.value, {"raw": "string", "regex": "regex", "time": "time"}[t.kind], at=t.at)
        if self.is_op("("):
            self.take()
            self.skip()
            body = [self.expression()]
            self.breaks()
            while not self.is_op(")"):
                body.append(self.expression())
                self.breaks()
            self.take()
            return body[0] if len(body) == 1 else Block(body, at=t.at)
        if self.is_op("["):
            self.take()
            items = self.listed("]", self.expression)
            return Array(items, at=t.at)
        if self.is_op("{"):
            return self.braces()
        if t.kind == "name":
            return self.named()
        raise CompileError(203, f"syntax error: unexpected {t.value!r}", t.at)

    def listed(self, stop: str, each) -> list:
        out = []
        self.skip()
        while not self.is_op(stop):
            out.append(each())
            self.skip()
            if not self.is_op(stop):
                self.need(",")
                self.skip()
        self.take()
        return out

    def template(self, t: Token) -> Node:
        parts: list[str | Variable] = []
        last = 0
        for m in re.finditer(r"(?<!\\)\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}", t.value):
            parts += [unescape(t.value[last : m.start()], t.at), Variable(m[1], at=t.at)]
            last = m.end()
        if not parts:
            return Literal(unescape(t.value, t.at), "string", at=t.at)
        parts.append(unescape(t.value[last:], t.at))
        return Template([p for p in parts if p != ""], at=t.at)

    def braces(self) -> Node:
        at = self.need("{").at
        mark = self.i
        self.skip()
        if self.is_op("}"):
            self.take()
            return Object({}, at=at)
        if self.now.kind == "string":
            n = 1
            while self.ahead(n).kind == "newline":
                n += 1
            if self.ahead(n).kind == "op" and self.ahead(n).value == ":":

                def entry():
                    if self.now.kind != "string":
                        raise CompileError(203, "syntax error: an object's key must be a string", self.now.at)
                    k = self.take()
                    self.skip()
                    self.need(":")
                    self.skip()
                    return unescape(k.value, k.at), self.expression()

                return Object(dict(self.listed("}", entry)), at=at)
        self.i = mark
        body = self.statements("}")
        self.need("}")
        return Block(body, at=at)

    def block(self) -> Block:
        node = self.braces()
        return node if isinstance(node, Block) else Block([node], at=node.at)

    def named(self) -> Node:
        t = self.take()
        word = t.value
        if word in ("true", "false"):
            return Literal(word == "true", "bool", at=t.at)
        if word == "null":
            return Literal(None, "null", at=t.at)
        if word == "if":
            return self.branch(t.at)
        if word == "abort":
            message = None if self.now.kind in ("newline", "end") or self.is_op("}", ";", ")") else self.expression()
            return Abort(message, at=t.at)
        if word == "return":
            return Return(self.expression(), at=t.at)
        if self.is_op("(") and not self.now.space or self.is_op("!") and self.ahead().kind == "op" and self.ahead().value == "(" and not self.now.space:
            bang = self.is_op("!") and bool(self.take())
            self.need("(")
            args = self.listed(")", self.argument)
            closure = None
            if self.is_op("->"):
                self.take()
                closure = self.closure()
            return Call(word, args, bang, closure, at=t.at)
        if word in RESERVED:
            raise CompileError(205, f"reserved keyword: {word}", t.at)
        return Variable(word, at=t.at)

    def argument(self) -> tuple[str | None, Node]:
        if self.now.kind == "name" and self.ahead().kind == "op" and self.ahead().value == ":":
            name = self.take().value
            self.take()
            self.skip()
            return name, self.expression()
        return None, self.expression()

    def closure(self) -> Closure:
        at = self.now.at
        params = []
        if self.is_op("||"):
            self.take()
        else:
            self.need("|")
            while not self.is_op("|"):
                params.append(str(self.take().value))
                if self.is_op(","):
                    self.take()
            self.take()
        self.skip()
        return Closure(params, self.block(), at=at)

    def branch(self, at: int) -> Node:
        test = self.binary(0)
        self.skip()
        then = self.block()
        mark = self.i
        self.skip()
        if not self.is_word("else"):
            self.i = mark
            return If(test, then, None, at=at)
        self.take()
        self.skip()
        if self.is_word("if"):
            at = self.take().at
            return If(test, then, Block([self.branch(at)], at=at), at=at)
        return If(test, then, self.block(), at=at)


def parse(source: str) -> Block:
    return Parser(source).program()
