"""Rule expressions as Columns.

A rule is a boolean expression over Sample (Path, RelativePath, FileName, Extension, Format, SizeBytes), Metrics
(numbers by name) and Attributes (texts by name); missing names are 0 and "". It is parsed once on the driver
and becomes one Catalyst expression, so that all rules run in the scan of the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|&&|\|\||==|!=|<=|>=|\?\?|[-+*/%<>!()\[\].,?:]))""")
SAMPLE = {"Path": "path", "RelativePath": "relative_path", "FileName": "file_name", "Extension": "extension", "Format": "format", "SizeBytes": "size_bytes"}
POWER = {"||": 1, "or": 1, "&&": 2, "and": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "in": 4, "contains": 4, "startsWith": 4, "endsWith": 4, "matches": 4, "not": 4, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "**": 9}


class RuleError(ValueError):
    """A rule that cannot be used."""


@dataclass
class Value:
    """kind: num, str, bool, list, or the name of an environment object."""

    kind: str
    col: Column | list | None = None


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise RuleError(f"unexpected {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise RuleError("unexpected end")
        token = self.tokens[self.at]
        if want is not None and (token[1] != want or token[0] == "str"):
            raise RuleError(f"expected {want!r}, found {token[1]!r}")
        self.at += 1
        return token

    def whole(self) -> Column:
        out = self.ternary()
        if self.at < len(self.tokens):
            raise RuleError(f"unexpected {self.tokens[self.at][1]!r}")
        return _typed(out, "bool")

    def ternary(self) -> Value:
        test = self.expression(0)
        if self.peek() != "?":
            return test
        self.take()
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        if yes.kind != no.kind:
            raise RuleError("both outcomes must have one type")
        return Value(yes.kind, F.when(_typed(test, "bool"), yes.col).otherwise(no.col))

    def expression(self, least: int) -> Value:
        left = self.unary()
        while (op := self.peek()) in POWER and POWER[op] > least:
            self.take()
            negated = op == "not"
            if negated:
                op = self.take()[1]
                if op not in ("in", "contains", "startsWith", "endsWith", "matches"):
                    raise RuleError(f"unexpected not {op}")
            right = self.expression(POWER[op] - (op == "**"))
            left = _apply(op, left, right)
            if negated:
                left = Value("bool", ~left.col)
        return left

    def unary(self) -> Value:
        op = self.peek()
        if op in ("!", "not"):
            self.take()
            return Value("bool", ~_typed(self.expression(5), "bool"))
        if op in ("-", "+"):
            self.take()
            value = _typed(self.expression(8), "num")
            return Value("num", -value if op == "-" else value)
        return self.postfix()

    def postfix(self) -> Value:
        value = self.primary()
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                name = self.take()[1]
            else:
                kind, name = self.take()
                if kind != "str":
                    raise RuleError("names in brackets must be texts")
                name = _text(name)
                self.take("]")
            value = _member(value, name)
        return value

    def primary(self) -> Value:
        kind, text = self.take()
        if kind == "num":
            return Value("num", F.lit(float(text)))
        if kind == "str":
            return Value("str", F.lit(_text(text)))
        if text == "(":
            inner = self.ternary()
            self.take(")")
            return inner
        if text == "[":
            items = []
            while self.peek() != "]":
                items.append(self.ternary())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return Value("list", items)
        if kind == "name":
            if text in ("true", "false"):
                return Value("bool", F.lit(text == "true"))
            if text in ("Sample", "Metrics", "Attributes"):
                return Value(text)
            if self.peek() == "(":
                self.take()
                arguments = []
                while self.peek() != ")":
                    arguments.append(self.ternary())
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                return _call(text, arguments)
        raise RuleError(f"unknown name {text!r}")


def _text(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1])


def _typed(value: Value, kind: str) -> Column:
    if value.kind != kind:
        raise RuleError(f"expected {kind}, found {value.kind}")
    return value.col


def _member(value: Value, name: str) -> Value:
    if value.kind == "Sample" and name in SAMPLE:
        return Value("num", F.col(SAMPLE[name]).cast("double")) if name == "SizeBytes" else Value("str", F.coalesce(F.col(SAMPLE[name]), F.lit("")))
    if value.kind == "Metrics":
        return Value("num", F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0)))
    if value.kind == "Attributes":
        return Value("str", F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit("")))
    raise RuleError(f"{value.kind} has no {name!r}")


def _apply(op: str, a: Value, b: Value) -> Value:
    if op in ("&&", "and"):
        return Value("bool", _typed(a, "bool") & _typed(b, "bool"))
    if op in ("||", "or"):
        return Value("bool", _typed(a, "bool") | _typed(b, "bool"))
    if op == "in":
        if b.kind in ("Metrics", "Attributes"):
            return Value("bool", F.coalesce(F.map_contains_key(b.kind.lower(), _typed(a, "str")), F.lit(False)))
        found = F.lit(False)
        for item in _typed(b, "list"):
            found = found | (a.col == _typed(item, a.kind))
        return Value("bool", found)
    if op in ("contains", "startsWith", "endsWith", "matches"):
        x, y = _typed(a, "str"), _typed(b, "str")
        return Value("bool", {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}[op](x, y))
    if op in ("==", "!="):
        same = a.col == _typed(b, a.kind)
        return Value("bool", same if op == "==" else ~same)
    if op == "+" and a.kind == "str":
        return Value("str", F.concat(a.col, _typed(b, "str")))
    if op in ("<", ">", "<=", ">="):
        if a.kind not in ("num", "str"):
            raise RuleError(f"{op} of {a.kind}")
        y = _typed(b, a.kind)
        return Value("bool", {"<": a.col < y, ">": a.col > y, "<=": a.col <= y, ">=": a.col >= y}[op])
    x, y = _typed(a, "num"), _typed(b, "num")
    return Value("num", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y), "**": lambda: F.pow(x, y)}[op]())


def _call(name: str, arguments: list[Value]) -> Value:
    if name in ("lower", "upper", "trim") and len(arguments) == 1:
        return Value("str", getattr(F, name)(_typed(arguments[0], "str")))
    if name in ("abs", "ceil", "floor", "round") and len(arguments) == 1:
        return Value("num", getattr(F, name)(_typed(arguments[0], "num")).cast("double"))
    if name == "len" and len(arguments) == 1 and arguments[0].kind == "str":
        return Value("num", F.length(arguments[0].col).cast("double"))
    if name in ("min", "max") and len(arguments) > 1:
        return Value("num", (F.least if name == "min" else F.greatest)(*[_typed(a, "num") for a in arguments]))
    raise RuleError(f"unknown function {name!r}")


def compile_rule(text: str) -> Column:
    """The expression as a boolean Column over sample columns, metrics and attributes; null counts as false."""
    if not text.strip():
        raise RuleError("expression is required")
    return F.coalesce(_Parser(text).whole(), F.lit(False))
