"""The formula language: arithmetic and logic over named metrics, compiled to columns.

    or < and < not < one comparison < + - < * / < ^ (right) < unary minus < primary

Unary minus binds tighter than ^. Constants phi, pi and e, and the functions sqrt, abs, log, log2 and
exp, of one argument. Comparisons count as 0 and 1 in arithmetic; a gate is open when its value
is not 0. `and` and `or` leave their right side unevaluated where the left side decides. In strict
mode division by zero, overflow and logarithms out of range raise; else they give null.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.constants import PHI

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>>=|<=|==|!=|[-+*/^()<>]))")
CONSTANTS = {"phi": PHI, "pi": math.pi, "e": math.e}
FUNCTIONS = ("sqrt", "abs", "log", "log2", "exp")


@dataclass(frozen=True)
class Node:
    kind: str  # number, metric, neg, not, call, or an operator
    value: object = None
    args: tuple[Node, ...] = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected character at {at}: {text[at:].strip()[:1]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    LEVELS = (("or",), ("and",))

    def __init__(self, text: str):
        self.rest = tokens(text)
        if not self.rest:
            raise SyntaxError("empty formula")

    def peek(self) -> str | None:
        if not self.rest:
            return None
        kind, text = self.rest[0]
        return text.lower() if kind == "name" else text

    def take(self, *texts: str) -> str | None:
        if self.peek() in texts and self.rest[0][0] != "number":
            return self.rest.pop(0)[1].lower()
        return None

    def whole(self) -> Node:
        node = self.logic(0)
        if self.rest:
            raise SyntaxError(f"unexpected {self.rest[0][1]!r}")
        return node

    def logic(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.negation()
        left = self.logic(level + 1)
        while op := self.take(*self.LEVELS[level]):
            left = Node(op, args=(left, self.logic(level + 1)))
        return left

    def negation(self) -> Node:
        return Node("not", args=(self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        left = self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.power))
        if op := self.take(">=", "<=", "==", "!=", ">", "<"):
            return Node(op, args=(left, self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.power))))
        return left

    def chain(self, ops: tuple[str, ...], below) -> Node:
        left = below()
        while op := self.take(*ops):
            left = Node(op, args=(left, below()))
        return left

    def power(self) -> Node:
        base = self.unary()
        return Node("^", args=(base, self.power())) if self.take("^") else base

    def unary(self) -> Node:
        return Node("neg", args=(self.unary(),)) if self.take("-") else self.primary()

    def primary(self) -> Node:
        if not self.rest:
            raise SyntaxError("unexpected end of formula")
        kind, text = self.rest.pop(0)
        if kind == "number":
            return Node("number", float(text))
        if text == "(":
            node = self.logic(0)
            if not self.take(")"):
                raise SyntaxError("missing )")
            return node
        if kind == "name":
            if self.take("("):
                if text.lower() not in FUNCTIONS:
                    raise NameError(f"unknown function {text!r}; known: {', '.join(FUNCTIONS)}")
                node = Node("call", text.lower(), (self.logic(0),))
                if not self.take(")"):
                    raise SyntaxError("missing )")
                return node
            if text.lower() in CONSTANTS:
                return Node("number", CONSTANTS[text.lower()])
            if text.lower() in ("and", "or", "not"):
                raise SyntaxError(f"unexpected {text!r}")
            return Node("metric", text)
        raise SyntaxError(f"unexpected {text!r}")


def parse(text: str) -> Node:
    return _Parser(text).whole()


_COMPARE = {">": "gt", "<": "lt", ">=": "ge", "<=": "le", "==": "eq", "!=": "ne"}


class _Compiler:
    def __init__(self, names: list[str], strict: bool):
        self.names, self.strict = names, strict

    def fail(self, what: str) -> Column:
        return F.raise_error(F.lit(what)).cast("double") if self.strict else F.lit(None).cast("double")

    def boolean(self, node: Node) -> Column:
        if node.kind in _COMPARE:
            a, b = map(self.number, node.args)
            return getattr(a, f"__{_COMPARE[node.kind]}__")(b)
        if node.kind == "not":
            return ~self.boolean(node.args[0])
        if node.kind in ("and", "or"):
            a, b = map(self.boolean, node.args)
            return F.when(a, b).otherwise(F.lit(False)) if node.kind == "and" else F.when(a, F.lit(True)).otherwise(b)
        return self.number(node) != 0

    def number(self, node: Node) -> Column:
        if node.kind == "number":
            return F.lit(node.value)
        if node.kind == "metric":
            if node.value not in self.names:
                raise NameError(f"unknown metric {node.value!r}; known: {', '.join(sorted(self.names))}")
            return F.col(f"`{node.value}`").cast("double")
        if node.kind == "neg":
            return -self.number(node.args[0])
        if node.kind == "call":
            x = self.number(node.args[0])
            if node.value == "abs":
                return F.abs(x)
            if node.value == "exp":
                return F.when(x > 709.782712893384, self.fail("overflow in exp")).otherwise(F.exp(x))
            if node.value == "sqrt":
                return F.when(x < 0, self.fail("sqrt of a negative number")).otherwise(F.sqrt(x))
            f = F.log if node.value == "log" else F.log2
            return F.when(x <= 0, self.fail(f"{node.value} of a number that is not positive")).otherwise(f(x))
        if node.kind in ("+", "-", "*", "/", "^"):
            a, b = map(self.number, node.args)
            if node.kind == "/":
                return F.when(b == 0, self.fail("division by zero")).otherwise(F.try_divide(a, b))
            if node.kind == "^":
                value = F.pow(a, b)
                bad = F.isnan(value) | (F.abs(value) == float("inf"))
                return F.when((a == 0) & (b < 0), self.fail("division by zero")).when(bad, self.fail("power out of range")).otherwise(value)
            return {"+": a + b, "-": a - b, "*": a * b}[node.kind]
        return self.boolean(node).cast("double")


def formula(text: str, names: list[str], strict: bool = False) -> Column:
    """The formula's value as a double. Unknown names fail here, not at run time."""
    return _Compiler(names, strict).number(parse(text))


def gate(text: str, names: list[str], strict: bool = False) -> Column:
    return _Compiler(names, strict).boolean(parse(text))


def filter_gate(frame: DataFrame, text: str, closed: bool = False, strict: bool = False) -> DataFrame:
    """The rows whose gate is open (or closed, null included)."""
    opened = F.coalesce(gate(text, frame.columns, strict), F.lit(False))
    return frame.where(~opened if closed else opened)
