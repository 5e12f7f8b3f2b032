"""Filters of a chart spec as Spark columns, so that they reach the scan; nothing is ever evaluated as code."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||===|!==|==|!=|<=|>=|[<>!+\-*/%().\[\]]))""")
WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
COMPARE = ("==", "===", "!=", "!==", "<", "<=", ">", ">=")
LEVELS = (("+", "-"), ("*", "/", "%"))


class FilterError(ValueError):
    """A filter outside the grammar."""


class _Parser:
    """or > and > not > comparison > sum > product > sign > primary; fields are datum.name or datum['name']."""

    def __init__(self, text: str, on):
        self.on, self.tokens, at = on, [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise FilterError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if (now := self.peek()) in wanted and now is not None:
            self.at += 1
            return now
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise FilterError(f"{wanted!r} is missing")

    def parse(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("||", "or"):
            out = self.on.either(out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.take("&&", "and"):
            out = self.on.both(out, self.negated())
        return out

    def negated(self):
        return self.on.negated(self.negated()) if self.take("!", "not") else self.compared()

    def compared(self):
        out = self.level(0)
        while op := self.take(*COMPARE):
            out = self.on.compared(op[:2], out, self.level(0))
        return out

    def level(self, k: int):
        if k == len(LEVELS):
            return self.on.computed("-", self.on.literal(0), self.level(k)) if self.take("-") else self.primary()
        out = self.level(k + 1)
        while op := self.take(*LEVELS[k]):
            out = self.on.computed(op, out, self.level(k + 1))
        return out

    def primary(self):
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise FilterError("unexpected end")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return self.on.literal(float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "str":
            return self.on.literal(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "name" and text in WORDS:
            return self.on.literal(WORDS[text])
        if kind == "name":
            if text == "datum" and self.take("."):
                text = self.tokens[self.at][1]
                self.at += 1
            elif text == "datum" and self.take("["):
                text = self.tokens[self.at][1][1:-1]
                self.at += 1
                self.need("]")
            return self.on.field(text)
        raise FilterError(f"unexpected {text!r}")


def field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Columns:
    """What a filter means for Spark.

    A missing value passes no comparison but an inequality, and negation has two values: what doesn't hold is negated
    to true, also where something is missing.
    """

    literal = staticmethod(F.lit)
    field = staticmethod(field)
    either = staticmethod(Column.__or__)
    both = staticmethod(Column.__and__)
    negated = staticmethod(lambda test: ~F.coalesce(test, F.lit(False)))

    @staticmethod
    def compared(op: str, a: Column, b: Column) -> Column:
        if op == "!=":
            return (a != b) | a.isNull() | b.isNull()
        return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    @staticmethod
    def computed(op: str, a: Column, b: Column) -> Column:
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.try_mod(a, b)}[op]


class Source:
    """What a filter means in a drawing script, over a row `r`; a missing value passes no comparison."""

    literal = staticmethod(repr)
    field = staticmethod(lambda name: f"r.get({name!r})")
    either = staticmethod(lambda a, b: f"({a} or {b})")
    both = staticmethod(lambda a, b: f"({a} and {b})")
    negated = staticmethod(lambda a: f"(not {a})")
    compared = staticmethod(lambda op, a, b: f"compare({op!r}, {a}, {b})")
    computed = staticmethod(lambda op, a, b: f"compute({op!r}, {a}, {b})")


def string_filter(text: str, on=Columns):
    """R7."""
    return _Parser(text, on).parse()


def fields_of(spec: Any) -> set[str]:
    """The fields that a filter reads."""
    found: set[str] = set()

    class Names(Source):
        field = staticmethod(lambda name: found.add(name) or name)

    if isinstance(spec, str):
        string_filter(spec, Names)
    elif isinstance(spec, dict) and isinstance(spec.get("field"), str):
        found.add(spec["field"])
    return found


def negates(spec: Any) -> bool:
    """Whether a filter negates anything, so that it may pass rows for which a part of it is unknown."""
    return isinstance(spec, str) and any(kind != "str" and text in ("!", "not") for kind, text in _Parser(spec, Columns).tokens)


def object_filter(spec: dict) -> Column | None:
    """All conditions of the object together; None if it has none."""
    if "field" not in spec:
        return None
    x, tests = field(spec["field"]), []
    simple = {"equal": Column.__eq__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    tests += [compare(x, F.lit(spec[key])) for key, compare in simple.items() if key in spec]
    if isinstance(spec.get("oneOf"), list):
        tests.append(x.isin(spec["oneOf"]))
    if isinstance(spec.get("range"), list) and len(spec["range"]) == 2:
        tests.append(x.between(*spec["range"]))
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def predicate(spec: Any) -> Column | None:
    """The column of a filter; None for one that the language passes over."""
    return string_filter(spec) if isinstance(spec, str) else object_filter(spec) if isinstance(spec, dict) else None
