"""Path filters over nested catalogue payloads, as Spark columns.

A filter such as ``$.catalogs[*].resources[*] ? (@.resourceAttributes.size >= 20)`` becomes one boolean column
of built-in higher-order functions over a VARIANT; nothing runs in Python. The language is the subset that
catalogue filters use: member steps, ``[*]``, ``? ( )``, ``exists( )``, comparisons with numbers, strings and
booleans, ``&& || !``, ``like_regex`` and ``starts with``. Comparisons are by JSON type: a value of another type
makes the comparison unknown, which neither holds nor negates.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<op>&&|\|\||==|!=|<>|<=|>=|<|>|!|\(|\)|\?|\[\*\]|\.|\$|@)|(?P<word>[A-Za-z_][\w-]*))')
_BARE_PREFIXED = re.compile(r"\.([A-Za-z_]\w*:[A-Za-z_]\w*)")


def is_number(kind: Column) -> Column:
    """Whether a type, as ``schema_of_variant`` names it, is one of numbers."""
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


class BadPath(ValueError):
    """The expression is outside the path language."""


def normalise_path(expression: str) -> str:
    """Double quotes for strings, quotes around ``prefix:name`` members."""
    return _BARE_PREFIXED.sub(r'."\1"', expression.replace("'", '"'))


def _tokens(expression: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise BadPath(f"unexpected text at {at}: {text[at:at + 12]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _at(values: Column, names: list[str]) -> Column:
    """The members that a run of names leads to, read in one step: each read copies what it returns."""
    if not names:
        return values
    path = _path(names)
    return F.filter(F.transform(values, lambda x: F.try_variant_get(x, path, "variant")), lambda x: x.isNotNull())


def _elements(values: Column, names: list[str]) -> Column:
    """The elements of the lists that a run of names leads to; what is no list stands for itself."""
    path = _path(names)
    one = lambda x: F.filter(F.array(F.try_variant_get(x, path, "variant")), lambda v: v.isNotNull())
    return F.flatten(F.transform(values, lambda x: F.coalesce(F.try_variant_get(x, path, "array<variant>"), one(x))))


def _path(names: list[str]) -> str:
    return "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in names)


def _compare(values: Column, op: str, kind: str, literal: str) -> Column:
    tests: dict[str, Callable[[Column, Column], Column]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if kind == "num":
        cast, typed, value = "double", is_number, F.lit(float(literal))
    elif kind == "str":
        cast, typed, value = "string", lambda t: t == "STRING", F.lit(literal[1:-1].replace('\\"', '"'))
    elif literal in ("true", "false"):
        cast, typed, value = "boolean", lambda t: t == "BOOLEAN", F.lit(literal == "true")
    else:
        raise BadPath(f"not a literal: {literal}")
    if op == "like":
        test = lambda a: a.rlike(literal[1:-1])
    elif op == "starts":
        test = lambda a: a.startswith(literal[1:-1])
    else:
        test = lambda a: tests[op](a, value)
    one = lambda x: F.when(typed(F.schema_of_variant(x)), test(F.try_variant_get(x, "$", cast)))
    return F.exists(values, one)


class _Reader:
    def __init__(self, expression: str):
        self.tokens, self.at = _tokens(expression), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want is not None and self.tokens[self.at][1] != want:
            raise BadPath(f"expected {want or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def path(self, context: Column, root: Column) -> Column:
        start = self.take()[1]
        if start not in ("$", "@"):
            raise BadPath(f"a path starts with $ or @, not {start!r}")
        values, names = F.array(root if start == "$" else context), []
        while (step := self.peek()) in (".", "[*]", "?"):
            self.take()
            if step == ".":
                kind, name = self.take()
                if kind not in ("word", "str"):
                    raise BadPath(f"not a member name: {name!r}")
                names.append(name[1:-1] if kind == "str" else name)
            elif step == "[*]":
                values, names = _elements(values, names), []
            else:
                self.take("(")
                values, names = F.filter(_at(values, names), self._keeper(root)), []
                self.take(")")
        return _at(values, names)

    def _keeper(self, root: Column) -> Callable[[Column], Column]:
        begin = self.at

        def keep(x: Column) -> Column:
            self.at = begin  # read anew however often the function is called
            return F.coalesce(self.either(x, root), F.lit(False))

        return keep

    def either(self, context: Column, root: Column) -> Column:
        out = self.both(context, root)
        while self.peek() == "||":
            self.take()
            out = out | self.both(context, root)
        return out

    def both(self, context: Column, root: Column) -> Column:
        out = self.test(context, root)
        while self.peek() == "&&":
            self.take()
            out = out & self.test(context, root)
        return out

    def test(self, context: Column, root: Column) -> Column:
        word = self.peek()
        if word == "!":
            self.take()
            return ~self.test(context, root)
        if word == "(":
            self.take()
            out = self.either(context, root)
            self.take(")")
            return out
        if word == "exists":
            self.take()
            self.take("(")
            out = F.size(self.path(context, root)) > 0
            self.take(")")
            return out
        values = self.path(context, root)
        op = self.take()[1]
        if op == "like_regex":
            return _compare(values, "like", *self.take())
        if op == "starts":
            self.take("with")
            return _compare(values, "starts", *self.take())
        if op not in ("==", "!=", "<>", "<", "<=", ">", ">="):
            raise BadPath(f"not a comparison: {op!r}")
        return _compare(values, op, *self.take())

    def done(self) -> None:
        if self.peek() is not None:
            raise BadPath(f"text after the end: {self.peek()!r}")


def path_values(payload: Column, expression: str) -> Column:
    """Every element that an absolute path selects, as ``array<variant>``."""
    reader = _Reader(normalise_path(expression))
    out = reader.path(payload, payload)
    reader.done()
    return out


def path_filter(payload: Column, expression: str | None) -> Column:
    """Rows that a filter keeps: a path that selects something, a condition on the whole payload, or all rows
    for a blank filter."""
    if expression is None or not expression.strip():
        return F.lit(True)
    text = normalise_path(expression.strip())
    if text.startswith("$"):
        try:
            return F.size(path_values(payload, text)) > 0
        except BadPath:
            pass  # a condition that opens with an absolute path
    reader = _Reader(text)
    out = reader.either(payload, payload)
    reader.done()
    return F.coalesce(out, F.lit(False))


def selects(expression: str | None) -> bool:
    """Whether the filter is a path (whose elements can be returned) rather than a condition."""
    try:
        path_values(F.parse_json(F.lit("{}")), expression or "")
    except BadPath:
        return False
    return True


def path_problem(expression: str | None) -> str | None:
    """Why an expression cannot be used, or None."""
    if expression is None or not expression.strip():
        return "the expression is blank"
    try:
        path_filter(F.parse_json(F.lit("{}")), expression)
    except BadPath as e:
        return str(e)
    return None
