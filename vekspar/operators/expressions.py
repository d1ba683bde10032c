"""Arithmetic of column expressions, for adding and altering numeric columns.

Numbers, columns, + - * /, parentheses and signs. Null in, null out. Integers divide with
truncation; a zero divisor and results that are not finite are errors. The result is truncated
and wrapped into an integer target, as two's complement.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError
from ..schema import CollectionSchema, DataType, spark_type

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|`(?P<quoted>[^`]+)`|(?P<op>[-+*/()]))")
_BITS = {DataType.INT32: (32, True), DataType.UINT32: (32, False), DataType.INT64: (64, True), DataType.UINT64: (64, False)}
NUMERIC = (DataType.INT32, DataType.INT64, DataType.UINT32, DataType.UINT64, DataType.FLOAT, DataType.DOUBLE)


def wrap(value: Column, kind: DataType) -> Column:
    """A number as kind: floats keep their size, integers wrap modulo 2^bits."""
    if kind not in _BITS:
        return value.cast(spark_type(kind))
    bits, signed = _BITS[kind]
    span = F.lit(Decimal(1 << bits)).cast("decimal(38,0)")
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("decimal(38,0)")
    low = F.pmod(whole, span)
    if signed:
        low = F.when(low >= F.lit(Decimal(1 << (bits - 1))).cast("decimal(38,0)"), low - span).otherwise(low)
    return low.cast(spark_type(kind))


class _Parser:
    """Each result is a column and whether it is an integer (a decimal(38,0))."""

    def __init__(self, text: str, schema: CollectionSchema) -> None:
        self.text, self.schema, self.at, self.depth = text, schema, 0, 0

    def peek(self) -> str:
        m = _TOKEN.match(self.text, self.at)
        return m["op"] or "" if m else ""

    def take(self) -> re.Match:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise ParseError("expected a number, a column or '('", self.text, self.at, "column expression")
        self.at = m.end()
        return m

    def whole(self) -> tuple[Column, bool]:
        found = self.sum()
        if self.text[self.at :].strip():
            raise ParseError("expected the end", self.text, self.at, "column expression")
        return found

    def sum(self) -> tuple[Column, bool]:
        left = self.product()
        while self.peek() in ("+", "-"):
            left = self.apply(self.take()["op"], left, self.product())
        return left

    def product(self) -> tuple[Column, bool]:
        left = self.factor()
        while self.peek() in ("*", "/"):
            left = self.apply(self.take()["op"], left, self.factor())
        return left

    def factor(self) -> tuple[Column, bool]:
        self.depth += 1
        if self.depth > 256:
            raise ParseError("nested too deeply", self.text, self.at, "column expression")
        m = self.take()
        if m["op"] == "(":
            found = self.sum()
            if self.peek() != ")":
                raise ParseError("expected ')'", self.text, self.at, "column expression")
            self.take()
        elif m["op"] in ("+", "-"):
            value, whole = self.factor()
            found = (-value if m["op"] == "-" else value), whole
        elif m["number"]:
            whole = m["number"].isdigit()
            found = (F.lit(Decimal(m["number"])).cast("decimal(38,0)") if whole else F.lit(float(m["number"]))), whole
        elif m["name"] or m["quoted"]:
            f = self.schema.field(m["name"] or m["quoted"])
            if f.data_type not in NUMERIC:
                raise ParseError(f"{f.name} is not numeric", self.text, m.start(), "column expression")
            whole = f.data_type in _BITS
            found = F.col(f"`{f.name}`").cast("decimal(38,0)" if whole else "double"), whole
        else:
            raise ParseError("expected a value", self.text, m.start(), "column expression")
        self.depth -= 1
        return found

    def apply(self, op: str, a: tuple[Column, bool], b: tuple[Column, bool]) -> tuple[Column, bool]:
        whole = a[1] and b[1]
        x, y = (a[0], b[0]) if whole else (a[0].cast("double"), b[0].cast("double"))
        if op == "/":
            y = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("decimal(38,0)" if whole else "double")).otherwise(y)
            if whole:
                return F.call_function("div", x, y).cast("decimal(38,0)"), True
            return x / y, False
        found = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
        return (found.cast("decimal(38,0)") if whole else found), whole


def compile_expression(text: str, schema: CollectionSchema, kind: DataType) -> Column:
    value, whole = _Parser(text, schema).whole()
    if not whole:
        value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("the result is not finite")).cast("double")).otherwise(value)
    return wrap(value, kind)
