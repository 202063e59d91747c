"""The decode language: programs, capabilities, statements and expressions.

A program declares what it may read and write and how much work it may do, and has a body of statements that append
to output builders. ``SHAPES`` describes every node once; the binary and JSON forms and all walks follow from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

OUTPUT_TYPES = ("boolean", "int32", "int64", "float32", "float64", "utf8")
SCALAR_TYPES = ("bool", "int32", "int64", "float32", "float64", "uint32", "uint64", "bytes", "rowindex")
VALUE_TYPES = SCALAR_TYPES[:-1]
ARITHMETIC, EXTREMA, COMPARISONS = ("add", "sub", "mul"), ("min", "max"), ("eq", "lt", "le")
WIDTHS = {"boolean": 1, "int32": 4, "int64": 8, "float32": 4, "float64": 8}
SPARK_TYPES = {"boolean": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType()}
#: The scalar type that each output type takes.
STORED_AS = dict(zip(OUTPUT_TYPES, ("bool", "int32", "int64", "float32", "float64", "bytes"), strict=True))


@dataclass(frozen=True)
class Const:
    type: str
    value: Any  # float types hold their raw bits


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Bitcast:
    target: str
    value: Any


@dataclass(frozen=True)
class ForRange:
    index: str
    start: Any
    end: Any
    body: tuple = ()


@dataclass(frozen=True)
class CursorLoop:
    cursor: str
    limit: Any
    progress: Any
    body: tuple = ()


@dataclass(frozen=True)
class ReadInput:
    capability: str
    offset: Any
    width: Any
    bind: str


@dataclass(frozen=True)
class LetScalar:
    name: str
    expr: Any


@dataclass(frozen=True)
class AppendValue:
    builder: str
    value: Any


@dataclass(frozen=True)
class AppendNull:
    builder: str


@dataclass(frozen=True)
class FailClosed:
    code: str


@dataclass(frozen=True)
class If:
    cond: Any
    then: tuple = ()
    orelse: tuple = ()


@dataclass(frozen=True)
class InputSlice:
    id: str
    offset: int
    length: int


@dataclass(frozen=True)
class Scratch:
    id: str
    max_bytes: int


@dataclass(frozen=True)
class OutputBuilder:
    id: str
    type: str
    nullable: bool
    max_events: int


@dataclass(frozen=True)
class Budget:
    steps: int
    input_bytes: int
    scratch_bytes: int
    builder_events: int
    rows: int
    constraints: int

    @staticmethod
    def for_rows(rows: int, columns: int = 1, constraints: int = 64) -> Budget:
        """Room for a straight decode of so many rows and columns."""
        events = rows * columns
        return Budget(8 * events + 8 * columns + 64, 16 * events + 8 * columns, 0, 2 * events + columns, rows, max(constraints, 16 * columns))


@dataclass(frozen=True)
class Program:
    version: int = 1
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    capabilities: tuple = ()
    budget: Budget = field(default_factory=lambda: Budget.for_rows(0))
    body: tuple = ()

    def builders(self) -> list[OutputBuilder]:
        return [c for c in self.capabilities if isinstance(c, OutputBuilder)]

    def slices(self) -> dict[str, InputSlice]:
        return {c.id: c for c in self.capabilities if isinstance(c, InputSlice)}

    def schema(self) -> T.StructType:
        """Columns in the order of declaration, with the declared nullability."""
        return T.StructType([T.StructField(column_name(b.id), SPARK_TYPES[b.type], b.nullable) for b in self.builders()])


def column_name(builder: str) -> str:
    return builder.removeprefix("output_")


#: Kinds of nodes in the order of their binary tags, and the kind of each field: s string, b bool, 2 4 8 unsigned
#: bytes, o output type, t scalar type, v typed value, e expression, S statements.
SHAPES: dict[str, list[tuple[type, str]]] = {
    "capability": [(InputSlice, "s88"), (Scratch, "s8"), (OutputBuilder, "sob8")],
    "statement": [(ForRange, "seeS"), (CursorLoop, "seeS"), (ReadInput, "sees"), (LetScalar, "se"), (AppendValue, "se"), (AppendNull, "s"), (FailClosed, "s"), (If, "eSS")],
}
#: Binary tags of expressions, in order.
EXPRESSION_TAGS = ("const", "var", "add", "sub", "mul", "min", "max", "eq", "lt", "le", "bitcast")


def children(node: Any) -> list[Any]:
    """The direct parts of a node that are nodes."""
    out = []
    for f in fields(node):
        value = getattr(node, f.name)
        if isinstance(value, tuple):
            out.extend(value)
        elif hasattr(value, "__dataclass_fields__"):
            out.append(value)
    return out


def u64(value: int) -> Const:
    return Const("uint64", value)


def i32(value: int) -> Const:
    return Const("int32", value)


def i64(value: int) -> Const:
    return Const("int64", value)


def add(left: Any, right: Any) -> Binary:
    return Binary("add", left, right)


def mul(left: Any, right: Any) -> Binary:
    return Binary("mul", left, right)


def constant(expr: Any) -> int | None:
    """The value of a non-negative integer literal."""
    if isinstance(expr, Const) and expr.type in ("int32", "int64", "uint32", "uint64") and expr.value >= 0:
        return expr.value
    return None
