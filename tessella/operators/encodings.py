"""Column encodings: blocks of encoded rows, and their decoding as column expressions.

``encode_table`` turns rows into blocks in one narrow Arrow stage; each column of a block is a struct that its
encoding defines. ``decode_table`` is a projection: every encoding has an expression from its struct to the array of
the block's values, nested encodings compose by composition of expressions, and ``inline`` emits the rows. There is no
shuffle, and a query reads only the structs of the columns that it uses. Expressions stay in the JVM except for raw
bytes, packed bits and string symbols, which one Arrow function reads for all columns, a block at a time.

Encoders refuse values that they can't hold exactly; decoders raise on malformed blocks (``raise_error``), so a query
fails instead of returning part of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import bits, fastlanes, kernels
from tessella.plans import ir

BLOCK_ROWS = 8192
_NUMPY = {"boolean": "u1", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}


def sql_type(kind: str) -> str:
    return ir.SPARK_TYPES[kind].simpleString()


class EncodingError(ValueError):
    pass


def fail_if(bad: Column, value: Column, code: str) -> Column:
    """``value``, unless ``bad``: then the query fails with the code."""
    return F.when(bad, F.raise_error(F.lit(code))).otherwise(value)


def _valid(column: pa.Array) -> np.ndarray:
    return np.asarray(column.is_valid())


def _filled(column: pa.Array, kind: str) -> np.ndarray:
    """Values as numpy, with zeros for nulls."""
    if column.null_count:
        column = column.fill_null(False if pa.types.is_boolean(column.type) else 0)
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(_NUMPY[kind])


class Encoding:
    """kind: the output type. ``layout`` is the SQL type of the struct, ``encode`` makes it, ``decode`` reads it."""

    kind: str

    def layout(self) -> str:
        raise NotImplementedError

    def encode(self, column: pa.Array) -> dict[str, Any]:
        raise NotImplementedError

    def decode(self, block: Column, leaves: Leaves) -> Column:
        raise NotImplementedError


class Leaves:
    """Parts of blocks that Python reads. One Arrow function reads those of all columns and emits a row per block, so that a
    worker holds the values of one block, however many blocks Spark hands it in a batch."""

    def __init__(self) -> None:
        self.inputs: list[Column] = []
        self.parts: list[tuple[Callable[..., pa.Array], str, int, int]] = []

    def add(self, read: Callable[..., pa.Array], kind: str, *inputs: Column) -> Column:
        """The array that ``read`` makes of the inputs' values in a block."""
        at, name = len(self.inputs), f"v{len(self.parts)}"
        self.inputs += inputs
        self.parts.append((read, kind, at, at + len(inputs)))
        return F.col(f"`{LEAVES}`")[name]

    def values(self) -> Column:
        """All arrays, as a struct."""
        layout = "struct<" + ",".join(f"v{k}:array<{sql_type(kind)}>" for k, (_, kind, _, _) in enumerate(self.parts)) + ">"
        return leaf_values([(read, at, end) for read, _, at, end in self.parts], layout)(F.col("rows"), *self.inputs)


LEAVES = "#leaves"


def leaf_values(parts: list[tuple[Callable[..., pa.Array], int, int]], layout: str):
    """An Arrow function from (rows, inputs) of blocks to the struct of what the parts read, a block at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse(f"x {layout}")).field(0).type

    @F.arrow_udf(layout)
    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rows, *inputs in batches:
            for k in range(len(rows)):
                yield _one({f"v{j}": one(*(x[k] for x in inputs[at:end])) for j, (one, at, end) in enumerate(parts)}, target)

    return read


@dataclass(frozen=True)
class Raw(Encoding):
    """Little-endian fixed-width values; integers may be narrower than their type and are sign-extended. No nulls."""

    kind: str
    width: int = 0

    def size(self) -> int:
        return self.width or ir.WIDTHS[self.kind]

    def layout(self) -> str:
        return "struct<count:int,data:binary>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        if column.null_count:
            raise EncodingError("raw values have no nulls")
        values = _filled(column, self.kind)
        if self.kind in ("int32", "int64"):
            narrow = values.astype(f"<i{self.size()}")
            if (narrow != values).any():
                raise EncodingError(f"values do not fit in {self.size()} bytes")
            values = narrow
        return {"count": len(values), "data": values.tobytes()}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        return leaves.add(raw_values(self.kind, self.size()), self.kind, block["count"], block["data"])


def raw_values(kind: str, size: int) -> Callable[..., pa.Array]:
    """A function from (count, bytes) of a block to its values."""
    stored = f"<i{size}" if kind in ("int32", "int64") else _NUMPY[kind]

    def read(count: pa.Scalar, data: pa.Scalar) -> pa.Array:
        n, view = count.as_py(), np.frombuffer(data.as_buffer(), dtype=np.uint8)
        if len(view) < n * size:
            raise EncodingError("buffer-too-short")
        values = view[: n * size].view(stored)
        return pa.array(values != 0 if kind == "boolean" else values.astype(_NUMPY[kind], copy=False))

    return read


@dataclass(frozen=True)
class BitPack(Encoding):
    """Unsigned values of ``width`` bits in transposed blocks; nulls by a validity array; an all-null block has no words."""

    kind: str
    width: int
    t: int = 32
    offset: int = 0

    def __post_init__(self) -> None:
        if self.t not in (32, 64) or not 1 <= self.width <= self.t:
            raise EncodingError("invalid-bit-width")

    def layout(self) -> str:
        return "struct<count:int,words:array<bigint>,validity:array<boolean>>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        valid = _valid(column)
        values = _filled(column, self.kind).astype(np.int64).view(np.uint64)
        if self.width < 64 and (values >> np.uint64(self.width)).any():
            raise EncodingError(f"values do not fit in {self.width} bits")
        shifted = np.concatenate((np.zeros(self.offset, np.uint64), values))
        words = fastlanes.pack(shifted, self.width, self.t).view(np.int64) if valid.any() else np.zeros(0, np.int64)
        return {"count": len(values), "words": words, "validity": None if valid.all() else valid}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        return leaves.add(packed_values(self), self.kind, block["count"], block["words"], block["validity"])


def packed_values(e: BitPack) -> Callable[..., pa.Array]:
    """A function from (count, words, validity) of a block to its values."""
    lanes = fastlanes.BLOCK // e.t

    def read(count: pa.Scalar, packed: pa.Scalar, known: pa.Scalar) -> pa.Array:
        n = count.as_py()
        need = -(-(n + e.offset) // fastlanes.BLOCK) * e.width * lanes
        missing = None if not known.is_valid else ~np.asarray(known.values.to_numpy(zero_copy_only=False), dtype=bool)[:n]
        if not len(packed.values) and n and missing is not None:  # a block of nulls alone has no words, and none are read
            return pa.nulls(n, _ARROW[e.kind])
        if len(packed.values) < need:
            raise EncodingError("buffer-too-short")
        values = fastlanes.unpack(np.asarray(packed.values).view(np.uint64), e.width, e.t, e.offset, n)
        return pa.array((values.astype(np.uint32).view(np.int32) if e.kind == "int32" else values.view(np.int64)), _ARROW[e.kind], mask=missing)

    return read


_ARROW = {"int32": pa.int32(), "int64": pa.int64()}


def indices(count: Column) -> Column:
    """0, 1, ... count - 1, also for a count of 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class Frame(Encoding):
    """A reference plus non-negative deltas in another encoding; sums wrap in the output type; nulls are the inner ones."""

    inner: Encoding
    reference: int | None = None  # None: the least value of each block

    @property
    def kind(self) -> str:
        return self.inner.kind

    def layout(self) -> str:
        return f"struct<reference:bigint,inner:{self.inner.layout()}>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        values, valid = _filled(column, self.kind).astype(np.int64), _valid(column)
        reference = self.reference if self.reference is not None else int(values[valid].min()) if valid.any() else 0
        delta = values - np.int64(reference)
        if self.kind == "int32":
            delta = delta.astype(np.int32)
        return {"reference": reference, "inner": self.inner.encode(pa.array(delta, mask=~valid))}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        plus = (lambda d: bits.wrap32(d.cast("long") + block["reference"])) if self.kind == "int32" else (lambda d: bits.wrapping_add64(d, block["reference"]))
        return F.transform(self.inner.decode(block["inner"], leaves), plus)


@dataclass(frozen=True)
class Dictionary(Encoding):
    """Distinct values of the block, and codes in another encoding; a null code is a null, any other must be in range."""

    codes: Encoding
    values: Encoding

    @property
    def kind(self) -> str:
        return self.values.kind

    def layout(self) -> str:
        return f"struct<codes:{self.codes.layout()},values:{self.values.layout()}>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        d = column.dictionary_encode()
        codes = d.indices.cast(pa.int64() if self.codes.kind == "int64" else pa.int32())
        return {"codes": self.codes.encode(codes), "values": self.values.encode(d.dictionary)}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        values, codes = self.values.decode(block["values"], leaves), self.codes.decode(block["codes"], leaves)
        # One array holds both, so that the values are decoded once for a block and not once for a row.
        both = F.array(F.struct(values.alias("values"), codes.alias("codes")))

        def look(pair: Column) -> Column:
            n = F.size(pair["values"])
            return F.transform(pair["codes"], lambda c: F.when(c.isNotNull(), fail_if((c < 0) | (c >= n), F.get(pair["values"], c.cast("int")), "invalid-dictionary-code")))

        return F.flatten(F.transform(both, look))


@dataclass(frozen=True)
class RunEnd(Encoding):
    """Runs of equal values: where each ends, strictly rising to the count, and its value."""

    values: Encoding

    @property
    def kind(self) -> str:
        return self.values.kind

    def layout(self) -> str:
        return f"struct<count:int,ends:array<int>,values:{self.values.layout()}>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        runs = pa.compute.run_end_encode(column, run_end_type=pa.int32())
        return {"count": len(column), "ends": np.asarray(runs.run_ends), "values": self.values.encode(runs.values)}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        ends, count = block["ends"], block["count"]
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
        runs = F.arrays_zip(starts.alias("a"), ends.alias("b"), self.values.decode(block["values"], leaves).alias("v"))
        ordered = F.forall(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.coalesce(r["a"] < r["b"], F.lit(False)))
        bad = ~ordered | F.coalesce(F.get(ends, F.size(ends) - 1) != count, count != 0)
        long_enough = F.size(F.filter(runs, lambda r: r["b"].isNull())) == 0
        out = F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["b"] - r["a"])))
        empty = F.array().cast(f"array<{sql_type(self.kind)}>")
        return F.when(count == 0, empty).otherwise(fail_if(bad | ~long_enough, out, "invalid-run-end"))


@dataclass(frozen=True)
class Decimal(Encoding):
    """Floats that are integers times a power of ten, exactly: value = mantissa * 10**exponent, in that order."""

    kind: str
    exponent: int

    def __post_init__(self) -> None:
        if not -22 <= self.exponent <= 22:
            raise EncodingError("exponents beyond 22 are not exact")

    def layout(self) -> str:
        return "struct<mantissas:array<bigint>>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        valid = _valid(column)
        block = kernels.alp_encode(_filled(column, self.kind), self.exponent, None if valid.all() else valid)
        if block is None:
            raise EncodingError(f"values are not multiples of 1e{self.exponent}")
        return {"mantissas": pa.array(kernels.alp_parse(block).mantissas, mask=~valid)}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        scale = F.lit(10.0**self.exponent)
        return F.transform(block["mantissas"], lambda m: (m.cast("double") * scale).cast(sql_type(self.kind)))


@dataclass(frozen=True)
class Symbols(Encoding):
    """Strings coded by a table of up to 255 symbols per block."""

    kind: str = "utf8"

    def layout(self) -> str:
        return "struct<params:binary>"

    def encode(self, column: pa.Array) -> dict[str, Any]:
        return {"params": kernels.fsst_encode([None if x is None else x.encode() for x in column.to_pylist()])}

    def decode(self, block: Column, leaves: Leaves) -> Column:
        return leaves.add(symbol_values, self.kind, block["params"])


def symbol_values(params: pa.Scalar) -> pa.Array:
    """The strings of a parameter block."""
    return pa.array(kernels.fsst_decode(params.as_py()), pa.string())


@dataclass(frozen=True)
class Plain(Encoding):
    """Values as an array: the leaf of dictionaries and runs."""

    kind: str

    def layout(self) -> str:
        return f"array<{sql_type(self.kind)}>"

    def encode(self, column: pa.Array) -> Any:
        return column

    def decode(self, block: Column, leaves: Leaves) -> Column:
        return block


def _one(value: Any, kind: pa.DataType) -> pa.Array:
    """An array of one row, without going through Python values: fields of a dict, items of an array, or a scalar."""
    if isinstance(value, dict):
        return pa.StructArray.from_arrays([_one(value[f.name], f.type) for f in kind], fields=list(kind))
    if isinstance(value, pa.ChunkedArray):
        value = value.combine_chunks()
    if isinstance(value, np.ndarray | pa.Array):
        items = value if isinstance(value, pa.Array) else pa.array(value)
        items = items if items.type == kind.value_type else items.cast(kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items).cast(kind)
    return pa.array([value], kind)


def encode_table(df: DataFrame, encodings: dict[str, Encoding], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (block, rows, and a struct per column) of at most ``block_rows`` rows, in one narrow stage."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = list(encodings)
    schema = "part int, seq int, rows int, " + ", ".join(f"`{n}` {e.layout()}" for n, e in encodings.items())
    target = to_arrow_schema(_parse(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                piece = batch.slice(at, block_rows)
                values = [part, seq, piece.num_rows, *(encodings[n].encode(piece.column(k)) for k, n in enumerate(names))]
                seq += 1
                yield pa.RecordBatch.from_arrays([_one(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)

    return df.select(*names).mapInArrow(run, schema)


def _parse(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def decode_table(blocks: DataFrame, encodings: dict[str, Encoding], *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of blocks; ``keep`` carries block columns along."""
    leaves = Leaves()
    arrays = [F.struct(e.decode(F.col(f"`{n}`"), leaves).alias("x"))["x"].alias(n) for n, e in encodings.items()]
    read = blocks.withColumn(LEAVES, leaves.values()) if leaves.parts else blocks
    values = read.select("rows", *keep, *arrays)
    sizes = [F.coalesce(F.size(f"`{n}`"), F.lit(-1)) != F.col("rows") for n in encodings]
    checked = fail_if(reduce(lambda a, b: a | b, sizes), F.arrays_zip(*[F.col(f"`{n}`") for n in encodings]), "count-mismatch")
    out = values.select(*keep, F.inline(checked))
    return out
