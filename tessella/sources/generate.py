"""From a schema to a program and packed blocks: tier 1 fixed width, tier 2 with nulls, tier 3 text, tier 4 text that is
stored with a dictionary (read as plain values before packing).

Blocks are column-major and little-endian. A column has one input slice for each of its parts: ``x`` values or text
bytes, ``x#valid`` one byte a row (1 is valid), ``x#ends`` rows + 1 offsets of text. Nullable text is an extension: it
has all three. Columns of other types are reported, never dropped in silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.plans import ir

FEATURE = "l2core.copy.v0"
BLOCK_ROWS = 16384
MAX_TEXT = 1 << 31
_KINDS = {T.BooleanType(): "boolean", T.IntegerType(): "int32", T.LongType(): "int64", T.FloatType(): "float32", T.DoubleType(): "float64", T.StringType(): "utf8"}
_NUMPY = {"boolean": "u1", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}


@dataclass
class Generated:
    program: ir.Program | None
    columns: list[str]
    skipped: list[tuple[str, str]] = field(default_factory=list)  # column, reason


def generate(schema: T.StructType, rows: int = BLOCK_ROWS, *, required: tuple[str, ...] = ()) -> Generated:
    """A program that decodes blocks of up to ``rows`` rows. ``required`` columns are declared without nulls."""
    capabilities, body, columns, skipped = [], [], [], []
    row, outputs = ir.Var("row"), []
    for f in schema.fields:
        kind = _KINDS.get(f.dataType)
        if kind is None:
            skipped.append((f.name, f"type {f.dataType.simpleString()} is not in the language"))
            continue
        nullable = f.nullable and f.name not in required
        builder = ir.OutputBuilder(f"output_{f.name}", kind, nullable, max(rows, 2))
        read: list = []
        if kind == "utf8":
            capabilities += [ir.InputSlice(f"{f.name}#ends", 0, 4 * (rows + 1)), ir.InputSlice(f.name, 0, MAX_TEXT)]
            read += [
                ir.ReadInput(f"{f.name}#ends", ir.mul(row, ir.u64(4)), ir.u64(4), "from"),
                ir.ReadInput(f"{f.name}#ends", ir.add(ir.mul(row, ir.u64(4)), ir.u64(4)), ir.u64(4), "to"),
                ir.ReadInput(f.name, ir.Var("from"), ir.Binary("sub", ir.Var("to"), ir.Var("from")), "raw"),
            ]
            value = ir.Var("raw")
        else:
            width = ir.WIDTHS[kind]
            capabilities.append(ir.InputSlice(f.name, 0, width * rows))
            read.append(ir.ReadInput(f.name, ir.mul(row, ir.u64(width)), ir.u64(width), "raw"))
            value = ir.Var("raw") if kind in ("int32", "int64") else ir.Bitcast(ir.STORED_AS[kind], ir.Var("raw"))
        read.append(ir.AppendValue(builder.id, value))
        if nullable:
            capabilities.append(ir.InputSlice(f"{f.name}#valid", 0, rows))
            flag = ir.ReadInput(f"{f.name}#valid", row, ir.u64(1), "valid")
            read = [flag, ir.If(ir.Bitcast("bool", ir.Var("valid")), tuple(read), (ir.AppendNull(builder.id),))]
        body.append(ir.ForRange("row", ir.u64(0), ir.u64(rows), tuple(read)))
        outputs.append(builder)
        columns.append(f.name)
    if not outputs:
        return Generated(None, [], skipped)
    budget = ir.Budget.for_rows(rows, len(outputs))
    text = sum(c.length for c in capabilities if c.length == MAX_TEXT)
    budget = ir.Budget(budget.steps, budget.input_bytes + text + 16 * rows * len(outputs), 0, budget.builder_events, rows, budget.constraints)
    return Generated(ir.Program(required=(FEATURE,), capabilities=(*capabilities, *outputs), budget=budget, body=tuple(body)), columns, skipped)


def pack_column(name: str, kind: str, nullable: bool, column: pa.Array) -> dict[str, bytes]:
    """The slices of one column of a block; null rows hold zeros."""
    out = {}
    if nullable:
        out[f"{name}#valid"] = np.asarray(column.is_valid()).astype("u1").tobytes()
    elif column.null_count:
        raise ValueError(f"column {name!r} is declared without nulls and has {column.null_count}")
    if kind == "utf8":
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.string())
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, dtype="<i4")[column.offset : column.offset + len(column) + 1]
        out[f"{name}#ends"] = (ends - ends[0]).astype("<i4").tobytes()
        out[name] = data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""
    else:
        filled = column.fill_null(False if kind == "boolean" else 0) if column.null_count else column
        out[name] = np.asarray(filled.to_numpy(zero_copy_only=False)).astype(_NUMPY[kind]).tobytes()
    return out


def pack_table(df: DataFrame, program: ir.Program, rows: int = BLOCK_ROWS, *, bounds: tuple[str, ...] = ()) -> DataFrame:
    """Blocks (part, seq, the part's rows before, rows, and the program's slices) of a table, in one narrow Arrow stage, with
    ``x#min`` and ``x#max`` of the integer columns in ``bounds``."""
    slices = list(program.slices())
    outputs = [(ir.column_name(b.id), b.type, b.nullable) for b in program.builders()]
    places = [[n for n, _, _ in outputs].index(c) for c in bounds]
    ends = [f"{c}#{m}" for c in bounds for m in ("min", "max")]
    target = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_row", pa.int64()), ("rows", pa.int32()), *((s, pa.binary()) for s in slices), *((e, pa.int64()) for e in ends)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                packed = {k: v for j, o in enumerate(outputs) for k, v in pack_column(*o, piece.column(j)).items()}
                found = [x for j in places for x in pa.compute.min_max(piece.column(j)).as_py().values()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([done], pa.int64()), pa.array([piece.num_rows], pa.int32()), *(pa.array([packed[s]], pa.binary()) for s in slices), *(pa.array([x], pa.int64()) for x in found)], schema=target)
                seq, done = seq + 1, done + piece.num_rows

    fields = ", ".join([*(f"`{s}` binary" for s in slices), *(f"`{e}` bigint" for e in ends)])
    return df.select(*[f"`{n}`" for n, _, _ in outputs]).mapInArrow(run, f"part int, seq int, part_row bigint, rows int, {fields}")
