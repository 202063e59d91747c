"""Producer and inspection tool: ``python -m tessella.cli verify|convert|gen-ir|embed|sample ...``"""

from __future__ import annotations

import argparse
import struct
import sys
from pathlib import Path

from tessella.plans import codec, ir, sidecar, verify


def sample_program() -> ir.Program:
    """Five rows of one constant per output type."""
    bits = lambda code, back, x: struct.unpack(back, struct.pack(code, x))[0]
    values = (("flag", "boolean", ir.Const("bool", True)), ("id", "int32", ir.i32(42)), ("count", "int64", ir.i64(9999)), ("ratio", "float32", ir.Const("float32", bits("<f", "<I", 3.14))), ("score", "float64", ir.Const("float64", bits("<d", "<Q", 2.718))), ("name", "utf8", ir.Const("bytes", b"hello")))
    builders = tuple(ir.OutputBuilder(f"output_{n}", kind, False, 5) for n, kind, _ in values)
    body = (ir.ForRange("i", ir.u64(0), ir.u64(5), tuple(ir.AppendValue(f"output_{n}", value) for n, _, value in values)),)
    return ir.Program(required=("l2core.copy.v0",), capabilities=builders, budget=ir.Budget.for_rows(5, 6), body=body)


def _load(path: str) -> ir.Program:
    raw = Path(path).read_bytes()
    return codec.decode(raw) if raw[:4] == codec.MAGIC else codec.from_json(raw.decode())


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *parts in (("verify", "program"), ("convert", "program", "target"), ("gen-ir", "parquet", "target"), ("embed", "data", "program"), ("sample", "target")):
        own = commands.add_parser(name)
        for part in parts:
            own.add_argument(part)
    a = parser.parse_args(arguments)
    if a.command == "verify":
        report = verify.verify(_load(a.program))
        for d in report.diagnostics:
            print(f"{d.code}\t{d.path}\t{d.message}")
        print("accepted" if report.ok else "rejected")
        return 0 if report.ok else 6
    if a.command in ("convert", "sample"):
        program = sample_program() if a.command == "sample" else _load(a.program)
        Path(a.target).write_bytes(codec.to_json(program).encode() if a.target.endswith(".json") else codec.encode(program))
    elif a.command == "gen-ir":
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        from tessella.sources.generate import generate

        made = generate(from_arrow_schema(pq.read_schema(a.parquet)), max(1, pq.read_metadata(a.parquet).num_rows))
        for column, reason in made.skipped:
            print(f"skipped {column}: {reason}", file=sys.stderr)
        if made.program is None:
            return 3
        Path(a.target).write_bytes(codec.encode(made.program))
    else:
        data, program = Path(a.data).read_bytes(), _load(a.program)
        verify.admit(program)
        bound = sidecar.bind(data, codec.encode(program), [("file", 0, len(data))])
        Path(a.data + sidecar.SUFFIX).write_bytes(sidecar.encode(bound))
    return 0


if __name__ == "__main__":
    sys.exit(main())
