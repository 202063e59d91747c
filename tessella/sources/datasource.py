"""``spark.read.format("tessella")``: encoded tables through Spark's Python data source interface.

For folders that Python can open on every machine. A partition is a file of blocks; filters on integer columns skip
blocks by their least and greatest values; the option ``columns``
prunes the program, as data sources in Python get no projection. ``store.read_encoded`` has the same rows from any store.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from tessella.plans import codec, compile, ir, verify

_FILTERS = {ds.EqualTo: lambda lo, hi, v: lo <= v <= hi, ds.GreaterThan: lambda lo, hi, v: hi > v, ds.GreaterThanOrEqual: lambda lo, hi, v: hi >= v, ds.LessThan: lambda lo, hi, v: lo < v, ds.LessThanOrEqual: lambda lo, hi, v: lo <= v}


@dataclass
class BlockFile(ds.InputPartition):
    path: str


class EncodedSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella"

    def _program(self) -> ir.Program:
        root = self.options["path"].removeprefix("file://")
        (part,) = glob.glob(f"{root}/program/part-*")
        with open(part) as f:
            program = codec.decode(bytes.fromhex(json.loads(f.read())["program"]))
        if columns := self.options.get("columns"):
            program = compile.prune(program, columns.split(","))
        verify.admit(program)
        return program

    def schema(self) -> StructType:
        return self._program().schema()

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return EncodedReader(self.options["path"].removeprefix("file://"), self._program())


class EncodedReader(ds.DataSourceReader):
    def __init__(self, root: str, program: ir.Program):
        self.root, self.program, self.tests = root, program, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        integers = {ir.column_name(b.id) for b in self.program.builders() if b.type in ("int32", "int64")}
        for f in filters:
            if type(f) in _FILTERS and len(f.attribute) == 1 and f.attribute[0] in integers:
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f  # blocks are skipped, rows are still to be filtered

    def partitions(self) -> list[BlockFile]:
        return [BlockFile(p) for p in sorted(glob.glob(f"{self.root}/blocks/*.parquet"))]

    def read(self, partition: BlockFile) -> Iterator[pa.RecordBatch]:
        slices = list(self.program.slices())
        bounds = [f"{c}#{m}" for c, _, _ in self.tests for m in ("min", "max")]
        file = pq.ParquetFile(partition.path)
        for batch in file.iter_batches(batch_size=1, columns=[*dict.fromkeys(["rows", *slices, *bounds])]):
            row = {n: batch.column(k)[0] for k, n in enumerate(batch.schema.names)}
            known = [(row[f"{c}#min"].as_py(), row[f"{c}#max"].as_py(), kind, value) for c, kind, value in self.tests]
            if all(lo is not None and _FILTERS[kind](lo, hi, value) for lo, hi, kind, value in known):
                inputs = {s: np.frombuffer(row[s].as_buffer(), dtype=np.uint8) for s in slices}
                yield compile.run_block(self.program, inputs, row["rows"].as_py())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters is refused without it
    spark.dataSource.register(EncodedSource)
