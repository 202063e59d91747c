"""Facts of Parquet files from their footers, hashes of their column chunks, and sidecars in footers.

Footers are read by Spark tasks through Spark's own readers of bytes, so any store that Spark reads will do; a row of
the result is a row group or a column chunk, and nothing but paths is on the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.blake3 import content_hash
from tessella.plans import sidecar

FACTS = "path string, row_group int, column string, physical string, encodings array<string>, compression string, rows bigint, offset bigint, length bigint"
#: Spark hands out the bytes of a file as one value up to this size.
LARGEST_FILE = (1 << 31) - 1


def _files(spark: SparkSession, path: str, largest: int = LARGEST_FILE) -> DataFrame:
    """Paths and contents. A larger file fails the query: none is left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    too_large = F.raise_error(F.concat(F.lit("file-too-large: "), F.col("path"), F.lit(" has "), F.col("length").cast("string"), F.lit(f" bytes of {largest}")))
    return found.select("path", F.when(F.col("length") <= largest, F.col("content")).otherwise(too_large).alias("content"))


def _chunks(raw: bytes) -> Iterator[tuple[int, pq.ColumnChunkMetaData, int, int, int]]:
    return _chunks_of(pq.ParquetFile(pa.BufferReader(raw)).metadata)


def _chunks_of(meta: pq.FileMetaData) -> Iterator[tuple[int, pq.ColumnChunkMetaData, int, int, int]]:
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            start = chunk.dictionary_page_offset or chunk.data_page_offset
            yield g, chunk, group.num_rows, start, chunk.total_compressed_size


def source_facts(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk: layout, splits (row groups) and where its bytes are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"path": name, "row_group": g, "column": c.path_in_schema, "physical": c.physical_type, "encodings": sorted(c.encodings), "compression": c.compression, "rows": n, "offset": at, "length": size} for g, c, n, at, size in _chunks(raw)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("physical", pa.string()), ("encodings", pa.list_(pa.string())), ("compression", pa.string()), ("rows", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

    return _files(spark, path).select("path", "content").mapInArrow(run, FACTS)


def chunk_bindings(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """A binding per column chunk: granule, range, content hash, program identity. Hashes are of the chunk's own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"path": name, "granule": f"{g}/{c.path_in_schema}", "offset": at, "length": size, "content_hash": content_hash(raw[at : at + size]), "identity": identity} for g, c, _, at, size in _chunks(raw)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("granule", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content_hash", pa.string()), ("identity", pa.string())]))

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, granule string, offset bigint, length bigint, content_hash string, identity string")


def check_bindings(spark: SparkSession, path: str, bindings: DataFrame) -> DataFrame:
    """Bindings with ``matches``: whether the bytes are there and unchanged."""
    found = chunk_bindings(spark, path, "").select("path", "granule", "offset", "length", "content_hash")
    keys = ["path", "granule", "offset", "length"]
    return bindings.join(found.withColumnRenamed("content_hash", "found"), keys, "left").selectExpr(*keys, "content_hash", "identity", "coalesce(content_hash = found, false) as matches")


# Sidecars in footers

SIDECAR_KEY, HASH_KEY = "tessella.sidecar.v1", "tessella.hash."


def footer_sidecar(metadata: pq.FileMetaData) -> sidecar.Sidecar | None:
    """The sidecar among the key-value pairs of a footer, if there is one."""
    found = (metadata.metadata or {}).get(SIDECAR_KEY.encode())
    if found is None:
        return None
    try:
        return sidecar.decode(base64.b64decode(found, validate=True))
    except ValueError as error:
        raise sidecar.SidecarError(f"footer: {error}") from error


def embed_sidecar(source: str, target: str, program: bytes) -> sidecar.Sidecar:
    """A copy of a local Parquet file whose footer binds a program to every column chunk, in place of any sidecar before.

    The copy is written row group by row group. Its chunks have their final bytes before the footer is written, so they
    are hashed in a first copy and bound in the second.
    """

    def copy(pairs: dict[str, str]) -> pq.FileMetaData:
        with pq.ParquetFile(source) as held, pq.ParquetWriter(target, held.schema_arrow.remove_metadata(), compression="snappy") as writer:
            for g in range(held.num_row_groups):
                writer.write_table(held.read_row_group(g).replace_schema_metadata(None), row_group_size=max(1, held.metadata.row_group(g).num_rows))
            writer.add_key_value_metadata({**_other_pairs(held.metadata), **pairs})
        return pq.read_metadata(target)

    copy({})
    with open(target, "rb") as f:
        ranges = []
        for g, chunk, _, at, size in _chunks_of(pq.read_metadata(target)):
            f.seek(at)
            ranges.append(sidecar.Binding(f"{g}/{chunk.path_in_schema}", at, size, content_hash(f.read(size)), content_hash(program)))
    bound = sidecar.Sidecar(program, tuple(ranges))
    copy({SIDECAR_KEY: base64.b64encode(sidecar.encode(bound)).decode(), **{HASH_KEY + b.granule: b.content_hash for b in ranges}})
    return bound


def _other_pairs(metadata: pq.FileMetaData) -> dict[str, str]:
    known = (SIDECAR_KEY, HASH_KEY, "ARROW:schema")
    return {k.decode(): v.decode() for k, v in (metadata.metadata or {}).items() if not k.decode().startswith(known)}
