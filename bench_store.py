"""Times encoded tables against plain Parquet at ``$BENCH_SF_DIR`` (median of five warm runs each); prints a table row per case.

The encodings are written to Parquet once, outside of what is timed; decoding reads them back.
"""

from __future__ import annotations

import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.encodings import BitPack, Decimal, Dictionary, Frame, Plain, Raw, RunEnd, Symbols, decode_table, encode_table
from tessella.plans.scan import BLOCK_TESTS, Predicate
from tessella.sources import store

CASES = {
    "raw int64": ("l_orderkey", Raw("int64")),
    "bit-packed int32": ("l_linenumber", BitPack("int32", 3)),
    "frame of reference int64": ("l_orderkey", Frame(BitPack("int64", 20, 64))),
    "dictionary utf8": ("l_returnflag", Dictionary(BitPack("int32", 2), Plain("utf8"))),
    "run-end int32": ("l_linenumber", RunEnd(Plain("int32"))),
    "decimal float64": ("l_quantity", Decimal("float64", 0)),
    "symbols utf8": ("l_returnflag", Symbols()),
}


def seconds(df: DataFrame) -> float:
    times = []
    for _ in range(6):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return statistics.median(times[1:])


def size(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    lines, root = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), tempfile.mkdtemp()
    print(f"Spark {spark.version}, local[{cpus}], {sf_dir}, {lines.count()} rows")
    for name, (column, encoding) in CASES.items():
        df, own = lines.select(column), f"{root}/{name.replace(' ', '-')}"
        df.write.parquet(f"file://{own}-plain")
        began = time.perf_counter()
        encode_table(df, {column: encoding}).write.parquet(f"file://{own}")
        took = time.perf_counter() - began
        blocks = spark.read.parquet(f"file://{own}")
        print(f"{name} | plain {seconds(spark.read.parquet(f'file://{own}-plain')):.3f} s | decoded {seconds(decode_table(blocks, {column: encoding})):.3f} s | encode {took:.2f} s | bytes {size(own) / max(size(own + '-plain'), 1):.2f} x plain")
    columns, path = ["l_orderkey", "l_linenumber", "l_quantity"], f"file://{root}/store"
    began = time.perf_counter()
    store.write_encoded(lines.select(*columns), path, rows=2048, order_by="l_orderkey")
    print(f"store write {time.perf_counter() - began:.2f} s, {size(f'{root}/store') / 1e6:.1f} MB")
    every = store.blocks_read(spark, path, []).first().blocks
    middle = lines.agg(F.percentile_approx("l_orderkey", 0.5)).first()[0]
    print(f"scan | plain {seconds(lines.select(*columns)):.3f} s | store {seconds(store.read_encoded(spark, path)):.3f} s | without hashes {seconds(store.read_encoded(spark, path, check_hashes=False)):.3f} s")
    for op in BLOCK_TESTS:
        p = Predicate("l_orderkey", op, middle)
        read = store.blocks_read(spark, path, [p]).first().blocks
        print(f"{op} {middle} | blocks read {read} of {every} | plain {seconds(lines.select(*columns).where(p.condition())):.3f} s | store {seconds(store.read_encoded(spark, path, predicate=p)):.3f} s")


if __name__ == "__main__":
    main()
