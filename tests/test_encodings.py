"""Encodings, kernels, layout checks, generated programs, stored tables."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import catalog, cli
from tessella.functions import bits, fastlanes, kernels
from tessella.operators import layout_check
from tessella.operators.encodings import BitPack, Decimal, Dictionary, EncodingError, Frame, Plain, Raw, RunEnd, Symbols, decode_table, encode_table
from tessella.plans import codec, ir, scan, sidecar
from tessella.sources import datasource, parquet_facts, store
from tessella.sources.generate import generate
from tessella.streaming import read_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("t", "width"), [(32, w) for w in (1, 3, 11, 17, 31, 32)] + [(64, w) for w in (1, 33, 63, 64)])
@pytest.mark.parametrize("offset", [0, 5, 1000])
def test_bit_packing_round_trips(t, width, offset):
    values = np.random.default_rng(width).integers(0, 1 << min(width, 63), 1500, dtype=np.uint64)
    packed = fastlanes.pack(np.concatenate((np.zeros(offset, np.uint64), values)), width, t)
    assert (fastlanes.unpack(packed, width, t, offset, 1500) == values).all()


def test_places_are_a_bijection():
    for t in (32, 64):
        assert sorted(fastlanes.places(t).reshape(-1).tolist()) == list(range(1024))


@given(st.lists(st.none() | st.text(max_size=30), max_size=40))
@settings(max_examples=80, deadline=None)
def test_symbols_round_trip(values):
    assert kernels.fsst_decode(kernels.fsst_encode([None if v is None else v.encode() for v in values])) == values


def test_kernel_blocks_are_rejected():
    good = kernels.fsst_encode([b"alpha", None, b"beta"])
    for bad in (good[:-1], good + b"x", b"XXXX" + good[4:], good[:6] + b"\2" + good[7:]):
        with pytest.raises(kernels.KernelError):
            kernels.fsst_decode(bad)
    alp = kernels.alp_encode(np.array([1.25, -2.5]), -2)
    assert kernels.alp_decode(alp)[0].tolist() == [1.25, -2.5]
    for bad in (alp[:-1], alp + b"x", alp[:9] + b"\1" + alp[10:]):
        with pytest.raises(kernels.KernelError):
            kernels.alp_decode(bad)
    assert kernels.alp_encode(np.array([0.123]), -2) is None
    with pytest.raises(kernels.KernelError) as error:
        kernels.run_kernel(7, b"")
    assert error.value.code == "unknown-kernel"


@pytest.mark.parametrize("code", layout_check.CODES)
def test_one_layout_per_code(code):
    assert [c for c, _ in dict(catalog.bad_layouts())[code]] == [code]


def test_wrapping_sums_and_bytes(spark):
    top = (1 << 63) - 1
    row = spark.range(1).select(bits.wrapping_add64(F.lit(top), F.lit(1)).alias("a"), bits.wrapping_add64(F.lit(-1).cast("long"), F.lit(-5).cast("long")).alias("b"), bits.wrap32(F.lit(1 << 31)).alias("c"), bits.little_endian(F.lit((-20).to_bytes(4, "little", signed=True)), 4).alias("d"), bits.little_endian(F.lit((-3).to_bytes(8, "little", signed=True)), 8).alias("e"), bits.little_endian(F.lit(b"\xec"), 1).alias("f")).first()
    assert tuple(row) == (-top - 1, -6, -(1 << 31), -20, -3, -20)


@pytest.mark.parametrize(
    ("values", "kind", "encoding"),
    [
        ([i % 8 for i in range(200)], "int", BitPack("int32", 3)),
        ([1 << 16] * 150, "int", BitPack("int32", 17)),
        ([None] * 40, "int", BitPack("int32", 5)),
        ([None if i % 3 else i for i in range(1100)], "int", BitPack("int32", 11)),
        ([1000 + i for i in range(100)], "int", Frame(BitPack("int32", 7), 1000)),
        ([i - 500 for i in range(100)], "bigint", Frame(BitPack("int64", 7, 64), -500)),
        ([10, None, 30, 20], "int", Dictionary(BitPack("int32", 2), Plain("int32"))),
        ([1, 1, 2, 2, 2, 3], "int", RunEnd(Plain("int32"))),
        ([True, True, False], "boolean", RunEnd(Plain("boolean"))),
        (["a", None, None, "b"], "string", RunEnd(Dictionary(BitPack("int32", 2), Plain("utf8")))),
        (["", "aaaaaaaa", "abcdefgh", "escape-heavy-xyz-123-!@#", "short", None, "βγ"], "string", Symbols()),
        (["beta", "alpha", "gamma", "beta", None], "string", Dictionary(BitPack("int32", 2), Symbols())),
        ([1.25, -2.5, 0.0, 1.25, None], "float", Decimal("float32", -2)),
        ([10.125, -3.5, 0.0], "double", Raw("float64")),
    ],
)
def test_decode_of_encode_is_the_column(spark, values, kind, encoding):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)
    spec = {"i": Raw("int32"), "x": encoding}
    out = decode_table(encode_table(df, spec, 64), spec)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [tuple(r) for r in df.collect()]


def test_encoders_refuse_what_they_cannot_hold(spark):
    df = spark.createDataFrame([(9,), (None,)], "x int")
    for encoding in (BitPack("int32", 3), Raw("int32")):
        with pytest.raises(Exception, match="do not fit|no nulls"):
            encode_table(df, {"x": encoding}).collect()
    with pytest.raises(EncodingError):
        BitPack("int32", 33)


def test_malformed_blocks_fail(spark):
    cases = [
        (RunEnd(Plain("int32")), "named_struct('count', 2, 'ends', array(2, 2), 'values', array(1, 2))", "invalid-run-end"),
        (Dictionary(Plain("int32"), Plain("int32")), "named_struct('codes', array(0, 2), 'values', array(7))", "invalid-dictionary-code"),
        (BitPack("int32", 3), "named_struct('count', 2, 'words', array(1L), 'validity', cast(null as array<boolean>))", "buffer-too-short"),
    ]
    for encoding, block, code in cases:
        blocks = spark.range(1).selectExpr("2 AS rows", f"cast({block} AS {encoding.layout()}) AS x")
        with pytest.raises(Exception, match=code):
            decode_table(blocks, {"x": encoding}).collect()


def test_decoding_is_in_the_plan_and_narrow(spark):
    plan = catalog.QUERIES["enc_bitpack"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan


def test_generated_programs_report_what_they_skip(spark):
    made = generate(spark.read.parquet(f"{SF}/orders.parquet").schema)
    assert [c for c, _ in made.skipped] == ["o_orderdate"]
    assert generate(spark.createDataFrame([], "a array<int>").schema).program is None


def test_stored_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").orderBy("l_orderkey").coalesce(1)
    store.write_encoded(df, path, rows=500)
    assert store.read_encoded(spark, path).exceptAll(df).count() == 0
    for op in scan.PREDICATES:
        p = scan.Predicate("l_orderkey", op, 300)
        got = store.read_encoded(spark, path, columns=["l_quantity"], predicate=p, check_hashes=True)
        assert got.count() == df.where(p.condition()).count()
    every = store.blocks_read(spark, path, []).first()
    some = store.blocks_read(spark, path, [scan.Predicate("l_orderkey", "lt", 100)]).first()
    assert every.blocks == 12 and some.blocks == 1
    stream = read_stream(spark, path, columns=["l_orderkey"]).writeStream.format("memory").queryName("decoded").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("decoded").count() == df.count()


def test_data_source(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    store.write_encoded(df, f"file://{tmp_path}/t", rows=200)
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("tessella").load(str(tmp_path / "t"))
    assert read.exceptAll(df).count() == 0
    assert read.where("o_orderkey >= 100").count() == df.where("o_orderkey >= 100").count()
    assert spark.read.format("tessella").option("columns", "o_orderstatus").load(str(tmp_path / "t")).columns == ["o_orderstatus"]


def test_changed_blocks_fail(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(10)], "x int")
    path = f"file://{tmp_path}/t"
    store.write_encoded(df, path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("x", F.expr("cast(concat(X'09', substring(x, 2)) as binary)"))
    blocks.write.parquet(f"{path}/changed")
    (tmp_path / "t" / "blocks").rename(tmp_path / "t" / "old")
    (tmp_path / "t" / "changed").rename(tmp_path / "t" / "blocks")
    with pytest.raises(Exception, match="hash-mismatch"):
        store.read_encoded(spark, path, check_hashes=True).collect()


def test_fallback_reads_the_original(spark, tmp_path):
    df = store.read_encoded(spark, f"file://{tmp_path}/none", fallback=f"{SF}/nation.parquet", columns=["n_name"])
    assert df.count() == 25
    with pytest.raises(ValueError, match="no-sidecar-present"):
        store.read_encoded(spark, f"file://{tmp_path}/none")


def test_sorted_blocks_are_skipped(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity")
    store.write_encoded(df, path, rows=250, order_by="l_orderkey")
    blocks = lambda op, v: store.blocks_read(spark, path, [scan.Predicate("l_orderkey", op, v)]).first().blocks or 0
    every = store.blocks_read(spark, path, []).first().blocks
    assert blocks("eq", 700) <= 2 < every and blocks("eq", -1) == 0 and blocks("ne", 700) >= every - 1
    assert blocks("lt", 700) < every and blocks("gt", 700) < every
    edges = spark.read.parquet(f"{path}/blocks").orderBy("l_orderkey#min").select("l_orderkey#min", "l_orderkey#max").collect()[3]
    for op in scan.PREDICATES:
        for value in (*edges, edges[0] - 1, edges[1] + 1):
            p = scan.Predicate("l_orderkey", op, value)
            assert store.read_encoded(spark, path, predicate=p).count() == df.where(p.condition()).count()


def test_splits_read_ranges_of_rows(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.range(1000).selectExpr("id", "cast(id as string) AS name").repartition(3)
    store.write_encoded(df, path, rows=90)
    whole = [r.id for r in store.read_encoded(spark, path, columns=["id"]).collect()]
    parts = store.read_encoded(spark, path, parallel=7)
    assert parts.exceptAll(df).count() == 0 and parts.count() == 1000
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    first = [r.first_row for r in spark.read.parquet(f"{path}/parts").orderBy("first_row").collect()]
    seen = []
    for start, rows in ((0, 1), (0, 95), (95, 205), (300, 699), (999, 1)):
        got = [r.id for r in store.read_encoded(spark, path, columns=["id"], split=scan.Split(start, rows)).collect()]
        assert len(got) == rows and set(got) <= set(whole)
        seen += got
    assert first[0] == 0 and sorted(seen[1:]) == sorted(whole)
    with pytest.raises(scan.ScanError, match="invalid-split"):
        store.read_encoded(spark, path, split=scan.Split(990, 20))


def test_decisions_lead_the_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.write_encoded(spark.range(10), path)
    with pytest.raises(scan.ScanError, match="unsupported-projection"):
        store.read_encoded(spark, path, columns=["nope"])
    with pytest.raises(scan.ScanError, match="unsupported-predicate"):
        store.read_encoded(spark, path, predicate=scan.Predicate("id", "like", 3))
    assert store.read_encoded(spark, path, predicate=scan.Predicate("id", "like", 3), unsupported="scan-all").count() == 10
    with pytest.raises(scan.ScanError, match="unsafe-concurrency"):
        store.read_encoded(spark, path, parallel=0)
    _, program = store.open_program(spark, path)
    store.PLANS.disable(codec.identity(program))
    spark.range(3).write.parquet(f"file://{tmp_path}/plain")
    try:
        assert store.read_encoded(spark, path, fallback=f"file://{tmp_path}/plain").count() == 3
    finally:
        store.PLANS.disabled.clear()


def test_sidecar_beside_a_file(spark, tmp_path):
    data = tmp_path / "numbers.bin"
    data.write_bytes(struct.pack("<4i", 3, 1, 4, 1))
    body = (ir.ForRange("i", ir.u64(0), ir.u64(4), (ir.ReadInput("in", ir.mul(ir.Var("i"), ir.u64(4)), ir.u64(4), "raw"), ir.AppendValue("output_x", ir.Var("raw")))),)
    program = ir.Program(required=("l2core.copy.v0",), capabilities=(ir.InputSlice("in", 0, 16), ir.OutputBuilder("output_x", "int32", False, 4)), budget=ir.Budget.for_rows(4, 4), body=body)
    (tmp_path / "p").write_bytes(codec.encode(program))
    assert cli.main(["embed", str(data), str(tmp_path / "p")]) == 0
    assert [r.x for r in store.read_beside(spark, f"file://{data}").collect()] == [3, 1, 4, 1]
    data.write_bytes(struct.pack("<4i", 3, 1, 4, 2))
    with pytest.raises(scan.ScanError, match="hash-mismatch"):
        store.read_beside(spark, f"file://{data}", fallback=False)
    plain = spark.range(3)
    plain.coalesce(1).write.parquet(f"file://{tmp_path}/plain")
    (part,) = (tmp_path / "plain").glob("*.parquet")
    assert store.read_beside(spark, f"file://{part}").count() == 3
    odd = sidecar.bind(part.read_bytes(), codec.encode(ir.Program(required=("none.v9",), capabilities=program.capabilities, budget=program.budget, body=body)), [("file", 0, part.stat().st_size)])
    (tmp_path / "plain" / (part.name + sidecar.SUFFIX)).write_bytes(sidecar.encode(odd))
    assert store.read_beside(spark, f"file://{part}").count() == 3  # a feature that is not supported
    with pytest.raises(scan.ScanError, match="encoding-unsupported"):
        store.read_beside(spark, f"file://{part}", fallback=False)


def test_sidecars_in_footers(tmp_path):
    source, target, again = (str(tmp_path / n) for n in ("a.parquet", "b.parquet", "c.parquet"))
    pq.write_table(pa.table({"x": list(range(1000)), "y": [str(k) for k in range(1000)]}).replace_schema_metadata({"own": "kept"}), source, row_group_size=300)
    assert parquet_facts.footer_sidecar(pq.read_metadata(source)) is None
    program = codec.encode(cli.sample_program())
    bound = parquet_facts.embed_sidecar(source, target, program)
    held = parquet_facts.footer_sidecar(pq.read_metadata(target))
    assert held == bound and len(held.bindings) == 8 and pq.read_metadata(target).metadata[b"own"] == b"kept"
    assert all(c.matches for c in sidecar.check_bindings(held, open(target, "rb").read()))
    assert pq.read_table(target).equals(pq.read_table(source).replace_schema_metadata(None))
    parquet_facts.embed_sidecar(target, again, codec.encode(cli.sample_program()) )
    keys = [k for k in pq.read_metadata(again).metadata if k.startswith(b"tessella.")]
    assert len(keys) == 9  # what was there is replaced
    with pytest.raises(sidecar.SidecarError):
        parquet_facts.footer_sidecar(pa.parquet.ParquetFile(_with_pair(tmp_path, "tessella.sidecar.v1", "%%%")).metadata)


def _with_pair(folder, key, value):
    path = str(folder / "bad.parquet")
    with pq.ParquetWriter(path, pa.schema([("x", pa.int64())])) as writer:
        writer.add_key_value_metadata({key: value})
    return path


def test_large_files_are_never_left_out(spark):
    with pytest.raises(Exception, match="file-too-large"):
        parquet_facts._files(spark, f"{SF}/nation.parquet", largest=100).collect()


def test_ingress_report_tells_what_was_made(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.write_encoded(spark.createDataFrame([(1, "ab", None), (2, None, None)], "x int, s string, m map<int,int>"), path)
    rows = {r.column: r for r in store.ingress_report(spark, path).collect()}
    assert {c: r.status for c, r in rows.items()} == {"x": "encoded", "s": "encoded", "m": "skipped"}
    assert rows["x"].rows == 2 and rows["m"].bytes == 0 and "map<int,int>" in rows["m"].detail
    assert rows["x"].bytes == 2 * 4 + 2 and rows["x"].identity.startswith("blake3:") and rows["m"].identity is None


def _worker_peak_mb():
    """The most memory that any Python worker of this process has had."""
    import psutil

    peaks = [0.0]
    for p in psutil.Process().children(recursive=True):
        try:
            status = dict(line.split(":", 1) for line in open(f"/proc/{p.pid}/status"))
        except OSError:
            continue
        if "python" in p.name() and "VmHWM" in status:
            peaks.append(int(status["VmHWM"].split()[0]) / 1024)
    return max(peaks)


def test_a_worker_decodes_a_block_at_a_time(spark):
    """100 blocks of 512 Ki rows are one Arrow batch of 13 MB and 210 MB of values."""
    n = 1 << 19
    blocks = spark.range(100, numPartitions=1).selectExpr(f"{n} AS rows", f"named_struct('count', {n}, 'words', array_repeat(0L, {n // 32}), 'validity', cast(null as array<boolean>)) AS x")
    before = _worker_peak_mb()
    rows = decode_table(blocks, {"x": BitPack("int32", 1)}).agg(F.count(F.lit(1)), F.sum("x")).first()
    assert tuple(rows) == (100 * n, 0)
    assert _worker_peak_mb() < max(before, 250)
    plan = catalog.QUERIES["enc_dict_nullable"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_bounds_of_blocks_are_taken_as_they_are_packed(spark):
    """Blocks don't go to Python a second time, in batches as large as Spark makes them."""
    df = spark.createDataFrame([(None if i % 3 == 0 or i >= 90 else i - 40, -i, float(i)) for i in range(99)], "a int, b bigint, c double").coalesce(1)
    blocks = store.described(df, generate(df.schema, 10, required=("b",)).program, 10)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = [tuple(r) for r in blocks.orderBy("seq").select("a#min", "a#max", "b#min", "b#max").collect()]
    kept = [[i - 40 for i in range(at, min(at + 10, 90)) if i % 3] for at in range(0, 99, 10)]
    assert got == [(min(x, default=None), max(x, default=None), -min(at + 9, 98), -at) for x, at in zip(kept, range(0, 99, 10), strict=True)]
    assert "c#min" not in blocks.columns
