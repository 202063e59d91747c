"""Registered queries over the engine's own operators, and their oracle SQL.

Queries of encodings and scans really encode and decode; their oracles state the source values.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import layout_check
from tessella.operators.encodings import BitPack, Decimal, Dictionary, Encoding, Frame, Plain, Raw, RunEnd, Symbols, decode_table, encode_table
from tessella.plans import codec, compile, container, interp, ir, scan, sidecar, verify
from tessella.sources import datasource, parquet_facts, store
from tessella.sources.generate import generate, pack_table
from tessella.storage import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return take


# Encodings: encode and decode in one plan


def _round_trip(name: str, source: str, columns: dict[str, tuple[str, Encoding]], sql_columns: str | None = None) -> None:
    """A query that encodes and decodes expressions of a table: name -> (SQL that both engines read, encoding)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, (e, _) in columns.items()])
        encodings = {c: e for c, (_, e) in columns.items()}
        return decode_table(encode_table(df, encodings), encodings)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(f'{e} AS {c}' for c, (e, _) in columns.items())} FROM {source}"


_NULLED = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_linenumber END"
_STATUS = BitPack("int32", 2)
for _name, _source, _columns in (
    ("enc_raw_i64", "lineitem", {"l_orderkey": ("l_orderkey", Raw("int64")), "l_partkey": ("l_partkey", Raw("int64"))}),
    ("enc_raw_f64", "lineitem", {"l_quantity": ("l_quantity", Raw("float64")), "l_extendedprice": ("l_extendedprice", Raw("float64"))}),
    ("enc_raw_f32", "lineitem", {"quantity": ("CAST(l_quantity AS FLOAT)", Raw("float32"))}),
    ("enc_raw_bool", "lineitem", {"l_orderkey": ("l_orderkey", Raw("int64")), "even": ("l_orderkey % 2 = 0", Raw("boolean"))}),
    ("enc_raw_narrow_i32", "lineitem", {"l_orderkey": ("l_orderkey", Raw("int64", 4)), "l_linenumber": ("l_linenumber", Raw("int32", 1))}),
    ("enc_bitpack", "lineitem", {"l_orderkey": ("l_orderkey", BitPack("int64", 33, 64)), "l_linenumber": ("l_linenumber", BitPack("int32", 3))}),
    ("enc_bitpack_offset", "part", {"p_partkey": ("p_partkey", BitPack("int64", 40, 64, 1000)), "p_size": ("p_size", BitPack("int32", 11, 32, 5))}),
    ("enc_bitpack_nullable", "lineitem", {"l_orderkey": ("l_orderkey", Raw("int64")), "n": (_NULLED, BitPack("int32", 3))}),
    ("enc_bitpack_all_null", "supplier", {"s_suppkey": ("s_suppkey", Raw("int64")), "n": ("CAST(NULL AS INTEGER)", BitPack("int32", 5))}),
    ("enc_for", "orders", {"o_orderkey": ("o_orderkey", Frame(BitPack("int64", 40, 64)))}),
    ("enc_for_negative", "customer", {"c_custkey": ("c_custkey", Frame(BitPack("int64", 40, 64), -500)), "cents": ("CAST(round(c_acctbal * 100) AS BIGINT)", Frame(BitPack("int64", 40, 64)))}),
    ("enc_for_over_raw", "part", {"p_size": ("p_size", Frame(Raw("int32", 2), 1000)), "p_partkey": ("p_partkey", Frame(Raw("int64", 8), -(1 << 62)))}),
    ("enc_dict_str", "lineitem", {"l_orderkey": ("l_orderkey", Raw("int64")), "l_returnflag": ("l_returnflag", Dictionary(_STATUS, Plain("utf8")))}),
    ("enc_dict_int", "nation", {"n_nationkey": ("n_nationkey", Raw("int32")), "n_regionkey": ("n_regionkey", Dictionary(Raw("int32", 1), Plain("int32")))}),
    ("enc_dict_nullable", "lineitem", {"l_orderkey": ("l_orderkey", Raw("int64")), "n": (_NULLED, Dictionary(BitPack("int32", 3), Plain("int32")))}),
    ("enc_runend", "orders", {"o_orderkey": ("o_orderkey", Raw("int64")), "o_orderstatus": ("o_orderstatus", RunEnd(Plain("utf8")))}),
    ("enc_runend_over_dict", "orders", {"o_orderkey": ("o_orderkey", Raw("int64")), "o_orderstatus": ("o_orderstatus", RunEnd(Dictionary(_STATUS, Plain("utf8"))))}),
    ("enc_alp_f64", "lineitem", {"l_discount": ("l_discount", Decimal("float64", -2)), "l_tax": ("l_tax", Decimal("float64", -2)), "l_quantity": ("l_quantity", Decimal("float64", 0))}),
    ("enc_alp_f32", "lineitem", {"quantity": ("CAST(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS FLOAT)", Decimal("float32", 0))}),
    ("enc_fsst", "part", {"p_partkey": ("p_partkey", Raw("int64")), "p_name": ("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END", Symbols())}),
    ("enc_dict_over_fsst", "customer", {"c_custkey": ("c_custkey", Raw("int64")), "c_mktsegment": ("c_mktsegment", Dictionary(BitPack("int32", 4), Symbols()))}),
):
    _round_trip(_name, _source, _columns)


# Generated programs


def _generated(df: DataFrame, rows: int = 4096, required: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    program = generate(df.schema, rows, required=required).program
    return compile.decode_blocks(pack_table(df, program, rows), program, columns=columns)


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_tax AS FLOAT) AS tax, l_linenumber > 3 AS late FROM lineitem")
def gen_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "CAST(l_tax AS FLOAT) AS tax", "l_linenumber > 3 AS late")
    return _generated(df, required=tuple(df.columns))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders")
def gen_tier2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS custkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price"))


@query("SELECT doc_id, text, lang FROM documents")
def gen_tier3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return _generated(df, required=tuple(df.columns))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def gen_tier4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name"))


@query("SELECT * FROM (VALUES ('l_shipdate', 'type timestamp_ntz is not in the language')) AS t(column_name, reason)")
def gen_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(generate(table(spark, sf_dir, "lineitem").schema).skipped, "column_name string, reason string")


# Statements and expressions of the language


def _program(builders: dict[str, tuple[str, bool]], body: tuple, rows: int = 64, slices: tuple = ()) -> ir.Program:
    outputs = tuple(ir.OutputBuilder(f"output_{n}", kind, null, rows) for n, (kind, null) in builders.items())
    return ir.Program(capabilities=(*slices, *outputs), budget=ir.Budget.for_rows(max(rows, 8), max(1, len(outputs)) + 2), body=body)


def _loop(rows: int, *body) -> tuple:
    return (ir.ForRange("i", ir.u64(0), ir.u64(rows), body),)


_I = ir.Bitcast("int64", ir.Var("i"))
_DATA = b"".join(struct.pack("<i", 7 * k - 20) for k in range(12))


@query("SELECT CAST(i AS BIGINT) AS x FROM range(3, 20) t(i)")
def ir_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile.to_dataframe(spark, _program({"x": ("int64", False)}, (ir.ForRange("i", ir.u64(3), ir.u64(20), (ir.AppendValue("output_x", _I),)),)))


@query("SELECT CAST(i AS BIGINT) AS x FROM range(0, 50, 3) t(i)")
def ir_cursor_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    loop = ir.CursorLoop("i", ir.u64(50), ir.add(ir.Var("i"), ir.u64(3)), (ir.AppendValue("output_x", _I),))
    return compile.to_dataframe(spark, _program({"x": ("int64", False)}, (loop,)))


@query("SELECT CAST(7 * i - 20 AS INTEGER) AS x FROM range(12) t(i)")
def ir_read_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _loop(12, ir.ReadInput("in", ir.mul(ir.Var("i"), ir.u64(4)), ir.u64(4), "raw"), ir.AppendValue("output_x", ir.Var("raw")))
    return compile.to_dataframe(spark, _program({"x": ("int32", False)}, body, slices=(ir.InputSlice("in", 0, 48),)), {"in": _DATA})


@query("SELECT CAST(i * 3 + 4 AS BIGINT) AS x, CAST(least(i, 5) AS BIGINT) AS lo, CAST(greatest(i, 5) AS BIGINT) AS hi, i < 4 AS lt, i <= 4 AS le, i = 4 AS eq FROM range(10) t(i)")
def ir_let_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, five, four = ir.Var("n"), ir.i64(5), ir.i64(4)
    values = {"x": ir.add(ir.mul(n, ir.i64(3)), four), "lo": ir.Binary("min", n, five), "hi": ir.Binary("max", n, five), **{op: ir.Binary(op, n, four) for op in ir.COMPARISONS}}
    body = _loop(10, ir.LetScalar("n", _I), *(ir.AppendValue(f"output_{k}", v) for k, v in values.items()))
    return compile.to_dataframe(spark, _program({k: ("boolean" if k in ir.COMPARISONS else "int64", False) for k in values}, body))


@query("SELECT TRUE AS flag, 42 AS id, CAST(9999 AS BIGINT) AS count, CAST(3.14 AS FLOAT) AS ratio, CAST(2.718 AS DOUBLE) AS score, 'hello' AS name FROM range(5)")
def ir_append_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.cli import sample_program

    return compile.to_dataframe(spark, sample_program())


@query("SELECT CAST(NULL AS INTEGER) AS x FROM range(6)")
def ir_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile.to_dataframe(spark, _program({"x": ("int32", True)}, _loop(6, ir.AppendNull("output_x"))))


@query("SELECT CASE WHEN i % 2 = 0 THEN CAST(7 * i - 20 AS INTEGER) END AS x FROM range(12) t(i)")
def ir_if_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ir.ReadInput("valid", ir.Var("i"), ir.u64(1), "v")
    read = ir.ReadInput("in", ir.mul(ir.Var("i"), ir.u64(4)), ir.u64(4), "raw")
    body = _loop(12, flags, ir.If(ir.Bitcast("bool", ir.Var("v")), (read, ir.AppendValue("output_x", ir.Var("raw"))), (ir.AppendNull("output_x"),)))
    slices = (ir.InputSlice("in", 0, 48), ir.InputSlice("valid", 0, 12))
    return compile.to_dataframe(spark, _program({"x": ("int32", True)}, body, slices=slices), {"in": _DATA, "valid": bytes((1, 0) * 6)})


@query("SELECT CAST(i AS BIGINT) AS x FROM range(4) t(i), range(3) u(j)")
def ir_nested_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = ir.ForRange("j", ir.u64(0), ir.u64(3), (ir.AppendValue("output_x", _I),))
    return compile.to_dataframe(spark, _program({"x": ("int64", False)}, _loop(4, inner)))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(42) AS BIGINT) AS total, 42 AS least FROM range(10)")
def host_global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compile.to_dataframe(spark, _program({"x": ("int32", False)}, _loop(10, ir.AppendValue("output_x", ir.i32(42)))))
    return rows.agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"))


# Verification


def bad_programs() -> dict[str, ir.Program]:
    """A program for each diagnostic code that has it and no other."""
    x, one = {"x": ("int32", False)}, ir.AppendValue("output_x", ir.i32(1))
    tight = ir.Budget(100, 100, 0, 100, 8, 1)
    adds = _program(x, tuple(ir.LetScalar(f"a{k}", ir.add(ir.i32(1), ir.i32(k))) for k in range(3)))
    return {
        "missing-input-capability": _program(x, (ir.ReadInput("none", ir.u64(0), ir.u64(4), "r"),)),
        "missing-output-builder": _program(x, (ir.AppendValue("output_y", ir.i32(1)),)),
        "unknown-variable": _program(x, (ir.LetScalar("a", ir.Var("b")),)),
        "output-type-mismatch": _program(x, (ir.AppendValue("output_x", ir.i64(1)),)),
        "output-nullability-mismatch": _program(x, (ir.AppendNull("output_x"),)),
        "invalid-loop-bounds": _program(x, (ir.ForRange("i", ir.u64(5), ir.u64(2), (one,)),)),
        "non-monotone-cursor-loop": _program(x, (ir.CursorLoop("c", ir.u64(5), ir.Var("c"), (one,)),)),
        "resource-budget-exceeded": _program(x, (ir.ForRange("i", ir.u64(0), ir.u64(1000), (one,)),)),
        "constraint-budget-exceeded": ir.Program(capabilities=adds.capabilities, budget=tight, body=adds.body),
        "explicit-fail-closed": _program(x, (ir.FailClosed("stop"),)),
    }


@query("""SELECT code AS expected, code AS found FROM (VALUES ('missing-input-capability'), ('missing-output-builder'), ('unknown-variable'), ('output-type-mismatch'), ('output-nullability-mismatch'),
    ('invalid-loop-bounds'), ('non-monotone-cursor-loop'), ('resource-budget-exceeded'), ('constraint-budget-exceeded'), ('explicit-fail-closed')) AS t(code)""")
def verify_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, ",".join(verify.verify_bytes(codec.encode(p)).codes())) for name, p in bad_programs().items()]
    return spark.createDataFrame(rows, "expected string, found string")


def bad_layouts() -> list[tuple[str, list[tuple[str, str]]]]:
    """Each layout code with what the check says of a layout that has it."""
    raw = {"kind": "raw", "size": 4, "count": 2, "data": struct.pack("<ii", 0, 1)}
    runs = {"kind": "run-end", "ends": [1, 2], "count": 2, "values": raw}
    c = layout_check.check
    checks = {
        "unsupported-type": c(raw, "decimal"),
        "unsupported-layout-type": c({"kind": "raw", "size": 3, "count": 0, "data": b""}, "int32"),
        "buffer-too-short": c({**raw, "count": 3}, "int32"),
        "count-mismatch": c(raw, "int32", 3),
        "validity-mismatch": c({"kind": "bitpack", "width": 3, "count": 2, "data": bytes(384), "validity": [True]}, "int32"),
        "invalid-bit-width": c({"kind": "bitpack", "width": 33, "count": 2, "data": bytes(8192)}, "int32"),
        "invalid-run-end": c({**runs, "ends": [2, 1]}, "int32"),
        "insufficient-run-values": c({**runs, "values": {**raw, "count": 1}}, "int32"),
        "invalid-dictionary-code": c({"kind": "dictionary", "codes": raw, "values": {**raw, "count": 1}}, "int32"),
        "unknown-kernel": c({"kind": "kernel", "kernel": 9, "params": b"", "count": 0}, "utf8"),
        "malformed-kernel-params": c({"kind": "kernel", "kernel": 1, "params": b"LAP1", "count": 0}, "float64"),
        "table-shape": layout_check.check_table([("a", "int32", raw), ("a", "int32", raw)], 2),
    }
    try:
        container.load(b"none")
        checks["container-shape"] = []
    except container.ContainerError:
        checks["container-shape"] = [("container-shape", "$")]
    return list(checks.items())


@query("""SELECT code AS expected, code AS found FROM (VALUES ('unsupported-type'), ('unsupported-layout-type'), ('buffer-too-short'), ('count-mismatch'), ('validity-mismatch'), ('invalid-bit-width'), ('invalid-run-end'),
    ('insufficient-run-values'), ('invalid-dictionary-code'), ('unknown-kernel'), ('malformed-kernel-params'), ('table-shape'), ('container-shape')) AS t(code)""")
def verify_layout_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(code, ",".join(c for c, _ in found)) for code, found in bad_layouts()], "expected string, found string")


_SMALL = _program({"x": ("int32", False)}, _loop(12, ir.ReadInput("in", ir.mul(ir.Var("i"), ir.u64(4)), ir.u64(4), "raw"), ir.AppendValue("output_x", ir.Var("raw"))), slices=(ir.InputSlice("in", 0, 48),))


@query("""SELECT * FROM (VALUES ('body.0.body.0.offset.mul-no-overflow', 'MulNoOverflow', 'i 4'), ('body.0.body.0.read-add-no-overflow', 'AddNoOverflow', '(mul i 4) 4'),
    ('body.0.body.0.read-in-range', 'InRange', '(+ (mul i 4) 4) 0 49'), ('body.0.body.0.capability-declared', 'FeatureImplies', 'input-capability:in')) AS t(id, kind, terms)""")
def verify_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c.id, c.kind, " ".join(c.terms)) for c in verify.verify(_SMALL).constraints], "id string, kind string, terms string")


@query("SELECT * FROM (VALUES ('input', 'in', '0+48'), ('output', 'output_x', 'int32'), ('loop', 'i', '12'), ('rows', '', '12')) AS t(fact, name, value)")
def ir_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = verify.admit(_SMALL)
    rows = [("input", n, f"{at}+{k}") for n, at, k in f.input_ranges] + [("output", n, kind) for n, kind, _ in f.output_schema] + [("loop", n, str(k)) for n, k in f.loop_bounds] + [("rows", "", str(f.row_bound))]
    return spark.createDataFrame(rows, "fact string, name string, value string")


@query("SELECT CAST(i AS BIGINT) AS seq, 'output_x' AS builder, CASE WHEN i % 2 = 0 THEN 'value' ELSE 'null' END AS event FROM range(6) t(i)")
def builder_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (ir.AppendValue("output_x", ir.i32(1)), ir.AppendNull("output_x"))
    events = interp.trace(_program({"x": ("int32", True)}, _loop(3, *both)), {})
    return spark.createDataFrame([(k, b, e) for k, (b, e) in enumerate(events)], "seq bigint, builder string, event string")


# Containers, sidecars, routing


@query("SELECT r_regionkey, r_name FROM region")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = container.save(table(spark, sf_dir, "region").toArrow())
    return spark.createDataFrame(container.load(held))


_CASE = "CASE WHEN NOT engine THEN 'engine-not-integrated' WHEN NOT sidecar THEN 'no-sidecar-present' WHEN NOT hashes THEN 'hash-mismatch' WHEN NOT supported THEN 'encoding-unsupported' END"


@query(f"SELECT *, {_CASE} AS reason, CASE WHEN engine AND sidecar AND hashes AND supported THEN 'native' ELSE 'host' END AS track FROM (SELECT i % 2 = 1 AS engine, i // 2 % 2 = 1 AS sidecar, i // 4 % 2 = 1 AS hashes, i // 8 % 2 = 1 AS supported FROM range(16) t(i))")
def routing_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = sidecar.bind(_DATA, codec.encode(_SMALL), [("in", 0, 48)])
    rows = []
    for k in range(16):
        engine, there, hashes, supported = (bool(k >> b & 1) for b in range(4))
        found = sidecar.route(engine, one if there else None, sidecar.check_bindings(one, _DATA if hashes else b"x" + _DATA[1:]), supported)
        rows.append((engine, there, hashes, supported, found.reason, found.track))
    return spark.createDataFrame(rows, "engine boolean, sidecar boolean, hashes boolean, supported boolean, reason string, track string")


_FLAGS = [f for f, _ in scan.GATES] + ["lowering_ok"]
_REFUSED = "CASE WHEN fallback = 'diagnostic-only' THEN 'diagnostic-only' ELSE 'fail-closed' END"
_DECISION = "CASE " + " ".join(f"WHEN NOT {f} {'AND unsupported_predicate <> ' + repr('scan-all') if f == 'predicate_ok' else ''} THEN {_REFUSED}" for f in _FLAGS[:-1]) + f" WHEN lowering = 'supported' AND lowering_ok THEN 'native-candidate' WHEN lowering = 'interpreter-only' AND fallback = 'allow-interpreter' THEN 'interpreter-fallback' ELSE {_REFUSED} END"


@query(
    f"SELECT *, {_DECISION} AS decision FROM (SELECT "
    + ", ".join(f"i // {1 << k} % 2 = 1 AS {f}" for k, f in enumerate(_FLAGS))
    + f", lowering, fallback, unsupported_predicate FROM range(256) t(i), (VALUES {', '.join(f'({x!r})' for x in scan.LOWERINGS)}) l(lowering), (VALUES {', '.join(f'({x!r})' for x in scan.FALLBACKS)}) f(fallback), (VALUES ('fail-closed'), ('scan-all')) u(unsupported_predicate))"
)
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [(F.floor(F.col("id") / (1 << k)) % 2 == 1).alias(f) for k, f in enumerate(_FLAGS)]
    each = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    inputs = spark.range(256).select(*flags).select("*", each("lowering", scan.LOWERINGS)).select("*", each("fallback", scan.FALLBACKS)).select("*", each("unsupported_predicate", ("fail-closed", "scan-all")))
    return inputs.withColumn("decision", scan.decision_column())


@query("SELECT * FROM (VALUES ('whole', TRUE), ('changed', FALSE), ('cut', FALSE)) AS t(data, matches)")
def binding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = sidecar.decode(sidecar.encode(sidecar.bind(_DATA, codec.encode(_SMALL), [("in", 0, 48)])))
    cases = {"whole": _DATA, "changed": _DATA[:-1] + b"\1", "cut": _DATA[:-1]}
    return spark.createDataFrame([(n, all(c.matches for c in sidecar.check_bindings(bound, d))) for n, d in cases.items()], "data string, matches boolean")


# Sources


@query("SELECT CAST(count(*) AS BIGINT) AS row_groups, CAST(sum(row_group_num_rows) AS BIGINT) AS rows, 'l_orderkey' AS column_name FROM (SELECT 1 AS one, count(*) AS row_group_num_rows FROM lineitem)")
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = parquet_facts.source_facts(spark, f"{sf_dir}/lineitem.parquet").where("column = 'l_orderkey'")
    return facts.groupBy(F.col("column").alias("column_name")).agg(F.count(F.lit(1)).alias("row_groups"), F.sum("rows").alias("rows"))


@query("SELECT column_name, TRUE AS matches FROM (VALUES ('n_name'), ('n_nationkey'), ('n_regionkey')) AS t(column_name)")
def chunk_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/nation.parquet"
    bound = parquet_facts.chunk_bindings(spark, path, codec.identity(_SMALL))
    return parquet_facts.check_bindings(spark, path, bound).select(F.substring_index("granule", "/", -1).alias("column_name"), "matches")


@query("""SELECT name AS "column", status, detail, CASE WHEN status = 'encoded' THEN (SELECT count(*) FROM orders) ELSE 0 END AS rows, CASE name WHEN 'o_orderkey' THEN 8 WHEN 'o_custkey' THEN 8 WHEN 'o_totalprice' THEN 8 ELSE 0 END AS width
    FROM (VALUES ('o_orderkey', 'encoded', 'int64'), ('o_custkey', 'encoded', 'int64'), ('o_totalprice', 'encoded', 'float64'), ('o_orderdate', 'skipped', 'type timestamp_ntz is not in the language')) AS t(name, status, detail)""")
def ingress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    report = store.ingress_report(spark, stored(spark, sf_dir, "orders", columns, required=("o_orderkey", "o_custkey", "o_totalprice")))
    return report.select("column", "status", "detail", "rows", F.when(F.col("rows") > 0, F.floor(F.col("bytes") / F.col("rows"))).otherwise(0).cast("int").alias("width"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = arrow_ipc(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return spark.createDataFrame(pa.ipc.open_stream(held).read_all())


# Scans of an encoded table in the store

_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, columns: list[str], rows: int = 16384, required: tuple[str, ...] = (), order_by: str | None = None) -> str:
    """The path of an encoded table, which is written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(columns), rows, required, order_by)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/tessella/encoded-{name}-{uuid.uuid4().hex}"
        store.write_encoded(table(spark, sf_dir, name).select(*columns), path, rows=rows, required=required, order_by=order_by)
        _STORED[key] = path
    return _STORED[key]


@query("SELECT l_quantity, l_orderkey FROM lineitem")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    order = [c for c, _ in scan.projection(columns, [(0, 1), (2, 0)])]
    return store.read_encoded(spark, stored(spark, sf_dir, "lineitem", columns), columns=order)


_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


#: A key that is there in every scale, in the middle; and the least key and one that no row has.
_VALUES = {"": 625, "_first": 0, "_absent": -5}


def _scan_predicate(op: str, where: str, value: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = stored(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], 2048, order_by="l_orderkey")
        return store.read_encoded(spark, path, predicate=scan.Predicate("l_orderkey", op, value))

    QUERIES[f"scan_pred_{op}{where}"] = run
    ORACLES[f"scan_pred_{op}{where}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey {_SIGNS[op]} {value}"


for _op in _SIGNS:
    for _where, _value in _VALUES.items():
        _scan_predicate(_op, _where, _value)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def scan_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_encoded(spark, stored(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"], 1024), parallel=4)


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS held FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 700)")
def scan_split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 rows from the 700th on, of a table in the order of its keys: how many, and how many of them belong there."""
    path = stored(spark, sf_dir, "orders", ["o_orderkey"], 256, order_by="o_orderkey")
    rows = store.read_encoded(spark, path, split=scan.Split(700, 100))
    expected = table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(700).limit(100)
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(rows.join(expected, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("held")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 40")
def scan_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasource.register(spark)
    return spark.read.format("tessella").load(stored(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"], 1024)).where("o_orderkey >= 40")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_encoded(spark, f"{shared_dir(spark)}/tessella/none-{uuid.uuid4().hex}", fallback=f"{sf_dir}/nation.parquet")


@query("SELECT CAST(k AS INTEGER) AS part, CAST(60 * k AS BIGINT) AS first_row, CAST(60 AS BIGINT) AS n_rows FROM range(4) t(k)")
def scan_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, s.start, s.rows) for k, s in enumerate(scan.splits(240, None, parallel=4))], "part int, first_row bigint, n_rows bigint")


# Relational work over decoded rows


def _decoded_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return _generated(df, 16384)


@query("SELECT l_linenumber, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, sum(l_quantity) AS total FROM lineitem GROUP BY l_linenumber")
def host_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return _decoded_lineitem(spark, sf_dir).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.avg(q), 6).alias("mean"), F.sum(q).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded_lineitem(spark, sf_dir).where("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 20")
def host_orderby_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem")
def host_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded_lineitem(spark, sf_dir)


def arrow_ipc(df: DataFrame) -> bytes:
    """A result as a bare Arrow IPC stream."""
    rows = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()
