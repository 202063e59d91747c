"""The decode language: verifier, codec, identity, interpreter, compiled forms, sidecars, scan planning, containers."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella import catalog, cli
from tessella.functions import blake3 as b3
from tessella.plans import codec, compile, container, interp, ir, scan, sidecar, verify


def program(builders, body, slices=(), rows=64):
    return catalog._program(builders, body, rows, slices)


def test_blake3_published_vectors():
    data = bytes(i % 251 for i in range(2049))
    assert b3.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert b3.blake3(data[:1025]).hex().startswith("d00278ae47eb27b3")
    assert b3.blake3(data).hex().startswith("5f4d72f40d7a5f82")


@pytest.mark.parametrize("code", verify.CODES)
def test_one_program_per_code(code):
    assert verify.verify(catalog.bad_programs()[code]).codes() == [code]


def test_budgets_of_bytes_and_scratch():
    p = catalog._SMALL
    poor = ir.Program(capabilities=p.capabilities, budget=ir.Budget(1000, 47, 0, 100, 64, 64), body=p.body)
    assert verify.verify(poor).codes() == ["resource-budget-exceeded"]
    scratch = ir.Program(capabilities=(*p.capabilities, ir.Scratch("s", 9)), budget=p.budget, body=p.body)
    assert verify.verify(scratch).codes() == ["resource-budget-exceeded"]


def test_reads_are_relative_to_their_slice():
    inside = program({"x": ("int32", False)}, (ir.ReadInput("in", ir.u64(4), ir.u64(4), "r"), ir.AppendValue("output_x", ir.Var("r"))), (ir.InputSlice("in", 100, 8),))
    assert verify.verify(inside).ok
    outside = program({"x": ("int32", False)}, (ir.ReadInput("in", ir.u64(5), ir.u64(4), "r"), ir.AppendValue("output_x", ir.Var("r"))), (ir.InputSlice("in", 100, 8),))
    assert verify.verify(outside).codes() == ["missing-input-capability"]


def test_a_name_of_one_branch_is_not_in_scope_after_it():
    body = (ir.If(ir.Const("bool", True), (ir.LetScalar("a", ir.i32(1)),)), ir.AppendValue("output_x", ir.Var("a")))
    assert verify.verify(program({"x": ("int32", False)}, body)).codes() == ["unknown-variable"]


def test_codec_round_trips_and_rejects():
    for p in (*catalog.bad_programs().values(), cli.sample_program(), catalog._SMALL):
        raw = codec.encode(p)
        assert codec.decode(raw) == p and codec.from_json(codec.to_json(p)) == p
        with pytest.raises(codec.CodecError):
            codec.decode(raw + b"\0")
        with pytest.raises(codec.CodecError):
            codec.decode(raw[:-1])
    assert verify.verify_bytes(b"L2IR").codes() == ["explicit-fail-closed"]


def test_deep_nesting_is_rejected():
    body = (ir.AppendNull("x"),)
    for _ in range(codec.DEEPEST + 1):
        body = (ir.If(ir.Const("bool", True), body),)
    with pytest.raises(codec.CodecError):
        codec.decode(codec.encode(ir.Program(body=body)))


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_bytes_are_a_program_or_an_error(raw):
    try:
        codec.decode(b"L2IR\1\0" + raw)
    except codec.CodecError:
        pass


@given(st.lists(st.integers(-(1 << 31), (1 << 31) - 1), min_size=1, max_size=30), st.integers(-100, 100))
@settings(max_examples=60, deadline=None)
def test_vectors_agree_with_the_interpreter(values, pivot):
    n = len(values)
    data = struct.pack(f"<{n}i", *values)
    cond = ir.Binary("lt", ir.Var("r"), ir.i32(pivot))
    body = catalog._loop(n, ir.ReadInput("in", ir.mul(ir.Var("i"), ir.u64(4)), ir.u64(4), "r"), ir.If(cond, (ir.AppendValue("output_x", ir.Binary("min", ir.Var("r"), ir.i32(0))),), (ir.AppendNull("output_x"),)), ir.AppendValue("output_s", ir.Bitcast("bytes", ir.Var("r"))))
    p = program({"x": ("int32", True), "s": ("utf8", False)}, body, (ir.InputSlice("in", 0, 4 * n),))
    try:
        slow = interp.interpret(p, {"in": data})
    except interp.Failed:  # the bytes are no text
        with pytest.raises(interp.Failed):
            compile.run_block(p, {"in": np.frombuffer(data, np.uint8)}, n)
        return
    assert compile.run_block(p, {"in": np.frombuffer(data, np.uint8)}, n).to_pydict() == {"x": slow["output_x"], "s": slow["output_s"]}


def test_arithmetic_out_of_range_fails_closed(spark):
    p = program({"x": ("int32", False)}, catalog._loop(3, ir.AppendValue("output_x", ir.add(ir.i32((1 << 31) - 1), ir.Bitcast("int32", ir.i32(1))))))
    with pytest.raises(interp.Failed):
        interp.interpret(p, {})
    with pytest.raises(interp.Failed):
        compile.run_block(p, {}, 3)
    with pytest.raises(Exception, match="arithmetic-out-of-range"):
        compile.to_dataframe(spark, p).collect()


def test_columns_interpreter_and_default_program(spark):
    p = cli.sample_program()
    rows = compile.to_dataframe(spark, p)
    assert rows.schema == p.schema() or [f.name for f in rows.schema] == [f.name for f in p.schema()]
    assert [tuple(r) for r in rows.collect()] == [(True, 42, 9999, np.float32(3.14), 2.718, "hello")] * 5


def test_rejected_programs_never_run(spark):
    with pytest.raises(verify.Rejected):
        compile.to_dataframe(spark, catalog.bad_programs()["unknown-variable"])


def test_sidecar_routes():
    raw = codec.encode(catalog._SMALL)
    data = bytes(range(48))
    bound = sidecar.bind(data, raw, [("in", 0, 48)])
    wire = sidecar.encode(bound)
    assert sidecar.decode(wire) == bound
    with pytest.raises(sidecar.SidecarError):
        sidecar.decode(wire + b"x")
    assert sidecar.open_data(data, wire)[0].track == sidecar.NATIVE
    assert sidecar.open_data(b"x" + data[1:], wire)[0].reason == "hash-mismatch"
    assert sidecar.open_data(data, None)[0].reason == "no-sidecar-present"
    assert sidecar.open_data(data, wire, engine=False)[0].reason == "engine-not-integrated"
    alien = ir.Program(required=("other",), capabilities=catalog._SMALL.capabilities, budget=catalog._SMALL.budget, body=catalog._SMALL.body)
    assert sidecar.open_data(data, sidecar.encode(sidecar.bind(data, codec.encode(alien), [])))[0].reason == "encoding-unsupported"
    bad = codec.encode(catalog.bad_programs()["unknown-variable"])
    assert sidecar.open_data(data, sidecar.encode(sidecar.bind(data, bad, [])))[0].reason == "verifier-rejected"


def test_scan_planning_refuses():
    for pairs in ([], [(0, 0), (0, 1)], [(0, 0), (1, 0)], [(9, 0)]):
        with pytest.raises(scan.ScanError, match="unsupported-projection"):
            scan.projection(["a", "b"], pairs)
    with pytest.raises(scan.ScanError, match="invalid-split"):
        scan.splits(10, [scan.Split(5, 6)])
    with pytest.raises(scan.ScanError, match="unsafe-concurrency"):
        scan.splits(10, None, splittable=False, parallel=2)
    assert scan.plan_predicate(scan.Predicate("a", "like", 1), unsupported="scan-all") is False
    with pytest.raises(scan.ScanError, match="unsupported-predicate"):
        scan.plan_predicate(scan.Predicate("a", "like", 1))


def test_decision_column_agrees_with_the_function(spark):
    rows = catalog.decision_table(spark, "").collect()
    assert len(rows) == 4608
    for r in rows:
        assert scan.decide({f: r[f] for f in catalog._FLAGS}, r.lowering, r.fallback, r.unsupported_predicate).decision == r.decision


def test_plan_cache():
    cache = scan.PlanCache()
    assert cache.get(a=1) == ("miss", None)
    cache.put("plan", a=1)
    assert cache.get(a=1) == ("hit", "plan")
    key = scan.cache_key(a=1)
    cache.held[key] = ("other", "plan")
    assert cache.get(a=1) == ("key-mismatch", None)


def test_containers():
    t = pa.table({"a": [1, None], "day": pa.array([0, 1], pa.date32()), "l": [[1], None]})
    raw = container.save(t)
    assert container.load(raw).equals(t)
    assert container.load(raw[:-4]).equals(t)  # the trailing magic may be absent
    header, section = container._HEADER.size, container._SECTION

    def changed(at, value):
        return raw[:at] + value + raw[at + len(value) :]

    cases = {
        "magic": changed(0, b"XXXX"), "version": changed(4, b"\2"), "required-feature": changed(8, b"\x80"), "flags": changed(header + 2, b"\1"),
        "checksum": changed(header + section.size - 8, b"\1"), "reserved": changed(header + section.size - 4, b"\1"), "gap-or-overlap": changed(header + 4, b"\0"),
        "out-of-container": changed(header + 12, b"\xff" * 4), "missing-payload": changed(header, b"\7"), "trailing-bytes": raw + b"x",
    }
    for code, data in cases.items():
        with pytest.raises(container.ContainerError) as error:
            container.load(data)
        assert error.value.code == code


def test_command_line(tmp_path, capsys):
    target = str(tmp_path / "p.l2ir")
    assert cli.main(["sample", target]) == 0 and cli.main(["verify", target]) == 0
    assert cli.main(["convert", target, str(tmp_path / "p.json")]) == 0 and cli.main(["verify", str(tmp_path / "p.json")]) == 0
    (tmp_path / "bad").write_bytes(codec.encode(catalog.bad_programs()["unknown-variable"]))
    assert cli.main(["verify", str(tmp_path / "bad")]) == 6
    assert "unknown-variable" in capsys.readouterr().out
    (tmp_path / "data").write_bytes(b"abc")
    assert cli.main(["embed", str(tmp_path / "data"), target]) == 0
    assert sidecar.decode((tmp_path / ("data" + sidecar.SUFFIX)).read_bytes()).bindings[0].length == 3
