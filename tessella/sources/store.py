"""Encoded tables in a store: Parquet files of packed blocks beside a program that decodes them.

``write_encoded`` verifies the program, packs rows into blocks, and adds per block a hash of each slice and, for integer
columns, the least and greatest value; with ``order_by`` rows are range-partitioned and sorted first, so that predicates on
that column skip blocks. ``read_encoded`` opens the sidecar, passes the gates of ``plans.sidecar`` and the execution
decision of ``plans.scan``, and decodes blocks in one narrow stage. Projection prunes the program, so only the slices of
the wanted columns are read from Parquet; a predicate is first an ordinary filter on the blocks' least and greatest
values, which Parquet and Spark push down, and then a filter on the rows; a split (a range of rows) is a filter on where
blocks stand, and cuts the first and last. If a gate fails the original data is read instead; a slice whose bytes do not
hash to what is bound to it fails the query, never part of the rows. Hashes of slices are SHA-256, which the JVM computes;
the program and external sidecars are bound by BLAKE3.

Paths go through Spark's readers and writers only, so any store that Spark can open will do.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.blake3 import content_hash
from tessella.plans import codec, compile, ir, scan, sidecar, verify
from tessella.sources.generate import BLOCK_ROWS, Generated, generate, pack_table

_INTEGERS = ("int32", "int64")


def _stats(program: ir.Program) -> list[str]:
    return [ir.column_name(b.id) for b in program.builders() if b.type in _INTEGERS]


def _hash(part: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.col(f"`{part}`"), 256))


def described(df: DataFrame, program: ir.Program, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of a table with ``x#min``, ``x#max`` of integer columns, taken as a block is packed, and ``x#hash`` of every slice."""
    return pack_table(df, program, rows, bounds=tuple(_stats(program))).withColumns({f"{s}#hash": _hash(s) for s in program.slices()})


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_encoded(df: DataFrame, path: str, *, rows: int = BLOCK_ROWS, required: tuple[str, ...] = (), order_by: str | None = None) -> Generated:
    """Blocks at ``path``/blocks, where parts begin at ``path``/parts, and the sidecar at ``path``/program; returns what was
    generated, with skipped columns."""
    made = generate(df.schema, rows, required=required)
    if made.program is None:
        raise ValueError(f"no column can be encoded: {made.skipped}")
    verify.admit(made.program)
    if order_by:
        df = df.repartitionByRange(F.col(f"`{order_by}`")).sortWithinPartitions(F.col(f"`{order_by}`"))
    described(df, made.program, rows).write.mode("overwrite").parquet(f"{path}/blocks")
    parts = df.sparkSession.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("rows").cast("bigint").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts.withColumn("first_row", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    program = codec.encode(made.program)
    identity = content_hash(program)
    _put_text(df.sparkSession, f"{path}/program", json.dumps({"program": program.hex(), "identity": identity, "skipped": made.skipped}))
    return made


def _held(spark: SparkSession, path: str) -> dict | None:
    try:
        text = spark.read.text(f"{path}/program", wholetext=True).first()
    except Exception as error:  # an absent path is an analysis error of Spark
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return json.loads(text[0]) if text else None


def open_program(spark: SparkSession, path: str) -> tuple[sidecar.Route, ir.Program | None]:
    """The program beside the blocks, if every gate passes."""
    held = _held(spark, path)
    if held is None:
        return sidecar.route(True, None, [], True), None
    raw = bytes.fromhex(held["program"])
    overlay = sidecar.encode(sidecar.Sidecar(raw, (sidecar.Binding("program", 0, len(raw), held["identity"], content_hash(raw)),)))
    return sidecar.open_data(raw, overlay)


def block_filter(p: scan.Predicate, program: ir.Program):
    """A condition on blocks that holds wherever a row may satisfy the predicate, or None."""
    if p.column not in _stats(program):
        return None
    return scan.BLOCK_TESTS[p.op](F.col(f"`{p.column}#min`"), F.col(f"`{p.column}#max`"), F.lit(p.value))


def _checked(part: str) -> Column:
    """A slice that hashes to what is bound to it; the query fails on any other."""
    found = F.col(f"`{part}`")
    return F.when(_hash(part) == F.col(f"`{part}#hash`"), found).otherwise(F.raise_error(F.lit(f"hash-mismatch in slice {part!r}"))).alias(part)


#: Plans of this process by what was asked for: programs that were pruned and admitted.
PLANS = scan.PlanCache()


def _pruned(program: ir.Program, columns: list[str]) -> ir.Program:
    asked = {"program": codec.identity(program), "columns": columns}
    state, held = PLANS.get(**asked)
    if state == "hit":
        return held
    held = compile.prune(program, columns)
    verify.admit(held)
    PLANS.put(held, **asked)
    return held


def _decide(program: ir.Program, columns: list[str], predicate: scan.Predicate | None, split: scan.Split | None, total: int | None, parallel: int | None, unsupported: str) -> scan.Decision:
    """The execution decision of a scan of an accepted program."""
    names = [ir.column_name(b.id) for b in program.builders()]

    def passes(check) -> bool:
        try:
            check()
        except scan.ScanError:
            return False
        return True

    flags = {
        "artifact_accepted": True,
        "reader_accepted": PLANS.allowed(codec.identity(program)),
        "emitted": bool(names),
        "projection_ok": passes(lambda: scan.projection(names, [(names.index(c) if c in names else -1, k) for k, c in enumerate(columns)])),
        "predicate_ok": predicate is None or predicate.column in names and predicate.op in scan.PREDICATES,
        "split_ok": split is None or passes(lambda: scan.splits(total, [split])),
        "concurrency_ok": parallel is None or parallel >= 1,
    }
    return scan.decide(flags, "supported", unsupported_predicate=unsupported)


def read_encoded(
    spark: SparkSession, path: str, *, columns: list[str] | None = None, predicate: scan.Predicate | None = None, fallback: str | None = None, check_hashes: bool = True, split: scan.Split | None = None, parallel: int | None = None, unsupported: str = "fail-closed"
) -> DataFrame:
    """The rows of an encoded table, or of ``fallback`` (Parquet) if a gate fails; without one that raises.

    ``split`` reads a range of rows, in the order in which they were written; ``parallel`` that many even ranges side by
    side. ``unsupported`` tells what becomes of a predicate that cannot be planned: an error, or under ``scan-all`` none.
    """
    route, program = open_program(spark, path)
    reason = f"{route.reason}: {route.diagnostics}"
    every = [ir.column_name(b.id) for b in program.builders()] if program else []
    wanted = columns or every
    total = spark.read.parquet(f"{path}/parts").agg(F.sum("rows")).first()[0] or 0 if program and (split or parallel) else None
    if program is not None:
        decision = _decide(program, wanted, predicate, split, total, parallel, unsupported)
        if decision.decision != "native-candidate":
            program, reason = None, ", ".join(decision.diagnostics)
    if program is None:
        if fallback is None:
            raise scan.ScanError(reason.partition(":")[0], reason)
        df = spark.read.parquet(fallback)
        df = df.where(predicate.condition()) if predicate else df
        return df.select(*columns) if columns else df
    if predicate and not (predicate.column in every and predicate.op in scan.PREDICATES):
        predicate = None  # scan-all: whoever asked filters the rows
    needed = [*wanted, *([predicate.column] if predicate and predicate.column not in wanted else [])]
    pruned = _pruned(program, needed)
    blocks = spark.read.parquet(f"{path}/blocks")
    possible = block_filter(predicate, program) if predicate else None
    blocks = blocks.where(possible) if possible is not None else blocks

    def rows_of(one: scan.Split | None) -> DataFrame:
        here, between = (blocks, None) if one is None else _cut(spark, path, blocks, one)
        slices = list(pruned.slices())
        part = _checked if check_hashes else lambda s: F.col(f"`{s}`")
        own = here.select("rows", *([x.alias(n) for x, n in zip(between, ("own_first", "own_end"), strict=True)] if between else []), *map(part, slices))
        return compile.decode_blocks(own, pruned, between=(F.col("own_first"), F.col("own_end")) if between else None)

    ranges = scan.splits(total, None if parallel else [split], parallel=parallel or 1) if total else [None]
    rows = reduce(DataFrame.unionAll, map(rows_of, ranges))
    return (rows.where(predicate.condition()) if predicate else rows).select(*[F.col(f"`{c}`") for c in wanted])


def _cut(spark: SparkSession, path: str, blocks: DataFrame, split: scan.Split) -> tuple[DataFrame, tuple[Column, Column]]:
    """Blocks that hold rows of a split, as a filter that is pushed down, and which of their rows it takes."""
    end = split.start + split.rows
    inside = (F.col("first_row") < end) & (F.col("first_row") + F.col("rows") > split.start)
    ends = spark.read.parquet(f"{path}/parts").where(inside).agg(F.min_by("part", "first_row"), F.min("first_row"), F.max_by("part", "first_row"), F.max("first_row")).first()
    first_part, first_row, last_part, last_row = ends
    low = F.when(F.col("part") == first_part, F.lit(split.start - first_row)).otherwise(0)  # rows of the part
    high = F.when(F.col("part") == last_part, F.lit(end - last_row)).otherwise(F.lit(2**62))
    own = blocks.where((F.col("part") >= first_part) & (F.col("part") <= last_part)).where((F.col("part_row") + F.col("rows") > low) & (F.col("part_row") < high))
    return own, (F.greatest(low - F.col("part_row"), F.lit(0)), F.least(high - F.col("part_row"), F.col("rows")))


def read_beside(spark: SparkSession, path: str, *, fallback: bool = True) -> DataFrame:
    """A data file with a sidecar beside it (``path`` + SUFFIX): decoded by its program if every gate passes, else read as
    Parquet. The file is bound as a whole, so it is held as a whole; a slice of the program is its range of bytes."""

    def content(of: str) -> bytes | None:
        folder, _, name = of.rpartition("/")
        row = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("content").first()
        return bytes(row.content) if row else None

    data, overlay = content(path), content(path + sidecar.SUFFIX)
    if data is None:
        raise FileNotFoundError(path)
    route, program = sidecar.open_data(data, overlay)
    if program is not None:
        return compile.to_dataframe(spark, program, {s.id: data[s.offset : s.offset + s.length] for s in program.slices().values()})
    if not fallback:
        raise scan.ScanError(route.reason, str(route.diagnostics))
    return spark.read.parquet(path)


def ingress_report(spark: SparkSession, path: str) -> DataFrame:
    """What taking in a table really made: a row per column of the source, from the program, the list of skipped columns and
    the blocks themselves: column, status, type (as stored) or reason, blocks, rows, bytes, identity of the program."""
    held = _held(spark, path)
    if held is None:
        raise ValueError(f"no-sidecar-present: {path}")
    program = codec.decode(bytes.fromhex(held["program"]))
    verify.admit(program)
    blocks = spark.read.parquet(f"{path}/blocks")
    own = {ir.column_name(b.id): (b.type, [s for s in program.slices() if s.partition("#")[0] == ir.column_name(b.id)]) for b in program.builders()}
    sizes = [F.sum(reduce(lambda a, b: a + b, [F.octet_length(F.col(f"`{s}`")).cast("bigint") for s in parts])).alias(c) for c, (_, parts) in own.items()]
    found = blocks.agg(F.count(F.lit(1)).alias("#blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("#rows"), *sizes).first()
    rows = [(c, "encoded", kind, found["#blocks"], found["#rows"], found[c] or 0, held["identity"]) for c, (kind, _) in own.items()]
    rows += [(c, "skipped", reason, 0, 0, 0, None) for c, reason in held["skipped"]]
    return spark.createDataFrame(rows, "column string, status string, detail string, blocks bigint, rows bigint, bytes bigint, identity string")


def blocks_read(spark: SparkSession, path: str, predicates: list[scan.Predicate]) -> DataFrame:
    """How many blocks and rows a scan with all of the predicates must read."""
    _, program = open_program(spark, path)
    tests = [t for t in (block_filter(p, program) for p in predicates) if t is not None]
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.where(reduce(lambda a, b: a & b, tests, F.lit(True))).agg(F.count(F.lit(1)).alias("blocks"), F.sum("rows").alias("rows"))
