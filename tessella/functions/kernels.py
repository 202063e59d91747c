"""Kernels with parameter blocks: string symbols (id 0) and decimal floats (id 1).

Both blocks are little-endian with a magic and a version; readers reject unknown flags, reserved bytes that are not
zero, counts that disagree, validity bytes other than 0 and 1, and trailing bytes.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np

ALP_MAGIC, FSST_MAGIC, VERSION, HAS_VALIDITY = b"LAP1", b"LFS1", 1, 1
ESCAPE = 255
FSST, ALP = 0, 1


class KernelError(ValueError):
    """code: malformed-kernel-params or unknown-kernel."""

    def __init__(self, message: str, code: str = "malformed-kernel-params"):
        super().__init__(message)
        self.code = code


class _Block:
    def __init__(self, data: bytes, magic: bytes):
        self.data, self.at = data, 0
        if self.take(4) != magic:
            raise KernelError("wrong magic")
        if self.number("H") != VERSION:
            raise KernelError("unknown version")
        self.flags = self.number("H")
        if self.flags & ~HAS_VALIDITY:
            raise KernelError("unknown flags")

    def take(self, n: int) -> bytes:
        if n < 0 or n > len(self.data) - self.at:
            raise KernelError("block is too short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def zero(self, n: int) -> None:
        if any(self.take(n)):
            raise KernelError("reserved bytes are not zero")

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.take(n * np.dtype(kind).itemsize), dtype=kind)

    def validity(self, rows: int) -> np.ndarray | None:
        if not self.flags & HAS_VALIDITY:
            return None
        if self.number("Q") != rows:
            raise KernelError("validity count differs from rows")
        bits = self.array("u1", rows)
        if bits.size and bits.max() > 1:
            raise KernelError("validity bytes must be 0 or 1")
        return bits.astype(bool)

    def end(self) -> None:
        if self.at != len(self.data):
            raise KernelError("bytes follow the block")


def _validity_bytes(valid: np.ndarray | None) -> bytes:
    return b"" if valid is None else struct.pack("<Q", len(valid)) + valid.astype("u1").tobytes()


# Decimal floats


def alp_encode(values: np.ndarray, exponent: int, valid: np.ndarray | None = None) -> bytes | None:
    """A parameter block, or None if any valid value is not exactly mantissa * 10**exponent (there are no exceptions)."""
    scale = 10.0**exponent
    double = values.dtype == np.float64
    wide = np.where(valid, values, 0).astype(np.float64) if valid is not None else values.astype(np.float64)
    scaled = np.round(wide / scale)
    if not np.isfinite(scaled).all() or (np.abs(scaled) >= 2.0**63).any():
        return None
    mantissas = scaled.astype("<i8")
    back = (mantissas.astype(np.float64) * scale).astype(values.dtype)
    want = np.where(valid, values, back) if valid is not None else values
    if (back.view("u8" if double else "u4") != np.ascontiguousarray(want).view("u8" if double else "u4")).any():
        return None
    head = ALP_MAGIC + struct.pack("<HHB3xQiIQ", VERSION, HAS_VALIDITY if valid is not None else 0, 2 if double else 1, len(values), exponent, 0, len(values))
    return head + mantissas.tobytes() + _validity_bytes(valid)


@dataclass
class Alp:
    double: bool
    exponent: int
    mantissas: np.ndarray
    valid: np.ndarray | None


def alp_parse(data: bytes) -> Alp:
    b = _Block(data, ALP_MAGIC)
    kind = b.number("B")
    if kind not in (1, 2):
        raise KernelError("unknown output type")
    b.zero(3)
    rows, exponent = b.number("Q"), b.number("i")
    b.zero(4)
    if b.number("Q") != rows:
        raise KernelError("mantissa count differs from rows")
    out = Alp(kind == 2, exponent, b.array("<i8", rows), b.validity(rows))
    b.end()
    return out


def alp_decode(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    p = alp_parse(data)
    try:
        scale = 10.0**p.exponent
    except OverflowError as error:
        raise KernelError("scale is not finite") from error
    with np.errstate(over="ignore"):
        out = p.mantissas.astype(np.float64) * scale
        out = out if p.double else out.astype(np.float32)
    if not np.isfinite(out).all():
        raise KernelError("value is not finite")
    return out, p.valid


# String symbols


def train_symbols(values: list[bytes], sample: int = 1 << 14, rounds: int = 4) -> list[bytes]:
    """Up to 255 symbols of 1 to 8 bytes: in each round the strings are coded with the current table, and symbols and
    pairs of neighbours compete by the bytes they would save. Any table is a right one; the sample bounds the work."""
    text = values[: max(1, sample // (1 + sum(map(len, values[:64])) // max(1, len(values[:64]))))]
    table: list[bytes] = []
    for _ in range(rounds):
        gain: Counter[bytes] = Counter()
        find = _finder(table)
        for v in text:
            before, at = b"", 0
            while at < len(v):
                code = find(v, at)
                now = table[code] if code is not None else v[at : at + 1]
                gain[now] += len(now)
                if before and len(before) + len(now) <= 8:
                    gain[before + now] += len(before) + len(now)
                before, at = now, at + len(now)
        table = [s for s, _ in sorted(gain.items(), key=lambda x: (-x[1], x[0]))[:255]]
    return table


def _finder(table: list[bytes]):
    """The code of the longest symbol at a place, or None."""
    codes = {s: i for i, s in enumerate(table)}
    by_first: dict[int, list[int]] = {}
    for s in table:
        by_first.setdefault(s[0], [])
        if len(s) not in by_first[s[0]]:
            by_first[s[0]].append(len(s))
    for sizes in by_first.values():
        sizes.sort(reverse=True)

    def find(v: bytes, at: int) -> int | None:
        for n in by_first.get(v[at], ()):
            code = codes.get(v[at : at + n])
            if code is not None:
                return code
        return None

    return find


def fsst_encode(values: list[bytes | None], table: list[bytes] | None = None) -> bytes:
    """A parameter block; None is a null of no bytes."""
    plain = [v or b"" for v in values]
    table = train_symbols(plain) if table is None else table
    find, codes, offsets = _finder(table), bytearray(), [0]
    for v in plain:
        at = 0
        while at < len(v):
            code = find(v, at)
            if code is None:
                codes += bytes((ESCAPE, v[at]))
                at += 1
            else:
                codes.append(code)
                at += len(table[code])
        offsets.append(len(codes))
    valid = np.array([v is not None for v in values]) if any(v is None for v in values) else None
    head = FSST_MAGIC + struct.pack("<HHQHH", VERSION, HAS_VALIDITY if valid is not None else 0, len(values), len(table), 0)
    symbols = b"".join(s.ljust(8, b"\0") for s in table) + bytes(len(s) for s in table)
    return head + symbols + np.array(offsets, "<u8").tobytes() + np.array([len(v) for v in plain], "<u8").tobytes() + _validity_bytes(valid) + struct.pack("<Q", len(codes)) + bytes(codes)


def fsst_decode(data: bytes) -> list[str | None]:
    b = _Block(data, FSST_MAGIC)
    rows, n = b.number("Q"), b.number("H")
    if n > 255:
        raise KernelError("too many symbols")
    b.zero(2)
    raw, lengths = b.take(8 * n), b.take(n)
    if any(not 1 <= k <= 8 for k in lengths):
        raise KernelError("symbol lengths must be 1 to 8")
    table = [raw[8 * i : 8 * i + k] for i, k in enumerate(lengths)]
    if rows >= 1 << 48:
        raise KernelError("block is too short")
    offsets, sizes, valid = b.array("<u8", rows + 1).tolist(), b.array("<u8", rows).tolist(), b.validity(rows)
    codes = b.take(b.number("Q"))
    b.end()
    if offsets[0] != 0 or offsets[-1] != len(codes) or any(x > y for x, y in zip(offsets, offsets[1:], strict=False)):
        raise KernelError("offsets must rise from 0 to the end of the codes")
    out: list[str | None] = []
    for row in range(rows):
        parts, run = [], iter(codes[offsets[row] : offsets[row + 1]])
        for code in run:
            if code < n:
                parts.append(table[code])
            elif code == ESCAPE:
                literal = next(run, None)
                if literal is None:
                    raise KernelError("escape at the end of a string")
                parts.append(bytes((literal,)))
            else:
                raise KernelError(f"code {code} has no symbol")
        value = b"".join(parts)
        if len(value) != sizes[row]:
            raise KernelError("decoded length differs")
        try:
            out.append(value.decode() if valid is None or valid[row] else None)
        except UnicodeDecodeError as error:
            raise KernelError("decoded string is not UTF-8") from error
    return out


def run_kernel(kernel: int, params: bytes):
    if kernel == FSST:
        return fsst_decode(params)
    if kernel == ALP:
        return alp_decode(params)
    raise KernelError(f"kernel {kernel} is unknown", "unknown-kernel")
