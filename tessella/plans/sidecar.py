"""Sidecars: a program beside the data it decodes, bound to it by content hashes, and the routing decision.

The file is ``<data>`` + ``SUFFIX``; its binary form is: program length (4 bytes) and bytes, binding count (2), and for
each binding granule, offset, length, content hash and program identity (names with one length byte, numbers of eight).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from tessella.functions.blake3 import content_hash
from tessella.plans import codec, verify

SUFFIX = ".tsidecar"
NATIVE, HOST = "native", "host"
#: Reasons for the host's reader, in the order of the gates.
REASONS = ("engine-not-integrated", "no-sidecar-present", "hash-mismatch", "encoding-unsupported")
LATER_REASONS = ("verifier-rejected", "decode-unsupported")
SUPPORTED = frozenset({"l2core.copy.v0"})


@dataclass(frozen=True)
class Binding:
    granule: str
    offset: int
    length: int
    content_hash: str
    identity: str


@dataclass(frozen=True)
class Sidecar:
    program: bytes
    bindings: tuple[Binding, ...]


class SidecarError(ValueError):
    pass


def _is_hash(text: str) -> bool:
    return text.startswith("blake3:") and len(text) == 71 and all(c in "0123456789abcdef" for c in text[7:])


def encode(sidecar: Sidecar) -> bytes:
    out = bytearray(struct.pack("<I", len(sidecar.program)) + sidecar.program + struct.pack("<H", len(sidecar.bindings)))
    for b in sidecar.bindings:
        if not _is_hash(b.content_hash) or not _is_hash(b.identity):
            raise SidecarError("a hash is not blake3:<64 hex digits>")
        for text, numbers in ((b.granule, (b.offset, b.length)), (b.content_hash, ()), (b.identity, ())):
            raw = text.encode()
            if len(raw) > 255:
                raise SidecarError("a name is longer than 255 bytes")
            out += bytes((len(raw),)) + raw + b"".join(struct.pack("<Q", n) for n in numbers)
    return bytes(out)


def decode(data: bytes) -> Sidecar:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n > len(data) - at:
            raise SidecarError("sidecar is cut off")
        at += n
        return data[at - n : at]

    def text() -> str:
        try:
            return take(take(1)[0]).decode()
        except UnicodeDecodeError as error:
            raise SidecarError("a name is not UTF-8") from error

    program = take(struct.unpack("<I", take(4))[0])
    bindings = []
    for _ in range(struct.unpack("<H", take(2))[0]):
        granule = text()
        offset, length = struct.unpack("<QQ", take(16))
        bindings.append(Binding(granule, offset, length, text(), text()))
        if not _is_hash(bindings[-1].content_hash) or not _is_hash(bindings[-1].identity):
            raise SidecarError("a hash is not blake3:<64 hex digits>")
    if at != len(data):
        raise SidecarError("bytes follow the bindings")
    return Sidecar(program, tuple(bindings))


def bind(data: bytes, program: bytes, granules: list[tuple[str, int, int]]) -> Sidecar:
    """A sidecar for byte ranges of some data."""
    identity = content_hash(program)
    return Sidecar(program, tuple(Binding(name, at, n, content_hash(data[at : at + n]), identity) for name, at, n in granules))


@dataclass(frozen=True)
class Check:
    binding: Binding
    found: str

    @property
    def matches(self) -> bool:
        return self.found == self.binding.content_hash


def check_bindings(sidecar: Sidecar, data: bytes) -> list[Check]:
    """Recomputed hashes; a range beyond the data, or a foreign program, matches nothing."""
    identity = content_hash(sidecar.program)
    return [Check(b, content_hash(data[b.offset : b.offset + b.length]) if b.offset + b.length <= len(data) and b.identity == identity else "blake3:") for b in sidecar.bindings]


@dataclass(frozen=True)
class Route:
    track: str
    reason: str | None = None
    diagnostics: tuple[verify.Diagnostic, ...] = ()


def features_supported(required: tuple[str, ...]) -> bool:
    return set(required) <= SUPPORTED


def route(engine: bool, sidecar: Sidecar | None, checks: list[Check], supported: bool) -> Route:
    """The gates in order; the first that fails names the reason."""
    bad = [c for c in checks if not c.matches]
    gates = (
        (engine, [("$.engine", "the engine does not take sidecars")]),
        (sidecar is not None, [("$.sidecar", "there is no sidecar")]),
        (not bad, [(f"$.hash.{c.binding.granule}", f"expected {c.binding.content_hash}, found {c.found}") for c in bad]),
        (supported, [("$.sidecar.ir", "the program needs features that are not supported")]),
    )
    for (passed, notes), reason in zip(gates, REASONS, strict=True):
        if not passed:
            return Route(HOST, reason, tuple(verify.Diagnostic(reason, path, message) for path, message in notes))
    return Route(NATIVE)


def open_data(data: bytes, overlay: bytes | None, *, engine: bool = True) -> tuple[Route, object]:
    """Every gate in one place: routing, then verification. The program is returned only if all passed."""
    try:
        sidecar = decode(overlay) if overlay is not None else None
        program = codec.decode(sidecar.program) if sidecar else None
    except (SidecarError, codec.CodecError) as error:
        return Route(HOST, "verifier-rejected", (verify.Diagnostic("verifier-rejected", "$.sidecar", str(error)),)), None
    decision = route(engine, sidecar, check_bindings(sidecar, data) if sidecar else [], bool(program) and features_supported(program.required))
    if decision.track == HOST:
        return decision, None
    report = verify.verify(program)
    if not report.ok:
        return Route(HOST, "verifier-rejected", tuple(report.diagnostics)), None
    return decision, program
