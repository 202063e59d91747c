"""Binary and JSON forms of programs, and their identity.

The binary form is canonical: little-endian, a magic and a version, lengths of four bytes, one tag byte per node. A
decoder here rejects unknown tags, lengths beyond the input, nesting deeper than ``DEEPEST`` and trailing bytes.
"""

from __future__ import annotations

import base64
import json
import struct
from dataclasses import fields
from typing import Any

from tessella.functions.blake3 import content_hash
from tessella.plans import ir

MAGIC, VERSION, DEEPEST = b"L2IR", 1, 64
_INTS = {"2": "<H", "4": "<I", "8": "<Q"}
#: struct codes of typed values, in the order of their tags; bytes are counted.
_VALUES = ("<?", "<i", "<q", "<I", "<Q", "<I", "<Q", None)


class CodecError(ValueError):
    pass


class _Writer:
    def __init__(self) -> None:
        self.out = bytearray()

    def put(self, kind: str, value: Any) -> None:
        if kind in _INTS:
            self.out += struct.pack(_INTS[kind], value)
        elif kind == "s":
            raw = value.encode()
            self.out += struct.pack("<I", len(raw)) + raw
        elif kind == "b":
            self.out.append(bool(value))
        elif kind == "o":
            self.out.append(ir.OUTPUT_TYPES.index(value))
        elif kind == "t":
            self.out.append(ir.SCALAR_TYPES.index(value))
        elif kind == "v":
            tag = ir.VALUE_TYPES.index(value.type)
            self.out.append(tag)
            if _VALUES[tag]:
                self.out += struct.pack(_VALUES[tag], value.value)
            else:
                self.out += struct.pack("<I", len(value.value)) + value.value
        elif kind == "e":
            self.expression(value)
        elif kind == "S":
            self.many("statement", value)

    def expression(self, e: Any) -> None:
        name = e.op if isinstance(e, ir.Binary) else type(e).__name__.lower()
        self.out.append(ir.EXPRESSION_TAGS.index(name))
        for kind, part in _expression_parts(e):
            self.put(kind, part)

    def node(self, family: str, value: Any) -> None:
        for tag, (cls, shape) in enumerate(ir.SHAPES[family]):
            if isinstance(value, cls):
                self.out.append(tag)
                for kind, f in zip(shape, fields(cls), strict=True):
                    self.put(kind, getattr(value, f.name))
                return
        raise CodecError(f"not a {family}: {value!r}")

    def many(self, family: str, values: Any) -> None:
        self.out += struct.pack("<I", len(values))
        for v in values:
            self.put("s", v) if family == "string" else self.node(family, v)


def _expression_parts(e: Any) -> list[tuple[str, Any]]:
    if isinstance(e, ir.Const):
        return [("v", e)]
    if isinstance(e, ir.Var):
        return [("s", e.name)]
    if isinstance(e, ir.Binary):
        return [("e", e.left), ("e", e.right)]
    return [("t", e.target), ("e", e.value)]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.depth = data, 0, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise CodecError(f"{n} bytes wanted at {self.at}, {len(self.data) - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> Any:
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]

    def tag(self, what: str, names: Any) -> Any:
        tag = self.number("<B")
        if tag >= len(names):
            raise CodecError(f"unknown tag {tag} of {what}")
        return names[tag]

    def get(self, kind: str) -> Any:
        if kind in _INTS:
            return self.number(_INTS[kind])
        if kind == "s":
            try:
                return self.take(self.number("<I")).decode()
            except UnicodeDecodeError as error:
                raise CodecError("text is not UTF-8") from error
        if kind == "b":
            return self.tag("flag", (False, True))
        if kind == "o":
            return self.tag("output type", ir.OUTPUT_TYPES)
        if kind == "t":
            return self.tag("scalar type", ir.SCALAR_TYPES)
        if kind == "v":
            name = self.tag("value", ir.VALUE_TYPES)
            code = _VALUES[ir.VALUE_TYPES.index(name)]
            if name == "bool":
                return ir.Const(name, self.tag("flag", (False, True)))
            return ir.Const(name, self.number(code) if code else bytes(self.take(self.number("<I"))))
        return self.nested(self.expression) if kind == "e" else self.many("statement")

    def nested(self, read: Any, *args: Any) -> Any:
        self.depth += 1
        if self.depth > DEEPEST:
            raise CodecError(f"nested deeper than {DEEPEST}")
        out = read(*args)
        self.depth -= 1
        return out

    def expression(self) -> Any:
        name = self.tag("expression", ir.EXPRESSION_TAGS)
        if name == "const":
            return self.get("v")
        if name == "var":
            return ir.Var(self.get("s"))
        if name == "bitcast":
            return ir.Bitcast(self.get("t"), self.get("e"))
        return ir.Binary(name, self.get("e"), self.get("e"))

    def node(self, family: str) -> Any:
        cls, shape = self.tag(family, ir.SHAPES[family])
        return cls(*[self.get(kind) for kind in shape])

    def many(self, family: str) -> tuple:
        n = self.number("<I")
        if n > len(self.data) - self.at:  # every item takes a byte at least
            raise CodecError(f"{n} items in {len(self.data) - self.at} bytes")
        return tuple(self.get("s") if family == "string" else self.nested(self.node, family) for _ in range(n))


def encode(program: ir.Program) -> bytes:
    w = _Writer()
    w.out += MAGIC + struct.pack("<HH", VERSION, program.version)
    w.many("string", program.required)
    w.many("string", program.optional)
    w.many("capability", program.capabilities)
    for f in fields(ir.Budget):
        w.put("8", getattr(program.budget, f.name))
    w.many("statement", program.body)
    return bytes(w.out)


def decode(data: bytes) -> ir.Program:
    r = _Reader(bytes(data))
    if r.take(4) != MAGIC:
        raise CodecError("wrong magic")
    if (version := r.number("<H")) != VERSION:
        raise CodecError(f"version {version} is unknown")
    program = ir.Program(r.number("<H"), r.many("string"), r.many("string"), r.many("capability"), ir.Budget(*[r.number("<Q") for _ in fields(ir.Budget)]), r.many("statement"))
    if r.at != len(r.data):
        raise CodecError(f"{len(r.data) - r.at} bytes follow the program")
    return program


def identity(program: ir.Program) -> str:
    return content_hash(encode(program))


_CLASSES = {c.__name__: c for c in (ir.Program, ir.Budget, ir.Const, ir.Var, ir.Binary, ir.Bitcast, *(cls for shapes in ir.SHAPES.values() for cls, _ in shapes))}


def _plain(node: Any) -> Any:
    if hasattr(node, "__dataclass_fields__"):
        return {"kind": type(node).__name__, **{f.name: _plain(getattr(node, f.name)) for f in fields(node)}}
    if isinstance(node, tuple):
        return [_plain(x) for x in node]
    return {"base64": base64.b64encode(node).decode()} if isinstance(node, bytes) else node


def _node(value: Any) -> Any:
    if isinstance(value, list):
        return tuple(_node(x) for x in value)
    if not isinstance(value, dict):
        return value
    if "base64" in value:
        return base64.b64decode(value["base64"])
    if value.get("kind") not in _CLASSES:
        raise CodecError(f"unknown kind {value.get('kind')!r}")
    try:
        return _CLASSES[value["kind"]](**{k: _node(v) for k, v in value.items() if k != "kind"})
    except TypeError as error:
        raise CodecError(str(error)) from error


def to_json(program: ir.Program) -> str:
    return json.dumps(_plain(program), indent=1)


def from_json(text: str) -> ir.Program:
    program = _node(json.loads(text))
    if not isinstance(program, ir.Program):
        raise CodecError("not a program")
    return program
