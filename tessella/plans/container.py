"""A checked container around an Arrow IPC stream.

The payload is a magic, a version, the length and the stream. The container has a header with features and a table of
sections that must tile the rest without gap or overlap, and a trailing magic that may be absent.
"""

from __future__ import annotations

import struct

import pyarrow as pa

PAYLOAD_MAGIC, CONTAINER_MAGIC, VERSION = b"LMA1", b"LMC2", 1
PAYLOAD_TAG = 1
KNOWN_FEATURES = 1
_HEADER, _SECTION = struct.Struct("<4sHHQQI"), struct.Struct("<HHQQII")


class ContainerError(ValueError):
    """code: a short name of what is wrong."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def write_payload(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    stream = sink.getvalue().to_pybytes()
    return PAYLOAD_MAGIC + struct.pack("<HQ", VERSION, len(stream)) + stream


def read_payload(data: bytes) -> pa.Table:
    if len(data) < 14 or data[:4] != PAYLOAD_MAGIC:
        raise ContainerError("payload-magic")
    version, n = struct.unpack_from("<HQ", data, 4)
    if version != VERSION:
        raise ContainerError("payload-version")
    if n != len(data) - 14:
        raise ContainerError("payload-length")
    try:
        return pa.ipc.open_stream(data[14:]).read_all()
    except pa.ArrowInvalid as error:
        raise ContainerError("payload-stream") from error


def wrap(payload: bytes, *, required: int = KNOWN_FEATURES, optional: int = 0) -> bytes:
    start = _HEADER.size + _SECTION.size
    return _HEADER.pack(CONTAINER_MAGIC, VERSION, _HEADER.size, required, optional, 1) + _SECTION.pack(PAYLOAD_TAG, 0, start, len(payload), 0, 0) + payload + CONTAINER_MAGIC


def unwrap(data: bytes) -> bytes:
    """The payload of a container that is right in every part."""
    if len(data) < _HEADER.size:
        raise ContainerError("header-length")
    magic, version, header, required, _, count = _HEADER.unpack_from(data)
    for bad, code in ((magic != CONTAINER_MAGIC, "magic"), (version != VERSION, "version"), (header != _HEADER.size, "header-length"), (required & ~KNOWN_FEATURES, "required-feature"), (count > (len(data) - header) // _SECTION.size, "section-count")):
        if bad:
            raise ContainerError(code)
    end, payload = header + count * _SECTION.size, None
    for k in range(count):
        tag, flags, offset, length, checksum, reserved = _SECTION.unpack_from(data, header + k * _SECTION.size)
        for bad, code in ((flags, "flags"), (checksum, "checksum"), (reserved, "reserved"), (offset != end, "gap-or-overlap"), (offset + length > len(data), "out-of-container"), (tag == PAYLOAD_TAG and payload is not None, "duplicate-payload")):
            if bad:
                raise ContainerError(code)
        end = offset + length
        if tag == PAYLOAD_TAG:
            payload = data[offset:end]
    if payload is None:
        raise ContainerError("missing-payload")
    if data[end:] not in (b"", CONTAINER_MAGIC):
        raise ContainerError("trailing-bytes")
    return payload


def save(table: pa.Table) -> bytes:
    return wrap(write_payload(table))


def load(data: bytes) -> pa.Table:
    return read_payload(unwrap(data))
