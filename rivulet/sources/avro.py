"""Avro object containers of small records, by their schema: what table manifests are made of."""

from __future__ import annotations

import json
import os
import struct

from rivulet.sources.batches import Reader, varint

_MAGIC = b"Obj\x01"


def _put(kind, x) -> bytes:
    if isinstance(kind, list):  # null or one type
        return varint(0) if x is None else varint(1) + _put(kind[1], x)
    name = kind["type"] if isinstance(kind, dict) else kind
    if isinstance(name, (dict, list)):
        return _put(name, x)
    if name in ("int", "long"):
        return varint(x)
    if name in ("string", "bytes"):
        data = x.encode() if isinstance(x, str) else x
        return varint(len(data)) + data
    if name == "boolean":
        return bytes([x])
    if name == "double":
        return struct.pack("<d", x)
    if name == "record":
        return b"".join(_put(f["type"], x.get(f["name"])) for f in kind["fields"])
    if name == "array":
        return (varint(len(x)) + b"".join(_put(kind["items"], y) for y in x) if x else b"") + varint(0)
    if name == "map":
        return (varint(len(x)) + b"".join(_put("string", k) + _put(kind["values"], v) for k, v in x.items()) if x else b"") + varint(0)
    raise ValueError(f"no encoding for {kind!r}")


def _take(kind, r: Reader):
    if isinstance(kind, list):
        return _take(kind[r.varint()], r)
    name = kind["type"] if isinstance(kind, dict) else kind
    if isinstance(name, (dict, list)):
        return _take(name, r)
    if name == "null":
        return None
    if name in ("int", "long"):
        return r.varint()
    if name in ("string", "bytes"):
        data = r.take(r.varint())
        return data.decode() if name == "string" else data
    if name == "boolean":
        return r.take(1) == b"\x01"
    if name == "double":
        return struct.unpack("<d", r.take(8))[0]
    if name == "record":
        return {f["name"]: _take(f["type"], r) for f in kind["fields"]}
    out: list = []
    while n := r.varint():
        if n < 0:  # a block that tells its size in bytes
            n = -n
            r.varint()
        out += [(_take("string", r), _take(kind["values"], r)) if name == "map" else _take(kind["items"], r) for _ in range(n)]
    return dict(out) if name == "map" else out


def write(schema: dict, rows: list[dict], about: dict[str, str]) -> bytes:
    """A container of ``rows``; ``about`` goes into its header."""
    sync = os.urandom(16)
    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"} | {k: v.encode() for k, v in about.items()}
    body = b"".join(_put(schema, x) for x in rows)
    return _MAGIC + _put({"type": "map", "values": "bytes"}, head) + sync + (varint(len(rows)) + varint(len(body)) + body + sync if rows else b"")


def read(data: bytes) -> tuple[list[dict], dict[str, bytes]]:
    """(rows, header) of an uncompressed container."""
    r = Reader(data)
    if r.take(4) != _MAGIC:
        raise ValueError("no object container")
    head = _take({"type": "map", "values": "bytes"}, r)
    if head.get("avro.codec", b"null") != b"null":
        raise ValueError(f"compressed: {head['avro.codec'].decode()}")
    sync, schema, out = r.take(16), json.loads(head["avro.schema"]), []
    while r.at < len(data):
        n, _ = r.varint(), r.varint()
        out += [_take(schema, r) for _ in range(n)]
        if r.take(16) != sync:
            raise ValueError("block ends early")
    return out, head
