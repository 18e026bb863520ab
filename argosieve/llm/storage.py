"""Array files in the shared folder: written once under another name, then renamed; local ones are memory-mapped."""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

_MAGIC = b"ARGOARR1"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts: list) -> int:
    """Writes the parts as one file. A task that runs twice replaces its own file by an equal one."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    total = 0
    with fs.open_output_stream(tmp) as out:
        for p in parts:
            out.write(p)
            total += memoryview(p).nbytes
    fs.move(tmp, path)
    return total


def read_buffer(uri: str) -> pa.Buffer:
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as m:
            return m.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, a.size, at]
        pad = -a.nbytes % 8
        parts += [a.tobytes(), b"\0" * pad]
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 16) % 8)
    return write_bytes(uri, [_MAGIC, struct.pack("<q", len(text)), text, *parts])


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    buf = read_buffer(uri)
    view = memoryview(buf)
    if bytes(view[:8]) != _MAGIC:
        raise ValueError(f"{uri} is not an array file")
    n = struct.unpack("<q", view[8:16])[0]
    head, base = json.loads(bytes(view[16 : 16 + n])), 16 + n
    return {k: np.frombuffer(view, dtype=np.dtype(d), count=c, offset=base + at) for k, (d, c, at) in head.items()}
