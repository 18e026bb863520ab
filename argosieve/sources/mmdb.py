"""Binary network databases in the MaxMind DB format: a data source that reads them in parallel, and an export.

``spark.read.format("mmdb").load(path)`` gives (network, prefix_len, data_json), one row for each leaf of the tree that has
data. The tree is cut into subtrees, one task each. Networks under ``::/96`` of an IPv6 tree are written as IPv4.
"""

from __future__ import annotations

import ipaddress
import json
import math
import struct
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MARKER = b"\xab\xcd\xefMaxMind.com"
SEPARATOR = 16
SCHEMA = "network string, prefix_len int, data_json string"
#: Depth, below the first node with two ways on, at which the tree is cut into tasks.
CUT = 6


class MmdbError(ValueError):
    """A file that isn't a sound database."""


class Mmdb:
    """A database in memory."""

    def __init__(self, data: bytes):
        at = data.rfind(MARKER, max(0, len(data) - (128 << 10)))
        if at < 0:
            raise MmdbError("no metadata marker")
        self.data, self.base = data, at + len(MARKER)
        self.meta = self._value(self.base)[0]
        self.nodes, self.record, self.version = (self.meta[k] for k in ("node_count", "record_size", "ip_version"))
        if self.record not in (24, 28, 32):
            raise MmdbError(f"record size {self.record}")
        self.base = self.nodes * self.record // 4 + SEPARATOR
        if self.base > at:
            raise MmdbError("the tree is longer than the file")

    def child(self, node: int, bit: int) -> int:
        d, size = self.data, self.record
        at = node * size // 4
        if size == 24:
            return int.from_bytes(d[at + 3 * bit : at + 3 * bit + 3], "big")
        if size == 32:
            return int.from_bytes(d[at + 4 * bit : at + 4 * bit + 4], "big")
        middle = d[at + 3]
        return ((middle & 15) << 24 | int.from_bytes(d[at + 4 : at + 7], "big")) if bit else ((middle >> 4) << 24 | int.from_bytes(d[at : at + 3], "big"))

    def _size(self, control: int, at: int) -> tuple[int, int]:
        n = control & 31
        if n < 29:
            return n, at
        width = n - 28
        extra = int.from_bytes(self.data[at : at + width], "big")
        return extra + (29, 285, 65821)[width - 1], at + width

    def _value(self, at: int):
        """The value at a place of the file, and the place behind it."""
        d = self.data
        if at >= len(d):
            raise MmdbError("a value lies beyond the file")
        control = d[at]
        kind, at = control >> 5, at + 1
        if kind == 1:
            width = control >> 3 & 3
            raw = int.from_bytes(d[at : at + width + 1], "big")
            to = raw if width == 3 else ((control & 7) << 8 * (width + 1) | raw) + (0, 2048, 526336)[width]
            return self._value(self.base + to)[0], at + width + 1
        if kind == 0:
            kind, at = 7 + d[at], at + 1
        n, at = self._size(control, at)
        if kind == 7:
            out = {}
            for _ in range(n):
                key, at = self._value(at)
                out[key], at = self._value(at)
            return out, at
        if kind == 11:
            items = []
            for _ in range(n):
                item, at = self._value(at)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(n), at
        raw = d[at : at + n]
        at += n
        if kind == 2:
            return raw.decode("utf-8", "replace"), at
        if kind == 3:
            return struct.unpack(">d", raw)[0], at
        if kind == 15:
            return float(str(struct.unpack(">f", raw)[0])), at
        if kind == 4:
            return list(raw), at
        if kind in (5, 6, 9):
            return int.from_bytes(raw, "big"), at
        if kind == 10:
            return str(int.from_bytes(raw, "big")), at
        if kind == 8:
            return int.from_bytes(raw.rjust(4, b"\0"), "big", signed=True), at
        raise MmdbError(f"unknown type {kind}")

    def payload(self, record: int) -> str:
        return dumps(self._value(self.base - SEPARATOR + record - self.nodes)[0])

    def v4_start(self) -> int | None:
        """The node of ``::/96`` in an IPv6 tree."""
        node = 0
        for _ in range(96):
            node = self.child(node, 0)
            if node >= self.nodes:
                return None
        return node

    def walk(self, node: int, bits: int, depth: int, limit: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(record, bits, depth) of the leaves with data below a node; nodes at ``limit`` are given as they are."""
        width = 128 if self.version == 6 else 32
        stack, v4 = [(node, bits, depth)], self.v4_start() if self.version == 6 else None
        while stack:
            node, bits, depth = stack.pop()
            if node == self.nodes or (node == v4 and depth > 0 and not (depth == 96 and bits == 0)):
                continue
            if node > self.nodes or depth == limit:
                yield node, bits, depth
            elif depth >= width:
                raise MmdbError("the tree is too deep")
            else:
                stack += [(self.child(node, b), bits << 1 | b, depth + 1) for b in (1, 0)]

    def network(self, bits: int, depth: int) -> tuple[str, int]:
        if self.version == 4:
            return str(ipaddress.IPv4Address(bits << 32 - depth)), depth
        n = bits << 128 - depth
        return (str(ipaddress.IPv4Address(n)), depth - 96) if depth >= 96 and n >> 32 == 0 else (str(ipaddress.IPv6Address(n)), depth)


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _Subtree(InputPartition):
    def __init__(self, node: int, bits: int, depth: int):
        self.node, self.bits, self.depth = node, bits, depth


def _read(path: str) -> bytes:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with where.open_input_file(at) as f:
        return f.read()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Subtree]:
        db = Mmdb(_read(self.path))
        cuts, limit = [(0, 0, 0)], 0
        while len(cuts) < 1 << CUT and limit < (128 if db.version == 6 else 32):
            limit += 1
            new = list(db.walk(0, 0, 0, limit))
            if all(n >= db.nodes for n, _, _ in new):
                return [_Subtree(*c) for c in new] or [_Subtree(db.nodes, 0, 0)]
            cuts = new
        return [_Subtree(*c) for c in cuts]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        db = Mmdb(_read(self.path))
        seen: dict[int, str] = {}
        for record, bits, depth in db.walk(partition.node, partition.bits, partition.depth):
            if record not in seen:
                seen[record] = db.payload(record)
            network, length = db.network(bits, depth)
            yield f"{network}/{length}", length, seen[record]


class MmdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mmdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_mmdb(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MmdbSource)
    return spark.read.format("mmdb").load(path)


def mmdb_feed(spark: SparkSession, path: str) -> DataFrame:
    """A database as entries (seq, key, data_json)."""
    return read_mmdb(spark, path).select(F.monotonically_increasing_id().alias("seq"), F.col("network").alias("key"), "data_json")


def mmdb_metadata(path: str) -> dict:
    return Mmdb(_read(path)).meta


def _head(kind: int, n: int) -> bytes:
    extended = b"" if kind <= 7 else bytes([kind - 7])
    top = kind << 5 if kind <= 7 else 0
    if n < 29:
        return bytes([top | n]) + extended
    for width, low in ((1, 29), (2, 285), (3, 65821)):
        if n < low + (1 << 8 * width):
            return bytes([top | 28 + width]) + extended + (n - low).to_bytes(width, "big")
    raise MmdbError("a value is too long")


def encode(value) -> bytes:
    """A JSON value in the format's encoding; whole numbers take the smallest type that holds them."""
    if isinstance(value, dict):
        return _head(7, len(value)) + b"".join(encode(str(k)) + encode(value[k]) for k in sorted(value))
    if isinstance(value, list):
        return _head(11, len(value)) + b"".join(map(encode, value))
    if isinstance(value, bool):
        return _head(14, int(value))
    if isinstance(value, str):
        raw = value.encode("utf-8", "replace")
        return _head(2, len(raw)) + raw
    if value is None:
        return _head(4, 0)
    if isinstance(value, int) and -(1 << 31) <= value < 1 << 128:
        if value < 0:
            return _head(8, 4) + (value & 0xFFFFFFFF).to_bytes(4, "big")
        kind = 5 if value < 1 << 16 else 6 if value < 1 << 32 else 9 if value < 1 << 64 else 10
        raw = value.to_bytes(math.ceil(value.bit_length() / 8), "big")
        return _head(kind, len(raw)) + raw
    return _head(3, 8) + struct.pack(">d", float(value))


def build_mmdb(prefixes: list[tuple[int, int, str]], version: int, database_type: str, description: dict[str, str] | None = None) -> bytes:
    """A database of prefixes (bits of the masked address, length, JSON text); lengths count in the version's width."""
    width, nodes = (128 if version == 6 else 32), [[None, None]]
    for bits, length, text in sorted(prefixes, key=lambda p: p[1]):
        if not length:
            nodes[0] = [("d", text), ("d", text)]
            continue
        node = 0
        for k in range(length - 1):
            b = bits >> (width - 1 - k) & 1
            to = nodes[node][b]
            if not isinstance(to, int):
                nodes.append([to, to])
                to = nodes[node][b] = len(nodes) - 1
            node = to
        nodes[node][bits >> (width - length) & 1] = ("d", text)
    place, section = {}, bytearray()
    for _, _, text in prefixes:
        if text not in place:
            place[text] = len(section)
            section += encode(json.loads(text))
    n = len(nodes)
    record = next((r for r in (24, 28, 32) if n + SEPARATOR + len(section) < 1 << r), None)
    if record is None:
        raise MmdbError("too large for the format")
    number = lambda x: n if x is None else x if isinstance(x, int) else n + SEPARATOR + place[x[1]]
    tree = bytearray()
    for a, b in nodes:
        a, b = number(a), number(b)
        tree += ((a & 0xFFFFFF) << 32 | (a >> 24) << 28 | b).to_bytes(7, "big") if record == 28 else a.to_bytes(record // 8, "big") + b.to_bytes(record // 8, "big")
    meta = {
        "binary_format_major_version": 2, "binary_format_minor_version": 0, "build_epoch": int(time.time()), "database_type": database_type, "description": description or {}, "ip_version": version,
        "languages": sorted(description or {}), "node_count": n, "record_size": record,
    }
    return bytes(tree) + bytes(SEPARATOR) + bytes(section) + MARKER + encode(meta)


def export_mmdb(iset, path: str) -> int:
    """Writes a set's prefixes as one file; the format is one tree, so they are gathered on the driver. Returns their number."""
    from pyarrow import fs

    wide = bool(iset.meta["has_v6"])
    rows = iset.ips.select("hi", "lo", "plen", "data_json").toLocalIterator()
    mask = (1 << 64) - 1
    prefixes = [((r["hi"] & mask) << 64 | r["lo"] & mask, r["plen"], r["data_json"]) if wide else (r["lo"], r["plen"] - 96, r["data_json"]) for r in rows]
    raw = build_mmdb(prefixes, 6 if wide else 4, iset.meta["database_type"], iset.meta["description"])
    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with where.open_output_stream(at) as out:
        out.write(raw)
    return len(prefixes)
