"""Growing files as a stream of lines: ``spark.readStream.format("tail").load(glob)`` gives (source, text).

The path may be several patterns, one a line. An offset holds, for each file, the place behind its last whole line and the file's identity. What was there at first is
read, then what is appended; a line is read when it is whole. A file that shrank or was replaced is read from its start, one
that is gone is left out. The driver only looks at sizes; tasks read ranges of bytes. Paths must be visible to all executors.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16
SCHEMA = "source string, text string"


def last_line_end(path: str, size: int) -> int:
    """The place behind the last newline before ``size``."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - BLOCK)
            f.seek(begin)
            k = f.read(at - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            at = begin
    return 0


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, chunk: int):
        self.patterns, self.chunk = [p.removeprefix("file://").removeprefix("file:") for p in pattern.split("\n")], chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted({x for p in self.patterns for x in glob.glob(p)}):
            try:
                s = os.stat(path)
                out[path] = [last_line_end(path, s.st_size), s.st_ino]
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, (to, who) in end.items():
            at, before = start.get(path, [0, who])
            if before != who or to < at:
                at = 0
            out += [_Range(path, a, min(to, a + self.chunk)) for a in range(at, to, self.chunk)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple[str, str]]:
        """The lines that begin in the range; the last of them may end behind it."""
        if partition.end <= partition.begin:
            return
        try:
            f = open(partition.path, "rb")  # noqa: SIM115
        except FileNotFoundError:
            return
        with f:
            f.seek(max(0, partition.begin - 1))
            if partition.begin:
                f.readline()
            while f.tell() < partition.end:
                line = f.readline()
                if not line:
                    break
                text = line.strip(b" \t\r\n\f\v")
                if text:
                    yield partition.path, text.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        return


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("chunkbytes", str(32 << 20))))
