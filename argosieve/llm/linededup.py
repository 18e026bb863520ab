"""Removal of lines that earlier documents hold, by an index of all distinct lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm import hashindex
from argosieve.llm.common import read_table, text_column, text_slices

#: The floor of ``dedup_lines`` where none is given; ``op6_line_dedup`` and the pipeline take every line that isn't blank.
MIN_CHARS = 20
#: Bytes of text that a task holds while it probes the index.
HELD_BYTES = 64_000_000
_NOBODY = np.iinfo(np.int64).max


def _hashes(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Hashes of all lines that are long enough, the number of lines before each, and the lines of each text."""
    lines = [[] if t is None else t.split("\n") for t in texts]
    h, at, n = [], [], 0
    digest = xxhash.xxh3_64_intdigest
    for own in lines:
        for line in own:
            key = line.strip(" ")
            if len(key) >= min_chars and not key.isspace():
                h.append(digest(key.encode("utf-8", "surrogatepass")))
                at.append(n)
            n += 1
    return np.array(h, np.uint64), np.array(at, np.int64), lines


def line_index(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> hashindex.HashIndex:
    """The index of all distinct lines: how often each occurs, and the smallest id of the documents that hold it."""
    src = docs.select(docs[id_col].cast("bigint").alias("k"), docs[text_col].alias("t")).filter(F.col("t").isNotNull())

    def run(batches):
        for batch in batches:
            h, at, lines = _hashes(text_column(batch, "t"), min_chars)
            if not h.size:
                continue
            ids = batch.column(0).fill_null(_NOBODY).to_numpy(zero_copy_only=False)
            owner = np.repeat(ids, [len(x) for x in lines])[at]
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.concatenate([new, [len(h)]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.minimum.reduceat(owner, new))], ["h", "n", "owner"])

    return hashindex.build(src.mapInArrow(run, "h bigint, n bigint, owner bigint"), {"n": ("<u4", "sum"), "owner": ("<i8", "min")}, "lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns, ``text`` without the lines that an earlier document holds, and n_lines, n_dropped.

    Lines are compared whole, without spaces at their ends, over all documents; lines of fewer than ``min_chars``
    characters always stay, and so do short ones of white space alone. Of a line that repeats, the first occurrence in the
    document of the smallest id stays (in each of its rows, if the id repeats: rows that tie by id aren't told apart); all
    others go. Ids are integers; documents without an id never keep a line that one with an id holds. A null text stays
    null, with no lines; an empty one has one empty line, which stays; a text that loses every line becomes empty. Texts of
    any length are read whole. An empty table gives no rows. Columns that are named n_lines or n_dropped already are
    replaced, others are kept whatever their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    index = line_index(docs, id_col, text_col, min_chars)
    names = docs.columns
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[id_col].cast("bigint").alias("k"))
    t, k = names.index(text_col), len(names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, f"c{t}", 16_000_000):
                held.append(part)
                size += part.nbytes
                if size > HELD_BYTES:
                    yield from judge(held)
                    held, size = [], 0
        yield from judge(held)

    def judge(parts):
        found = [_hashes(text_column(p, f"c{t}"), min_chars)[:2] for p in parts]
        sizes = [len(h) for h, _ in found]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        values = index.probe(hashes)[1] if hashes.size else {}
        begin = 0
        for part, (h, at), size in zip(parts, found, sizes):
            n, owner = (values[c][begin : begin + size] if size else np.zeros(0, np.int64) for c in ("n", "owner"))
            begin += size
            texts = text_column(part, f"c{t}")
            lines = [[] if x is None else x.split("\n") for x in texts]
            counts = np.array([len(x) for x in lines], np.int64)
            drop = np.zeros(int(counts.sum()), bool)
            ids = part.column(k).fill_null(_NOBODY).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lines)), counts)[at]
            again = n > 1
            mine = owner == ids[row]
            drop[at[again & ~mine]] = True
            own = np.flatnonzero(again & mine)
            if own.size:
                order = own[np.lexsort((at[own], h[own], row[own]))]
                same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1]) & (ids[row[order][1:]] != _NOBODY)
                drop[at[order[1:][same]]] = True
            ends = np.concatenate([[0], np.cumsum(counts)])
            gone = np.add.reduceat(np.concatenate([drop, [False]]).astype(np.int64), ends[:-1]) * (counts > 0) if len(lines) else counts
            new = [x if not g else "\n".join([y for y, d in zip(own_lines, drop[a:b]) if not d]) for x, own_lines, g, a, b in zip(texts, lines, gone, ends, ends[1:])]
            cols = [part.column(i) if i != t else pa.array(new, pa.string()) for i in range(k)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts), pa.array(gone)], [*(f"c{i}" for i in range(k)), "n_lines", "n_dropped"])

    kinds = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    out = src.mapInArrow(run, T.StructType([*kinds, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents"), min_chars=1).select("doc_id", "text", "n_lines", "n_dropped")


OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT *, regexp_full_match(line, '\\s*') OR row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) = 1 AS stays FROM l
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
