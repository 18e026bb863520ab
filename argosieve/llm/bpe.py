"""Byte-pair encoding and decoding of whole tables, by dynamic programming over prefixes (see ``vocab``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from argosieve.llm.common import read_table, text_column, text_slices
from argosieve.llm.vocab import load_vocab, worker_encoder

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"


def encode(docs: DataFrame, vocab_path: str = VOCAB, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """Rows (id, n_tokens, ids, exact), and the column ``place_col``, a bigint, if it is given; ``exact`` tells that the ids decode to the text's very bytes.

    The vocabulary is read on the driver and broadcast; its size doesn't depend on the data. A null text gives nulls, an
    empty one no ids. Texts of any length are encoded whole; exactly one encoding fits the merges, so there are no ties.
    Rows that repeat are encoded each, an empty table gives no rows. Other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(load_vocab(vocab_path))
    place = [] if place_col is None else [docs[place_col].alias("p")]
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"), *place)

    def run(batches):
        enc = worker_encoder(vocab_path, tables.value)
        for batch in batches:
            for part in text_slices(batch, "t"):
                texts = text_column(part, "t")
                coded = enc.encode_texts(["" if t is None else t for t in texts])
                ids = np.frombuffer(b"".join(coded), enc.dtype)
                n = np.fromiter(map(len, coded), np.int64, len(coded)) // enc.dtype.itemsize
                ends = np.concatenate([[0], np.cumsum(n)])
                exact = [None if t is None else enc.decode_bytes(ids[a:b]) == t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, ends, ends[1:])]
                gone = np.array([t is None for t in texts], bool)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                if gone.any():
                    lists = pc.if_else(pa.array(gone), pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32), mask=gone), lists, pa.array(exact, pa.bool_()), *part.columns[2:]], ["k", "n_tokens", "ids", "exact", *part.schema.names[2:]])

    kind = src.schema["k"].dataType
    out = src.mapInArrow(run, T.StructType([T.StructField("k", kind), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType()), *(T.StructField("p", T.LongType()) for _ in place)]))
    return out.withColumnsRenamed({"k": id_col} | ({"p": place_col} if place else {}))


def with_counts(docs: DataFrame, name: str, vocab_path: str = VOCAB, text_col: str = "text") -> DataFrame:
    """All rows and columns, and how many ids each text has, in column ``name`` (a bigint, null for a null text)."""
    tables = docs.sparkSession.sparkContext.broadcast(load_vocab(vocab_path))
    names = docs.columns
    t = f"c{names.index(text_col)}"
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches):
        enc = worker_encoder(vocab_path, tables.value)
        for batch in batches:
            for part in text_slices(batch, t):
                texts = text_column(part, t)
                coded = enc.encode_texts([x or "" for x in texts])
                n = pa.array([len(c) // enc.dtype.itemsize for c in coded], pa.int64(), mask=np.array([x is None for x in texts], bool))
                yield pa.RecordBatch.from_arrays([*part.columns, n], [*part.schema.names, "n"])

    out = src.mapInArrow(run, T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), T.StructField("n", T.LongType())]))
    return out.select(*[out[f"c{i}"].alias(c) for i, c in enumerate(names)], out["n"].alias(name))


def decode(coded: DataFrame, vocab_path: str = VOCAB, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) from rows with ids. Null ids give a null text; bytes that aren't UTF-8 are replaced by U+FFFD."""
    tables = coded.sparkSession.sparkContext.broadcast(load_vocab(vocab_path))
    src = coded.select(coded[id_col].alias("k"), coded[ids_col].alias("i"))

    def run(batches):
        enc = worker_encoder(vocab_path, tables.value)
        for batch in batches:
            lists = batch.column(1)
            texts = [None if x is None else enc.decode_bytes(np.array(x, np.int64)).decode("utf-8", "replace") for x in (lists[k].as_py() for k in range(len(lists)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return src.mapInArrow(run, T.StructType([T.StructField("k", src.schema["k"].dataType), T.StructField("text", T.StringType())])).withColumnRenamed("k", id_col)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))
