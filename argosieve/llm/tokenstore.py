"""Token ids as raw binary shards, and an index that finds a document's ids in constant time."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.llm import hashindex
from argosieve.llm.common import materialize, mix64, read_table, shared_dir, text_column, text_slices
from argosieve.llm.storage import filesystem
from argosieve.llm.vocab import PRE_TOKEN

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_TOKENIZERS: dict[str, object] = {}


def id_type(ranks: dict[bytes, int]) -> np.dtype:
    """Two bytes an id where the vocabulary allows, else four."""
    return np.dtype("<u2") if max(ranks.values(), default=0) < 1 << 16 else np.dtype("<u4")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tokenizer(path: str, ranks: dict[bytes, int]):
    if path not in _TOKENIZERS:
        import tiktoken

        _TOKENIZERS[path] = tiktoken.Encoding("payload", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path]


def key_hash(keys: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit document keys: distinct keys never share a hash."""
    return mix64(keys.astype(np.int64).view(np.uint64), 3)


def write_payloads(docs: DataFrame, folder: str, ranks_path: str, id_col: str, text_col: str) -> DataFrame:
    """Every task writes one file ``tokens-K.bin`` of ids in a row; returns (key, h, shard, byte_offset, n_tokens)."""
    spark = docs.sparkSession
    vocabulary = load_ranks(ranks_path)
    kind, ranks = id_type(vocabulary), spark.sparkContext.broadcast(vocabulary)
    src = docs.select(docs[id_col].cast("bigint").alias("key"), docs[text_col].alias("t"))

    def run(batches):
        tok, which, at, out, path, fs, tmp = _tokenizer(ranks_path, ranks.value), TaskContext.get().partitionId(), 0, None, None, None, None
        for batch in batches:
            for part in text_slices(batch, "t", 8_000_000):
                ids = [tok.encode_to_numpy(t or "", allowed_special=set(), disallowed_special=()) for t in text_column(part, "t")]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                raw = np.concatenate(ids).astype(kind).tobytes() if len(ids) else b""
                if out is None:
                    fs, path = filesystem(f"{folder}/tokens-{which:06d}.bin")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    tmp = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
                    out = fs.open_output_stream(tmp)
                out.write(raw)
                offsets = at + (np.cumsum(n) - n) * kind.itemsize
                at += len(raw)
                keys = part.column(0)
                gone = keys.is_null().to_numpy(zero_copy_only=False)
                h = key_hash(keys.fill_null(0).to_numpy(zero_copy_only=False)).view(np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(h, mask=gone), pa.array(np.full(len(n), which, np.int32)), pa.array(offsets), pa.array(n.astype(np.int32))], ["key", "h", "shard", "byte_offset", "n_tokens"])
        if out is not None:
            out.close()
            fs.move(tmp, path)

    return src.mapInArrow(run, "key bigint, h bigint, shard int, byte_offset bigint, n_tokens int")


def build_store(docs: DataFrame, folder: str, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, TokenStore]:
    """Writes payloads and index under ``folder``; returns a row for each payload and the store that reads by key.

    Of a key that repeats, the index keeps the copy in the lowest shard and place. A null key has a payload and no index
    entry, so repeated rows have a payload each and one entry. Null and empty texts have payloads of no ids, texts of any
    length are taken whole, an empty table gives no payloads and an index that finds nothing. Other columns, whatever their
    names, are left out. Keys are integers, and nothing is ordered, so there are no ties. A lookup opens one shard of the
    index and one payload, however many documents there are. Ids have two bytes if the vocabulary allows, else four.
    """
    rows = materialize(write_payloads(docs, f"{folder}/payload", ranks_path, id_col, text_col), "tokenstore-rows")
    first = F.min(F.struct("shard", "byte_offset", "n_tokens"))
    index = hashindex.build(
        rows.groupBy("h").agg(first.alias("p")).select("h", F.col("p.shard").cast("bigint").alias("shard"), F.col("p.byte_offset").alias("offset"), F.col("p.n_tokens").cast("bigint").alias("n_tokens")),
        {"shard": ("<i4", "min"), "offset": ("<i8", "min"), "n_tokens": ("<i4", "min")},
        "tokenstore-index",
    )
    return rows, TokenStore(folder, index, id_type(load_ranks(ranks_path)))


class TokenStore:
    def __init__(self, folder: str, index: hashindex.HashIndex, kind: np.dtype):
        self.folder, self.index, self.kind = folder, index, kind

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return self.index.probe(key_hash(keys))

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, None for an unknown key: one slot, one comparison of fingerprints, one read."""
        found, at = self.locate(np.array([key], np.int64))
        if not found[0]:
            return None
        fs, path = filesystem(f"{self.folder}/payload/tokens-{int(at['shard'][0]):06d}.bin")
        with fs.open_input_file(path) as f:
            f.seek(int(at["offset"][0]))
            return np.frombuffer(f.read(int(at["n_tokens"][0]) * self.kind.itemsize), self.kind)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place as the index gives it: (doc_id, shard, byte_offset, n_tokens, found)."""
    rows, store = build_store(read_table(spark, sf_dir, "documents"), shared_dir(spark, "tokenstore"))
    at = store.index.probe_rows(rows.select("key", "h"))
    return at.select(F.col("key").alias("doc_id"), F.col("shard").cast("int").alias("shard"), F.col("offset").alias("byte_offset"), F.col("n_tokens").cast("int").alias("n_tokens"), "found")
