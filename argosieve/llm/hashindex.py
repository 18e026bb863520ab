"""An index of 64-bit hashes in the shared folder: shards of minimal perfect hashes with fingerprint and value arrays.

A shard holds a range of hashes, so a reader needs one shard at a time, whatever the whole index weighs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm.common import discard, mix64, shared_dir, stored
from argosieve.llm.mph import MinimalPerfectHash
from argosieve.llm.storage import read_arrays, write_arrays

#: Rows that a shard is built from on average; a task holds one shard.
SHARD_ROWS = 250_000
_COMBINE = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) >> np.uint64(40)) * np.uint64(n_shards) >> np.uint64(24)).astype(np.int64)


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes, 77) >> np.uint64(32)).astype(np.uint32)


def build(rows: DataFrame, values: dict[str, tuple[str, str]], tag: str) -> HashIndex:
    """Indexes column ``h`` (bigint, the hash's bits) with one value for each name in ``values``.

    ``values`` gives the numpy type and how rows of one hash combine (sum, min or max); sums beyond a type's range stay at
    its largest number. Rows without a hash are left out. The rows are written first, so that they are computed once, and
    counted: there are as many shards as SHARD_ROWS asks for, and a task of its own builds each.
    """
    spark = rows.sparkSession
    names = list(values)
    path = shared_dir(spark, tag + "-rows")
    rows = stored(rows.filter(F.col("h").isNotNull()).select("h", *names), path)
    n, folder = max(1, -(-rows.count() // SHARD_ROWS)), shared_dir(spark, tag)
    shard = F.shiftright(F.shiftrightunsigned("h", 40) * F.lit(n), 24).cast("int")
    src = rows.select("h", *names, shard.alias("s")).repartitionById(n, "s")

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        h, s = t.column("h").to_numpy().view(np.uint64), t.column("s").to_numpy()
        order = np.lexsort((h, s))
        h, s = h[order], s[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        keys, at = h[new], s[new]
        cols = {k: np.minimum(_COMBINE[how].reduceat(t.column(k).to_numpy()[order], new), np.iinfo(kind).max) for k, (kind, how) in values.items()}
        for which in np.unique(at):
            own = np.flatnonzero(at == which)
            mph = MinimalPerfectHash.build(keys[own])
            slot = mph.lookup(keys[own])
            arrays = mph.arrays()
            prints = np.zeros(len(own), np.uint32)
            prints[slot] = fingerprint_of(keys[own])
            arrays["fingerprint"] = prints
            for k, (kind, _) in values.items():
                a = np.zeros(len(own), kind)
                a[slot] = cols[k][own]
                arrays[k] = a
            write_arrays(f"{folder}/shard-{int(which):06d}.arr", arrays)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(which)], pa.int32()), "n": pa.array([len(own)], pa.int64())})

    made = {r["shard"]: r["n"] for r in src.mapInArrow(run, "shard int, n bigint").collect()}
    discard(spark, path)
    return HashIndex(folder, n, made, names)


class HashIndex:
    """Reads an index: as many numbers as there are shards, and files that are opened when they are asked."""

    def __init__(self, folder: str, n_shards: int, sizes: dict[int, int], names: list[str]):
        self.folder, self.n_shards, self.sizes, self.names = folder, n_shards, sizes, names

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each hash is there, and its values (0 where it isn't)."""
        hashes = hashes.astype(np.uint64)
        s = shard_of(hashes, self.n_shards)
        order = np.argsort(s, kind="stable")
        cuts = np.searchsorted(s[order], np.arange(self.n_shards + 1))
        found = np.zeros(len(hashes), bool)
        out: dict[str, np.ndarray] = {}
        for which in range(self.n_shards):
            a, b = int(cuts[which]), int(cuts[which + 1])
            if a == b or not self.sizes.get(which):
                continue
            arrays = read_arrays(f"{self.folder}/shard-{which:06d}.arr")
            asked = order[a:b]
            slot = MinimalPerfectHash.from_arrays(arrays).lookup(hashes[asked])
            ok = slot >= 0
            ok[ok] = arrays["fingerprint"][slot[ok]] == fingerprint_of(hashes[asked[ok]])
            found[asked] = ok
            for k in self.names:
                if k not in out:
                    out[k] = np.zeros(len(hashes), arrays[k].dtype)
                out[k][asked[ok]] = arrays[k][slot[ok]]
        for k in self.names:
            out.setdefault(k, np.zeros(len(hashes), np.int64))
        return found, out

    def probe_rows(self, rows: DataFrame) -> DataFrame:
        """The rows, which have a column ``h``, and found and the values as bigints (null where it isn't there).

        Rows go to the task that opens their shard, so that no task reads more than one, whatever the index weighs. Rows
        without a hash are spread over all tasks and not found.
        """
        n, names, kinds = self.n_shards, self.names, rows.schema
        shard = F.shiftright(F.shiftrightunsigned("h", 40) * F.lit(n), 24).cast("int")
        src = rows.repartitionById(n, F.coalesce(shard, F.pmod(F.spark_partition_id(), F.lit(n))))

        def run(batches):
            for b in batches:
                h = b.column(b.schema.get_field_index("h"))
                gone = h.is_null().to_numpy(zero_copy_only=False)
                found, got = self.probe(h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
                found = found & ~gone
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), *(pa.array(got[k].astype(np.int64), mask=~found) for k in names)], [*b.schema.names, "found", *names])

        extra = [T.StructField("found", T.BooleanType()), *(T.StructField(k, T.LongType()) for k in names)]
        return src.mapInArrow(run, T.StructType([*kinds.fields, *extra]))
