"""Near-duplicate documents by SimHash fingerprints and the May-Ozerov search for near neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm.common import materialize, mix64, read_table, shuffle_partitions, text_column, text_slices
from argosieve.llm.graph import components, merge

BITS = 256
WORDS = BITS // 64
#: Fingerprints that differ in this many bits at most are near.
RADIUS = 44
#: Coordinates of a strip; and, where no plan says otherwise, the most of them that may differ from a list's centre, and the
#: centres of a strip.
STRIP, WEIGHT, CENTRES = 64, 22, 119
#: The expected size up to which all fingerprints are one list, compared pair by pair.
LIST_SIZE = 4000
#: A list that turned out longer than this is cut further.
LONG_LIST = 32_000
#: In lists from this length on, balls of near fingerprints that hold this share of the list are taken out first.
DENSE_LIST, DENSE = 4096, 0.02
#: Share of the pairs at the radius itself that the repetitions are to find; nearer pairs are found more surely.
RECALL = 0.95
#: The same for the cut of a list that turned out long.
CUT_RECALL = 0.99
#: Parts of the repetitions after which the search looks whether the last part found anything new.
ROUNDS = (0.5, 0.75, 1.0)
#: Microseconds for a centre that is compared, for a row that is moved, and for a pair that is compared. What a row takes of
#: disks and network is what runs out first in a large corpus, so it counts for several times the time that it takes here.
_COSTS = (0.006, 40.0, 0.008)


#: Words whose hashes a task keeps.
MAX_WORDS = 200_000
#: What tells the words of a fingerprint's bits apart in ``mix64``.
_SEEDS = np.array([(11 + j) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for j in range(WORDS)], np.uint64)


class _WordHashes(dict):
    """The numbers of words in lower case without marks around them, 0 for bare marks; and each number's 256 random bits.

    Let go when it has grown large.
    """

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.bare, self.new, self.bits = {"": 0}, [], np.zeros((1, BITS // 8), np.uint8)

    def __missing__(self, word: str) -> int:
        bare = word.lower()
        if not bare.isalnum():
            bare = bare.strip(".,;:!?\"'()")
            if not bare.isalnum():
                bare = "".join(filter(str.isalnum, bare))
        k = self.bare.get(bare)
        if k is None:
            k = self.bare[bare] = len(self.bare)
            self.new.append(xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")))
        self[word] = k
        return k

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        if self.new:
            h = np.array(self.new, np.uint64)
            with np.errstate(over="ignore"):
                made = mix64(h[:, None] + _SEEDS)
            known, need = len(self.bare) - len(h), len(self.bare)
            if need > len(self.bits):
                grown = np.zeros((max(4096, 2 * need), BITS // 8), np.uint8)
                grown[:known] = self.bits[:known]
                self.bits = grown
            self.bits[known:need] = made.view(np.uint8).reshape(len(h), -1)
            self.new = []
        return self.bits[numbers]


def simhash(text: str, hashes: _WordHashes) -> np.ndarray | None:
    """The 256-bit SimHash over the text's distinct words; None if it has none."""
    words = set(text.split())
    k = np.unique(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
    k = k[k > 0]
    if not k.size:
        return None
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(k), 255):
        ones += np.add.reduce(np.unpackbits(hashes.rows(k[a : a + 255]), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(k), bitorder="little").view(np.uint64)


def restored_fingerprints(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp) of texts that lost lines, as they were before: those of ``table`` under the same id that differ from
    the text and hold all lines that it has left.

    Copies that differ in a few words lose most of their lines to the first of them when repeated lines go, and what is left
    isn't near it any more. Only ids and hashes of lines are joined; then only the texts that are asked for are moved.
    Blank lines don't count; null ids and texts give nothing; repeated rows count once.
    """
    marks = lambda df: df.filter(df[id_col].isNotNull() & df[text_col].isNotNull()).select(
        df[id_col].cast("bigint").alias("id"), F.array_distinct(F.transform(F.filter(F.split(df[text_col], "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))).alias("lines"), F.xxhash64(df[text_col]).alias("whole")
    )
    now, then = marks(docs), marks(table).withColumnsRenamed({"lines": "before", "whole": "once"})
    lost = now.join(then, "id").filter((F.col("whole") != F.col("once")) & (F.size("lines") > 0) & (F.size(F.array_except("lines", "before")) == 0))
    asked = materialize(lost.select("id", "once").distinct(), "simhash-asked")
    texts = table.select(table[id_col].cast("bigint").alias("i"), table[text_col].alias("t"), F.xxhash64(table[text_col]).alias("w"))
    texts = texts.join(asked, (texts["i"] == asked["id"]) & (texts["w"] == asked["once"]), "left_semi")
    return fingerprints(texts, "i", "t")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, fp) of the texts that have words."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).filter(F.col("t").isNotNull())

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for part in text_slices(batch, "t", 4_000_000):
                if len(hashes) > MAX_WORDS:
                    hashes.clear()
                fps = [simhash(t, hashes) for t in text_column(part, "t")]
                has = pa.array([f is not None for f in fps], pa.bool_())
                ids = part.column(0).filter(has)
                yield pa.RecordBatch.from_arrays([ids, pa.array([f.tobytes() for f in fps if f is not None], pa.binary())], ["id", "fp"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.BinaryType())]))


@cache
def _on_list(weight: int = WEIGHT) -> float:
    """The chance that a random fingerprint is on a list."""
    return sum(math.comb(STRIP, w) for w in range(weight + 1)) / 2.0**STRIP


@cache
def _share_a_list(differ: int, weight: int = WEIGHT, centres: int = CENTRES) -> float:
    """The chance that two fingerprints that differ in so many coordinates of a strip are together on one of its lists."""
    both = 0
    for w in range(weight + 1):
        for flipped in range(min(w, differ) + 1):
            if w - flipped + differ - flipped <= weight:
                both += math.comb(differ, flipped) * math.comb(STRIP - differ, w - flipped)
    return 1 - (1 - both / 2.0**STRIP) ** centres


@cache
def meeting(levels: int, bits: int = BITS, distance: int = RADIUS, weight: int = WEIGHT, centres: int = CENTRES) -> float:
    """The chance that two fingerprints at a distance share a list after the levels of one repetition.

    Strips hold different coordinates, so each takes its part of the differing bits from what the earlier ones left.
    """
    if not levels:
        return 1.0
    fits = range(max(0, STRIP - bits + distance), min(STRIP, distance) + 1)
    ways = (math.comb(distance, d) * math.comb(bits - distance, STRIP - d) * _share_a_list(d, weight, centres) * meeting(levels - 1, bits - STRIP, distance - d, weight, centres) for d in fits)
    return sum(ways) / math.comb(bits, STRIP)


def _times(chance: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-chance)))


class Plan(NamedTuple):
    """Levels of strips, repetitions, and each strip's weight and centres."""

    levels: int
    reps: int
    weight: int = WEIGHT
    centres: int = CENTRES

    def rows(self) -> float:
        """Rows that a fingerprint becomes."""
        return self.reps * (self.centres * _on_list(self.weight)) ** self.levels

    def cost(self, n: int) -> float:
        """Microseconds for a fingerprint among n."""
        centre, row, pair = _COSTS
        return self.reps * self.levels * self.centres * centre + self.rows() * (row + pair * n * _on_list(self.weight) ** self.levels)


@cache
def _plans() -> tuple[Plan, ...]:
    """A fingerprint is on about one list of a repetition; pairs at the radius are found with RECALL, even if their lists are cut once."""
    out = []
    for levels in range(1, BITS // STRIP + 1):
        for weight in range(16, 26):
            centres = round(1 / _on_list(weight))
            chance = meeting(levels, BITS, RADIUS, weight, centres) * CUT_RECALL
            out.append(Plan(levels, _times(chance, RECALL), weight, centres))
    return tuple(out)


def plan(n: int) -> Plan:
    """The cheapest plan for n fingerprints: what a repetition costs is weighed against how many it takes."""
    return Plan(0, 1) if n <= LIST_SIZE else min(_plans(), key=lambda p: p.cost(n))


def _strips(rep: int) -> np.ndarray:
    return np.random.default_rng([91, rep]).permutation(BITS).reshape(-1, STRIP)


def _on_strip(bits: np.ndarray, strip: np.ndarray) -> np.ndarray:
    return np.packbits(np.ascontiguousarray(bits[:, strip]), axis=1, bitorder="little").view(np.uint64).ravel()


def _centres(rep: int, level: int, path: int, centres: int) -> np.ndarray:
    return np.random.default_rng([17, rep, level, path & 0xFFFFFFFF]).integers(0, 1 << STRIP, centres, dtype=np.uint64)


def list_keys(fps: np.ndarray, rep: int, levels: int, weight: int = WEIGHT, centres: int = CENTRES) -> tuple[np.ndarray, np.ndarray]:
    """(row, key of a list) for every list that a fingerprint is on after the levels of a repetition.

    On each level a strip of coordinates is compared with that level's random centres; a fingerprint goes on to the lists
    of the centres from which it differs in ``weight`` coordinates at most.
    """
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    strips = _strips(rep)
    rows, keys = np.arange(len(fps)), np.full(len(fps), rep + 1, np.uint64)
    for level in range(levels):
        part, some = _on_strip(bits, strips[level])[rows], _centres(rep, level, 0, centres)
        at, centre = [], []
        step = max(1, 500_000 // centres)
        for a in range(0, len(part), step):
            i, c = np.divmod(np.flatnonzero((np.bitwise_count(part[a : a + step, None] ^ some[None, :]) <= weight).ravel()), centres)
            at.append(i + a)
            centre.append(c)
        i = np.concatenate(at) if at else np.zeros(0, np.int64)
        c = np.concatenate(centre) if centre else np.zeros(0, np.int64)
        rows, keys = rows[i], mix64(keys[i] * np.uint64(centres) + c.astype(np.uint64), level)
    return rows, keys


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WORDS):
        d += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return d


def _pair_blocks(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the list within the radius, by brute force, block by block; half of the bits rules most pairs out."""
    words, step, half = np.ascontiguousarray(fps.T), max(1, 500_000 // max(1, len(fps))), WORDS // 2
    for a in range(0, len(fps), step):
        d = np.bitwise_count(words[0, a : a + step, None] ^ words[0, None, a:])
        for w in range(1, half):
            d += np.bitwise_count(words[w, a : a + step, None] ^ words[w, None, a:])
        i, j = np.divmod(np.flatnonzero((d <= RADIUS).ravel()), len(fps) - a)
        i, j = i[j > i] + a, j[j > i] + a
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= RADIUS
        yield i[near], j[near]


def _joined(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found = list(blocks)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _joined(_pair_blocks(fps))


def _search(fps: np.ndarray, rep: int, level: int, path: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of a list: recursion over the strips that are left while it is long, brute force once it is small.

    A long list is cut by fresh centres as often as it takes to find pairs at the radius with CUT_RECALL.
    """
    if len(fps) <= LONG_LIST or level >= BITS // STRIP:
        yield from _pair_blocks(fps)
        return
    times = _times(meeting(1), CUT_RECALL)
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    part = _on_strip(bits, _strips(rep)[level])
    for k in range(times):
        for c, centre in enumerate(_centres(rep, level, path * 64 + k + 1, CENTRES)):
            on = np.flatnonzero(np.bitwise_count(part ^ centre) <= WEIGHT)
            if on.size == len(fps):
                yield from _pair_blocks(fps)
                return
            if on.size > 1:
                for i, j in _search(fps[on], rep, level + 1, path * 64 * CENTRES + k * CENTRES + c + 1):
                    yield on[i], on[j]


def search(fps: np.ndarray, rep: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    return _joined(_search(fps, rep, level))


def _take_balls(fps: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Joins fingerprints in large balls of near ones; returns the places that are left.

    What is within the radius of a ball's centre is joined with it. Only fingerprints within twice the radius can be near
    one of the ball, so these are compared with all of it, until they are joined, and the ball needs no further look. A
    list of near templates thus takes time in proportion to its length.
    """
    left = np.arange(len(fps))
    rng = np.random.default_rng(len(fps))
    while len(left) >= DENSE_LIST:
        tried = _distances(fps[rng.choice(left, 32, replace=False)], fps[left])
        sizes = (tried <= RADIUS).sum(1)
        best = int(sizes.argmax())
        if sizes[best] < DENSE * len(left):
            break
        d = tried[best]
        ball, shell = left[d <= RADIUS], left[(d > RADIUS) & (d <= 2 * RADIUS)]
        merge(root, ball[1:], np.full(len(ball) - 1, ball[0]))
        shell = shell[root[shell] != root[ball[0]]]
        for a in range(0, len(ball), 4096):
            some, step = ball[a : a + 4096], 512
            near = [(_distances(fps[shell[b : b + step]], fps[some]) <= RADIUS).any(1) for b in range(0, len(shell), step)]
            hit = np.concatenate(near) if near else np.zeros(0, bool)
            merge(root, shell[hit], np.full(int(hit.sum()), ball[0]))
            shell = shell[~hit]
            shell = shell[root[shell] != root[ball[0]]]
        left = left[d > RADIUS]
    return left


def groups_of(fps: np.ndarray, rep: int, level: int) -> np.ndarray:
    """For each fingerprint of a list, the first one that it is connected with by near pairs; pairs are never held."""
    root = np.arange(len(fps))
    left = _take_balls(fps, root)
    for i, j in _search(fps[left], rep, level):
        if i.size:
            merge(root, left[i], left[j])
    return root


def near_edges(fps: DataFrame, levels: int, reps: int, weight: int = WEIGHT, centres: int = CENTRES, first: int = 0) -> DataFrame:
    """Edges (a, b) between the ids of near fingerprints (id, fp), by the repetitions from ``first`` up to ``reps``.

    A list gives a tree for each of its groups, not all pairs.
    """
    parts = shuffle_partitions(fps.sparkSession)

    def scatter(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            words = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(-1, WORDS)
            for rep in range(first, reps):
                rows, keys = list_keys(words, rep, levels, weight, centres)
                if rows.size:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), rep, np.int32)), pa.array(ids[rows]), raw.take(pa.array(rows))], ["key", "rep", "id", "fp"])

    def close(ids, words, rep):
        root = groups_of(words, rep, levels)
        far = np.flatnonzero(root != np.arange(len(ids)))
        return ids[far], ids[root[far]]

    def gather(batches):
        rest, last = [], None  # whole batches are held while they are of one list, and joined once
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = t.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            if rest and key[0] != last:
                yield from lists(pa.concat_tables(rest))
                rest = []
            if ends.size:
                yield from lists(pa.concat_tables([*rest, t.slice(0, int(ends[-1]))]))
                rest, t = [], t.slice(int(ends[-1]))
            rest.append(t)
            last = key[-1]
        if rest:
            yield from lists(pa.concat_tables(rest))

    def lists(t):
        key, rep, ids = (t.column(c).to_numpy() for c in ("key", "rep", "id"))
        words = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        out_a, out_b = [], []
        for a, b in pairwise(cuts.tolist()):
            if b - a > 1:
                x, y = close(ids[a:b], words[a:b], int(rep[a]))
                out_a.append(x)
                out_b.append(y)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    spread = fps.mapInArrow(scatter, "key bigint, rep int, id bigint, fp binary").repartition(parts, "key").sortWithinPartitions("key")
    return spread.mapInArrow(gather, "a bigint, b bigint")


def near_groups(fp: DataFrame) -> DataFrame:
    """Rows (node, root) for the ids of fingerprints (id, fp) that are near others; an id may have several fingerprints.

    Equal fingerprints meet before the search, so it works on distinct ones. Repetitions come in ROUNDS; when one of them
    joins nothing that the earlier ones left apart, the rest are left out.
    """
    distinct = materialize(fp.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    chosen = plan(distinct.count())
    equal = fp.join(distinct.withColumnRenamed("id", "b"), "fp").select(F.col("id").alias("a"), "b").filter("a <> b")
    src, done, roots, more = distinct.select("id", "fp"), 0, None, None
    for upto in sorted({math.ceil(chosen.reps * share) for share in ROUNDS}):
        edges = near_edges(src, chosen.levels, upto, chosen.weight, chosen.centres, done)
        done = upto
        if roots is None:
            roots = materialize(components(edges.unionByName(equal)), "simhash-roots")
            continue
        for end in ("a", "b"):
            r = roots.select(F.col("node").alias(end), F.col("root").alias("r"))
            edges = edges.join(r, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new = materialize(edges if more is None else edges.join(more, ["a", "b"], "left_anti"), "simhash-new")
        if new.isEmpty():
            break
        more = new if more is None else more.unionByName(new)
    if more is None:
        return roots
    joined = components(more).select(F.col("node").alias("n"), F.col("root").alias("r"))
    whole = roots.join(joined, roots["root"] == joined["n"], "left").select("node", F.coalesce("r", "root").alias("root"))
    return whole.unionByName(joined.join(roots, joined["n"] == roots["node"], "left_anti").select(F.col("n").alias("node"), F.col("r").alias("root")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, keeper_id, is_duplicate) for every document.

    Documents are near if their fingerprints differ in RADIUS of 256 bits at most; groups are the connected components of
    nearness, and the document of the smallest id stays, so there are no ties. Ids are integers. Documents without words
    (null, empty, marks only) and those without an id are alone; texts of any length are read whole. Rows with the same id,
    repeated ones too, are one document and get the same result, with the smallest keeper of their texts. An empty table
    gives no rows. Other columns are left out, whatever their names.

    ``before`` is a table of the same documents before lines were taken from them: a document that lost lines has two
    fingerprints, that of its text and that of its text there, and is near to what either is near to.
    """
    ids = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias(text_col))
    fp = fingerprints(ids, id_col, text_col)
    if before is not None:
        fp = fp.unionByName(restored_fingerprints(docs, before, id_col, text_col))
    return keepers(docs, near_groups(materialize(fp.filter(F.col("id").isNotNull()), "simhash")), id_col)


def keepers(docs: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, keeper_id, is_duplicate) for every document, from the (node, root) of those that are in groups."""
    ids = docs.select(docs[id_col].alias("id"))
    out = ids.join(roots, ids["id"] == roots["node"], "left").select(ids["id"], F.coalesce("root", ids["id"]).alias("keeper"))
    return out.select(F.col("id").alias(id_col), F.col("keeper").alias("keeper_id"), F.coalesce(F.col("id") != F.col("keeper"), F.lit(False)).alias("is_duplicate"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))
