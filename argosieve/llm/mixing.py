"""Mixing sources to target weights that change over the training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosieve.llm.common import read_table, shuffle_partitions

SEED = "mix-1"
#: (time, exponent): at this share of the run, a source's weight is its tokens to this power.
SCHEDULE = ((0.0, 1.0), (0.5, 0.75), (1.0, 0.5))


def tokens(text_col: str = "text") -> F.Column:
    """Tokens of a text as they are budgeted: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text_col) + 3) / 4)).cast("bigint")


def segments(totals: DataFrame, schedule: tuple = SCHEDULE, weights: dict[str, list[float]] | None = None) -> DataFrame:
    """Rows (src, t0, t1, w0, w1, a0, a1) of each source's schedule, where a0 and a1 are its integral up to t0 and t1.

    Weights are shares at every knot of the schedule and linear between knots, so that they add up to one at any time.
    ``weights`` gives the sources' weights at the knots; without it they are powers of the sources' tokens.
    """
    spark = totals.sparkSession
    knots = spark.createDataFrame([(i, float(t), float(e)) for i, (t, e) in enumerate(schedule)], "i int, t double, e double")
    if weights is None:
        raw = totals.crossJoin(knots).withColumn("w", F.pow(F.col("tokens").cast("double"), F.col("e")))
    else:
        given = spark.createDataFrame([(s, i, float(w)) for s, ws in weights.items() for i, w in enumerate(ws)], "src string, i int, w double")
        raw = totals.join(given, "src").join(knots, "i")
    sums = raw.groupBy("i").agg(F.sum("w").alias("all_w"))
    share = raw.join(sums, "i").withColumn("w", F.col("w") / F.col("all_w"))
    w = Window.partitionBy("src").orderBy("i")
    parts = share.select("src", "i", F.lag("t").over(w).alias("t0"), F.col("t").alias("t1"), F.lag("w").over(w).alias("w0"), F.col("w").alias("w1")).filter("t0 IS NOT NULL")
    area = (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))
    return parts.withColumn("a1", F.sum(area).over(w)).withColumn("a0", F.coalesce(F.lag("a1").over(w), F.lit(0.0)))


def mix(docs: DataFrame, schedule: tuple = SCHEDULE, weights: dict[str, list[float]] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, whole: bool = False) -> DataFrame:
    """The documents that the mix takes, in training order: all columns, and n_tokens, position (0 to 1).

    A source's documents come in a seeded random order. The middle of a document's tokens, summed over its source, is set
    equal to the run's tokens times the integral of the source's weight, and solved for the time: its position. The run has
    as many tokens as it can without a source running out; documents beyond that aren't taken. With ``whole``, each source's
    integral is scaled to its own tokens instead: every document is taken once, whatever the sizes of other sources, a
    source's tokens follow the course of its weight, and its share is the weight only as far as its tokens allow. The output
    is sorted and partitioned by ranges of the position, which are even, as equal times hold equal tokens.

    Order and sums don't need a source in one task: documents are summed inside 4096 buckets of the order, then buckets.
    ``size_col`` may hold the rows' tokens; else they are taken from the text, by its length. Rows with a null text (or
    size), or with a source of weight zero, aren't taken. A null source is one source, named ''. An empty text counts as one
    token, a very long one by its whole length. Rows with equal ids come one after the other, shorter first, and a hash of
    all their columns settles further ties; rows that repeat are taken each. An empty table gives no rows. Columns named
    n_tokens or position are replaced, others are kept whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "position")
    names = docs.columns
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    src = docs.filter(docs[size_col or text_col].isNotNull()).select(F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].alias("id"), F.coalesce(docs[source_col], F.lit("")).alias("src"), (docs[size_col].cast("bigint") if size_col else tokens(text_col)).alias("n"), key.alias("o"), F.xxhash64(*[docs[c] for c in names]).alias("tie"))
    src = src.withColumn("b", F.substring("o", 1, 3))
    parts = src.groupBy("src", "b").agg(F.sum("n").alias("part"))
    before = parts.withColumn("before", F.sum("part").over(Window.partitionBy("src").orderBy("b")) - F.col("part"))
    segs = segments(parts.groupBy("src").agg(F.sum("part").alias("tokens")), schedule, weights)
    ends = segs.groupBy("src").agg(F.max("a1").alias("all_a"))
    totals = parts.groupBy("src").agg(F.sum("part").alias("tokens"))
    own = totals.join(ends, "src").filter("all_a > 0").select("src", "all_a", (F.greatest(F.col("tokens"), F.lit(1)) / F.col("all_a")).alias("run"))
    order = Window.partitionBy("src", "b").orderBy("o", "id", "n", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = src.withColumn("inside", F.sum("n").over(order)).join(before.select("src", "b", "before"), ["src", "b"])
    middle = F.col("before") + F.col("inside") - F.col("n") / 2
    if whole:
        y = F.greatest(F.lit(1e-300), F.least(F.col("all_a"), middle / F.col("run")))
        hit = placed.join(segs.join(own, "src"), "src").withColumn("y", y)
    else:
        run = own.agg(F.min("run").alias("run"))
        hit = placed.crossJoin(F.broadcast(run)).withColumn("y", middle / F.col("run")).join(segs, "src")
    hit = hit.filter((F.col("y") > F.col("a0")) & (F.col("y") <= F.col("a1")))
    slope = (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0"))
    rest = F.col("y") - F.col("a0")
    t = F.col("t0") + 2 * rest / (F.col("w0") + F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * slope * rest)))
    parts_n = shuffle_partitions(spark)
    out = hit.select("row", "id", F.col("n").alias("n_tokens"), F.round(F.least(t, F.lit(1.0)), 6).alias("position"))
    ranged = out.repartitionById(parts_n, F.least(F.floor(F.col("position") * parts_n), F.lit(parts_n - 1)).cast("int"))
    return ranged.sortWithinPartitions("position", "id", "n_tokens", F.xxhash64("row")).select(*[F.col("row")[c].alias(c) for c in names], "n_tokens", "position")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return mix(docs.select("doc_id", "source", tokens().alias("size")), size_col="size").drop("size")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, greatest(1, (length(text) + 3) // 4) AS n, md5('{SEED}:' || doc_id) AS o FROM documents WHERE text IS NOT NULL
), c AS (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY o, doc_id, n ROWS UNBOUNDED PRECEDING) - n / 2.0 AS middle FROM d),
tot AS (SELECT src, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY src),
knots(i, t, e) AS (VALUES {", ".join(f"({i}, CAST({t} AS DOUBLE), CAST({e} AS DOUBLE))" for i, (t, e) in enumerate(SCHEDULE))}),
raw AS (SELECT src, i, t, tokens, pow(tokens, e) AS w FROM tot, knots),
share AS (SELECT src, i, t, tokens, w / sum(w) OVER (PARTITION BY i) AS w FROM raw),
parts AS (SELECT src, tokens, i, lag(t) OVER s AS t0, t AS t1, lag(w) OVER s AS w0, w AS w1 FROM share WINDOW s AS (PARTITION BY src ORDER BY i)),
areas AS (SELECT *, sum((w0 + w1) / 2 * (t1 - t0)) OVER (PARTITION BY src ORDER BY i) AS a1 FROM parts WHERE t0 IS NOT NULL),
segs AS (SELECT *, coalesce(lag(a1) OVER (PARTITION BY src ORDER BY i), 0) AS a0 FROM areas),
run AS (SELECT min(tokens / a) AS run FROM (SELECT src, any_value(tokens) AS tokens, max(a1) AS a FROM segs GROUP BY src) WHERE a > 0),
hit AS (SELECT c.*, segs.*, CAST(middle AS DOUBLE) / run - a0 AS rest FROM c JOIN segs ON c.src = segs.src, run WHERE CAST(middle AS DOUBLE) / run > a0 AND CAST(middle AS DOUBLE) / run <= a1)
SELECT doc_id, source, n AS n_tokens, round(least(1.0, t0 + 2 * rest / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * (w1 - w0) / (t1 - t0) * rest)))), 6) AS position FROM hit
"""
