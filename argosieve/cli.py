"""The command line: build, extract, match, query, inspect, validate and bench."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.functions.synth import STYLES, lookups, synthetic
from argosieve.operators.extract import choose, extract, unique
from argosieve.operators.lookup import lookup
from argosieve.plans.indicators import IndicatorSet, build, current_version
from argosieve.plans.scan import items_json, scan, scan_stats, to_ndjson
from argosieve.sources.feeds import concat_feeds, load_feed
from argosieve.sources.logs import log_lines
from argosieve.sources.mmdb import mmdb_feed
from argosieve.streaming.follow import Reloading, follow, tail


def session() -> SparkSession:
    spark = SparkSession.builder.appName("argosieve").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_set(spark: SparkSession, path: str) -> IndicatorSet:
    """A saved set, or one that is built from a feed (case counts then)."""
    if path.endswith(".mmdb"):
        return build(mmdb_feed(spark, path), path)
    if path.endswith((".json", ".csv", ".txt")):
        return build(load_feed(spark, path), path)
    return IndicatorSet.load(spark, path)


def read_logs(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of files, or of standard input for ``-``."""
    if files != ["-"]:
        return log_lines(spark, files)
    lines = [("-", x.strip()) for x in sys.stdin.buffer.read().decode("utf-8", "replace").split("\n")]
    return spark.createDataFrame([x for x in lines if x[1]], "source string, text string")


def follow_logs(spark: SparkSession, files: list[str], sets: list, checkpoint: str, types: tuple[str, ...] | None = None, form: str = "json", out: str | None = None) -> None:
    """Gives the matches of lines as they come, until it is stopped; saved sets are reloaded when they change.

    Matches, or their number where ``form`` is summary, are printed, or go to a folder for each batch under ``out``.
    """

    def show(matches: DataFrame, number: int) -> None:
        if form == "summary":
            lines = matches.groupBy().agg(F.count(F.lit(1)).alias("matches")).select(F.to_json(F.struct(F.lit(number).alias("batch"), "matches")))
        else:
            lines = to_ndjson(matches, "source", time.strftime("%s.000"))
        if out:
            lines.write.mode("overwrite").text(f"{out}/batch={number}")
            return
        for r in lines.toLocalIterator():
            print(r[0], flush=True)

    query = follow(tail(spark, "\n".join(files)), sets, show, checkpoint, types=types)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()


def emit(df: DataFrame, out: str | None, kind: str = "text") -> None:
    """Rows into a folder, or line by line to standard output."""
    if out:
        getattr(df.write, kind)(out)
        return
    for r in df.toLocalIterator():
        print(r[0])


def items_text(items: DataFrame, form: str) -> DataFrame:
    if form == "json":
        return items_json(items)
    if form == "csv":
        return items.select(F.concat(F.lower("item_type"), F.lit(',"'), F.regexp_replace("value", '"', '""'), F.lit('"')).alias("value"))
    return items.select("value")


def run_bench(spark: SparkSession, kind: str, n: int, queries: int, hit_rate: float, style: str) -> dict:
    began = time.time()
    iset = build(synthetic(spark, kind, n, style))
    counted = sum(t.count() for t in (iset.ips, iset.literals, iset.globs))
    built = time.time()
    texts = lookups(spark, kind, queries, n, hit_rate, style)
    hits = lookup(texts, "q", iset)
    found = texts.join(hits, texts["q"] == hits["text"], "left_semi").count()
    done = time.time()
    return {"kind": kind, "entries": counted, "build_s": round(built - began, 3), "queries": queries, "found": found, "lookup_s": round(done - built, 3), "lookups_per_s": round(queries / (done - built), 1)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="argosieve")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="a set from feeds")
    b.add_argument("feeds", nargs="+")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("-f", "--format", choices=("text", "csv", "json", "misp", "mmdb"))
    b.add_argument("-i", "--case-insensitive", action="store_true")
    b.add_argument("--metadata", choices=("full", "minimal", "threatdb"), default="full", help="what entries of events tell")
    b.add_argument("--database-type")
    b.add_argument("--schema", choices=("threatdb",))
    b.add_argument("-d", "--description")
    b.add_argument("--desc-lang", default="en")
    e = sub.add_parser("extract", help="items in logs")
    e.add_argument("files", nargs="+")
    e.add_argument("--types")
    e.add_argument("--format", choices=("json", "csv", "text"), default="json")
    e.add_argument("--unique", action="store_true")
    e.add_argument("--min-labels", type=int, default=2)
    e.add_argument("-o", "--output")
    m = sub.add_parser("match", help="items in logs that a set knows")
    m.add_argument("database")
    m.add_argument("files", nargs="+")
    m.add_argument("--extractors")
    m.add_argument("--follow", metavar="CHECKPOINT", help="go on with what is appended; the folder keeps the places")
    m.add_argument("--format", choices=("json", "summary"), default="json")
    m.add_argument("-o", "--output")
    q = sub.add_parser("query", help="one text")
    q.add_argument("database")
    q.add_argument("text")
    q.add_argument("-q", "--quiet", action="store_true")
    for name in ("inspect", "validate"):
        s = sub.add_parser(name)
        s.add_argument("database")
        s.add_argument("--strict", action="store_true") if name == "validate" else None
    n = sub.add_parser("bench", help="lookups in a made-up set")
    n.add_argument("kind", choices=("ip", "literal", "pattern", "combined"))
    n.add_argument("--count", type=int, default=10_000)
    n.add_argument("--queries", type=int, default=50_000)
    n.add_argument("--hit-rate", type=float, default=0.1)
    n.add_argument("--style", choices=STYLES, default="mixed")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "build":
        feeds = [mmdb_feed(spark, f) if a.format == "mmdb" or f.endswith(".mmdb") else load_feed(spark, f, a.format, a.metadata) for f in a.feeds]
        iset = build(concat_feeds(feeds), a.output, a.case_insensitive, a.schema, {a.desc_lang: a.description} if a.description else None, a.database_type)
        print(json.dumps({"version": iset.save(a.output), **iset.meta["counts"]}))
    elif a.command == "extract":
        items = extract(read_logs(spark, a.files), "text", choose(a.types), a.min_labels)
        if a.format == "csv" and not a.output:
            print("type,value")
        emit(items_text(unique(items).withColumnRenamed("raw", "value") if a.unique else items, a.format), a.output)
    elif a.command == "match":
        if a.follow:
            saved = not a.database.endswith((".mmdb", ".json", ".csv", ".txt"))
            follow_logs(spark, a.files, [Reloading(spark, a.database) if saved else open_set(spark, a.database)], a.follow, choose(a.extractors) if a.extractors else None, a.format, a.output)
            return 0
        sets, lines = [open_set(spark, a.database)], read_logs(spark, a.files)
        if a.format == "summary":
            emit(scan_stats(lines.withColumn("line", F.monotonically_increasing_id()), "text", sets, "line").select(F.to_json(F.struct("*"))), a.output)
        else:
            emit(to_ndjson(scan(lines, "text", sets, choose(a.extractors) if a.extractors else None), "source"), a.output)
    elif a.command == "query":
        rows = lookup(spark.createDataFrame([(a.text,)], "q string"), "q", open_set(spark, a.database)).collect()
        results = []
        for r in rows:
            for x in map(json.loads, r["data"]):
                results.append(x | {"cidr": r["cidr"], "prefix_len": r["prefix_len"]} if r["match_type"] == "ip" else x)
        if not a.quiet:
            print(json.dumps(results, indent=2, sort_keys=True))
        return 0 if rows else 1
    elif a.command == "inspect":
        print(json.dumps(open_set(spark, a.database).inspect().first().asDict() | {"version": None if "." in a.database.rsplit("/", 1)[-1] else current_version(spark, a.database)}, indent=2, sort_keys=True))
    elif a.command == "validate":
        rows = open_set(spark, a.database).validate(a.strict).collect()
        for r in rows:
            print(json.dumps(r.asDict()))
        return int(any(r["severity"] == "error" for r in rows))
    else:
        print(json.dumps(run_bench(spark, a.kind, a.count, a.queries, a.hit_rate, a.style)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
