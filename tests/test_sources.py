"""Feeds, logs, binary databases, saved sets, streams and the command line."""

import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from argosieve import cli
from argosieve.operators.lookup import lookup
from argosieve.operators.quality import require_sound
from argosieve.plans.indicators import IndicatorSet, build, current_version
from argosieve.plans.scan import scan
from argosieve.sources import misp
from argosieve.sources.feeds import csv_feed, json_feed, load_feed, rows_feed, text_feed
from argosieve.sources.logs import log_lines, log_lines_bytes
from argosieve.sources.mmdb import Mmdb, build_mmdb, export_mmdb, mmdb_feed, mmdb_metadata, read_mmdb
from argosieve.streaming.follow import Reloading, follow, tail

LOG = "Connection from 192.168.1.50\nRequest to bad.malware.com\n\nSafe traffic\n"


@pytest.fixture
def feeds(tmp_path):
    (tmp_path / "a.txt").write_text("# comment\n192.168.1.0/24\n\n *.evil.com \nexact-match.com\n")
    (tmp_path / "b.csv").write_text('type,key,severity,n\ninternal,192.168.1.0/24,low,\nmalicious,*.malware.com,"hi ""x""",7\n')
    (tmp_path / "c.json").write_text(json.dumps([{"key": "192.168.1.0/24", "data": {"b": [1, {"z": None}], "a": 1.5}}, {"entry": "evil.com"}]))
    (tmp_path / "log.txt").write_text(LOG)
    return tmp_path


def test_feeds(spark, feeds):
    assert [r["key"] for r in text_feed(spark, str(feeds / "a.txt")).orderBy("seq").collect()] == ["192.168.1.0/24", "*.evil.com", "exact-match.com"]
    assert [(r["key"], r["data_json"]) for r in csv_feed(spark, str(feeds / "b.csv")).orderBy("seq").collect()] == [("192.168.1.0/24", '{"severity":"low","type":"internal"}'), ("*.malware.com", '{"n":7,"severity":"hi \\"x\\"","type":"malicious"}')]
    assert [(r["key"], r["data_json"]) for r in json_feed(spark, str(feeds / "c.json")).orderBy("seq").collect()] == [("192.168.1.0/24", '{"a":1.5,"b":[1,{"z":null}]}'), ("evil.com", "{}")]
    (feeds / "d.json").write_text('[{"data":{}}]')
    with pytest.raises(Exception, match="no key"):
        json_feed(spark, str(feeds / "d.json")).collect()
    with pytest.raises(ValueError, match="unknown feed"):
        load_feed(spark, "x", "xml")


def test_logs(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wb") as f:
        f.write(b" one \r\n\n\t\ntwo\xff\n")
    assert sorted(r["text"] for r in log_lines(spark, str(tmp_path / "a.log.gz")).collect()) == ["one", "two\ufffd"]
    (tmp_path / "b.log").write_bytes(b"10.0.0.1 \xff\n\n")
    assert [r["text"] for r in log_lines_bytes(spark, str(tmp_path / "b.log")).collect()] == ["10.0.0.1 \xff"]


def test_events_in_many_files_and_partitions(spark, tmp_path):
    """A file for each event, all in one folder, and a number for each entry, however many partitions there are."""
    from argosieve.plans.shared import write_each

    inner = [{"type": "md5", "value": "o{k}a"}, {"type": "md5", "value": "o{k}b"}]
    event = {"info": "e{k}", "Object": [None, {"name": "no attributes"}, {"name": "file", "comment": "c", "Attribute": inner}], "Attribute": [{"type": "domain|ip", "value": "d{k}|10.0.0.1"}, {"type": "md5", "value": "m{k}"}]}
    texts = [json.dumps({"Event": event}).replace("{k}", str(k)) for k in range(90)]
    path = f"file:{tmp_path}/events"
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "value string")
    assert write_each(df.repartition(7, "value"), path) == 91 and len(os.listdir(tmp_path / "events")) == 90
    events = misp.read_events(spark, path).repartition(80, F.col("Event.info"))
    assert misp.attributes(events)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    rows = sorted((r["seq"], r["key"]) for r in misp.entries(events).collect())
    want = {k: [f"d{k}", "10.0.0.1", f"m{k}", f"o{k}a", f"o{k}b"] for k in range(90)}
    assert len({n for n, _ in rows}) == len(rows) == 450
    keys = [k for _, k in rows]
    assert all(keys[keys.index(w[0]) : keys.index(w[0]) + 5] == w for w in want.values())


def test_misp_files(spark, tmp_path):
    event = {"Event": {"uuid": "u", "info": "i", "threat_level_id": 2, "date": "2024-01-01", "Attribute": [{"type": "ip-src", "value": "192.168.1.1", "to_ids": True}], "Object": [{"name": "file", "comment": "oc", "Attribute": [{"type": "md5", "value": "ab"}, {"type": "text", "value": "no"}]}]}}
    (tmp_path / "e.json").write_text(json.dumps(event))
    (tmp_path / "manifest.json").write_text("{}")
    rows = {r["key"]: (r["kind"], json.loads(r["data_json"])) for r in misp.misp_feed(spark, [str(tmp_path / "e.json"), str(tmp_path / "manifest.json")]).collect()}
    assert rows["192.168.1.1"][0] == "ip" and rows["192.168.1.1"][1]["threat_level"] == "Medium" and rows["ab"][1]["object_type"] == "file" and len(rows) == 2
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="no file"):
        misp.read_events(spark, str(tmp_path / "other"))


def test_schema_stops_a_build(spark):
    good = '{"threat_level":"high","category":"c","source":"s"}'
    assert build(rows_feed(spark, [("1.1.1.1", good)]), schema="threatdb").meta["counts"]["ip"] == 1
    with pytest.raises(Exception, match="is not valid"):
        build(rows_feed(spark, [("1.1.1.1", "{}")]), schema="threatdb").ips.collect()
    with pytest.raises(Exception, match="not an address"):
        build(rows_feed(spark, [("ip:nonsense", "{}")])).ips.collect()
    with pytest.raises(Exception, match="is not valid"):
        require_sound(rows_feed(spark, [("a", "{}")])).collect()


def test_empty_set(spark):
    iset = build(rows_feed(spark, [("a", "{}")]).filter("false"))
    assert lookup(spark.createDataFrame([("1.1.1.1",), ("a",)], "q string"), "q", iset).collect() == [] and iset.validate().collect() == []


@pytest.mark.parametrize("version, count", [(4, 3), (6, 3), (4, 3000)])
def test_binary_databases(spark, tmp_path, version, count):
    width = 128 if version == 6 else 32
    rows = [(k << (width - 16) if count > 3 else k << (width - 8), 16 if count > 3 else 8, json.dumps({"n": k, "s": "x" * (k % 400), "f": 1.5, "l": [True, -3, 1 << 40, 1 << 70], "m": {}}, sort_keys=True)) for k in range(1, count + 1)]
    raw = build_mmdb(rows, version, "Test")
    db = Mmdb(raw)
    assert db.meta["database_type"] == "Test" and db.meta["record_size"] in (24, 28, 32)
    path = tmp_path / "t.mmdb"
    path.write_bytes(raw)
    got = read_mmdb(spark, str(path)).collect()
    assert len(got) == count and mmdb_metadata(str(path))["ip_version"] == version
    by = {json.loads(r["data_json"])["n"]: json.loads(r["data_json"]) for r in got}
    assert set(by) == set(range(1, count + 1)) and by[3]["l"] == [True, -3, 1 << 40, str(1 << 70)] and by[3]["s"] == "xxx" and by[3]["f"] == 1.5


def test_wide_records():
    db = Mmdb(build_mmdb([(1 << 31, 1, json.dumps({"x": "y" * (1 << 24)}))], 4, "Big"))
    assert db.meta["record_size"] == 28 and [d for _, _, d in db.walk(0, 0, 0)] == [1]


def test_set_survives_export(spark, tmp_path):
    iset = build(rows_feed(spark, [("10.0.0.0/8", '{"a":1}'), ("10.1.0.0/16", '{"a":2}'), ("2001:db8::/32", '{"a":3}')]))
    assert export_mmdb(iset, str(tmp_path / "x.mmdb")) == 3
    again = build(mmdb_feed(spark, str(tmp_path / "x.mmdb")))
    q = spark.createDataFrame([("10.2.3.4",), ("10.1.9.9",), ("2001:db8::7",), ("11.0.0.1",)], "q string")
    want = {r["text"]: r["data"] for r in lookup(q, "q", iset).collect()}
    assert {r["text"]: r["data"] for r in lookup(q, "q", again).collect()} == want and len(want) == 3


def test_saved_versions_and_reload(spark, tmp_path):
    path, seen = str(tmp_path / "set"), []
    first = build(rows_feed(spark, [("evil.com", '{"v":1}')])).save(path)
    live = Reloading(spark, path, lambda *a: seen.append(a))
    assert current_version(spark, path) == first and live.get().meta["counts"]["literal"] == 1
    build(rows_feed(spark, [("evil.com", '{"v":2}'), ("bad.com", "{}")])).save(path)
    assert live.get().meta["counts"]["literal"] == 2 and live.generation == 2 and seen[0][1:] == (2, None)
    from argosieve.plans.indicators import point

    point(spark, path, "missing")
    assert live.get().meta["counts"]["literal"] == 2 and live.generation == 2 and seen[1][2] is not None
    assert IndicatorSet.load(spark, path, first).meta["counts"]["literal"] == 1
    with pytest.raises(FileNotFoundError):
        IndicatorSet.load(spark, str(tmp_path / "none"))


def test_following_a_growing_file(spark, tmp_path):
    log, out = tmp_path / "a.log", []
    iset = build(rows_feed(spark, [("192.168.1.0/24", '{"n":1}')]))
    sink = lambda df, n: out.extend((n, r["matched_text"]) for r in df.collect())

    def run():
        q = follow(tail(spark, str(tmp_path / "*.log"), 16), [iset], sink, str(tmp_path / "cp"), available_now=False)
        q.processAllAvailable()
        q.stop()

    log.write_text("from 192.168.1.50 here\nfrom 192.168.1.5")
    run()
    assert [t for _, t in out] == ["192.168.1.50"]
    with log.open("a") as f:
        f.write("1 there\n" + "x" * 100 + "\n192.168.1.52\n")
    run()
    assert sorted(t for _, t in out) == ["192.168.1.50", "192.168.1.51", "192.168.1.52"]
    log.write_text("192.168.1.9\n")
    run()
    assert sorted(t for _, t in out)[-1] == "192.168.1.9" and len(out) == 4
    os.remove(log)
    run()
    assert len(out) == 4


def test_command_line(spark, feeds, capsys, monkeypatch):
    db = str(feeds / "db")
    assert cli.main(["build", str(feeds / "b.csv"), str(feeds / "a.txt"), "-o", db, "-d", "test"]) == 0
    assert cli.main(["query", db, "x.malware.com"]) == 0 and cli.main(["query", "-q", db, "nothing.org"]) == 1
    capsys.readouterr()
    assert cli.main(["match", db, str(feeds / "log.txt")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["matched_text"] for x in lines} == {"192.168.1.50", "bad.malware.com"}
    assert cli.main(["match", db, str(feeds / "log.txt"), "--format", "summary"]) == 0
    assert json.loads(capsys.readouterr().out)["lines_with_matches"] == 2
    assert cli.main(["extract", str(feeds / "log.txt"), "--types", "ip4", "--format", "csv"]) == 0
    assert capsys.readouterr().out.split() == ["type,value", 'ipv4,"192.168.1.50"']
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"x 10.9.8.7 y\n\n")))
    assert cli.main(["extract", "-", "--types", "ip4", "--format", "text", "--unique"]) == 0
    assert capsys.readouterr().out.split() == ["10.9.8.7"]
    assert cli.main(["inspect", db]) == 0 and cli.main(["validate", db]) == 0
    assert cli.main(["bench", "combined", "--count", "50", "--queries", "100", "--hit-rate", "1"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["found"] == 100


def test_scan_without_sets_or_texts(spark):
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([("x",)], "text string"), "text", []).collect()


def test_following_several_files_on_the_command_line(spark, tmp_path):
    iset = build(rows_feed(spark, [("10.0.0.0/8", "{}"), ("*.example.com", "{}")]))
    for name, text in (("a.log", "10.0.0.1 x\n"), ("b.log", "10.0.0.2 h.example.com\n")):
        (tmp_path / name).write_text(text)
    out = []
    lines = tail(spark, f"{tmp_path}/a.log\nfile:{tmp_path}/b*")
    query = follow(lines, [iset], lambda df, n: out.extend(r["matched_text"] for r in df.collect()), str(tmp_path / "cp"), types=("IPv4",))
    query.processAllAvailable()
    query.stop()
    assert sorted(out) == ["10.0.0.1", "10.0.0.2"]


def test_shared_folders_keep_their_file_system(spark, monkeypatch):
    from argosieve.plans import shared

    path = shared.shared_dir(spark, "x")
    assert path.startswith("file:/") and spark.sparkContext.applicationId in path
    assert shared.qualified(spark, "/some/folder") == spark._jvm.org.apache.hadoop.fs.Path("/some/folder").getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path("/some/folder")).toString()
    df = shared.materialize(spark.range(3), "x")
    assert df.count() == 3
    shared.stored(df, path)
    shared.discard(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize(
    ("code", "change"),
    [
        ("prefix_range", lambda s: {"ips": s.ips.withColumn("plen", F.lit(200))}), ("host_bits", lambda s: {"ips": s.ips.withColumn("lo", F.col("lo") + 1)}), ("glob_invalid", lambda s: {"globs": s.globs.withColumn("regex", F.lit(None).cast("string"))}),
        ("glob_id", lambda s: {"globs": s.globs.withColumn("id", F.lit(0).cast("bigint"))}), ("literal_repeats", lambda s: {"literals": s.literals.unionByName(s.literals)}), ("payload_json", lambda s: {"literals": s.literals.withColumn("data_json", F.lit("{"))}),
        ("count", lambda s: {"ips": s.ips.filter("false")}), ("payload_empty", lambda s: {"ips": s.ips.withColumn("data_json", F.lit("{}"))}), ("schema", lambda s: {"meta": s.meta | {"schema": "threatdb"}}),
    ],
)
def test_validation_finds_what_is_broken(spark, code, change):
    sound = build(rows_feed(spark, [("10.0.0.0/8", '{"a":1}'), ("evil.com", '{"a":1}'), ("*.com", '{"a":1}'), ("b*", '{"a":1}')]))
    assert sound.validate(strict=True).collect() == []
    parts = {k: getattr(sound, k) for k in ("ips", "literals", "globs", "nodes", "meta")} | change(sound)
    broken = IndicatorSet(parts["ips"], parts["literals"], parts["globs"], parts["nodes"], parts["meta"])
    assert code in {r["code"] for r in broken.validate(strict=True).collect()}


def test_small_inputs_are_spread_and_large_ones_are_not(spark):
    from argosieve.plans.shared import spread

    assert "Exchange" in spread(spark.range(10).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in spread(spark.range(10).coalesce(1), least_bytes=1)._jdf.queryExecution().executedPlan().toString()
