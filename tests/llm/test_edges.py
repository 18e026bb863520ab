"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: each has a defined result."""

from collections import Counter

import pytest

from argosieve.llm import bpe, exactdedup, fingerprint, htmlextract, linededup, mixing, sharding, simhash, tokenstore, toxicity
from argosieve.llm.common import shared_dir

N = 16


def test_near_dedup(nasty, empty):
    got = simhash.near_dedup(nasty).collect()
    assert len(got) == N
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["keeper_id"] == 1 and not by[1]["is_duplicate"] and by[2]["keeper_id"] == 1 and by[2]["is_duplicate"]
    assert by[7]["keeper_id"] == 6 and not by[3]["is_duplicate"] and not by[4]["is_duplicate"] and not by[10]["is_duplicate"]
    assert all(not r["is_duplicate"] and r["keeper_id"] is None for r in got if r["doc_id"] is None)
    assert simhash.near_dedup(empty).collect() == []


def test_line_dedup(nasty, empty):
    got = linededup.dedup_lines(nasty)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(got.columns) == len(nasty.columns)
    rows = got.collect()
    by = Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in rows)
    assert len(rows) == N and by[(1, 1, 0)] == 2 and by[(2, 1, 1)] == 1 and by[(3, 0, 0)] == 1 and by[(4, 1, 0)] == 1
    assert by[(6, 4001, 0)] == 1 and by[(7, 4001, 4000)] == 1
    assert next(r["text"] for r in rows if r["doc_id"] == 7) == "and an end"
    assert next(r["text"] for r in rows if r["doc_id"] == 2) == "" and next(r["text"] for r in rows if r["doc_id"] == 3) is None
    assert linededup.dedup_lines(empty).collect() == []


def test_toxicity(spark, nasty, empty, labels):
    got = toxicity.detect(nasty, labels).collect()
    assert len(got) == N and all(r["toxicity"] is not None for r in got) and not any(r["is_toxic"] for r in got if not r["text"])
    assert toxicity.detect(empty, labels).collect() == []
    assert not any(r["is_toxic"] for r in toxicity.detect(nasty, labels.limit(0)).collect())


def test_mixing(nasty, empty):
    got = mixing.mix(nasty).collect()
    assert 0 < len(got) <= N and all(r["text"] is not None and 0 <= r["position"] <= 1 for r in got)
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert mixing.mix(empty).collect() == []


def test_bpe(nasty, empty):
    coded = bpe.encode(nasty)
    rows = coded.collect()
    assert len(rows) == N and all(r["exact"] for r in rows if r["ids"] is not None) and sum(r["ids"] is None for r in rows) == 2
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(coded).collect())
    assert back == Counter((r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect())
    assert bpe.encode(empty).collect() == []


def test_token_store(spark, nasty, empty):
    rows, store = tokenstore.build_store(nasty, shared_dir(spark, "t"))
    assert rows.count() == N
    assert store.get(12345) is None and len(store.get(4)) == 0 and len(store.get(3)) == 0 and len(store.get(9)) > 0 and len(store.get(-5)) > 0 and len(store.get(2**63 - 1)) > 0
    rows, store = tokenstore.build_store(empty, shared_dir(spark, "t"))
    assert rows.collect() == [] and store.get(1) is None


def test_fingerprints(nasty, empty):
    got = fingerprint.fingerprints(nasty).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == N and by[1]["group_size"] == 3 and by[2]["group_id"] == 1 and by[3]["digest"] is None and by[4]["group_id"] == 4 and by[5]["group_id"] == 4 and by[5]["canonical_bytes"] == 0
    assert fingerprint.fingerprints(empty).collect() == []


def test_exact_dedup(spark, nasty, empty):
    path = shared_dir(spark, "exact-in")
    nasty.write.parquet(path)
    got = exactdedup.stream_dedup(spark, path).collect()
    by = Counter((r["doc_id"], r["keeper_id"], r["is_duplicate"]) for r in got)
    assert len(got) == N and by[(1, 1, False)] == 1 and by[(1, 1, True)] == 1 and by[(2, 1, True)] == 1 and by[(3, 3, False)] == 1 and by[(None, None, False)] == 2
    path = shared_dir(spark, "exact-in")
    empty.write.parquet(path)
    assert exactdedup.stream_dedup(spark, path).collect() == []


def test_sharding(spark, nasty, empty):
    got = sharding.shard(nasty, shared_dir(spark, "s"), shard_bytes=100_000)
    rows = got.collect()
    assert got.columns[-2:] == ["shard", "position"] and Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in nasty.collect())
    for k in {r["shard"] for r in rows}:
        own = sorted(r["position"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert sharding.shard(empty, shared_dir(spark, "s")).collect() == []


@pytest.mark.parametrize("html", [None, "", "plain words", "<p>open", "<div>" * 3000 + "deep", "<!-- never closed", "</p></p>", "<a href='x>y'>t</a>", "x" * 200_000])
def test_pages(spark, html):
    rows = [(1, "u", "<html><body><nav><a href=1>m</a></nav><article><p>Real words of a text.</p></article></body></html>", "c"), (2, None, html, "c"), (2, None, html, "c"), (None, "u", html, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = htmlextract.extract(pages).collect()
    assert len(got) == 4 and len({(r["text"], r["n_nodes"]) for r in got if r["page_id"] != 1}) == 1
    assert (got[1]["text"] is None) == (html is None)
    assert htmlextract.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(spark, tiny, nasty, empty, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, nasty, tiny)
    if stage < 4:
        assert got.columns == nasty.columns and got.schema["doc_id"].dataType == nasty.schema["doc_id"].dataType
    ids = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    want = Counter(r["doc_id"] for r in nasty.select("doc_id").collect())
    gone = {"toxicity": set(), "line dedup": {2}, "near dedup": {2, 7}, "bpe": set()}
    if name == "mixing":
        assert not ids - want and 3 not in ids
    else:
        assert ids == Counter({k: v for k, v in want.items() if k not in gone[name]})
    assert run(spark, empty, tiny).collect() == []
