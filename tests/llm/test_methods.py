"""Operators against brute force, exact round trips, other libraries and held-out labels."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from argosieve.llm import bpe, exactdedup, fingerprint, graph, hashindex, htmlextract, linededup, mixing, sharding, simhash, tokenstore, toxicity, vocab
from argosieve.llm.common import read_table, shared_dir
from argosieve.llm.exactgroups import exact_groups
from argosieve.llm.mph import MinimalPerfectHash


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def planted(n, near, seed=3):
    """Random fingerprints, and copies of some of them at up to 40 bits' distance."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (n, simhash.BITS), dtype=np.uint8)
    copies = base[rng.integers(0, n, near)].copy()
    for c in copies:
        c[rng.choice(simhash.BITS, int(rng.integers(0, simhash.RADIUS + 1)), replace=False)] ^= 1
    return np.packbits(np.concatenate([base, copies]), axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("rows", [1, 2, 7, 500])
def test_list_keys_any_number_of_rows(rows):
    at, keys = simhash.list_keys(planted(rows, 0), 0, 2)
    assert len(at) == len(keys) and (at < rows).all()


def test_near_search_finds_what_brute_force_finds(spark):
    fps = planted(3000, 600)
    i, j = simhash._pairs(fps)
    want = set(zip(i.tolist(), j.tolist()))
    df = spark.createDataFrame([(k, f.tobytes()) for k, f in enumerate(fps)], "id bigint, fp binary").repartition(7)
    levels, reps = 1, simhash.plan(600_000)[1]
    assert simhash.plan(600_000)[0] >= 1
    edges = [(r["a"], r["b"]) for r in simhash.near_edges(df, levels, reps).collect()]
    root = roots_of(len(fps), edges)
    found = sum(root[a] == root[b] for a, b in want)
    assert found >= 0.95 * len(want)
    words = fps
    assert all(sum(int(np.bitwise_count(words[a, w] ^ words[b, w])) for w in range(4)) <= 3 * simhash.RADIUS for a, b in edges)


def test_long_lists_are_cut_and_searched(monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 300)
    fps = planted(900, 300)
    want = set(zip(*(x.tolist() for x in simhash._pairs(fps))))
    i, j = simhash.search(fps, 0, 0)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert got <= want and len(got) >= 0.93 * len(want)


def test_near_dedup_against_brute_force(spark, tiny):
    docs = read_table(spark, tiny, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    hashes = simhash._WordHashes()
    fps = [(r["doc_id"], simhash.simhash(r["text"], hashes)) for r in rows if r["text"] is not None]
    fps = [(i, f) for i, f in fps if f is not None]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if int(np.bitwise_count(fps[a][1] ^ fps[b][1]).sum()) <= simhash.RADIUS]
    root = roots_of(len(fps), near)
    want = {i: fps[root[k]][0] for k, (i, _) in enumerate(fps)}
    got = {r["doc_id"]: r["keeper_id"] for r in simhash.near_dedup(docs).collect()}
    assert all(got[i] == k for i, k in want.items()) and len(set(got.values())) < len(got)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(500, 560)]
    root = roots_of(600, pairs)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root[x] for p in pairs for x in p if p[0] != p[1]}


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    mph = MinimalPerfectHash.build(np.unique(keys))
    assert sorted(mph.lookup(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def test_hash_index(spark):
    rows = [(int(k) - 2500, int(k) % 7, int(k)) for k in np.random.default_rng(2).permutation(5000)] + [(10, 1, -3)]
    index = hashindex.build(spark.createDataFrame(rows, "h bigint, a bigint, b bigint"), {"a": ("<i8", "sum"), "b": ("<i8", "min")}, "t")
    found, got = index.probe(np.arange(-3000, 3000, dtype=np.int64).view(np.uint64))
    assert found.sum() == 5000 and not found[:500].any()
    assert got["b"][3010] == -3 and got["a"][3010] == 1 + 2510 % 7


def test_bpe_equals_other_libraries(spark, tiny):
    import tiktoken
    from tokenizers import Tokenizer

    docs = read_table(spark, tiny, "documents")
    tok = Tokenizer.from_file(bpe.VOCAB)
    tok.encode_special_tokens = True
    rows = bpe.encode(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    want = tok.encode_batch([r["text"] for r in rows], add_special_tokens=False)
    assert all(r["ids"] == w.ids for r, w in zip(rows, want)) and all(r["exact"] for r in rows)
    multi = bpe.VOCAB.replace("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=vocab.PRE_TOKEN, mergeable_ranks=tokenstore.load_ranks(multi), special_tokens={})
    for r in bpe.encode(docs, multi).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == enc.encode_ordinary(r["text"])


def test_token_store_round_trip(spark, tiny):
    import tiktoken

    docs = read_table(spark, tiny, "documents")
    _, store = tokenstore.build_store(docs, shared_dir(spark, "t"))
    enc = tiktoken.Encoding("t", pat_str=vocab.PRE_TOKEN, mergeable_ranks=tokenstore.load_ranks(tokenstore.RANKS), special_tokens={})
    for r in docs.select("doc_id", "text").collect():
        assert enc.decode(store.get(r["doc_id"]).tolist()) == r["text"]
    found, _ = store.locate(np.arange(10_000, 60_000))
    assert found.sum() == 0


def test_line_dedup_against_brute_force(spark, tiny):
    docs = read_table(spark, tiny, "documents")
    seen, want = set(), {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        keep = []
        for line in r["text"].split("\n"):
            key = line.strip(" ")
            if len(key) < linededup.MIN_CHARS or key not in seen:
                keep.append(line)
            seen.add(key)
        want[r["doc_id"]] = "\n".join(keep)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == want


def test_exact_dedup_goes_by_arrival(spark, tmp_path):
    import time

    for k, rows in enumerate([[(5, "same"), (6, "other")], [(1, "same"), (2, None), (7, "other")]]):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        time.sleep(1.1)
    got = {r["doc_id"]: (r["keeper_id"], r["is_duplicate"]) for r in exactdedup.stream_dedup(spark, str(tmp_path / "d"), bytes_per_batch=1).collect()}
    assert got == {5: (5, False), 6: (6, False), 1: (5, True), 2: (2, False), 7: (6, True)}


def test_unequal_bodies_of_one_digest_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "cc"), (5, "b"), (5, "b")], "doc_id bigint, text string")
    got = exact_groups(docs, "doc_id", "text", lambda t: t.encode(), lambda b: bytes([len(b)]) * 16, "clash").collect()
    assert sorted((r["id"], r["keeper"], r["n"]) for r in got) == [(1, 1, 2), (2, 2, 3), (3, 1, 2), (4, 4, 1), (5, 2, 3), (5, 2, 3)]


def test_fingerprints_fold_case_space_and_form(spark):
    docs = spark.createDataFrame([(1, "Ä b\n c"), (2, "ä  B c "), (3, "ä bc"), (4, "ä b c")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in fingerprint.fingerprints(docs).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (3, 1), 4: (1, 3)}


def test_shuffle_is_uniform_and_repeats(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"))
    a = sharding.shard(docs, shared_dir(spark, "s"), shard_bytes=20_000).collect()
    b = sharding.shard(docs.repartition(3), shared_dir(spark, "s"), shard_bytes=20_000).collect()
    order = lambda rows: [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["position"]))]
    assert order(a) == order(b) != sorted(order(a))
    sizes = Counter(r["shard"] for r in a)
    assert len(sizes) == 10 and max(sizes.values()) < 1.2 * min(sizes.values())
    x = np.array(order(a), float)
    assert abs(np.corrcoef(x, np.arange(len(x)))[0, 1]) < 0.03
    assert order(sharding.shard(docs, shared_dir(spark, "s"), seed=2, shard_bytes=20_000).collect()) != order(a)


def test_mixing_against_a_numeric_inverse(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(1, 400)), ["a", "b", "c"][int(rng.choice(3, p=[0.7, 0.2, 0.1]))]) for i in range(3000)]
    weights = {"a": [0.8, 0.5, 0.1], "b": [0.2, 0.3, 0.5], "c": [0.0, 0.2, 0.4]}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=weights).collect()
    n = {i: max(1, (len(t) + 3) // 4) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += n[i]
    grid = np.linspace(0, 1, 200_001)
    knots = [t for t, _ in mixing.SCHEDULE]
    share = {s: np.interp(grid, knots, w) for s, w in weights.items()}
    area = {s: np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2 * np.diff(grid))]) for s, v in share.items()}
    run = min(total[s] / area[s][-1] for s in weights)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for s, some in by.items():
        at = 0
        for r in sorted(some, key=lambda r: r["position"]):
            y = (at + r["n_tokens"] / 2) / run
            at += r["n_tokens"]
            assert r["position"] == pytest.approx(float(np.interp(y, area[s], grid)), abs=2e-4)
        assert at == pytest.approx(run * area[s][-1], rel=0.02)
    third = [r for r in got if r["position"] < 0.25]
    a = sum(r["n_tokens"] for r in third if r["source"] == "a") / sum(r["n_tokens"] for r in third)
    assert a == pytest.approx(0.725, abs=0.05)


def test_toxicity_on_held_out_labels(spark, tiny):
    folder = tiny.replace("sf0.001", "sf0.1")
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2))
    got = toxicity.detect(docs, labels.filter(half > 0)).join(labels.filter(half == 0), "doc_id").select("toxic", "is_toxic").collect()
    n = Counter((r["toxic"], r["is_toxic"]) for r in got)
    assert n[(1, True)] >= 0.9 * (n[(1, True)] + n[(1, False)]) and n[(0, True)] <= 0.01 * (n[(0, True)] + n[(0, False)])


def restorer(spark, words):
    docs = spark.createDataFrame([(f"{' '.join(words)} the plain text of a table that reads like words do",)] * 50, "text string")
    return toxicity.Restorer(toxicity.letter_model(docs), words)


@pytest.mark.parametrize("written", ["1d10t", "!diot", "id!ot", "iiidiot", "idiooot", "i.d.i.o.t", "id1ot", "i*iot", "iiddiioott", "ídiot", "ID10T!!", "i_d_i_o_t"])
def test_disguised_words_are_restored(spark, written):
    told = toxicity.Evidence(sure={"idiot": 0.99}, telling=frozenset(["idiot"]))
    scorer = toxicity.TokenScorer(toxicity.TokenReader(restorer(spark, ["idiot", "stupid"])), told)
    assert toxicity.score(f"you are {written} here", scorer) > 0.9
    assert toxicity.score("you are not 2024 at a 3.5 list here, id of 10 to", scorer) < 0.1


def test_spaced_letters_are_read_together(spark):
    told = toxicity.Evidence(sure={"idiot": 0.99}, telling=frozenset(["idiot"]))
    scorer = toxicity.TokenScorer(toxicity.TokenReader(restorer(spark, ["idiot"])), told)
    assert toxicity.score("you i d i o t there", scorer) > 0.9 and toxicity.score("points a b c d e then", scorer) < 0.1


def test_letter_model_is_a_distribution(spark):
    p = np.exp(-restorer(spark, ["abc"]).costs.astype(float)).reshape(-1, toxicity.BASE).sum(1)
    assert np.allclose(p, 1, atol=1e-3)


def test_html_marginals_equal_enumeration():
    page = htmlextract.parse("<div class=content><p>one two</p><nav><a href=1>x</a></nav></div>")
    forest = htmlextract.Forest([page])
    rng = np.random.default_rng(0)
    model = htmlextract.TreeModel(np.log([0.4, 0.6]), np.log([[0.9, 0.1], [0.3, 0.7]]), [np.log(rng.dirichlet(np.ones(n), 2)) for n in htmlextract.FEATURES])
    n, total = len(page.parent), np.zeros((len(page.parent), 2))
    for state in range(1 << n):
        y = [(state >> k) & 1 for k in range(n)]
        s = sum(model.root[y[k]] if page.parent[k] < 0 else model.pair[y[page.parent[k]], y[k]] for k in range(n))
        s += sum(model.node[f][y[k], forest.features[k, f]] for k in range(n) for f in range(len(htmlextract.FEATURES)))
        for k in range(n):
            total[k, y[k]] += math.exp(s)
    assert np.allclose(model.marginals(forest), total[:, 1] / total.sum(1))


def test_html_on_held_out_pages(spark, tiny):
    pages = read_table(spark, tiny.replace("sf0.001", "sf0.01"), "pages")
    half = F.pmod(F.xxhash64(F.lit(8), "page_id"), F.lit(2))
    model = htmlextract.train(pages.filter(half == 0))
    right = total = 0
    for r in pages.filter(half == 1).collect():
        page = htmlextract.parse(r["html"])
        forest = htmlextract.Forest([page])
        if not any(page.marked):
            continue
        content = model.marginals(forest) >= 0.5
        for node, text in page.texts.items():
            right += len(text) * (bool(content[node]) == bool(page.marked[node]))
            total += len(text)
    assert total and right >= 0.95 * total


def test_pipeline_against_its_stages_by_brute_force(spark, tiny):
    docs = read_table(spark, tiny, "documents")
    names = docs.columns
    out, kept = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, tiny)
        if name != "bpe":
            assert out.columns == names
            assert out.count() <= before.count()
        if name == "near dedup":
            texts = [r["text"] for r in out.collect()]
            assert len(texts) == len(set(texts))
    kept = {r["doc_id"]: r["text"] for r in before.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out).collect()}
    assert back == kept and 0 < len(kept) < docs.count()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tiny).collect()} == set(kept)
