"""Whole jobs: rare sources, doubled letters, rare telling words, long texts, short lines, large corpora, blank nodes."""

import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest
import unicodedata
from pyspark.sql import functions as F

import corpus_pipeline
from argosieve.llm import bpe, exactdedup, fingerprint, graph, hashindex, htmlextract, linededup, mixing, sharding, simhash, tokenstore, toxicity, vocab
from argosieve.llm.common import read_table, shared_dir
from argosieve.llm.graph import merge


def test_a_rare_source_drops_no_documents(spark):
    rows = [(i, "x" * (40 + i % 90), f"s{i % 20}") for i in range(2000)] + [(5000, "y" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in rows)
    got = mixing.mix(docs, whole=True).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)


def test_a_whole_mix_follows_the_course_of_its_weights(spark):
    rows = [(i, "x" * 100, "a" if i % 50 else "b") for i in range(4000)] + [(9000, "", "a"), (9001, "", "b")]
    docs = spark.createDataFrame([(i, len(t), s) for i, t, s in rows], "doc_id bigint, size bigint, source string")
    weights = {"a": [0.8, 0.5, 0.2], "b": [0.2, 0.5, 0.8]}
    got = mixing.mix(docs, weights=weights, size_col="size", whole=True).collect()
    assert len(got) == len(rows)
    grid = np.linspace(0, 1, 100_001)
    for s, w in weights.items():
        own = [r for r in got if r["source"] == s]
        share = np.interp(grid, [0, 0.5, 1], w)
        area = np.concatenate([[0], np.cumsum((share[1:] + share[:-1]) / 2 * np.diff(grid))])
        assert sum(r["position"] <= 0.5 for r in own) / len(own) == pytest.approx(area[50_000] / area[-1], abs=0.03)


LEXICON = ["stupid", "moron", "worthless", "disgusting", "pathetic"]


@pytest.fixture(scope="module")
def restorer(spark):
    text = " ".join(LEXICON) + " the plain text of a table that reads like words do, all will be well and good in a small book"
    return toxicity.Restorer(toxicity.letter_model(spark.createDataFrame([(text,)] * 50, "text string")), LEXICON)


@pytest.mark.parametrize("written", ["stuupid", "stuupidd", "sttuupid", "morron", "wworthless", "ddisgusting", "patheetic", "STUUPID!", "(morron)"])
def test_words_with_any_doubled_letter_are_decoded(restorer, written):
    told = toxicity.Evidence(sure={w: 0.99 for w in LEXICON}, telling=frozenset(LEXICON))
    scorer = toxicity.TokenScorer(toxicity.TokenReader(restorer), told)
    assert toxicity.score(f"you are {written} here", scorer) > 0.9
    assert toxicity.score("all will be well and good in a small book", scorer) < 0.1


def test_a_telling_word_needs_no_share_of_all_toxic_texts(spark):
    rng = np.random.default_rng(6)
    plain = lambda: " ".join("w" + chr(97 + x // 100) + chr(97 + x // 10 % 10) + chr(107 + x % 10) for x in rng.integers(0, 2600, 12).tolist())
    rows = [(f"{plain()} idiot {plain()}", 1) for _ in range(600)] + [(f"{plain()} bocoos {plain()}", 1) for _ in range(8)] + [(f"{plain()} {plain()}", 0) for _ in range(3000)]
    told = toxicity.fit_words(spark.createDataFrame(rows, "t string, y int"))
    assert {"idiot", "bocoos"} <= told.telling
    assert not [w for w in told.telling if w[0] == "w"]


def test_a_toxic_passage_weighs_the_same_inside_a_long_text():
    told = toxicity.Evidence(telling=frozenset(["moron", "stupid"]), toxic_rate=0.08, clean_rate=0.0002, share=0.1)
    scorer = toxicity.TokenScorer(toxicity.TokenReader(None), told)
    passage, long = "you moron are so stupid a moron", "plain words of a text " * 2000
    alone = toxicity.score(passage, scorer)
    assert alone > 0.9 and toxicity.score(long + passage + " " + long, scorer) == pytest.approx(alone, abs=0.1)
    assert toxicity.score(long + "moron " + long + "stupid", scorer) < 0.1


def test_few_labels_can_make_a_word_sure():
    assert toxicity.is_sure(8, 0) and toxicity.is_sure(49, 0) and not toxicity.is_sure(3, 0) and not toxicity.is_sure(400, 300) and not toxicity.is_sure(49, 2)


@pytest.mark.parametrize("seed", range(5))
def test_worst_window_is_that_of_all_windows(seed):
    rng = np.random.default_rng(seed)
    places = np.flatnonzero(rng.random(200) < 0.05).tolist()
    want = max((j - i + 1) * 2.0 - (places[j] - places[i] + 1) * 0.1 for i in range(len(places)) for j in range(i + toxicity.MIN_HITS - 1, len(places)))
    assert toxicity.worst_window(places, 2.0, 0.1) == pytest.approx(want)


def test_the_pipeline_drops_short_lines_that_repeat(spark):
    docs = spark.createDataFrame([(1, "And ornd.\n\nfirst of all\n\t\nx"), (2, "And ornd.\n\n\t\na second\n\r\nx")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: "And ornd.\n\nfirst of all\n\t\nx", 2: "\n\t\na second\n\r"}
    kept = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs).collect()}
    assert kept == {1: 0, 2: 0}


@pytest.mark.parametrize(("n", "levels"), [(10_000, 1), (600_000, 1), (15_000_000, 1), (150_000_000, 2), (20_000_000_000, 2)])
def test_near_edges_with_the_plan_of_a_large_corpus(spark, n, levels):
    """Pairs at the radius itself, with the very levels, repetitions, weights and centres that a corpus of n gets."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, (400, simhash.BITS), dtype=np.uint8)
    copies = base.copy()
    for c in copies:
        c[rng.choice(simhash.BITS, simhash.RADIUS, replace=False)] ^= 1
    fps = np.packbits(np.concatenate([base, copies]), axis=1, bitorder="little").view(np.uint64)
    plan = simhash.plan(n)
    assert plan.levels == levels
    df = spark.createDataFrame([(k, f.tobytes()) for k, f in enumerate(fps)], "id bigint, fp binary").repartition(4)
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.near_edges(df, *plan).collect()}
    assert sum((k, k + 400) in found for k in range(400)) >= 370


def test_plans_cost_little_more_for_many_more_fingerprints():
    sizes = [10**k for k in range(4, 11)]
    rows = [simhash.plan(n).rows() for n in sizes]
    assert rows == sorted(rows) and rows[-1] / rows[0] < (sizes[-1] / sizes[0]) ** 0.35 and all(b / a < 4 for a, b in zip(rows, rows[1:]))
    assert simhash.plan(simhash.LIST_SIZE) == (0, 1, simhash.WEIGHT, simhash.CENTRES)


def clusters(seed, big, small, alone):
    """Fingerprints around one centre, around several others, and alone."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2, (1 + small // 20, simhash.BITS), dtype=np.uint8)
    near = np.concatenate([np.repeat(centres[:1], big, 0), np.repeat(centres[1:], 20, 0)[:small]])
    near ^= (rng.random(near.shape) < 0.07).astype(np.uint8)
    bits = np.concatenate([near, rng.integers(0, 2, (alone, simhash.BITS), dtype=np.uint8)])
    return np.packbits(bits[rng.permutation(len(bits))], axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_a_hot_list_are_those_of_all_pairs(monkeypatch, seed):
    monkeypatch.setattr(simhash, "DENSE_LIST", 200)
    fps = clusters(seed, 500, 300, 300)
    root = np.arange(len(fps))
    merge(root, *simhash._pairs(fps))
    assert (simhash.groups_of(fps, 0, 4) == root).all()


def test_a_hot_list_takes_time_in_proportion():
    began = time.time()
    fps = clusters(1, 60_000, 0, 20_000)
    assert len(set(simhash.groups_of(fps, 0, 1).tolist())) == 20_001
    assert time.time() - began < 60


def test_components_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)] + [(1, None), (None, None), (3, 3)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    by = [{r["node"]: r["root"] for r in graph.components(df, n).collect()} for n in (0, 10**6)]
    assert by[0] == by[1] and len(by[0]) > 100 and graph.components(df.limit(0), 0).collect() == []


def test_copies_that_lost_lines_are_found_by_their_former_text(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    lines = [[word() for _ in range(12)] for _ in range(30)]
    other = [list(x) for x in lines]
    for x in other[::2]:
        x[5] = word()
    texts = {1: "\n".join(map(" ".join, lines)), 2: "\n".join(map(" ".join, other)), 3: "\n".join(" ".join(word() for _ in range(12)) for _ in range(20))}
    table = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(9, "one line\nand another"), (None, None)], "doc_id bigint, text string")
    left = linededup.dedup_lines(table, min_chars=1).select("doc_id", "text")
    assert not any(r["is_duplicate"] for r in simhash.near_dedup(left).collect())
    got = {r["doc_id"]: r["keeper_id"] for r in simhash.near_dedup(left, before=table).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 9: 9, None: None}
    strange = spark.createDataFrame([(1, "nothing of the table's text"), (2, "but the same ids")], "doc_id bigint, text string")
    assert not any(r["is_duplicate"] for r in simhash.near_dedup(strange, before=table).collect())


@pytest.mark.parametrize("distance", [30, 44])
def test_meeting_chance_is_that_of_the_lists(distance):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, (400, simhash.BITS), dtype=np.uint8)
    b = a.copy()
    for c in b:
        c[rng.choice(simhash.BITS, distance, replace=False)] ^= 1
    met = 0
    for rep in range(40):
        lists = []
        for x in (a, b):
            at, keys = simhash.list_keys(np.packbits(x, axis=1, bitorder="little").view(np.uint64), rep, 1)
            lists.append(set(zip(at.tolist(), keys.tolist())))
        met += len({k for k, _ in lists[0] & lists[1]})
    assert met / 16_000 == pytest.approx(simhash.meeting(1, distance=distance), rel=0.1)


@pytest.mark.parametrize(
    ("html", "want"),
    [("<p><b>Hello</b> <i>world</i></p>", "Hello world"), ("<p><a>one</a>\n<a>two</a></p>", "one two"), ("<p>a<b>b</b>c</p>", "abc"), ("<p>one</p> <p>two</p>", "one\ntwo")],
)
def test_white_space_between_inline_elements_stays(html, want):
    page = htmlextract.parse(html)
    assert htmlextract.page_text(page, np.ones(len(page.parent), bool)) == want


def test_white_space_around_what_is_left_out_stays():
    page = htmlextract.parse("<p><b>one</b> <a>menu</a><i>two</i></p>")
    content = np.array([page.texts.get(k, "").strip() != "menu" for k in range(len(page.parent))])
    assert htmlextract.page_text(page, content) == "one two"


# ---- toxicity


def readings(restorer, places):
    """Every reading of a lattice, its letters' cost under the model and its cost as a word that is looked for."""
    for way in itertools.product(*places):
        if any(x == "?" for x, _ in way):
            continue
        context, cost, word = 0, 0.0, ""
        for letter, price in way:
            cost += price
            if letter:
                key = context * toxicity.BASE + toxicity._CODE.get(letter, toxicity._OTHER)
                cost, context, word = cost + float(restorer.costs[key]), key % toxicity.BASE**3, word + letter
        yield word, cost + float(restorer.costs[context * toxicity.BASE]), sum(p for _, p in way)


@pytest.mark.parametrize("token", ["m0r0n", "m0rrr0n", "5tup1d", "st!!pid", "m@r+", "wor+hl3ss", "p4thet1c", "xyz1", "8e9", "b0ok", "mmoorroonn", "s t.u p1d"])
def test_decoding_is_that_of_all_readings(restorer, token):
    places = restorer.lattice(token)
    assert math.prod(map(len, places)) < 300_000
    every = list(readings(restorer, places))
    cost = min(c for _, c, _ in every)
    assert restorer._letters(places)[0] == pytest.approx(cost, abs=1e-4)
    assert min(c for w, c, _ in every if w == restorer.letters(token)) == pytest.approx(cost, abs=1e-4)
    known = [(p, w) for w, _, p in every if w in restorer.words]
    got = restorer.decode(token)
    if not known:
        assert got == ""
    elif min(known)[0] + toxicity._WORD <= cost:
        assert got == min(known)[1]
    else:
        assert got == restorer.letters(token)


@pytest.mark.parametrize("written", ["iddiot", "idioot", "iddioot", "1diot", "m o r o n", "k y z", "k.y.z", "kyyz", "ky2"])
def test_short_and_stretched_words_are_restored(restorer, written):
    words = ["idiot", "moron", "kyz"]
    told = toxicity.Evidence(sure={w: 0.99 for w in words}, telling=frozenset(words))
    scorer = toxicity.TokenScorer(toxicity.TokenReader(toxicity.Restorer(restorer.costs, words)), told)
    assert toxicity.score(f"you {written} there", scorer) > 0.9


@pytest.mark.parametrize("token", ["!" * 200_000 + "a", "a" + "!@" * 20_000 + "b", "deadbeef0123" * 20_000, "a b " * 50_000, "(" * 100_000])
def test_very_long_tokens_are_read_in_time(restorer, token):
    told = toxicity.Evidence(sure={w: 0.99 for w in LEXICON}, telling=frozenset(LEXICON))
    began = time.time()
    assert toxicity.score(token, toxicity.TokenScorer(toxicity.TokenReader(restorer), told)) < 0.1
    assert time.time() - began < 30


def test_core_takes_marks_and_runs_from_both_ends():
    assert [toxicity._core(x) for x in ("!!!a!!", "(**b##).", "@c", "$$$", "", "d!", "..!!..e")] == ["a", "b", "@c", "", "", "d!", "e"]


def test_the_classifier_is_a_maximum_of_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    n = rng.integers(1, 4, 400)
    loss = lambda w: float((n * np.logaddexp(0, -(2 * y - 1) * (x @ w[:3] + w[3]))).sum() + 0.5 * (w[:3] @ w[:3]))
    best = toxicity.fit_logistic(x, y, n)
    assert all(loss(best + d) >= loss(best) - 1e-6 for d in 0.05 * np.vstack([np.eye(4), -np.eye(4)]))


# ---- exact copies


def add_file(spark, path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, _metadata string, path string, row string").coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def test_later_files_are_judged_against_the_state_that_was_kept(spark, tmp_path):
    path, folder = str(tmp_path / "d"), f"file://{tmp_path}/state"
    add_file(spark, path, [(5, "same", "x", "p", "r"), (6, "other", "x", "p", "r")])
    run = lambda: sorted((r["doc_id"], r["keeper_id"], r["is_duplicate"]) for r in exactdedup.stream_dedup(spark, path, folder=folder).collect())
    assert run() == [(5, 5, False), (6, 6, False)]
    add_file(spark, path, [(1, "same", "x", "p", "r"), (2, None, "x", "p", "r"), (7, "other", "x", "p", "r"), (8, "new", None, None, None), (9, "new", None, None, None)])
    want = [(1, 5, True), (2, 2, False), (5, 5, False), (6, 6, False), (7, 6, True), (8, 8, False), (9, 8, True)]
    assert run() == want and run() == want


def test_a_run_that_is_cut_short_goes_on(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "d"), f"file://{tmp_path}/state"
    add_file(spark, path, [(5, "same", "x", "p", "r"), (6, "other", "x", "p", "r")])
    add_file(spark, path, [(1, "same", "x", "p", "r")])
    judge = exactdedup._judge
    monkeypatch.setattr(exactdedup, "_judge", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exactdedup.stream_dedup(spark, path, folder=folder, bytes_per_batch=1)
    monkeypatch.setattr(exactdedup, "_judge", judge)
    got = sorted((r["doc_id"], r["keeper_id"], r["is_duplicate"]) for r in exactdedup.stream_dedup(spark, path, folder=folder).collect())
    assert got == [(1, 5, True), (5, 5, False), (6, 6, False)]


def test_bytes_of_hits_are_compared(spark, tmp_path, monkeypatch):
    """With a digest that tells lengths only, unequal texts of one length must still be told apart."""
    path, folder = str(tmp_path / "d"), f"file://{tmp_path}/state"
    monkeypatch.setattr(exactdedup, "_digest", lambda b: bytes([len(b)]) * 32)
    monkeypatch.setattr(exactdedup, "digest_of", lambda text: F.when(text.isNotNull(), F.unhex(F.repeat(F.lpad(F.hex(F.octet_length(text)), 2, "0"), 32))))
    add_file(spark, path, [(1, "aa", "", "", ""), (2, "bb", "", "", ""), (3, "aa", "", "", "")])
    run = lambda: sorted((r["doc_id"], r["keeper_id"], r["is_duplicate"]) for r in exactdedup.stream_dedup(spark, path, folder=folder).collect())
    assert run() == [(1, 1, False), (2, 2, False), (3, 1, True)]
    add_file(spark, path, [(4, "bb", "", "", ""), (5, "cc", "", "", ""), (6, "d", "", "", "")])
    assert run() == [(1, 1, False), (2, 2, False), (3, 1, True), (4, 2, True), (5, 5, False), (6, 6, False)]


# ---- fingerprints, shards, pages, indexes, tokens


def test_case_is_folded_in_full(spark):
    pairs = [("STRASSE", "Straße"), ("ΟΔΟΣ", "οδος"), ("ΟΔΟΣ", "οδοσ"), ("e\u0301t", "ÉT"), ("ǰ", "J\u030c"), ("İ", "i\u0307")]
    assert all(fingerprint.canonical(a) == fingerprint.canonical(b) for a, b in pairs) and fingerprint.canonical("a b") != fingerprint.canonical("ab")


def test_fingerprints_against_brute_force(spark, tiny):
    import xxhash

    docs = read_table(spark, tiny, "documents")
    fold = lambda t: " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()).split()).encode()
    groups = {}
    rows = [(r["doc_id"], fold(r["text"])) for r in docs.collect()]
    for i, b in rows:
        groups.setdefault(b, []).append(i)
    want = {i: (xxhash.xxh128(b).hexdigest(), len(b), min(groups[b]), len(groups[b])) for i, b in rows}
    got = {r["doc_id"]: (r["digest"], r["canonical_bytes"], r["group_id"], r["group_size"]) for r in fingerprint.fingerprints(docs).collect()}
    assert got == want


def shards_by_hand(rows, seed, n, h):
    """The order of records in n buckets, from their hashes."""
    out = {}
    for b in range(n):
        own = sorted((r for r in rows if h[r] % n == b), key=lambda r: (h[r], str(r[0])))
        order = sharding.fisher_yates(len(own), seed, b).tolist()
        out.update({own[k]: (b, at) for at, k in enumerate(order)})
    return out


@pytest.mark.parametrize("most", [8192, 7])
def test_shards_against_brute_force(spark, most):
    rows = [(i, f"text number {i * 7919 % 1000} of all") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    h = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64(F.lit(sharding.SEED), "doc_id", "text").alias("h")).collect()}
    size = sum(len(t) + 16 for _, t in rows)
    n = -(-size // 5000)
    got = {(r["doc_id"], r["text"]): (r["shard"], r["position"]) for r in sharding.shard(docs, shared_dir(spark, "s"), shard_bytes=5000, max_buckets=most).collect()}
    assert n > 7 and got == shards_by_hand(rows, sharding.SEED, n, h)


def test_equal_records_fill_no_shard(spark):
    same, other = "x" * 84, "y" * 84
    rows = [(None, same)] * 4000 + [(k, other) for k in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), shared_dir(spark, "s"), shard_bytes=20_000).collect()
    sizes = Counter(r["shard"] for r in got)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows) and len(sizes) == 30 and max(sizes.values()) < 1.35 * 200
    assert all(sum(r["text"] == same for r in got if r["shard"] == k) > 80 for k in sizes)


@pytest.mark.parametrize("html", ["<b>" * 20_000 + "x" + "</i>" * 20_000, "<div>" * 50_000, "<p>" * 50_000 + "</div>" * 50_000])
def test_unclosed_pages_are_parsed_in_time(html):
    began = time.time()
    htmlextract.parse(html)
    assert time.time() - began < 20


def test_tags_without_a_start_are_passed_over():
    page = htmlextract.parse("<div><p>a</i></p></b>b</div>c")
    assert list(page.texts.values()) == ["a", "b", "c"] and [page.depth[k] for k in page.texts] == [2, 1, 0]


def test_html_precision_and_recall_apart_and_without_marks(spark, tiny):
    pages = read_table(spark, tiny.replace("sf0.001", "sf0.01"), "pages")
    half = F.pmod(F.xxhash64(F.lit(8), "page_id"), F.lit(2))
    model = htmlextract.train(pages.filter(half == 0))
    rename = lambda h: h.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")
    hit = taken = want = 0
    for r in pages.filter(half == 1).collect():
        marked, bare = htmlextract.parse(r["html"]), htmlextract.parse(rename(r["html"]))
        content = model.marginals(htmlextract.Forest([bare])) >= 0.5
        assert list(marked.texts) == list(bare.texts)
        for node, text in bare.texts.items():
            hit += len(text) * bool(content[node] and marked.marked[node])
            taken += len(text) * bool(content[node])
            want += len(text) * bool(marked.marked[node])
    assert hit >= 0.97 * taken and hit >= 0.97 * want and taken < 0.96 * sum(len(x) for r in pages.filter(half == 1).collect() for x in htmlextract.parse(r["html"]).texts.values())


def test_an_index_has_as_many_shards_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(hashindex, "SHARD_ROWS", 700)
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), F.lit(1 << 40).alias("n"))
    index = hashindex.build(df.unionByName(df), {"n": ("<u4", "sum")}, "t")
    assert index.n_shards == 15 and len(index.sizes) == 15 and sum(index.sizes.values()) == 5000
    asked = df.select("h").unionByName(spark.range(100).select(F.lit(None).cast("bigint").alias("h"))).unionByName(spark.range(50).select((F.col("id") + 12345).alias("h")))
    rows = index.probe_rows(asked.withColumn("key", F.lit("k"))).collect()
    assert len(rows) == 5150 and sum(r["found"] for r in rows) == 5000 and {r["n"] for r in rows if r["found"]} == {2**32 - 1} and {r["n"] for r in rows if not r["found"]} == {None}
    assert hashindex.build(df.limit(0), {"n": ("<u4", "sum")}, "t").probe(np.arange(5, dtype=np.uint64))[0].sum() == 0


def test_ids_take_the_bytes_that_the_vocabulary_needs():
    assert tokenstore.id_type({b"a": 65_535}) == np.dtype("<u2") and tokenstore.id_type({b"a": 65_536}) == np.dtype("<u4")


def test_mixing_counts_token_ids_in_the_pipeline(spark, nasty, empty):
    docs = nasty.withColumn("n_ids", F.lit("clash"))
    counted = bpe.with_counts(docs, "n_")
    n = {r["doc_id"]: r["n_"] for r in counted.collect()}
    want = {r["doc_id"]: r["n_tokens"] for r in bpe.encode(docs).collect()}
    assert n == want and counted.columns == [*docs.columns, "n_"] and bpe.with_counts(empty, "n_").collect() == []
    assert corpus_pipeline.mix_sources(spark, docs, "").columns == docs.columns


def test_short_lines_go_and_blank_ones_stay(spark, tiny):
    docs = spark.createDataFrame([(1, "a\n\n  \n" + " " * 30 + "\nb"), (2, "a \n\n  \n" + " " * 30 + "\nc\nb\nc")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs, min_chars=1).collect()}
    assert got == {1: "a\n\n  \n" + " " * 30 + "\nb", 2: "\n  \n" + " " * 30 + "\nc"}


def test_partitions_are_held_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"line {k % 7}\nown line {k}") for k in range(300)], "doc_id bigint, text string").coalesce(1)
    want = Counter(tuple(r) for r in linededup.dedup_lines(docs, min_chars=1).collect())
    monkeypatch.setattr(linededup, "HELD_BYTES", 10)
    assert Counter(tuple(r) for r in linededup.dedup_lines(docs, min_chars=1).collect()) == want


def pipeline_fixture():
    """Documents whose fate is known: toxic ones, disguised ones, shared passages, exact and near copies, nulls, clean ones."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(4, 9))))
    line = lambda n=14: " ".join(word() for _ in range(n))
    rows, toxic, passage = [], set(), line(55)
    for k in range(60):
        text = "\n".join(line() for _ in range(6))
        if k % 6 == 1:
            text += f"\nwhat a {['worthless', 'w0rthless', 'wortthless', 'w o r t h l e s s', 'WORTHLESS!'][k // 6 % 5]} pathetic worthless fool"
            toxic.add(k)
        if k % 10 == 4:
            text += "\n" + passage
        rows.append((k, text, "en", ["web", "books", None][k % 3]))
    near = rows[8][1].split(" ")
    near[3], near[40] = word(), word()
    rows += [(100, rows[2][1], "en", "web"), (101, " ".join(near), "en", "books"), (102, None, "en", "web"), (103, "", "en", "web"), (None, line(), None, "web")]
    learnt = []
    for k in range(200, 240):
        learnt.append((k, f"{line(10)} you worthless {line(10)}", "en", "web"))
        toxic.add(k)
    learnt += [(k, line(20), "en", "books") for k in range(240, 420)]
    return rows + learnt, toxic, {k for k, *_ in learnt}


def test_the_whole_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, toxic, learnt = pipeline_fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in sorted(learnt)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # toxic ones go
    left = [(k, t) for k, t, *_ in rows if k not in toxic]
    # lines that an earlier document holds go, and with them documents that had nothing else
    seen, kept = set(), []
    for k, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, stay = [] if t is None else t.split("\n"), []
        for x in lines:
            key = x.strip(" ")
            if key not in seen or not key.strip():
                stay.append(x)
            seen.add(key)
        kept.append((k, t if len(stay) == len(lines) else "\n".join(stay), len(lines) - len(stay)))
    kept = [(k, t) for k, t, gone in kept if not gone or t.strip()]
    # near copies, by text or by former text
    before, hashes, marks = {k: t for k, t, *_ in rows}, simhash._WordHashes(), []
    for k, t in kept:
        for form in {t, before[k]} if k is not None else ():
            f = None if form is None else simhash.simhash(form, hashes)
            if f is not None:
                marks.append((k, f))
    near = {}
    for a, b in itertools.combinations(marks, 2):
        if int(np.bitwise_count(a[1] ^ b[1]).sum()) <= simhash.RADIUS and a[0] != b[0]:
            near.setdefault(max(a[0], b[0]), set()).add(min(a[0], b[0]))
    final = {(k, t) for k, t in kept if k not in near and t is not None}
    tok = Tokenizer.from_file(bpe.VOCAB)
    tok.encode_special_tokens = True
    want = Counter((k, tuple(tok.encode(t, add_special_tokens=False).ids)) for k, t in final)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert 100 not in dict(final) and 101 not in dict(final) and None in dict(final) and 103 in dict(final) and len(final) > 200
    # sources in training order, by the tokens of each
    mixed = mixing.mix(bpe.with_counts(spark.createDataFrame([(k, t, next((r[3] for r in rows if r[0] == k), None)) for k, t in final], "doc_id bigint, text string, source string"), "size"), size_col="size", whole=True).collect()
    total = Counter()
    for r in mixed:
        total[r["source"] or ""] += max(0, r["size"])
    grid, knots = np.linspace(0, 1, 20_001), [t for t, _ in mixing.SCHEDULE]
    power = {s: np.array([float(n) ** e for _, e in mixing.SCHEDULE]) for s, n in total.items()}
    every = sum(power.values())
    area = {s: np.concatenate([[0], np.cumsum(np.convolve(np.interp(grid, knots, p / every), [0.5, 0.5], "valid") * np.diff(grid))]) for s, p in power.items()}
    for s, n in total.items():
        at = 0
        for r in sorted((r for r in mixed if (r["source"] or "") == s), key=lambda r: r["position"]):
            y = (at + r["size"] / 2) / n * area[s][-1]
            at += r["size"]
            assert r["position"] == pytest.approx(float(np.interp(y, area[s], grid)), abs=2e-3)


def test_an_encoder_keeps_so_many_bytes_and_no_more():
    rng = np.random.default_rng(4)
    chunk = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    arrays, top = vocab.load_vocab(bpe.VOCAB), 0
    enc, fresh = vocab.Encoder(arrays, keep=100_000), vocab.Encoder(arrays)
    for _ in range(12):
        texts = [" ".join(chunk(int(n)) for n in (5, 800, 9, 7)) for _ in range(20)]
        assert enc.encode_texts(texts) == fresh.encode_texts(texts)
        top = max(top, sum(len(k) + len(v) for kept in (enc.first, enc.rest) for k, v in kept.items()))
    assert 20_000 < top < 160_000


def test_token_ids_keep_the_training_order(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 37), f"s{i % 5}", "clash") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, position string").repartition(3)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    want = [r["doc_id"] for r in mixing.mix(bpe.with_counts(docs, "size"), size_col="size", whole=True).collect()]
    mixed.write.parquet(f"{tmp_path}/mixed")
    mixed.write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/cut")
    for table in (mixed, spark.read.parquet(f"{tmp_path}/mixed"), spark.read.parquet(f"{tmp_path}/cut")):
        got = corpus_pipeline.to_token_ids(spark, table, "").collect()
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == want != sorted(want)
        assert len({r["position"] for r in got}) == len(rows)
    plain = corpus_pipeline.to_token_ids(spark, docs, "").orderBy("position").collect()
    assert [r["doc_id"] for r in plain] != want
