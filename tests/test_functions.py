"""Goldens and properties of single functions."""

import ipaddress
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from argosieve.functions import crypto, globs
from argosieve.functions.scanner import scan
from argosieve.operators.extract import BOUNDARY, TYPES, choose, extract
from argosieve.operators.lookup import lookup_ip, lookup_string
from argosieve.plans.indicators import build
from argosieve.sources.feeds import rows_feed

GLOBS = [
    ("*.txt", [".txt", "my.file.txt"], ["txt", "file.pdf"]), ("hello*world", ["helloworld", "hello beautiful world"], ["hello"]), ("file?.txt", ["file1.txt", "file?.txt"], ["file.txt", "file10.txt"]), ("???", ["abc"], ["ab", "abcd"]),
    ("file[123].txt", ["file2.txt"], ["file4.txt"]), ("[a-zA-Z]", ["a", "Z"], ["0", "!"]), ("file[!0-9].txt", ["fileA.txt"], ["file0.txt"]), ("[^abc]", ["d"], ["a"]), ("[]a]x", ["]x", "ax"], ["bx"]), (r"a\*b", ["a*b"], ["axb"]), ("é?", ["éx", "éß"], ["é"]),
]


@pytest.mark.parametrize("pattern, yes, no", GLOBS)
def test_globs(pattern, yes, no):
    assert all(globs.match(pattern, t) for t in yes) and not any(globs.match(pattern, t) for t in no)


@pytest.mark.parametrize("pattern", ["[unclosed", "file\\", "[z-a]"])
def test_bad_globs(pattern):
    assert not globs.is_valid(pattern)


@given(st.text("ab*?[]!-\\.é", max_size=8), st.text("abAB.é-]", max_size=6), st.booleans())
@settings(max_examples=400, deadline=None)
def test_regex_agrees_with_matcher(pattern, text, insensitive):
    import re

    p = globs.plan(pattern, insensitive)
    if not p["valid"]:
        return
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), p["regex"]).replace("\\z", "\\Z")
    t = text.translate(globs._ASCII_LOWER) if insensitive else text
    assert (re.search(python, t) is not None) == globs.match(pattern, text, insensitive)
    if p["sure"] and p["anchor_kind"] != "none":
        hit = {"prefix": t.startswith(p["anchor"]), "suffix": t.endswith(p["anchor"]), "inner": p["anchor"] in t}[p["anchor_kind"]]
        assert hit == globs.match(pattern, text, insensitive)


ITEMS = [
    ("Traffic from 10.0.0.5 to 172.16.0.10", {("IPv4", "10.0.0.5"), ("IPv4", "172.16.0.10")}), ("Not IPs: 256.1.1.1 1.2.3.999 1.2.3", set()), ("2025.36.0.72591908 460.1.1.2 26.0..26.0 01.2.3.4 1.2.3.4.5 1.2.3.4.", set()),
    ("Address 2001:0db8::1 connects to 2606:2800:220:1::248", {("IPv6", "2001:db8::1"), ("IPv6", "2606:2800:220:1::248")}), ("e::f ce::A FEC0050519FB::c 7::31BD71E4 fe80::1 fe80::dead:beef", set()),
    ("Go to https://www.example.com/path", {("Domain", "www.example.com")}), ("host=api.example.com method=GET", {("Domain", "api.example.com")}), ("blah.community. stuff example.com. EXAMPLE.COM .app", set()), ("see co.uk now", {("Domain", "co.uk")}),
    ("2024-01-15 user@example.com from 10.1.2.3 accessed api.test.com", {("Email", "user@example.com"), ("IPv4", "10.1.2.3"), ("Domain", "example.com"), ("Domain", "api.test.com")}), ("s...@example.zzzz .@nothing user@192.168.1.222x", set()),
    ("MD5=5d41402abc4b2a76b9719d911017c592", {("MD5", "5d41402abc4b2a76b9719d911017c592")}), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", {("Bitcoin", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")}), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7Divf00", set()),
    ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", {("Ethereum", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed")}), ("0x5aAeb6053f3e94c9b9a09f33669435e7ef1beaed", set()), ("", set()), ("a,b;c", set()),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ITEMS)] + [(-1, None)], "i int, text string")
    got = {}
    for r in extract(df, "text", TYPES).collect():
        got.setdefault(r["i"], set()).add((r["item_type"], r["value"]))
    for i, (text, want) in enumerate(ITEMS):
        assert got.get(i, set()) == want, text
        assert {(k, v) for k, _, v, _, _ in scan(text.encode())} == want, text
    assert -1 not in got


def test_spans_count_bytes():
    text = "é 10.0.0.5"
    (_, raw, _, a, b), = scan(text.encode())
    assert text.encode()[a:b].decode() == raw == "10.0.0.5"


def test_table_function(spark):
    from argosieve.functions.scanner import register

    register(spark)
    rows = spark.sql("SELECT t.item_type, t.value FROM VALUES ('at 10.0.0.5 now') AS v(x), LATERAL extract_indicators(x) t").collect()
    assert [tuple(r) for r in rows] == [("IPv4", "10.0.0.5")]


def test_choose():
    assert choose("ip") == ("IPv4", "IPv6") and "Bitcoin" not in choose("-crypto") and choose("ips,-ipv6") == ("IPv4",)
    with pytest.raises(ValueError, match="unknown"):
        choose("nothing")


def test_keccak():
    assert crypto.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert crypto.keccak256(b"a" * 135).hex() != crypto.keccak256(b"a" * 136).hex()


def test_checksums_of_many_tokens_are_those_of_each(monkeypatch):
    import random

    rng = random.Random(5)
    texts = [rng.randbytes(n) for n in range(300)] + [rng.randbytes(69) for _ in range(300)]
    assert crypto.keccak256_all(texts) == [crypto.keccak256(t) for t in texts] and crypto.keccak256_all([]) == []
    sound = [crypto.monero_address(bytes([k])) for k in range(20)]
    broken = [t[:40] + ("x" if t[40] != "x" else "y") + t[41:] for t in sound]
    assert crypto.monero_all([*sound, *broken, "", "4" * 95, sound[0][:-1] + "0"]) == [True] * 20 + [False] * 23
    mixed = "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
    assert crypto.ethereum_all([mixed, mixed.replace("F3E", "f3E"), mixed.lower(), "0x", "", "1x" + mixed[2:]] * 9) == [True, False, True, False, False, False] * 9
    tried = []
    monkeypatch.setattr(crypto, "keccak256", lambda data: tried.append(data) or b"")
    crypto.monero_all([*sound, *broken])
    assert not tried, "a hash was taken token by token"


def test_longest_prefix_against_brute_force(spark):
    rng = random.Random(5)
    nets = [f"{ipaddress.IPv4Address(rng.getrandbits(4) << 28 | rng.getrandbits(6))}/{rng.choice([0, 1, 4, 8, 24, 27, 30, 31, 32])}" for _ in range(60)] + ["2001:db8::/32", "2001:db8::/64", "::/0", "2001:db8::1"]
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(4) << 28 | rng.getrandbits(6))) for _ in range(200)] + ["2001:db8::1", "2001:db8::2", "2001:db8:1::", "fe80::1", "2001:db9::"]
    iset = build(rows_feed(spark, [(n, json.dumps({"i": i})) for i, n in enumerate(nets)]))
    got = {r["text"]: (r["matched_prefix_len"], json.loads(r["data_json"])["i"]) for r in lookup_ip(spark.createDataFrame([(x,) for x in ips], "q string"), "q", iset).collect()}

    def wide(n, v):
        return (int(n), v) if v == 6 else (int(n), v)

    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]
    for text in ips:
        a = ipaddress.ip_address(text)
        best = None
        for i, n in enumerate(parsed):
            covers = a in n if n.version == a.version else n.version == 6 and n.prefixlen <= 96 and int(n.network_address) >> (128 - n.prefixlen) == 0 if n.prefixlen else n.version == 6
            if covers:
                length = n.prefixlen + (96 if n.version == 4 else 0)
                if best is None or length >= best[0]:
                    best = (length, i)
        if best is None:
            assert text not in got
        else:
            assert got[text] == (max(0, best[0] - (96 if a.version == 4 else 0)), best[1]), text


def test_strings_and_globs_together(spark):
    iset = build(rows_feed(spark, [("literal:evil.com", '{"a":1}'), ("*.com", '{"b":2}'), ("literal:evil.com", '{"a":3}'), ("*file*", "{}"), ("test*", "{}"), ("*", "{}"), ("?", "{}")]))
    got = {r["text"]: list(zip(r["pattern_ids"], r["data"])) for r in lookup_string(spark.createDataFrame([("evil.com",), ("testfile",), ("a",), ("",), (None,)], "q string"), "q", iset).collect()}
    assert got["evil.com"] == [(-1, '{"a":3}'), (0, '{"b":2}'), (3, "{}")]
    assert [i for i, _ in got["testfile"]] == [1, 2, 3] and [i for i, _ in got["a"]] == [3, 4] and [i for i, _ in got[""]] == [3]


LARGE = {
    "labels": ("a." * 100_000 + "com", [("Domain", 200_003)]), "hex": ("0a" * 500_000, []), "no boundary": ("x-y_z" * 200_000, []), "dots": ("." * 1_000_000, []), "boundaries": (" ,;" * 300_000, []), "colons": ("a:" * 400_000 + ":b", []),
    "marks": ("a@b.com@" * 100_000, [("Email", 7)]), "names": ("w.example.com " * 50_000, [("Domain", 13)]), "local": ("a." * 300_000 + "@example.com", [("Domain", 11), ("Email", 600_012)]), "words": ("plain words of a text. " * 50_000, []),
}


@pytest.mark.parametrize("name", list(LARGE))
def test_large_texts_are_read_in_time(spark, name):
    text, want = LARGE[name]
    began = time.time()
    rows = extract(spark.createDataFrame([(text,)], "text string"), "text", TYPES).selectExpr("item_type", "length(raw) n").distinct().collect()
    assert sorted(set(map(tuple, rows)) & set(want)) == want and (want or not rows)
    assert time.time() - began < 30
    began = time.time()
    assert {(k, len(raw)) for k, raw, _, _, _ in scan(text.encode())} == set(map(tuple, rows))
    assert time.time() - began < 30


WORDS = ["10.0.0.5", "1.2.3.4.", "word.", "a.b.com", "x.com", "co.uk", "u@x.com", "u@v@x.com", "d41d8cd98f00b204e9800998ecf8427e", "2001:db8::1", "::", "a" * 26, "-x.com", "é.com", "0x" + "a" * 40, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "..", "", "x"]


@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(list(" ,;@=:/") + ["", ". "])), max_size=12))
@settings(max_examples=150, deadline=None)
def test_expressions_agree_with_the_scanner_of_bytes(parts):
    """The cut of dull tokens takes no item: the scanner finds the same in what is left."""
    import re

    text = "".join(w + s for w, s in parts)
    python = lambda p: p.replace(r"\x{80}-\x{10ffff}", "\x80-\U0010ffff")
    edge = python(BOUNDARY)
    few = re.sub(rf"[{edge}](?:[^{edge}.]{{0,25}}+\.*+[{edge}])*+", " ", text)
    mine = lambda t: sorted((k, raw) for k, raw, _, _, _ in scan(t.encode()) if k not in ("Email", "IPv6"))
    assert mine(few) == mine(text)
    mail = edge.removesuffix("@=") + "="
    some = re.sub(rf"[{mail}](?:[^{mail}@]*+[{mail}])*+", " ", text)
    mails = lambda t: sorted(raw for k, raw, _, _, _ in scan(t.encode()) if k == "Email")
    assert mails(some) == mails(text)


def test_spans_of_a_table(spark):
    texts = ["é 10.0.0.5 ü", "see a.example.com, u@example.com and 2001:0db8::1.", None, "", "10.0.0.5 10.0.0.5"]
    df = spark.createDataFrame(list(enumerate(texts)), "start int, text string")
    rows = extract(df.withColumnRenamed("start", "k"), "text", TYPES, spans=True).collect()
    assert all(texts[r["k"]].encode()[r["start"] : r["end"]].decode() == r["raw"] for r in rows) and len(rows) == 7
    plain = extract(df.withColumnRenamed("start", "k"), "text", TYPES).collect()
    assert sorted((r["k"], r["item_type"], r["value"]) for r in plain) == sorted((r["k"], r["item_type"], r["value"]) for r in rows)
    assert extract(df, "text", ("IPv4",), spans=True).columns == ["item_type", "raw", "value", "start", "end"]


def test_items_inside_words(spark):
    text = "x10.0.0.5y 1.2.3.256 1.2.3.4.5 zu@example.com! id_0x" + "a" * 40 + "z 0" + "1.2.3.4"
    found = {(k, raw) for k, raw, _, _, _ in scan(text.encode(), boundaries=False)}
    assert found == {("IPv4", "10.0.0.5"), ("IPv4", "1.2.3.4"), ("Email", "zu@example.com"), ("Domain", "example.com"), ("Ethereum", "0x" + "a" * 40)}
    df = spark.createDataFrame([(text,)], "text string")
    assert {(r["item_type"], r["raw"]) for r in extract(df, "text", TYPES, boundaries=False).collect()} == found
    assert {(r["item_type"], r["raw"]) for r in extract(df, "text", TYPES, boundaries=False, spans=True).collect()} == found
    assert not {k for k, *_ in scan(text.encode())} & {"IPv4", "Ethereum"}


def test_monero_addresses():
    address = crypto.monero_address(b"any")
    assert crypto.monero(address) and address[0] == "4" and not crypto.monero(address[:-1] + ("2" if address[-1] != "2" else "3"))
    assert ("Monero", address) in {(k, raw) for k, raw, _, _, _ in scan(f"to <{address}>".encode())}


def test_lookups_in_several_sets_are_those_in_each(spark):
    from argosieve.operators.lookup import lookup, lookup_many

    rows = [
        [("10.0.0.0/8", '{"a":1}'), ("literal:Evil.com", '{"a":2}'), ("*.com", '{"a":3}')], [("::/0", '{"b":1}'), ("10.1.0.0/16", '{"b":2}')], [("EVIL.com", '{"c":1}'), ("*vil*", '{"c":2}'), ("[x-z]?", "{}")], [("2.2.2.2", "{}")],
    ]
    sets = [build(rows_feed(spark, r), database_id=f"s{i}", insensitive=i == 2) for i, r in enumerate(rows)]
    q = spark.createDataFrame([(x,) for x in ("10.1.2.3", "10.2.2.2", "::5", "::1.2.3.4", "2.2.2.2", "evil.com", "Evil.com", "x1", "10.0.0.0/8", None, "", "evil.com")], "q string")
    each = [tuple(map(str, r)) for s in sets for r in lookup(q, "q", s).collect()]
    many = lookup_many(q, "q", sets)
    assert sorted(tuple(map(str, r)) for r in many.collect()) == sorted(each) and len(each) > 8
    assert not [r for r in each if r[0] == "::1.2.3.4" and r[1] in ("s0", "s3")]
    only = lookup_many(q, "q", [sets[3]])._jdf.queryExecution().optimizedPlan().toString()
    assert "regex" not in only and "norm" not in only
    nothing = build(rows_feed(spark, []), database_id="none")
    assert lookup_many(q, "q", [nothing]).collect() == []
