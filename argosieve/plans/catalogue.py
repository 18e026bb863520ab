"""The engine's operators as named queries over the tables, with equivalent SQL where SQL can express them.

Every query reads its tables whole. Indicator sets are made from ``supplier`` and ``nation``, addresses from ``customer``
keys, so that hits and misses grow with the tables.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.functions.crypto import monero_address
from argosieve.functions.ip import OCTET, format_cidr, long_to_ipv4
from argosieve.functions.suffixes import decisive, load
from argosieve.functions.synth import synthetic
from argosieve.operators import lookup as lk
from argosieve.operators.extract import choose, counts, extract, unique
from argosieve.operators.quality import threatdb_violations
from argosieve.operators.values import flatten, format_bytes, format_number, format_rate, path_get
from argosieve.plans.indicators import IndicatorSet, build, builder_stats
from argosieve.plans.scan import items_json, scan, scan_stats, to_ndjson
from argosieve.plans.shared import shared_dir, spread, write_each
from argosieve.sources import misp
from argosieve.sources.feeds import canonical_json, coerce, concat_feeds, csv_feed, entries_from_table, json_feed, text_feed
from argosieve.sources.logs import log_lines
from argosieve.sources.mmdb import export_mmdb, read_mmdb
from argosieve.streaming.follow import Reloading, follow, tail

BASE = 10 << 24
#: An address with a sound checksum, made from a hash.
MONERO = monero_address(b"argosieve")
HASH_TYPES = ("MD5", "SHA1", "SHA256", "SHA384", "SHA512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else _lit(x) if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


# ---- extraction

_SPLIT = r"""[ \t\n\r/,;:()\[\]{}<>"''@=]"""
_MAIL_SPLIT = _SPLIT.replace("@", "")


def _public_sql(labels: str, text: str) -> str:
    """SQL for ``ends_in_suffix`` of a name that ``labels`` holds as a list."""
    tests = []
    for n, some in decisive(load()).items():
        tail = f"array_to_string({labels}[-{n}:], '.')"
        tests.append(f"({tail} IN ({', '.join(map(_lit, some))}) AND length({text}) - length({tail}) > 1)")
    return "(" + " OR ".join(tests) + ")"


def _token_sql(where: str, kind: str, source: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    return f"SELECT {key}, '{kind}' AS item_type, t AS value FROM (SELECT {key}, unnest(regexp_split_to_array({col}, '{_SPLIT}')) AS t FROM {source}) WHERE {where}"


_IPV4_SQL = _token_sql(rf"regexp_full_match(t, '{OCTET}(\.{OCTET}){{3}}')", "IPv4")
_HASH_SQL = {k: _token_sql(f"regexp_full_match(t, '[0-9a-fA-F]{{{n}}}')", k) for k, n in zip(HASH_TYPES, (32, 40, 64, 96, 128))}


def _domain_sql(source: str = "documents", key: str = "doc_id", col: str = "text", min_labels: int = 2) -> str:
    shape = r"[^.\-]([^.]*[^.\-])?(\.[^.\-]([^.]*[^.\-])?){%d,}" % max(1, min_labels - 1)
    run = r"[0-9A-Za-z.\-\x{80}-\x{10ffff}]+"
    inner = _token_sql(f"contains(t, '.') AND regexp_full_match(t, '{run}') AND regexp_full_match(t, '{shape}')", "Domain", source, key, col)
    return f"SELECT {key}, item_type, value FROM (SELECT *, string_split(value, '.') AS ls FROM ({inner})) WHERE {_public_sql('ls', 'value')}"


_EMAIL_SQL = f"""
SELECT doc_id, 'Email' AS item_type, l || '@' || dm AS value FROM (
  SELECT doc_id, ps[i] AS l, ps[i + 1] AS dm, string_split(ps[i + 1], '.') AS ls FROM (
    SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM (
      SELECT doc_id, string_split(t, '@') AS ps FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{_MAIL_SPLIT}')) AS t FROM documents) WHERE contains(t, '@'))))
WHERE regexp_full_match(l, '[A-Za-z0-9._+\\-]+') AND regexp_full_match(dm, '[A-Za-z0-9.\\-]+') AND NOT contains(l, '..') AND regexp_matches(l, '[A-Za-z]')
  AND contains(dm, '.') AND {_public_sql("ls", "dm")}
"""
_COMMON_TYPES = ("Domain", "Email", "IPv4", *HASH_TYPES)
_COMMON_SQL = " UNION ALL ".join(f"({s})" for s in (_domain_sql(), _EMAIL_SQL, _IPV4_SQL, *_HASH_SQL.values()))


def _doc_items(*types: str, min_labels: int = 2):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return extract(docs, "text", types, min_labels).select("doc_id", "item_type", "value")

    return run


def _url_items(min_labels: int = 2):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ("Domain",), min_labels).select("page_id", "item_type", "value")

    return run


def _all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "documents").select("text")), "text", _COMMON_TYPES)


CHECKED_TOKENS = [
    "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "1A1zP1eP5QGefi2DMPTfTL5SLmv7Divf00", "3Cbq7aT1tY8kMxWLbitaG7yT6bPbKChq64", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq",
    "0x5aeda56215b167893e80b4fe645ba6d5bab767de", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0x5aAeb6053f3e94c9b9a09f33669435e7ef1beaed", "2001:0db8::1", "2606:2800:220:1::248", "fe80::dead:beef", "e::f",
]
_CHECKED = {"Bitcoin": {0, 2, 3}, "Ethereum": {4, 5}, "IPv6": {7, 8}}


def extract_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with checksums and IPv6, planted in a line for each customer, found again."""
    words = F.array(*[F.lit(w) for w in CHECKED_TOKENS])
    lines = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.concat(F.col("c_name"), F.lit(" sent <"), F.get(words, (F.col("c_custkey") % len(CHECKED_TOKENS)).cast("int")), F.lit(">, ok")).alias("line"))
    return extract(lines, "line", ("IPv6", "Bitcoin", "Ethereum", "Monero")).select("c_custkey", "item_type", "value")


_CHECKED_SQL = f"""SELECT c_custkey, k AS item_type, w AS value FROM customer JOIN {_values([(i, k, "2001:db8::1" if i == 7 else CHECKED_TOKENS[i]) for k, s in _CHECKED.items() for i in sorted(s)], "i, k, w")} ON c_custkey % {len(CHECKED_TOKENS)} = v.i"""


# ---- prefixes


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", long_to_ipv4(F.lit(BASE) + F.col("c_custkey")).alias("ip"))


def prefix_entries(spark: SparkSession, sf_dir: str, step: int = 16, least: int = 20) -> DataFrame:
    """One prefix for each supplier, of ``least`` to 32 bits; host bits are left to the engine to clear."""
    s = table(spark, sf_dir, "supplier")
    key = F.concat(long_to_ipv4(F.lit(BASE) + F.col("s_suppkey") * step), F.lit("/"), (F.lit(least) + F.col("s_suppkey") % (33 - least)).cast("string"))
    return s.select(F.col("s_suppkey").alias("seq"), key.alias("key"), F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("data_json"))


_PAYLOAD = """'{"name":"' || s_name || '","nation":' || s_nationkey || '}'"""


def _dotted(n: str) -> str:
    return " || '.' || ".join(f"(({n} >> {s}) & 255)" for s in (24, 16, 8, 0))


def _prefix_sql(step: int = 16, least: int = 20) -> str:
    return f"""
p0 AS (SELECT s_suppkey AS seq, {least} + s_suppkey % {33 - least} AS len, CAST({BASE} + s_suppkey * {step} AS BIGINT) AS a, {_PAYLOAD} AS data_json FROM supplier),
p AS (SELECT len, (a >> (32 - len)) << (32 - len) AS net, arg_max(data_json, seq) AS data_json FROM p0 GROUP BY 1, 2),
c AS (SELECT c_custkey, CAST({BASE} + c_custkey AS BIGINT) AS ip FROM customer),
h AS (SELECT c.c_custkey, c.ip, p.* FROM c JOIN p ON (c.ip >> (32 - p.len)) << (32 - p.len) = p.net),
best AS (SELECT c_custkey, ip, max(len) AS len, arg_max(net, len) AS net, arg_max(data_json, len) AS data_json FROM h GROUP BY 1, 2)
"""


def lpm_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = addresses(spark, sf_dir)
    hits = lk.lookup_ip(ips, "ip", build(prefix_entries(spark, sf_dir)))
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", "ip", F.col("matched_prefix_len").cast("bigint").alias("matched_prefix_len"), "network", "data_json")


_LPM_SQL = f"WITH {_prefix_sql()} SELECT c_custkey, {_dotted('ip')} AS ip, len AS matched_prefix_len, {_dotted('net')} || '/' || len AS network, data_json FROM best"


def lpm_tree_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = addresses(spark, sf_dir)
    hits = lk.lookup_ip(ips, "ip", build(prefix_entries(spark, sf_dir)), tree_depth=True)
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", F.col("matched_prefix_len").cast("bigint").alias("matched_prefix_len"), F.col("tree_prefix_len").cast("bigint").alias("tree_prefix_len"))


_TREE_SQL = f"""WITH {_prefix_sql()},
nodes AS (SELECT DISTINCT d, net >> (32 - d) AS bits FROM (SELECT net, unnest(range(1, len)) AS d FROM p)),
deep AS (SELECT best.c_custkey, max(nodes.d) AS d FROM best JOIN nodes ON best.ip >> (32 - nodes.d) = nodes.bits GROUP BY 1)
SELECT best.c_custkey, best.len AS matched_prefix_len, 1 + coalesce(deep.d, 0) AS tree_prefix_len FROM best LEFT JOIN deep USING (c_custkey)"""


def lpm_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers on few prefixes: of entries that repeat, the last one counts."""
    ips = addresses(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    key = F.concat(long_to_ipv4(F.lit(BASE) + (F.col("s_suppkey") % 8) * 64), F.lit("/26"))
    entries = s.select(F.col("s_suppkey").alias("seq"), key.alias("key"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("data_json"))
    hits = lk.lookup_ip(ips, "ip", build(entries))
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", "network", "data_json")


_DUP_SQL = f"""WITH p AS (SELECT {BASE} + (s_suppkey % 8) * 64 AS net, '{{"name":"' || arg_max(s_name, s_suppkey) || '"}}' AS data_json FROM supplier GROUP BY 1)
SELECT c_custkey, {_dotted("CAST(net AS BIGINT)")} || '/26' AS network, data_json FROM customer JOIN p ON (({BASE} + c_custkey) >> 6) << 6 = net"""


def lpm_default_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of no bits covers what no longer one does."""
    ips = addresses(spark, sf_dir)
    default = spark.createDataFrame([(0, "0.0.0.0/0", '{"name":"default"}')], "seq bigint, key string, data_json string")
    hits = lk.lookup_ip(ips, "ip", build(concat_feeds([default, prefix_entries(spark, sf_dir)])))
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", F.col("matched_prefix_len").cast("bigint").alias("matched_prefix_len"), "data_json")


_DEFAULT_SQL = f"""WITH {_prefix_sql()} SELECT c.c_custkey, coalesce(best.len, 0) AS matched_prefix_len, coalesce(best.data_json, '{{"name":"default"}}') AS data_json FROM c LEFT JOIN best USING (c_custkey)"""

V6_ROWS = [("2001:db8::/64", 64), ("2001:db8::1", 128), ("2001:db8::/96", 96)]


def lpm_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 addresses made from customer keys, in a set of three nested prefixes.

    A group of an address has 16 bits, so a key takes two: its last 32 bits.
    """
    group = lambda shift: F.lower(F.hex(F.shiftright("c_custkey", shift).bitwiseAND(0xFFFF)))
    tail = F.concat(group(16), F.lit(":"), group(0))
    ips = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("2001:db8::"), tail)).otherwise(F.concat(F.lit("2001:db8::1:"), tail)).alias("ip"))
    entries = spark.createDataFrame([(i, k, json.dumps({"level": n}, separators=(",", ":"))) for i, (k, n) in enumerate(V6_ROWS)], "seq bigint, key string, data_json string")
    hits = lk.lookup_ip(ips, "ip", build(entries))
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", F.col("matched_prefix_len").cast("bigint").alias("matched_prefix_len"), "network", "data_json")


_V6_SQL = """SELECT c_custkey, n AS matched_prefix_len, '2001:db8::/' || n AS network, '{"level":' || n || '}' AS data_json FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 96 ELSE 64 END AS n FROM customer)"""


def cidr_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = addresses(spark, sf_dir).withColumn("n", (F.col("c_custkey") % 33).cast("int"))
    return ips.select("c_custkey", format_cidr(F.col("ip"), F.col("n")).alias("cidr"), format_cidr(F.concat(F.lit("host-"), F.col("c_custkey").cast("string")), F.col("n")).alias("other"))


_CIDR_SQL = f"""SELECT c_custkey, {_dotted("net")} || '/' || n AS cidr, 'host-' || c_custkey || '/' || n AS other
FROM (SELECT c_custkey, n, CAST((({BASE} + c_custkey) >> (32 - n)) << (32 - n) AS BIGINT) AS net FROM (SELECT c_custkey, c_custkey % 33 AS n FROM customer))"""


def lookup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.found(addresses(spark, sf_dir), "ip", build(prefix_entries(spark, sf_dir, least=28))).select("c_custkey")


def lookup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.not_found(addresses(spark, sf_dir), "ip", build(prefix_entries(spark, sf_dir, least=28))).select("c_custkey")


# ---- strings and globs


def name_entries(spark: SparkSession, sf_dir: str, upper: bool = False) -> DataFrame:
    """Customers' names from the suppliers' keys: each a literal."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("literal:Customer#"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 9, "0"))
    return s.select(F.col("s_suppkey").alias("seq"), (F.concat(F.lit("literal:"), F.upper(F.substring(name, 9, 99))) if upper else name).alias("key"), F.to_json(F.struct(F.col("s_nationkey").alias("n"))).alias("data_json"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name")


def _literal(upper: bool, insensitive: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = _names(spark, sf_dir)
        hits = lk.lookup_literal(names, "c_name", build(name_entries(spark, sf_dir, upper), insensitive=insensitive))
        return names.join(hits, names["c_name"] == hits["text"]).select("c_custkey", "key", "data_json")

    return run


def _literal_sql(upper: bool, insensitive: bool) -> str:
    key = "'Customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0')"
    key = f"upper({key})" if upper else key
    on = "lower(c_name) = lower(key)" if insensitive else "c_name = key"
    return f"""SELECT c_custkey, key, data_json FROM customer JOIN (SELECT {key} AS key, '{{"n":' || s_nationkey || '}}' AS data_json FROM supplier) ON {on}"""


GLOBS = {
    "glob_suffix": (["*77", "*.example.com", "*0"], ["%77", None, "%0"]),
    "glob_prefix": (["Customer#00000001*", "Customer#0000*", "Supplier*"], ["Customer#00000001%", "Customer#0000%", None]),
    "glob_contains": (["*#0000000*", "*13*", "*nothing*"], ["%#0000000%", "%13%", None]),
    "glob_single": (["Customer#0000000??", "Customer#?????????", "?"], ["Customer#0000000__", "Customer#_________", None]),
}
REGEX_GLOBS = {
    "glob_class": [("Customer#*[0-3]", "Customer#.*[0-3]"), ("*[13579]5", ".*[13579]5"), ("[a-z]*", "[a-z].*")],
    "glob_negated": [("*[!0-8]", ".*[^0-8]"), ("*[^135]7", ".*[^135]7"), ("[!C]*", "[^C].*")],
    "glob_escape": [(r"Customer\#*9", "Customer#.*9"), (r"*\*", r".*\*"), (r"\C*[5]", "C.*5")],
    "glob_short": [("C*", "C.*"), ("*?-?*", ".*.-..*"), ("*", ".*"), ("*9*9*", ".*9.*9.*")],
}
CI_GLOBS = [("CUSTOMER#*1", "customer#.*1"), ("*OMER#00000000[A-Z]", "[^a-z]*omer#00000000[a-z]"), ("*R#*5", ".*r#.*5")]


def _glob_entries(spark: SparkSession, patterns: list[str]) -> DataFrame:
    rows = [(i, "glob:" + p, json.dumps({"p": i}, separators=(",", ":"))) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "seq bigint, key string, data_json string")


def _glob(patterns: list[str], insensitive: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = _names(spark, sf_dir)
        hits = lk.lookup_glob(names, "c_name", build(_glob_entries(spark, patterns), insensitive=insensitive))
        return names.join(hits, names["c_name"] == hits["text"]).select("c_custkey", "pattern", "data_json")

    return run


def _glob_sql(patterns: list[str], test: list[str], col: str = "c_name", like: bool = False) -> str:
    rows = [(i, p, t, f'{{"p":{i}}}') for i, (p, t) in enumerate(zip(patterns, test)) if t is not None]
    on = f"{col} LIKE v.t" if like else f"regexp_full_match({col}, '(?s)' || v.t)"
    return f"SELECT c_custkey, v.p AS pattern, v.j AS data_json FROM customer JOIN {_values(rows, 'i, p, t, j')} ON {on}"


SUBSTRINGS = ["r#0000001", "99", "omer", "Supplier"]
_SUBSTRING_SQL = "SELECT c_custkey, v.p AS pattern, v.j AS data_json FROM customer JOIN " + _values([(p, f'{{"p":{i}}}') for i, p in enumerate(SUBSTRINGS)], "p, j") + " ON contains(c_name, v.p)"


def literal_union_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact hit first, then all globs."""
    names = _names(spark, sf_dir)
    hits = lk.lookup_string(names, "c_name", build(concat_feeds([name_entries(spark, sf_dir), _glob_entries(spark, ["*7", "Customer#00000*"])])))
    return names.join(hits, names["c_name"] == hits["text"]).select("c_custkey", F.array_join(F.transform("pattern_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("data", ";").alias("payloads"))


_UNION_SQL = f"""WITH h AS (
  SELECT c_custkey, -1 AS id, data_json FROM ({_literal_sql(False, False)})
  UNION ALL SELECT c_custkey, v.i, v.j FROM customer JOIN {_values([(0, "%7", '{"p":0}'), (1, "Customer#00000%", '{"p":1}')], "i, t, j")} ON c_name LIKE v.t)
SELECT c_custkey, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, string_agg(data_json, ';' ORDER BY id) AS payloads FROM h GROUP BY 1"""


# ---- unified lookups and scans


def mixed_set(spark: SparkSession, sf_dir: str, database_id: str = "db") -> IndicatorSet:
    return build(concat_feeds([prefix_entries(spark, sf_dir), name_entries(spark, sf_dir), _glob_entries(spark, ["*77"])]), database_id=database_id)


def _queries_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips, names = addresses(spark, sf_dir), _names(spark, sf_dir)
    return ips.select("c_custkey", F.col("ip").alias("q")).unionByName(names.select("c_custkey", F.col("c_name").alias("q")))


def unified_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries_text(spark, sf_dir)
    hits = lk.lookup(q, "q", mixed_set(spark, sf_dir))
    return q.join(hits, q["q"] == hits["text"], "left").select("c_custkey", "q", F.coalesce("match_type", F.lit("none")).alias("match_type"), F.col("prefix_len").cast("bigint").alias("prefix_len"), F.col("pattern_count").cast("bigint").alias("pattern_count"), F.array_join("data", ";").alias("payloads"))


def _unified_sql() -> str:
    return f"""WITH {_prefix_sql()},
s AS (SELECT c_custkey, -1 AS id, data_json FROM ({_literal_sql(False, False)}) UNION ALL SELECT c_custkey, 0, '{{"p":0}}' FROM customer WHERE c_name LIKE '%77'),
g AS (SELECT c_custkey, count(*) AS n, string_agg(data_json, ';' ORDER BY id) AS d FROM s GROUP BY 1)
SELECT c.c_custkey, {_dotted("c.ip")} AS q, CASE WHEN best.len IS NULL THEN 'none' ELSE 'ip' END AS match_type, best.len AS prefix_len, CAST(NULL AS BIGINT) AS pattern_count, best.data_json AS payloads FROM c LEFT JOIN best USING (c_custkey)
UNION ALL SELECT customer.c_custkey, c_name, CASE WHEN g.n IS NULL THEN 'none' ELSE 'pattern' END, NULL, g.n, g.d FROM customer LEFT JOIN g USING (c_custkey)"""


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries_text(spark, sf_dir)
    hits = lk.first_data(lk.lookup(q, "q", mixed_set(spark, sf_dir)))
    return q.join(hits, q["q"] == hits["text"]).select("c_custkey", "q", F.col("data").alias("payload"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line for each customer, with an address and a name of a host."""
    c = addresses(spark, sf_dir)
    return c.select("c_custkey", F.concat(F.lit("from "), F.col("ip"), F.lit(" to h"), (F.col("c_custkey") % 50).cast("string"), F.lit(".example.com: ok")).alias("line"))


def _host_set(spark: SparkSession, database_id: str, patterns: list[str]) -> IndicatorSet:
    return build(_glob_entries(spark, patterns), database_id=database_id)


def multi_db_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [build(prefix_entries(spark, sf_dir), database_id="nets"), _host_set(spark, "hosts", ["h1*.example.com", "*7.example.com"])]
    found = scan(_log(spark, sf_dir), "line", sets)
    return found.select("c_custkey", "item_type", "matched_text", "database_id", "match_type", F.col("prefix_len").cast("bigint").alias("prefix_len"), "cidr", F.col("pattern_count").cast("bigint").alias("pattern_count"), F.array_join("data", ";").alias("payloads"))


def _scan_sql() -> str:
    return f"""WITH {_prefix_sql()},
t AS (SELECT c_custkey, 'h' || (c_custkey % 50) || '.example.com' AS host FROM customer),
g AS (SELECT c_custkey, host, count(*) AS n, string_agg(v.j, ';' ORDER BY v.i) AS d FROM t JOIN {_values([(0, "h1%.example.com", '{"p":0}'), (1, "%7.example.com", '{"p":1}')], "i, t, j")} ON host LIKE v.t GROUP BY 1, 2)
SELECT c_custkey, 'IPv4' AS item_type, {_dotted("ip")} AS matched_text, 'nets' AS database_id, 'ip' AS match_type, len AS prefix_len, {_dotted("net")} || '/' || len AS cidr, CAST(NULL AS BIGINT) AS pattern_count, data_json AS payloads FROM best
UNION ALL SELECT c_custkey, 'Domain', host, 'hosts', 'pattern', NULL, NULL, n, d FROM g"""


def allowlist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of threats but for items that an allow list holds."""
    found = scan(_log(spark, sf_dir), "line", [_host_set(spark, "threats", ["h*.example.com"])])
    return lk.not_found(found.select("c_custkey", "matched_text"), "matched_text", _host_set(spark, "allowed", ["h[1-3].example.com", "h4?.example.com"]))


_ALLOW_SQL = "SELECT c_custkey, 'h' || (c_custkey % 50) || '.example.com' AS matched_text FROM customer WHERE NOT (c_custkey % 50 BETWEEN 1 AND 3 OR c_custkey % 50 BETWEEN 40 AND 49)"


def document_set(spark: SparkSession) -> IndicatorSet:
    rows = [(0, "0.0.0.0/1", '{"half":"low"}'), (1, "128.0.0.0/1", '{"half":"high"}'), (2, "10.0.0.0/8", '{"half":"private"}')]
    return build(spark.createDataFrame(rows, "seq bigint, key string, data_json string"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: addresses in documents, looked up by longest prefix."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [document_set(spark)])
    return found.select("doc_id", "matched_text", F.col("prefix_len").cast("bigint").alias("prefix_len"), "cidr", F.element_at("data", 1).alias("data_json"))


_SCAN_DOCS_SQL = f"""SELECT doc_id, value AS matched_text, CASE WHEN o = 10 THEN 8 ELSE 1 END AS prefix_len, CASE WHEN o = 10 THEN '10.0.0.0/8' WHEN o < 128 THEN '0.0.0.0/1' ELSE '128.0.0.0/1' END AS cidr,
  CASE WHEN o = 10 THEN '{{"half":"private"}}' WHEN o < 128 THEN '{{"half":"low"}}' ELSE '{{"half":"high"}}' END AS data_json FROM (SELECT *, CAST(split_part(value, '.', 1) AS INT) AS o FROM ({_IPV4_SQL}))"""


def scan_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [document_set(spark)]).withColumn("src", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return to_ndjson(found, "src")


_NDJSON_SQL = f"""SELECT '{{"timestamp":"0.000","source":"doc-' || doc_id || '","matched_text":"' || matched_text || '","match_type":"ip","prefix_len":' || prefix_len || ',"cidr":"' || cidr || '","data":' || data_json || '}}' AS value FROM ({_SCAN_DOCS_SQL})"""


def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_stats(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [document_set(spark)], "doc_id").withColumn("match_rate", F.round("match_rate", 6))


_STATS_SQL = f"""WITH m AS ({_IPV4_SQL}) SELECT count(*) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes, (SELECT count(*) FROM m) AS candidates, (SELECT count(*) FROM m) AS matches,
(SELECT count(DISTINCT doc_id) FROM m) AS lines_with_matches, CAST(CASE WHEN (SELECT count(*) FROM m) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS match_rate FROM documents"""


# ---- keys, cells, payloads

KEYS = [
    ("8.8.8.8", "ip"), ("192.168.0.0/16", "ip"), ("2001:db8::/32", "ip"), ("1.2.3.4/33", "literal"), ("*.evil.com", "glob"), ("evil.com", "literal"), ("literal:*.not-a-glob.com", "literal"), ("glob:no-wildcards.com", "glob"),
    ("ip:10.0.0.0/8", "ip"), ("LITERAL:test.com", "literal"), ("literal:", "literal"), ("[unclosed", "literal"), ("a?c", "glob"), ("file[!0-9].txt", "glob"), ("01.2.3.4", "literal"),
]


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every kind, spread over the parts."""
    keys = F.array(*[F.lit(k) for k, _ in KEYS])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.get(keys, (F.col("p_partkey") % len(KEYS)).cast("int")).alias("key"), F.lit("{}").alias("data_json"))


def classify_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from argosieve.operators.classify import classify

    return classify(_keyed(spark, sf_dir)).select("seq", "key", "kind")


_KEYS_SQL = f"SELECT p_partkey AS seq, k AS key, d AS kind FROM part JOIN {_values([(i, k, d) for i, (k, d) in enumerate(KEYS)], 'i, k, d')} ON p_partkey % {len(KEYS)} = v.i"


def builder_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builder_stats(_keyed(spark, sf_dir))


CELLS = ["12", "-7", "+3", "9223372036854775808", "2.5", "true", "false", "text", "nan", 'say "hi"', "1.2.3", ""]
_CELLS_JSON = ["12", "-7", "3", "9223372036854775808", "2.5", "true", "false", '"text"', '"nan"', '"say \\"hi\\""', '"1.2.3"', '""']


def csv_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.lit(c) for c in CELLS])
    cell = F.get(cells, (F.col("p_partkey") % len(CELLS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell")).select("p_partkey", coerce(F.col("cell")).alias("json"))


_CELLS_SQL = f"SELECT p_partkey, j AS json FROM part JOIN {_values(list(enumerate(_CELLS_JSON)), 'i, j')} ON p_partkey % {len(CELLS)} = v.i"


def table_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as a feed: the column ``key``, and the others, cell by cell, as payload."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("string").alias("nation"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.col("s_name")).alias("label"))
    return entries_from_table(s).select("key", "data_json")


_FEED_SQL = """SELECT s_name AS key, '{' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '"label":"' || s_name || '",' END || '"nation":' || s_nationkey || '}' AS data_json FROM supplier"""


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", path_get(F.col("props"), ["k"]).cast("bigint").alias("k"), path_get(F.col("props"), ["k", "none"]).alias("none"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.to_json(F.struct(F.col("s_name").alias("name"), F.array(F.col("s_nationkey"), F.lit(1)).alias("ns")))
    return flatten(table(spark, sf_dir, "supplier").select("s_suppkey", nested.alias("data_json"))).select("s_suppkey", "path", "depth", "value_type", "value", "size")


_FLATTEN_SQL = """SELECT s_suppkey, '$' AS path, 0 AS depth, 'map' AS value_type, CAST(NULL AS VARCHAR) AS value, 2 AS size FROM supplier
UNION ALL SELECT s_suppkey, '$.name', 1, 'string', s_name, NULL FROM supplier UNION ALL SELECT s_suppkey, '$.ns', 1, 'array', NULL, 2 FROM supplier
UNION ALL SELECT s_suppkey, '$.ns[0]', 2, 'number', CAST(s_nationkey AS VARCHAR), NULL FROM supplier UNION ALL SELECT s_suppkey, '$.ns[1]', 2, 'number', '1', NULL FROM supplier"""


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") * F.col("c_custkey") * 1024
    return table(spark, sf_dir, "customer").select("c_custkey", format_number(n).alias("number"), format_bytes(n).alias("bytes"), format_rate(n).alias("rate"))


_FORMATS_SQL = """SELECT c_custkey, format('{:,}', n) AS number,
CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE n || ' bytes' END AS bytes,
CASE WHEN n >= 1000000 THEN printf('%.2fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.2fK', n / 1000.0) ELSE printf('%.2f', CAST(n AS DOUBLE)) END AS rate
FROM (SELECT c_custkey, c_custkey * c_custkey * 1024 AS n FROM customer)"""

PAYLOADS = [
    ('{"threat_level":"high","category":"malware","source":"test-feed"}', ""),
    ('{"threat_level":"super-critical","category":"malware","source":"x"}', "threat_level is not a known level"),
    ('{"threat_level":"high"}', "category is required;source is required"),
    ('{"threat_level":"low","category":"c","source":"s","confidence":150}', "confidence must be from 0 to 100"),
    ('{"threat_level":"low","category":"c","source":"s","confidence":1.5}', "confidence must be a whole number"),
    ('{"threat_level":"low","category":"c","source":"s","tlp":"purple"}', "tlp is not a known marking"),
    ('{"threat_level":"low","category":"","source":"s","extra":{"a":1}}', "category must not be empty"),
    ('{"threat_level":"low","category":"c","source":"s","tags":["a","b"]}', ""),
    ('{"threat_level":"low","category":"c","source":"s","tags":[1]}', "tags must be an array of strings"),
    ("[]", " is not a JSON object"),
]


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.lit(p) for p, _ in PAYLOADS])
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.get(rows, (F.col("p_partkey") % len(PAYLOADS)).cast("int")).alias("data_json"))


def _violations(c: Column) -> Column:
    return F.array_join(F.transform(threatdb_violations(c), lambda v: F.concat_ws(" ", v["path"], v["message"])), ";")


def threat_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("p_partkey", _violations(F.col("data_json")).alias("violations"))


def threat_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).filter(F.size(threatdb_violations(F.col("data_json"))) == 0).select("p_partkey")


_VIOLATIONS_SQL = f"SELECT p_partkey, m AS violations FROM part JOIN {_values([(i, m) for i, (_, m) in enumerate(PAYLOADS)], 'i, m')} ON p_partkey % {len(PAYLOADS)} = v.i"

# ---- events


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each supplier, in the JSON format that events come in, with an attribute of every way of routing."""
    s = table(spark, sf_dir, "supplier")
    attribute = lambda kind, value, **more: F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit("Network activity").alias("category"), *[F.lit(v).alias(k) for k, v in more.items()])
    key = F.col("s_suppkey").cast("string")
    ip = long_to_ipv4(F.lit(BASE) + F.col("s_suppkey"))
    rows = F.array(
        attribute("ip-src", ip, comment=""), attribute("ip-dst|port", F.concat(ip, F.lit("|443")), comment="c2"), attribute("domain|ip", F.concat(F.lit("d"), key, F.lit(".example.com|"), ip), comment=""),
        attribute("url", F.concat(F.lit("http://u"), key, F.lit(".example.net:8080/x?y")), comment=""), attribute("filename|md5", F.concat(F.lit("f"), key, F.lit("|"), F.md5(key)), comment=""), attribute("comment", key, comment=""), attribute("md5", F.lit(" "), comment=""),
    )
    event = F.struct(F.concat(F.lit("uuid-"), key).alias("uuid"), F.col("s_name").alias("info"), (F.col("s_suppkey") % 4 + 1).cast("string").alias("threat_level_id"), F.lit("2").alias("analysis"), F.lit("2024-05-01").alias("date"), F.struct(F.lit("Org").alias("name")).alias("Orgc"), F.array(F.struct(F.lit("tlp:amber").alias("name"))).alias("Tag"), rows.alias("Attribute"))
    return s.select(F.to_json(F.struct(event.alias("Event"))).alias("value"))


def _misp(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = events_json(spark, sf_dir).select(F.from_json("value", misp.SCHEMA).alias("e")).select("e.Event")
        return misp.entries(events, mode).select("key", "kind", canonical_json(F.col("data_json")).alias("data_json"))

    return run


def _misp_sql(mode: str) -> str:
    level = {"full": ("High", "Medium", "Low", "Undefined"), "minimal": ("High", "Medium", "Low", "Undefined"), "threatdb": ("high", "medium", "low", "unknown")}[mode]
    name = f"CASE s_suppkey % 4 + 1 WHEN 1 THEN '{level[0]}' WHEN 2 THEN '{level[1]}' WHEN 3 THEN '{level[2]}' ELSE '{level[3]}' END"
    payload = {
        "full": """'{"analysis":"Complete","category":"Network activity",' || CASE WHEN c = '' THEN '' ELSE '"comment":"' || c || '",' END || '"event_date":"2024-05-01","event_info":"' || s_name || '","event_uuid":"uuid-' || s_suppkey || '","org_name":"Org","tags":"tlp:amber","threat_level":"' || lv || '","type":"' || ty || '"}'""",
        "minimal": """'{"tags":"tlp:amber","threat_level":"' || lv || '","type":"' || ty || '"}'""",
        "threatdb": """'{"category":"Network activity","description":"' || s_name || '","first_seen":"2024-05-01T00:00:00Z","indicator_type":"' || ty || '","source":"Org","tags":["tlp:amber"],"threat_level":"' || lv || '","tlp":"AMBER"}'""",
    }[mode]
    return f"""WITH s AS (SELECT *, {name} AS lv, {_dotted(f"CAST({BASE} + s_suppkey AS BIGINT)")} AS ip FROM supplier), k AS (
SELECT *, 'ip-src' AS ty, '' AS c, ip AS key, 'ip' AS kind FROM s UNION ALL SELECT *, 'ip-dst|port', 'c2', ip, 'ip' FROM s
UNION ALL SELECT *, 'domain|ip', '', 'd' || s_suppkey || '.example.com', 'literal' FROM s UNION ALL SELECT *, 'domain|ip', '', ip, 'ip' FROM s
UNION ALL SELECT *, 'url', '', 'u' || s_suppkey || '.example.net', 'literal' FROM s UNION ALL SELECT *, 'url', '', 'http://u' || s_suppkey || '.example.net:8080/x?y', 'literal' FROM s
UNION ALL SELECT *, 'filename|md5', '', 'f' || s_suppkey, 'literal' FROM s UNION ALL SELECT *, 'filename|md5', '', md5(CAST(s_suppkey AS VARCHAR)), 'literal' FROM s)
SELECT key, kind, {payload} AS data_json FROM k"""


def misp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misp.import_stats(events_json(spark, sf_dir).select(F.from_json("value", misp.SCHEMA).alias("e")).select("e.Event"))


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", misp.url_host(F.col("url")).alias("host"))


_HOST_SQL = r"""SELECT page_id, regexp_replace(CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) WHEN contains(r, '?') THEN split_part(r, '?', 1) ELSE split_part(r, '#', 1) END, ':\d*$', '') AS host
FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE url END AS r FROM pages)"""

# ---- sets


def inspect_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_set(spark, sf_dir).inspect().select("database_id", "database_type", "ip_count", "literal_count", "glob_count", "has_ip", "has_literal", "has_glob", "match_mode", F.col("ip_version").cast("bigint").alias("ip_version"))


_INSPECT_SQL = f"""WITH {_prefix_sql()} SELECT 'db' AS database_id, 'Combined-IP-Pattern' AS database_type, (SELECT count(*) FROM p) AS ip_count, (SELECT count(*) FROM supplier) AS literal_count, 1 AS glob_count, true AS has_ip, true AS has_literal, true AS has_glob, 'sensitive' AS match_mode, 4 AS ip_version"""


def validate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a set of globs without payloads, in strict mode."""
    broken = build(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("glob:*"), F.col("s_name")).alias("key"), F.lit("{}").alias("data_json")))
    return broken.validate(strict=True)


_VALIDATE_SQL = "SELECT 'warning' AS severity, 'payload_empty' AS code, 'glob entries without payload' AS message, count(*) AS n FROM supplier HAVING count(*) > 0"


# ---- streams and files


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a stream over the files of documents; every batch's matches are written under its number."""
    path, out = f"{sf_dir}/documents.parquet", shared_dir(spark, "stream-matches")
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    source, at = spark.readStream.schema(schema), spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        lines = source.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))
    else:
        lines = source.parquet(path)

    def sink(matches: DataFrame, number: int) -> None:
        flat = matches.select("doc_id", "matched_text", F.col("prefix_len").cast("bigint").alias("prefix_len"), "cidr", F.element_at("data", 1).alias("data_json"))
        flat.write.mode("overwrite").parquet(f"{out}/batch={number}")

    follow(lines, [document_set(spark)], sink, shared_dir(spark, "stream-places"), available_now=True).awaitTermination()
    kind = "doc_id bigint, matched_text string, prefix_len bigint, cidr string, data_json string"
    return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(out)


def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files that are written and then followed as a stream of lines."""
    logs, out = shared_dir(spark, "tail-logs"), shared_dir(spark, "tail-lines")
    _log(spark, sf_dir).select("line").write.text(logs)
    query = tail(spark, f"{logs}/part-*", 1 << 20).writeStream.option("checkpointLocation", shared_dir(spark, "tail-places")).format("parquet").start(out)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("source string, text string").parquet(out).select(F.col("text").alias("line"))


_TAIL_SQL = f"SELECT 'from ' || {_dotted(f'CAST({BASE} + c_custkey AS BIGINT)')} || ' to h' || (c_custkey % 50) || '.example.com: ok' AS line FROM customer"


def binary_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of prefixes, exported as a binary database and read back by the data source."""
    key = F.concat(long_to_ipv4(F.lit(BASE) + F.col("s_suppkey") * 16), F.lit("/28"))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), key.alias("key"), F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("data_json"))
    path = shared_dir(spark, "database") + ".mmdb"
    export_mmdb(build(entries), path)
    return read_mmdb(spark, path).select("network", F.col("prefix_len").cast("bigint").alias("prefix_len"), "data_json")


_BINARY_SQL = f"SELECT {_dotted(f'CAST({BASE} + s_suppkey * 16 AS BIGINT)')} || '/28' AS network, 28 AS prefix_len, {_PAYLOAD} AS data_json FROM supplier"


def saved_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in a set that was saved and loaded again."""
    path = shared_dir(spark, "set")
    build(prefix_entries(spark, sf_dir)).save(path)
    ips = addresses(spark, sf_dir)
    hits = lk.lookup_ip(ips, "ip", IndicatorSet.load(spark, path))
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", "ip", F.col("matched_prefix_len").cast("bigint").alias("matched_prefix_len"), "network", "data_json")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ("IPv4", *HASH_TYPES), spans=True)


def extract_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their places in the text's bytes."""
    return _spans(spark, sf_dir).select("doc_id", "item_type", "value", "start", "end")


_KIND_SQL = f"CASE WHEN regexp_full_match(t, '{OCTET}(\\.{OCTET}){{3}}') THEN 'IPv4' " + " ".join(f"WHEN regexp_full_match(t, '[0-9a-fA-F]{{{n}}}') THEN '{k}'" for k, n in zip(HASH_TYPES, (32, 40, 64, 96, 128))) + " END"
_SPANS_SQL = f"""SELECT doc_id, item_type, t AS value, start, start + strlen(t) AS "end" FROM (
SELECT doc_id, t, {_KIND_SQL} AS item_type, CAST(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - strlen(t) - 1 AS BIGINT) AS start
FROM (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{_SPLIT}') AS a FROM documents))) WHERE item_type IS NOT NULL"""


def scan_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [document_set(spark)], spans=True)
    return found.select("doc_id", "matched_text", "start", "end")


def extract_inside_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses inside longer words, which only count without boundaries."""
    c = addresses(spark, sf_dir)
    lines = c.select("c_custkey", F.concat(F.lit("x_"), F.col("ip"), F.lit("_y u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com!z")).alias("line"))
    return extract(lines, "line", ("IPv4", "Email", "Domain"), boundaries=False).select("c_custkey", "item_type", "value")


_INSIDE_SQL = f"""SELECT c_custkey, 'IPv4' AS item_type, {_dotted(f"CAST({BASE} + c_custkey AS BIGINT)")} AS value FROM customer
UNION ALL SELECT c_custkey, 'Email', 'u' || c_custkey || '@mail.example.com' FROM customer UNION ALL SELECT c_custkey, 'Domain', 'mail.example.com' FROM customer"""


def extract_monero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address with a sound checksum in every other line, and one with a letter changed in the rest."""
    word = F.when(F.col("c_custkey") % 2 == 0, F.lit(MONERO)).otherwise(F.lit(MONERO[:50] + ("x" if MONERO[50] != "x" else "y") + MONERO[51:]))
    lines = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.concat(F.lit("pay <"), word, F.lit("> now")).alias("line"))
    return extract(lines, "line", ("Monero", "Bitcoin")).select("c_custkey", "item_type", "value")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("string").alias("nation"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.col("s_name")).alias("label"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of lines, with blank ones and comments, written and read."""
    path = shared_dir(spark, "feed-text")
    names = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")), F.lit(""), F.lit("# nothing"))).alias("value"))
    names.write.text(path)
    return text_feed(spark, path).select("key", "data_json")


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "feed-csv")
    _cells(spark, sf_dir).select("nation", "key", "label").write.csv(path, header=True, escape='"')
    return csv_feed(spark, path).select("key", "data_json")


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold an array of entries each."""
    path = shared_dir(spark, "feed-json")
    cells = _cells(spark, sf_dir)
    data = F.struct(F.col("nation").cast("bigint").alias("nation"), F.when(F.col("label") != "", F.col("label")).alias("label"))
    rows = cells.select(F.to_json(F.struct("key", data.alias("data"))).alias("row"), F.pmod(F.xxhash64("key"), F.lit(8)).cast("int").alias("b"))
    rows.groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value")).repartitionById(8, "b").select("value").write.text(path)
    return json_feed(spark, path).select("key", "data_json")


def misp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a file each, beside files that hold none; one folder for all, as listing one for each would take longer than
    reading them."""
    path = shared_dir(spark, "feed-misp")
    events = events_json(spark, sf_dir).unionByName(spark.createDataFrame([('{"no":"event"}',)], "value string"))
    write_each(events.repartition(spark.sparkContext.defaultParallelism, "value"), path)
    return misp.misp_feed(spark, path).select("key", "kind", canonical_json(F.col("data_json")).alias("data_json"))


def gzip_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "logs-gzip")
    _log(spark, sf_dir).select(F.concat(F.lit(" "), F.col("line"), F.lit("  ")).alias("line")).write.option("compression", "gzip").text(path)
    return log_lines(spark, path).select(F.col("text").alias("line"))


def hot_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in a set that was replaced after it had been opened."""
    path = shared_dir(spark, "set-reload")
    build(prefix_entries(spark, sf_dir)).save(path)
    held = Reloading(spark, path)
    build(prefix_entries(spark, sf_dir, least=28)).save(path)
    ips, now = addresses(spark, sf_dir), held.get()
    if held.generation != 2:
        raise RuntimeError("the new version was not loaded")
    hits = lk.lookup_ip(ips, "ip", now)
    return ips.join(hits, ips["ip"] == hits["text"]).select("c_custkey", F.col("matched_prefix_len").cast("bigint").alias("matched_prefix_len"), "data_json")


def checked_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that is built under the threat schema and a check of one's own, and what it holds."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    data = F.to_json(F.struct(level.alias("threat_level"), F.lit("malware").alias("category"), F.col("s_name").alias("source"), (F.col("s_suppkey") % 101).alias("confidence")))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("literal:"), F.col("s_name")).alias("key"), data.alias("data_json"))
    build(entries, check=lambda c: F.when(F.length(c) > 1000, F.array(F.struct(F.lit("").alias("path"), F.lit("is too long").alias("message")))).otherwise(F.array().cast("array<struct<path:string,message:string>>")))
    return build(entries, schema="threatdb").literals.select(F.col("key"), path_get(F.col("data_json"), ["threat_level"]).alias("level"), path_get(F.col("data_json"), ["confidence"]).cast("bigint").alias("confidence"))


_CHECKED_INSERT_SQL = "SELECT s_name AS key, CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS level, s_suppkey % 101 AS confidence FROM supplier"


def ndjson_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of globs as lines of JSON, with the payloads as an array."""
    found = scan(_log(spark, sf_dir), "line", [_host_set(spark, "hosts", ["h1*.example.com", "*7.example.com"])])
    return to_ndjson(found.withColumn("src", F.concat(F.lit("line-"), F.col("c_custkey").cast("string"))), "src")


_NDJSON_PATTERNS_SQL = f"""WITH t AS (SELECT c_custkey, 'h' || (c_custkey % 50) || '.example.com' AS host FROM customer),
g AS (SELECT c_custkey, host, count(*) AS n, string_agg(v.j, ',' ORDER BY v.i) AS d FROM t JOIN {_values([(0, "h1%.example.com", '{"p":0}'), (1, "%7.example.com", '{"p":1}')], "i, t, j")} ON host LIKE v.t GROUP BY 1, 2)
SELECT '{{"timestamp":"0.000","source":"line-' || c_custkey || '","matched_text":"' || host || '","match_type":"pattern","pattern_count":' || n || ',"data":[' || d || ']}}' AS value FROM g"""


def bench_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    return synthetic(spark, "ip", n).select("seq", "key")


_BENCH_SQL = f"SELECT c_custkey AS seq, {_dotted('CAST(c_custkey AS BIGINT)')} AS key FROM customer"


QUERIES = {
    "scan_documents": (scan_documents, _SCAN_DOCS_SQL),
    "extract_ipv4_documents": (_doc_items("IPv4"), _IPV4_SQL),
    "extract_hashes_documents": (_doc_items(*HASH_TYPES), " UNION ALL ".join(_HASH_SQL.values())),
    "extract_email_documents": (_doc_items("Email"), _EMAIL_SQL),
    "extract_domain_documents": (_doc_items("Domain"), _domain_sql()),
    "extract_domain_pages": (_url_items(), _domain_sql("pages", "page_id", "url")),
    "domain_min_labels": (_url_items(3), _domain_sql("pages", "page_id", "url", 3)),
    "extract_checked": (extract_checked, _CHECKED_SQL),
    "extract_selected": (_doc_items(*choose("ip4,hashes,-crypto")), " UNION ALL ".join([_IPV4_SQL, *_HASH_SQL.values()])),
    "extract_all_counts": (lambda spark, d: counts(_all_items(spark, d)), f"SELECT item_type, count(*) AS n FROM ({_COMMON_SQL}) GROUP BY 1"),
    "extract_unique": (lambda spark, d: unique(_all_items(spark, d)), f"SELECT value AS raw, min(item_type) AS item_type FROM ({_COMMON_SQL}) GROUP BY 1"),
    "extract_json": (lambda spark, d: items_json(_doc_items("IPv4")(spark, d)), f"""SELECT '{{"type":"ipv4","value":"' || value || '"}}' AS value FROM ({_IPV4_SQL})"""),
    "lpm_customer": (lpm_customer, _LPM_SQL),
    "lpm_tree_prefix": (lpm_tree_prefix, _TREE_SQL),
    "lpm_duplicates": (lpm_duplicates, _DUP_SQL),
    "lpm_default_route": (lpm_default_route, _DEFAULT_SQL),
    "lpm_ipv6": (lpm_ipv6, _V6_SQL),
    "cidr_format": (cidr_format, _CIDR_SQL),
    "lookup_semi": (lookup_semi, f"WITH {_prefix_sql(least=28)} SELECT c_custkey FROM best"),
    "lookup_anti": (lookup_anti, f"WITH {_prefix_sql(least=28)} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM best)"),
    "literal_exact": (_literal(False, False), _literal_sql(False, False)),
    "literal_ci": (_literal(True, True), _literal_sql(True, True)),
    **{k: (_glob(p), _glob_sql(p, t, like=True)) for k, (p, t) in GLOBS.items()},
    **{k: (_glob([p for p, _ in v]), _glob_sql([p for p, _ in v], [t for _, t in v])) for k, v in REGEX_GLOBS.items()},
    "glob_ci": (_glob([p for p, _ in CI_GLOBS], True), _glob_sql([p for p, _ in CI_GLOBS], [t for _, t in CI_GLOBS], "lower(c_name)")),
    "glob_substring": (_glob(SUBSTRINGS), _SUBSTRING_SQL),
    "literal_union_glob": (literal_union_glob, _UNION_SQL),
    "unified_lookup": (unified_lookup, _unified_sql()),
    "first_match": (first_match, f"SELECT c_custkey, q, split_part(payloads, ';', 1) AS payload FROM ({_unified_sql()}) WHERE match_type <> 'none'"),
    "multi_db_scan": (multi_db_scan, _scan_sql()),
    "allowlist_scan": (allowlist_scan, _ALLOW_SQL),
    "scan_ndjson": (scan_ndjson, _NDJSON_SQL),
    "scan_stats": (scan_statistics, _STATS_SQL),
    "classify_keys": (classify_keys, _KEYS_SQL),
    "builder_stats": (builder_statistics, f"SELECT kind, count(*) AS n FROM ({_KEYS_SQL}) GROUP BY 1"),
    "csv_coerce": (csv_coerce, _CELLS_SQL),
    "table_feed": (table_feed, _FEED_SQL),
    "json_path": (json_path, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS none FROM events"),
    "json_flatten": (json_flatten, _FLATTEN_SQL),
    "number_formats": (number_formats, _FORMATS_SQL),
    "threat_violations": (threat_violations, _VIOLATIONS_SQL),
    "threat_valid": (threat_valid, f"SELECT p_partkey FROM ({_VIOLATIONS_SQL}) WHERE violations = ''"),
    **{f"misp_{m}": (_misp(m), _misp_sql(m)) for m in ("full", "minimal", "threatdb")},
    "misp_stats": (misp_stats, "SELECT count(*) AS events, 7 * count(*) AS attributes, 0 AS object_attributes FROM supplier"),
    "url_host": (url_host, _HOST_SQL),
    "inspect_set": (inspect_set, _INSPECT_SQL),
    "validate_set": (validate_set, _VALIDATE_SQL),
    "bench_ips": (bench_ips, _BENCH_SQL),
    "stream_scan": (stream_scan, _SCAN_DOCS_SQL),
    "tail_lines": (tail_lines, _TAIL_SQL),
    "binary_database": (binary_database, _BINARY_SQL),
    "saved_set": (saved_set, _LPM_SQL),
    "extract_spans": (extract_spans, _SPANS_SQL),
    "scan_offsets": (scan_offsets, f"SELECT doc_id, value AS matched_text, start, \"end\" FROM ({_SPANS_SQL}) WHERE item_type = 'IPv4'"),
    "extract_inside_words": (extract_inside_words, _INSIDE_SQL),
    "extract_monero": (extract_monero, f"SELECT c_custkey, 'Monero' AS item_type, '{MONERO}' AS value FROM customer WHERE c_custkey % 2 = 0"),
    "text_files": (text_files, "SELECT s_name AS key, '{}' AS data_json FROM supplier"),
    "csv_files": (csv_files, _FEED_SQL),
    "json_files": (json_files, _FEED_SQL),
    "misp_files": (misp_files, _misp_sql("full")),
    "gzip_logs": (gzip_logs, _TAIL_SQL),
    "hot_reload": (hot_reload, f"WITH {_prefix_sql(least=28)} SELECT c_custkey, len AS matched_prefix_len, data_json FROM best"),
    "checked_insert": (checked_insert, _CHECKED_INSERT_SQL),
    "ndjson_patterns": (ndjson_patterns, _NDJSON_PATTERNS_SQL),
}


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
