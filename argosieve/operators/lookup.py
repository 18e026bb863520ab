"""Lookups of text in indicator sets: longest prefix, exact string and glob, each as equality joins.

Every lookup first takes the distinct texts. Sides are never broadcast by hand: Spark does so where their size allows.
Several sets are looked up as one: their tables carry ``database_id``, which results keep, and kinds that no set has aren't
planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosieve.functions.globs import ascii_lower
from argosieve.functions.ip import address, ipv4_to_long, ipv6_parts, is_ipv4, looks_ipv6, mask_hi, mask_lo, network_text
from argosieve.plans.indicators import IndicatorSet

#: What tells the sets of a merged one apart.
_DB = "database_id"


def _texts(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("text")).filter(F.col("text").isNotNull()).distinct()


def merge_sets(isets: list[IndicatorSet]) -> IndicatorSet:
    """One set of several of the same match mode, whose tables have a column ``database_id``."""
    tagged = {}
    for t in ("ips", "literals", "globs", "nodes"):
        out = None
        for s in isets:
            part = getattr(s, t).withColumn(_DB, F.lit(s.database_id))
            part = part.withColumn("set_v6", F.lit(bool(s.meta["has_v6"]))) if t == "ips" else part
            out = part if out is None else out.unionByName(part)
        tagged[t] = out
    kinds = {k for s in isets for k in s.meta["anchors"]}
    meta = isets[0].meta | {
        "has_v6": any(s.meta["has_v6"] for s in isets), "lengths": sorted({n for s in isets for n in s.meta["lengths"]}), "anchors": {k: sorted({n for s in isets for n in s.meta["anchors"].get(k, [])}) for k in kinds},
        "counts": {k: sum(s.meta["counts"].get(k, 0) for s in isets) for k in ("ip", "literal", "glob")},
    }
    return IndicatorSet(tagged["ips"], tagged["literals"], tagged["globs"], tagged["nodes"], meta)


def _lengths(values: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>"))


def lookup_ip(df: DataFrame, text_col: str, iset: IndicatorSet, tree_depth: bool = False) -> DataFrame:
    """Rows (text, matched_prefix_len, network, data_json[, tree_prefix_len]) for addresses that a prefix covers.

    The longest covering prefix counts. An address is masked to each length that the set has, and joined on length and
    masked bits; only text that looks like IPv6 goes through Python, and none does if the set has IPv4 alone.
    ``tree_prefix_len`` is the depth at which a binary tree of all prefixes would end the walk: one more than the deepest
    inner node on the address's path. IPv6 addresses match nothing in a set of IPv4 prefixes.
    """
    m = merge_sets([iset])
    texts = _texts(df, text_col)
    seen = _seen(texts, m.meta["has_v6"])
    out = _prefixes(texts, m).drop(_DB)
    if not tree_depth:
        return out.drop("six")
    mixed = iset.meta["has_v6"]
    walk = seen.select("text", F.col("hi").alias("h"), F.col("lo").alias("l"), _lengths(iset.meta["depths"]).alias("depth"))
    walk = walk.select("text", "depth", mask_hi(F.col("h"), F.col("depth")).alias("hi"), mask_lo(F.col("l"), F.col("depth")).alias("lo"))
    deepest = walk.join(iset.nodes, ["depth", "hi", "lo"], "left_semi").groupBy("text").agg(F.max("depth").alias("deepest"))
    start = 0 if mixed else 96
    depth = 1 + F.coalesce("deepest", F.lit(start)) - F.when(F.col("six"), 0).otherwise(96)
    return out.join(deepest, "text", "left").select("text", "matched_prefix_len", "network", "data_json", depth.cast("int").alias("tree_prefix_len"))


def _seen(texts: DataFrame, mixed: bool) -> DataFrame:
    """Rows (text, hi, lo, six) of the texts that are addresses."""
    four = texts.filter(is_ipv4(F.col("text")))
    seen = four.select("text", F.lit(0).cast("bigint").alias("hi"), ipv4_to_long(F.col("text")).alias("lo"), F.lit(False).alias("six"))
    if mixed:
        six = texts.filter(looks_ipv6(F.col("text"))).withColumn("p", ipv6_parts(F.col("text"))).filter(F.col("p.hi").isNotNull())
        seen = seen.unionByName(six.select("text", "p.hi", "p.lo", F.lit(True).alias("six")))
    return seen


def _prefixes(texts: DataFrame, m: IndicatorSet) -> DataFrame:
    """The longest prefix of each set: rows (text, database_id, six, matched_prefix_len, network, data_json)."""
    mixed = m.meta["has_v6"]
    tries = _seen(texts, mixed).select("text", "six", F.col("hi").alias("h"), F.col("lo").alias("l"), _lengths(m.lengths).alias("plen"))
    tries = tries.select("text", "six", "plen", mask_hi(F.col("h"), F.col("plen")).alias("hi"), mask_lo(F.col("l"), F.col("plen")).alias("lo"))
    hits = tries.join(m.ips, ["hi", "lo", "plen"])
    hits = hits.filter(~F.col("six") | F.col("set_v6")) if mixed else hits
    best = hits.groupBy("text", "six", _DB).agg(F.max_by(F.struct("hi", "lo", "plen", "v6", "data_json"), "plen").alias("b"))
    shown = F.col("b.plen") - F.when(F.col("six"), 0).otherwise(96)
    return best.select("text", _DB, "six", F.greatest(shown, F.lit(0)).alias("matched_prefix_len"), network_text(F.col("b.hi"), F.col("b.lo"), F.col("b.plen"), F.col("b.v6"), mixed).alias("network"), F.col("b.data_json").alias("data_json"))


def lookup_literal(df: DataFrame, text_col: str, iset: IndicatorSet) -> DataFrame:
    """Rows (text, id, key, data_json) for texts that are in the set as they are, or in lower case if case doesn't count."""
    return _literal_hits(_texts(df, text_col), iset).select("text", "id", "key", "data_json")


def lookup_glob(df: DataFrame, text_col: str, iset: IndicatorSet) -> DataFrame:
    """Rows (text, id, pattern, data_json) for every glob that matches the whole text.

    Globs with a literal beginning or end are joined on it, for each of the lengths that such literals have; those with one
    inside only, on four characters of it. What the join can't decide is then matched. Only globs without any literal are
    tried on every text.
    """
    return _glob_hits(_texts(df, text_col), merge_sets([iset])).drop(_DB)


def _glob_hits(texts: DataFrame, iset: IndicatorSet) -> DataFrame:
    seen = texts.withColumn("t", ascii_lower(F.col("text")) if iset.insensitive else F.col("text"))
    globs, parts = iset.globs, []
    cut = {"prefix": lambda n: F.substring(F.col("t"), F.lit(1), n), "suffix": lambda n: F.right(F.col("t"), n)}
    for kind, take in cut.items():
        if iset.anchor_lengths(kind):
            keyed = seen.select("text", "t", _lengths(iset.anchor_lengths(kind)).alias("n")).filter(F.length("t") >= F.col("n"))
            keyed = keyed.select("text", "t", take(F.col("n")).alias("anchor"))
            parts.append(keyed.join(globs.filter(F.col("anchor_kind") == kind), "anchor"))
    if iset.anchor_lengths("inner"):
        keyed = seen.select("text", "t", _lengths(iset.anchor_lengths("inner")).alias("n")).filter(F.length("t") >= F.col("n"))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1), lambda i: F.substring(F.col("t"), i, F.col("n"))))
        parts.append(keyed.select("text", "t", F.explode(grams).alias("anchor")).join(globs.filter("anchor_kind = 'inner'"), "anchor"))
    if iset.anchor_lengths("none"):
        parts.append(seen.crossJoin(globs.filter("anchor_kind = 'none'")))
    cols = ["text", _DB, "id", "pattern", "data_json"]
    if not parts:
        return seen.select("text").crossJoin(globs.filter(F.lit(False)).select(_DB, "id", "pattern", "data_json")).select(*cols)
    out = None
    for p in parts:
        p = p.filter(F.col("sure") | F.expr("t RLIKE regex")).select(*cols)
        out = p if out is None else out.unionByName(p)
    return out


def is_address(c: Column) -> Column:
    """Whether text takes the way of addresses; CIDR text is a string."""
    return is_ipv4(c) | (looks_ipv6(c) & address(c).isNotNull())


def lookup_string(df: DataFrame, text_col: str, iset: IndicatorSet) -> DataFrame:
    """Rows (text, pattern_ids, data): the exact hit first, then all globs by id."""
    return _strings(_texts(df, text_col), merge_sets([iset])).drop(_DB)


def _literal_hits(seen: DataFrame, m: IndicatorSet) -> DataFrame:
    norm = F.lower("text") if m.insensitive else F.col("text")
    return seen.withColumn("norm", norm).join(m.literals, "norm")


def _strings(seen: DataFrame, m: IndicatorSet) -> DataFrame:
    parts = []
    if m.meta["counts"]["literal"] or not m.meta["counts"]["glob"]:
        parts.append(_literal_hits(seen, m).select("text", _DB, F.lit(0).alias("rank"), F.lit(-1).cast("bigint").alias("id"), "data_json"))
    if m.meta["counts"]["glob"]:
        parts.append(_glob_hits(seen, m).select("text", _DB, F.lit(1).alias("rank"), "id", "data_json"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    hits = both.groupBy("text", _DB).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "data_json"))).alias("h"))
    return hits.select("text", _DB, F.transform("h", lambda x: x["id"]).alias("pattern_ids"), F.transform("h", lambda x: x["data_json"]).alias("data"))


def lookup(df: DataFrame, text_col: str, iset: IndicatorSet) -> DataFrame:
    """Rows (text, database_id, match_type, prefix_len, cidr, pattern_count, data) for the distinct texts that are found.

    Addresses take the prefixes, all other texts the strings and globs; an exact hit of strings has the id -1.
    """
    return lookup_many(df, text_col, [iset])


def lookup_many(df: DataFrame, text_col: str, isets: list[IndicatorSet]) -> DataFrame:
    """The lookups in several sets, told apart by ``database_id``: one plan for all sets of a match mode."""
    if not isets:
        raise ValueError("no indicator sets")
    seen, out = _texts(df, text_col), []
    with_ips = [s for s in isets if s.meta["counts"].get("ip")]
    if with_ips:
        addresses = seen.filter(is_ipv4(F.col("text")) | looks_ipv6(F.col("text")))
        ip = _prefixes(addresses, merge_sets(with_ips))
        out.append(ip.select("text", _DB, F.lit("ip").alias("match_type"), F.col("matched_prefix_len").alias("prefix_len"), F.col("network").alias("cidr"), F.lit(None).cast("int").alias("pattern_count"), F.array("data_json").alias("data")))
    for mode in (False, True):
        some = [s for s in isets if s.insensitive == mode and (s.meta["counts"].get("literal") or s.meta["counts"].get("glob"))]
        if some:
            strings = seen.filter(~is_ipv4(F.col("text")))
            texts = strings.filter(~looks_ipv6(F.col("text"))).unionByName(strings.filter(looks_ipv6(F.col("text")) & address(F.col("text")).isNull()))
            hits = _strings(texts, merge_sets(some))
            out.append(hits.select("text", _DB, F.lit("pattern").alias("match_type"), F.lit(None).cast("int").alias("prefix_len"), F.lit(None).cast("string").alias("cidr"), F.size("data").alias("pattern_count"), "data"))
    if not out:
        kind = "text string, database_id string, match_type string, prefix_len int, cidr string, pattern_count int, data array<string>"
        return df.sparkSession.createDataFrame([], kind)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def found(df: DataFrame, text_col: str, iset: IndicatorSet) -> DataFrame:
    """The rows whose text is in the set."""
    return df.join(lookup(df, text_col, iset).select(F.col("text").alias("_t")), F.col(text_col) == F.col("_t"), "left_semi")


def not_found(df: DataFrame, text_col: str, iset: IndicatorSet) -> DataFrame:
    """The rows whose text isn't in the set, null ones among them."""
    return df.join(lookup(df, text_col, iset).select(F.col("text").alias("_t")), F.col(text_col) == F.col("_t"), "left_anti")


def first_data(matches: DataFrame) -> DataFrame:
    """Matches with the first payload only."""
    return matches.withColumn("data", F.try_element_at("data", F.lit(1)))
