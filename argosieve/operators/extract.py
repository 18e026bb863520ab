"""Extraction of indicators from text, as expressions.

A text is read once: one replacement leaves only the tokens that may be items, few beside the rest, and every extractor looks
at these. E-mail and IPv6, which are cut in other ways, look at texts that hold ``@`` and ``::``. All of it is regular
expressions and filters that Spark runs itself, without repeated groups that could overflow a stack; only checksums and IPv6
text go through Arrow functions, and only for candidates that passed the cheap tests.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.functions import crypto
from argosieve.functions.ip import IPV4, ipv6_parts
from argosieve.functions.suffixes import ends_in_suffix

BOUNDARY = r" \t\n\r/,;:()\[\]{}<>\"'@="
#: Nothing but a boundary, or an end of the text, stands before or after.
LEFT, RIGHT = rf"(?<![^{BOUNDARY}])", rf"(?![^{BOUNDARY}])"
HASHES = {"MD5": 32, "SHA1": 40, "SHA256": 64, "SHA384": 96, "SHA512": 128}
TYPES = ("Domain", "Email", "IPv4", "IPv6", *HASHES, "Bitcoin", "Ethereum", "Monero")
_GROUPS = {
    "crypto": ("Bitcoin", "Ethereum", "Monero"), "ip": ("IPv4", "IPv6"), "ips": ("IPv4", "IPv6"), "ipv4": ("IPv4",), "ip4": ("IPv4",), "ipv6": ("IPv6",), "ip6": ("IPv6",), "domain": ("Domain",), "domains": ("Domain",),
    "email": ("Email",), "emails": ("Email",), "hash": tuple(HASHES), "hashes": tuple(HASHES), "bitcoin": ("Bitcoin",), "ethereum": ("Ethereum",), "monero": ("Monero",), "all": TYPES,
}
_RUN = r"0-9A-Za-z.\-\x{80}-\x{10ffff}"


def choose(spec: str | None, default: tuple[str, ...] = TYPES) -> tuple[str, ...]:
    """Item types of a list such as ``ipv4,hashes`` or ``-crypto``: names alone are meant exclusively, a dash takes away."""
    if not spec:
        return default
    chosen, without, named = set(), set(), False
    for part in (p.strip() for p in spec.split(",")):
        off, name = part.startswith("-"), part.removeprefix("-")
        if name not in _GROUPS:
            raise ValueError(f"unknown extractor: {name}")
        named |= not off
        (without if off else chosen).update(_GROUPS[name])
    return tuple(t for t in TYPES if t in (chosen if named else default) and t not in without)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


_LOCAL, _HOST = r"A-Za-z0-9._+\-", r"A-Za-z0-9.\-"
#: An octet whose digits aren't cut off from more, for addresses that need no boundary after them.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d(?!\d))"
#: Letters of the shortest token that counts by its length alone.
_SHORTEST = {**HASHES, "Bitcoin": 26, "Ethereum": 42, "Monero": 90}


def candidates(text: Column, types: tuple[str, ...]) -> Column:
    """The text without tokens that can't be items of these types: those without a dot inside that are too short."""
    short = min([_SHORTEST[t] for t in types if t in _SHORTEST], default=0)
    size = f"{{0,{short - 1}}}+" if short else "*+"
    dull = rf"[^{BOUNDARY}.]{size}\.*+" if "Domain" in types or "IPv4" in types else rf"[^{BOUNDARY}]{size}"
    return F.regexp_replace(text, rf"[{BOUNDARY}](?:{dull}[{BOUNDARY}])*+", " ")


def mail_candidates(text: Column) -> Column:
    """The parts of a text around ``@``, null for texts that have none."""
    edge = BOUNDARY.removesuffix("@=") + "="
    return F.when(text.contains("@"), F.regexp_replace(text, rf"[{edge}](?:[^{edge}@]*+[{edge}])*+", " "))


def ipv4(text: Column, boundaries: bool = True) -> Column:
    """Dotted addresses without leading zeros, alone between boundaries."""
    return _all(text, f"{LEFT}({IPV4}){RIGHT}" if boundaries else rf"(?<![0-9.])({_OCTET}(?:\.{_OCTET}){{3}})")


def ipv6_candidates(text: Column) -> Column:
    """Runs of hex digits and colons with one ``::`` inside that can be addresses, link-local ones left out."""
    runs = F.when(text.contains("::"), _all(text, "(?<![0-9a-fA-F:])([0-9a-fA-F:]++)"))
    shape = r"^[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*+::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*+$"
    return F.filter(runs, lambda x: F.length(x).between(8, 39) & x.contains("::") & x.rlike(shape) & (F.size(F.split(x, ":+")) <= 7) & ~x.rlike("(?i)^fe[89ab]"))


def file_hashes(text: Column, name: str) -> Column:
    """Tokens that are all hex digits, as many as the hash has."""
    return _all(text, f"{LEFT}([0-9a-fA-F]{{{HASHES[name]}}}){RIGHT}")


def domains(text: Column, min_labels: int = 2, suffixes: frozenset[str] | None = None, boundaries: bool = True) -> Column:
    """Names between boundaries whose labels are sound, and that end in a public suffix behind another label."""
    runs = _all(text, rf"{LEFT}([{_RUN}]*\.[{_RUN}]*+){RIGHT}" if boundaries else rf"(?<![{_RUN}])([{_RUN}]++)")
    label = r"(?!-)[^.]++(?<!-)"
    return F.filter(runs, lambda x: x.contains(".") & x.rlike(rf"^{label}(?:\.{label}){{{max(1, min_labels - 1)},}}+$") & ends_in_suffix(x, suffixes))


def emails(text: Column, suffixes: frozenset[str] | None = None, boundaries: bool = True) -> Column:
    """Addresses between boundaries: a letter and no double dot in the local part, a public suffix at the end."""
    address = rf"[{_LOCAL}]++@[{_HOST}]++"
    found = _all(text, rf"{LEFT}(?=({address}){RIGHT})" if boundaries else rf"(?<![{_LOCAL}])(?=({address}))")
    local, domain = lambda x: F.substring_index(x, "@", 1), lambda x: F.substring_index(x, "@", -1)
    return F.filter(found, lambda x: ~local(x).contains("..") & local(x).rlike("[A-Za-z]") & domain(x).contains(".") & ends_in_suffix(domain(x), suffixes))


def bitcoin_candidates(text: Column) -> Column:
    return _all(text, rf"{LEFT}((?:bc1|[13])[0-9A-Za-z]{{23,61}}){RIGHT}")


def ethereum_candidates(text: Column, boundaries: bool = True) -> Column:
    return _all(text, f"{LEFT}(0x[0-9a-fA-F]{{40}}){RIGHT}" if boundaries else "(0x[0-9a-fA-F]{40})")


def monero_candidates(text: Column) -> Column:
    return _all(text, f"{LEFT}([48][1-9A-HJ-NP-Za-km-z]{{89,109}}){RIGHT}")


def _items(name: str, found: Column) -> Column:
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("item_type"), x.alias("raw")))


def extract(df: DataFrame, text_col: str = "text", types: tuple[str, ...] = TYPES, min_labels: int = 2, suffixes: frozenset[str] | None = None, boundaries: bool = True, spans: bool = False) -> DataFrame:
    """A row for each item found: the columns of ``df`` but the text, and item_type, raw, value.

    ``value`` is the canonical text of an IPv6 address and the item itself otherwise. Items of one text are a bag: the same
    item twice gives two rows. Null texts give none. Only the chosen types are in the plan. Without ``boundaries``, names,
    IPv4, e-mail and Ethereum addresses may stand inside longer words. With ``spans``, start and end tell where an item
    lies in the text's UTF-8 bytes; positions need a scanner of bytes, which is Arrow-batched Python.
    """
    for t in types:
        if t not in TYPES:
            raise ValueError(f"unknown item type: {t}")
    names = ("item_type", "raw", "value", "start", "end") if spans else ("item_type", "raw", "value")
    keep = [c for c in df.columns if c != text_col and c not in names]
    if spans:
        return _with_spans(df, text_col, keep, types, min_labels, suffixes, boundaries)
    text = F.col(text_col)
    few = text if not boundaries else candidates(text, types)
    cut = {"_few": few, "_mail": mail_candidates(text) if boundaries else text, "_six": ipv6_candidates(text)}
    needs = {"Email": "_mail", "IPv6": "_six"}
    used = {needs.get(t, "_few") for t in types}
    df = df.select(*keep, *[c.alias(n) for n, c in cut.items() if n in used])
    few, mail, six, parts = F.col("_few"), F.col("_mail"), F.col("_six"), []
    for t in types:
        if t == "IPv4":
            parts.append(_items(t, ipv4(few, boundaries)))
        elif t == "IPv6":
            parts.append(_items(t, six))
        elif t == "Domain":
            parts.append(_items(t, domains(few, min_labels, suffixes, boundaries)))
        elif t == "Email":
            parts.append(_items(t, emails(mail, suffixes, boundaries)))
        elif t in HASHES:
            parts.append(_items(t, file_hashes(few, t)))
        elif t == "Bitcoin":
            parts.append(_items(t, bitcoin_candidates(few)))
        elif t == "Ethereum":
            parts.append(_items(t, ethereum_candidates(few, boundaries)))
        else:
            parts.append(_items(t, monero_candidates(few)))
    found = df.select(*keep, F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("item")).select(*keep, "item.item_type", "item.raw")
    return _verify(found, types)


def _with_spans(df: DataFrame, text_col: str, keep: list[str], types: tuple[str, ...], min_labels: int, suffixes: frozenset[str] | None, boundaries: bool) -> DataFrame:
    from argosieve.functions.scanner import scan

    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    wanted = frozenset(types)

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(len(keep)).to_pylist()):
                for item in scan(text.encode("utf-8", "surrogatepass"), suffixes, min_labels, boundaries, wanted):
                    rows.append(k)
                    found.append(item)
            at = pa.array(rows, pa.int64())
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *cols], [*(f"c{i}" for i in range(len(keep))), "item_type", "raw", "value", "start", "end"])

    extra = [T.StructField(n, T.StringType()) for n in ("item_type", "raw", "value")] + [T.StructField(n, T.LongType()) for n in ("start", "end")]
    out = src.mapInArrow(run, T.StructType([*(T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)), *extra]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "item_type", "raw", "value", "start", "end")


def _verify(found: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Checksums of addresses and canonical IPv6; types without such a test never reach Python."""
    kind, raw = F.col("item_type"), F.col("raw")
    value, sound = raw, F.lit(True)
    if "IPv6" in types:
        found = found.withColumn("_six", F.when(kind == "IPv6", ipv6_parts(F.when(kind == "IPv6", raw))["text"]))
        value = F.when(kind == "IPv6", F.col("_six")).otherwise(raw)
        sound = sound & ((kind != "IPv6") | F.col("_six").isNotNull())
    for t, check in (("Bitcoin", crypto.btc_valid), ("Ethereum", crypto.eth_valid), ("Monero", crypto.xmr_valid)):
        if t in types:
            sound = sound & ((kind != t) | check(F.when(kind == t, raw).otherwise(F.lit(""))))
    keep = [c for c in found.columns if c != "_six"]
    return found.filter(sound).select(*keep, value.alias("value"))


#: The order in which a text's items are looked for.
_ORDER = ("Domain", "IPv4", "Email", "IPv6", *HASHES, "Bitcoin", "Ethereum", "Monero")


def unique(items: DataFrame) -> DataFrame:
    """One row for each distinct raw item, with the type that is looked for first."""
    rank = F.array_position(F.array(*[F.lit(t) for t in _ORDER]), F.col("item_type"))
    return items.groupBy("raw").agg(F.min_by("item_type", rank).alias("item_type"))


def counts(items: DataFrame) -> DataFrame:
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"))
