"""IP addresses and prefixes as expressions.

An address is two bigints, ``hi`` and ``lo``, the halves of its 128 bits; IPv4 lies in ``::/96``. IPv4 is parsed, masked and
written by built-in expressions; only IPv6 text goes through an Arrow function.
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("text", T.StringType())])
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
_V6_SHAPE = r"^(?=.*:.*:)[0-9a-fA-F:]+(?:(?<=:)\d{1,3}(?:\.\d{1,3}){3})?$"


def is_ipv4(c: Column) -> Column:
    return c.rlike(rf"^{IPV4}$") & ~c.contains("\n")


def ipv4_to_long(c: Column) -> Column:
    """The number of a dotted IPv4 address, null for other text."""
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).cast("bigint")
    return F.when(is_ipv4(c), F.shiftleft(part(1), 24) + F.shiftleft(part(2), 16) + F.shiftleft(part(3), 8) + part(4))


def long_to_ipv4(c: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def parse_ipv6(text: str | None) -> dict | None:
    """Halves and canonical text of an IPv6 address without zone, None for other text."""
    if text is None or ":" not in text or "%" in text:
        return None
    try:
        a = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    n = int(a)
    name = f"::ffff:{a.ipv4_mapped}" if a.ipv4_mapped else str(a)
    return {"hi": _signed(n >> 64), "lo": _signed(n & (1 << 64) - 1), "text": name}


@F.pandas_udf(PARTS)
def ipv6_parts(s: pd.Series) -> pd.DataFrame:
    hi, lo, gone, text = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.ones(len(s), bool), np.full(len(s), None, object)
    for i in np.flatnonzero(s.notna().to_numpy()):
        found = parse_ipv6(s.iat[i])
        if found:
            hi[i], lo[i], text[i], gone[i] = found["hi"], found["lo"], found["text"], False
    whole = pd.arrays.IntegerArray
    return pd.DataFrame({"hi": whole(hi, gone), "lo": whole(lo, gone.copy()), "text": text})


@F.pandas_udf(T.StringType())
def ipv6_text(hi: pd.Series, lo: pd.Series) -> pd.Series:
    out, mask = np.full(len(hi), None, object), (1 << 64) - 1
    for i in np.flatnonzero(hi.notna().to_numpy()):
        v = ipaddress.IPv6Address((int(hi.iat[i]) & mask) << 64 | int(lo.iat[i]) & mask)
        out[i] = f"::ffff:{v.ipv4_mapped}" if v.ipv4_mapped else str(v)
    return pd.Series(out, dtype=object)


def looks_ipv6(c: Column) -> Column:
    """A cheap test that keeps text that can't be IPv6 out of Python."""
    return c.rlike(_V6_SHAPE)


def address(c: Column) -> Column:
    """Struct (hi, lo, v6, text) of an address; null for other text. ``text`` is canonical."""
    v4 = ipv4_to_long(c)
    six = ipv6_parts(F.when(looks_ipv6(c), c))
    return F.when(v4.isNotNull(), F.struct(F.lit(0).cast("bigint").alias("hi"), v4.alias("lo"), F.lit(False).alias("v6"), c.alias("text"))).when(
        six["hi"].isNotNull(), F.struct(six["hi"].alias("hi"), six["lo"].alias("lo"), F.lit(True).alias("v6"), six["text"].alias("text"))
    )


def _ones(n: Column) -> Column:
    """A bigint whose first n of 64 bits are set, n from 0 to 64."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - n).cast("int")))


def mask_hi(hi: Column, length: Column) -> Column:
    return hi.bitwiseAND(_ones(F.least(length, F.lit(64))))


def mask_lo(lo: Column, length: Column) -> Column:
    return lo.bitwiseAND(_ones(F.greatest(length - 64, F.lit(0))))


def parse_prefix(c: Column) -> Column:
    """Struct (hi, lo, plen, v6) of an address or CIDR prefix, null for other text.

    ``plen`` counts in 128 bits, so IPv4 lengths are 96 more. Bits beyond the length are cleared.
    """
    base, tail = F.substring_index(c, "/", 1), F.when(c.contains("/"), F.substring_index(c, "/", -1))
    sound = F.size(F.split(c, "/")) <= 2
    a = address(base)
    width = F.when(a["v6"], 128).otherwise(32)
    n = F.when(tail.isNull(), width).when(tail.rlike(r"^\+?\d{1,3}$"), tail.cast("int"))
    plen = F.when(a["v6"], n).otherwise(n + 96)
    ok = sound & a["hi"].isNotNull() & n.isNotNull() & (n <= width)
    return F.when(ok, F.struct(mask_hi(a["hi"], plen).alias("hi"), mask_lo(a["lo"], plen).alias("lo"), plen.cast("int").alias("plen"), a["v6"].alias("v6")))


def network_text(hi: Column, lo: Column, plen: Column, v6: Column, may_be_v6: bool = True) -> Column:
    """CIDR text of a masked prefix, with the length in its family's bits."""
    four = F.concat(long_to_ipv4(lo), F.lit("/"), (plen - 96).cast("string"))
    if not may_be_v6:
        return four
    six = F.concat(ipv6_text(F.when(v6, hi), F.when(v6, lo)), F.lit("/"), plen.cast("string"))
    return F.when(v6, six).otherwise(four)


def format_cidr(text: Column, length: Column) -> Column:
    """The network of an IPv4 address at a prefix length; other text is joined with the length as it is."""
    n = ipv4_to_long(text)
    net = n.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(32) - length).cast("int")))
    return F.when(n.isNotNull(), F.concat(long_to_ipv4(net), F.lit("/"), length.cast("string"))).otherwise(F.concat(text, F.lit("/"), length.cast("string")))


def format_cidr_any(text: Column, length: Column) -> Column:
    """As ``format_cidr``, for IPv6 addresses too."""
    a = address(text)
    six = network_text(mask_hi(a["hi"], length), mask_lo(a["lo"], length), length, a["v6"])
    return F.when(a["v6"], six).otherwise(format_cidr(text, length))
