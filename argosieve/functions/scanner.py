"""A scanner of one text with byte positions, for the table function and as a measure for the expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from argosieve.functions import crypto
from argosieve.functions.ip import OCTET, parse_ipv6
from argosieve.functions.suffixes import load

_B = rb" \t\n\r/,;:()\[\]{}<>\"'@="
#: Tokens with a dot inside or of the length of a hash or address.
_TOKEN = re.compile(rb"(?<![^" + _B + rb"])(?:[^" + _B + rb".]*+\.[^" + _B + rb"]++|[^" + _B + rb".]{26,}+(?:\.[^" + _B + rb"]*+)?)")
_IPV4 = re.compile(rf"{OCTET}(?:\.{OCTET}){{3}}".encode())
_HEX = re.compile(rb"[0-9a-fA-F]+")
_SIX = re.compile(rb"(?<![0-9a-fA-F:])[0-9a-fA-F:]++")
_MAIL = re.compile(rb"(?<![^" + _B + rb"])([A-Za-z0-9._+\-]+)@([A-Za-z0-9.\-]+)(?![^" + _B + rb"])")
_NAME = re.compile(rb"[0-9A-Za-z.\-\x80-\xff]+")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d(?!\d))"
_LOOSE_IPV4 = re.compile(rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}".encode())
_LOOSE_NAME = re.compile(rb"(?<![0-9A-Za-z.\-\x80-\xff])[0-9A-Za-z.\-\x80-\xff]++")
_LOOSE_MAIL = re.compile(rb"(?<![A-Za-z0-9._+\-])([A-Za-z0-9._+\-]++)@([A-Za-z0-9.\-]++)")
_LOOSE_ETH = re.compile(rb"0x[0-9a-fA-F]{40}")
_SIZES = {32: "MD5", 40: "SHA1", 64: "SHA256", 96: "SHA384", 128: "SHA512"}


@lru_cache(maxsize=8)
def _most_labels(suffixes: frozenset[str]) -> int:
    return max((s.count(".") + 1 for s in suffixes), default=0)


def _public(name: str, suffixes: frozenset[str]) -> bool:
    labels = name.rsplit(".", _most_labels(suffixes) + 1)
    return any(".".join(labels[i:]) in suffixes for i in range(1, len(labels))) and not (len(labels) == 2 and not labels[0])


def _name(t: bytes, least: int, suffixes: frozenset[str]) -> bool:
    try:
        labels = t.decode().split(".")
    except UnicodeDecodeError:
        return False
    return len(labels) >= max(2, least) and all(x and x[0] != "-" and x[-1] != "-" for x in labels) and _public(".".join(labels), suffixes)


def scan(data: bytes, suffixes: frozenset[str] | None = None, min_labels: int = 2, boundaries: bool = True, types: frozenset[str] | None = None) -> list[tuple[str, str, str, int, int]]:
    """Items (type, raw, value, start, end) of a text's bytes, which need not be UTF-8; positions count bytes.

    Without ``boundaries``, names, IPv4, e-mail and Ethereum addresses may stand inside longer words.
    """
    suffixes = load() if suffixes is None else suffixes
    out = []
    for m in _TOKEN.finditer(data):
        t, span = m.group(), m.span()
        if len(t) in _SIZES and _HEX.fullmatch(t):
            out.append((_SIZES[len(t)], t, None, *span))
        if boundaries and _IPV4.fullmatch(t):
            out.append(("IPv4", t, None, *span))
        if t.isascii() and t.isalnum():
            s = t.decode()
            for name, check in (("Bitcoin", crypto.bitcoin), ("Ethereum", crypto.ethereum), ("Monero", crypto.monero)):
                if (boundaries or name != "Ethereum") and check(s):
                    out.append((name, t, None, *span))
        if boundaries and b"." in t and _NAME.fullmatch(t) and _name(t, min_labels, suffixes):
            out.append(("Domain", t, None, *span))
    if not boundaries:
        out += [("IPv4", m.group(), None, *m.span()) for m in _LOOSE_IPV4.finditer(data)]
        out += [("Ethereum", m.group(), None, *m.span()) for m in _LOOSE_ETH.finditer(data) if crypto.ethereum(m.group().decode())]
        out += [("Domain", m.group(), None, *m.span()) for m in _LOOSE_NAME.finditer(data) if b"." in m.group() and _name(m.group(), min_labels, suffixes)]
    for m in _SIX.finditer(data) if b"::" in data else ():
        t = m.group().decode()
        a = parse_ipv6(t) if 8 <= len(t) <= 39 and "::" in t and not t.startswith("::") and not t.endswith("::") and t[:3].lower() not in ("fe8", "fe9", "fea", "feb") else None
        if a:
            out.append(("IPv6", m.group(), a["text"], *m.span()))
    mail, at = _MAIL if boundaries else _LOOSE_MAIL, 0
    while m := mail.search(data, at) if b"@" in data else None:
        at = m.end(1) + 1
        local, domain = m.group(1), m.group(2).decode()
        if b".." not in local and re.search(rb"[A-Za-z]", local) and "." in domain and _public(domain, suffixes):
            out.append(("Email", m.group(), None, *m.span()))
    texts = [(k, raw.decode("utf-8", "replace"), v, a, b) for k, raw, v, a, b in out if types is None or k in types]
    return sorted((k, raw, v if v is not None else raw, a, b) for k, raw, v, a, b in texts)


def register(spark) -> None:
    """Makes the functions known to SQL, ``extract_indicators(text)`` as a table function among them."""
    from pyspark.sql.functions import udtf

    from argosieve.functions import globs, ip

    @udtf(returnType="item_type string, raw string, value string, start int, end int")
    class ExtractIndicators:
        def eval(self, text: str):
            if text is not None:
                yield from scan(text.encode("utf-8", "surrogatepass"))

    spark.udtf.register("extract_indicators", ExtractIndicators)
    for name, f in (("ip_parts", ip.ipv6_parts), ("glob_to_regex", globs.glob_to_regex), ("is_valid_glob", globs.is_valid_glob), ("btc_valid", crypto.btc_valid), ("eth_valid", crypto.eth_valid), ("xmr_valid", crypto.xmr_valid)):
        spark.udf.register(name, f)
