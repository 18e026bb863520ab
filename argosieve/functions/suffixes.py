"""The public suffix list, and the test that a name ends in one of its entries."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_FILE = Path(__file__).with_name("public_suffixes.dat")


@lru_cache(maxsize=1)
def load() -> frozenset[str]:
    lines = (x.strip() for x in _FILE.read_text(encoding="utf-8").splitlines())
    return frozenset(x for x in lines if x and not x.startswith("//"))


def decisive(suffixes: frozenset[str]) -> dict[int, list[str]]:
    """Suffixes by their number of labels, without those that end in a shorter suffix: these never decide."""
    out: dict[int, list[str]] = {}
    for s in suffixes:
        labels = s.split(".")
        if "*" not in s and not any(".".join(labels[i:]) in suffixes for i in range(1, len(labels))):
            out.setdefault(len(labels), []).append(s)
    return {n: sorted(v) for n, v in sorted(out.items())}


def ends_in_suffix(name: Column, suffixes: frozenset[str] | None = None) -> Column:
    """Whether some suffix after a dot of the name, the name's first dot not at its start, is public. Case counts.

    The list's size doesn't depend on the data; it becomes a hash set in the plan.
    """
    test = F.lit(False)
    for n, some in decisive(load() if suffixes is None else suffixes).items():
        test = test | (F.substring_index(name, ".", -n).isin(some) & (F.length(name) - F.length(F.substring_index(name, ".", -n)) > 1))
    return test
