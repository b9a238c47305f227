"""Public suffixes of DNS names and how their payload looks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where Debian keeps the list; any path may be given, the list is never bundled.
SYSTEM_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"
_PARTS = "public_suffix string, registrable_domain string, left_payload string, suffix_section string, suffix_rule string"


@dataclass(frozen=True)
class SuffixRules:
    """Rules of a public suffix list by what they say about a name: rule text to (kind, section)."""

    rules: dict[str, tuple[str, str]] = field(hash=False)
    version: str

    @staticmethod
    def parse(lines: Iterable[str], version: str = "given rules") -> SuffixRules:
        section, rules = "icann", {}
        for line in lines:
            line = line.strip().lower()
            if line.startswith("// ===begin private"):
                section = "private"
            elif line and not line.startswith("//"):
                rules.setdefault(line.split()[0], section)
        return SuffixRules(rules, version)

    @staticmethod
    @lru_cache(4)
    def load(path: str = SYSTEM_LIST) -> SuffixRules:
        """The list in a file; its version is the one the file states, else its path."""
        with open(path, encoding="utf-8") as f:
            lines = f.readlines()
        stated = next((x.split(":", 1)[1].strip() for x in lines if x.startswith("// VERSION:")), path)
        return SuffixRules.parse(lines, stated)

    def split(self, name: str) -> tuple[str, str, str, str, str]:
        """Public suffix, registrable domain, labels left of it without dots, section and rule that matched.

        An exception rule wins, then the longest exact or wildcard rule, then ``*``. A bad name gives empty texts.
        """
        labels = name.lower().rstrip(".").split(".")
        if not all(labels):
            return "", "", "", "unknown", "*"
        n, best, section, rule = len(labels), 1, "unknown", "*"
        tails = [".".join(labels[i:]) for i in range(n)]
        for i, t in enumerate(tails):
            if f"!{t}" in self.rules:
                best, section, rule = n - i - 1, self.rules[f"!{t}"], f"!{t}"
                break
            wild = f"*.{tails[i + 1]}" if i + 1 < n else None
            if section == "unknown" and t in self.rules:
                best, section, rule = n - i, self.rules[t], t
            elif section == "unknown" and wild in self.rules:
                best, section, rule = n - i, self.rules[wild], wild
        if not 0 < best <= n:
            return "", "", "", section, rule
        own = labels[n - best - 1 :] if n > best else []
        return tails[n - best], ".".join(own), "".join(labels[: n - best - 1]) if own else "", section, rule


def suffix_parts(col: Column | str, rules: SuffixRules) -> Column:
    """Struct of ``public_suffix``, ``registrable_domain``, ``left_payload``, ``suffix_section``, ``suffix_rule``.

    Null for a null name. Each batch resolves its different names once.
    """

    @F.pandas_udf(_PARTS)
    def parts(names: pd.Series) -> pd.DataFrame:
        known = {n: rules.split(n) for n in names.dropna().unique()}
        none = (None,) * 5
        return pd.DataFrame([none if n is None else known[n] for n in names], columns=[p.split()[0] for p in _PARTS.split(", ")])

    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), parts(c))


def normalized_entropy(col: Column | str) -> Column:
    """Shannon entropy of the bytes of a text in bits, by 6 and at most 1; 0 for ``''``, null for null."""
    c = F.col(col) if isinstance(col, str) else col
    size = F.octet_length(c)
    pairs = F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))

    def term(kind: Column, all_: Column) -> Column:
        p = F.size(F.filter(all_, lambda x: x == kind)) / F.size(all_)
        return -p * F.log2(p)

    total = F.transform(F.array(pairs), lambda a: F.aggregate(F.array_sort(F.array_distinct(a)), F.lit(0.0), lambda acc, k: acc + term(k, a)))[0]
    return F.when(c.isNull(), None).when(size == 0, 0.0).otherwise(F.least(F.lit(1.0), total / 6))


def encoded_ratio(col: Column | str) -> Column:
    """The greater share of hexadecimal or base32 characters (``a-z2-7``), whatever the case; 0 for ``''``, null for null."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    size = F.octet_length(c)
    share = F.greatest(*[F.length(F.regexp_replace(c, f"[^{s}]", "")) for s in ("0-9a-f", "a-z2-7")]) / size
    return F.when(c.isNull(), None).when(size == 0, 0.0).otherwise(share)
