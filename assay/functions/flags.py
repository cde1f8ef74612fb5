"""Flags: an ordered domain of no flag, safe, suspicious and critical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all

RANKS = {"safe": 1, "suspicious": 2, "critical": 3}

#: Marks that stand for flags.
MARKS = {"◯": "safe", "?": "suspicious", "✗": "critical"}


def normalize_flag(c: Column) -> Column:
    """One of the flags, or empty for anything else (null too)."""
    t = F.lower(trim_all(c))
    out = F.when(t.isin(*RANKS), t)
    for mark, flag in MARKS.items():
        out = out.when(t == mark, flag)
    return out.otherwise("")


def severity_rank(c: Column) -> Column:
    """3 for critical, 2 for suspicious, 1 for safe, else 0."""
    out = F.when(c == "critical", 3)
    return out.when(c == "suspicious", 2).when(c == "safe", 1).otherwise(0)


def rank_flag(c: Column) -> Column:
    """The flag of a rank; empty for 0 and null."""
    return F.when(c == 3, "critical").when(c == 2, "suspicious").when(c == 1, "safe").otherwise("")


def rule_flag_default(c: Column) -> Column:
    """The flag of an edited rule: anything unknown becomes safe."""
    flag = normalize_flag(c)
    return F.when(flag == "", "safe").otherwise(flag)


def normalized(flag: str | None) -> str:
    """``normalize_flag`` of one value on the driver (for rules)."""
    t = (flag or "").strip().lower()
    return t if t in RANKS else MARKS.get(t, "")
