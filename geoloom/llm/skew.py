"""Joins of rows with facts about their keys, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose facts are broadcast, at most.
HOT_KEYS = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per ``key``, which is never null).

    ``size`` is a share of ``total`` that adds up over the keys (as a count of
    rows does), so fewer than HOT_KEYS keys can have more than
    ``total / HOT_KEYS`` of it, whatever the input. These keys' facts are
    broadcast and their rows stay where they are; the other rows are joined by
    a shuffle in which no key is large.
    """
    hot = facts.filter(F.col(size) * HOT_KEYS > total)
    cold = facts.filter(F.col(size) * HOT_KEYS <= total)
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return there.unionByName(rest)
