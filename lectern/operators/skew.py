"""Joins against one row per key when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key below this many rows is never worth a detour.
HOT_ROWS = 200_000
#: A key is hot from this share of the rows on, so that there are at most as many hot keys as 1 / share.
HOT_SHARE = 1 / 1000


def lookup(facts: DataFrame, dim: DataFrame, key: str, weight: str, total: int, hottest: int, how: str = "inner") -> DataFrame:
    """``facts`` with the columns of ``dim``, which has one row for each ``key``.

    ``dim[weight]`` is the number of rows that ``facts`` has of the key, ``total`` the number of all rows and
    ``hottest`` the largest weight. Keys of more than max(HOT_ROWS, total * HOT_SHARE) rows, of which there can't be
    more than 1 / HOT_SHARE, are joined by broadcast, so that their rows stay where they are; the others by shuffle.
    Rows whose key is null come back only under ``how="left"``.
    """
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    if hottest <= least:
        return facts.join(dim.drop(weight), key, how)
    heavy = F.broadcast(dim.where(F.col(weight) > least).drop(weight))
    hot = facts.join(heavy, key, "inner")
    rest = facts.join(F.broadcast(dim.where(F.col(weight) > least).select(key)), key, "left_anti")
    return hot.unionByName(rest.join(dim.where(F.col(weight) <= least).drop(weight), key, how))
