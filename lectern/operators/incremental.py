"""Refreshing by cache key, change detection and daily snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C


def changes(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """``(status, n)``: files that are new, updated or unchanged against the cache; keys are ``ckey``.

    A listed key that the cache has is unchanged; otherwise a path that the cache has under another key is updated, and
    any other is new.
    """
    keys, paths = cache.select("ckey").distinct(), cache.select(C.path_of_cache_key(F.col("ckey")).alias("path")).distinct()
    x = listing.select("ckey", C.path_of_cache_key(F.col("ckey")).alias("path")).distinct()
    x = x.join(keys.withColumn("k", F.lit(1)), "ckey", "left").join(paths.withColumn("p", F.lit(1)), "path", "left")
    status = F.when(F.col("k").isNotNull(), "unchanged").when(F.col("p").isNotNull(), "updated").otherwise("new")
    return x.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def refreshed(listing: DataFrame, cache: DataFrame, cols: list[str]) -> DataFrame:
    """The listing with what the cache knows of each file; a cached value goes before the listed one."""
    c = cache.groupBy("ckey").agg(*[F.max_by(x, "cached_at").alias(f"_{x}") for x in cols])
    return listing.join(c, "ckey", "left").withColumns({x: F.coalesce(f"_{x}", x) for x in cols}).drop(*[f"_{x}" for x in cols])


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def by_priority(rows: DataFrame, key: str, order: list[str], reason: str = "reason") -> DataFrame:
    """One row for each key: the reason that comes first in ``order``, then the least id."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(reason))
    w = Window.partitionBy(key).orderBy(rank, "paper_id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
