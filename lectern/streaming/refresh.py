"""Streams: landed records merged into a table, and counts by time with late rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import delete, names_in


def _first_version(spark: SparkSession, target: str, checkpoint: str) -> int:
    """The version that the stream of a checkpoint writes first: behind all that were there when it began.

    It is kept beside the table, so that a stream that starts again goes on where it was.
    """
    mark = f"{target}/_streams/{hashlib.md5(checkpoint.encode()).hexdigest()}"
    if names_in(spark, mark):
        return spark.read.schema("first long").json(mark).first().first
    first = 1 + max([int(n[2:]) for n in names_in(spark, target) if n.startswith("v=")], default=-1)
    spark.createDataFrame([(first,)], "first long").coalesce(1).write.mode("overwrite").json(mark)
    return first


def merged(spark: SparkSession, arrivals: DataFrame, target: str, key: str, order: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame] | None = None, keep: int = 3):
    """Starts a stream that keeps the newest row of each key in ``target``, a version for each batch.

    A batch reads the version before and writes its own, so that it may be repeated after a failure. A new checkpoint
    over an old table goes on from its last version. A version that should be there and isn't is an error: nothing is
    taken for empty. Of the versions before, the last ``keep`` stay. Null keys are kept as one.
    """
    first = _first_version(spark, target, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        new, version = merge(batch) if merge else batch, first + number
        if version:
            if f"v={version - 1}" not in names_in(spark, target):
                raise FileNotFoundError(f"{target}/v={version - 1} is missing")
            new = spark.read.parquet(f"{target}/v={version - 1}").unionByName(new)
        cols = [c for c in new.columns if c != key]
        best = new.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, F.xxhash64(*cols))).alias("r")).select(key, "r.*")
        best.write.mode("overwrite").parquet(f"{target}/v={version}")
        for name in names_in(spark, target):
            if name.startswith("v=") and int(name[2:]) < version - keep:
                delete(spark, f"{target}/{name}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Rows by window; rows that come later than ``late`` behind the newest are left out."""
    g = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")
