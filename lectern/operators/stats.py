"""Counts by time, library, source and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C


def publication_stats(papers: DataFrame) -> DataFrame:
    """``(grp, library, k, n)``: counts by year, month, library and year, and source of the date, in one pass."""
    p = papers.where(F.coalesce("pub_year", F.lit(0)) != 0)
    row = lambda g, library, k: F.struct(F.lit(g).alias("grp"), library.alias("library"), k.alias("k"))
    year, none = F.col("pub_year").cast("string"), F.lit("")
    each = F.array(
        row("year", none, year), row("month", none, C.month_key(F.col("pub_year"), F.col("pub_month"))),
        row("library_year", F.coalesce("library", none), year), row("source", none, F.coalesce("pub_date_source", F.lit("unknown"))),
    )
    return p.select(F.inline(each)).groupBy("grp", "library", "k").agg(F.count("*").alias("n"))


def coverage(papers: DataFrame) -> DataFrame:
    """Before rows without a year are dropped: how many have one, the first and last year, the share in percent."""
    has = F.coalesce("pub_year", F.lit(0)) != 0
    return papers.agg(
        F.count("*").alias("n"), F.count_if(has).alias("with_year"), F.min(F.when(has, F.col("pub_year"))).alias("min_year"), F.max("pub_year").alias("max_year"),
        F.round(100.0 * F.count_if(has) / F.greatest(F.count("*"), F.lit(1)), 1).alias("coverage"),
    )


def quarter_of(year: Column, month: Column) -> Column:
    """``YYYY-Qn``; a missing month counts as January."""
    return F.concat(year.cast("string"), F.lit("-Q"), F.ceil(F.coalesce(month, F.lit(1)) / 3).cast("string"))


def evolution(layers: DataFrame) -> DataFrame:
    """``(quarter, topic, n)``; a missing year is that of the file's birth. Records without a topic count nowhere."""
    y = F.coalesce("pub_year", F.year("birthtime"))
    return layers.where(y.isNotNull()).select(quarter_of(y, F.col("pub_month")).alias("quarter"), F.explode_outer("topic").alias("topic")).where("topic is not null").groupBy("quarter", "topic").agg(F.count("*").alias("n"))


def month_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def dense_tag_months(items: DataFrame, tags: int = 15) -> DataFrame:
    """``(tag, month, n)`` of the most frequent tags for every month that occurs, zeros included.

    The grid is as large as the tags shown times the months; it comes from two small distinct lists.
    """
    x = items.where("date_added > 0").select(month_of(F.col("date_added")).alias("month"), F.explode("tags").alias("tag"))
    n = x.groupBy("tag", "month").agg(F.count("*").alias("n"))
    top = n.groupBy("tag").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "tag").limit(tags).select("tag")
    months = n.select("month").distinct().agg(F.array_sort(F.collect_set("month")).alias("ms"))
    grid = top.select("tag", F.explode(months.scalar()).alias("month"))
    return grid.join(n, ["tag", "month"], "left").select("tag", "month", F.coalesce("n", F.lit(0)).alias("n"))


def was_read(as_of: Column, window_days: int | None = None) -> Column:
    """Changed more than two minutes after it was made, within the last days before ``as_of`` if a window is given."""
    changed = F.col("mtime") > F.col("birthtime") + F.expr("INTERVAL 120 SECONDS")
    return changed & (F.col("mtime") >= as_of - F.make_dt_interval(F.lit(window_days))) if window_days else changed


def snapshot(papers: DataFrame, day: str) -> DataFrame:
    """One row for each library of one day: totals, how many need review, how many have a date."""
    return papers.groupBy(F.coalesce("library", F.lit("")).alias("library")).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("n_review"), F.count_if(F.coalesce("pub_year", F.lit(0)) != 0).alias("with_date")
    ).withColumn("day", F.lit(day))


#: Years are looked for at the beginning of a text, where a publication names its own.
YEAR_CHARS = 3000


def modal_year(docs: DataFrame, key: str, text: Column, as_of: int) -> DataFrame:
    """``(key, year, n)``: the plausible year a text names most often; ties go to the first named."""
    ys = F.regexp_extract_all(F.substring(text, 1, YEAR_CHARS), F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1))
    each = docs.select(key, F.posexplode(ys).alias("pos", "y")).withColumn("year", F.col("y").cast("int")).where(C.plausible_year(F.col("year"), as_of))
    n = each.groupBy(key, "year").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return n.groupBy(key).agg(F.max(F.struct("n", (-F.col("pos")).alias("p"), "year")).alias("b")).select(key, F.col("b.year").alias("year"), F.col("b.n").alias("n"))
