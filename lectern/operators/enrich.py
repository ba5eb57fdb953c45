"""Lookups in landed provider responses, and repairs that take the first acceptable candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from .clean import junk_reasons


def enriched(papers: DataFrame, providers: list[tuple[DataFrame, str, float]], fields: list[str]) -> DataFrame:
    """Missing ``fields`` filled from ``providers``, in their order.

    A provider is a table with one response for each key, the name of the key (a column of both), and the least title
    similarity that a response needs; 0 asks for none. Negative results are rows of nulls. Repeated keys keep the
    response of the least title. A field that is filled is never replaced.
    """
    out = papers
    for i, (table, key, least) in enumerate(providers):
        cols = [c for c in fields if c in table.columns]
        r = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(F.col("title").alias("_t"), *[F.col(c).alias(f"_{c}") for c in cols]), F.coalesce("title", F.lit(""))).alias(f"_r{i}"))
        j = out.join(r, key, "left")
        ok = F.lit(True) if not least else C.token_similarity(C.title_tokens(F.col("title")), C.title_tokens(F.col(f"_r{i}._t"))) > least
        out = j.withColumns({c: F.coalesce(F.col(c), F.when(ok, F.col(f"_r{i}._{c}"))) for c in cols}).drop(f"_r{i}")
    return out


def first_clean(candidates: list[Column], junk: list[Column]) -> Column:
    """The first candidate that isn't missing and isn't junk; null if there is none, which asks for a review."""
    return F.coalesce(*[F.when((c != "") & ~bad, c) for c, bad in zip(candidates, junk)])


def repaired_titles(records: DataFrame, candidates: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``method`` and ``new_title``: ``ok`` keeps a title that isn't junk; a junk one gets the first candidate that is
    neither missing nor junk, by its name; ``still_junk`` keeps what there is, for a review. Needs ``stem`` and
    ``title_is_filename``."""
    r = records.withColumns({f"_c{i}": c for i, (_, c) in enumerate(candidates)})
    bad = lambda c: F.size(junk_reasons(F.col(c), F.coalesce("stem", F.lit("")), F.col("title_is_filename"))) > 0
    r = r.withColumns({"_j": bad("title"), **{f"_j{i}": bad(f"_c{i}") for i in range(len(candidates))}})
    method, title = F.when(~F.col("_j"), "ok"), F.when(~F.col("_j"), F.col("title"))
    for i, (name, _) in enumerate(candidates):
        fit = (F.col(f"_c{i}") != "") & ~F.col(f"_j{i}")
        method, title = method.when(fit, name), title.when(fit, F.col(f"_c{i}"))
    r = r.withColumns({"method": method.otherwise("still_junk"), "new_title": title.otherwise(F.col("title"))})
    return r.drop("_j", *[f"_{x}{i}" for x in "cj" for i in range(len(candidates))])


def latest_or_previous(fetched: DataFrame, previous: DataFrame, cols: list[str]) -> DataFrame:
    """One row of counters: the newest fetch, each counter it lacks from the newest snapshot before."""
    both = fetched.select("generated_at", *cols, F.lit(True).alias("now")).unionByName(previous.select("generated_at", *cols, F.lit(False).alias("now")))
    of = lambda c, now: F.max_by(F.when(F.col("now") == now, F.col(c)), F.when(F.col("now") == now, F.col("generated_at")))
    return both.agg(*[F.coalesce(of(c, True), of(c, False)).alias(c) for c in ("generated_at", *cols)])
