"""Faceted, typo-tolerant, ranked search over papers and over bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import let

SHOWN_ABSTRACT = 400
SORTS = ("relevance", "year_desc", "year_asc", "title", "tags")


def _lower(c: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def fields() -> dict[str, Column]:
    """The searchable texts of a paper. Of the abstract only the shown part is searched."""
    return {
        "title": _lower("title"), "authors": F.lower(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")),
        "abstract": _lower(F.substring("abstract", 1, SHOWN_ABSTRACT)), "summary": _lower("summary"), "tags": F.lower(F.array_join("tags", " ")),
    }


def terms(query: str) -> list[str]:
    return query.lower().split()


def term_matches(text: Column, words: Column, term: str) -> Column:
    """The term is part of the text, or, from four characters on, one edit away from a word of about its length."""
    hit = F.contains(text, F.lit(term))
    if len(term) < 4:
        return hit
    return hit | F.exists(words, lambda w: F.length(w).between(len(term) - 1, len(term) + 2) & (F.levenshtein(F.lit(term), w, 1) >= 0))


def matches(query: str) -> Column:
    """Every term matches the text of all fields together."""
    text = F.concat_ws(" ", *fields().values())

    def all_terms(x: Column) -> Column:
        out = F.lit(True)
        for t in terms(query):
            out = out & term_matches(x["text"], x["words"], t)
        return out

    return let(F.struct(text.alias("text"), F.split(text, r"[\s,;·、]+").alias("words")), all_terms)


def score(query: str) -> Column:
    """100 for the whole query in the title; for each term that a field holds 50 title, 40 authors, 20 abstract, 5 summary, 3 tags."""
    q = query.strip().lower()

    def total(f: Column) -> Column:
        out = F.when(F.contains(f["title"], F.lit(q)), 100).otherwise(0)
        for t in terms(query):
            for name, w in (("title", 50), ("authors", 40), ("abstract", 20), ("summary", 5), ("tags", 3)):
                out = out + F.when(F.contains(f[name], F.lit(t)), w).otherwise(0)
        return out

    return let(F.struct(*[c.alias(n) for n, c in fields().items()]), total)


def tag_facet(selected: list[str], mode: str) -> Column:
    """``and``: all selected tags; ``or``: any. No selection lets everything pass."""
    if not selected:
        return F.lit(True)
    sel = F.array(*map(F.lit, selected))
    return F.size(F.array_except(sel, "tags")) == 0 if mode == "and" else F.coalesce(F.arrays_overlap("tags", sel), F.lit(False))


def search(papers: DataFrame, query: str = "", library: str = "all", year: int | str = "all", tags: list[str] = (), mode: str = "and") -> DataFrame:
    """The matching papers with their ``score``. Needs columns ``tags`` (array) and ``summary``."""
    p = papers
    if library != "all":
        p = p.where(F.col("library") == library)
    if year != "all":
        p = p.where(F.col("pub_year") == int(year))
    if terms(query):
        p = p.where(matches(query))
    return p.where(tag_facet(list(tags), mode)).withColumn("score", score(query) if terms(query) else F.lit(0))


def ordered(found: DataFrame, query: str = "", sort: str = "relevance") -> DataFrame:
    """A query is always ranked by relevance; the id breaks every tie."""
    year = F.coalesce("pub_year", F.lit(0))
    by = {
        "relevance": [F.desc("score"), year.desc()], "year_desc": [year.desc()], "year_asc": [F.coalesce("pub_year", F.lit(9999)).asc()],
        "title": [F.lower(F.coalesce("title", F.lit("")))], "tags": [F.size("tags").desc()],
    }["relevance" if terms(query) else sort]
    return found.orderBy(*by, "paper_id")


def page(found: DataFrame, query: str, sort: str, offset: int, limit: int) -> DataFrame:
    """One page; only its rows are sorted to the end (top-k)."""
    return ordered(found, query, sort).offset(offset).limit(limit)


def placed(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with ``place``; only its rows are sorted to the end, and numbered."""
    top = rows.orderBy(*order).offset(offset).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)) + offset)


def unparsed(rows: DataFrame, query: str = "", library: str = "all", reason: str = "all") -> DataFrame:
    """What isn't shown, by library, reason and text. Duplicates stay hidden unless their reason is chosen."""
    out = rows.where(F.col("reason") == reason) if reason != "all" else rows.where("reason <> 'duplicate'")
    if library != "all":
        out = out.where(F.col("library") == library)
    hay = F.lower(F.concat_ws(" ", "stem", "title", "rel_path", "file_path", "folder", "reason"))
    for t in terms(query):
        out = out.where(term_matches(hay, F.split(hay, r"[\s,;·、]+"), t))
    return out


def unparsed_page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """The latest first, then by name."""
    return placed(rows, [F.desc_nulls_last("mtime"), F.coalesce("stem", F.lit("")), F.col("paper_id")], offset, limit)


def unparsed_reasons(rows: DataFrame, most: int = 4) -> DataFrame:
    """``(reason, n)``, the most frequent first, without duplicates."""
    return rows.where("reason <> 'duplicate'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def facet_counts(found: DataFrame, most: int = 35) -> DataFrame:
    """``(tag, n)`` of the most frequent tags of what was found."""
    return found.select(F.explode_outer("tags").alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def bookmark_matches(query: str) -> Column:
    """The whole query is part of title, address, domain and tags together."""
    text = F.lower(F.concat_ws(" ", "title", "url", "url_domain", F.array_join("tags", " ")))
    return F.contains(text, F.lit(query.strip().lower()))
