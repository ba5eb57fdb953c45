"""Junk titles, exclusion, repairs of ids and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import rules as R
from ..functions.text import nfkc

HAN = r"[一-鿿]"


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def junk_reasons(title: Column, stem: Column, title_is_filename: Column) -> Column:
    """Every reason why a title is junk, in the rules' order. A missing or blank title has none."""
    bare = F.regexp_replace(title, r"(?U)^\s+|\s+\z", "")
    t = nfkc(bare)
    parts = F.size(F.filter(F.split(t, r"[：:] |\n"), lambda p: F.trim(p) != ""))
    whens = [F.when(F.length(t) > 200, "too_long")]
    for reason, p in R.JUNK_TITLES:
        whens.append(F.when(t.rlike(f"(?d){p}"), reason))
        if reason == "cn_multi_section":
            whens.append(F.when(F.regexp_count(t, F.lit(R.SECTION_PATTERN)) >= 2, "cn_section_summary"))
            whens.append(F.when(F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit(""))) >= 3, "many_colons"))
            whens.append(F.when(parts >= 3, "multi_parts"))
    whens.append(F.when(F.coalesce(title_is_filename, F.lit(False)) & _contains_any(stem, (*R.COURSE_WORDS, "合辑")), "filename_course_stem"))
    return F.when(bare != "", F.array_compact(F.array(*whens))).otherwise(F.array().cast("array<string>"))


def with_junk(papers: DataFrame) -> DataFrame:
    """Adds ``junk``, the title's reasons."""
    return papers.withColumn("junk", junk_reasons(F.col("title"), F.coalesce("stem", F.lit("")), F.col("title_is_filename")))


def exclude_reason(p: DataFrame) -> Column:
    """The first rule that keeps a record out of the library; null for those that stay. Needs ``junk``."""
    rel = F.lower(F.coalesce("rel_path", F.lit("")))
    stem = F.coalesce("stem", F.lit(""))
    title = F.coalesce(C.presence(F.col("title")), stem)
    no_abstract = F.coalesce(F.col("abstract"), F.lit("")) == ""
    han = stem.rlike(HAN) | title.rlike(HAN)
    out = [F.when(F.col("size_bytes") == 0, "empty_file")]
    out += [F.when(F.contains(rel, F.lit(d.lower())), "dir:" + d.strip("/")) for d in R.EXCLUDED_FOLDERS]
    out += [F.when(stem.rlike(pat), reason) for pat, reason in R.EXCLUDED_STEMS]
    out.append(F.when(_contains_any(stem, R.COURSE_KEYWORDS) | _contains_any(title, R.COURSE_KEYWORDS), "course_material"))
    out.append(F.when((F.size("junk") > 0) & no_abstract & han, "junk_title_course_notes"))
    out.append(F.when(F.contains(stem, F.lit("智东西")) | F.contains(title, F.lit("智东西")), "course_material"))
    out.append(F.when(F.contains(rel, F.lit("course_slides")) & no_abstract, "course_slides_no_abstract"))
    tutorial = no_abstract & stem.rlike(HAN) & ~stem.rlike(r"^[0-9]{4}\.[0-9]{4,5}") & F.coalesce("title_is_filename", F.lit(False))
    tutorial = tutorial & ~stem.rlike("(?i)paper|arxiv|proceedings") & _contains_any(stem, R.COURSE_WORDS)
    out.append(F.when(tutorial, "cn_tutorial_no_abstract"))
    return F.coalesce(*out)


def excluded(papers: DataFrame) -> DataFrame:
    """Adds ``exclude_reason``."""
    p = with_junk(papers)
    return p.withColumn("exclude_reason", exclude_reason(p))


def repaired_dates(papers: DataFrame, as_of: int) -> DataFrame:
    """Ids that are no ids are dropped, with the dates derived from them; dates are recovered from the file's name.

    A valid id sets year and month if the date has no source or came from the id. An invalid one is dropped together
    with a date whose source is the id or its provider, or which has no source and equals the bogus id's; a date read
    from the document stays. Years outside 1990 .. ``as_of`` go. Then the name's id, then the name's year, fill in.
    Adds ``needs_review``: the title is the file's name or junk, or there is no year.
    """
    p = with_junk(papers)
    aid, src, year, month = (F.col(c) for c in ("arxiv_id", "pub_date_source", "pub_year", "pub_month"))
    valid, given = C.valid_preprint_id(aid, as_of), F.coalesce(aid, F.lit("")) != ""
    by_id = valid & (src.isNull() | (src == "arxiv_id"))
    looks = F.coalesce(aid.rlike(r"^[0-9]{4}\."), F.lit(False))
    bogus = ~valid & looks & src.isNull() & (year == 2000 + F.substring(aid, 1, 2).try_cast("int")) & (month.isNull() | (month == F.substring(aid, 3, 2).try_cast("int")))
    drop = (~valid & F.coalesce(src.isin("arxiv_id", "arxiv_api"), F.lit(False))) | (F.coalesce(bogus, F.lit(False)))
    y1 = F.when(by_id, C.preprint_year(aid, as_of)).when(~drop, year)
    m1 = F.when(by_id, C.preprint_month(aid, as_of)).when(~drop, month)
    s1 = F.when(~drop, src)
    bad = ~valid & ~C.plausible_year(y1, as_of)
    p = p.withColumn("_y", F.when(~bad, y1)).withColumn("_m", F.when(~bad, m1))
    p = p.withColumn("_s", F.when(~(bad & (s1.isNull() | s1.isin("arxiv_id", "arxiv_api"))), s1)).withColumn("_a", F.when(valid, C.stripped(aid)))
    named = C.id_from_stem(F.col("stem"), as_of)
    named_year = C.year_from_stem(F.col("stem"), as_of)
    take_id, take_year = F.col("_a").isNull() & named.isNotNull(), F.col("_y").isNull() & named_year.isNotNull()
    out = p.withColumns(
        {
            "arxiv_id": F.coalesce("_a", named),
            "pub_year": F.when(take_id & F.col("_y").isNull(), C.preprint_year(named, as_of)).when(take_year, named_year).otherwise(F.col("_y")),
            "pub_month": F.when(take_id & F.col("_y").isNull(), C.preprint_month(named, as_of)).otherwise(F.col("_m")),
            "pub_date_source": F.when(take_id & F.col("_y").isNull(), "arxiv_id").when(take_year, "filename").otherwise(F.col("_s")),
        }
    ).drop("_y", "_m", "_s", "_a")
    review = F.coalesce("title_is_filename", F.lit(False)) | F.col("pub_year").isNull() | (F.size("junk") > 0)
    return out.withColumn("needs_review", review).drop("junk")
