"""Projections that clean and extract: keys, dates, titles, names and text sections.

Every function takes and returns columns. Null in, null out, unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import BOOKMARK_SOURCES, GRAPH_STOP_WORDS, STOP_WORDS, TITLE_STOP_WORDS, TREE_ROOTS

FIRST_YEAR = 1990
#: Seconds between 1601 and 1970, the epoch of browser timestamps.
BROWSER_EPOCH = 11_644_473_600


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def presence(c: Column) -> Column:
    """The empty string counts as missing; blanks don't."""
    return F.when(c != "", c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def valid_preprint_id(c: Column, as_of: int) -> Column:
    """Whether a trimmed id is ``YYMM.number``, dated from 1991 to ``as_of`` and plausible for its numbering scheme."""
    s = stripped(c)
    yymm, number = F.substring(s, 1, 4), F.regexp_extract(s, r"^[0-9]{4}\.([0-9]{4,5})(?:v[0-9]+)?\z", 1)
    yy, mm = F.try_to_number(F.substring(s, 1, 2), F.lit("99")).cast("int"), F.try_to_number(F.substring(s, 3, 2), F.lit("99")).cast("int")
    year = F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy)
    ok = (number != "") & mm.between(1, 12) & (number != "00000") & (yymm != "0001") & year.between(1991, as_of) & ~((yymm < "0704") & (year >= 2000))
    return F.coalesce(ok, F.lit(False))


def invalid_preprint_id(c: Column, as_of: int) -> Column:
    """A missing id is not invalid."""
    return F.coalesce((c != "") & ~valid_preprint_id(c, as_of), F.lit(False))


def preprint_year(c: Column, as_of: int) -> Column:
    yy = F.substring(stripped(c), 1, 2).cast("int")
    return F.when(valid_preprint_id(c, as_of), F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy))


def preprint_month(c: Column, as_of: int) -> Column:
    return F.when(valid_preprint_id(c, as_of), F.substring(stripped(c), 3, 2).cast("int"))


def plausible_year(c: Column, as_of: int) -> Column:
    return F.coalesce(c.between(FIRST_YEAR, as_of), F.lit(False))


def id_from_stem(stem: Column, as_of: int) -> Column:
    found = F.regexp_extract(stem, r"^([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?\z", 1)
    return F.when(valid_preprint_id(found, as_of), found)


def year_from_stem(stem: Column, as_of: int) -> Column:
    y = F.regexp_extract(stem, r"(?:^|[_.\-])(20[0-9]{2})(?:[_.\-]|\z)", 1)
    y = F.when(y != "", y).cast("int")
    return F.when(plausible_year(y, as_of), y)


def first_valid_id(text: Column, as_of: int) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(r"([0-9]{4}\.[0-9]{4,5})"), F.lit(1)), lambda x: valid_preprint_id(x, as_of))
    return F.try_element_at(found, F.lit(1))


def category_in_text(text: Column) -> Column:
    c = F.regexp_extract(text, r"\[([a-z\-]+\.[A-Z]{2})\]", 1)
    return F.when(c != "", c)


def abstract_of(text: Column) -> Column:
    """Between the heading "Abstract" and the introduction or key words, else what follows the heading; 1500 characters."""
    a = F.regexp_extract(text, r"(?is)\bAbstract\b[.\s]*(.{100,2000}?)(?:\n\s*(?:1\.?\s*Introduction|Keywords|Index Terms))", 1)
    b = F.regexp_extract(text, r"(?is)\bAbstract\b[.\s]*(.{100,800})", 1)
    one = F.trim(F.regexp_replace(F.when(a != "", a).otherwise(b), r"\s+", " "))
    return presence(F.substring(one, 1, 1500))


def introduction_of(text: Column) -> Column:
    """The section "Introduction" up to the next heading, hyphenation undone; at least 80 and at most 1500 characters."""
    body = F.regexp_extract(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?is)\b(?:1\.?\s*)?Introduction\b[.\s:—–\-]*\n?\s*(.{100,8000})", 1)
    heads = r"(?is)\n\s*(?:\d+\.?\s*(?:Related\s+Work|Background|Preliminar|Methods?|Problem|Overview|Approach)|2\.?\s+[A-Z]|II\.|References\b|Conclusion\b|Experiments\b|Implementation\b).*$"
    one = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, heads, ""), r"(\w)-\s+(\w)", "$1$2"), r"\s+", " "))
    return F.when(F.length(one) >= 80, F.substring(one, 1, 1500))


def title_from_stem(stem: Column) -> Column:
    s = F.trim(F.regexp_replace(F.regexp_replace(stem, r"^[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?[_\-]*", ""), r"[_\-]+", " "))
    return F.when((F.length(s) >= 3) & ~s.rlike(r"^[0-9\s.\-]+$"), s)


def normalized_title(c: Column) -> Column:
    """Lower case, punctuation as blanks, no version suffix, single blanks. Null counts as empty."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*v[0-9]+\s*\z", ""), r"\s+", " "))


def title_tokens(c: Column) -> Column:
    """Distinct words of a title without stop words, sorted."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return F.array_sort(F.array_except(w, F.array(*map(F.lit, TITLE_STOP_WORDS))))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over those of the larger set; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def tokens(text: Column, hyphens: bool = True) -> Column:
    """Words of more than two characters that aren't stop words or numbers, in order. Null counts as empty.

    With ``hyphens`` they stay inside words (vocabulary), otherwise they separate (similarity graph).
    """
    t = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\-]" if hyphens else r"[^\p{L}\p{N}_\s]", " ")
    stop = sorted(STOP_WORDS if hyphens else GRAPH_STOP_WORDS)
    return F.filter(F.split(t, r"\s+"), lambda x: (F.length(x) > 2) & ~x.isin(*stop) & ~x.rlike(r"^\p{Nd}+$"))


def joined_lines(text: Column) -> Column:
    """Hyphenation undone, whitespace collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\w)-\s+(\w)", "$1$2"), r"\s+", " "))


def latin_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.length(text)).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 8)


def title_head(title: Column) -> Column:
    """The part before the first of ``: ``, `` - ``, `` – ``, `` — ``; the whole if there is none."""
    out = title
    for sep in (" — ", " – ", " - ", ":"):
        out = F.when(F.contains(title, F.lit(sep)), F.substring_index(title, sep, 1)).otherwise(out)
    return F.trim(out)


# --- addresses ---------------------------------------------------------------------------------------------------


def url_key(url: Column) -> Column:
    """Trailing slashes go first, then the fragment, then case; so a slash before a fragment stays."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"(?d)#.*", ""))


def stable_id(url: Column) -> Column:
    return F.substring(F.sha2(url_key(url), 256), 1, 16)


def domain_of(url: Column) -> Column:
    """Host with user and port, lower case, without ``www.``; ``unknown`` if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.when(host != "", host).otherwise("unknown")


def source_of(url: Column, platform: Column) -> Column:
    low, out = F.lower(F.coalesce(url, F.lit(""))), F.lit("Other")
    for part, source in reversed(BOOKMARK_SOURCES):
        out = F.when(F.contains(low, F.lit(part)), F.lit(source)).otherwise(out)
    return F.when(platform == "zhihu", "Zhihu").otherwise(out)


def browser_seconds(micros: Column) -> Column:
    """Microseconds since 1601 as seconds since 1970; 0 for what is no number."""
    n = micros.cast("string")
    n = F.when(n.rlike("^-?[0-9]{1,18}$"), n).cast("long")
    return F.coalesce(F.when(n != 0, (n / 1e6 - BROWSER_EPOCH).cast("long")), F.lit(0))


def _below_roots(path: Column) -> Column:
    return F.filter(path, lambda p: (p != "") & ~p.isin(*TREE_ROOTS))


def topic_of(path: Column) -> Column:
    """The folder below ``topics``, else the last folder, else ``other``."""
    p = _below_roots(path)
    at = F.array_position(p, "topics")
    return F.coalesce(F.when(at > 0, F.get(p, at.cast("int"))), F.try_element_at(p, F.lit(-1)), F.lit("other"))


def folder_label(path: Column) -> Column:
    p = _below_roots(path)
    at = F.array_position(p, "topics").cast("int")
    return F.coalesce(presence(F.array_join(F.when(at > 0, F.slice(p, at, F.size(p))).otherwise(p), "/")), F.lit("other"))


# --- keys and times ----------------------------------------------------------------------------------------------


def cache_key(path: Column, mtime: Column, size: Column) -> Column:
    return F.concat_ws("|", path, mtime.cast("string"), size.cast("string"))


def path_of_cache_key(key: Column) -> Column:
    """The inverse of :func:`cache_key`; the path itself may hold bars."""
    return F.regexp_extract(key, r"^(.*)\|[^|]*\|[^|]*$", 1)


def month_key(year: Column, month: Column) -> Column:
    """``YYYY-MM``, or ``YYYY`` if the month is missing."""
    return F.when(month.isNotNull(), F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(year.cast("string"))


def content_hash(version: str, model: str, title: Column, abstract: Column, intro: Column, tags: Column, full: Column) -> Column:
    """Changes whenever the input of a summary does: of ``full`` rows all the text counts, of others 300 characters."""
    body = F.when(full, F.concat_ws("|", F.coalesce(abstract, F.lit("")), F.coalesce(intro, F.lit("")))).otherwise(F.substring(F.coalesce(abstract, F.lit("")), 1, 300))
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), F.lit(model), F.coalesce(title, F.lit("")), body, F.coalesce(tags, F.lit(""))), 256), 1, 16)


def trimmed_summary(s: Column, most: int = 120) -> Column:
    t = F.regexp_replace(s, r"[\s\"'“”‘’]+", "")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def highlighted(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with the terms marked, longest first."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    import re

    words = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return F.regexp_replace(out, "(?i)(" + "|".join(map(re.escape, words)) + ")", "<mark>$1</mark>") if words else out


def tag_hue(name: Column) -> Column:
    """A 32-bit rolling hash of the name's characters, as one of 360 hues."""
    h = F.aggregate(
        F.transform(F.split(name, ""), lambda c: F.unicode(c) if hasattr(F, "unicode") else F.ascii(c)),
        F.lit(0).cast("long"),
        lambda a, c: F.shiftright(F.shiftleft(a * 31 + F.coalesce(c, F.lit(0)), 32), 32),
    )
    return F.pmod(F.abs(h), F.lit(360)).cast("int")
