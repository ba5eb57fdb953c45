"""Author names, author lines, and the title among a page's text blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.clean import let
from .clean import junk_reasons

# Words that are no part of a name, phrases that no list of names has, starts of other lines, signs of an
# affiliation, what a name looks like inside a line, limits.
JUNK_WORDS = (
    "equal contribution contributions corresponding correspondence author authors project leader lead human egocentric post pre training tasks task model models dataset encoder backbone "
    "expert experts latent action tactile spatial temporal contact rich skills team worldbench university institute inc laboratory lab school college department figure abstract arxiv preprint "
    "submitted accepted proceedings berkeley nvidia stanford google meta microsoft amazon openai alibaba singapore china email overview following grounding efficient diverse objects videos "
    "trajectories primitives teleoperation motor language image images signals wrist view head slow fast future visual prediction refinement denosing toothpaste apply pour drill dumpling rollup "
    "wrap fold peel close wipe squeeze insert extract cube make roll natural daily interactions manipulation reactive world rl posttraining pretraining"
).split()
JUNK_PHRASE = (
    r"(?i)equal\s+contrib|correspond(?:ing|ence)\s+auth|project\s+lead(?:er)?|human\s+egocentric|post[\s-]?training|pre[\s-]?training|worldbench\s+team|contact[\s-]?rich|zero[\s-]?shot|"
    r"mixture[\s-]of[\s-]|figure\s*\d|tactile[\s-]?reactive|in[\s-]?the[\s-]?wild"
)
OTHER_LINE = r"(?i)^(?:arXiv|doi:|https?://|www\.|Keywords|Index Terms|Preprint|Submitted|Accepted|Proceedings|Abstract\b)"
NAME_LIKE = (
    r"(?:[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?|[A-Z]{2,})(?:\s+(?:[A-Z]\.?|[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?|[A-Z]{2,}))+"
    r"|[\x{4e00}-\x{9fff}]{2,4}(?:\s*[\x{4e00}-\x{9fff}]{1,3})?"
)
HAN = r"[\x{4e00}-\x{9fff}]+"
MAX_AUTHORS, MAX_PAGE_AUTHORS, SHORT_LINE, LONG_LINE = 20, 15, 250, 900
TOP_BLOCKS, TOP_SHARE, MAX_TITLE, TITLES = 12, 0.55, 200, 5


def _stripped(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+\z", "")


def _one_line(c: Column, chars: str) -> Column:
    return _stripped(F.regexp_replace(c, r"(?U)\s+", " "), chars)


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def valid_name(name: Column) -> Column:
    """3 to 60 characters without marks. Han names of 2 to 4 characters a part; others of two capitalised words that
    stand for nothing else, and no single small letter. Null isn't valid."""

    def test(x: Column) -> Column:
        words = _found(x, "[A-Za-z]+(?:'[A-Za-z]+)?")
        good = F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike("^[A-Z]") & ~F.lower(w).isin(*JUNK_WORDS))
        latin = ~F.exists(words, lambda w: w.rlike("^[a-z]$")) & (F.size(good) >= 2)
        han = F.forall(_found(x, HAN), lambda h: F.length(h).between(2, 4))
        kind = F.when(x.rlike(HAN), han).otherwise(latin)
        return F.length(x).between(3, 60) & ~x.rlike(JUNK_PHRASE) & ~x.rlike(OTHER_LINE) & kind

    return F.coalesce(let(_one_line(F.regexp_replace(name, r"(?U)[\d*†‡§∗\[\]（）()]+", " "), " ,;."), test), F.lit(False))


def _listed(t: Column) -> Column:
    """Names by their looks, if there are two of them and something that separates them."""
    names = F.filter(F.transform(_found(t, NAME_LIKE), lambda x: F.trim(x)), valid_name)
    return F.when((F.contains(t, F.lit(",")) | t.rlike(r"(?i)\band\b")) & (F.size(names) >= 2), F.transform(names, lambda x: _one_line(x, " ,;")))


def author_names(text: Column) -> Column:
    """The valid names of one entry or line: split at commas, "and", their Chinese forms and line ends, without marks and
    addresses. If no part is one, the names by their looks. Null gives none."""

    def names(t: Column) -> Column:
        parts = F.transform(F.split(t, r"(?iU),|\band\b|、|·|\n"), lambda x: _one_line(x, " ,;"))
        good = F.filter(parts, lambda x: (F.length(x) <= 60) & valid_name(x) & x.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]"))
        return F.when(F.size(good) > 0, good).otherwise(F.coalesce(_listed(t), F.array().cast("array<string>")))

    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[{}$\\]|[\d*†‡§∗]+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)\S+@\S+", ""), r"[ \t]+", " ")
    return let(_stripped(bare, " ,;"), names)


def _distinct(names: Column, most: int) -> Column:
    """Each name once whatever its case: first spelling, first place, ``most`` at most."""

    def keep(xs: Column) -> Column:
        low = F.transform(xs, F.lower)
        return F.slice(F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)

    return let(names, keep)


def clean_authors(authors: Column) -> Column:
    """The valid names of all entries, each once, MAX_AUTHORS at most. Null gives none."""
    return _distinct(F.flatten(F.transform(F.coalesce(authors, F.array().cast("array<string>")), author_names)), MAX_AUTHORS)


def authors_look_wrong(authors: Column) -> Column:
    """TeX signs, a phrase that no list of names has, no valid name, fewer than half as many names as entries, or more
    than half of the entries invalid. A missing or empty list isn't wrong."""

    def test(a: Column) -> Column:
        n, half = F.size(clean_authors(a)), F.floor(F.size(a) / 2)
        joined = F.array_join(a, ", ")
        bad = F.size(F.filter(a, lambda x: ~valid_name(F.trim(x))))
        return joined.rlike(r"[{}$\\]") | joined.rlike(JUNK_PHRASE) | (n == 0) | (n < F.greatest(F.lit(1), half)) | (bad > half)

    return F.coalesce((F.size(authors) > 0) & let(authors, test), F.lit(False))


def repaired_authors(candidates: list[Column]) -> Column:
    """The first list that doesn't look wrong, cleaned; null if there is none."""
    fit = [F.when((F.size(c) > 0) & ~authors_look_wrong(c) & (F.size(clean_authors(c)) > 0), clean_authors(c)) for c in candidates]
    return F.coalesce(*fit)


def author_line(text: Column) -> Column:
    """Whether a block of text names authors. Null doesn't."""

    def test(t: Column) -> Column:
        own = F.filter(F.split(t, "\n"), lambda x: valid_name(F.trim(x)))
        short = F.size(F.split(F.trim(t), r"\s+")).between(2, 12) & valid_name(t)
        good = (F.size(own) >= 2) | (F.size(author_names(t)) > 0) | _listed(t).isNotNull() | short
        bad = t.rlike(r"^[\d\s.\-]+\z") | t.rlike(OTHER_LINE) | t.rlike(JUNK_PHRASE) | t.rlike(r"[{}$\\@]")
        return F.length(t).between(6, LONG_LINE) & ~bad & good

    return F.coalesce(let(text, test), F.lit(False))


def _blocks(blocks: DataFrame, key: str) -> DataFrame:
    """The text blocks with the page's size and their text on one line. Blocks of another ``kind`` than 0 are left out."""
    b = blocks.where("kind = 0 and text is not null") if "kind" in blocks.columns else blocks.where("text is not null")
    page = Window.partitionBy(key)
    return b.withColumns({"w": F.max("x1").over(page), "h": F.max("y1").over(page), "t": F.trim(F.regexp_replace("text", r"(?U)\s+", " "))})


def page_authors(blocks: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """``(key, authors)``: the names between a first page's title and its abstract, MAX_PAGE_AUTHORS at most.

    The first run of blocks that name authors counts, three of them at most; it ends after a block that is a list or has
    three names. ``titles`` has ``key`` and ``title``. A page has a bounded number of blocks. Pages without names are
    left out.
    """
    b = _blocks(blocks, key).join(titles.select(key, F.lower(F.substring("title", 1, 50)).alias("needle")), key, "left")
    low = F.lower("t")
    is_title = (F.col("needle") != "") & (F.contains(low, F.col("needle")) | F.contains(F.col("needle"), F.substring(low, 1, 50)))
    marks = b.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col("t").rlike(r"(?i)^Abstract\b"), F.col("y0"))), F.max("h")).alias("abstract_y"),
        F.coalesce(F.min_by(F.when(is_title, F.col("y1")), F.when(is_title, F.col("y0"))), F.lit(0.0)).alias("title_y"),
    )
    raw = F.trim("text")
    row = F.struct("y0", "x0", raw.alias("text"), _listed(raw).isNotNull().alias("listed"), F.size(author_names(raw)).alias("n"), author_line(raw).alias("names"))
    mid = b.join(marks, key).where((F.col("y0") > F.col("title_y") + 2) & (F.col("y0") < F.col("abstract_y") - 2) & (raw != ""))
    got = mid.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    ok: Callable[[Column], Column] = lambda r: r["names"] & ((F.length(r["text"]) <= SHORT_LINE) | r["listed"])
    got = got.withColumn("at", F.array_position(F.transform("rows", ok), True).cast("int")).where("at > 0").select(key, F.slice("rows", F.col("at"), 3).alias("r"))
    one, two, three = (F.get("r", F.lit(i)) for i in range(3))
    more = lambda before, this: ~before["listed"] & (before["n"] < 3) & F.coalesce(ok(this), F.lit(False))
    n = F.when(~more(one, two), 1).when(~more(two, three), 2).otherwise(3)
    names = F.flatten(F.transform(F.slice("r", F.lit(1), n), lambda r: author_names(r["text"])))
    return got.select(key, _distinct(names, MAX_PAGE_AUTHORS).alias("authors")).where(F.size("authors") > 0)


def title_block(blocks: DataFrame, key: str, stems: DataFrame | None = None) -> DataFrame:
    """``(key, title)``: the block of a first page that looks most like its title.

    ``blocks`` has ``x0, y0, x1, y1, text`` and may have ``kind``. Of the first TOP_BLOCKS blocks of the upper part of the
    page (of the whole page if that is empty) high, centred blocks of title length score; lists of names and junk lose.
    Of the TITLES best, short ones go first if one is Chinese, and lists of names only stand alone. A page without a
    candidate gets the title of its file's name (``stems``: ``key``, ``stem``) unless that is junk; else it has no row.
    """
    b = _blocks(blocks, key)
    upper = b.withColumn("up", F.col("y0") < TOP_SHARE * F.col("h"))
    upper = upper.withColumn("any_up", F.max("up").over(Window.partitionBy(key))).where("up or not any_up")
    top = upper.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("y0", "x0", "t"))).where(F.col("r") <= TOP_BLOCKS)
    n = F.length("t")
    many = (F.regexp_count("t", F.lit(",")) > 4) | F.contains(F.lower("t"), F.lit("et al"))
    top = top.where((n > 10) & (n <= MAX_TITLE) & ~F.col("t").rlike(r"^[\d\s.\-]+\z") & ~F.contains("t", F.lit("@")))
    s = F.greatest(F.lit(0.0), 1 - F.col("y0") / F.greatest(0.45 * F.col("h"), F.lit(1.0)))
    s = s + 0.5 * F.greatest(F.lit(0.0), 1 - F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("w") / 2) / F.greatest(F.col("w") / 2, F.lit(1.0)))
    s = s + F.when(n.between(15, 120), 1.0).when(n <= 150, 0.4).otherwise(-0.5) - F.when(many, 0.8).otherwise(0.0)
    junk = F.size(junk_reasons(F.col("t"), F.lit(""), F.lit(False))) > 0  # five points less: below -2 in any case
    good = top.where(~junk).withColumn("s", F.round(s, 6)).where("s >= -2").groupBy(key, "t").agg(F.max(F.struct("s", (-F.col("r")).alias("r"))).alias("best"), F.first(many).alias("many"))
    five = good.withColumn("o", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("best"), "t"))).where(F.col("o") <= TITLES)
    page = Window.partitionBy(key)
    five = five.withColumns({"han": F.max(F.col("t").rlike(HAN)).over(page), "all": F.count("*").over(page)})
    late = (F.col("han") & (n >= 120)).cast("int")
    won = five.where(~(F.col("many") & (F.col("all") > 1))).groupBy(key).agg(F.min_by("t", F.struct(late, "o")).alias("title"))
    if stems is None:
        return won
    named = stems.select(key, C.title_from_stem(F.col("stem")).alias("named"))
    named = named.where(F.size(junk_reasons(F.col("named"), F.lit(""), F.lit(False))) == 0)
    return named.join(won, key, "full").select(key, F.coalesce("title", "named").alias("title")).where("title is not null")
