"""Quality checks of records and tags, and the confidence that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import rules as R
from ..functions.clean import let
from ..runtime import stored
from .skew import lookup

MIN_ABSTRACT = 80
NEEDS_LOOKUP = ("title_is_filename", "junk_title", "missing_abstract", "missing_pub_year", "invalid_arxiv_id", "suspicious_tag", "folder_topic_mismatch")
LOW_CONFIDENCE = 0.55


def _issue(when: Column, kind: str, severity: str, detail: Column | None = None) -> Column:
    d = F.coalesce(detail.cast("string"), F.lit("")) if detail is not None else F.lit("")
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), d.alias("detail")))


def _words(c: str) -> Column:
    return F.array(*map(F.lit, c.split())) if c else F.array().cast("array<string>")


def metadata_issues(as_of: int) -> list[Column]:
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    year, month = F.col("pub_year"), F.col("pub_month")
    out = [_issue(F.coalesce("title_is_filename", F.lit(False)) & (abstract == ""), "title_is_filename", "warning", F.substring(title, 1, 120))]
    out += [_issue(title.rlike(p), "junk_title", "warning", F.lit(reason)) for reason, p in R.VALIDATOR_JUNK]
    out += [
        _issue(abstract == "", "missing_abstract", "warning"),
        _issue((abstract != "") & (F.length(abstract) < MIN_ABSTRACT), "short_abstract", "info", F.length(abstract)),
        _issue(year.isNull(), "missing_pub_year", "warning"),
        _issue(year.isNotNull() & ~C.plausible_year(year, as_of), "implausible_pub_year", "warning", year),
        _issue(month.isNotNull() & ~month.between(1, 12), "implausible_pub_month", "warning", month),
        _issue(C.invalid_preprint_id(F.col("arxiv_id"), as_of), "invalid_arxiv_id", "error", F.col("arxiv_id")),
    ]
    return out


def _word_map(layers: tuple[str, ...]) -> Column:
    return F.create_map(*[v for x in layers for t in R.TAXONOMY[x] for v in (F.lit(f"{x}:{t}"), F.array(*map(F.lit, R.tag_words(x, t))))])


def tag_issues(x: Column) -> list[Column]:
    """Tags without one of their words in the text, a topic that the words suggest, tags that contradict the text."""
    t = x["toks"]
    some = F.size(t) > 0
    out = []
    none = (F.size(x["topic"]) == 0) | F.array_contains(x["topic"], "Uncategorized")
    # a tag needs two of its words: only where none is set are the words looked at
    suggest = F.coalesce(*[F.when(some & none & (F.size(F.array_intersect(F.array(*map(F.lit, R.tag_words("topic", tag))), t)) >= 2), F.lit(tag)) for tag in R.TAXONOMY["topic"]])
    out.append(_issue(some & none & suggest.isNotNull(), "missing_topic", "info", suggest))
    for tag, layers, words in R.CONTRADICTIONS:
        for layer in layers:
            out.append(_issue(some & F.array_contains(x[layer], tag) & ~F.arrays_overlap(_words(words), t), "contradictory_tag", "warning", F.lit(f"{layer}:{tag}")))
    return out


def _prefixed(tags: Column, prefix: str) -> Column:
    return F.transform(tags, lambda t: F.concat(F.lit(prefix), t))


def doubtful_tags(x: Column) -> Column:
    """An issue for each tag that a record has without one of its words, in the layers' order."""
    words, t = _word_map(R.LAYERS), x["toks"]
    names = F.concat(*[_prefixed(x[layer], f"{layer}:") for layer in R.LAYERS])
    bad = F.filter(names, lambda n: (F.size(t) > 0) & ~F.coalesce(F.arrays_overlap(F.try_element_at(words, n), t), F.lit(True)))
    return F.transform(bad, lambda n: F.struct(F.lit("suspicious_tag").alias("type"), F.lit("warning").alias("severity"), n.alias("detail")))


def folder_issues(x: Column) -> list[Column]:
    """Records whose tags or words have nothing of what their folder stands for. Folders that take anything are spared."""
    out, toks, have = [], x["toks"], F.concat(x["topic"], x["folder_tags"], x["method"])
    for folder, (topics, words) in R.FOLDER_HINTS.items():
        here = F.coalesce(F.col("folder") == folder, F.lit(False))
        if topics:
            out.append(_issue(here & ~F.arrays_overlap(have, F.array(*map(F.lit, topics))), "folder_topic_mismatch", "warning", F.lit(folder)))
        if folder.startswith("paper-") or folder in R.FOLDER_TAGS:
            out.append(_issue(here & (F.size(toks) > 0) & ~F.arrays_overlap(_words(words), toks), "folder_content_mismatch", "info", F.lit(folder)))
    return out


def validated(layers: DataFrame, as_of: int) -> DataFrame:
    """Adds ``issues`` (type, severity, detail) and ``confidence``. Needs the rule layers and ``folder_tags``."""
    toks = F.array_distinct(C.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))))
    # tokens and tags are bound once: as plain columns they would be worked out again in each of the checks
    bound = F.struct(toks.alias("toks"), *R.LAYERS, "folder_tags")
    checks = F.concat(F.array_compact(F.array(*metadata_issues(as_of))), let(bound, lambda x: F.concat(doubtful_tags(x), F.array_compact(F.array(*tag_issues(x), *folder_issues(x))))))
    return layers.withColumn("issues", checks).withColumn("confidence", let(F.col("issues"), confidence))


def confidence(issues: Column) -> Column:
    """1, less 0.25 for an error, 0.08 for a warning (0.05 for a doubtful tag), 0.02 for a missing topic; less 0.15, 0.10
    and 0.08 for a file's name as title, no abstract and no year; between 0 and 1."""
    worth = lambda i: F.when(i.severity == "error", 0.25).when(i.severity == "warning", F.when(i.type == "suspicious_tag", 0.05).otherwise(0.08)).when(i.type == "missing_topic", 0.02).otherwise(0.0)
    loss = F.aggregate(issues, F.lit(0.0), lambda a, i: a + worth(i))
    loss = loss + F.when(F.coalesce("title_is_filename", F.lit(False)), 0.15).otherwise(0.0) + F.when(F.coalesce("abstract", F.lit("")) == "", 0.10).otherwise(0.0)
    loss = loss + F.when(F.coalesce("pub_year", F.lit(0)) == 0, 0.08).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - loss)), 3)


def needs_lookup() -> Column:
    return (F.col("confidence") < LOW_CONFIDENCE) | F.arrays_overlap(F.transform("issues", lambda i: i.type), F.array(*map(F.lit, NEEDS_LOOKUP)))


def title_conflicts(papers: DataFrame) -> DataFrame:
    """``(title_key, n, n_ids)``: titles of more than ten characters that records of different ids share."""
    t = F.lower(F.trim("title"))
    g = papers.where(F.length(t) > 10).groupBy(t.alias("title_key")).agg(F.count("*").alias("n"), F.count_distinct(C.presence(F.col("arxiv_id"))).alias("n_ids"))
    return g.where("n > 1 and n_ids > 1")


def with_title_conflicts(validated_papers: DataFrame) -> DataFrame:
    """``issues`` with the conflict of each title that records of different ids share. The titles are a hot key's worth
    of rows at most each, and few: they are looked up."""
    t = F.lower(F.trim("title"))
    bad = stored(title_conflicts(validated_papers).select(F.col("title_key").alias("_t"), "n", F.lit(True).alias("_bad")), "title_conflicts")
    total, hottest = bad.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    j = lookup(validated_papers.withColumn("_t", t), bad, "_t", "n", total, hottest, "left")
    one = F.array(F.struct(F.lit("duplicate_title_conflict").alias("type"), F.lit("warning").alias("severity"), F.col("_t").alias("detail")))
    return j.withColumn("issues", F.when(F.col("_bad"), F.concat("issues", one)).otherwise(F.col("issues"))).drop("_t", "_bad")


def flags() -> Column:
    """The kinds of a record's errors and warnings, sorted."""
    loud = F.filter("issues", lambda i: i.severity.isin("error", "warning"))
    return F.array_sort(F.array_distinct(F.transform(loud, lambda i: i.type)))


def _issue_counts(v: DataFrame, kinds: tuple[str, ...], most: int) -> DataFrame:
    each = v.select(F.explode_outer(F.filter("issues", lambda i: i.type.isin(*kinds))).alias("i")).where("i is not null")
    return each.groupBy(F.col("i.detail").alias("detail")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detail").limit(most)


def suspicious_tags(v: DataFrame, most: int = 20) -> DataFrame:
    """``(layer, tag, n)`` of the tags that most often lack support in the text."""
    return _issue_counts(v, ("suspicious_tag",), most).select(F.substring_index("detail", ":", 1).alias("layer"), F.regexp_replace("detail", "^[^:]*:", "").alias("tag"), "n")


def folder_mismatches(v: DataFrame, most: int = 20) -> DataFrame:
    """``(folder, n)`` of the folders whose records most often don't fit them."""
    return _issue_counts(v, ("folder_topic_mismatch", "folder_content_mismatch"), most).withColumnRenamed("detail", "folder")


def category_report(tagged: DataFrame) -> DataFrame:
    """``(metric, n, share)``: records with each layer, without a topic, with a folder tag that repeats a topic."""
    bare = (F.size("topic") == 0) | (F.col("topic") == F.array(F.lit("Uncategorized")))
    tests = {**{f"has_{x}": F.size(x) > 0 for x in (*R.LAYERS, "keyword")}, "no_topic": bare, "folder_in_topic": F.arrays_overlap("folder_tags", "topic")}
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(c, F.lit(False)).alias("yes")) for k, c in tests.items()])
    g = tagged.select(F.inline(each)).groupBy("metric").agg(F.count_if("yes").alias("n"), F.count("*").alias("of"))
    return g.select("metric", "n", F.round(100.0 * F.col("n") / F.greatest("of", F.lit(1)), 1).alias("share"))


TITLE_MATCH, MAX_SUGGESTIONS = 0.7, 5


def against_response(papers: DataFrame, title: Column, text: Column) -> DataFrame:
    """Adds ``status`` (not_found, mismatch, verified), ``similarity`` of the titles, and ``suggestions``: tags, in the
    rules' order, that the record lacks (array ``mine``) though the response's ``text`` has two of their words.

    A record without a title stands with its file's name. A null ``title`` is no response.
    """
    own = F.coalesce(C.presence(F.col("title")), "stem")
    # worked out once each
    p = papers.withColumn("_sim", F.round(C.token_similarity(C.title_tokens(own), C.title_tokens(title)), 3))
    hit = lambda t, x, tag: F.when(~F.array_contains("mine", tag) & (F.size(F.array_intersect(F.array(*map(F.lit, R.tag_words(x, tag))), t)) >= 2), tag)
    tips = let(F.array_distinct(C.tokens(text)), lambda t: F.array_compact(F.array(*[hit(t, x, tag) for x in R.LAYERS for tag in R.TAXONOMY[x]])))
    there = title.isNotNull()
    status = F.when(~there, "not_found").when(F.col("_sim") < TITLE_MATCH, "mismatch").otherwise("verified")
    return p.withColumns({"status": status, "similarity": F.when(there, F.col("_sim")), "suggestions": F.when(there, F.slice(tips, 1, MAX_SUGGESTIONS))}).drop("_sim")


def layer_coverage(layers: DataFrame) -> DataFrame:
    """``(layer, n, share)``: records with a tag of the layer, in percent of all."""
    each = F.array(*[F.struct(F.lit(x).alias("layer"), (F.size(x) > 0).alias("has")) for x in R.LAYERS])
    g = layers.select(F.inline(each)).groupBy("layer").agg(F.count_if("has").alias("n"), F.count("*").alias("of"))
    return g.select("layer", "n", F.round(100.0 * F.col("n") / F.col("of"), 1).alias("share"))
