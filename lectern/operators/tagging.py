"""Layered tags: rules, folders, categories and keywords; their counts and co-occurrence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as C
from ..functions import rules as R
from ..functions.clean import let
from ..runtime import stored
from .skew import lookup

MIN_DF, MAX_SHARE = 12, 0.25
MAX_KEYWORDS, MIN_SCORE = 3, 0.8
#: Layer -> column of a tagged record.
ALL_LAYERS = {**{x: x for x in R.LAYERS}, "folder": "folder_tags", "arxiv": "category_tags", "keyword": "keyword"}
SHOWN_TAGS, SHOWN_KEYWORDS = 200, 10


def paper_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))


def matched(text: Column, rules: dict[str, list[str]]) -> Column:
    """The tags of which a pattern occurs in the text, in the rules' order.

    A pattern is tried only where the text holds what each of its matches needs, which is a plain search for bytes.
    """

    def occurs(t: Column, p: str) -> Column:
        need = R.needed(p)
        hit = t.rlike("(?d)" + R.portable(p))
        return F.contains(t, F.lit(need)) & hit if len(need) > 1 else hit

    def tags(t: Column) -> Column:
        return F.array_compact(F.array(*[F.when(reduce(Column.__or__, [occurs(t, p) for p in ps]), F.lit(tag)) for tag, ps in rules.items()]))

    return let(text, tags)


def _map(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.array().cast("array<string>"))


def canonical(tag: Column) -> Column:
    pairs = [F.lit(x) for kv in R.TAG_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(tag)), tag)


def document_frequency(docs: DataFrame, toks: str) -> DataFrame:
    """``(term, df)``; a row's repeated terms count once."""
    return docs.select(F.explode(F.array_distinct(toks)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(docs: DataFrame, toks: str, n: int, min_df: int = MIN_DF, max_share: float = MAX_SHARE) -> DataFrame:
    """``(term, df, idf)`` of the terms that are neither rare nor common."""
    return document_frequency(docs, toks).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n)).withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row's distinct term, with its count and first place."""
    for b in batches:
        rows, terms, tf, pos = [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            n = Counter(t or ())
            first: dict[str, int] = {}
            for at, x in enumerate(t or ()):
                first.setdefault(x, at)
            rows += [i] * len(n)
            terms += n.keys()
            tf += n.values()
            pos += first.values()
        keys = b.column(0).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(pos, pa.int32())], names=[b.schema.names[0], "term", "tf", "pos"])


def _frequencies(docs: DataFrame, key: str, toks: str) -> DataFrame:
    """``(key, term, tf, pos)``: counted in the row, so that nothing is moved for it. Keys are unique."""
    d = docs.select(key, toks)
    return d.mapInArrow(_counted, T.StructType([d.schema[key], *T._parse_datatype_string("term string, tf long, pos int").fields]))


def keywords(docs: DataFrame, key: str, toks: str, vocab: DataFrame, most: int = MAX_KEYWORDS, least: float = MIN_SCORE) -> DataFrame:
    """``(key, term, score, rank)``: each row's terms of highest (1 + ln tf) idf; ties go to the first occurrence."""
    vocab = stored(vocab.select("term", "idf", "df"), "vocabulary")
    total, hottest = vocab.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    scored = lookup(_frequencies(docs, key, toks), vocab, "term", "df", total, hottest).withColumn("score", F.round((1 + F.log(F.col("tf").cast("double"))) * F.col("idf"), 9))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    return scored.where(F.col("score") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "term", "score", "rank")


def rule_layers(papers: DataFrame) -> DataFrame:
    """Adds an array for each rule layer, and the folder's and the category's tags."""
    text = paper_text()
    p = papers.withColumns({layer: matched(text, R.TAXONOMY[layer]) for layer in R.LAYERS})
    cat = F.create_map(*[F.lit(x) for kv in R.CATEGORY_TAGS.items() for x in kv])
    p = p.withColumn("folder_tags", F.array_except(_map(R.FOLDER_TAGS, F.coalesce("folder", F.lit(""))), "topic"))
    return p.withColumn("category_tags", F.array_compact(F.array(F.try_element_at(cat, F.coalesce("arxiv_cat", F.lit(""))))))


def tagged(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """Adds the rule layers, ``keyword`` and ``all_tags``.

    Keywords that equal a structural tag, aliases included, are dropped after the cut to MAX_KEYWORDS. ``all_tags`` is
    ordered: topic, method, task, modality, folder, category, keyword; the first of equal keys stays. A record without
    any tag gets ``Uncategorized`` there and as its topic.
    """
    p = rule_layers(papers)
    toks = p.select(key, C.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("toks"))
    n = papers.count()
    kw = keywords(toks, key, "toks", vocabulary(toks, "toks", n)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    p = p.join(kw.select(key, F.col("k.term").alias("kw")), key, "left")
    structural = F.concat("topic", "method", "task", "modality", "folder_tags", "category_tags")
    fold = lambda a: F.transform(a, lambda t: F.lower(canonical(t)))
    p = p.withColumn("_s", structural)
    p = p.withColumn("keyword", F.filter(F.coalesce("kw", F.array().cast("array<string>")), lambda t: ~F.array_contains(fold(F.col("_s")), F.lower(canonical(t)))))
    every = F.concat("_s", "keyword")
    first = F.filter(F.transform(every, lambda t, i: F.struct(canonical(t).alias("t"), i.alias("i"))), lambda x: F.array_position(fold(every), F.lower(x.t)) == x.i + 1)
    p = p.withColumn("all_tags", F.transform(first, lambda x: x.t)).drop("_s", "kw")
    none = F.array(F.lit("Uncategorized"))
    bare = F.size("all_tags") == 0
    return p.withColumn("topic", F.when(bare, none).otherwise(F.col("topic"))).withColumn("all_tags", F.when(bare, none).otherwise(F.col("all_tags")))


def tag_counts(tagged: DataFrame, most: int = SHOWN_TAGS) -> DataFrame:
    """``(tag, n)`` of the most frequent tags of all layers."""
    return tagged.select(F.explode_outer("all_tags").alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def tag_totals(tagged: DataFrame) -> DataFrame:
    """``(total, uncategorized, unique_tags)``. The tags are counted by value first, so that no value is gathered."""
    each = F.array_union(F.coalesce("all_tags", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))  # the null stands for the record
    n = tagged.select(F.explode(each).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return n.agg(
        F.coalesce(F.sum(F.when(F.col("tag").isNull(), F.col("n"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("tag") == "Uncategorized", F.col("n"))), F.lit(0)).alias("uncategorized"), F.count("tag").alias("unique_tags"),
    )


def all_layer_counts(tagged: DataFrame, least_keyword: int = SHOWN_KEYWORDS) -> DataFrame:
    """``(layer, tag, n)`` of all layers; keywords from ``least_keyword`` records on."""
    each = F.array(*[F.struct(F.lit(x).alias("layer"), F.col(c).alias("tags")) for x, c in ALL_LAYERS.items()])
    long = tagged.select(F.inline(each)).select("layer", F.explode_outer("tags").alias("tag")).where("tag is not null")
    n = long.groupBy("layer", "tag").agg(F.count("*").alias("n"))
    return n.where((F.col("layer") != "keyword") | (F.col("n") >= least_keyword))


def tag_layer(tag: Column) -> Column:
    """The first layer of a tagged record that has the tag; ``topic`` if none has."""
    return F.coalesce(*[F.when(F.array_contains(c, tag), x) for x, c in ALL_LAYERS.items()], F.lit("topic"))


def short_tags(most: int = 3) -> Column:
    """At most two tags each of topic, task and method, ``most`` in all, for a summary's input."""
    two = lambda c: F.slice(F.filter(c, lambda t: t != "Uncategorized"), 1, 2)
    return F.coalesce(C.presence(F.array_join(F.slice(F.array_distinct(F.concat(two("topic"), two("task"), two("method"))), 1, most), "、")), F.lit("未分类"))


def resolved_tags(items: DataFrame, cache: DataFrame, answers: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """Adds ``resolved`` and ``origin``: tags of a model's answer, else of the cache if it is of ``version``, else by rule.

    ``cache`` and ``answers`` have the key, ``tags`` and ``order``; of repeated keys the first by ``order`` counts. Null
    keys match nothing.
    """
    one = lambda t, name: t.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("tags", *(["version"] if name == "c" else [])), order).alias(f"_{name}"))
    j = bookmark_rule_tags(items).join(one(cache, "c"), key, "left").join(one(answers, "m"), key, "left")
    cached = F.when(F.col("_c.version") == version, F.col("_c.tags"))
    origin = F.when(F.col("_m.tags").isNotNull(), "model").when(cached.isNotNull(), "cache").otherwise("rule")
    return j.withColumns({"resolved": F.coalesce("_m.tags", cached, "rule_tags"), "origin": origin}).drop("_c", "_m")


def long_tags(layers: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(key, layer, tag, ord)`` of the rule layers.

    The outer form of explode keeps Spark from filtering by the array first, which would match every rule twice.
    """
    each = F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("tags")) for x in R.LAYERS])
    return layers.select(key, F.inline(each)).select(key, "layer", F.posexplode_outer("tags").alias("ord", "tag")).where("tag is not null")


def cooccurrence(layers: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(tag_a, tag_b, n)``: pairs of different places in a record's topic, method and task tags, both ways round.

    A tag in two layers meets itself. A record has a few tags, so pairs come from its own array, without a join.
    """
    t = F.concat("topic", "method", "task")
    pairs = F.flatten(F.transform(t, lambda a, i: F.transform(F.filter(t, lambda b, j: j != i), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    return layers.select(F.inline_outer(pairs)).where("tag_a is not null").groupBy("tag_a", "tag_b").agg(F.count("*").alias("n"))


def top_cooccurrence(pairs: DataFrame, tags: int = 60, partners: int = 20) -> DataFrame:
    """The tags of the largest row sums, each with its most frequent partners. One row for each pair of tags goes in."""
    sums = pairs.groupBy("tag_a").agg(F.sum("n").alias("row_sum")).orderBy(F.desc("row_sum"), "tag_a").limit(tags)
    w = Window.partitionBy("tag_a").orderBy(F.desc("n"), "tag_b")
    return pairs.join(sums, "tag_a").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= partners)


def bookmark_rule_tags(items: DataFrame) -> DataFrame:
    """Adds ``rule_tags``: at most three topical tags and one of the kind of page; else two of those; else the domain's."""
    text = F.lower(F.concat_ws(" ", C.presence(F.col("title")), C.presence(F.col("url")), C.presence(F.col("url_domain"))))
    hits, meta = matched(text, R.BOOKMARK_TAGS), F.array(*map(F.lit, R.BOOKMARK_META))
    topical, kind = F.array_except(hits, meta), F.filter(hits, lambda t: F.array_contains(meta, t))
    domain = F.lower(F.coalesce("url_domain", F.lit("")))
    default = F.when(F.contains(domain, F.lit("github.com")), "Foundation Model").when(F.contains(domain, F.lit("arxiv")), "Paper / arXiv").otherwise("General Tech")
    tags = F.when(F.size(topical) > 0, F.concat(F.slice(topical, 1, 3), F.slice(kind, 1, 1))).when(F.size(kind) > 0, F.slice(kind, 1, 2)).otherwise(F.array(default))
    return items.withColumn("rule_tags", tags)
