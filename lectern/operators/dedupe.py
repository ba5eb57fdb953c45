"""Duplicates: exact keys, similar titles, groups, the record to keep, and one entry for each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..runtime import Stored
from .clean import with_junk
from .skew import HOT_ROWS, lookup

THRESHOLD = 0.92
MIN_TITLE = 10


def dedupe_keys(papers: DataFrame, as_of: int) -> DataFrame:
    """``(paper_id, wid, norm, toks)``: the valid id, the normalized title and its tokens."""
    aid = F.col("arxiv_id")
    return papers.select(
        "paper_id", F.when(C.valid_preprint_id(aid, as_of), C.stripped(aid)).alias("wid"), C.normalized_title(F.col("title")).alias("norm"), C.title_tokens(F.col("title")).alias("toks")
    )


def _stars(rows: DataFrame, key: Column, only: Column | None = None) -> DataFrame:
    """``(a, b)``: each record tied to the least record of its key. ``only`` tests a key, by its ``ids`` as well.

    A key of any size is allowed: its least record is found with map-side combining and looked up as a hot key.
    """
    r = rows.select(key.alias("k"), "paper_id", "wid")
    least = r.groupBy("k").agg(F.min("paper_id").alias("b"), F.max("paper_id").alias("last"), F.count("*").alias("n"), F.count_distinct("wid").alias("ids"))
    least = Stored(least.where("b <> last" if only is None else (F.col("b") != F.col("last")) & only).select("k", "b", "n"), "stars").df
    total, hottest = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return lookup(r.select("k", F.col("paper_id").alias("a")), least, "k", "n", total, hottest).where("a <> b").select("a", "b")


def exact_edges(keys: DataFrame) -> DataFrame:
    """Records of one id; records of one normalized title of more than MIN_TITLE characters with at most one id among them."""
    by_id = _stars(keys.where("wid is not null"), F.col("wid"))
    return by_id.unionByName(_stars(keys.where(F.length("norm") > MIN_TITLE), F.col("norm"), F.col("ids") <= 1))


def mismatches(m: Column) -> Column:
    """How many tokens two sets of at most ``m`` may differ by and still be similar: the greatest k < (1 - THRESHOLD) m."""
    return F.ceil(F.round((1 - THRESHOLD) * m, 6) - 1).cast("int")


def similar_edges(keys: DataFrame) -> DataFrame:
    """``(a, b)``: titles whose token similarity exceeds THRESHOLD, unless two different ids forbid it.

    Equal token sets meet by the set, where only the least id of each preprint id, and the least without one, stand for
    the rest. Sets that differ meet by the prefixes of their rarest tokens: one more than the mismatches they may have.
    """
    k = keys.where(F.size("toks") > 0).withColumn("m", F.size("toks"))
    reps = k.groupBy("toks", "m", "wid").agg(F.min("paper_id").alias("paper_id"))
    same = _equal_set_edges(k)
    long = reps.where(F.col("m") / (F.col("m") + 1) > THRESHOLD)  # shorter sets are similar to none but their equals
    df = long.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    df = Stored(df, "title_tokens").df
    total, hottest = df.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    dim = df.withColumn("n", F.col("df"))
    ranked = lookup(long.select("paper_id", "wid", "toks", "m", F.explode("toks").alias("t")), dim, "t", "n", total, hottest)
    w = Window.partitionBy("paper_id").orderBy("df", "t")
    prefix = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= mismatches(F.col("m")) + 1)
    x = prefix.select("t", F.col("paper_id").alias("a"), F.col("wid").alias("wa"), F.col("toks").alias("ta"))
    y = prefix.select("t", F.col("paper_id").alias("b"), F.col("wid").alias("wb"), F.col("toks").alias("tb"))
    near = x.join(y, "t").where((F.col("a") < F.col("b")) & (C.token_similarity(F.col("ta"), F.col("tb")) > THRESHOLD))
    near = near.where(~F.coalesce(F.col("wa") != F.col("wb"), F.lit(False)))
    return same.unionByName(near.select("a", "b")).distinct()


def _equal_set_edges(k: DataFrame) -> DataFrame:
    """Within one token set: records of one id, and records without an id with everything (they conflict with nothing)."""
    inner = _stars(k, F.struct("toks", "wid"))
    by_id = k.groupBy("toks", "wid").agg(F.min("paper_id").alias("b"))
    free = by_id.where("wid is null").select("toks", F.col("b").alias("free"))
    across = by_id.where("wid is not null").join(free, "toks").select(F.col("b").alias("a"), F.col("free").alias("b"))
    return inner.unionByName(across)


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(paper_id, component)`` for every node: the least id it is linked to, directly or through others.

    Labels spread along the edges and then jump to their label's label, until none changes; every state is a table in
    the shared folder. The least label moves on in each round, so the rounds end. Nodes of many edges and labels of many
    nodes are looked up as hot keys.
    """
    both = Stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "label_edges")
    now = Stored(nodes.select("paper_id", F.col("paper_id").alias("component")), "labels")
    n_nodes, n_edges = now.df.count(), both.df.count()
    ends = Stored(both.df.groupBy("b").agg(F.count("*").alias("n")), "label_ends").df
    busiest = ends.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while True:
        of = now.df.select(F.col("paper_id").alias("b"), "component").join(ends, "b")
        seen = lookup(both.df, of, "b", "n", n_edges, busiest).groupBy("a").agg(F.min("component").alias("seen"))
        step = now.df.join(seen, F.col("paper_id") == F.col("a"), "left").select("paper_id", F.least("component", F.coalesce("seen", "component")).alias("c1"), "component")
        jump = now.df.select(F.col("paper_id").alias("c1"), F.col("component").alias("c2"))
        # no label can be hot among few nodes
        if n_nodes <= HOT_ROWS:
            far = step.join(jump, "c1", "left")
        else:
            jump = jump.join(step.groupBy("c1").agg(F.count("*").alias("n")), "c1")
            far = lookup(step, jump, "c1", "n", n_nodes, n_nodes, "left")
        moved = Stored(far.select("paper_id", F.least("c1", "c2").alias("component"), F.col("component").alias("before")), "labels")
        changed = moved.df.where("component <> before").limit(1).count()
        now.drop()
        now = moved
        if not changed:
            return now.df.select("paper_id", "component")


def duplicate_groups(papers: DataFrame, as_of: int) -> DataFrame:
    """``(paper_id, component)`` over exact and similar titles and ids."""
    keys = Stored(dedupe_keys(papers.where("paper_id is not null"), as_of), "dedupe_keys").df
    return label_components(keys, exact_edges(keys).unionByName(similar_edges(keys)))


def keeper_score(p: DataFrame, as_of: int) -> Column:
    """Complete, self-identified, clean, well-placed, recent and large records first. Needs ``junk``."""
    abstract, rel, folder = (F.coalesce(c, F.lit("")) for c in ("abstract", "rel_path", "folder"))
    own_id = C.valid_preprint_id(F.col("arxiv_id"), as_of) & (
        F.startswith(F.coalesce("stem", F.lit("")), C.stripped(F.col("arxiv_id"))) | C.id_from_stem(F.col("stem"), as_of).isNotNull() | F.coalesce(F.col("pub_date_source").isin("pdf", "arxiv_id", "filename"), F.lit(False))
    )
    rank = F.when((folder == "paper-HKU") | F.startswith(rel, F.lit("paper-HKU/")), 0).when(F.startswith(folder, F.lit("paper-")), 1).otherwise(2)
    return F.struct(
        (F.length(abstract) > 50).cast("int").alias("s1"), F.length(abstract).alias("s2"), F.coalesce(own_id, F.lit(False)).cast("int").alias("s3"), (F.size("junk") == 0).cast("int").alias("s4"),
        (-rank).alias("s5"), (-F.length(rel)).alias("s6"), F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), F.lit(0)).alias("s7"), F.coalesce("size_bytes", F.lit(0)).alias("s8"),
    )


def kept_records(papers: DataFrame, groups: DataFrame, as_of: int) -> DataFrame:
    """One record for each component: the best by :func:`keeper_score` (ties: least id), its gaps filled by the others.

    Abstract, valid id, and year with month come from the first other member, by id, that has them, each as an
    aggregate; the source of the date follows what was filled last. ``alternate_paths`` counts the other paths.
    """
    p = with_junk(papers).join(groups, "paper_id")
    p = p.withColumn("score", keeper_score(p, as_of))
    order = F.col("paper_id")
    valid = C.valid_preprint_id(F.col("arxiv_id"), as_of)
    first = lambda cond, *cols: F.min(F.when(cond, F.struct(order.alias("o"), *[F.col(c) for c in cols])))
    g = p.groupBy("component").agg(
        F.max(F.struct("score", (-order).alias("neg"), "title", "abstract", "arxiv_id", "pub_year", "pub_month", "pub_date_source", "rel_path", "needs_review")).alias("k"),
        first(F.coalesce(F.col("abstract"), F.lit("")) != "", "abstract").alias("fa"), first(valid, "arxiv_id", "pub_date_source").alias("fi"), first(F.coalesce("pub_year", F.lit(0)) != 0, "pub_year", "pub_month", "pub_date_source").alias("fy"),
        F.bool_or(~F.coalesce("needs_review", F.lit(False))).alias("any_clear"), F.count("*").alias("n_members"), F.count_distinct("rel_path").alias("n_paths"),
    )
    k = lambda c: F.col(f"k.{c}")
    need_id, need_year = ~C.valid_preprint_id(k("arxiv_id"), as_of) & F.col("fi").isNotNull(), (F.coalesce(k("pub_year"), F.lit(0)) == 0) & F.col("fy").isNotNull()
    src_id, src_year = F.col("fi.pub_date_source"), F.col("fy.pub_date_source")
    later_id = F.col("fi.o") > F.col("fy.o")
    source = F.when(need_id & need_year, F.when(later_id, F.coalesce(src_id, src_year)).otherwise(F.coalesce(src_year, src_id))).when(need_id, src_id).when(need_year, src_year)
    return g.select(
        "component", (-k("neg")).alias("paper_id"), k("title").alias("title"), F.when(F.coalesce(k("abstract"), F.lit("")) != "", k("abstract")).otherwise(F.col("fa.abstract")).alias("abstract"),
        F.when(need_id, F.col("fi.arxiv_id")).otherwise(k("arxiv_id")).alias("arxiv_id"), F.when(need_year, F.col("fy.pub_year")).otherwise(k("pub_year")).alias("pub_year"),
        F.when(need_year, F.col("fy.pub_month")).otherwise(k("pub_month")).alias("pub_month"), F.coalesce(source, k("pub_date_source")).alias("pub_date_source"),
        (F.coalesce(k("needs_review"), F.lit(False)) & ~F.col("any_clear")).alias("needs_review"), "n_members",
        (F.col("n_paths") - F.when(k("rel_path").isNotNull(), 1).otherwise(0)).alias("n_other_paths"),
    )


def unique_bookmarks(items: DataFrame) -> DataFrame:
    """One item for each address key: the latest date, then the longest title, then the least id. Null addresses go."""
    best = F.max(F.struct(F.coalesce("date_added", F.lit(0)).alias("d"), F.length(F.coalesce("title", F.lit(""))).alias("l"), (-F.col("item_id")).alias("i"), "title"))
    g = items.where("url is not null").groupBy(C.url_key(F.col("url")).alias("url_key")).agg(best.alias("b"), F.min("item_id").alias("first_id"), F.count("*").alias("n"))
    return g.select("url_key", (-F.col("b.i")).alias("item_id"), F.col("b.d").alias("date_added"), F.col("b.title").alias("title"), "first_id", "n")
