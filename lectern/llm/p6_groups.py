"""Problem 6: one group identifier for all records tied by preprint id or title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import letters_and_digits
from ..operators.skew import lookup
from ..runtime import stored
from .components import components
from .ids import well_formed_id

MIN_TITLE_KEY = 12


def title_key(c) -> F.Column:
    """The title key; null where it is too short to be compared."""
    k = letters_and_digits(c)
    return F.when(F.length(k) >= MIN_TITLE_KEY, k)


def _stars(nodes: DataFrame, key: str) -> DataFrame:
    """Each node of a key tied to the key's least node."""
    least = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    total, hottest = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tied = lookup(nodes.select("rep", key), least, key, "n", total, hottest)
    return tied.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def record_groups(papers: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """``(group_id, paper_id)`` of every record in a group of two or more; ``group_id`` is the group's least id.

    Records are tied by equal well-formed preprint ids or equal title keys, directly or through others. Records that
    agree in both, copies above all, are first merged into one node with map-side combining, so that a group of copies
    costs one node. Null, blank, malformed ids and null or short titles tie nothing; records without an id column value
    are left out; a row repeated under its id counts once. Other columns are ignored.
    """
    key = F.concat_ws("\u0001", F.coalesce("wid", F.lit("")), F.coalesce("key", F.lit("")))
    rec = papers.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("paper_id"), well_formed_id(F.col("arxiv_id")).alias("wid"), title_key(F.col("title")).alias("key")
    )
    rec = rec.where("wid is not null or key is not null").select(
        "paper_id", "wid", F.unhex(F.md5("key")).alias("tkey"), F.unhex(F.md5(key)).alias("nk")
    )
    rec = stored(rec, "p6_records")
    nodes = rec.groupBy("nk").agg(
        F.first("wid").alias("wid"), F.first("tkey").alias("tkey"), F.min("paper_id").alias("rep"), F.max("paper_id").alias("last"), F.count("*").alias("n")
    )
    nodes = stored(nodes, "p6_nodes")
    comp = components(_stars(nodes, "wid").unionByName(_stars(nodes, "tkey"))).withColumnRenamed("node", "rep")
    dim = nodes.join(comp, "rep", "left").where("component is not null or rep <> last")
    dim = dim.select("nk", F.coalesce("component", "rep").alias("group_id"), "n")
    total, hottest = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return lookup(rec.select("nk", "paper_id"), dim, "nk", "n", total, hottest).select("group_id", "paper_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See :func:`record_groups`."""
    return record_groups(spark.read.parquet(f"{sf_dir}/library_papers.parquet"))
