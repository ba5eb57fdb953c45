"""Problem 2: entries that differ in spelling only, and how many copies each had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..runtime import stored
from .p6_groups import title_key

#: Separates the parts of a canonical address; it can't occur in one.
_SEP = "\u001f"


def _decoded(c: Column) -> Column:
    """Percent-encoded characters as themselves, in lower case; a text that doesn't decode stays as it is."""
    plain = F.try_url_decode(F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))
    return F.when(~F.contains(c, F.lit("%")), F.lower(c)).otherwise(
        F.lower(F.when(F.contains(plain, F.lit("�")), c).otherwise(F.coalesce(plain, c)))
    )


def canonical_url(c: Column) -> Column:
    """The parts of an address that count, joined by a separator; null for null and blank addresses.

    Ignored are whitespace around it, letter case, the fragment, slashes at the end of the path, the scheme's default
    port, the order of parameters, empty parameters and whether a character is percent-encoded. The address is taken
    apart before it is decoded, so that an encoded ``&`` or ``?`` stays part of its value.
    """
    u = F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")
    u = F.regexp_replace(u, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")).otherwise(u)
    host = F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1))
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").when(scheme == "ftp", ":21")
    host = F.when(port.isNotNull() & F.endswith(host, port), F.regexp_replace(host, r":[0-9]+$", "")).otherwise(host)
    tail = F.regexp_replace(rest, r"^//[^/?]*", "")
    path = F.regexp_replace(_decoded(F.regexp_extract(tail, r"(?s)^([^?]*)", 1)), "/+$", "")
    query = F.regexp_extract(tail, r"(?s)^[^?]*\?(.*)$", 1)
    params = F.when(query == "", F.lit("")).otherwise(
        F.array_join(F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), _decoded)), _SEP)
    )
    whole = F.concat_ws(_SEP, scheme, _decoded(host), path, params)
    return F.when(u != "", whole)


def _hash128(c: Column) -> Column:
    return F.unhex(F.md5(c))


def collapse(entries: DataFrame, row_id: str, canon: str) -> tuple[DataFrame, DataFrame]:
    """``(groups, members)`` of the rows of ``entries`` whose canonical text is equal.

    groups: ``h`` (128 bits), ``first_id`` (least id), ``n_copies``. members: ``h``, the row's id. Rows are counted by
    their hash with map-side combining. Each hash also carries the least and greatest of a second, 64-bit hash; should
    the two ever differ, different texts share the first hash, and those are told apart by the second. Null texts and
    null ids are left out.
    """
    m = entries.where(F.col(canon).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("row_id"), _hash128(F.col(canon)).alias("h"), F.xxhash64(canon).alias("h2")
    )
    m = stored(m, "p2_members")
    g = m.groupBy("h").agg(
        F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.count("*").alias("n_copies"), F.min("h2").alias("lo"), F.max("h2").alias("hi")
    )
    g = stored(g, "p2_groups")
    if g.where("lo <> hi").limit(1).count():  # a collision of 128 bits
        m = stored(m.withColumn("h", F.concat("h", F.encode(F.hex("h2"), "utf-8"))), "p2_members")
        g = stored(
            m.groupBy("h").agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.count("*").alias("n_copies")), "p2_groups"
        )
    return g.select("h", "first_id", "last_id", "n_copies"), m.select("h", "row_id")


def copies(entries: DataFrame, row_id: str, canon: str) -> DataFrame:
    """``(first_id, copy_id)``: each row that isn't the first of its group."""
    groups, members = collapse(entries, row_id, canon)
    total, hottest = groups.agg(F.coalesce(F.sum("n_copies"), F.lit(0)), F.coalesce(F.max("n_copies"), F.lit(0))).first()
    dim = groups.where("first_id <> last_id").select("h", "first_id", "n_copies")
    got = lookup(members, dim, "h", "n_copies", total, hottest)
    return got.where("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"))


def _entries(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str]]:
    papers = spark.read.parquet(f"{sf_dir}/library_papers.parquet").select("paper_id", title_key(F.col("title")).alias("canon"))
    marks = spark.read.parquet(f"{sf_dir}/bookmarks.parquet").select("item_id", canonical_url(F.col("url")).alias("canon"))
    return [("library_papers", papers, "paper_id"), ("bookmarks", marks, "item_id")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each copy of a title or an address."""
    parts = [copies(df, i, "canon").select(F.lit(t).alias("tbl"), "first_id", "copy_id").distinct() for t, df, i in _entries(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tbl, first_id, n_copies)``: every entry once, with the number of rows it had."""
    parts = [collapse(df, i, "canon")[0].select(F.lit(t).alias("tbl"), "first_id", "n_copies") for t, df, i in _entries(spark, sf_dir)]
    return parts[0].unionByName(parts[1])
