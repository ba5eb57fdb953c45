"""Sources: tables, files of a library, landed responses, bookmark trees; and the sinks beside them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..runtime import stored

EXCLUDED = "/_excluded/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_files(spark: SparkSession, library: str, root: str, pattern: str = "*.pdf") -> DataFrame:
    """The files of one library without their contents: path, relative path, folder, stem, size, time, cache key.

    Only the listing is read; excluded folders are dropped before anything is opened. A scan leaves empty files out, so
    those come from the listing itself, with a null time.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    listed = f.select("path").inputFiles()
    f = f.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    if listed:
        every = spark.createDataFrame([(x,) for x in listed], "listed string").select(F.regexp_replace("listed", "^file:/+", "file:/").alias("path"))
        empty = every.join(f.select("path"), "path", "left_anti")
        f = f.unionByName(empty.select("path", F.lit(0).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("mtime")))
    f = f.where(~F.contains("path", F.lit(EXCLUDED)))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    stem = F.regexp_replace(F.regexp_extract(rel, r"([^/]*)$", 1), r"\.[^.]*$", "")
    folder = F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise("_root")
    return f.select(
        F.lit(library).alias("library"), folder.alias("folder"), stem.alias("stem"), rel.alias("rel_path"), "path", "size_bytes", "mtime",
        C.cache_key(F.col("path"), F.unix_seconds("mtime"), F.col("size_bytes")).alias("ckey"),
    )


def scan_libraries(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """All libraries; one whose folder is missing is skipped."""
    out = None
    for name, root in sorted(roots.items()):
        try:
            got = scan_files(spark, name, root)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no library has a folder")
    return out


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON; lines that don't parse, or a missing file, leave nothing."""
    try:
        return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache().where("_corrupt is null").drop("_corrupt")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def bookmark_tree(spark: SparkSession, path: str) -> DataFrame:
    """A browser's bookmark file, flattened: ``title, url, date_added, path``. The tree is walked on the driver: it is one
    small file for each user. Kept are addresses below a folder ``topics``; folders named after work are left out."""
    with open(path, encoding="utf-8") as f:
        roots = json.load(f).get("roots", {})
    rows: list[tuple] = []
    todo = [(n, (k,)) for k, n in roots.items() if isinstance(n, dict)]
    while todo:
        node, at = todo.pop()
        if node.get("type") == "url":
            url = node.get("url") or ""
            if "topics" in at and url and not url.lower().startswith("javascript:"):
                rows.append((node.get("name") or "", url, str(node.get("date_added") or ""), list(at)))
            continue
        here = (*at, node["name"]) if node.get("name") and node["name"] != at[-1] else at
        if not any("SANY" in p.upper() for p in here):
            todo += [(c, here) for c in reversed(node.get("children", []))]
    df = spark.createDataFrame(rows, "title string, url string, date_added string, path array<string>")
    return df.withColumn("date_added", C.browser_seconds(F.col("date_added"))).withColumn("folder_topic", C.topic_of(F.col("path"))).withColumn("folder", C.folder_label(F.col("path")))


def favourites(pages: DataFrame) -> DataFrame:
    """Landed pages of favourites, ``lists ARRAY<ARRAY<STRUCT<...>>>``, as rows; a list that failed is null and adds none."""
    return pages.select(F.explode("lists").alias("items")).where("items is not null").select(F.inline("items"))


def favourite_title(title: Column, question: Column, excerpt: Column, kind: Column) -> Column:
    return F.coalesce(C.presence(title), C.presence(question), C.presence(F.substring(excerpt, 1, 120)), C.presence(kind), F.lit("untitled"))


def atom_entry(xml: Column) -> Column:
    """Title, summary, date and authors of a feed's first entry; null without one."""
    entry = F.regexp_extract(xml, r"(?s)<entry>(.*?)</entry>", 1)
    one = lambda tag: C.presence(F.trim(F.regexp_replace(F.regexp_extract(entry, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"\s+", " ")))
    names = F.regexp_extract_all(entry, F.lit(r"<name>([^<]*)</name>"), F.lit(1))
    return F.when(entry != "", F.struct(one("title").alias("title"), one("summary").alias("abstract"), F.substring(one("published"), 1, 10).alias("published"), names.alias("authors")))


def tagged_response(raw: Column) -> Column:
    """Tags out of a model's answer: a code fence is taken off; a list, or an object with one in ``items``."""
    body = C.stripped(F.regexp_replace(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?", ""), r"```\s*\z", ""))
    item = "array<struct<id:string,tags:array<string>>>"
    return F.when(F.startswith(body, F.lit("[")), F.from_json(body, item)).otherwise(F.from_json(body, f"items {item}").getField("items"))


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A new version of a table beside the old ones; readers of an old one aren't disturbed."""
    out = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(out)
    return out


def numbered(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """``df`` with a dense number by ``order``, from 0. Ranges are sorted apart; only their sizes meet on the driver."""
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "numbered")
    sizes = {r._p: (r.n, r.lo) for r in parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("lo")).collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at - sizes[p][1]))
        at += sizes[p][0]
    shift = df.sparkSession.createDataFrame(starts, "_p int, _s long")
    return parts.join(F.broadcast(shift), "_p").withColumn(name, F.col("_m") + F.col("_s")).drop("_p", "_m", "_s")


def write_unparsed(rows: DataFrame, path: str) -> None:
    """What isn't shown, as JSON lines, newest version only."""
    rows.write.mode("overwrite").json(path)


def manifest(excluded: DataFrame, path: str) -> None:
    """What was excluded and why, as JSON lines; no file is moved."""
    excluded.where("exclude_reason is not null").select("library", "rel_path", "file_path", "title", F.col("exclude_reason").alias("reason"), "size_bytes").write.mode("overwrite").json(path)


def published(papers: DataFrame, public: bool) -> DataFrame:
    """What a page gets: the shown part of the abstract; the times only for the owner."""
    p = papers.withColumn("abstract", F.substring("abstract", 1, 400))
    return p.drop("mtime", "birthtime", "cached_at") if public else p
