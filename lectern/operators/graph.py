"""Content-similarity graph: sparse TF-IDF cosine, with bonuses for tags, folder and year."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored
from .skew import lookup

CANDIDATES, NEIGHBOURS = 300, 15
MIN_DF, MAX_SHARE = 2, 0.65
#: Query rows in a pass over all rows. A task numbers them in Q_BITS bits, and its own rows in ROW_BITS.
QUERIES = 12_000
Q_BITS, SHARED_BITS, ROW_BITS = 14, 18, 31
#: A term in more than one of so many query rows is counted as a whole vector, others by their postings.
DENSE = 64


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct terms and their numbers."""
    for b in batches:
        terms, tf = [], []
        for t in b.column(1).to_pylist():
            c = Counter(x for x in t or () if x is not None)
            terms.append(list(c))
            tf.append(list(c.values()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string())), pa.array(tf, pa.list_(pa.int32()))], names=["k", "terms", "tf"])


class _Batch:
    """Vectors of some query rows: by row, and as postings of their terms."""

    def __init__(self, rows: pa.Table):
        self.keys = rows["k"].to_numpy()
        if len(self.keys) >= 1 << Q_BITS:
            raise ValueError("too many query rows in a pass")
        terms, w, idf = (rows[c].combine_chunks() for c in ("terms", "w", "idf"))
        n = pc.list_value_length(terms).to_numpy()
        flat = pc.list_flatten(terms)
        self.vocab = pc.unique(flat)
        self.t = pc.index_in(flat, value_set=self.vocab).to_numpy()
        self.w = pc.list_flatten(w).to_numpy()
        self.idf = np.zeros(len(self.vocab))
        self.idf[self.t] = pc.list_flatten(idf).to_numpy()
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.number = {k: q for q, k in enumerate(self.keys.tolist())}

    def postings(self) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        """The query rows of each term, and for a frequent one the vector that has a one for each of them."""
        q = np.repeat(np.arange(len(self.keys)), np.diff(self.at))
        by = np.argsort(self.t, kind="stable")
        posts = np.split(q[by], np.cumsum(np.bincount(self.t, minlength=len(self.vocab)))[:-1])
        whole: list[np.ndarray | None] = [None] * len(posts)
        for t, p in enumerate(posts):
            if len(p) * DENSE > len(self.keys):
                whole[t] = np.zeros(len(self.keys), np.uint8)
                whole[t][p] = 1
        return posts, whole


def _shared(batch: _Batch):
    """For each query row the CANDIDATES rows of a task that share most terms with it; the rows come sorted by key."""

    def best(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The first CANDIDATES of each query row, and its places that are left."""
        x = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
        q = x >> (SHARED_BITS + ROW_BITS)
        first = np.searchsorted(q, np.arange(len(batch.keys)))
        return x[np.arange(len(x)) - first[q] < CANDIDATES], CANDIDATES - np.bincount(q, minlength=len(batch.keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts, whole = batch.postings()
        nq, top = len(batch.keys), (1 << SHARED_BITS) - 1
        base = np.arange(nq, dtype=np.int64) << (SHARED_BITS + ROW_BITS)
        least = np.zeros(nq, np.int32)  # rows that share no more come too late
        few = least.astype(np.uint8)
        found, size, keys, row = [], 0, [], 0
        for b in batches:
            keys.append(b.column(0).to_numpy())
            lists = b.column(1)
            at = lists.offsets.to_numpy()
            term = pc.fill_null(pc.index_in(lists.values, value_set=batch.vocab), -1).to_numpy()
            for r, k in enumerate(keys[-1].tolist()):
                mine = term[at[r] : at[r + 1]]
                mine = mine[mine >= 0].tolist()
                if len(mine) > top:
                    raise ValueError("a row has too many terms")
                n = None
                for lo in range(0, len(mine), 255):
                    c = np.zeros(nq, np.uint8)
                    for t in mine[lo : lo + 255]:
                        if whole[t] is None:
                            c[posts[t]] += 1
                        else:
                            np.add(c, whole[t], out=c)
                    n = c if len(mine) <= 255 else c.astype(np.int32) if n is None else n + c
                if n is not None:
                    if k in batch.number:
                        n[batch.number[k]] = 0
                    q = np.flatnonzero(n > (few if n.dtype == np.uint8 else least))
                    found.append(base[q] + ((top - n[q].astype(np.int64)) << ROW_BITS) + row)
                    size += len(q)
                row += 1
                if size > 2 * CANDIDATES * nq + 100_000:
                    x, free = best(found)
                    found, size = [x], len(x)
                    last = np.searchsorted(x >> (SHARED_BITS + ROW_BITS), np.arange(nq), side="right") - 1
                    least = np.where(free <= 0, top - ((x[last] >> ROW_BITS) & top), 0).astype(np.int32)
                    few = np.minimum(least, 255).astype(np.uint8)
        x, _ = best(found)
        if len(x):
            q, edge = np.unique(x >> (SHARED_BITS + ROW_BITS), return_index=True)
            offsets = pa.array(np.append(edge, len(x)).astype(np.int32))
            dst = np.concatenate(keys)[x & ((1 << ROW_BITS) - 1)]
            less = -(top - ((x >> ROW_BITS) & top)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(batch.keys[q]), pa.ListArray.from_arrays(offsets, pa.array(less)), pa.ListArray.from_arrays(offsets, pa.array(dst))], names=["src", "less", "dst"])

    return run


def _dots(batch: _Batch):
    """Each row's products with the query rows whose candidate it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tf, norm, asked = b.column(1), b.column(2).values.to_numpy(), b.column(3).to_numpy(), b.column(4)
            at, ask_at = terms.offsets.to_numpy(), asked.offsets.to_numpy()
            term = pc.fill_null(pc.index_in(terms.values, value_set=batch.vocab), -1).to_numpy()
            src = np.array([batch.number[k] for k in asked.values.to_pylist()], np.int64)
            dot = np.zeros(len(src))
            v = np.zeros(len(batch.vocab))
            for r in range(b.num_rows):
                t, n = term[at[r] : at[r + 1]], tf[at[r] : at[r + 1]]
                t, n = t[t >= 0], n[t >= 0]
                v[t] = (1 + np.log(n)) * batch.idf[t] / norm[r]
                q = src[ask_at[r] : ask_at[r + 1]]
                size = batch.at[q + 1] - batch.at[q]
                edge = np.cumsum(size) - size
                i = np.repeat(batch.at[q] - edge, size) + np.arange(size.sum())
                dot[ask_at[r] : ask_at[r + 1]] = np.add.reduceat(batch.w[i] * v[batch.t[i]], edge) if len(q) else 0
                v[t] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), asked, pa.ListArray.from_arrays(asked.offsets, pa.array(dot))], names=["dst", "src", "dot"])

    return run


def neighbours(docs: DataFrame, key: str, toks: str, n: int, queries: Column | None = None, max_df: int | None = None, bonus: Column | None = None) -> DataFrame:
    """``(src, dst, score, rank)``: for each query row the NEIGHBOURS rows most like it.

    The CANDIDATES rows that share most terms are scored: cosine plus ``bonus`` (columns ``s_*`` and ``d_*`` of the two
    rows). ``queries`` selects the rows asked about, all rows are candidates. Terms are kept from MIN_DF rows up to
    MAX_SHARE of all rows; ``max_df`` leaves out those in more rows than that. The query rows' vectors go to every task
    in passes of QUERIES; a task counts the terms that its rows share with each of them and gives the first CANDIDATES.
    Keys are whole numbers; rows with a null key are left out, rows with the same key are one.
    """
    share = MAX_SHARE if max_df is None else min(MAX_SHARE, max_df / max(n, 1))
    spark = docs.sparkSession
    kept = stored(docs.where(F.col(key).isNotNull()), "graph_rows")
    rows = kept.select(F.col(key).cast("long").alias("k"), F.col(toks).alias("t"))
    if not rows.groupBy("k").count().where("count > 1").isEmpty():
        rows = rows.groupBy("k").agg(F.flatten(F.collect_list(F.coalesce("t", F.array().cast("array<string>")))).alias("t"))
    bags = stored(rows.mapInArrow(_bags, "k long, terms array<string>, tf array<int>"), "graph_bags")
    df = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= MIN_DF) & (F.col("df") <= share * n))
    idf = stored(df.select("term", "df", F.log((n + 1.0) / (F.col("df") + 1.0)).alias("idf")), "graph_terms")
    total, hottest = idf.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    long = lambda b: b.select("k", F.inline(F.arrays_zip("terms", "tf"))).withColumnRenamed("terms", "term")
    weights = lambda b: lookup(long(b), idf, "term", "df", total, hottest).withColumn("raw", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norms = stored(weights(bags).groupBy("k").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")).where("norm > 0"), "graph_norms")
    asked = (kept.where(queries) if queries is not None else kept).select(F.col(key).cast("long").alias("k")).distinct()
    passes = max(1, -(-asked.count() // QUERIES))
    meta = kept.drop(toks)
    out = None
    for p in range(passes):
        mine = bags.join(asked.where(F.pmod(F.xxhash64("k"), F.lit(passes)) == p), "k", "left_semi")
        vectors = weights(mine).join(norms, "k").groupBy("k").agg(F.collect_list(F.struct("term", (F.col("raw") / F.col("norm")).alias("w"), "idf")).alias("v"))
        batch = _Batch(vectors.select("k", F.col("v.term").alias("terms"), F.col("v.w").alias("w"), F.col("v.idf").alias("idf")).toArrow())
        if not len(batch.keys):
            continue
        sorted_rows = bags.select("k", "terms").coalesce(spark.sparkContext.defaultParallelism).sortWithinPartitions("k")
        first = sorted_rows.mapInArrow(_shared(batch), "src long, less array<int>, dst array<long>")
        best = first.groupBy("src").agg(F.collect_list(F.arrays_zip("less", "dst")).alias("c")).select("src", F.slice(F.sort_array(F.flatten("c")), 1, CANDIDATES).alias("c"))
        pairs = best.select("src", F.explode("c.dst").alias("k")).groupBy("k").agg(F.collect_list("src").alias("asked"))
        both = bags.join(norms, "k").join(pairs, "k").select("k", "terms", "tf", "norm", "asked")
        dots = both.mapInArrow(_dots(batch), "dst long, src array<long>, dot array<double>")
        if bonus is not None:
            d = meta.select(*[F.col(c).alias("dst" if c == key else f"d_{c}") for c in meta.columns])
            s = meta.select(*[F.col(c).alias("src" if c == key else f"s_{c}") for c in meta.columns]).join(vectors.select(F.col("k").alias("src")), "src", "left_semi")
            dots = dots.join(d, "dst")
        cand = dots.select("*", F.arrays_zip(F.col("src").alias("a"), F.col("dot").alias("b")).alias("z")).drop("src", "dot").select("*", F.inline("z").alias("src", "dot")).drop("z")
        if bonus is not None:
            cand = cand.join(F.broadcast(s), "src")  # the rows of one pass
        scored = cand.select("src", "dst", F.round(F.col("dot") + (bonus if bonus is not None else F.lit(0.0)), 4).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return spark.createDataFrame([], "src long, dst long, score double, rank int")
    best = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEIGHBOURS).select("src", "dst", "score", "rank")


def paper_bonus() -> Column:
    """0.08 for a shared tag, 0.04 for the same folder (two missing ones too), up to 0.04 for near years."""
    tag = F.when(F.coalesce(F.arrays_overlap(F.array_except("s_tags", F.array(F.lit("Uncategorized"))), "d_tags"), F.lit(False)), 0.08).otherwise(0.0)
    folder = F.when(F.col("s_folder").eqNullSafe(F.col("d_folder")), 0.04).otherwise(0.0)
    year = F.coalesce(F.greatest(F.lit(0.0), 0.04 - 0.01 * F.abs(F.col("s_pub_year") - F.col("d_pub_year"))), F.lit(0.0))
    return tag + folder + year
