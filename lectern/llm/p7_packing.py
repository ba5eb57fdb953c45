"""Problem 7: texts combined into containers of fixed capacity, counted in tokens of a public tokenizer.

Items are dealt to shards of bounded size by hash. A shard is packed best-fit-decreasing and then improved by local
search: to empty the least filled container its items are moved to others, or exchanged one-for-one or two-for-one so
that the sum of squared fills grows. The least filled containers of all shards are opened and packed again together,
level by level, until one shard holds them.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored

#: Items in a shard, on average; containers of a shard that are opened again, as far as they hold half of its items.
SHARD_ITEMS, OPENED = 8192, 8
#: The search ends when so many containers in a row have resisted; so many exchanges are tried to empty one of them.
STALL, STEPS = 40, 24
TOKENIZER = os.environ.get("LECTERN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once; a text is cut between a word and the blank before the next.
CHUNK = 200_000


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lectern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that are encoded as they would be inside it: cut before a blank between letters."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut > at and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut -= 1
        if cut == at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n)`` of every text that has a token; null texts and null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_tokenizer(tokenizer)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n"])

    d = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return d.mapInArrow(run, "doc_id long, n long").where("n > 0")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item."""
    out = np.empty(len(sizes), np.int64)
    free: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(free, (s, -1))
        if k < len(free):
            room, c = free.pop(k)
        else:
            room, c, n = capacity, n, n + 1
        out[i] = c
        if room > s:
            bisect.insort(free, (room - s, c))
    return out


def local_search(sizes: np.ndarray, box: np.ndarray, capacity: int) -> np.ndarray:
    """Empties containers where it can; every step adds to the sum of squared fills."""
    n = int(box.max()) + 1 if len(box) else 0
    fill = np.bincount(box, weights=sizes, minlength=n).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    live = int((fill > 0).sum())
    given_up, failed = np.zeros(n, bool), 0
    while live > least and failed < STALL:
        open_ = np.flatnonzero((fill > 0) & ~given_up)
        if not len(open_):
            break
        u = int(open_[np.argmin(fill[open_])])
        for _ in range(STEPS):
            own = np.flatnonzero(box == u)
            if not len(own):
                break
            room = capacity - fill
            if not any(_step(int(x), u, sizes, box, fill, room) for x in own[np.argsort(-sizes[own])]):
                break
        if fill[u] == 0:
            live, failed = live - 1, 0
        else:
            given_up[u] = True
            failed += 1
    return box


def _step(x: int, u: int, sizes: np.ndarray, box: np.ndarray, fill: np.ndarray, room: np.ndarray) -> bool:
    """One move or exchange that takes weight out of container ``u``."""
    s = sizes[x]

    def put(item: int, c: int) -> None:
        fill[box[item]] -= sizes[item]
        fill[c] += sizes[item]
        box[item] = c

    fits = np.flatnonzero((room >= s) & (fill > 0))
    fits = fits[fits != u]
    if len(fits):  # the fullest container that has room
        put(x, int(fits[np.argmin(room[fits])]))
        return True
    slack = room[box]
    ok = np.flatnonzero((sizes < s) & (sizes >= s - slack) & (box != u) & (fill[box] >= fill[u] - s))
    if len(ok):  # one for one: the smallest that makes room
        y = int(ok[np.argmin(sizes[ok])])
        c = int(box[y])
        put(y, u), put(x, c)
        return True
    # two for one: to each item of a container the smallest other that makes enough room with it
    order = np.lexsort((sizes, box))
    by, at = sizes[order], box[order]
    big = int(sizes.max()) + 2
    rank = at * big + by
    need = np.clip(s - slack[order] - by, 0, big - 1)
    z = np.searchsorted(rank, at * big + need)
    z += z == np.arange(len(z))  # not the item itself
    z = np.minimum(z, len(z) - 1)
    both = by + by[z]
    ok = np.flatnonzero((at[z] == at) & (z != np.arange(len(z))) & (by[z] >= need) & (both < s) & (at != u))
    if len(ok):
        i = int(ok[np.argmin(both[ok])])
        y, w, c = int(order[i]), int(order[z[i]]), int(at[i])
        put(y, u), put(w, u), put(x, c)
        return True
    return False


def _packer(level: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "first"], ascending=[False, True, True], ignore_index=True)
        capacity, sizes = int(key[1]), pdf["n"].to_numpy(np.int64)
        box = local_search(sizes, best_fit_decreasing(sizes, capacity), capacity)
        names, box = np.unique(box, return_inverse=True)
        fill = np.bincount(box, weights=sizes).astype(np.int64)
        again = np.zeros(len(names), bool)
        if not last:
            first = np.argsort(fill, kind="stable")[:OPENED]
            again[first[np.cumsum(np.bincount(box)[first]) * 2 <= len(sizes)]] = True
            again &= fill < capacity
        pdf["container_id"] = [f"{level}-{key[2]}-{c}" for c in box]
        pdf["fill"], pdf["again"] = fill[box], again[box]
        return pdf[["budget_id", "n_capacity", "container_id", "doc_id", "first", "n", "fill", "again"]]

    return run


_ROW = "budget_id int, n_capacity int, container_id string, doc_id long, first long, n long, fill long, again boolean"


def pack(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(budget_id, n_capacity, container_id, doc_id, first_token, n_tokens, fill)``: the items of every container.

    An item that exceeds the capacity fills containers of its own, and what is left of it is packed like any other
    item; no other is split. Budgets with a null or non-positive capacity are left out, as are repeated ones. Every
    shard has a bounded number of items, since they are dealt by a hash of the document and its part.
    """
    wanted = budgets.where("budget_id is not null and n_capacity > 0").select("budget_id", "n_capacity").distinct()
    spark = sizes.sparkSession
    # every item is packed once for each budget: the budgets are a row's worth of data
    each = wanted.agg(F.array_sort(F.collect_list(F.struct(F.col("budget_id").cast("int"), F.col("n_capacity").cast("int")))).alias("b"))
    all_ = sizes.select("doc_id", F.col("n").alias("size"), F.inline(each.scalar()).alias("budget_id", "n_capacity"))
    whole = F.when(F.col("size") > F.col("n_capacity"), F.floor(F.col("size") / F.col("n_capacity"))).otherwise(F.lit(0)).cast("long")
    full = all_.where("size > n_capacity").select(
        "budget_id", "n_capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part")
    )
    full = full.select(
        "budget_id", "n_capacity", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("container_id"), "doc_id",
        (F.col("part") * F.col("n_capacity")).alias("first"), F.col("n_capacity").cast("long").alias("n"), F.col("n_capacity").cast("long").alias("fill"),
    )
    items = all_.withColumn("first", whole * F.col("n_capacity")).withColumn("n", F.col("size") - F.col("first")).where("n > 0").drop("size")
    total = sizes.count()
    out, level = full, 0
    while total:
        shards = -(-total // SHARD_ITEMS)
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "first", F.lit(level)), F.lit(shards)))
        packed = stored(dealt.groupBy("budget_id", "n_capacity", "shard").applyInPandas(_packer(level, shards == 1), _ROW), f"p7_level{level}")
        out = out.unionByName(packed.where("not again").drop("again"))
        if shards == 1:
            break
        items = packed.where("again").select("budget_id", "n_capacity", "doc_id", "first", "n")
        # at most half of a shard's items are packed again, so there is a last level, of one shard
        total = items.groupBy("budget_id", "n_capacity").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        level += 1
    return out.withColumnsRenamed({"first": "first_token", "n": "n_tokens"})


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See :func:`pack`."""
    sizes = stored(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "p7_sizes")
    return pack(sizes, spark.read.parquet(f"{sf_dir}/pack_budgets.parquet"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(budget_id, n_capacity, n_containers, n_least, used)``: how full the containers are; ``n_least`` is the number
    that the tokens alone would need."""
    c = p7_containers(spark, sf_dir).groupBy("budget_id", "n_capacity").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("n_capacity"))
    return c.select("budget_id", "n_capacity", "n_containers", least.alias("n_least"), F.round(F.col("tokens") / (F.col("n_containers") * F.col("n_capacity")), 6).alias("used"))
