"""Problem 8: documents that carry held-out test passages.

Each task indexes its documents (an FM-index for each shard of them), searches the index backwards for every phrase of
every test passage, locates the hits and joins them into stretches. No row is shuffled. A shard is read and indexed once,
over the words of all passages; the passages are searched in passes of bounded size.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fm_index import FMIndex

#: Phrase length, longest gap inside a stretch and shortest stretch, in words; the same in Chinese characters.
WORDS, CHARS = (5, 5, 8), (8, 10, 20)
#: A gap may be longer on one side than on the other by so much.
SLIP = 2
#: Share of a passage that a document must reproduce.
LEAKED = 0.5
#: Symbols in a shard's index, and test items in a pass.
SHARD, ITEMS = 2_000_000, 20_000

_HAN = "㐀-䶿一-鿿豈-﫿"
_TOKEN = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_HYPHEN = re.compile(r"-[ \t]*\r?\n[ \t]*")
_FORMAT = re.compile("[­​-‏⁠﻿]")


def tokens(text: str) -> list[str]:
    """Words, in Chinese characters, after NFKC and case folding; markup and hyphens at line ends are dropped."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-" in text:
        text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
    return _TOKEN.findall(text.casefold())


Item = tuple[int, list[str]]


def phrase_shape(t: list[str]) -> tuple[int, int, int]:
    """Phrase length, longest gap and shortest stretch of a passage."""
    kind = CHARS if 2 * sum(bool(re.match(f"[{_HAN}]", x)) for x in t) >= len(t) else WORDS
    return min(kind[0], len(t)), kind[1], min(kind[2], len(t))


class Vocabulary(dict):
    """The numbers of the passages' words, from 1, and the length of the shortest phrase."""

    shortest = 1 << 30

    def add(self, t: list[str]) -> None:
        self.shortest = min(self.shortest, phrase_shape(t)[0])
        for x in t:
            self.setdefault(x, len(self) + 1)

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text in the words' numbers, and the place of each in the text.

        A word of no passage is a separator, and so is a run of words too short for any phrase; of neighbouring
        separators one is kept. No hit can contain one, so none is lost.
        """
        get = self.get
        ids = np.array([get(x, 0) for x in tokens(text)], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        long = end - start >= self.shortest
        start, end = start[long], end[long]
        if not len(start):
            return ids[:0], ids[:0]
        size = end - start + 1  # with one separator
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out = np.where(at < np.repeat(end, size), ids[np.minimum(at, len(ids) - 1)], 0)
        return out, at


class Phrases:
    """The phrases of some test passages, each with the places where it stands."""

    def __init__(self, items: list[Item], vocab: Vocabulary):
        self.size: dict[int, int] = {}
        self.kind: dict[int, tuple[int, int, int]] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, t in items:
            k, gap, least = phrase_shape(t)
            ids = [vocab[x] for x in t]
            self.size[item], self.kind[item] = len(t), (k, gap, least)
            for i in range(len(t) - k + 1):
                places.setdefault(tuple(ids[i : i + k]), []).append((item, i))
        self.places = list(places.values())
        self.lengths = np.array([len(p) for p in places], np.int64)
        self.rows = np.zeros((len(places), int(self.lengths.max(initial=1))), np.int64)
        for r, p in enumerate(places):
            self.rows[r, : len(p)] = p


def stretches(hits: list[tuple[int, int]], k: int, gap: int, least: int) -> list[tuple[int, int, int, int]]:
    """Hits (place in the document, place in the passage) joined along both: (from, to, passage from, passage to)."""
    hits = sorted(hits)
    runs: list[list[int]] = []
    by: dict[int, list[int]] = {}  # numbers of the runs in reach, by the diagonal of their last hit, the oldest first
    for j, i in hits:
        last = -1
        for diagonal in range(j - i - SLIP, j - i + SLIP + 1):
            mine = by.get(diagonal, ())
            if mine and j - runs[mine[0]][1] > gap + 1:
                mine = by[diagonal] = [r for r in mine if j - runs[r][1] <= gap + 1]
            for r in mine:
                if r > last and 0 <= i - runs[r][3] <= gap + 1:
                    last = r
        if last < 0:
            last = len(runs)
            runs.append([j, j, i, i])
        else:
            old = runs[last]
            by[old[1] - old[3]].remove(last)
            old[1], old[3] = j, i
        by.setdefault(j - i, []).append(last)
    return [(a, b + k, c, d + k) for a, b, c, d in runs if d + k - c >= least]


def _scan(fm: FMIndex, ph: Phrases, ids: list[int], doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
    """Stretches of one shard, with the share of the passage that the document's stretches cover together."""
    lo, hi = fm.search(ph.rows, ph.lengths)
    n = hi - lo
    found = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    pos = fm.locate(rows)
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, d, j in zip(found.tolist(), doc[pos].tolist(), place[pos].tolist()):
        for item, i in ph.places[p]:
            by.setdefault((d, item), []).append((j, i))
    for (d, item), hits in by.items():
        runs = stretches(hits, *ph.kind[item])
        cover = np.zeros(ph.size[item], bool)
        for _, _, c, e in runs:
            cover[c:e] = True
        for a, b, c, e in runs:
            yield ids[d], item, a, b, c, e, float(cover.mean())


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int64()) for c in ("start", "end", "item_start", "item_end")), ("share", pa.float64())])


def _task(vocab: Broadcast, passes: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocab.value
        one = Phrases(passes[0].value, voc) if len(passes) == 1 else None
        ids, texts, at, n = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            fm = FMIndex(np.concatenate(texts), len(voc) + 1)
            doc, place = np.repeat(np.arange(len(ids)), [len(x) for x in texts]), np.concatenate(at)
            for items in passes:
                rows = list(_scan(fm, one or Phrases(items.value, voc), ids, doc, place))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s, p = voc.symbols(text)
                if len(s):
                    ids.append(i), texts.append(s), at.append(p)
                    n += len(s)
                if n >= SHARD:
                    yield from flush()
                    ids, texts, at, n = [], [], [], 0
        yield from flush()

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``(doc_id, item_id, start, end, item_start, item_end, share)``: every stretch of a test passage in a document.

    ``start`` and ``end`` count the document's words, ``item_start`` and ``item_end`` the passage's; ``share`` is the
    share of the passage that the document's stretches cover together. The documents are read once. The items go to the
    tasks in passes of ITEMS, each a broadcast of its own, so the phrases a task holds are bounded; the words of all
    items are held beside them. A passage shorter than a phrase is one phrase. Null and empty texts and passages have no
    hits; rows with a null id are left out; repeated items are searched once.
    """
    q = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).distinct()
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text))
    sc = docs.sparkSession.sparkContext
    vocab, passes = Vocabulary(), []
    n = -(-q.count() // ITEMS)
    for k in range(n):
        part = [(r.i, tokens(r.p)) for r in q.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]
        part = [x for x in part if x[1]]
        for _, t in part:
            vocab.add(t)
        if part:
            passes.append(sc.broadcast(part))
    if not passes:
        return docs.sparkSession.createDataFrame([], _SPANS)
    return d.mapInArrow(_task(sc.broadcast(vocab), passes), _SPANS)


_SPANS = "doc_id long, item_id long, start long, end long, item_start long, item_end long, share double"


def removals(spans: DataFrame, least: float = LEAKED) -> DataFrame:
    """``(doc_id, start, end, n_items)``: what has to be cut out. Stretches of leaked passages that overlap or touch are
    one; ``n_items`` is the number of items in it."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "item_id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") > before)).cast("int")
    s = spans.where(F.col("share") >= least).withColumn("_new", new).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("item_id").alias("n_items")).drop("_part")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, item_id)``: documents that reproduce at least half of an item's passage."""
    spans = leaked_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
    return spans.where(F.col("share") >= LEAKED).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of all leaked passages."""
    spans = leaked_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
    return spans.where(F.col("share") >= LEAKED)


def p8_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See :func:`removals`."""
    return removals(leaked_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")))
