"""Problem 9: the level of reader that a document demands.

Boosted regression trees over the distributions of length, vocabulary, syntax and cohesion features, trained on hand
labels; the grades' cut points are calibrated on predictions for sources the trees haven't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored
from .boosting import Trees

#: Documents with fewer whitespace-separated words have no level.
MIN_WORDS = 60
#: Labelled documents used to fit, at most (a sample by hash beyond that); folds of the cross-validation by source.
MAX_TRAIN, FOLDS = 4000, 5
BANDS = 4

# English function words (to tell the language), subordinators and connectives.
FUNCTION = frozenset(
    "the a an and or but of to in on at for with by from as is are was were be been it its this that these those he she they we you i his her their our my not no so then than can will would which who when where what has have had do does did if into over under about after before while because although"
    .split()
)
FOREIGN = frozenset("der das und nicht ist mit für von den dem ein eine zu auf le la les des une est dans pour que qui los las del una por con para el il che di della per non een het van niet och att det som en de".split())
SUBORDINATE = frozenset("although because while whereas which that when after before until unless since if whether though who whose whom where so provided insofar notwithstanding".split())
CONNECT = frozenset("however therefore moreover furthermore consequently nevertheless thus hence accordingly conversely similarly otherwise meanwhile later then first finally next also instead".split())

_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n")
_HAN = re.compile("[぀-ヿ㐀-鿿가-힯]")
_VOWELS = re.compile(r"[aeiouy]+")
_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


class _Words(dict):
    """word -> (letters, syllables, class): 1 function, 2 subordinator, 4 connective, 8 content, 16 foreign."""

    def __missing__(self, w: str) -> tuple[int, int, int]:
        if len(self) > 500_000:
            self.clear()
        n = len(w)
        syl = max(1, len(_VOWELS.findall(w)) - (w.endswith("e") and not w.endswith("le")))
        c = (w in FUNCTION) + 2 * (w in SUBORDINATE) + 4 * (w in CONNECT) + 16 * (w in FOREIGN)
        self[w] = v = (n, syl, c or (8 if n > 3 else 0))
        return v


def is_english(text: str, kinds: list[int]) -> bool:
    """By the text: written in Latin letters, and without more function words of other languages than English ones.

    Dense English may do without function words, so none are asked for. ``kinds`` are the words' classes.
    """
    if not kinds:
        return False
    han = 0 if text.isascii() else len(_HAN.findall(text))
    foreign, own = sum(k >= 16 for k in kinds), sum(k & 1 for k in kinds)
    return han * 2 < len(kinds) and not (foreign > own and foreign >= 0.04 * len(kinds))


_STEPS = np.array((2, 5, 8, 11, 14, 18, 24), float)
_NO_DIGITS = {ord(c): None for c in "0123456789"}
_ASIDE = ("|", "#", "```", ">", "http")


def features(text: str, cache: dict[str, tuple[int, int, int]]) -> np.ndarray | None:
    """The features of an English document of MIN_WORDS words or more; None for others."""
    if len(text.split()) < MIN_WORDS:
        return None
    low = text.lower()
    lines = [x for x in low.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x and not x.isspace()]
    plain = [x for x in lines if not x.lstrip().startswith(_ASIDE)]
    sents = [(s, w) for s in _SENTENCE.split("\n\n".join(plain)) if len(w := _WORD.findall(s)) >= 3] or [(low, _WORD.findall(low))]
    flat = [x for _, w in sents for x in w]
    if not flat:
        return None
    known = [cache[x] for x in flat]
    if not is_english(low, [k[2] for k in known]):
        return None
    letters, syl, cls = np.array(known, np.int32).T
    n = np.array([len(w) for _, w in sents])
    at = np.cumsum(n) - n
    total = len(flat)
    counts = np.stack([letters, syl, letters >= 8, letters >= 11, (cls & 2) > 0, (cls & 1) > 0]).astype(float)
    sums = np.add.reduceat(counts, at, axis=1)
    mean_len, mean_syl, long, very = sums[:4] / n
    sub, fun = sums[4], sums[5] / n
    commas = np.array([s.count(",") for s, _ in sents], float)
    grade = 0.39 * n + 11.8 * mean_syl - 15.59
    spread = np.stack([n.astype(float), mean_len, mean_syl, long, very, grade])
    out = [np.quantile(spread, _QUANTILES, axis=1).T.ravel(), spread.mean(1)]
    # the share of sentences in each step of difficulty, by sentences and by words
    hard = grade[None, :] >= _STEPS[:, None]
    out += [hard.mean(1), (hard * n).sum(1) / total]
    out += [np.bincount(np.minimum(letters, 16), minlength=17)[1:] / total, np.bincount(np.minimum(syl, 7), minlength=8)[1:] / total]
    types = np.array(list(Counter(flat).values()))
    rest = [len(types) / np.sqrt(total), (types == 1).mean(), ((types / total) ** 2).sum()]
    rest += [sub.mean(), (sub > 0).mean(), commas.mean(), commas.sum() / total, fun.mean()]
    content = [{x for x, k in zip(flat[i : i + m], known[i : i + m]) if k[2] == 8} for i, m in zip(at.tolist(), n.tolist())]
    link = np.array([len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:])] or [0.0])
    rest += [link.mean(), (link > 0).mean(), ((cls & 4) > 0).sum() / total, 1 - len(low.translate(_NO_DIGITS)) / len(low), low.count("!") / len(sents), low.count("-") / total]
    rest += [len(plain) / max(1, len(lines)), total / max(1, len(plain)), np.log(total), np.log(len(sents))]
    return np.concatenate([*out, rest]).astype(np.float32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for b in batches:
        ids, rows = [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (f := features(text, cache)) is not None:
                ids.append(i)
                rows.append(f)
        flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
        at = np.arange(len(rows) + 1, dtype=np.int32) * (len(rows[0]) if rows else 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "f"])


class Grader:
    """The trees and the cut points between the bands."""

    def __init__(self, x: np.ndarray, y: np.ndarray, source: np.ndarray):
        fold = np.array([hash_fold(s) for s in source])
        seen = np.empty(len(y))
        for k in range(FOLDS):
            out = fold == k
            if out.any() and (~out).any():
                seen[out] = Trees().fit(x[~out], y[~out]).predict(x[out])
            else:
                seen[out] = y.mean()
        self.trees = Trees().fit(x, y)
        self.cuts = calibrate(seen, y)
        #: Share of the labelled documents that get their label's band from trees that haven't seen their source.
        self.held_out = float((self.band(seen) == np.clip(np.round(y), 1, BANDS)).mean())

    def band(self, score: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, score, side="right")


def hash_fold(source: str) -> int:
    return sum(map(ord, source)) % FOLDS


def calibrate(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each boundary a score that errs least between the bands below and above it.

    Of the cuts that err hardly more than the best, which noisy labels can't tell apart, the one nearest to the middle
    between the bands is taken.
    """
    order = np.argsort(score)
    s = score[order]
    cuts = []
    for k in range(1, BANDS):
        up = np.concatenate([[0], np.cumsum(y[order] > k + 0.5)])
        err = up + (len(s) - np.arange(len(s) + 1)) - (up[-1] - up)
        ends = np.concatenate([[-np.inf], s, [np.inf]])
        good = np.flatnonzero(err <= err.min() + max(1, 0.005 * len(s)))
        # the cut may lie anywhere between its two neighbours
        cut = np.clip(k + 0.5, ends[good] + 1e-9, ends[good + 1])
        cuts.append(float(cut[np.argmin(np.abs(cut - k - 0.5))]))
    return np.maximum.accumulate(np.array(cuts))


def train(feats: DataFrame, labels: DataFrame, docs: DataFrame) -> Grader | None:
    """Fits on one mean label for each document; null bands, bands off the scale and doubled labels don't count."""
    one = labels.where(F.col("band").between(1, BANDS)).groupBy("doc_id", "annotator_id").agg(F.avg("band").alias("band")).groupBy("doc_id").agg(F.avg("band").alias("y"))
    src = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    rows = feats.join(one, "doc_id").join(src, "doc_id", "left").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN).collect()
    if not rows:
        return None
    return Grader(np.array([r.f for r in rows], np.float32), np.array([r.y for r in rows], float), np.array([r.source or "" for r in rows]))


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score, band)`` of every English document of MIN_WORDS words or more.

    Whole texts are read, once. Null and short texts, texts in other languages and null ids have no level. At most
    MAX_TRAIN labelled documents go to the driver, where the trees are fitted; without labels no document has a level.
    """
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    feats = stored(d.select(F.col("doc_id").cast("long"), "text").mapInArrow(_extract, "doc_id long, f array<float>"), "p9_features")
    grader = train(feats, labels, d)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and grader is not None:
                f = b.column(1)
                x = f.values.to_numpy()[f.offsets[0].as_py() : f.offsets[len(f)].as_py()].reshape(b.num_rows, -1)
                s = grader.trees.predict(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 6)), pa.array(grader.band(s).astype(np.int32))], names=["doc_id", "score", "band"])

    return feats.mapInArrow(grade, "doc_id long, score double, band int")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See :func:`reading_levels`."""
    return reading_levels(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/reading_labels.parquet"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, band)``."""
    return p9_levels(spark, sf_dir).select("doc_id", "band")
