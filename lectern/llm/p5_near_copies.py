"""Problem 5: records that repeat another record's text with small edits.

Two records are linked if they share at least THRESHOLD of the words of the longer one, as bags. Candidates come from
several global orders of the bags' elements: under a random global order the prefix of one element is that order's
least element, and two bags agree in it with the chance of their resemblance. A band intersects the filters of ORDERS
orders: its key is made of their prefixes, so that only bags that agree under all of them meet. BANDS independent bands
are joined by union. A pair at the threshold (resemblance 2/3) is missed by all bands with a chance of 1.1 %, one that
shares 85 % of its words with 0.04 %, one that shares 90 % with less than one in a million. Candidates whose sketches
disagree are dropped, then those whose counters show that they can't share enough; all others are verified exactly.
A large bucket is first compared with its leaders; the members that the verified links leave in different groups are
then compared pair by pair, a block of pairs to a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.skew import lookup
from ..runtime import Stored, stored
from .components import components

MIN_WORDS = 40
THRESHOLD = 0.8
ORDERS, BANDS, SKETCH = 5, 32, 128
#: Of SKETCH bits, so many may differ: 36 is more than three deviations beyond what pairs at the threshold have.
MAX_BITS = 36
#: Counters of a bag's elements, by the first bits of their hashes: all of them inside large buckets, else FOLD in one.
COUNTERS, FOLD = 512, 4
#: Buckets up to this size are compared pair by pair, larger ones against leaders before that.
BLOCK = 256
#: A large bucket is compared by pairs of pieces of about so many bags, so many rows of a piece at once.
PIECE, ROWS = 4096, 256
#: Up to so many bags (8 bytes each) are broadcast to filter the table of all bags; more are joined by shuffle.
FEW = 1_000_000
SEEN = 500_000

_U32, _U64 = np.uint32, np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64"""
    x = (x + _U64(0x9E3779B97F4A7C15)).astype(_U64)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def bag_elements(texts: list[list[str]], hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's bag elements, where the k-th copy of a word is an element of its own; the bounds."""
    keys: list[int] = []
    counts: list[int] = []
    sizes = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        c = Counter(t)
        keys += map(hashes.__getitem__, c)
        counts += c.values()
        sizes[i + 1] = len(t)
    n = np.array(counts, np.int64)
    start = np.repeat(np.cumsum(n) - n, n)
    copy = np.arange(len(start)) - start
    return _mix(np.repeat(np.array(keys, _U64), n) + copy.astype(_U64) * _U64(0xD1B54A32D192ED03)), np.cumsum(sizes)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of each long enough text and two sums over them; no elements for a bag this task has given already."""
    hashes, seen = _Hashes(), set()
    for b in batches:
        ids, texts = [], []
        for i, title, abstract in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            w = words(abstract)
            if len(w) >= MIN_WORDS:
                ids.append(i)
                texts.append(words(title) + w)
        if not ids:
            continue
        e, at = bag_elements(texts, hashes)
        s1, s2 = np.add.reduceat(e, at[:-1]), np.add.reduceat(_mix(e ^ _U64(0xA5A5A5A5A5A5A5A5)), at[:-1])
        if len(seen) > SEEN:
            seen.clear()
        new = np.zeros(len(ids), bool)
        for i, s in enumerate(zip(s1.tolist(), s2.tolist())):
            if s not in seen:
                seen.add(s)
                new[i] = True
        n = np.diff(at)
        kept = np.repeat(new, n)
        offsets = np.concatenate([[0], np.cumsum(np.where(new, n, 0))]).astype(np.int32)
        # how many elements fall into each bucket: two bags share at most the sum of the lesser counts
        row = np.repeat(np.arange(len(ids)), n)
        spread = np.bincount(row * COUNTERS + (e >> _U64(64 - COUNTERS.bit_length() + 1)).astype(np.int64), minlength=len(ids) * COUNTERS)
        counts = [x.tobytes() if k else None for x, k in zip(np.minimum(spread, 255).astype(np.uint8).reshape(-1, COUNTERS), new)]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(e[kept].view(np.int64)), mask=pa.array(~new))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, pa.array(counts, pa.binary())], names=["paper_id", "s1", "s2", "e", "c"]
        )


def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = ORDERS * BANDS
    return rng.integers(0, 2**32, n, dtype=_U32) | _U32(1), rng.integers(0, 2**32, n, dtype=_U32)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bag and band a key made of the bag's least elements under the band's orders."""
    a, x = _orders()
    salt = _mix(np.arange(BANDS, dtype=_U64))
    for b in batches:
        s1, lists = b.column(0).to_numpy(), b.column(1)
        at_all, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(_U64)
        for lo in range(0, len(s1), 128):
            hi = min(lo + 128, len(s1))
            at = at_all[lo : hi + 1]
            h = (flat[at[0] : at[-1]] >> _U64(32)).astype(_U32)
            least = np.empty((len(a), hi - lo), _U32)
            for k in range(len(a)):
                least[k] = np.minimum.reduceat((h ^ x[k]) * a[k], at[:-1] - at[0])
            keys = np.repeat(salt[:, None], hi - lo, 1)
            for j in range(ORDERS):
                keys = _mix(keys ^ least[j::ORDERS].astype(_U64)) if j else _mix(keys + least[j::ORDERS])
            odd = (_mix(least[:SKETCH].astype(_U64)) & _U64(1)).astype(np.uint8)
            bits = np.ascontiguousarray(np.packbits(odd, axis=0).T).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.T.ravel().view(np.int64)), *(pa.array(np.repeat(c, BANDS)) for c in (s1[lo:hi], bits[:, 0], bits[:, 1]))],
                names=["k", "s1", "x", "y"],
            )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1) <= MAX_BITS


def _small(k: np.ndarray, s: np.ndarray, sk: np.ndarray) -> tuple[list, list]:
    """Pairs of rows of one key, all buckets at once, by their distance in the sorted order."""
    left, right = [], []
    i = np.arange(len(k))
    for d in range(1, BLOCK):
        i = i[i + d < len(k)]
        i = i[k[i] == k[i + d]]
        if not len(i):
            break
        ok = i[(s[i] != s[i + d]) & _near(sk[i], sk[i + d])]
        left.append(s[ok])
        right.append(s[ok + d])
    return left, right


class _Leaders:
    """One large bucket, in any number of pieces: members go with the leaders they are near to, or become leaders."""

    def __init__(self) -> None:
        self.s, self.sk = np.empty(0, np.int64), np.empty((0, 2), _U64)

    def add(self, s: np.ndarray, sk: np.ndarray) -> tuple[list, list]:
        left, right = [], []
        while len(s):
            n = max(1, 4_000_000 // max(1, len(self.s)))
            part, psk, s, sk = s[:n], sk[:n], s[n:], sk[n:]
            if len(self.s):
                m, j = np.nonzero(_near(psk[:, None], self.sk[None, :]))
                differ = part[m] != self.s[j]
                left.append(part[m][differ])
                right.append(self.s[j][differ])
                free = np.ones(len(part), bool)
                free[m] = False
                part, psk = part[free], psk[free]
            while len(part):  # the first that is near to no leader leads those near to it
                near = _near(psk, psk[:1])
                follow = near & (part != part[0])
                left.append(part[follow])
                right.append(np.full(int(follow.sum()), part[0]))
                self.s, self.sk = np.append(self.s, part[0]), np.concatenate([self.sk, psk[:1]])
                part, psk = part[~near], psk[~near]
        return left, right


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of bags that meet in a bucket; the rows come sorted by key and bag. A bucket of any size is read in pieces.

    A bag that several tasks have given counts once. Of a large bucket, whose members are only compared with leaders,
    every member comes out besides, with the key and the sketch.
    """
    big_key, big = None, _Leaders()
    rest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), _U64))
    last = None

    def out(left: list, right: list) -> Iterator[pa.RecordBatch]:
        if left and sum(map(len, left)):
            x, y = np.concatenate(left), np.concatenate(right)
            p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            none = pa.nulls(len(p[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), none, none, none], names=["a", "b", "k", "x", "y"])

    def work(k: np.ndarray, s: np.ndarray, sk: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal big_key, big
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(edge, len(k)))
        large = (size > BLOCK) | (k[edge] == big_key if big_key is not None else False)
        for i in np.flatnonzero(large):
            if k[edge[i]] != big_key:
                big_key, big = k[edge[i]], _Leaders()
            part = slice(edge[i], edge[i] + size[i])
            bits = sk[part].view(np.int64)
            none = pa.nulls(size[i], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(s[part]), none, *map(pa.array, (k[part], bits[:, 0], bits[:, 1]))], names=["a", "b", "k", "x", "y"])
            yield from out(*big.add(s[part], sk[part]))
        few = np.repeat(~large & (size > 1), size)
        yield from out(*_small(k[few], s[few], sk[few]))

    for b in batches:
        cols = (b.column(0).to_numpy(), b.column(1).to_numpy(), np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], axis=1).view(_U64))
        if not len(cols[0]):
            continue
        new = np.concatenate([[last != (cols[0][0], cols[1][0])], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)])
        last = (cols[0][-1], cols[1][-1])
        k, s, sk = (np.concatenate([r, c[new]]) for r, c in zip(rest, cols))
        # the last key may go on in the next batch, unless its bucket is known to be large
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if len(k) - cut > BLOCK or (big_key is not None and len(k) and k[-1] == big_key):
            cut = len(k)
        if cut:
            yield from work(k[:cut], s[:cut], sk[:cut])
        rest = (k[cut:], s[cut:], sk[cut:])
    if len(rest[0]):
        yield from work(*rest)


def candidates(bags: DataFrame) -> DataFrame:
    """``(a, b, k, x, y)``: pairs of bags, by ``s1``, that meet in a band and whose sketches agree, with a null key; and
    the members ``a`` of large buckets ``k`` with their sketches, with a null ``b``."""
    keys = bags.where("e is not null").select("s1", "e").mapInArrow(_band_keys, "k long, s1 long, x long, y long")
    by_key = keys.repartition("k").sortWithinPartitions("k", "s1")
    return by_key.mapInArrow(_pairs, "a long, b long, k long, x long, y long")


def _enough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether counters leave room for enough shared elements. A full counter says nothing."""
    most = np.maximum(x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64))
    return (np.minimum(x, y).sum(1, dtype=np.int64) >= THRESHOLD * most - 1e-9) | (x == 255).any(1) | (y == 255).any(1)


def _counters(column: pa.Array) -> np.ndarray:
    """Counters of each row; a batch of them is one stretch of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring counters as one."""
    for b in batches:
        if b.num_rows:
            c = np.minimum(_counters(b.column(2)).reshape(b.num_rows, -1, FOLD).sum(2, dtype=np.int64), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in c], pa.binary())], names=["s1", "s2", "c"])


def _once(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``given`` whose ``s1`` is in ``wanted``, with its columns; each bag once, placed by ``s1``."""
    few = wanted.count() <= FEW
    rows = given.join(F.broadcast(wanted) if few else wanted, "s1")
    return (rows.repartition("s1") if few else rows).dropDuplicates(["s1", "s2"])


def _may_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counters leave room for enough shared elements."""
    for b in batches:
        if b.num_rows:
            ok = pa.array(_enough(_counters(b.column(2)), _counters(b.column(3))))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])


def _unmet(rows: pa.Table) -> pa.Table:
    """Pairs of bags of different labels, of one piece or of two, whose sketches and counters allow a link."""
    s, label, piece = (rows[c].to_numpy() for c in ("s1", "label", "piece"))
    sk = np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1).view(_U64)
    c = _counters(rows["c"].combine_chunks())
    mine = np.flatnonzero(piece == piece.min())
    other = np.flatnonzero(piece != piece.min()) if (piece != piece.min()).any() else mine
    left, right = [], []
    for lo in range(0, len(mine), ROWS):
        i = mine[lo : lo + ROWS]
        p, q = np.nonzero(_near(sk[i][:, None], sk[other][None, :]) & (label[i][:, None] != label[other][None, :]))
        a, b = i[p], other[q]
        if other is mine:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 10_000):
            x, y = a[at : at + 10_000], b[at : at + 10_000]
            ok = _enough(c[x], c[y])
            left.append(s[x[ok]])
            right.append(s[y[ok]])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _unmet_pairs(members: DataFrame, given: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(a, b)``: pairs inside large buckets that ``links`` don't connect and whose sketches and counters agree.

    Every two such members of a bucket are compared. A bucket is cut into pieces, and each pair of pieces is a group of
    its own, so that no task holds a whole bucket.
    """
    label = nodes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("s1", F.coalesce("component", "rep").alias("label"))
    member = stored(members.join(label, "s1"), "p5_members")
    mixed = member.groupBy("k").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    pieces = mixed.select("k", F.ceil(F.col("n") / PIECE).cast("int").alias("m"))
    part = member.join(pieces, "k").withColumn("piece", F.pmod(F.xxhash64("s1"), "m").cast("int"))
    each = part.select("k", "s1", "label", "x", "y", "piece", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    counters = _once(given.select("s1", "s2", "c"), part.select("s1").distinct()).drop("s2")
    # a bucket of more than one piece has its pairs inside a piece in the groups (i, i)
    each = each.withColumns({"i": F.least("piece", "o"), "j": F.greatest("piece", "o")}).drop("o").join(counters, "s1")
    return each.groupBy("k", "i", "j").applyInArrow(_unmet, "a long, b long").distinct()


def _verified(pairs: DataFrame, given: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)``, by ``rep``: the pairs that share enough. A bag in many pairs is looked up as a hot key."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("s1")).groupBy("s1").agg(F.count("*").alias("n")), "p5_ends")
    bags = _once(given.select("s1", "s2", "e"), ends)
    total, hottest = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    for c in "ab":
        dim = bags.select(F.col("s1").alias(c), F.col("s2").alias(f"s2{c}"), F.col("e").alias(f"e{c}"), "n")
        pairs = lookup(pairs, dim, c, "n", total, hottest)
    shared = F.size(F.array_intersect("ea", "eb"))
    links = pairs.where(shared >= F.lit(THRESHOLD) * F.greatest(F.size("ea"), F.size("eb")) - 1e-9).select("a", "s2a", "b", "s2b")
    for c in "ab":
        links = links.join(nodes.select(F.col("s1").alias(c), F.col("s2").alias(f"s2{c}"), F.col("rep").alias(f"rep{c}")), [c, f"s2{c}"])
    return stored(links.select(F.col("repa").alias("a"), F.col("repb").alias("b")), "p5_links")


def near_copy_groups(docs: DataFrame, row_id: str = "paper_id", title: str = "title", abstract: str = "abstract") -> DataFrame:
    """``(first_id, other_id)`` of every group of two or more linked records; ``first_id`` is the least id.

    Records whose abstract has fewer than MIN_WORDS words, or is null, take no part; a null title counts as empty; rows
    with a null id are left out. Equal bags are one node from the start: a task gives the elements of a bag once, so
    copies cost neither candidates nor a hot bucket. A large bucket is compared with its leaders, piece by piece; its
    members that the links found so far leave apart are compared with each other, all of them.
    """
    d = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("paper_id"), F.col(title).cast("string"), F.col(abstract).cast("string"))
    bags = stored(d.mapInArrow(_bags, "paper_id long, s1 long, s2 long, e array<long>, c binary"), "p5_bags")
    nodes = bags.groupBy("s1", "s2").agg(F.min("paper_id").alias("rep"), F.max("paper_id").alias("last"), F.count("*").alias("n"))
    nodes = stored(nodes, "p5_nodes")
    given = bags.where("e is not null")
    found = Stored(candidates(bags), "p5_met")
    counters = given.select("s1", "s2", "c").mapInArrow(_folded, "s1 long, s2 long, c binary").repartition("s1").dropDuplicates(["s1", "s2"])
    left, right = (counters.select(F.col("s1").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    met = found.df.where("b is not null").select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "ca", "cb")
    pairs = stored(met.mapInArrow(_may_share, "a long, b long").distinct(), "p5_pairs")
    links = _verified(pairs, given, nodes)
    members = found.df.where("b is null").select("k", F.col("a").alias("s1"), "x", "y")
    if not members.isEmpty():
        more = stored(_unmet_pairs(members, given, nodes, links), "p5_unmet")
        if not more.isEmpty():
            links = links.unionByName(_verified(more, given, nodes))
    found.drop()
    comp = components(links).withColumnRenamed("node", "rep")
    dim = nodes.join(comp, "rep", "left").where("component is not null or rep <> last")
    dim = dim.select(F.struct("s1", "s2").alias("nk"), F.coalesce("component", "rep").alias("first_id"), "n")
    total, hottest = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    got = lookup(bags.select(F.struct("s1", "s2").alias("nk"), "paper_id"), dim, "nk", "n", total, hottest)
    return got.where("paper_id <> first_id").select("first_id", F.col("paper_id").alias("other_id")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See :func:`near_copy_groups`."""
    return near_copy_groups(spark.read.parquet(f"{sf_dir}/library_papers.parquet"))
