"""Problems 3, 7, 8 and 9."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import p3_residue as p3
from lectern.llm import p7_packing as p7
from lectern.llm import p8_leaks as p8
from lectern.llm import p9_reading as p9
from lectern.llm import queries
from lectern.llm.boosting import Trees
from lectern.llm.fm_index import FMIndex

SF = "/root/testdata/sf0.001"

RESIDUE = [
    "{{ title }}", "Learning ${name} in Crowds", "ＰＬＥＡＳＥ ＥＮＡＢＬＥ ＪＡＶＡＳＣＲＩＰＴ ＴＯ ＣＯＮＴＩＮＵＥ", "l o r e m i p s u m d o l o r s i t a m e t", "404 | Not Found | site.example", "Untitled-3", "请填写标题",
    "Towards <your title here> of Robots", "Traceback (most recent call last): KeyError: 'title'", "Published as a workshop paper at PLV 2020", "[object Object]", "zzzzzzzzzzz", "--------", "&lt;paper_title&gt;", "Page 3 of 12",
    "to keep site.test safe, turn on JavaScript first", "asdf asdf asdf", "Title TBD!",
]
REAL = [
    "Lorem or Not? Filler Detection for Bin Picking Captions", "Under Review: How Referees Judge Tool Use", "404 Hours of Crowd Navigation in Orchard Rows", "Just a Moment: Short-Horizon Calibrators for Aerial Inspection",
    "JavaScript Bindings for Decoders: A Toolkit for Door Traversal", "[Re] Cross-Embodiment Box Unloading under Changing Light", "$\\pi$-Guided Pose Graphs in Small Workshops", "<sup>2</sup>D-to-3D Flow Fields for Box Unloading",
    "基于模板匹配的深度估计研究", "Data-Efficient Bimanual Folding: Test, Test, Test", "Title Generation for Papers on Object Rearrangement", "Access Denied: Privilege-Aware Simulators for Bimanual Folding", "SE(3)-Equivariant State Estimators",
]


def test_residue(spark):
    # document frequencies as in a library: the words of real titles are common
    fill = [(1000 + i, REAL[i % len(REAL)]) for i in range(400)]
    data = list(enumerate(RESIDUE)) + [(100 + i, t) for i, t in enumerate(REAL)] + [(200, None), (201, ""), (202, "  "), (None, "{{ title }}"), (203, "Real words about robots " * 5000), (0, RESIDUE[0])] + fill
    df = spark.createDataFrame(data, "id long, title string").withColumn("row_id", F.lit("clash")).withColumn("g", F.lit(1))
    got = [r.row_id for r in p3.residue(df, "id", "title").collect()]
    assert sorted(got) == list(range(len(RESIDUE)))
    assert p3.residue(df.limit(0), "id", "title").count() == 0


def test_residue_by_given_exemplars(spark):
    """Exemplars come as a table; a star stands for any name; only texts that the retrieved ones cover are residue."""
    ex = spark.createDataFrame([("x", "draft prepared for * meeting 0"), ("x", "please ignore"), (None, "y"), ("x", None)], "label string, text string")
    rows = [(1, "Draft prepared for Quorvex-B meeting 2021"), (2, "draft prepared for robots and meeting quiet tinkerers"), (3, "Please ignore"), (4, "enable javascript to continue"), (5, "Meeting of quiet robots")]
    rows += [(10 + i, f"robots and people in buildings {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, title string")
    assert {r.row_id for r in p3.residue(df, "id", "title", ex).collect()} == {1, 3}
    assert p3.residue(df, "id", "title", ex.limit(0)).count() == 0


def test_placeholders_of_any_length():
    long = "record.metadata.title | default('no title was given for this record') | truncate(80)"
    for t in ("{{ " + long + " }}", "Towards ${" + "a" * 70 + "} of Robots", "{{ Sets and " + "words " * 20 + "{{ title }}", "[" + "_" * 50 + "title]"):
        assert p3.has_placeholder(p3.prepared(t)), t
    for t in (*REAL, "{{ Sets of Robots", "Sets [" + "a" * 60 + "] of [x]"):
        assert not p3.has_placeholder(p3.prepared(t)), t


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(0, 5, 800), np.zeros(3, int), np.tile([1, 2, 3], 40), rng.integers(0, 3, 200)])
    fm = FMIndex(text, 6)
    phrases = [tuple(rng.integers(1, 6, rng.integers(1, 7))) for _ in range(80)]
    rows, n = np.zeros((80, 7), np.int64), np.array([len(p) for p in phrases])
    for i, p in enumerate(phrases):
        rows[i, : len(p)] = p
    lo, hi = fm.search(rows, n)
    for i, p in enumerate(phrases):
        want = [j for j in range(len(text) - len(p) + 1) if tuple(text[j : j + len(p)]) == p]
        assert sorted(fm.locate(np.arange(lo[i], hi[i])).tolist()) == want
    assert FMIndex(np.array([], np.int64), 2).search(np.array([[1]]), np.array([1]))[1][0] == FMIndex(np.array([], np.int64), 2).search(np.array([[1]]), np.array([1]))[0][0]


PASSAGE = "Every amber ledger sketched this muddy dial without that gasket. One sealed ratchet rotated an oily spindle. Later that winter its idle mason guarded a wooden auditor. Their lacquered tunnel inspected the stubborn spindle across from that winch."
HAN = "月底夜班电工在木工房加热了备用齿轮，周三下午女司机在滨河泵房涂抹了潮湿缆绳，随后质检员封存了陶瓷垫片，年检前夕志愿者在北侧码头检验了旧账本。"


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(p8, "SHARD", 60)
    monkeypatch.setattr(p8, "ITEMS", 1)
    s = PASSAGE.split(". ")
    docs = [
        (1, "Intro words here. " + PASSAGE.upper() + " and more"), (2, "; ".join(reversed(s))), (3, PASSAGE.replace("muddy", "dirty").replace("idle", "lazy").replace(" ", " \n")), (4, s[0]), (5, None), (6, ""),
        (7, "<p>" + "</p> <b>".join(s) + "</b>"), (8, HAN.replace("，", "\n")), (9, HAN[:20]), (None, PASSAGE), (10, "filler " * 30_000 + PASSAGE), (11, "Every other amber word but no passage " * 10), (1, "Intro words here. " + PASSAGE.upper() + " and more"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3)).withColumn("share", F.lit("clash"))
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, HAN), (3, None), (4, ""), (None, "x y z")], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in p8.leaked_spans(d, items).where(F.col("share") >= p8.LEAKED).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 2), (10, 1)}
    assert p8.leaked_spans(d.limit(0), items).count() == 0 and p8.leaked_spans(d, items.limit(0)).count() == 0


def test_leak_spans_are_places_in_the_document(spark):
    d = spark.createDataFrame([(1, "one two three " + PASSAGE)], "doc_id long, text string")
    r = p8.leaked_spans(d, spark.createDataFrame([(9, PASSAGE)], "item_id long, passage string")).collect()
    assert [(x.start, x.item_start, x.share) for x in r] == [(3, 0, 1.0)] and r[0].end == 3 + len(p8.tokens(PASSAGE))


def test_removals_are_merged(spark):
    spans = spark.createDataFrame(
        [(1, 1, 0, 10, 0, 10, 1.0), (1, 2, 8, 20, 0, 12, 1.0), (1, 1, 20, 25, 0, 5, 1.0), (1, 3, 40, 50, 0, 10, 0.6), (1, 4, 45, 60, 0, 15, 0.4), (2, 1, 0, 9, 0, 9, 0.5)], p8._SPANS
    )
    assert {tuple(r) for r in p8.removals(spans).collect()} == {(1, 0, 25, 2), (1, 40, 50, 1), (2, 0, 9, 1)}
    assert p8.removals(spans.limit(0)).count() == 0


def test_stretches_between_many_other_runs():
    """Nine and more runs open before the true one goes on, within the gap."""
    others = [(6, 100 * i) for i in range(1, 13)]
    assert p8.stretches([(5, 0), *others, (10, 5)], 5, 5, 8) == [(5, 15, 0, 10)]
    rng = random.Random(4)
    for _ in range(200):
        hits = [(rng.randrange(40), rng.randrange(12)) for _ in range(rng.randrange(60))]
        runs = []
        for j, i in sorted(hits):
            for r in reversed(runs):
                if j - r[1] <= 6 and 0 <= i - r[3] <= 6 and abs(j - r[1] - i + r[3]) <= p8.SLIP:
                    r[1], r[3] = j, i
                    break
            else:
                runs.append([j, j, i, i])
        assert p8.stretches(hits, 5, 5, 8) == [(a, b + 5, c, e + 5) for a, b, c, e in runs if e + 5 - c >= 8]


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(p7, "SHARD_ITEMS", 50)
    rng = random.Random(3)
    sizes = [(i, rng.choice([5, 30, 60, 99, 100, 101, 250, 300])) for i in range(600)]
    b = spark.createDataFrame([(1, 100), (2, 256), (2, 256), (3, 0), (4, None)], "budget_id int, n_capacity int")
    got = p7.pack(spark.createDataFrame(sizes, "doc_id long, n long"), b).collect()
    assert {r.budget_id for r in got} == {1, 2}
    for budget, cap in ((1, 100), (2, 256)):
        mine = [r for r in got if r.budget_id == budget]
        fill, parts = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        assert max(fill.values()) <= cap and all(fill[r.container_id] == r.fill for r in mine)
        for i, n in sizes:
            p = sorted(parts[i])
            assert sum(x for _, x in p) == n and (len(p) == 1 or n > cap)
            assert [f for f, _ in p] == list(np.cumsum([0] + [x for _, x in p[:-1]]))
        assert len(fill) <= 1.12 * -(-sum(n for _, n in sizes) // cap) + 1
    assert p7.pack(spark.createDataFrame([], "doc_id long, n long"), b).count() == 0
    assert p7.pack(spark.createDataFrame(sizes, "doc_id long, n long"), b.limit(0)).count() == 0


def test_local_search_empties_a_container():
    sizes = np.array([6, 6, 4, 4, 5, 5], np.int64)
    box = p7.local_search(sizes, np.array([0, 1, 2, 2, 3, 0]) * 0 + np.array([0, 1, 2, 2, 3, 4]), 10)
    assert len(set(box.tolist())) == 3 and np.bincount(box, weights=sizes).max() <= 10
    order = np.random.default_rng(0).integers(1, 100, 300)
    a = p7.best_fit_decreasing(order, 100)
    b = p7.local_search(order, a.copy(), 100)
    assert len(set(b.tolist())) <= len(set(a.tolist())) and np.bincount(b, weights=order).max() <= 100
    assert (np.bincount(b, weights=order) ** 2).sum() >= (np.bincount(a, weights=order) ** 2).sum()


def test_two_items_make_room_for_one():
    """The pair that is exchanged may be any two items of a container, not only those with its smallest."""
    sizes, box = np.array([60, 45, 31, 20, 4, 98]), np.array([0, 1, 1, 1, 1, 2])
    fill = np.bincount(box, weights=sizes).astype(np.int64)
    assert p7._step(0, 0, sizes, box, fill, 100 - fill) and list(box) == [1, 1, 0, 0, 1, 2] or sizes[box == 1].sum() > 60
    assert (np.bincount(box, weights=sizes) <= 100).all()


def test_tokens_of_long_texts(spark, monkeypatch):
    enc = p7.load_tokenizer(p7.TOKENIZER)
    monkeypatch.setattr(p7, "CHUNK", 50)
    text = "Some words, numbers 123 and  blanks 语言 \n\n <|endoftext|> " * 40
    assert "".join(p7.pieces(text)) == text
    assert sum(len(enc.encode_ordinary(p)) for p in p7.pieces(text)) == len(enc.encode_ordinary(text))
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "x")], "doc_id long, text string").withColumn("n", F.lit("clash"))
    assert [(r.doc_id, r.n) for r in p7.token_counts(d).collect()] == [(1, len(enc.encode_ordinary(text)))]


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((600, 5))
    y = 1.0 + (x[:, 0] > 0.5) + 2 * (x[:, 1] > 0.3) * (x[:, 0] > 0.5)
    t = Trees().fit(x[:400], y[:400])
    assert np.abs(t.predict(x[400:]) - y[400:]).mean() < 0.3
    assert Trees().fit(x[:1], y[:1]).predict(x[:3]).tolist() == [y[0]] * 3


def test_calibration():
    y = np.repeat([1, 2, 3, 4], 50).astype(float)
    score = y + np.random.default_rng(1).normal(0, 0.1, 200)
    assert (1 + np.searchsorted(p9.calibrate(score, y), score, side="right") == y).mean() > 0.98


def test_levels_on_labels(spark):
    """Held-out accuracy: the labels of sources whose documents took no part in the fit."""
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/reading_labels.parquet")
    feats = d.where("text is not null").select("doc_id", "text").mapInArrow(p9._extract, "doc_id long, f array<float>")
    assert p9.train(feats, lab, d).held_out >= 0.8


def test_levels_of_odd_documents(spark):
    text = "The cat sat on the mat and it was glad to see the dog. " * 8
    rows = [(1, text, "s"), (2, None, None), (3, "", "s"), (4, "短文本。" * 100, "s"), (5, "too short", "s"), (None, text, "s"), (6, text * 300, "s"), (7, "Der Hund ist nicht mit dem Ball und die Katze ist auf dem Dach. " * 9, "s"), (8, "1 2 3 " * 50, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("band", F.lit("clash"))
    lab = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 2, None), (6, 1, 2), (99, 1, 4), (1, 3, 9)], "doc_id long, annotator_id int, band int")
    assert {(r.doc_id, r.band) for r in p9.reading_levels(d, lab).collect()} == {(1, 2), (6, 2)}
    assert p9.reading_levels(d, lab.limit(0)).count() == 0 and p9.reading_levels(d.limit(0), lab).count() == 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
