import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import clean as C
from lectern.operators import dedupe, enrich, graph, incremental, people, search, skew, stats, tagging, validate
from lectern.plans import catalog
from lectern.runtime import Stored, delete
from lectern.sources import library
from lectern.streaming import refresh

from .conftest import SF


def test_lookup_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    facts = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 20 + ["b"] * 3 + ["c", None])], "k string, i long")
    dim = spark.createDataFrame([("a", 1, 20), ("b", 2, 3)], "k string, v int, n long")
    for how, rows in (("inner", 23), ("left", 25)):
        got = skew.lookup(facts, dim, "k", "n", 25, 20, how)
        assert got.count() == rows and got.where("k = 'a' and v = 1").count() == 20


@pytest.mark.parametrize("seed", range(2))
def test_components_and_similar_titles(spark, make_papers, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = rng.sample(words, rng.choice([3, 12, 13, 14, 26]))
        for j in range(rng.choice([1, 2, 3])):
            v = list(w)
            if rng.random() < 0.6:
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append({"paper_id": len(rows) + 1, "title": " ".join(v), "arxiv_id": rng.choice([None, None, f"2403.{i + 1:05d}", f"2404.{i + 1:05d}"])})
    rows += [{"paper_id": 900, "title": None}, {"paper_id": 901, "title": ""}, {"paper_id": None, "title": "x"}]
    got = {r.paper_id: r.component for r in dedupe.duplicate_groups(make_papers(rows), 2026).collect()}
    par = {r["paper_id"]: r["paper_id"] for r in rows if r["paper_id"]}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ok = [r for r in rows if r["paper_id"]]
    for a, b in itertools.combinations(ok, 2):
        ta, tb = (set((x["title"] or "").split()) for x in (a, b))
        same_id = a.get("arxiv_id") and a.get("arxiv_id") == b.get("arxiv_id")
        clash = a.get("arxiv_id") and b.get("arxiv_id") and a["arxiv_id"] != b["arxiv_id"]
        like = ta and tb and len(ta & tb) / max(len(ta), len(tb)) > 0.92 and not clash
        if same_id or like:
            x, y = find(a["paper_id"]), find(b["paper_id"])
            par[max(x, y)] = min(x, y)
    assert got == {p: find(p) for p in par}


def test_kept_record_is_filled(make_papers):
    p = make_papers([
        {"paper_id": 1, "title": "Same Title Here Ok", "abstract": "a" * 60}, {"paper_id": 2, "title": "same title here ok", "pub_year": 2020, "pub_month": 3, "pub_date_source": "pdf", "needs_review": True},
        {"paper_id": 3, "title": "Same title here, ok", "arxiv_id": "2403.01234", "pub_date_source": "arxiv_id"},
    ])
    r = dedupe.kept_records(p, dedupe.duplicate_groups(p, 2026), 2026).collect()
    assert len(r) == 1 and (r[0].paper_id, r[0].arxiv_id, r[0].pub_year, r[0].pub_date_source, r[0].n_members) == (1, "2403.01234", 2020, "arxiv_id", 3)


def test_search(spark, make_papers):
    p = make_papers([{"paper_id": 1, "title": "Tactile Grasping", "pub_year": 2020}, {"paper_id": 2, "title": "Other", "abstract": "tactle things"}, {"paper_id": 3}])
    p = p.withColumn("tags", F.when(F.col("paper_id") == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).withColumn("summary", F.lit(None).cast("string"))
    got = search.ordered(search.search(p, "tactile"), "tactile").select("paper_id", "score").collect()
    assert [tuple(r) for r in got] == [(1, 150), (2, 0)]
    ids = lambda **k: {r.paper_id for r in search.search(p, **k).collect()}
    assert ids(tags=["x", "y"], mode="and") == {1} <= ids(tags=["x", "y"], mode="or") == {1, 2, 3}
    assert ids() == {1, 2, 3} and ids(year=2020) == {1}
    assert search.page(search.search(p), "", "title", 1, 1).count() == 1


def test_tagging_orders_and_falls_back(make_papers):
    p = make_papers([{"paper_id": 1, "title": "LiDAR tracking of objects", "folder": "WM"}, {"paper_id": 2, "title": None}, {"paper_id": 3, "title": "haptic tactile glove"}])
    got = {r.paper_id: r.all_tags for r in tagging.tagged(p).collect()}
    assert got[1] == ["Tracking", "LiDAR", "World Model"] and got[2] == ["Uncategorized"] and got[3] == ["Tactile"]


def test_cooccurrence_counts_places(spark):
    lay = spark.createDataFrame([(1, ["A"], ["B"], ["A"]), (2, [], [], [])], "paper_id long, topic array<string>, method array<string>, task array<string>")
    got = {(r.tag_a, r.tag_b): r.n for r in tagging.cooccurrence(lay).collect()}
    assert got == {("A", "B"): 2, ("A", "A"): 2, ("B", "A"): 2}


def test_similar_rows(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["x", "y"]), (4, ["x", "a"]), (5, None)], "id long, toks array<string>")
    got = graph.neighbours(d, "id", "toks", 5, max_df=4).collect()
    best = {r.src: r.dst for r in got if r["rank"] == 1}
    assert best[1] == 2 and best[2] == 1 and best[3] == 4 and 5 not in best


def brute_neighbours(rows, asked):
    n, bags = len(rows), {i: Counter(t) for i, t in rows}
    df = Counter(t for b in bags.values() for t in b)
    w = {i: {t: (1 + math.log(f)) * math.log((n + 1) / (df[t] + 1)) for t, f in b.items() if 2 <= df[t] <= 0.65 * n} for i, b in bags.items()}
    w = {i: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for i, v in w.items()}
    out = {}
    for i in asked:
        shared = sorted((-len(w[i].keys() & v.keys()), j) for j, v in w.items() if j != i and w[i].keys() & v.keys())[: graph.CANDIDATES]
        out[i] = sorted(((-round(sum(x * w[j].get(t, 0.0) for t, x in w[i].items()), 4), j) for _, j in shared))[: graph.NEIGHBOURS]
    return {i: x for i, x in out.items() if x}


def test_similar_rows_by_frequent_terms(spark, monkeypatch):
    """Terms in more than 400 rows count, in any number of passes and of rows that are told apart late."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rng.choices(words, k=rng.choice([5, 12, 30]))) for i in range(1300)]
    rows += [(1300, [f"u{i}" for i in range(700)] + words), (1301, [f"u{i}" for i in range(700)] + words[:9]), (1302, None), (1320, ["alone"])]
    d = spark.createDataFrame(rows, "id long, toks array<string>").repartition(3)
    monkeypatch.setattr(graph, "QUERIES", 30)
    got = graph.neighbours(d, "id", "toks", len(rows), F.col("id") % 20 == 0).collect()
    want = brute_neighbours([(i, t or []) for i, t in rows], range(0, 1321, 20))
    assert len(want) == 66 and {r.src for r in got} == set(want)
    for i, w in want.items():
        mine = sorted((r for r in got if r.src == i), key=lambda r: r.rank)
        assert len(mine) == len(w) and all(abs(r.score + s) < 2e-4 for r, (s, _) in zip(mine, w))


def test_similar_papers_of_a_large_library(spark, make_papers, tmp_path):
    """Every term is in more than 400 rows, none in more than 65 % of them."""
    rng = random.Random(2)
    words = ["amber", "ledger", "muddy", "gasket", "ratchet", "spindle", "winter", "mason", "auditor", "tunnel"]
    make_papers([{"paper_id": i, "title": " ".join(rng.sample(words, 5))} for i in range(1200)]).write.parquet(str(tmp_path / "library_papers.parquet"))
    got = entry.queries()["similar_papers"](spark, str(tmp_path)).collect()
    assert {r.src for r in got} == set(range(0, 1200, 20)) and {r.n for r in got} == {graph.NEIGHBOURS}


def test_enrichment_fills_only_gaps(spark, make_papers):
    p = make_papers([{"paper_id": 1, "title": "alpha beta gamma"}, {"paper_id": 2, "title": "alpha beta gamma", "pub_year": 1999}, {"paper_id": 3}])
    r = spark.createDataFrame([(1, "alpha beta gamma", 2020), (2, "zzz", 2021), (3, None, 2022)], "paper_id long, title string, pub_year int")
    got = {x.paper_id: x.pub_year for x in enrich.enriched(p, [(r, "paper_id", 0.45)], ["pub_year"]).collect()}
    assert got == {1: 2020, 2: 1999, 3: None}


def test_changes_and_upsert(spark):
    a = spark.createDataFrame([("/a|1|1",), ("/b|2|2",), ("/c|3|3",)], "ckey string")
    b = spark.createDataFrame([("/a|1|1",), ("/b|9|2",)], "ckey string")
    assert {r.status: r.n for r in incremental.changes(a, b).collect()} == {"unchanged": 1, "updated": 1, "new": 1}
    old, new = (spark.createDataFrame(x, "day string, n int") for x in ([("1", 1), ("2", 2)], [("2", 9)]))
    assert {tuple(r) for r in incremental.upserted(old, new, "day").collect()} == {("1", 1), ("2", 9)}


def test_stats_on_empty(make_papers):
    p = make_papers([])
    assert stats.publication_stats(p).count() == 0 and stats.coverage(p).first().n == 0
    assert dedupe.duplicate_groups(p, 2026).count() == 0
    assert tagging.tagged(p).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "lib/BEV").mkdir(parents=True)
    (tmp_path / "lib/BEV/a.pdf").write_bytes(b"xx")
    (tmp_path / "lib/b.pdf").write_bytes(b"")
    got = {r.stem: (r.folder, r.size_bytes, r.rel_path) for r in library.scan_libraries(spark, {"l": str(tmp_path / "lib"), "gone": str(tmp_path / "no")}).collect()}
    assert got == {"a": ("BEV", 2, "BEV/a.pdf"), "b": ("_root", 0, "b.pdf")}
    url = lambda n, u: {"type": "url", "name": n, "url": u, "date_added": "13350000000000000"}
    tree = {"roots": {"other": {"type": "folder", "name": "other", "children": [
        {"type": "folder", "name": "topics", "children": [{"type": "folder", "name": "RL", "children": [url("x", "http://a"), url("j", "javascript:1")]}, {"type": "folder", "name": "SANY", "children": [url("y", "http://b")]}]}, url("z", "http://c")]}}}
    (tmp_path / "b.json").write_text(json.dumps(tree))
    rows = library.bookmark_tree(spark, str(tmp_path / "b.json")).collect()
    assert [(r.title, r.folder_topic, r.folder) for r in rows] == [("x", "RL", "topics/RL")]
    xml = spark.createDataFrame([("<entry><title>A\n B</title><summary>s</summary><published>2024-01-02T0</published><name>X Y</name></entry>",), ("",)], "x string")
    got = [r.e for r in xml.select(library.atom_entry(F.col("x")).alias("e")).collect()]
    assert (got[0].title, got[0].published, got[0].authors) == ("A B", "2024-01-02", ["X Y"]) and got[1] is None
    js = spark.createDataFrame([('```json\n[{"id":"1","tags":["a"]}]\n```',), ('{"items":[{"id":"2","tags":[]}]}',)], "x string")
    assert [r[0][0].id for r in js.select(library.tagged_response(F.col("x"))).collect()] == ["1", "2"]


def test_stream_keeps_the_newest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string").write.parquet(str(src))
    q = refresh.merged(spark, spark.readStream.schema("k int, o int, v string").parquet(str(src)), str(tmp_path / "t"), "k", "o", str(tmp_path / "ck"))
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v=0")).select("k", "v").collect()} == {(1, "b"), (2, "c")}


def test_stream_goes_on_from_an_old_table(spark, tmp_path):
    schema, t = "k int, o int, v string", str(tmp_path / "t")

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        refresh.merged(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), t, "k", "o", str(tmp_path / name)).awaitTermination()

    newest = lambda v: {tuple(r) for r in spark.read.parquet(f"{t}/v={v}").select("k", "v").collect()}
    run([(1, 1, "a"), (2, 1, "b")], "ck1")
    run([(2, 2, "c")], "ck1")
    assert newest(1) == {(1, "a"), (2, "c")}
    spark.createDataFrame([(9, 1, "old")], schema).write.parquet(f"{t}/v=2")
    run([(3, 1, "d")], "ck2")  # a fresh checkpoint over the old table
    assert newest(3) == {(9, "old"), (1, "a"), (2, "c"), (3, "d")}
    delete(spark, f"{t}/v=3")
    with pytest.raises(Exception, match="is missing"):
        run([(4, 1, "e")], "ck2")


@pytest.mark.parametrize("hot", [0, 10**6])
def test_labels_of_a_hot_component(spark, monkeypatch, hot):
    """A third of all nodes on one centre, and a chain; every key hot, and none."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(dedupe, "HOT_ROWS", hot)
    edges = [(1000, i) for i in range(500, 540)] + [(i, i + 1) for i in range(20)]
    nodes = spark.createDataFrame([(i,) for i in {x for e in edges for x in e} | {7777}], "paper_id long")
    got = {r.paper_id: r.component for r in dedupe.label_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 500 for i in (*range(500, 540), 1000)}, **{i: 0 for i in range(21)}, 7777: 7777}


def test_keywords_with_a_hot_term(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    d = spark.createDataFrame([(i, ["hot", f"t{i % 3}", "hot"]) for i in range(30)] + [(99, None), (98, [])], "id long, toks array<string>")
    vocab = tagging.vocabulary(d, "toks", 32, min_df=2, max_share=1.0)
    got = {(r.id, r.term) for r in tagging.keywords(d, "id", "toks", vocab, least=0.0).collect()}
    assert got == {(i, t) for i in range(30) for t in ("hot", f"t{i % 3}")}


def test_authors(spark):
    rows = [["Alice Smith, Bob Lee and Carla Diaz"], ["University Lab"], ["李小龙、王五"], ["John Smith", "john smith", "X"], None, [], ["Equal contribution John Smith"], ["{Ann} $x$"], ["Jean-Luc Picard*†", "a@b.c Mary Jane Watson"], [None]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, a array<string>").orderBy("i")
    got = [tuple(r) for r in df.select(people.clean_authors(F.col("a")), people.authors_look_wrong(F.col("a"))).collect()]
    assert got == [
        (["Alice Smith", "Bob Lee", "Carla Diaz"], False), ([], True), (["李小龙"], False), (["John Smith"], True), ([], False), ([], False), ([], True), ([], True), (["Jean-Luc Picard", "Mary Jane Watson"], False), ([], True),
    ]
    lines = ["Alice Smith, Bob Lee", "12 34", "Abstract We do", "see a@b.c", "the method works well here", None]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(lines)), "i int, t string").orderBy("i").select(people.author_line(F.col("t"))).collect()] == [True, False, False, False, False, False]


def test_title_and_authors_of_a_page(spark):
    schema = "k long, x0 double, y0 double, x1 double, y1 double, text string"
    page = [(1, 100.0, 90.0, 500.0, 120.0, "a good title about small robots"), (1, 100.0, 130.0, 500.0, 150.0, "Alice Smith, Bob Lee, Carla Diaz"), (1, 100.0, 155.0, 500.0, 158.0, "University of Somewhere"),
            (1, 100.0, 160.0, 500.0, 165.0, "Dora Known"), (1, 100.0, 200.0, 500.0, 600.0, "Abstract We do things"), (2, 0.0, 0.0, 10.0, 10.0, "12345678901234"), (3, 0.0, 0.0, 1.0, 1.0, None)]
    b = spark.createDataFrame(page, schema)
    stems = spark.createDataFrame([(1, "x"), (2, "2403.00001v1_my_paper"), (3, None)], "k long, stem string")
    titles = people.title_block(b, "k", stems)
    assert {tuple(r) for r in titles.collect()} == {(1, "a good title about small robots"), (2, "my paper")}
    assert {(r.k, tuple(r.authors)) for r in people.page_authors(b, titles, "k").collect()} == {(1, ("Alice Smith", "Bob Lee", "Carla Diaz"))}
    assert people.page_authors(b.limit(0), titles, "k").count() == 0 and people.title_block(b.limit(0), "k").count() == 0


def test_dense_numbers(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("clash").alias("n"))
    assert library.numbered(df, "x").where("x = id").count() == 1000 and library.numbered(df.limit(0), "x").count() == 0


def test_responses(spark):
    rows = [(1, "bird eye view maps", "s", ["Tracking"], "bird eye view maps"), (2, None, "other name here", [], "sensor fusion of lidar"), (3, "t", "s", [], None)]
    p = spark.createDataFrame(rows, "paper_id long, title string, stem string, mine array<string>, online string")
    got = {r.paper_id: (r.status, r.similarity, r.suggestions) for r in validate.against_response(p, F.col("online"), F.col("online")).collect()}
    assert got[1] == ("verified", 1.0, ["BEV Perception"]) and got[2][:2] == ("mismatch", 0.0) and got[3] == ("not_found", None, None)


def test_windowed_counts(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    assert refresh.windowed_counts(ev.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", "event_type").agg(F.sum("n")).first()[0] == ev.count()


def test_stored_is_deleted(spark):
    import os

    t = Stored(spark.range(3), "t")
    assert t.df.count() == 3 and os.path.exists(t.path)
    t.drop()
    assert not os.path.exists(t.path)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_runs(spark, name):
    """Queries without SQL: every paper has an answer."""
    rows = entry.queries()[name](spark, SF).collect()
    papers = spark.read.parquet(f"{SF}/library_papers.parquet").count()
    assert (sum(r.n for r in rows) if "n" in rows[0] else len(rows)) == papers


def values(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("library_papers", "scan_records", "bookmarks", "documents", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert values(got.select(*cols).collect()) == values(want.fetchall())


def test_url_key_is_idempotent(spark):
    b = spark.read.parquet(f"{SF}/bookmarks.parquet").select(C.url_key(F.col("url")).alias("k"))
    assert b.where(~F.contains("k", F.lit("#")) & (C.url_key(F.col("k")) != F.col("k")) & ~F.col("k").rlike(r"/+\z")).count() == 0


def test_entry_without_the_llm_package(tmp_path):
    """A package that can't be imported leaves the core's queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "lectern", tmp_path / "lectern")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "lectern/llm").mkdir(exist_ok=True)
    (tmp_path / "lectern/llm/__init__.py").write_text("")
    (tmp_path / "lectern/llm/queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
