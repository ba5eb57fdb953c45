from pyspark.sql import functions as F

from lectern.functions import clean as C
from lectern.functions import rules as R
from lectern.functions.text import fold, letters_and_digits
from lectern.operators import clean, people, summary, validate


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def out(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_preprint_ids(spark):
    ids = ["2403.01234", "2413.01234", "0703.1234", "0704.1234", "9912.1234", "2403.00000", " 2403.01234v2\n", None, "", "2712.00001", "23O8.47868"]
    df = col(spark, ids)
    assert out(df, C.valid_preprint_id(F.col("x"), 2026)) == [True, False, False, True, True, False, True, False, False, False, False]
    assert out(df, C.invalid_preprint_id(F.col("x"), 2026)) == [False, True, True, False, False, True, False, False, False, True, True]
    assert out(df, C.preprint_year(F.col("x"), 2026))[:5] == [2024, None, None, 2007, 1999]


def test_folding_agrees_with_python(spark):
    texts = ["Ｆｕｌｌ Ｗｉｄｔｈ", "straße", "plain Text-1", "ﬁne", None, "", "日本 2024", "é"]
    want = [None if t is None else "".join(c for c in fold(t) if c.isalnum()) for t in texts]
    assert out(col(spark, texts), letters_and_digits(F.col("x"))) == want


def test_url_key_and_domain(spark):
    df = col(spark, ["http://A/x/", "http://a/#t", None, "https://www.B.example:8443/q?x=1", "no address"])
    assert out(df, C.url_key(F.col("x"))) == ["http://a/x", "http://a/", None, "https://www.b.example:8443/q?x=1", "no address"]
    assert out(df, C.domain_of(F.col("x"))) == ["a", "a", "unknown", "b.example:8443", "unknown"]


def test_titles(spark):
    df = col(spark, ["A Study: of X v2", None, "  Weird__name ", "2403.01234v1_some-name"])
    assert out(df, C.normalized_title(F.col("x")))[:2] == ["a study of x", ""]
    assert out(df, C.title_from_stem(F.col("x")))[3] == "some name"
    a, b = F.split(F.lit("p q r"), " "), F.split(F.lit("p q r s"), " ")
    assert out(col(spark, ["x"]), C.token_similarity(a, b)) == [0.75]


def test_tokens(spark):
    df = col(spark, ["The end-to-end model 12 ﬁts", None, ""])
    assert out(df, C.tokens(F.col("x"))) == [["end-to-end", "fits"], [], []]
    assert out(df, C.tokens(F.col("x"), False))[0] == ["end", "end", "ﬁts".replace("ﬁ", "fi")]


def test_month_and_cache_keys(spark):
    one = col(spark, ["/a|b/c.pdf|1700000000|99"])
    assert out(one, C.path_of_cache_key(F.col("x"))) == ["/a|b/c.pdf"]
    assert out(one, C.month_key(F.lit(2024), F.lit(None).cast("int"))) == ["2024"] and out(one, C.month_key(F.lit(2024), F.lit(3))) == ["2024-03"]
    assert out(one, C.browser_seconds(F.lit("13350000000000000"))) == [13350000000 - 11644473600] and out(one, C.browser_seconds(F.lit("x"))) == [0]


def test_sections(spark):
    body = "Title\nAbstract. " + "word " * 40 + "\n1. Introduction\n" + "intro text con- tinues " * 10 + "\n2. Method\nrest"
    df = col(spark, [body, "nothing", None])
    a, i = out(df, C.abstract_of(F.col("x"))), out(df, C.introduction_of(F.col("x")))
    assert a[0].startswith("word word") and a[1:] == [None, None]
    assert "continues" in i[0] and "rest" not in i[0] and i[1:] == [None, None]


JUNK = [
    ("动机：作者试图探究，能否单靠开源机器人数据", "cn_motivation"), ("观察：该方法在仿真中表现良好", "cn_observation"), ("提出：一种新的 VLA 框架", "cn_propose"), ("该论文的核心贡献在于...", "cn_contribution"),
    ("Published as a conference paper at RLC 2024", "conf_paper_boilerplate"), ("详见摘要", "cn_see_abstract"), ("Qwen-VLA: Unifying Vision-Language-Action Modeling across Tasks", None),
    ("DINO: DETR with Improved DeNoising Anchor Boxes for End-to-End Object Detection", None), ("Under review as a conference paper at NeurIPS 2025", "under_review_conf"), (None, None), (" ", None),
]


def test_junk_titles(spark):
    df = spark.createDataFrame([(t,) for t, _ in JUNK], "title string").withColumn("stem", F.lit("x")).withColumn("title_is_filename", F.lit(False))
    got = [r.junk for r in clean.with_junk(df).collect()]
    for (title, reason), reasons in zip(JUNK, got):
        assert (reason in reasons) if reason else reasons == [], title


def test_exclusion(make_papers):
    rows = [
        {"paper_id": 1, "stem": "lecture12_hres", "size_bytes": 5}, {"paper_id": 2, "stem": "cvpr17_pointnet_slides"}, {"paper_id": 3, "size_bytes": 0, "stem": "lecture1"},
        {"paper_id": 4, "stem": "ok", "title": "Fine"}, {"paper_id": 5, "stem": "ok", "rel_path": "x/Course_Slides/y.pdf"}, {"paper_id": 6},
    ]
    got = {r.paper_id: r.exclude_reason for r in clean.excluded(make_papers(rows)).collect()}
    assert got == {1: "lecture_deck", 2: "slides_deck", 3: "empty_file", 4: None, 5: "dir:course_slides", 6: None}


def test_repaired_dates(make_papers):
    rows = [
        {"paper_id": 1, "arxiv_id": "2403.01234", "pub_year": 1999, "stem": "a"}, {"paper_id": 2, "arxiv_id": "2413.01234", "pub_year": 2024, "pub_date_source": "arxiv_id", "stem": "x_2018"},
        {"paper_id": 3, "arxiv_id": "bad", "pub_year": 2011, "pub_date_source": "pdf", "stem": "y", "title": "Good title"}, {"paper_id": 4, "pub_year": 3000, "stem": "2001.00001"}, {"paper_id": 5},
    ]
    got = {r.paper_id: (r.arxiv_id, r.pub_year, r.pub_date_source, r.needs_review) for r in clean.repaired_dates(make_papers(rows), 2026).collect()}
    assert got == {1: ("2403.01234", 2024, None, False), 2: (None, 2018, "filename", False), 3: (None, 2011, "pdf", False), 4: ("2001.00001", 2020, "arxiv_id", False), 5: (None, None, None, True)}


def test_confidence_values(spark, make_papers):
    from lectern.operators import tagging

    rows = [{"paper_id": 1, "title": "x", "title_is_filename": True}, {"paper_id": 2, "title": "x"}]
    got = {r.paper_id: r.confidence for r in validate.validated(tagging.rule_layers(make_papers(rows)), 2026).collect()}
    assert got == {1: 0.43, 2: 0.66}


def test_authors(spark):
    df = col(spark, [["Ada Lovelace, Alan Turing and ada lovelace"], ["University of X"], None, ["李雷"], ["李小雷"], ["{x}"]], "array<string>")
    assert out(df, people.clean_authors(F.col("x"))) == [["Ada Lovelace", "Alan Turing"], [], [], [], ["李小雷"], []]
    assert out(df, people.authors_look_wrong(F.col("x"))) == [False, True, False, True, False, True]


def test_title_block(spark):
    rows = [(1, 100.0, 20.0, 500.0, 40.0, "A Very Good Title of a Paper"), (1, 100.0, 60.0, 500.0, 70.0, "A. B., C. D., E. F., G. H., I. J., K. L."), (1, 0.0, 700.0, 600.0, 800.0, "body text of the page")]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, text string")
    assert people.title_block(df, "id").collect()[0].title == "A Very Good Title of a Paper"


def test_summary(spark):
    df = spark.createDataFrame([("A Title: sub", "We propose a thing for robots. However it remains hard to do. It improves success by 3 points."), ("Only Title", None), (None, None)], "t string, a string")
    got = out(df, summary.rule_summary(F.col("t"), F.col("a")))
    assert got[0].startswith("We propose") and got[1] == "Only Title" and got[2] is None


def test_patterns_stay_equal():
    import re

    for layer in R.TAXONOMY.values():
        for patterns in layer.values():
            for p in patterns:
                need = R.needed(p)
                assert need in p.replace("\\", "") or not need
    assert re.search(R.portable(r"\bbev\b").replace(r"\p{L}\p{N}_", "a-z0-9_").replace(r"\z", r"\Z"), "a bev b")


def test_small_projections(spark):
    from lectern.operators import enrich
    from lectern.sources import library

    one = col(spark, ["Ａ"])
    get = lambda c: out(one, c)[0]
    assert get(C.highlighted(F.lit("a <b> Robot robots"), ["robot", "robots"])) == "a &lt;b&gt; <mark>Robot</mark> <mark>robots</mark>"
    assert 0 <= get(C.tag_hue(F.lit("VLA"))) < 360 and get(C.tag_hue(F.lit("VLA"))) == get(C.tag_hue(F.lit("VLA")))
    assert get(C.trimmed_summary(F.lit(' a "b" ' + "c" * 200))).endswith("…") and len(get(C.trimmed_summary(F.lit("c" * 200)))) == 120
    assert get(C.first_valid_id(F.lit("x 2413.01234 y 2403.01234 [cs.RO]"), 2026)) == "2403.01234" and get(C.category_in_text(F.lit("[cs.RO]"))) == "cs.RO"
    path = F.array(*map(F.lit, ("other", "a", "topics", "RL", "x")))
    assert get(C.topic_of(path)) == "RL" and get(C.folder_label(path)) == "topics/RL/x" and get(C.topic_of(F.array().cast("array<string>"))) == "other"
    assert get(C.title_head(F.lit("Name: a long story"))) == "Name" and get(C.latin_share(F.lit("ab12"))) == 0.5
    assert get(summary.resolved(F.lit("w"), F.lit("h"), F.lit("r"), F.lit("v"), F.lit("h"), "v", F.lit("x"))) == "w"
    assert get(summary.resolved(F.lit("w"), F.lit("h"), F.lit("r"), F.lit("v"), F.lit("i"), "v", F.lit("x"))) == "r"
    assert get(enrich.first_clean([F.lit("bad"), F.lit(""), F.lit("ok")], [F.lit(True), F.lit(False), F.lit(False)])) == "ok"
    assert get(library.favourite_title(F.lit(""), F.lit(None).cast("string"), F.lit("e" * 200), F.lit("k"))) == "e" * 120
    new, old = (spark.createDataFrame(x, "generated_at string, votes long, thanks long") for x in ([("2", None, 5)], [("1", 7, 1), ("0", 3, 1)]))
    assert tuple(enrich.latest_or_previous(new, old, ["votes", "thanks"]).first()) == ("2", 7, 5)
    fav = spark.createDataFrame([([[("a", 1)], None],)], "lists array<array<struct<t:string,n:int>>>")
    assert [tuple(r) for r in library.favourites(fav).collect()] == [("a", 1)]


def test_versions_and_cache(spark, tmp_path):
    from lectern.sources import library

    assert library.read_cache(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "c.json").write_text('{"a": 1}\nnot json\n')
    assert [r.a for r in library.read_cache(spark, str(tmp_path / "c.json"), "a int").collect()] == [1]
    p = library.write_version(spark.range(2), str(tmp_path / "t"), "7")
    assert p.endswith("version=7") and spark.read.parquet(p).count() == 2
