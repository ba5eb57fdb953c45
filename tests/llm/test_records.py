"""Problems 1, 2, 4, 5 and 6 against brute force, on the small tables and on made-up edge cases."""

import datetime
import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict
from urllib.parse import unquote

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import components as CC
from lectern.llm import p1_survivors as p1
from lectern.llm import p2_spellings as p2
from lectern.llm import p4_terms as p4
from lectern.llm import p5_near_copies as p5
from lectern.llm import p6_groups as p6
from lectern.llm.ids import id_version, well_formed_id
from lectern.operators import skew

SF = "/root/testdata/sf0.001"


def rows(table, cols=None):
    return pq.read_table(f"{SF}/{table}.parquet", columns=cols).to_pylist()


def title_key(t):
    k = "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())
    return k if len(k) >= 12 else None


def well_formed(s):
    m = re.fullmatch(r"(?:arxiv:\s*|abs/)?(\d{4}\.\d{4,5})(?:v(\d+))?", (s or "").strip(), re.I)
    if not m or not "01" <= m[1][2:4] <= "12" or set(m[1][5:]) == {"0"}:
        return None
    return (m[1], int(m[2] or 0)) if m[1][:2] >= "91" or "0704" <= m[1][:4] <= "2612" else None


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def tie(self, a, b):
        a, b = sorted((self.find(a), self.find(b)), key=str)
        self[b] = a


def brute_groups(papers):
    s = Sets()
    for r in papers:
        s.find(r["paper_id"])
        for k in (title_key(r["title"]), (well_formed(r["arxiv_id"]) or [None])[0]):
            if k:
                s.tie(r["paper_id"], ("key", k))
    g = defaultdict(list)
    for r in papers:
        g[s.find(r["paper_id"])].append(r["paper_id"])
    return {min(m): sorted(m) for m in g.values() if len(set(m)) > 1}


def test_groups(spark):
    want = {(g, x) for g, m in brute_groups(rows("library_papers")).items() for x in m}
    got = [tuple(r) for r in p6.p6_found(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_groups_of_odd_records(make_papers):
    t = "A Title That Is Long Enough"
    p = make_papers([
        {"paper_id": 3, "title": t}, {"paper_id": 1, "title": t.upper() + "!!"}, {"paper_id": 1, "title": t}, {"paper_id": 4, "title": "short", "arxiv_id": "arXiv: 2403.01234v2"},
        {"paper_id": 5, "arxiv_id": "2403.01234\n", "title": t}, {"paper_id": 6, "title": "short"}, {"paper_id": 7}, {"paper_id": None, "title": t}, {"paper_id": 8, "title": "", "arxiv_id": "2403.00000"},
    ])
    p = p.withColumn("group_id", F.lit(1)).withColumn("rep", F.lit("clash")).withColumn("nk", F.lit(0))
    assert {tuple(r) for r in p6.record_groups(p).collect()} == {(1, 1), (1, 3), (1, 4), (1, 5)}
    assert p6.record_groups(make_papers([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rng = random.Random(seed)
    e = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, i) for i in range(200, 230)] + [(1, 1), (None, 2)]
    s = Sets()
    for a, b in e:
        if a is not None and a != b:
            s[max(s.find(a), s.find(b))] = min(s.find(a), s.find(b))
    got = {r.node: r.component for r in CC.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: s.find(x) for x in s}


def test_survivors(spark):
    papers = {r["paper_id"]: r for r in rows("library_papers")}
    trust = {r["pub_date_source"]: r["trust_rank"] for r in rows("date_sources")}
    want = set()
    for g, m in brute_groups(list(papers.values())).items():
        rs = [papers[x] for x in m]
        time = lambda r: r["mtime"].timestamp() if r["mtime"] else -1e18
        keys = {
            "abstract": [(len(" ".join(r["abstract"].split())), -r["paper_id"]) for r in rs if (r["abstract"] or "").strip()],
            "pub_year": [(-trust.get(r["pub_date_source"], 10**6), time(r), -r["paper_id"]) for r in rs if r["pub_year"] and 1990 <= r["pub_year"] <= 2026],
            "rel_path": [(time(r), -r["paper_id"]) for r in rs if r["rel_path"] is not None],
            "arxiv_id": [(well_formed(r["arxiv_id"])[1], -r["paper_id"]) for r in rs if well_formed(r["arxiv_id"])],
        }
        want |= {(g, f, -max(k)[-1]) for f, k in keys.items() if k}
    got = [tuple(r) for r in p1.p1_found(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_survivors_estimate_nothing(spark, make_papers, monkeypatch):
    """the order of preference is total, so the survivors are the same with any votes and come out without them."""
    d = dict(title="A Title That Is Long Enough")
    day = [datetime.datetime(2024, 1, i) for i in (1, 2)]
    papers = make_papers([
        {**d, "paper_id": 5, "abstract": " one  two ", "pub_year": 2001, "pub_date_source": "pdf", "mtime": day[0], "rel_path": "", "arxiv_id": "2403.01234"},
        {**d, "paper_id": 4, "abstract": "one three", "pub_year": 2002, "pub_date_source": "none such", "mtime": day[1], "arxiv_id": "2403.01234v0"},
        {**d, "paper_id": 4, "abstract": "two three", "pub_year": 2002, "pub_date_source": "none such", "mtime": day[1], "arxiv_id": "2403.99999v1"},
        {**d, "paper_id": 3, "abstract": " \n", "pub_year": 1989, "pub_date_source": "pdf", "mtime": day[1], "arxiv_id": "2413.01234v9"},
        {**d, "paper_id": 2, "abstract": "one", "pub_year": 2003, "pub_date_source": "pdf", "rel_path": "x"},
        *({"paper_id": i, "title": "Another Title Without a Value"} for i in (10, 11)), {"paper_id": 12, "title": "Quite Alone in the Library", "abstract": "long " * 9}, {**d, "paper_id": None, "abstract": "long " * 9},
    ])
    src = spark.createDataFrame([("pdf", 2), ("pdf", 1), ("web", 3), (None, 0)], "pub_date_source string, trust_rank int")
    want = {(2, "abstract", 4), (2, "pub_year", 5), (2, "rel_path", 5), (2, "arxiv_id", 4)}
    voted = [{tuple(r)[:3] for r in p1.fuse(*t, prefer=True).collect()} for t in ((papers, src), p1._tables(spark, SF))]
    assert voted[0] == want

    def refuse(*_):
        raise AssertionError("a model is estimated")

    monkeypatch.setattr(p1, "estimate", refuse)
    got = [tuple(r) for r in p1.p1_found(spark, SF).collect()]
    assert set(got) == voted[1] and len(got) == len(voted[1]) > 0
    got = [tuple(r) for r in p1.preferred(papers, src).collect()]
    assert set(got) == want and len(got) == len(want)
    assert p1.preferred(make_papers([]), src.limit(0)).count() == 0


def test_fusion_discounts_copies(spark, make_papers, monkeypatch):
    """A source and its two copiers are outvoted by two others once their shared false values have given them away."""
    out, n = [], 0
    for g in range(60):
        wrong = 1991 if g % 2 or g >= 50 else 2000
        good = ("a", "b") if g >= 50 else ("a", "b", "d", "e")
        for src, year in (*((x, 2000) for x in good), *((x, wrong) for x in ("pdf", "c1", "c2"))):
            n += 1
            out.append({"paper_id": n, "title": f"Some Long Enough Title Number {g}x{g}", "pub_year": year, "pub_date_source": src})
    src = spark.createDataFrame([("pdf", 1)], "pub_date_source string, trust_rank int")
    papers = make_papers(out)
    m = p1.estimate(p1.claims(papers, src).cache(), False)
    assert m.copies[("c1", "c2")] > 0.9 and m.copies[("c1", "pdf")] > 0.9 and m.accuracy["a"] > m.accuracy["pdf"]
    years = {r["paper_id"]: r["pub_year"] for r in out}
    won = [years[r.paper_id] for r in p1.fuse(papers, src).where("field_name = 'pub_year'").collect()]
    assert won == [2000] * 60
    # the same model in tables
    want = {tuple(r) for r in p1.fuse(papers, src).collect()}
    monkeypatch.setattr(p1, "INLINE", 0)
    assert isinstance(p1.estimate(p1.claims(papers, src), False), p1.Tables)
    assert {tuple(r) for r in p1.fuse(papers, src).collect()} == want
    monkeypatch.undo()
    assert p1.dependence(50, 0, 50, 0.8, 0.8) < 0.1 < 0.9 < p1.dependence(50, 20, 0, 0.8, 0.8)
    none = make_papers([{"paper_id": 1}, {"paper_id": 2, "title": "x"}])
    assert p1.fuse(none, src).count() == 0 and p1.fuse(make_papers([]), src, prefer=True).count() == 0


def canonical(u):
    u = (u or "").strip().split("#")[0]
    m = re.match(r"(?is)([a-z]+)://([^/?]*)([^?]*)(?:\?(.*))?$", u)
    s, h, p, q = m.groups()
    h = re.sub({"http": ":80$", "https": ":443$"}[s.lower()], "", h.lower())
    return s.lower(), h, unquote(p).lower().rstrip("/"), tuple(sorted(unquote(x).lower() for x in (q or "").split("&") if x))


def test_copies(spark):
    want = set()
    for t, f, i, c in (("library_papers", title_key, "paper_id", "title"), ("bookmarks", canonical, "item_id", "url")):
        g = defaultdict(list)
        for r in rows(t, [i, c]):
            if f(r[c]):
                g[f(r[c])].append(r[i])
        want |= {(t, min(m), x) for m in g.values() for x in m if x != min(m)}
    got = [tuple(r) for r in p2.p2_found(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)
    assert p2.p2_counts(spark, SF).agg(F.sum(F.col("n_copies") - 1)).first()[0] == len(want)


SAME = [
    ("http://A.example:80/x/?b=2&a=1#top", " HTTP://a.example/X?a=1&&b=2 "), ("https://a.example/%E5%9B%9E", "https://a.example/回//"), ("https://a.example?", "https://a.example/"), ("https://a/%7Eme", "https://a/~me"),
]
DIFFERENT = [
    ("http://a.example/", "https://a.example/"), ("http://a.example/", "http://www.a.example/"), ("http://a.example:443/", "http://a.example/"), ("http://a/?x=1", "http://a/?x=2"), ("http://a/p?x=%26y", "http://a/p?x=&y"),
    ("http://a/x+y", "http://a/x y"), ("http://a/100%25", "http://a/100%2525"),
]


def test_addresses(spark):
    df = spark.createDataFrame([(a, b) for a, b in SAME + DIFFERENT], "a string, b string")
    got = [r[0] for r in df.select(p2.canonical_url(F.col("a")) == p2.canonical_url(F.col("b"))).collect()]
    assert got == [True] * len(SAME) + [False] * len(DIFFERENT)
    odd = spark.createDataFrame([(None,), ("",), (" \t",), ("not an address",), ("http://a/%zz",), ("http://a/%E4%B8",), ("x" * 100_000,)], "u string")
    c = [r[0] for r in odd.select(p2.canonical_url(F.col("u"))).collect()]
    assert c[:3] == [None] * 3 and all(c[3:])


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(p2, "_hash128", lambda c: F.unhex(F.md5(F.substring(c, 1, 1))))
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "ac"), (None, "ab"), (4, None)], "id long, canon string")
    assert {tuple(r) for r in p2.copies(df, "id", "canon").collect()} == {(1, 2)}


def test_terms(spark):
    df, tf = Counter(), {}
    for r in rows("library_papers", ["paper_id", "title", "abstract"]):
        text = unicodedata.normalize("NFKC", (r["title"] or "") + " " + (r["abstract"] or "")).lower()
        tf[r["paper_id"]] = Counter(t for t in re.findall(r"[^\W_]+(?:-[^\W_]+)*", text) if len(t) > 2 and not t.isdigit())
        df.update(tf[r["paper_id"]].keys())
    want = {(p, t) for p, c in tf.items() for t, n in c.items() if n >= 3 and 2 <= df[t] <= 12}
    assert {tuple(r) for r in p4.p4_found(spark, SF).collect()} == want


def test_terms_found_without_a_score(spark, monkeypatch):
    """F2: every score is positive, so the terms that counts define are the same without them, and none is computed."""
    scored = p4.characteristic_terms(p4._papers(spark, SF), "paper_id", F.concat_ws(" ", "title", "abstract"), p4.MIN_TF, p4.MIN_DF, p4.MAX_DF)
    want = [(r.row_id, r.term, r.score) for r in scored.collect()]
    assert want and all(x > 0 for *_, x in want)

    def refuse(*_):
        raise AssertionError("a score is computed")

    monkeypatch.setattr(p4, "divergence", refuse)
    got = [tuple(r) for r in p4.p4_found(spark, SF).collect()]
    assert set(got) == {x[:2] for x in want} and len(got) == len(want)


def test_term_scores(spark):
    import math

    d = spark.createDataFrame([(1, "rare rare rare common", 0), (2, "common common words", 1), (3, None, 2), (4, "12 ab !", 3), (None, "rare", 4), (5, "long " * 50_000, 5)], "id long, text string, df int")
    got = {(r.row_id, r.term): r for r in p4.characteristic_terms(d, "id", F.col("text")).collect()}
    assert set(got) == {(1, "rare"), (1, "common"), (2, "common"), (2, "words"), (5, "long")}
    n, avg = 3, (4 + 3 + 50_000) / 3
    tfn, lam = 3 * math.log2(1 + avg / 4), 3 / n
    assert got[(1, "rare")].score == pytest.approx((math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1), abs=1e-8)
    assert p4.characteristic_terms(d.limit(0), "id", F.col("text")).count() == 0


def words(s):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", s or "").casefold())


def brute_near(papers):
    ok = [(r["paper_id"], Counter(words(r["title"]) + words(r["abstract"]))) for r in papers if len(words(r["abstract"])) >= 40]
    s = Sets()
    for (i, a), (j, b) in itertools.combinations(ok, 2):
        if (a & b).total() >= 0.8 * max(a.total(), b.total()) - 1e-9:
            x, y = s.find(i), s.find(j)
            s[max(x, y)] = min(x, y)
    return {(s.find(x), x) for x in s if s.find(x) != x}


def test_near_copies(spark):
    assert {tuple(r) for r in p5.p5_found(spark, SF).collect()} == brute_near(rows("library_papers", ["paper_id", "title", "abstract"]))


def test_near_copies_of_one_text(spark, monkeypatch):
    """A bucket far larger than a block: edits of one text, and exact copies of it."""
    monkeypatch.setattr(p5, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    data = [(i, "t", " ".join(base)) for i in range(1, 40)]
    for i in range(40, 120):
        w = list(base)
        for j in rng.sample(range(60), 3):
            w[j] = f"x{i}{j}"
        rng.shuffle(w)
        data.append((i, None, " ".join(w)))
    data += [(500, "t", None), (501, "t", ""), (502, "t", "too few words"), (503, None, " ".join(f"q{i}" for i in range(50))), (504, "z", "long " * 20_000)]
    df = spark.createDataFrame(data, "paper_id long, title string, abstract string").withColumn("e", F.lit(0)).withColumn("s1", F.lit("clash"))
    assert {tuple(r) for r in p5.near_copy_groups(df).collect()} == {(1, i) for i in range(2, 120)}
    assert p5.near_copy_groups(df.limit(0)).count() == 0


def family(n, shared, seed=1):
    """Texts of 125 words, of which all share 95; two and two share ``shared``."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(95)]
    out = []
    for i in range(n // 2):
        both = [f"p{i}q{j}" for j in range(shared - 95)]
        for side in "xy":
            w = base + both + [f"{side}{i}q{j}" for j in range(125 - shared)]
            rng.shuffle(w)
            out.append((2 * i + (side == "y"), None, " ".join(w)))
    return out


def test_partners_in_a_large_family(spark, monkeypatch):
    """Texts that resemble each other just below the threshold, in buckets of more than a block; of several pieces."""
    monkeypatch.setattr(p5, "PIECE", 500)
    df = spark.createDataFrame(family(2000, 103), "paper_id long, title string, abstract string")
    got = {tuple(r) for r in p5.near_copy_groups(df).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(1000)} and len(got) >= 985


def test_well_formed_id(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["arXiv: 2403.01234v3", "ABS/2403.01234", "2117.27792", "1605.00000", None, "　2403.01234 ", "arXiv:abs/2403.01234"])], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(well_formed_id(F.col("x"))).collect()] == ["2403.01234", "2403.01234", None, None, None, "2403.01234", None]
    assert [r[0] for r in df.orderBy("i").select(id_version(F.col("x"))).collect()][:2] == [3, 0]
