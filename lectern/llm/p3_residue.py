"""Problem 3: template residue, filler, error pages and demands for scripts in place of content.

Labelled exemplars, a table that may be given, are indexed by their terms (words; character pairs in Chinese; letter
triples of filler). A text is cut into windows of terms. For each window the exemplars that share most of its terms are
retrieved, one after the other, until they add nothing; the window's containment is the share of its term weight
(inverse document frequency over all texts) that they cover. Texts whose windows are covered are residue. A placeholder
is an exemplar that a window need only contain.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..runtime import stored

WINDOW, STRIDE = 24, 12
#: Share of a window's weight, and of the windows' weight in a text, from which on the text is residue.
COVERED = 0.85
#: Exemplars that together may cover a window, of one label and of those that stand beside any.
TOGETHER, BESIDE = 4, ("decoration", "filler")
#: What stands in an exemplar for any one word, such as the name of a venue; a hyphenated one has two terms.
SLOT = "*"

# Labelled exemplars. Digits stand for any number, the site for any host name, a star for any word.
EXEMPLARS: dict[str, list[str]] = {
    "decoration": ["paper viewer", "lab mirror", "thank you", "ref 0", "code 0x0", "site", "re", "paper", "题目", "nbsp"],
    "template": [
        "add title here", "enter the paper title", "fill in your headline", "insert a heading", "put the document name", "supply a descriptive title",
        "type main title", "write your title", "please provide the title of the manuscript", "before submission", "as it should appear", "in this box", "required",
        "click to edit master title style", "click here to enter text", "title of the paper: subtitle if needed", "paper title (use style: paper title)",
        "enter paper title (max. 0 words)", "title goes here", "your title goes here", "running head goes here", "short title", "insert title here",
        "type the document title", "full title of your contribution", "a very long title placeholder for your submission", "replace this line with your title",
        "instructions for preparing your manuscript: put the title here", "todo: write title", "title to be decided", "title tbd", "no title yet", "untitled",
        "untitled document", "new document 0", "working title, change later", "document title not set", "sample article title for template users",
        "placeholder text for the title", "example heading to be replaced", "dummy title, please ignore", "some text for the title", "sample title to be replaced",
        "example text, please ignore", "dummy heading for the title", "some heading please ignore", "placeholder title", "placeholder heading", "example words so that the layout can be checked", "some words", "dummy words",
        "main title", "document name", "paper title", "titel hier eingeben", "saisissez le titre ici", "escriba el título aquí", "inserire qui il titolo",
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi",
        "ipsum amet elit", "dummy text dummy text dummy", "dummy dummy dummy", "filler filler filler", "text text text", "sample sample sample", "sample text, ignore",
        "test test test 0", "todo todo todo", "title title title", "abc abc abc", "aaa bbb ccc", "foo bar baz qux", "blah blah blah", 
        "placeholder placeholder placeholder",
        "测试测试", "测试文本测试文本", "标题标题标题", "占位占位占位", "这里是占位文字", "示例文本示例文本",
        "单击此处编辑标题", "在此输入论文题目", "请填写标题", "论文标题(不超过二十字)", "请输入标题", "此处填写题目", "标题待定", "未命名文档", "无标题",
    ],
    "filler": ["qwertyuiop asdfghjkl zxcvbnm", " ".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")],
    "rendering": [
        "[object object]", "nan - nan", "null | null", "null null", "none - none", "none none", "undefined: undefined", "undefined undefined", "nan nan", "#ref!", "%%eof", "eof",
        "template error on line 0: unclosed tag", "could not render template 'paper'", "traceback (most recent call last): keyerror: 'title'", "keyerror title",
        "java.lang.nullpointerexception at pdftitle.parse", "title=; author=; year=", "#value! #n/a #name?", "\\maketitle", "\\title{\\thetitle}", "title thetitle", "maketitle",
        "latex error: undefined control sequence", "syntaxerror: unexpected token", "endblock block title", "if title title if", "no title title",
    ],
    "error": [
        "error 0: not found", "error 000: gone", "0 | bad gateway", "000 internal server error", "http 0 - gateway timeout", "http 000 - unauthorized", "forbidden", "unauthorized (0)", "gone (0)",
        "service unavailable", "too many requests", "gateway timeout", "bad request", "payment required", "request timeout", "not found", "access denied",
        "the page failed to open", "that link timed out", "the mirror site has expired", "the pdf could not be loaded", "this paper was blocked by the server",
        "the requested file returned status 0", "your download is not available right now", "the page does not exist any more", "the file is damaged and could not be opened",
        "the article you asked for", "we are sorry for the inconvenience", "contact the administrator", "try again later", "go back to the home page", "sorry, an unexpected error has occurred (ref 0)", "the server responded with status 0",
        "this site can't be reached", "request blocked, reference no. 0", "the requested document is temporarily unavailable", "this page has moved or no longer exists",
        "oops! something went wrong", "access to this resource was denied", "bandwidth limit exceeded", "we can't find the page you are looking for",
        "database connection failed", "document not available in your region", "connection timed out while contacting site", "too many redirects at site", "ssl handshake with site failed", "could not resolve host site",
        "your session has expired, please sign in again", "sign in to continue", "the requested url was not found on this server", "you do not have permission to view this page",
        "seite nicht gefunden", "page introuvable - erreur 0", "página no encontrada", "pagina non trovata", "zugriff verweigert", "accès refusé",
        "服务器内部错误,请稍后再试", "访问过于频繁,请稍后重试", "无权访问该资源", "页面不存在或已被删除", "找不到该页面", "链接已失效", "会话已过期,请重新登录", "网络连接超时",
    ],
    "scripts": [
        "please enable javascript to continue", "enable javascript and cookies to continue", "you need to enable javascript to run this app.", "javascript is disabled in your browser",
        "please turn on cookies and reload", "this viewer requires scripts to be turned on", "sorry, this reader only works with scripting on", "noscript: content hidden",
        "your browser does not support scripts; the paper cannot be shown", "checking your browser before accessing site", "just a moment... verifying you are human",
        "complete the security check to access the pdf", "to view this paper, allow scripts", "to keep site safe, disable your script blocker first", "before you continue, turn on javascript",
        "if you see this line, switch on scripting in your browser", "reader error: enable cookies and scripts and reload", "complete the captcha", "use a browser with javascript support", "for the full document", "please confirm that you are not a robot", "verify you are human",
        "loading, please wait. if nothing happens, allow scripts for site", "this page needs javascript", "cookies must be enabled", "activez javascript pour afficher ce document", "bitte aktivieren sie javascript", "active javascript para continuar",
        "请启用javascript后重新加载页面", "您的浏览器已禁用脚本", "正在验证您是否为真人", "请开启cookie", "请完成安全验证", "请允许脚本运行",
    ],
    "style": [
        "page 0 of 0", "accepted for publication in a future issue of this journal; content may change", "copyright 0 by the author(s). all rights reserved.", "preprint, work in progress.",
        "preprint. under review.", "running title: * 0 camera-ready template", "proceedings of the 0th international conference on * 0", "proceedings of the 0nd conference", "proceedings of the 0rd conference", "proceedings of the 0st conference",
        "final version to appear in * 0", "* 0 submission #0. confidential review copy.", "confidential review copy. do not distribute", "anonymous * submission, paper id",
        "journal of * class files, vol. 0, no. 0, month 0", "* transactions on *, vol. xx, no. x, xxxx 0", "manuscript submitted to * 0. do not distribute.", "published as a workshop paper at * 0",
        "published as a conference paper at * 0", "currently under double-blind review at * 0", "under review as a conference paper at * 0", "submitted to * 0", "camera-ready template",
        "this work has been submitted for possible publication", "personal use is permitted", "licensed under a creative commons attribution license",
        "preprint submitted to *", "author manuscript", "manuscript draft", "journal logo", "运行标题", "版权所有 翻印必究", "内部资料 请勿外传",
    ],
}
#: Names of template fields, and the delimiters that templates put around them. Names are written without
#: separators. A strong pair marks a placeholder around any name, a weak one around a field's name only.
FIELD_NAMES = (
    "title papertitle maintitle articletitle doctitle documenttitle shorttitle subtitle thetitle pagetitle headline heading name papername docname filename author authors authorname "
    "venue journal conference year date month dataset method topic task project sitename site domain affiliation institution email abstract keywords subject category tag version doi id volume"
).split()
STRONG = [("{{", "}}"), ("<%=", "%>"), ("{%", "%}"), ("${", "}"), ("#{", "}"), ("%(", ")s"), ("@@", "@@"), ("[[", "]]"), ("<!--", "-->"), ("\\thetitle", ""), ("{#if", "}"), ("<?", "?>")]
WEAK = [("{", "}"), ("[", "]"), ("<", ">"), ("%", "%"), ("$", "$"), ("__", "__"), ("«", "»"), ("【", "】"), ("<your", ">"), ("<insert", ">"), ("[your", "]"), ("[insert", "]")]

_SITE = re.compile(r"\b(?:[a-z0-9-]+\.)+(?:example|test|invalid|com|org|net|edu|io|cn|local)\b")


def prepared(text: str) -> str:
    """NFKC, entities and format characters resolved, case folded, whitespace collapsed, letter-spacing closed."""
    t = unicodedata.normalize("NFKC", html.unescape(unicodedata.normalize("NFKC", text)))
    t = "".join(c for c in t if unicodedata.category(c) != "Cf").casefold()
    parts = t.split()
    return " ".join(parts)


_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+|[^\W_\u3040-\u30ff\u3400-\u9fff]+")


def terms(prepared_text: str, vocab: frozenset[str]) -> list[str]:
    """Words and, in Chinese, pairs of neighbouring characters; any number is one zero, any host name one word."""
    t = re.sub(r"\d+", "0", _SITE.sub(" site ", prepared_text))
    parts = t.split()
    if len(parts) >= 4 and sum(len(x) == 1 for x in parts) >= 0.7 * len(parts):
        whole = re.sub(r"\d+", "0", _SITE.sub(" site ", "".join(prepared_text.split())))
        t = " ".join(w for x in _RUN.findall(whole) for w in ([x] if x[0] >= "\u3040" else _respaced(x, vocab)))
    out = []
    for run in _RUN.findall(t):
        if "\u3040" <= run[0] <= "\u9fff" and len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def _respaced(k: str, vocab: frozenset[str]) -> list[str]:
    """Letter-spaced text cut into the exemplars' words: as few letters as possible outside words, then few words."""
    k = re.sub("0+", "0", k)
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for j in range(1, len(k) + 1):
        cost, n, _ = best[j - 1]
        top = (cost + 1, n + 1, j - 1)
        for i in range(max(0, j - 16), j):
            if k[i:j] in vocab:
                top = min(top, (best[i][0], best[i][1] + 1, i))
        best.append(top)
    cut, j = [], len(k)
    while j:
        cut.append(k[best[j][2] : j])
        j = best[j][2]
    return cut[::-1]


def _pieces(word: str) -> list[str]:
    """A word of filler by its letter triples, marked as such; a short one by itself."""
    return ["~" + word[i : i + 3] for i in range(max(1, len(word) - 2))]


class Index:
    """Term -> the exemplars that have it; their labels, slots and, for filler, letter triples and pairs."""

    def __init__(self, exemplars: list[tuple[str, str]]):
        self.label = [label for label, _ in exemplars]
        self.slots = [text.count(SLOT) for _, text in exemplars]
        bags = [terms(prepared(text), frozenset()) for _, text in exemplars]
        self.size = [len(set(bag)) for bag in bags]
        self.vocab = frozenset(x for label, bag in zip(self.label, bags) for x in bag if label != "filler")
        self.post: dict[str, list[int]] = {}
        for e, (label, bag) in enumerate(zip(self.label, bags)):
            each = {p for w in bag for p in (*_pieces(w), *("~" + w[i : i + 2] for i in range(len(w) - 1)))} if label == "filler" else set(bag)
            for x in sorted(each):
                self.post.setdefault(x, []).append(e)

    def having(self, term: str) -> set[int]:
        """The exemplars that have a term, or all the triples of a word."""
        out = set(self.post.get(term, ()))
        if term.isascii() and term.isalpha() and len(term) > 1:
            each = [self.post.get(p) for p in _pieces(term)]
            if all(each):
                out |= set.intersection(*map(set, each))
        return out

    def cover(self, window: list[str]) -> list[bool | None] | None:
        """Which terms of a window the retrieved exemplars cover; null for a word that only fills a slot. Of the labels
        the one that covers most counts; none, if no exemplar has a term of the window."""
        have = [self.having(t) for t in window]
        labels = {self.label[e] for h in have for e in h} - {"decoration"}
        labels = labels - {"filler"} or labels
        best: list[bool | None] | None = None
        for label in sorted(labels):
            hit: list[bool | None] = [False] * len(window)
            slots = 0
            for _ in range(TOGETHER):
                gain: dict[int, int] = {}
                for h, done in zip(have, hit):
                    if not done:
                        for e in h:
                            if self.label[e] == label or self.label[e] in BESIDE:
                                gain[e] = gain.get(e, 0) + 1
                if not gain:
                    break
                pick = max(gain, key=lambda e: (gain[e], -e))
                if self.slots[pick] and 2 * len({t for t, h in zip(window, have) if pick in h}) > self.size[pick]:
                    slots += self.slots[pick]  # most of the exemplar is there
                hit = [done or pick in h for h, done in zip(have, hit)]
            for i, h in enumerate(have):
                if slots and not hit[i] and not h:
                    hit[i], slots = None, slots - 1
                    if i + 1 < len(have) and not hit[i + 1] and not have[i + 1]:
                        hit[i + 1] = None
            if best is None or sum(x is True for x in hit) > sum(x is True for x in best):
                best = hit
        return best


_ASK = re.compile("^(?:your|insert|enter|the|请填写|请输入|填写|输入)+|here$")
_BARE = re.compile(r"[\s_\-.|:]")


def has_placeholder(prepared_text: str) -> bool:
    """A window between delimiters, of any length, holds a field's name, or any name if the delimiters occur in templates only."""
    t = re.sub(r"\s+", "", prepared_text)
    for a, b in STRONG:
        # an end after any of the starts is an end after the first one
        i = t.find(a)
        if i >= 0 and (not b or t.find(b, i + len(a)) >= 0):
            return True
    if t in ("{{", "{{{", "}}") or "\\title{}" in t:
        return True
    for a, b in WEAK:
        i = t.find(a)
        while i >= 0:
            j = t.find(b, i + len(a))
            if j < 0:
                break
            if (j - i <= 40 or t.find(a, i + len(a), j) < 0) and _ASK.sub("", _BARE.sub("", t[i + len(a) : j])) in _NAMES:
                return True
            i = t.find(a, i + 1)
    return bool(re.search(r"\\[a-z_]*(?:title|author|year|name|venue|headline|dataset|method|topic|task|project|site)[a-z_.]*\{\}", t))


_NAMES = frozenset(FIELD_NAMES)


def labelled(exemplars: DataFrame | None = None) -> list[tuple[str, str]]:
    """The exemplars of a table ``(label, text)``, or the ones above. They are indexed in every task, so there must not be
    more than MAX_EXEMPLARS."""
    if exemplars is None:
        return [(label, t) for label, texts in EXEMPLARS.items() for t in texts]
    rows = exemplars.where("label is not null and text is not null").select("label", "text").distinct().orderBy("label", "text").limit(MAX_EXEMPLARS + 1).collect()
    if len(rows) > MAX_EXEMPLARS:
        raise ValueError(f"more than {MAX_EXEMPLARS} exemplars")
    return [(r.label, r.text) for r in rows]


MAX_EXEMPLARS = 100_000


def _retrieve(exemplars: list[tuple[str, str]], least: float):
    """Placeholders, and each window with its terms and cover, of texts of which at least a share of the terms is covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(exemplars)
        for b in batches:
            ids, marks, wins, gs, cov = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = prepared(text)
                t = [] if has_placeholder(p) else terms(p, index.vocab)
                if not t:
                    # without a letter or digit a title says nothing: what is left of a failed rendering
                    if p and (has_placeholder(p) or not any(c.isalnum() for c in p)):
                        ids.append(i), marks.append(True), wins.append(None), gs.append(None), cov.append(None)
                    continue
                found = [(w, t[at : at + WINDOW], index.cover(t[at : at + WINDOW])) for w, at in enumerate(range(0, max(1, len(t) - STRIDE), STRIDE))]
                known, of = sum(c.count(True) for _, _, c in found if c), sum(len(g) - (c or []).count(None) for _, g, c in found)
                if not known or known < least * of:
                    continue
                for w, g, c in found:
                    ids.append(i), marks.append(False), wins.append(w), gs.append(g), cov.append(c or [False] * len(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.bool_()), pa.array(wins, pa.int32()), pa.array(gs, pa.list_(pa.string())), pa.array(cov, pa.list_(pa.bool_()))],
                names=["row_id", "mark", "win", "g", "c"],
            )

    return run


def _all_terms(exemplars: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Index(exemplars).vocab
        for b in batches:
            out: list[str] = []
            for text in b.column(0).to_pylist():
                out += set(terms(prepared(text), vocab))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["g"])

    return run


def residue(docs: DataFrame, row_id: str, text: str, exemplars: DataFrame | None = None, threshold: float = COVERED) -> DataFrame:
    """``(row_id, containment)`` of the rows whose text is, or still contains, residue.

    ``containment`` is 1 for a placeholder, otherwise the covered share of the text's weight. Null and blank texts, and
    rows with a null id, are no cases. Texts of any length are cut into windows; document frequencies cover all rows. A
    text is weighted only if enough of its terms are covered for any weighting to reach the threshold: weights lie
    between ln 2 and ln (1 + the number of texts).
    """
    known = labelled(exemplars)
    d = docs.where(F.col(row_id).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    total = max(1, d.count())
    low, high = math.log(2), math.log(1 + total)
    bound = threshold**2  # of all windows together: covered windows have at least threshold times threshold of the weight
    least = bound * low / ((1 - bound) * high + bound * low)
    got = stored(d.mapInArrow(_retrieve(known, least), "row_id long, mark boolean, win int, g array<string>, c array<boolean>"), "p3_retrieved")
    long = got.where(~F.col("mark")).select("row_id", "win", F.inline(F.arrays_zip(F.col("g").alias("g"), F.col("c").alias("c")))).where("c is not null")
    wanted = long.groupBy("g").agg(F.count("*").alias("n"))
    df = d.select("text").mapInArrow(_all_terms(known), "g string").groupBy("g").agg(F.count("*").alias("df"))
    df = stored(df.join(wanted, "g"), "p3_terms")
    rows, hottest = df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    weight = F.log(1 + total / F.col("df"))
    w = lookup(long, df, "g", "n", rows, hottest).groupBy("row_id", "win").agg(F.sum(F.when(F.col("c"), weight).otherwise(0.0)).alias("in"), F.sum(weight).alias("of"))
    by_text = w.groupBy("row_id").agg(
        (F.sum(F.when(F.col("in") >= threshold * F.col("of"), F.col("of")).otherwise(0.0)) / F.sum("of")).alias("share"), (F.sum("in") / F.sum("of")).alias("containment")
    )
    whole = by_text.where(F.col("share") >= threshold).select("row_id", F.round("containment", 6).alias("containment"))
    return got.where("mark").select("row_id", F.lit(1.0).alias("containment")).unionByName(whole).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scan_id)`` of the scanned records whose title is residue."""
    return residue(spark.read.parquet(f"{sf_dir}/scan_records.parquet"), "scan_id", "title").select(F.col("row_id").alias("scan_id"))
