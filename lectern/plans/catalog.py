"""The named queries, each over its whole tables, and the SQL beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import rules as R
from ..operators import clean, dedupe, enrich, graph, incremental, people, search, stats, summary, tagging, validate
from ..runtime import spread, stored
from ..sources import library
from ..sources.library import table
from . import sql as S

#: The date on which everything is judged; nothing asks the clock.
AS_OF, AS_OF_TIME = 2026, "2026-09-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library_papers")


def wide_papers(spark: SparkSession, d: str) -> DataFrame:
    """The papers for work that costs far more than moving a row."""
    return spread(papers(spark, d))


def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bookmarks")


def _toks(df: DataFrame, hyphens: bool = True, *texts: str) -> DataFrame:
    parts = [F.coalesce(c, F.lit("")) for c in (texts or ("title", "abstract"))]
    return df.withColumn("toks", C.tokens(F.concat_ws(" ", *parts), hyphens))


# --- terms -------------------------------------------------------------------------------------------------------

_PTOK = S.tokens("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))")
_VOCAB = f"""toks AS (SELECT paper_id, {_PTOK} AS ts FROM library_papers),
  df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM toks) GROUP BY term),
  vocab AS (SELECT term, df, ln(((SELECT count(*) FROM library_papers) + 1.0) / (df + 1.0)) AS idf FROM df WHERE df >= 12 AND df <= 0.25 * (SELECT count(*) FROM library_papers))"""


@query(f"""WITH {_VOCAB}, tf AS (SELECT paper_id, term, count(*) AS tf, min(pos) AS pos FROM (SELECT paper_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM toks) GROUP BY ALL),
  s AS (SELECT paper_id, term, pos, round((1 + ln(tf)) * idf, 9) AS score FROM tf JOIN vocab USING (term))
  SELECT paper_id, term, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos)::INT AS rank FROM s WHERE score > 0.8) WHERE rank <= 3""")
def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    p = wide_papers(spark, d)
    t = _toks(p).select("paper_id", "toks")
    kw = tagging.keywords(t, "paper_id", "toks", tagging.vocabulary(t, "toks", p.count()))
    return kw.select("paper_id", "term", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def keyword_vocab(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return tagging.vocabulary(_toks(p), "toks", p.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({S.tokens('text')})) AS term FROM documents) GROUP BY term")
def document_terms(spark: SparkSession, d: str) -> DataFrame:
    return tagging.document_frequency(_toks(table(spark, d, "documents"), True, "text"), "toks")


# --- cleaning ----------------------------------------------------------------------------------------------------


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(junk) AS reason FROM {S.with_junk('scan_records', chr(39).join(('title_source = ', 'stem', '')))}) GROUP BY reason")
def junk_reasons(spark: SparkSession, d: str) -> DataFrame:
    """(reason, n) over the scanned titles."""
    s = table(spark, d, "scan_records").withColumn("title_is_filename", F.col("title_source") == "stem")
    return clean.with_junk(s).select(F.explode("junk").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT scan_id, array_to_string(junk, '|') AS reasons FROM {S.with_junk('scan_records', chr(39).join(('title_source = ', 'stem', '')))} WHERE len(junk) > 0")
def junk_titles(spark: SparkSession, d: str) -> DataFrame:
    """The scanned titles that are junk, with every reason."""
    s = table(spark, d, "scan_records").withColumn("title_is_filename", F.col("title_source") == "stem")
    return clean.with_junk(s).where(F.size("junk") > 0).select("scan_id", F.array_join("junk", "|").alias("reasons"))


@query(f"SELECT paper_id, exclude_reason FROM {S.excluded('library_papers')} WHERE exclude_reason IS NOT NULL")
def excluded_papers(spark: SparkSession, d: str) -> DataFrame:
    return clean.excluded(papers(spark, d)).where("exclude_reason is not null").select("paper_id", "exclude_reason")


@query(f"SELECT exclude_reason, count(*) AS n FROM {S.excluded('library_papers')} GROUP BY 1")
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return clean.excluded(papers(spark, d)).groupBy("exclude_reason").agg(F.count("*").alias("n"))


_STEM = r"regexp_extract(stem, '(?:^|[_.\-])(20[0-9]{2})(?:[_.\-]|\z)', 1)"
_STEM_ID = r"regexp_extract(stem, '^([0-9]{4}[.][0-9]{4,5})(?:v[0-9]+)?\z', 1)"


def _id_part(c: str, part: str) -> str:
    y = f"substr({S.stripped(c)}, 1, 2)::INT"
    return f"(CASE WHEN {y} >= 91 THEN 1900 ELSE 2000 END + {y})" if part == "year" else f"substr({S.stripped(c)}, 3, 2)::INT"


_REPAIRED = f"""WITH a AS (SELECT *, {S.valid_id('arxiv_id', AS_OF)} AS valid, CASE WHEN {S.valid_id(_STEM_ID, AS_OF)} THEN {_STEM_ID} END AS named,
    CASE WHEN try_cast(nullif({_STEM}, '') AS INT) BETWEEN 1990 AND {AS_OF} THEN try_cast({_STEM} AS INT) END AS named_year FROM library_papers),
  b AS (SELECT *, valid AND (pub_date_source IS NULL OR pub_date_source = 'arxiv_id') AS by_id, (NOT valid AND coalesce(pub_date_source IN ('arxiv_id', 'arxiv_api'), false))
    OR coalesce(NOT valid AND regexp_matches(arxiv_id, '^[0-9]{{4}}[.]') AND pub_date_source IS NULL AND pub_year = 2000 + try_cast(substr(arxiv_id, 1, 2) AS INT)
      AND (pub_month IS NULL OR pub_month = try_cast(substr(arxiv_id, 3, 2) AS INT)), false) AS gone FROM a),
  c AS (SELECT *, CASE WHEN by_id THEN {_id_part('arxiv_id', 'year')} WHEN NOT gone THEN pub_year END AS y1, CASE WHEN by_id THEN {_id_part('arxiv_id', 'month')} WHEN NOT gone THEN pub_month END AS m1,
    CASE WHEN NOT gone THEN pub_date_source END AS s1 FROM b),
  d AS (SELECT *, NOT valid AND NOT coalesce(y1 BETWEEN 1990 AND {AS_OF}, false) AS bad FROM c),
  e AS (SELECT *, CASE WHEN NOT bad THEN y1 END AS y, CASE WHEN NOT bad THEN m1 END AS m, CASE WHEN NOT (bad AND (s1 IS NULL OR s1 IN ('arxiv_id', 'arxiv_api'))) THEN s1 END AS s,
    CASE WHEN valid THEN {S.stripped('arxiv_id')} END AS aid FROM d),
  f AS (SELECT *, aid IS NULL AND named IS NOT NULL AND y IS NULL AS by_name, y IS NULL AND named_year IS NOT NULL AS by_year FROM e)
  SELECT paper_id, coalesce(aid, named) AS arxiv_id, CASE WHEN by_name THEN {_id_part('named', 'year')} WHEN by_year THEN named_year ELSE y END AS pub_year,
    CASE WHEN by_name THEN {_id_part('named', 'month')} ELSE m END AS pub_month, CASE WHEN by_name THEN 'arxiv_id' WHEN by_year THEN 'filename' ELSE s END AS pub_date_source FROM f"""


@query(_REPAIRED)
def repaired_dates(spark: SparkSession, d: str) -> DataFrame:
    return clean.repaired_dates(papers(spark, d), AS_OF).select("paper_id", "arxiv_id", "pub_year", "pub_month", "pub_date_source")


@query(f"""SELECT paper_id, coalesce(title_is_filename, false) OR r.pub_year IS NULL OR len(junk) > 0 AS needs_review FROM {S.with_junk('library_papers')} JOIN ({_REPAIRED}) r USING (paper_id)""")
def review_marks(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, needs_review) after the repair of the dates."""
    return clean.repaired_dates(papers(spark, d), AS_OF).select("paper_id", "needs_review")


@query(rf"""SELECT paper_id, {S.valid_id('arxiv_id', AS_OF)} AS valid, coalesce(arxiv_id <> '' AND NOT {S.valid_id('arxiv_id', AS_OF)}, false) AS invalid,
  CASE WHEN {S.valid_id('arxiv_id', AS_OF)} THEN (CASE WHEN substr({S.stripped('arxiv_id')}, 1, 2)::INT >= 91 THEN 1900 ELSE 2000 END + substr({S.stripped('arxiv_id')}, 1, 2)::INT) END AS id_year,
  CASE WHEN try_cast(nullif({_STEM}, '') AS INT) BETWEEN 1990 AND {AS_OF} THEN try_cast({_STEM} AS INT) END AS stem_year,
  CASE WHEN {S.valid_id(r"regexp_extract(stem, '^([0-9]{4}[.][0-9]{4,5})(?:v[0-9]+)?\z', 1)", AS_OF)} THEN regexp_extract(stem, '^([0-9]{{4}}[.][0-9]{{4,5}})(?:v[0-9]+)?\z', 1) END AS stem_id
  FROM library_papers""")
def id_dates(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("arxiv_id")
    return papers(spark, d).select(
        "paper_id", C.valid_preprint_id(a, AS_OF).alias("valid"), C.invalid_preprint_id(a, AS_OF).alias("invalid"), C.preprint_year(a, AS_OF).alias("id_year"),
        C.year_from_stem(F.col("stem"), AS_OF).alias("stem_year"), C.id_from_stem(F.col("stem"), AS_OF).alias("stem_id"),
    )


@query(f"SELECT paper_id, {S.normalized_title('title')} AS norm, array_to_string({S.title_tokens('title')}, ' ') AS toks FROM library_papers")
def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return papers(spark, d).select("paper_id", C.normalized_title(t).alias("norm"), F.array_join(C.title_tokens(t), " ").alias("toks"))


@query(r"""SELECT scan_id, CASE WHEN length(t) >= 3 AND NOT regexp_matches(t, '^[0-9\s.\-]+$') THEN t END AS title FROM
  (SELECT scan_id, trim(regexp_replace(regexp_replace(stem, '^[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?[_\-]*', ''), '[_\-]+', ' ', 'g')) AS t FROM scan_records)""")
def stem_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_records").select("scan_id", C.title_from_stem(F.col("stem")).alias("title"))


@query(f"SELECT paper_id, array_to_string(names, '|') AS names, wrong FROM {S.cleaned_authors()}")
def clean_authors(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("authors")
    return wide_papers(spark, d).select("paper_id", F.array_join(people.clean_authors(a), "|").alias("names"), people.authors_look_wrong(a).alias("wrong"))


_OLD_NEW = f"""SELECT count(*) FILTER (p.arxiv_id IS DISTINCT FROM r.arxiv_id OR p.pub_year IS DISTINCT FROM r.pub_year OR p.pub_month IS DISTINCT FROM r.pub_month) AS n_dates FROM library_papers p JOIN ({_REPAIRED}) r USING (paper_id)"""


@query(f"""SELECT (SELECT n_dates FROM ({_OLD_NEW})) AS n_dates, (SELECT count(*) FROM library_papers p JOIN {S.cleaned_authors()} USING (paper_id) WHERE len(authors) > 0 AND (wrong OR names <> authors)) AS n_authors,
  (SELECT count(*) FROM {S.with_junk('library_papers')} WHERE len(junk) > 0) AS n_titles, (SELECT count(*) FROM library_papers WHERE pub_year > {AS_OF}) AS n_future""")
def cache_repairs(spark: SparkSession, d: str) -> DataFrame:
    """How many cached records a repair of dates, authors and titles changes, and how many years are still to come."""
    old = wide_papers(spark, d).withColumns({f"old_{c}": F.col(c) for c in ("arxiv_id", "pub_year", "pub_month")})
    new = clean.repaired_dates(clean.with_junk(old).withColumnRenamed("junk", "junk_title"), AS_OF)
    moved = ~(F.col("old_arxiv_id").eqNullSafe(F.col("arxiv_id")) & F.col("old_pub_year").eqNullSafe(F.col("pub_year")) & F.col("old_pub_month").eqNullSafe(F.col("pub_month")))
    a = F.col("authors")
    other = (F.size(a) > 0) & (people.authors_look_wrong(a) | (people.clean_authors(a) != a))
    return new.agg(
        F.count_if(moved).alias("n_dates"), F.count_if(other).alias("n_authors"), F.count_if(F.size("junk_title") > 0).alias("n_titles"), F.count_if(F.col("old_pub_year") > AS_OF).alias("n_future")
    )


def _sql_titles() -> str:
    one = lambda c: S.junk(c, "coalesce(stem, '')", "file")
    named = r"trim(regexp_replace(regexp_replace(stem, '^[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?[_\-]*', ''), '[_\-]+', ' ', 'g'))"
    return f"""(SELECT scan_id, CASE WHEN len({one('t0')}) = 0 THEN 'ok' WHEN given <> '' AND len({one('t1')}) = 0 THEN 'provider' WHEN named IS NOT NULL AND len({one('t2')}) = 0 THEN 'stem' ELSE 'still_junk' END AS method, title, given, named
      FROM (SELECT *, {S.bare_title('title')} AS t0, {S.bare_title('given')} AS t1, {S.bare_title('named')} AS t2 FROM (SELECT s.scan_id, s.title, s.stem, coalesce(s.title_source = 'stem', false) AS file, p.title AS given,
        CASE WHEN length({named.replace('stem', 's.stem')}) >= 3 AND NOT regexp_matches({named.replace('stem', 's.stem')}, '^[0-9\\s.\\-]+$') THEN {named.replace('stem', 's.stem')} END AS named
        FROM scan_records s LEFT JOIN library_papers p USING (paper_id))))"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scan_records").withColumn("title_is_filename", F.coalesce(F.col("title_source") == "stem", F.lit(False)))
    given = papers(spark, d).select("paper_id", F.col("title").alias("given"))
    return enrich.repaired_titles(s.join(given, "paper_id", "left"), [("provider", F.col("given")), ("stem", C.title_from_stem(F.col("stem")))])


@query(f"SELECT scan_id, method, CASE method WHEN 'provider' THEN given WHEN 'stem' THEN named ELSE title END AS title FROM {_sql_titles()} WHERE method <> 'ok'")
def repaired_titles(spark: SparkSession, d: str) -> DataFrame:
    """Junk titles replaced by the library's title of the same paper, else the file's name, unless those are junk too."""
    return _titles(spark, d).where("method <> 'ok'").select("scan_id", "method", F.col("new_title").alias("title"))


@query(f"SELECT method, count(*) AS n FROM {_sql_titles()} GROUP BY method")
def title_audit(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).groupBy("method").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT scan_id, substr(concat_ws(' ', title, ckey, stem), 1, 3000) AS text FROM scan_records), y AS (SELECT scan_id, unnest(regexp_extract_all(text, '(?:19|20)[0-9]{2}'))::INT AS yr,
  generate_subscripts(regexp_extract_all(text, '(?:19|20)[0-9]{2}'), 1) AS pos FROM t), n AS (SELECT scan_id, yr, count(*) AS n, min(pos) AS pos FROM y WHERE yr BETWEEN 1990 AND 2026 GROUP BY ALL)
  SELECT scan_id, yr AS year, n FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, pos) AS r FROM n) WHERE r = 1""")
def modal_year(spark: SparkSession, d: str) -> DataFrame:
    return stats.modal_year(table(spark, d, "scan_records"), "scan_id", F.concat_ws(" ", "title", "ckey", "stem"), AS_OF)


# --- duplicates --------------------------------------------------------------------------------------------------

def _components(src: str = "library_papers") -> str:
    return f"""WITH RECURSIVE k AS MATERIALIZED (SELECT paper_id, CASE WHEN {S.valid_id('arxiv_id', AS_OF)} THEN {S.stripped('arxiv_id')} END AS wid, {S.normalized_title('title')} AS norm, {S.title_tokens('title')} AS toks FROM {src}),
  clear AS (SELECT norm FROM k WHERE length(norm) > 10 GROUP BY norm HAVING count(DISTINCT wid) <= 1),
  e AS MATERIALIZED (SELECT a.paper_id AS a, b.paper_id AS b FROM k a JOIN k b ON a.wid = b.wid WHERE a.paper_id <> b.paper_id
    UNION SELECT a.paper_id, b.paper_id FROM k a JOIN k b ON a.norm = b.norm JOIN clear ON clear.norm = a.norm WHERE a.paper_id <> b.paper_id
    UNION SELECT a.paper_id, b.paper_id FROM k a JOIN k b ON a.paper_id <> b.paper_id AND len(a.toks) > 0 AND abs(len(a.toks) - len(b.toks)) <= 0.08 * greatest(len(a.toks), len(b.toks))
      AND len(list_intersect(a.toks, b.toks)) / greatest(len(a.toks), len(b.toks)) > 0.92 AND NOT coalesce(a.wid <> b.wid, false)),
  reach AS (SELECT paper_id AS a, paper_id AS b FROM k UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
  SELECT a AS paper_id, min(b) AS component FROM reach GROUP BY a"""


@query(_components())
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(papers(spark, d), AS_OF)


@query(f"SELECT count(*) AS n_groups, sum(n - 1)::BIGINT AS n_removable, max(n) AS largest FROM (SELECT component, count(*) AS n FROM ({_components()}) GROUP BY component HAVING count(*) > 1)")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    g = dedupe.duplicate_groups(papers(spark, d), AS_OF).groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("n_removable"), F.max("n").alias("largest"))


@query(f"""SELECT c.component, count(*) AS n, min(lower(trim(coalesce(title, ''), ' '))) AS title FROM ({_components()}) c JOIN library_papers USING (paper_id) GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, c.component LIMIT 20""")
def largest_duplicates(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    g = dedupe.duplicate_groups(p, AS_OF).join(p.select("paper_id", "title"), "paper_id").groupBy("component").agg(F.count("*").alias("n"), F.min(F.lower(F.trim(F.coalesce("title", F.lit(""))))).alias("title"))
    return g.where("n > 1").orderBy(F.desc("n"), "component").limit(20)


def _sql_kept(src: str) -> str:
    """The kept records in SQL; ``src`` is a table with ``junk``."""
    vid, stem_id = S.valid_id("arxiv_id", AS_OF), S.valid_id(_STEM_ID, AS_OF)
    own = f"coalesce({vid} AND (starts_with(coalesce(stem, ''), {S.stripped('arxiv_id')}) OR {stem_id} OR coalesce(pub_date_source IN ('pdf', 'arxiv_id', 'filename'), false)), false)"
    rank = "CASE WHEN coalesce(folder, '') = 'paper-HKU' OR starts_with(coalesce(rel_path, ''), 'paper-HKU/') THEN 0 WHEN starts_with(coalesce(folder, ''), 'paper-') THEN 1 ELSE 2 END"
    best = f"(length(coalesce(abstract, '')) > 50) DESC, length(coalesce(abstract, '')) DESC, {own} DESC, (len(junk) = 0) DESC, {rank}, length(coalesce(rel_path, '')), coalesce(epoch_us(mtime), 0) DESC, coalesce(size_bytes, 0) DESC, paper_id"
    return f"""(WITH p AS (SELECT x.*, c.component, {vid} AS vid FROM {src} x JOIN ({_components(src)}) c USING (paper_id)), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY {best}) AS r FROM p) WHERE r = 1),
      g AS (SELECT component, arg_min(abstract, paper_id) FILTER (coalesce(abstract, '') <> '') AS fa, arg_min(struct_pack(o := paper_id, i := arxiv_id, s := pub_date_source), paper_id) FILTER (vid) AS fi,
        arg_min(struct_pack(o := paper_id, y := pub_year, m := pub_month, s := pub_date_source), paper_id) FILTER (coalesce(pub_year, 0) <> 0) AS fy,
        bool_or(NOT coalesce(needs_review, false)) AS clear, count(*) AS n, count(DISTINCT rel_path) AS paths FROM p GROUP BY component),
      j AS (SELECT k.*, g.* EXCLUDE (component), NOT k.vid AND fi IS NOT NULL AS ni, coalesce(k.pub_year, 0) = 0 AND fy IS NOT NULL AS ny FROM k JOIN g USING (component))
      SELECT component, paper_id, title, CASE WHEN coalesce(abstract, '') <> '' THEN abstract ELSE fa END AS abstract, CASE WHEN ni THEN fi.i ELSE arxiv_id END AS arxiv_id, CASE WHEN ny THEN fy.y ELSE pub_year END AS pub_year,
        CASE WHEN ny THEN fy.m ELSE pub_month END AS pub_month, coalesce(CASE WHEN ni AND ny THEN CASE WHEN fi.o > fy.o THEN coalesce(fi.s, fy.s) ELSE coalesce(fy.s, fi.s) END WHEN ni THEN fi.s WHEN ny THEN fy.s END, pub_date_source) AS pub_date_source,
        coalesce(needs_review, false) AND NOT clear AS needs_review, n AS n_members, paths - CASE WHEN rel_path IS NOT NULL THEN 1 ELSE 0 END AS n_other_paths FROM j)"""


@query(f"WITH src AS MATERIALIZED (SELECT * FROM {S.with_junk('library_papers')}) SELECT * FROM {_sql_kept('src')}")
def kept_records(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return dedupe.kept_records(p, dedupe.duplicate_groups(p, AS_OF), AS_OF)


_UNPARSED = f"""(WITH every AS MATERIALIZED (SELECT * FROM {S.excluded('library_papers')}), src AS MATERIALIZED (SELECT * FROM every WHERE exclude_reason IS NULL), kept AS MATERIALIZED (SELECT * FROM {_sql_kept('src')})
  SELECT paper_id, exclude_reason AS reason FROM every WHERE exclude_reason IS NOT NULL UNION ALL SELECT paper_id, 'duplicate' FROM src WHERE paper_id NOT IN (SELECT paper_id FROM kept)
  UNION ALL SELECT paper_id, 'no_pub_date' FROM kept WHERE coalesce(pub_year, 0) = 0)"""


def _unparsed(spark: SparkSession, d: str) -> DataFrame:
    every = stored(clean.excluded(papers(spark, d)), "every_paper")
    p = every.where("exclude_reason is null").drop("junk")
    kept = stored(dedupe.kept_records(p, dedupe.duplicate_groups(p, AS_OF), AS_OF).select("paper_id", "pub_year"), "kept")
    rows = every.where("exclude_reason is not null").select("paper_id", F.col("exclude_reason").alias("reason"))
    rows = rows.unionByName(p.join(kept, "paper_id", "left_anti").select("paper_id", F.lit("duplicate").alias("reason")))
    return rows.unionByName(kept.where(F.coalesce("pub_year", F.lit(0)) == 0).select("paper_id", F.lit("no_pub_date").alias("reason")))


@query(f"SELECT * FROM {_UNPARSED}")
def unparsed(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, reason) of what the library doesn't show: what a rule excludes, then the duplicates of the rest, then
    the kept records without a year. A record has one reason, as each step works on what the one before has left."""
    return _unparsed(spark, d)


@query(f"SELECT reason, count(*) AS n FROM {_UNPARSED} WHERE reason <> 'duplicate' GROUP BY reason ORDER BY n DESC, reason LIMIT 4")
def unparsed_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The four most frequent reasons; duplicates stay hidden unless asked for."""
    return search.unparsed_reasons(_unparsed(spark, d))


@query(f"""SELECT paper_id, reason, row_number() OVER (ORDER BY mtime DESC NULLS LAST, coalesce(stem, ''), paper_id)::INT AS place FROM {_UNPARSED} JOIN library_papers USING (paper_id)
  WHERE reason <> 'duplicate' AND library = 'robotics' AND contains(lower(concat_ws(' ', stem, title, rel_path, file_path, folder, reason)), 'paper') ORDER BY place LIMIT 50""")
def unparsed_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of what isn't shown, filtered by library and text, newest first."""
    rows = _unparsed(spark, d).join(papers(spark, d), "paper_id")
    return search.unparsed_page(search.unparsed(rows, "paper", library="robotics"), 0, 50).select("paper_id", "reason", "place")


@query(f"""SELECT paper_id, row_number() OVER (ORDER BY mtime DESC, paper_id)::INT AS place FROM library_papers WHERE mtime > birthtime + INTERVAL 120 SECOND AND mtime >= TIMESTAMP '{AS_OF_TIME}' - INTERVAL 120 DAY AND library = 'driving'
  ORDER BY place LIMIT 50""")
def recent_reading(spark: SparkSession, d: str) -> DataFrame:
    """What was read of one library in the last days, the latest first."""
    p = papers(spark, d).where(stats.was_read(F.lit(AS_OF_TIME).cast("timestamp_ntz"), 120) & (F.col("library") == "driving"))
    return search.placed(p, [F.desc("mtime"), F.col("paper_id")], 0, 50).select("paper_id", "place")


@query(f"""SELECT url_key, item_id, d AS date_added, title, first_id, n FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY d DESC, length(coalesce(title, '')) DESC, item_id) AS r,
  min(item_id) OVER (PARTITION BY url_key) AS first_id, count(*) OVER (PARTITION BY url_key) AS n FROM (SELECT *, {S.url_key('url')} AS url_key, coalesce(date_added, 0) AS d FROM bookmarks WHERE url IS NOT NULL)) WHERE r = 1""")
def unique_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.unique_bookmarks(bookmarks(spark, d))


@query("""SELECT title_key, n, n_ids FROM (SELECT lower(trim(title, ' ')) AS title_key, count(*) AS n, count(DISTINCT nullif(arxiv_id, '')) AS n_ids FROM library_papers
  WHERE length(lower(trim(title, ' '))) > 10 GROUP BY 1) WHERE n > 1 AND n_ids > 1""")
def title_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return validate.title_conflicts(papers(spark, d))


# --- bookmarks ---------------------------------------------------------------------------------------------------

_CASE = " ".join(f"WHEN contains(lower(coalesce(url, '')), {S.q(p)}) THEN {S.q(s)}" for p, s in R.BOOKMARK_SOURCES)


@query(f"""SELECT item_id, CASE WHEN platform = 'zhihu' THEN 'Zhihu' {_CASE} ELSE 'Other' END AS source, substr(sha256({S.url_key('url')}), 1, 16) AS stable_id,
  coalesce(nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www[.]', ''), ''), 'unknown') AS domain FROM bookmarks""")
def bookmark_keys(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return bookmarks(spark, d).select("item_id", C.source_of(u, F.col("platform")).alias("source"), C.stable_id(u).alias("stable_id"), C.domain_of(u).alias("domain"))


@query(f"SELECT item_id, array_to_string(rt, '|') AS rule_tags FROM {S.bookmark_tags()}")
def bookmark_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagging.bookmark_rule_tags(spread(bookmarks(spark, d))).select("item_id", F.array_join("rule_tags", "|").alias("rule_tags"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM bookmarks) GROUP BY tag")
def bookmark_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return bookmarks(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT strftime(to_timestamp(date_added) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM bookmarks WHERE date_added > 0 GROUP BY 1")
def bookmarks_by_month(spark: SparkSession, d: str) -> DataFrame:
    return bookmarks(spark, d).where("date_added > 0").groupBy(stats.month_of(F.col("date_added")).alias("month")).agg(F.count("*").alias("n"))


_TM = "x AS (SELECT strftime(to_timestamp(date_added) AT TIME ZONE 'UTC', '%Y-%m') AS month, unnest(tags) AS tag FROM bookmarks WHERE date_added > 0), n AS (SELECT tag, month, count(*) AS n FROM x GROUP BY ALL)"


@query(f"""WITH {_TM}, top AS (SELECT tag FROM n GROUP BY tag ORDER BY sum(n) DESC, tag LIMIT 15)
  SELECT tag, month, coalesce(n, 0) AS n FROM (SELECT tag, month FROM top, (SELECT DISTINCT month FROM n)) LEFT JOIN n USING (tag, month)""")
def dense_tag_months(spark: SparkSession, d: str) -> DataFrame:
    return stats.dense_tag_months(bookmarks(spark, d))


@query("""SELECT item_id, date_added, title FROM bookmarks WHERE contains(lower(concat_ws(' ', title, url, url_domain, array_to_string(tags, ' '))), 'notes') AND list_has_any(tags, ['VLA', 'RL'])
  ORDER BY date_added DESC, title, item_id LIMIT 50""")
def bookmark_search(spark: SparkSession, d: str) -> DataFrame:
    hit = search.bookmark_matches("notes") & F.coalesce(F.arrays_overlap("tags", F.array(F.lit("VLA"), F.lit("RL"))), F.lit(False))
    return bookmarks(spark, d).where(hit).orderBy(F.desc_nulls_last("date_added"), F.asc_nulls_last("title"), "item_id").limit(50).select("item_id", "date_added", "title")


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM bookmarks WHERE contains(lower(concat_ws(' ', title, url, url_domain, array_to_string(tags, ' '))), 'notes')) GROUP BY tag""")
def bookmark_sidebar(spark: SparkSession, d: str) -> DataFrame:
    """Counts follow the search, not the tags chosen."""
    return bookmarks(spark, d).where(search.bookmark_matches("notes")).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT item_id, rt FROM {S.bookmark_tags()}), b AS (SELECT *, substr(sha256({S.url_key('url')}), 1, 16) AS k FROM bookmarks),
  c AS (SELECT k, arg_min(struct_pack(t := tags, v := CASE WHEN primary_tag IS NULL THEN 'old' ELSE 'now' END), item_id) AS c FROM b WHERE len(tags) > 0 AND platform = 'chrome' AND k IS NOT NULL GROUP BY k),
  m AS (SELECT k, arg_min(tags, item_id) AS t FROM b WHERE len(tags) > 0 AND platform = 'zhihu' AND k IS NOT NULL GROUP BY k)
  SELECT item_id, array_to_string(coalesce(m.t, CASE WHEN c.c.v = 'now' THEN c.c.t END, rt), '|') AS tags, CASE WHEN m.t IS NOT NULL THEN 'model' WHEN c.c.v = 'now' THEN 'cache' ELSE 'rule' END AS origin
  FROM b JOIN r USING (item_id) LEFT JOIN c USING (k) LEFT JOIN m USING (k)""")
def resolved_bookmark_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of a landed model answer, else of the cache if it is of this version, else by rule."""
    b = bookmarks(spark, d).withColumn("k", C.stable_id(F.col("url")))
    version = F.when(F.col("primary_tag").isNull(), "old").otherwise("now")
    known = lambda p: b.where((F.size("tags") > 0) & (F.col("platform") == p)).select("k", "tags", "item_id", version.alias("version"))
    got = tagging.resolved_tags(spread(b), known("chrome"), known("zhihu"), "k", "item_id", "now")
    return got.select("item_id", F.array_join("resolved", "|").alias("tags"), "origin")


# --- tags --------------------------------------------------------------------------------------------------------


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return tagging.rule_layers(wide_papers(spark, d))


_LONG = " UNION ALL ".join(f"SELECT paper_id, '{x}' AS layer, unnest({x}) AS tag FROM l" for x in R.LAYERS)


@query(f"WITH l AS MATERIALIZED (SELECT * FROM {S.layers()}) {_LONG}")
def rule_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagging.long_tags(_layers(spark, d)).select("paper_id", "layer", "tag")


@query(f"WITH l AS MATERIALIZED (SELECT * FROM {S.layers()}) SELECT layer, tag, count(*) AS n FROM ({_LONG}) GROUP BY ALL")
def layer_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return tagging.long_tags(_layers(spark, d)).groupBy("layer", "tag").agg(F.count("*").alias("n"))


@query(f"WITH l AS MATERIALIZED (SELECT * FROM {S.layers()}) " + " UNION ALL ".join(f"SELECT '{x}' AS layer, count(*) FILTER (len({x}) > 0) AS n, round(100.0 * count(*) FILTER (len({x}) > 0) / count(*), 1)::DOUBLE AS share FROM l" for x in R.LAYERS))
def layer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return validate.layer_coverage(_layers(spark, d))


def _canon(x: str) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN {S.q(a)} THEN {S.q(t)}" for a, t in R.TAG_ALIASES.items()) + f" ELSE {x} END"


_CATEGORY = "CASE coalesce(arxiv_cat, '') " + " ".join(f"WHEN {S.q(c)} THEN [{S.q(t)}]" for c, t in R.CATEGORY_TAGS.items()) + " ELSE []::VARCHAR[] END"


_TAGGED = f"""(WITH {_VOCAB}, tf AS (SELECT paper_id, term, count(*) AS tf, min(pos) AS pos FROM (SELECT paper_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM toks) GROUP BY ALL),
  sc AS (SELECT paper_id, term, pos, round((1 + ln(tf)) * idf, 9) AS score FROM tf JOIN vocab USING (term)),
  kw AS (SELECT paper_id, list(term ORDER BY r) AS kws FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS r FROM sc WHERE score > 0.8) WHERE r <= 3 GROUP BY paper_id),
  l AS (SELECT *, list_concat(topic, method, task, modality, folder_tags, category_tags) AS s, coalesce(kws, []) AS kws0 FROM (SELECT *, {_CATEGORY} AS category_tags FROM {S.layers()}) LEFT JOIN kw USING (paper_id)),
  k AS (SELECT *, list_filter(kws0, lambda x: NOT list_contains(list_transform(s, lambda t: lower({_canon('t')})), lower({_canon('x')}))) AS keyword FROM l),
  e AS (SELECT *, list_transform(list_concat(s, keyword), lambda t: {_canon('t')}) AS every FROM k)
  SELECT * EXCLUDE (topic), CASE WHEN len(every) = 0 THEN ['Uncategorized'] ELSE topic END AS topic,
    CASE WHEN len(every) = 0 THEN ['Uncategorized'] ELSE list_filter(every, lambda x, i: list_position(list_transform(every, lambda t: lower(t)), lower(x)) = i) END AS tags FROM e)"""


@query(f"SELECT paper_id, array_to_string(tags, '|') AS all_tags, array_to_string(keyword, '|') AS keyword FROM {_TAGGED}")
def all_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its tags of all layers, keywords included."""
    return tagging.tagged(wide_papers(spark, d)).select("paper_id", F.array_join("all_tags", "|").alias("all_tags"), F.array_join("keyword", "|").alias("keyword"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {_TAGGED}) GROUP BY tag ORDER BY n DESC, tag LIMIT 200")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most frequent tags of all layers."""
    return tagging.tag_counts(tagging.tagged(wide_papers(spark, d)))


@query(f"""WITH t AS MATERIALIZED (SELECT * FROM {_TAGGED}) SELECT count(*) AS total, count(*) FILTER (tags = ['Uncategorized']) AS uncategorized, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM t)) AS unique_tags FROM t""")
def tag_totals(spark: SparkSession, d: str) -> DataFrame:
    return tagging.tag_totals(tagging.tagged(wide_papers(spark, d)))


_EVERY_LAYER = " UNION ALL ".join(f"SELECT '{n}' AS layer, unnest({c}) AS tag FROM t" for n, c in tagging.ALL_LAYERS.items())


@query(f"WITH t AS MATERIALIZED (SELECT * FROM {_TAGGED}) SELECT layer, tag, count(*) AS n FROM ({_EVERY_LAYER}) GROUP BY ALL HAVING layer <> 'keyword' OR count(*) >= 10")
def all_layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags by layer, with the folder's, the category's and the frequent keywords."""
    return tagging.all_layer_counts(tagging.tagged(wide_papers(spark, d)))


_COVER = " UNION ALL ".join(f"SELECT 'has_{x}' AS metric, count(*) FILTER (len({x}) > 0) AS n, count(*) AS total FROM t" for x in (*R.LAYERS, "keyword"))


@query(f"""WITH t AS MATERIALIZED (SELECT * FROM {_TAGGED}) SELECT metric, n, round(100.0 * n / greatest(total, 1), 1)::DOUBLE AS share FROM ({_COVER}
  UNION ALL SELECT 'no_topic', count(*) FILTER (len(topic) = 0 OR topic = ['Uncategorized']), count(*) FROM t UNION ALL SELECT 'folder_in_topic', count(*) FILTER (list_has_any(folder_tags, topic)), count(*) FROM t)""")
def category_report(spark: SparkSession, d: str) -> DataFrame:
    """How many records have each layer, no topic, or a folder tag that repeats a topic; in percent of all besides."""
    return validate.category_report(tagging.tagged(wide_papers(spark, d)))


_PAIRS = f"""SELECT tag_a, tag_b, count(*) AS n FROM (SELECT a.t AS tag_a, b.t AS tag_b FROM
  (SELECT paper_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM ct) a JOIN (SELECT paper_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM ct) b ON a.paper_id = b.paper_id AND a.i <> b.i) GROUP BY ALL"""
_CT = f"ct AS MATERIALIZED (SELECT paper_id, list_concat(topic, method, task) AS ts FROM {S.layers()})"


@query(f"WITH {_CT} {_PAIRS}")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return tagging.cooccurrence(_layers(spark, d))


@query(f"""WITH {_CT}, p AS ({_PAIRS}), s AS (SELECT tag_a, sum(n)::BIGINT AS row_sum FROM p GROUP BY tag_a ORDER BY row_sum DESC, tag_a LIMIT 60)
  SELECT tag_a, tag_b, n, row_sum, rank FROM (SELECT p.*, row_sum, row_number() OVER (PARTITION BY tag_a ORDER BY n DESC, tag_b)::INT AS rank FROM p JOIN s USING (tag_a)) WHERE rank <= 20""")
def top_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return tagging.top_cooccurrence(tagging.cooccurrence(_layers(spark, d)))


@query(f"""WITH {_CT}, c AS (SELECT t, count(*) AS n FROM (SELECT unnest(ts) AS t FROM ct) GROUP BY t), top AS (SELECT t, n FROM c ORDER BY n DESC, t LIMIT 18), p AS ({_PAIRS})
  SELECT a.t AS tag_a, b.t AS tag_b, CASE WHEN a.t = b.t THEN a.n ELSE coalesce(p.n, 0) END AS n FROM top a CROSS JOIN top b LEFT JOIN p ON p.tag_a = a.t AND p.tag_b = b.t""")
def tag_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """The 18 most frequent tags against each other; on the diagonal their own counts."""
    lay = _layers(spark, d)
    top = lay.select(F.explode_outer(F.concat("topic", "method", "task")).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(18)
    rows = top.agg(F.collect_list(F.struct("t", "n")).alias("all"))  # 18 at most
    grid = rows.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).select(F.col("a.t").alias("tag_a"), F.col("b.t").alias("tag_b"), F.col("a.n").alias("own"))
    n = grid.join(tagging.cooccurrence(lay), ["tag_a", "tag_b"], "left")
    return n.select("tag_a", "tag_b", F.when(F.col("tag_a") == F.col("tag_b"), F.col("own")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


@query(f"""WITH l AS MATERIALIZED (SELECT * FROM {S.layers()}), x AS (SELECT unnest(topic) AS tag, pub_year FROM l WHERE pub_year IS NOT NULL) SELECT tag, pub_year, count(*) AS n FROM x GROUP BY ALL""")
def tag_years(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).where("pub_year is not null").select(F.explode_outer("topic").alias("tag"), "pub_year").where("tag is not null").groupBy("tag", "pub_year").agg(F.count("*").alias("n"))


# --- counts ------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT * FROM library_papers WHERE coalesce(pub_year, 0) <> 0)
  SELECT 'year' AS grp, '' AS library, pub_year::VARCHAR AS k, count(*) AS n FROM p GROUP BY ALL
  UNION ALL SELECT 'month', '', {S.month_key()}, count(*) FROM p GROUP BY ALL
  UNION ALL SELECT 'library_year', coalesce(library, ''), pub_year::VARCHAR, count(*) FROM p GROUP BY ALL
  UNION ALL SELECT 'source', '', coalesce(pub_date_source, 'unknown'), count(*) FROM p GROUP BY ALL""")
def publication_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.publication_stats(papers(spark, d))


@query("""SELECT count(*) AS n, count(*) FILTER (coalesce(pub_year, 0) <> 0) AS with_year, min(nullif(pub_year, 0)) AS min_year, max(pub_year) AS max_year,
  round(100.0 * count(*) FILTER (coalesce(pub_year, 0) <> 0) / count(*), 1)::DOUBLE AS coverage FROM library_papers""")
def date_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(papers(spark, d))


@query(f"""WITH l AS (SELECT *, coalesce(pub_year, year(birthtime)) AS y FROM {S.layers()}) SELECT y::VARCHAR || '-Q' || (ceil(coalesce(pub_month, 1) / 3.0)::INT)::VARCHAR AS quarter, topic, count(*) AS n
  FROM (SELECT y, pub_month, unnest(topic) AS topic FROM l WHERE y IS NOT NULL) GROUP BY ALL""")
def evolution(spark: SparkSession, d: str) -> DataFrame:
    return stats.evolution(_layers(spark, d))


@query(f"""SELECT count(*) FILTER (r AND mtime >= TIMESTAMP '{AS_OF_TIME}' - INTERVAL 7 DAY) AS week, count(*) FILTER (r AND mtime >= TIMESTAMP '{AS_OF_TIME}' - INTERVAL 30 DAY) AS month, count(*) FILTER (r) AS ever
  FROM (SELECT *, mtime > birthtime + INTERVAL 120 SECOND AS r FROM library_papers)""")
def reading_stats(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(AS_OF_TIME).cast("timestamp_ntz")
    week, month, ever = stats.was_read(now, 7), stats.was_read(now, 30), stats.was_read(now)
    return papers(spark, d).agg(F.count_if(week).alias("week"), F.count_if(month).alias("month"), F.count_if(ever).alias("ever"))


@query("""SELECT coalesce(library, '') AS library, count(*) AS total, count(*) FILTER (coalesce(needs_review, false)) AS n_review, count(*) FILTER (coalesce(pub_year, 0) <> 0) AS with_date, '2026-09-01' AS day FROM library_papers GROUP BY ALL""")
def library_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return stats.snapshot(papers(spark, d), "2026-09-01")


@query("""WITH old AS (SELECT strftime(scanned_at, '%Y-%m-%d') AS day, count(*) AS n FROM scan_records GROUP BY ALL), new AS (SELECT strftime(landed_at, '%Y-%m-%d') AS day, count(*) AS n FROM scan_records GROUP BY ALL)
  SELECT day, n FROM old WHERE day IS NOT NULL AND day NOT IN (SELECT day FROM new WHERE day IS NOT NULL) UNION ALL SELECT day, n FROM new WHERE day IS NOT NULL""")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day of the scan, replaced on the days on which something landed."""
    s = table(spark, d, "scan_records")
    by = lambda c: s.where(F.col(c).isNotNull()).groupBy(F.date_format(c, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return incremental.upserted(by("scanned_at"), by("landed_at"), "day")


_PATH = r"regexp_extract(ckey, '^(.*)\|[^|]*\|[^|]*$', 1)"


@query(f"""WITH x AS (SELECT DISTINCT ckey, {_PATH} AS path FROM scan_records), c AS (SELECT DISTINCT ckey, {_PATH} AS path FROM library_papers)
  SELECT CASE WHEN ckey IN (SELECT ckey FROM c WHERE ckey IS NOT NULL) THEN 'unchanged' WHEN path IN (SELECT path FROM c WHERE path IS NOT NULL) THEN 'updated' ELSE 'new' END AS status, count(*) AS n FROM x GROUP BY ALL""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(table(spark, d, "scan_records"), papers(spark, d))


@query("""WITH c AS (SELECT ckey, arg_max(title, cached_at) AS t, arg_max(pub_year, cached_at) AS y FROM library_papers GROUP BY ckey)
  SELECT scan_id, coalesce(t, title) AS title, coalesce(y, pub_year) AS pub_year FROM scan_records LEFT JOIN c USING (ckey)""")
def refreshed_scans(spark: SparkSession, d: str) -> DataFrame:
    return incremental.refreshed(table(spark, d, "scan_records"), papers(spark, d), ["title", "pub_year"]).select("scan_id", "title", "pub_year")


@query("""WITH r AS (SELECT paper_id, arg_min(struct_pack(c := arxiv_cat, y := pub_year), (coalesce(title, ''), scan_id)) AS s FROM scan_records WHERE paper_id IS NOT NULL GROUP BY paper_id)
  SELECT paper_id, coalesce(arxiv_cat, s.c) AS arxiv_cat, coalesce(pub_year, s.y) AS pub_year FROM library_papers LEFT JOIN r USING (paper_id)""")
def enriched_papers(spark: SparkSession, d: str) -> DataFrame:
    """Category and year filled from what was scanned of the same paper."""
    s = table(spark, d, "scan_records")
    one = s.where("paper_id is not null").groupBy("paper_id").agg(F.min_by(F.struct("title", "arxiv_cat", "pub_year"), F.struct(F.coalesce("title", F.lit("")), "scan_id")).alias("r")).select("paper_id", "r.*")
    return enrich.enriched(papers(spark, d), [(one, "paper_id", 0)], ["arxiv_cat", "pub_year"]).select("paper_id", "arxiv_cat", "pub_year")


@query("SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


# --- search ------------------------------------------------------------------------------------------------------


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    """The papers with their tags, written once: a search looks at each tag many times. No table of summaries is given,
    so the beginning of the introduction stands for a paper's summary."""
    p = _layers(spark, d).withColumn("tags", F.array_distinct(F.concat("topic", "method", "task")))
    return stored(p.select("paper_id", "library", "folder", "title", "authors", "abstract", "pub_year", F.substring("intro_excerpt", 1, 120).alias("summary"), "tags"), "searchable")


_FIELDS = """lower(coalesce(title, '')) AS f1, lower(array_to_string(coalesce(authors, []), ', ')) AS f2, lower(coalesce(substr(abstract, 1, 400), '')) AS f3, lower(coalesce(substr(intro_excerpt, 1, 120), '')) AS f4"""


def _sql_search(q: str, where: str = "true") -> str:
    """The ranked search in SQL."""
    conds, score = [], f"CASE WHEN contains(f1, {S.q(q.strip().lower())}) THEN 100 ELSE 0 END"
    for t in search.terms(q):
        near = f"len(list_filter(string_split_regex(hay, '[\\s,;·、]+'), lambda w: length(w) BETWEEN {len(t) - 1} AND {len(t) + 2} AND levenshtein({S.q(t)}, w) <= 1)) > 0"
        conds.append(f"(contains(hay, {S.q(t)})" + (f" OR {near})" if len(t) >= 4 else ")"))
        for f, w in zip(("f1", "f2", "f3", "f4", "f5"), (50, 40, 20, 5, 3)):
            score += f" + CASE WHEN contains({f}, {S.q(t)}) THEN {w} ELSE 0 END"
    return f"""SELECT *, {score} AS score FROM (SELECT *, concat_ws(' ', f1, f2, f3, f4, f5) AS hay FROM (SELECT *, lower(array_to_string(tags, ' ')) AS f5 FROM
      (SELECT *, list_filter(list_concat(topic, method, task), lambda x, i: list_position(list_concat(topic, method, task), x) = i) AS tags, {_FIELDS} FROM {S.layers()}))) WHERE {' AND '.join([*conds, where])}"""


@query(f"SELECT paper_id, score FROM ({_sql_search('tactile encoders')})")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_searchable(spark, d), "tactile encoders").select("paper_id", "score")


@query(f"SELECT paper_id, score FROM ({_sql_search('tactle encodrs grasp')})")
def search_with_typos(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_searchable(spark, d), "tactle encodrs grasp").select("paper_id", "score")


@query(f"SELECT paper_id, score, row_number() OVER (ORDER BY score DESC, coalesce(pub_year, 0) DESC, paper_id)::INT AS place FROM ({_sql_search('lidar segmentation')}) ORDER BY place LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(_searchable(spark, d), "lidar segmentation")
    p = search.page(found, "lidar segmentation", "relevance", 20, 20).select("paper_id", "score", "pub_year")
    w = Window.orderBy(F.desc("score"), F.coalesce("pub_year", F.lit(0)).desc(), "paper_id")  # a page of 20 rows
    return p.select("paper_id", "score", (F.row_number().over(w) + 20).alias("place"))


def _sql_facet(cond: str) -> str:
    return f"SELECT paper_id FROM (SELECT paper_id, library, list_concat(topic, method, task) AS tags FROM {S.layers()}) WHERE {cond}"


@query(_sql_facet("list_contains(tags, 'Tracking') AND list_contains(tags, 'Segmentation')"))
def facet_and(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_searchable(spark, d), tags=["Tracking", "Segmentation"], mode="and").select("paper_id")


@query(_sql_facet("list_has_any(tags, ['Tracking', 'Segmentation'])"))
def facet_or(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_searchable(spark, d), tags=["Tracking", "Segmentation"], mode="or").select("paper_id")


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ({_sql_search('robot')})) GROUP BY tag ORDER BY n DESC, tag LIMIT 35")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.facet_counts(search.search(_searchable(spark, d), "robot"))


# --- quality -----------------------------------------------------------------------------------------------------


@query(f"SELECT paper_id, confidence, len(types) AS n_issues FROM {S.validated(AS_OF)}")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return validate.validated(_layers(spark, d), AS_OF).select("paper_id", "confidence", F.size("issues").alias("n_issues"))


@query(f"SELECT type, count(*) AS n FROM (SELECT unnest(types) AS type FROM {S.validated(AS_OF)}) GROUP BY type")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.validated(_layers(spark, d), AS_OF).select(F.explode_outer(F.transform("issues", lambda i: i.type)).alias("type")).where("type is not null").groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT paper_id, confidence, len(types) AS n_issues FROM {S.validated(AS_OF)} ORDER BY confidence, n_issues DESC, paper_id LIMIT 50")
def review_list(spark: SparkSession, d: str) -> DataFrame:
    v = validate.validated(_layers(spark, d), AS_OF).select("paper_id", "confidence", F.size("issues").alias("n_issues"))
    return v.orderBy("confidence", F.desc("n_issues"), "paper_id").limit(50)


@query(f"SELECT paper_id FROM {S.validated(AS_OF)} WHERE confidence < 0.55 OR list_has_any(types, {S.lst(validate.NEEDS_LOOKUP)})")
def lookup_list(spark: SparkSession, d: str) -> DataFrame:
    return validate.validated(_layers(spark, d), AS_OF).where(validate.needs_lookup()).select("paper_id")


@query(f"SELECT coalesce(library, '') AS library, count(*) AS n, round(avg(confidence), 3) AS mean_confidence FROM {S.validated(AS_OF)} GROUP BY 1")
def library_quality(spark: SparkSession, d: str) -> DataFrame:
    v = validate.validated(_layers(spark, d), AS_OF)
    return v.groupBy(F.coalesce("library", F.lit("")).alias("library")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@query(f"SELECT layer, tag, count(*) AS n FROM (SELECT unnest(doubts) AS u FROM {S.doubtful()}) , LATERAL (SELECT split_part(u, ':', 1) AS layer, split_part(u, ':', 2) AS tag) GROUP BY ALL ORDER BY n DESC, layer, tag LIMIT 20")
def suspicious_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags that most often stand on records without one of their words."""
    return validate.suspicious_tags(validate.validated(_layers(spark, d), AS_OF))


@query(f"SELECT folder, count(*) AS n FROM (SELECT folder, unnest(types) AS t FROM {S.validated(AS_OF)}) WHERE t IN ('folder_topic_mismatch', 'folder_content_mismatch') GROUP BY folder ORDER BY n DESC, folder LIMIT 20")
def folder_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return validate.folder_mismatches(validate.validated(_layers(spark, d), AS_OF))


_LOUD = ("title_is_filename", "junk_title", "missing_abstract", "missing_pub_year", "implausible_pub_year", "implausible_pub_month", "invalid_arxiv_id", "suspicious_tag", "contradictory_tag", "folder_topic_mismatch")


@query(f"""WITH c AS (SELECT lower(trim(title, ' ')) AS k FROM library_papers WHERE length(lower(trim(title, ' '))) > 10 GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT nullif(arxiv_id, '')) > 1)
  SELECT paper_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(types, lambda x: list_contains({S.lst(_LOUD)}, x)), CASE WHEN lower(trim(title, ' ')) IN (SELECT k FROM c) THEN ['duplicate_title_conflict'] ELSE []::VARCHAR[] END))), '|') AS flags
  FROM {S.validated(AS_OF)} JOIN library_papers USING (paper_id)""")
def validation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each record's kinds of errors and warnings, the conflicts of its title included."""
    v = validate.with_title_conflicts(validate.validated(_layers(spark, d), AS_OF))
    return v.select("paper_id", F.array_join(validate.flags(), "|").alias("flags"))


@query(f"SELECT paper_id, row_number() OVER (ORDER BY confidence, paper_id)::INT AS place FROM {S.validated(AS_OF)} WHERE confidence < 0.55 OR list_has_any(types, {S.lst(validate.NEEDS_LOOKUP)}) ORDER BY place LIMIT 100")
def lookup_page(spark: SparkSession, d: str) -> DataFrame:
    """The hundred least trusted records that need a lookup."""
    v = validate.validated(_layers(spark, d), AS_OF).where(validate.needs_lookup())
    return search.placed(v, [F.col("confidence"), F.col("paper_id")], 0, 100).select("paper_id", "place")


_HITS = ", ".join(f"CASE WHEN NOT list_contains(mine, {S.q(t)}) AND len(list_intersect({S.lst(R.tag_words(x, t))}, otoks)) >= 2 THEN {S.q(t)} END" for x in R.LAYERS for t in R.TAXONOMY[x])


@query(f"""WITH o AS (SELECT paper_id, arg_min(title, (coalesce(title, ''), scan_id)) AS otitle FROM scan_records WHERE paper_id IS NOT NULL GROUP BY paper_id),
  l AS (SELECT paper_id, coalesce(nullif(title, ''), stem) AS own, list_concat(topic, method, task, modality) AS mine FROM {S.layers()}),
  j AS (SELECT l.*, otitle, list_distinct({S.tokens('otitle')}) AS otoks, {S.title_tokens('own')} AS ta, {S.title_tokens('otitle')} AS tb FROM l LEFT JOIN o USING (paper_id)),
  s AS (SELECT *, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN round(len(list_intersect(ta, tb)) / greatest(len(ta), len(tb)), 3) ELSE 0.0 END::DOUBLE AS sim, list_filter([{_HITS}], lambda x: x IS NOT NULL)[1:5] AS tips FROM j)
  SELECT paper_id, CASE WHEN otitle IS NULL THEN 'not_found' WHEN sim < 0.7 THEN 'mismatch' ELSE 'verified' END AS status, CASE WHEN otitle IS NOT NULL THEN sim END AS similarity, CASE WHEN otitle IS NOT NULL THEN array_to_string(tips, '|') END AS suggestions FROM s""")
def verified_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every record against the landed response of its paper: agreement of the titles, and tags that the response suggests."""
    s = table(spark, d, "scan_records").where("paper_id is not null")
    one = s.groupBy("paper_id").agg(F.min_by("title", F.struct(F.coalesce("title", F.lit("")), "scan_id")).alias("online_title"))
    lay = _layers(spark, d).join(one, "paper_id", "left")
    v = validate.against_response(lay.withColumn("mine", F.concat(*R.LAYERS)), F.col("online_title"), F.col("online_title"))
    return v.select("paper_id", "status", "similarity", F.array_join("suggestions", "|").alias("suggestions"))


@query("SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS id, length(substr(abstract, 1, 400)) AS shown, folder FROM library_papers")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a page gets: a dense number for each record, the shown part of its abstract."""
    p = library.numbered(library.published(papers(spark, d), True), "paper_id")
    return p.select("paper_id", "id", F.length("abstract").alias("shown"), "folder")


# --- similarity and summaries ------------------------------------------------------------------------------------

_G = S.tokens("concat_ws(' ', coalesce(title, ''), coalesce(title, ''), coalesce(abstract, ''))", False)


@query(f"""WITH n AS (SELECT count(*) AS n FROM library_papers), t AS MATERIALIZED (SELECT paper_id, folder, pub_year, list_concat(topic, method, task) AS tags, {_G} AS ts FROM {S.layers()}),
  df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM t) GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.65 * (SELECT n FROM n)),
  raw AS MATERIALIZED (SELECT paper_id, term, (1 + ln(count(*))) * ln(((SELECT n FROM n) + 1.0) / (any_value(df) + 1.0)) AS raw FROM (SELECT paper_id, unnest(ts) AS term FROM t) JOIN df USING (term) GROUP BY ALL),
  w AS MATERIALIZED (SELECT paper_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY paper_id)) AS w FROM raw),
  c AS (SELECT a.paper_id AS src, b.paper_id AS dst, count(*) AS shared, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (term) WHERE a.paper_id % 20 = 0 AND a.paper_id <> b.paper_id GROUP BY ALL),
  c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY shared DESC, dst) AS r FROM c) WHERE r <= 300),
  s AS (SELECT src, dst, round(dot + CASE WHEN list_has_any(a.tags, b.tags) THEN 0.08 ELSE 0 END + CASE WHEN a.folder IS NOT DISTINCT FROM b.folder THEN 0.04 ELSE 0 END
    + coalesce(greatest(0, 0.04 - 0.01 * abs(a.pub_year - b.pub_year)), 0), 4) AS score FROM c2 JOIN t a ON a.paper_id = src JOIN t b ON b.paper_id = dst)
  SELECT src, round(sum(score), 2) AS total, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s) WHERE rank <= 15 GROUP BY src""")
def similar_papers(spark: SparkSession, d: str) -> DataFrame:
    """For every query paper (id divisible by 20) its neighbours among all papers: how many, and their total score."""
    p = _searchable(spark, d)
    t = p.select("paper_id", "folder", "pub_year", "tags", C.tokens(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "title", "abstract")]), False).alias("toks"))
    n = p.count()
    g = graph.neighbours(t, "paper_id", "toks", n, F.col("paper_id") % 20 == 0, bonus=graph.paper_bonus())
    return g.groupBy("src").agg(F.round(F.sum("score"), 2).alias("total"), F.count("*").alias("n"))


@query()
def rule_summaries(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", summary.rule_summary(F.col("title"), F.col("abstract")).alias("summary"))


@query()
def summary_policy(spark: SparkSession, d: str) -> DataFrame:
    """(decision, n): which records need a written summary, and why."""
    v = validate.validated(_layers(spark, d), AS_OF).withColumn("s", summary.rule_summary(F.col("title"), F.col("abstract")))
    dec = summary.policy(F.col("needs_review"), F.size("issues") > 0, F.col("pub_year"), F.col("title"), F.col("s"), F.col("topic"), F.col("task"), F.col("abstract"))
    return v.groupBy(dec.alias("decision")).agg(F.count("*").alias("n"))


@query("""SELECT paper_id, substr(sha256(concat_ws('|', 'v1', 'rules', coalesce(title, ''), CASE WHEN coalesce(pub_year BETWEEN 2025 AND 2026, false)
  THEN concat_ws('|', coalesce(abstract, ''), coalesce(intro_excerpt, '')) ELSE substr(coalesce(abstract, ''), 1, 300) END, coalesce(folder, ''))), 1, 16) AS h FROM library_papers""")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    full = F.coalesce(F.col("pub_year").between(*summary.FULL_YEARS), F.lit(False))
    return papers(spark, d).select("paper_id", C.content_hash("v1", "rules", F.col("title"), F.col("abstract"), F.col("intro_excerpt"), F.col("folder"), full).alias("h"))


@query("SELECT paper_id FROM library_papers ORDER BY md5(concat_ws(':', '42', paper_id::VARCHAR)), paper_id LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred records that any run and any engine picks alike."""
    return papers(spark, d).select("paper_id").orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("paper_id").cast("string"))), "paper_id").limit(100)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
