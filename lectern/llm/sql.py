"""The queries of this package that another engine can say in SQL, written apart from the operators.

The SQL knows the compatibility characters that the tables hold, no others; case folding is lower-casing.
"""

from __future__ import annotations

from ..plans.sql import nfkc

_KEY = rf"regexp_replace(lower({nfkc('title')}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_ID = r"(?i)^[\s\p{Z}]*(?:arxiv:[\s\p{Z}]*|abs/)?([0-9]{4}\.[0-9]{4,5})(?:v([0-9]+))?[\s\p{Z}]*$"

#: Records with ``wid`` (the well-formed id), ``version`` and ``tkey`` (the title key); null where they tie nothing.
_RECORDS = rf"""rec AS MATERIALIZED (SELECT *, CASE WHEN length({_KEY}) >= 12 THEN {_KEY} END AS tkey,
  CASE WHEN id0 <> '' AND substr(id0, 3, 2) BETWEEN '01' AND '12' AND NOT regexp_matches(substr(id0, 6), '^0+$') AND (substr(id0, 1, 2) >= '91' OR substr(id0, 1, 4) BETWEEN '0704' AND '2612') THEN id0 END AS wid
  FROM (SELECT *, coalesce(regexp_extract(arxiv_id, '{_ID}', 1), '') AS id0, coalesce(try_cast(nullif(regexp_extract(arxiv_id, '{_ID}', 2), '') AS BIGINT), 0) AS version FROM library_papers))"""
_GROUPS = f"""{_RECORDS}, link AS MATERIALIZED (SELECT paper_id AS a, min(paper_id) OVER (PARTITION BY wid) AS b FROM rec WHERE wid IS NOT NULL UNION SELECT paper_id, min(paper_id) OVER (PARTITION BY tkey) FROM rec WHERE tkey IS NOT NULL),
  e AS MATERIALIZED (SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b), reach AS (SELECT a AS s, a AS t FROM e UNION SELECT r.s, e.b FROM reach r JOIN e ON r.t = e.a),
  grp AS MATERIALIZED (SELECT s AS paper_id, min(t) AS group_id FROM reach GROUP BY s)"""

P6_FOUND = f"WITH RECURSIVE {_GROUPS} SELECT group_id, paper_id FROM grp"

_SHOWN = r"trim(regexp_replace(abstract, '[\s\p{Z}]+', ' ', 'g'))"
_BEST = {
    "abstract": (f"{_SHOWN} <> ''", f"length({_SHOWN}) DESC"),
    "pub_year": ("pub_year BETWEEN 1990 AND 2026", "coalesce(trust_rank, 2147483647), mtime DESC NULLS LAST"),
    "rel_path": ("rel_path IS NOT NULL", "mtime DESC NULLS LAST"),
    "arxiv_id": ("wid IS NOT NULL", "version DESC"),
}
P1_FOUND = f"WITH RECURSIVE {_GROUPS}, r AS MATERIALIZED (SELECT * FROM rec JOIN grp USING (paper_id) LEFT JOIN date_sources USING (pub_date_source)) " + " UNION ALL ".join(
    f"SELECT group_id, '{f}' AS field_name, paper_id FROM (SELECT group_id, paper_id, row_number() OVER (PARTITION BY group_id ORDER BY {o}, paper_id) AS n FROM r WHERE {c}) WHERE n = 1" for f, (c, o) in _BEST.items()
)

_DECODED = r"lower(CASE WHEN contains({0}, '%') THEN url_decode(regexp_replace({0}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|$)', '%25\1', 'g')) ELSE {0} END)"
_HOST = r"lower(regexp_extract(rest, '^//([^/?]*)', 1))"
_PARAMS = f"list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {_DECODED.format('x')}))"
_URLS = rf"""url AS (SELECT item_id, scheme || chr(31) || {_DECODED.format('host')} || chr(31) || regexp_replace({_DECODED.format('path')}, '/+$', '') || chr(31) || array_to_string({_PARAMS}, chr(31)) AS canon FROM
  (SELECT *, CASE WHEN host <> '' THEN host ELSE '' END, regexp_extract(tail, '(?s)^([^?]*)', 1) AS path, regexp_extract(tail, '(?s)^[^?]*\?(.*)$', 1) AS query FROM
    (SELECT *, CASE WHEN (scheme = 'http' AND ends_with({_HOST}, ':80')) OR (scheme = 'https' AND ends_with({_HOST}, ':443')) OR (scheme = 'ftp' AND ends_with({_HOST}, ':21')) THEN regexp_replace({_HOST}, ':[0-9]+$', '') ELSE {_HOST} END AS host,
      regexp_replace(rest, '^//[^/?]*', '') AS tail FROM
      (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS rest FROM
        (SELECT item_id, regexp_replace(regexp_replace(url, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'), '(?s)#.*$', '') AS u FROM bookmarks) WHERE u <> ''))))"""
_ENTRIES = f"{_RECORDS}, {_URLS}, entry AS MATERIALIZED (SELECT 'library_papers' AS tbl, paper_id AS id, tkey AS canon FROM rec WHERE tkey IS NOT NULL UNION ALL SELECT 'bookmarks', item_id, canon FROM url)"
P2_COUNTS = f"WITH {_ENTRIES} SELECT tbl, min(id) AS first_id, count(*) AS n_copies FROM entry GROUP BY tbl, canon"
P2_FOUND = f"WITH {_ENTRIES} SELECT tbl, first_id, id AS copy_id FROM (SELECT *, min(id) OVER (PARTITION BY tbl, canon) AS first_id FROM entry) WHERE id <> first_id"

_TERM = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
_TERMS = rf"""t AS MATERIALIZED (SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(regexp_extract_all(lower({nfkc("concat_ws(' ', title, abstract)")}), '{_TERM}')) AS term FROM library_papers)
  WHERE length(term) > 2 AND NOT regexp_matches(term, '^\p{{Nd}}+$') GROUP BY ALL), s AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS cf FROM t GROUP BY term),
  d AS MATERIALIZED (SELECT paper_id, sum(tf)::DOUBLE AS dl FROM t GROUP BY paper_id), n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avg_dl FROM d)"""
P4_FOUND = f"WITH {_TERMS} SELECT paper_id, term FROM t JOIN s USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 12"
P4_SCORES = f"""WITH {_TERMS}, x AS (SELECT paper_id, term, tf, df, cf / n AS lam, tf * log2(1 + avg_dl / dl) AS tfn FROM t JOIN s USING (term) JOIN d USING (paper_id), n)
  SELECT paper_id, term, tf::INT AS tf, df, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 9) AS score FROM x"""

SQL = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_counts": P2_COUNTS, "p4_found": P4_FOUND, "p4_scores": P4_SCORES, "p6_found": P6_FOUND}
