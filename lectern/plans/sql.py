"""Pieces of SQL that say again, for another engine, what the column functions say."""

from __future__ import annotations

from ..functions import rules as R
from ..operators import people as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


TEXT = "lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')))"


def tokens(text: str, hyphens: bool = True) -> str:
    stop = sorted(R.STOP_WORDS if hyphens else R.GRAPH_STOP_WORDS)
    keep = r"[^\p{L}\p{N}_\s\-]" if hyphens else r"[^\p{L}\p{N}_\s]"
    t = f"regexp_replace(replace(replace(lower(coalesce({text}, '')), 'ﬁ', 'fi'), 'ﬂ', 'fl'), {q(keep)}, ' ', 'g')"
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda x: length(x) > 2 and not list_contains({lst(stop)}, x) and not regexp_matches(x, '^\p{{Nd}}+$'))"


def has(layer: str, tag: str, text: str = "txt") -> str:
    return f"regexp_matches({text}, {q(R.any_of(R.TAXONOMY[layer][tag]))})"


def layer(name: str, text: str = "txt") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(name, t, text)} THEN {q(t)} END" for t in R.TAXONOMY[name]) + "], lambda x: x IS NOT NULL)"


def layers() -> str:
    """A subquery: every paper with its rule layers and folder tags."""
    folder = " ".join(f"WHEN {q(f)} THEN {lst(t)}" for f, t in R.FOLDER_TAGS.items())
    cols = ", ".join(f"{layer(x)} AS {x}" for x in R.LAYERS)
    return f"""(SELECT *, list_filter(CASE folder {folder} ELSE []::VARCHAR[] END, lambda x: NOT list_contains(topic, x)) AS folder_tags
        FROM (SELECT *, {cols} FROM (SELECT *, {TEXT} AS txt FROM library_papers)))"""


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+\z', '', 'g')"


def valid_id(c: str, as_of: int) -> str:
    s = stripped(c)
    num = rf"regexp_extract({s}, '^[0-9]{{4}}\.([0-9]{{4,5}})(?:v[0-9]+)?\z', 1)"
    yy, mm = f"try_cast(substr({s}, 1, 2) AS INT)", f"try_cast(substr({s}, 3, 2) AS INT)"
    year = f"(CASE WHEN {yy} >= 91 THEN 1900 ELSE 2000 END + {yy})"
    return f"coalesce({num} <> '' AND {mm} BETWEEN 1 AND 12 AND {num} <> '00000' AND substr({s}, 1, 4) <> '0001' AND {year} BETWEEN 1991 AND {as_of} AND NOT (substr({s}, 1, 4) < '0704' AND {year} >= 2000), false)"


def normalized_title(c: str) -> str:
    t = rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '\s*v[0-9]+\s*\z', ''), '\s+', ' ', 'g'))"


def title_tokens(c: str) -> str:
    return rf"list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')), lambda x: NOT list_contains({lst(R.TITLE_STOP_WORDS)}, x)))"


def url_key(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({c}, '/+\z', ''), '#.*', ''))"


def month_key() -> str:
    return "CASE WHEN pub_month IS NOT NULL THEN pub_year::VARCHAR || '-' || lpad(pub_month::VARCHAR, 2, '0') ELSE pub_year::VARCHAR END"


def issues(as_of: int) -> list[tuple[str, str, str]]:
    """(condition, type, severity) over the layers with ``toks``."""
    out = [("coalesce(title_is_filename, false) AND coalesce(abstract, '') = ''", "title_is_filename", "warning")]
    out += [(f"regexp_matches(coalesce(title, ''), {q(R.portable(p))})", "junk_title", "warning") for _, p in R.VALIDATOR_JUNK]
    out += [
        ("coalesce(abstract, '') = ''", "missing_abstract", "warning"), ("coalesce(abstract, '') <> '' AND length(abstract) < 80", "short_abstract", "info"),
        ("pub_year IS NULL", "missing_pub_year", "warning"), (f"pub_year IS NOT NULL AND pub_year NOT BETWEEN 1990 AND {as_of}", "implausible_pub_year", "warning"),
        ("pub_month IS NOT NULL AND pub_month NOT BETWEEN 1 AND 12", "implausible_pub_month", "warning"),
        (f"coalesce(arxiv_id <> '', false) AND NOT {valid_id('arxiv_id', as_of)}", "invalid_arxiv_id", "error"),
    ]
    some = "len(toks) > 0"
    for name in R.LAYERS:
        for tag in R.TAXONOMY[name]:
            out.append((f"{some} AND list_contains({name}, {q(tag)}) AND NOT list_has_any({lst(R.tag_words(name, tag))}, toks)", "suspicious_tag", "warning"))
    any_topic = " OR ".join(f"len(list_intersect({lst(R.tag_words('topic', t))}, toks)) >= 2" for t in R.TAXONOMY["topic"])
    out.append((f"{some} AND len(topic) = 0 AND ({any_topic})", "missing_topic", "info"))
    for tag, names, words in R.CONTRADICTIONS:
        out += [(f"{some} AND list_contains({n}, {q(tag)}) AND NOT list_has_any({lst(words.split())}, toks)", "contradictory_tag", "warning") for n in names]
    for folder, (topics, words) in R.FOLDER_HINTS.items():
        here = f"coalesce(folder = {q(folder)}, false)"
        if topics:
            out.append((f"{here} AND NOT list_has_any(list_concat(topic, folder_tags, method), {lst(topics)})", "folder_topic_mismatch", "warning"))
        if folder.startswith("paper-") or folder in R.FOLDER_TAGS:
            out.append((f"{here} AND {some} AND NOT list_has_any({lst(words.split())}, toks)", "folder_content_mismatch", "info"))
    return out


def validated(as_of: int) -> str:
    """A subquery: paper_id, the types of its issues, its confidence."""
    found = issues(as_of)
    worth = {"error": 0.25, "warning": 0.08, "info": 0.0}
    loss = " + ".join(f"CASE WHEN {c} THEN {0.05 if t == 'suspicious_tag' else 0.02 if t == 'missing_topic' else worth[s]} ELSE 0.0 END" for c, t, s in found if worth[s] or t == "missing_topic")
    types = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(t)} END" for c, t, _ in found) + "], lambda x: x IS NOT NULL)"
    more = "CASE WHEN coalesce(title_is_filename, false) THEN 0.15 ELSE 0.0 END + CASE WHEN coalesce(abstract, '') = '' THEN 0.10 ELSE 0.0 END + CASE WHEN coalesce(pub_year, 0) = 0 THEN 0.08 ELSE 0.0 END"
    return f"""(SELECT paper_id, library, folder, {types} AS types, round(greatest(0.0, least(1.0, 1.0 - ({loss} + {more})))::DOUBLE, 3) AS confidence
        FROM (SELECT *, list_distinct({tokens("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))")}) AS toks FROM {layers()}))"""


def doubtful() -> str:
    """A subquery: paper_id with the tags that lack their words, as ``layer:tag``."""
    c = [f"CASE WHEN len(toks) > 0 AND list_contains({x}, {q(t)}) AND NOT list_has_any({lst(R.tag_words(x, t))}, toks) THEN {q(x + ':' + t)} END" for x in R.LAYERS for t in R.TAXONOMY[x]]
    return f"""(SELECT paper_id, list_filter([{', '.join(c)}], lambda x: x IS NOT NULL) AS doubts
        FROM (SELECT *, list_distinct({tokens("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))")}) AS toks FROM {layers()}))"""


def bookmark_tags() -> str:
    """A subquery: item_id with its rule tags joined by bars."""
    blob = "lower(concat_ws(' ', nullif(title, ''), nullif(url, ''), nullif(url_domain, '')))"
    hits = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(txt, {q(R.any_of(p))}) THEN {q(t)} END" for t, p in R.BOOKMARK_TAGS.items()) + "], lambda x: x IS NOT NULL)"
    meta = lst(R.BOOKMARK_META)
    return f"""(SELECT item_id, CASE WHEN len(topical) > 0 THEN list_concat(topical[1:3], kind[1:1]) WHEN len(kind) > 0 THEN kind[1:2]
          WHEN contains(lower(coalesce(url_domain, '')), 'github.com') THEN ['Foundation Model'] WHEN contains(lower(coalesce(url_domain, '')), 'arxiv') THEN ['Paper / arXiv'] ELSE ['General Tech'] END AS rt
        FROM (SELECT *, list_filter(hits, lambda x: NOT list_contains({meta}, x)) AS topical, list_filter(hits, lambda x: list_contains({meta}, x)) AS kind
          FROM (SELECT *, {hits} AS hits FROM (SELECT *, {blob} AS txt FROM bookmarks))))"""


# --- Unicode, titles, names ----------------------------------------------------------------------------------------

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
#: Compatibility characters outside the full-width block that titles hold, and what they stand for.
_COMPAT = {"\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "\u2011": "\u2010", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "…": "...", "²": "2", "³": "3", "™": "TM"}


def nfkc(c: str) -> str:
    """NFKC of texts whose compatibility characters are full-width ones or in the table above."""
    for a, b in _COMPAT.items():
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"nfc_normalize(translate({c}, {q(_WIDE)}, {q(_ASCII)}))"


def bare_title(c: str) -> str:
    return nfkc(rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+\z', '', 'g')")


def any_part(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in parts) + ")"


def junk(t: str, stem: str, from_file: str) -> str:
    """The reasons why a bare title ``t`` is junk."""
    out = [f"CASE WHEN length({t}) > 200 THEN 'too_long' END"]
    for reason, p in R.JUNK_TITLES:
        out.append(f"CASE WHEN regexp_matches({t}, {q(p)}) THEN {q(reason)} END")
        if reason == "cn_multi_section":
            out.append(f"CASE WHEN len(regexp_extract_all({t}, {q(R.SECTION_PATTERN)})) >= 2 THEN 'cn_section_summary' END")
            out.append(f"CASE WHEN length({t}) - length(replace({t}, ':', '')) >= 3 THEN 'many_colons' END")
            out.append(rf"CASE WHEN len(list_filter(string_split_regex({t}, '[：:] |\n'), lambda p: trim(p) <> '')) >= 3 THEN 'multi_parts' END")
    out.append(f"CASE WHEN coalesce({from_file}, false) AND {any_part(stem, (*R.COURSE_WORDS, '合辑'))} THEN 'filename_course_stem' END")
    return f"CASE WHEN {t} <> '' THEN list_filter([{', '.join(out)}], lambda x: x IS NOT NULL) ELSE []::VARCHAR[] END"


def with_junk(src: str, from_file: str = "title_is_filename") -> str:
    """A subquery: ``src`` with ``junk``."""
    j = junk("t0", "coalesce(stem, '')", from_file)
    return f"(SELECT * EXCLUDE (t0), {j} AS junk FROM (SELECT *, {bare_title('title')} AS t0 FROM {src}))"


def excluded(src: str) -> str:
    """A subquery: ``src`` with ``junk`` and ``exclude_reason``."""
    han = "[一-鿿]"
    c = ["WHEN size_bytes = 0 THEN 'empty_file'"]
    c += [f"WHEN contains(rel, {q(d.lower())}) THEN {q('dir:' + d.strip('/'))}" for d in R.EXCLUDED_FOLDERS]
    c += [f"WHEN regexp_matches(st, {q(p)}) THEN {q(r)}" for p, r in R.EXCLUDED_STEMS]
    c += [
        f"WHEN {any_part('st', R.COURSE_KEYWORDS)} OR {any_part('ti', R.COURSE_KEYWORDS)} THEN 'course_material'",
        f"WHEN len(junk) > 0 AND bare AND (regexp_matches(st, '{han}') OR regexp_matches(ti, '{han}')) THEN 'junk_title_course_notes'",
        "WHEN contains(st, '智东西') OR contains(ti, '智东西') THEN 'course_material'",
        "WHEN contains(rel, 'course_slides') AND bare THEN 'course_slides_no_abstract'",
        f"WHEN bare AND regexp_matches(st, '{han}') AND NOT regexp_matches(st, '^[0-9]{{4}}[.][0-9]{{4,5}}') AND coalesce(title_is_filename, false) "
        f"AND NOT regexp_matches(st, '(?i)paper|arxiv|proceedings') AND {any_part('st', R.COURSE_WORDS)} THEN 'cn_tutorial_no_abstract'",
    ]
    cols = "lower(coalesce(rel_path, '')) AS rel, coalesce(stem, '') AS st, coalesce(nullif(title, ''), stem, '') AS ti, coalesce(abstract, '') = '' AS bare"
    return f"(SELECT * EXCLUDE (rel, st, ti, bare), CASE {' '.join(c)} END AS exclude_reason FROM (SELECT *, {cols} FROM {with_junk(src)}))"


def valid_name(x: str) -> str:
    n = rf"regexp_replace(regexp_replace(regexp_replace({x}, '[\d*†‡§∗\[\]（）()]+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), '^[ ,;.]+|[ ,;.]+\z', '', 'g')"
    words = f"regexp_extract_all({n}, '[A-Za-z]+(?:''[A-Za-z]+)?')"
    good = f"len(list_filter({words}, lambda w: length(w) >= 2 AND regexp_matches(w, '^[A-Z]') AND NOT list_contains({lst(dict.fromkeys(P.JUNK_WORDS))}, lower(w)))) >= 2"
    small = f"len(list_filter({words}, lambda w: regexp_matches(w, '^[a-z]$'))) = 0"
    han = f"len(list_filter(regexp_extract_all({n}, '[一-鿿]+'), lambda h: length(h) NOT BETWEEN 2 AND 4)) = 0"
    return f"coalesce(length({n}) BETWEEN 3 AND 60 AND NOT regexp_matches({n}, {q(P.JUNK_PHRASE)}) AND NOT regexp_matches({n}, {q(P.OTHER_LINE)}) AND CASE WHEN regexp_matches({n}, '[一-鿿]') THEN {han} ELSE {small} AND {good} END, false)"


def cleaned_authors() -> str:
    """A subquery: ``paper_id``, the list ``names`` of valid names, and ``wrong``; for lists whose parts are names or nothing."""
    bare = r"regexp_replace(regexp_replace(regexp_replace(a, '[{}$\\]|[\d*†‡§∗]+', '', 'g'), '\S+@\S+', '', 'g'), '[ \t]+', ' ', 'g')"
    part = r"regexp_replace(regexp_replace(part, '[\s\p{Z}]+', ' ', 'g'), '^[ ,;]+|[ ,;]+\z', '', 'g')"
    return rf"""(WITH e AS (SELECT paper_id, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM library_papers),
      p AS (SELECT paper_id, i, unnest(string_split_regex({bare}, '(?i),|\band\b|、|·|\n')) AS part, generate_subscripts(string_split_regex({bare}, '(?i),|\band\b|、|·|\n'), 1) AS j FROM e),
      n AS (SELECT paper_id, i, j, {part} AS name FROM p), v AS (SELECT *, lower(name) AS low FROM n WHERE {valid_name('name')}),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, low ORDER BY i, j) AS r FROM v) WHERE r = 1),
      c AS (SELECT paper_id, list(name ORDER BY i, j)[1:20] AS names FROM o GROUP BY paper_id),
      b AS (SELECT paper_id, count(*) FILTER (NOT {valid_name('trim(a)')}) AS bad FROM e GROUP BY paper_id)
      SELECT paper_id, coalesce(names, []) AS names, coalesce(len(authors) > 0 AND (regexp_matches(array_to_string(authors, ', '), '[{{}}$\\]') OR regexp_matches(array_to_string(authors, ', '), {q(P.JUNK_PHRASE)})
        OR len(coalesce(names, [])) = 0 OR len(coalesce(names, [])) < greatest(1, len(authors) // 2) OR coalesce(bad, 0) > len(authors) // 2), false) AS wrong
      FROM library_papers LEFT JOIN c USING (paper_id) LEFT JOIN b USING (paper_id))"""
