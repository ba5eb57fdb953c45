"""Short summaries: who needs a written one, what a cache may give, and the rule-made fallback.

The rules are tables, so that another language or field only needs other tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import clean as C

FULL_YEARS = (2025, 2026)
MAX_LENGTH = 160

# Words of titles whose summaries the rules do well.
SURVEY_WORDS = r"(?i)\b(?:survey|review|benchmark|dataset|challenge|workshop)\b"

#: (pattern over a sentence, what it tells): the default tables of the rule-made summary.
CUES = {
    "method": r"(?i)\b(?:we (?:propose|present|introduce|develop|describe)|this (?:paper|article|work) (?:presents|proposes|introduces))\b",
    "problem": r"(?i)\b(?:remains|little is known|limited|however|suffer|fail|unavailable|challeng|difficult)",
    "benefit": r"(?i)\b(?:improves?|outperforms?|reduces?|raises?|percent|points|faster|fewer)\b",
    "insight": r"(?i)\b(?:key (?:observation|insight|idea)|our key|by treating)\b",
}
WEAK = [r"^.{0,11}$", r"(?i)^(?:see|details in) (?:the )?abstract", r"(?i)^this paper\.?$", r"^[\W\d]+$", r"(?i)lorem ipsum"]


def first_cue(abstract: Column, cue: str, most: int = 1) -> Column:
    return F.slice(F.filter(C.sentences(abstract), lambda s: s.rlike(CUES[cue])), 1, most)


def is_weak(summary: Column, title: Column) -> Column:
    """Too short, empty talk, or the title again."""
    echo = C.normalized_title(summary) == C.normalized_title(title)
    return F.coalesce(echo | summary.rlike("|".join(f"(?:{p})" for p in WEAK)), F.lit(True))


def rule_summary(title: Column, abstract: Column) -> Column:
    """Method, problem and benefit from the abstract's sentences; else the insight; else the title's head; else null.

    Each step is taken only if it isn't weak. At most MAX_LENGTH characters.
    """
    a = C.joined_lines(abstract)
    parts = F.array_distinct(F.concat(first_cue(a, "method"), first_cue(a, "problem"), first_cue(a, "benefit")))
    composed, insight = F.array_join(parts, " "), F.array_join(first_cue(a, "insight"), " ")
    steps = [composed, insight, F.array_join(F.slice(C.sentences(a), 1, 1), " "), C.title_head(title)]
    cut = lambda s: F.when(F.length(s) > MAX_LENGTH, F.concat(F.substring(s, 1, MAX_LENGTH - 1), F.lit("…"))).otherwise(s)
    weak = [is_weak(cut(s), title) for s in steps[:-1]] + [F.length(steps[-1]) < 3]
    return F.coalesce(*[F.when(~w, cut(s)) for s, w in zip(steps, weak)])


def policy(needs_review: Column, has_flags: Column, year: Column, title: Column, summary: Column, topics: Column, tasks: Column, abstract: Column) -> Column:
    """Whether a summary has to be written rather than made by rule; the first rule that decides, by name."""
    return (
        F.when(F.coalesce(year.between(*FULL_YEARS), F.lit(False)), "yes:recent").when(F.coalesce(needs_review, F.lit(False)), "yes:review").when(has_flags, "yes:flagged")
        .when(F.coalesce(title, F.lit("")).rlike(SURVEY_WORDS), "no:survey").when(is_weak(summary, title), "yes:weak")
        .when((C.latin_share(summary) <= 0.38) & (F.length(summary) >= 12), "no:translated").when((F.size(topics) == 0) & (F.size(tasks) == 0), "yes:untagged")
        .when(F.coalesce(abstract, F.lit("")) == "", "yes:no_abstract").otherwise("no:good")
    )


def resolved(written: Column, written_hash: Column, cached_rule: Column, cached_version: Column, now_hash: Column, version: str, rule: Column) -> Column:
    """A written summary of the same input, else a cached one of the same rules, else the rules' own."""
    return F.coalesce(F.when(written_hash == now_hash, C.presence(written)), F.when(cached_version == version, C.presence(cached_rule)), rule)
