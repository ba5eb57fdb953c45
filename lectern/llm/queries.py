"""The queries of this package, and the SQL beside those that SQL can express. Iteration over pairs of texts, indexes,
tokenizers and models are beyond it; the tests compare these with brute force, round trips and held-out labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import p1_survivors, p2_spellings, p3_residue, p4_terms, p5_near_copies, p6_groups, p7_packing, p8_leaks, p9_reading
from .sql import SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_survivors.p1_found,
        "p1_fused": p1_survivors.p1_fused,
        "p2_found": p2_spellings.p2_found,
        "p2_counts": p2_spellings.p2_counts,
        "p3_found": p3_residue.p3_found,
        "p4_found": p4_terms.p4_found,
        "p4_scores": p4_terms.p4_scores,
        "p5_found": p5_near_copies.p5_found,
        "p6_found": p6_groups.p6_found,
        "p7_containers": p7_packing.p7_containers,
        "p7_fill": p7_packing.p7_fill,
        "p8_found": p8_leaks.p8_found,
        "p8_spans": p8_leaks.p8_spans,
        "p8_removals": p8_leaks.p8_removals,
        "p9_found": p9_reading.p9_found,
        "p9_levels": p9_reading.p9_levels,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
