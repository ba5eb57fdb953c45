"""Preprint identifiers and other keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The format of a preprint id, its optional lead and version suffix.
ID_FORMAT = r"(?iU)^\s*(?:arxiv:\s*|abs/)?([0-9]{4}\.[0-9]{4,5})(?:v([0-9]+))?\s*$"


def well_formed_id(c: Column) -> Column:
    """``YYMM.number`` of an id written in any accepted way; null if there is none."""
    bare = F.regexp_extract(c, ID_FORMAT, 1)
    yymm, number = F.substring(bare, 1, 4), F.substring(bare, 6, 5)
    ok = (
        (bare != "")
        & F.substring(bare, 3, 2).between("01", "12")
        & ~number.rlike("^0+$")
        & ((F.substring(bare, 1, 2) >= "91") | yymm.between("0704", "2612"))
    )
    return F.when(ok, bare)


def id_version(c: Column) -> Column:
    """The version number of an id; 0 if it has none."""
    v = F.regexp_extract(c, ID_FORMAT, 2)
    return F.coalesce(F.try_to_number(F.when(v != "", F.substring(v, 1, 9)), F.lit("999999999")).cast("long"), F.lit(0))
