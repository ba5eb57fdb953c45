"""Text normal forms as column expressions.

Spark has no Unicode normalisation. ASCII values stay in the JVM, where NFKC is the identity and
case folding equals ``lower``; only the others are sent to an Arrow function.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII = r"^[\x00-\x7F]*$"
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and case folding."""
    return WORD.findall(fold(text)) if text else []


@F.arrow_udf(T.StringType())
def _fold_udf(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else fold(x) for x in s.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc_udf(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _key_udf(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else "".join(WORD.findall(fold(x))) for x in s.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Null stays null."""
    return F.when(c.rlike(ASCII), c).otherwise(_nfkc_udf(F.when(~c.rlike(ASCII), c)))


def folded(c: Column) -> Column:
    """NFKC and case folding. Null stays null."""
    return F.when(c.rlike(ASCII), F.lower(c)).otherwise(_fold_udf(F.when(~c.rlike(ASCII), c)))


def letters_and_digits(c: Column) -> Column:
    """The letters and digits of a text after NFKC and case folding, in order. Null stays null."""
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.when(c.rlike(ASCII), plain).otherwise(_key_udf(F.when(~c.rlike(ASCII), c)))


def collapsed(c: Column) -> Column:
    """Whitespace runs, Unicode ones too, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
