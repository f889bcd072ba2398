"""Search text by compatibility decomposition, as JVM functions: decompose, drop combining marks, lower case, all but words and digits as one space.

The decomposition is the ICU library's, which Spark ships. Which marks combine, and which characters belong to words, is taken from Python's Unicode tables by rule and written as
classes of regular expressions; where the JVM's own classes say the same they are used, and only the difference is listed.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SURROGATES = range(0xD800, 0xE000)


def code_class(points: Iterable[int]) -> str:
    """Code points as the inside of a class of a regular expression."""
    out, first, last = [], None, None
    for p in [*points, None]:
        if first is not None and p is not None and p == last + 1:
            last = p
            continue
        if first is not None:
            out.append(f"\\x{{{first:X}}}" + (f"-\\x{{{last:X}}}" if last > first else ""))
        first = last = p
    return "".join(out)


def points_where(rule: Callable[[str], bool]) -> list[int]:
    return [p for p in range(sys.maxunicode + 1) if p not in SURROGATES and rule(chr(p))]


@cache
def marks() -> str:
    """The class of combining marks."""
    return code_class(points_where(lambda c: unicodedata.combining(c) != 0))


@cache
def _letters(application: str) -> tuple[str, str]:
    """Code points that belong to words though the JVM's classes of letters and numbers lack them, and the other way round."""
    spark = SparkSession.getActiveSession()
    points = spark.range(sys.maxunicode + 1).filter(f"id < {SURROGATES.start} OR id >= {SURROGATES.stop}")
    text = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = {r["id"] for r in points.filter(text.rlike("^[\\p{L}\\p{N}]$")).select("id").collect()}  # code points, whatever the data
    wanted = set(points_where(str.isalnum))
    return code_class(sorted(wanted - known)), code_class(sorted(known - wanted))


def folded(column: str) -> Column:
    """The search text of a column, exact for every code point that Python's tables assign. Needs an active session."""
    more, less = _letters(SparkSession.getActiveSession().sparkContext.applicationId)
    text = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.col(column), F.lit(True))
    text = F.lower(F.regexp_replace(text, f"(?=[\\p{{M}}\\p{{Cn}}])[{marks()}]", ""))
    other = f"[^\\p{{L}}\\p{{N}}{more}]"
    other = f"[{other}[{less}]]" if less else other
    text = F.regexp_replace(text, f"(?! [a-z0-9])(?![a-z0-9]){other}+", " ")  # whole runs; a lone space before a plain letter stays as it is
    return F.when(F.col(column).isNotNull(), F.trim(text))
