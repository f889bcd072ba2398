"""Text functions that need Python: Unicode decomposition and sequence similarity, on Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import jaccard


@F.pandas_udf(T.StringType())
def search_text_exact(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, lower case, other than words and digits as one space."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w]|_", " ", plain.lower()).split())

    return x.map(one)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """The greater of the sequence ratio and the overlap of words."""
    return F.greatest(sequence_ratio(a, b), jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))))
