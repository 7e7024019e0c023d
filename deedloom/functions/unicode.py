"""Unicode normalisation, which Spark has no built-in for: one Arrow batch function, applied only where it can matter."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedloom.functions.text import evidence_fold


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC of the text. ASCII texts, which it cannot change, are not sent to Python: they travel as null."""
    beyond = F.when(c.rlike(r"[^\x00-\x7f]"), c)
    return F.coalesce(F.pandas_udf(_nfkc, T.StringType())(beyond), c)


def evidence(c: Column) -> Column:
    """Comparison form of evidence: NFKC, then ASCII letters and digits only, lower case. Null stays null."""
    return evidence_fold(nfkc(c))
