"""Unicode compatibility folding, which Spark has no function for: an Arrow-batched UDF around the standard library."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    return F.pandas_udf(_fold, "string")(text)
