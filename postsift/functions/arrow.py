"""The few expressions that need Python; all work on Arrow batches."""

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_full(c) -> Column:
    """Decode every entity HTML 5 names; for texts where the JVM table is too small."""
    return _unescape(F.col(c) if isinstance(c, str) else c)
