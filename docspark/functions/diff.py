"""Previews of changes."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINES = 10


@F.pandas_udf(StringType())
def preview(old: pd.Series, new: pd.Series) -> pd.Series:
    """The first LINES lines of a unified diff with one line around each change; empty for equal texts."""

    def one(a, b):
        lines = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm="", n=1)
        return "\n".join(line for line, _ in zip(lines, range(LINES), strict=False))

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])
