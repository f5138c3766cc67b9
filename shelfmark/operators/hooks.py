"""Caller code on rows. A function over frames or columns is the first choice; these wrap
plain Python for the cases no expression covers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enrich_batches(
    fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str | None = None
) -> Callable[[DataFrame], DataFrame]:
    """An enrichment step from a function over pandas batches; the schema stays unless given."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield fn(batch)

    return lambda df: df.mapInPandas(batches, schema or df.schema)


def row_predicate(
    fn: Callable[..., pd.Series], columns: Sequence[str]
) -> Callable[[DataFrame], Column]:
    """A filter from a function over the named columns, each a pandas series."""

    def test(*series: pd.Series) -> pd.Series:
        return fn(*series)

    keep = F.pandas_udf(test, T.BooleanType())
    return lambda df: keep(*[df[c] for c in columns])
