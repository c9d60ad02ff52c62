"""User functions over batches, for what native expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import fan_out


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, costly: bool = False
) -> DataFrame:
    """Apply `fn` to Arrow batches of rows, partition by partition, in parallel.

    `costly` spreads a table that is small in bytes over all cores first. The batch size is the
    session's spark.sql.execution.arrow.maxRecordsPerBatch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return (fan_out(df) if costly else df).mapInPandas(run, schema)
