"""Results out: CSV worklists and partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import worklists
from ..schema import Dataset


def write_csv(df: DataFrame, path: str) -> str:
    """One header per part file, quotes inside fields doubled; files follow the data's size."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
    return path


def write_worklists(ds: Dataset, folder: str, prefix: str = "") -> list[str]:
    """Both lists, dates already reduced to yyyy-MM-dd."""
    lists = {"unrecovered_failed_payments": worklists.unrecovered(ds.invoices, ds.subscriptions),
             "departures": worklists.departures(ds.invoices, ds.subscriptions)}
    return [write_csv(df, f"{folder}/{prefix}{name}") for name, df in lists.items()]


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)
    return path
