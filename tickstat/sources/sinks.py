"""Parquet and CSV sinks with file-count control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None,
                rebalance: bool = True) -> None:
    """Large table: AQE ``REBALANCE`` sizes the output files (no fixed
    coalesce that would funnel a big table through a few tasks)."""
    out = df.hint("rebalance") if rebalance else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_small(df: DataFrame, path: str, mode: str = "overwrite", files: int = 1) -> None:
    """Small result (summaries, a few thousand rows): ``files`` output files.

    The result is shuffled, not coalesced, so that the aggregate that makes it
    keeps its own partitions."""
    df.repartition(files).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """One CSV file with a header, for a small summary table."""
    df.repartition(1).write.mode(mode).option("header", str(header).lower()).csv(path)
