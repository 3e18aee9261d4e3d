"""Market capitalisations from outside: dated snapshot files.

A provider publishes one CSV per day (``2024-05-01.csv``, or a folder
``date=2024-05-01``) with a header and the columns ``base_asset, market_cap``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "base_asset string, market_cap double"
_DATE = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"


def read_market_caps(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Snapshots as (base_asset, snap_time, market_cap), one row per asset and snapshot.

    ``date=`` folders are pruned by filters on ``snap_time``'s date; otherwise the
    last date in the file's path counts. Asset names are trimmed and upper-cased;
    of repeated rows the largest value stays. Rows without an asset, a date or a
    positive finite value go: they say nothing of the asset's size."""
    df = spark.read.option("header", "true").schema(SCHEMA).csv(path if isinstance(path, str) else list(path))
    if "date" in df.columns:
        day = F.col("date").try_cast("date")
    else:
        day = F.try_to_date(F.try_element_at(F.regexp_extract_all(F.url_decode(F.col("_metadata.file_path")), F.lit(_DATE), 1), F.lit(-1)))
    rows = df.select(F.upper(F.trim("base_asset")).alias("base_asset"), day.cast("timestamp_ntz").alias("snap_time"), "market_cap")
    rows = rows.where((F.col("base_asset") != "") & F.col("snap_time").isNotNull()
                      & (F.col("market_cap") > 0) & (F.col("market_cap") < F.lit(float("inf"))))
    return rows.groupBy("base_asset", "snap_time").agg(F.max("market_cap").alias("market_cap"))


def write_market_caps(snaps: DataFrame, path: str) -> None:
    """Snapshots in the layout ``read_market_caps`` prunes: one folder per date."""
    out = snaps.select("base_asset", "market_cap", F.to_date("snap_time").alias("date"))
    out.repartition("date").write.partitionBy("date").option("header", "true").csv(path)
