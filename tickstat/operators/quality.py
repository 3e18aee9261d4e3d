"""M3: data-quality report of a feature table in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DERIVED = ("log_return", "amihud_illiq", "parkinson_var_1m", "taker_ratio")


def quality_report(features: DataFrame, derived=DERIVED) -> DataFrame:
    """One row: rows, columns, time coverage, distinct symbols / base assets,
    null rate of each derived column, zero-volume rate, duplicated keys.

    Level 1 groups by the logical key (symbol, open_time), which the duplicate
    check needs anyway; level 2 folds the keys of a symbol, level 3 the symbols.
    So the six separate scans of the reference become one shuffle of narrow
    rows, all by hash aggregates of numbers. Base assets are a second, one-column
    scan whose partial aggregate leaves one row per base; its rows go into the
    last level beside the symbols.
    """
    n_cols = len(features.columns)
    sums = [f"_n_{c}" for c in derived] + ["_zero"]
    per_key = features.groupBy("symbol", "open_time").agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in derived],
        F.sum(F.col("zero_volume_flag").cast("long")).alias("_zero"),
    )
    per_symbol = per_key.groupBy("symbol").agg(
        F.sum("_c").alias("_c"),
        F.min("open_time").alias("_first"),
        F.max("open_time").alias("_last"),
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col("_c") > 1).alias("_dup"),
    )
    bases = features.select(F.col("base_asset").alias("_base")).distinct().where("_base is not null")
    per_symbol = per_symbol.unionByName(bases, allowMissingColumns=True)
    rows = F.sum("_c")
    return per_symbol.agg(
        rows.alias("n_rows"),
        F.lit(n_cols).alias("n_columns"),
        F.min("_first").alias("min_open_time"),
        F.max("_last").alias("max_open_time"),
        F.count("symbol").alias("n_symbols"),
        F.count("_base").alias("n_base_assets"),
        *[F.try_divide(F.sum(f"_n_{c}").cast("double"), rows).alias(f"{c}_null_rate") for c in derived],
        F.try_divide(F.sum("_zero").cast("double"), rows).alias("zero_volume_rate"),
        F.coalesce(F.sum("_dup"), F.lit(0)).alias("dup_keys"),
    ).withColumn("passed", F.col("dup_keys") == 0)
