"""Distribution summaries and samples.

The reference drew bar charts and box plots on the driver from a sample. Here
the numbers behind those charts are computed on all rows in Spark: a
plot-ready pivot of the tier x stress metrics, and box-plot statistics
(quartiles and whiskers) per group. Rendering is left to the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstat.operators.quantiles import quantiles

PLOT_METRICS = ("median_quote_volume", "zero_volume_ratio", "avg_parkinson_vol", "p95_amihud")
BOX_COLUMNS = ("quote_asset_volume", "amihud_illiq", "parkinson_var_1m", "abs_return")


def _states():
    return (("stress", F.col("is_stress") == F.lit(True)), ("calm", F.col("is_stress") == F.lit(False)),
            ("unknown", F.col("is_stress").isNull()))


def plot_table(compare: DataFrame, metrics: Sequence[str] = PLOT_METRICS) -> DataFrame:
    """One row per tier, one column per (metric, stress state):
    ``<metric>_stress``, ``<metric>_calm``, ``<metric>_unknown``."""
    return compare.groupBy("tier").agg(
        *[F.max(F.when(cond, F.col(m))).alias(f"{m}_{state}") for m in metrics for state, cond in _states()])


def box_stats(labelled: DataFrame, keys: Sequence[str] = ("tier", "is_stress"),
              columns: Sequence[str] = BOX_COLUMNS, whisker: float = 1.5, exact: bool = False) -> DataFrame:
    """Per group and column: n, q1, median, q3 (with ``exact`` by linear
    interpolation, as a box plot draws them; else elements of the data within
    the sketch's rank error) and the whiskers -- the most extreme values within
    ``whisker`` x IQR of the box. Outliers are not listed. All rows are used;
    nothing is sampled or collected."""
    keys = list(keys)
    df = labelled.withColumn("abs_return", F.abs("log_return")) if "abs_return" in columns else labelled
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_s")
    ).select(*keys, F.col("_s.m").alias("metric"), F.col("_s.v").alias("value")).where(F.col("value").isNotNull())
    q = quantiles(stacked, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys + ["metric"], "cont" if exact else "disc", exact)
    iqr = F.col("q3") - F.col("q1")
    kk = keys + ["metric"]
    fences = q.select(*[F.col(k).alias(f"_f_{k}") for k in kk], "q1", "median", "q3",
                      (F.col("q1") - F.lit(whisker) * iqr).alias("_lo_fence"),
                      (F.col("q3") + F.lit(whisker) * iqr).alias("_hi_fence"))
    # fences: one row per (group, column); groups are tier x stress state here.
    # Keys are renamed so the join is unambiguous when both sides share lineage.
    cond = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in kk]
    j = stacked.join(fences, cond, "inner").select(*kk, "value", "q1", "median", "q3", "_lo_fence",
                                                              "_hi_fence")
    return j.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("value") >= F.col("_lo_fence"), F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("value") <= F.col("_hi_fence"), F.col("value"))).alias("whisker_hi"),
    )


def hash_limit(fraction: float) -> str:
    """First eight hex digits below which a share ``fraction`` of all hashes lies."""
    return f"{min(max(int(fraction * (1 << 32)), 0), (1 << 32) - 1):08x}" if fraction < 1 else "g"


def _row_hash(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def sample_uniform(df: DataFrame, key: Sequence[str], fraction: float = 0.001, seed: int = 42, cap: int | None = None) -> DataFrame:
    """Uniform sample without replacement, and an optional row cap (the
    sampling feature itself). A row is kept by the hash of its key and the
    seed, so the sample depends neither on file splits nor on partitions; the
    cap keeps the smallest hashes."""
    h = _row_hash(key, seed)
    kept = df.where(F.substring(h, 1, 8) < hash_limit(fraction))
    return kept.orderBy(h, *key).limit(cap) if cap else kept


def sample_stratified(df: DataFrame, key: Sequence[str], strata: Sequence[str], fractions: Mapping[str, float] | float = 0.001,
                      seed: int = 42) -> DataFrame:
    """Per-stratum sample on a combined key ``k1|k2``; null key parts read
    as 'null'. A single float applies to every stratum; strata that a mapping
    doesn't list are left out."""
    if not isinstance(fractions, Mapping):
        return sample_uniform(df, key, float(fractions), seed)
    stratum = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in strata])
    limit = F.lit("")
    for name, fraction in fractions.items():
        limit = F.when(stratum == name, hash_limit(fraction)).otherwise(limit)
    return df.where(F.substring(_row_hash(key, seed), 1, 8) < limit)


def distribution_summary(labelled: DataFrame, compare: DataFrame | None = None, exact: bool = False):
    """(plot table, box statistics) for a tier x stress labelled table.
    ``compare`` is the stress comparison if already computed."""
    from tickstat.operators.stress import market_quality

    cmp = compare if compare is not None else market_quality(labelled, ["tier", "is_stress"], exact)
    return plot_table(cmp), box_stats(labelled, exact=exact)
