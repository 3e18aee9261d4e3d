"""Structural breaks of a series' mean, by binary segmentation over prefix sums.

Running sums and lag products are taken once per symbol. Then each round tests
every open segment of every symbol in one pass: the largest absolute CUSUM of
the segment's de-meaned values, scaled by the square root of its length times
its long-run variance (Bartlett weights over ``lags`` autocovariances). Where
the statistic exceeds the critical value, the segment is cut there and both
parts are tested in the next round. Sums are exact integers, so the result
doesn't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstat.operators.joins import broadcast_if_small
from tickstat.operators.series import lagged_values, running_total
from tickstat.sources.shared import stored

#: The 5 % point of the supremum of a Brownian bridge's absolute value.
CRITICAL = 1.358


def prefix_sums(features: DataFrame, symbols: Sequence[str] | None, value: str, lags: int, unit: str) -> DataFrame:
    """symbol, open_time, k (place from 1), x, s (sum up to here), x_1.. (lagged values)."""
    d = features if symbols is None else features.where(F.col("symbol").isin(list(symbols)))
    d = d.where(F.col(value).isNotNull()).select("symbol", "open_time", F.col(value).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("_one"))
    d = running_total(d, "x", "s", unit=unit)
    d = running_total(d, "_one", "k", unit=unit).drop("_one")
    return lagged_values(d, ["x"], lags, unit=unit) if lags else d


def structural_breaks(features: DataFrame, symbols: Sequence[str] | None = None, value: str = "number_of_trades", lags: int = 5, rounds: int = 6,
                      critical: float = CRITICAL, min_size: int = 30, unit: str = "month") -> DataFrame:
    """One row per break: symbol, round, seg_start and seg_end (places of the
    segment that it cuts, start exclusive), n, break_place and break_time (the
    last bar before the change), statistic, mean_before, mean_after.

    ``symbols`` None: all. Equal CUSUMs: the earliest place. Segments with no
    long-run variance (constant values, or estimated as not positive) and parts
    shorter than ``min_size`` are not cut."""
    rows = stored(prefix_sums(features, symbols, value, lags, unit), "prefix_sums")
    ends = rows.groupBy("symbol").agg(F.max("k").alias("hi"))
    segments = ends.select("symbol", F.lit(0).cast("bigint").alias("lo"), "hi", F.lit(0).cast("bigint").alias("s_lo"))
    sums = rows.groupBy("symbol").agg(F.sum("x").alias("s_hi"))
    segments = stored(segments.join(sums, "symbol").where(F.col("hi") >= 2 * min_size), "segments")
    found: list[DataFrame] = []
    for turn in range(1, rounds + 1):
        if segments.isEmpty():
            break
        # a few rows per symbol; broadcast while that is small
        own = rows.join(broadcast_if_small(segments.withColumnRenamed("symbol", "_symbol")), (F.col("symbol") == F.col("_symbol")) & (F.col("k") > F.col("lo")) & (F.col("k") <= F.col("hi")))
        n = F.col("hi") - F.col("lo")
        mean = (F.col("s_hi") - F.col("s_lo")) / n
        cusum = F.abs((F.col("s") - F.col("s_lo")) - (F.col("k") - F.col("lo")) * mean)
        inside = (F.col("k") - F.col("lo") >= min_size) & (F.col("hi") - F.col("k") >= min_size)
        x = F.col("x")
        aggs = [F.sum(x * x).alias("xx"), F.max(F.when(inside, F.struct(cusum.alias("c"), (-F.col("k")).alias("minus_k"), "open_time", "s"))).alias("top")]
        for j in range(1, lags + 1):
            pair = F.when(F.col("k") - j > F.col("lo"), F.col(f"x_{j}"))
            aggs += [F.sum(x * pair).alias(f"xx{j}"), F.sum(F.when(pair.isNotNull(), x) + pair).alias(f"sum{j}"), F.count(pair).alias(f"n{j}")]
        seg = own.groupBy("symbol", "lo", "hi", "s_lo", "s_hi").agg(*aggs)
        seg = seg.withColumn("n", n).withColumn("mean", mean)
        m = F.col("mean")
        variance = (F.col("xx") - F.col("n") * m * m) / F.col("n")
        for j in range(1, lags + 1):
            product = F.coalesce(F.col(f"xx{j}") - m * F.col(f"sum{j}") + F.col(f"n{j}") * m * m, F.lit(0.0))
            variance = variance + F.lit(2.0 * (1 - j / (lags + 1))) * product / F.col("n")
        seg = seg.withColumn("lrv", variance).where((F.col("lrv") > 0) & F.col("top").isNotNull())
        seg = seg.withColumn("statistic", F.col("top.c") / F.sqrt(F.col("lrv") * F.col("n"))).where(F.col("statistic") > critical)
        place, s = -F.col("top.minus_k"), F.col("top.s")
        cut = stored(seg.select("symbol", F.lit(turn).alias("round"), "lo", "hi", "n", "s_lo", "s_hi", place.alias("break_place"), F.col("top.open_time").alias("break_time"),
                                s.alias("s_at"), "statistic"), "breaks")
        found.append(cut)
        left = cut.select("symbol", "lo", F.col("break_place").alias("hi"), "s_lo", F.col("s_at").alias("s_hi"))
        right = cut.select("symbol", F.col("break_place").alias("lo"), "hi", F.col("s_at").alias("s_lo"), "s_hi")
        segments = left.unionByName(right).where(F.col("hi") - F.col("lo") >= 2 * min_size)
    if not found:
        found = [segments.selectExpr("symbol", "0 round", "lo", "hi", "0L n", "s_lo", "s_hi", "0L break_place", "timestamp_ntz '1970-01-01' break_time", "0L s_at", "0D statistic").where("false")]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(
        "symbol", "round", F.col("lo").alias("seg_start"), F.col("hi").alias("seg_end"), "n", "break_place", "break_time", "statistic",
        ((F.col("s_at") - F.col("s_lo")) / (F.col("break_place") - F.col("lo"))).alias("mean_before"),
        ((F.col("s_hi") - F.col("s_at")) / (F.col("hi") - F.col("break_place"))).alias("mean_after"))
