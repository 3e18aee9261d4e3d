"""Size tiers from ranks that hold for a time (a slowly changing table).

Bars meet the rank that was valid at their own time, so a tier never looks
ahead. The rank table has one row per asset and interval ``[valid_from,
valid_to)``. Each interval is dealt to the months it touches and joined on
(asset, month) with the interval as a condition: no window over all bars, no
comparison of every bar with every interval. The rank table is broadcast behind
a check of its rows; beyond the bound the join shuffles by (asset, month), so an
asset with a third of all bars is still cut by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickstat.functions.symbols import LARGE, MID, SMALL
from tickstat.operators.joins import broadcast_if_small
from tickstat.schemas import require_columns


def ranks_of(snapshots: DataFrame, max_age_days: int = 90) -> DataFrame:
    """(base_asset, snap_time, market_cap) -> (base_asset, valid_from, valid_to,
    market_cap, cap_rank): the rank within each snapshot (ties by name), valid
    until the asset's next snapshot, at most ``max_age_days``.

    Both windows see one row per asset and snapshot: the assets of one
    snapshot, and the snapshots of one asset."""
    require_columns(snapshots, ("base_asset", "snap_time", "market_cap"), "ranks_of")
    within = Window.partitionBy("snap_time").orderBy(F.col("market_cap").desc_nulls_last(), F.col("base_asset"))
    later = F.lead("snap_time").over(Window.partitionBy("base_asset").orderBy("snap_time"))
    limit = F.timestamp_add("DAY", F.lit(int(max_age_days)), F.col("snap_time"))
    return snapshots.select("base_asset", "snap_time", "market_cap", F.row_number().over(within).cast("long").alias("cap_rank")).select(
        "base_asset", F.col("snap_time").alias("valid_from"), F.least(later, limit).alias("valid_to"), "market_cap", "cap_rank")


def valid_at(bars: DataFrame, ranks: DataFrame, values: tuple[str, ...] = ("market_cap", "cap_rank")) -> DataFrame:
    """Every bar once, with the ``values`` valid at its ``open_time`` (null where none is).

    Where intervals of an asset overlap, the one that began last holds; of rows
    with the same beginning, the smallest rank. A null ``valid_to`` means until
    the asset's next interval, or for good. Empty intervals, and rows without an asset or a
    beginning, hold nowhere. A bar without an asset or a time gets nulls."""
    require_columns(bars, ("base_asset", "open_time"), "valid_at")
    require_columns(ranks, ("base_asset", "valid_from", "valid_to", "cap_rank", *values), "valid_at")
    known = ranks.where("base_asset IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)")
    one = known.groupBy("base_asset", "valid_from").agg(F.min(F.struct(
        F.coalesce("cap_rank", F.lit(1 << 62)).alias("_r"), "valid_to", *values)).alias("_x")).select("base_asset", "valid_from", "_x.*")
    last = bars.agg(F.max("open_time")).first()[0]
    after = F.lead("valid_from").over(Window.partitionBy("base_asset").orderBy("valid_from"))
    # an open end reaches to the last bar: months beyond it meet nothing
    spans = one.withColumn("_to", F.least("valid_to", after)).where(F.col("valid_from") <= F.lit(last).cast("timestamp_ntz"))
    end = F.least(F.coalesce("_to", F.lit(last).cast("timestamp_ntz")), F.lit(last).cast("timestamp_ntz"))
    months = F.sequence(F.trunc(F.to_date("valid_from"), "month"), F.trunc(F.to_date(end), "month"), F.expr("INTERVAL 1 MONTH"))
    spans = spans.select(F.col("base_asset").alias("_a"), F.explode(months).alias("_m"), F.col("valid_from").alias("_from"), "_to",
                         *[F.col(v).alias(f"_v_{v}") for v in values])
    spans = broadcast_if_small(spans)
    holds = (F.col("base_asset") == F.col("_a")) & (F.trunc(F.to_date("open_time"), "month") == F.col("_m")) & (
        F.col("open_time") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("open_time") < F.col("_to")))
    kept = [c for c in bars.columns if c not in values]
    return bars.select(*kept).join(spans, holds, "left").select(*kept, *[F.col(f"_v_{v}").alias(v) for v in values])


def ranked_tiers(bars: DataFrame, ranks: DataFrame, large_max_rank: int = 10, mid_max_rank: int = 30) -> DataFrame:
    """Bars with ``market_cap``, ``cap_rank`` and ``tier3`` as of their own time:
    LARGE up to ``large_max_rank``, MID up to ``mid_max_rank``, SMALL beyond or unranked."""
    if not 0 <= large_max_rank <= mid_max_rank:
        raise ValueError("0 <= large_max_rank <= mid_max_rank is needed")
    rank = F.col("cap_rank")
    tier = F.when(rank <= large_max_rank, F.lit(LARGE)).when(rank <= mid_max_rank, F.lit(MID)).otherwise(F.lit(SMALL))
    return valid_at(bars, ranks).withColumn("tier3", tier)
