"""Per-symbol time-series primitives that never put a whole symbol in one task.

A symbol can hold a third of all rows, so a ``Window.partitionBy(symbol)``
over the full history would be one giant task. Instead the series is cut into
time buckets (default: calendar month). The window runs per (symbol, bucket);
the value that crosses a bucket boundary comes from a tiny per-bucket table
(one row per symbol and bucket) and is joined back on the same keys, so the
large side keeps the window's partitioning and is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_UNITS = ("year", "quarter", "month", "week", "day")


def time_bucket(ts: str = "open_time", unit: str = "month") -> Column:
    if unit not in BUCKET_UNITS:
        raise ValueError(f"bucket unit must be one of {BUCKET_UNITS}")
    return F.trunc(F.to_date(F.col(ts)), unit) if unit != "day" else F.to_date(F.col(ts))


def previous_value(
    df: DataFrame,
    value: str,
    out: str,
    key: str = "symbol",
    ts: str = "open_time",
    unit: str = "month",
) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same ``key`` by ``ts``.

    Same result as ``lag(value, 1) OVER (PARTITION BY key ORDER BY ts)``: the
    previous *row*, not the previous minute, so a gap gives a longer return.
    """
    return previous_values(df, [value], [out], key, ts, unit)


def previous_values(
    df: DataFrame,
    values: list[str],
    outs: list[str],
    key: str = "symbol",
    ts: str = "open_time",
    unit: str = "month",
) -> DataFrame:
    """``previous_value`` for several columns in one window pass and one carry join."""
    b = "_bucket"
    x = df.withColumn(b, time_bucket(ts, unit))
    w = Window.partitionBy(key, b).orderBy(ts)
    for i, v in enumerate(values):
        x = x.withColumn(f"_lag_in{i}", F.lag(v, 1).over(w))
    x = x.withColumn("_is_first", F.row_number().over(w) == 1)
    # last row of each (key, bucket) straight from the input: a column-pruned
    # scan whose partial aggregate leaves one row per (key, bucket) per task,
    # so this branch shuffles almost nothing; then the previous non-empty
    # bucket's last row
    last = x.groupBy(key, b).agg(F.max_by(F.struct(*[F.col(v) for v in values]), ts).alias("_last"))
    carry = last.select(key, b, F.lag("_last", 1).over(Window.partitionBy(key).orderBy(b)).alias("_carry"))
    x = x.join(carry, [key, b], "left")
    for i, (v, o) in enumerate(zip(values, outs)):
        x = x.withColumn(o, F.when(F.col("_is_first"), F.col(f"_carry.{v}")).otherwise(F.col(f"_lag_in{i}")))
    return x.drop(b, "_is_first", "_carry", *[f"_lag_in{i}" for i in range(len(values))])


def running_total(
    df: DataFrame,
    value: str,
    out: str,
    how: str = "sum",
    key: str = "symbol",
    ts: str = "open_time",
    unit: str = "month",
) -> DataFrame:
    """Add ``out`` = running ``sum`` or ``max`` of ``value`` from the first row
    of ``key`` up to this row (inclusive), ordered by ``ts``.

    Equal to ``agg(value) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED
    PRECEDING)`` but computed per (key, bucket) plus a carry of all earlier
    buckets.
    """
    if how not in ("sum", "max"):
        raise ValueError("how must be 'sum' or 'max'")
    agg = F.sum if how == "sum" else F.max
    b = "_bucket"
    x = df.withColumn(b, time_bucket(ts, unit))
    w = Window.partitionBy(key, b).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_run_in", agg(value).over(w))
    tot = x.groupBy(key, b).agg(agg(value).alias("_tot"))
    carry = tot.select(
        key, b,
        agg("_tot").over(Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    x = x.join(carry, [key, b], "left")
    if how == "sum":
        res = F.when(F.col("_carry").isNull(), F.col("_run_in")).when(
            F.col("_run_in").isNull(), F.col("_carry")).otherwise(F.col("_run_in") + F.col("_carry"))
    else:
        res = F.greatest(F.col("_run_in"), F.col("_carry"))
    return x.withColumn(out, res).drop(b, "_run_in", "_carry")


def last_known(
    df: DataFrame,
    value: str,
    out: str,
    key: str = "symbol",
    ts: str = "open_time",
    order: str | None = None,
    unit: str = "month",
) -> DataFrame:
    """Add ``out`` = last non-null ``value`` of ``key`` up to this row (inclusive).

    Equal to ``last(value, ignorenulls) OVER (PARTITION BY key ORDER BY ts,
    order ROWS UNBOUNDED PRECEDING)``; per (key, bucket) window plus the last
    non-null value of the earlier buckets. This is the as-of join primitive.
    """
    b = "_bucket"
    ords = [ts] + ([order] if order else [])
    x = df.withColumn(b, time_bucket(ts, unit))
    w = Window.partitionBy(key, b).orderBy(*ords).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    # one row per non-empty bucket (buckets without a known value must still
    # pass the carry on); the ordering key is null for null values, which
    # max_by skips
    last = x.groupBy(key, b).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*ords))).alias("_last"))
    carry = last.select(key, b, F.last("_last", ignorenulls=True).over(
        Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    x = x.join(carry, [key, b], "left")
    return x.withColumn(out, F.coalesce("_in", "_carry")).drop(b, "_in", "_carry")


def epoch_seconds(ts: str = "open_time"):
    """Seconds since 1970-01-01 of a timestamp_ntz column (no time-zone shift)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def rolling(
    df: DataFrame,
    aggs: dict,
    seconds: int,
    key: str = "symbol",
    ts: str = "open_time",
    bucket_seconds: int = 30 * 86400,
) -> DataFrame:
    """Trailing time-window aggregates ``RANGE BETWEEN seconds PRECEDING AND
    CURRENT ROW`` per key, without one task per key.

    Rows are cut into fixed-width time buckets; each row is also copied into
    the later buckets whose window reaches back to it (the halo), the window
    runs per (key, bucket), and only each bucket's own rows are kept. Exact
    for any window length. ``aggs`` maps output name -> aggregate Column.
    """
    t = epoch_seconds(ts)
    x = df.withColumn("_t", t)
    own = F.floor(F.col("_t") / bucket_seconds)
    last = F.floor((F.col("_t") + seconds) / bucket_seconds)
    x = x.withColumn("_own", own).withColumn("_b", F.explode(F.sequence(own, last)))
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-seconds, 0)
    x = x.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
    return x.where(F.col("_b") == F.col("_own")).drop("_t", "_own", "_b")


def _pair_moments(y: Column, x: Column, over=None) -> Column:
    """State of some rows: complete pairs (n, means, sum of co-deviations), x alone, number of y; zeros where empty."""
    both = y.isNotNull() & x.isNotNull()
    y2, x2 = F.when(both, y), F.when(both, x)
    aggs = {"n": F.count(y2), "my": F.avg(y2), "mx": F.avg(x2), "c": F.covar_pop(y2, x2), "nx": F.count(x), "ax": F.avg(x), "v": F.var_pop(x), "ny": F.count(y)}
    if over is not None:
        aggs = {k: a.over(over) for k, a in aggs.items()}
    num = {k: F.coalesce(a.cast("double"), F.lit(0.0)) for k, a in aggs.items()}
    num["c"], num["v"] = num["c"] * num["n"], num["v"] * num["nx"]
    return F.struct(*[c.alias(k) for k, c in num.items()])


def _merged(a: Column, b: Column) -> Column:
    """State of the rows of two disjoint states."""
    def pooled(n: str):
        total = a[n] + b[n]
        share = F.when(total > 0, b[n] / total).otherwise(0.0)
        return total, share, share * a[n]

    n, s, w = pooled("n")
    nx, sx, wx = pooled("nx")
    step = lambda m, s: a[m] + (b[m] - a[m]) * s
    return F.struct(
        n.alias("n"), step("my", s).alias("my"), step("mx", s).alias("mx"), (a["c"] + b["c"] + (b["my"] - a["my"]) * (b["mx"] - a["mx"]) * w).alias("c"),
        nx.alias("nx"), step("ax", sx).alias("ax"), (a["v"] + b["v"] + (b["ax"] - a["ax"]) * (b["ax"] - a["ax"]) * wx).alias("v"), (a["ny"] + b["ny"]).alias("ny"))


def trailing_moments(df: DataFrame, y: str, x: str, seconds: int, key: str = "symbol", ts: str = "open_time", most: int = 30 * 86400) -> DataFrame:
    """Add ``_m``: the moments of (y, x) over ``RANGE BETWEEN seconds PRECEDING
    AND CURRENT ROW`` per key, in time linear in the rows.

    Time is cut into buckets of ``seconds`` / k, the largest part that is at
    most ``most``. A window is the end of the bucket in which it begins, the
    k - 1 whole buckets between, and the start of the row's own bucket. Every
    row enters twice: at its time, and where it leaves the window (``seconds``
    later, which is exactly k buckets on). Within (key, bucket) a running state
    over rows up to now gives the own part, and one backwards over leaving rows
    from now on gives the oldest part; both only ever grow, so no frame slides
    and nothing is subtracted. States are merged by their centred moments."""
    k = max(1, -(-seconds // most))
    state = x_ = df.withColumn("_t", epoch_seconds(ts))
    both = F.array(F.struct(F.col("_t").alias("_at"), F.lit(True).alias("_own")), F.struct((F.col("_t") + seconds).alias("_at"), F.lit(False).alias("_own")))
    x_ = x_.withColumn("_e", F.explode(both)).select("*", "_e.*").drop("_e")
    x_ = x_.withColumn("_b", F.floor(F.col("_at") * k / F.lit(seconds)))
    by = Window.partitionBy(key, "_b")
    up = by.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    down = by.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    own = lambda c, yes: F.when(F.col("_own") == yes, F.col(c).cast("double"))
    x_ = x_.withColumn("_new", _pair_moments(own(y, True), own(x, True), up)).withColumn("_old", _pair_moments(own(y, False), own(x, False), down))
    x_ = x_.where("_own").withColumn("_m", _merged(F.col("_old"), F.col("_new"))).drop("_new", "_old", "_own", "_at")
    if k > 1:
        whole = state.withColumn("_b", F.floor(F.col("_t") * k / F.lit(seconds))).groupBy(key, "_b").agg(_pair_moments(F.col(y).cast("double"), F.col(x).cast("double")).alias("_s"))
        # a row's own bucket may hold no complete pair but always has a state, so every (key, bucket) is there
        between = F.collect_list("_s").over(Window.partitionBy(key).orderBy("_b").rangeBetween(-(k - 1), -1))
        whole = whole.select(key, "_b", between.alias("_between"))
        x_ = x_.join(whole, [key, "_b"], "left")
        x_ = x_.withColumn("_m", F.aggregate(F.coalesce("_between", F.array().cast(f"array<{_STATE}>")), F.col("_m"), _merged)).drop("_between")
    return x_.drop("_t", "_b")


_STATE = "struct<" + ",".join(f"{c}:double" for c in ("n", "my", "mx", "c", "nx", "ax", "v", "ny")) + ">"


def lagged_values(df: DataFrame, values: list[str], lags: int, key: str = "symbol", ts: str = "open_time", unit: str = "month") -> DataFrame:
    """Add ``<value>_1`` to ``<value>_<lags>``: the values of the previous rows of
    the same key. Within (key, bucket) by a window; the last ``lags`` rows of the
    earlier buckets (a small table) fill the start of each bucket."""
    b = "_bucket"
    x = df.withColumn(b, time_bucket(ts, unit))
    w = Window.partitionBy(key, b).orderBy(ts)
    inner = {f"_{v}_{j}": F.lag(v, j).over(w) for v in values for j in range(1, lags + 1)}
    x = x.select("*", *[c.alias(n) for n, c in inner.items()], F.row_number().over(w).alias("_place"), F.lead(F.lit(1), lags).over(w).isNull().alias("_tail"))
    tails = x.where("_tail").groupBy(key, b).agg(F.sort_array(F.collect_list(F.struct(ts, *values)), asc=False).alias("_last"))
    before = F.collect_list("_last").over(Window.partitionBy(key).orderBy(b).rowsBetween(-lags, -1))
    carry = tails.select(key, b, F.slice(F.flatten(F.reverse(before)), 1, lags).alias("_carry"))
    x = x.join(carry, [key, b], "left")
    for v in values:
        for j in range(1, lags + 1):
            x = x.withColumn(f"{v}_{j}", F.when(F.col("_place") > j, F.col(f"_{v}_{j}")).otherwise(F.get("_carry", F.lit(j) - F.col("_place"))[v]))
    return x.drop(b, "_place", "_tail", "_carry", *inner)
