"""D4 over every lag from 0 to a maximum in one pass (``lag_scan``).

``lag_effects`` expands each receiver row once per lag, which suits the seven
lags of the standard study. A scan of all lags up to two hours would expand it
121 times. Shocks are rare and calendar gaps are rarer, so here a receiver row
only meets what is *not* calm:

1. The calendar (one row per time unit) is turned round: for each receiver time
   ``t`` two bit maps over the lags say where ``t - lag`` was a shock and where
   the calendar has a row at all. Only the calendar is expanded by lag; the
   partial aggregate (``bit_or``) folds it before the shuffle.
2. Each bit map becomes a short list of events: one entry for the total, one per
   lag in shock, one per lag without a calendar row. Where more than half of
   the lags have no row (edges, long gaps) the lags that have one are listed
   instead, so a list never holds more than about as many entries as lags.
3. Receivers meet the lists by time (broadcast behind a check of rows and
   entries, else one shuffle), are expanded by their few events and summed per
   (symbol, event) with partial aggregation.
4. calm = total - shock - absent (+ listed calm), on at most one row per symbol
   and lag.

Results equal ``lag_effects``. Means of calm rows come from a difference of
sums: their error is about 1e-16 times total / calm. Rows with a value that is
not finite are listed one by one, so that they never spoil a difference. Lags
may be repeated or in any order (each counts once); the calendar holds one row
per time; a null ``any_shock`` counts as no row. Receivers without any calendar
row at their lags, and empty tables, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstat.operators.shock import UNITS, ShockParams, keep_reliable, receivers, shock_calendar
from tickstat.sources.shared import stored

_WORD = 62  # lags per bit map word
# event codes: 8 * (position of the lag + 1) + kind; the total has position 0
_TOTAL, _SHOCK, _ABSENT, _SHOCK_LISTED, _CALM_LISTED = range(5)


def lag_events(calendar: DataFrame, lags: list[int], unit: str) -> DataFrame:
    """(open_time, events, dense) for each time with a calendar row at one of its lags."""
    words = range((len(lags) + _WORD - 1) // _WORD)
    bit = F.expr(f"shiftleft(1L, CAST(_i % {_WORD} AS INT))")
    moved = calendar.where(F.col("any_shock").isin(0, 1)).select(
        "open_time", "any_shock", F.posexplode(F.array(*[F.lit(x) for x in lags])).alias("_i", "_lag"))
    moved = moved.select(F.timestamp_add(UNITS[unit], F.col("_lag"), F.col("open_time")).alias("open_time"), "any_shock", "_i")
    here = [F.coalesce(F.bit_or(F.when(F.floor(F.col("_i") / _WORD) == w, bit)), F.lit(0).cast("long")) for w in words]
    shock = [F.coalesce(F.bit_or(F.when((F.floor(F.col("_i") / _WORD) == w) & (F.col("any_shock") == 1), bit)), F.lit(0).cast("long"))
             for w in words]
    maps = moved.groupBy("open_time").agg(F.array(*here).alias("_here"), F.array(*shock).alias("_shock"))

    def is_set(words_: str, i: Column) -> Column:
        return F.getbit(F.get(F.col(words_), F.floor(i / _WORD).cast("int")), (i % _WORD).cast("int")) == 1

    def code(kind: int):
        return lambda i: ((i + 1) * 8 + kind).cast("int")

    positions = F.array(*[F.lit(i) for i in range(len(lags))])
    lists = maps.select(
        "open_time",
        F.filter(positions, lambda i: is_set("_shock", i)).alias("_s"),
        F.filter(positions, lambda i: ~is_set("_here", i)).alias("_a"),
        F.filter(positions, lambda i: is_set("_here", i) & ~is_set("_shock", i)).alias("_c"))
    dense = F.size("_a") * 2 <= len(lags)
    few = F.concat(F.array(F.lit(_TOTAL)), F.transform("_s", code(_SHOCK)), F.transform("_a", code(_ABSENT)))
    listed = F.concat(F.transform("_s", code(_SHOCK_LISTED)), F.transform("_c", code(_CALM_LISTED)))
    return lists.select("open_time", F.when(dense, few).otherwise(listed).alias("events"), dense.alias("dense"))


def _all_listed(events: Column, n: int) -> Column:
    """The listed form of a dense list: every lag with a calendar row, one by one."""
    def one(p: Column) -> Column:
        return (F.when(F.array_contains(events, p * 8 + _SHOCK), p * 8 + _SHOCK_LISTED)
                .when(~F.array_contains(events, p * 8 + _ABSENT), p * 8 + _CALM_LISTED))

    return F.filter(F.transform(F.array(*[F.lit(i + 1) for i in range(n)]), one), lambda c: c.isNotNull())


def _finite(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(True))


def lag_scan(features: DataFrame, p: ShockParams = ShockParams(lags=tuple(range(121))), calendar: DataFrame | None = None) -> DataFrame:
    """M11 for many lags: the rows of ``lag_effects``, without expanding each receiver row by every lag."""
    if p.unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    lags = sorted({int(x) for x in p.lags})
    cal = calendar if calendar is not None else stored(shock_calendar(features, p), "calendar")
    lists = stored(lag_events(cal, lags, p.unit), "lag-events")
    size = lists.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("e")).first()
    if size["n"] <= p.max_broadcast_rows and size["e"] <= 8 * p.max_broadcast_rows:
        lists = F.broadcast(lists)
    values = ("parkinson_var_1m", "amihud_illiq")
    rows = receivers(features, p).join(lists, "open_time")
    exact = F.col("dense") & ~(_finite(values[0]) & _finite(values[1]))
    event = F.explode(F.when(exact, _all_listed(F.col("events"), len(lags))).otherwise(F.col("events")))
    rows = rows.select("symbol", *values, event.alias("_e")).select("symbol", *values, (F.col("_e") % 8).alias("_kind"), F.floor(F.col("_e") / 8).cast("int").alias("_p"))

    shock = F.col("_kind").isin(_SHOCK, _SHOCK_LISTED)
    off = F.when(F.col("_kind").isin(_SHOCK, _ABSENT), 1).when(F.col("_kind").isin(_TOTAL, _CALM_LISTED), -1)
    sums = [F.count_if(shock).alias("n"), F.coalesce(F.sum(off), F.lit(0)).alias("n_off")]
    for i, v in enumerate(values):
        held = F.col(v).isNotNull()
        sums += [F.coalesce(F.sum(F.when(shock, F.col(v))), F.lit(0.0)).alias(f"s{i}"), F.count_if(shock & held).alias(f"c{i}"),
                 F.coalesce(F.sum(off * F.col(v)), F.lit(0.0)).alias(f"s{i}_off"), F.coalesce(F.sum(F.when(held, off)), F.lit(0)).alias(f"c{i}_off")]
    names = ["n", "n_off"] + [f"{k}{i}{o}" for i in range(2) for o in ("", "_off") for k in ("s", "c")]
    per = rows.groupBy("symbol", "_p").agg(*sums)
    # at most one entry per lag and symbol
    maps = per.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("_p", F.struct(*names).alias("x")))).alias("_m"))
    each = maps.select("symbol", F.posexplode(F.array(*[F.lit(x) for x in lags])).alias("_i", "lag"), F.col("_m")[0].alias("_all"), "_m")
    each = each.select("symbol", "lag", "_all", F.col("_m")[F.col("_i") + 1].alias("_one"))

    def of(name: str) -> Column:
        return F.coalesce(F.col("_one")[name], F.lit(0))

    def calm(name: str) -> Column:
        return -F.coalesce(F.col("_all")[f"{name}_off"], F.lit(0)) - of(f"{name}_off")

    def mean(total: Column, count: Column) -> Column:
        return F.when(count > 0, total / count)

    out = each.select(
        "symbol", "lag",
        mean(of("s0"), of("c0")).alias("vol_on_shock"), mean(calm("s0"), calm("c0")).alias("vol_on_noshock"),
        mean(of("s1"), of("c1")).alias("illiq_on_shock"), mean(calm("s1"), calm("c1")).alias("illiq_on_noshock"),
        of("n").alias("n_shock_obs"), calm("n").alias("n_noshock_obs"))
    return keep_reliable(out.where(F.col("n_shock_obs") + F.col("n_noshock_obs") > 0), p)
