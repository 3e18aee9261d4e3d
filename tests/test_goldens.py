"""Golden values from FIXTURES.md (computed there with DuckDB) and the
time-shift property of SURVEY section 5."""


from pyspark.sql import functions as F

from tickstat.functions.symbols import LARGE_CAP_TWO
from tickstat.operators import stress as S
from tickstat.operators.features import bar_features
from tickstat.plans.catalog import features_d
from tickstat.sources.fixtures import daily_bars


def test_stress_goldens_sf001(spark, sf_mid):
    f = features_d(spark, sf_mid)
    assert f.count() == 38372
    p = S.StressParams(exact=True, large_caps=LARGE_CAP_TWO)  # the goldens are those of the two-asset tier
    assert S.stress_threshold(f, p) == 3.2772627313515983
    sizes = {(r.tier, r.is_stress): r.n_bars for r in S.stress_compare(f, p).collect()}
    assert sizes == {("LARGE_CAP", False): 4297, ("LARGE_CAP", True): 230, ("LARGE_CAP", None): 249,
                     ("SMALL_CAP", False): 27244, ("SMALL_CAP", True): 1449, ("SMALL_CAP", None): 4903}
    days = S.stress_days(f, p)
    assert days.count() == 2136 and days.where("is_stress").count() == 107


def test_shift_by_whole_days_keeps_metrics(spark, sf_small):
    bars = daily_bars(spark, sf_small)
    shifted = bars.withColumn("open_time", F.timestamp_add("DAY", F.lit(45), F.col("open_time")))
    p = S.StressParams(exact=True)
    a = {(r.tier, r.is_stress): r for r in S.stress_compare(bar_features(bars), p).collect()}
    b = {(r.tier, r.is_stress): r for r in S.stress_compare(bar_features(shifted), p).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c, u in a[k].asDict().items():
            v = b[k][c]
            assert u == v or (isinstance(u, float) and abs(u - v) <= 1e-9 * max(1.0, abs(u))), (k, c)
