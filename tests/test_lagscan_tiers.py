"""The scan of all lags against the expanded study, and tiers from ranks with validity against a plain lookup."""

import datetime as dt
import math
import tempfile

import numpy as np
import pytest

from tickstat.operators import shock as K
from tickstat.operators.lagscan import lag_scan
from tickstat.operators.tiers import ranked_tiers, ranks_of, valid_at
from tickstat.plans.cli import _ints
from tickstat.sources.marketcap import read_market_caps, write_market_caps

START = dt.datetime(2024, 1, 31, 22, 0)
BARS = "symbol string, open_time timestamp_ntz, parkinson_var_1m double, amihud_illiq double"


def _study(spark, seed, n=400, keep=0.8, odd=True):
    rng = np.random.default_rng(seed)
    at = [START + dt.timedelta(minutes=i) for i in range(n)]
    cal = [(t, int(rng.random() < 0.1)) for i, t in enumerate(at) if rng.random() < keep and not 100 <= i < 190]  # a long gap
    cal += [(START + dt.timedelta(minutes=7, seconds=30), 1)]  # off the grid
    rows = []
    for s in ("A-B", "C-D", "E-F"):
        for i in range(-20, n + 60):
            if rng.random() < 0.7:
                t = START + dt.timedelta(minutes=i, seconds=30 if rng.random() < 0.02 else 0)
                v, w = (None if rng.random() < 0.1 else float(x) for x in rng.lognormal(0, 2, 2))
                if odd and s == "C-D" and rng.random() < 0.01:
                    v = float(rng.choice([math.nan, math.inf, -math.inf]))
                rows.append((s, t, v, w))
    rows += rows[:5]  # repeated rows count each
    return (spark.createDataFrame(rows, BARS).repartition(5),
            spark.createDataFrame(cal, "open_time timestamp_ntz, any_shock int").repartition(3))


def _rows(df):
    return {(r.symbol, r.lag): tuple(r)[2:] for r in df.collect()}


@pytest.mark.parametrize("seed,keep,least,broadcast", [(1, 0.9, -1, 10**6), (2, 0.3, 2, 10**6), (3, 0.9, 2, 0)])
def test_lag_scan_equals_the_expanded_study(spark, seed, keep, least, broadcast):
    frame, cal = _study(spark, seed, keep=keep)
    p = K.ShockParams(lags=tuple(range(0, 131, 1 if seed == 1 else 2)), min_shock=least, min_noshock=least, max_broadcast_rows=broadcast)
    got, wanted = _rows(lag_scan(frame, p, cal)), _rows(K.lag_effects(frame, p, cal))
    assert got.keys() == wanted.keys() and got
    for k in wanted:
        for a, b in zip(got[k], wanted[k]):
            assert (a is None) == (b is None), k
            assert a is None or (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12 * abs(b) + 1e-9), (k, a, b)


def test_lag_scan_of_empty_tables_and_repeated_lags(spark):
    frame, cal = _study(spark, 4, n=60)
    p = K.ShockParams(lags=(3, 0, 3), min_shock=-1, min_noshock=-1)
    assert lag_scan(frame.limit(0), p, cal).collect() == [] == lag_scan(frame, p, cal.limit(0)).collect()
    once = _rows(K.lag_effects(frame, K.ShockParams(lags=(0, 3), min_shock=-1, min_noshock=-1), cal))
    assert {k: v[4:6] for k, v in _rows(lag_scan(frame, p, cal)).items()} == {k: v[4:6] for k, v in once.items()}


def test_lag_scan_expands_rows_by_events_not_by_lags(spark):
    """With a whole calendar and one shock in a hundred, a row meets about 1 + lags / 100 events."""
    from tickstat.operators.lagscan import lag_events

    n = 2000
    cal = spark.createDataFrame([(START + dt.timedelta(minutes=i), int(i % 100 == 0)) for i in range(n)], "open_time timestamp_ntz, any_shock int")
    sizes = [len(r.events) for r in lag_events(cal, list(range(121)), "minutes").collect()]
    inner = sorted(sizes)[:-240]  # 120 times at either end miss calendar rows
    assert len(sizes) == n + 120 and max(inner) <= 4 and max(sizes) <= 122


def test_lag_ranges_of_the_command_line():
    assert _ints("0,5,10-12") == (0, 5, 10, 11, 12) and _ints("") == () and _ints("-3") == (-3,)


def _plain(bars, ranks):
    out = []
    for s, a, t in bars:
        held = None
        if a is not None and t is not None:
            begun = [r for r in ranks if r[0] == a and r[1] is not None and (r[2] is None or r[2] > r[1]) and r[1] <= t]
            if begun:
                last = max(r[1] for r in begun)
                held = min((r for r in begun if r[1] == last), key=lambda r: (r[4] is None, r[4]))
                held = None if held[2] is not None and t >= held[2] else held
        out.append((s, a, t, held and held[3], held and held[4]))
    return out


RANKS = "base_asset string, valid_from timestamp_ntz, valid_to timestamp_ntz, market_cap double, cap_rank long"


def test_valid_at_equals_a_plain_lookup(spark):
    rng = np.random.default_rng(5)
    day = lambda i: dt.datetime(2023, 12, 20) + dt.timedelta(hours=int(i))
    ranks = [("A", day(0), day(50 * 24), 9.0, 1), ("A", day(10 * 24), day(12 * 24), 8.0, 2), ("A", day(60 * 24), None, 7.0, 3), ("A", day(80 * 24), day(81 * 24), 6.0, 4),
             ("B", day(5 * 24), day(5 * 24), 1.0, 1), ("B", day(30 * 24), day(400 * 24), 2.0, 7), ("B", day(30 * 24), day(33 * 24), 3.0, 5),
             (None, day(0), None, 1.0, 1), ("C", None, None, 1.0, 1), ("D", day(9000 * 24), None, 1.0, 1)]
    bars = [("s", a, None if rng.random() < 0.02 else day(rng.integers(-100, 100 * 24))) for a in ("A", "B", "C", "D", None) for _ in range(120)]
    bars += bars[:4] + [("s", "A", day(50 * 24)), ("s", "A", day(12 * 24)), ("s", "A", day(60 * 24)), ("s", "B", day(33 * 24))]
    got = valid_at(spark.createDataFrame(bars, "symbol string, base_asset string, open_time timestamp_ntz"), spark.createDataFrame(ranks, RANKS)).collect()
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    assert sorted((tuple(r) for r in got), key=lambda r: str(key(r))) == sorted(_plain(bars, ranks), key=lambda r: str(key(r)))


def test_valid_at_of_empty_tables_and_clashing_columns(spark):
    bars = spark.createDataFrame([("A", START, 5.0, 1)], "base_asset string, open_time timestamp_ntz, market_cap double, valid_from int")
    none = spark.createDataFrame([], RANKS)
    assert [tuple(r) for r in ranked_tiers(bars, none).select("base_asset", "valid_from", "market_cap", "cap_rank", "tier3").collect()] == [("A", 1, None, None, "SMALL_CAP")]
    assert valid_at(bars.limit(0), spark.createDataFrame([("A", START, None, 1.0, 1)], RANKS)).collect() == []
    with pytest.raises(ValueError):
        ranked_tiers(bars, none, 30, 10)


def test_market_cap_files_and_ranks(spark):
    d = tempfile.mkdtemp(prefix="tickstat-test-", dir="/tmp")
    for name, lines in {"2024-01-01.csv": "base_asset,market_cap\nbtc,100\n ETH ,50\nADA,50\nBTC,90\nXRP,\nBAD,-1\nBAD,NaN\n,5\n", "2024-02-01.csv": "base_asset,market_cap\nETH,70\nBTC,60\n", "notes.csv": "base_asset,market_cap\nSOL,1\n"}.items():
        with open(f"{d}/{name}", "w") as f:
            f.write(lines)
    snaps = read_market_caps(spark, d)
    ranks = sorted((r.base_asset, r.valid_from.date().isoformat(), r.valid_to.date().isoformat(), r.market_cap, r.cap_rank) for r in ranks_of(snaps, 40).collect())
    assert ranks == [("ADA", "2024-01-01", "2024-02-10", 50.0, 2), ("BTC", "2024-01-01", "2024-02-01", 100.0, 1), ("BTC", "2024-02-01", "2024-03-12", 60.0, 2), ("ETH", "2024-01-01", "2024-02-01", 50.0, 3), ("ETH", "2024-02-01", "2024-03-12", 70.0, 1)]
    write_market_caps(snaps, f"{d}/again")
    assert sorted(map(tuple, read_market_caps(spark, f"{d}/again").collect())) == sorted(map(tuple, snaps.collect()))
    bars = spark.createDataFrame([("ETH", dt.datetime(2024, 1, 15)), ("ETH", dt.datetime(2024, 2, 15)), ("ADA", dt.datetime(2024, 2, 15)), ("ETH", dt.datetime(2023, 12, 31))], "base_asset string, open_time timestamp_ntz")
    tiers = sorted((r.base_asset, r.open_time.isoformat()[:10], r.tier3) for r in ranked_tiers(bars, ranks_of(snaps, 40), 1, 3).collect())
    assert tiers == [("ADA", "2024-02-15", "SMALL_CAP"), ("ETH", "2023-12-31", "SMALL_CAP"), ("ETH", "2024-01-15", "MID_CAP"), ("ETH", "2024-02-15", "LARGE_CAP")]
