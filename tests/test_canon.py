"""Canonical rounding gives identical doubles in Spark and DuckDB."""

import random

import duckdb

from tickstat.functions.canon import round_sig_sql


def test_spark_and_duckdb_round_alike(spark):
    rnd = random.Random(5)
    vals = [0.0, -0.0, 1.0, 10.0, 1e-5, 9.999999999999999e-06, 2571.735625, 123443.31 / 48, 1e15, 3e-17, -2.5e-9]
    for _ in range(5000):
        vals.append(rnd.uniform(-1, 1) * 10 ** rnd.randint(-16, 14))
        vals.append(rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-300, 299))
        vals.append(round(rnd.uniform(0, 1000), rnd.randint(0, 6)) * 10 ** rnd.randint(-6, 3))
    df = spark.createDataFrame(list(enumerate(vals)), "i long, x double")
    s = {r.i: r.y for r in df.selectExpr("i", f"{round_sig_sql('x')} AS y").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    d = dict(con.execute(f"SELECT i, {round_sig_sql('x', dialect='duckdb')} FROM t").fetchall())
    assert s == d
    assert s[7] == 2571.73562  # 2571.735625 is stored just below the tie: both engines round down


def test_small_values_keep_their_digits(spark):
    got = spark.createDataFrame([(3.3e-25,), (1.23456789123e-20,), (4.0e-300,)], "x double").selectExpr(f"{round_sig_sql('x')} AS y").collect()
    for row, want in zip(got, (3.3e-25, 1.23456789e-20, 4.0e-300)):
        assert abs(row.y / want - 1) < 1e-14
