"""Places of doubles against DuckDB's round."""

import duckdb

from cytoloom.functions.scalars import rounded


def test_halves(spark):
    values = [s * (i + 0.5) / 10_000 for i in range(0, 700_000, 997) for s in (1, -1)] + [0.1234449999, 5e-5, 0.0]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.r for r in d.select(rounded("v", 4).alias("r")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    assert got == [r[0] for r in con.execute("SELECT round(v, 4) FROM t ORDER BY i").fetchall()]
    assert spark.createDataFrame([(None,)], "v double").select(rounded("v", 4)).first()[0] is None
