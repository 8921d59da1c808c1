"""The feature fact that queries read: sums that don't follow the order of rows."""

import functools
import itertools
import math
import operator

from cytoloom.plans.registry import Tables


def test_discounts_add_up_exactly(spark, tmp_path):
    orders = list(itertools.permutations([0.1, 0.2, 0.3, 0.4])) + [(0.1,) * 10, (0.5, float("nan")), (0.5, None), (None, None)]
    assert len({functools.reduce(operator.add, x) for x in orders[:25]}) > 1  # as doubles
    rows = [(i, 1, 1.0, d) for i, ds in enumerate(orders) for d in ds]
    spark.createDataFrame([(1, "B")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.patient_id: r.value for r in Tables(spark, str(tmp_path)).features().where("feature = 'disc_B'").collect()}
    assert {got[i] for i in range(25)} == {1.0} and math.isnan(got[25]) and got[26] == 0.5 and got[27] is None
