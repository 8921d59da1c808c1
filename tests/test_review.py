"""Review tables by hand."""

from cytoloom.operators import programs, review
from cytoloom.sources import tables
from pyspark.sql import functions as F


def test_stage_words(spark):
    d = spark.createDataFrame([(x,) for x in ["pT2b", "T3/T4", "ypT0", "0", "4", "NX", "N 1", "pN0", "yes", "PD", "2.7", None]], "s string")
    read = lambda f: [r[0] for r in d.select(f(F.col("s"))).collect()]
    assert read(lambda c: review.stage_from(c, 3)) == [0, 1, 0, 0, 1, None, 0, 0, None, None, 1, None]
    assert read(review.stage_zero) == [0, 0, 1, 1, 0, None, None, None, None, None, 0, None]
    assert read(review.node_positive) == [None, None, None, 0, 1, None, 1, 0, None, None, 1, None]
    assert read(review.binary) == [None, None, None, 0, 4, None, None, None, 1, 0, 2, None]


def test_clinical_summary(spark):
    rows = [("a", 50.0, 1, 10.0, 1), ("a", 61.0, 0, 20.0, 0), ("a", None, None, 30.0, 1), ("a", 70.0, 1, None, 1), ("b", None, None, 5.0, 0)]
    d = spark.createDataFrame(rows, "cohort string, age double, male int, months double, dead int")
    a, b = sorted(review.clinical_summary(d, "cohort", ["age"], ["male"], {"os": ("months", "dead")}).collect(), key=lambda r: r.cohort)
    assert (a.n, a.age, a.male_evaluable, a.male) == (4, "61.0 (55.5-65.5)", 3, "2 (66.7%)")
    assert (a.os_evaluable, a.os_events, a.os_time, a.os_median) == (3, "2 (66.7%)", "20.0 (15.0-25.0)", "30.0")
    assert (b.age, b.male, b.os_events, b.os_median) == ("NA", "0", "0 (0.0%)", "NR")


def test_alignment_and_metrics(spark):
    base = spark.createDataFrame([("P", None, " x "), ("P", "nan", "y"), ("P", "NA", "y"), ("P", "c", None)], "panel string, cohort string, coord string")
    other = spark.createDataFrame([("x",), (" y",), ("",), (None,)], "coord string")
    got = {r.cohort: (r.n, r.meta, r.all_tables) for r in review.alignment(base, {"meta": other, "qc": other.limit(1)}, ["panel", "cohort"], "coord").collect()}
    assert got == {"NA": (2, "2 (100.0%)", "1 (50.0%)"), "c": (1, "0 (0.0%)", "0 (0.0%)")}
    e = spark.createDataFrame([("k", 0.5), ("k", None), ("k", float("nan")), ("k", 0.7)], "context string, oof double")
    (m,) = review.metric_summary(e, ["context"], ["oof"]).collect()
    assert (m.n, m.n_available, m.missing, m.least, m.median, m.most) == (4, 2, 0.5, 0.5, 0.6, 0.7)


def test_manifest_and_frozen(spark):
    d = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2)], "context string, x int")
    assert [tuple(r) for r in tables.array_index(d, ["context"]).orderBy("array_id").collect()] == [(0, "a", 1), (1, "b", 2)]
    other = spark.createDataFrame([("b", 2), ("b", 1), ("c", 1)], "context string, x int")
    assert {tuple(r) for r in programs.frozen_differences(d, other, ["context"]).collect()} == {("a", "new"), ("b", "same"), ("c", "missing")}
