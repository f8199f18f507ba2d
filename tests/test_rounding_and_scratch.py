from types import SimpleNamespace

import pytest
from helpers import day

from shelfcast.operators import evaluate
from shelfcast.plans import catalog
from shelfcast.session import scratch_folder


def test_results_keep_large_infinite_and_undefined_values(spark):
    df = spark.createDataFrame([(5e13, float("inf"), float("nan"), 1.23456789, None)], "a double, b double, c double, d double, e double")
    r = catalog._rounded(df).first()
    assert (r.a, r.b, r.d, r.e) == (5e13, float("inf"), 1.234568, None) and r.c != r.c


def test_rows_without_a_year_stay_in_their_range(spark):
    rows = [(day(0), 2025), (day(1), None), (day(400), None)]
    df = spark.createDataFrame(rows, "date long, year int")
    assert sorted(r.date for r in evaluate.between_days(df, day(0), day(5)).collect()) == [day(0), day(1)]


def test_no_machine_local_scratch_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(SimpleNamespace(sparkContext=context, conf=conf))
