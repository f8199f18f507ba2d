import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from shelfcast.operators.ordering import exact_quantiles, global_running_totals, ranked_values


def test_running_totals_cross_slices_and_ties(spark):
    # half of the rows share one value: the key cuts that run into slices
    df = spark.range(1000).selectExpr("id as k", "case when id % 2 = 0 then 5L else id % 7 end as v")
    out = global_running_totals(
        df, [F.col("v").desc(), F.col("k").asc()], {"total": F.col("v"), "pos": F.lit(1)}, slices=6
    )
    assert out.columns == ["k", "v", "total", "pos"]
    got = sorted(rows(out), key=lambda r: r[3])
    want = sorted(((r[0], r[1]) for r in rows(df)), key=lambda r: (-r[1], r[0]))
    assert [(r[0], r[1]) for r in got] == want
    assert [r[2] for r in got] == np.cumsum([v for _, v in want]).tolist()


def test_quantiles(spark):
    values = [(i, float((i * 37) % 101)) for i in range(250)]
    df = spark.createDataFrame(values, "k long, v double")
    ranked = ranked_values(df, "v", ["k"])
    assert sorted(r[2] for r in rows(ranked)) == list(range(1, 251))
    cuts = exact_quantiles(ranked, "v", {"q1": 1 / 3, "q2": 2 / 3, "top": 1.0})
    want = np.quantile([v for _, v in values], [1 / 3, 2 / 3, 1.0])
    assert np.allclose([cuts["q1"], cuts["q2"], cuts["top"]], want)
    assert cuts["min_value"] == 0.0 and cuts["max_value"] == 100.0


def test_quantiles_of_nothing(spark):
    ranked = ranked_values(spark.createDataFrame([], "k long, v double"), "v", ["k"])
    assert exact_quantiles(ranked, "v", {"q": 0.5})["q"] is None
