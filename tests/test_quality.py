import pytest
from helpers import rows

from shelfcast.operators import quality


def passed(result):
    return result.first()["passed"]


def test_no_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, value string")
    assert passed(quality.no_nulls(df, ["id"])) and not passed(quality.no_nulls(df, ["id", "value"]))
    assert not passed(quality.no_nulls(df, ["absent"]))
    assert passed(quality.no_nulls(df, []))


def test_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, value string")
    assert not passed(quality.unique(df, ["id"])) and passed(quality.unique(df, ["id", "value"]))
    assert not passed(quality.unique(df, ["absent"]))


def test_references(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (3,), (3,)], "id int")
    assert rows(quality.references(child, parent, "id")) == [(False, 1)]


def test_min_rows(spark):
    df = spark.range(3)
    assert passed(quality.min_rows(df, 3)) and not passed(quality.min_rows(df, 4))
    with pytest.raises(ValueError):
        quality.min_rows(df, -1)


def test_require_names_failures(spark):
    df = spark.createDataFrame([("x", False, 1), ("y", True, 0)], "check_name string, passed boolean, failures long")
    with pytest.raises(ValueError, match="x"):
        quality.require(df)
