import pandas as pd
import pytest
from pyspark.sql import functions as F

from daymosaic.schema import as_table, canonical, is_table


def table(spark, rows, columns="pid long, act string, start double, end double"):
    return spark.createDataFrame(rows, columns)


def test_third_time_is_derived_and_rows_are_ordered(spark):
    df = table(spark, [(1, "b", 5.0, 9.0), (1, "a", 0.0, 5.0), (2, "c", 1.0, 1.0)])
    rows = canonical(df).orderBy("pid", "seq").collect()
    assert [(r["act"], r["duration"], r["seq"]) for r in rows] == [("a", 5.0, 1), ("b", 4.0, 2), ("c", 0.0, 1)]
    by_duration = canonical(df.withColumn("duration", F.col("end") - F.col("start")).drop("end"))
    assert by_duration.agg(F.sum("end")).first()[0] == 15.0


def test_ties_keep_input_order_or_the_given_one(spark):
    df = spark.createDataFrame([(1, "x", 0.0, 0.0, 2), (1, "y", 0.0, 4.0, 1)], "pid long, act string, start double, end double, n int").coalesce(1)
    assert [r["act"] for r in canonical(df).orderBy("seq").collect()] == ["x", "y"]
    assert [r["act"] for r in canonical(df, order_col="n").orderBy("seq").collect()] == ["y", "x"]


@pytest.mark.parametrize(("rows", "columns", "message"), [
    ([("a", 0.0)], "act string, start double", "pid"),
    ([(None, "a", 0.0, 1.0)], "pid long, act string, start double, end double", "pid"),
    ([(1, "a", None, 1.0)], "pid long, act string, start double, end double", "start"),
    ([(1, "a", float("nan"), 1.0)], "pid long, act string, start double, end double", "start"),
    ([(1, "a", "0", 1.0)], "pid long, act string, start string, end double", "numeric"),
    ([(1, "a", 2.0, 1.0)], "pid long, act string, start double, end double", "after"),
    ([(1, "a", 0.0, 1.0, 2.0)], "pid long, act string, start double, end double, duration double", "duration"),
])
def test_bad_schedules_are_refused(spark, rows, columns, message):
    with pytest.raises(ValueError, match=message):
        canonical(spark.createDataFrame(rows, columns))


def test_tables_of_other_kinds(spark):
    class Polars:
        def to_pandas(self):
            return pd.DataFrame({"pid": [1], "act": ["a"]})

    assert as_table(Polars(), spark).count() == 1 and is_table(Polars())
    assert as_table(pd.DataFrame({"pid": pd.Series([], dtype="int64")}), spark).schema["pid"].dataType.simpleString() == "bigint"
    with pytest.raises(TypeError):
        as_table([1, 2], spark)
    assert canonical(pd.DataFrame({"pid": [1, 1], "act": ["a", "b"]}), spark=spark).count() == 2
