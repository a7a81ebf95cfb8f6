"""The canonical schedule table: pid, act, start, end, duration, seq."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TIMES = ("start", "end", "duration")
#: Stands for the population that models are compared with.
OBSERVED = "observed"
#: Tolerances of duration against end - start.
ABSOLUTE, RELATIVE = 1e-6, 1e-5


def is_table(x: object) -> bool:
    """Whether x can be used as a table."""
    return isinstance(x, DataFrame) or hasattr(x, "to_pandas") or type(x).__module__.startswith("pandas.")


def as_table(x: object, spark: SparkSession | None = None) -> DataFrame:
    """A Spark DataFrame from a Spark, pandas, or pandas-convertible table."""
    if isinstance(x, DataFrame):
        return x
    if not is_table(x):
        raise TypeError(f"a Spark, pandas or polars DataFrame is needed, not {type(x).__name__}")
    spark = spark or SparkSession.active()
    pdf = x if type(x).__module__.startswith("pandas.") else x.to_pandas()
    if not len(pdf.columns):
        raise ValueError("a table without columns")
    if not len(pdf):
        kinds = {"i": "long", "f": "double", "b": "boolean"}
        return spark.createDataFrame([], ", ".join(f"`{c}` {kinds.get(pdf[c].dtype.kind, 'string')}" for c in pdf.columns))
    return spark.createDataFrame(pdf)


def canonical(schedules: object, order_col: str | None = None, validate: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """Validated schedules, one row per episode, with seq: the episode's place in its schedule, from 1.

    Two of start, end and duration give the third. Episodes are ordered by start, ties by order_col or the input's
    order; without start, by order_col or the input's order alone. Raises ValueError on missing or null pids, null or
    non-numeric times, start after end, and durations that differ from end - start.
    """
    df = as_table(schedules, spark)
    if "pid" not in df.columns:
        raise ValueError("schedules are missing required column 'pid'")
    given = [c for c in TIMES if c in df.columns]
    for c in given:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError(f"column '{c}' must be numeric, not {df.schema[c].dataType.simpleString()}")
    # NaN counts as missing in numeric input.
    value = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in given}
    null = F.lit(None).cast("double")
    start, end, duration = (value.get(c) for c in TIMES)
    out = {
        "start": start if start is not None else (end - duration if end is not None and duration is not None else null),
        "end": end if end is not None else (start + duration if start is not None and duration is not None else null),
        "duration": duration if duration is not None else (end - start if start is not None and end is not None else null),
    }
    act = F.col("act").cast("string") if "act" in df.columns else F.lit(None).cast("string")
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = df.select("pid", act.alias("act"), *[out[c].alias(c) for c in TIMES], order.alias("order"), *[value[c].isNull().alias(f"no_{c}") for c in given])
    if validate:
        _check(rows, given)
    by = ["start", "order"] if start is not None else ["order"]
    seq = F.row_number().over(Window.partitionBy("pid").orderBy(*by))
    return rows.select("pid", "act", *TIMES, seq.alias("seq"))


def _check(rows: DataFrame, given: Sequence[str]) -> None:
    """One aggregate over the input for all checks."""
    span = F.col("end") - F.col("start")
    checks = {"null 'pid' values": F.col("pid").isNull() | (F.isnan("pid") if isinstance(rows.schema["pid"].dataType, (T.FloatType, T.DoubleType)) else F.lit(False))}
    checks |= {f"missing values in '{c}'": F.col(f"no_{c}") for c in given}
    if len(given) == 3:
        checks["'duration' that differs from end - start"] = F.abs(F.col("duration") - span) > ABSOLUTE + RELATIVE * F.abs(span)
    checks["'start' after 'end'"] = F.col("start") > F.col("end")
    found = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(str(i)) for i, c in enumerate(checks.values())]).first()
    for what, n in zip(checks, found, strict=True):
        if n:
            raise ValueError(f"schedules have {what} in {n} row(s)")


def population(tables: dict[str, DataFrame]) -> DataFrame:
    """Canonical tables of several models as one long table with a model column."""
    parts = [df.withColumn("model", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        if out.schema["pid"].dataType != p.schema["pid"].dataType:
            out, p = (x.withColumn("pid", F.col("pid").cast("string")) for x in (out, p))
        out = out.unionByName(p)
    return out
