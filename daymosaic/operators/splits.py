"""Splits: attributes unpivoted to (pid, label, cat), numeric columns binned with edges of the observed population."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of ordinal bins, lowest first.
ORDINAL = ("lowest", "low", "mid", "high", "highest")
#: Whole-number columns with more distinct values than this are binned.
FEW = 10


def numeric_edges(attributes: DataFrame, split_on: list[str]) -> dict[str, list[float]]:
    """Inner edges of each numeric split column: quintiles, without repeats; a warning names the column."""
    kinds = {c: attributes.schema[c].dataType for c in split_on}
    fractional = {c for c, k in kinds.items() if isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType))}
    whole = [c for c, k in kinds.items() if isinstance(k, T.IntegralType)]
    if whole:
        distinct = attributes.agg(*[F.count_distinct(c).alias(c) for c in whole]).first()
        fractional |= {c for c in whole if distinct[c] > FEW}
    if not fractional:
        return {}
    chosen = [c for c in split_on if c in fractional]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = attributes.agg(*[F.percentile(value(c), F.array(*[F.lit(i / 5) for i in range(6)])).alias(c) for c in chosen]).first()
    edges = {}
    for c in chosen:
        cuts = sorted(set(found[c] or []))
        if len(cuts) < 2:  # one value only: five equal parts around it
            low = cuts[0] if cuts else 0.0
            spread = abs(low) * 0.001 or 0.001
            cuts = [low - spread + 2 * spread * i / 5 for i in range(6)]
        edges[c] = cuts[1:-1]
        names = list(ORDINAL[: len(cuts) - 1])
        warnings.warn(f"split column '{c}' is numeric; it is binned into {names}. Use a categorical column to avoid this.", UserWarning, stacklevel=3)
    return edges


def category(column: str, edges: dict[str, list[float]]) -> Column:
    """A split column as text; binned (right-closed, open ends) if it has edges, where missing values are 'nan'."""
    if column not in edges:
        return F.col(column).cast("string")
    x, out = F.col(column).cast("double"), F.lit(ORDINAL[len(edges[column])])
    for i in reversed(range(len(edges[column]))):
        out = F.when(x <= edges[column][i], ORDINAL[i]).otherwise(out)
    return F.when(x.isNull() | F.isnan(x), "nan").otherwise(out)


def unpivoted(attributes: DataFrame, split_on: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """(pid, label, cat); rows without a category are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), category(c, edges).alias("cat")) for c in split_on])
    return attributes.select("pid", F.explode(pairs).alias("s")).select("pid", "s.label", "s.cat").where("cat is not null")
