"""Groups of rows: labels, missing values, stable order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tasks import MISSING


def categories(field: T.StructField) -> list | None:
    """The levels of a categorical column in order, from the column's metadata."""
    return (field.metadata or {}).get("categories")


def present(rows: DataFrame, column: str) -> Column:
    """The column with NaN, as missing values are in some sources, as null."""
    kind = rows.schema[column].dataType
    name = F.col(f"`{column}`")
    return F.when(~F.isnan(name), name) if isinstance(kind, (T.FloatType, T.DoubleType)) else name


def label(rows: DataFrame, column: str) -> Column:
    return F.coalesce(present(rows, column).cast("string"), F.lit(MISSING))


def ambiguous(rows: DataFrame, column: str, test: Column) -> Column:
    """Whether, where test holds, some rows are missing and others hold the missing label as a value: an aggregate."""
    value = present(rows, column)
    flag = lambda c: F.coalesce(F.max((test & c).cast("int")), F.lit(0))
    return flag(value.isNull()) + flag(F.coalesce(value.cast("string") == MISSING, F.lit(False))) > 1


def ordered_groups(groups: DataFrame, columns: Sequence[str], levels: Sequence[list | None]) -> DataFrame:
    """group_idx added to groups(key array<string>, missing array<boolean>, first): by the level of each column in turn.

    A categorical's levels come in its order, others by the first row that has them, missing last.
    The window holds a row per group, not per row of the data.
    """
    order = []
    ranked = groups
    for i in range(len(columns)):
        order.append(F.col("missing")[i])
        if levels[i] is None:
            ranked = ranked.withColumn(f"_level{i}", F.min("first").over(Window.partitionBy(F.col("key")[i])))
        else:
            known = F.array(*[F.lit(str(v)) for v in levels[i]]) if levels[i] else F.array().cast("array<string>")
            ranked = ranked.withColumn(f"_level{i}", F.array_position(known, F.col("key")[i]).cast("long"))
        order.append(F.col(f"_level{i}"))
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return ranked.withColumn("group_idx", place.cast("int")).drop(*[f"_level{i}" for i in range(len(columns))])
