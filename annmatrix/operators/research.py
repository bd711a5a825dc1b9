"""Descriptive summaries of aggregated results, cohorts by value, and regions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared_scan import AggregateResult
from ..sources.matrix import Matrix


def quantile_cohorts(values: DataFrame, value: str, labels: Sequence[str], column: str = "cohort") -> DataFrame:
    """A label by which of equal shares a value falls in: thresholds are exact, linearly interpolated quantiles; a value on one belongs below.

    The column's metadata has the labels in order, as a categorical's.
    """
    n = len(labels)
    cuts = values.agg(F.expr(f"percentile(`{value}`, array({', '.join(f'{i}D/{n}' for i in range(1, n))}))").alias("_cuts"))
    met = values.crossJoin(F.broadcast(cuts))
    out: Column = F.lit(labels[-1])
    for i in range(n - 2, -1, -1):
        out = F.when(F.col(value) <= F.col("_cuts")[i], labels[i]).otherwise(out)
    return met.withColumn(column, out.alias(column, metadata={"categories": list(labels), "ordered": True})).drop("_cuts")


def contrast(result: AggregateResult, column: str, reference: Any, comparison: Any, metric: str = "mean") -> DataFrame:
    """feature_pos, feature, comparison_mean, reference_mean, mean_difference: unweighted means over groups of each arm.

    A group without entries of a feature counts as zero there.
    """
    arm = F.col(f"`{column}`").cast("string")
    sizes = result.groups.agg(F.count_if(arm == str(reference)).alias("_r"), F.count_if(arm == str(comparison)).alias("_c"))
    if not all(sizes.first()):
        raise ValueError(f"comparison requires groups for {reference!r} and {comparison!r}")
    met = result.stats.join(F.broadcast(result.groups.select(F.col("group_idx").alias("_g"), arm.alias("_arm"))), F.col("group_idx") == F.col("_g"))
    sums = met.groupBy("feature_pos").agg(*[F.coalesce(F.sum(F.when(F.col("_arm") == str(v), F.col(metric))), F.lit(0.0)).alias(n) for n, v in (("_rs", reference), ("_cs", comparison))])
    full = result.features.join(sums, "feature_pos", "left").crossJoin(F.broadcast(sizes))
    full = full.select("feature_pos", "feature", (F.coalesce("_cs", F.lit(0.0)) / F.col("_c")).alias("comparison_mean"), (F.coalesce("_rs", F.lit(0.0)) / F.col("_r")).alias("reference_mean"))
    return full.withColumn("mean_difference", F.col("comparison_mean") - F.col("reference_mean"))


def top_features(table: DataFrame, column: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows of the greatest or least values; ties by the features' order."""
    return table.orderBy(F.desc(column) if largest else F.asc(column), "feature_pos").limit(k)


def matched_response(result: AggregateResult, strata: Sequence[str], arm: str, control: Any, treatment: Any) -> DataFrame:
    """feature_pos, feature, mean_matched_difference, positive_pair_fraction, n_pairs.

    For each stratum, the treated mean less the control mean; then unweighted
    over strata.  A stratum without both arms is an error.  result needs the metric sum or mean.
    """
    groups = result.groups.select("group_idx", *[F.col(f"`{s}`") for s in strata], F.col(f"`{arm}`").cast("string").alias("_arm"), "n_cells")
    sides = []
    for n, v in (("c", control), ("t", treatment)):
        own = groups.where(F.col("_arm") == str(v))
        sides.append(own.select(F.struct(*strata).alias(f"_{n}s"), F.col("group_idx").alias(f"_{n}g"), F.col("n_cells").alias(f"_{n}n")))
    pairs = sides[0].join(sides[1], F.col("_cs") == F.col("_ts"), "full")
    if not pairs.where("_cs is null or _ts is null").isEmpty():
        raise ValueError(f"some strata lack {control!r} or {treatment!r}")
    mean = F.col("mean") if "mean" in result.task.metrics else F.col("sum") / F.col("n")
    sizes = groups.select(F.col("group_idx").alias("_i"), F.col("n_cells").alias("n"))
    means = result.stats.join(F.broadcast(sizes), F.col("group_idx") == F.col("_i")).select("group_idx", "feature_pos", mean.alias("m"))
    grid = pairs.crossJoin(F.broadcast(result.features))
    c, t = (means.select(F.col("group_idx").alias(f"_{n}i"), F.col("feature_pos").alias(f"_{n}f"), F.col("m").alias(f"_{n}m")) for n in "ct")
    grid = grid.join(c, (F.col("_cg") == F.col("_ci")) & (F.col("feature_pos") == F.col("_cf")), "left")
    grid = grid.join(t, (F.col("_tg") == F.col("_ti")) & (F.col("feature_pos") == F.col("_tf")), "left")
    grid = grid.withColumn("d", F.coalesce("_tm", F.lit(0.0)) - F.coalesce("_cm", F.lit(0.0)))
    return grid.groupBy("feature_pos", "feature").agg(F.avg("d").alias("mean_matched_difference"), F.avg((F.col("d") > 0).cast("double")).alias("positive_pair_fraction"), F.count(F.lit(1)).alias("n_pairs"))


def matched_strata(obs: DataFrame, strata: Sequence[str], arm: str, control: Any, treatment: Any) -> DataFrame:
    """The strata that hold rows of both arms."""
    sides = [obs.where(F.col(f"`{arm}`") == F.lit(v)).select(*[F.col(f"`{s}`") for s in strata]) for v in (control, treatment)]
    return sides[0].intersect(sides[1])


def top_per_group(result: AggregateResult, metric: str, k: int) -> DataFrame:
    """group_idx, rank, feature, value of the k greatest features of every group; ties by the features' order, zeros included."""
    table = result.dense()
    rank = F.row_number().over(Window.partitionBy("group_idx").orderBy(F.desc(metric), "feature_pos"))
    return table.withColumn("rank", rank).where(F.col("rank") <= k).select("group_idx", "rank", "feature_pos", "feature", F.col(metric).alias("value"))


def largest_groups(obs: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return obs.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def min_max(points: DataFrame, *columns: str) -> DataFrame:
    """The columns brought to 0..1 by one global aggregation; a constant column becomes 0."""
    ends = points.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    met = points.crossJoin(F.broadcast(ends))
    for c in columns:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        met = met.withColumn(c, F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0))
    return met.select(*points.columns)


def rectangle_membership(points: DataFrame, regions: Sequence[tuple[str, float, float, float, float]], x: str = "x", y: str = "y", id_col: str = "_id") -> DataFrame:
    """cell_id, roi of the points inside rectangles (name, x0, x1, y0, y1), bounds included; a point may be in several.

    The rectangles are a short list, evaluated per row: no join.
    """
    inside = [F.when(F.col(x).between(x0, x1) & F.col(y).between(y0, y1), F.lit(name)) for name, x0, x1, y0, y1 in regions]
    found = F.filter(F.array(*inside), lambda r: r.isNotNull())
    return points.select(F.col(id_col).alias("cell_id"), F.explode(found).alias("roi"))


def first_by_symbol(var: DataFrame, symbol: str) -> DataFrame:
    """symbol, _id: the first feature of each symbol."""
    return var.groupBy(F.col(f"`{symbol}`").alias("symbol")).agg(F.min_by("_id", "_pos").alias("_id"))


def normalized(matrix: Matrix, target: float = 1e4, log: bool = True) -> Matrix:
    """Entries scaled so that each row adds up to target, then log(1 + x); rows without entries stay empty.

    For packed rows this is done inside the row.
    """
    if matrix.kind == "coo":
        matrix = matrix.packed()
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double"))
    scale = F.when(F.col("_total") != 0, F.lit(float(target)) / F.col("_total")).otherwise(F.lit(0.0))
    rows = matrix.rows.withColumn("_total", total).withColumn("_scale", scale)
    one = (lambda v: F.log1p(v.cast("double") * F.col("_scale"))) if log else (lambda v: v.cast("double") * F.col("_scale"))
    rows = rows.withColumn("values", F.transform("values", one)).drop("_total", "_scale")
    return Matrix(rows, matrix.kind, matrix.n_rows, matrix.n_cols)


def quality_control(matrix: Matrix, var: DataFrame, prefix: str = "MT-", symbol: str = "_id") -> DataFrame:
    """row, total, n_features, percent of the total in features whose symbol starts with prefix."""
    marked = var.select(F.col("_pos").cast("int").alias("_col"), F.col(f"`{symbol}`").startswith(prefix).alias("_hit"))
    entries = matrix.single(matrix.entries()).join(marked, F.col("col") == F.col("_col"))
    per = entries.groupBy("row").agg(F.sum(F.col("value").cast("double")).alias("total"), F.count_if(F.col("value") != 0).alias("n_features"), F.coalesce(F.sum(F.when(F.col("_hit"), F.col("value").cast("double"))), F.lit(0.0)).alias("_part"))
    return per.select("row", "total", "n_features", F.when(F.col("total") != 0, 100 * F.col("_part") / F.col("total")).otherwise(0.0).alias("percent"))


def variable_features(matrix: Matrix, k: int) -> DataFrame:
    """col, mean, variance of the k columns of the greatest variance over mean, zeros counted."""
    entries = matrix.single(matrix.entries())
    v = F.col("value").cast("double")
    sums = entries.groupBy("col").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    n = F.lit(float(matrix.n_rows))
    table = sums.select("col", (F.col("s") / n).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("variance"))
    return table.where("mean <> 0").orderBy(F.desc(F.col("variance") / F.col("mean")), "col").limit(k)
