"""Many aggregations from one scan of a matrix.

Every row of the metadata is tagged with the groups that it belongs to in each
task; tags meet the packed matrix rows once, entries are unpacked after that, and one
aggregation keyed by task, group and column serves all tasks of a (source, features) pair.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicate
from ..operators.tasks import MISSING, AggregateTask, AggregationRun, ExecutionReport
from ..sources.matrix import Matrix
from .grouping import ambiguous, categories, label, ordered_groups, present

#: Groups whose numbers are broadcast to the tagged rows.
BROADCAST_GROUPS = 500_000


@dataclass
class AggregateResult:
    """Groups of a task in order, and their statistics where they aren't zero.

    groups: group_idx, group ("<task>:<index>"), the keys, n_cells and, for
    memberships, view_id.  stats: group_idx, feature_pos (place in the task's features), feature
    and the metrics, for stored entries only; dense() has every group and feature.
    """

    task: AggregateTask
    groups: DataFrame
    stats: DataFrame | None
    features: DataFrame
    n_input_cells: int
    n_memberships: int
    run_id: str

    @property
    def metadata(self) -> dict[str, Any]:
        return {"run_id": self.run_id, "task_id": self.task.name, "task": self.task.to_dict(), "source": self.task.source, "n_input_cells": self.n_input_cells, "n_memberships": self.n_memberships}

    def dense(self) -> DataFrame:
        """group_idx, feature_pos, feature and the metrics for each group and feature, zero where no entry is."""
        grid = self.groups.select("group_idx").crossJoin(F.broadcast(self.features))
        if self.stats is None:
            return grid
        met = grid.join(self.stats.drop("feature"), ["group_idx", "feature_pos"], "left")
        return met.select("group_idx", "feature_pos", "feature", *[F.coalesce(F.col(m), F.lit(0).cast(met.schema[m].dataType)).alias(m) for m in self.task.metrics])

    def vectors(self) -> DataFrame:
        """A row per group with an array per metric, in the order of the features."""
        cells = self.dense().groupBy("group_idx").agg(F.sort_array(F.collect_list(F.struct("feature_pos", *self.task.metrics))).alias("v"))
        return self.groups.join(cells, "group_idx", "left").select(*self.groups.columns, *[F.col(f"v.{m}").alias(m) for m in self.task.metrics])

    def to_arrays(self) -> tuple[pd.DataFrame, dict[str, Any]]:
        """The groups as a frame, and each metric as a groups x features array, in the driver's memory."""
        groups = self.groups.orderBy("group_idx").toPandas()
        cells = self.dense().orderBy("group_idx", "feature_pos").toPandas()
        width = self.features.count()
        return groups, {m: cells[m].to_numpy().reshape(len(groups), width) for m in self.task.metrics}


@dataclass
class Selection:
    """Features of a task: their positions in order, and a table (feature_pos, col, feature)."""

    positions: list[int] | None
    table: DataFrame
    size: int


def select_features(var: DataFrame, features: tuple | None) -> Selection:
    """Features by name, in the caller's order; unknown ones are a KeyError, ambiguous ones a ValueError."""
    if features is None:
        table = var.select(F.col("_pos").cast("int").alias("feature_pos"), F.col("_pos").cast("int").alias("col"), F.col("_id").alias("feature"))
        return Selection(None, table, table.count())
    rows = var.where(F.col("_id").isin([str(f) for f in features])).select("_pos", "_id").collect()
    at: dict[str, int] = {}
    for r in rows:
        if r._id in at:
            raise ValueError(f"var names must be unique; {r._id!r} occurs more than once")
        at[r._id] = int(r._pos)
    if missing := [f for f in features if str(f) not in at]:
        raise KeyError(f"features not found: {missing}")
    positions = [at[str(f)] for f in features]
    table = var.sparkSession.createDataFrame([(i, p, str(f)) for i, (p, f) in enumerate(zip(positions, features, strict=True))], "feature_pos int, col int, feature string")
    return Selection(positions, table, len(positions))


def source_of(data: Any, source: str) -> Matrix:
    found = data.X if source == "X" else data.layers.get(source.removeprefix("layers:"))
    if found is None:
        raise KeyError(f"matrix source {source!r} not found")
    return found


def require(rows: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in rows.columns]:
        raise KeyError(f"obs columns not found: {missing}")


def membership_edges(obs: DataFrame, task: AggregateTask) -> DataFrame:
    """obs rows by edge: the metadata of the cohort, the edge's columns, and _edge, its place in the membership table."""
    table = task.membership
    spark = obs.sparkSession
    if isinstance(table, pd.DataFrame):
        plain = table.reset_index(drop=True).reset_index(names="_edge")
        plain = plain.astype({c: object for c in plain.columns if c != "_edge"}).where(plain.notna(), None)
        edges = spark.createDataFrame(plain)
    else:
        edges = table
        if "membership" in edges.columns:
            odd = edges.where("membership is null or cast(membership as double) not in (0, 1)")
            if not odd.isEmpty():
                raise ValueError("membership values must be boolean or binary; weighted memberships are not supported")
            edges = edges.where("cast(membership as boolean)").drop("membership")
        if not edges.where(F.col(task.membership_cell_id).isNull()).isEmpty():
            raise ValueError("membership cell IDs must not be missing")
        keys = [task.membership_cell_id, *(c for c in task.groupby if c in edges.columns)]
        if not edges.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("membership contains duplicate cell/group edges")
        edges = edges.withColumn("_edge", F.monotonically_increasing_id())
    own = [c for c in task.groupby if c in edges.columns]
    edges = edges.select("_edge", F.col(task.membership_cell_id).cast("string").alias("_member"), *own)
    unknown = edges.join(obs.select("_id"), F.col("_member") == F.col("_id"), "left_anti").select("_member").limit(5).collect()
    if unknown:
        raise KeyError(f"membership cell IDs not found: {[r[0] for r in unknown]}")
    cohort = predicate.matching(obs, task.where, task.params)
    kept = [c for c in cohort.columns if c not in own]
    return edges.join(cohort.select(*kept), F.col("_member") == F.col("_id")).drop("_member")


class Assignment:
    """Which rows are in which group of which task.

    One pass over the metadata checks the labels and counts the unions, one more makes the groups.
    """

    def __init__(self, obs: DataFrame, tasks: Sequence[AggregateTask], scans: Sequence[Sequence[int]] = ()):
        self.tasks = list(tasks)
        self.sources: list[DataFrame] = []
        self.plain: list[int] = []
        parts = []
        for i, task in enumerate(self.tasks):
            if task.membership is None:
                require(obs, task.groupby)
                self.sources.append(obs)
                self.plain.append(i)
            else:
                rows = membership_edges(obs, task)
                require(rows, task.groupby)
                self.sources.append(rows)
                parts.append(rows.select(F.col("_pos").alias("row"), F.lit(i).alias("task"), self.key(i).alias("key"), self.missing(i).alias("missing"), F.col("_edge").cast("long").alias("at")))
        self.tests = {i: F.coalesce(predicate.condition(self.tasks[i].where, self.tasks[i].params), F.lit(False)) for i in self.plain}
        if self.plain:
            tags = [F.when(self.tests[i], F.struct(F.lit(i).alias("task"), self.key(i).alias("key"), self.missing(i).alias("missing"))) for i in self.plain]
            tagged = obs.select(F.col("_pos").alias("row"), F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("t"))
            parts.insert(0, tagged.select("row", "t.task", "t.key", "t.missing", F.col("row").cast("long").alias("at")))
        self.unions = self.check_and_count(obs, scans)
        self.rows = reduce(DataFrame.unionByName, parts)
        self.groups = self.rows.groupBy("task", "key", "missing").agg(F.count(F.lit(1)).alias("n_cells"), F.min("at").alias("first")).persist()
        sizes = {r.task: (r.g, r.edges) for r in self.groups.groupBy("task").agg(F.count(F.lit(1)).alias("g"), F.sum("n_cells").alias("edges")).collect()}
        self.n_groups = [sizes.get(i, (0, 0))[0] for i in range(len(self.tasks))]
        self.edges = [int(sizes.get(i, (0, 0))[1]) for i in range(len(self.tasks))]
        self.numbered: list[DataFrame] = []
        for i, task in enumerate(self.tasks):
            levels = [categories(self.sources[i].schema[c]) for c in task.groupby]
            self.numbered.append(ordered_groups(self.groups.where(F.col("task") == i), task.groupby, levels))

    def key(self, i: int):
        return F.array(*[label(self.sources[i], c) for c in self.tasks[i].groupby])

    def missing(self, i: int):
        return F.array(*[present(self.sources[i], c).isNull() for c in self.tasks[i].groupby])

    def check_and_count(self, obs: DataFrame, scans: Sequence[Sequence[int]]) -> dict[tuple[int, ...], int]:
        """Rows of the union of each list of tasks without memberships; and the check that no missing label is also a value."""
        wanted: list[tuple[str, str]] = []
        checks, unions = [], []
        for i, task in enumerate(self.tasks):
            rows = self.sources[i]
            text = [c for c in task.groupby if rows.schema[c].dataType.simpleString() == "string"]
            if i in self.tests:
                checks += [ambiguous(rows, c, self.tests[i]) for c in text]
                wanted += [(task.name, c) for c in text]
            elif text:
                found = rows.agg(*[ambiguous(rows, c, F.lit(True)) for c in text]).first()
                self.refuse([c for c, bad in zip(text, found, strict=True) if bad])
        for members in scans:
            if all(i in self.tests for i in members):
                unions.append(tuple(members))
        counts = [F.count_if(reduce(lambda x, y: x | y, [self.tests[i] for i in members])) for members in unions]
        if not checks and not counts:
            return {}
        got = obs.agg(*[c.alias(f"c{k}") for k, c in enumerate([*checks, *counts])]).first()
        self.refuse([c for (_, c), bad in zip(wanted, got, strict=False) if bad])
        return dict(zip(unions, got[len(checks) :], strict=True))

    @staticmethod
    def refuse(columns: list[str]) -> None:
        if columns:
            raise ValueError(f"groupby columns {columns} hold both missing values and the label {MISSING!r}")

    def numbered_rows(self) -> DataFrame:
        """row, task, group_idx of every assignment."""
        groups = reduce(DataFrame.union, [g.select(F.col("task").alias("_task"), F.col("key").alias("_key"), F.col("missing").alias("_missing"), "group_idx") for g in self.numbered])
        if sum(self.n_groups) <= BROADCAST_GROUPS:
            groups = F.broadcast(groups)
        met = self.rows.join(groups, (F.col("task") == F.col("_task")) & (F.col("key") == F.col("_key")) & (F.col("missing") == F.col("_missing")))
        return met.select("row", "task", "group_idx")

    def result_groups(self, i: int) -> DataFrame:
        """The groups of a task: labels for text keys, values of their own type for others."""
        task, rows = self.tasks[i], self.sources[i]
        keys = []
        for k, c in enumerate(task.groupby):
            kind = rows.schema[c].dataType
            value = F.col("key")[k] if kind.simpleString() == "string" else F.when(~F.col("missing")[k], F.col("key")[k].cast(kind))
            keys.append(value.alias(c))
        out = self.numbered[i].select("group_idx", F.concat(F.lit(f"{task.name}:"), F.col("group_idx").cast("string")).alias("group"), *keys, "n_cells")
        return out.withColumn("view_id", F.col("group")) if task.membership is not None else out

    def task_rows(self) -> list[int]:
        """Distinct rows by task: the edges, but for memberships."""
        out = list(self.edges)
        members = [i for i in range(len(self.tasks)) if i not in self.tests]
        if members:
            per = {r.task: r.n for r in self.rows.where(F.col("task").isin(members)).groupBy("task").agg(F.countDistinct("row").alias("n")).collect()}
            for i in members:
                out[i] = per.get(i, 0)
        return out

    def union_rows(self, members: Sequence[int]) -> int:
        """Distinct rows of some tasks together."""
        found = self.unions.get(tuple(members))
        return self.rows.where(F.col("task").isin(list(members))).select("row").distinct().count() if found is None else int(found)


def scan(matrix: Matrix, tags: DataFrame, selection: Selection) -> DataFrame:
    """task, group_idx, col, sum, count_nonzero: one scan of the matrix for all tags(row, task, group_idx).

    Tags meet packed rows; only then entries are unpacked.
    """
    tags = tags.select(F.col("row").alias("_row"), "task", "group_idx")
    if not matrix.unique:
        entries = matrix.single(matrix.take(tags.select(F.col("_row").alias("row"))).entries(selection.positions))
        met = entries.join(tags, F.col("row") == F.col("_row")).select("task", "group_idx", "col", "value")
    else:
        met = matrix.rows.join(tags, F.col("row") == F.col("_row"))
        tagged = Matrix(met.select(F.struct("task", "group_idx").alias("row"), *[c for c in ("indices", "values", "col", "value") if c in matrix.rows.columns]), matrix.kind, matrix.n_rows, matrix.n_cols)
        met = tagged.entries(selection.positions).select("row.task", "row.group_idx", "col", "value")
    value = F.col("value").cast("int") if matrix.value_type.simpleString() == "boolean" else F.col("value")
    kept = met.where(value != 0)  # NaN counts as different from zero
    return kept.groupBy("task", "group_idx", "col").agg(F.sum(value.cast(matrix.sum_type)).alias("sum"), F.count(F.lit(1)).alias("count_nonzero"))


def build_results(assignment: Assignment, members: dict[Any, list[int]], scans: dict[Any, DataFrame], selections: dict[Any, Selection], counts: tuple[list[int], list[int]], run_id: str) -> dict[str, AggregateResult]:
    results = {}
    for key, tasks in members.items():
        for i in tasks:
            task = assignment.tasks[i]
            stats = None
            if task.metrics:
                table = selections[key].table
                sizes = assignment.numbered[i].select(F.col("group_idx").alias("_g"), "n_cells")
                own = scans[key].where(F.col("task") == i)
                own = own.join(F.broadcast(table), "col").join(sizes, F.col("group_idx") == F.col("_g"))
                own = own.withColumn("mean", F.col("sum").cast("double") / F.col("n_cells"))
                stats = own.select("group_idx", "feature_pos", "feature", *task.metrics)
            results[task.name] = AggregateResult(task, assignment.result_groups(i), stats, selections[key].table.select("feature_pos", "feature"), counts[0][i], counts[1][i], run_id)
    return {t.name: results[t.name] for t in assignment.tasks}


def check_run(tasks: Any, batch_size: Any, kinds: tuple) -> list:
    if isinstance(batch_size, bool) or not isinstance(batch_size, int):
        raise TypeError("batch_size must be an integer")
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if isinstance(tasks, (str, bytes, *kinds)) or not hasattr(tasks, "__iter__"):
        raise TypeError("tasks must be a sequence of tasks")
    tasks = list(tasks)
    if not tasks:
        raise ValueError("tasks must not be empty")
    if odd := [t for t in tasks if not isinstance(t, kinds)]:
        raise TypeError(f"tasks must contain {' or '.join(k.__name__ for k in kinds)} values, not {type(odd[0]).__name__}")
    names = [t.name for t in tasks]
    if len(set(names)) != len(names):
        raise ValueError("task names must be unique")
    return tasks


def aggregate_many(data: Any, tasks: Sequence[AggregateTask], *, batch_size: int = 4096, row_limit: DataFrame | None = None) -> AggregationRun:
    """Runs all tasks with one scan per (source, features).

    data: has obs, var, X and layers.  Results are lazy tables; the report's
    counts come from small aggregations of the assignments.  batch_size only shapes the report's batches.
    """
    began = time.time()
    tasks = check_run(tasks, batch_size, (AggregateTask,))
    obs = data.obs
    members: dict[Any, list[int]] = {}
    for i, t in enumerate(tasks):
        members.setdefault((t.source, t.features) if t.metrics else None, []).append(i)
    matrices = {k: source_of(data, k[0]) for k in members if k}
    selections = {k: select_features(data.var, k[1] if k else None) for k in members if k}
    if None in members:
        # group sizes only: features are listed, the matrix isn't touched
        selections[None] = select_features(data.var, None) if data.var is not None else Selection([], obs.sparkSession.createDataFrame([], "feature_pos int, col int, feature string"), 0)
    reading = {k: v for k, v in members.items() if k}
    assignment = Assignment(obs, tasks, list(reading.values()))
    rows, edges = assignment.task_rows(), assignment.edges
    union = {k: assignment.union_rows(v) for k, v in reading.items()}
    tags = assignment.numbered_rows() if reading else None
    scans = {k: scan(matrices[k], tags.where(F.col("task").isin(v)), selections[k]) for k, v in reading.items()}
    run_id = uuid.uuid4().hex
    results = build_results(assignment, members, scans, selections, (rows, edges), run_id)
    report = ExecutionReport(
        run_id=run_id,
        task_count=len(tasks),
        source_scan_count=len(reading),
        matrix_batch_reads=sum(math.ceil(n / batch_size) for n in union.values()),
        requested_rows=sum(rows[i] for v in reading.values() for i in v),
        unique_rows=sum(union.values()),
        matrix_bytes_read=sum(union[k] * selections[k].size * matrices[k].value_bytes for k in reading if matrices[k].kind == "dense"),
        elapsed_seconds=time.time() - began,
        result_bytes={tasks[i].name: assignment.n_groups[i] * selections[k].size * 8 * len(tasks[i].metrics) for k, v in members.items() for i in v},
        task_rows={t.name: rows[i] for i, t in enumerate(tasks)},
        task_memberships={t.name: edges[i] for i, t in enumerate(tasks)},
    )
    return AggregationRun(results, report)
