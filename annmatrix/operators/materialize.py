"""Subsets of rows and features, and runs that mix them with aggregations under a budget."""

from __future__ import annotations

import math
import sys
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicate
from ..plans.shared_scan import Assignment, Selection, build_results, check_run, require, scan, select_features, source_of
from ..plans.waves import Item, MatrixCost, Planner
from ..sources.matrix import Matrix
from .tasks import AggregateTask, ExecutionReport, MaterializeTask, TaskRun


@dataclass
class Subset:
    """Rows of a cohort in order with the chosen features: obs, var and entries(row, col, value) as lazy tables.

    row is the place in the subset, col the place in the features; what has no entry is zero.
    """

    obs: DataFrame
    var: DataFrame
    entries: DataFrame
    n_obs: int
    n_vars: int
    metadata: dict[str, Any]

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    @property
    def obs_names(self) -> list[str]:
        return [r[0] for r in self.obs.orderBy("_pos").select("_id").collect()]

    def to_array(self) -> np.ndarray:
        """The subset as an array in the driver's memory."""
        cells = self.entries.toPandas()
        out = np.zeros(self.shape, cells["value"].dtype if len(cells) else np.float64)
        np.add.at(out, (cells["row"].to_numpy(int), cells["col"].to_numpy(int)), cells["value"].to_numpy())
        return out


def cohort_rows(obs: DataFrame, task: MaterializeTask) -> DataFrame:
    """obs rows of the cohort with ord, their place in it."""
    rows = predicate.matching(obs, task.where, task.params)
    if task.cell_ids is not None:
        wanted = obs.sparkSession.createDataFrame([(str(c),) for c in task.cell_ids], "_wanted string")
        missing = wanted.join(rows.select("_id"), F.col("_wanted") == F.col("_id"), "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"cell IDs not found in the cohort: {[r[0] for r in missing]}")
        rows = rows.join(wanted, F.col("_id") == F.col("_wanted"), "left_semi")
    if task.obs_columns is not None:
        require(obs, task.obs_columns)
        rows = rows.select("_pos", "_id", *task.obs_columns)
    return with_order(rows, "_pos")


def with_order(rows: DataFrame, column: str) -> DataFrame:
    """ord (from 0) by a column, without bringing all rows to one task.

    Rows are dealt by range and numbered in their partition; the partitions' sizes give the offsets.
    """
    dealt = rows.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return dealt.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("ord", F.col("_before") + F.col("_in")).drop("_part", "_in", "_p", "_before")


def subset(data: Any, task: MaterializeTask, rows: DataFrame, n_rows: int, selection: Selection, run_id: str) -> Subset:
    matrix = source_of(data, task.source)
    entries = matrix.subset(rows.select("ord", F.col("_pos").alias("row")), selection.positions)
    if not matrix.unique:
        entries = matrix.single(entries)
    obs = rows.drop("_pos").withColumnRenamed("ord", "_pos")
    var = selection.table.select(F.col("feature_pos").alias("_pos"), F.col("feature").alias("_id"), "col")
    var = var.join(data.var.withColumnRenamed("_pos", "_at").drop("_id"), F.col("col") == F.col("_at")).drop("_at", "col")
    meta = {"run_id": run_id, "analysis_id": run_id, "task_id": task.name, "task": task.to_dict(), "source": task.source, "n_input_cells": n_rows}
    return Subset(obs, var, entries, n_rows, selection.size, meta)


def output_bytes(value: Any, result_bytes: int) -> int:
    """Bytes that a consumer's output keeps: known for arrays, frames and texts, else of the object itself and its parts."""
    if isinstance(value, Subset):
        return result_bytes
    if isinstance(value, np.ndarray):
        return int(value.nbytes)
    if isinstance(value, (pd.DataFrame, pd.Series)):
        return int(np.sum(value.memory_usage(deep=True)))
    if isinstance(value, (bytes, str)):
        return len(value)
    if isinstance(value, dict):
        return sum(output_bytes(v, 0) for v in value.values())
    if isinstance(value, (list, tuple, set)):
        return sum(output_bytes(v, 0) for v in value)
    return 0 if value is None or isinstance(value, (int, float, bool, DataFrame)) else sys.getsizeof(value)


class MixedRun:
    """Prepares, plans and runs tasks of both kinds."""

    def __init__(self, data: Any, tasks: Sequence[Any], batch_size: int, budget: int | None):
        self.began = time.time()
        self.tasks = check_run(tasks, batch_size, (AggregateTask, MaterializeTask))
        if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int)):
            raise TypeError("memory_budget_bytes must be an integer or None")
        if budget is not None and budget <= 0:
            raise ValueError("memory_budget_bytes must be positive")
        self.data, self.batch_size, self.budget = data, batch_size, budget
        self.run_id = uuid.uuid4().hex
        self.aggregates = [t for t in self.tasks if isinstance(t, AggregateTask)]
        self.assignment = Assignment(data.obs, self.aggregates) if self.aggregates else None
        self.cohorts = {t.name: cohort_rows(data.obs, t) for t in self.tasks if isinstance(t, MaterializeTask)}
        self.selections: dict[Any, Selection] = {}
        self.groups: dict[Any, tuple[list[AggregateTask], list[MaterializeTask]]] = {}
        for t in self.tasks:
            key = (t.source, t.features) if not isinstance(t, AggregateTask) or t.metrics else None
            if key not in self.selections:
                self.selections[key] = select_features(data.var, key[1] if key else None)
            if key:
                self.groups.setdefault(key, ([], []))[isinstance(t, MaterializeTask)].append(t)
        self.place = {t.name: i for i, t in enumerate(self.tasks)}
        self.row_sets = self.rows_by_task()
        self.cache: dict[tuple, tuple[int, int]] = {}

    def rows_by_task(self) -> DataFrame | None:
        """(task, row): the distinct rows of each task that reads a matrix."""
        parts = []
        if self.assignment is not None:
            at = F.element_at(F.array(*[F.lit(self.place[t.name]) for t in self.aggregates]), F.col("task") + 1)
            parts.append(self.assignment.rows.select(at.alias("task"), "row").distinct())
        parts += [c.select(F.lit(self.place[n]).alias("task"), F.col("_pos").alias("row")) for n, c in self.cohorts.items()]
        return reduce(DataFrame.union, parts).persist()

    def matrix_of(self, key: tuple) -> Matrix:
        return source_of(self.data, key[0])

    def entries_by_row(self, matrix: Matrix) -> DataFrame:
        if matrix.kind == "csr":
            return matrix.rows.select(F.col("row").alias("_row"), F.size("indices").alias("e"))
        return matrix.rows.groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).alias("e"))

    def union(self, key: tuple, members: tuple[int, ...]) -> tuple[int, int]:
        """Rows of the tasks' union, and the largest decoded batch of it."""
        found = self.cache.get((key, members))
        if found is None:
            matrix, cost = self.matrix_of(key), self.cost(key)
            rows = self.row_sets.where(F.col("task").isin(list(members))).select("row").distinct()
            if not cost.sparse:
                n = rows.count()
                found = n, cost.decoded(min(n, self.batch_size), 0)
            else:
                numbered = with_order(rows.join(self.entries_by_row(matrix), F.col("row") == F.col("_row"), "left").select("row", F.coalesce("e", F.lit(0)).alias("e")), "row")
                batches = numbered.groupBy(F.floor(F.col("ord") / self.batch_size).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"))
                size = F.col("e") * (cost.value_bytes + 4) + (F.col("n") + 1) * 4
                got = batches.agg(F.sum("n"), F.max(size)).first()
                found = int(got[0] or 0), int(got[1] or 0)
            self.cache[key, members] = found
        return found

    def cost(self, key: tuple) -> MatrixCost:
        matrix = self.matrix_of(key)
        return MatrixCost(matrix.kind != "dense", self.selections[key].size, matrix.value_bytes)

    def item(self, key: tuple, task: Any) -> Item:
        i = self.place[task.name]
        if isinstance(task, AggregateTask):
            groups = self.assignment.n_groups[self.aggregates.index(task)]
            return Item(i, groups=groups, accumulators=len({"sum" if m == "mean" else m for m in task.metrics}))
        rows = self.row_sets.where(F.col("task") == i).select("row")
        matrix = self.matrix_of(key)
        entries = 0
        if matrix.kind != "dense":
            entries = rows.join(self.entries_by_row(matrix), F.col("row") == F.col("_row")).agg(F.sum("e")).first()[0] or 0
        return Item(i, rows=rows.count(), entries=int(entries), keeps_result=task.consumer is None)

    def check(self, size: int, what: str) -> None:
        if self.budget is not None and size > self.budget:
            raise MemoryError(f"{what} needs {size} bytes, over memory_budget_bytes={self.budget}")

    def run(self) -> TaskRun:
        planner = Planner({k: self.cost(k) for k in self.groups}, lambda k, m: self.union(k, m)[1], self.budget)
        for key, (aggregates, materializers) in self.groups.items():
            scope = "all features" if key[1] is None else f"{len(key[1])} selected features"
            planner.add(key, [self.item(key, t) for t in aggregates], [self.item(key, t) for t in materializers], f"source {key[0]!r} ({scope})")
        results: dict[str, Any] = {}
        plan, peak_all, kept, seen = [], 0, 0, {}
        sizes: dict[str, int] = {}
        scans: dict[Any, DataFrame] = {}
        held = 0
        for number, wave in enumerate(planner.waves, 1):
            key, cost = wave.key, planner.costs[wave.key]
            members = tuple(i.index for i in (*wave.aggregates, *wave.materializers))
            self.check(wave.peak, f"wave {number} of source {key[0]!r} before reading")
            rows, _ = self.union(key, members)
            before = seen.setdefault(key, set())
            repeated = self.repeated(members, tuple(before)) if before else 0
            before.update(members)
            accumulators = sum(a.groups * cost.width * a.accumulators * 8 for a in wave.aggregates)
            held += accumulators
            names = {i.index: self.tasks[i.index].name for i in (*wave.aggregates, *wave.materializers)}
            if wave.aggregates:
                own = [self.aggregates.index(self.tasks[a.index]) for a in wave.aggregates]
                tags = self.assignment.numbered_rows().where(F.col("task").isin(own))
                scans[key] = scan(self.matrix_of(key), tags, self.selections[key])
            consumed = 0
            for m in wave.materializers:
                task = self.tasks[m.index]
                size = cost.decoded(m.rows, m.entries)
                consumed += cost.decoded(m.rows, m.entries, chunked=True)
                got: Any = subset(self.data, task, self.cohorts[task.name], m.rows, self.selections[key], self.run_id)
                if task.consumer is not None:
                    got = task.consumer(got)
                    size = output_bytes(got, size)
                    kept += size
                    self.check(held + kept, "retained consumer output")
                else:
                    kept += size
                results[task.name], sizes[task.name] = got, size
            peak_all = max(peak_all, wave.peak)
            plan.append({"wave": number, "source": key[0], "features": None if key[1] is None else tuple(key[1]), "rows": rows, "repeated_rows": repeated, "batch_count": math.ceil(rows / self.batch_size), "aggregate_tasks": tuple(names[a.index] for a in wave.aggregates), "materialize_tasks": tuple(names[m.index] for m in wave.materializers), "estimated_peak_buffer_bytes": wave.peak, "peak_accumulator_bytes": held, "peak_consumer_bytes": consumed + kept, "peak_buffer_bytes": wave.peak})
        peak_all = self.finish_aggregates(planner, plan, results, sizes, scans, held, kept, peak_all)
        return TaskRun({t.name: results[t.name] for t in self.tasks}, self.report(planner, plan, sizes, peak_all))

    def repeated(self, members: tuple[int, ...], before: tuple[int, ...]) -> int:
        now, old = (self.row_sets.where(F.col("task").isin(list(m))).select("row").distinct() for m in (members, before))
        return now.intersect(old).count()

    def finish_aggregates(self, planner: Planner, plan: list, results: dict, sizes: dict, scans: dict, held: int, kept: int, peak: int) -> int:
        if not self.aggregates:
            return peak
        extra = 0
        members: dict[Any, list[int]] = {}
        for i, t in enumerate(self.aggregates):
            key = (t.source, t.features) if t.metrics else None
            members.setdefault(key, []).append(i)
            groups = self.assignment.n_groups[i]
            sizes[t.name] = groups * self.selections[key].size * 8 * len(t.metrics)
            extra += groups * self.selections[key].size * 8 * ("mean" in t.metrics)
        final = held + kept + extra
        self.check(final, "aggregate result finalization")
        rows, edges = self.assignment.task_rows(), self.assignment.edges
        results |= build_results(self.assignment, members, scans, self.selections, (rows, edges), self.run_id)
        if plan and extra and final > plan[-1]["peak_buffer_bytes"]:
            plan[-1]["peak_buffer_bytes"] = final
        return max(peak, final)

    def report(self, planner: Planner, plan: list, sizes: dict, peak: int) -> ExecutionReport:
        per = {r.task: r.n for r in self.row_sets.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
        reads = {t.name for a, m in self.groups.values() for t in (*a, *m)}
        edges = self.assignment.edges if self.assignment else []
        at = {t.name: edges[i] for i, t in enumerate(self.aggregates)}
        return ExecutionReport(
            run_id=self.run_id,
            task_count=len(self.tasks),
            source_scan_count=len(planner.waves),
            matrix_batch_reads=sum(p["batch_count"] for p in plan),
            requested_rows=sum(per.get(self.place[n], 0) for n in reads),
            unique_rows=sum(p["rows"] for p in plan),
            matrix_bytes_read=sum(p["rows"] * planner.costs[w.key].width * planner.costs[w.key].value_bytes for p, w in zip(plan, planner.waves, strict=True) if not planner.costs[w.key].sparse),
            elapsed_seconds=time.time() - self.began,
            result_bytes=sizes,
            task_rows={t.name: per.get(self.place[t.name], 0) for t in self.tasks},
            task_memberships={t.name: at.get(t.name, per.get(self.place[t.name], 0)) for t in self.tasks},
            memory_budget_bytes=self.budget,
            peak_buffer_bytes=peak,
            execution_waves=len(planner.waves),
            scan_plan=tuple(plan),
            degradation_reasons=tuple(planner.reasons),
        )


def execute_tasks(data: Any, tasks: Sequence[Any], *, batch_size: int = 4096, memory_budget_bytes: int | None = None) -> TaskRun:
    """Aggregations and materialisations with shared scans, in as few waves as the budget allows.

    A materialisation's result is a lazy Subset, or what its consumer makes of it; consumers run
    one after the other.  A wave's aggregations read their source together; each materialisation's lazy table
    reads it again when used, which the report, the planner's accounting, counts as the same scan.
    """
    return MixedRun(data, tasks, batch_size, memory_budget_bytes).run()


def materialize_many(data: Any, cohorts: dict[str, DataFrame], source: str = "X", features: tuple | None = None) -> DataFrame:
    """name, row (place in the cohort), col, value for many cohorts(ord, row), each source row read once."""
    matrix = source_of(data, source)
    selection = select_features(data.var, features)
    tagged = reduce(DataFrame.unionByName, [c.select(F.lit(n).alias("name"), F.col("ord"), F.col("row")) for n, c in cohorts.items()])
    met = matrix.single(matrix.take(tagged.select("row")).entries(selection.positions)) if not matrix.unique else None
    if met is None:
        rows = matrix.rows.join(tagged.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"))
        packed = Matrix(rows.select(F.struct("name", "ord").alias("row"), *[c for c in ("indices", "values", "col", "value") if c in matrix.rows.columns]), matrix.kind, matrix.n_rows, matrix.n_cols)
        met = packed.entries(selection.positions).select("row.name", F.col("row.ord").alias("row"), "col", "value")
    else:
        met = met.join(tagged.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row")).select("name", F.col("ord").alias("row"), "col", "value")
    if selection.positions is not None:
        met = met.join(F.broadcast(selection.table.select("feature_pos", F.col("col").alias("_c"))), F.col("col") == F.col("_c")).select("name", "row", F.col("feature_pos").alias("col"), "value")
    return met
