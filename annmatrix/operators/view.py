"""Views: the rows of a predicate, as a dataset that reads only what is asked for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicate
from ..functions.names import NameRegistry
from ..plans.shared_scan import require
from ..sources.dataset import RESERVED, Dataset, check_shape
from ..sources.matrix import Matrix
from .materialize import with_order


def check_columns(obs: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns is None:
        return [c for c in obs.columns if c not in RESERVED]
    if isinstance(columns, str):
        raise TypeError("columns must be a sequence of column names, not a string")
    columns = list(columns)
    if len(set(columns)) != len(columns):
        raise ValueError("columns must not contain duplicates")
    require(obs, columns)
    return columns


class View(Dataset):
    """A snapshot of the rows that match a predicate.

    It reads the version of the metadata that was current when it was made, so its rows
    don't change with later updates.  Matrices are semi-joined to the rows when used; results
    put on the view stay on the view.  Rows keep their positions in the parent.
    """

    def __init__(self, parent: Dataset, where: str, params: tuple, columns: list[str]):
        matched = predicate.matching(parent.obs, where, params)
        super().__init__(matched.select(*RESERVED, *[F.col(f"`{c}`") for c in columns]), parent.var)
        self.parent, self.where, self.params, self.columns = parent, where, params, columns
        self.all_obs = matched
        rows = self.obs.select(F.col("_pos").alias("row"))
        self.X = None if parent.X is None else parent.X.take(rows)
        self.layers = {k: m.take(rows) for k, m in parent.layers.items()}
        self.obsm = {k: m.take(rows) for k, m in parent.obsm.items()}
        self.obsp = {k: induced(m, rows) for k, m in parent.obsp.items()}
        self.varm, self.varp, self.uns, self.raw = dict(parent.varm), dict(parent.varp), dict(parent.uns), parent.raw

    @classmethod
    def of(cls, parent: Dataset, where: str, params: Sequence[Any], columns: Sequence[str] | None) -> View:
        where, params = predicate.check(where, params)
        return cls(parent, where, params, check_columns(parent.obs, columns))

    def query_obs(self, where: str = "TRUE", params: Sequence[Any] = (), columns: Sequence[str] | None = None) -> View:
        """The view's rows that also match: the conjunction of both predicates, over the parent."""
        joined, values = predicate.both((self.where, self.params), predicate.check(where, params))
        return View.of(self.parent, joined, values, self.columns if columns is None else columns)

    refine = query_obs

    def positions(self) -> DataFrame:
        """(ord, row): the rows by their place in the view."""
        return with_order(self.obs.select(F.col("_pos").alias("row")), "row").select("ord", "row")

    def put_obsm(self, key: str, matrix: Matrix) -> None:
        """A result for the view alone; names must be canonical."""
        self._canonical(key)
        check_shape(f"obsm[{key!r}]", matrix, self.n_obs, "the view", None)
        self.obsm[key] = matrix

    def put_obsp(self, key: str, matrix: Matrix) -> None:
        self._canonical(key)
        check_shape(f"obsp[{key!r}]", matrix, self.n_obs, "the view", self.n_obs)
        self.obsp[key] = matrix

    @staticmethod
    def _canonical(key: str) -> None:
        if not NameRegistry.is_canonical(key):
            raise ValueError(f"{key!r} is not a canonical result name")

    def save(self, name: str) -> None:
        self.parent.save_view(name, self)

    def update_obs(self, column: str, values: DataFrame, *, create: bool = False, fill_value: Any = None) -> None:
        """Writes values(_id, value) of the view's rows to the parent's column; create makes it, as text, with fill_value elsewhere."""
        if column not in self.parent.obs_columns:
            if not create:
                raise KeyError(f"obs column {column!r} not found; pass create=True to add it")
            rows = self.parent.obs.select("_pos", F.col("_id").alias("_i")).join(values.select(F.col("_id").alias("_v"), "value"), F.col("_i") == F.col("_v"), "left")
            filled = F.coalesce(F.col("value").cast("string"), F.lit(None if fill_value is None else str(fill_value)))
            self.parent.add_obs_column(column, rows.select("_pos", filled.alias("value")))
        else:
            self.parent.update_obs(column, values)

    def materialize(self, path: str, *, overwrite: bool = False):
        """An independent store of the view's rows, numbered anew."""
        from ..sources.store import Store

        order = self.positions().persist()
        obs = self.obs.join(order, F.col("_pos") == F.col("row")).select(F.col("ord").alias("_pos"), "_id", *[F.col(f"`{c}`") for c in self.columns])
        n = order.count()

        def moved(m: Matrix) -> Matrix:
            at = order.withColumnRenamed("row", "_r")
            rows = m.rows.join(at, F.col("row") == F.col("_r")).drop("row", "_r").withColumnRenamed("ord", "row")
            return Matrix(rows, m.kind, n, m.n_cols, m.unique)

        def moved_graph(m: Matrix) -> Matrix:
            a, b = (order.select(F.col("row").alias(f"_r{i}"), F.col("ord").alias(f"_o{i}")) for i in (1, 2))
            edges = m.entries().join(a, F.col("row") == F.col("_r1")).join(b, F.col("col") == F.col("_r2"))
            return Matrix(edges.select(F.col("_o1").alias("row"), F.col("_o2").cast("int").alias("col"), "value"), "coo", n, n, m.unique)

        data = Dataset(obs, self.var, self.X and moved(self.X), layers={k: moved(m) for k, m in self.layers.items()}, obsm={k: moved(m) for k, m in self.obsm.items()}, obsp={k: moved_graph(m) for k, m in self.obsp.items()}, varm=self.varm, varp=self.varp, uns=self.uns, raw=self.raw and Dataset(obs.select(*RESERVED), self.raw.var, moved(self.raw.X.take(order.select("row"))), varm=self.raw.varm))
        return Store.from_dataset(data, path, overwrite=overwrite)


def induced(graph: Matrix, rows: DataFrame) -> Matrix:
    """The edges of which both ends are in rows(row), by their positions in the parent."""
    kept = graph.entries()
    kept = kept.join(rows.select(F.col("row").alias("_a")), F.col("row") == F.col("_a"), "left_semi")
    kept = kept.join(rows.select(F.col("row").alias("_b")), F.col("col") == F.col("_b"), "left_semi")
    return Matrix(kept, "coo", graph.n_rows, graph.n_cols, graph.unique)


def partition_obs(data: Dataset, column: str, groups: dict[str, Any], *, columns: Sequence[str] | None = None, require_complete: bool = False, persist: bool = False) -> dict[str, View]:
    """A view per group of a column's values; values in two groups are an error, and so are uncovered ones if require_complete.

    With persist the views are saved by their names, before completeness is checked.
    """
    require(data.obs, [column])
    values: dict[str, list] = {}
    owner: dict[Any, str] = {}
    for name, given in groups.items():
        listed = list(given) if isinstance(given, Iterable) and not isinstance(given, (str, bytes)) else [given]
        if not listed:
            raise ValueError(f"group {name!r} has no values")
        for v in listed:
            v = v.item() if hasattr(v, "item") else v
            if owner.setdefault(v, name) != name:
                raise ValueError(f"value {v!r} is in the groups {owner[v]!r} and {name!r}")
            values.setdefault(name, []).append(v)
    quoted = '"' + column.replace('"', '""') + '"'
    made = {n: data.query_obs(f"{quoted} IN ({', '.join('?' * len(v))})", v, columns) for n, v in values.items()}
    if persist:
        for n, v in made.items():
            v.save(n)
    if require_complete:
        covered = predicate.condition(f"{quoted} IN ({', '.join('?' * len(owner))})", list(owner))
        left = data.obs.where(~F.coalesce(covered, F.lit(False))).select(F.col(f"`{column}`")).distinct().limit(5).collect()
        if left:
            raise ValueError(f"values of {column!r} in no group: {[r[0] for r in left]}")
    return made
