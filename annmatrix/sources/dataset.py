"""An annotated matrix as tables: row metadata, feature metadata, aligned matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matrix import Matrix, from_array

RESERVED = ("_pos", "_id")
SLOTS = ("X", "obs", "var", "obsm", "obsp", "layers", "varm", "varp", "uns", "raw")


def as_axis(spark: SparkSession, frame: Any) -> DataFrame:
    """Metadata as (_pos, _id, columns): a Spark table with _id and _pos, or a pandas frame with ids as its index.

    A pandas categorical becomes text, with its levels and their order in the column's metadata.
    """
    if isinstance(frame, DataFrame):
        if "_id" not in frame.columns or "_pos" not in frame.columns:
            raise ValueError("a Spark table of metadata needs the columns _pos (0 to n-1) and _id")
        rest = [c for c in frame.columns if c not in RESERVED]
        return frame.select(F.col("_pos").cast("long").alias("_pos"), F.col("_id").cast("string").alias("_id"), *[F.col(f"`{c}`") for c in rest])
    if taken := [c for c in frame.columns if c in RESERVED]:
        raise ValueError(f"columns {taken} are reserved")
    plain = pd.DataFrame({"_pos": range(len(frame)), "_id": [str(i) for i in frame.index]})
    kinds, levels = [T.StructField("_pos", T.LongType(), False), T.StructField("_id", T.StringType())], {}
    for c in frame.columns:
        values = frame[c]
        if isinstance(values.dtype, pd.CategoricalDtype):
            levels[c] = {"categories": [level.isoformat() if hasattr(level, "isoformat") else str(level) for level in values.cat.categories], "ordered": bool(values.cat.ordered)}
            values = values.astype(object)
            kind: T.DataType = T.StringType()
        elif pd.api.types.is_bool_dtype(values):
            kind = T.BooleanType()
        elif pd.api.types.is_integer_dtype(values):
            kind = T.LongType()
        elif pd.api.types.is_float_dtype(values):
            kind = T.DoubleType()
        elif pd.api.types.is_datetime64_dtype(values):
            kind = T.TimestampNTZType()
        else:
            kind = T.StringType()
        make = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.DoubleType: float, T.TimestampNTZType: lambda v: v.to_pydatetime()}[type(kind)]
        plain[c] = pd.Series([None if pd.isna(v) else make(v) for v in values], dtype=object)
        kinds.append(T.StructField(c, kind, True, levels.get(c)))
    schema = T.StructType(kinds)
    return spark.createDataFrame([tuple(r) for r in plain.itertuples(index=False, name=None)], schema)


def as_matrix(spark: SparkSession, value: Any, shape: tuple[int, int] | None = None) -> Matrix:
    """A Matrix as it is, a Spark table by its columns (shape needed), anything else as an array."""
    if isinstance(value, Matrix):
        return value
    if isinstance(value, DataFrame):
        if shape is None:
            raise ValueError("a matrix given as a table needs its shape")
        kind = "csr" if "indices" in value.columns else "dense" if "values" in value.columns else "coo"
        return Matrix(value, kind, *shape, unique=kind != "coo")
    return from_array(spark, value)


class Dataset:
    """obs, var, X, layers, obsm, obsp, varm, varp, uns and raw; all tables are lazy."""

    def __init__(self, obs: DataFrame, var: DataFrame | None = None, X: Matrix | None = None, *, layers: dict[str, Matrix] | None = None, obsm: dict[str, Matrix] | None = None, obsp: dict[str, Matrix] | None = None, varm: dict[str, Matrix] | None = None, varp: dict[str, Matrix] | None = None, uns: dict | None = None, raw: Dataset | None = None):
        self.obs, self.var, self.X = obs, var, X
        self.layers, self.obsm, self.obsp, self.varm, self.varp = (dict(d or {}) for d in (layers, obsm, obsp, varm, varp))
        self.uns, self.raw = uns or {}, raw

    @property
    def spark(self) -> SparkSession:
        return self.obs.sparkSession

    @property
    def n_obs(self) -> int:
        return self.obs.count()

    @property
    def n_vars(self) -> int:
        return self.var.count() if self.var is not None else self.X.n_cols if self.X is not None else 0

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    @property
    def obs_columns(self) -> list[str]:
        return [c for c in self.obs.columns if c not in RESERVED]

    @property
    def obs_names(self) -> list[str]:
        return [r[0] for r in self.obs.orderBy("_pos").select("_id").collect()]

    @property
    def var_names(self) -> list[str]:
        return [r[0] for r in self.var.orderBy("_pos").select("_id").collect()]

    def __len__(self) -> int:
        return self.n_obs

    def __repr__(self) -> str:
        keys = ", ".join(f"{n}: {sorted(d)}" for n in ("layers", "obsm", "obsp", "varm", "varp") if (d := getattr(self, n)))
        return f"{type(self).__name__}({len(self.obs_columns)} obs columns{', X ' + 'x'.join(map(str, self.X.shape)) if self.X else ''}{', ' + keys if keys else ''})"

    def keys(self, slot: str) -> list[str]:
        if slot not in ("layers", "obsm", "obsp", "varm", "varp"):
            raise ValueError(f"slot {slot!r} has no keys")
        return sorted(getattr(self, slot))

    def get_state(self) -> dict[str, Any]:
        """What preconditions are checked against."""
        return {"X_exists": self.X is not None, "obsm_keys": self.keys("obsm"), "obsp_keys": self.keys("obsp"), "obs_columns": self.obs_columns, "uns_keys": sorted(self.uns)}

    # queries
    def query_obs(self, where: str = "TRUE", params: Sequence[Any] = (), columns: Sequence[str] | None = None):
        """A View of the rows for which the predicate holds."""
        from ..operators.view import View

        return View.of(self, where, params, columns)

    def partition_obs(self, column: str, groups: dict[str, Any], *, columns: Sequence[str] | None = None, require_complete: bool = False, persist: bool = False) -> dict[str, Any]:
        from ..operators.view import partition_obs

        return partition_obs(self, column, groups, columns=columns, require_complete=require_complete, persist=persist)

    def aggregate_many(self, tasks: Sequence[Any], *, batch_size: int = 4096):
        from ..plans.shared_scan import aggregate_many

        return aggregate_many(self, tasks, batch_size=batch_size)

    def execute_tasks(self, tasks: Sequence[Any], *, batch_size: int = 4096, memory_budget_bytes: int | None = None):
        from ..operators.materialize import execute_tasks

        return execute_tasks(self, tasks, batch_size=batch_size, memory_budget_bytes=memory_budget_bytes)

    def materialize_many(self, views: dict[str, Any], source: str = "X", features: Any = None) -> DataFrame:
        """name, row, col, value of many views of this dataset, from one read of the source."""
        from ..operators.materialize import materialize_many
        from ..operators.tasks import feature_names

        if foreign := [n for n, v in views.items() if v.parent is not self]:
            raise ValueError(f"views {foreign} belong to another dataset")
        return materialize_many(self, {n: v.positions() for n, v in views.items()}, source, feature_names(features, "materialize_many"))

    def iter_batches(self, batch_size: int = 4096, *, layer: str | None = None) -> Iterator[tuple[pd.DataFrame, Any]]:
        from ..streaming.batches import iter_batches

        return iter_batches(self, batch_size, layer)

    def bundle(self, slots: Sequence[str] | None = None, **keys: Sequence[str] | None) -> dict[str, Any]:
        """The chosen slots as lazy tables; slots that aren't chosen aren't in any plan.

        keys: obsm_keys, obsp_keys, layer_keys, varm_keys and varp_keys pick from a slot.
        """
        chosen = set(SLOTS if slots is None else slots)
        if odd := chosen - set(SLOTS):
            raise ValueError(f"unknown slots {sorted(odd)}; slots are {list(SLOTS)}")
        names = {"layer_keys": "layers", "obsm_keys": "obsm", "obsp_keys": "obsp", "varm_keys": "varm", "varp_keys": "varp"}
        if odd := set(keys) - set(names):
            raise TypeError(f"unknown arguments {sorted(odd)}")
        out: dict[str, Any] = {}
        for slot in ("X", "obs", "var", "uns", "raw"):
            if slot in chosen:
                out[slot] = getattr(self, slot)
        for argument, slot in names.items():
            if slot in chosen:
                have, wanted = getattr(self, slot), keys.get(argument)
                if missing := [k for k in wanted or () if k not in have]:
                    raise KeyError(f"{slot} keys not found: {missing}")
                out[slot] = {k: have[k] for k in (have if wanted is None else wanted)}
        return out


def from_frames(spark: SparkSession, obs: Any, var: Any = None, X: Any = None, *, raw: Any = None, uns: dict | None = None, **slots: dict[str, Any]) -> Dataset:
    """A Dataset from pandas or Spark tables and arrays, with its alignment checked."""
    obs = as_axis(spark, obs)
    n = obs.count()
    var = None if var is None else as_axis(spark, var)
    m = 0 if var is None else var.count()
    X = None if X is None else as_matrix(spark, X, (n, m))
    made = {}
    for name, square in (("layers", None), ("obsm", None), ("obsp", n), ("varm", None), ("varp", m)):
        rows = m if name.startswith("var") else n
        made[name] = {k: as_matrix(spark, v, (rows, m if name == "layers" else rows)) for k, v in (slots.pop(name, None) or {}).items()}
        for k, v in made[name].items():
            check_shape(f"{name}[{k!r}]", v, rows, "var" if name.startswith("var") else "obs", m if name == "layers" else square)
    if slots:
        raise TypeError(f"unknown slots {sorted(slots)}")
    if X is not None:
        check_shape("X", X, n, "obs", m if var is not None else None)
    if raw is not None:
        check_shape("raw.X", raw.X, n, "obs", None)
    return Dataset(obs, var, X, uns=uns, raw=raw, **made)


def check_shape(what: str, matrix: Matrix, rows: int, axis: str, cols: int | None) -> None:
    if matrix.n_rows != rows:
        raise ValueError(f"{what} has {matrix.n_rows} rows but {axis} has {rows} rows")
    if cols is not None and matrix.n_cols != cols:
        raise ValueError(f"{what} has {matrix.n_cols} columns but {cols} are expected")
