"""A dataset on disk: a folder of Parquet versions per slot, and a manifest that names the live ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicate
from ..functions.names import NameRegistry
from ..functions.provenance import ProvenanceLogger, fingerprint
from ..plans.shared_scan import require
from .dataset import RESERVED, Dataset, as_axis, as_matrix, check_shape, from_frames
from .files import Files
from .matrix import Matrix

MANIFEST = "manifest.json"
#: Rows of a written matrix's Parquet file groups: small enough for row-number ranges to skip.
ROW_GROUP_BYTES = 16 << 20


def storage_key(key: Any) -> str:
    if not isinstance(key, str) or key in ("", ".", "..") or any(c in key for c in "/\\\0"):
        raise ValueError(f"{key!r} can't be a storage key")
    return key


class Store(Dataset):
    """A Dataset whose changes are new versions.

    Every write goes to a new folder; replacing the manifest makes it
    live, so readers see the old or the new state, and views keep what they were made from.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._spark = path.rstrip("/"), spark
        self.files = Files(spark, self.path)
        self.provenance = ProvenanceLogger(self.files)
        self.reload()

    # opening and making
    @classmethod
    def create(cls, spark: SparkSession, path: str, *, overwrite: bool = False) -> Store:
        files = Files(spark, path)
        if files.exists() and not files.is_dir():
            raise ValueError(f"{path} exists and is not a folder")
        if files.names():
            if not overwrite:
                raise FileExistsError(f"{path} is not empty; pass overwrite=True to replace it")
            files.delete()
        files.make()
        files.write_json(MANIFEST, {"format": 1, "slots": {}})
        empty = spark.createDataFrame([], "_pos long, _id string")
        store = cls.__new__(cls)
        store.path, store._spark, store.files, store.provenance = path.rstrip("/"), spark, files, ProvenanceLogger(files)
        store.manifest = files.read_json(MANIFEST)
        store._put("obs", empty, {})
        store.reload()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        files = Files(spark, path)
        if not files.exists():
            raise FileNotFoundError(path)
        if not files.exists(MANIFEST):
            raise ValueError(f"{path} is not a store: it has no {MANIFEST}")
        return cls(spark, path)

    @classmethod
    def from_frames(cls, spark: SparkSession, path: str, obs: Any, var: Any = None, X: Any = None, *, overwrite: bool = False, **slots: Any) -> Store:
        return cls.from_dataset(from_frames(spark, obs, var, X, **slots), path, overwrite=overwrite)

    @classmethod
    def from_dataset(cls, data: Dataset, path: str, *, overwrite: bool = False) -> Store:
        """Writes all slots.  Values of uns that JSON can't hold are left out, with one warning."""
        import warnings

        store = cls.create(data.spark, path, overwrite=overwrite)
        store._put("obs", data.obs, {})
        if data.var is not None:
            store._put("var", data.var, {})
        if data.X is not None:
            store._put_matrix("X", data.X)
        for slot in ("layers", "obsm", "obsp", "varm", "varp"):
            for k, m in getattr(data, slot).items():
                store._put_matrix(f"{slot}/{storage_key(k)}", m)
        if data.raw is not None:
            store._put("raw/var", data.raw.var, {})
            store._put_matrix("raw/X", data.raw.X)
            for k, m in data.raw.varm.items():
                store._put_matrix(f"raw/varm/{storage_key(k)}", m)
        kept, lost = {}, []
        for k, v in data.uns.items():
            try:
                kept[k] = plain_json(v)
            except TypeError:
                lost.append(k)
        if lost:
            warnings.warn(f"uns keys that can't be stored were left out: {sorted(lost)}", UserWarning, stacklevel=2)
        store.files.write_json("uns.json", kept)
        store.reload()
        store.provenance.log("import", "store", params={"n_obs": store.n_obs})
        return store

    def reload(self) -> None:
        """Reads the manifest; tables are opened when used."""
        self.manifest = self.files.read_json(MANIFEST)
        slots = self.manifest["slots"]
        if "obs" not in slots:
            raise ValueError(f"{self.path} has no obs")

        def several(prefix: str) -> dict[str, Matrix]:
            return {k.removeprefix(prefix): self._matrix(k) for k in sorted(slots) if k.startswith(prefix) and "/" not in k.removeprefix(prefix)}

        raw = None
        if "raw/X" in slots and "raw/var" in slots:
            raw = Dataset(self._table("obs").select(*RESERVED), self._table("raw/var"), self._matrix("raw/X"), varm=several("raw/varm/"))
        Dataset.__init__(self, self._table("obs"), self._table("var") if "var" in slots else None, self._matrix("X") if "X" in slots else None, layers=several("layers/"), obsm=several("obsm/"), obsp=several("obsp/"), varm=several("varm/"), varp=several("varp/"), uns=self.files.read_json("uns.json", {}), raw=raw)

    def close(self) -> None:
        self._spark.catalog.clearCache()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    # counts without a scan of values
    @property
    def n_obs(self) -> int:
        return int(self.manifest["slots"]["obs"]["n"])

    @property
    def n_vars(self) -> int:
        var = self.manifest["slots"].get("var")
        return int(var["n"]) if var else super().n_vars

    # the physical layer
    def _folder(self, slot: str) -> str:
        return f"{self.path}/{slot}/{self.manifest['slots'][slot]['version']}"

    def _table(self, slot: str) -> DataFrame:
        entry = self.manifest["slots"][slot]
        table = self._spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(self._folder(slot))
        # file sources drop nothing of a given schema but column metadata, which the manifest keeps
        return table.select(*[F.col(f"`{n}`").alias(n, metadata=m) if (m := entry["levels"].get(n)) else F.col(f"`{n}`") for n in table.columns])

    def _matrix(self, slot: str) -> Matrix:
        entry = self.manifest["slots"][slot]
        return Matrix(self._table(slot), entry["kind"], entry["n_rows"], entry["n_cols"], entry["unique"])

    def _put(self, slot: str, table: DataFrame, more: dict[str, Any]) -> None:
        version = f"v-{uuid.uuid4().hex[:12]}"
        order = next(c for c in ("_pos", "row") if c in table.columns)
        table.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/{slot}/{version}")
        levels = {f.name: f.metadata for f in table.schema if f.metadata}
        bare = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema])
        n = self._spark.read.schema(bare).parquet(f"{self.path}/{slot}/{version}").count()
        fresh = self.files.read_json(MANIFEST)
        fresh["slots"][slot] = {"version": version, "schema": bare.json(), "levels": levels, "n": n} | more
        self.files.write_json(MANIFEST, fresh)
        self.manifest = fresh

    def _put_matrix(self, slot: str, matrix: Matrix) -> None:
        stored = matrix.packed() if matrix.kind == "coo" and not slot.split("/")[0].endswith("p") else matrix
        self._put(slot, stored.rows, {"kind": stored.kind, "n_rows": matrix.n_rows, "n_cols": matrix.n_cols, "unique": stored.unique})

    def vacuum(self) -> int:
        """Deletes versions that aren't live; views made before lose their tables.  Returns how many."""
        gone = 0
        for slot, entry in self.manifest["slots"].items():
            for name in self.files.names(slot):
                if name.startswith("v-") and name != entry["version"]:
                    self.files.delete(f"{slot}/{name}")
                    gone += 1
        return gone

    # whole slots
    def write_obs(self, frame: Any) -> None:
        """Replaces the row metadata, and its schema; the number of rows must fit all aligned slots."""
        table = as_axis(self._spark, frame)
        n = table.count()
        for slot, entry in self.manifest["slots"].items():
            if slot == "X" or slot.split("/")[0] in ("layers", "obsm", "obsp") or slot == "raw/X":
                if entry["n_rows"] != n:
                    raise ValueError(f"{slot} has {entry['n_rows']} rows but obs has {n} rows")
        old = fingerprint(self.obs)
        self._put("obs", table, {})
        self.reload()
        self.provenance.log("write", "obs", old_hash=old, new_hash=fingerprint(self.obs))

    def write_var(self, frame: Any, raw: bool = False) -> None:
        table, x = as_axis(self._spark, frame), "raw/X" if raw else "X"
        n = table.count()
        if x in self.manifest["slots"] and self.manifest["slots"][x]["n_cols"] != n:
            raise ValueError(f"{x} has {self.manifest['slots'][x]['n_cols']} columns but var has {n} rows")
        self._put("raw/var" if raw else "var", table, {})
        self.reload()
        self.provenance.log("write", "raw.var" if raw else "var", new_hash=fingerprint(table))

    def write_matrix(self, slot: str, value: Any) -> None:
        """Replaces X, raw/X, or KIND/KEY of layers, obsm, obsp, varm, varp and raw/varm, after the alignment checks."""
        kind, _, key = slot.rpartition("/")
        if kind and slot != "raw/X":
            storage_key(key)
        if kind not in ("", "raw", "layers", "obsm", "obsp", "varm", "varp", "raw/varm") or (not kind and slot != "X") or (kind == "raw" and key != "X"):
            raise ValueError(f"{slot!r} is not a matrix slot")
        var_like = kind in ("varm", "varp", "raw/varm")
        rows = (self.raw.n_vars if kind == "raw/varm" and self.raw else self.n_vars) if var_like else self.n_obs
        cols = rows if kind in ("obsp", "varp") else self.n_vars if (slot == "X" or kind == "layers") and self.var is not None else None
        matrix = as_matrix(self._spark, value, (rows, cols or 0))
        check_shape(slot, matrix, rows, "var" if var_like else "obs", cols)
        old = fingerprint(self._table(slot)) if slot in self.manifest["slots"] else None
        self._put_matrix(slot, matrix)
        self.reload()
        self.provenance.log("write", kind or "X", key=key if kind else None, old_hash=old, new_hash=fingerprint(self._table(slot)))

    def put_obsm(self, key: str, value: Any) -> None:
        """Like write_matrix, for canonical result names only."""
        self._canonical(key)
        self.write_matrix(f"obsm/{key}", value)

    def put_obsp(self, key: str, value: Any) -> None:
        self._canonical(key)
        self.write_matrix(f"obsp/{key}", value)

    @staticmethod
    def _canonical(key: str) -> None:
        if not NameRegistry.is_canonical(key):
            raise ValueError(f"{key!r} is not a canonical result name")

    def write_uns(self, values: dict) -> None:
        self.files.write_json("uns.json", plain_json(values))
        self.uns = self.files.read_json("uns.json")
        self.provenance.log("write", "uns")

    # changes of the row metadata
    def update_obs(self, column: str, values: Any, new: Sequence[Any] | None = None) -> None:
        """Sets a column for some ids: from values(_id, value), a pandas Series by id, or ids and new values.

        Ids that occur twice in the update are a ValueError; unknown ones, or ones that several rows share, a KeyError.
        An empty update does nothing.  A categorical column becomes plain.
        """
        require(self.obs, [column])
        if not isinstance(values, DataFrame):
            pairs = list(values.items()) if isinstance(values, pd.Series) else list(zip(values, new, strict=True))
            if not pairs:
                return
            kind = self.obs.schema[column].dataType
            values = self._spark.createDataFrame([(str(i), v.item() if hasattr(v, "item") else v) for i, v in pairs], T.StructType([T.StructField("_id", T.StringType()), T.StructField("value", kind)]))
        values = values.select(F.col("_id").cast("string").alias("_u"), "value").persist()
        if values.isEmpty():
            return
        twice = values.groupBy("_u").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"ids occur more than once in the update: {[r[0] for r in twice]}")
        met = values.join(self.obs.select("_id"), F.col("_u") == F.col("_id"), "left").groupBy("_u").agg(F.count("_id").alias("n"))
        odd = met.where("n <> 1").limit(5).collect()
        if odd:
            raise KeyError(f"ids not found, or not unique: {[r[0] for r in odd]}")
        kind = self.obs.schema[column].dataType
        changed = self.obs.join(values.withColumn("_hit", F.lit(True)), F.col("_id") == F.col("_u"), "left")
        self._replace_column("update_obs", changed, column, F.when(F.col("_hit"), F.col("value").cast(kind)).otherwise(F.col(f"`{column}`")), {"n_rows": values.count()})
        values.unpersist()

    def update_obs_where(self, column: str, value: Any, where: str, params: Sequence[Any] = ()) -> int:
        """Sets a column where a predicate holds, which may be about that column; returns the number of rows."""
        require(self.obs, [column])
        test = F.coalesce(predicate.condition(where, params), F.lit(False))
        n = self.obs.where(test).count()
        if n:
            new = F.expr(predicate.as_literal(value)).cast(self.obs.schema[column].dataType)
            self._replace_column("update_obs_where", self.obs, column, F.when(test, new).otherwise(F.col(f"`{column}`")), {"where": where, "params": list(params), "n_rows": n})
        return n

    def add_obs_column(self, column: str, values: Any) -> None:
        """A new column: one value per row in order, or a table (_pos, value).

        Values become boolean, long, double or text, in that order of preference; a pandas categorical keeps its levels.
        """
        if column in RESERVED:
            raise ValueError(f"{column!r} is reserved")
        if column in self.obs_columns:
            raise ValueError(f"obs column {column!r} exists")
        if isinstance(values, DataFrame):
            table = values.select(F.col("_pos").alias("_at"), "value")
        else:
            series = values if isinstance(values, pd.Series) else pd.Series(values)
            if len(series) != self.n_obs:
                raise ValueError(f"{len(series)} values for {self.n_obs} rows")
            table = as_axis(self._spark, pd.DataFrame({"value": series.reset_index(drop=True)})).select(F.col("_pos").alias("_at"), "value")
        levels = table.schema["value"].metadata
        joined = self.obs.join(table, F.col("_pos") == F.col("_at"), "left")
        kept = [F.col(f"`{c}`") for c in self.obs.columns]
        self._write_changed("add_obs_column", joined.select(*kept, F.col("value").alias(column, metadata=levels)), column, {})

    def _replace_column(self, operation: str, rows: DataFrame, column: str, value: Any, params: dict) -> None:
        out = [value.alias(c, metadata={}) if c == column else F.col(f"`{c}`") for c in self.obs.columns]
        self._write_changed(operation, rows.select(*out), column, params)

    def _write_changed(self, operation: str, table: DataFrame, column: str, params: dict) -> None:
        old = fingerprint(self.obs.select(f"`{column}`")) if column in self.obs_columns else None
        self._put("obs", table, {})
        self.reload()
        self.provenance.log(operation, "obs", key=column, params=params, old_hash=old, new_hash=fingerprint(self.obs.select(f"`{column}`")))

    # named views
    @property
    def named_views(self) -> list[str]:
        return sorted(self.files.read_json("views.json", {}))

    def save_view(self, name: str, view: Any) -> None:
        """Keeps a view's predicate, parameters and columns; it is evaluated anew when loaded."""
        if not isinstance(name, str) or not name:
            raise ValueError("a view's name must be a non-empty string")
        if view.parent is not self:
            raise ValueError("the view belongs to another dataset")
        views = self.files.read_json("views.json", {})
        views[name] = {"where": view.where, "params": [p.item() if hasattr(p, "item") else p for p in view.params], "columns": view.columns}
        self.files.write_json("views.json", views)

    def load_view(self, name: str):
        views = self.files.read_json("views.json", {})
        if name not in views:
            raise KeyError(f"view {name!r} not found")
        v = views[name]
        return self.query_obs(v["where"], v["params"], v["columns"])


def plain_json(value: Any) -> Any:
    """Arrays, frames, categoricals and scalars of NumPy and pandas as JSON's types; a TypeError for what has none."""
    if isinstance(value, dict):
        return {str(k): plain_json(v) for k, v in value.items()}
    if isinstance(value, pd.DataFrame):
        return {str(k): plain_json(v) for k, v in value.to_dict("list").items()}
    if isinstance(value, (pd.Series, pd.Categorical, pd.Index)):
        return [plain_json(v) for v in value.tolist()]
    if hasattr(value, "tolist"):
        return plain_json(value.tolist())
    if isinstance(value, (list, tuple)):
        return [plain_json(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} can't be stored as JSON")
