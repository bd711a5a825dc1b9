"""Exchange with annotated-matrix files of the AnnData library, where that library is installed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .dataset import Dataset, from_frames
from .matrix import Matrix


def library():
    try:
        import anndata
    except ImportError as e:
        raise ImportError("reading and writing h5ad files needs the anndata package; use stores, tables or MatrixMarket files without it") from e
    return anndata


def from_anndata(spark: SparkSession, data: Any) -> Dataset:
    """A Dataset of an AnnData object's slots; sparse matrices arrive as entries."""

    def matrix(value: Any) -> Any:
        if not hasattr(value, "tocoo"):
            return value
        coo = value.tocoo()
        rows = list(zip(coo.row.tolist(), coo.col.tolist(), coo.data.tolist(), strict=True))
        kind = "double" if coo.data.dtype.kind == "f" else "long"
        return Matrix(spark.createDataFrame(rows, f"row long, col int, value {kind}"), "coo", *value.shape).packed()

    slots = {n: {k: matrix(v) for k, v in getattr(data, n).items()} for n in ("layers", "obsm", "obsp", "varm", "varp")}
    raw = None
    if data.raw is not None:
        raw = from_frames(spark, data.obs[[]], data.raw.var, matrix(data.raw.X), varm={k: matrix(v) for k, v in data.raw.varm.items()})
    return from_frames(spark, data.obs, data.var, matrix(data.X), raw=raw, uns=dict(data.uns), **slots)


def read_h5ad(spark: SparkSession, path: str) -> Dataset:
    return from_anndata(spark, library().read_h5ad(path))


def to_anndata(data: Dataset) -> Any:
    """An AnnData object of obs, var, X and layers, in the driver's memory."""
    import numpy as np

    frames = []
    for axis in (data.obs, data.var):
        frames.append(axis.orderBy("_pos").toPandas().drop(columns="_pos").set_index("_id"))
    order = {int(p): i for i, p in enumerate(r[0] for r in data.obs.orderBy("_pos").select("_pos").collect())}

    def array(m: Matrix) -> Any:
        out = np.zeros((len(order), len(frames[1])))
        cells = m.single(m.entries()).toPandas()
        out[[order[int(r)] for r in cells["row"]], cells["col"].to_numpy(int)] = cells["value"].to_numpy(float)
        return out

    return library().AnnData(X=None if data.X is None else array(data.X), obs=frames[0], var=frames[1], layers={k: array(m) for k, m in data.layers.items()})


def write_h5ad(data: Dataset, path: str) -> None:
    to_anndata(data).write_h5ad(path)
