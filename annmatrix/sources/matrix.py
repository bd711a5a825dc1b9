"""Matrices as tables: packed sparse rows, dense rows or entries, and what can be read from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Feature positions that are filtered as a literal list before rows are unpacked; more are joined.
LITERAL_FEATURES = 2000
# Bytes of a stored value by SQL type.
VALUE_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


@dataclass(frozen=True)
class Matrix:
    """A matrix of n_rows x n_cols.

    kind "csr": row long, indices array<int>, values array<T>; rows without
    entries may be missing.  kind "dense": row long, values array<T>.  kind "coo": row long,
    col int, value T; unique says that no (row, col) occurs twice.
    """

    rows: DataFrame
    kind: str
    n_rows: int
    n_cols: int
    unique: bool = True

    def __post_init__(self) -> None:
        wanted = {"csr": {"row", "indices", "values"}, "dense": {"row", "values"}, "coo": {"row", "col", "value"}}
        if self.kind not in wanted:
            raise ValueError(f"matrix kind must be csr, dense or coo, not {self.kind!r}")
        if missing := wanted[self.kind] - set(self.rows.columns):
            raise ValueError(f"a {self.kind} matrix needs the columns {sorted(wanted[self.kind])}; missing: {sorted(missing)}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    @property
    def value_type(self) -> T.DataType:
        kind = self.rows.schema["value" if self.kind == "coo" else "values"].dataType
        return kind if self.kind == "coo" else kind.elementType

    @property
    def value_bytes(self) -> int:
        return VALUE_BYTES.get(self.value_type.simpleString(), 8)

    @property
    def sum_type(self) -> T.DataType:
        """Whole numbers add up to longs (too large a sum is an error, not a wrapped number), others to doubles."""
        whole = isinstance(self.value_type, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return T.LongType() if whole else T.DoubleType()

    def take(self, rows: DataFrame) -> Matrix:
        """The rows whose number is in rows(row): a semi-join, before anything is unpacked."""
        return replace(self, rows=self.rows.join(rows.select(F.col("row").alias("_row")).distinct(), F.col("row") == F.col("_row"), "left_semi"))

    def entries(self, features: Sequence[int] | None = None) -> DataFrame:
        """row, col, value of the stored entries, of some columns if features is given.

        The columns are picked inside the packed rows, so the unpacked ones
        hold nothing that goes again.  Dense zeros come along: they are stored.
        """
        few = None if features is None or len(features) > LITERAL_FEATURES else [int(f) for f in features]
        if self.kind == "coo":
            out = self.rows.select("row", "col", "value")
            out = out if few is None else out.where(F.col("col").isin(few))
        elif self.kind == "csr":
            pairs = F.arrays_zip("indices", "values")
            if few is not None:
                pairs = F.filter(pairs, lambda e: e["indices"].isin(few))
            out = self.rows.select("row", F.explode(pairs).alias("e")).select("row", F.col("e.indices").alias("col"), F.col("e.values").alias("value"))
        elif few is None:
            out = self.rows.select("row", F.posexplode("values").alias("col", "value"))
        else:
            picked = F.array(*[F.struct(F.lit(f).alias("col"), F.get("values", F.lit(f)).alias("value")) for f in few])
            out = self.rows.select("row", F.explode(picked).alias("e")).select("row", "e.col", "e.value")
        if features is not None and few is None:
            wanted = self.rows.sparkSession.createDataFrame([(int(f),) for f in features], "wanted int")
            out = out.join(wanted, F.col("col") == F.col("wanted"), "left_semi")
        return out

    def single(self, entries: DataFrame) -> DataFrame:
        """The entries with those of one place added up."""
        if self.unique:
            return entries
        return entries.groupBy("row", "col").agg(F.sum(F.col("value").cast(self.sum_type)).alias("value"))

    def packed(self) -> Matrix:
        """As sparse rows, columns in order, places that occur twice added up; dense zeros aren't kept."""
        if self.kind == "csr":
            return self
        entries = self.single(self.entries())
        if self.kind == "dense":
            entries = entries.where("value <> 0")
        rows = entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("e"))
        return Matrix(rows.select("row", F.col("e.col").cast("array<int>").alias("indices"), F.col("e.value").alias("values")), "csr", self.n_rows, self.n_cols)

    def subset(self, rows: DataFrame | None = None, features: Sequence[int] | None = None) -> DataFrame:
        """row, col, value in the caller's order: rows(ord, row) may repeat rows; col is the place in features.

        Entries only: what is missing is zero.
        """
        entries = (self if rows is None else self.take(rows)).entries(features)
        if features is not None:
            order = self.rows.sparkSession.createDataFrame([(int(f), i) for i, f in enumerate(features)], "wanted int, place int")
            entries = entries.join(F.broadcast(order), F.col("col") == F.col("wanted")).select("row", F.col("place").alias("col"), "value")
        if rows is None:
            return entries
        order = rows.select(F.col("ord"), F.col("row").alias("wanted_row"))
        return entries.join(order, F.col("row") == F.col("wanted_row")).select(F.col("ord").alias("row"), "col", "value")

    def totals(self) -> DataFrame:
        """row, total, nnz of every row that has entries."""
        return self.entries().groupBy("row").agg(F.sum(F.col("value").cast(self.sum_type)).alias("total"), F.count_if(F.col("value") != 0).alias("nnz"))


def from_array(spark: SparkSession, values: Any, sparse: bool = False) -> Matrix:
    """A matrix from a two-dimensional array in the driver's memory: for small inputs and tests."""
    x = np.asarray(values)
    if x.ndim != 2:
        raise ValueError(f"a matrix must be two-dimensional, not of shape {x.shape}")
    kind = {"b": "boolean", "i": "int" if x.itemsize <= 4 else "bigint", "u": "bigint", "f": "float" if x.itemsize <= 4 else "double"}.get(x.dtype.kind)
    if kind is None:
        raise TypeError(f"values of type {x.dtype} can't be stored")
    if sparse:
        data = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
        return Matrix(spark.createDataFrame(data, f"row long, indices array<int>, values array<{kind}>"), "csr", *x.shape)
    return Matrix(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"row long, values array<{kind}>"), "dense", *x.shape)


def read_matrix_market(spark: SparkSession, path: str, transpose: bool = False) -> Matrix:
    """A coordinate MatrixMarket file (real, integer or pattern; general or symmetric), or a folder that write_matrix_market has written, as entries.

    Lines are read as a table, so a large file is split over tasks.  transpose: for feature-by-cell files.
    """
    # files without a header of their own, as parts of a written folder, are entries only
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("value")).where("value <> ''")
    head = lines.where(F.lower("value").startswith("%%matrixmarket")).first()
    words = head[0].lower().split() if head else []
    if words[1:3] != ["matrix", "coordinate"] or words[3] not in ("real", "integer", "pattern") or words[4] not in ("general", "symmetric"):
        raise ValueError(f"not a coordinate MatrixMarket file of real, integer or pattern values: {words}")
    # the size stands in the first line that is no comment of the file that has the header
    headed = F.input_file_name()
    named = spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("value"), headed.alias("file"), F.monotonically_increasing_id().alias("i"))
    first = named.where(F.lower("value").startswith("%%matrixmarket")).select("file").first().file
    size = named.where((F.col("file") == first) & (F.col("value") != "") & ~F.col("value").startswith("%")).orderBy("i").first()
    n, m, _ = map(int, size.value.split())
    body = named.where((F.col("value") != "") & ~F.col("value").startswith("%") & ~((F.col("file") == first) & (F.col("i") == size.i)))
    body = body.select(F.split("value", r"\s+").alias("w"))
    kind = {"real": "double", "integer": "bigint", "pattern": "int"}[words[3]]
    value = F.lit(1) if words[3] == "pattern" else F.col("w")[2].cast(kind)
    entries = body.select((F.col("w")[0].cast("long") - 1).alias("row"), (F.col("w")[1].cast("int") - 1).alias("col"), value.alias("value"))
    if words[4] == "symmetric":
        entries = entries.union(entries.where("row <> col").select(F.col("col").cast("long"), F.col("row").cast("int"), "value"))
    if transpose:
        entries, n, m = entries.select(F.col("col").cast("long").alias("row"), F.col("row").cast("int").alias("col"), "value"), m, n
    return Matrix(entries, "coo", n, m)


def write_matrix_market(matrix: Matrix, path: str) -> None:
    """A folder of part files whose lines, after the header's, are the entries."""
    entries = matrix.single(matrix.entries()).where("value <> 0").persist()
    spark = entries.sparkSession
    kind = "integer" if isinstance(matrix.sum_type, T.LongType) else "real"
    head = [f"%%MatrixMarket matrix coordinate {kind} general", f"{matrix.n_rows} {matrix.n_cols} {entries.count()}"]
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    entries.select(F.format_string("%d %d %s", F.col("row") + 1, F.col("col") + 1, F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/entries")
    entries.unpersist()
