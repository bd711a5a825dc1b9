"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: The setting that lets Spark delete checkpoints out of use.
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share.

    Only on one machine, as in tests, a folder is made where that setting is absent; on a cluster that is an error.
    Checkpoints that nothing refers to any more are deleted, unless the session's configuration says otherwise.
    """
    context = spark.sparkContext
    live = context._jsc.sc()
    if live.getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    if not live.conf().contains(CLEAN):
        live.conf().set(CLEAN, "true")
    return live.getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, saved; shuffle files and checkpoints that nothing refers to any more are deleted.

    Spark deletes them only when the driver collects its garbage, which a driver with little work of its own does rarely: until
    then the files of all steps so far stay on the executors' disks.
    """
    spark = df.sparkSession
    out = saved(df)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in any store that Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of df as the one column row, and more beside it, so that no name of theirs can clash; box.row.* unpacks it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def literal(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Rows and bytes of a part of a batch; a single row may have more.
PART_ROWS, PART_BYTES = 1000, 4 << 20


def parts(batch: pa.RecordBatch, most: int = PART_BYTES):
    """A batch in slices of bounded size."""
    each = max(1, min(PART_ROWS, most * batch.num_rows // max(1, batch.nbytes)))
    for k in range(0, batch.num_rows, each):
        yield batch.slice(k, each)


def give_back() -> None:
    """Returns what a task has freed to the system: workers live on from stage to stage, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """mapInArrow for a function from a batch's columns, as a dict of Arrow arrays, to a dict of columns.

    fn is made on each worker by a factory, so that it may hold state over the batches of a task.
    It gets a batch in parts of few rows and bytes, so that what it builds from them stays small.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        each = fn()
        for batch in (part for whole in batches for part in parts(whole, part_bytes)):
            out = each({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
        each = out = None
        give_back()

    return df.mapInArrow(run, schema)
