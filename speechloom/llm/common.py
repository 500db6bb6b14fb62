"""Helpers shared by the training-data operators: table reading, shared folders, Arrow row mapping, bounded caches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches are bounded in rows and in bytes, so a run of very long texts cannot fill a Python worker.
BATCH_ROWS = 1024
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For the session: plans read these settings when they run, which is after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one, but only if driver and
    executors are one process (local tests): anywhere else each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="speechloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/speechloom-{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder: later stages, and retries after a lost executor, reread it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table made by written() that nothing will read again."""
    for name in df.inputFiles():
        jpath = spark._jvm.org.apache.hadoop.fs.Path(name)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, False)


def arrow_schema(fields: str) -> tuple[str, pa.Schema]:
    """The DDL that mapInArrow needs, and the Arrow schema the Python side builds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T._parse_datatype_string(fields)
    return fields, to_arrow_schema(struct)


def map_columns(df: DataFrame, fields: str, make: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]]) -> DataFrame:
    """mapInArrow over column lists. make sees one partition's batches, and yields batches of columns of its own."""
    ddl, schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Caches hold millions of small objects that never form cycles; looking through them often is all the collector would do.
        gc.set_threshold(100_000, 20, 100)
        columns = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches if b.num_rows)
        for out in make(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def texts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Key columns and the whole text, null read as empty. Other columns of the input, whatever their names, are left out."""
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


class Bounded:
    """A cache that fills up to a limit (one batch may pass it). What comes later is worked out anew for each batch, and goes
    with the next one, so results never depend on it."""

    def __init__(self, limit: int, make: Callable[[list], Iterable]) -> None:
        self.limit, self.make, self.kept = limit, make, {}
        self.passing: list = []

    def view(self, keys: Iterable) -> dict:
        """A dict that holds every one of keys, until the next call."""
        for k in self.passing:
            del self.kept[k]
        self.passing = []
        missing = sorted(set(keys).difference(self.kept))
        if missing:
            full = len(self.kept) >= self.limit
            self.kept.update(zip(missing, self.make(missing), strict=True))
            if full:
                self.passing = missing
        return self.kept
