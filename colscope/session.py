"""Session helpers: a local session for tests and scripts, and the checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("colscope")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable without ever choosing a machine-local folder on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        # local, local[8]; not local-cluster, whose executors have folders of their own
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="colscope-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share."""
    prepare_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    Both later passes over the result see the same rows in the same partitions, also when an
    executor is lost in between.
    """
    prepare_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared checkpoint folder and read them back.

    For frames that several jobs read: columns stay prunable, sizes are known to the optimizer,
    and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    prepare_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder behind a frame of ``materialize`` that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("frame-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Small driver-side records as a local relation, whose size the optimizer knows."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)
