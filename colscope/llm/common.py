"""Helpers that several operators share: frames in the shared folder, Arrow batches, link components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import prepare_checkpoints

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of one text column that a Python worker holds at a time, besides one whole text.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the checkpoint folder, which all executors share."""
    prepare_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


class Frames:
    """Parquet frames in the shared folder; ``release`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "frame")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, keep_last: int = 0) -> None:
        gone, self.paths = (self.paths[:-keep_last], self.paths[-keep_last:]) if keep_last else (self.paths, [])
        for path in gone:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_tables: dict[str, tuple] = {}


def worker_tables(name: str, key: tuple, make: Callable[[], object]) -> object:
    """Tables that a Python worker keeps from task to task: those of ``key``, made where others are held.

    They hold nothing that decides a result, so a lost worker costs the time to make them again.
    """
    if _tables.get(name, (None,))[0] != key:
        _tables.pop(name, None)
        _tables[name] = key, make()
    return _tables[name][1]


def drop_tables(step: Callable) -> None:
    """Ends the tables that ``step`` doesn't name in its attribute ``tables``: a worker serves many stages."""
    for name in _tables.keys() - {getattr(step, "tables", None)}:
        del _tables[name]
    # what an earlier stage's batches left behind
    pa.default_memory_pool().release_unused()


def in_batches(
    df: DataFrame,
    schema: str,
    step: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    text: str | None = None,
    at_once: int | None = None,
) -> DataFrame:
    """Rows of ``df`` through a Python step, a bounded slice of rows at a time.

    ``step()`` is called once per task and returns the function from columns to columns. Slices end
    where the column ``text`` (bytes, or a number of bytes) has gathered ``at_once`` (``BATCH_BYTES``); a text is never cut.
    A function with an attribute ``close`` has it called at the end of the task. A step with an attribute
    ``tables`` goes on with the ``worker_tables`` of that name.
    """
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(fields)
        drop_tables(step)
        work = step()
        try:
            for batch in batches:
                for part in slices(batch, text, at_once):
                    made = work(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns))))
                    columns = [pa.array(made[f.name], type=f.type) for f in out]
                    if columns and len(columns[0]):
                        yield pa.RecordBatch.from_arrays(columns, schema=out)
        finally:
            if hasattr(work, "close"):
                work.close()

    return df.mapInArrow(run, fields)


def with_python_column(df: DataFrame, name: str, kind: str, step: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """``df`` and one more column, computed from the UTF-8 bytes of ``text`` (null: empty)."""
    fields = T.StructType([*df.schema.fields, T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(fields)
        drop_tables(step)
        work = step()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column(part.schema.names.index("text")).cast(pa.binary()).to_pylist()]
                columns = [c.cast(f.type) for c, f in zip(part.columns, out)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(work(texts), type=out[-1].type)], schema=out)

    return df.mapInArrow(run, fields)


def slices(batch: pa.RecordBatch, text: str | None, at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    if text is None:
        yield batch
        return
    start, held = 0, 0
    column = batch.column(batch.schema.names.index(text))
    sizes = pa.compute.fill_null(column if pa.types.is_integer(column.type) else pa.compute.binary_length(column), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > (at_once or BATCH_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b): the smallest node reachable by links.

    Every node hooks to its smallest smaller neighbour, labels jump to the roots, and links between
    roots that are still apart go into the next round; links within a component are gone by then.
    Joins are plain equi-joins of narrow rows, which adaptive execution splits at a hot node, and
    labels are aggregated before they are shuffled. A node that is null is no node.
    """
    frames = Frames(links.sparkSession)
    c = F.col
    links = links.where("a is not null and b is not null and a <> b")
    edges = frames.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    placed = None
    while True:
        labels = frames.keep(edges.groupBy(c("b").alias("node")).agg(F.min("a").alias("component")))
        while True:
            above = labels.select(c("node").alias("component"), c("component").alias("above"))
            jumped = frames.keep(labels.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"), c("above").isNotNull().alias("moved")))
            labels = jumped.select("node", "component")
            if jumped.where("moved").limit(1).count() == 0:
                break
        for end in "ab":
            root = labels.select(c("node").alias(end), c("component").alias("root"))
            edges = edges.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = frames.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if placed is not None:
            further = labels.select(c("node").alias("component"), c("component").alias("above"))
            moved = placed.join(further, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
            labels = moved.union(labels)
        placed = frames.keep(labels)
        if edges.limit(1).count() == 0:
            break
    roots = placed.select("component").distinct().select(c("component").alias("node"), "component")
    done = frames.keep(placed.union(roots))
    frames.release(keep_last=1)
    return done
