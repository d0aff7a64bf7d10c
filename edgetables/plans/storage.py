"""Intermediate tables in the cluster's shared checkpoint folder.

Writing a table cuts the lineage of a loop like a checkpoint does, but in one
job and in columnar form, and it outlives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession


TASK_ROWS = 2**19  # of two longs each: sorted, some 40 MB of a task's memory
SPLIT_BYTES = "4m"  # a table's files hold TASK_ROWS rows at most, so a split is a file


def task_count(n_rows: int) -> int:
    """Tasks for ``n_rows`` rows, so that what one task sorts or groups does not grow with the table."""
    return max(1, -(-n_rows // TASK_ROWS))


@contextmanager
def small_tasks(spark: SparkSession, n_rows: int | None) -> Iterator[None]:
    """While a job over ``n_rows`` rows runs, its shuffles and scans are cut for ``TASK_ROWS`` rows a task.

    Left as they are, settings for a number of partitions or of bytes let the rows
    of a task grow with the table, the more the better they compress.
    """
    if n_rows is None or n_rows <= TASK_ROWS:
        yield
        return
    wanted = {
        "spark.sql.shuffle.partitions": str(task_count(n_rows)),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": SPLIT_BYTES,
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one under the warehouse folder.

    Both are folders that a cluster shares; a machine's own temporary folder is
    never used.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    root = root or context.getCheckpointDir()
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.edgetables"


def stored_rows(frame: DataFrame, n_rows: int) -> DataFrame:
    """``frame`` from a table of its own, made by tasks cut for ``n_rows`` rows whatever the caller's settings."""
    return Workspace(frame.sparkSession).write(frame, "rows", n_rows=n_rows)[0]


class Workspace:
    """A folder of its own for the tables of one run.

    ``close()``, or leaving it as a context, removes the folder with all its
    tables; a folder that nobody closes goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/edgetables-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self._delete(self.path)

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, frame: DataFrame, name: str, *metrics, columns: list[str] | None = None, n_rows: int | None = None):
        """Store ``frame``, read it back, and return it with ``metrics`` taken on the way.

        The metrics are aggregates over the rows as written, collected by the
        writing tasks themselves; ``columns`` limits what is stored.  ``n_rows``
        bounds the rows that the job shuffles at once (:func:`small_tasks`).
        """
        observed = Observation()
        stored = frame.observe(observed, *metrics) if metrics else frame
        stored = stored.select(*columns) if columns else stored
        with small_tasks(self.spark, n_rows):
            stored.write.option("maxRecordsPerFile", TASK_ROWS).parquet(self.table(name))
        back = self.spark.read.schema(stored.schema).parquet(self.table(name))
        return back, (observed.get if metrics else {})

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        self._delete(self.table(name))

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
