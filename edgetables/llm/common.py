"""What several of these operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from edgetables.plans.storage import checkpoint_root
from edgetables.sources.files import open_filesystem

CHUNK_CHARS = 4_000_000


class Folder:
    """A folder of its own in the shared checkpoint folder, as a URI that workers can open too."""

    def __init__(self, spark: SparkSession, uri: str | None = None):
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(uri or f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}")
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if uri is None:
            self._files.deleteOnExit(path)  # with the driver's JVM; results may be read until then
        qualified = self._files.makeQualified(path).toString()
        self.uri = qualified.replace("file:/", "file:///", 1) if qualified.startswith("file:/") else qualified
        self.uri = self.uri.replace("file://///", "file:///")

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def store(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` as a table and read it back: cuts the lineage, survives lost executors."""
        frame.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        self._files.delete(path, True)


def write_file(uri: str, content: bytes) -> None:
    """Write one file from a task: under another name first, so that a retried task leaves no half file."""
    files, path = open_filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    trial = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    with files.open_output_stream(trial) as out:
        out.write(content)
    files.move(trial, path)


def arrow_schema(columns: str):
    """The Arrow schema of a list of columns as in a table definition; for use on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns))


def batch_of(rows: list[tuple], schema):
    """An Arrow batch from rows."""
    import pyarrow as pa

    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema)


SLICE_ROWS = 1000


def slices(batches):
    """Arrow batches in pieces of at most ``SLICE_ROWS`` rows, so that results leave a task early."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def trimmed(results):
    """Pass results on, and after each give the memory that is free again back to the machine.

    Python workers outlive their task and lie beside the JVM and those of later
    stages; what the C library keeps for itself adds up there.
    """
    import ctypes

    import pyarrow as pa

    trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)
    for result in results:
        yield result
        del result
        pa.default_memory_pool().release_unused()
        trim(0)
    trim(0)


def chunks_of(texts: list[str], most: int = CHUNK_CHARS):
    """Slices ``(start, end)`` of a list, each of about ``most`` characters; one long text makes one slice."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
