"""Edge lists as text, and edges taken from other tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgetables.functions.ids import big
from edgetables.functions.text import HEADER_KEYS, header_key, header_value, id_token, is_header, stripped, tokens
from edgetables.sources.files import read_header

MODES = ("failfast", "dropmalformed")
HEADER_PLACES = ("top", "anywhere")
UNKNOWN_TYPE = "unknown"
NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
GZIP_RATIO = 4  # of edge lists, about
PARTITION_BYTES = 128 * 1024 * 1024
# What a missing header entry means.
HEADER_DEFAULTS = {"n_nodes": 0, "n_edges": 0, "n_components": -1, "diameter": -1}


def read_edge_list(
    spark: SparkSession, path: str, mode: str = "failfast", partitions: int | None = None
) -> DataFrame:
    """``(src, dst)`` from whitespace-separated text; ``#`` and blank lines are skipped.

    Tokens after the second are ignored.  A line without two ids raises, or is
    left out with ``mode="dropmalformed"``.  Compressed files are read as they
    are; gzip files do not split, so where there are any the rows are dealt to
    ``partitions`` partitions, by default as many as their bytes ask for.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    lines = spark.read.text(path)
    rows = lines.filter(~is_header(F.col("value")) & (F.length(stripped(F.col("value"))) > 0))
    rows = rows.select("value", tokens(F.col("value")).alias("parts"))
    rows = rows.select("value", id_token(F.col("parts"), 1).alias("src"), id_token(F.col("parts"), 2).alias("dst"))
    is_edge = F.col("src").isNotNull() & F.col("dst").isNotNull()
    if mode == "failfast":
        problem = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("boolean")
        is_edge = F.when(is_edge, F.lit(True)).otherwise(problem)
    edges = rows.filter(is_edge).select("src", "dst")
    partitions = partitions or _gzip_partitions(spark, path)
    return edges.repartition(partitions) if partitions else edges


def _gzip_partitions(spark: SparkSession, path: str) -> int:
    """Partitions for the contents of the gzip files under ``path``; 0 if there are none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    packed = files.filter(F.col("path").endswith(".gz")).agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    return -(-packed * GZIP_RATIO // PARTITION_BYTES)


def write_edge_list(edges: DataFrame, path: str, meta: dict | None = None, compression: str | None = None) -> None:
    """Text rows ``src dst`` under ``path``; ``meta`` goes to a one-row JSON table at ``path + ".meta"``."""
    lines = edges.select(F.concat_ws(" ", "src", "dst").alias("value"))
    lines.write.text(path, compression=compression or "none")
    if meta is not None:
        row = {"graph_type": UNKNOWN_TYPE, **HEADER_DEFAULTS, **meta, "path": path}
        columns = [F.lit(row[key]).alias(key) for key in ["path", *HEADER_KEYS]]
        edges.sparkSession.range(1).select(*columns).write.json(f"{path.rstrip('/')}.meta")


def read_graph_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata tables written next to edge lists; ``path`` may be a glob."""
    fields = ", ".join(f"{key} bigint" for key in HEADER_DEFAULTS)
    return spark.read.schema(f"path string, graph_type string, {fields}").json(path)


def read_graph_catalog(spark: SparkSession, path: str, meta: str | None = None, headers: str = "top") -> DataFrame:
    """One row per text file: what is known of its graph.

    Files whose folder has a metadata table under ``meta`` (a glob of tables
    written by :func:`write_edge_list`) take its entries and are not read.  Of the
    others the ``# key: value`` lines at the top are read, up to the first line
    that is neither comment nor blank, so a file costs its first bytes whatever its
    size.  Unknown keys are ignored; missing ones get defaults, for files without any header line too.
    Spark does not list files without a byte, so they give no row.

    Tasks open the files themselves, on file systems that Arrow knows.
    ``headers="anywhere"`` reads all lines with Spark's own reader instead: on
    any file system, and with comment lines between the edges.
    """
    if headers not in HEADER_PLACES:
        raise ValueError(f"headers must be one of {HEADER_PLACES}, not {headers!r}")
    # Without its content the file source lists files and reads none.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("place"))
    described, rest = None, files
    if meta is not None:
        known = read_graph_meta(spark, meta).withColumn("folder", _plain_path(F.col("path"))).drop("path")
        by_folder = files.withColumn("folder", _plain_path(F.regexp_replace("place", "/[^/]*$", "")))
        described = by_folder.join(known, "folder").drop("folder", "place")
        rest = by_folder.join(known, "folder", "left_anti").drop("folder")
    read = _top_headers(rest) if headers == "top" else _all_headers(spark, path, rest)
    catalog = read.select(
        "path",
        F.coalesce("graph_type", F.lit(UNKNOWN_TYPE)).alias("graph_type"),
        *[F.coalesce(F.col(key).try_cast("bigint"), big(default)).alias(key) for key, default in HEADER_DEFAULTS.items()],
    )
    return catalog if described is None else described.unionByName(catalog)


def _plain_path(path: Column) -> Column:
    """A path without its scheme and repeated or closing slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z0-9+.-]+:/+|^/+", "/"), "/+$", "")


def _top_headers(files: DataFrame) -> DataFrame:
    """``path`` and the entries as text, each file opened where its row is."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [read_header(place) for place in batch.column(1).to_pylist()]
            entries = [pa.array([one.get(key) for one in found], pa.string()) for key in HEADER_KEYS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *entries], names=["path", *HEADER_KEYS])

    return files.select("path", "place").mapInArrow(read, ", ".join(f"{c} string" for c in ("path", *HEADER_KEYS)))


def _all_headers(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    entries = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .filter(is_header(F.col("value")))
        .select("path", header_key(F.col("value")).alias("key"), header_value(F.col("value")).alias("entry"))
        .groupBy("path")
        .pivot("key", HEADER_KEYS)
        .agg(F.max("entry"))
    )
    return files.select("path").join(entries, "path", "left")


def edges_from(
    table: DataFrame,
    src: str | Column,
    dst: str | Column,
    src_offset: int = 0,
    dst_offset: int = 0,
    two_sided: bool = False,
) -> DataFrame:
    """Two key columns of any table as edges.

    ``two_sided`` keeps the ends apart whatever their ids: ``src`` becomes even,
    ``dst`` odd.  Offsets are for ranges that are known not to meet.

    Numbers become whole numbers.  Keys of another type stay as they are, or
    become text if the two types differ; ``two_sided`` then makes them structs
    ``(side, key)`` with side 0 or 1 and a null for a null key, and there are no offsets.
    """
    ends = table.select(src, dst).dtypes
    if all(kind in NUMBER_TYPES or kind.startswith("decimal") for _, kind in ends):

        def end(key: str | Column, offset: int, side: int) -> Column:
            key = (F.col(key) if isinstance(key, str) else key).cast("bigint")
            return 2 * key + big(side) if two_sided else key + big(offset)

    else:
        if src_offset or dst_offset:
            raise TypeError(f"offsets are for numbers, not for {dict(ends)}")
        same = ends[0][1] == ends[1][1]

        def end(key: str | Column, offset: int, side: int) -> Column:
            key = F.col(key) if isinstance(key, str) else key
            key = key if same else key.cast("string")
            return F.when(key.isNotNull(), F.struct(F.lit(side).alias("side"), key.alias("key"))) if two_sided else key

    return table.select(end(src, src_offset, 0).alias("src"), end(dst, dst_offset, 1).alias("dst"))
