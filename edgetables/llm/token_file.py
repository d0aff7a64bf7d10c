"""Token ids as files: frequency ranks in one to four bytes, with the sizes in bytes of their own.

An id is replaced by its rank among all ids of the corpus, the commonest being
0, and written in as few whole bytes as the rank needs.  Two bits per id say how
many; the control bytes, four ids each, come before all data bytes, so a reader
turns them into sizes with one table lookup and gathers every id at once.

A file holds some whole documents (all numbers little-endian)::

    b"VTK1", documents: uint32, ids: uint64, ids of the same partition in earlier files: uint64
    for each document  known: uint8 (0 for a null id), doc_id: int64, ids: uint32
    control bytes, then data bytes

The table of ranks and a list of the files lie beside them as Parquet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from edgetables.llm.common import Folder, slices, trimmed, write_file
from edgetables.llm.tokens import encoder

END_ID = 0
FILE_IDS = 2_000_000  # a file closes after the document that reaches it
MAGIC = b"VTK1"
LIST = "file string, part int, n_docs bigint, n_ids bigint"
HEAD = struct.Struct("<4sIQQ")
#: Sizes of the four ids that a control byte speaks of.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> bytes:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        has = slice(None) if k == 0 else size > k
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes() + data.tobytes()


def decode_ranks(coded: memoryview, n: int) -> np.ndarray:
    n_control = -(-n // 4)
    control = np.frombuffer(coded, np.uint8, n_control)
    data = np.frombuffer(coded, np.uint8, offset=n_control)
    size = SIZES[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        ranks[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def file_bytes(before: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, rank_of: np.ndarray) -> bytes:
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), before)
    known = np.array([doc is not None for doc in doc_ids], np.uint8)
    columns = (known, np.array([doc or 0 for doc in doc_ids], "<i8"), sizes.astype("<u4"))
    return head + b"".join(c.tobytes() for c in columns) + encode_ranks(rank_of[ids])


def file_rows(content: bytes, id_of: np.ndarray) -> Iterator[tuple[int | None, int, bytes]]:
    """``(doc_id, start in the partition, ids as unsigned 32-bit)`` of each document."""
    magic, n_docs, n_ids, before = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    known = np.frombuffer(content, np.uint8, n_docs, at)
    doc_ids = np.frombuffer(content, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    ids = id_of[decode_ranks(memoryview(content)[at + 13 * n_docs :], n_ids)].astype("<u4")
    starts = np.cumsum(sizes) - sizes
    for has, doc, start, size in zip(known.tolist(), doc_ids.tolist(), starts.tolist(), sizes.tolist()):
        yield doc if has else None, before + start, ids[start : start + size].tobytes()


def write_token_files(
    docs: DataFrame, tokenizer: str, uri: str | None = None, end_id: int = END_ID, white_matters: bool = True
) -> Folder:
    """Write the ids of all texts in ascending order of ``doc_id`` (nulls first) and return their folder.

    A null or empty text is the end id alone.  Rows with one ``doc_id`` follow
    each other by text.  A very long text is one document of a larger file.  An
    empty table writes no file; reading back then gives no rows.  Further
    columns are not looked at.
    """
    spark = docs.sparkSession
    folder = Folder(spark, uri)
    in_order = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, block, before = TaskContext.get().partitionId(), 0, 0
        words, end = encoder(tokenizer, white_matters), np.uint32(end_id).tobytes()
        docs_held, ids_held, held = [], [], 0

        def out():
            sizes = [len(x) // 4 for x in ids_held]
            columns = [[part], [block], [before], [docs_held], [sizes], [b"".join(ids_held)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "before", "doc_ids", "sizes", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(texts)):
                docs_held.append(doc)
                ids_held.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= FILE_IDS:
                    yield out()
                    docs_held, ids_held, held, block, before = [], [], 0, block + 1, before + held
        if docs_held:
            yield out()

    columns = "part int, block int, before bigint, doc_ids array<bigint>, sizes array<bigint>, ids binary"
    blocks = folder.store(in_order.mapInArrow(lambda batches: trimmed(encode(batches)), columns), "ids")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    by_rank = (
        blocks.select("ids")
        .mapInArrow(count, "id bigint, n bigint")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "id")
        .collect()  # a row for each id of the vocabulary at most
    )
    ranked = [row["id"] for row in by_rank]
    folder.store(spark.createDataFrame(list(enumerate(ranked)), "rank int, id bigint").coalesce(1), "ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    uri = folder.uri

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                part, block, before, doc_ids = (batch.column(c)[i].as_py() for c in range(4))
                sizes = batch.column(4)[i].values.to_numpy()
                ids = np.frombuffer(batch.column(5)[i].as_buffer(), "<u4")
                name = f"{part}-{block:06d}.vtok"
                write_file(f"{uri}/files/{name}", file_bytes(before, doc_ids, sizes, ids, rank_of))
                columns = [[name], [part], [len(doc_ids)], [len(ids)]]
                names = ["file", "part", "n_docs", "n_ids"]
                types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    folder.store(blocks.mapInArrow(write, LIST), "list")
    folder.drop("ids")
    return folder


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files, in their order.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit.
    """
    listed = spark.read.schema(LIST).parquet(f"{uri}/list")
    ranks = spark.read.schema("rank int, id bigint").parquet(f"{uri}/ranks").orderBy("rank").collect()
    id_of = np.array([row["id"] for row in ranks], np.uint32)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not ranks:  # nothing was written
        return spark.createDataFrame([], schema)
    totals = listed.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("bigint").alias("part_start"))
    content = (
        spark.read.format("binaryFile")
        .load(f"{uri}/files")
        .select(F.regexp_extract("path", r"([0-9]+)-[0-9]+[.]vtok$", 1).cast("int").alias("part"), "content")
    )

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column(0)[i].as_py()
                rows = list(file_rows(batch.column(1)[i].as_buffer().to_pybytes(), id_of))
                columns = [
                    pa.array([doc for doc, _, _ in rows], pa.int64()),
                    pa.array([at + start for _, start, _ in rows], pa.int64()),
                    pa.array([len(ids) // 4 for _, _, ids in rows], pa.int64()),
                    pa.array([ids for _, _, ids in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return content.join(F.broadcast(parts), "part").select("part_start", "content").mapInArrow(decode, schema)
