"""Packing of documents into training sequences: concatenate and cut.

All ids, in one stable order of the documents, form one long row of tokens that
is cut every ``window`` tokens.  Two passes find the place of every document in
that row: the first encodes the documents where they lie and keeps running
totals inside its partition, the second adds the totals of the partitions
before.  No document moves to another task for that.  Only the pieces on both
sides of a cut share a sequence with other tasks' pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from edgetables.llm.common import Folder, arrow_schema, batch_of, slices, trimmed
from edgetables.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
PAD_ID = 0
PIECE_BYTES = 8_000_000


def encoded(docs: DataFrame, tokenizer: str, end_id: int, white_matters: bool) -> DataFrame:
    """``(part, local_start, doc_id, doc_tokens, ids)``: ids of whole texts and their place in the partition.

    A null text counts as empty; every document ends with ``end_id``.
    """

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part, start = TaskContext.get().partitionId(), 0
        words, end = encoder(tokenizer, white_matters), np.uint32(end_id).tobytes()
        for batch in slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids = [got + end for got in words.encode(texts)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), batch.column(0), pa.array(sizes), pa.array(ids, pa.binary())],
                names=["part", "local_start", "doc_id", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        lambda batches: trimmed(encode(batches)), "part int, local_start bigint, doc_id bigint, doc_tokens bigint, ids binary"
    )


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, white_matters: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``start`` counts the ids of the document before the piece, ``offset`` those of
    the sequence before it; ``ids`` are little-endian unsigned 32-bit.  Every
    sequence but the last is full, whatever the documents' lengths.

    A null or empty text is the end id alone; a very long text spans many
    sequences; rows that repeat, and null ids, are documents of their own; an
    empty table gives no rows.  Further columns of ``docs`` are not looked at.
    """
    folder = Folder(docs.sparkSession)
    placed = folder.store(encoded(docs, tokenizer, end_id, white_matters), "ids")
    totals = placed.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row per partition of the input: the window and the broadcast stay small for any number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("bigint").alias("before"))
    located = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("at"), "doc_tokens", "ids"
    )

    columns = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    schema = arrow_schema(columns)

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                doc, at, size = (batch.column(c)[i].as_py() for c in range(3))
                ids = memoryview(batch.column(3)[i].as_buffer())
                for sequence in range(at // window, (at + size - 1) // window + 1):
                    low, high = max(sequence * window, at), min((sequence + 1) * window, at + size)
                    piece = bytes(ids[4 * (low - at) : 4 * (high - at)])
                    rows.append((doc, low - at, high - low, piece, size, sequence, low - sequence * window))
                    held += len(piece)
                    if held > PIECE_BYTES:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
            yield batch_of(rows, schema)

    return located.mapInArrow(cut, columns)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = PAD_ID) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: whole sequences with their ids, ready to train on.

    A sequence whose length is a power of two stays as it is, any other short
    one (at most the last) is filled up to ``window`` with ``pad_id``.  A group
    is at most ``window`` ids, so it always fits a task.
    """
    joined = (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .withColumn(
            "held", F.aggregate("parts", F.lit(b""), lambda so_far, part: F.concat(so_far, part["ids"]))
        )
    )
    round_size = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (window - F.col("n_tokens")).cast("int")))
    return joined.select(
        "sequence_id", "n_tokens", F.when(round_size, F.col("held")).otherwise(F.concat("held", pad)).alias("ids")
    )
