"""Exact top-k search by inner product over a bit-sliced index.

Vectors are integers per component.  A block of rows keeps, for every component
and bit, a bitmap over its rows (two's complement).  The score of all rows of a
block is added up in bitmap arithmetic: each non-zero signed digit of a query
component contributes the component's slices, shifted, to columns of bitmaps that
full adders reduce to the slices of the sum.  Only the upper slices of a
component go in; what the lower ones can add is bounded by the query.  The k-th
largest sum is found from its most significant slice downward, and every row
whose bound reaches it, the boundary rows, is scored exactly from all slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from edgetables.llm.common import Folder

TOP_SLICES = 7
SMALLEST, LARGEST = -(2**63), 2**63 - 1
BLOCK_ROWS = 16_384
LEAST_QUERIES, MOST_QUERIES = 256, 65_536  # in one task


def quantised(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null for vectors that take no part."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    codes = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return F.when(F.col(vector).isNotNull() & finite & (F.size(vector) > 0), codes)


def slices_of(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """``(bits, bitmaps)``: bitmaps as ``uint64[component, bit, word]`` of rows by components."""
    most = int(np.maximum(codes, -codes - 1).max(initial=0))
    bits, words = most.bit_length() + 1, -(-len(codes) // 64)
    padded = np.zeros((words * 64, codes.shape[1]), np.int64)
    padded[: len(codes)] = codes
    planes = (padded.T[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(np.uint8)
    return bits, np.packbits(planes, axis=-1, bitorder="little").view(np.uint64)


@cache
def signed_digits(n: int) -> list[tuple[int, int]]:
    """Non-adjacent form: ``n`` as a sum of ``digit * 2**shift``, digit 1 or -1."""
    out, shift = [], 0
    while n:
        if n & 1:
            digit = 2 - (n & 3)
            out.append((shift, digit))
            n -= digit
        n >>= 1
        shift += 1
    return out


def add_columns(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sum of all bitmaps, the rows of ``columns[w]`` counting ``2**w``; thirds of a column are added at once."""
    out, carried, weight = [], [], 0
    while weight < len(columns) or carried:
        x = np.concatenate([*columns[weight : weight + 1], *carried])
        carried = []
        while len(x) > 2:
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            both = a ^ b
            carried.append((a & b) | (both & c))
            x = np.concatenate([both ^ c, x[3 * k :]])
        if len(x) == 2:
            carried.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else None)
        weight += 1
    return out


def kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among ``rows`` (a bitmap), from the most significant slice downward."""
    above, equal, value = 0, rows, 0
    for weight in range(len(sums) - 1, -1, -1):
        if sums[weight] is None:
            continue
        ones = equal & sums[weight]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal = ones
            value |= 1 << weight
        else:
            above += n
            equal = equal & ~sums[weight]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of ``rows`` whose sum is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(sums):
        return np.zeros_like(rows)
    greater, equal = np.zeros_like(rows), rows
    for weight in range(len(sums) - 1, -1, -1):
        ones = equal & sums[weight] if sums[weight] is not None else np.zeros_like(rows)
        if value >> weight & 1:
            equal = ones
        else:
            greater = greater | ones
            equal = equal & ~ones
    return greater | equal


class Block:
    """One block of the index."""

    def __init__(self, ids: np.ndarray, bits: int, bitmaps: np.ndarray):
        self.ids, self.bits, self.bitmaps = ids, bits, bitmaps
        self.bytes = bitmaps.view(np.uint8)
        self.low = max(0, bits - TOP_SLICES)
        words = bitmaps.shape[2]
        valid = np.zeros(words * 64, np.uint8)
        valid[: len(ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        upper = bitmaps[:, self.low :]
        self.kept = upper.shape[1]
        self.planes = np.concatenate([upper, ~upper]).reshape(-1, words)  # each slice as it is, then inverted
        self.order = np.argsort(ids, kind="stable")
        self.weights = np.array([1 << b for b in range(bits - 1)] + [-(1 << bits - 1)], np.int64)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """All components of some rows, from all slices: ``int64[component, row]``."""
        held = self.bytes[:, :, rows >> 3] >> (rows & 7).astype(np.uint8) & 1
        return np.tensordot(self.weights, held, axes=(0, 1))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of at least the k best rows."""
        columns: list[list[int]] = []
        offset, last = 0, self.kept - 1
        inverted = len(self.planes) // 2
        for d in np.flatnonzero(query).tolist():
            for shift, digit in signed_digits(int(query[d])):
                while len(columns) < shift + self.kept:
                    columns.append([])
                for b in range(self.kept):
                    plane = d * self.kept + b
                    if (digit < 0) != (b == last):  # -x is (1 - x) - 1
                        columns[shift + b].append(inverted + plane)
                        offset -= 1 << shift + b
                    else:
                        columns[shift + b].append(plane)
        sums = add_columns([self.planes[column] for column in columns])
        rows = self.valid.copy()
        mine = np.searchsorted(self.ids, own, "left", sorter=self.order), np.searchsorted(self.ids, own, "right", sorter=self.order)
        for row in self.order[mine[0] : mine[1]].tolist():
            rows[row >> 6] &= ~np.uint64(1 << (row & 63))
        n = int(np.bitwise_count(rows).sum())
        rest = (1 << self.low) - 1  # most that the lower slices of one component add
        lowest, highest = (sum(map(int, some)) * rest for some in (query[query < 0], query[query > 0]))
        if n > k:
            reached = min(((kth_largest(sums, rows, k) + offset) << self.low) + lowest, LARGEST)
            if reached > SMALLEST:  # sums whose score may reach it
                rows = at_least(sums, rows, -(-(reached - highest) // (1 << self.low)) - offset)
        found = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        return self.ids[found], scores(query, self.codes(found))


def scores(query: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products as longs; those that a long cannot hold are its largest or smallest value."""
    most = int(np.maximum(codes, -codes - 1).max(initial=0)) + 1
    if sum(abs(int(x)) for x in query) * most <= LARGEST:
        return query.astype(np.int64) @ codes
    exact = query.astype(object) @ codes.astype(object)
    return np.array([min(max(score, SMALLEST), LARGEST) for score in exact], np.int64)


def build_index(vectors: DataFrame, folder: Folder, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Store the index of all rows and return it: ``block, dims, n, ids, bits, bitmaps``."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(vector, scale).alias("codes"))

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}

        def out(dims):
            ids, codes = zip(*held.pop(dims))
            bits, bitmaps = slices_of(np.array(codes, np.int64))
            columns = [[dims], [len(ids)], [np.array(ids, np.int64).tobytes()], [bits], [bitmaps.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            names = ["dims", "n", "ids", "bits", "bitmaps"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for vec_id, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = held.setdefault(len(codes), [])
                some.append((vec_id, codes.values.to_numpy()))
                if len(some) >= BLOCK_ROWS:
                    yield out(len(codes))
        for dims in list(held):
            yield out(dims)

    used = rows.filter("codes is not null and vec_id is not null")
    n = vectors.count()
    blocks = used.repartition(max(1, math.ceil(n / BLOCK_ROWS))).mapInArrow(
        build, "dims int, n int, ids binary, bits int, bitmaps binary"
    )
    return folder.store(blocks.withColumn("block", F.monotonically_increasing_id()), "index")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the highest inner product for every query.

    Both tables have ``vec_id`` and the vector column.  Ties go to the smaller
    id.  Rows with the query's own id are no candidates; a query id that occurs
    more than once asks with the smallest of its vectors; candidate rows that
    repeat are rows of their own.  Null or empty vectors, vectors with null or
    non-finite components and rows without an id take no part, neither do
    candidates with another number of components than the query.  Components
    whose integer a long cannot hold count as its largest or smallest value, and
    so do scores, which then tie.  Fewer
    candidates than ``k`` give fewer rows, an empty table none.  Further columns
    are not looked at.
    """
    spark = vectors.sparkSession
    folder = Folder(spark)
    index = build_index(vectors, folder, vector, scale)
    asked = (
        queries.select(F.col("vec_id").cast("bigint").alias("query_id"), quantised(vector, scale).alias("codes"))
        .filter("codes is not null and query_id is not null")
        .groupBy("query_id")
        .agg(F.min("codes").alias("codes"))
    )
    asked = folder.store(asked, "queries")
    n_queries, n_blocks = asked.count(), index.count()
    cores = spark.sparkContext.defaultParallelism
    per_task = min(MOST_QUERIES, max(LEAST_QUERIES, math.ceil(n_queries * n_blocks / (4 * cores))))
    groups = max(1, math.ceil(n_queries / per_task))
    grouped = (
        asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        .groupBy("lot", F.size("codes").alias("dims"))
        .agg(F.collect_list(F.struct("query_id", "codes")).alias("asked"))
    )
    # Every lot of queries meets every block once; a lot is bounded by MOST_QUERIES.
    pairs = index.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition("block", "lot")
    met = pairs.join(grouped, ["lot", "dims"]).select("ids", "dims", "bits", "bitmaps", "asked")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids, dims, bits, maps = (batch.column(c)[i] for c in range(4))
                dims, bits = dims.as_py(), bits.as_py()
                maps = np.frombuffer(maps.as_buffer(), np.uint64).reshape(dims, bits, -1)
                block = Block(np.frombuffer(ids.as_buffer(), np.int64), bits, maps)
                rows = ([], [], [])
                for one in batch.column(4)[i].values.to_pylist():
                    query = np.array(one["codes"], np.int64)
                    found, score = block.best(query, one["query_id"], k)
                    best = np.lexsort((found, -1 - score))[:k]  # of the smallest long there is no negative
                    rows[0].extend([one["query_id"]] * len(best))
                    rows[1].extend(found[best].tolist())
                    rows[2].extend(score[best].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in rows], names=["query_id", "vec_id", "score"]
                )

    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
