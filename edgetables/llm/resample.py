"""Importance resampling towards a target corpus, by bit-sliced aggregation.

Words are features, hashed into buckets.  A bucket's gain is the logarithm of how
much commoner it is in the target than in the corpus, as an integer.  The counts of
a document's buckets become planes of bits, one bit per bucket and one plane per
binary digit; the gains become planes of their two's complement.  The sum of
counts times gains is then the number of common bits of every pair of planes times
a power of two, exactly.  A Gumbel number from a hash of the id turns the draw
without replacement into a choice of the highest scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from edgetables.llm.common import Folder, chunks_of
from edgetables.operators.groups import rank_in_group

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
CHUNK = 1_000_000
TABLE_BYTES = 64  # features up to so many bytes go through the tables
SEPARATOR = re.compile("[\x00-/:-@[-`{-\x7f]")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x80] = False
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = True


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to a CRC-32 by its distance from the end, and the CRC-32 of so many zero bytes."""
    # One byte alone: its CRC differs from that of a zero byte by what the byte adds.
    first = np.array([zlib.crc32(bytes([byte])) ^ zlib.crc32(b"\0") for byte in range(256)], np.uint32)
    rows = [first]
    for _ in range(TABLE_BYTES - 1):
        rows.append(first[rows[-1] & 0xFF] ^ (rows[-1] >> np.uint32(8)))
    return np.array(rows), np.array([zlib.crc32(bytes(n)) for n in range(TABLE_BYTES + 1)], np.uint32)


_BYTE_CRC, _ZEROS_CRC = _crc_tables()


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of many pieces ``data[start : start + size]``, which may overlap; no size is 0."""
    out = np.empty(len(starts), np.uint32)
    short = sizes <= TABLE_BYTES
    for k in np.flatnonzero(~short).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]])
    if short.any():
        begin, size = starts[short], sizes[short]
        ends = np.cumsum(size)
        at = np.arange(ends[-1])
        to_end = np.repeat(ends, size) - 1 - at
        byte = data[np.repeat(begin + size, size) - 1 - to_end]
        out[short] = np.bitwise_xor.reduceat(_BYTE_CRC[to_end, byte], ends - size) ^ _ZEROS_CRC[size]
    return out


def features(texts: list[str], longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bucket, words)``: text number and bucket of every run of up to ``longest`` words; words of each text."""
    coded = [text.encode() for text in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*coded, b"\n"]), np.uint8)]
    word = _IN_WORD[data]
    ends_here = word[:-1] & ~word[1:]
    kept = word.copy()
    kept[1:] |= ends_here  # and one space after each word
    ends = np.flatnonzero(ends_here) + 1
    text_ends = np.cumsum([len(text) + 1 for text in coded])
    text_of = np.searchsorted(text_ends, ends, "left")
    data = np.where(word, data, np.uint8(0x20))[kept]
    stops = np.flatnonzero(data == 0x20)
    starts = np.r_[0, stops + 1][: len(stops)]
    found_in, found = [], []
    for n in range(1, longest + 1):
        last = len(stops) - n + 1
        if last <= 0:
            break
        same = text_of[:last] == text_of[n - 1 :]
        begin = starts[:last][same]
        found.append(crc32_of(data, begin, stops[n - 1 :][same] - begin) % np.uint32(buckets))
        found_in.append(text_of[:last][same])
    nothing = np.zeros(0, np.int64)
    return (
        np.concatenate([nothing, *found_in]),
        np.concatenate([nothing, *found]),
        np.bincount(text_of, minlength=len(texts)),
    )


def pieces(texts: list[str], longest: int) -> Iterator[tuple[int, list[str]]]:
    """``(number of the first, texts)`` of chunks of texts; very long texts come alone and, for single words, cut between words."""
    for start, end in chunks_of(texts, CHUNK):
        one = texts[start]
        if longest > 1 or end - start > 1 or len(one) <= 2 * CHUNK:
            yield start, texts[start:end]
            continue
        at = 0
        while at < len(one):
            gap = SEPARATOR.search(one, at + CHUNK)
            stop = gap.end() if gap else len(one)
            yield start, [one[at:stop]]
            at = stop


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; every task adds up its own, so at most ``buckets`` rows a task are shuffled."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in pieces([text or "" for text in batch.column(0).to_pylist()], longest):
                total += np.bincount(features(texts, longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket bigint, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one for each bucket at most
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both distributions, one added to every count."""
    n, s, t = float(len(corpus)), corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """``uint64[bit, word]``: the lowest bits of every bucket's value, in two's complement if it is negative."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.int64)
    padded[: len(values)] = values
    digits = (padded[None, :] >> np.arange(bits)[:, None] & 1).astype(np.uint8)
    return np.packbits(digits, axis=1, bitorder="little").view(np.uint64)


def count_planes(text_of: np.ndarray, bucket: np.ndarray, n_texts: int, buckets: int) -> list[np.ndarray]:
    """The bucket counts of every text: for each binary digit ``uint64[text, word]``."""
    n_bytes = -(-buckets // 64) * 8
    key, n = np.unique(text_of * buckets + bucket, return_counts=True)
    at, bit = key // buckets * n_bytes + key % buckets // 8, (1 << (key % buckets & 7)).astype(np.uint8)
    planes = []
    for digit in range(int(n.max(initial=0)).bit_length()):
        plane, has = np.zeros(n_texts * n_bytes, np.uint8), n >> digit & 1 == 1
        np.bitwise_or.at(plane, at[has], bit[has])
        planes.append(plane.view(np.uint64).reshape(n_texts, -1))
    return planes


def sliced_sums(counts: list[np.ndarray], gains: np.ndarray) -> np.ndarray:
    """Sum of counts times gains of every text, from the bits that their planes share."""
    total, top = 0, len(gains) - 1
    for i, plane in enumerate(counts):
        for j, gain in enumerate(gains):
            common = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
            total = total + (common << (i + j)) * (-1 if j == top else 1)
    return total


def importance(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """``(doc_id, n_features, n_words, weight)`` of every row, the weight being the floored mean gain of its features."""
    buckets = len(gains)
    planes = planes_of(gains, int(np.maximum(gains, -gains - 1).max(initial=0)).bit_length() + 1)

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            n, words, sums = (np.zeros(len(texts), np.int64) for _ in range(3))
            for start, some in pieces(texts, longest):
                text_of, bucket, n_words = features(some, longest, buckets)
                here = slice(start, start + len(some))
                n[here] += np.bincount(text_of, minlength=len(some))
                words[here] += n_words
                sums[here] += sliced_sums(count_planes(text_of, bucket, len(some), buckets), planes)
            columns = [batch.column(0), *map(pa.array, (n, words, sums // np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(weigh, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")


def gumbel(doc_id: str, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number, fixed by the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs (doc_id, text)``.

    ``rank`` counts the drawn rows by falling score, ties going to the smaller
    id: ``percent`` of the rows with ``least_words`` words, rounded down.

    A null or empty text, and one without a word, has no features and weight 0.
    Rows that repeat are drawn each, in consecutive ranks.  Rows without an id
    count in the corpus but have no score and are not drawn.  An empty ``docs``
    gives no rows, an empty ``target`` gains against an even distribution.
    Further columns of both tables are not looked at.
    """
    folder = Folder(docs.sparkSession)
    gains = gains_of(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = importance(docs, gains, longest).withColumn("score", F.col("weight") + gumbel("doc_id"))
    scored = folder.store(weighed, "scored")
    may = scored.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    rows = scored.select("doc_id", "n_features", "weight", "score")
    drawn = percent * may.count() // 100
    in_order = may.select(F.lit(0).alias("all"), (-F.col("score")).alias("falling"), "doc_id", "n_features", "weight", "score")
    ranked = rank_in_group(in_order, ["all"], ["falling", "doc_id"]).withColumn("rank", F.col("row_num").cast("bigint"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.filter((F.col("n_words") < least_words) | F.col("score").isNull())
    return ranked.select(*rows.columns, rank).unionByName(rest.select(*rows.columns, F.lit(None).cast("bigint").alias("rank")))
