"""Fingerprints of documents by Order MinHash.

A text is the set of its runs of eight characters, each numbered by how often it
has occurred before.  Under each of 64 hash functions the two smallest elements are
picked and put into the order they have in the text; a hash of that pair is one
place of the fingerprint.  Two fingerprints agree in a place if the texts share
both elements in the same order, so moving passages about lowers their likeness,
as it raises their edit distance, while a plain MinHash would not see it
(Marcais and others, 2019).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from edgetables.llm.common import Folder, arrow_schema, batch_of, slices
from edgetables.llm.shingles import mixed

GRAM = 8
PICKED = 2
PLACES = 64  # of 16 bits: different pairs agree with a chance of 1.5e-5
BLOCK = 8192  # runs hashed at once
ROWS = 500

_random = np.random.Generator(np.random.PCG64(20_190_714))
_TIMES = _random.integers(0, 2**31, (PLACES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TURN = _random.integers(0, 2**32, (PLACES, 1), dtype=np.uint32)
_PLACE = _random.integers(0, 2**63, PLACES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` characters; a shorter text is one run."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(codes):
        return codes
    size = min(GRAM, len(codes))
    n = len(codes) - size + 1
    sums = np.zeros(n, np.uint64)
    for k in range(size):
        sums *= _BASE
        sums += codes[k : k + n]
    return mixed(sums)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each value has occurred before its place."""
    n = len(hashes)
    low = np.uint64((1 << n.bit_length()) - 1)
    keys = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))  # equal values side by side, in order of place
    first = np.r_[True, (keys[1:] ^ keys[:-1]) > low]
    at = np.arange(n)
    out = np.empty(n, np.uint64)
    out[(keys & low).astype(np.int64)] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def smallest(values: np.ndarray) -> np.ndarray:
    """``int64[place, picked]``: positions of the smallest elements under each hash function, in text order."""
    found, where = [], []
    row = np.arange(PLACES)
    for start in range(0, len(values), BLOCK):
        hashed = (values[None, start : start + BLOCK] ^ _TURN) * _TIMES
        for _ in range(min(PICKED, hashed.shape[1])):
            at = hashed.argmin(axis=1)
            found.append(hashed[row, at])
            where.append(at + start)
            hashed[row, at] = 0xFFFFFFFF
    found, where = np.array(found).T, np.array(where).T
    best = np.argsort(found, axis=1, kind="stable")[:, :PICKED]
    return np.sort(np.take_along_axis(where, best, axis=1), axis=1)


def fingerprint(text: str) -> np.ndarray:
    """``uint16[place]``; zeros for the empty text."""
    hashes = gram_hashes(text)
    if not len(hashes):
        return np.zeros(PLACES, np.uint16)
    elements = mixed(hashes + occurrences(hashes) * _STEP)
    picked = elements[smallest((elements >> np.uint64(32)).astype(np.uint32))]
    sums = _PLACE.copy()
    for k in range(picked.shape[1]):
        sums = mixed(sums * _BASE + picked[:, k])
    return (sums >> np.uint64(48)).astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of the places in which two fingerprints agree."""
    return float((one == other).mean())


def spliced(text: str, other: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compared(doc_id: int | None, text: str, mark: np.ndarray, after: str, after_mark: np.ndarray) -> tuple:
    """A row of ``OUT``."""
    edited = spliced(text, after)
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    marks = (mark.tobytes(), changed.tobytes())
    return doc_id, len(text), digest, *marks, likeness(mark, changed), likeness(mark, after_mark)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, fingerprint)`` for every row, without any shuffle.

    A null text counts as empty; equal texts have equal fingerprints.
    """

    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield column.map(lambda text: fingerprint(text or "").tobytes())

    signed = F.pandas_udf(sign, "binary")
    return docs.select("doc_id", "text", F.lower(F.hex(signed(F.col("text").cast("string")))).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of the text edited with the next document's, and both likenesses.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  Documents follow each other by falling ``doc_id``,
    the last one being followed by the first.

    A null text counts as empty; an empty one is like another empty one (1) and
    like nothing else.  A text shorter than a run is one run.  Ties: rows with one id follow each other
    by a hash of their texts, then by the texts; repeated rows follow each other.
    Rows without an id come last.  A single row follows itself; an empty
    table gives no rows.  Further columns are not looked at.

    Texts are shuffled once, into ranges of ids, and sorted there, so all but the
    last of a range have the next one at hand; the first and the last text of every
    range are kept and joined range to range.
    """
    folder = Folder(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    order = [F.desc("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    edges = f"{OUT}, part int, first boolean, last boolean, text string"
    schema, out_schema = arrow_schema(edges), arrow_schema(OUT)

    def walk(batches: Iterator) -> Iterator:
        part, held, done, first = TaskContext.get().partitionId(), None, [], True
        for batch in slices(batches):
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = fingerprint(body)
                if held:
                    done.append((*compared(*held, body, mark), part, first, False, held[1] if first else None))
                    first = False
                    if len(done) >= ROWS:
                        yield batch_of(done, schema)
                        done = []
                held = (doc_id, body, mark)
        if held:
            doc_id, body, mark = held
            done.append((doc_id, len(body), None, mark.tobytes(), None, None, None, part, first, True, body))
        yield batch_of(done, schema)

    walked = folder.store(rows.mapInArrow(walk, edges), "walked")
    heads = walked.filter("first").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    in_order = Window.orderBy("part")  # one row per range
    following = heads.select(
        "part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)).alias("next_part")
    )
    tails = walked.filter("last").select("part", "doc_id", "text", "fingerprint").join(following, "part")
    met = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part")

    def close(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            found = []
            for doc_id, body, mark, after, after_mark in zip(*[column.to_pylist() for column in batch.columns]):
                marks = [np.frombuffer(one, np.uint16) for one in (mark, after_mark)]
                found.append(compared(doc_id, body, marks[0], after, marks[1]))
            yield batch_of(found, out_schema)

    closed = met.select("doc_id", "text", "fingerprint", "after", "after_mark").mapInArrow(close, OUT)
    whole = walked.filter("not last").select(*closed.columns).unionByName(closed)
    as_text = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return whole.withColumns(as_text)
