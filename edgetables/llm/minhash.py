"""Near-duplicate documents by b-bit MinHash.

Every document gets the minima of 384 hash functions over its shingles.  Four
full minima make a band, 32 bands take the first 128, and documents that share a
band meet.  What travels with a document is a packed signature of the low four
bits of all minima: equal bits are counted, corrected for the chance of one in sixteen that they agree by
accident, and pairs far below the threshold go no further.  The others are
confirmed on their full sets.  A pair at a similarity of 0.8 shares none of the
32 bands with a chance of 5e-8.

Groups of copies are never expanded into pairs.  Documents with one set are one
node.  In a band all documents meet one of it, its head: at first the one with
the most band neighbours in all, which in a group of edited copies is the original
or close to it, then another one, drawn by a hash.  Only bands whose documents are not yet
connected go on.  What is left of them has met the first head and is
outlined against it: one bit for each of the head's shingles.  Two documents have
in common what their outlines share, and at most the smaller of what each
shares with any document outside the head.  Blocks of outlines are compared by
bit counts, and only pairs that this bound and the estimate allow leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from edgetables.llm.common import Folder, arrow_schema, batch_of, chunks_of, slices, trimmed
from edgetables.llm.shingles import mixed, shingle_sets
from edgetables.plans.components import connected_components

WORDS = 5
PERCENT = 80
BANDS, ROWS, BITS = 32, 4, 4
HASHES = 384  # the first BANDS * ROWS make the bands
LANES = HASHES * BITS // 64  # 64-bit numbers of a packed signature
ESTIMATE_MARGIN = 0.11  # more than five standard deviations of the estimate at 0.8
ROUNDS = 2
BLOCK_ROWS = 2048  # outlines compared with as many others in one task
OUTLINED = "ref bigint, variant bigint, rep bigint, size bigint, outline binary"
SIGNED = "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, packed array<bigint>, bands array<bigint>"
CHUNK = 500_000

_random = np.random.Generator(np.random.PCG64(19_970_611))
_TIMES = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = _random.integers(0, 2**63, (ROWS, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """``uint64[set, hash]``: 32-bit minima over non-empty sets."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((values * _TIMES[k] + _PLUS[k]) >> np.uint64(32), starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima: for every 64 hashes one 64-bit number per bit."""
    bits = (low[:, None, :] >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    planes = np.packbits(bits, axis=2, bitorder="little").view(np.int64)  # set, bit, group of hashes
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(len(low), LANES)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One number per band from its full minima; different bands have different numbers."""
    sums = (low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS) * _BAND.T).sum(axis=2, dtype=np.uint64)
    return mixed(sums + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def likely(one: list[Column], other: list[Column], percent: int) -> Column:
    """Whether two packed signatures allow the similarity, by the minima that agree in all bits."""
    differ = F.lit(0)
    for group in range(0, LANES, BITS):
        odd = [one[k].bitwiseXOR(other[k]) for k in range(group, group + BITS)]
        differ = differ + F.bit_count(reduce(Column.bitwiseOR, odd))
    chance = 2.0**-BITS
    least = chance + (1 - chance) * (percent / 100 - ESTIMATE_MARGIN)  # share of minima that agree
    return differ <= math.floor((1 - least) * HASHES)


def lanes_of(array: str) -> list[Column]:
    return [F.col(array)[k] for k in range(LANES)]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per document: size and 128-bit key of its set, packed signature, band keys; nulls without a set."""
    schema = arrow_schema(SIGNED)

    def sign(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [text or "" for text in batch.column(1).to_pylist()]
            for start, end in chunks_of(texts, CHUNK):
                sets = shingle_sets(texts[start:end], words)
                full = [k for k, found in enumerate(sets) if len(found)]
                rows = [(doc, 0, None, None, None, None) for doc in ids[start:end]]
                if full:
                    low = minima([sets[k] for k in full])
                    for k, bits, bands in zip(full, packed(low), band_keys(low)):
                        found = sets[k]
                        keys = [int(mixed(found ^ _PLUS[j]).sum(dtype=np.uint64).view(np.int64)) for j in (0, 1)]
                        rows[k] = (ids[start + k], len(found), *keys, bits, bands)
                yield batch_of(rows, schema)

    return docs.mapInArrow(lambda batches: trimmed(sign(batches)), SIGNED)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(src, dst)`` whose full sets are similar enough; each text is cut into its set next to its pair."""
    texts = docs.select("doc_id", "text")
    with_dst = pairs.join(texts.withColumnsRenamed({"doc_id": "dst", "text": "dst_text"}), "dst")
    both = with_dst.join(texts.withColumnsRenamed({"doc_id": "src", "text": "src_text"}), "src")

    def confirm(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, last_set = None, None
        for batch in batches:
            src, dst = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            step = max(1, CHUNK * batch.num_rows // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                some = slice(start, start + step)
                others = shingle_sets([text or "" for text in batch.column(3)[some].to_pylist()], words)
                for k, found in enumerate(others, start):
                    text = batch.column(2)[k].as_py() or ""
                    if text != last:
                        last, last_set = text, shingle_sets([text], words)[0]
                    at = np.searchsorted(last_set, found)
                    at[at == len(last_set)] = 0
                    common = int((last_set[at] == found).sum()) if len(last_set) else 0
                    if common and 100 * common >= percent * (len(last_set) + len(found) - common):
                        kept.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([src[k] for k in kept], pa.int64()), pa.array([dst[k] for k in kept], pa.int64())],
                names=["src", "dst"],
            )

    return both.select("src", "dst", "src_text", "dst_text").mapInArrow(lambda batches: trimmed(confirm(batches)), "src bigint, dst bigint")


def shared_sizes(docs: DataFrame, words: int) -> DataFrame:
    """``(rep, size, shared)``: size of each set, and how many of its shingles another set of ``docs`` holds too.

    No two sets have more in common than either shares with all others.  An id with
    several texts gets its smallest size and its largest share.
    """
    schema = arrow_schema("rep bigint, variant bigint, shingle bigint")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [text or "" for text in batch.column(1).to_pylist()]
            for start, end in chunks_of(texts, CHUNK):
                sets = shingle_sets(texts[start:end], words)
                sizes = [len(found) for found in sets]
                variant = np.array([found.sum(dtype=np.uint64) for found in sets], np.uint64).view(np.int64)
                columns = [np.repeat(np.array(ids[start:end]), sizes), np.repeat(variant, sizes)]
                columns = [pa.array(c) for c in (*columns, np.concatenate(sets).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    one = ["rep", "variant"]
    shingles = docs.dropDuplicates().mapInArrow(lambda batches: trimmed(cut(batches)), "rep bigint, variant bigint, shingle bigint")
    counted = shingles.groupBy("shingle").agg(*[F.min(c).alias(c) for c in one], F.count(F.lit(1)).alias("n"))
    alone = counted.filter("n = 1").groupBy(*one).agg(F.count(F.lit(1)).alias("alone"))
    sizes = shingles.groupBy(*one).agg(F.count(F.lit(1)).alias("size")).join(alone, one, "left")
    return sizes.groupBy("rep").agg(
        F.min("size").alias("size"), F.max(F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared")
    )


def outlined(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``(ref, variant, rep, size, outline)`` for pairs ``(ref, rep)``: which shingles of ``ref`` are in ``rep``, as bits.

    ``variant`` tells several texts of one ``ref`` apart.
    """
    texts = docs.select("doc_id", "text").dropDuplicates()
    with_ref = pairs.join(texts.withColumnsRenamed({"doc_id": "ref", "text": "ref_text"}), "ref")
    both = with_ref.join(texts.withColumnsRenamed({"doc_id": "rep", "text": "rep_text"}), "rep")
    schema = arrow_schema(OUTLINED)

    def outline(batches: Iterator) -> Iterator:
        last, last_set, variant = None, None, 0
        for batch in batches:
            ref, rep = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            step = max(1, CHUNK * batch.num_rows // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                rows = []
                others = shingle_sets([text or "" for text in batch.column(3)[start : start + step].to_pylist()], words)
                for k, found in enumerate(others, start):
                    text = batch.column(2)[k].as_py() or ""
                    if text != last:
                        last, last_set = text, shingle_sets([text], words)[0]
                        variant = int(last_set.sum(dtype=np.uint64).view(np.int64))
                    bits = np.packbits(np.isin(last_set, found, assume_unique=True))
                    rows.append((ref[k], variant, rep[k], len(found), bits.tobytes()))
                yield batch_of(rows, schema)

    return both.select("ref", "rep", "ref_text", "rep_text").mapInArrow(lambda batches: trimmed(outline(batches)), OUTLINED)


def allowed_pairs(outlines: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(src, dst)`` with different labels that may be similar enough, by outlines ``(ref, variant, rep, size, outline, label, shared)``.

    The rows of one ``ref`` are dealt to blocks, and every two blocks meet in a
    group of their own, so no task holds more than two blocks.
    """
    key = ["ref", "variant"]
    sizes = outlines.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    open_ = outlines.join(sizes.filter("low < high").select(*key, blocks.alias("blocks")), key)
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = open_.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        *key, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "rep", "label", "size", "shared", "outline",
    )
    schema = arrow_schema("src bigint, dst bigint")

    def meet(cell):
        block = cell["block"].to_numpy()
        rep, label, size, shared = (cell[c].to_numpy() for c in ("rep", "label", "size", "shared"))
        bits = np.frombuffer(b"".join(cell["outline"].to_pylist()), np.uint8).reshape(len(rep), -1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        beyond = np.maximum(shared - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), 0)
        one, two = cell["one"][0].as_py(), cell["two"][0].as_py()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        rows = []
        for k, a in enumerate(left.tolist()):
            with_ = right[k + 1 :] if one == two else right
            with_ = with_[label[with_] != label[a]]
            common = np.bitwise_count(bits[with_] & bits[a]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[with_], beyond[a])
            for b in with_[100 * common >= percent * (size[with_] + size[a] - common)].tolist():
                if rep[a] != rep[b]:
                    rows.append((min(int(rep[a]), int(rep[b])), max(int(rep[a]), int(rep[b]))))
        import pyarrow as pa

        return pa.Table.from_batches([batch_of(rows, schema)], schema)

    return cells.groupBy(*key, "one", "two").applyInArrow(meet, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row per row of ``docs (doc_id, text)``.

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their
    sets of shingles of ``words`` words; ``component_id`` is the smallest id
    reachable over links and ``kept`` marks the document that gave it.

    A null text, or one without words, has an empty set and links with nothing; a
    text of fewer words than a shingle is one shingle.  Rows that share an id are
    one node.  Rows without an id link with nothing and are kept.  An empty table
    gives no rows.  Further columns are not looked at.
    """
    folder = Folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = folder.store(signatures(docs, words), "signed")
    key = ["key1", "key2", "n_shingles"]
    firsts = (
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    )
    firsts = folder.store(firsts, "firsts")
    nodes = (
        signed.withColumnRenamed("doc_id", "rep").join(firsts, [*key, "rep"], "left_semi").dropDuplicates([*key, "rep"])
    )
    packs = folder.store(nodes.select("rep", "packed", "bands"), "nodes")
    met = packs.select("rep", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = folder.store(met.join(shared, "band"), "met")
    near = met.groupBy("rep").agg(F.sum("n").alias("near"))
    open_ = folder.store(met.select("rep", "band").join(near, "rep"), "open-0")
    first_heads, labels, links, done = None, None, None, None
    for turn in range(rounds + 1):
        rows = open_
        if labels is not None:
            rows = rows.join(labels, "rep", "left")
        rows = rows.withColumn("label", F.col("rep") if labels is None else F.coalesce("label", "rep"))
        drawn = F.xxhash64("rep", "band", F.lit(turn))
        drawn = F.struct(-F.col("near") if turn == 0 else drawn, drawn, "rep", "label")
        heads = (
            rows.groupBy("band")
            .agg(F.min(drawn).alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
            .filter("low < high")
            .select("band", "head")
        )
        held = folder.store(rows.join(heads, "band"), f"held-{turn}")
        if held.isEmpty():
            break
        if turn == 0:
            first_heads = held.groupBy("band").agg(F.first("head.rep").alias("ref"))
        if turn < rounds:
            pairs = held.filter("rep <> head.rep and label <> head.label").select(
                F.least("rep", "head.rep").alias("src"), F.greatest("rep", "head.rep").alias("dst")
            )
        else:
            rest = held.select("band", "rep", "label").join(first_heads, "band").select("ref", "rep", "label").distinct()
            rest = folder.store(rest, "rest")
            both = rest.select(F.explode(F.array("ref", "rep")).alias("doc_id")).distinct()
            sizes = shared_sizes(docs.join(both, "doc_id", "left_semi"), words)
            outlines = outlined(rest.select("ref", "rep"), docs, words)
            outlines = outlines.join(rest, ["ref", "rep"]).join(sizes.select("rep", "shared"), "rep")
            pairs = allowed_pairs(folder.store(outlines, "outlines"), percent)
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["src", "dst"], "left_anti")
        sides = packs.select("rep", "packed")
        pairs = (
            pairs.join(sides.withColumnsRenamed({"rep": "dst", "packed": "dst_packed"}), "dst")
            .join(sides.withColumnsRenamed({"rep": "src", "packed": "src_packed"}), "src")
            .filter(likely(lanes_of("src_packed"), lanes_of("dst_packed"), percent))
            .select("src", "dst")
        )
        pairs = folder.store(pairs, f"pairs-{turn}")
        found = folder.store(confirmed(pairs, docs, words, percent), f"links-{turn}")
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
        if turn < rounds:
            open_ = held.filter("rep <> head.rep").select("band", "rep", "near")
    groups = firsts if labels is None else firsts.join(labels, "rep", "left")
    smallest = F.coalesce("label", "rep") if labels is not None else F.col("rep")
    placed = signed.select("doc_id", *key).join(groups.select(*key, smallest.alias("found")), key, "left")
    return placed.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
