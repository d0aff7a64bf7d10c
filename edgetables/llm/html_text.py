"""Main text of web pages: tags first, then what repeats across the pages of a host.

What stands in an ``article`` is kept whole, however often it occurs elsewhere;
what stands in a menu, a footer, a form and the like goes.  The text of which the
tags say nothing is decided by a suffix array of the token streams of each
host: stretches of at least ``LEAST_TOKENS`` tokens that occur on two pages or
more are boilerplate and go, token by token, and runs that occur on one page alone
stay, also inside a block; but of a block that is otherwise repeated, fewer than
``LEAST_TOKENS`` tokens are no text of their own and go with it.  An element of fewer
tokens goes if an equal one stands on another page.  Pages that are near
copies of each other count as one page.  Menus and footers are part of the streams,
as their texts turn up without their tags on other pages.

The stream of a page is all its text outside articles, over the borders of
elements.  Its suffixes are sorted by host and tokens, the tokens ordered by
their hashes: rows are partitioned by range and sorted inside the partitions.
A scan of each partition measures the common prefix of neighbours; where it
falls below ``LEAST_TOKENS``, an interval ends, and an interval that holds two
pages is a repeat.  Suffixes are compared by ``LEAST_TOKENS`` tokens, as longer
agreement decides nothing more: a longer repeat is the union of the beginnings
of its suffixes.  The ranges go on into stream and place, so an interval of any
size spreads over partitions; those at the ends of partitions, two for each,
are joined by their totals.  Equal streams of a host are one stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from edgetables.llm.common import Folder, arrow_schema, batch_of, slices
from edgetables.llm.markup import FRAMED, INSIDE, OPEN, blocks
from edgetables.llm.minhash import near_duplicates

LEAST_TOKENS = 6
BLOCK_END, ELEMENT_END = "\n", "\v"  # of a stream; neither occurs in a block
TOKEN_END = re.compile("[ \n\v]")
PARSED = (
    "row bigint, page_id bigint, url string, host string, texts array<string>, place_of array<int>, "
    "stream string, undecided boolean"
)
BATCH_CHARS = 4_000_000
SUFFIX = "suffix binary, stream bigint, at int, size int, low bigint, high bigint"


def parsed_page(content: str) -> tuple[list[str], list[int], str, bool]:
    """Blocks that may be kept, the place of each in the stream, the stream, and whether it holds undecided blocks.

    The stream is all blocks outside articles; blocks of an article have place -1.
    """
    texts, place_of, elements, undecided = [], [], [], False
    last, place = None, 0
    for text, state, segment in blocks(content):
        if state == INSIDE:
            texts.append(text)
            place_of.append(-1)
            continue
        if segment != last:
            last = segment
            elements.append([])
        elements[-1].append(text)
        if state != FRAMED:
            texts.append(text)
            place_of.append(place)
        undecided = undecided or state == OPEN
        place += 1
    return texts, place_of, ELEMENT_END.join(BLOCK_END.join(held) for held in elements), undecided


def parsed_pages(pages: DataFrame) -> DataFrame:
    schema = arrow_schema(PARSED)

    def parse(batches: Iterator) -> Iterator:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                row, page, url, host, content = (column[i].as_py() for column in batch.columns)
                rows.append((row, page, url, host, *parsed_page(content or "")))
                held += len(content or "")
                if held > BATCH_CHARS:
                    yield batch_of(rows, schema)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, schema)

    url = F.col("url").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("bigint").alias("page_id"),
        url.alias("url"),
        host.alias("host"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(parse, PARSED)


def stream_key(host: str = "host", stream: str = "stream") -> Column:
    """128 bits that stand for a stream of a host."""
    return F.unhex(F.md5(F.concat(F.col(host), F.lit("\n"), F.col(stream)).cast("binary")))


def suffixes_of(host: str, stream: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, at, size)``: the suffixes of a stream by host and first ``least`` tokens, and its shorter elements as they are."""
    own, ends = [], []
    for element in stream.split(ELEMENT_END):
        own += [xxhash.xxh3_64_intdigest(token) for token in TOKEN_END.split(element)]
        ends.append(len(own))
    sizes = np.diff(ends, prepend=0)
    short = np.flatnonzero(sizes < least)
    at = np.concatenate([np.arange(max(0, len(own) - least + 1)), np.array(ends)[short] - sizes[short]])
    size = np.concatenate([np.full(len(at) - len(short), least), sizes[short]])
    places = at[:, None] + np.arange(least)
    tokens = np.array(own + [0] * least, np.uint64)[places]
    tokens[np.arange(least) >= size[:, None]] = 0
    first = np.full((len(at), 1), xxhash.xxh3_64_intdigest(host), np.uint64)
    return np.hstack([first, tokens]).astype(">u8"), at, size


def kept_runs(stream: str, starts: np.ndarray, sizes: np.ndarray, least: int) -> list[str]:
    """The blocks of a stream without the stretches of ``sizes`` tokens that begin at ``starts``."""
    blocks_ = [block.split(" ") for element in stream.split(ELEMENT_END) for block in element.split(BLOCK_END)]
    ends = np.cumsum([len(block) for block in blocks_])
    steps = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    lone = np.cumsum(steps)[: ends[-1]] == 0
    out = []
    for block, end in zip(blocks_, ends.tolist()):
        rest = [token for token, alone in zip(block, lone[end - len(block) : end].tolist()) if alone]
        out.append(" ".join(rest) if len(rest) in (len(block), *range(least, len(block))) else "")
    return out


def repeats_of(batches: Iterator) -> Iterator:
    """From sorted suffixes: those of intervals with two pages, and with their suffix those of the first and last interval."""
    import pyarrow as pa

    def intervals(table):
        keys = np.frombuffer(b"".join(table.column("suffix").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        common = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)  # host and tokens that neighbours share
        return np.concatenate([[0], np.flatnonzero(common < keys.shape[1]) + 1])

    def closed(table, starts, border):
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        repeated = np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts)
        open_ = np.zeros(len(starts), bool)
        open_[0] = border
        rows = np.diff(starts, append=table.num_rows)
        chosen, own = np.repeat(repeated | open_, rows), np.repeat(open_, rows)
        suffix = pa.array(table.column("suffix").to_pylist(), pa.binary(), mask=~own)
        found = table.set_column(0, "suffix", suffix).filter(pa.array(chosen))
        return found.combine_chunks().to_batches(max_chunksize=10_000)

    held, first = [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[0].column(0)[0].as_py() == batch.column(0)[batch.num_rows - 1].as_py():
            held.append(batch)  # all of one interval that goes on
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = intervals(table)
        end = int(starts[-1])
        if end:
            yield from closed(table.slice(0, end), starts[:-1], first)
            first = False
        held = table.slice(end).to_batches()
    if held:
        yield from closed(pa.Table.from_batches(held).combine_chunks(), np.array([0]), True)


def repeated_blocks(streams: DataFrame, folder: Folder, least: int = LEAST_TOKENS) -> DataFrame:
    """``(key, kept)`` from ``streams (host, stream, page)``: by :func:`stream_key`, what is left of each block of a stream.

    ``page`` tells different pages apart; pages with one content should share it.
    Streams without a repeated stretch give no row.
    """
    distinct = streams.groupBy("host", "stream").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    numbered = distinct.withColumn("key", stream_key()).withColumn("number", F.monotonically_increasing_id())
    distinct = folder.store(numbered, "streams")

    def suffixes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [field.split()[0] for field in SUFFIX.split(", ")]
        for batch in slices(batches):
            for number, host, stream, low, high in zip(*(column.to_pylist() for column in batch.columns)):
                keys, at, size = suffixes_of(host, stream, least)
                n, width = keys.shape
                columns = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), n, [None, pa.py_buffer(keys.tobytes())])]
                columns[0] = columns[0].cast(pa.binary())
                columns += [pa.array(np.full(n, number)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))]
                columns += [pa.array(np.full(n, page, np.int64)) for page in (low, high)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = distinct.select("number", "host", "stream", "low", "high").mapInArrow(suffixes, SUFFIX)
    order = ["suffix", "stream", "at"]
    scanned = made.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(repeats_of, SUFFIX)
    scanned = folder.store(scanned, "repeats")
    # At most two intervals a partition.
    borders = scanned.filter("suffix is not null").groupBy("suffix").agg(F.min("low").alias("l"), F.max("high").alias("h"))
    crossing = scanned.join(F.broadcast(borders.filter("l < h")), "suffix", "left_semi")
    starts = (
        scanned.filter("suffix is null")
        .unionByName(crossing)
        .groupBy(F.col("stream").alias("number"))
        .agg(F.collect_list(F.struct("at", "size")).alias("starts"))
    )
    schema = arrow_schema("key binary, kept array<string>")

    def keep(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            rows = []
            for key, stream, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at, size = (some.values.field(k).to_numpy() for k in (0, 1))
                rows.append((key, kept_runs(stream, at, size, least)))
            yield batch_of(rows, schema)

    found = distinct.select("number", "key", "stream").join(starts, "number").select("key", "stream", "starts")
    return found.mapInArrow(keep, "key binary, kept array<string>")


def near_copies(parsed: DataFrame, folder: Folder) -> DataFrame:
    """``(row, copy_of)`` of the pages with undecided blocks that are near copies of a page on their host."""
    # Words carry their host, so pages of different hosts share none.
    words = F.split(F.array_join("texts", " "), r"\s+")
    own = F.array_join(F.transform(words, lambda w: F.concat(F.hex(F.xxhash64("host")), F.lit(":"), w)), " ")
    undecided = parsed.filter(F.col("undecided") & (F.size("texts") > 0)).select(F.col("row").alias("doc_id"), own.alias("text"))
    undecided = folder.store(undecided, "undecided")
    if undecided.isEmpty():
        return undecided.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("copy_of"))
    found = near_duplicates(undecided, words=4)
    return folder.store(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("copy_of")), "copies")


def main_text(pages: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """``(page_id, url, text)``: one row per row of ``pages (page_id, url, html)``.

    White space inside a block becomes one space, blocks are joined by one space,
    character references are decoded.  A null or empty html, or a page without
    text, gives an empty text.  Rows that repeat, and null ids, are rows of their
    own; pages with the same blocks, and near copies (0.8 of their shingles of four
    words) on one host, count as one page when repeats are sought, so copies do not
    erase each other.  A page of which everything would go as
    repeated keeps it.  Pages without a host share the empty one.  An empty table
    gives no rows.  Further columns are not looked at.
    """
    folder = Folder(pages.sparkSession)
    parsed = folder.store(parsed_pages(pages), "parsed")
    copies = near_copies(parsed, folder)
    page = F.coalesce(F.xxhash64("copy_of"), F.xxhash64("texts", "stream")).alias("page")
    streams = parsed.filter("stream <> ''").join(copies, "row", "left").select("host", "stream", page)
    flags = folder.store(repeated_blocks(streams, folder, least), "flags")
    open_ = parsed.filter("undecided").select("row", "page_id", "url", "texts", "place_of", stream_key().alias("key"))
    left = lambda text, i: F.coalesce(F.get("kept", F.get("place_of", i)), text)
    unique = F.filter(F.transform("texts", left), lambda text: text != "")
    kept = F.when(F.col("kept").isNull() | (F.size(unique) == 0), F.col("texts")).otherwise(unique)
    settled = parsed.filter("not undecided").select("page_id", "url", F.array_join("texts", " ").alias("text"))
    rest = open_.join(flags, "key", "left")
    return settled.unionByName(rest.select("page_id", "url", F.array_join(kept, " ").alias("text")))
