"""Encoding to pieces and decoding back: Viterbi over a double-array trie of pieces with log scores.

A blank becomes the marker that pieces begin with, one marker is put before the
text, and the segmentation with the largest sum of log scores is taken.
A character that no piece covers is written as its bytes.  Decoding joins the
pieces, so every text comes back exactly; a marker character that stands in the
text itself is written as bytes, and is no blank when it comes back.

No piece continues past a blank, so the words of a text, each with the blanks
before it, are segmented one by one, and a worker remembers those it has met.  New
words go through the trie together, one position of all of them at a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from edgetables.llm.common import chunks_of, slices

MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # below the smallest score, for each character written as bytes
REMEMBERED = 200_000
CHUNK = 1_000_000
TOGETHER = 8_192  # words that pass the trie at once
LONG_WORD = 64  # bytes; longer words are segmented alone and not remembered
UNITS = re.compile(" *[^ ]+| +").findall


class Trie:
    """Double-array trie: the child of ``state`` under a byte is ``base[state] + byte`` where ``check`` names the state."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, number in keys.items():
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][byte]
            values[node] = number
        size = 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        place, waiting = {0: 0}, [0]
        resume = [0] * 257  # where the last node with as many children found room
        for node in waiting:
            state = place[node]
            value[state] = values[node]
            if not children[node]:
                continue
            labels = np.array(sorted(children[node]))
            start, window = resume[len(labels)], 32
            while True:
                while start + 4096 > size:
                    size *= 2
                    base = np.concatenate([base, np.zeros(size - len(base), np.int32)])
                    check, value = (np.concatenate([x, np.full(size - len(x), -1, np.int32)]) for x in (check, value))
                free = (check[start + np.arange(window)[:, None] + labels] < 0).all(axis=1)
                if free.any():
                    start += int(free.argmax())
                    break
                start, window = start + window, min(2048, 2 * window)
            base[state] = resume[len(labels)] = start
            for label in labels.tolist():
                check[start + label] = state
                place[children[node][label]] = start + label
                waiting.append(children[node][label])
        return cls(base, check, value)


@dataclass
class Pieces:
    """A vocabulary: each id's bytes with the marker as a blank, its log score, and the ids of single bytes."""

    content: list[bytes]
    scores: np.ndarray
    usable: list[bool]
    bytes_at: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Pieces of a SentencePiece file.

        Files of merge ranks hold no probabilities; their pieces get those of Zipf's
        law over the order of the file.
        """
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        at = next(i for i in range(n) if model.is_byte(i))
        usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        content = [bytes([i - at]) if model.is_byte(i) else model.id_to_piece(i).replace(MARKER, " ").encode() for i in range(n)]
        rank = np.cumsum(usable) + 1.0
        scores = -np.log(rank) - np.log((1 / rank[usable]).sum())
        return cls(content, scores, usable, at)

    @cached_property
    def trie(self) -> Trie:
        return Trie.build({c: i for i, c in enumerate(self.content) if self.usable[i] and c})

    @cached_property
    def unknown(self) -> float:
        return float(self.scores[self.usable].min()) - UNKNOWN_PENALTY


class Segmenter:
    """Encodes and decodes texts with one vocabulary, remembering words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        out: list[bytes] = []
        for start, end in chunks_of(texts, CHUNK):
            split = [UNITS(" " + text) if text else [] for text in texts[start:end]]
            used = set(chain.from_iterable(split))
            if len(self.known) + len(used) > REMEMBERED:
                self.known.clear()
            new = sorted(used - self.known.keys(), key=len)
            for i in range(0, len(new), TOGETHER):
                some = new[i : i + TOGETHER]
                self.known.update(zip(some, self.segment([word.encode() for word in some])))
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
            for word in [word for word in used if len(word) > LONG_WORD]:
                del self.known[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        joined = b"".join(map(self.pieces.content.__getitem__, ids.tolist()))
        return joined.decode("utf-8", "replace")[1:]

    def segment(self, words: list[bytes]) -> list[bytes]:
        """Ids of the best segmentation of each word."""
        short = [k for k, word in enumerate(words) if len(word) <= LONG_WORD]
        out: list[bytes] = [b""] * len(words)
        for k, ids in zip(short, self._together([words[k] for k in short])):
            out[k] = ids
        for k, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[k] = self._alone(word)
        return out

    def _ids(self, word: bytes, back: list[int], piece: list[int]) -> bytes:
        ids, end = [], len(word)
        while end:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(self.pieces.bytes_at + byte for byte in reversed(word[start:end]))
            end = start
        return array("I", ids[::-1]).tobytes()

    def _alone(self, word: bytes) -> bytes:
        """One long word, position by position."""
        trie, scores, unknown = self.pieces.trie, self.pieces.scores, self.pieces.unknown
        base, check, value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        n, low = len(word), float("-inf")
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            lead = word[at]
            if lead & 0xC0 == 0x80:
                continue
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, single = 0, False
            for end in range(at, n):
                following = base[state] + word[end]
                if check[following] != state or following == 0:
                    break
                state = following
                if value[state] >= 0:
                    single = single or end + 1 - at == width
                    total = best[at] + float(scores[value[state]])
                    if total > best[end + 1]:
                        best[end + 1], back[end + 1], piece[end + 1] = total, at, value[state]
            if not single and best[at] + unknown > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = best[at] + unknown, at, -1
        return self._ids(word, back, piece)

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Short words, all at the same position at once."""
        if not words:
            return []
        trie, scores, unknown = self.pieces.trie, self.pieces.scores, self.pieces.unknown
        sizes = np.array([len(word) for word in words])
        longest = int(sizes.max())
        data = np.zeros((longest, len(words)), np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        data[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = flat
        best = np.full((longest + 1, len(words)), -np.inf)
        back, piece = np.zeros((longest + 1, len(words)), np.int32), np.full((longest + 1, len(words)), -1, np.int32)
        best[0] = 0.0
        for at in range(longest):
            lead = data[at]
            here = np.flatnonzero((sizes > at) & (lead & 0xC0 != 0x80))
            width = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(words), bool)
            walking, state = here, np.zeros(len(here), np.int32)
            for end in range(at, longest):
                following = trie.base[state] + data[end, walking]
                fits = (trie.check[following] == state) & (following != 0) & (sizes[walking] > end)
                walking, state = walking[fits], following[fits]
                if not len(walking):
                    break
                found = trie.value[state]
                hit = found >= 0
                who, found = walking[hit], found[hit]
                single[who[width[who] == end + 1 - at]] = True
                total = best[at, who] + scores[found]
                better = total > best[end + 1, who]
                who = who[better]
                best[end + 1, who], back[end + 1, who], piece[end + 1, who] = total[better], at, found[better]
            who = here[~single[here]]
            total, end = best[at, who] + unknown, at + width[who]
            better = total > best[end, who]
            who, end = who[better], end[better]
            best[end, who], back[end, who], piece[end, who] = total[better], at, -1
        return [
            self._ids(word, came, took) for word, came, took in zip(words, back.T.tolist(), piece.T.tolist())
        ]


_segmenters: dict[str, Segmenter] = {}


def _segmenter(path: str, pieces: Pieces) -> Segmenter:
    if path not in _segmenters:
        _segmenters[path] = Segmenter(pieces)
    return _segmenters[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)``: little-endian unsigned 32-bit piece ids of every text.

    A null or empty text has no ids.  Very long texts and words are segmented
    whole.  Rows that repeat, and null ids, are rows of their own; ties between
    segmentations go to the one whose last piece starts first.  An empty table
    gives no rows.  Further columns are not looked at.
    """
    pieces = Pieces.load(path)
    pieces.trie, pieces.unknown  # noqa: B018  made once, here
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _segmenter(path, shared.value)
        for batch in slices(batches):
            ids = own.encode([text or "" for text in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        split, "doc_id bigint, ids binary"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, text)``: the texts that ``encode`` was given; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Segmenter(shared.value)
        for batch in slices(batches):
            ids = batch.column(1).to_pylist()
            texts = [own.decode(np.frombuffer(some, "<u4")) if some else "" for some in ids]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id bigint, ids binary, text string")
