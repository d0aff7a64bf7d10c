"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to three bytes long counts which
byte follows.  The code length of a byte is taken in the longest context known;
a byte unseen there costs the escape (method C: as many chances as there are
different followers) and is coded in the next shorter context, at last among all
256 bytes.  The statistics are frozen after training, so the code length of a byte
depends on it and the three before it alone, and is worked out once for each of
those that occur in a chunk of texts.  The language with the shortest code wins.

Every language learns from a sample of its labelled rows, ``LANGUAGE_ROWS`` of them
(all, if it has fewer), drawn by a hash of the text, and keeps all contexts of its
own, as sorted arrays: no tree depends on other languages or on their number, and
the model of a language stops growing with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from edgetables.llm.common import Folder, chunks_of, slices, trimmed

ORDER = 3
LANGUAGE_ROWS = 20_000  # that a language learns from, but for chance
CHUNK_CHARS = 1_000_000
UNKNOWN = "und"
START = b"\0\0\0"


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document by the CRC of its id; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def grams(texts: list[str]) -> np.ndarray:
    """Each byte with the three before it, as a number; starts of texts count as zero bytes."""
    data = np.frombuffer(b"".join([START + text.encode() for text in texts]), np.uint8)
    found = data[3:].astype(np.uint32)
    for k in (1, 2, 3):
        found |= data[3 - k : -k].astype(np.uint32) << np.uint32(8 * k)
    return found[found & 0xFF != 0]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: dict[str, tuple[list, list]] = {}
    for batch in slices(batches):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            keys, counts = held.setdefault(lang, ([], []))
            for start, end in chunks_of(some, CHUNK_CHARS):
                found = np.sort(grams(some[start:end]))
                if len(found):
                    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                    keys.append(found[first])
                    counts.append(np.diff(np.r_[first, len(found)]))
            if len(keys) > 8:
                key, count = merged(keys, counts)
                held[lang] = ([key], [count])
    for lang, (keys, counts) in held.items():
        if keys:
            key, count = merged(keys, counts)
            arrays = [pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "gram", "n"])


@dataclass
class Model:
    """Counts of a followed context per language: for each order, ``(gram, language, n)`` arrays by language and gram."""

    languages: list[str]
    counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @cached_property
    def trees(self) -> list[list[tuple[np.ndarray, ...]]]:
        """By language and order: grams in order and their counts; contexts in order, their counts and numbers of followers."""
        trees: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.languages]
        for gram, lang, n in self.counts:
            bounds = np.searchsorted(lang, np.arange(len(trees) + 1))
            for tree, start, end in zip(trees, bounds[:-1], bounds[1:]):
                grams_, n_ = gram[start:end], n[start:end]
                contexts, first, kinds = np.unique(grams_ >> np.uint32(8), return_index=True, return_counts=True)
                total = np.add.reduceat(n_, first) if len(first) else n_[:0]
                tree.append((grams_, n_, contexts, total, kinds.astype(np.int32)))
        return trees

    def costs(self, grams_: np.ndarray, lang: int) -> np.ndarray:
        """Nats of the last byte of each gram after the others."""
        cost = np.full(len(grams_), np.log(256.0))
        for order, (known, n, contexts, total, kinds) in enumerate(self.trees[lang]):
            if not len(known):
                continue
            part = grams_ & np.uint32((1 << 8 * (order + 1)) - 1)
            above = part >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, above), len(contexts) - 1)
            met = contexts[at] == above
            both = np.log(total[at] + kinds[at])
            place = np.minimum(np.searchsorted(known, part), len(known) - 1)
            escaped = np.where(met, cost + both - np.log(kinds[at]), cost)
            cost = np.where(known[place] == part, both - np.log(n[place]), escaped)
        cost[grams_ & 0xFF == 0] = 0.0  # starts of texts
        return cost

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Nats of each text in each language."""
        coded = [START + text.encode() for text in texts]
        data = np.frombuffer(b"".join([START, *coded]), np.uint8)
        found = data[3:].astype(np.uint32)
        for k in (1, 2, 3):
            found |= data[3 - k : -k].astype(np.uint32) << np.uint32(8 * k)
        distinct, at = np.unique(found, return_inverse=True)
        starts = np.r_[0, np.cumsum([len(text) for text in coded])[:-1]]
        lengths = np.empty((len(texts), len(self.languages)))
        for lang in range(len(self.languages)):
            lengths[:, lang] = np.add.reduceat(self.costs(distinct, lang)[at], starts)
        return lengths


def sample(rows: DataFrame, most: int, folder: Folder) -> DataFrame:
    """About ``most`` rows of every language that has more, all of the others, by a hash of the text."""
    # Stored, so that Spark knows how few rows it joins the texts with and leaves them where they are.
    sizes = folder.store(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "sizes")
    share = F.lit(float(most)) / F.col("size")
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / float(1 << 32)
    return rows.join(sizes, "lang").filter(drawn < share).select(*rows.columns)


def train(labelled: DataFrame, most: int = LANGUAGE_ROWS) -> Model:
    """Count the texts of ``labelled (lang, text)``, of each language about ``most`` rows.

    Rows with a null in either column teach nothing; an empty table makes a model
    that knows no language.
    """
    folder = Folder(labelled.sparkSession)
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = sample(rows.filter("lang is not null and text is not null"), most, folder)
    counted = rows.mapInArrow(lambda batches: trimmed(_count(batches)), "lang string, gram bigint, n bigint")
    table = folder.store(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    found = table.toArrow()
    names = found["lang"].combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    number = {lang: k for k, lang in enumerate(languages)}
    to = np.array([number[lang] for lang in names.dictionary.to_pylist()], np.int64)
    lang = to[names.indices.to_numpy()] if languages else np.zeros(0, np.int64)
    gram = found["gram"].to_numpy().astype(np.int64)
    n = found["n"].to_numpy().astype(np.float64)
    counts = []
    for order in range(ORDER + 1):
        part = lang << 32 | gram & ((1 << 8 * (order + 1)) - 1)
        key, count = merged([part], [n]) if len(part) else (part, n)
        counts.append(((key & 0xFFFFFFFF).astype(np.uint32), (key >> 32).astype(np.int32), count))
    folder.drop("grams")
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the likeliest language between 0 and 1.

    Only ``text`` is read.  A null text, and one without a letter, is ``und`` with
    score 0; so is every text if nothing was learned.  Ties go to the
    language first in the alphabet.  Columns of these two names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def guess(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        learned = shared.value
        for texts in column:
            texts = [text if isinstance(text, str) else "" for text in texts]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = [k for k, text in enumerate(texts) if any(map(str.isalpha, text))] if learned.languages else []
            some = [texts[k] for k in lettered]
            for start, end in chunks_of(some, CHUNK_CHARS):
                lengths = learned.code_lengths(some[start:end])
                best = lengths.argmin(axis=1)
                share = 1 / np.exp(lengths.min(axis=1, keepdims=True) - lengths).sum(axis=1)
                for k, name, score in zip(lettered[start:end], best.tolist(), share.tolist()):
                    names[k], scores[k] = learned.languages[name], score
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    def freed(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return trimmed(guess(column))

    guessed = F.pandas_udf(freed, "lang_pred string, score double")
    return docs.select(*[F.col(f"`{c}`") for c in others], guessed(F.col("text").cast("string")).alias("_guess")).select(
        *[F.col(f"`{c}`") for c in others], "_guess.lang_pred", "_guess.score"
    )

