import random
import zlib
from array import array

import numpy as np
import pytest

from edgetables.llm import packing, token_file, unigram
from edgetables.llm import tokens
from edgetables.llm.tokens import UnitEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, source string, start long"
DOCS = [
    (3, "The quick brown fox, naïve café.\nNew line  two blanks", "a", 9),
    (1, None, None, None),
    (2, "", "b", 1),
    (None, "no id here", "b", 1),
    (5, "wörd " * 3000, "hot", 1),
    (7, "same text", "hot", 1),
    (7, "same text", "hot", 1),
    (8, "x" * 20_000 + " \x1c\x85  <|endoftext|> end ", "hot", 1),
]


def ids_of(path, text, end):
    encoder = UnitEncoder(path, path == BYTES).library
    return [*encoder.encode(text or "", add_special_tokens=False).ids, end]


def fuzz(n, seed):
    rng = random.Random(seed)
    odd = list("ab'sATé ß́Å \t\n\r\x0b\x1c\x85\xa0 　.,!1२Ⅷ²日本🙂​​ΣςİŉǅØ") + ["<|endoftext|>", "  ", "'ll", "\n\n"]
    latin = [chr(c) for c in range(0xC0, 0x250)] + list("abcXYZ")
    for _ in range(n):
        yield "".join(rng.choice(odd) for _ in range(rng.randrange(25)))
        words = ("".join(rng.choice(latin) for _ in range(rng.randrange(1, 9))) for _ in range(5))
        yield " ".join(word + rng.choice(["", ".", ",", "..", "!", "\n"]) for word in words)


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("path, white_matters", [(WORDS, False), (BYTES, True)])
def test_units_encode_as_the_whole_text_does(path, white_matters, special):
    encoder = UnitEncoder(path, white_matters, special)
    texts = list(fuzz(1500, 4))
    for _ in range(2):  # the second time from memory
        for text, got in zip(texts, encoder.encode(texts)):
            assert array("I", got).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path, white_matters", [(WORDS, False), (BYTES, True)])
def test_ascii_and_apostrophes(path, white_matters):
    encoder, rng = UnitEncoder(path, white_matters), random.Random(8)
    alphabet = "abS'tlL.,-1 2\n\t 'srEvm~\x00\x7f"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(4000)]
    texts += ["don't", "'S 's 'll", "a.'s", "it''s", "x'", "' s", "a1'd", "1'd2", "\n'm", "<|endoftext|", "I'M<|ENDOFTEXT|>"]
    for text, got in zip(texts, encoder.encode(texts)):
        assert array("I", got).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_tokens_are_those_of_the_file():
    assert len(UnitEncoder(BYTES, True).encode(["one <|endoftext|> two"])[0]) == 4 * 4
    assert len(UnitEncoder(BYTES, True, special=False).encode(["one <|endoftext|> two"])[0]) > 4 * 4
    assert array("I", UnitEncoder(WORDS, False).encode(["a<|startoftext|>"])[0])[-1] == 49406


@pytest.mark.parametrize("path, white_matters", [(WORDS, False), (BYTES, True)])
def test_little_memory_and_long_texts_change_nothing(monkeypatch, path, white_matters):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "CHUNK", 200)
    encoder = UnitEncoder(path, white_matters)
    texts = [*fuzz(200, 9), "one two  three\n\nfour " * 90, "x" * 3000, " ".join(fuzz(60, 5)).replace("<", ""), " \n" * 400]
    for text, got in zip(texts, encoder.encode(texts)):
        assert array("I", got).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text[:99])
    assert len(encoder.known.keys) <= 40


def test_packing_is_gapless_and_holds_every_id_once(spark):
    pieces = packing.pack(spark.createDataFrame(DOCS, SCHEMA).repartition(3), WORDS, window=64)
    rows = sorted((r["sequence_id"], r["offset"], r) for r in pieces.collect())
    filled = {}
    for sequence, offset, row in rows:
        assert offset == filled.get(sequence, 0) and row["length"] * 4 == len(row["ids"])
        filled[sequence] = offset + row["length"]
    assert list(filled) == list(range(len(filled))) and set(list(filled.values())[:-1]) == {64}
    docs = {}
    for _, _, row in rows:
        docs.setdefault((row["doc_id"], row["doc_tokens"]), []).append((row["start"], row["ids"]))
    for doc_id, text, *_ in DOCS:
        want = ids_of(WORDS, text, 1)
        parts = sorted(docs[doc_id, len(want)])
        copies = 2 if doc_id == 7 else 1
        assert b"".join(p for _, p in parts) == b"".join(array("I", want).tobytes() for _ in range(copies)) or copies == 2
        assert sum(len(p) for _, p in parts) == copies * 4 * len(want)
    whole = packing.sequences(pieces, window=64, pad_id=9).collect()
    last = max(whole, key=lambda r: r["sequence_id"])
    assert all(len(r["ids"]) == 256 for r in whole if r["sequence_id"] != last["sequence_id"])
    n = last["n_tokens"]
    assert len(last["ids"]) == (4 * n if n & (n - 1) == 0 else 256)
    assert set(array("I", last["ids"]).tolist()[n:]) <= {9}


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_token_files_give_back_the_ids_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_IDS", 50)
    folder = token_file.write_token_files(spark.createDataFrame(DOCS, SCHEMA).repartition(4), BYTES)
    rows = sorted(token_file.read_token_files(spark, folder.uri).collect(), key=lambda r: r["start"])
    at = 0
    for row, (doc_id, text, *_) in zip(rows, sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)), strict=True):
        want = array("I", ids_of(BYTES, text, 0)).tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, at, len(want) // 4)
        assert zlib.crc32(row["ids"]) == zlib.crc32(want)
        at += row["n_tokens"]


def test_token_files_of_nothing(spark):
    folder = token_file.write_token_files(spark.createDataFrame([], SCHEMA), BYTES)
    assert token_file.read_token_files(spark, folder.uri).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_byte_aligned_code_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
    ranks[: min(n, 4)] = [0, 255, 65_536, 2**32 - 1][: min(n, 4)]
    coded = token_file.encode_ranks(ranks)
    assert token_file.decode_ranks(memoryview(coded), n).tolist() == ranks.tolist()
    size = sum(1 + (r > 255) + (r > 65_535) + (r > 2**24 - 1) for r in ranks.tolist())
    assert len(coded) == -(-n // 4) + size


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces.load(PIECES)


def best_score(pieces, text):
    """Plain dynamic programme over characters with a dictionary of pieces."""
    known = {c: s for c, s, ok in zip(pieces.content, pieces.scores.tolist(), pieces.usable) if ok}
    text = " " + text
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            score = known.get(text[start:end].encode())
            if score is None and end - start == 1:
                score = pieces.unknown
            if score is not None and best[start] + score > best[end]:
                best[end] = best[start] + score
    return best[-1]


def total_score(pieces, ids):
    total, run = 0.0, b""
    for i in ids:
        if pieces.usable[i]:
            total += pieces.scores[i]
        else:
            run += pieces.content[i]
    return total + pieces.unknown * len(run.decode())


def test_segmentation_is_the_best_one_and_decodes(pieces):
    own = unigram.Segmenter(pieces)
    rng = random.Random(8)
    pool = [*"ab  é日🙂\n\tΩ", unigram.MARKER, "the", "ing", " of", "x" * 70, "tion" * 20]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)]
    for text, coded in zip(texts, own.encode(texts)):
        ids = np.frombuffer(coded, "<u4")
        assert own.decode(ids) == text
        if text:
            assert total_score(pieces, ids.tolist()) == pytest.approx(best_score(pieces, text))
        else:
            assert not len(ids)


def test_trie_finds_exactly_its_keys():
    rng = random.Random(2)
    keys = {bytes(rng.choice(b"\x00abc\xff") for _ in range(rng.randrange(1, 7))): k for k in range(300)}
    trie = unigram.Trie.build(keys)

    def find(word):
        state = 0
        for byte in word:
            following = int(trie.base[state]) + byte
            if following == 0 or trie.check[following] != state:
                return -1
            state = following
        return int(trie.value[state])

    assert all(find(key) == number for key, number in keys.items())
    for _ in range(2000):
        word = bytes(rng.choice(b"\x00abc\xff") for _ in range(rng.randrange(1, 8)))
        assert find(word) == keys.get(word, -1)


def test_pieces_of_a_table_round_trip(spark):
    frame = spark.createDataFrame(DOCS, SCHEMA)
    read = unigram.decode(unigram.encode(frame, PIECES), PIECES).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in read)) == sorted((d[0] or 0, d[1] or "") for d in DOCS)
    assert unigram.encode(spark.createDataFrame([], SCHEMA), PIECES).count() == 0
