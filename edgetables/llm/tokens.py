"""Token ids of whole texts through the tokenizers library.

The library takes about one second for a megabyte.  Its vocabularies here cut a
text at white space and between letters, digits and marks before they merge
anything, so the ids of a text are those of such units one after another.  Units
are found and told apart by numpy for many texts at once, and only units that
the worker does not remember go through the library.  A text that holds one of
the vocabulary's special tokens goes through it whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from edgetables.llm.common import chunks_of
from edgetables.llm.shingles import mixed

#: Unicode's White_Space, as the tokenizers' patterns have it.
WHITE = "\t-\r \u0085   -     　"
CHUNK = 500_000
REMEMBERED = 250_000
LONGEST = 64  # bytes of a unit that is remembered
OTHER, SPACE, LETTER, MARK, DIGIT, APOSTROPHE = range(6)

#: Places of very long texts at which one unit ends and the next begins.
CUT = re.compile(f"(?<=[^{WHITE}])[ \n](?=[^{WHITE}])")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte, and of the two-byte characters from U+0080 to U+024F by lead and second byte."""
    one = np.zeros(256, np.uint8)
    one[0x21:0x7F] = MARK
    one[[0x20, *range(0x09, 0x0E)]] = SPACE
    one[0x30:0x3A] = DIGIT
    one[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    one[0x27] = APOSTROPHE
    two = np.zeros((8, 64), np.uint8)  # leads C2 to C9
    letters = [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)]  # lower-cased one by one
    for code in letters:
        two[(code >> 6) - 2, code & 63] = LETTER
    two[0, [0x05, 0x20]] = SPACE
    return one, two


ONE, TWO = _classes()
#: Whether a unit ends between two classes.  White space goes with what follows it.
ENDS = np.zeros((6, 6), bool)
ENDS[[OTHER, LETTER, MARK, DIGIT, APOSTROPHE], SPACE] = True
ENDS[LETTER, [[MARK], [DIGIT], [APOSTROPHE]]] = True
ENDS[MARK, [[LETTER], [DIGIT]]] = True
ENDS[DIGIT, [[LETTER], [MARK], [APOSTROPHE]]] = True

_random = np.random.Generator(np.random.PCG64(49_408))
_BYTE = _random.integers(1, 2**63, (2, 256), dtype=np.uint64)
_POWERS = np.cumprod(np.full((2, LONGEST), _random.integers(0, 2**62, (2, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), axis=1)


def _byte_names() -> list[str]:
    """How byte-level vocabularies spell a byte: itself if it prints, else the next character from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte if byte in prints else next(spare)) for byte in range(256)]


#: The same as code points, with line feeds as they are.
NAME_CODES = np.array([ord("\n") if byte == 10 else ord(name) for byte, name in enumerate(_byte_names())], "<u4")

_encoders: dict[tuple[str, bool, bool], UnitEncoder] = {}


def encoder(path: str, white_matters: bool, special: bool = True) -> UnitEncoder:
    """The encoder of this worker process, with what it remembers from earlier tasks."""
    key = (path, white_matters, special)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, white_matters, special)
    return _encoders[key]


def classes_of(data: np.ndarray) -> np.ndarray:
    """The class of every byte of UTF-8 text; bytes of one character have one class."""
    out = ONE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    out[lead] = out[lead + 1] = TWO[data[lead] - 0xC2, data[lead + 1] & 63]
    wide = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    if len(wide):
        code = (data[wide].astype(np.int32) & 15) << 12 | (data[wide + 1].astype(np.int32) & 63) << 6 | data[wide + 2] & 63
        white = (code >= 0x2000) & (code <= 0x200A) | np.isin(code, [0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
        for k in range(3):
            out[wide[white] + k] = SPACE
    return out


class Remembered:
    """Ids of units by two hashes of their bytes, in sorted arrays."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units are, and which are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def add(self, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, used: np.ndarray) -> None:
        """Learn units; past the limit those used least are forgotten."""
        starts = np.concatenate([self.starts, starts + len(self.ids)])
        sizes, used = np.concatenate([self.sizes, sizes]), np.concatenate([self.used, used])
        ids = np.concatenate([self.ids, ids])
        keys, checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        order = np.argsort(keys, kind="stable")
        if len(order) > REMEMBERED:
            kept = np.zeros(len(order), bool)
            kept[np.argsort(-used, kind="stable")[: REMEMBERED // 2]] = True
            order = order[kept[order]]
            used = used // 2
        self.keys, self.checks, self.used = keys[order], checks[order], used[order]
        self.starts, self.sizes, self.ids = starts[order], sizes[order], ids
        if len(order) < len(keys):
            self.ids = gathered(ids, self.starts, self.sizes)
            self.starts = np.cumsum(self.sizes) - self.sizes


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``ids`` one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return ids[:0]
    return ids[np.repeat(starts + sizes - ends, sizes) + np.arange(ends[-1])]


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``white_matters`` is for vocabularies whose tokens hold the white space before
    a word; without it white space is dropped, as the vocabulary does itself.
    Special tokens in a text become their single ids, as the vocabulary says, or,
    with ``special=False``, are text like any other.
    """

    def __init__(self, path: str, white_matters: bool, special: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.library.no_padding()
        self.library.no_truncation()
        self.white_matters = white_matters
        added = self.library.get_added_tokens_decoder().values()
        self.special = [token.content.lower() for token in added if special or not token.special]
        self.known = Remembered()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start, end in chunks_of(texts, CHUNK):
            out += self._chunk(texts[start:end])
        return out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if len(texts) == 1 and len(texts[0]) > 2 * CHUNK and not self._has_special(texts[0]):
            return [b"".join(self._units([piece])[0] for piece in cut(texts[0]))]
        whole = [k for k, text in enumerate(texts) if self._has_special(text)]
        found = self._units(["" if k in set(whole) else text for k, text in enumerate(texts)] if whole else texts)
        for k in whole:
            found[k] = self._whole([texts[k]])[0].tobytes()
        return found

    def _has_special(self, text: str) -> bool:
        low = text.lower() if self.special and "<" in text else ""
        return bool(low) and any(token in low for token in self.special) or any(
            token in text.lower() for token in self.special if "<" not in token
        )

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for i in range(0, len(texts), 4096):
            some = self.library.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)
            found += [np.array(one.ids, np.uint32) for one in some]
        return found

    def _units(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        coded = [text.encode() for text in texts]
        content = b"".join(coded)
        data = np.frombuffer(content, np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        text_ends = np.cumsum(sizes)
        if not len(data):
            return [b""] * len(texts)
        kind = classes_of(data)
        begins = np.r_[True, ENDS[kind[:-1], kind[1:]]]
        begins[(text_ends - sizes)[sizes > 0]] = True
        white = kind == SPACE
        after = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        if self.white_matters:  # one white character that is no blank is a token of its own
            after = after[begins[after - 1] & (data[after - 1] != 0x20) & (data[after - 1] < 0x80)]
        begins[after] = True
        starts = np.flatnonzero(begins)
        length = np.diff(np.r_[starts, len(data)])
        text_of = np.searchsorted(text_ends, starts, "right")
        if not self.white_matters:
            used = ~white[starts]
            starts, length, text_of = starts[used], length[used], text_of[used]
        ids, n_ids = self._ids(content, data, kind, starts, length)
        per_text = np.bincount(text_of, weights=n_ids, minlength=len(texts)).astype(np.int64)
        bounds = np.r_[0, np.cumsum(per_text)]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _ids(self, content: bytes, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in their order, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        short = length <= LONGEST
        keys, checks = hashes(data, starts[short], length[short])
        distinct, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        checks = checks[first]
        at, met = self.known.find(distinct, checks)
        new = np.flatnonzero(~met)
        place = np.flatnonzero(short)[first]
        flat, sizes = self._learned(content, data, kind, starts[place[new]], length[place[new]])
        if met.any():
            self.known.used[at[met]] += counts[met]
        # All units of the chunk in one table: remembered ones, fresh ones, then long ones.
        long_ids = self._whole([content[s : s + n].decode() for s, n in zip(starts[~short].tolist(), length[~short].tolist())])
        pool = np.concatenate([self.known.ids, flat, *long_ids])
        begin, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        some_begin, some_size = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        some_begin[met], some_size[met] = self.known.starts[at[met]], self.known.sizes[at[met]]
        fresh_starts = np.cumsum(sizes) - sizes
        some_begin[new], some_size[new] = len(self.known.ids) + fresh_starts, sizes
        begin[short], size[short] = some_begin[inverse], some_size[inverse]
        long_sizes = np.fromiter(map(len, long_ids), np.int64, len(long_ids))
        begin[~short], size[~short] = len(self.known.ids) + len(flat) + np.cumsum(long_sizes) - long_sizes, long_sizes
        out = gathered(pool, begin, size)
        if len(new):
            self.known.add(distinct[new], checks[new], fresh_starts, sizes, flat, counts[new])
        return out, size

    def _learned(self, content: bytes, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one by one: words of letters by the merges alone, without the steps before them, others through the library."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends = np.cumsum(length)
        at = np.repeat(starts + length - ends, length) + np.arange(ends[-1])
        no_letter = kind[at] != LETTER
        no_letter[ends - length] &= (data[starts] != 0x20) | (length == 1)
        words = ~np.logical_or.reduceat(no_letter, ends - length)
        units = [content[s : s + n] for s, n in zip(starts.tolist(), length.tolist())]
        tokenize, ids, sizes = self.library.model.tokenize, array("I"), np.empty(len(units), np.int64)
        counts = []
        for word in self._spelled([units[k] for k in np.flatnonzero(words)]) if words.any() else ():
            found = tokenize(word)
            ids.extend([token.id for token in found])
            counts.append(len(found))
        rest = self._whole([units[k].decode() for k in np.flatnonzero(~words)])
        flat = np.concatenate([np.frombuffer(ids, np.uint32), *rest])
        sizes[words], sizes[~words] = counts, [len(some) for some in rest]
        starts = np.empty(len(units), np.int64)  # words come first, the others behind them
        order = np.r_[np.flatnonzero(words), np.flatnonzero(~words)]
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gathered(flat, starts, sizes), sizes

    def _spelled(self, words: list[bytes]) -> list[str]:
        """Words of letters as the vocabulary spells them."""
        joined = b"\n".join(words)
        if not self.white_matters:
            joined = joined.decode().lower().encode()
        codes = NAME_CODES[np.frombuffer(joined, np.uint8)]
        return codes.tobytes().decode("utf-32-le").split("\n")


def hashes(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every piece of at most ``LONGEST`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = np.cumsum(length)
    place = np.arange(ends[-1]) - np.repeat(ends - length, length)
    byte = data[place + np.repeat(starts, length)]
    one, other = (np.add.reduceat(_BYTE[k][byte] * _POWERS[k][place], ends - length) for k in (0, 1))
    return mixed(one), other


def cut(text: str):
    """Pieces of a very long text, each beginning with a new unit."""
    at = 0
    while at < len(text):
        gap = CUT.search(text, at + CHUNK)
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop
