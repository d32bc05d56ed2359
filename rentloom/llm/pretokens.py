"""Pre-tokens of many texts at once, as the pattern of the byte-level BPE vocabularies cuts them.

The pattern knows four kinds of characters: letters, numbers, white space and the rest. Runs of one kind are words; one
space before a run belongs to it, other white space stands for itself, and an apostrophe that begins a word takes its
English ending along. All cuts of a chunk follow from the kinds of neighbouring characters, so they are found for the
whole chunk in arrays; no text is matched on its own. Tests hold the cuts against the pattern itself.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

from rentloom.llm.common import buffer_of, prefix_hash, stretch_hash

OTHER, LETTER, NUMBER, SPACE = range(4)
# What may follow an apostrophe that begins a word.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            low, high = min(b, 0xD800), max(a, 0xD800)
            out[a:low] = kind
            out[high + 0x800 : b + 0x800] = kind
    return out


def word_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in code points; ``at`` says where texts do (n + 1 places)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # White space right before something else in the same text: the last one of its run stands alone or goes along.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    out = begins | last
    along = np.flatnonzero(last & (points == 32)) + 1
    out[along] = False
    # Apostrophes that begin a word by themselves, with letters after them.
    quote = np.flatnonzero((points == 39) & out)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    wide = np.concatenate([points, np.zeros(3, points.dtype)])
    for ending in ENDINGS:
        hit = np.ones(len(quote), bool)
        for k, letter in enumerate(ending):
            hit &= (wide[quote + 1 + k] == ord(letter)) & ~edge[np.minimum(quote + 1 + k, n)]
        found = quote[hit]
        out[found + 1] = False
        after = found + 1 + len(ending)
        out[after[after < n]] = True
    return np.flatnonzero(out)


class Words:
    """The pre-tokens of a column of texts: ``row`` (the word's number, for each pre-token in order), ``cut`` (where each
    text's pre-tokens begin, n + 1 places), and each different word's hash, start and end in ``data``."""

    def __init__(self, column: pa.Array):
        self.data, at = buffer_of(column)
        points = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        plain = len(points) == len(self.data)
        place = None if plain else np.flatnonzero((self.data & 0xC0) != 0x80)
        starts = word_starts(points, at if plain else np.searchsorted(place, at))
        start = starts if plain else place[starts]
        end = np.append(start[1:], len(self.data))
        self.cut = np.searchsorted(start, at)
        sums = prefix_hash(self.data)
        self.hashes, first, self.row = np.unique(stretch_hash(sums, start, end), return_index=True, return_inverse=True)
        self.start, self.end = start[first], end[first]

    def __len__(self) -> int:
        return len(self.hashes)

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Rank by token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class WordEncoder:
    """Ids of words, many in one call of the library: they are joined by a zero byte, and the pattern given to the library
    cuts there and nowhere else, so every word is encoded as a whole."""

    def __init__(self, path: str):
        import tiktoken

        self.one = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks(path), special_tokens={})
        self.path, self.zero = path, ranks(path)[b"\0"]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has)."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Words with a zero byte of their own are rare; each is cut at it, and put together again.
        odd = [k for k, w in enumerate(words) if b"\0" in w]
        sent = [b"" if b"\0" in w else w for w in words] if odd else words
        ids = np.array(self.one.encode_ordinary(b"\0".join(sent).decode()), np.uint32)
        ends = np.append(np.flatnonzero(ids == self.zero), len(ids))
        sizes = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.zero]
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in odd:
                parts[k] = self._odd(words[k])
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, sizes

    def _odd(self, word: bytes) -> np.ndarray:
        import public_tokenizers as P
        import tiktoken

        plain = tiktoken.Encoding("one", pat_str=P.PATTERN, mergeable_ranks=ranks(self.path), special_tokens={})
        return np.array(plain.encode_ordinary(word.decode()), np.uint32)


def gather(flat: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The stretches flat[first : first + many], one after the other."""
    ends = np.cumsum(many)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(first - (ends - many), many) + np.arange(ends[-1])]


class WordIds:
    """Ids of words by the words' hashes. Words are encoded when first seen, and all are forgotten at the limit."""

    def __init__(self, encode: WordEncoder, limit: int):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self):
        self.rows: dict[int, int] = {}
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def of(self, hashes: np.ndarray, texts: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(where each word's ids begin in ``flat``, how many they are); texts(which) gives the bytes of new words."""
        if len(self.rows) > self.limit:
            self.forget()
        keys = hashes.tolist()
        rows = np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(rows < 0)
        if len(new):
            ids, sizes = self.encode(texts(new))
            rows[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows.update(zip(hashes[new].tolist(), rows[new].tolist(), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        return self.at[rows], self.at[rows + 1] - self.at[rows]
