"""Texts to the words that byte-level vocabularies merge within, and words to ids: numpy over blocks, each new word encoded once.

The splits are those of PATTERN with the letters, numbers and white space of Unicode 16, which the tokenizers and tiktoken
libraries know. They follow from where classes of characters change, where white space ends and where a contraction stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from evidence_engine.llm.arrays import span_hashes

# Fixed value: the pattern whose matches word_starts finds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPACE, LETTER, NUMBER, OTHER = range(4)

# White space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers that Unicode 16 added, for standard libraries that do not know them.
LATER_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"

#: Endings that stay with the apostrophe before them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for span in ranges.split():
            low, high = (int(x, 16) for x in span.split("-"))
            out[low : high + 1] = kind
    out[WHITE] = SPACE
    return out


def characters(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 starts, and its class."""
    at = np.flatnonzero((body & 0xC0) != 0x80)
    code = body[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        padded = np.concatenate([body, np.zeros(3, np.uint8)]).astype(np.int32)
        lead, first = code[wide], at[wide]
        tail = [padded[first + k] & 0x3F for k in (1, 2, 3)]
        two, three = (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
        code[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
    return at, classes()[code]


def word_starts(body: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where each word starts in texts laid end to end; heads: the starts of texts that are not empty, 0 the first."""
    at, kind = characters(body)
    n = len(at)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, heads)] = True
    head[n] = True
    kind = np.append(kind, OTHER)
    change = head.copy()
    change[1:n] |= kind[1:n] != kind[: n - 1]
    start = change.copy()
    # white space before something: its last character stands alone or, if it is a space, joins what follows
    after = np.flatnonzero(change[1:n] & ~head[1:n] & (kind[: n - 1] == SPACE)) + 1
    start[after - 1] = True
    first = np.append(body[at], np.zeros(3, np.uint8))
    start[after[first[after - 1] == 0x20]] = False
    # an apostrophe alone at the start of a word, and letters after it
    quote = np.flatnonzero(start[: n - 1] & change[: n - 1] & (first[: n - 1] == 0x27) & change[1:n] & ~head[1:n] & (kind[1:n] == LETTER))
    for ending in CONTRACTIONS:
        fits = np.ones(len(quote), bool)
        for k, c in enumerate(ending.encode()):
            fits &= first[quote + 1 + k] == c
            if k:
                fits &= ~head[np.minimum(quote + 1 + k, n)]
        here = quote[fits]
        start[here + 1] = False
        start[here + 1 + len(ending)] = True
    return at[np.flatnonzero(start[:n])]


_CUT = re.compile(rb"[!-~](?= )")


def with_cuts(raw: bytes, heads: list[int], size: int, whole: Callable[[int], bool] = lambda _: False) -> list[int]:
    """heads (ascending starts of stretches) and, in stretches longer than size, places where no word is cut: before a space that follows something visible."""
    out = heads.copy()
    for a, b in zip(heads, [*heads[1:], len(raw)][: len(heads)], strict=True):
        while b - a > size and not whole(a) and (m := _CUT.search(raw, a + size, b)):
            a = m.end()
            out.append(a)
    return sorted(out)


class Remembered:
    """Ids of words, kept from block to block; most at a time."""

    def __init__(self, encode_words: Callable[[list[bytes]], list[bytes]], most: int):
        self.encode_words, self.most = encode_words, most
        self.known: dict[bytes, bytes] = {}

    def block(self, body: np.ndarray, starts: np.ndarray, ready: dict[bytes, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that tile a block, and how many each word has. ready: words that have their ids already."""
        ends = np.append(starts[1:], len(body))
        _, first, of = np.unique(span_hashes(body, starts, ends), return_index=True, return_inverse=True)
        # words of one hash are compared byte by byte with the first of them; one that differs stands for itself
        size = ends - starts
        same = size == size[first[of]]
        like = np.repeat(np.where(same, starts[first[of]] - starts, 0), size) + np.arange(len(body))
        same &= np.maximum.reduceat(body != body[like], starts) == 0
        alone = np.flatnonzero(~same)
        of[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate([first, alone])
        raw, ready = body.tobytes(), ready or {}
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) > self.most:
            self.known.clear()
        new = list({w for w in words if w not in self.known and w not in ready})
        if new:
            self.known.update(zip(new, self.encode_words(new), strict=True))
        told = [ready.get(w) or self.known[w] for w in words] if ready else [self.known[w] for w in words]
        many = np.fromiter(map(len, told), np.int64, len(told)) // 4
        flat, offset = np.frombuffer(b"".join(told), "<u4"), np.cumsum(many) - many
        count = many[of]
        to = np.cumsum(count) - count
        return flat[np.repeat(offset[of] - to, count) + np.arange(count.sum())], count
