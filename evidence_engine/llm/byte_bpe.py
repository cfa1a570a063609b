"""Byte-level BPE encoding and decoding of whole texts, exact to the merges of a rank file.

The bytes of a text stand for characters of Latin-1, so a pyahocorasick automaton over the tokens finds the longest
token at any place. A sequence of tokens is what the merges give exactly when every two neighbours are compatible, that
is, when the merges of their joined bytes give the two back. Compatibility is memoised by pair.

A task reads words (matches of the pattern) in blocks; those of the usual pattern are found as numpy (words.py), others by
the regular expression. Words new to it are laid end to end, with a character between them that no token holds, and one pass
of the automaton splits them all by longest match. Where all neighbours in a word are compatible, that split is the answer.
Otherwise the word is encoded by backtracking: the longest token that is compatible with the one before it, else the next
shorter one, else a step back; places that failed are not tried again, so the work is linear in the length of the word.

The vocabulary has a fixed size; its path is a parameter and must be readable on the executors. A task keeps at most
CACHE words. A very long text is cut at spaces into blocks, which changes no token; without spaces it is one block.

Nulls: a null text counts as empty: no tokens. Any id may be null or repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import joined, parts
from evidence_engine.llm.columns import text_or_empty
from evidence_engine.llm.words import PATTERN, Remembered, with_cuts, word_starts

#: Words that a task remembers; beyond, it starts anew.
CACHE = 200_000

#: Bytes of text that a task encodes at a time, about; a longer text goes alone.
BLOCK = 1 << 19


class Bpe:
    """Encoder and decoder for one rank file (base64 token and rank on each line) and one pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern) if pattern != PATTERN else None
        self.compatible: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.words = Remembered(self.encode_words, CACHE)

    @cached_property
    def automaton(self):
        """Over all tokens; decoding does without."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        return automaton

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one encoder lives as long as its worker
    def _shorter(self, token: int) -> tuple[int, ...]:
        """The tokens that begin this one, longest first, itself included."""
        body = self.tokens[token]
        return tuple(r for n in range(len(body), 0, -1) if (r := self.ranks.get(body[:n])) is not None)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (-1, -1) for a byte, None if no merges lead to the token."""
        if token not in self.halves:
            body = self.tokens[token]
            parts = [body[i : i + 1] for i in range(len(body))]
            while len(parts) > 2:
                found = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
                if found is None:
                    break
                i = found[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (-1, -1) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes of a and b never cross their border.

        Undoes the merges of both, the later one first: a merge across the border would happen if its rank came before
        that of the merge that consumed one of its sides.
        """
        if self._halves(a) is None or self._halves(b) is None:
            return False
        until = len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < until:
                return False
            left, right = self.halves_of(a)[1], self.halves_of(b)[0]
            if left < 0 and right < 0:
                return True
            # of the two that can be undone, the one that was made last
            if right < 0 or (left >= 0 and a > b):
                until, a = a, left
            else:
                until, b = b + 1, right

    def halves_of(self, token: int) -> tuple[int, int]:
        return self._halves(token) or (-1, -1)

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2 * CACHE:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(a, b)
        return known

    def _longest(self, body: str, at: int) -> int:
        for _, token in self.automaton.iter_long(body, at, min(len(body), at + 1024)):
            return token
        raise ValueError("the vocabulary lacks a byte")

    def backtrack(self, body: bytes) -> list[int]:
        """The merges' tokens of a piece."""
        text, n = body.decode("latin-1"), len(body)
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, (self._longest(text, 0) if n else None)
        while token is not None:
            last = out[-1] if out else None
            for t in self._shorter(token):
                end = at + len(self.tokens[t])
                if not dead[end] and (last is None or self.fits(last, t)):
                    out.append(t)
                    at = end
                    token = self._longest(text, at) if at < n else None
                    break
            else:
                # nothing fits here: take back the last token and try its next shorter one
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        joined_words = "\u0100".join(w.decode("latin-1") for w in words)
        ends, tokens = [], []
        for end, token in self.automaton.iter_long(joined_words):
            ends.append(end)
            tokens.append(token)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        of = np.searchsorted(stops, np.asarray(ends, np.int64), side="right")
        bounds = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        ids, fits = np.asarray(tokens, "<u4"), self.fits
        body, out = ids.tobytes(), []
        for k, word in enumerate(words):
            i, j = bounds[k], bounds[k + 1]
            if j - i > 1 and not all(fits(tokens[x], tokens[x + 1]) for x in range(i, j - 1)):
                out.append(np.asarray(self.backtrack(word), "<u4").tobytes())
            else:
                out.append(body[4 * i : 4 * j])
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self.pattern is not None:  # a pattern of its own: its matches are the words
            split = [[w.encode() for w in self.pattern.findall(t or "")] for t in texts.to_pylist()]
            known = self.words.known
            if len(known) > CACHE:
                known.clear()
            new = list(set().union(*split).difference(known))
            known.update(zip(new, self.encode_words(new), strict=True))
            return [b"".join(known[w] for w in words) for words in split]
        body, at = joined(texts)
        heads = with_cuts(body.tobytes(), sorted(set(at[:-1][at[:-1] < at[1:]].tolist())), BLOCK)
        edges, low, ids, ends = [*heads, len(body)], 0, [], [np.zeros(1, np.int64)]
        starts = []
        while low < len(heads):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BLOCK, side="right")) - 1)
            first, last = edges[low], edges[high]
            words = word_starts(body[first:last], np.asarray(heads[low:high]) - first)
            made, many = self.words.block(body[first:last], words)
            ids.append(made)
            starts.append(words + first)
            ends.append(many)
            low = high
        if not ids:
            return [b""] * len(texts)
        total = np.cumsum(np.concatenate(ends))
        bounds = (4 * total[np.searchsorted(np.concatenate(starts), at)]).tolist()
        packed = np.concatenate(ids).astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    @cached_property
    def bodies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens end to end, and where each starts and how long it is, by id."""
        most = max(self.tokens) + 1
        size = np.array([len(self.tokens.get(t, b"")) for t in range(most)], np.int64)
        return np.frombuffer(b"".join(self.tokens.get(t, b"") for t in range(most)), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: bytes) -> bytes:
        flat, place, size = self.bodies
        token = np.frombuffer(ids, "<u4").astype(np.int64)
        n = size[token]
        return flat[np.repeat(place[token] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Bpe:
    return Bpe(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in (p for whole in batches for p in parts(whole, "text", BLOCK)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bpe.encode(batch.column("text")), pa.binary())], ["doc_id", "ids"])

    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, body (binary: the bytes of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in (p for whole in batches for p in parts(whole, "ids", BLOCK)):
            bodies = [bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(bodies, pa.binary())], ["doc_id", "ids", "body"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, body binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids, body: encoded, and the ids decoded, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in (p for whole in batches for p in parts(whole, "text", BLOCK)):
            ids = bpe.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "body"])

    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary, body binary")


def tokenized(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with all its columns but text, and n_tokens, ids (binary), round_trip: whether the ids decode to the text's bytes.

    Columns of docs with these names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in (p for whole in batches for p in parts(whole, "text", BLOCK)):
            ids = bpe.encode(batch.column("text"))
            same = [bpe.decode(x) == t for x, t in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True)]
            out = [*(batch.column(c) for c in columns), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, [*columns, "n_tokens", "ids", "round_trip"])

    docs = docs.drop("n_tokens", "ids", "round_trip")
    columns = [c for c in docs.columns if c != "text"]
    source = docs.select(*columns, text_or_empty(F.col("text")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return source.mapInArrow(run, f"{schema}, n_tokens long, ids binary, round_trip boolean")
