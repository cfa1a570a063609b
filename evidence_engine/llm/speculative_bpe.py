"""Byte-level BPE by speculation: propose tokens by longest match, verify all neighbours at once, merge only what fails.

Words are found as numpy over a block (words.py). Words that are new to a task are proposed by greedy longest match. A sequence of tokens is what the merges give exactly if
no merge across any border of two neighbours would come before those that made them; that is tested for all distinct pairs
of neighbours together, undoing the later merge of each pair step by step. Words with a failing pair, or with a token that
its own bytes do not merge to, are merged exactly: short ones together, one merge of each word at a time, long ones with a
heap, in n log n.

The vocabulary is a JSON file as the tokenizers library reads: byte-level BPE with its own splitting, without normaliser,
prefix space or dropout. Its added tokens are cut out of a text first, leftmost and longest. Its path is a parameter and
must be readable on the executors; its size is fixed. A task keeps at most CACHE words.

Nulls and others: a null text counts as empty: no tokens. Any id may be null or repeated. An empty table gives an empty
result. A very long text is cut at spaces into blocks, which changes no token; without spaces it is one block, with some
hundred bytes of memory for each of its bytes. Ids that the vocabulary lacks decode to nothing; bytes that are no UTF-8 decode
to the replacement character. Other columns of the table are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import joined, parts
from evidence_engine.llm.columns import text_or_empty
from evidence_engine.llm.words import Remembered, with_cuts, word_starts

#: Words that a task remembers; beyond, it starts anew.
CACHE = 250_000

#: Bytes of text that a task encodes at a time, about.
BLOCK = 1 << 19

#: Failing words that are merged together, and the longest of them in bytes; longer ones are merged with a heap.
MERGED, LONG_WORD = 1 << 14, 48

_NONE = np.int64(2**62)


class Vocabulary:
    """Tokens, merges and added tokens of one file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        unusual = [spec.get("normalizer"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        added = [t for t in spec.get("added_tokens") or [] if t["content"]]
        if not plain or any(unusual) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("not a plain byte-level BPE")
        byte_of = {c: b for b, c in byte_characters().items()}
        ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        self.added = {t["content"].encode(): t["id"] for t in added}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.body = [b""] * size
        for token, i in [*ids.items(), *self.added.items()]:
            self.body[i] = token
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.specials = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        side = [[ids[bytes(byte_of[c] for c in p[k])] for p in pairs] for k in (0, 1)]
        whole = [ids[self.body[a] + self.body[b]] for a, b in zip(*side, strict=True)]
        self.whole = np.array(whole, np.int64)
        self.merge = {(a, b): (rank, t) for rank, (a, b, t) in enumerate(zip(*side, whole, strict=True))}
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.made[whole], self.left[whole], self.right[whole] = np.arange(len(whole)), side[0], side[1]
        keys = np.array(side[0], np.int64) << 32 | np.array(side[1], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.proper = self._proper(whole)
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size_of = np.array([len(t) for t in self.body], np.int64)
        self.place = np.cumsum(self.size_of) - self.size_of
        self.bodies = np.frombuffer(b"".join(self.body), np.uint8)

    def _proper(self, whole: list[int]) -> np.ndarray:
        """Which tokens their own bytes merge to."""
        out = np.zeros(len(self.body), bool)
        out[self.byte] = True
        tokens = np.array(whole, np.int64)
        apart = self.apart(self.left[tokens], self.right[tokens], self.made[tokens])
        once = np.bincount(tokens, minlength=len(out)) == 1
        for t, a, b, ok in zip(whole, self.left[tokens].tolist(), self.right[tokens].tolist(), apart.tolist(), strict=True):
            out[t] = ok and once[t] and out[a] and out[b]
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a number above all ranks."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Of each pair: whether no merge across its border comes before the given rank, nor before those that made its sides."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            crossed = self.rank(a, b) < until
            out[live[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            on = ~crossed & ((made_a >= 0) | (made_b >= 0))
            live, a, b, made_a, made_b = live[on], a[on], b[on], made_a[on], made_b[on]
            undo = made_a > made_b
            until = np.where(undo, made_a, made_b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def merged(self, word: bytes) -> list[int]:
        """The merges of a word, lowest rank first, leftmost first."""
        ids = [self.byte[b] for b in word]
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = [(self.merge[p][0], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue  # one side has been merged since
            ids[i], ids[j] = self.merge[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], x, p))
        return [t for t in ids if t >= 0]

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """The ids of words as little-endian 32-bit integers, from one merge of each word at a time; long words go to the heap."""
        short = [w for w in words if len(w) <= LONG_WORD]
        if not short:
            return [np.asarray(self.merged(w), "<u4").tobytes() for w in words]
        size = np.fromiter(map(len, short), np.int64, len(short))
        width = int(size.max())
        token = np.full((len(short), width + 1), -1, np.int64)
        token[np.arange(width + 1) < size[:, None]] = np.array(self.byte, np.int64)[np.frombuffer(b"".join(short), np.uint8)]
        rank = np.full((len(short), width + 1), _NONE)
        inside = np.arange(width + 1) < size[:, None] - 1
        rank[inside] = self.rank(token[:, :-1][inside[:, :-1]], token[:, 1:][inside[:, :-1]])
        live, column = np.arange(len(short)), np.arange(width)
        while len(live):
            at = rank[live].argmin(axis=1)
            least = rank[live, at]
            on = least < _NONE
            live, at, least = live[on], at[on], least[on]
            # what is right of the pair moves one place to the left
            source = column + (column > at[:, None])
            token[live, :width] = np.take_along_axis(token[live], source, axis=1)
            rank[live, :width] = np.take_along_axis(rank[live], column + (column >= at[:, None]), axis=1)
            token[live, at] = self.whole[least]
            for left in (at - 1, at):
                pair = token[live, np.maximum(left, 0)], token[live, left + 1]
                real = (left >= 0) & (pair[1] >= 0)
                rank[live[real], left[real]] = self.rank(pair[0][real], pair[1][real])
                gone = (left >= 0) & (pair[1] < 0)
                rank[live[gone], left[gone]] = _NONE
        kept = token >= 0
        body, ends = token[kept].astype("<u4").tobytes(), np.cumsum(4 * kept.sum(axis=1)).tolist()
        made = iter(body[a:b] for a, b in zip([0, *ends], ends))
        return [next(made) if len(w) <= LONG_WORD else np.asarray(self.merged(w), "<u4").tobytes() for w in words]

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """The ids of each word as little-endian 32-bit integers, and how many words had to be merged."""
        text = "Ā".join(w.decode("latin-1") for w in words)
        ends, tokens = [], []
        for end, token in self.automaton.iter_long(text):
            ends.append(end)
            tokens.append(token)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        of = np.searchsorted(stops, np.asarray(ends, np.int64), side="right")
        ids = np.asarray(tokens, np.int64)
        next_to = np.flatnonzero(of[1:] == of[:-1])
        pairs, inverse = np.unique(ids[next_to] << 32 | ids[next_to + 1], return_inverse=True)
        ok = self.apart(pairs >> 32, pairs & (2**32 - 1), np.full(len(pairs), _NONE))
        failed = np.zeros(len(words), bool)
        failed[of[next_to[~ok[inverse]]]] = True
        failed[of[~self.proper[ids]]] = True
        body = ids.astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(of, np.arange(len(words) + 1))).tolist()
        out = [body[bounds[k] : bounds[k + 1]] for k in range(len(words))]
        again = np.flatnonzero(failed).tolist()
        again.sort(key=lambda k: len(words[k]))
        for low in range(0, len(again), MERGED):
            some = again[low : low + MERGED]
            for k, tokens in zip(some, self.merged_together([words[k] for k in some]), strict=True):
                out[k] = tokens
        return out, len(again)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the file: visible ones for themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes blocks of texts, remembering words."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = Remembered(lambda words: self.vocabulary.encode_words(words)[0], CACHE)

    def cuts(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where texts, added tokens and blocks of long texts start, ascending; and the ids of the added tokens by start."""
        raw = body.tobytes()
        heads, special = set(at[:-1][at[:-1] < at[1:]].tolist()), {}
        if self.vocabulary.specials is not None and self.vocabulary.specials.search(raw):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for m in self.vocabulary.specials.finditer(raw, a, b):
                    special[m.start()] = self.vocabulary.added[m.group()]
                    heads |= {m.start(), m.end()} - {b}
        return np.array(with_cuts(raw, sorted(heads), BLOCK, special.__contains__), np.int64), special

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's start and, last, end."""
        body, at = joined(texts)
        heads, special = self.cuts(body, at)
        ids, starts, counts, low = [], [], [], 0
        edges = np.append(heads, len(body))
        while low < len(heads):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BLOCK, side="right")) - 1)
            first, last = edges[low], edges[high]
            words = word_starts(body[first:last], heads[low:high] - first)
            if special:
                whole = [s - first for s in special if first <= s < last]
                inside = np.zeros(last - first, bool)
                for s in whole:
                    inside[s + 1 : s + len(self.vocabulary.body[special[int(s + first)]])] = True
                words = words[~inside[words]]
            ready = {self.vocabulary.body[t]: np.array([t], "<u4").tobytes() for s, t in special.items() if first <= s < last}
            made, many = self.words.block(body[first:last], words, ready)
            ids.append(made)
            starts.append(words + first)
            counts.append(many)
            low = high
        if not ids:
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), total[np.searchsorted(np.concatenate(starts), at)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts(whole, "text", BLOCK)):
            ids, at = encoder(path).encode(batch.column("text"))
            offsets = pa.py_buffer((4 * at).astype(np.int64).tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, offsets, pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed.cast(pa.binary())], ["doc_id", "ids"])

    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts of runs of ids."""
    known = ids < len(vocabulary.body)
    token = np.where(known, ids, 0).astype(np.int64)
    size = np.where(known, vocabulary.size_of[token], 0)
    to = np.concatenate([[0], np.cumsum(size)])
    body = vocabulary.bodies[np.repeat(vocabulary.place[token] - to[:-1], size) + np.arange(to[-1])]
    packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(to[at].astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])
    try:
        return packed.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([b.decode("utf-8", "replace") for b in packed.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, body (the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts(whole, "ids", BLOCK)):
            body, at = joined(batch.column("ids"))
            text = decoded(encoder(path).vocabulary, np.frombuffer(body.tobytes(), "<u4"), at // 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], ["doc_id", "ids", "body"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, body string")
