"""Byte-level BPE encoding and decoding by merge replay over a corpus slice.

Each task reads its rows in slices of bounded size, splits the texts by the
tokenizer's pattern and collects the *distinct* words of the slice that it does not
know yet. An inverted index maps each merge (a token pair and the id it gives) to the
word positions where it applies. The merges that occur are replayed in rank order, a
band of ranks at a time; applying one touches only the neighbours of its positions,
whose new pairs are entered in the index. Texts are then put together from their
words' ids. Nothing is shuffled.

Exactness: within a word the lowest rank goes first and the leftmost of equal ranks,
one merge per word and step, so a band's positions in many words are merged together
as arrays. A merge can bring up a pair of lower rank than its own; it is then that
word's next step. A word that is itself in the vocabulary is one token. A word of
more than ``LONG`` bytes would take as many steps as it has merges: it has an index
of its own, a heap, and costs O(n log n), so a text without any space is no special
case. The words of texts over ``PART`` characters are read one by one, never listed.

NULL texts count as empty; an empty text has no ids. Extra columns are kept; a
column named as an output is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from staywise.llm.common import ship

SLICE_BYTES = 4 << 20  # texts handled together
KNOWN_WORDS = 300_000  # words a task remembers between slices
KNOWN_BYTES = 16 << 20
BAND = 512  # ranks replayed together
LONG = 64  # bytes of a word with an index of its own
PART = 1 << 18  # characters of a text whose words are listed
GONE = -2  # the place of a token merged into the one before


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> id of the merged token, -1 where there is none: an open hash table, asked for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ids above 20 bits")
        get = ranks.get
        parts = [(get(t[:i]), get(t[i:]), rank) for t, rank in ranks.items() for i in range(1, len(t))]
        left, right, merged = np.array([p for p in parts if p[0] is not None and p[1] is not None], np.int64).reshape(-1, 3).T
        bits = max(10, int(4 * len(left)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = left << 20 | right
        at = self._slot(keys)
        while len(keys):
            _, lead = np.unique(at, return_index=True)
            lead = lead[self.keys[at[lead]] < 0]
            self.keys[at[lead]], self.values[at[lead]] = keys[lead], merged[lead]
            rest = np.ones(len(keys), bool)
            rest[lead] = False
            keys, merged, at = keys[rest], merged[rest], (at[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1).astype(np.int32)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.last
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class MergeReplay:
    """Encodes batches of words by replaying the merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.merged = ranks, PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bands = max(ranks.values()) // BAND + 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        # all words in a row, each followed by a -1; place -1 is the last of these
        token = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1, np.int32)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths + 1)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        ready = np.flatnonzero(whole >= 0)
        token[(whole >= 0)[word] & inner[: len(word)]] = GONE
        token[starts[ready]] = whole[ready]
        for i in np.flatnonzero((lengths > LONG) & (whole < 0)).tolist():
            token[starts[i] : ends[i]] = self._long(token[starts[i] : ends[i]])
        self._replay(token, word, ((lengths <= LONG) & (whole < 0))[word])
        found = np.flatnonzero(token >= 0)
        return token[found], np.bincount(word[found], minlength=len(words))

    def _replay(self, token: np.ndarray, word: np.ndarray, open_places: np.ndarray) -> None:
        """Merge in place. ``pair`` holds the merge that applies at each place, ``index`` the places of each band of merges."""
        n = len(word)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n + 1, -1, np.int32)
        at = np.flatnonzero(open_places[:-1] & (token[:-1] >= 0) & (token[1:] >= 0)) if n else np.empty(0, np.int64)
        pair[at] = self.merged(token[at], token[at + 1])
        index: list[list[np.ndarray]] = [[] for _ in range(self.bands)]
        self._enter(index, at[pair[at] >= 0], pair)
        for band in range(self.bands):
            limit = (band + 1) * BAND
            todo = np.concatenate(index[band]) if index[band] else ()
            index[band] = []
            while len(todo):
                todo = np.unique(todo)
                rank = pair[todo]
                live = (rank >= 0) & (rank < limit)
                todo, rank = todo[live], rank[live]
                if not len(todo):
                    break
                # within a word the lowest rank first, the leftmost of equal ranks; words do not touch each other
                of = word[todo]
                order = np.lexsort((todo, rank, of))
                lead = np.ones(len(order), bool)
                lead[1:] = of[order][1:] != of[order][:-1]
                first, rest = todo[order[lead]], todo[order[~lead]]
                gone = after[first]
                follow, left = after[gone], before[first]
                token[first], token[gone], pair[gone] = pair[first], GONE, -1
                after[first], before[follow] = follow, first
                pair[first] = self._beside(token[first], token[follow])
                near = left[token[left] >= 0]
                pair[near] = self.merged(token[near], token[after[near]])
                new = np.concatenate([first, near])
                now = (pair[new] >= 0) & (pair[new] < limit)
                self._enter(index, new[pair[new] >= limit], pair)
                todo = np.concatenate([rest, new[now]])

    def _beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge of each pair, -1 also at the end of a word."""
        return np.where(right >= 0, self.merged(left, np.maximum(right, 0)), -1)

    @staticmethod
    def _enter(index: list[list[np.ndarray]], places: np.ndarray, pair: np.ndarray) -> None:
        band = pair[places] // BAND
        order = np.argsort(band, kind="stable")
        found, starts = np.unique(band[order], return_index=True)
        for b, group in zip(found.tolist(), np.split(places[order], starts[1:]) if len(found) else ()):
            index[b].append(group)

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long word: its own index as a heap of (merge, place), one merge at a time; O(n log n) whatever it holds."""
        token, n = [*ids.tolist(), -1], len(ids)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ranks = self.merged(ids[:-1], ids[1:]).tolist()
        known = _Known(self.merged)
        heap = [(rank, at) for at, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            gone = after[at]
            if token[at] < 0 or token[gone] < 0 or known[token[at] << 20 | token[gone]] != rank:
                continue
            follow, left = after[gone], before[at]
            token[at], token[gone] = rank, GONE
            after[at], before[follow] = follow, at
            for place, a, b in ((left, token[left], rank), (at, rank, token[follow])):
                if a >= 0 and b >= 0 and (near := known[a << 20 | b]) >= 0:
                    heapq.heappush(heap, (near, place))
        return np.array(token[:-1], np.int32)


class _Known(dict):
    """Pair of ids (a << 20 | b) -> merged id, for one pair at a time."""

    def __init__(self, merged: PairTable):
        super().__init__()
        self.merged = merged

    def __missing__(self, pair: int) -> int:
        found = self[pair] = int(self.merged(np.array([pair >> 20]), np.array([pair & 0xFFFFF]))[0])
        return found


class _Index(dict):
    """Word -> number, in order of first use."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Turns texts into ids; remembers the words of earlier slices up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay, self.pattern = MergeReplay(load_ranks(path)), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.index, self.seen = _Index(), 0
        self.flat, self.ends, self.bytes = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def _split(self, text: str) -> np.ndarray:
        """The numbers of the text's words."""
        number = self.index.__getitem__
        if len(text) <= PART:
            words = self.pattern.findall(text)
            return np.fromiter(map(number, words), np.int32, len(words))
        # the words of a long text are never held together
        found = (number(match.group()) for match in self.pattern.finditer(text))
        return np.fromiter(found, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts in it."""
        if len(self.index) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self._forget()
        words = [self._split(text) for text in texts]
        new = [word.encode() for word in islice(self.index, self.seen, None)]
        if new:
            flat, sizes = self.replay.encode(new)
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.seen, self.bytes = len(self.index), self.bytes + sum(map(len, new))
        used = np.concatenate(words) if words else np.empty(0, np.int32)
        sizes = self.ends[used + 1] - self.ends[used]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.ends[used] - (stops - sizes), sizes) + np.arange(total)]
        counts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return ids, np.concatenate([[0], stops])[counts]


class Decoder:
    """Turns ids back into bytes."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        spelling = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelling[rank] = token
        self.tokens = pa.array(spelling, pa.large_binary())

    def decode(self, flat: pa.Array, bounds: np.ndarray) -> pa.Array:
        """The bytes of each run of ids between two bounds."""
        taken = self.tokens.take(flat)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        offsets = pa.array(ends[bounds], pa.int32())
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets.buffers()[1], taken.buffers()[2]])


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a larger row is a range of its own."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    others = [f for f in batch.schema if f.name != name]
    schema = pa.schema([*others, pa.field(name, column.type)])
    return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), column], schema=schema)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name]).add(name, kind)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the array column ``ids``, and under ``decoded`` the bytes that these ids decode to.

    ``path``: the rank file, which every executor can read. Encoding and decoding
    share one worker and its tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        decoder = Decoder(path) if decoded else None
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            for start, stop in _slices(lengths, SLICE_BYTES):
                part = batch.slice(start, stop - start)
                found, offsets = encoder.encode([t or "" for t in part.column(text).to_pylist()])
                flat = pa.array(found, pa.int32())
                out = _replaced(part, ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
                yield _replaced(out, decoded, decoder.decode(flat, offsets)) if decoder else out

    kind = _with(df, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, T.StructType([f for f in kind if f.name != decoded]).add(decoded, T.BinaryType()) if decoded else kind)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the binary column ``decoded``: the bytes of the ids. A NULL array gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            for start, stop in _slices(counts.astype(np.int64) * 8, SLICE_BYTES):
                part = batch.slice(start, stop - start)
                bounds = np.concatenate([[0], np.cumsum(counts[start:stop])]).astype(np.int64)
                yield _replaced(part, decoded, decoder.decode(part.column(ids).flatten(), bounds))

    return df.mapInArrow(run, _with(df, decoded, T.BinaryType()))


ship(__name__)
