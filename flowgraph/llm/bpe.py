"""Byte-level BPE encoding and decoding.

Text is cut by the tokenizer's pattern; each distinct piece of a task is encoded once by folding the ranked merges over
its bytes, lowest rank first, and the result is memoised (bounded), so that the fold runs over distinct words and not
over all of them. Decoding gathers the vocabulary's binary pieces by id and concatenates them.

The vocabulary is a rank file (base64 piece, blank, rank per line); its bytes, not the corpus, are what is broadcast.

Cases: null text encodes as empty text, to no ids; a very long text is held alone, and a very long piece of one is merged with
a heap; rows that repeat a text get the same ids; of equal merges in a piece the leftmost goes first; null ids decode to null; an
id outside the vocabulary decodes to no bytes; empty tables give empty results; further columns pass through unchanged, but for
one that has a result's name, which the result replaces (choose another name by the parameter).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import without

#: Most pieces that a task remembers, and most characters of them. Both bound memory only; results don't depend on them.
MEMO_PIECES, MEMO_LENGTH = 1 << 16, 1 << 21
#: Bytes of text, or ids, that are worked on at once (one longer text is held alone).
HELD = 1 << 19
#: Pieces of more bytes than this are merged alone, with a heap: n log n instead of n squared.
LONG_PIECE = 96
NONE = np.iinfo(np.int32).max


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The rank map of a rank file's content."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, data.splitlines()) if piece}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Merges:
    """The ranked merges of a vocabulary, as a table from (left id, right id) to the id of the two joined."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, len(keys).bit_length() + 2)
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, NONE, np.int32)
        left, slots = np.arange(len(keys)), self._slot(np.array(keys, np.int64))
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        while len(left):  # open addressing: those that find their slot taken try the next one
            free = left[self.keys[slots[left]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, NONE where two ids don't join."""
        keys = left << 32 | right
        slots = self._slot(keys)
        out = self.values[slots]
        held = self.keys[slots]
        out[held != keys] = NONE
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slots[open_] += 1
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def fold(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, end to end, and how many each has: as long as two neighbours of a piece join, the pair of
        lowest rank does, leftmost first. Pieces of one length are folded together, a row each; every round joins one
        pair in every row that still has one."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        lengths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                lengths.setdefault(0, []).append(i)
            elif len(piece) > LONG_PIECE:
                found.append((np.array([i]), np.array([_merge_long(piece, self.ranks)])))
            elif piece:
                lengths.setdefault(len(piece), []).append(i)
        if own := lengths.pop(0, None):
            found.append((np.array(own), np.array([[self.ranks[pieces[i]]] for i in own])))
        for n, own in lengths.items():
            at = np.array(own)
            ids = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)].reshape(-1, n)
            pairs = self.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(at), n - 1)
            while len(at):
                width = ids.shape[1]
                if width == 1:
                    found.append((at, ids))
                    break
                row = np.arange(len(at))
                best = pairs.argmin(axis=1)
                joined = pairs[row, best]
                more = joined != NONE
                if not more.all():
                    found.append((at[~more], ids[~more]))
                    at, ids, pairs, best, joined = at[more], ids[more], pairs[more], best[more], joined[more]
                    row = np.arange(len(at))
                ids[row, best] = joined
                ids = ids[np.arange(width) != (best + 1)[:, None]].reshape(len(at), width - 1)
                pairs = pairs[np.arange(width - 1) != best[:, None]].reshape(len(at), width - 2)
                for own_rows, left in ((np.flatnonzero(best > 0), best - 1), (np.flatnonzero(best < width - 2), best)):
                    j = left[own_rows]
                    pairs[own_rows, j] = self.look(ids[own_rows, j], ids[own_rows, j + 1])
        counts = np.zeros(len(pieces), np.int64)
        for at, ids in found:
            counts[at] = ids.shape[1]
        starts, flat = np.cumsum(counts) - counts, np.empty(counts.sum(), np.int32)
        for at, ids in found:
            flat[starts[at][:, None] + np.arange(ids.shape[1])] = ids
        return flat, counts


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """merge() with a heap of pairs over a doubly linked list of spans."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = 0, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start : start + count] for each start and count, end to end."""
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


class Encoder:
    """Encodes texts; remembers the ids of the pieces met so far, in a bounded memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges, self.find, self.memo = Merges(ranks), regex.compile(pattern).findall, {}
        self.flat, self.counts, self.length = np.empty(0, np.int32), np.empty(0, np.int64), 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        cut = [self.find(text) for text in texts]
        distinct = set().union(*cut)
        fresh = list(distinct.difference(self.memo))
        flat, counts = self.merges.fold([piece.encode() for piece in fresh])
        at = dict(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh))))
        flat, counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        length = sum(map(len, fresh))
        if len(counts) <= MEMO_PIECES and self.length + length <= MEMO_LENGTH:
            self.memo |= at
            self.length += length
            self.flat, self.counts = flat, counts
            at = self.memo
        else:
            at |= {piece: self.memo[piece] for piece in distinct.intersection(self.memo)}
        starts = np.cumsum(counts) - counts
        sizes = np.array([len(pieces) for pieces in cut], np.int64)
        words = np.fromiter(map(at.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        before = np.concatenate([[0], np.cumsum(counts[words])])
        ends = np.cumsum(sizes)
        return gather(flat, starts[words], counts[words]), before[ends] - before[ends - sizes]


def lots(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows of about HELD in size together; a batch of no rows is one slice."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // HELD)) + 1
    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(first, last - first)


def _encoding(shared, pattern: str, at: int, kept: list[int], ids: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(parse_ranks(shared.value), pattern)
        for batch in batches:
            for lot in lots(batch, pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()):
                flat, counts = encoder([value.as_py() or "" for value in lot.column(at)])
                column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts], dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(lot.column(i) for i in kept), column], names=[*(lot.schema.names[i] for i in kept), ids])

    return run


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """df with the ids of each whole text as an array<int>; no special tokens. keep_text: whether the text goes on with them.
    decoded: the name of one more column, the bytes that the ids decode to, made by the same tasks."""
    df = without(df, [ids, decoded] if decoded else [ids], text)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != at]
    fields = [*(df.schema.fields[i] for i in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))]
    to_ids = _encoding(shared, pattern, at, kept, ids)
    if decoded is None:
        return df.mapInArrow(to_ids, T.StructType(fields))
    to_bytes = _decoding(shared, len(kept), decoded)
    return df.mapInArrow(lambda batches: to_bytes(to_ids(batches)), T.StructType([*fields, T.StructField(decoded, T.BinaryType())]))


def pieces_of(column: pa.ListArray, n: int, start: np.ndarray, length: np.ndarray, store: np.ndarray) -> list[bytes | None]:
    """The joined pieces of each list of ids; a piece is store[start : start + length], and the last one stands for other ids."""
    flat = column.flatten().fill_null(-1).to_numpy().astype(np.int64)
    flat[(flat < 0) | (flat >= n)] = n
    counts = np.array(column.value_lengths().fill_null(0), np.int64)
    size = np.concatenate([[0], np.cumsum(length[flat])])[np.concatenate([[0], np.cumsum(counts)])]
    data = gather(store, start[flat], length[flat]).tobytes()
    return [data[a:b] if whole else None for a, b, whole in zip(size[:-1], size[1:], column.is_valid().to_pylist())]


def _decoding(shared, at: int, decoded: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in parse_ranks(shared.value).items()}
        n = max(pieces, default=-1) + 1
        length = np.array([len(pieces.get(i, b"")) for i in range(n)] + [0], np.int64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        store = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(n)), np.uint8)
        del pieces
        for batch in batches:
            for lot in lots(batch, 4 * batch.column(at).value_lengths().fill_null(0).to_numpy()):  # a piece has some four bytes
                rows = pieces_of(lot.column(at), n, start, length, store)
                yield pa.RecordBatch.from_arrays([*lot.columns, pa.array(rows, pa.binary())], names=[*lot.schema.names, decoded])

    return run


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of each list of ids, as binary (a cut text need not be UTF-8)."""
    df = without(df, [decoded], ids)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    run = _decoding(shared, df.columns.index(ids), decoded)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))
