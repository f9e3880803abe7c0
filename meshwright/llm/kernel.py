"""Vectorised byte kernels: words, shingles and their hashes over whole Arrow batches of texts, without a Python loop over words."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # the white space of `[^\x20\x09-\x0D]+`
_ODD = U(0x9E3779B97F4A7C15)
_BASE = U(0xD1342543DE82EF95)
#: Bytes of a run of texts.
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _ODD
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_array(column) -> pa.Array:
    """A string array without nulls (null: empty) in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def pieces(column, max_bytes: int = PIECE, max_rows: int = 1000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of whole texts, of about max_bytes each, so that memory doesn't follow the batch."""
    a = text_array(column)
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    i = 0
    while i < len(a):
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = max(i + 1, min(j, i + max_rows, len(a)))
        yield i, a.slice(i, j - i)
        i = j


def give_back() -> None:
    """Gives the free memory of this process back to the system: Arrow's pool and the C library (glibc's, others have no such call) keep it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable) -> Callable:
    """run, a function for mapInArrow, whose worker gives free memory back at a task's end: workers live on and are used by later stages, and what
    they keep counts beside those stages' own."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    off: np.ndarray  # texts' bounds in data
    start: np.ndarray  # words' bounds in data
    end: np.ndarray
    doc: np.ndarray  # each word's text
    first: np.ndarray  # each text's first word, and the count at last
    _ids: tuple[np.ndarray, pa.Array] | None = None
    _hashes: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """(a number for each word, the different words' bytes): words have the same number only if their bytes are the same."""
        if self._ids is None:
            size = self.end - self.start
            off = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=off[1:])
            inside = self.data[~SPACE[self.data]]
            found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(inside)]).dictionary_encode()
            self._ids = found.indices.to_numpy().astype(np.int64), found.dictionary
        return self._ids

    def different(self) -> list[bytes]:
        """The different words, in the order of their numbers."""
        a = self.ids()[1]
        if not len(a):
            return []
        data, off = a.buffers()[2].to_pybytes(), np.frombuffer(a.buffers()[1], np.int32)[: len(a) + 1].tolist()
        return [data[i:j] for i, j in zip(off, off[1:])]

    def hashes(self) -> np.ndarray:
        """64 bits of each word, the same in every task. Different words may share them: what must be exact goes by ids."""
        if self._hashes is None:
            own = np.array([xxhash.xxh3_64_intdigest(v) for v in self.different()], U)
            self._hashes = own[self.ids()[0]] if len(own) else own
        return self._hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum over each text's bytes, whose numbers are small."""
        out = np.zeros(self.n, np.int64)
        some = np.flatnonzero(np.diff(self.off))
        if len(some):
            out[some] = np.add.reduceat(per_byte, self.off[some], dtype=np.int64)
        return out

    def word_total(self, per_word: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(per_word, dtype=np.float64 if per_word.dtype.kind == "f" else np.int64)])
        return c[self.first[1:]] - c[self.first[:-1]]


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of True that don't cross a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    a, z = off[:-1][full], off[1:][full] - 1
    begin[a] = inside[a]
    end[z] = inside[z]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(a: pa.Array) -> Words:
    data, off = raw(a)
    start, end = runs(~SPACE[data], off)
    return Words(data, off, start, end, np.searchsorted(off, start, "right") - 1, np.searchsorted(start, off))


def inside(w: Words, k: int) -> np.ndarray:
    """The first words of all k-word windows inside a text."""
    n = len(w.doc) - k + 1
    return np.flatnonzero(np.arange(n) + k <= w.first[w.doc[:n] + 1]) if n > 0 else np.zeros(0, np.int64)


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number below len(a) for each pair of numbers below 2**31: equal ones for equal pairs only."""
    return pa.array((a << 32) | b).dictionary_encode().indices.to_numpy().astype(np.int64)


def repeated(w: Words, k: int) -> np.ndarray:
    """The first words of the k-word windows that their text holds twice or more. A sum of the words' numbers finds windows that may be equal;
    those are then told apart by all their words."""
    at = inside(w, k)
    if not len(at):
        return at
    own = w.ids()[0]
    s = mix(w.doc[at].astype(U))
    for j in range(k):
        s = s + mix(np.full(1, j, U)) * own[at + j].astype(U)
    key = pa.array(s).dictionary_encode().indices.to_numpy()
    at = at[np.bincount(key)[key] > 1]
    number = w.doc[at]
    for j in range(k):
        number = numbered(number, own[at + j])
    return at[np.bincount(number)[number] > 1] if len(at) else at


def windows(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every k-word window inside a text."""
    at = inside(w, k)
    s = np.zeros(len(at), U)
    for j in range(k):
        s = mix(s + h[at + j])
    return at, s


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 54-bit hash, times) of each text's different shingles, sorted; a text of fewer than k words has one shingle of all of them."""
    h = w.hashes()
    at, s = windows(w, h, k)
    n = w.counts()
    doc = w.doc[at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        own = np.zeros(len(few), U)
        for j in range(k - 1):
            has = n[few] > j
            own[has] = mix(own[has] + h[w.first[few[has]] + j])
        doc, s = np.concatenate([doc, few]), np.concatenate([s, mix(own ^ (_BASE * n[few].astype(U)))])
    key = np.sort((doc.astype(U) << U(54)) | (s >> U(10)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(key)]]))
    key = key[new]
    return (key >> U(54)).astype(np.int64), key & U((1 << 54) - 1), times


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
