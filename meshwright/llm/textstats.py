"""Counts over whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as K
from .shared import bounded

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",  # the contract's
    "n_lines", "n_letters", "n_upper", "n_digits", "n_bars", "n_bangs", "n_distinct", "n_ends", "n_odd_ends", "n_bare", "n_same_next", "max_word", "n_varied", "n_variable",
]


def _bytes(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


#: The contract's symbol class.
SYMBOLS = _bytes("#*$%&|<>")
_UPPER, _LOWER, _DIGIT, _BAR, _BANG = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789"), _bytes("|"), _bytes("!")
_HIGH = np.arange(256) >= 0xC0  # the first byte of a longer character, which counts as a letter
_ALNUM = _UPPER | _LOWER | _DIGIT | (np.arange(256) >= 0x80)
_END = _bytes(".,;:?")


#: Words of a window whose variety is counted.
VARIETY_WORDS = 500


def _distinct(of: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Different ids with each number below n in `of`."""
    key = np.sort((of << 32) | ids)
    if not len(key):
        return np.zeros(n, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount(key[new] >> 32, minlength=n)


def variety(w: K.Words, ids: np.ndarray, k: int = VARIETY_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each text, (different words, words), both summed over its consecutive k-word windows. The last window of a longer text is its last k
    words, so that all windows are of one size; a text of up to k words is one window."""
    n = w.counts()
    size, many = np.minimum(n, k), -(-n // k)
    at = np.arange(len(ids)) - (np.cumsum(n) - n)[w.doc]
    last = many[w.doc] - 1
    # Words of the last window that the one before holds too.
    again = np.flatnonzero((last > 0) & (at >= n[w.doc] - k) & (at < last * k))
    base = np.cumsum(many) - many  # windows of earlier texts
    window = np.concatenate([base[w.doc] + at // k, base[w.doc[again]] + last[again]])
    per = np.concatenate([[0], np.cumsum(_distinct(window, np.concatenate([ids, ids[again]]), int(many.sum())))])
    return per[base + many] - per[base], size * many


def repeat_words(w: K.Words, k: int = 8) -> np.ndarray:
    """For each text, the words inside k-word windows that it holds twice or more."""
    at = K.repeated(w, k)
    edge = np.zeros(len(w.doc) + 1, np.int32)
    edge[at] += 1
    edge[at + k] -= 1
    return w.word_total((np.cumsum(edge)[:-1] > 0).astype(np.int64))


def lines(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(\\n-split lines with a word, of those the ones equal to an earlier line), for each text."""
    parts = pc.split_pattern(a, "\n")
    doc = np.repeat(np.arange(len(a)), np.diff(parts.offsets.to_numpy()))
    code = parts.flatten().dictionary_encode()
    line = code.indices.to_numpy().astype(np.int64)
    has = (K.words(code.dictionary).counts() > 0)[line] if len(line) else np.zeros(0, bool)
    n = np.bincount(doc[has], minlength=len(a))
    return n, n - _distinct(doc[has], line[has], len(a))


def stats(a: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text. Words, lines and windows are told apart by their bytes, not by hashes."""
    w = K.words(a)
    ids = w.ids()[0]
    d = w.data
    size = w.end - w.start
    n_lines, dup = lines(a)
    last = d[w.end - 1] if len(size) else np.zeros(0, np.uint8)
    plain = _ALNUM[last]
    bare = np.add.reduceat(_ALNUM[d], w.start, dtype=np.int64) == 0 if len(size) else np.zeros(0, bool)  # what follows a word is white space
    varied, variable = variety(w, ids)
    longest = np.zeros(w.n, np.int64)
    np.maximum.at(longest, w.doc, size)
    same = np.zeros(len(ids), np.int64)
    if len(ids) > 1:
        same[1:] = (ids[1:] == ids[:-1]) & (w.doc[1:] == w.doc[:-1])
    return {
        "n_words": w.counts(), "word_chars": w.total(((d & 0xC0) != 0x80) & ~K.SPACE[d]), "n_symbols": w.total(SYMBOLS[d]), "n_dup_lines": dup, "n_repeat_words": repeat_words(w),
        "n_lines": n_lines, "n_letters": w.total(_UPPER[d] | _LOWER[d] | _HIGH[d]), "n_upper": w.total(_UPPER[d]), "n_digits": w.total(_DIGIT[d]), "n_bars": w.total(_BAR[d]), "n_bangs": w.total(_BANG[d]),
        "n_distinct": _distinct(w.doc, ids, w.n), "n_ends": w.word_total(_END[last].astype(np.int64)), "n_odd_ends": w.word_total((~plain & ~_END[last]).astype(np.int64)), "n_bare": w.word_total(bare.astype(np.int64)),
        "n_same_next": w.word_total(same), "max_word": longest, "n_varied": varied, "n_variable": variable,
    }


def text_stats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """A row of COUNTS, after the columns in carry (doc_id), for each row of docs, which has a text; a null text counts as empty."""
    carry = carry or ["doc_id"]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches):
        for b in batches:
            own = [K.column(b, c) for c in carry]
            for i, a in K.pieces(K.column(b, "text")):
                s = stats(a)
                yield pa.RecordBatch.from_arrays([*(x.slice(i, len(a)) for x in own), *(pa.array(s[c].astype(np.int64)) for c in COUNTS)], names=[*carry, *COUNTS])

    return bounded(docs).select(*carry, "text").mapInArrow(K.tidy(run), schema)
