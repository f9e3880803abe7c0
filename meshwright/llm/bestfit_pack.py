"""Best-fit packing with certified repacking: documents are cut into pieces of at most a sequence, partitions pack their pieces best-fit
decreasing, and dual feasible functions give each partition a lower bound of its sequence count. A partition that meets its bound is done;
those with a gap keep their full sequences, exchange the documents of the others and pack again; the old packing stays where it isn't beaten.

Defined cases: a null or empty text is the separator alone (length 1); repeated rows and null ids are documents of their own; only texts
longer than a sequence are cut, and a very long one gives as many pieces as it needs; an empty table gives an empty result."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded, chunks, cut

CAPACITY = 2048
#: Pieces of one packing group, rounds of exchange, and words and parts of words that a worker's cache holds.
GROUP, ROUNDS, CACHE, PARTS = 8192, 3, 1_000_000, 150_000


def _byte_chars() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable bytes as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: The steps of a tokenizer file whose pieces never cross white space, which `Coder` may therefore encode word by word.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_PROBES = "It's 2024, we'll see: WORDS don't end-here (x1) caf\u00e9 \u00c0\u00c9\u00dc --- $9.50 ''s a_b".split()


class Coder:
    """Ids of whole texts. A tokenizer of the steps above encodes each different word once; any other one encodes the texts as they are."""

    _PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    _PLAIN = regex.compile(r"[\x21-\x7e¡-įĲ-ňŊ-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.chars = _byte_chars()
        self.clear()
        spec = json.loads(self.tok.to_str())
        self.by_word = all(spec.get(k) == v for k, v in _STEPS.items()) and spec["model"]["type"] == "BPE"
        self.by_word = self.by_word and all(self._word(w) == self.tok.encode(w, add_special_tokens=False).ids for w in _PROBES)

    def clear(self):
        """The cache: the words' bytes and where their ids are in a pool. Words are known as seen lately or before; once CACHE / 2 of them were seen
        lately, those that weren't are forgotten, so that frequent words stay."""
        self.known: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}
        self.slots = 0
        self.at, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.parts: dict[str, bytes] = {}

    def _age(self):
        slots = np.fromiter(self.known.values(), np.int64, len(self.known))
        at, size = self.at[slots], self.size[slots]
        begin = np.cumsum(size) - size
        total = int(size.sum())
        self.pool[:total] = self.pool[np.repeat(at - begin, size) + np.arange(total)]
        self.used, self.slots = total, len(slots)
        self.at[: len(slots)], self.size[: len(slots)] = begin, size
        self.before, self.known = dict(zip(self.known, range(len(slots)))), {}

    def _word(self, text: str) -> list[int]:
        if not self._PLAIN.fullmatch(text) or "<|" in text:  # its lower case or composition may depend on more than single characters
            return self.tok.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for part in self._PIECE.findall(text.lower()):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                ids = self.parts[part] = array("I", [t.id for t in self.tok.model.tokenize("".join([self.chars[b] for b in part.encode()]))]).tobytes()
            out += memoryview(ids).cast("I")
        return out

    def _add(self, words: list[bytes]):
        ids: list[int] = []
        need = self.slots + len(words)
        if need > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(need, x.dtype)]) for x in (self.at, self.size))
        for k, w in enumerate(words, self.slots):
            own = self._word(w.decode())
            self.known[w], self.at[k], self.size[k] = k, self.used + len(ids), len(own)
            ids += own
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(self.used + len(ids) - len(self.pool), len(self.pool) // 2), self.pool.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.slots = self.used + len(ids), need

    def encode(self, a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with a 0 after it; texts' bounds in them)."""
        texts = range(len(a)) if not self.by_word else np.flatnonzero([b"<|" in t for t in a.cast(pa.binary()).to_pylist()]) if b"<|" in K.raw(a)[0].tobytes() else ()
        whole = {int(k): np.array([*self.tok.encode(a[int(k)].as_py(), add_special_tokens=False).ids, 0], np.uint32) for k in texts}
        if not self.by_word:
            bound = np.concatenate([[0], np.cumsum([len(v) for v in whole.values()], dtype=np.int64)])
            return np.concatenate([np.zeros(0, np.uint32), *whole.values()]), bound
        w = K.words(a)
        number, different = w.ids()[0], w.different()
        if len(self.known) > CACHE // 2:
            self._age()
        new = []
        for v in different:
            if v not in self.known:
                k = self.before.get(v)
                if k is None:
                    new.append(v)
                else:
                    self.known[v] = k
        self._add(new)
        slots = np.array([self.known[v] for v in different], np.int64)[number] if different else np.zeros(0, np.int64)
        size = self.size[slots]
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = np.zeros(begin[-1] + w.n, np.uint32)
        place = np.arange(begin[-1]) + np.repeat(w.doc, size)
        ids[place] = self.pool[np.repeat(self.at[slots] - begin[:-1], size) + np.arange(begin[-1])]
        bound = begin[w.first] + np.arange(w.n + 1)
        if whole:  # texts in which a special token's string may be, which the tokenizer takes out before it looks at words
            parts = [whole.get(k, ids[bound[k] : bound[k + 1]]) for k in range(w.n)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        return ids, bound


_coders: dict[str, Coder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, rid long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text); rid numbers them."""

    def run(batches: Iterator[pa.RecordBatch]):
        coder = _coders.get(tokenizer) or _coders.setdefault(tokenizer, Coder(tokenizer))
        task = TaskContext.get()
        rid = (task.partitionId() if task else 0) << 36
        for b in batches:
            doc_ids = K.column(b, "doc_id").cast(pa.int64())
            for i, a in K.pieces(K.column(b, "text"), max_rows=4000):
                ids, off = coder.encode(a)
                raw, off_l = ids.astype("<u4").tobytes(), off.tolist()
                rows: tuple[list, ...] = ([], [], [], [], [])
                for k in range(len(a)):
                    text = raw[4 * off_l[k] : 4 * off_l[k + 1]]
                    for p, s in enumerate(range(0, len(text), 4 * capacity)):
                        cut_ = text[s : s + 4 * capacity]
                        for r, v in zip(rows, (i + k, p, s // 4, len(cut_) // 4, zlib.crc32(cut_))):
                            r.append(v)
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:]), pa.array(np.arange(rid, rid + n))], names=["doc_id", "piece", "start", "length", "ids_crc32", "rid"]
                )
                rid += n

    return bounded(docs).select("doc_id", "text").mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by best-fit decreasing; bins are numbered from 0."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, mask, n = [[] for _ in range(capacity + 1)], 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = open_[room].pop()
            if not open_[room]:
                mask &= ~(1 << room)
        else:
            room, k, n = capacity, n, n + 1
        bin_of[i], offset[i] = k, capacity - room
        if room > s:
            open_[room - s].append(k)
            mask |= 1 << (room - s)
    return bin_of, offset


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the volume bound and of those by two families of dual feasible functions: thresholds that round large pieces up and leave
    small ones out, and roundings to multiples of 1/k."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((n * x).sum()) // capacity)
    count, volume = np.cumsum(n), np.cumsum(n * x)
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e]
    middle = volume[capacity - e] - volume[e - 1]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max()))
    for k in range(1, 21):
        y = (k + 1) * x
        exact = y % capacity == 0
        best = max(best, -(-int((n * np.where(exact, k * x, y // capacity * capacity)).sum()) // (k * capacity)))
    return best


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, rid long, sequence_id long, offset long, done boolean"


def _round(pieces: DataFrame, groups: int, capacity: int, last: bool) -> DataFrame:
    """Packs groups of rows with the same g. Rows that come with a packing keep it unless the new one has fewer sequences."""

    def pack(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by("rid")
        length, rid = t["length"].to_numpy(), t["rid"].to_numpy()
        old, offset = t["sequence_id"].to_numpy(), t["offset"].to_numpy()
        k, at = best_fit(length, capacity)
        bound, bins, before = lower_bound(length, capacity), int(k.max()) + 1, len(np.unique(old))
        if bins < before:
            head = np.zeros(bins, np.int64)
            head[k[at == 0]] = rid[at == 0]  # a sequence is named after its first piece
            old, offset = head[k], at
        else:
            bins = before
        of = np.unique(old, return_inverse=True)[1]
        done = np.full(len(old), last or bins <= bound) | (np.bincount(of, length)[of] == capacity)
        cols = dict(zip(t.column_names, t.columns)) | {"sequence_id": pa.array(old), "offset": pa.array(offset), "done": pa.array(done)}
        return pa.Table.from_arrays([cols[c] for c in (s.split()[0] for s in _PACKED.split(", "))], names=[s.split()[0] for s in _PACKED.split(", ")]).combine_chunks().to_batches()[0]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by group; a group has a bounded number of rows
            g = K.column(b, "g").to_numpy()
            edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for i, j in zip(edge, edge[1:]):
                if held and j > i and K.column(held[0], "g")[0].as_py() != int(g[i]):
                    yield pack(pa.Table.from_batches(held))
                    held = []
                if j > i:
                    held.append(b.slice(i, j - i))
        if held:
            yield pack(pa.Table.from_batches(held))

    return pieces.repartition(groups, "g").sortWithinPartitions("g").mapInArrow(run, _PACKED)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = cut(token_pieces(docs, tokenizer or default_tokenizer(), capacity).withColumns({"sequence_id": F.col("rid"), "offset": F.lit(0).cast("long")}))
    found = [alone.where(F.col("length") == capacity).select(out)]
    rest = alone.where(F.col("length") < capacity)
    for r in range(rounds):
        n = rest.count()
        if not n:
            break
        groups = chunks(n, group)
        # Whole sequences move together; in the first round that is every piece alone.
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("sequence_id", F.lit(r)), F.lit(groups)))
        packed = cut(_round(dealt, groups, capacity, r == rounds - 1))
        found.append(packed.where("done").select(out))
        rest = packed.where("not done").drop("done")
    done = found[0]
    for f in found[1:]:
        done = done.unionByName(f)
    return done
