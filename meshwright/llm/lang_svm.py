"""Language identification by hierarchical discrimination: one-versus-rest linear support vector machines choose the language family, then
one-versus-one machines vote between the languages of that family. Features: hashed byte 2-, 3- and 4-grams of the whole lower-cased text.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null language teaches nothing; with one learned language that one
is predicted, with none `und`; repeated rows and null ids are predicted row by row; an empty table gives an empty result."""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .gam_quality import held_out
from .shared import bounded, small

#: Hashed features; the bounds of the fitting sample, in rows for each language and in all, and the rows of any language that the latter leaves.
DIM, PER_LANG, TRAIN_ROWS, LEAST_ROWS = 2048, 1500, 8000, 20
#: The least score of a document whose language counts as known.
LEAST_SCORE = 0.5
#: Families of language codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur pa gu mr ne".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY = {c: f for f, cs in FAMILIES.items() for c in cs}
_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def grams(a: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features of unit length for each text, whether it has a letter)."""
    data, off = K.raw(a)
    n = len(off) - 1
    d = _FOLD[data]
    if len(d) > 1:  # capitals of two-byte Latin letters
        after = np.concatenate([[False], data[:-1] == 0xC3])
        d = np.where(after & (data >= 0x80) & (data <= 0x9E), data + 0x20, d).astype(np.uint8)
    out = np.zeros((n, dim), np.float32)
    if len(d):
        doc = np.repeat(np.arange(n), np.diff(off))
        end = off[1:][doc]
        x = d.astype(np.uint32)
        h = x * _MULT[0]
        for k in range(1, 4):
            h = h[:-1] + x[k:] * _MULT[k] if k < len(x) else h[:0]
            ok = np.arange(len(h)) + k < end[: len(h)]
            ok &= (d[: len(h)] != 32) | (d[1 : len(h) + 1] != 32)
            v = h ^ (h >> np.uint32(15))
            v = v * np.uint32(0x2C1B3C6D)
            out += np.bincount(doc[: len(h)][ok] * dim + (v[ok] >> np.uint32(12)) % np.uint32(dim), minlength=n * dim).reshape(n, dim)
    plain = np.concatenate([[0], np.cumsum((d != 32) & (data < 0x80))]) if len(d) else np.zeros(1, np.int64)
    letter = plain[off[1:]] > plain[off[:-1]]
    for i in np.flatnonzero(~letter & (np.diff(off) > 0)):
        letter[i] = any(c.isalpha() for c in a[int(i)].as_py())
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)), letter


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss and classes of equal weight, by accelerated gradients."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * c * 10
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-9)
    step = 1 / (1 + 2 * top)
    w = z = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * (x.T @ (weight * y * slack)))
        z = new + t / (t + 3) * (new - w)
        w = new
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, lang: list[str]):
        self.langs = sorted(set(lang))
        lang = np.array(lang, object)
        fam = np.array([_FAMILY.get(v, f"only {v}") for v in lang], object)
        self.families = sorted(set(fam))
        self.members = {f: [v for v in self.langs if _FAMILY.get(v, f"only {v}") == f] for f in self.families}
        many = len(self.families) > 1
        self.top = np.stack([svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in self.families]) if many else None
        self.pairs = {}
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                of = (lang == a) | (lang == b)
                self.pairs[a, b] = svm(x[of], np.where(lang[of] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        x = np.concatenate([x, np.ones((n, 1), np.float32)], 1)
        sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        out, score = np.full(n, "und", object), np.zeros(n)
        if not self.langs:
            return out, score
        if self.top is None:
            which, sure = np.zeros(n, np.int64), np.ones(n)
        else:
            m = x @ self.top.T
            which = m.argmax(1)
            order = np.sort(m, 1)
            sure = sigmoid(order[:, -1] - order[:, -2])
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(which == k)
            own = self.members[f]
            votes, margin = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for (i, a), (j, b) in itertools.combinations(enumerate(own), 2):
                m = x[rows] @ self.pairs[a, b]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margin[:, i] += m
                margin[:, j] -= m
            best = (votes + np.tanh(margin) * 0.4).argmax(1) if len(rows) else np.zeros(0, np.int64)
            out[rows] = np.array(own, object)[best]
            score[rows] = sure[rows] * (sigmoid(margin[np.arange(len(rows)), best] / (len(own) - 1)) if len(own) > 1 else 1)
        return out, score


def shares(rows: dict[str, int], total: int) -> dict[str, int]:
    """How many of its rows each language gives, total in all at most: the least first, each up to an even part of what is left."""
    out: dict[str, int] = {}
    for k, (v, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        out[v] = min(n, (total - sum(out.values())) // (len(rows) - k))
    return out


def learn(docs: DataFrame, per_lang: int = PER_LANG, train_rows: int = TRAIN_ROWS) -> Hierarchy:
    """The machines, fitted to a bounded sample of the rows outside the held-out fold: up to about per_lang rows of each language, by the hash
    of their id, and train_rows in all (LEAST_ROWS for each language where that is more), which the languages share out evenly, those with few
    rows first. Every language is learned: the driver holds a number for each."""
    spark = docs.sparkSession
    known = bounded(docs).select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    train_rows = max(train_rows, LEAST_ROWS * len(per))
    quota = shares({v: min(n, per_lang) for v, n in per.items()}, train_rows)
    rates = spark.createDataFrame([(v, min(1_000_000, int(1e6 * quota[v] / n) + 1), quota[v] >= n) for v, n in per.items()], "_lang string, _share long, _whole boolean")

    def featured(batches):
        for b in batches:
            lang = K.column(b, "lang")
            for i, a in K.pieces(K.column(b, "text"), max_rows=500):
                x, letter = grams(a)
                own = K.column(b, "_whole").slice(i, len(a))
                yield pa.RecordBatch.from_arrays([lang.slice(i, len(a)), own, pa.array([v.tobytes() for v in x], pa.binary()), pa.array(letter)], names=["lang", "_whole", "x", "letter"])

    # The sample is chosen before any features are made: rows by the hash of their id, at each language's rate.
    pick = known.join(small(rates), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.lit(1_000_000)) < F.col("_share"))
    sample = pick.select("text", "lang", "_whole").mapInArrow(K.tidy(featured), "lang string, _whole boolean, x binary, letter boolean").where("letter")
    sample = sample.orderBy(~F.col("_whole"), F.xxhash64("x"), "x", "lang").limit(train_rows)  # languages taken whole come first

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        lang = [v for b in held for v in K.column(b, "lang").to_pylist()]
        x = np.concatenate([np.frombuffer(b"".join(K.column(b, "x").to_pylist()), np.float32).reshape(b.num_rows, DIM) for b in held]) if held else np.zeros((0, DIM), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Hierarchy(x, lang))], pa.binary())], names=["model"])

    # The bounded sample is one task's, which returns the weights alone.
    made = sample.mapInArrow(K.tidy(fitted), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Hierarchy(np.zeros((0, DIM), np.float32), [])


def _predict(model: Hierarchy, a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, letter = grams(a)
    lang, score = model.predict(x)
    lang[~letter], score[~letter] = "und", 0.0
    return lang, score


def identify(docs: DataFrame, per_lang: int = PER_LANG, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""
    model = learn(docs, per_lang, train_rows)

    def run(batches):
        for b in batches:
            ids = K.column(b, "doc_id")
            for i, a in K.pieces(K.column(b, "text"), max_rows=500):
                lang, score = _predict(model, a)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(a)).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(K.tidy(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with their columns, whose language can be told: not `und`, and with a score of at least `least`."""
    model = learn(docs)

    def run(batches):
        for b in batches:
            for i, a in K.pieces(K.column(b, "text"), max_rows=500):
                lang, score = _predict(model, a)
                yield b.slice(i, len(a)).filter(pa.array((lang != "und") & (score >= least)))

    return docs.mapInArrow(K.tidy(run), docs.schema)
