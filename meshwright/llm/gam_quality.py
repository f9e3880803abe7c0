"""Quality classifier: a generalised additive model with pairwise interactions. Boosting goes round the features; each step fits a shallow tree
to one feature's bins and adds it to that feature's lookup table. The pairs of features whose best tree of one cut along each explains the
residuals best then join the rounds with tables of their own. A text's score is the sum of its bins' entries.

Defined cases: a null or empty text has counts of 0 and gets a score like any other; labels that are null, for unknown documents, or
contradictory are used as they are (nulls and unknown ones not at all); without labels of both kinds every score is the share of label 1
(0.5 without any); repeated rows and null ids are scored row by row; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import cut
from .textstats import COUNTS, text_stats

#: The bound of the fitting sample: so many labelled rows outside the held-out fold, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
PREDICT_AT = 0.3
_RATIOS = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_letters", "word_chars"), ("n_upper", "n_letters"), ("n_digits", "word_chars"), ("n_bars", "n_words"),
           ("n_bangs", "n_words"), ("n_distinct", "n_words"), ("n_ends", "n_words"), ("n_odd_ends", "n_words"), ("n_bare", "n_words"), ("n_same_next", "n_words"), ("word_chars", "n_words"), ("n_words", "n_lines")]
FEATURES = [f"{a}/{b}" for a, b in _RATIOS] + ["n_words", "max_word"]


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    cols = [c[a] / np.maximum(c[b], 1) for a, b in _RATIOS] + [np.log1p(c["n_words"]), np.log1p(c["max_word"])]
    return np.stack(cols, 1).astype(np.float64)


class Gam:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, bins: int = 24, cycles: int = 60, pair_bins: int = 6, pairs: int = 4, rate: float = 0.15):
        self.bins, self.cycles, self.pair_bins, self.n_pairs, self.rate = bins, cycles, pair_bins, pairs, rate
        self.base, self.cuts, self.tables, self.pair_cuts, self.pairs, self.pair_tables = 0.0, [], [], [], [], []

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))

    @staticmethod
    def _shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3, lam: float = 2.0) -> np.ndarray:
        """Values of bins after at most `leaves - 1` best splits of an ordered feature."""
        spans, out = [(0, len(g))], np.zeros(len(g))
        gain_of = lambda a, b: a * a / (b + lam)
        while len(spans) < leaves:
            best = (1e-6, None)
            for k, (i, j) in enumerate(spans):
                cg, ch = np.cumsum(g[i:j]), np.cumsum(h[i:j])
                if j - i > 1:
                    gain = gain_of(cg[:-1], ch[:-1]) + gain_of(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain_of(cg[-1], ch[-1])
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (gain[at], (k, i, i + at + 1, j))
            if best[1] is None:
                break
            k, i, m, j = best[1]
            spans[k : k + 1] = [(i, m), (m, j)]
        for i, j in spans:
            out[i:j] = g[i:j].sum() / (h[i:j].sum() + lam)
        return out

    @staticmethod
    def _quadrants(g: np.ndarray, h: np.ndarray, lam: float = 5.0) -> tuple[float, np.ndarray]:
        """(gain, values of cells) of the best tree of two levels that cuts a grid once along each feature."""
        cut = lambda c, a, b: np.stack([c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]])
        if min(g.shape) < 2:
            return 0.0, np.zeros(g.shape)
        a, b = (v.ravel() for v in np.meshgrid(np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1), indexing="ij"))
        sums, weights = (cut(v.cumsum(0).cumsum(1), a, b) for v in (g, h))
        gain = (sums**2 / (weights + lam)).sum(0)
        k = int(gain.argmax())
        value = sums[:, k] / (weights[:, k] + lam)
        out = np.empty(g.shape)
        out[: a[k] + 1, : b[k] + 1], out[: a[k] + 1, b[k] + 1 :], out[a[k] + 1 :, : b[k] + 1], out[a[k] + 1 :, b[k] + 1 :] = value
        return float(gain[k]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        share = float(y.mean()) if len(y) else 0.5
        p = min(max(share, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if len(np.unique(y)) < 2:
            return self
        self.cuts = [self._edges(x[:, j], self.bins) for j in range(x.shape[1])]
        at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(len(y), self.base)

        def boost():
            nonlocal f
            for j, b in enumerate(at):
                q = 1 / (1 + np.exp(-f))
                step = self.rate * self._shallow(np.bincount(b, y - q, len(self.tables[j])), np.bincount(b, q * (1 - q), len(self.tables[j])))
                self.tables[j] += step
                f = f + step[b]

        for _ in range(self.cycles):
            boost()
        self.pair_cuts = [self._edges(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
        shape = lambda i, j: (len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)

        def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-f))
            n = shape(i, j)
            cell = low[i] * n[1] + low[j]
            return cell, np.bincount(cell, y - q, n[0] * n[1]).reshape(n), np.bincount(cell, q * (1 - q), n[0] * n[1]).reshape(n)

        gains = [(self._quadrants(*grid(i, j)[1:])[0], i, j) for i in range(x.shape[1]) for j in range(i)]
        self.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[: self.n_pairs] if gain > 0]
        self.pair_tables = [np.zeros(np.prod(shape(i, j))) for i, j in self.pairs]
        for _ in range(self.cycles // 3):
            for t, (i, j) in zip(self.pair_tables, self.pairs):
                cell, g, h = grid(i, j)
                step = self.rate * self._quadrants(g, h)[1].ravel()
                t += step
                f += step[cell]
            boost()
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
            f += t[np.searchsorted(c, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            a, b = (np.searchsorted(self.pair_cuts[k], x[:, k], "right") for k in (i, j))
            f += t[a * (len(self.pair_cuts[j]) + 1) + b]
        return 1 / (1 + np.exp(-f))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    counts = cut(text_stats(docs))
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out())
    # The rows are thinned out by their hash to about the bound before they are put in order, so that no task sends more than its share.
    rate = min(1_000_000, int(1.2e6 * train_rows / max(1, known.count())) + 1)
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < rate)
    sample = counts.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *COUNTS).limit(train_rows).toPandas()
    x = features({c: sample[c].to_numpy() for c in COUNTS}) if len(sample) else np.zeros((0, len(FEATURES)))
    model = Gam().fit(x, (sample["quality"].to_numpy() > 0).astype(float))

    def run(batches):
        for b in batches:
            score = model.score(features({c: K.column(b, c).to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = counts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
