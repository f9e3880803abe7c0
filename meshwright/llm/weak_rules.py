"""Quality rules as weak supervision: each rule votes good, bad or abstains; expectation-maximisation over the counted vote patterns
estimates how each rule's votes go with a document's hidden class; the posterior probability of good decides.

Defined cases: a null or wordless text has counts of 0 and fails the base; rows are scored one by one, so repeated rows and null ids
give repeated rows; an empty table gives an empty result; columns besides doc_id and text don't matter."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textstats import text_stats

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
KEEP_AT = 0.5


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> list[tuple[str, Column, Column]]:
    """Each rule: its name, when it votes bad, when it votes good; else it abstains. No rule asks how long a text is: shares of ends of sentences
    have half an end added, so that a short text without any is no evidence."""
    never = F.lit(False)
    ends = (F.col("n_ends") + 0.5) / F.greatest(F.col("n_words"), F.lit(1))
    return [
        ("symbols", _share("n_symbols", "word_chars") > 0.1, never),
        ("odd_ends", _share("n_odd_ends", "n_words") > 0.3, never),
        ("letters", _share("n_letters", "word_chars") < 0.7, _share("n_letters", "word_chars") > 0.95),
        ("capitals", _share("n_upper", "n_letters") > 0.4, _share("n_upper", "n_letters") < 0.15),
        ("bangs", _share("n_bangs", "n_words") > 0.5, never),
        ("bare_words", _share("n_bare", "n_words") > 0.2, never),
        ("bars", _share("n_bars", "n_words") > 0.1, never),
        ("same_next", _share("n_same_next", "n_words") > 0.2, never),
        ("variety", _share("n_varied", "n_variable") < 0.15, _share("n_varied", "n_variable") > 0.35),
        ("same_lines", _share("n_dup_lines", "n_lines") > 0.3, never),
        ("stops", ends < 0.01, _share("n_ends", "n_words").between(0.02, 0.5)),
    ]


#: What is believed of any rule before a text is seen: its chances of voting bad, abstaining and voting good, in good texts and in bad ones.
#: Beliefs count as so many texts for each text seen, so that they weigh alike at every size of corpus.
BELIEF = np.array([[0.004, 0.446, 0.55], [0.3, 0.45, 0.25]])
GOOD_BELIEF, BELIEF_WEIGHT = 0.8, 0.02


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, weight: float = BELIEF_WEIGHT) -> tuple[float, np.ndarray]:
    """EM for two hidden classes with votes independent within a class, with Dirichlet priors: texts believed in beforehand are added to those
    counted. patterns: rows of votes 0 bad, 1 abstain, 2 good. Returns the log odds of good, and for each rule and vote the log ratio of its
    probability in good and bad texts. Where a class has few texts, the beliefs keep its meaning; where it has many, the corpus decides. A rule
    that votes both ways abstains as often in either class, so that texts which rules don't apply to are not taken for the bad class."""
    k, mass = patterns.shape[1], float(counts.sum())
    added = max(mass * weight, 1e-9)
    votes = [patterns == v for v in range(3)]
    both = votes[2].any(0) if len(patterns) else np.zeros(k, bool)
    net = votes[2].sum(1) - 3.0 * votes[0].sum(1)
    good = 1 / (1 + np.exp(-np.clip(net + 1, -30, 30)))
    prior, ratio = 0.0, np.zeros((k, 3))
    for _ in range(rounds):
        share = ((good * counts).sum() + added * GOOD_BELIEF) / (mass + added)
        prior = math.log(share / (1 - share))
        p = np.stack([np.stack([(wt * counts) @ v for v in votes], 1) for wt in (good, 1 - good)])  # class, rule, vote
        p = p + added * BELIEF[:, None, :]
        of = np.where(both[None, :], p[:, :, 0] + p[:, :, 2], p.sum(2))
        ratio = np.log(p[0] / of[0][:, None]) - np.log(p[1] / of[1][:, None])
        ratio[both, 1] = 0.0
        new = 1 / (1 + np.exp(-np.clip(prior + ratio[np.arange(k), patterns].sum(1), -30, 30)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return prior, ratio


def _base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _votes() -> list[Column]:
    return [F.when(bad, 0).when(good, 2).otherwise(1).cast("byte").alias(f"vote_{n}") for n, bad, good in rules()]


def learn(counted: DataFrame) -> Column:
    """The posterior of good, fitted to rows of counts. Texts that pass the base teach; what is collected is bounded by the number of vote
    patterns, not by the rows."""
    names = [r[0] for r in rules()]
    seen = counted.where(~_base()).groupBy(*_votes()).count().collect()
    votes = np.array([list(r)[:-1] for r in seen], np.int64).reshape(-1, len(names))
    prior, ratio = fit(votes, np.array([r["count"] for r in seen], float)) if seen else (0.0, np.zeros((len(names), 3)))
    odds = F.lit(float(prior))
    for (_, bad, good), r in zip(rules(), ratio):
        odds = odds + F.when(bad, float(r[0])).when(good, float(r[2])).otherwise(float(r[1]))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: its counts, votes, base_failed, posterior and kept."""
    m = cut(text_stats(docs))
    posterior = learn(m)
    return m.select("*", *_votes(), _base().alias("base_failed"), posterior.alias("posterior"), (~_base() & (posterior >= KEEP_AT)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps, with their columns. Texts are counted again rather than joined, as rows may share an id."""
    posterior = learn(text_stats(docs.select("doc_id", "text")))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text"))
    return text_stats(row, carry=["row"]).where(~_base() & (posterior >= KEEP_AT)).select("row.*")
