"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

Voters say toxic, clean or nothing of a sampled document.  Many read its text alone: two seed lexicons; lexicons grown from
other rows (words and word beginnings that toxic rows of the other ``FOLDS`` - 1 folds hold far more often, dealt into
disjoint groups at three strengths), so that no lexicon has seen the label of a row it votes on; the presence of what clean
rows hold more often; and patterns of characters (``PATTERNS``: shouting, runs of exclamation marks, masked, stretched and
spaced-out words, insults to a second person, threats, heaped insults).  The annotators are one more voter, with an
accuracy to be estimated like all others.

The label model has a class prior (the annotators' rate) and, for each voter, the chance of each vote given the class, found
by expectation maximisation from the mean vote.  Correlations of the votes within a class are estimated from what each vote differs from its
expectation in that class; voters that go together count for less: a voter's weight is the inverse
of one plus its correlations above ``NOISE``.  No voter is exempt.  A logistic regression with an L1 penalty over hashed
text features is then fitted to the posterior labels, and it alone scores documents, so labels, ids, languages and sources
are no inputs.

Labels are used only of rows whose crc32(id as text) mod 4 is not 2.  Without usable labels the seed lexicon votes alone
on nothing, and all scores are PRIOR.  Null counts as empty; an empty text has the score of a text without features.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.hashlinear import SAMPLE, Matrix, Model, features, fit_logistic, held_out, sample, sigmoid, tails

THRESHOLD, PRIOR = 0.3, 0.1
#: The seed lexicon.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "vermin", "filth", "hate", "kill")
#: Grown lexicons: (least standard score, least share of toxic rows among those that hold an entry), each dealt into GROUPS.
FOLDS, GROUPS, GROWN = 20, 3, ((5.0, 0.95), (3.5, 0.95), (2.5, 0.95))
PENALTY, ROUNDS = 1e-3, 150
#: Correlations up to this are taken as noise.
NOISE = 0.05
_SEED = "(?:" + "|".join(SEEDS) + ")"
#: Pattern voters: (pattern, least number of places).
PATTERNS = (
    (re.compile(r"[!?]{2,}"), 3),
    (re.compile(r"\b[^\W\d_a-z]{3,}(?: [^\W\d_a-z]{3,}){4}"), 1),
    (re.compile(r"\b\w+[*#@$%]{2,}\w*"), 1),
    (re.compile(r"([^\W\d_])\1{3,}"), 1),
    (re.compile(r"\b(?:[^\W\d_] ){4,}[^\W\d_]\b"), 1),
    (re.compile(rf"\byou(?:r|'re| are)? (?:\w+ ){{0,2}}{_SEED}\b", re.I), 1),
    (re.compile(r"\b(?:kill|hurt|hate)s? (?:you|him|her|them|yourself)\b", re.I), 1),
    (re.compile(rf"\b{_SEED}\b(?:\W+\w+){{0,12}}?\W+{_SEED}\b", re.I), 1),
)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y): documents with a usable label; several labels of an id count as their mean."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("y"))
    known = known.filter(~held_out())
    return docs.select("doc_id", "text").join(known, "doc_id")


def _seed_ids() -> np.ndarray:
    raw = np.frombuffer("".join(SEEDS).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in SEEDS])])
    rows, got = features(raw, offsets, shapes=False)
    first = np.unique(rows, return_index=True)[1]  # whole words come first
    return np.unique(got[first])


def patterns(texts: list[str]) -> np.ndarray:
    """One bit for each pattern that a text shows."""
    out = np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        for k, (pattern, least) in enumerate(PATTERNS):
            places = pattern.finditer(text)
            if all(next(places, None) is not None for _ in range(least)):
                out[n] |= 1 << k
    return out


def votes(x: Matrix, y: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 nothing) of all voters, a column each; the last are the annotators."""
    have = np.bincount(x.cols, minlength=len(x.ids)).astype(float)
    toxic = x.back(y)
    key = x.ids.astype(np.int64) * 2654435761 % (1 << 32)
    seed = np.isin(x.ids, _seed_ids())
    edges = np.arange(FOLDS + 1) * x.n // FOLDS  # rows come in the order of a hash of their texts
    grown = np.zeros((x.n, GROUPS * len(GROWN) + 3), np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        use = slice(*np.searchsorted(x.rows, [a, b]))
        rows, cols = x.rows[use] - a, x.cols[use]
        others = have - np.bincount(cols, minlength=len(have))
        theirs = toxic - np.bincount(cols, y[a:b][rows], minlength=len(have))
        rate = np.clip((y.sum() - y[a:b].sum()) / max(x.n - (b - a), 1), 1e-6, 1 - 1e-6)
        z = (theirs - others * rate) / np.sqrt(others * rate * (1 - rate) + 1e-9)
        pure = theirs / np.maximum(others, 1)
        any_of = lambda mask, rows=rows, cols=cols, n=b - a: np.bincount(rows, mask[cols], minlength=n) > 0
        said = [np.where(any_of(seed & (key >> 31 == g)), 1, 0) for g in (0, 1)]
        said += [np.where(any_of((z >= least) & (pure >= share) & (key * GROUPS >> 32 == g)), 1, 0) for least, share in GROWN for g in range(GROUPS)]
        said.append(np.where(any_of(z <= -3.0) & ~any_of((z >= 3.0) & (pure >= 0.5)), -1, 0))
        grown[a:b] = np.stack(said, axis=1)
    shapes = (marks[:, None] >> np.arange(len(PATTERNS)) & 1).astype(np.int64)
    return np.concatenate([grown, shapes, np.where(y > 0.5, 1, -1)[:, None]], axis=1)


def label_model(v: np.ndarray, prior: float, passes: int = 2, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, P(vote | class) as [voter, class, vote + 1], and the voters' weights.

    Each pass is an expectation maximisation with fixed weights; the first one's are equal.  Correlations are taken at the end
    of a pass only: within rounds, soft posteriors and the correlations that they cause would feed each other.
    """
    n, m = v.shape
    hot = np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)
    spoke = (v != 0).sum(axis=1)
    prior = np.clip(prior, 1e-3, 1 - 1e-3)
    first = np.where(spoke > 0, np.clip((v > 0).sum(axis=1) / np.maximum(spoke, 1), 0.02, 0.98), prior)
    post, chance, weight = first, np.zeros((m, 2, 3)), np.ones(m)
    for n_pass in range(passes):
        post = first
        for _ in range(rounds):
            by = np.stack([1 - post, post], axis=1)
            chance = (np.einsum("nc,nmk->mck", by, hot) + 0.5) / (by.sum(axis=0)[None, :, None] + 1.5)
            said = np.einsum("nmk,mk,m->n", hot, np.log(chance[:, 1]) - np.log(chance[:, 0]), weight)
            post = sigmoid(said + np.log(prior / (1 - prior)))
        if n_pass + 1 < passes:
            by = np.stack([1 - post, post], axis=1)
            expected = chance @ np.array([-1.0, 0.0, 1.0])
            together = np.zeros((m, m))
            for c in (0, 1):
                left = v - expected[:, c]
                together += (left * by[:, c : c + 1]).T @ left
            spread = np.sqrt(np.diag(together)) + 1e-9
            correlation = np.minimum(together / np.outer(spread, spread), 1.0)
            correlation[correlation < NOISE] = 0.0
            np.fill_diagonal(correlation, 0.0)
            weight = 1.0 / (1.0 + correlation.sum(axis=1))
    return post, chance, weight


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Train on about ``most`` labelled rows at most."""
    y, sketches, marks = sample(training_rows(docs, labels), most, patterns)
    x = Matrix(sketches)
    del sketches
    if not x.n:
        return Model(cuts=np.array([np.log((1 - PRIOR) / PRIOR)]))
    post, _, _ = label_model(votes(x, y, marks), y.mean())
    return fit_logistic(x, post, PENALTY, ROUNDS)


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD) of every document, one row for each input row."""
    got = tails(docs, fit(docs, labels, most))
    score = F.col("q_tails")[0]
    return got.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    got = tails(docs, fit(docs, labels, most), keep_text=True)
    return got.filter(F.col("q_tails")[0] < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
