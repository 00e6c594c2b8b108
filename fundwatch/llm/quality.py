"""Quality classifier from weak labels.

1. Overlapping heuristic labellers look at every whole text and vote good, bad or nothing.
2. Expectation-maximisation over the counts of all vote patterns estimates, for each labeller,
   how often it is right on good and on bad texts, and the share of good texts. A pattern's
   posterior follows. Patterns are few, so all texts count and only patterns reach the driver.
3. The posteriors of all texts train a hashed linear scorer (logistic, stochastic gradient descent):
   byte n-grams as written, and the labellers' measurements in steps. Every partition learns from all
   its texts, a few hundred at a time; the partitions' weights are averaged by their numbers of texts.
4. The least score kept is set on the scores of all texts, so that hardly any likely good text falls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ngrams import BUCKETS, frequencies, mean_rows
from .scratch import written

#: Texts held at a time; passes over those among a partition's first ``EARLY`` texts (later ones have one); updates until the rate is halved.
CHUNK, EPOCHS, EARLY, RATE, HALF, SEED = 256, 5, 2000, 0.5, 4000, 11
#: Least weight of a text of the larger side (likely good or likely bad), whose weight is the ratio of the smaller side to it.
EVEN = 0.1
#: Share of the likely good texts that may fall below the least score kept, the most that score can be, and its grid.
LOST, CLEAR, GRID = 0.002, 0.4, 1 << 16
ADDED = ["quality_score", "quality_posterior", "quality_keep"]
_SYMBOLS = re.compile(r"[#$%&*@^~=_<>{}\\]{2,}")
_BARE = re.compile(r"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
_LETTERS, _UPPER, _HIGH = (bytes(c for c in range(256) if test(c)) for test in (lambda c: c < 128 and chr(c).isalpha(), lambda c: c < 128 and chr(c).isupper(), lambda c: c >= 128))
_SHOUT = re.compile(r"!{2,}|\?{2,}")
#: Frequent function words of the languages at hand; a parameter of ``measures``.
FUNCTION_WORDS = frozenset("the of and to in is that it for was on are with as at this be by from or der die und den das von zu ist mit le la les de des et un une que est en du dans el los las y que por una con para se del al".split())


def measures(text: str | None, function_words: frozenset = FUNCTION_WORDS) -> list[float | None]:
    """The labellers' measurements of a text; None where a labeller has too little to go by. Characters beyond ASCII count as letters."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [None] * len(LABELLERS)
    raw = text.encode()
    ascii_letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = ascii_letters + len(text) - len(raw.translate(None, _HIGH))
    lower = text.lower().split()
    again = sum(map(eq, lower, islice(lower, 1, None)))
    lines = [x for x in text.split("\n") if x.strip()]
    shown = sum(map(len, words))
    return [
        len(_SYMBOLS.findall(text)) / n,
        len(_SHOUT.findall(text)) / n,
        upper / ascii_letters if ascii_letters >= 8 else None,
        len(_BARE.findall(text)) / n,
        again / (n - 1) if n >= 5 else None,
        len(set(lower)) / n**0.75 if n >= 20 else None,
        1 - len(set(lines)) / len(lines) if len(lines) >= 4 else None,
        letters / n if n >= 5 else None,
        letters / shown,
        sum(map(function_words.__contains__, lower)) / n if n >= 20 else None,
        float(text.rstrip()[-1] in ".!?…\"')]:;") if n >= 5 else None,
    ]


#: (name, measurement at which the text looks good, at which it looks bad); between them no vote.
LABELLERS = [
    ("symbol runs", 0.01, 0.03), ("shouting", 0.01, 0.03), ("capitals", 0.12, 0.3), ("bare symbols", 0.02, 0.06), ("stutter", 0.03, 0.12), ("variety", 0.9, 0.5),
    ("repeated lines", 0.1, 0.35), ("long words", 9.0, 14.0), ("letters", 0.8, 0.65), ("function words", 0.1, 0.02), ("ending", 1.0, -1.0),
]


def votes(found: list[float | None]) -> str:
    """One character a labeller: 1 good, 0 bad, - none."""
    out = []
    for x, (_, good, bad) in zip(found, LABELLERS):
        up = good > bad
        out.append("-" if x is None else "1" if (x >= good if up else x <= good) else "0" if (x <= bad if up else x >= bad) else "-")
    return "".join(out)


def steps(found: list[float | None]) -> list[int]:
    """The scorer's feature of each labeller: its measurement in 16 steps between its bounds, or none."""
    out = []
    for i, (x, (_, good, bad)) in enumerate(zip(found, LABELLERS)):
        out.append(i * STEPS + (STEPS - 1 if x is None else int(min(max((x - good) / (bad - good) * 8 + 4, 0), STEPS - 2))))
    return out


STEPS = 17


def posteriors(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Probability that a text with these votes is good, by expectation-maximisation over the patterns' counts."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    good, bad = (np.array([[c == v for c in p] for p in patterns], float) for v in "10")
    q = np.where(bad.sum(axis=1) > 0, 0.2, 0.9)
    q = np.where(good.sum(axis=1) + bad.sum(axis=1) > 0, q, 0.5)
    for _ in range(rounds):
        share = (weight @ q + 1) / (weight.sum() + 2)
        right_good = (weight * q @ good + 2) / (weight * q @ (good + bad) + 2.5)
        right_bad = (weight * (1 - q) @ bad + 0.5) / (weight * (1 - q) @ (good + bad) + 2.5)
        odds = np.log(share / (1 - share)) + good @ np.log(right_good / (1 - right_bad)) + bad @ np.log((1 - right_good) / right_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done, q = np.abs(new - q).max() < 1e-9, new
        if done:
            break
    return dict(zip(patterns, q.tolist()))


@dataclass
class Model:
    """Weights of the n-gram buckets (a row) and of the measurements' steps, intercept, posteriors by votes, least score kept."""

    table: np.ndarray
    steps: np.ndarray
    bias: float
    posterior: dict[str, float]
    least: float = CLEAR


def _votes_of(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(measures(t)) for t in batch.column(0).to_pylist()], pa.string())], names=["votes"])

    return texts.select("text").mapInArrow(run, "votes string")


class _Learner:
    """Weights of the n-grams, the measurements' steps and the intercept, learnt from texts in turn."""

    def __init__(self, posterior: dict[str, float], weights: list[float]):
        self.posterior, self.weights, self.rng = posterior, weights, np.random.default_rng(SEED)
        self.table, self.step, self.bias = np.zeros(BUCKETS, np.float32), np.zeros(STEPS * len(LABELLERS), np.float32), 0.0
        self.n, self.updates = 0, 0

    def learn(self, texts: list[str]) -> None:
        rows = []
        for text in texts:
            found = measures(text)
            q = self.posterior.get(votes(found), 0.5)
            rows.append((np.array(steps(found)), *frequencies(text.encode()), q, self.weights[q >= 0.5]))
        for _ in range(EPOCHS if self.n < EARLY else 1):
            for i in self.rng.permutation(len(rows)).tolist():
                step, at, share, q, weight = rows[i]
                logit = float(np.clip(self.table[at] @ share + self.step[step].sum() + self.bias, -50, 50))
                move = RATE / (1 + self.updates / HALF) * weight * (1 / (1 + np.exp(-logit)) - q)
                self.table[at] -= 50 * move * share
                self.step[step] -= 0.2 * move
                self.bias -= 0.2 * move
                self.updates += 1
        self.n += len(rows)

    def rows(self) -> pa.RecordBatch:
        """at, value: the weights that are not 0 times the number of texts (n-grams, steps, intercept), and that number last."""
        found = np.concatenate([self.table, self.step, [self.bias, 1.0]]).astype(float) * self.n
        at = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], names=["at", "value"])


def _learnt(posterior: dict[str, float], weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, held = _Learner(posterior, weights), []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                if len(held) == CHUNK:
                    learner.learn(held)
                    held = []
        learner.learn(held)
        yield learner.rows()

    return run


def fit(docs: DataFrame) -> Model:
    """Model for the texts of ``docs`` (text), learnt from all of them, with ``CLEAR`` as the least score kept."""
    texts = docs.filter(F.length("text") > 0)
    counts = {r["votes"]: r["count"] for r in _votes_of(texts).groupBy("votes").count().collect()}
    posterior = posteriors(counts)
    halves = [sum(n for p, n in counts.items() if (posterior[p] >= 0.5) == side) for side in (False, True)]
    weights = [max(EVEN, min(halves) / n) if n else 1.0 for n in halves]
    found = texts.select("text").mapInArrow(_learnt(posterior, weights), "at bigint, value double").groupBy("at").agg(F.sum("value")).collect()
    sums = np.zeros(BUCKETS + STEPS * len(LABELLERS) + 2)
    for at, value in found:
        sums[at] = value
    mean = sums[:-1] / max(sums[-1], 1.0)
    return Model(mean[None, :BUCKETS].astype(np.float32), mean[BUCKETS:-1].astype(np.float32), float(mean[-1]), posterior)


def least_kept(scores: DataFrame) -> float:
    """The largest multiple of 1 / ``GRID``, ``CLEAR`` at most, below which no more than ``LOST`` of the likely good texts fall.

    All rows of ``scores`` (quality_score, quality_posterior) count; only the grid reaches the driver.
    """
    place = F.least(F.floor(F.col("quality_score") * GRID), F.lit(int(CLEAR * GRID))).alias("place")
    counts = dict(map(tuple, scores.filter("quality_posterior >= 0.9").groupBy(place).count().collect()))
    allowed, least = LOST * sum(counts.values()), 1
    for at in range(1, int(CLEAR * GRID) + 1):
        allowed -= counts.get(at - 1, 0)
        if allowed < 0:
            break
        least = at
    return least / GRID


def train(docs: DataFrame) -> Model:
    """Model for the texts of ``docs`` (text), its least score kept set on the scores of them all."""
    model = fit(docs)
    return replace(model, least=least_kept(classify(docs.select("text"), model)))


def judge(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, posterior of the votes, and whether to keep it, of each text."""
    found = [measures(t) for t in texts]
    blank = np.array([not (t and t.strip()) for t in texts], bool)
    q = np.array([model.posterior.get(votes(x), 0.5) for x in found], float)
    logit = mean_rows([(t or "").encode() for t in texts], model.table)[:, 0] + np.array([model.steps[steps(x)].sum() for x in found]) + model.bias
    score = np.where(blank, 0.0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))))
    return score, np.where(blank, 0.0, q), ~blank & (score >= model.least)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score (0 to 1), quality_posterior (of its votes) and quality_keep.

    Null, empty and blank texts have score and posterior 0 and are not kept. Each row is
    judged by its whole text alone; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(*ADDED)
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, judge(shared.value, batch.column(at).to_pylist()))], names=[*batch.schema.names, *ADDED])

    schema = rest.select("*", *(F.lit(x).alias(c) for c, x in zip(ADDED, (0.0, 0.0, False)))).schema
    return rest.mapInArrow(run, schema)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, quality_score, quality_posterior, quality_keep of ``docs`` (doc_id, text) by a model trained on them, each text scored once."""
    scored = written(classify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", *ADDED[:2]), "scores")
    return scored.withColumn(ADDED[2], F.col("quality_score") >= least_kept(scored))


def good_ones(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, without the rows that a model trained on them rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(shared.value, batch.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
