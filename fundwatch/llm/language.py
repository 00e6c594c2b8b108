"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (lower case, letters only).
Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a
sample of about ``PER_LANGUAGE`` labelled rows a language, chosen by a hash of doc_id; a fifth
of it is set aside to fit the temperature that makes the scores probabilities and the score
below which a text is rejected. The average commutes with the softmax's weights, so a trained
model is one table of a number for each bucket and language: scoring is a gather and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .ngrams import BUCKETS, frequencies, mean_rows

PER_LANGUAGE, DIMENSIONS, EPOCHS, RATE, SEED = 500, 16, 6, 0.5, 7
#: Share of the labelled rows of the calibration set that may fall to rejection.
REJECTED = 0.002
UNDETERMINED = "und"
ADDED = ["lang_pred", "lang_score", "lang_rejected"]
_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    return text.lower().encode().translate(_TABLE)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for tests: crc32 of the id as text leaves 1 when divided by 3; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Languages, logits by language and bucket, intercepts, temperature, least accepted score."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax((mean_rows(texts, self.table) + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, per_language: int) -> list[tuple]:
    """(language, buckets, shares) of the training rows: features are made where the texts are, from whole texts."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    draw = (F.xxhash64("doc_id", F.lit(SEED)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < rate[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [frequencies(letters(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<u2").tobytes() for a, _ in made], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in made], pa.binary())], names=["doc_id", "lang", "at", "share"])

    some = rows.filter(draw).limit(2 * per_language * len(counts))
    found = some.mapInArrow(run, "doc_id bigint, lang string, at binary, share binary").collect()
    return [(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4")) for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["lang"], bytes(r["at"]), bytes(r["share"])))]


def fit(rows: list[tuple], languages: list[str], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    check, train = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 50 else (order, order)
    number = {lang: i for i, lang in enumerate(languages)}
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((len(languages), DIMENSIONS), np.float32), np.zeros(len(languages), np.float32)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, at, share = rows[i]
            step, done = rate * (1 - done / steps), done + 1
            hidden = share @ embedding[at]
            gap = softmax(weights @ hidden + bias)
            gap[number[lang]] -= 1
            back = gap @ weights
            weights -= step * np.outer(gap, hidden)
            bias -= 0.1 * step * gap
            embedding[at] -= (20 * step * share)[:, None] * back
    model = Model(languages, (weights @ embedding.T).astype(np.float32), bias)
    if len(rows):
        logits = np.array([model.table[:, rows[i][1]] @ rows[i][2] + bias for i in check])
        truth = np.array([number[rows[i][0]] for i in check])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 200, 60), key=loss))
        model.least = min(0.5, float(np.quantile(softmax(logits / model.temperature).max(axis=1), REJECTED)))
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model of the values of ``lang``, from text and non-null lang of the rows that aren't held out."""
    rows = sample(docs, per_language)
    return fit(rows, sorted({r[0] for r in rows}))


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.languages else []
    lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if known:
        p = model.probabilities([letters(texts[i]) for i in known])
        score[known] = p.max(axis=1)
        rejected[known] = score[known] < model.least
        for i, best in zip(known, p.argmax(axis=1).tolist()):
            lang[i] = model.languages[best]
    return lang, score, rejected


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected; only the text is looked at.

    Text that is null or has no letter: ``und``, score 0, rejected. So is every text of a model
    without languages. A text whose score is below the model's least accepted one is rejected
    but keeps its most likely language. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(*ADDED)
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = judge(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, *ADDED])

    schema = rest.select("*", *(F.lit(x).alias(c) for c, x in zip(ADDED, ("", 0.0, False)))).schema
    return rest.mapInArrow(run, schema)


def accepted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs``, same columns, without the texts that a model trained on them rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~judge(shared.value, batch.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
