"""Token counts without ids: each distinct pre-token is counted once, documents sum over theirs.

1. All pre-tokens of the corpus are counted (a partial count per task, then by pre-token).
2. The library counts the pieces of each distinct pre-token, once; the table is written.
3. A document's count is the sum over its distinct pre-tokens of frequency times pieces. The
   ``head`` most frequent pre-tokens (a stated number of at most 64 bytes each, so of bounded
   size) are broadcast and resolved where the document is read; the others, a few per
   document, go through a shuffle join with the table of pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .pieces import pieces
from .scratch import written

#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 500_000


def _cut(encoder, text: str) -> list[str]:
    """Pre-tokens of a text; one with special strings, or of a tokenizer that isn't cut, counts as one."""
    if not text:
        return []
    return encoder.chunks(text)[0] if encoder.chunked and not encoder.special(text) else [text]


def pretoken_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """pretoken, n: frequency of each distinct pre-token over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = pieces(tokenizer), Counter()

        def rows():
            words = iter(sorted(held))
            while some := list(islice(words, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[w] for w in some], pa.int64())], names=["pretoken", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(_cut(encoder, text))
                if len(held) > HELD:
                    yield from rows()
                    held.clear()
        yield from rows()

    return texts.select("text").mapInArrow(run, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, tokenizer: str) -> DataFrame:
    """pretoken, n, pieces: each distinct pre-token counted once by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(tokenizer)
        for batch in batches:
            found = [len(encoder.encode(w)) // 4 for w in batch.column(0).to_pylist()]
            encoder.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["pretoken", "n", "pieces"])

    return pretokens.select("pretoken", "n").mapInArrow(run, "pretoken string, n bigint, pieces bigint")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, head: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes and no tokens. Rows are told apart by their place in
    the input, so a repeated or null doc_id keeps its own row; other columns are ignored.
    """
    spark = docs.sparkSession
    table = written(piece_counts(pretoken_counts(docs, tokenizer), tokenizer), "pieces")
    frequent = table.filter(F.octet_length("pretoken") <= 64).orderBy(F.desc("n"), "pretoken").limit(head).select("pretoken", "pieces")
    known = spark.sparkContext.broadcast(dict(map(tuple, frequent.toArrow().to_pandas().itertuples(index=False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number, pieces_of = pieces(tokenizer), TaskContext.get().partitionId() << 33, 0, known.value
        for batch in batches:
            row, doc, size, word, n, count = [], [], [], [], [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, number = 0, number + 1
                for w, k in Counter(_cut(encoder, text)).items():
                    if (c := pieces_of.get(w)) is None:
                        row.append(part + number), doc.append(None), size.append(None), word.append(w), n.append(k), count.append(None)
                    else:
                        total += c * k
                row.append(part + number), doc.append(one), size.append(len((text or "").encode())), word.append(None), n.append(1), count.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(count, pa.int64())], names=["row", "doc_id", "n_bytes", "pretoken", "n", "pieces"])

    found = written(docs.select("doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, n_bytes bigint, pretoken string, n bigint, pieces bigint"), "frequencies")
    rare = found.filter(F.col("pretoken").isNotNull()).select("row", "pretoken", "n").join(table.select("pretoken", F.col("pieces").alias("each")), "pretoken")
    parts = found.filter(F.col("pretoken").isNull()).select("row", "doc_id", "n_bytes", "pieces").unionByName(rare.select("row", (F.col("n") * F.col("each")).alias("pieces")), allowMissingColumns=True)
    summed = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("pieces").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
