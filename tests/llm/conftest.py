import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """The tests' own checkpoint folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


LONG = " ".join(f"word{i % 977} and the {i % 31}" for i in range(60_000))
#: Nulls, empty and blank texts, a very long one, special strings, repeated rows and ids, ties.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, "The quick brown fox jumps over the lazy dog near the river bank today."), (3, None), (4, ""), (5, " \n\t "),
    (6, "a"), (7, "two words"), (8, LONG), (9, "<|endoftext|> inside <|endoftext|>"), (10, "Ünïcödé — 日本語 текст “q” don't\n\n\n  x"), (11, "!!! ### 123 ???"), (12, "line\nline\nline\nline"),
    (None, "no id here"), (None, None), (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (13, "two words"), (-5, "negative id and the text of it"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case and with columns named like those of the operators."""
    rows = [(i, t, "xx" if k % 2 else None, 1.0, "s", k, True, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, source string, fp int, shard boolean, row string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
