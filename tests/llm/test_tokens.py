"""Token files, packing and token counts against the library, odd rows included."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from fundwatch.llm import packing, token_counts, token_file
from fundwatch.llm.pieces import Pieces
from fundwatch.llm.queries import TOKENIZER
from fundwatch.llm.scratch import new_folder

from .conftest import TEXTS

LIBRARY = Tokenizer.from_file(TOKENIZER)
PIECES = Pieces(TOKENIZER)


def ids_of(text, end=None):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZé1_ '\n\t!,.-×日ßtdrevmls ​\x1c\x85", max_size=40) | st.text(max_size=30))
def test_pieces_equal_the_library(text):
    assert np.frombuffer(PIECES.encode(text), "<u4").tolist() == ids_of(text)


def test_pieces_keep_specials_and_forget():
    small = Pieces(TOKENIZER, limit=2)
    texts = ["a<|endoftext|>b c", "one two three four", "don't we'll 'san", None]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000), st.integers(0, 2999), st.integers(0, 3000))
def test_blocks_round_trip(values, a, b):
    ids = np.array(values, np.uint32)
    row = token_file.encode_blocks(ids) | {"n_ids": len(ids)}
    assert (token_file.decode_blocks(row) == ids).all()
    assert (token_file.read_ids(row, a, max(a, min(b, len(ids)))) == ids[a : max(a, min(b, len(ids)))]).all()


def test_blocks_are_small_and_patched():
    ids = np.random.default_rng(0).integers(0, 200, 50_000).astype(np.uint32)
    ids[::100] = 50_000
    row = token_file.encode_blocks(ids)
    assert len(row["payload"]) < 1.1 * len(ids) and np.frombuffer(row["n_exceptions"], "<u2").sum() == 500
    assert len(row["block_start"]) == -(-len(ids) // token_file.BLOCK) + 1


def test_token_file(spark, odd, monkeypatch):
    folder = new_folder(spark, "tokens")
    token_file.write_tokens(odd, folder, TOKENIZER)
    got = token_file.read_documents(spark, folder).orderBy("start").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in TEXTS for x in [ids_of(t, 2)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_file_of_nothing(spark, none):
    folder = new_folder(spark, "tokens")
    token_file.write_tokens(none, folder, TOKENIZER)
    assert token_file.read_documents(spark, folder).count() == 0


def test_differencing_levels_and_counts_rise():
    sizes = list(range(1, 100))
    windows = packing.differencing(sizes, 9)
    loads = np.bincount(windows, sizes, 9)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 0.01 * loads.mean()
    found, k = packing.deal([6, 6, 6], 10, 2)
    assert k == 3 and np.bincount(found, [6, 6, 6], k).max() <= 10


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_packing_keeps_every_id_once(odd, capacity):
    few = odd if capacity == 1024 else odd.filter("doc_id IS NULL OR doc_id <> 8")
    texts = TEXTS if capacity == 1024 else [x for x in TEXTS if x[0] != 8]
    rows = packing.pack(few, TOKENIZER, capacity).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, list(np.frombuffer(r.ids, "<u4"))))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    for doc in {i for i, _ in texts}:
        want = sorted(x for i, t in texts if i == doc for x in enumerate_ids(ids_of(t, 0)))
        assert sorted((s + k, x) for s, ids in pieces[doc] for k, x in enumerate(ids)) == want


def enumerate_ids(ids):
    return list(enumerate(ids))


def test_packing_pads_little_and_needs_no_rows(odd, none):
    rows = packing.pack(odd.coalesce(1), TOKENIZER, 64).collect()
    loads = Counter()
    for r in rows:
        loads[r.sequence_id] += r.length
    assert sum(loads.values()) / (64 * len(loads)) > 0.94
    assert packing.pack(none, TOKENIZER).count() == 0 and packing.pack(odd.filter("text IS NULL"), TOKENIZER, end_id=None).count() == 0


@pytest.mark.parametrize("head", [0, 5, 10_000])
def test_token_counts(odd, none, head):
    got = Counter(map(tuple, token_counts.token_counts(odd, TOKENIZER, 10, head).collect()))
    assert got == Counter((i, len((t or "").encode()), len(x), len(x) > 10) for i, t in TEXTS for x in [ids_of(t)])
    assert token_counts.token_counts(none, TOKENIZER).count() == 0


def test_token_counts_of_the_other_files(odd):
    import public_tokenizers
    import sentencepiece

    few, rows = odd.filter("doc_id IS NULL OR doc_id <> 8"), [x for x in TEXTS if x[0] != 8]
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, count in (("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False).ids)), ("piece_bpe_32k.model", lambda t: len(model.encode(t)))):
        got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(few, public_tokenizers.path(name)).collect())
        assert got == Counter((i, count(t or "")) for i, t in rows)


def test_memory_of_pieces_is_bounded():
    """Long chunks are not remembered, and the limit counts both memories."""
    small = Pieces(TOKENIZER, limit=50)
    for text in ("x" * 5000, "日本語" * 500, " ".join(f"a{i}b" for i in range(40)), " ".join(f"日本{i}" for i in range(40))):
        assert small.encode(text) == small.whole(text)
    assert max(map(len, [*small.fine, *small.coarse])) <= 64
    small.trim()
    assert not small.fine and not small.coarse
