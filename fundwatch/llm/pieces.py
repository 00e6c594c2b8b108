"""Exact, fast use of a public tokenizer file inside tasks.

Prose repeats its words, so each distinct pre-token goes through the library once per worker.
A text of usual characters is cut into the pre-tokens of the byte-level scheme; a text with
other characters is cut only at white space, where that scheme always ends a pre-token, and
the library cuts the parts further. Either way the ids put together are those of the text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCT = r"!-/:-@\[-`{-~"
_UNUSUAL = re.compile(rf"[^\t-\r -~{_LETTER}]")
_FINE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[{_PUNCT}]+|\s+(?!\S)|\s+")
_COARSE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def _byte_letters() -> dict[int, str]:
    """The byte-level scheme's letter for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


#: Characters of the longest chunk that is remembered: a text without a space is one chunk.
LONG = 64


class _Known(dict):
    """Ids by chunk; an unknown chunk is given to ``encode``, and remembered unless it is long."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= LONG:
            self[chunk] = ids
        return ids


class Pieces:
    """Ids of texts under one tokenizer file (``.json``: tokenizers, ``.model``: sentencepiece), nothing added.

    ``limit`` bounds the chunks that a worker remembers; when it is reached, the memory is emptied.
    A chunk and its ids take about 200 bytes.
    """

    def __init__(self, path: str, limit: int = 300_000):
        self.limit, self.chunked, self.specials = limit, False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: array("I", model.encode(text)).tobytes()
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda text: array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, kind = spec.get("pre_tokenizer") or {}, spec.get("model", {})
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and kind.get("type", "BPE") == "BPE" and not kind.get("ignore_merges")
        if self.chunked:
            added = [re.escape(x["content"]) for x in spec.get("added_tokens") or ()]
            self.specials = re.compile("|".join(added)) if added else None
            model, letters = library.model, str.maketrans(_byte_letters())
            self.fine = _Known(lambda chunk: array("I", [t.id for t in model.tokenize(chunk.encode().decode("latin-1").translate(letters))]).tobytes())
            self.coarse = _Known(self.whole)

    def chunks(self, text: str) -> tuple[list[str], _Known]:
        """Parts whose ids do not depend on each other, and the memory that has or makes their ids."""
        if _UNUSUAL.search(text):
            return _COARSE.split(text), self.coarse
        return _FINE.findall(text), self.fine

    def special(self, text: str) -> bool:
        return bool(self.specials and self.specials.search(text))

    def trim(self) -> None:
        if self.chunked and len(self.fine) + len(self.coarse) > self.limit:
            self.fine.clear()
            self.coarse.clear()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids (null: none)."""
        if not text:
            return b""
        if not self.chunked or self.special(text):
            return self.whole(text)
        parts, known = self.chunks(text)
        return b"".join(map(known.__getitem__, parts))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        self.trim()
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One tokenizer per worker and file."""
    return Pieces(path)


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
