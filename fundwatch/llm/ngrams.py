"""Hashed byte n-grams of whole texts, in numpy: bucket counts for training, summed table rows for scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ORDERS, BUCKETS = (3, 4), 1 << 15
#: Positions hashed at a time; longer texts are taken in pieces that overlap by an n-gram.
SLICE = 1 << 20
_PAD = b"\0" * (max(ORDERS) - 1)


def _hashed(raw: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    n = len(raw) - max(ORDERS) + 1
    code = raw[:n].astype(np.uint32)
    for i in range(1, order):
        code |= raw[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    code += np.uint32(order)
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def _slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, texts' numbers): runs of texts of about ``SLICE`` bytes; a text stands between spaces, a longer one is cut up."""
    parts, starts, owners, held = [], [], [], 0
    for number, text in enumerate(texts):
        text = b" " + text + b" "
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE + len(_PAD)]
            if len(part) <= len(_PAD) and at:
                break
            parts.append(part + _PAD if at + SLICE + len(_PAD) >= len(text) else part)
            starts.append(held)
            owners.append(number)
            held += len(parts[-1])
            if held >= SLICE:
                yield np.frombuffer(b"".join(parts) + _PAD, np.uint8), np.array(starts), np.array(owners)
                parts, starts, owners, held = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts) + _PAD, np.uint8), np.array(starts), np.array(owners)


def frequencies(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their shares of all its n-grams."""
    counts = np.zeros(BUCKETS, np.int64)
    for raw, _, _ in _slices([text]):
        for order in ORDERS:
            counts += np.bincount(_hashed(raw, order), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, (counts[at] / counts.sum()).astype(np.float32)


def mean_rows(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """For each text the mean of the table's columns (one row a class, one column a bucket) over its n-grams."""
    out, size = np.zeros((len(texts), len(table))), np.zeros(len(texts))
    for raw, starts, owners in _slices(texts):
        buckets = [_hashed(raw, order) for order in ORDERS]
        lengths = np.diff(np.append(starts, len(buckets[0])))
        np.add.at(size, owners, lengths * len(ORDERS))
        for c, row in enumerate(table):
            values = row[buckets[0]]
            for b in buckets[1:]:
                values = values + row[b]
            np.add.at(out[:, c], owners, np.add.reduceat(values, starts, dtype=np.float64))
    return out / np.maximum(size, 1)[:, None]
