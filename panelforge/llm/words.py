"""Texts as arrays of words, for operators that work on many texts at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np


def blocks(texts: list[bytes | None], limit: int) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """Texts first to last (not included), their words one after the other, and where each text's
    words begin and the last one's end. A block has at most `limit` words, or one text. Words are
    what is between space and U+0009 to U+000D; a null text has none."""
    first, words, ends = 0, [], [0]
    for k, text in enumerate(texts):
        found = text.split() if text else []
        if words and len(words) + len(found) > limit:
            yield first, k, words, np.array(ends)
            first, words, ends = k, [], [0]
        words += found
        ends.append(len(words))
    if len(ends) > 1:
        yield first, len(texts), words, np.array(ends)


def numbered(words: list[bytes], first: int = 0) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, in order of first appearance, and the distinct words."""
    known: defaultdict[bytes, int] = defaultdict(count(first).__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), list(known)


def packed(columns: list[np.ndarray], largest: int) -> list[np.ndarray]:
    """Columns of numbers from 0 to `largest` as few 63-bit keys of the same order."""
    bits = max(1, int(largest).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for at in range(0, len(columns), per):
        key = columns[at].astype(np.int64)
        for column in columns[at + 1 : at + per]:
            key = key << bits | column
        keys.append(key)
    return keys


def ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by keys (first key first), and which rows differ from the one before."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order, new


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches in which the mask holds."""
    edges = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
