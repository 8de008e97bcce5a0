"""Words of many texts at once as hashes, by array operations on code points."""

from __future__ import annotations

import functools
import re

import numpy as np

#: Characters that are turned into arrays at once; longer texts are cut at the next character that is no letter or digit.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE, LETTER, DIGIT, OTHER = range(4)


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its kind, its lower-case letter, and whether it is an upper-case letter."""
    kind, low, upper = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            kind[c], low[c], upper[c] = LETTER, ord(ch.lower()[0]), ch.isupper()
        elif ch.isalnum():
            kind[c] = DIGIT
        elif ch.isspace():
            kind[c] = SPACE
    return kind, low, upper


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_break = re.compile(r"[\W_]")


def chunks(texts: list[str]):
    """(numbers of texts, their parts) of about CHUNK characters; no word is cut."""
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > CHUNK:
                found = _break.search(text, at + CHUNK)
                end = found.start() if found else end
            owners.append(k)
            parts.append(text[at:end])
            size += end - at + 1
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
            if end == len(text):
                break
            at = end
    if parts:
        yield owners, parts


def runs(parts: list[str], merged: bool):
    """(start, length, kind, hash of the lower-case form, number of upper-case letters, part) of each run of one kind of character.

    merged takes letters and digits as one kind.
    """
    kind_of, low_of, upper_of = tables()
    codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = kind_of[codes]
    if merged:
        kind = np.where(kind == DIGIT, LETTER, kind)
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    lengths = np.diff(np.append(starts, len(codes)))
    powers = _powers(1 << int(lengths.max(initial=1) - 1).bit_length() if len(lengths) else 1)
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat((low_of[codes].astype(np.uint64) + np.uint64(1)) * powers[place], starts)
    uppers = np.add.reduceat(upper_of[codes].astype(np.int32), starts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    part = np.searchsorted(ends, starts, side="right")
    return starts, lengths, kind[starts], mix(hashes ^ lengths.astype(np.uint64)), uppers, part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in a row, number of words of each); a word is a run of letters and digits, in lower case."""
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for owners, parts in chunks(texts):
        _, _, kind, hashes, _, part = runs(parts, True)
        word = kind == LETTER
        found.append(hashes[word])
        owner.append(np.array(owners)[part[word]])
    return np.concatenate(found), np.bincount(np.concatenate(owner), minlength=len(texts))
