"""Byte-pair merging by segment trees, and tables from pre-tokens to token ids.

A segment tree stands over the adjacent pairs of a pre-token. A leaf holds rank * width + position of the pair that begins
there, so the root is the leftmost pair of the lowest rank; a merge updates three leaves and their paths. Short pre-tokens
are merged in lockstep, one tree a row of a matrix; long ones have a tree of their own.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import regex

NONE = np.iinfo(np.int64).max
#: Pre-tokens of more symbols than this get a tree of their own.
WIDEST = 256
#: Symbols in a matrix of trees at most.
CELLS = 1 << 19
#: Pre-tokens that a table keeps before it starts anew; this bounds memory and has no effect on results.
TABLE_CAP = 300_000

_WS = r"\p{White_Space}"
#: The split patterns of the two tokenizers, with the White_Space property written out.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?![^{_WS}])|{_WS}+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+"
#: The letters, numbers and white space of Latin-1: the same patterns for texts that need no others, in the faster engine.
_L1, _N1, _S1 = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_BYTE_PATTERN = rf" ?[{_L1}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N1}]+| ?[^{_S1}{_L1}{_N1}]+|[{_S1}]+(?![^{_S1}])|[{_S1}]+"
LATIN_WORD_PATTERN = rf"[{_L1}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N1}]|[^{_S1}{_L1}{_N1}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Merger:
    """Merges symbol sequences by pair ranks."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.by_pair = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) for the words whose symbols stand one after another."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.ones(len(lengths), np.int64)
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            if w > WIDEST:
                for i in rows.tolist():
                    ids = np.array(self._one(symbols[starts[i] : starts[i + 1]].tolist()), np.int64)
                    counts[i] = len(ids)
                    done.append((np.array([i]), ids))
                continue
            for lo in range(0, len(rows), max(1, CELLS // w)):
                part = rows[lo : lo + max(1, CELLS // w)]
                ids, counts[part] = self._lockstep(symbols, starts[part], lengths[part], w)
                done.append((part, ids))
        places = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for part, ids in done:
            n = counts[part]
            out[np.repeat(places[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _lockstep(self, symbols, starts, lengths, w):
        n, sentinel = len(starts), w
        column = np.arange(w)
        inside = column < lengths[:, None]
        sym = np.full((n, w + 1), -1, np.int64)
        sym[:, :w][inside] = symbols[(starts[:, None] + column)[inside]]
        after = np.broadcast_to(np.arange(1, w + 2), (n, w + 1)).copy()
        after[np.arange(n), lengths - 1] = sentinel
        before = np.broadcast_to(np.arange(-1, w), (n, w + 1)).copy()
        before[:, 0] = sentinel
        tree = np.full((n, 2 * w), NONE, np.int64)
        paired = column[: w - 1] + 1 < lengths[:, None]
        rank = self.rank(sym[:, : w - 1][paired], sym[:, 1:w][paired])
        tree[:, w : 2 * w - 1][paired] = np.where(rank < 0, NONE, rank * w + np.broadcast_to(column[: w - 1], paired.shape)[paired])
        level = w
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        sym, after, before, tree = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
        act = np.flatnonzero(tree[1 :: 2 * w] < NONE)
        while len(act):
            base, root = act * (w + 1), act * (2 * w)
            rank, p = np.divmod(tree[root + 1], w)
            q = after[base + p]
            r, before_p = after[base + q], before[base + p]
            made = self.made[rank]
            sym[base + p], sym[base + q] = made, -1
            after[base + p] = r
            before[base + r] = np.where(r == sentinel, before[base + r], p)
            right, left = r < sentinel, before_p < sentinel
            rank_p = np.where(right, self.rank(made, sym[base + r]), -1)
            rank_l = np.where(left, self.rank(sym[base + before_p], made), -1)
            tree[root + w + q] = NONE
            tree[root + w + p] = np.where(rank_p < 0, NONE, rank_p * w + p)
            has = np.flatnonzero(left)
            tree[root[has] + w + before_p[has]] = np.where(rank_l[has] < 0, NONE, rank_l[has] * w + before_p[has])
            at, top = np.concatenate([q, p, before_p[has]]) + w, np.concatenate([root, root, root[has]])
            while at[0] > 1:
                at >>= 1
                child = top + 2 * at
                tree[top + at] = np.minimum(tree[child], tree[child + 1])
            act = act[tree[root + 1] < NONE]
        sym = sym.reshape(n, w + 1)[:, :w]
        alive = sym >= 0
        return sym[alive], alive.sum(1)

    def _one(self, sym: list[int]) -> list[int]:
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n, find, none = len(sym), self.by_pair.get, int(NONE)
        w = 1 << (n - 1).bit_length()
        tree = [none] * (2 * w)
        for p in range(n - 1):
            rank = find(sym[p] << 20 | sym[p + 1])
            if rank is not None:
                tree[w + p] = rank * w + p
        for i in range(w - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(p, value):
            i = w + p
            tree[i] = value
            while i > 1:
                i >>= 1
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value

        while tree[1] < none:
            rank, p = divmod(tree[1], w)
            q = after[p]
            r, before_p = after[q], before[p]
            sym[p], sym[q], after[p] = int(self.made[rank]), -1, r
            put(q, none)
            if r < n:
                before[r] = p
            rank = find(sym[p] << 20 | sym[r]) if r < n else None
            put(p, none if rank is None else rank * w + p)
            if before_p >= 0:
                rank = find(sym[before_p] << 20 | sym[p])
                put(before_p, none if rank is None else rank * w + before_p)
        return [x for x in sym if x >= 0]


@functools.lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Any code point that this Python's tables don't know; the library's may be of a later date."""
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)]
    edges = [c for c in range(0x110000) if not known[c] and (c == 0 or known[c - 1])], [c for c in range(0x110000) if not known[c] and (c == 0x10FFFF or known[c + 1])]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(*edges, strict=True)) + "]")


class _Index(dict):
    def __init__(self):
        self.fresh = []

    def __missing__(self, word):
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


class Tokenizer:
    """Token ids of whole texts as the library gives them for a byte-level BPE file, without added special tokens."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.lower = spec["normalizer"] is not None
        self.merger = Merger(self.vocab, model["merges"])
        chars = byte_chars()
        self.first = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)
        self.pattern = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        self.latin = re.compile(LATIN_WORD_PATTERN if self.lower else LATIN_BYTE_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.to_byte = {c: b for b, c in enumerate(chars)}
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.flat, self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for content, i in self.special.items():
            self.index[content]
            self._append(np.array([i]), np.array([1]))
        self.index.fresh.clear()

    def _append(self, ids, counts) -> None:
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, ids])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character, as the file of lower-case words asks for."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such a text is in NFC already
        except UnicodeEncodeError:
            if not self.lower:
                return self.pattern.findall(text)
            return self.split_by_library(text) if unassigned().search(text) else self.pattern.findall(self.normal(text))
        return self.latin.findall(text.lower() if self.lower else text)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def split_by_library(self, text: str) -> list[str]:
        """Pre-tokens of a text with letters too new for this Python, by the library's own tables."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.to_byte[c] for c in piece).decode("utf-8") for piece, _ in found]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; strings of special tokens stand alone."""
        if "<|" not in text:
            return self.split(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.split(part)
        return out

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        return self.merger.encode(symbols, lengths)

    def learn(self, words: list[str]) -> None:
        """Ids of words that the table lacks."""
        self._append(*self.merge_words(words))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(table row of every pre-token, number of pre-tokens of each text)."""
        if len(self.index) > TABLE_CAP:
            self.reset()
        found, sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = self.pieces(text)
            sizes[k] = len(words)
            found.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.index.fresh = []
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), sizes

    def count_batch(self, texts: list[str]) -> np.ndarray:
        rows, sizes = self.rows(texts)
        sums = np.concatenate([[0], np.cumsum(self.counts[rows])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text as unsigned 32-bit integers."""
        rows, sizes = self.rows(texts)
        counts = self.counts[rows]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.starts[rows] - sums[:-1], counts) + np.arange(sums[-1])].astype("<u4")
        ends = np.cumsum(sizes)
        return [ids[a:b] for a, b in zip(sums[ends - sizes].tolist(), sums[ends].tolist(), strict=True)]

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; a special token's are its string."""
        out = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in self.vocab.items():
            out[i] = bytes(self.to_byte[c] for c in token if c in self.to_byte)
        for content, i in self.special.items():
            out[i] = content.encode()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 are replaced."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class CountingTokenizer(Tokenizer):
    """Counts tokens with the whole-token shortcut: pre-tokens proved to be one token are counted without a merge."""

    def reset(self) -> None:
        super().reset()
        if not hasattr(self, "whole"):
            self.whole = self.prove()

    def prove(self) -> frozenset[str]:
        """The strings of the vocabulary that encode alone as their own single token, found by merging each of them.

        A vocabulary string is no proof by itself: merges in rank order may never reach it.
        """
        words, ids = [], []
        for token, i in self.vocab.items():
            text = token.removesuffix(self.suffix) if self.suffix else token
            if (text != token) == bool(self.suffix) and text and all(c in self.to_byte for c in text):
                try:
                    words.append(bytes(self.to_byte[c] for c in text).decode("utf-8"))
                    ids.append(i)
                except UnicodeDecodeError:
                    pass
        got, counts = self.merge_words(words)
        firsts = got[np.cumsum(counts) - counts]
        return frozenset(w for w, n, a, b in zip(words, counts.tolist(), firsts.tolist(), ids, strict=True) if n == 1 and a == b)

    def learn(self, words: list[str]) -> None:
        counts = np.ones(len(words), np.int64)
        rest = [k for k, w in enumerate(words) if w not in self.whole]
        if rest:
            counts[rest] = self.merge_words([words[k] for k in rest])[1]
        self.counts = np.concatenate([self.counts, counts])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once in each Python worker."""
    return Tokenizer(path)


@functools.lru_cache(maxsize=2)
def counting_tokenizer(path: str) -> CountingTokenizer:
    return CountingTokenizer(path)
