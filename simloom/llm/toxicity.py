"""Toxicity (op2): noisy-channel restoration of disguised words, then a score of the restored text."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import common, neardup

#: Symbols of the language model: 0 a break, 1 to 26 the letters without marks, 27 any other letter.
SYMBOLS, OTHER = 28, 27
#: What a sign may stand for. A star may stand for a vowel or for nothing.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou",
}
SIGNS = "".join(LEET)
#: Costs of the channel, in natural logarithms.
SWAP, STAR, DROP, BREAK, ONCE, TWICE, FEWER = 1.0, 2.0, 1.0, 4.0, 0.7, 1.2, 4.5
#: Labelled documents that the lexicon is learned on at most, about; toxic documents that a feature needs, and least evidence.
TRAIN_DOCS, LEAST_DOCS, LEAST_EVIDENCE = 20_000, 3, 0.3
PREFIXES = (4, 5, 6)
#: Shrinkage that is tried, on inner folds of the learned rows; there, a clean document flagged counts as so many toxic ones missed.
SHRINKAGE, FOLDS, CLEAN_COST = (10.0, 3.0, 1.0, 0.3, 0.1), 4, 4
STEPS = 300
#: Tokens whose restoration a worker remembers before it starts anew; this has no effect on results.
MEMO_CAP = 400_000

_token = re.compile(rf"[\w{re.escape(SIGNS)}.\-]+")
_edge = re.compile(r"^[^\w@$!|+(€*]+|[^\w]+$")
_edge_but_signs = re.compile(rf"^[^\w@$!|+(€*]+|[^\w{re.escape(SIGNS)}]+$")
_run = re.compile(r"([^\W\d_])\1")
_single = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){2,}(?!\S)")
#: As _single, but beside other signs too, unless these join a letter to a word.
_single_beside = re.compile(r"(?<!\w)(?<!\w['’.,\-])\S(?:[ \t]{1,3}\S){2,}(?!\w)(?!['’.,\-]\w)")
_dotted = re.compile(r"^[^\W_](?:[.\-_*][^\W_]){2,}$")
_disguised = re.compile(rf"[^\W\d_][{re.escape(SIGNS)}]|[{re.escape(SIGNS)}][^\W\d_]")
_signs_alone = re.compile(r"^[@$!|+(€]*([@$!|+(€])(?!\1)[@$!|+(€]+$")
_hidden = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = symbol(ch)
    return out


@functools.lru_cache(maxsize=4096)
def symbol(ch: str) -> int:
    if not ch.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", ch.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else OTHER


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of symbol trigrams within each text, runs of breaks taken as one, with two breaks before it and one after."""
    table = symbol_table()
    total = np.zeros(SYMBOLS**3, np.int64)
    tail, before = np.zeros(0, np.int32), 0
    for text in texts:
        joined = "\0\0" + text + "\n"
        for at in range(0, len(joined), 1 << 18):
            s = table[np.frombuffer(joined[at : at + (1 << 18)].encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
            keep = (s != 0) | (np.concatenate([[before], s[:-1]]) != 0)
            if not at:
                keep[:2] = True
            before = s[-1]
            s = np.concatenate([tail, s[keep]])
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else 0
            tail = s[-2:]
    total.reshape((SYMBOLS,) * 3)[:, 0, 0] = 0  # these lie between texts
    return total


class CharModel:
    """A trigram model over symbols, with bigrams and single symbols mixed in."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape((SYMBOLS,) * 3).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + SYMBOLS)
        p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
        p3 = (tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8)
        self.cost = (-np.log(p3)).ravel().tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings that it may stand for, with the channel's costs; a blank is a break."""
    out, at = [], 0
    while at < len(token):
        ch = token[at]
        n = 1
        while at + n < len(token) and token[at + n] == ch:
            n += 1
        at += n
        if ch.isalpha():
            out.append([(ch, 0.0)] if n == 1 else [(ch * 2, 0.0), (ch, FEWER)] if n == 2 else [(ch, ONCE), (ch * 2, TWICE)])
        elif ch in "*#":
            out.append([(x, STAR) for x in LEET[ch]] + [("", STAR), (" ", STAR)])
        elif ch in LEET:
            out.append([(x * k, SWAP * n) for x in LEET[ch] for k in {1, min(n, 2)}] + [(" ", BREAK)])
        elif ch in " \t":
            out.append([("", DROP / 2), (" ", DROP)])
        else:
            out.append([("", DROP), (" ", DROP)])
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a disguised token: Viterbi over its lattice, states being the last two symbols.

    A state holds its cost and a link to the piece and the state that it came from; of equal costs the first found stays.
    """
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    cost = model.cost
    for choices in [*lattice(token), [(" ", 0.0)]]:
        ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, back) in paths.items():
            for piece, extra in choices:
                x, y, total = a, b, so_far + extra
                for ch in piece:
                    c = 0 if ch == " " else symbol(ch)
                    if c or y:
                        total += cost[(x * SYMBOLS + y) * SYMBOLS + c]
                        x, y = y, c
                best = ahead.get((x, y))
                if best is None or total < best[0]:
                    ahead[x, y] = (total, (back, piece))
        paths = ahead
    link, pieces = min(paths.values(), key=lambda found: found[0])[1], []
    while link:
        link, piece = link
        pieces.append(piece)
    return "".join(reversed(pieces)).strip()


class Restorer:
    """The restored words of texts; what it has seen, it remembers up to MEMO_CAP tokens."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, {}

    def words_of(self, token: str) -> tuple[str, ...]:
        """The words that one token without blanks stands for."""
        if not token.isascii():
            token = unicodedata.normalize("NFKC", token).translate(_hidden)
        token = token.lower()
        core = token.strip(".,;:?\"'")
        if core.isalpha() and not _run.search(core):
            return (core,)
        out = []
        for part in _token.findall(token):
            core = _edge.sub("", part)
            for form in dict.fromkeys((core, _edge_but_signs.sub("", part))):
                if _dotted.match(form) or _run.search(form) or _disguised.search(form) or _signs_alone.match(form):
                    out += [w for w in restore(form, self.model).split() if w.isalpha() or len(w) > 1]
            out += [w for w in re.split(r"[\W\d_]+", core) if w]
        return tuple(dict.fromkeys(out))

    def spaced(self, text: str) -> list[str]:
        """The words that are spelled out with blanks between letters."""
        out = []
        for found in dict.fromkeys(_single.findall(text) + _single_beside.findall(text)):
            plain = unicodedata.normalize("NFKC", found).translate(_hidden).lower()
            if sum(c.isalpha() or c in LEET for c in plain) > 2:
                out += restore(plain, self.model).split()
        return out

    def words(self, text: str) -> set[str]:
        if len(self.memo) > MEMO_CAP:
            self.memo.clear()
        out: set[str] = set()
        memo = self.memo
        for token in set(text.split()):
            got = memo.get(token)
            if got is None:
                got = memo[token] = self.words_of(token)
            out.update(got)
        out.update(self.spaced(text))
        return out


def features(word: str) -> list[str]:
    """A word as a whole and its beginnings, which stand for a family of words."""
    return [word + "$"] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]


class Lexicon:
    """Features that speak for a toxic document, each with a weight; a score is the logistic of their sum and a bias."""

    def __init__(self, weights: dict[str, float], bias: float = -5.0):
        self.weights, self.bias = weights, bias

    def hits(self, word: str) -> tuple[tuple[str, float], ...]:
        """The features of a word that have a weight."""
        return tuple((f, self.weights[f]) for f in features(word) if f in self.weights)

    def joined(self, found: dict[str, float]) -> float:
        """The score of a text with these features, each counted once."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + math.fsum(found.values())))))

    def score(self, words) -> float:
        return self.joined(dict(hit for w in words for hit in self.hits(w)))


def chance(k_toxic: float, k_clean: float, n_toxic: int, n_clean: int) -> float:
    """The chance that a document with a feature is toxic: a low estimate of the feature's rate among toxic documents against its rate among clean ones."""
    share = n_toxic / max(1, n_toxic + n_clean)
    rate = max(0.0, k_toxic - 1.5 * math.sqrt(k_toxic)) / max(1, n_toxic)
    ratio = rate / ((k_clean + 0.5) / max(1, n_clean))
    return share * ratio / (share * ratio + 1 - share)


class Sample:
    """Documents as sets of features: equal sets of one label and fold are one row with a count."""

    def __init__(self, rows: list[tuple[int, int, tuple[str, ...], int]]):
        """rows: (label, fold, features, number of documents)."""
        self.names = sorted({f for _, _, bag, _ in rows for f in bag})
        at = {f: k for k, f in enumerate(self.names)}
        self.label, self.fold, self.n = (np.array([r[k] for r in rows], np.float64) for k in (0, 1, 3))
        self.row = np.repeat(np.arange(len(rows)), [len(bag) for _, _, bag, _ in rows])
        self.column = np.array([at[f] for _, _, bag, _ in rows for f in bag], np.int64)

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.label))

    def fit(self, counted: np.ndarray, shrinkage: float) -> tuple[np.ndarray, float]:
        """Weights that are never negative and a bias: logistic regression on the rows that count, by accelerated projected steps."""
        n = self.n * counted
        share = (n * self.label).sum() / max(1.0, n.sum())
        w, b = np.zeros(len(self.names)), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not 0 < share < 1:
            return w, b
        v, top = np.ones(len(self.names) + 1), 1.0
        for _ in range(20):  # the largest eigenvalue of the curvature's bound
            r = n * (self.sums(v[:-1]) + v[-1])
            v = np.append(np.bincount(self.column, r[self.row], len(self.names)), r.sum())
            top = np.linalg.norm(v)
            v /= max(top, 1e-12)
        rate = 1 / (0.3 * top + shrinkage)
        z, zb, t = w, b, 1.0
        for _ in range(STEPS):
            error = n * (1 / (1 + np.exp(-np.clip(self.sums(z) + zb, -30, 30))) - self.label)
            ahead = np.maximum(0, z - rate * (np.bincount(self.column, error[self.row], len(self.names)) + shrinkage * z))
            ahead_b, nxt = zb - rate * error.sum(), (1 + math.sqrt(1 + 4 * t * t)) / 2
            z, zb = ahead + (t - 1) / nxt * (ahead - w), ahead_b + (t - 1) / nxt * (ahead_b - b)
            w, b, t = ahead, ahead_b, nxt
        return w, b

    def learn(self) -> Lexicon:
        """The lexicon whose shrinkage does best on inner folds, each scored by what the others taught; ties to more shrinkage."""

        def loss(shrinkage: float) -> float:
            wrong = 0.0
            for fold in range(FOLDS):
                apart = self.fold == fold
                w, b = self.fit(~apart, shrinkage)
                toxic = self.sums(w) + b >= 0
                wrong += (self.n * apart * (toxic != self.label) * np.where(toxic, CLEAN_COST, 1)).sum()
            return wrong

        best = min(SHRINKAGE, key=loss) if len(self.names) else SHRINKAGE[0]
        w, b = self.fit(np.ones(len(self.label)), best)
        return Lexicon({f: x for f, x in zip(self.names, w.tolist(), strict=True) if x > 0}, min(b, -0.1))


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CharModel:
    """The character model of all whole texts: each task adds up its own table, the sums meet by trigram."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for _, texts in common.text_slices(batches):
            total += trigram_counts(texts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["trigram", "n"])

    sums = common.id_text(docs, id_col, text_col).mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for row in sums.collect():
        counts[row.trigram] = row.n
    return CharModel(counts)


def learn_lexicon(sample: DataFrame, model: CharModel) -> Lexicon:
    """The lexicon from a bounded labelled sample (doc_id, text, label).

    Copies would let chance words look telling, so of documents with the same four least word 5-gram hashes one counts. First
    the toxic documents' features are counted, then those of clean documents that can matter; features that tell the two
    apart are weighed together. Everything here is of the sample's size.
    """
    sample, context = common.cut(sample), sample.sparkSession.sparkContext

    def mark(label: int, wanted):
        def run(batches):
            restorer = Restorer(model)
            for part, texts in common.text_slices(batches):
                prints, bags = [], []
                mine = [t for y, t in zip(part.column(2).to_pylist(), texts, strict=True) if y == label]
                for text, grams in zip(mine, neardup.gram_sets(mine), strict=True):
                    prints.append(",".join(map(str, grams[:4].tolist())))
                    found = {f for w in restorer.words(text) for f in features(w)}
                    bags.append(sorted(found if wanted is None else found & wanted.value))
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.string()), pa.array(bags, pa.list_(pa.string()))], ["print", "bag"])

        return common.cut(sample.mapInArrow(run, "print string, bag array<string>").groupBy("print").agg(F.min("bag").alias("bag")))

    tally = lambda bags: Counter({r.f: r.n for r in bags.select(F.explode("bag").alias("f")).groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()})
    toxic, least = mark(1, None), LEAST_DOCS
    n_toxic, seen = toxic.count(), tally(toxic)
    clean, least = mark(0, context.broadcast(frozenset(seen))), 1
    n_clean, among = clean.count(), tally(clean)
    telling = context.broadcast(frozenset(f for f, k in seen.items() if chance(k, among[f], n_toxic, n_clean) >= LEAST_EVIDENCE))

    def reduce(batches):
        for batch in batches:
            bags = [[f for f in bag if f in telling.value] for bag in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.string()))], ["label", "fold", "bag"])

    fold = F.pmod(F.xxhash64("print", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    both = toxic.select(F.lit(1).alias("label"), fold, "bag").unionByName(clean.select(F.lit(0).alias("label"), fold, "bag"))
    rows = both.mapInArrow(reduce, "label int, fold int, bag array<string>").groupBy("label", "fold", "bag").agg(F.count("*").alias("n"))
    return Sample(sorted((r.label, r.fold, tuple(r.bag), r.n) for r in rows.collect())).learn()


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(character model of all texts, lexicon of about limit labelled documents that learn allows)."""
    model = language_model(docs, id_col, text_col)
    return model, learn_lexicon(common.labelled_sample(docs, labels, label_col, learn, limit, id_col, text_col), model)


def score_toxicity(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text", with_words: bool = False) -> DataFrame:
    """The toxicity of every whole text: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    with_words adds the restored words of each text. Null and empty texts have no words and get the lowest score, and so do
    all if no label was learned from. Repeated rows and null ids stay; no other column is read; an empty table gives an
    empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        model, lexicon = sent.value
        restorer = Restorer(model)
        hits: dict[str, tuple] = {}
        for part, texts in common.text_slices(batches):
            if len(hits) > MEMO_CAP:
                hits.clear()
            scores, kept = [], []
            for text in texts:
                if with_words:
                    words = restorer.words(text)
                    kept.append(sorted(words))
                    scores.append(lexicon.score(words))
                    continue
                found: dict[str, float] = {}
                for token in set(text.split()):
                    got = hits.get(token)
                    if got is None:
                        got = hits[token] = tuple(h for w in restorer.words_of(token) for h in lexicon.hits(w))
                    if got:
                        found.update(got)
                for w in restorer.spaced(text):
                    found.update(lexicon.hits(w))
                scores.append(lexicon.joined(found))
            columns = [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.string()))] * with_words, ["doc_id", "score", "predicted"] + ["words"] * with_words)

    schema = "doc_id long, score double, predicted int" + ", words array<string>" * with_words
    return common.id_text(docs, id_col, text_col).mapInArrow(run, schema)
