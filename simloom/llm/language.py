"""Language identification by cross-parsing entropy (op4)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm import common

#: Labelled rows that a language's automaton is built of: so many documents, of those whose whole text has at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 24, 4000
#: Letters of one lane; lanes are parsed side by side and then joined, which has no effect on results.
LANE = 1024
#: Free places that are tried for a state of several transitions before the search for the next ones begins further on.
TRIES = 8
UNKNOWN = "und"
#: Scores under this are rejected by the pipeline.
LEAST_SCORE = 0.3


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of every code point, 32 (a blank) for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts in a row, number of each): lower case, with one blank for each run of anything else between letters."""
    joined = "\n".join(texts) + "\n"
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    codes = codes[keep]
    return codes, np.bincount(owner, minlength=len(texts))


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: from state 0, exactly its substrings can be read."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


class CrossParser:
    """Counts the phrases that texts need in terms of each language's sample.

    A phrase is the longest match of what follows in the sample, or one unknown letter. The transitions of all automata stand
    in one table in which rows of states are laid over one another: place base[state] + letter holds a state and its next one,
    and is a transition only if that state is the one asked for. Where there is none, the phrase ends and a new one begins with
    the letter. An unknown letter leads to a state of its language that no letter goes on from.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        folded = {x: fold([samples[x]])[0] for x in self.langs}
        self.alphabet = np.unique(np.concatenate([*folded.values(), np.array([32], np.uint32)]))
        self.width = len(self.alphabet) + 1
        self.first = np.zeros((len(self.langs), self.width), np.int64)
        rows, letters_of, next_of, base, cost = [], [], [], 0, []
        for k, x in enumerate(self.langs):
            text = (np.searchsorted(self.alphabet, folded[x]) + 1).tolist()
            steps = suffix_automaton(text)
            states = np.repeat(np.arange(len(steps)), [len(t) for t in steps])
            letters = np.array([c for t in steps for c in t], np.int64)
            to = np.array([n for t in steps for n in t.values()], np.int64) + base
            self.first[k] = base + len(steps)
            self.first[k, letters[states == 0]] = to[states == 0]
            rows.append(states + base)
            letters_of.append(letters)
            next_of.append(to)
            cost.append(np.log2(max(2, len(text))))
            base += len(steps) + 1
        if base >= 1 << 31:
            raise ValueError("the samples have too many states")
        self.cost = np.array(cost)
        none = np.zeros(0, np.int64)
        self._fill(base, np.concatenate([none, *rows]), np.concatenate([none, *letters_of]), np.concatenate([none, *next_of]))

    def _fill(self, states: int, row: np.ndarray, letter: np.ndarray, to: np.ndarray) -> None:
        """Lay the rows over one another: those of several letters first fit, the largest first, then those of one letter into what is free."""
        degree = np.bincount(row, minlength=states)
        self.base = np.zeros(states, np.int64)
        ends = np.cumsum(degree)
        order = np.argsort(-degree, kind="stable")
        many = order[: int((degree > 1).sum())]
        width, used, start = self.width, bytearray(2 * self.width), self.width
        in_rows = letter[np.argsort(row, kind="stable")].tolist()
        for s, n, end in zip(many.tolist(), degree[many].tolist(), ends[many].tolist(), strict=True):
            mine = in_rows[end - n : end]
            at, first, rest, tried = start - 1, mine[0], mine[1:], 0
            while True:
                at = used.find(0, at + 1)
                if at < 0 or at + width >= len(used):
                    at = len(used) if at < 0 else at
                    used.extend(bytes(len(used) + 2 * width))
                if not any(used[at - first + c] for c in rest):
                    break
                tried += 1
            if tried >= TRIES:
                start = at
            self.base[s] = at - first
            for c in mine:
                used[at - first + c] = 1
        used = used[: used.rfind(1) + 1].ljust(width, b"\0")
        one = order[len(many) : int((degree > 0).sum())]
        free = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0) + width
        free = np.concatenate([free, len(used) + np.arange(max(0, len(one) - len(free)))])[: len(one)]
        single = np.zeros(states, np.int64)
        single[row] = letter
        self.base[one] = free - single[one]
        self.table = np.full(max(len(used), int(free.max(initial=0)) + 1) + width, -1, np.int64)
        self.table[self.base[row] + letter] = row << 32 | to

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next state of each, or -1 where the match does not go on."""
        found = self.table[self.base[states] + letters]
        return np.where(found >> 32 == states, found & 0xFFFFFFFF, -1)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.int32)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Languages x texts: the number of phrases of each whole text.

        Texts are cut into lanes, which are parsed side by side as if a phrase began with each, and then joined (see _join).
        """
        langs = len(self.langs)
        out = np.zeros((langs, len(sizes)), np.int64)
        if not len(codes) or not langs:
            return out
        symbols = self.symbols(codes)
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin, length = starts[owner] + number * LANE, np.minimum(LANE, sizes[owner] - number * LANE)
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(int(length.max())), side="left")  # lanes longer than t
        at = begin[order]
        state = self.first[:, symbols[at]]
        count = np.ones(state.shape, np.int64)
        for t in range(1, len(active)):
            a = int(active[t])
            letters = symbols[at[:a] + t]
            nxt = self.step(state[:, :a], letters)
            ended = nxt < 0
            count[:, :a] += ended
            state[:, :a] = np.where(ended, self.first[:, letters], nxt)
        ends, counts = np.empty_like(state), np.empty_like(count)
        ends[:, order], counts[:, order] = state, count
        if (number > 0).any():
            self._join(symbols, begin, length, number > 0, ends, counts)
        for k in range(langs):
            out[k] = np.bincount(owner, counts[k], minlength=len(sizes)).astype(np.int64)
        return out

    def _join(self, symbols, begin, length, later, ends, counts) -> None:
        """Correct the counts of lanes that go on from the lane before them.

        Such a lane is parsed again from the last state of the lane before it, together with the parse that began with it,
        until both are in one state, from where on they agree. Where they differ to the end, the next lane is corrected again;
        lanes of a text that never agree are so parsed one after the other.
        """
        langs = np.repeat(np.arange(len(ends)), len(begin))
        lane = np.tile(np.arange(len(begin)), len(ends))
        todo = np.tile(later, len(ends))
        langs, lane = langs[todo], lane[todo]
        fresh_ends, fresh_counts = ends.copy(), counts.copy()
        last = np.append(~later[1:], True)  # lanes that end their text
        while len(lane):
            before = ends[langs, lane - 1].copy()
            end, extra = fresh_ends[langs, lane].copy(), np.zeros(len(lane), np.int64)
            going, true, guess = np.arange(len(lane)), before, np.full(len(lane), -1, np.int64)
            for t in range(int(length[lane].max())):
                inside = length[lane[going]] > t
                end[going[~inside]] = true[~inside]
                going, true, guess = going[inside], true[inside], guess[inside]
                letters, k = symbols[begin[lane[going]] + t], langs[going]
                anew = self.first[k, letters]
                nxt = self.step(true, letters)
                extra[going] += nxt < 0
                true = np.where(nxt < 0, anew, nxt)
                if t:
                    nxt = self.step(guess, letters)
                    extra[going] -= nxt < 0
                    guess = np.where(nxt < 0, anew, nxt)
                else:
                    extra[going] -= 1
                    guess = anew
                apart = true != guess
                going, true, guess = going[apart], true[apart], guess[apart]
                if not len(going):
                    break
            end[going] = true
            counts[langs, lane] = fresh_counts[langs, lane] + extra
            moved = (end != ends[langs, lane]) & ~last[lane]
            ends[langs, lane] = end
            langs, lane = langs[moved], lane[moved] + 1

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text.

        The cost of a language is its phrases times log2 of its sample's length, a letter; the lowest wins, ties to the first
        by name. The score is the share of letters that the samples know, times a half for any winner and up to a half more for
        its margin over the mean of the others (without others, over one phrase a letter).
        """
        codes, sizes = fold(texts)
        some = np.zeros(len(texts), bool)
        owner = np.repeat(np.arange(len(texts)), sizes)
        some[owner[codes != 32]] = True
        n = np.maximum(sizes, 1)
        cost = self.phrases(codes, sizes) * self.cost[:, None] / n
        best = cost.argmin(0) if len(self.langs) else np.zeros(len(texts), np.int64)
        low = cost.min(0)
        others = (cost.sum(0) - low) / max(1, len(self.langs) - 1) if len(self.langs) > 1 else np.broadcast_to(self.cost.max(), low.shape)
        known = np.bincount(owner, self.symbols(codes) > 0, minlength=len(texts)) / n
        score = np.clip(known * (0.5 + 0.5 * (1 - low / np.maximum(others, 1e-9))), 0, 1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


_parsers: dict[str, CrossParser] = {}


def parser(samples: dict[str, str]) -> CrossParser:
    """The automata of these samples, once in each Python worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "replace")).hexdigest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def learn_samples(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """A bounded sample of labelled rows: of each language the whole texts of docs_per_lang rows by a hash of id and text.

    Rows with letters and of at most chars characters count; a language without one has its shortest row. The rows are
    chosen by their hashes first, so that no text is moved for those not chosen.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text", F.lit("sample")))
    short = F.greatest(F.char_length("text"), F.lit(chars))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h"))
    ids = rows.select("lang", "h", short.alias("size")).distinct().withColumn("r", first).filter(F.col("r") <= docs_per_lang)
    chosen = {(r.lang, r.h) for r in ids.collect() if r["size"] <= chars or r.r == 1}
    texts = rows.filter(F.col("h").isin([h for _, h in chosen])).select("lang", "h", "text").distinct()
    found: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.h, r.text)):
        if (r.lang, r.h) in chosen:
            found.setdefault(r.lang, []).append(r.text)
    return {x: "\n".join(texts) for x, texts in found.items()}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, and so are all if there are no samples. Repeated rows and
    null ids stay; no other column is read; an empty table gives an empty one.
    """

    def run(batches):
        for part, texts in common.text_slices(batches):
            if samples:
                langs, score = parser(samples).predict(texts)
            else:
                langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
