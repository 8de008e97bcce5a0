"""Quality classifier (op6): random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import common, words

#: Words that have a vector of their own, the most frequent of all texts; buckets that the other words share by a hash.
VOCABULARY, SHARED = 1 << 16, 1 << 13
#: Dimensions of a word vector, and non-zero places of an index vector.
DIMS, PLACES = 32, 4
#: Vectors kept for the forms of tokens: words in capitals, of mixed case, said again at once, and digits by length.
FORMS = 16
#: Word hashes that a task gathers before it adds them up.
GATHERED = 1 << 20
#: Neighbouring tokens that are added to a matrix together, and tasks for each core that add up a matrix at most.
NEAR, MATRICES = 1 << 14, 8
#: Words that the driver turns into vectors together.
AT_ONCE = 4096
#: Labelled documents that the network is fitted on at most, about.
TRAIN_DOCS = 6000
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-4
#: Documents of a lower score are rejected.
LEAST_SCORE = 0.5
#: Tokens of an average text that every text is mixed with, so that very short ones say little: what is tried on an inner part.
PRIOR_TOKENS = (16, 8, 4, 2)


def index_vectors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the sparse ternary index vectors of n words, from a hash of their numbers."""
    h = words.mix(np.arange(n * PLACES, dtype=np.uint64) + np.uint64(0x1234567))
    return (h % np.uint64(DIMS)).astype(np.int64).reshape(n, PLACES), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0).reshape(n, PLACES)


def rows_of(vocabulary: np.ndarray) -> int:
    """Vectors of a model with these words."""
    return FORMS + SHARED + len(vocabulary)


def chunk_runs(texts: list[str]):
    """(lengths, kinds, hashes, numbers of capitals, parts, texts of parts) of the tokens, chunk by chunk, blanks left out."""
    for owners, parts in words.chunks(texts):
        _, lengths, kind, hashes, uppers, part = words.runs(parts, False)
        keep = kind != words.SPACE
        yield lengths[keep], kind[keep], hashes[keep], uppers[keep], part[keep], np.array(owners)


def vocabulary(docs: DataFrame, size: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the most frequent words of all texts, at most size: all that occur as often as some least number.

    Each task counts its own words; sums meet by word; a table of how many words occur how often gives the least number.
    """

    def run(batches):
        held, n, size_held = [], [], 0

        def add_up():
            found, at = np.unique(np.concatenate(held), return_inverse=True)
            return [found], [np.bincount(at, np.concatenate(n)).astype(np.int64)]

        for _, texts in common.text_slices(batches):
            for _, kind, hashes, _, _, _ in chunk_runs(texts):
                found, counts = np.unique(hashes[kind != words.DIGIT], return_counts=True)
                held.append(found)
                n.append(counts)
                size_held += len(found)
            if size_held > GATHERED:
                held, n = add_up()
                size_held = 0
        if held:
            held, n = add_up()
            for lo in range(0, len(held[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(held[0][lo : lo + (1 << 16)].view(np.int64)), pa.array(n[0][lo : lo + (1 << 16)])], ["word", "n"])

    counts = common.id_text(docs, id_col, text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.cut(counts)
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    least, total = None, 0
    for r in sorted(counts.groupBy(level).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r.level):
        total += r.k
        if total > size:
            break
        least = r.n
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.filter(F.col("n") >= least).select("word").toArrow().column("word").to_numpy().view(np.uint64))


def token_buckets(texts: list[str], vocabulary: np.ndarray):
    """(numbers of token vectors, text of each), chunk by chunk: words, runs of other signs, and tokens for forms."""
    for lengths, kind, hashes, uppers, part, owners in chunk_runs(texts):
        bucket = FORMS + (hashes % np.uint64(SHARED)).astype(np.int64)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            bucket = np.where(vocabulary[at] == hashes, FORMS + SHARED + at, bucket)
        bucket = np.where(kind == words.DIGIT, 4 + np.minimum(lengths, 11), bucket)
        letter = kind == words.LETTER
        capitals = letter & (uppers == lengths) & (lengths > 1)
        mixed = letter & (uppers > 1) & ~capitals
        form = np.where(capitals, 0, np.where(mixed, 1, -1))
        again = np.zeros(len(bucket), bool)
        for back in (1, 2):
            again[back:] |= letter[back:] & (bucket[back:] == bucket[:-back]) & (part[back:] == part[:-back])
        n = 1 + (form >= 0) + again
        at = np.cumsum(n) - 1
        out = np.full(int(n.sum()), 2, np.int64)
        out[at] = bucket
        out[at[form >= 0] - 1] = form[form >= 0]
        yield out, np.repeat(owners[part], n)


def context_counts(texts: list[str], vocabulary: np.ndarray, places, signs) -> np.ndarray:
    """Words x dims: for each the sum of the index vectors of its neighbours on both sides."""
    total = np.zeros((rows_of(vocabulary), DIMS))
    add_context(total, texts, vocabulary, places, signs)
    return total


def add_context(total: np.ndarray, texts: list[str], vocabulary: np.ndarray, places, signs) -> None:
    """Add the context counts of texts in place, some tokens at a time: no second matrix, no list of all of a slice's places."""
    flat = total.reshape(-1)
    for bucket, owner in token_buckets(texts, vocabulary):
        near = np.flatnonzero(owner[1:] == owner[:-1])
        for lo in range(0, len(near), NEAR):
            left, right = bucket[near[lo : lo + NEAR]], bucket[near[lo : lo + NEAR] + 1]
            for a, b in ((left, right), (right, left)):
                np.add.at(flat, (a[:, None] * DIMS + places[b]).ravel(), signs[b].ravel())


def context_rows(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, v): of each task and word the sum of its contexts.

    Each task adds up its own matrix of fixed size, and small partitions are read together, so that the number of matrices has a
    bound.
    """

    def run(batches):
        places, signs = index_vectors(rows_of(vocabulary))
        total = np.zeros((rows_of(vocabulary), DIMS))
        for _, texts in common.text_slices(batches):
            add_context(total, texts, vocabulary, places, signs)
        used = np.flatnonzero(total.any(1))
        for lo in range(0, len(used), 4096):
            mine = used[lo : lo + 4096]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * DIMS, pa.int32()), pa.array(total[mine].astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), rows], ["bucket", "v"])

    texts = common.id_text(docs, id_col, text_col)
    return texts.coalesce(MATRICES * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "bucket int, v array<long>")


def word_vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors of all words from all documents: index vector plus centred context of unit length.

    The sums of all tasks meet by word, and come to the driver compressed, a batch a row.
    """
    sums = context_rows(docs, vocabulary, id_col, text_col).groupBy("bucket").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIMS)])

    def pack(batches):
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(rows.tobytes(), 1)], pa.binary())], ["packed"])

    context = np.zeros((rows_of(vocabulary), DIMS))
    for r in sums.mapInArrow(pack, "packed binary").collect():
        rows = np.frombuffer(zlib.decompress(r.packed), "<i8").reshape(-1, 1 + DIMS)
        context[rows[:, 0]] = rows[:, 1:]
    return vectors_from(context)


def vectors_from(context: np.ndarray) -> np.ndarray:
    """The word vectors of these contexts, some rows at a time: beside context and the result, no matrix is made."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    parts = [slice(lo, lo + AT_ONCE) for lo in range(0, len(context), AT_ONCE)]
    total, seen = np.zeros((1, context.shape[1])), 0
    for part in parts:
        total = np.concatenate([total, unit(context[part])]).sum(0, keepdims=True)  # row after row, as one sum over all
        seen += int(context[part].any(1).sum())
    places, signs = index_vectors(len(context))
    out = np.empty(context.shape, np.float32)
    for part in parts:
        mine = context[part]
        own = np.zeros(mine.shape)
        np.add.at(own, (np.arange(len(own))[:, None], places[part]), signs[part])
        out[part] = unit(own) + unit(np.where(mine.any(1, keepdims=True), unit(mine) - total / max(1, seen), 0.0))
    return out


def pool(texts: list[str], vectors: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Texts x (dims + 1): the mean vector of a text's tokens, and the logarithm of their number."""
    n = np.zeros(len(texts))
    total = np.zeros((len(texts), DIMS))
    for bucket, owner in token_buckets(texts, vocabulary):
        if not len(bucket):
            continue
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[owner[first]] += np.add.reduceat(vectors[bucket], first, axis=0)
        n += np.bincount(owner, minlength=len(texts))
    return np.concatenate([total / np.maximum(n, 1)[:, None], np.log1p(n)[:, None] / 10], 1)


class Network:
    """Two layers (tanh, then a logit) fitted by Adam.

    Of the rows, one fifth chooses how many average tokens are mixed in (by the loss of networks fitted without it), and
    another fifth, never fitted on, sets the temperature.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        n = np.expm1(10 * x[:, -1:])
        self.average = (x[:, :-1] * n).sum(0) / max(1.0, n.sum())
        self.temperature, self.prior = 1.0, PRIOR_TOKENS[0]
        fifth = np.arange(len(y)) % 5 if len(y) >= 50 else np.zeros(len(y), np.int64)
        inner, apart = fifth == 3, fifth == 4
        if inner.any():
            losses = []
            for prior in PRIOR_TOKENS:
                self.prior = prior
                self._fit(x[fifth < 3], y[fifth < 3], seed)
                losses.append(np.logaddexp(0, -self.logits(x[inner]) * (2 * y[inner] - 1)).mean())
            self.prior = PRIOR_TOKENS[int(np.argmin(losses))]
        self._fit(x[~apart], y[~apart], seed)
        if apart.any():
            logits, truth = self.logits(x[apart]), y[apart]
            loss = lambda t: np.logaddexp(0, -logits / t * (2 * truth - 1)).mean()
            self.temperature = float(min(np.geomspace(0.25, 16, 49), key=loss))

    def _fit(self, x: np.ndarray, y: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        mixed = self.mix(x)
        self.mean, self.spread = mixed.mean(0), mixed.std(0) + 1e-6
        fit_x, fit_y = (mixed - self.mean) / self.spread, y.astype(float)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(fit_x @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - fit_y) / max(1, len(fit_y))
            back = np.outer(error, w[2]) * (1 - h * h)
            grads = [fit_x.T @ back + DECAY * w[0], back.sum(0), h.T @ error + DECAY * w[2], error.sum()]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def mix(self, x: np.ndarray) -> np.ndarray:
        """Rows of pool() with average tokens put in."""
        n = np.expm1(10 * x[:, -1:])
        return np.concatenate([(x[:, :-1] * n + self.prior * self.average) / (n + self.prior), x[:, -1:]], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((self.mix(x) - self.mean) / self.spread @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Model:
    """Word vectors, the words that have one of their own, and the network, or None where there was no label."""

    def __init__(self, vectors: np.ndarray, vocabulary: np.ndarray, network: Network | None):
        self.vectors, self.vocabulary, self.network = vectors, vocabulary, network

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.probability(pool(texts, self.vectors, self.vocabulary))


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors of all documents, and the network fitted on about limit labelled ones; no network if there is no label."""
    chosen = vocabulary(docs, VOCABULARY, id_col, text_col)
    vectors = word_vectors(docs, chosen, id_col, text_col)
    sample = common.labelled_sample(docs, labels, label_col, learn, limit, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, chosen))

    def run(batches):
        for part, texts in common.text_slices(batches):
            x = pool(texts, *sent.value)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), rows], ["doc_id", "label", "x"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    sent.destroy()
    return Model(vectors, chosen, Network(np.array([r.x for r in rows]), np.array([r.label for r in rows])) if rows else None)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The quality of every whole text: doc_id, score (0 to 1), predicted (1 if score >= LEAST_SCORE).

    Null and empty texts have no tokens and are scored as such; without labels every score is 0.5. Repeated rows and null ids
    stay; no other column is read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in common.text_slices(batches):
            score = sent.value.scores(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= LEAST_SCORE).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
