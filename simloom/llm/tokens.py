"""Byte-pair encoding and decoding (op7), token counts (op9) and best-fit packing (op5)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import bpe, common

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Pieces that one packing group has on average; groups are packed apart from one another.
GROUP_PIECES = 16384


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text by segment trees over pair ranks and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids and decoded. Null counts as the empty
    text, which has no ids; repeated rows and null ids stay as they are; other columns are not read. An empty table gives
    an empty one. Strings of special tokens in a text become their ids, as in the library.
    """

    def run(batches):
        tok = bpe.tokenizer(path)
        for part, texts in common.text_slices(batches):
            ids = tok.encode_batch(texts)
            decoded = [tok.decode(x) for x in ids]
            columns = [
                part.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.id_text(docs, id_col, text_col).mapInArrow(run, schema + ", ids array<long>, decoded string" * with_ids)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: pre-tokens proved to be single tokens count as one, the rest are merged.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null counts as the empty text (0 bytes, 0 tokens);
    repeated rows and null ids stay; other columns are not read; an empty table gives an empty one.
    """

    def run(batches):
        tok = bpe.counting_tokenizer(path)
        for part, texts in common.text_slices(batches):
            n = tok.count_batch(texts)
            size = [len(x.encode("utf-8")) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids and its end id into pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        tok = bpe.tokenizer(path)
        for part, texts in common.text_slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for k, ids in enumerate(tok.encode_batch(texts)):
                data = np.append(ids, np.array([end_id], "<u4"))
                for piece, lo in enumerate(range(0, len(data), capacity)):
                    cut = data[lo : lo + capacity]
                    for column, x in zip(rows, (k, piece, lo, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        column.append(x)
            numbers = [pa.array(x, pa.int64()) for x in rows]
            numbers[1] = numbers[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(numbers[0]), *numbers[1:]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class VectorBins:
    """Bins with several capacities; best fit by weighted dot product or by the norm of what remains.

    Demands and capacities are vectors over (tokens, documents, attention cost). An item goes, of the bins that hold it under
    every capacity, to the one whose residual vector has the smallest weighted norm after it ("norm"), or whose residual
    has the largest weighted dot product with the demand relative to the residual's size ("dot"); ties to the oldest bin. A
    bin that no further item can enter leaves the search.
    """

    def __init__(self, capacities, weights=(1.0, 0.05, 0.2), rule: str = "norm"):
        if rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {rule!r}")
        self.capacities, self.weights, self.rule = np.asarray(capacities, float), np.asarray(weights, float), rule

    def pack(self, demands: np.ndarray) -> np.ndarray:
        """The bin of each item, taken in the given order; every demand must fit into an empty bin."""
        demands = np.asarray(demands, float) / self.capacities
        if len(demands) and (demands.max() > 1 or demands.min() < 0):
            raise ValueError("an item exceeds a capacity")
        least = demands.min(0) if len(demands) else None
        room, names = np.empty((max(1, len(demands)), len(self.capacities))), np.empty(max(1, len(demands)), np.int64)
        live = made = 0
        out = np.empty(len(demands), np.int64)
        for k, d in enumerate(demands):
            left = room[:live] - d
            fits = np.flatnonzero((left >= -1e-12).all(1))
            if len(fits):
                if self.rule == "norm":
                    cost = (left[fits] ** 2) @ self.weights
                else:
                    r = room[fits]
                    cost = -((r * d) @ self.weights) / np.maximum((r**2) @ self.weights, 1e-12)
                at = fits[np.argmin(cost)]
                room[at] = left[at]
            else:
                at, live, made = live, live + 1, made + 1
                room[at], names[at] = 1 - d, made - 1
            out[k] = names[at]
            if (room[at] < least - 1e-12).any():
                live -= 1
                room[at : live] = room[at + 1 : live + 1]
                names[at : live] = names[at + 1 : live + 1]
        return out


def best_fit(
    items: DataFrame, capacity: int = SEQUENCE_TOKENS, max_documents: int | None = None, max_attention: int | None = None,
    rule: str = "norm", group_pieces: int = GROUP_PIECES, seed_columns: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """Pack rows with a length into sequences by vector best fit; adds sequence_id and offset.

    Rows are numbered and dealt by a hash of the number to groups of about group_pieces rows, so that rows alike in all
    columns are spread too; groups are packed apart, longest first, ties by seed_columns. So memory is bounded and the loss is
    at most one sequence in part for each group. items should be cheap and stable to read again. max_documents and max_attention (the
    sum of squared lengths) bind only if given. A sequence's rows follow one another without gaps from offset 0.
    """
    groups = max(1, -(-items.count() // group_pieces))
    limits = [capacity, max_documents or capacity, max_attention or capacity * capacity]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *seed_columns], ascending=[False] + [True] * len(seed_columns), kind="stable")
        n = pdf["length"].to_numpy(np.int64)
        at = VectorBins(limits, rule=rule).pack(np.stack([n, np.ones_like(n), n * n], 1))
        pdf["sequence_id"] = pdf["_group"].to_numpy(np.int64) * (1 << 32) + at
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_group")

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    names = [f"{c} {t}" for c, t in items.dtypes] + ["sequence_id long", "offset long"]
    return dealt.groupBy("_group").applyInPandas(pack, ", ".join(names))


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Tokenize, cut and pack documents; one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Repeated rows are packed as often as they occur; a null id is
    packed under null; other columns are not read; an empty table gives an empty one. Pieces, not ids, are kept in the
    shared folder, so nothing is tokenized twice.
    """
    return best_fit(common.cut(pieces(docs, path, capacity, END_ID, id_col, text_col), gather=True), capacity, **limits)
