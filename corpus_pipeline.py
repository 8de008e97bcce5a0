"""The corpus pipeline: language, quality, repeated lines, near copies, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import common, language, lines, neardup, quality, tokens


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter, and those that no learned language explains, go."""
    samples = language.learn_samples(docs.filter(~common.held_out(3, 1)))

    def keep(texts):
        if not samples:
            return [False] * len(texts)
        langs, score = language.parser(samples).predict(texts)
        return [x != language.UNKNOWN and s >= language.LEAST_SCORE for x, s in zip(langs, score.tolist(), strict=True)]

    return common.filter_texts(docs, keep)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op6) predicts as good; without labels all stay."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string")) % 3 != 1)
    sent = spark.sparkContext.broadcast(model)

    def keep(texts):
        return sent.value.scores(texts) >= quality.LEAST_SCORE if sent.value.network else [True] * len(texts)

    return common.filter_texts(docs, keep)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows. A document that loses every line stays, empty."""
    out = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    changed, row = F.col("n_dropped") > 0, {c: F.col(f"row.`{c}`") for c in docs.columns}
    row["text"] = F.when(changed, F.col("kept")).otherwise(row["text"])
    if "n_chars" in row:
        row["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return out.select(*[x.alias(c) for c, x in row.items()])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near copies join, the one with the smallest id; documents without an id stay."""
    return neardup.keep_first_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document with its place in a sequence of 4096 tokens."""
    return tokens.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("quality", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_each_group),
    ("packing", pack),
]

#: Language, quality and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of sf_dir.

    Every stage but the last is written to the shared folder and read again; a stage's table goes once the next one is whole.
    """
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
