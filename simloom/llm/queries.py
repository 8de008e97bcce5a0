"""The query of each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from simloom.llm import language, lines, media, neardup, quality, tokens, topk, toxicity
from simloom.llm.common import held_out, table

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string")) % 5 != 0)
    return toxicity.score_toxicity(docs, fitted).withColumn("held_out", held_out(5, 0))


def op3_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = language.learn_samples(docs.filter(~held_out(3, 1)))
    return language.identify(docs, samples).withColumn("held_out", held_out(3, 1))


def op5_best_fit_packing(spark, sf_dir):
    return tokens.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string")) % 3 != 1)
    return quality.classify(docs, model).withColumn("held_out", held_out(3, 1))


def op7_bpe_codec(spark, sf_dir):
    return tokens.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE))


def op8_ngram_jaccard_join(spark, sf_dir):
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE))


def op10_media_columns(spark, sf_dir):
    found = media.text_media(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.to_binary(F.array_join(F.transform("tiles", F.hex), ""), F.lit("hex")), 256)
    return found.withColumns({"n_tiles": F.size("tiles"), "tiles_sha256": digest}).drop("tiles")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk, op2_toxicity, op3_line_dedup, op4_language_id, op5_best_fit_packing, op6_quality_classifier,
        op7_bpe_codec, op8_ngram_jaccard_join, op9_token_counts, op10_media_columns,
    )
}
ORACLES = {"op1_exact_topk": topk.TOP_K_SQL, "op3_line_dedup": lines.LINE_DEDUP_SQL, "op8_ngram_jaccard_join": neardup.JACCARD_SQL}
