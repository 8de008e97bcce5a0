"""Line dedup (op3), in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm import common

LEAST_CODE_POINTS = 10
#: A line on more than one of so many rows (and more than HOT_ROWS) is hot. Hot lines are sought among about SOUGHT_ROWS rows.
HOT_SHARE, HOT_ROWS, SOUGHT_ROWS = 1000, 100, 4_000_000
#: The characters that are stripped, and the letters that are lowered.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line):
    """The line without blanks at its ends and with A-Z lowered; lines of ASCII alone take the quicker lower()."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def hot_hashes(rows: DataFrame, n: int) -> DataFrame:
    """(hash, slices) of the hashes on a large share of rows, at most about HOT_SHARE of them whatever n, the number of rows.

    They only decide how rows are dealt, so where there are many rows they are sought on a part of them.
    """
    every = max(1, n // SOUGHT_ROWS)
    part = rows if every == 1 else rows.filter(F.pmod(F.xxhash64("hash", "doc_id", "pos"), F.lit(every)) == 0)
    bound = max(HOT_ROWS, n // HOT_SHARE) / every
    counts = part.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > bound)
    return counts.select("hash", F.ceil(F.col("n") / bound).cast("int").alias("slices"))


def first_documents(rows: DataFrame) -> DataFrame:
    """rows (hash, doc_id, text_hash, pos) with first_doc, the smallest document that holds the hash.

    Rows are dealt by ranges of (hash, slice) and sorted by document and position within; a window streams over that order,
    with no further exchange or sort. Only hot hashes have more than one slice, so one hash may fill many partitions; their
    first documents come from sums of each task and are broadcast.
    """
    hot = common.cut(hot_hashes(rows, rows.count()))
    anywhere = rows.join(F.broadcast(hot), "hash").groupBy("hash").agg(F.min("doc_id").alias("first_anywhere"))
    sliced = rows.join(F.broadcast(hot), "hash", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"), F.lit(0))).drop("slices")
    ranged = sliced.repartitionByRange("hash", "slice").sortWithinPartitions("hash", "slice", "doc_id", "pos")
    stream = Window.partitionBy("hash", "slice").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = ranged.withColumn("first_here", F.first("doc_id").over(stream)).join(F.broadcast(anywhere), "hash", "left")
    return firsts.select("hash", "doc_id", "text_hash", "pos", F.coalesce("first_anywhere", "first_here").alias("first_doc"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CODE_POINTS) -> DataFrame:
    """Which lines of which documents stay: doc_id, text_hash, n_dropped, keeps.

    Line keys become hashes of 128 bits, dealt by range with documents and positions in order, and each hash's first document
    is streamed (see first_documents). keeps is a compressed bitmap, from numbers of words to words: bit p of word w is set
    where line 64 w + p stays (and past the last line). A word that is not there has all bits set, and a document that loses
    no line has no row.
    """
    text = common.id_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    lines = text.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least)
    rows = keyed.select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "text_hash", "pos")
    rows = common.cut(rows, gather=True)  # the sampling for ranges reads them a second time
    later = first_documents(rows).filter("doc_id > first_doc")
    words = later.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos & 63)"))).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(64 - F.bit_count("bits")).alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keeps")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of all columns of docs), n_lines, n_dropped and kept (the text of the lines that stay)."""
    text = F.col(f"`{text_col}`").cast("string")
    marked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = marked.join(bitmaps.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    lines = F.split("text", "\n", -1)
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    whole = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6)), lambda w: F.coalesce(F.try_element_at("keeps", w), F.lit(-1).cast("long")))
    joined = joined.withColumn("bits", F.when(F.col("n_dropped").isNotNull(), whole))
    stays = lambda line, p: F.call_function("shiftright", F.get("bits", F.shiftright(p, 6)), p.bitwiseAND(63)).bitwiseAND(1) == 1
    kept = F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select("row", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CODE_POINTS) -> DataFrame:
    """Drop lines whose key stands in an earlier document: doc_id, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line. A document that holds its own line twice keeps both. Rows with a null id are not
    compared with others and stay whole; rows that repeat an id count as one document; other columns are not read; an empty
    table gives an empty one. If every line goes, kept_text is empty.
    """
    text = common.id_text(docs, id_col, text_col)
    out = apply_bitmaps(text, keep_bitmaps(text, least=least))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_text"))


#: DuckDB SQL of the query.
LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT l.*, f.first_doc IS NOT NULL AND l.doc_id > f.first_doc AS gone
  FROM keyed l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
