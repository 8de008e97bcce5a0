"""Every query that writes checkpoints, in a session that names no folder for them."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import corpus_pipeline
from simloom.llm import lines, neardup, topk
docs = spark.createDataFrame([(k, f"some line number {k % 2} of text\\nand another", "en", "s", 1) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
vectors = spark.createDataFrame([(k, [1.0 * k, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
out = [topk.top_k(vectors), lines.dedup_lines(docs), neardup.jaccard_join(docs), *(f(spark, docs, "") for n, f in corpus_pipeline.STAGES if n in ("line_dedup", "near_copies", "packing"))]
print("ROWS", [d.count() for d in out])
"""


def test_no_folder_is_needed_in_a_local_session():
    root = Path(__file__).resolve().parent.parent.parent
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, timeout=300, cwd=root, env=os.environ | {"PYSPARK_PYTHON": sys.executable})
    assert "ROWS [3, 4, 4, 4, 2, 4]" in done.stdout, done.stderr[-2000:]
