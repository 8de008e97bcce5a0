import numpy as np
import pytest

import corpus_pipeline
from simloom.llm import quality, queries

SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog while many people watch from the quiet side of the road",
    "fr": "le renard brun saute par dessus le chien paresseux pendant que beaucoup de gens regardent depuis la route",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rnd = random.Random(3)
    docs = []
    for k in range(240):
        lang = "en" if k % 2 else "fr"
        words = SENTENCES[lang].split()
        text = "\n".join(" ".join(rnd.choice(words) + rnd.choice(["", "", "s"]) for _ in range(14)) for _ in range(4))
        if k % 6 == 5:
            text = " ".join(w.upper() + "%%%" for w in text.split())
        docs.append((k, text, lang, "src", len(text)))
    body = docs[0][1] + "\n" + docs[2][1]
    docs += [(300, body, "fr", "src", 1), (301, "a line that all of these share\n" + docs[1][1], "en", "src", 1), (302, "a line that all of these share\n" + docs[3][1] + " more", "en", "src", 1)]
    docs += [(400, None, None, None, None), (401, "", "en", "src", 0), (402, "123 456 !!", "en", "src", 10), (403, "привет как дела у вас", None, "src", 5)]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(k, int(k % 6 != 5), 0) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for k in sorted(docs):
        for line in docs[k].text.split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), k)
    return {k: "\n".join(x for x in r.text.split("\n") if first.get(key(x), k) == k) for k, r in docs.items()}


def test_each_stage_on_what_the_last_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [rows(docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    language, quality, lines, near, packed = (rows(d) for d in seen[1:])
    assert set(seen[0]) - set(language) == {400, 401, 402, 403}
    assert {k for k in range(240) if k % 6 == 5} == {k for k in language if k not in quality}
    assert {k: r.text for k, r in lines.items()} == brute_lines(quality)
    assert all(r.n_chars == len(r.text) for k, r in lines.items() if r.text != quality[k].text) and lines[300].text == ""
    from tests.llm.test_neardup import grams

    sets, kept = {k: grams(r.text) for k, r in lines.items()}, set(near)
    for k in lines:
        linked = [j for j in lines if j != k and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])]
        assert (k in kept) or min(linked) < k
    assert set(packed) == kept


def test_run_joins_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_stage_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "line_dedup", "near_copies", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, folder).count() == 0


@pytest.mark.parametrize("p", [0.2, 0.4, 0.6])
def test_quality_stage_drops_what_the_classifier_rejects(spark, folder, monkeypatch, p):
    network = quality.Network(np.random.default_rng(0).random((20, quality.DIMS + 1)), np.arange(20) % 2)
    network.w[2], network.w[3], network.temperature = np.zeros(quality.HIDDEN), np.log(p / (1 - p)), 1.0
    model = quality.Model(np.zeros((quality.rows_of(np.zeros(0)), quality.DIMS), np.float32), np.zeros(0, np.uint64), network)
    monkeypatch.setattr(quality, "fit", lambda *a: model)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good_quality(spark, docs, folder).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, model).filter("predicted = 1").collect()}
    assert len(kept) == (docs.count() if p > 0.5 else 0)


def test_stages_take_nulls_repeated_ids_long_texts_and_clashing_names(spark, folder):
    base = spark.read.parquet(f"{folder}/documents.parquet")
    first = base.filter("doc_id = 0").first()
    other = base.filter("doc_id = 1").first()
    long_text = "\n".join(f"{first.text.split(chr(10))[k % 4]} {k}" for k in range(4000))
    rows = [
        (None, first.text, None, None, None), (None, None, None, None, None), (7, first.text, "fr", "s", 1), (7, first.text, "fr", "s", 1), (7, other.text, "en", "s", 2),
        (8, first.text, "fr", "s", 3), (9, long_text, "fr", "s", None), (10, "", "en", None, 0), (11, other.text.upper(), None, "s", 5),
    ]
    docs = spark.createDataFrame([(*r, k, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long, text_hash string, doc long")
    marks = lambda df: sorted(r["row"] for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "packing":
            assert {str(r.doc_id) for r in out.collect()} == {"None", "7", "8", "9", "10", "11"}
            continue
        assert out.columns == docs.columns and set(marks(out)) <= set(range(len(rows)))
        if name == "line_dedup":
            got = {r["row"]: r for r in out.collect()}
            assert sorted(got) == list(range(len(rows))) and got[0].text == first.text and got[5].text == "" and got[6].text.count("\n") == 3999
        if name == "near_copies":
            assert [2 if k == 3 else k for k in marks(out)] == [0, 1, 2, 4, 6, 7]


def test_equal_documents_tie_to_the_smallest_id(spark, folder):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(k, text + (" more" if k % 2 else ""), "en", "s", 1) for k in (5, 3, 9, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, folder).collect()] == [3]
