import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import language, quality, toxicity, words

SMALL = "/root/testdata/sf0.01"
EDGES = [None, "", " ", "\n\n", "12 34 !!", "x", "x" * 30000, "word " * 20000, "日本語", "\U0001f600", "İß ǅ", "a" * 5000 + "!" + "b" * 5000]


def frame(spark, texts, extra="score string, words string"):
    return spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def longest_match_phrases(text, sample):
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1) if text[at] in sample else 1
        phrases += 1
    return phrases


def folded(text):
    out = []
    for c in text + "\n":
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return "".join(out)


def test_automaton_reads_substrings_only():
    rnd = random.Random(1)
    text = [rnd.randrange(3) for _ in range(60)]
    steps = language.suffix_automaton(text)
    subs = {tuple(text[a:b]) for a in range(61) for b in range(a, 61)}
    for _ in range(400):
        word = tuple(rnd.randrange(3) for _ in range(rnd.randrange(7)))
        state = 0
        for c in word:
            state = steps[state].get(c) if state is not None else None
        assert (state is not None) == (word in subs)


def test_phrases_against_plain_parsing():
    samples = {"a": "the quick brown fox jumps over the lazy dog again", "b": "le renard brun saute par dessus le chien"}
    parser = language.CrossParser(samples)
    texts = ["the lazy fox", "le chien brun", "zzz the", "q", "The Quick, brown; fox", "xyz le"]
    got = parser.phrases(*language.fold(texts))
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [longest_match_phrases(folded(t), folded(samples[lang])) for t in texts]


def test_laid_rows_hold_every_transition_and_no_other():
    rnd = random.Random(6)
    samples = {"a": "".join(rnd.choice("abcdefgh ") for _ in range(300)), "b": "".join(chr(0x4E00 + rnd.randrange(200)) for _ in range(300)), "c": ""}
    parser, base = language.CrossParser(samples), 0
    for x in parser.langs:
        steps = language.suffix_automaton((np.searchsorted(parser.alphabet, language.fold([samples[x]])[0]) + 1).tolist())
        for s, row in enumerate(steps):
            got = parser.step(np.full(parser.width, base + s), np.arange(parser.width)).tolist()
            assert got == [row[c] + base if c in row else -1 for c in range(parser.width)]
        base += len(steps) + 1
        assert (parser.step(np.full(parser.width, base - 1), np.arange(parser.width)) == -1).all()


@pytest.mark.parametrize("lane", [1, 2, 7, 64, 1024])
def test_long_texts_are_parsed_as_a_whole(monkeypatch, lane):
    monkeypatch.setattr(language, "LANE", lane)
    rnd = random.Random(lane)
    samples = {"a": "abcdefghij" * 20, "b": "jihgfedcba" * 20 + " other words", "c": "".join(rnd.choice("abcde ") for _ in range(400))}
    parser = language.CrossParser(samples)
    texts = ["abcdefghij" * 30, "", "".join(rnd.choice("abcdefgh ") for _ in range(500)), "zzz" * 40, "a", "fghijabcde" * 11 + "x" + "abc" * 30, " ".join(["abcde"] * 60)]
    got = parser.phrases(*language.fold(texts))
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [longest_match_phrases(folded(t).removeprefix(" "), folded(samples[lang])) if t else 0 for t in texts]


def test_a_text_of_many_lanes_needs_few_phrases():
    rnd = random.Random(9)
    sample = "".join(rnd.choice("abcdefghijklmnop") for _ in range(8400))
    assert language.CrossParser({"a": sample}).phrases(*language.fold([sample * 10]))[0, 0] == 10


def test_many_languages_and_large_alphabets():
    rnd = random.Random(2)
    samples = {f"l{k:02d}": "".join(chr(0x4E00 + 300 * k + rnd.randrange(3000)) for _ in range(2500)) for k in range(30)}
    parser = language.CrossParser(samples)
    assert parser.table.nbytes + parser.base.nbytes < 32 << 20
    texts = [samples[x][500:1500] + samples["l00"][:20] for x in parser.langs]
    assert parser.predict(texts)[0] == parser.langs
    got = parser.phrases(*language.fold(texts[:3]))
    assert got[2].tolist() == [longest_match_phrases(folded(t), folded(samples["l02"])) for t in texts[:3]]


def test_equal_languages_tie_to_the_first_name(spark):
    samples = {"b": "some words of text", "a": "some words of text"}
    rows = language.identify(spark.createDataFrame([(None, "words of text"), (1, "words of text"), (1, "words of text")], "doc_id long, text string"), samples).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows] == [(None, "a"), (1, "a"), (1, "a")] and len({r.score for r in rows}) == 1


def test_learned_rows_are_whole(spark):
    rows = [(1, "short text " * 3, "x"), (2, "long text " * 900, "x"), (3, "long " * 3000, "y"), (4, "longer " * 3000, "y"), (5, None, "x"), (6, "12", "x"), (7, "no label", None), (1, "short text " * 3, "x"), (1, "the same id", "x")]
    got = language.learn_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(got["x"].split("\n")) == ["short text " * 3, "the same id"] and got["y"] == "long " * 3000
    assert len(language.learn_samples(spark.createDataFrame([(k, f"text {k}", "x") for k in range(40)], "doc_id long, text string, lang string"))["x"].split("\n")) == language.SAMPLE_DOCS


def test_language_edges(spark):
    samples = {"en": "the words of this text are plain", "fr": "les mots de ce texte sont simples"}
    got = {r.doc_id: r for r in language.identify(frame(spark, EDGES), samples).collect()}
    for k, t in enumerate(EDGES):
        letters = any(c.isalpha() for c in t or "")
        assert (got[k].lang_pred in samples) if letters else (got[k].lang_pred == "und" and got[k].score == 0)
        assert 0 <= got[k].score <= 1
    assert {r.lang_pred for r in language.identify(frame(spark, ["x"]), {}).collect()} == {"und"}
    assert language.identify(frame(spark, ["x"]).limit(0), samples).count() == 0


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    samples = language.learn_samples(docs.filter(~out))
    assert all(len(x) <= language.SAMPLE_DOCS * (language.SAMPLE_CHARS + 1) for x in samples.values())
    right = language.identify(docs.filter(out), samples).join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])


def held_out_auc(spark, scored, column, modulus, remainder):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder).select("score", column).collect()
    return auc(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, lambda c: F.crc32(c.cast("string")) % 3 != 1)
    assert held_out_auc(spark, quality.classify(docs, model), "quality", 3, 1) > 0.95


def test_quality_edges(spark):
    df = frame(spark, EDGES)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(12)] + [(0, 1, None), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, lambda c: F.lit(True))
    rows = quality.classify(df, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = quality.fit(df.limit(0), labels.limit(0), lambda c: F.lit(True))
    assert {r.score for r in quality.classify(df, none).collect()} == {0.5} and quality.classify(df.limit(0), model).count() == 0


def some_vocabulary():
    return np.sort(words.word_hashes(["two three"])[0])


def test_context_vectors_against_a_loop():
    texts, known = ["one two two three!", "two one", "CAPS word WoRd 12"], some_vocabulary()
    n = quality.rows_of(known)
    places, signs = quality.index_vectors(n)
    want = np.zeros((n, quality.DIMS))
    for t in texts:
        (bucket, _), = quality.token_buckets([t], known)
        for a, b in [*zip(bucket, bucket[1:], strict=False), *zip(bucket[1:], bucket, strict=False)]:
            for p, s in zip(places[b], signs[b], strict=True):
                want[a, p] += s
    assert (quality.context_counts(texts, known, places, signs) == want).all()


@pytest.mark.parametrize("size,gathered", [(2, 4), (3, 1 << 20), (100, 2), (0, 8)])
def test_the_most_frequent_words_have_vectors_of_their_own(spark, monkeypatch, size, gathered):
    monkeypatch.setattr(quality, "GATHERED", gathered)
    texts = ["aa " * 40 + "bb " * 20, "bb aa cc cc cc cc cc 12 12", None, "", "dd aa AA"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = set(quality.vocabulary(df, size).tolist())
    of = lambda *w: set(words.word_hashes([" ".join(w)])[0].tolist())
    assert got == {0: set(), 2: of("aa", "bb"), 3: of("aa", "bb", "cc"), 100: of("aa", "bb", "cc", "dd")}[size]
    known = quality.vocabulary(df, 3)
    (bucket, _), = quality.token_buckets(["aa bb dd"], known)
    assert sorted(bucket[:2] >= quality.FORMS + quality.SHARED) == [True, True] and bucket[2] < quality.FORMS + quality.SHARED


def test_temperature_makes_probabilities_honest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p = quality.Network(x, y).probability(x)
    for lo in (0.1, 0.4, 0.7):
        near = (p > lo) & (p < lo + 0.2)
        assert abs(y[near].mean() - p[near].mean()) < 0.1


@pytest.fixture(scope="module")
def char_model():
    words_of = "you are an idiot and a moron what trash such a stupid clown pathetic loser disgusting scum worthless this is some other text that people write".split()
    rnd = random.Random(2)
    return toxicity.CharModel(toxicity.trigram_counts([" ".join(rnd.choice(words_of) for _ in range(400)) for _ in range(30)]))


@pytest.mark.parametrize("word,shapes", [("idiot", ["1d10t", "idioooot", "i.d.i.o.t", "i-d-i-o-t", "id!ot", "iiidiot", "IDI0T"]), ("moron", ["m0r0n", "moronnn", "m*ron"]), ("stupid", ["$tupid", "stuuupid", "s7upid"]), ("loser", ["l0ser", "lo$er", "l0s3r"]), ("trash", ["tr@sh", "tra5h", "traaash!!!"])])
def test_disguises_are_lifted(char_model, word, shapes):
    r = toxicity.Restorer(char_model)
    for shape in shapes:
        assert word in r.words(f"see {shape} there"), shape
    assert word in r.words("see " + " ".join(word) + " there")


def test_plain_words_stay(char_model):
    r = toxicity.Restorer(char_model)
    assert r.words("Plain words, 2024 and 3.14 stay!") >= {"plain", "words", "and", "stay"}
    assert r.words("") == set()


@pytest.mark.parametrize("word,shape", [("stupid", "stuupid"), ("idiot", "iddiot"), ("idiot", "Idiiot,"), ("ass", "a$$"), ("ass", "@$$"), ("ass", "a$$."), ("stupid", "s t u p i d."), ("stupid", '"s t u p i d'), ("stupid", "(s t u p i d)!")])
def test_doubled_letters_trailing_signs_and_spelling_beside_punctuation(word, shape):
    rnd = random.Random(2)
    words_of = "you are a stupid idiot and an ass this is some other text that people write".split()
    r = toxicity.Restorer(toxicity.CharModel(toxicity.trigram_counts([" ".join(rnd.choice(words_of) for _ in range(400)) for _ in range(30)])))
    assert word in r.words(f"see {shape} there")
    assert r.words("a letter, good stuff! it's a b c-d") >= {"letter", "good", "stuff"}


def test_viterbi_against_all_paths(char_model):
    import itertools

    def cost(text):
        x = y = total = 0
        for ch in text + " ":
            c = 0 if ch == " " else toxicity.symbol(ch)
            if c or y:
                total += char_model.cost[(x * 28 + y) * 28 + c]
                x, y = y, c
        return total

    for token in ("1d10t", "m0*n", "aaa$b", "l|0"):
        paths = itertools.product(*toxicity.lattice(token))
        best = min((cost("".join(p for p, _ in path)) + sum(c for _, c in path), "".join(p for p, _ in path).strip()) for path in paths)
        got = toxicity.restore(token, char_model)
        assert abs(min(cost("".join(p for p, _ in path)) + sum(c for _, c in path) for path in itertools.product(*toxicity.lattice(token)) if "".join(p for p, _ in path).strip() == got) - best[0]) < 1e-9


def test_trigrams_against_a_loop():
    texts = ["ab  c!", "", "É1z", "ßa"]
    want = np.zeros(28**3, int)
    for t in texts:
        s = [0, 0]
        for ch in t + " ":
            c = toxicity.symbol(ch)
            if c or s[-1]:
                s.append(c)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            want[(a * 28 + b) * 28 + c] += 1
    want.reshape(28, 28, 28)[:, 0, 0] = 0
    assert toxicity.trigram_counts(texts).tolist() == want.tolist()


def test_long_tokens_take_time_in_proportion(char_model):
    import time

    def seconds(n):
        token, began = "1d10t-" * n, time.process_time()
        assert len(toxicity.restore(token, char_model)) > 3 * n
        return time.process_time() - began

    seconds(50)
    assert seconds(4000) < 24 * max(seconds(500), 0.01)


def test_weights_are_a_constrained_minimum():
    rnd = random.Random(3)
    rows = [(int("t" in bag or rnd.random() < 0.05), rnd.randrange(4), tuple(sorted(bag)), 1) for bag in (set(rnd.sample("tabcd", rnd.randrange(4))) for _ in range(400))]
    sample = toxicity.Sample(rows)
    w, b = sample.fit(np.ones(len(rows)), 1.0)
    loss = lambda w, b: (np.logaddexp(0, -(sample.sums(w) + b) * (2 * sample.label - 1)) * sample.n).sum() + 0.5 * (w**2).sum()
    assert (w >= 0).all() and w[sample.names.index("t")] == w.max() > 2
    for k in range(len(w)):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] = max(0, moved[k] + step)
            assert loss(moved, b) >= loss(w, b) - 1e-3
    assert abs(loss(w, b + 0.05) - loss(w, b)) < 1 and loss(w, b + 0.3) > loss(w, b) < loss(w, b - 0.3)


def test_scores_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "good plain words"), (1, "good plain words"), (1, "good plain words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (toxicity.score_toxicity(df, toxicity.fit(df, labels, lambda c: F.lit(True))), quality.classify(df, quality.fit(df, labels, lambda c: F.lit(True)))):
        rows = scored.collect()
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None"]
        assert len({r.score for r in rows if r.doc_id != 2}) == 1


def test_toxicity_learns_words_families_and_disguises(spark):
    rnd = random.Random(5)
    plain = [f"wo{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    docs, labels = [], []
    for k in range(400):
        body = [rnd.choice(plain) for _ in range(60)]
        if toxic := k % 5 == 0:
            body[rnd.randrange(60)] = rnd.choice(["scumbag", "vermin", "grubiling" + rnd.choice("abcdefghij")])
        docs.append((k, " ".join(body)))
        labels.append((k, 1, int(toxic)))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = toxicity.fit(df, marks, lambda c: c % 4 != 3)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, fitted).collect()}
    assert got == {k: t for k, _, t in labels}
    new = ["such scumb4g", "s c u m b a g", "plain grubilingzz", "verrrrmin", "nothing here", *EDGES]
    rows = toxicity.score_toxicity(frame(spark, new), fitted).collect()
    assert [r.predicted for r in sorted(rows, key=lambda r: r.doc_id)] == [1, 1, 1, 1, 0] + [0] * len(EDGES)
    both = toxicity.score_toxicity(frame(spark, new), fitted, with_words=True).collect()
    assert {r.doc_id: round(r.score, 9) for r in rows} == {r.doc_id: round(r.score, 9) for r in both}
    empty = toxicity.fit(df.limit(0), marks.limit(0), lambda c: F.lit(True))
    assert {r.predicted for r in toxicity.score_toxicity(df, empty).collect()} == {0}


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    fitted = toxicity.fit(docs, labels, lambda c: F.crc32(c.cast("string")) % 5 != 0)
    assert held_out_auc(spark, toxicity.score_toxicity(docs, fitted), "toxic", 5, 0) > 0.75


def test_kinds_cover_all_code_points():
    kind, low, upper = words.tables()
    assert kind[ord("é")] == words.LETTER and kind[ord("٣")] == words.DIGIT and kind[ord(" ")] == words.SPACE and kind[ord("!")] == words.OTHER
    assert low[ord("É")] == ord("é") and upper[ord("É")]


def test_language_query_against_a_plain_parse(spark):
    samples = {"en": "the words of this text are plain and there are many more of them", "fr": "les mots de ce texte sont simples et il y en a encore beaucoup"}
    texts = ["there are many words", "il y a les mots", "zzz", "plain texte qq", "The TEXT, of; mots!"]
    rows = {r.doc_id: r for r in language.identify(frame(spark, texts), samples).collect()}
    for k, t in enumerate(texts):
        letters = folded(t)
        cost = {x: longest_match_phrases(letters, folded(s)) * np.log2(len(folded(s))) / len(letters) for x, s in samples.items()}
        best = min(sorted(cost), key=cost.get)
        alphabet = set("".join(map(folded, samples.values())))
        known = sum(c in alphabet for c in letters) / len(letters)
        other = max(cost.values()) if len(set(cost.values())) > 1 else cost[best]
        assert rows[k].lang_pred == best and abs(rows[k].score - min(1, known * (0.5 + 0.5 * (1 - cost[best] / other)))) < 1e-9


def test_quality_query_against_plain_loops(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["good", "plain", "words", "HERE", "12", "!!", "x"]) for _ in range(rnd.randrange(1, 30))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("good" in t), 0) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, lambda c: F.lit(True))
    vectors, network = model.vectors, model.network
    got = {r.doc_id: r.score for r in quality.classify(df, model).collect()}
    for k, t in enumerate(texts):
        (bucket, _), = quality.token_buckets([t], model.vocabulary)
        total, n = np.zeros(quality.DIMS), len(bucket)
        for b in bucket:
            total = total + vectors[b]
        x = np.append((total + network.prior * network.average) / (n + network.prior), np.log1p(n) / 10)
        logit = float(network.w[3])
        for h in range(quality.HIDDEN):
            logit += network.w[2][h] * np.tanh(sum((x[d] - network.mean[d]) / network.spread[d] * network.w[0][d, h] for d in range(len(x))) + network.w[1][h])
        assert abs(got[k] - 1 / (1 + np.exp(-logit / network.temperature))) < 1e-4


def test_toxicity_query_against_a_plain_loop(spark, char_model):
    lexicon = toxicity.Lexicon({"idiot$": 4.0, "^idio": 1.5, "^mor": 9.0, "^moron": 2.0, "scum$": 3.0}, -4.0)
    texts = ["an 1d10t here", "idiotic moronic stuff", "s c u m", "nothing", "", None, "scum scum idiot", "moron"]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(frame(spark, texts), (char_model, lexicon)).collect()}
    for k, t in enumerate(texts):
        found = set()
        for w in toxicity.Restorer(char_model).words(t or ""):
            found |= {w + "$", *("^" + w[:n] for n in (4, 5, 6) if len(w) >= n)}
        p = 1 / (1 + np.exp(4.0 - sum(lexicon.weights.get(f, 0) for f in found)))
        assert abs(got[k][0] - p) < 1e-12 and got[k][1] == (p >= 0.5)
    assert [got[k][1] for k in (0, 3, 4, 5, 6)] == [1, 0, 0, 0, 1]


def test_inner_folds_choose_the_shrinkage():
    rnd = random.Random(4)
    rows = [(int("t" in bag), rnd.randrange(4), tuple(sorted(bag)), 1) for bag in (set(rnd.sample("tabcd", rnd.randrange(4))) for _ in range(300))]
    lexicon = toxicity.Sample(rows).learn()
    assert lexicon.joined({"t": lexicon.weights["t"]}) > 0.5 > lexicon.joined({})
    assert toxicity.Sample([]).learn().weights == {} and toxicity.Sample([(1, 0, ("a",), 3)]).learn().joined({}) < 0.5


def test_context_counts_need_no_more_than_their_tokens_and_a_matrix():
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(4000)) for _ in range(40)]
    none = np.zeros(0, np.uint64)
    places, signs = quality.index_vectors(quality.rows_of(none))

    def peak(f):
        f(texts[:1])
        tracemalloc.start()
        f(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    tokens = peak(lambda some: [len(owner) for _, owner in quality.token_buckets(some, none)])
    matrix = quality.rows_of(none) * quality.DIMS * 8
    assert peak(lambda some: quality.context_counts(some, none, places, signs)) < tokens + matrix + 1e6


def test_matrices_of_context_have_a_bound(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(60)], "doc_id long, text string").repartition(60)
    most = quality.MATRICES * spark.sparkContext.defaultParallelism
    parts = quality.context_rows(docs, np.zeros(0, np.uint64))
    assert parts.rdd.getNumPartitions() == most < 60


def test_the_driver_holds_word_contexts_once(spark):
    """Of 40,000 words, at most their contexts, half as much in vectors and a part of the work on them are in the driver's Python."""
    texts = [" ".join(f"w{j}x" for j in range(k, k + 2001)) for k in range(0, 40000, 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = np.unique(words.word_hashes([" ".join(texts)])[0])
    matrix = quality.rows_of(known) * quality.DIMS * 8
    context = quality.context_counts(texts, known, *quality.index_vectors(quality.rows_of(known)))
    tracemalloc.start()
    vectors = quality.word_vectors(docs, known)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * matrix

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    seen, own = context.any(1, keepdims=True), np.zeros(context.shape)
    places, signs = quality.index_vectors(len(own))
    for k, (p, s) in enumerate(zip(places, signs, strict=True)):
        for a, b in zip(p, s, strict=True):
            own[k, a] += b
    centred = np.where(seen, unit(context) - unit(context).sum(0) / seen.sum(), 0.0)
    assert (vectors == (unit(own) + unit(centred)).astype(np.float32)).all()
