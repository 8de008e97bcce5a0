import hashlib
import io
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from simloom.llm import bpe, media, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
LIB = {f: Library.from_file(public_tokenizers.path(f)) for f in FILES}
EDGES = [
    None, "", " ", "a", "<|endoftext|>", "x <|endoftext|>  y\n\n z<|startoftext|>", "\x1c\x1d a\x85b　c\xa0d", "ΑΣ Σ ΣΑ İI ı ß ẞ", "don't WE'LL i'M", "日本語 漢字", "Ⅻ ½ ² x²",
    "😀 👩‍👩‍👧 ok", "a" * 3000 + " " + "ab" * 700, "   lead  trail   ", "é 가", "Ꟛ", "!!!!???? ''s 's", "\t\r\n q",
]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_equal_the_library(name, texts):
    tok = bpe.tokenizer(public_tokenizers.path(name))
    got = tok.encode_batch(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == LIB[name].encode(text, add_special_tokens=False).ids
    assert bpe.counting_tokenizer(public_tokenizers.path(name)).count_batch(texts).tolist() == [len(x) for x in got]


@pytest.mark.parametrize("name", FILES)
def test_edges_equal_the_library(name):
    texts = [x or "" for x in EDGES]
    tok = bpe.tokenizer(public_tokenizers.path(name))
    for text, ids in zip(texts, tok.encode_batch(texts), strict=True):
        assert ids.tolist() == LIB[name].encode(text, add_special_tokens=False).ids, text[:40]
        if name == FILES[0]:
            assert tok.decode(ids) == LIB[name].decode(ids.tolist(), skip_special_tokens=False)


def test_table_may_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_CAP", 3)
    tok = bpe.Tokenizer(public_tokenizers.path(FILES[0]))
    for _ in range(3):
        for text in ("one two three four", "five six seven", "one <|endoftext|> two"):
            assert tok.encode_batch([text])[0].tolist() == LIB[FILES[0]].encode(text).ids


def plain_merge(symbols, ranks):
    symbols = list(symbols)
    while True:
        found = [(ranks[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        k = min(found)[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=6), st.booleans())
def test_trees_against_a_plain_scan(words, wide):
    merges = [("a", "b"), ("ab", "ab"), ("b", "a"), ("a", "a"), ("aa", "ab"), ("b", "b"), ("abab", "a")]
    names = ["a", "b", *dict.fromkeys(x + y for x, y in merges)]
    merger = bpe.Merger({n: k for k, n in enumerate(names)}, [" ".join(m) for m in merges])
    symbols = np.array([names.index(c) for w in words for c in w])
    before, bpe.WIDEST = bpe.WIDEST, 2 if wide else 256
    try:
        ids, counts = merger.encode(symbols, np.array([len(w) for w in words]))
    finally:
        bpe.WIDEST = before
    ranks = {m: k for k, m in enumerate(merges)}
    assert [names[i] for i in ids] == [s for w in words for s in plain_merge(w, ranks)]
    assert counts.tolist() == [len(plain_merge(w, ranks)) for w in words]


def frame(spark, texts, extra="n_tokens string, lang string"):
    return spark.createDataFrame([(k, t, "x", None) for k, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_codec_and_counts(spark):
    df, path, lib = frame(spark, EDGES + EDGES[:3]), public_tokenizers.path(FILES[0]), LIB[FILES[0]]
    counts = {r.doc_id: r for r in tokens.token_counts(df, path, 5).collect()}
    rows = {r.doc_id: r for r in tokens.encode_decode(df, path, with_ids=True).collect()}
    for k, text in enumerate(EDGES + EDGES[:3]):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert rows[k].ids == ids and rows[k].n_tokens == len(ids) and rows[k].decoded == back
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and rows[k].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert (counts[k].n_bytes, counts[k].n_tokens, counts[k].over_limit) == (len((text or "").encode()), len(ids), len(ids) > 5)
    assert tokens.encode_decode(df.limit(0), path).count() == tokens.token_counts(df.limit(0), path).count() == 0


def test_packing(spark):
    texts = [*EDGES, "many words here " * 3000, *(f"text {k} " * (k % 40) for k in range(60))]
    df, path, lib = frame(spark, texts, "length string, piece string"), public_tokenizers.path(FILES[1]), LIB[FILES[1]]
    rows = tokens.pack_documents(df, path, 256).collect()
    for k, text in enumerate(texts):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == [(a, len(ids[a : a + 256])) for a in range(0, len(ids), 256)]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in rows) // 256) + 2
    assert tokens.pack_documents(df.limit(0), path).count() == 0


def plain_best_fit(items, capacities, rule):
    """The bin of each item by a plain loop over all bins."""
    room, out = [], []
    for item in items:
        d = [x / c for x, c in zip(item, capacities, strict=True)]
        best = None
        for k, r in enumerate(room):
            left = [a - b for a, b in zip(r, d, strict=True)]
            if min(left) < -1e-12:
                continue
            if rule == "norm":
                cost = sum(w * x * x for w, x in zip((1.0, 0.05, 0.2), left, strict=True))
            else:
                cost = -sum(w * a * b for w, a, b in zip((1.0, 0.05, 0.2), r, d, strict=True)) / max(sum(w * a * a for w, a in zip((1.0, 0.05, 0.2), r, strict=True)), 1e-12)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, left)
        if best is None:
            room.append([1 - x for x in d])
            out.append(len(room) - 1)
        else:
            room[best[1]] = best[2]
            out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacities", [(100, 100, 10000), (100, 4, 10000), (100, 100, 4000), (100, 3, 3700)])
def test_best_fit_against_a_plain_loop(rule, capacities):
    n = np.sort(np.random.default_rng(sum(capacities)).integers(1, 60, 300))[::-1]
    items = np.stack([n, np.ones_like(n), n * n], 1)
    assert tokens.VectorBins(capacities, rule=rule).pack(items).tolist() == plain_best_fit(items.tolist(), capacities, rule)


def test_rows_alike_are_spread_over_groups(spark):
    rows = [(None, 0, 10)] * 600 + [(k, 0, 10) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(4).checkpoint()
    got = tokens.best_fit(df, 100, group_pieces=100, max_documents=8).collect()
    per = {}
    for r in got:
        per.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(got) == 620 and len(per) == 7 and max(map(len, per.values())) < 160
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r.offset)
    assert all(sorted(x) == list(range(0, 10 * len(x), 10)) and len(x) <= 8 for x in bins.values())


def test_null_and_repeated_ids(spark):
    texts = [(None, "some text here"), (1, "some text here"), (1, "some text here"), (2, None), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    byte, word = (public_tokenizers.path(f) for f in FILES)
    for out in (tokens.encode_decode(df, byte), tokens.token_counts(df, byte), media.text_media(df), tokens.pack_documents(df, word)):
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None", "None"]
        same = [c for c in out.columns if c not in ("doc_id", "sequence_id", "offset")]
        assert len({tuple(str(r[c]) for c in same) for r in rows}) == 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    n = np.sort(rng.integers(1, 100, 200))[::-1]
    at = tokens.VectorBins([100, 3, 4000], rule=rule).pack(np.stack([n.clip(max=60), np.ones_like(n), n.clip(max=60) ** 2], 1))
    for b in np.unique(at):
        mine = n.clip(max=60)[at == b]
        assert mine.sum() <= 100 and len(mine) <= 3 and (mine**2).sum() <= 4000
    with pytest.raises(ValueError):
        tokens.VectorBins([10, 1, 100]).pack(np.array([[11, 1, 1]]))


def test_images():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_ppm(pixels)) == pixels).all() and (media.decode_image(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode_image(b"P2\n# note\n2 2\n15\n0 15 5 10\n").tolist() == [[0, 255], [85, 170]]
    assert media.decode_image(b"P5 2 1 255\n\x01\xff").tolist() == [[1, 255]]
    assert media.decode_image(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P4\n9 1\n\xaa\x80").tolist() == [[0, 255, 0, 255, 0, 255, 0, 255, 0]]
    assert media.decode_image(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode_image(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    with pytest.raises(ValueError):
        media.decode_image(b"GIF89a")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 6), st.integers(1, 6))
def test_area_resize_against_fine_grid(rows, cols, height, width):
    plane = np.random.default_rng(rows * 10 + cols).integers(0, 255, (rows, cols))
    fine = np.repeat(np.repeat(plane, height, 0), width, 1)
    want = fine.reshape(height, rows, width, cols).mean((1, 3))
    assert np.allclose(media.area_resize(plane, height, width), want)


@pytest.mark.parametrize("band", [1, 3, 7])
def test_bands_change_no_pixel(monkeypatch, band):
    pixels = np.random.default_rng(band).integers(0, 256, (23, 9, 3), dtype=np.uint8)
    want = media.area_resize(pixels, 5, 4)
    monkeypatch.setattr(media, "BAND_ROWS", band)
    assert np.allclose(media.area_resize(pixels, 5, 4), want) and media.area_resize(pixels, 23, 9) == pytest.approx(media.grey(pixels))


def test_both_formats_are_written_and_read():
    for rows, magic in ((1, b"P6"), (media.PPM_ROWS, b"P6"), (media.PPM_ROWS + 1, b"BM"), (300, b"BM")):
        text = "".join(chr(33 + k % 90) for k in range(192 * rows - 5))
        data, n = media.store(text)
        assert data[:2] == magic and n == len(text) and media.decode_image(data).tobytes() == text.encode() + b" " * 5


def test_tiles_and_hash():
    plane = np.arange(70 * 65, dtype=np.uint8).reshape(70, 65)
    tiles = [np.load(io.BytesIO(t)) for t in media.npy_tiles(plane, 64)]
    assert [t.shape for t in tiles] == [(64, 64), (64, 1), (6, 64), (6, 1)] and (tiles[0] == plane[:64, :64]).all()
    rising = np.tile(np.arange(90), (20, 1))
    assert media.difference_hash(rising) == 2**64 - 1 and media.difference_hash(rising[:, ::-1]) == 0


def test_text_media(spark):
    texts = [*EDGES, "x" * 192, "y" * 193, EDGES[5]]
    rows = {r.doc_id: r for r in media.text_media(frame(spark, texts, "feature string, media string"), tile=32, with_files=True).collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert media.decode_image(bytes(r.media)).tobytes() == payload and r.tiles
        small = np.concatenate([np.load(io.BytesIO(bytes(t))) for t in r.tiles])
        pixels = media.decode_image(bytes(r.media))
        assert (small == np.rint(media.area_resize(pixels, min(128, len(pixels)), 32)).astype(np.uint8)).all() and all(len(np.load(io.BytesIO(bytes(t)))) <= 32 for t in r.tiles)
    assert rows[5][1:] == rows[len(texts) - 1][1:]
    assert media.text_media(frame(spark, texts, "a string, b string").limit(0)).count() == 0
