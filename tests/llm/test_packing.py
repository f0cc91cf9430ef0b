import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "It's 'sun' don''t..'s 12ab3 ÀÉß×x ÷", "<|endoftext|> hi", "a\x85b\xa0c İ ﬁ ñ ª", "日本語 x́", "ÆØÅ ÿÞð!?--{}\t\n\r x", "Σς ΑΣ", "a\x1cb"])
def test_ids_are_the_librarys(text):
    assert np.frombuffer(K.word_encoder(PATH).encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZ09 éßÑÿ'.,!-\n$#stremvld")))
def test_plain_texts(text):
    assert np.frombuffer(K.word_encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def test_segments_and_bounded_words(monkeypatch):
    text = " ".join(f"wort{i} it's über" for i in range(900))
    monkeypatch.setattr(K, "_SEGMENT", 40)
    monkeypatch.setattr(K, "CACHE_WORDS", 10)
    assert np.frombuffer(K.WordEncoder(PATH).encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("scale", [1, 40, 900])
def test_plan_uses_the_histogram_and_nearly_no_room(scale):
    rng = np.random.default_rng(scale)
    hist = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 300 * scale).astype(int) + 1), minlength=2049)
    chosen = K.plan(hist)
    used = np.zeros(2049, int)
    for pattern, count in chosen:
        assert count > 0 and sum(a * b for a, b in pattern) <= 2048
        for a, b in pattern:
            used[a] += b * count
    assert (used == hist).all()
    total = sum(c for _, c in chosen)
    assert total <= sum(c for _, c in K._residual(hist, 2048))
    assert total <= max(-(-(hist * np.arange(2049)).sum() // 2048), hist[1025:].sum()) * 1.01 + 1


def test_fit_is_non_negative_least_squares():
    hist = np.zeros(17)
    hist[[3, 5, 8, 11, 13]] = [40, 60, 30, 60, 40]
    patterns = K._patterns(hist, 16)
    x = K.fit_counts(patterns, hist, 4000)
    made = np.bincount(patterns.ravel(), np.repeat(x, 3), 17)
    assert (x >= 0).all() and np.allclose(made[1:], hist[1:], atol=1e-3)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, capacity):
    texts = [None, "", "x y z", "a b " * 3000, *[f"word{i} " * (i % 23) for i in range(200)], *["same text here"] * 60]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, part int, offset int").repartition(4)
    rows = K.pack(docs, PATH, capacity).collect()
    want = []
    for i, t in enumerate(texts):
        own = [*ids(t or ""), 0]
        for n, at in enumerate(range(0, len(own), capacity)):
            cut = np.array(own[at : at + capacity], "<u4")
            want.append((i if i != 5 else None, n, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(places) <= 1.03 * total / capacity + 1
    assert K.pack(docs.limit(0), PATH, capacity).count() == 0
