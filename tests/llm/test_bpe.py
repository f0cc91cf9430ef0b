import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = B.read_ranks(PATH)
OWN = B.byte_bpe(PATH, public_tokenizers.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(b"".join(OWN.encode(text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == LIB.encode_ordinary(text)
    assert "".join(OWN.decode_text([np.array([i], "<u4").tobytes() for i in ids(text)])) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(RANKS)), max_size=8).map(b"".join))
def test_pieces_of_tokens(raw):
    text = raw.decode("utf-8", "ignore")
    assert ids(text) == LIB.encode_ordinary(text)


def test_runs_and_long_pieces():
    rng = random.Random(3)
    for text in ["a" * 3000, "ab" * 2000, " " * 500, "=" * 777 + "\n" * 9, "".join(rng.choice("etaoinü") for _ in range(5000)), "x\x1cy\x85z\xa0  w", "It's  we'll 12ab3 \t\n end  "]:
        assert ids(text) == LIB.encode_ordinary(text)


def test_segments_and_bounded_states(monkeypatch):
    text = " ".join(f"word{i} it's" for i in range(3000))
    want = LIB.encode_ordinary(text)
    monkeypatch.setattr(B, "_SEGMENT", 50)
    monkeypatch.setattr(B, "CACHE_STATES", 20)
    monkeypatch.setattr(B, "CACHE_PIECES", 30)
    assert ids(text) == want
    assert ids("abcdefgh" * 300) == LIB.encode_ordinary("abcdefgh" * 300)


def test_utf8_machine_holds_back_unfinished_characters():
    raw = "aé日😀z".encode()
    machine = B.Utf8Machine()
    parts = [machine.feed(raw[i : i + 1]) for i in range(len(raw))]
    assert "".join(parts) == "aé日😀z" and machine.close() == ""
    assert machine.feed("日".encode()[:2]) == "" and machine.close() == "�"


def test_table_and_round_trip(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Straße, it's ☕ 12", "x"), (3, "Straße, it's ☕ 12", "x"), (None, "a" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_and_decode(docs, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, text, _ in rows:
        own = LIB.encode_ordinary(text or "")
        want.add((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    back = B.decode(B.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(str((i, t or "")) for i, t, _ in rows)
    assert B.encode_and_decode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
