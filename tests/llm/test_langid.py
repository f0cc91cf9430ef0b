import zlib

import numpy as np
import pytest

from textloom.llm import langid as L


def greedy(sample, text):
    """Phrases by the definition: longest matches, one after the other."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_phrases_against_plain_search():
    rng = np.random.default_rng(2)
    texts = {"aa": ["".join(rng.choice(list("abc ä"), 300)) for _ in range(3)], "bb": ["".join(rng.choice(list("abd é"), 250)) for _ in range(3)]}
    parser = L.CrossParser(texts)
    fold = lambda t: "".join(chr(65 + c) for c in parser._fold(t))
    refs = {k: "".join(fold(t) + chr(65) for t in texts[k]) for k in texts}
    probes = ["".join(rng.choice(list("abcdé äz!"), n)) for n in (1, 7, 40, 200)]
    blocks = [parser._fold(p) for p in probes]
    blocks = [b for b in blocks if len(b)]
    got = parser.phrases(blocks)
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [greedy(refs[lang], "".join(chr(65 + c) for c in b)) for b in blocks]


def test_phrases_of_large_alphabets_against_plain_search():
    rng = np.random.default_rng(5)
    ideographs, astral, greek = [chr(0x4E00 + i) for i in range(150)], [chr(0x20000 + i) for i in range(20)], [chr(0x3B1 + i) for i in range(16)]
    pools = {"gg": [*greek, " "], "xx": [*ideographs, *astral, " "], "yy": [*ideographs[80:], *greek[:3], "a", " "]}
    texts = {k: ["".join(rng.choice(pool, 900, p=rng.dirichlet(np.ones(len(pool))))) for _ in range(3)] for k, pool in pools.items()}
    parser = L.CrossParser(texts)
    fold = lambda t: "".join(map(chr, parser._fold(t) + 65))
    refs = {k: "".join(fold(t) + chr(65) for t in texts[k]) for k in texts}
    blocks = [parser._fold(t[a : a + n]) for pool in texts.values() for t in pool for a, n in ((0, 90), (300, 200), (500, 1))]
    blocks += [parser._fold("".join(rng.choice([*ideographs, *astral, *greek, "z", "\u05d0"], 120))) for _ in range(5)]
    blocks = [b for b in blocks if len(b)]
    assert len(parser.keys) and len({c for t in texts.values() for x in t for c in x if c.isalpha()}) == parser.width - 2
    got = parser.phrases(blocks)
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [greedy(refs[lang], "".join(map(chr, b + 65))) for b in blocks]


def test_scripts_and_diacritics_keep_their_letters():
    rng = np.random.default_rng(3)
    latin = "abcdefghijklmnopqrst"
    words = ["".join(rng.choice(list(latin), n)) for n in rng.integers(2, 8, 300)]
    text = lambda n: " ".join(rng.choice(words, n))
    firsts = {"ar": 0x628, "el": 0x3B1, "he": 0x5D0, "hi": 0x915, "ja": 0x3042, "ka": 0x10D0, "zh": 0x4E00, "gothic": 0x10330}
    kept = {}
    for lang, first in firsts.items():
        letters = [c for c in map(chr, range(first, first + 60)) if c.isalpha() and c == c.lower() and c != "\u03c2"][:20]
        kept[lang] = str.maketrans(latin, "".join(letters))
    kept["cs"], kept["sk"] = str.maketrans("bdg", "ěřů"), str.maketrans("bdg", "ĺŕä")
    samples = {lang: [text(200).translate(table)] for lang, table in kept.items()}
    samples["en"], samples["ru"] = [text(2000) + " abcdefghijklmnopqrstuvwxyzàáâãåæçèéêëìíîï" * 900], [("".join(map(chr, range(0x430, 0x450))) + " ") * 900]
    parser = L.CrossParser(samples)
    probes = {lang: text(60).translate(table) for lang, table in kept.items()}
    assert dict(zip(probes, parser.predict(list(probes.values()))[0])) == {lang: lang for lang in probes}


def test_folding():
    parser = L.CrossParser({"xx": ["abc"]})
    assert parser._fold("  a--b 1c!! ".lower()).tolist() == [*parser._fold("a"), 0, *parser._fold("b"), 0, *parser._fold("c"), 0]
    assert parser._fold("日😀").tolist() == [parser.width - 1, 0] and len(parser._fold("")) == 0


def test_undecided_and_whole_texts(monkeypatch):
    parser = L.CrossParser({"aa": ["abab baba abba " * 9], "bb": ["cdcd dcdc cddc " * 9]})
    langs, scores = parser.predict([None, "", "12 ?!", "abba", "dccd", "zzz"])
    assert langs[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and langs[3:5] == ["aa", "bb"] and langs[5] == "aa"
    late = "ab " * 10 + "dcdc cddc " * 4000
    assert parser.predict([late])[0] == ["bb"]
    whole = parser.predict([late, "abba " * 50])[0]
    monkeypatch.setattr(L, "_SEGMENT", 1000)
    assert parser.predict([late, "abba " * 50])[0] == whole
    assert L.CrossParser({}).predict(["text"])[0] == ["und"]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")


def test_held_out_accuracy_and_columns(spark, documents):
    rows = L.identify_languages(documents).collect()
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1} and len(rows) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_from_allowed_rows_only(spark):
    rows = [(i, "aaaa abab" if zlib.crc32(str(i).encode()) % 3 != 1 else "zzzz zyzy", "aa" if zlib.crc32(str(i).encode()) % 3 != 1 else "zz", None, 1) for i in range(60)]
    parser = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int"))
    assert parser.langs == ["aa"]


def test_copies_do_not_shrink_a_sample(spark, monkeypatch):
    monkeypatch.setattr(L, "CrossParser", lambda samples: samples)
    aa, bb = [f"aba {i} ab" for i in range(900)], [f"cdc {i} dc" for i in range(40)]
    rows = [(3 * i, t, lang) for lang, texts in (("aa", aa), ("bb", bb + ["hot copy"] * 30_000)) for i, t in enumerate(texts)]
    allowed = {(lang, t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = L.learn(docs)
    assert sorted(got["bb"]) == sorted(t for lang, t in allowed if lang == "bb") and "hot copy" in got["bb"]
    assert len(got["aa"]) == len(set(got["aa"])) == 4 * L.DOCS_PER_LANG and L.learn(docs.repartition(3)) == got


def test_edges_and_stage(spark, documents):
    parser = L.learn(documents)
    rows = [(None, "the and of that", "en"), (1, None, None), (2, "", "en"), (3, "?? 12", "en"), (3, "?? 12", "en"), (4, "the thing and that of", None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, score string, found int")
    got = sorted(str((r.doc_id, r.held_out, r.lang_pred)) for r in L.identify_languages(docs, parser).collect())
    assert sum("und" in g for g in got) == 4 and "(None, False, 'en')" in got
    assert L.identify_languages(docs.limit(0)).count() == 0
    kept = L.keep_known_languages(documents)
    assert kept.columns == documents.columns and kept.count() >= 0.99 * documents.count()
    assert L.keep_known_languages(docs.limit(0)).columns == docs.columns


def test_interleaved_rows_are_found_again():
    rng = np.random.default_rng(1)
    rows = [{int(c): int(rng.integers(400)) for c in rng.choice(5000, rng.integers(0, 40), replace=False)} if i % 3 == 0 else {int(rng.integers(60)): i} for i in range(400)]
    place, owner, target = L.interleave(rows)
    assert len(set(place.tolist())) == len(rows)
    for s, row in enumerate(rows):
        mine = np.flatnonzero(owner == place[s])
        assert {int(at - place[s]): int(target[at]) for at in mine} == {c: place[t] for c, t in row.items()}


def test_two_hundred_languages_and_large_scripts():
    """Each language has its own words; two share no letter with the others and have 900 each."""
    rng = np.random.default_rng(4)
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{i:03d}": ["".join(rng.choice(alphabet, n)) for n in rng.integers(3, 9, 150)] for i in range(198)}
    for name, first in (("x1", 0x4E00), ("x2", 0x5200)):
        words[name] = ["".join(map(chr, first + rng.integers(0, 900, 2))) for _ in range(400)]
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    parser = L.CrossParser({lang: [say(lang, 250)] for lang in words})
    assert len(parser.langs) == 200 and parser.owner.nbytes + parser.target.nbytes < 40 * 200 * 2500
    probes = {lang: say(lang, 40) for lang in words}
    assert dict(zip(probes, parser.predict(list(probes.values()))[0], strict=True)) == {lang: lang for lang in probes}


def test_samples_share_one_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "CrossParser", lambda samples: samples)
    rows = [(i, f"aba {i} " * 40, f"l{i % 50}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.learn(docs, chars_per_doc=100, chars_in_all=20_000)
    assert len(got) == 50 and max(sum(map(len, v)) for v in got.values()) < 400 + 100
    starts = {t[:5] for v in got.values() for t in v}
    assert any(not t.startswith("aba ") for t in starts)  # stretches, not beginnings


def test_stage_keeps_clean_texts_and_clashing_columns(spark, documents):
    clean = "the thing and that of which we know the river and its old mill in the town"
    rows = [(1, clean, "en", 7, 8), (2, "xqzvkj wqpzx jjqxv zkqvw pqzzx vvkqj xzqpw kjvqz qxzvw " * 9, "en", 7, 8), (3, None, None, 7, 8), (4, "... 12", "en", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __found int, score int")
    kept = L.keep_known_languages(docs, L.learn(documents))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[0]]
