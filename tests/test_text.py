import random

import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import language, text, translit
from textloom.operators import text as ops
from textloom.plans.pipeline import local_clean, local_language

RULE_CASES = [
    ("go to http://a.b/c?d=e now", "go to  now", "links"),
    ("a \n\r\n  b\tc", "a b\tc", "blanks"),
    ("a_b__c", "a b c", "underscores"),
    ("end.Then 2.B a.b", "end. Then 2. B a.b", "full_stop"),
    ("a;b c:d e)f g:/h", "a; b c: d e) f g:/h", "after_mark"),
    ("see(this) (that)", "see (this) (that)", "before_bracket"),
    ("1,25 x 1,250", "1.25 x 1,250", "decimal_comma"),
    ("12.345 1.25", "12,345 1.25", "thousands_dot"),
    ("a,1", "a, 1", "comma_letter_digit"),
    ("1,a", "1, a", "comma_digit_letter"),
    ("a,b", "a, b", "comma_letters"),
    ("“a”™®\"", "a", "marks"),
    ("a-b–c—d", "a b c d", "dashes"),
    ("a/b //c d/", "a b //c d ", "slash"),
    ("it´s ‘x’", "it's 'x'", "apostrophes"),
    ("(ii) (i) (777) (ab)", ".  (i) .  (ab)", "list_numbers"),
]


@pytest.mark.parametrize(("dirty", "clean", "rule"), RULE_CASES)
def test_each_rule(spark, dirty, clean, rule):
    skip = [n for n, _, _ in text.RULES if n != rule]
    got = spark.range(1).select(text.apply_rules(F.lit(dirty), skip=skip)).first()[0]
    assert got == clean


DIRTY = ["One car,two 3..9K,and vans:fast.  So.\n\n\nYour name is Bo;", "Bikes(only old bikes)yet fine.", "siete bravi\n\r\r\n già,ma\r\r\n no,250,000 euro", "price 25.000,75 now 0,15.", "well(jjj)well (22) (j) top_line top___line", "UI and IT. CRM", "I use IT/HR now", "ALL ITS CAPS", "\tIT\tworks,HR\t", "\tCI$ x", "IT IT", None, "", "123 IT"]


def test_clean_text_on_frames_and_rows(spark):
    table = text.builtin_acronyms()
    assert len(table) == 31 and table["CRM"] == "Customer Relationship Management"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(DIRTY)], "i int, text string")
    got = [r.c for r in ops.with_clean_text(df, "text", "c", table).orderBy("i").collect()]
    assert got == [local_clean(t, table) for t in DIRTY]
    assert got[0] == "One car, two 3..9K, and vans: fast. So. Your name is Bo;"
    assert got[5:9] == ["User Interface and Information Technology. Customer Relationship Management", "I use Information Technology Human Resources now", "ALL ITS CAPS", "\tInformation Technology\tworks, Human Resources\t"]
    assert got[9] == "\tContinuous Integration$ x" and got[10] == "IT IT" and got[13] == "123 IT" and got[11] is None
    one = ops.with_clean_text(spark.createDataFrame([("the IT IT",)], "text string"), "text", "c", table).first().c
    assert one == "the Information Technology IT"  # separators are consumed


def test_quick_forms_of_rules_give_the_same(spark):
    """The forms that begin with a sign against the plain ones, on texts where matches touch; a text isn't scanned to learn whether to scan it."""
    pick = random.Random(5)
    alphabets = [["a", ",", "1", "𝒶"], ["1", "2", ",", ".", "3"], ["(", "a", " ", ")"], [":", ";", ")", "x", " ", "/"], ["/", "a", "\n"], ["a", ".", "A", "1", "𝒶", "𝒜"], list("abAÉé123,.;:)( /_\n\r-´中\t") + ["𝒶", "😀"]]
    df = spark.createDataFrame([("".join(pick.choices(a, k=pick.randint(1, 12))),) for a in alphabets for _ in range(1500)], "x string")
    for name, pattern, new in text.RULES:
        if name in text.FAST and not name.startswith("comma_"):
            rows = df.select("x", F.regexp_replace("x", pattern, new).alias("want"), text.guarded_rule(F.col("x"), name, pattern, new).alias("got")).collect()
            assert [r for r in rows if r.want != r.got] == [], name
    made = ops.with_clean_text(df.withColumn("want", text.apply_rules(F.col("x"))), "x", "got")
    assert [r for r in made.collect() if r.want != r.got] == []
    plan = ops.with_clean_text(df, "x", "got")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


def test_tokens_stop_words_and_bags(spark):
    df = spark.createDataFrame([("Das Haus und Ärger x1", "de"), ("a the Ab ab ab", "xx"), (None, "en"), ("the end", None)], "t string, l string")
    toks = text.tokens(F.col("t"))
    lists = text.stop_word_map(["de", "en", "zz"])
    rows = df.select(toks.alias("k"), text.remove_stop_words(toks, F.col("l"), lists, "en").alias("w"), text.bag_of_words(toks).alias("b"), text.word_count(F.col("t")).alias("n")).collect()
    assert rows[0].k == ["Das", "Haus", "und", "Ärger", "x1"] and rows[0].w == ["Haus", "Ärger", "x1"]
    assert rows[1].w == ["Ab", "ab", "ab"] and [tuple(x) for x in rows[1].b] == [("the", 1), ("Ab", 1), ("ab", 2)]
    assert rows[2].k is None and rows[2].w is None and rows[3].w is None
    assert rows[1].n == 5 and spark.range(1).select(text.word_count(F.lit("")), text.word_count(F.lit("  "))).first()[:] == (1, 0)
    assert len(text.stop_word_map(text.STOP_WORD_LANGUAGES)) == 14
    with pytest.raises(ValueError):
        text.remove_stop_words(toks, F.col("l"), lists, "it")


def test_stop_words_are_sparks_own(spark):
    from pyspark.ml.feature import StopWordsRemover

    for code, name in text.STOP_WORD_LANGUAGES.items():
        assert set(text.stop_words(code)) == set(StopWordsRemover.loadDefaultStopWords(name)), code


def test_acronyms(spark, tmp_path):
    docs = spark.createDataFrame([("t1", "en", ["IT", "is", "HR", "IT"]), ("t2", "de", ["IT", "A1"]), ("t3", "de", ["x"])], "text string, language string, words array<string>")
    inventory = ops.acronym_inventory(ops.detect_acronyms([(docs, "text", "language", "words")]))
    assert [(r.acronym, r.languages, r.texts, r.expansion) for r in ops.stringify_inventory(inventory).collect()] == [("IT", "de ||| en", "t1 ||| t2", ""), ("HR", "en", "t1", "")]
    from textloom.sources.io import DataRoot

    io = DataRoot(spark, f"file://{tmp_path}")
    io.write_csv(spark.createDataFrame([("AB", "alpha-beta gaMma")], "acronym string, expansion string"), "acr")
    ops.acronym_csv_to_parquet(io, "acr.csv", "acronyms")
    assert ops.load_acronyms(io) == {"AB": "Alpha Beta GaMma"} and ops.load_acronyms()["EU"] == "European Union"


def test_language(spark):
    rows = [("Das ist nicht so wie der andere", "de"), ("this is what they have", "en"), ("quello che non ho mai detto", "it"), ("שלום עולם", "he"), ("Καλημέρα κόσμε", "el"), (None, "en"), ("", "en"), ("zzz", "en"), ("test " * 100_000, "en")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = [r.l for r in df.select("i", language.detect_language(F.col("t"), config.SUPPORTED_LANGUAGES, "en").alias("l")).orderBy("i").collect()]
    assert got == [c for _, c in rows]
    assert [local_language(t, config.SUPPORTED_LANGUAGES, "en") for t, _ in rows[:8]] == got[:8]
    assert len(config.supported_languages()) == 30


def test_normalize_and_transliterate(spark):
    assert text.normalize_also_signs("ÄÖÅçé ß Ø & (x)'s__y--") == "aoace-ss-o-x-y"
    assert text.normalize_also_signs("b'sB((  %$ & c---") == "bb-c"
    assert text.normalize(" Écoute ") == "ecoute" and text.clean_string(" AB ") == "ab"
    assert translit.remove_emoji("hi 💪🏿 x") == "hi      x"
    assert translit.any_to_ascii("Привет Ünï").lower() == "privet uni"
    assert "Latin-ASCII" in translit.conversion_ids()
    run = translit.transliterator(spark, "Emoji-Remover; Any-Latin; Latin-ASCII")
    got = [r[0] for r in spark.createDataFrame([("Москва 😀",), (None,), ("plain",)], "t string").select(run("t")).collect()]
    assert got == ["Moskva   ", None, "plain"]
    df = spark.createDataFrame([("Été",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalizer("normalize")("t")).collect()] == ["ete", None]


def test_string_to_map(monkeypatch):
    assert config.string_to_map("a,1;b;c,x;d,2", int) == {"a": 1, "d": 2}
    monkeypatch.setenv("DEFAULT_OTHER_LANGUAGE_BOOSTS", "fr,1.5")
    assert config.default_boosts() == {"fr": 1.5}


def test_transliteration_beside_neighbours_is_icus(spark):
    """Scripts whose letters change beside one another, against the library itself."""
    texts = ["人人生而自由", "A人b。人", "日本語の文章です。", "きゃりーぱみゅぱみゅ", "カード ッタ がっこう コンピューター", "αυτός γγ Ευρώπη Αύριο μπορώ", "Привет объект ещё", "नमस्ते दुनिया हिन्दी भाषा", "السلام عليكم", "שלום עולם", "ქართული", "Բարեւ ուր", "straße ÀÉ"]
    for kind in ("Any-Latin", translit.ANY_LATIN_ASCII):
        icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(kind)
        own = [t for t in texts if "。" not in t or kind != "Any-Latin"]  # that keeps an ideographic stop at the end only
        assert [translit.transliterate_string(t, kind) for t in own] == [icu.transliterate(t) for t in own]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(translit.transliterator(spark)("t").alias("a")).collect()
    assert sorted(r.a for r in got) == sorted(map(translit.any_to_ascii, texts))


def test_bags_are_counted_without_python_objects():
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    from textloom.functions.text import word_counts

    own = [None, [], ["b", None, "a", "b", None]] + [[f"w{(i * j) % 977}" for j in range(1000)] for i in range(300)]
    lists = pa.array([["cut off"], *own], pa.list_(pa.string())).slice(1)
    for entries in (1, 1 << 14):
        assert word_counts(lists, entries).to_pylist() == [None if x is None else [{"_1": w, "_2": n} for w, n in Counter(x).items()] for x in own]
    tracemalloc.start()
    word_counts(lists, 1 << 14)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_values_become_objects_some_at_a_time():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    from textloom.functions.text import piecewise

    texts = pa.array(["cut off", None, *["x" * 2000] * 20_000]).slice(1)
    tracemalloc.start()
    got = piecewise(lambda t: t[::-1] + "y", T.StringType())(texts)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
    assert got[0].as_py() is None and got[1].as_py() == "x" * 2000 + "y" and len(got) == 20_001
    assert piecewise(lambda n: n / 2, T.LongType())(pa.array([4, None, 5])).to_pylist() == [2, None, 2]
    assert piecewise(lambda n: n + 1, T.LongType())(pa.array([2**53, None])).to_pylist() == [2**53 + 1, None]


def test_annotators_take_a_batch_in_pieces(spark):
    from textloom.operators import annotate

    plans = annotate.LanguagePipelines(annotate.Annotators(), {"en": ["tokenize"], "de": ["tokenize", "ssplit"]}, "en")
    df = spark.range(700, numPartitions=1).selectExpr("id", "if(id % 7 = 0, null, concat('a b. c', id)) as t", "if(id % 2 = 0, 'de', 'xx') as l")
    made = plans.transform(df, "t", "l", "t")
    for r in made.collect():
        want = (None, None) if r.id % 7 == 0 else (annotate.tokenize(r.t), annotate.split_sentences(r.t) if r.id % 2 == 0 else None)
        assert (r.t__corenlpTokens, r.t__sentences) == want
