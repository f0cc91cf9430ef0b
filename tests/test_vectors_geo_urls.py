import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import geo, urls, vectors
from textloom.operators import annotate, embeddings, places, scoring, wmd

WORDS = [("en", "king", [1.0, 1.0, 0.0, 0.0]), ("en", "man", [1.0, 0.0, 0.0, 0.0]), ("en", "woman", [0.0, 0.0, 1.0, 0.0]), ("en", "queen", [0.0, 1.0, 1.0, 0.0]), ("en", "desk", [0.0, 0.0, 0.0, 1.0]), ("de", "frau", [0.0, 0.0, 1.0, 0.0])]


@pytest.fixture(scope="module")
def dictionary(spark):
    unit = [(lang, w, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for lang, w, v in WORDS]
    return embeddings.WordVectors(spark.createDataFrame(unit, "lang string, word string, vector array<float>"), ("en", "de"), "en", 4)


def test_dictionary(spark, dictionary, tmp_path):
    assert dictionary.vector("en", "KING") == pytest.approx([0.7071, 0.7071, 0, 0], abs=1e-4) and dictionary.vector("en", "zz") is None
    assert dictionary.exists("de", "frau") and not dictionary.exists("de", "king")
    with pytest.raises(ValueError):
        dictionary.vector("fr", "roi")
    assert [r.word for r in dictionary.analogy("en", ["king", "woman"], ["man"], 1).collect()] == ["queen"]
    assert dictionary.analogy("en", ["king"]).count() == 4
    assert dictionary.synonyms("en", "nope", 3).collect()[0][:] == ("", 0.0)
    assert "woman" not in [r.word for r in dictionary.synonyms("en", "woman", 5).collect()]
    assert [r.word for r in dictionary.synonyms("en", dictionary.vector("de", "frau"), 2).collect()] == ["woman", "queen"]
    docs = spark.createDataFrame([("en", ["King", "desk"]), ("de", None), ("de", ["Frau", "xx"])], "l string, w array<string>")
    small = dictionary.restricted_to([(docs, "l", "w")])
    assert {r.lang: r["count"] for r in small.cache_sizes().collect()} == {"en": 2, "de": 1}
    small.save(f"file://{tmp_path}/d")
    assert embeddings.load(spark, f"file://{tmp_path}/d", ("en", "de"), "en", 4).status() == "3 words in 2 languages"
    assert [r["index"] for r in dictionary.with_index().where("lang = 'en'").orderBy("word").collect()] == [0, 1, 2, 3, 4]
    looked = dictionary.lookup(spark.createDataFrame([("en", "Desk"), ("en", "zz")], "lang string, word string")).collect()
    assert {r.word: r.vector is not None for r in looked} == {"Desk": True, "zz": False}


def test_embedding_ways_agree(spark, dictionary):
    rows = [(1, "en", ["King", "man", "man", "zz"]), (2, "xx", ["queen"]), (3, "en", []), (4, None, ["man"]), (5, "en", None), (6, "de", ["frau"]), (6, "de", ["frau"])]
    docs = spark.createDataFrame(rows, "i int, l string, w array<string>")
    a = sorted(map(str, ((r.i, r.v and [round(x, 5) for x in r.v]) for r in dictionary.embed(docs, "l", "w", "v").collect())))
    b = sorted(map(str, ((r.i, r.v and [round(x, 5) for x in r.v]) for r in dictionary.embed(docs, "l", "w", "v", max_broadcast=0).collect())))
    assert a == b and len(a) == 7
    king = np.array([1, 1, 0, 0]) / math.sqrt(2) + np.array([2.0, 0, 0, 0])
    got = {r.i: r.v for r in dictionary.embed(docs, "l", "w", "v").collect()}
    assert got[1] == pytest.approx((king / np.linalg.norm(king)).tolist(), abs=1e-6) and got[3] == [0.0] * 4 and got[4] is None and got[5] is None


def test_distances_and_movers(spark, dictionary):
    a, b = [0.6, 0.8], [1.0, 0.0]
    one = spark.range(1).select(*[d(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias(n) for n, d in vectors.DISTANCES.items()]).first()
    want = {"euclidean": math.sqrt(0.8), "euclidean_normalized": math.sqrt(0.8), "cosine": 0.4, "cosine_normalized": 0.4, "tanimoto": 1 - 0.6 / 1.4, "tanimoto_normalized": 1 - 0.6 / 1.4}
    assert {n: pytest.approx(one[n]) for n in want} == want
    df = spark.createDataFrame([(1, [("king", 1), ("man", 1)]), (2, [("queen", 2), ("zz", 5)]), (3, [("desk", 1)]), (4, [("zz", 1)])], "i int, bag array<struct<_1:string,_2:int>>").withColumns({"l": F.lit("en"), "base": F.expr("array(named_struct('_1','king','_2',1))")})
    for kind in vectors.DISTANCES:
        got = {r.i: r.d for r in wmd.with_distance(df, dictionary.table, "base", "l", "bag", "l", "d", kind).collect()}
        assert got[4] == pytest.approx(wmd.FLOAT_MAX) and got[1] < got[2] < got[3] or kind.startswith("tan")
        look = lambda c: F.transform(c, lambda x: F.struct(x["_2"].alias("n"), F.try_element_at(F.create_map(*[y for _, w, v in WORDS[:5] for y in (F.lit(w), F.array(*[F.lit(z / math.sqrt(sum(q * q for q in v))) for z in v]))]), x["_1"]).alias("vector")))  # noqa: B023, E731
        native = {r.i: r.d for r in df.select("i", wmd.native_distance(look(F.col("base")), look(F.col("bag")), kind).alias("d")).collect()}
        assert native == pytest.approx(got, rel=2e-3, abs=2e-3)


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0, 49.0, "de", "en"), (None, 3.5, -1.0, "en", "en")], "a float, b float, c float, l string, q string")
    for how, want in (("max", [49.0, 3.5]), ("min", [1.0, -1.0]), ("sum", [52.0, 2.5]), ("mean", [np.float32(52 / 3), np.float32(2.5 / 3)])):
        assert [r.o for r in scoring.aggregate_columns(df, ["a", "b", "c"], "o", how).collect()] == pytest.approx(want)
    with pytest.raises(ValueError):
        scoring.aggregate_columns(df, ["a"], "b")
    w = scoring.weigh_columns(df.withColumn("w", F.expr("named_struct('_1', cast(2 as float), '_2', array(cast(3 as float), cast(1 as float)))")), ["a", "b", "c"], "w", "o")
    assert [r.o for r in w.collect()] == [2.5, 1.75]
    assert [r.s for r in df.select(vectors.boosted(F.col("b"), F.col("q"), F.col("l"), {"en": 1.5, "de": 9.0}).alias("s")).collect()] == [3.0, 3.5]
    pairs = scoring.score_pairs(spark.createDataFrame([([1.0, 0.0],)], "v array<double>"), spark.createDataFrame([([0.5, 9.0],)], "q array<double>"), "v", "q", "s")
    assert pairs.first().s == 0.5
    with pytest.raises(ValueError):
        scoring.score_pairs(pairs, spark.range(3), "v", "id", "x", max_queries=2)


def km(spark, *p):
    a, b = (geo.coordinates(F.lit(p[i]), F.lit(p[i + 1])) for i in (0, 2))
    return spark.range(1).select(geo.haversine_km(a, b)).first()[0]


@settings(max_examples=15, deadline=None)
@given(st.tuples(st.floats(-90, 90), st.floats(-180, 180), st.floats(-90, 90), st.floats(-180, 180)))
def test_haversine_laws(spark_once, p):
    d = km(spark_once, *p)
    assert 0 <= d <= 6371 * math.pi + 0.01 and d == pytest.approx(km(spark_once, p[2], p[3], p[0], p[1]), abs=0.01)


@pytest.fixture(scope="module")
def spark_once(spark):
    return spark


def test_places(spark):
    assert km(spark, 0.0, 0.0, 0.0, 180.0) == pytest.approx(6371 * math.pi, abs=0.01) and km(spark, 48.15, 17.11, 48.21, 16.37) == pytest.approx(55.3, abs=0.5)
    null = F.lit(None).cast("struct<latitude:double,longitude:double>")
    assert spark.range(1).select(geo.haversine_km(null, geo.coordinates(F.lit(1), F.lit(1)))).first()[0] == 100_000
    with pytest.raises(Exception, match="no base location"):
        spark.range(1).select(geo.min_distance_km(F.array().cast("array<struct<latitude:double,longitude:double>>"), geo.coordinates(F.lit(1), F.lit(1)))).collect()
    assert spark.range(1).select(geo.country_name(F.lit("de")), geo.country_name(F.lit("zz"))).first()[:] == ("Germany", None)
    gazetteer = spark.createDataFrame([("Graz", "AT", 47.0, 15.4), ("Paris", "FR", 48.8, 2.3)], "place string, country string, latitude double, longitude double")
    df = spark.createDataFrame([("graz", "AT"), ("Paris", "US"), (None, "FR")], "city string, land string")
    assert [(r.at.latitude, r.at.longitude) for r in places.fetch_coordinates(df, gazetteer, "city", "at", "land").collect()] == [(47.0, 15.4), (0.0, 0.0), (0.0, 0.0)]
    assert places.fetch_coordinates(df, gazetteer, "city", "at", "absent").where("city = 'Paris'").first()["at"].latitude == 48.8
    filled = places.fill_gazetteer([(df, "city", "land"), (df, "city", None)], gazetteer, lambda: lambda p, c: (1.0, 2.0) if c == "US" else None)
    assert {(r.place, r.country, r.latitude) for r in filled.collect()} == {("Graz", "AT", 47.0), ("Paris", "FR", 48.8), ("Paris", "US", 1.0), ("Paris", None, 0.0), ("graz", None, 0.0)}


GOOD = ["http://a.de", "https://www.some-site.co.uk/p?q=1#f", "ftp://x.yz/z", "http://me:pw@host.org:8080/", "http://8.8.4.4/x", "http://ñandú.cl/ü", "http://☂.net", "http://x.io/(a)_b"]
BAD = ["http://", "http://?", "http:// a.de", "a.de", "//b", "http://-x.de", "http://x-.de", "http://10.2.3.4", "http://127.0.0.1", "http://192.168.1.1", "http://172.20.0.1", "http://0.1.2.3", "http://224.0.0.9", "http://1.2.3", "http://12345", "http://.x.de", "ssh://a.de", "http://a.de/x y"]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in GOOD + BAD], "u string")
    assert {r.u for r in df.where(urls.is_valid_url(F.col("u"))).collect()} == set(GOOD)
    found = spark.createDataFrame([('see www.Uni.AT, <a href="https://x.org/A?b">y</a> mail no.nosuchtld ' + "." * 5000,), (None,)], "t string").select(urls.detect_urls(F.col("t"))).collect()
    assert found[0][0] == ["http://www.uni.at/", "https://x.org/A?b"] and found[1][0] == []
    hops = {"a": "b", "b": "c", "self": "self", **{f"n{i}": f"n{i + 1}" for i in range(30)}}
    calls = []

    def resolve(u):
        calls.append(u)
        if u == "down":
            raise OSError
        return hops.get(u)

    s = urls.Unshortener(resolve)
    assert s.expand("a") == ("a", "c", True, 2) and s.expand("self")[3] == 0 and s.expand("down")[2] is False and s.expand("n0")[3] == 11
    before = len(calls)
    assert s.expands("a") and len(calls) == before
    out = spark.createDataFrame([(["a", "down"],), (None,)], "u array<string>").select(urls.expand_urls(lambda: {"a": "b"}.get)("u").alias("e")).collect()
    assert [tuple(x) for x in out[0].e] == [("a", "b", True, 1), ("down", "down", True, 0)] and out[1].e is None


def test_annotators(spark):
    a = annotate.Annotators()
    assert a.closure(["lemma"]) == ["tokenize", "ssplit", "pos", "lemma"]
    with pytest.raises(ValueError):
        a.get("pos")
    a.register("pos", lambda t: ["X"] * len(annotate.tokenize(t)))
    a.register("lemma", lambda t: [w.lower() for w in annotate.tokenize(t)])
    a.check_order(["tokenize", "ssplit", "pos", "lemma"])
    with pytest.raises(ValueError):
        a.check_order(["pos"])
    p = annotate.LanguagePipelines(a, {"en": ["tokenize", "pos", "lemma"], "de": ["tokenize", "pos"]}, "en")
    df = spark.createDataFrame([("Dogs run.", "en"), ("Hunde laufen.", "de"), ("Chats!", "fr"), (None, "en")], "t string, l string")
    rows = p.transform(df, "t", "l", "t").collect()
    assert rows[0].t__lemma == ["dogs", "run", "."] and rows[1].t__lemma is None and rows[1].t__pos == ["X"] * 3 and rows[2].t__lemma == ["chats", "!"] and rows[3].t__pos is None
    assert p.local({"t": "A b", "l": "de"}, "t", "l", "t")["t__lemma"] is None
    assert df.select(a.udf("ssplit")("t")).first()[0] == ["Dogs run."] and annotate.clean_xml("<p>a &amp; b</p>") == ["a", "&", "b"]


def test_sums_of_long_lists_in_parts():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(50, 6)).astype(np.float32)
    index = {"a": {f"w{i}": i for i in range(40)}, "b": {f"w{i}": i + 10 for i in range(40)}}
    lists = [None, [], ["x", None], *[[f"w{i}" for i in rng.integers(0, 45, n)] for n in (1, 3, 400, 2, 90)]]
    codes = ["a", "b", "a", "a", "b", "a", None, "b"]
    for entries in (6, 60, 1 << 20):
        got = embeddings._sums(pa.array(codes), pa.array(lists, pa.list_(pa.string())), index, matrix, entries).to_pylist()
        for code, own, v in zip(codes, lists, got, strict=True):
            if code is None or own is None:
                assert v is None
                continue
            total = sum((matrix[index[code][w]].astype(float) for w in own if w in index[code]), np.zeros(6))
            assert np.allclose(v, total / (np.sqrt((total * total).sum()) or 1), atol=1e-6)


def test_embedding_keeps_clashing_columns(spark, dictionary):
    docs = spark.createDataFrame([(1, ["İstanbul", "x"], "en", 5, 6)], "i int, w array<string>, l string, _row int, total int")
    for limit in (1 << 30, 0):
        made = dictionary.embed(docs, "l", "w", "v", max_broadcast=limit)
        assert made.columns == [*docs.columns, "v"] and made.select("_row", "total").first()[:] == (5, 6)


def test_movers_shared_or_joined(spark, dictionary):
    rows = [(1, [("king", 1), ("man", 1)], [("king", 2)], "en", 7), (2, [("queen", 2), ("zz", 5)], [("man", 1), ("desk", 3)], "en", 7), (3, [("zz", 1)], [("king", 1)], "en", 7), (4, None, [("king", 1)], "en", 7), (5, [], [("king", 1)], "en", 7), (2, [("queen", 2), ("zz", 5)], [("man", 1), ("desk", 3)], "en", 7)]
    df = spark.createDataFrame(rows, "i int, bag array<struct<_1:string,_2:int>>, base array<struct<_1:string,_2:int>>, l string, row int")
    for kind in ("euclidean_normalized", "cosine"):
        shared, joined = (wmd.with_distance(df, dictionary.table, "base", "l", "bag", "l", "d", kind, n) for n in (1 << 30, 0))
        assert shared.columns == joined.columns
        a, b = (sorted((r.i, -1.0 if r.d is None else round(r.d, 4) if r.d < 1e9 else 1e9, r.row) for r in x.collect()) for x in (shared, joined))
        assert [x[::2] for x in a] == [x[::2] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], abs=1e-3)


def moved(df):
    """Rows that were shuffled to write ``df``."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.finalPhysicalPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_rare_words_are_joined(spark, dictionary):
    bytes_of_three = 3 * 4 * 4
    rows = [(i, "en", ["King", "man", "man", "woman"] + (["queen", "zz", "queen"] if i % 50 == 7 else [])) for i in range(300)] + [(300, None, ["man"]), (301, "de", None), (302, "de", ["Frau", "xx"]), (303, "en", [])]
    docs = spark.createDataFrame(rows, "i int, l string, w array<string>")
    small = lambda df, c: sorted(((r.i, r[c] and [round(x, 5) for x in r[c]]) for r in df.collect()), key=str)
    mixed = dictionary.embed(docs, "l", "w", "v", max_broadcast=bytes_of_three)
    assert small(mixed, "v") == small(dictionary.embed(docs, "l", "w", "v"), "v")
    assert moved(mixed.select("v")) < 2 * len(rows)
    bags = spark.createDataFrame([(i, "en", [(x.lower(), w.count(x)) for x in dict.fromkeys(w)], [("king", 2), ("desk", 1), ("nope", 1)]) for i, code, w in rows if code == "en"], "i int, l string, bag array<struct<_1:string,_2:int>>, base array<struct<_1:string,_2:int>>")
    shared, mixed = (wmd.with_distance(bags, dictionary.table, "base", "l", "bag", "l", "d", max_bytes=n) for n in (1 << 30, bytes_of_three))
    assert sorted((r.i, r.d) for r in mixed.collect()) == sorted((r.i, r.d) for r in shared.collect())
    assert moved(mixed.select("d")) < 4 * len(rows)


def test_pairs_of_many_queries_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "i int, v array<double>")
    queries = spark.createDataFrame([(j, [1.0, float(j)]) for j in range(23)], "share int, q array<double>")
    for limit in (100, 5):
        got = scoring.score_pairs(df, queries, "v", "q", "s", limit, 3)
        assert got.columns == ["i", "v", "share", "q", "s"] and sorted((r.i, r.share, r.s) for r in got.collect()) == [(i, j, float(i + j)) for i in range(40) for j in range(23)]


def test_rows_meet_many_queries_without_a_copy(spark):
    """As rows times queries, but packed: a row is shuffled once, whatever the number of queries, and not a digit differs."""
    odd = [None, [], [1.0, None, 3.0], [float("inf"), 2.0], [float("nan")], [0.1, 0.2, 0.3, 0.4], [-0.0, 1e300], [1e-300, None]]
    df = spark.createDataFrame([(i, odd[i] if i < len(odd) else [0.1 * i, 1 / (i + 1), 0.7]) for i in range(1300)], "i int, v array<double>")
    queries = spark.createDataFrame([(j, odd[j] if j < len(odd) else [0.3, 0.01 * j, -1.7 / (j + 1)]) for j in range(90)], "j int, q array<double>")
    want, got = (scoring.score_pairs(df, queries, "v", "q", "s", limit, 3) for limit in (100, 2))
    assert got.count() == 1300 * 90 and got.schema.simpleString() == want.schema.simpleString()
    key = lambda rows: sorted((r.i, r.j, str(r.v), str(r.q), str(r.s)) for r in rows.where("i < 40 or i % 97 = 0").collect())
    assert key(got) == key(want)
    for kind in ("array<float>", "array<int>", "array<decimal(9,3)>"):
        small = [f.where(f"{c} between 8 and 30").withColumn(x, F.col(x).cast(kind)).select(c, x) for f, c, x in ((df, "i", "v"), (queries, "j", "q"))]
        want, got = (sorted(map(str, scoring.score_pairs(*small, "v", "q", "s", limit, 3).collect())) for limit in (100, 2))
        assert got == want and len(want) == 23 * 23
    assert moved(scoring.score_pairs(df, queries, "v", "q", "s", 2, 3)) <= 1300 + 90
    want, got = (scoring.score_pairs(df.where("i > 1200"), queries.where("j > 80"), "v", "q", "i", limit, 3) for limit in (100, 2))
    assert got.columns == ["i", "v", "j", "q"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_pairs_are_summed_in_order(monkeypatch):
    """Matrix products decide all but a few scores, and these are equal to the sums in the vectors' order to the digit."""
    slow, in_order = [], scoring._in_order
    monkeypatch.setattr(scoring, "_in_order", lambda *x: slow.append((made := in_order(*x)).size) or made)
    g = np.random.default_rng(3)
    odd = [[0.0] * 5, [-0.0, 1e-200, -1e-160], [1e150, -1e150, 1e-320], [1e300, -1e300, 1.0], [math.inf, 0.0], [math.nan], [None, 1.0], [0.0, None], None, [], [0.1, -0.1, 1e-9], [3e38, 1.0], [1.0, 0.0, -1.0], [0.0, 1.0, 0.0], [-1e-45, 1e-23]]
    ints = [[float(x) for x in g.integers(-2, 3, 7)] for _ in range(40)]
    sets = {"plain": [[list(g.normal(size=64)) for _ in range(n)] for n in (200, 300)], "odd": [odd, odd + ints], "ints": [ints, ints]}
    for name, (rows, queries) in sets.items():
        slow.clear()
        got = scoring.tile_scores(pa.array(rows, pa.list_(pa.float64())), pa.array(queries, pa.list_(pa.float64()))).to_pylist()
        want = []
        with np.errstate(all="ignore"):
            for a in rows:
                for b in queries:
                    total = 0.0
                    for x, y in zip(a or (), b or (), strict=False):
                        total += 0.0 if x is None or y is None else x * y
                    want.append(None if a is None or b is None else float(np.float32(total)))
        assert list(map(str, got)) == list(map(str, want))  # signs of zeros too
        assert name != "plain" or sum(slow) < len(want) / 1000
        assert name != "ints" or 0 < sum(slow) < len(want)


def test_parts_of_rows_grow_with_the_queries(spark):
    df, queries = (spark.range(n).select(F.col("id").alias(c), F.array(F.col("id").cast("double")).alias(v)) for n, c, v in ((50, "i", "v"), (290, "j", "q")))
    got = scoring.score_pairs(df, queries, "v", "q", "s", 2, 1)
    assert got.rdd.getNumPartitions() == 10 and got.where("s = i * j").count() == 50 * 290


def test_rounding_is_sparks(spark):
    near = [x for n in (0, 1, 7, 499, 123_456, 10**9) for half in (0.0, 0.5) for x in ((n + half) / 1000, math.nextafter((n + half) / 1000, 2e9), math.nextafter((n + half) / 1000, -1.0))]
    xs = [*near, *(-x for x in near), *(float(np.float32(math.sin(i))) for i in range(3000)), 1e300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select(vectors.rounded(F.col("x"), 3).alias("a"), F.round("x", 3).alias("b")).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]
