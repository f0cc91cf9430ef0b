import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.embeddings import WordVectors
from textloom.plans import columns as C
from textloom.plans import pipeline as P


def test_names():
    t = C.TextColumns("title")
    assert (t.language, t.bag, t.annotated_tokens) == ("title__language", "title__nBOW", "title__corenlpTokens")
    pair = C.SimilarityColumns(C.TextColumns("q"), t)
    assert pair.score == "q__vector__score__title__vector"
    place = C.LocationColumns("city", "land")
    assert place.score == "{city}__score" and C.LocationColumns("city", compat=False).score == "city__score"
    d = C.DistanceColumns(place, C.LocationColumns("town"))
    assert (d.distance, d.factor, d.score) == ("city__distance__town", "city__distanceFactor__town", "city__score__town")
    assert C.AggregatedColumns("S", (pair, d)).weights == "q__vector__score__title__vector__city__score__town__linearWeights"
    assert C.UrlColumns("u").expanded == "u__expanded"
    with pytest.raises(AttributeError):
        _ = t.nonsense


def matching():
    job, person, role = C.TextColumns("job"), C.TextColumns("person"), C.TextColumns("role")
    pairs = [C.SimilarityColumns(person, job), C.SimilarityColumns(role, job)]
    titles = C.AggregatedColumns("titles", tuple(pairs))
    far = C.DistanceColumns(C.LocationColumns("office"), C.LocationColumns("home", "land"))
    total = C.AggregatedColumns("total", (far, titles))
    inputs = [P.PipelineInput(pairs, P.TEXT_SCORING), P.PipelineInput([titles], ("ColumnAggregatorMax",)), P.PipelineInput([far], P.DISTANCE_SCORING), P.PipelineInput([total], ("LinearWeigher",))]
    return pairs, far, total, P.build(inputs)


def test_required_columns():
    pairs, far, total, pipe = matching()
    provided = [c for p in pairs for c in (p.base.vector, p.base.language)]
    loose = P.required_columns(["x"], provided, pipe.stages, strict=False)
    assert set(loose) == {"x", "job__vector", "job__language", "office__coords", total.weights}
    assert set(P.required_columns(["x"], provided, pipe.stages)) == {*loose, "home__coords", far.factor}
    assert [s.name for s in pipe.stages] == ["SimilarityScorer"] * 2 + ["OtherLanguageBooster"] * 2 + ["ColumnAggregatorMax", "DistanceCalculator", "DistanceScorer", "LinearWeigher"]


def test_matching_runs(spark):
    pairs, far, total, pipe = matching()
    names = {"person__vector": [1.0, 0.0], "role__vector": [0.0, 1.0], "job__vector": [0.6, 0.8]}
    df = spark.range(1).withColumns({n: F.array(*[F.lit(x).cast("float") for x in v]) for n, v in names.items()})
    df = df.withColumns({"person__language": F.lit("en"), "role__language": F.lit("en"), "job__language": F.lit("de"), "office__coords": F.expr("named_struct('latitude', 48.1D, 'longitude', 17.1D)"), "home__coords": F.expr("named_struct('latitude', 48.2D, 'longitude', 16.4D)"), far.factor: F.lit(0.001)})
    df = df.withColumn(total.weights, F.expr("named_struct('_1', cast(2 as float), '_2', array(cast(1 as float), cast(1 as float)))"))
    row = pipe.transform(df).first()
    assert row["titles"] == pytest.approx(0.88, abs=1e-5) and row["total"] == pytest.approx((0.88 + row[far.score]) / 2, abs=1e-5)
    with pytest.raises(ValueError, match="exists"):
        pipe.transform(df.withColumn("titles", F.lit(1)))
    with pytest.raises(ValueError, match="no columns"):
        pipe.transform(df.drop("job__vector"))
    with pytest.raises(ValueError, match="no stages"):
        P.build([P.PipelineInput([], ("Nope",))])


def test_preprocessing_on_frames_and_rows(spark):
    table = spark.createDataFrame([("en", "car", [1.0, 0.0]), ("en", "bike", [0.0, 1.0]), ("de", "rad", [0.0, 1.0])], "lang string, word string, vector array<float>")
    settings = P.Settings(dictionary=WordVectors(table, ("en", "de"), "en", 2))
    t = C.TextColumns("t")
    pipe = P.build([P.PipelineInput([t], (*P.TEXT_PREPROCESSING, "NormalizedBagOfWords"))], settings)
    rows = [{"t": "This is the car-bike of the IT people"}, {"t": "Das ist nicht das Rad und nicht mehr"}]
    local = pipe.fit(rows).transform(rows)
    frame = [r.asDict(recursive=True) for r in pipe.transform(spark.createDataFrame([(r["t"],) for r in rows], "t string")).collect()]
    for a, b in zip(local, frame):
        assert a[t.language] == b[t.language] and a[t.words] == b[t.words] and a[t.clean] == b[t.clean]
        assert a[t.vector] == pytest.approx(b[t.vector], abs=1e-6) and [tuple(x.values()) for x in b[t.bag]] == a[t.bag]
    assert local[1][t.language] == "de" and local[1][t.vector] == [0.0, 1.0] and "Information" in local[0][t.words]
    assert pipe.added == [t.language, t.clean, t.tokens, t.words, t.vector, t.bag]
    with pytest.raises(ValueError, match="local form"):
        P.build([P.PipelineInput([C.UrlColumns("t")], ("URLDetector",))]).fit(rows)


def test_url_places_and_own_stages(spark):
    u = C.UrlColumns("t")
    settings = P.Settings(url_resolver=lambda: {"http://a.de/": "http://b.de/"}.get)
    out = P.build([P.PipelineInput([u], ("URLAllLatin", "URLDetector", "URLValidator", "URLExpander"))], settings).transform(spark.createDataFrame([("👍 A.de und é",)], "t string")).first()
    assert out[u.urls] == ["http://a.de/"] and out[u.valid] == out[u.urls] and out[u.expanded][0].finalUrl == "http://b.de/"
    double = P.udf_stage("Double", "n", "m", lambda x: x * 2, T.LongType())
    pipe = P.Pipeline([double, P.word_count_stage(C.TextColumns("t"))])
    assert pipe.transform(spark.createDataFrame([(3, "a b ")], "n long, t string")).first()[:] == (3, "a b ", 6, 2)
    assert pipe.fit([]).transform([{"n": 3, "t": "a b "}]) == [{"n": 3, "t": "a b ", "m": 6, "t__score": 2}]
    gaz = spark.createDataFrame([("Bern", None, 46.9, 7.4)], "place string, country string, latitude double, longitude double")
    loc = C.LocationColumns("c")
    assert P.build([P.PipelineInput([loc], ("CoordinatesFetcher",))], P.Settings(gazetteer=gaz)).transform(spark.createDataFrame([("bern",)], "c string")).first()[loc.coordinates].latitude == 46.9
    from textloom.operators.frames import transform_with

    assert transform_with(spark.range(1).withColumn("n", F.lit(1).cast("long")), P.Pipeline([double])).first().m == 2
