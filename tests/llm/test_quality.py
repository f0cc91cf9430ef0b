import zlib

import numpy as np
import pytest

from textloom.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark, sf):
    big = sf.replace("0.001", "0.01")
    return spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")


def crc(i):
    return zlib.crc32(str(i).encode())


def test_moments_and_densities_by_brute_force(spark, tables):
    docs, labels = tables
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if crc(r.doc_id) % 5]
    x = {c: Q.statistics([texts[i] for i, q in known if q == c]) for c in (0, 1)}
    n = {c: len(v) for c, v in x.items()}
    covs = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = sum(n[c] * covs[c] for c in x) / sum(n.values())

    def density(c, row):
        cov = (1 - Q.TO_POOLED) * covs[c] + Q.TO_POOLED * pooled
        cov = (1 - Q.TO_DIAGONAL) * cov + Q.TO_DIAGONAL * np.diag(np.diag(cov)) + Q.FLOOR * np.eye(Q.D)
        d = row - x[c].mean(axis=0)
        return -0.5 * (d @ np.linalg.solve(cov, d)) - 0.5 * np.linalg.slogdet(cov)[1]

    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert len(got) == len(texts)
    prior = np.log(n[1] / n[0])
    for i, text in list(texts.items())[:150]:
        row = Q.statistics([text])[0]
        want = 1 / (1 + np.exp(-np.clip(Q.TEMPER * (density(1, row) - density(0, row)) + prior, -60, 60)))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (crc(i) % 5 == 0)


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r.predicted for r in Q.score_documents(docs, labels).where("held_out").collect()}
    pairs = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got]
    assert np.mean([a == b for a, b in pairs]) >= 0.95 and len(pairs) > 50


def test_statistics():
    x = Q.statistics([None, "", "One two, two.\nOne two, two.", "A" * 100, "é\ud800", "\n\n  "])
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    row = dict(zip(Q.NAMES, x[2]))
    assert row["words"] == pytest.approx(np.log1p(6)) and row["double_line"] == pytest.approx(np.arcsin(np.sqrt(0.5)))


def test_edges_and_stage(spark, tables):
    docs, labels = tables
    own = spark.createDataFrame([(None, "a b", "x", 1), (1, None, "x", 1), (1, None, "x", 1), (2, "", "x", 1)], "doc_id long, text string, score string, x int")
    kind = "doc_id long, quality int, toxic int, x string"
    none = spark.createDataFrame([], kind)
    assert [r.score for r in Q.score_documents(own, none).collect()] == [0.5] * 4
    one_class = spark.createDataFrame([(2, 1, 0, "q"), (None, 0, 0, "q"), (1, None, 0, "q")], kind)
    assert {r.score for r in Q.score_documents(own, one_class).collect()} <= {1.0, 0.5}
    assert Q.score_documents(own.limit(0), labels).count() == 0
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(good & ids) >= 0.98 * len(good) and len(bad & ids) <= 0.05 * len(bad)
    assert Q.keep_good(own, none).columns == own.columns


def test_stage_keeps_clashing_columns_and_long_texts(spark, tables):
    docs, labels = tables
    wide = docs.selectExpr("*", "0.25D as __score", "'mine' as statistics", "7 as x", "doc_id as quality").limit(200)
    wide = wide.unionByName(wide.limit(1).selectExpr("cast(null as long) as doc_id", "repeat(text || ' and the rest of it. ', 3000) as text", "lang", "source", "n_chars", "__score", "statistics", "x", "quality"))
    kept = Q.keep_good(wide, labels)
    assert kept.columns == wide.columns
    rows = kept.collect()
    assert rows and {(r["__score"], r.statistics, r.x) for r in rows} == {(0.25, "mine", 7)}
    scores = {r.doc_id: r.predicted for r in Q.score_documents(wide, labels).collect()}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, p in scores.items() if p)
