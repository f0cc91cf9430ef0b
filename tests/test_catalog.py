"""Every registered query against its SQL on the smallest tables, and the plans of the ones that matter most."""

import duckdb
import pytest

from textloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(table):
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names], strict=True)
    return names, sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, engine, name):
    got = plain(catalog.queries()[name](spark, sf).toArrow())
    assert got == plain(engine.execute(catalog.oracle_sql()[name]).to_arrow_table())


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    compacted = plan(catalog.es_latest(spark, sf))
    assert compacted.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in compacted and "Join" not in compacted
    assert "TakeOrderedAndProject" in plan(catalog.similarity_top_k(spark, sf))
    tokens = plan(catalog.tokens(spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in tokens and "Python" not in tokens and "Exchange" not in tokens
    assert "Python" not in plan(catalog.lang_detect(spark, sf)) and "PushedFilters: [IsNotNull(vec_id), Not(EqualTo(vec_id,0))]" in plan(catalog.similarity_top_k(spark, sf))


def test_bags_and_acronyms_of_all_texts(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    texts = read("documents").count() + read("conversations").count() + read("pages").count()
    assert catalog.queries()["clean_text_acronyms_all"](spark, sf).select("id").distinct().count() == texts
    want = {r.doc_id for r in catalog.tokens(spark, sf).where("n > 0").collect()}
    assert {r.doc_id for r in catalog.queries()["bag_of_words_documents"](spark, sf).select("doc_id").distinct().collect()} == want


def test_every_page_is_expanded(spark, sf):
    small = sf.replace("0.001", "0.01")
    ids = [r.page_id for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id").collect()]
    assert max(ids) >= 200
    hops = {f"u{i}": f"u{i + 1}" for i in ids if i % 7 != 6}
    want = []
    for i in ids:
        now, n = f"u{i}", 0
        while now in hops and n < 11:
            now, n = hops[now], n + 1
        want.append((f"u{i}", now, n))
    assert sorted(tuple(r) for r in catalog.url_redirects(spark, small).select("orig", "final", "hops").collect()) == sorted(want)


def test_the_vocabulary_of_a_cache_is_written_once(spark, sf):
    from textloom import config

    made = config._MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    catalog.queries()["dictionary_cache"](spark, sf)
    assert sum("/used-" in path for path in made[before:]) == 1
