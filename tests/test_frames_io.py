import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import config
from textloom.operators import frames
from textloom.sources import connectors, io, news


def test_shapes(spark):
    df = spark.sql("select 1 as id, named_struct('a', array(1), 'b', named_struct('c', 'x', 'd', null)) as s")
    assert frames.flatten(df).columns == ["id", "a", "c", "d"]
    assert frames.flatten(df, ("s", "b")).columns == ["c", "d"]
    assert frames.expand(df, "s").columns == ["id", "a", "b"]
    inverse = {}
    odd = spark.createDataFrame([(1, 2, 3)], ["k1", "k1.k1", "k2-k2"])
    clean = frames.sanitize_column_names(odd, "_", inverse)
    assert clean.columns == ["k1", "k1_k1", "k2_k2"] and inverse["k1_k1"] == "k1.k1"
    assert frames.prefix_column_names(clean, "p", ["k1"]).columns == ["k1", "p__k1_k1", "p__k2_k2"]
    assert frames.original_columns(spark.createDataFrame([(1, 2)], ["a", "a__b"])).columns == ["a"]


def test_nested_column(spark):
    df = spark.sql("select * from values (1, named_struct('x', 1)), (2, null) as t(id, s)")
    got = {r.id: r for r in frames.with_nested_column(frames.with_nested_column(df, "s.y.z", F.lit(5)), "n.m", F.col("id")).collect()}
    assert got[1].s.y.z == 5 and got[1].s.x == 1 and got[2].s is None and got[2].n.m == 2
    replaced = frames.with_nested_column(df, "s.x.w", F.lit("q")).where("id = 1").first()
    assert replaced.s.x.w == "q" and frames.with_nested_column(df, "k", F.lit(1)).columns[-1] == "k"


def test_arrays_nullability_and_zip(spark):
    df = spark.createDataFrame([(["a"], ["b"], [1])], "p array<string>, q array<string>, n array<int>")
    assert frames.merge_array_columns(df, "m", ["p", "q"], drop=True).first().m == ["a", "b"]
    for bad in (["p", "n"], ["absent"]):
        with pytest.raises(ValueError):
            frames.merge_array_columns(df, "m", bad)
    ints = spark.createDataFrame([(1,), (2,)], "i int")
    assert not frames.set_nullable(ints, False).schema["i"].nullable
    with pytest.raises(Exception, match="null in i"):
        frames.set_nullable(spark.createDataFrame([(None,)], "i int"), False).collect()
    left = spark.range(0, 100, 1, 7).select(F.col("id").alias("a"))
    right = spark.range(100, 200, 1, 3).select(F.col("id").alias("b"))
    assert all(r.b - r.a == 100 for r in frames.merge_dataframes([left, right]).collect())
    assert frames.empty_like(ints).schema == ints.schema and frames.limit_if_nonzero(ints, 1).count() == 1 and frames.limit_if_nonzero(ints, 0).count() == 2


def test_driver_side(spark, monkeypatch, capsys):
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    assert frames.to_json_string(df) == '[{"i":1,"s":"x"}]' and frames.to_dicts(df) == [{"i": 1, "s": "x"}]
    monkeypatch.setenv("DEBUGGING", "true")
    assert frames.debug_show(df) is df and "x" in capsys.readouterr().out
    source = frames.schema_to_dataclass(T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.ArrayType(T.StringType()), True), T.StructField("c", T.StructType([T.StructField("d", T.DateType())]))]), "Row")
    space = {}
    exec("from __future__ import annotations\nfrom dataclasses import dataclass\n" + source, space)
    assert space["Row"](a=1).b is None and "class RowC" in source
    with pytest.raises(ValueError):
        frames.require_type(df.schema, "i", T.StringType())
    frames.require_type(T.StructType([T.StructField("v", T.ArrayType(T.FloatType(), True))]), "v", T.ArrayType(T.FloatType(), False))


def test_inferred_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1, 2]}}',), ('{"a": 2, "d": "x"}',), (None,)], "j string")
    got = frames.from_inferred_json(df, "j", "p").select("p.*").collect()
    assert got[0].b.c == [1, 2] and got[1].d == "x" and got[1].a == 2


def test_data_root(spark, tmp_path):
    root = io.DataRoot(spark, f"file://{tmp_path}/data")
    df = spark.createDataFrame([(1, 'say "x"\nnew'), (2, None)], "i int, s string")
    root.write_csv(df, "t")
    assert root.read_csv("t.csv").count() == 2
    root.write_frame(df, "t")
    root.overwrite_frame("t", lambda d: d.where("i = 1"))
    assert root.read_frame("t").count() == 1 and root.exists("t.parquet")
    assert root.copy_snapshot("t.parquet", "v1").endswith(".snapshots/t.parquet/v1") and root.exists(".snapshots/t.parquet/v1")
    assert root.delete_frame("t") is True and root.delete_frame("t") is False
    assert io.list_directory(str(tmp_path / "absent")) == io.DirectoryContent((), ())
    io.write_text(str(tmp_path / "a.txt"), "one\ntwo")
    io.print_to_file(str(tmp_path / "b.txt"), lambda f: print("hi", file=f))
    assert io.first_line(str(tmp_path / "a.txt")) == "one" and io.first_line(str(tmp_path / "b.txt")) == "hi"


def test_messages(spark, tmp_path):
    for name in ("by-train", "by-test"):
        (tmp_path / name / "sci.x").mkdir(parents=True)
        (tmp_path / name / "sci.x" / "17").write_bytes("Köln".encode("iso-8859-1"))
    sets = news.read_datasets(spark, f"file://{tmp_path}", ("by-train", "by-test"))
    train, test = news.train_and_test(sets)
    assert [tuple(r) for r in train.collect()] == [("sci.x", "17", "Köln")] and test.count() == 1
    news.convert_to_parquet(spark, f"file://{tmp_path}", f"file://{tmp_path}/out", ("by-test",), partitions=2)
    assert spark.read.parquet(f"file://{tmp_path}/out/by-test.parquet").count() == 1


def test_connector_options():
    m = connectors.MongoSettings("h", "db", user="u@x", password="p/w", auth_source="admin")
    assert m.uri("c") == "mongodb://u%40x:p%2Fw@h:27017/db.c?authSource=admin"
    assert connectors.MongoSettings("h", "db", user="u").uri("c") == "mongodb://h:27017/db.c"
    assert connectors.kafka_read_options("b", "t")["failOnDataLoss"] == "false"
    assert connectors.kafka_write_options("b", "t", "c")["checkpointLocation"] == "c"
    assert connectors.cassandra_options("h", "u", "p")["spark.cassandra.auth.username"] == "u" and connectors.elasticsearch_options("n")["es.port"] == "9200"
    assert config.SessionSettings(cassandra_host="h", elasticsearch_nodes="e").options()["es.nodes"] == "e"
