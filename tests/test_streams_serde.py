import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources import avro, registry, serde
from textloom.streaming import multi, topics, windows

RECORD = {"type": "record", "name": "r", "fields": [{"name": "s", "type": ["null", "string"]}, {"name": "n", "type": "long"}, {"name": "d", "type": "double"}, {"name": "b", "type": "boolean"}, {"name": "a", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "string"}}, {"name": "x", "type": {"type": "record", "name": "i", "fields": [{"name": "y", "type": "bytes"}]}}]}
VALUES = st.fixed_dictionaries({"s": st.none() | st.text(), "n": st.integers(-(2**63), 2**63 - 1), "d": st.floats(allow_nan=False), "b": st.booleans(), "a": st.lists(st.integers(-(2**31), 2**31 - 1)), "m": st.dictionaries(st.text(), st.text()), "x": st.fixed_dictionaries({"y": st.binary()})})


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_avro_round_trip(value):
    raw = avro.encode(RECORD, value)
    assert avro.decode(RECORD, raw) == (value, len(raw))


def test_avro_bytes_by_hand():
    assert avro.encode("long", -65) == b"\x81\x01" and avro.encode("string", "foo") == b"\x06foo"
    assert avro.decode({"type": "array", "items": "long"}, b"\x03\x04\x02\x04\x00")[0] == [1, 2]  # a block with its size
    with pytest.raises(ValueError):
        avro.encode("long", None)


def test_confluent_frames(spark, tmp_path):
    reg = registry.FileRegistry(str(tmp_path / "r.json"))
    df = spark.createDataFrame([("a", 1), ("b", None)], "f1 string, f2 long")
    first = avro.to_confluent_avro(df, reg, "t-value", "value")
    assert first.columns == ["value"] and first.first()[0][:5] == b"\0" + struct.pack(">i", reg.id_of("t-value"))
    assert [tuple(r[0]) for r in first.select(avro.from_confluent_avro(F.col("value"), reg, "t-value")).collect()] == [("a", 1), ("b", None)]
    old = json.loads(json.dumps(reg.schema("t-value")))
    new = old | {"fields": [*old["fields"], {"name": "f3", "type": ["string", "null"], "default": "d"}]}
    reg.register("t-value", new)
    assert [tuple(r[0]) for r in first.select(avro.from_confluent_avro(F.col("value"), reg, "t-value")).collect()] == [("a", 1, "d"), ("b", None, "d")]
    with pytest.raises(avro.IncompatibleSchema):
        avro.to_confluent_avro(df, reg, "t-value", "value")
    with pytest.raises(ValueError):
        avro.to_confluent_avro(df, reg, "u-value", "value", register=False)
    assert registry.FileRegistry(str(tmp_path / "r.json")).schema("t-value") == new
    assert spark.range(1).select(avro.schema_id(F.lit(bytearray(b"\0\0\0\x04\xd2x")))).first()[0] == 1234


def test_serialize_both_ways(spark):
    df = spark.createDataFrame([("k", 1, 2.5)], "id string, n long, x double")
    plain = serde.serialize(df, "t", key_columns=["id"])
    assert plain.first().asDict() == {"key": '{"id":"k"}', "value": '{"n":1,"x":2.5}'}
    back = serde.deserialize(plain, "t", schemas=None)
    assert back.first().value.n == 1 and back.first().key == '{"id":"k"}'
    reg = registry.FileRegistry()
    framed = serde.serialize(df, "t", reg, key_columns=["id"])
    row = serde.deserialize(framed, "t", reg).first()
    assert row.key.id == "k" and row.value.x == 2.5


def publish(spark, transport, rows):
    df = spark.createDataFrame(rows, "key string, v string")
    transport.publish(df.select("key", F.col("v").alias("value")), "things")


def test_event_sourcing_waves(spark, tmp_path):
    transport = topics.FileTransport(f"file://{tmp_path}/in")
    schema = T.StructType([T.StructField("f1", T.StringType()), T.StructField("f2", T.LongType())])
    table = topics.TopicTables.of(spark, transport, f"file://{tmp_path}/sink", [topics.TableSettings("things", "things", entity_key=lambda df: topics.split_string_key(F.col("key")), schemas={"value": schema}, post_process=lambda df: df.orderBy("f1"))], refresh_seconds=0)
    value = lambda a, b: json.dumps({"f1": a, "f2": b})

    def state():
        table.process_available()
        return [tuple(r) for r in table["things"].collect()]

    publish(spark, transport, [("s.a.1", value("one", 1)), ("s.b.1", value("two", 2)), ("s.c.1", value("three", 3))])
    assert state() == [("one", 1), ("three", 3), ("two", 2)]
    publish(spark, transport, [("s.b.2", value("TWO", 22))])
    assert state() == [("TWO", 22), ("one", 1), ("three", 3)]
    publish(spark, transport, [("s.a.3", None), ("s.c.0", value("late", 0))])
    assert state() == [("TWO", 22), ("three", 3)]
    publish(spark, transport, [("s.b.2", value("tie", 23))])
    assert state() == [("TWO", 22), ("three", 3), ("tie", 23)]
    assert table.status() == {"tables.things": "3"} and table.names() == ["things"]
    table.delete()
    assert table.tables["things"].query is None


def test_topic_to_topic(spark, tmp_path):
    transport = topics.FileTransport(f"file://{tmp_path}/in")
    publish(spark, transport, [(None, json.dumps({"num": i, "kind": "x"})) for i in range(5)])
    sink = topics.SinkSettings(f"file://{tmp_path}/sink", refresh_seconds=0, transformation=lambda df: df.select("num", (F.col("num") * 3).alias("triple")))
    for reg in (None, registry.FileRegistry()):
        name = topics.TopicName("things", f"out{reg is not None}")
        table = topics.TopicToTopicTable(spark, topics.TopicSettings(name, transport, sink, reg, {"value": T._parse_datatype_string("num long, kind string")}))
        table.process_available()
        assert sorted(tuple(r) for r in table.data.collect()) == [(i, 3 * i) for i in range(5)]
    assert topics.TopicName("a").sink == "a.output"


def test_keys(spark):
    df = spark.sql("select named_struct('s', 'x', 't', cast(null as string), 'ts', 5L) as k")
    entity, ts = topics.split_struct_key("k", df.schema["k"].dataType)
    assert df.select(entity, ts).first()[:] == ("x.null", 5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.range(1).select(topics.split_string_key(F.lit("a.b"))[1]).collect()


def test_upserts(spark, tmp_path):
    apply = topics.upsert_batch(spark, f"file://{tmp_path}/u")
    kind = "unique_entity_key string, producer_timestamp long, kafka_value_is_null boolean, v int"
    apply(spark.createDataFrame([("a", 1, False, 1), ("b", 1, False, 2)], kind), 0)
    apply(spark.createDataFrame([("a", 2, True, None), ("c", 1, False, 3)], kind), 1)
    assert {r.v for r in topics.compact(spark.read.parquet(f"file://{tmp_path}/u/1")).collect()} == {2, 3}


def test_fresh_table(spark):
    now, naps, made = [0.0], [], []

    def load():
        made.append(1)
        if len(made) in (3, 4):
            raise LookupError("empty")
        return spark.range(len(made))

    t = topics.FreshTable(load, 10, clock=lambda: now[0], sleep=naps.append, tries=3)
    assert t.data.count() == 1 and t.data.count() == 1
    now[0] = 10
    assert t.data.count() == 2
    assert t.fresh_data.count() == 5 and naps == [1.0, 1.0]
    bad = topics.FreshTable(lambda: spark.read.parquet("/nowhere/x"), tries=2, sleep=naps.append)
    with pytest.raises(topics.TopicNotAvailable):
        _ = bad.data


def test_several_events_in_a_topic(spark, tmp_path):
    reg = registry.FileRegistry()
    transport = topics.FileTransport(f"file://{tmp_path}/in")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n long, s string")
    b = spark.createDataFrame([(1.5,)], "d double")
    for df, event in ((a, "Made"), (b, "Gone")):
        transport.publish(avro.to_confluent_avro(df, reg, f"shop.orders-com.shop.{event}", "value"), "shop.orders")
    reg.register("shop.orders-com.shop.Key", {"type": "record", "name": "k", "fields": []})
    transport.publish(spark.createDataFrame([(None,)], "value binary"), "shop.orders")
    router = multi.EventTopics(spark, transport, reg, "shop", f"file://{tmp_path}/out")
    assert sorted(router.events["shop.orders"]) == ["Gone", "Made"] and router.raw("shop.orders").count() == 3
    assert router.batch_frames("shop.orders")["Made"].count() == 2
    router.start("shop.orders")
    router.wait("shop.orders")
    assert sorted(r.s for r in router.get("shop.orders", "Made").collect()) == ["x", "y"] and router.get("shop.orders", "Gone").first().d == 1.5
    router.start("shop.orders", interval_ms=200)
    transport.publish(avro.to_confluent_avro(a.limit(1), reg, "shop.orders-com.shop.Made", "value"), "shop.orders")
    router.queries["shop.orders", "Made"].processAllAvailable()
    assert router.get("shop.orders", "Made", 200).count() == 3 and router.queries["shop.orders", "Made"].isActive
    router.stop("shop.orders")
    assert "v1" in router.snapshot("shop.orders", "Made", "v1")


def test_sampled_schema_of_a_stream(spark, tmp_path):
    transport = topics.FileTransport(f"file://{tmp_path}/in")
    publish(spark, transport, [(None, '{"q": [1]}')])
    stream = serde.deserialize_json(transport.stream(spark, "things"), "value", work_dir=f"file://{tmp_path}/w")
    assert stream.schema["value"].dataType["q"].dataType == T.ArrayType(T.LongType())
    with pytest.raises(ValueError):
        serde.deserialize_json(transport.stream(spark, "things"), "value")


def farm(spark, path, rows):
    spark.createDataFrame(rows, "owner string, fruit string, ts string").select("owner", "fruit", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_stateful_streams(spark, tmp_path):
    path = f"file://{tmp_path}/farm"
    farm(spark, path, [("ann", "fig", "2024-01-01 10:00:05"), ("ann", "kiwi", "2024-01-01 10:00:20"), ("bob", "plum", "2024-01-01 10:30:00")])
    farm(spark, path, [("zed", "end", "2024-01-02 10:00:00")])
    stream = lambda: spark.readStream.schema("owner string, fruit string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    slid = windows.windowed_lists(stream(), "ts", "owner", "fruit", "30 seconds", "30 seconds", "15 seconds")
    got = windows.run_available(slid, f"{path}-o1", f"{path}-c1").where("owner = 'ann'").collect()
    assert sorted(sorted(r["values"]) for r in got) == [["fig"], ["fig", "kiwi"], ["kiwi"]]
    by_time = windows.by_event_time(stream(), "ts", "owner", "fruit", "5 seconds")
    assert windows.run_available(by_time, f"{path}-o2", f"{path}-c2").where("owner <> 'zed'").count() == 3
    sessions = windows.session_aggregate(stream(), "ts", ["owner"], "1 minute", "1 minute", n=F.count("*"))
    assert {r.owner: r.n for r in windows.run_available(sessions, f"{path}-o3", f"{path}-c3").where("owner <> 'zed'").collect()} == {"ann": 2, "bob": 1}
    joined = windows.window_join(windows.windowed_lists(stream(), "ts", "owner", "fruit", "30 seconds", "1 minute"), stream(), "owner", "ts", "30 seconds")
    out = joined.select("a.owner", "b.fruit")
    assert {tuple(r) for r in windows.run_available(out, f"{path}-o4", f"{path}-c4").where("owner = 'ann'").collect()} == {("ann", "fig"), ("ann", "kiwi")}
    with pytest.raises(AnalysisException):
        stream().groupBy("owner").count().writeStream.format("parquet").outputMode("append").option("path", f"{path}-o5").option("checkpointLocation", f"{path}-c5").start()


def test_avro_frames_keep_every_digit(spark, tmp_path):
    reg = registry.FileRegistry(str(tmp_path / "r.json"))
    kind = "n long, x double, f float, b binary, a array<long>, m map<string,double>, s struct<k:long,t:struct<u:string,v:long>>, ok boolean"
    rows = [
        (9007199254740993, float("nan"), 0.1, bytearray(b"\0\xff"), [1, None, -(2**63)], {"a": float("nan"), "b": None}, (2**63 - 1, ("ü", None)), True),
        (None, None, None, None, None, None, None, None),
        (-(2**63), float("-inf"), float("nan"), bytearray(), [], {}, (None, None), False),
    ]
    df = spark.createDataFrame(rows, kind)
    framed = avro.to_confluent_avro(df, reg, "t-value", "value")
    back = framed.select(avro.from_confluent_avro(F.col("value"), reg, "t-value").alias("v")).select("v.*")
    assert [str(r) for r in back.collect()] == [str(r) for r in df.collect()]
    assert framed.select(avro.from_confluent_avro(F.lit(None).cast("binary"), reg, "t-value").alias("v")).where("v is null").count() == 3


def test_writers_that_come_later(spark, tmp_path):
    """A decoder that was planned before a schema was registered reads what it wrote, nested fields and wider numbers included."""
    reg = registry.FileRegistry(str(tmp_path / "r.json"))
    old = {"type": "record", "name": "r", "fields": [{"name": "n", "type": "int"}, {"name": "in", "type": {"type": "record", "name": "i", "fields": [{"name": "a", "type": "string"}]}}]}
    new = {"type": "record", "name": "r", "fields": [{"name": "in", "type": {"type": "record", "name": "i", "fields": [{"name": "z", "type": "long"}, {"name": "a", "type": "string"}]}}, {"name": "n", "type": "int"}]}
    reader = {"type": "record", "name": "r", "fields": [{"name": "n", "type": "double"}, {"name": "in", "type": {"type": "record", "name": "i", "fields": [{"name": "a", "type": "string"}, {"name": "q", "type": "string", "default": "d"}]}}]}
    one = reg.register("t-value", old)
    reg.register("t-value", reader)
    decode = avro.from_confluent_avro(F.col("value"), reg, "t-value")
    two = registry.FileRegistry(str(tmp_path / "r.json")).register("t-value", new)
    head = lambda i: b"\0" + struct.pack(">i", i)
    values = [head(one) + avro.encode(old, {"n": 1, "in": {"a": "x"}}), head(two) + avro.encode(new, {"n": 2, "in": {"z": 5, "a": "y"}})]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "value binary")
    assert [(r[0].n, r[0]["in"].a, r[0]["in"].q) for r in df.select(decode).collect()] == [(1.0, "x", "d"), (2.0, "y", "d")]
    with pytest.raises(Exception, match="isn't one of"):
        spark.createDataFrame([(bytearray(head(99) + b"x"),)], "value binary").select(decode).collect()


def test_named_types_enums_and_fixed():
    schema = avro.inlined({"type": "record", "name": "r", "fields": [{"name": "a", "type": {"type": "enum", "name": "e", "symbols": ["X", "Y"]}}, {"name": "b", "type": "e"}, {"name": "c", "type": {"type": "fixed", "name": "f", "size": 2}}]})
    value = {"a": "X", "b": "Y", "c": b"\1\2"}
    assert avro.decode(schema, avro.encode(schema, value)) == (value, 4) and avro.to_spark(schema).simpleString() == "struct<a:string,b:string,c:binary>"


def test_a_missing_version_is_an_error(spark, tmp_path):
    kind = "unique_entity_key string, producer_timestamp long, kafka_value_is_null boolean, v int"
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    apply = topics.upsert_batch(spark, f"file://{tmp_path}/u")
    for i in range(4):
        apply(batch(("a", i, False, i)), i)
    assert sorted(p.name for p in (tmp_path / "u").iterdir()) == ["2", "3"]
    with pytest.raises(topics.HistoryMissing):
        apply(batch(("a", 9, False, 9)), 5)


def test_compacted_log(spark, tmp_path):
    import shutil

    kind = "unique_entity_key string, producer_timestamp long, kafka_value_is_null boolean, v int"
    log = topics.CompactedLog(spark, f"file://{tmp_path}/log", every=3)
    every: list[tuple] = []
    for i in range(8):
        rows = [(f"k{j}", i - j % 2, (i + j) % 5 == 0, i) for j in range(i % 3 + 2)] + [(None, 1, False, 0)]
        every += rows[:-1]
        for _ in range(2 if i in (2, 5) else 1):  # a batch that runs again
            log.apply(spark.createDataFrame(rows, kind), i)
        newest = {k: max(t for e, t, _, _ in every if e == k) for k in {e for e, *_ in every}}
        assert sorted(map(str, map(tuple, log.read().distinct().collect()))) == sorted({str(r) for r in every if r[1] == newest[r[0]]})
    assert log._complete() == ([2, 5], [3, 4, 5, 6, 7])
    shutil.rmtree(tmp_path / "log" / "delta-6")
    with pytest.raises(topics.HistoryMissing):
        log.read()
    with pytest.raises(topics.HistoryMissing):
        log.apply(spark.createDataFrame([("k0", 99, False, 1)], kind), 8)


def test_stop_ends_under_steady_input(spark, tmp_path):
    query = spark.readStream.format("rate").option("rowsPerSecond", 500).load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="0 seconds").start()
    while query.lastProgress is None:
        pass
    multi.stop_after_batch(query, 30)
    assert not query.isActive


def test_compiled_codecs_do_as_the_plain_ones():
    import math

    from textloom.sources import avro

    deep = {"type": "record", "name": "d", "fields": [{"name": "s", "type": ["string", "null"]}, {"name": "m", "type": {"type": "map", "values": "long"}}, {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["A", "B"]}}]}
    schema = {"type": "record", "name": "r", "fields": [{"name": "n", "type": ["null", "long"]}, {"name": "x", "type": "double"}, {"name": "b", "type": ["bytes", "null"]}, {"name": "a", "type": [{"type": "array", "items": ["string", "null"]}, "null"]}, {"name": "d", "type": [deep, "null"]}]}
    reader = schema | {"fields": [*schema["fields"][::-1], {"name": "new", "type": ["string", "null"], "default": "none"}]}
    d = lambda s, e: {"s": s, "m": [("k", 1), ("l", -70)], "e": e}
    for n, x, b, a, inner in ((None, 1.5, b"\0", None, None), (2**53 + 1, math.inf, None, [], d(None, "B")), (-(2**63), -0.0, b"", ["é" * 70, None, ""], d("s" * 9000, "A"))):
        row = {"n": n, "x": x, "b": b, "a": a, "d": inner}
        raw = avro.encode(schema, row)
        assert avro.encoder(schema)(row) == raw
        assert avro.decoder(schema)(b"head" + raw, 4) == avro.decode(schema, b"head" + raw, 4)
        assert avro.resolver(reader)(avro.decoder(schema)(raw, 0)[0]) == avro.resolve(avro.decode(schema, raw)[0], reader)
    import pytest

    for bad in (None, {"x": None}):
        for write in (avro.encoder(schema), lambda v: avro.encode(schema, v)):
            with pytest.raises((ValueError, AttributeError)):
                write(bad)


def test_a_value_is_encoded_once_on_its_way_back(spark, sf):
    from textloom import catalog

    evaluated = [line for line in catalog.queries()["avro_two_writers"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    assert [line.count("run(") for line in evaluated] == [2, 2]
