"""More of the library's queries, each beside its SQL: serde, topics, places, annotators, stages, and the helpers around frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.catalog import LANGS, _dictionary, _doc_words, _event_stream, _events, _rows, _t
from textloom.catalog_sql import _PICK, _clean, _dot, _kept, _q, _tokens
from textloom.config import DEFAULT_BOOSTS, SessionSettings, materialized, scratch_path, string_to_map
from textloom.functions import geo, text, translit, urls, vectors
from textloom.operators import annotate, frames, places, scoring, wmd
from textloom.operators import text as text_ops
from textloom.plans import pipeline as P
from textloom.plans.columns import AggregatedColumns, DistanceColumns, LocationColumns, SimilarityColumns, TextColumns, UrlColumns
from textloom.sources import avro, connectors, news, registry, serde
from textloom.sources.io import DataRoot
from textloom.streaming import multi, topics, windows

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return add


def _values(rows: list[tuple], *names: str) -> str:
    """Rows as SQL, for results that are the same for any data."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else _q(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


# files and frames --


@_query("SELECT step, value::BIGINT AS value FROM (SELECT 'rows' AS step, count(*) AS value FROM region UNION ALL SELECT 'copied', count(*) FROM region UNION ALL SELECT 'deleted', 1 UNION ALL SELECT 'there', 0 UNION ALL SELECT 'deleted again', 0)")
def files_lifecycle(spark, sf):
    io = DataRoot(spark, scratch_path(spark, "files"))
    io.write_frame(_t(spark, sf, "region"), "region")
    rows = io.read_frame("region").count()
    copied = spark.read.parquet(io.copy_snapshot("region.parquet", "v1")).count()
    steps = [("rows", rows), ("copied", copied), ("deleted", int(io.delete_frame("region"))), ("there", int(io.exists("region.parquet"))), ("deleted again", int(io.delete_frame("region")))]
    return spark.createDataFrame(steps, "step string, value long")


@_query("SELECT r_name AS \"group\", string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def message_directories(spark, sf):
    path = scratch_path(spark, "messages")
    nation = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation.select(F.col("r_name").alias("g"), "n_name").repartition(1).sortWithinPartitions("g", "n_name").write.partitionBy("g").text(path)
    return news.read_messages(spark, path).select(F.regexp_replace("group", "^g=", "").alias("group"), "text")


@_query("SELECT n_nationkey, n_name, false AS may_be_null, true AS same_type FROM nation")
def nullability(spark, sf):
    nation = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    strict = frames.set_nullable(nation, False)
    same = frames.same_type(strict.schema, frames.set_nullable(strict, True).schema)
    return strict.select("*", F.lit(any(f.nullable for f in strict.schema)).alias("may_be_null"), F.lit(same).alias("same_type"))


@_query("SELECT n_nationkey, lower(n_name) AS name FROM nation")
def transform_with(spark, sf):
    from pyspark.ml.feature import SQLTransformer

    shown = frames.debug_print_schema(frames.debug_show(_t(spark, sf, "nation")))
    return frames.transform_with(shown, SQLTransformer(statement="SELECT n_nationkey, lower(n_name) AS name FROM __THIS__"))


@_query("SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS json, count(*)::BIGINT AS n FROM region")
def json_string(spark, sf):
    region = _t(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(frames.to_json_string(region), len(frames.to_dicts(region)))], "json string, n long")


_DATACLASS = "@dataclass\nclass NationRegion:\n    r_regionkey: int | None = None\n    r_name: str | None = None\n\n\n@dataclass\nclass Nation:\n    tags: list[str | None]\n    n_name: str | None = None\n    region: NationRegion | None = None\n"


@_query(_values([(_DATACLASS,)], "source"))
def schema_source(spark, sf):
    nation = _t(spark, sf, "nation").select("n_name", F.struct(F.col("n_regionkey").alias("r_regionkey"), F.lit("x").alias("r_name")).alias("region"))
    schema = T.StructType([nation.schema["n_name"], T.StructField("region", T.StructType([T.StructField(f.name, f.dataType, True) for f in nation.schema["region"].dataType]), True), T.StructField("tags", T.ArrayType(T.StringType()), False)])
    return spark.createDataFrame([(frames.schema_to_dataclass(schema, "Nation"),)], "source string")


@_query(_values([("same", "yes"), ("other type", "column 'n_name' is string, not bigint"), ("no column", "there is no column 'zzz'")], "check_name", "answer"))
def type_checks(spark, sf):
    schema = _t(spark, sf, "nation").schema

    def ask(column: str, kind: T.DataType) -> str:
        try:
            frames.require_type(schema, column, kind)
            return "yes"
        except ValueError as error:
            return str(error)

    return spark.createDataFrame([("same", ask("n_name", T.StringType())), ("other type", ask("n_name", T.LongType())), ("no column", ask("zzz", T.LongType()))], "check_name string, answer string")


@_query(_values([("id",), ("text",), ("query__language",), ("query__vector",)], "name"))
def needed_columns(spark, sf):
    body, query = TextColumns("text"), TextColumns("query")
    stages = P.build([P.PipelineInput([body], ("LanguageDetector", "TextCleaner", "Tokenizer", "StopWordsRemover")), P.PipelineInput([SimilarityColumns(query, body)], ("SimilarityScorer", "OtherLanguageBooster"))], P.Settings(supported=LANGS)).stages
    return spark.createDataFrame([(c,) for c in P.required_columns(["id"], [body.vector], stages)], "name string")


@_query(_values([("text__clean",), ("text__nBOW",), ("q__vector__similarity__text__vector",), ("q__vector__score__text__vector",), ("text__expanded",), ("place__coords",), ("a__distance__b",), ("a__distanceFactor__b",), ("text__score__q__score__linearWeights",)], "name"))
def column_families(spark, sf):
    q, t, pair, between = TextColumns("q"), TextColumns("text"), SimilarityColumns(TextColumns("q"), TextColumns("text")), DistanceColumns(LocationColumns("a"), LocationColumns("b"))
    names = [t.clean, t.bag, pair.similarity, pair.score, UrlColumns("text").expanded, LocationColumns("place").coordinates, between.distance, between.factor, AggregatedColumns("all", (t, q)).weights]
    return spark.createDataFrame([(n,) for n in names], "name string")


@_query(_values([("cassandra", "spark.cassandra.connection.host", "h"), ("elastic", "es.nodes", "a,b"), ("elastic", "es.port", "9200"), ("elastic", "es.index.auto.create", "true"), ("mongo", "uri", "mongodb://u:p%40ss@h:27017/db.c?authSource=admin"), ("mongo", "open", "mongodb://h:27017/db.c"), ("kafka", "subscribe", "topic"), ("kafka", "startingOffsets", "earliest"), ("session", "spark.sql.adaptive.enabled", "true"), ("session", "spark.sql.session.timeZone", "UTC")], "kind", "name", "value"))
def connector_options(spark, sf):
    mongo = connectors.MongoSettings("h", "db", user="u", password="p@ss", auth_source="admin")
    read, session = connectors.kafka_read_options("b:9092", "topic"), SessionSettings().options()
    rows = [("cassandra", *x) for x in connectors.cassandra_options("h").items()] + [("elastic", *x) for x in connectors.elasticsearch_options("a,b").items()]
    rows += [("mongo", "uri", mongo.uri("c")), ("mongo", "open", connectors.MongoSettings("h", "db", user="u").uri("c"))] + [("kafka", k, read[k]) for k in ("subscribe", "startingOffsets")]
    return spark.createDataFrame(rows + [("session", k, session[k]) for k in ("spark.sql.adaptive.enabled", "spark.sql.session.timeZone")], "kind string, name string, value string")


@_query(_values([("a", 1), ("b", 22)], "name", "value"))
def settings_map(spark, sf):
    return spark.createDataFrame(list(string_to_map("a,1;b,22;c;d,x;,3", int).items()), "name string, value int")


# serde --

_AVRO_KIND = "event_id bigint, big bigint, amount double, parts struct<user:bigint,deep:struct<kind:string,odd:bigint>>, tags array<string>"


def _avro_events(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 3 == 1, F.col("event_id") + 9007199254740993)
    amount = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 != 0, F.col("value"))
    parts = F.struct(F.col("user_id").cast("long").alias("user"), F.struct(F.col("event_type").alias("kind"), odd.alias("odd")).alias("deep"))
    return _events(spark, sf).select("event_id", odd.alias("big"), amount.alias("amount"), parts.alias("parts"), F.array("event_type", F.lit(None).cast("string")).alias("tags"))


_AVRO_SQL = "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_id + 9007199254740993 END AS big, CASE WHEN event_id % 5 = 0 THEN 'NaN' WHEN event_id % 7 <> 0 THEN round(value, 2)::DECIMAL(18, 2)::VARCHAR END AS amount, user_id::BIGINT AS user_id, event_type AS kind, CASE WHEN event_id % 3 = 1 THEN event_id + 9007199254740993 END AS odd, 2::BIGINT AS n_tags, {note} AS note FROM events"


def _avro_flat(df: DataFrame, note) -> DataFrame:
    amount = F.when(F.isnan("amount"), "NaN").otherwise(F.col("amount").cast("decimal(18,2)").cast("string"))
    return df.select("event_id", "big", amount.alias("amount"), F.col("parts.user").alias("user_id"), F.col("parts.deep.kind").alias("kind"), F.col("parts.deep.odd").alias("odd"), F.size("tags").cast("long").alias("n_tags"), note.alias("note"))


@_query(_AVRO_SQL.format(note="CASE WHEN event_id % 2 = 0 THEN 'none' ELSE event_type END"))
def avro_two_writers(spark, sf):
    """Values of two versions of a schema, the second with a field more, read into the second one's shape."""
    reg = registry.FileRegistry()
    events = _avro_events(spark, sf)
    first = avro.to_confluent_avro(events.where("event_id % 2 = 0"), reg, "events-value", "value")
    old = json.loads(json.dumps(reg.schema("events-value")))
    note = {"name": "note", "type": ["string", "null"]}
    reg.register("events-value", old | {"fields": [*old["fields"], note]})
    second = avro.to_confluent_avro(events.where("event_id % 2 = 1").withColumn("note", F.col("parts.deep.kind")), reg, "events-value", "value")
    reg.register("events-value", old | {"fields": [*old["fields"], note | {"default": "none"}]})
    back = first.unionByName(second).select(avro.from_confluent_avro(F.col("value"), reg, "events-value").alias("v")).select("v.*")
    return _avro_flat(back, F.col("note"))


@_query(_AVRO_SQL.format(note="'k' || event_id"))
def serde_avro_keys(spark, sf):
    """serialize and deserialize with a registry: key and value by their subjects."""
    reg = registry.FileRegistry()
    made = serde.serialize(_avro_events(spark, sf).withColumn("key_id", F.concat(F.lit("k"), F.col("event_id").cast("string"))), "events", reg, key_columns=["key_id"])
    back = serde.deserialize(made, "events", reg).select("value.*", F.col("key.key_id").alias("key_id"))
    return _avro_flat(back, F.col("key_id"))


@_query("SELECT event_id, value, json_extract(props, '$.k')::BIGINT AS k, user_id::VARCHAR AS key FROM events")
def serde_json(spark, sf):
    """The same without a registry: JSON, whose schema is given or found."""
    e = _events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id", "value", "props")).alias("value"))
    schema = T._parse_datatype_string("event_id bigint, value double, props string")
    back = serde.deserialize(e, "events", schemas={"value": schema}).select("key", "value.*")
    return serde.deserialize_json(back, "props").select("event_id", "value", F.col("props.k").cast("long").alias("k"), "key")


@_query(_values([("a-value", 1, 1), ("a-value", 2, 2), ("b-value", 1, 3)], "subject", "version", "id"))
def schema_registry(spark, sf):
    reg = registry.FileRegistry(None)
    for subject, fields in (("a-value", 1), ("a-value", 2), ("a-value", 2), ("b-value", 1)):
        reg.register(subject, {"type": "record", "name": "r", "fields": [{"name": f"f{i}", "type": "long"} for i in range(fields)]})
    return spark.createDataFrame([(s, v, reg.id_of(s, v)) for s in reg.subjects() for v in reg.versions(s)], "subject string, version int, id int")


# topics and streams --


def _published(spark: SparkSession, sf: str) -> topics.FileTransport:
    transport = topics.FileTransport(scratch_path(spark, "topics"))
    value = F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id", "value", "event_type")))
    transport.publish(_events(spark, sf).select(F.concat_ws(".", F.col("user_id").cast("string"), F.unix_seconds("ts").cast("string")).alias("key"), value.alias("value")), "events")
    return transport


_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("event_type", T.StringType())])
_LATEST = "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"


@_query("SELECT user_id || '.' || floor(epoch(ts))::BIGINT AS key, event_type <> 'error' AS full FROM events")
def topic_batch(spark, sf):
    return _published(spark, sf).batch(spark, "events").select(F.col("key").cast("string").alias("key"), F.col("value").isNotNull().alias("full"))


@_query("SELECT event_id, round(value * 3, 2) AS triple FROM events WHERE event_type <> 'error'")
def topic_to_topic(spark, sf):
    """From topic to topic with a transformation, read back in batch."""
    sink = topics.SinkSettings(scratch_path(spark, "sink"), cache=False, transformation=lambda df: df.where("event_id is not null").select("event_id", (F.col("value") * 3).alias("triple")))
    table = topics.TopicToTopicTable(spark, topics.TopicSettings(topics.TopicName("events", "tripled"), _published(spark, sf), sink, schemas={"value": _EVENT}))
    table.process_available()
    return table.data.select("event_id", F.round(F.col("triple").cast("double"), 2).alias("triple"))


@_query(f"SELECT name, n::VARCHAR AS status FROM (SELECT 'all.latest' AS name, count(*) AS n FROM ({_LATEST}) UNION ALL SELECT 'all.shops', count(*) FROM ({_LATEST}) WHERE event_type = 'purchase')")
def topic_tables_status(spark, sf):
    """Two tables of one topic with a collection's lifecycle; a status is a count."""
    key = lambda df: topics.split_string_key(F.col("key"))
    tables = [topics.TableSettings("latest", "events", entity_key=key, schemas={"value": _EVENT}), topics.TableSettings("shops", "events", post_process=lambda df: df.where("event_type = 'purchase'"), entity_key=key, schemas={"value": _EVENT})]
    # each table has a sink of its own, as both come from one topic
    made = {t.name: topics.TopicTables.of(spark, _published(spark, sf), scratch_path(spark, t.name), [t], partitions=3).tables[t.name] for t in tables}
    both = topics.TopicTables(made)
    both.process_available()
    status = both.status("all")
    both.stop()
    return spark.createDataFrame(list(status.items()), "name string, status string")


@_query("SELECT user_id || '.' || event_type AS entity, floor(epoch(ts))::BIGINT AS produced, event_id, event_type = 'error' AS removed FROM events")
def struct_keys(spark, sf):
    kind = T._parse_datatype_string("user string, type string, at bigint")
    keyed = _events(spark, sf).select(F.struct(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"), F.unix_seconds("ts").alias("at")).alias("key"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_id", F.col("ts").alias("timestamp"))
    entity, produced = topics.split_struct_key("key", kind)
    made = topics.select_kafka_columns_and(topics.with_event_columns(keyed, entity, produced, F.col("value")), "event_id")
    return made.select(F.col("unique_entity_key").alias("entity"), F.col("producer_timestamp").alias("produced"), "event_id", F.col("kafka_value_is_null").alias("removed"))


@_query("SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def compacted_batches(spark, sf):
    """The latest states from a log of seven batches that is merged every third one, newest batch first."""
    from textloom.streaming.compacted import CompactedLog

    log = CompactedLog(spark, scratch_path(spark, "log"), every=3)
    e = materialized(topics.with_event_columns(_events(spark, sf).select("user_id", "event_id", "ts", "event_type"), F.col("user_id"), F.unix_seconds("ts"), F.when(F.col("event_type") != "error", F.lit(1))), "log")
    for i in range(7):
        log.apply(e.where(F.pmod("event_id", F.lit(7)) == 6 - i), i)
    return topics.compact(log.read()).select("user_id", "event_id")


@_query("SELECT event_type AS event, event_id, value FROM events WHERE event_type IN ('click', 'purchase')")
def several_events(spark, sf):
    """One topic of two kinds of events and empty values, read once and routed by schema id."""
    reg, transport = registry.FileRegistry(), topics.FileTransport(scratch_path(spark, "topics"))
    e = _events(spark, sf)
    for event in ("click", "purchase"):
        own = e.where(F.col("event_type") == event).select("event_id", F.col("value").alias(f"{event}_value"))
        transport.publish(avro.to_confluent_avro(own, reg, f"shop.events-com.shop.{event}", "value"), "shop.events")
    transport.publish(e.select(F.lit(None).cast("binary").alias("value")), "shop.events")
    router = multi.EventTopics(spark, transport, reg, "shop", scratch_path(spark, "routed"))
    router.start("shop.events")
    router.wait("shop.events")
    parts = [router.get("shop.events", n).select(F.lit(n).alias("event"), "event_id", F.col(f"{n}_value").alias("value")) for n in ("click", "purchase")]
    return parts[0].unionByName(parts[1])


@_query("SELECT event_id, (event_id * 7 % 65521)::BIGINT AS schema_id, event_id * 7 % 65521 % 11 = 0 AS wanted FROM events")
def schema_id_membership(spark, sf):
    framed = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.col("event_id") * 7 % 65521), 8, "0"), F.lit("ff")))
    ids = _events(spark, sf).select("event_id", avro.schema_id(framed).cast("long").alias("schema_id"))
    return ids.withColumn("wanted", F.col("schema_id").isin(*range(0, 65521, 11)))


@_query("SELECT start, event_type, count(*) AS n FROM (SELECT unnest([floor(epoch(ts))::BIGINT // 43200 * 43200, floor(epoch(ts))::BIGINT // 43200 * 43200 - 43200]) AS start, event_type FROM events) GROUP BY ALL")
def stream_sliding_windows(spark, sf):
    out = scratch_path(spark, "slides")
    made = windows.windowed_aggregate(_event_stream(spark, sf), "ts", ["event_type"], "1 day", "1 day", "12 hours", n=F.count("*"))
    return windows.run_available(made.select(F.unix_seconds("window.start").alias("start"), "event_type", "n"), f"{out}/data", f"{out}/check").where("event_type <> 'flush'")


_LISTS = "SELECT floor(epoch(ts))::BIGINT // 86400 * 86400 AS start, user_id, list_sort(list(event_id)) AS ids FROM events WHERE event_type = 'purchase' GROUP BY ALL"


@_query(f"SELECT start, user_id, array_to_string(ids, ',') AS ids FROM ({_LISTS})")
def stream_window_lists(spark, sf):
    out = scratch_path(spark, "lists")
    made = windows.windowed_lists(_event_stream(spark, sf, "event_type = 'purchase'"), "ts", "user_id", "event_id", "1 day", "1 day", output="ids")
    flat = made.select(F.unix_seconds("window.start").alias("start"), "user_id", F.array_join(F.array_sort("ids").cast("array<string>"), ",").alias("ids"))
    return windows.run_available(flat, f"{out}/data", f"{out}/check").where("user_id >= 0")


@_query(f"SELECT l.user_id, e.event_id, len(l.ids)::BIGINT AS n FROM ({_LISTS}) l JOIN events e ON e.user_id = l.user_id AND e.event_type = 'click' AND epoch(e.ts) >= l.start AND epoch(e.ts) < l.start + 86400")
def stream_window_join(spark, sf):
    out = scratch_path(spark, "window-join")
    lists = windows.windowed_lists(_event_stream(spark, sf, "event_type = 'purchase'"), "ts", "user_id", "event_id", "1 day", "1 day", output="ids")
    made = windows.window_join(lists, _event_stream(spark, sf, "event_type = 'click'"), "user_id", "ts", "2 days")
    flat = made.select(F.col("a.user_id").alias("user_id"), F.col("b.event_id").alias("event_id"), F.size("a.ids").cast("long").alias("n"))
    return windows.run_available(flat, f"{out}/data", f"{out}/check").where("user_id >= 0")


# texts --


@_query("SELECT n_name AS acronym, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(r_name || '-' || n_name) || ' gaMma', '[^A-Za-z0-9]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS expansion FROM nation JOIN region ON n_regionkey = r_regionkey")
def acronym_table(spark, sf):
    io = DataRoot(spark, scratch_path(spark, "acronyms"))
    nation = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    io.write_csv(nation.select(F.col("n_name").alias("acronym"), F.concat(F.lower(F.concat_ws("-", "r_name", "n_name")), F.lit(" gaMma")).alias("expansion")), "given")
    text_ops.acronym_csv_to_parquet(io, "given.csv", "acronyms")
    return spark.createDataFrame(list(text_ops.load_acronyms(io).items()), "acronym string, expansion string")


@_query("SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS digest FROM documents")
def transliterated(spark, sf):
    return _rows(spark, sf, "documents").select("doc_id", F.md5(translit.transliterator(spark)("text")).alias("digest"))


@_query("SELECT n_nationkey, n_name || '  x    ' AS plain FROM nation")
def emoji_removed(spark, sf):
    return _t(spark, sf, "nation").select("n_nationkey", translit.transliterator(spark, "Emoji-Remover")(F.concat("n_name", F.lit("😀x👍🏽"))).alias("plain"))


@_query("SELECT page_id, url || '  ' AS latin FROM pages")
def url_latin_stage(spark, sf):
    c = UrlColumns("text")
    df = _t(spark, sf, "pages").select("page_id", F.concat("url", F.lit("😀")).alias("text"))
    return P.build([P.PipelineInput([c], ("URLAllLatin",))]).transform(df).select("page_id", F.col(c.latin).alias("latin"))


@_query("SELECT page_id, 'http://h' || page_id || '.com/' AS orig, 'http://h' || page_id || '.com/' || CASE page_id % 4 WHEN 0 THEN '' ELSE 'r' || (page_id % 4) END AS final, true AS connects, (page_id % 4)::INTEGER AS hops FROM pages WHERE page_id % 9 <> 5 UNION ALL SELECT page_id, 'http://h' || page_id || '.com/', 'http://h' || page_id || '.com/', false, 0 FROM pages WHERE page_id % 9 = 5")
def url_expanded(spark, sf):
    """Redirects followed by an injected resolver that also fails."""

    def resolver():
        def resolve(url: str) -> str | None:
            number = int(url.split("/")[2][1:-4])
            if number % 9 == 5:
                raise OSError("no answer")
            done = int(url.rsplit("r", 1)[1]) if not url.endswith("/") else 0
            return f"/r{done + 1}" if done < number % 4 else None

        return resolve

    key = F.col("page_id")
    found = F.explode(urls.expand_urls(resolver)(F.array(F.concat(F.lit("http://h"), key.cast("string"), F.lit(".com/"))))).alias("u")
    return _t(spark, sf, "pages").select("page_id", found).select("page_id", F.col("u.origUrl").alias("orig"), F.col("u.finalUrl").alias("final"), F.col("u.connects").alias("connects"), F.col("u.numRedirects").alias("hops"))


@_query("SELECT doc_id, md5(reverse(text)) AS digest FROM documents")
def udf_stage(spark, sf):
    stage = P.udf_stage("Reverse", "text", "back", lambda t: t[::-1], T.StringType())
    return P.Pipeline([stage]).transform(_rows(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5("back").alias("digest"))


_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]')"


@_query(rf"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS digest, CASE WHEN lang = 'de' THEN (len(t))::BIGINT END AS again FROM (SELECT doc_id, lang, {_WORDS} AS t FROM documents)")
def annotated(spark, sf):
    """Annotators by language: German has one more than the others, whose column is null there."""
    kinds = annotate.Annotators()
    kinds.register("again", annotate.tokenize, needs=("tokenize",))
    plans = annotate.LanguagePipelines(kinds, {"en": ["tokenize"], "de": kinds.closure(["again"])}, "en")
    made = plans.transform(_rows(spark, sf, "documents").select("doc_id", "text", "lang"), "text", "lang", "text")
    tokens = F.col("text__corenlpTokens")
    return made.select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, "|")).alias("digest"), F.when(F.col("text__again").isNotNull(), F.size("text__again").cast("long")).alias("again"))


@_query(rf"SELECT item_id, len(t)::BIGINT AS n FROM (SELECT item_id, {_WORDS} AS t FROM benchmark)")
def annotator_column(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", F.size(annotate.Annotators().udf("tokenize")("text")).cast("long").alias("n"))


@_query(f"SELECT item_id, md5(c) AS clean, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT item_id, c, {_tokens('c')} AS t FROM (SELECT item_id, {_clean('text')} AS c FROM benchmark))")
def local_stages(spark, sf):
    """Stages on single records, without a job."""
    import hashlib

    c = TextColumns("text")
    rows = [r.asDict() for r in _t(spark, sf, "benchmark").select("item_id", "text").collect()]
    made = P.build([P.PipelineInput([c], ("TextCleanerWithoutAcronyms", "Tokenizer"))]).fit(rows).transform(rows)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    return spark.createDataFrame([(r["item_id"], md5(r[c.clean]), len(r[c.tokens]), md5("|".join(r[c.tokens]))) for r in made], "item_id long, clean string, n long, digest string")


# vectors and places --

_DICT = f"dict AS (SELECT word, lang, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT lang, lower(unnest({_kept(_tokens('text'), 'lang')})) AS word, FROM documents) JOIN embeddings ON vec_id = {_PICK})"


@_query(f"WITH {_DICT} SELECT lang, count(*) AS n FROM dict GROUP BY lang")
def dictionary_cache(spark, sf):
    """A dictionary with the words of all documents and others, cut to what the documents use."""
    docs = materialized(_doc_words(spark, sf), "words")
    used = materialized(text_ops.vocabulary([(docs, "lang", "words")]).withColumnRenamed("language", "lang"), "used")
    more = used.select("lang", F.concat("word", F.lit("#")).alias("word"))
    return _dictionary(spark, sf, used.unionByName(more)).restricted_to([(docs, "lang", "words")]).cache_sizes().select("lang", F.col("count").alias("n"))


@_query(f"WITH d AS (SELECT DISTINCT lower(unnest({_tokens('text')})) AS word FROM benchmark), x AS (SELECT word, {_PICK} AS pick FROM d) SELECT word, round(embedding[1]::DOUBLE, 4) AS first, true AS known FROM x JOIN embeddings ON vec_id = pick UNION ALL SELECT word || '#', NULL, false FROM x")
def vector_lookup(spark, sf):
    words = _t(spark, sf, "benchmark").select(F.explode(text.tokens(F.lower("text"))).alias("word")).distinct().withColumn("lang", F.lit("en"))
    asked = words.unionByName(words.withColumn("word", F.concat("word", F.lit("#"))))
    return _dictionary(spark, sf, words.select("lang", "word")).lookup(asked).select("word", F.round(F.col("vector")[0].cast("double"), 4).alias("first"), F.col("vector").isNotNull().alias("known"))


@_query(f"SELECT a.vec_id, q.vec_id AS query_id, round({_dot('a.embedding', 'q.embedding')}::FLOAT::DOUBLE, 3) AS score FROM embeddings a, embeddings q WHERE q.vec_id % 97 = 3")
def score_pairs(spark, sf):
    """Every vector against a stated set of queries, in blocks of few."""
    own = _t(spark, sf, "embeddings")
    asked = own.where("vec_id % 97 = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    made = scoring.score_pairs(own, asked, "embedding", "query", "score", max_queries=2)
    return made.select("vec_id", "query_id", vectors.rounded(F.col("score").cast("double"), 3).alias("score"))


@_query("SELECT n_name AS place, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 1.5 WHEN n_nationkey % 3 = 1 THEN length(n_name) * 2.0 ELSE 0 END::DOUBLE AS latitude, CASE WHEN n_nationkey % 3 = 0 THEN 7.0 WHEN n_nationkey % 3 = 1 THEN -1.0 ELSE 0 END::DOUBLE AS longitude FROM nation")
def gazetteer_filled(spark, sf):
    """Places that a gazetteer lacks, asked of an injected geocoder that knows some of them."""

    def resolver():
        return lambda place, country: (len(place) * 2.0, -1.0) if int(place.split("_")[1]) % 3 == 1 else None

    nation = _t(spark, sf, "nation")
    known = nation.where("n_nationkey % 3 = 0").select(F.upper("n_name").alias("place"), F.lit(None).cast("string").alias("country"), (F.col("n_nationkey") * 1.5).cast("double").alias("latitude"), F.lit(7.0).alias("longitude"))
    return places.fill_gazetteer([(nation, "n_name", None)], known, resolver).select("place", "latitude", "longitude")


@_query(f"SELECT n_nationkey, name FROM (SELECT n_nationkey, ['de', 'US', 'zz', 'Fr', 'GB'][n_nationkey % 5 + 1] AS code FROM nation) LEFT JOIN ({_values(sorted(geo.COUNTRIES.items()), 'iso', 'name')}) ON iso = upper(code)")
def country_names(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("de", "US", "zz", "Fr", "GB"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return _t(spark, sf, "nation").select("n_nationkey", geo.country_name(code).alias("name"))


# whole texts --


@_query(f"WITH w AS (SELECT DISTINCT lang, text, unnest(list_filter({_tokens('text')}, " + r"lambda w: regexp_full_match(w, '\p{Lu}+'))) AS acronym FROM documents), t AS (SELECT DISTINCT acronym, text FROM w), r AS (SELECT acronym, md5(text) AS d, row_number() OVER (PARTITION BY acronym ORDER BY md5(text)) AS k FROM t) SELECT acronym, languages, n_texts, examples FROM (SELECT acronym, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, count(DISTINCT text) AS n_texts FROM w GROUP BY acronym) JOIN (SELECT acronym, array_to_string(list(d ORDER BY k), ',') AS examples FROM r WHERE k <= 20 GROUP BY acronym) USING (acronym)")
def acronym_counts(spark, sf):
    docs = _rows(spark, sf, "documents").select("text", F.col("lang").alias("language"), text.tokens(F.col("text")).alias("words"))
    made = text_ops.acronym_counts(text_ops.detect_acronyms([(docs, "text", "language", "words")]))
    return made.select("acronym", F.array_join("languages", ",").alias("languages"), "n_texts", F.array_join(F.transform("examples", F.md5), ",").alias("examples"))


@_query(f"SELECT DISTINCT lang AS language, md5(text) AS digest, unnest(list_filter({_tokens('text')}, " + r"lambda w: regexp_full_match(w, '\p{Lu}+'))) AS acronym FROM documents")
def acronym_texts(spark, sf):
    docs = _rows(spark, sf, "documents").select("text", F.col("lang").alias("language"), text.tokens(F.col("text")).alias("words"))
    made = text_ops.acronym_texts(text_ops.detect_acronyms([(docs, "text", "language", "words")]))
    return made.select("acronym", "language", F.md5("text").alias("digest"))


@_query(f"SELECT doc_id, round((CASE WHEN lang <> 'en' THEN s * 1.1::FLOAT ELSE s END)::DOUBLE, 4) AS score FROM (SELECT doc_id, lang, {_dot('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 2)')}::FLOAT AS s FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))")
def boosted_score_documents(spark, sf):
    """Every document, with the vector that its id picks."""
    own = _t(spark, sf, "embeddings")
    docs = _t(spark, sf, "documents").withColumn("pick", F.pmod("doc_id", F.lit(own.count()))).join(own, F.col("pick") == F.col("vec_id"))
    query = list(own.where("vec_id = 2").first()["embedding"])
    return scoring.score_documents(docs, "embedding", "lang", query, "en", DEFAULT_BOOSTS, "score").select("doc_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@_query(f"""WITH a AS (SELECT doc_id, lower(unnest({_tokens('text')})) AS word FROM documents), q AS (SELECT word, count(*) AS n FROM (SELECT lower(unnest({_tokens('text')})) AS word FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) GROUP BY word),
w AS (SELECT word, {_PICK} AS pick FROM (SELECT word FROM a UNION SELECT word FROM q)), v AS (SELECT word, embedding::DOUBLE[] AS v FROM w JOIN embeddings ON vec_id = pick),
d AS (SELECT x.word AS wo, q.word AS wq, q.n AS nq, sqrt(greatest(0, 2 - 2 * {_dot('x.v', 'y.v')})) AS d FROM v x, q JOIN v y ON y.word = q.word), near AS (SELECT wo, min(d) AS d FROM d GROUP BY wo),
b AS (SELECT doc_id, word, count(*) AS n FROM a GROUP BY ALL),
s1 AS (SELECT doc_id, sum(n * d) / sum(n) AS c FROM b JOIN near ON wo = word GROUP BY doc_id),
s2 AS (SELECT doc_id, sum(nq * d) / (SELECT sum(n) FROM q) AS c FROM (SELECT doc_id, wq, nq, min(d) AS d FROM b JOIN d ON wo = word GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, round(greatest(s1.c, s2.c), 3) AS distance FROM s1 JOIN s2 USING (doc_id)""")
def word_movers_documents(spark, sf):
    """The distance of every document with a word to the first item of the benchmark."""
    own = _rows(spark, sf, "documents").select("doc_id", text.tokens(F.lower("text")).alias("words")).where(F.size("words") > 0)
    bags = own.select("doc_id", F.lit("en").alias("lang"), text.bag_of_words(F.col("words")).alias("bag"))
    base = _t(spark, sf, "benchmark").orderBy("item_id").limit(1).select(text.bag_of_words(text.tokens(F.lower("text"))).alias("base"), F.lit("en").alias("base_lang"))
    pairs = materialized(bags.crossJoin(F.broadcast(base)), "pairs")
    words = pairs.select(F.explode(F.concat(F.col("bag")["_1"], F.col("base")["_1"])).alias("word")).distinct().withColumn("lang", F.lit("en"))
    made = wmd.with_distance(pairs, _dictionary(spark, sf, words).table, "base", "base_lang", "bag", "lang", "distance")
    return made.select("doc_id", F.round(F.col("distance").cast("double"), 3).alias("distance"))


_URL = urls._CANDIDATE


@_query(rf"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html || ' ' || url, {_q(_URL)}, 1)) AS u FROM pages),
f AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(u, '(?i)^(?:https?|ftp)://') THEN u ELSE 'http://' || u END, '[).,;:!?\]]+$', '') AS f FROM c),
n AS (SELECT page_id, regexp_extract(f, '^([^/]*//[^/?#]*)', 1) AS head, f FROM f),
r AS (SELECT page_id, lower(head) AS head, substr(f, length(head) + 1) AS rest FROM n),
x AS (SELECT page_id, head || CASE WHEN rest = '' THEN '/' WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS found FROM r)
SELECT page_id, found FROM x WHERE regexp_extract(lower(found), {_q(r'^[a-z]+://(?:[^/?#@]*@)?[^/?#:]*?([^./?#:@]+)(?::\d+)?(?:[/?#]|$)')}, 1) IN ({', '.join(map(_q, urls.TLDS))})""")
def url_detect_pages(spark, sf):
    """URLs in the whole markup of every page, and its own."""
    found = F.explode(urls.detect_urls(F.concat_ws(" ", "html", "url")))
    return _rows(spark, sf, "pages").select("page_id", found.alias("found"))
