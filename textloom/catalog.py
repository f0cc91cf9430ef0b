"""The library's queries, each with the SQL that another engine answers it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import DEFAULT_BOOSTS, materialized, scratch_path
from textloom.functions import geo, language, text, urls, vectors
from textloom.operators import embeddings, frames, places, scoring, wmd
from textloom.operators import text as text_ops
from textloom.plans.columns import SimilarityColumns, TextColumns
from textloom.plans.pipeline import PipelineInput, Settings, build
from textloom.sources.avro import schema_id
from textloom.sources.io import DataRoot, read_table
from textloom.streaming import topics, windows

LANGS = ("de", "en", "es", "fr")
DIM = 64


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on."""
    return read_table(spark, f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events with an instant for their time of day, whatever the session's zone."""
    e = _t(spark, sf, "events")
    if e.schema["ts"].dataType.typeName() == "timestamp_ntz":
        e = e.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    return e


# frames --


def _nested_nation(spark: SparkSession, sf: str) -> DataFrame:
    region = _t(spark, sf, "region").select("r_regionkey", "r_name")
    joined = _t(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.struct("n_name", F.struct("r_regionkey", "r_name").alias("region")).alias("info"))


def frame_flatten(spark, sf):
    return frames.flatten(_nested_nation(spark, sf))


def frame_expand(spark, sf):
    return frames.expand(frames.expand(_nested_nation(spark, sf), "info"), "region")


def frame_sanitize(spark, sf):
    return frames.sanitize_column_names(_t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))


def frame_prefix(spark, sf):
    return frames.prefix_column_names(_t(spark, sf, "supplier").select("s_suppkey", "s_name"), "sup", ["s_suppkey"])


def frame_rename_original(spark, sf):
    renamed = frames.rename_columns(_t(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit(1).alias("s__x")), {"s_name": "name", "absent": "y"})
    return frames.original_columns(renamed)


def frame_nested(spark, sf):
    df = frames.with_nested_column(_nested_nation(spark, sf), "info.region.label", F.concat(F.col("info.n_name"), F.lit("/"), F.col("info.region.r_name")))
    df = frames.with_nested_column(df, "extra.deep.n", F.col("n_nationkey") * 2)
    return df.select("n_nationkey", F.col("info.region.label").alias("label"), F.col("extra.deep.n").cast("long").alias("n"))


def frame_merge_arrays(spark, sf):
    df = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.slice("embedding", 1, 3).alias("b"))
    merged = frames.merge_array_columns(df, "m", ["a", "b"], drop=True)
    return merged.select("vec_id", F.size("m").cast("long").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def frame_merge_by_position(spark, sf):
    nation = _t(spark, sf, "nation")
    return frames.merge_dataframes([nation.select("n_nationkey"), nation.select("n_name"), nation.select("n_regionkey")])


def frame_empty_and_limit(spark, sf):
    region = _t(spark, sf, "region").select("r_regionkey", "r_name")
    return frames.limit_if_nonzero(region, 0).unionByName(frames.empty_like(region)).unionByName(region)


def frame_id_to_string(spark, sf):
    return frames.ids_to_strings(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"))


# input and output --


def csv_roundtrip(spark, sf):
    io = DataRoot(spark, scratch_path(spark, "csv"))
    io.write_csv(_t(spark, sf, "nation").select("n_nationkey", "n_name"), "nation")
    return io.read_csv("nation.csv").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def parquet_overwrite(spark, sf):
    io = DataRoot(spark, scratch_path(spark, "parquet"))
    io.write_frame(_t(spark, sf, "region").select("r_regionkey", "r_name"), "region")
    io.overwrite_frame("region", lambda df: df.withColumn("r_name", F.lower("r_name")))
    return io.read_frame("region")


# event sourcing --


def _event_log(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    payload = F.when(F.col("event_type") != "error", F.col("value"))
    return topics.with_event_columns(e, F.col("user_id"), F.unix_seconds("ts"), payload)


def es_latest(spark, sf):
    return topics.compact(_event_log(spark, sf)).select("user_id", "event_id", "event_type", "value")


def es_latest_with_ties(spark, sf):
    coarse = _event_log(spark, sf).withColumn("producer_timestamp", F.col("producer_timestamp") - F.col("producer_timestamp") % 86400)
    return topics.compact(coarse).select("user_id", "event_id")


def key_split(spark, sf):
    key = F.concat_ws(".", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    entity, produced = topics.split_string_key(F.col("key"))
    return _events(spark, sf).select("event_id", key.alias("key")).select("event_id", entity.alias("entity"), produced.alias("produced"))


# text --

TAIL = " See https://x.org/a_b now;then(ok)a.B and x_y 3,14 m 15.000 n a,1 1,b c,d it´s (ii) A/B-C"


def _all_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _rows(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = _rows(spark, sf, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    pages = _rows(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return docs.unionByName(turns).unionByName(pages)


def clean_text(spark, sf):
    marked = _all_texts(spark, sf).withColumn("text", F.concat("text", F.lit(TAIL)))
    return text_ops.with_clean_text(marked, "text", "cleaned").select("id", F.md5("cleaned").alias("digest"), F.length("cleaned").cast("long").alias("n"))


ACRONYMS = {"IT": "Information Technology", "HR": "Human Resources", "CI": "Continuous Integration"}


def clean_text_acronyms(spark, sf):
    items = _t(spark, sf, "benchmark").withColumn("text", F.concat(F.col("text"), F.lit(" IT and HR, then the CI.")))
    return text_ops.with_clean_text(items, "text", "cleaned", ACRONYMS).select("item_id", F.md5("cleaned").alias("digest"))


def clean_text_acronyms_all(spark, sf):
    marked = _all_texts(spark, sf).withColumn("text", F.concat("text", F.lit(" IT and HR, then the CI.")))
    return text_ops.with_clean_text(marked, "text", "cleaned", ACRONYMS).select("id", F.md5("cleaned").alias("digest"))


def tokens(spark, sf):
    own = _t(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("digest"))


def word_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.word_count(F.regexp_replace("text", "\n", " ")).cast("long").alias("n"))


def bag_of_words(spark, sf):
    own = _t(spark, sf, "benchmark").select("item_id", F.explode(text.bag_of_words(text.tokens(F.col("text")))).alias("b"))
    return own.select("item_id", F.col("b._1").alias("word"), F.col("b._2").cast("long").alias("n"))


def bag_of_words_documents(spark, sf):
    own = _rows(spark, sf, "documents").select("doc_id", F.explode(text.bag_of_words(text.tokens(F.col("text")))).alias("b"))
    return own.select("doc_id", F.col("b._1").alias("word"), F.col("b._2").cast("long").alias("n"))


def stop_words(spark, sf):
    lists = text.stop_word_map(LANGS)
    own = _rows(spark, sf, "documents").select("doc_id", text.remove_stop_words(text.tokens(F.col("text")), F.col("lang"), lists, "en").alias("w"))
    return own.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|")).alias("digest"))


def acronym_inventory(spark, sf):
    docs = _rows(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("text"), F.col("lang").alias("language"), text.tokens(F.col("text")).alias("words"))
    found = text_ops.acronym_inventory(text_ops.detect_acronyms([(docs, "text", "language", "words")]))
    return text_ops.stringify_inventory(found).select("acronym", "languages", F.md5("texts").alias("texts"), "expansion")


def vocabulary(spark, sf):
    docs = _rows(spark, sf, "documents").select("lang", text.tokens(F.col("text")).alias("words"))
    turns = _rows(spark, sf, "conversations").select(F.lit("en").alias("lang"), text.tokens(F.col("text")).alias("words"))
    return text_ops.vocabulary([(docs, "lang", "words"), (turns, "lang", "words")]).groupBy("language").agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max("word").alias("last"))


def lang_detect(spark, sf):
    return _rows(spark, sf, "documents").select("doc_id", language.detect_language(F.col("text"), LANGS, "en").alias("language"))


def normalize(spark, sf):
    return _rows(spark, sf, "documents").select("doc_id", F.md5(text.normalizer("normalize")("text")).alias("digest"))


# vectors --


def _dictionary(spark: SparkSession, sf: str, words: DataFrame) -> embeddings.WordVectors:
    """A vector for each (lang, word): that of the bundled one which the word's digest picks."""
    own = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = own.count()
    pick = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"), F.lit(n))
    table = words.withColumn("vec_id", pick).join(own, "vec_id").select("lang", "word", "vector")
    return embeddings.WordVectors(materialized(table, "dictionary"), LANGS, "en", DIM)


def _doc_words(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "documents").select("doc_id", "lang", text.remove_stop_words(text.tokens(F.col("text")), F.col("lang"), text.stop_word_map(LANGS), "en").alias("words"))


def embed_docs(spark, sf):
    docs = materialized(_doc_words(spark, sf), "words")
    words = text_ops.vocabulary([(docs, "lang", "words")]).withColumnRenamed("language", "lang")
    made = _dictionary(spark, sf, words).embed(docs, "lang", "words", "vector")
    query = _t(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("vector")
    return made.select("doc_id", F.round(vectors.dot(v, q), 4).alias("score"), F.round(vectors.dot(v, v), 3).alias("norm"))


def similarity_top_k(spark, sf):
    own = _t(spark, sf, "embeddings")
    query = own.where("vec_id = 0").first()["embedding"]
    return embeddings.top_k(own.where("vec_id <> 0"), "embedding", list(query), 10).select("vec_id", F.round("score", 4).alias("score"))


def distances(spark, sf):
    own = _t(spark, sf, "embeddings")
    base = F.array(*[F.lit(float(x)) for x in own.where("vec_id = 1").first()["embedding"]])
    made = own.where("vec_id <> 1").select("vec_id", *[d(F.col("embedding"), base).alias(n) for n, d in vectors.DISTANCES.items()])
    return made.select("vec_id", *[F.round(n, 4).alias(n) for n in vectors.DISTANCES])


def boosted_score(spark, sf):
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    query = list(_t(spark, sf, "embeddings").where("vec_id = 2").first()["embedding"])
    return scoring.score_documents(docs, "embedding", "lang", query, "en", DEFAULT_BOOSTS, "score").select("doc_id", F.round(F.col("score").cast("double"), 4).alias("score"))


def _benchmark_dictionary(spark: SparkSession, sf: str) -> embeddings.WordVectors:
    words = _t(spark, sf, "benchmark").select(F.lit("en").alias("lang"), F.explode(F.transform(text.tokens(F.col("text")), lambda w: F.lower(w))).alias("word")).distinct()
    return _dictionary(spark, sf, words)


def synonyms(spark, sf):
    d = _benchmark_dictionary(spark, sf)
    word = d.table.agg(F.min("word")).first()[0]
    return d.synonyms("en", word, 10).select("word", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


def analogy(spark, sf):
    d = _benchmark_dictionary(spark, sf)
    a, b = d.table.agg(F.min("word"), F.max("word")).first()
    return d.analogy("en", [a], [b], 5).select("word", F.round(F.col("similarity").cast("double"), 3).alias("similarity"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    bags = _t(spark, sf, "benchmark").select("item_id", F.lit("en").alias("lang"), text.bag_of_words(F.transform(text.tokens(F.col("text")), lambda w: F.lower(w))).alias("bag"))
    base = bags.orderBy("item_id").limit(1).select(F.col("bag").alias("base"), F.col("lang").alias("base_lang"))
    return bags.crossJoin(F.broadcast(base))


def word_movers(spark, sf):
    made = wmd.with_distance(_pairs(spark, sf), _benchmark_dictionary(spark, sf).table, "base", "base_lang", "bag", "lang", "distance")
    return made.select("item_id", F.round(F.col("distance").cast("double"), 3).alias("distance"))


# scores and places --


def _three(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("float").alias("a"), F.col("l_discount").cast("float").alias("b"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).cast("float").alias("c"))


def row_aggregates(spark, sf):
    df = _three(spark, sf)
    for how in vectors.ROW_AGGREGATES:
        df = scoring.aggregate_columns(df, ["a", "b", "c"], how, how)
    return df.select("l_orderkey", "l_linenumber", *[F.round(F.col(h).cast("double"), 3).alias(f"v_{h}") for h in vectors.ROW_AGGREGATES])


def linear_weights(spark, sf):
    w = F.struct(F.lit(2.0).cast("float").alias("_1"), F.array(*[F.lit(x).cast("float") for x in (0.5, 2.0, 3.0)]).alias("_2"))
    df = scoring.weigh_columns(_three(spark, sf).withColumn("w", w), ["a", "b", "c"], "w", "v")
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("v").cast("double"), 3).alias("v"))


def _supplier_places(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select("s_suppkey", geo.coordinates(key * 7 % 160 - 80, key * 13 % 340 - 170).alias("place"), geo.coordinates(key * 3 % 100 - 50, key * 11 % 300 - 150).alias("other"))


def haversine(spark, sf):
    return _supplier_places(spark, sf).select("s_suppkey", F.round(geo.haversine_km(F.col("place"), F.col("other")).cast("double"), 1).alias("km"))


def min_distance(spark, sf):
    bases = F.array(F.col("other"), geo.coordinates(F.lit(48.1), F.lit(17.1)), geo.coordinates(F.lit(-33.9), F.lit(18.4)))
    return _supplier_places(spark, sf).select("s_suppkey", F.round(geo.min_distance_km(bases, F.col("place")).cast("double"), 1).alias("km"))


def distance_scores(spark, sf):
    d = geo.haversine_km(F.col("place"), F.col("other"))
    return _supplier_places(spark, sf).select("s_suppkey", F.round(geo.distance_score(d, F.lit(0.0002)).cast("double"), 4).alias("score"))


def coordinates(spark, sf):
    nation = _t(spark, sf, "nation")
    gazetteer = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("place"), F.lit(None).cast("string").alias("country"), (F.col("n_nationkey") * 2.5).alias("latitude"), (F.col("n_nationkey") - 10.0).alias("longitude"))
    made = places.fetch_coordinates(nation.select("n_nationkey", "n_name"), gazetteer, "n_name", "at")
    return made.select("n_nationkey", F.col("at.latitude").cast("double").alias("latitude"), F.col("at.longitude").cast("double").alias("longitude"))


# URLs --


def url_valid(spark, sf):
    odd = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 9)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("http://93.184.216."), F.col("page_id") % 9 + 1)).when(F.col("page_id") % 5 == 2, F.lit("http:// x.com")).otherwise(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", urls.is_valid_url(odd).alias("valid"))


def url_detect(spark, sf):
    found = F.explode(urls.detect_urls(F.concat(F.lit("see "), F.col("url"), F.lit(" and www.Test.org, or no.tldx."))))
    return _t(spark, sf, "pages").select("page_id", found.alias("found"))


def url_redirects(spark, sf):
    pages = _t(spark, sf, "pages")
    key = F.col("page_id")
    chain = pages.select(F.concat(F.lit("u"), key).alias("url"), F.concat(F.lit("u"), key + 1).alias("location")).where(key % 7 != 6)
    return urls.expand_with_table(pages.select(F.concat(F.lit("u"), key).alias("url")), chain).select(F.col("origUrl").alias("orig"), F.col("finalUrl").alias("final"), F.col("numRedirects").cast("long").alias("hops"))


# JSON and ids --


def json_infer(spark, sf):
    parsed = frames.from_inferred_json(_events(spark, sf).select("event_id", "props"), "props")
    return parsed.select("event_id", F.col("props.k").cast("long").alias("k"))


def schema_ids(spark, sf):
    framed = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.col("event_id") * 7 % 65521), 8, "0"), F.lit("ff")))
    return _events(spark, sf).select("event_id", schema_id(framed).cast("long").alias("schema_id")).where(F.col("schema_id").isin(*range(0, 65521, 11)))


# streams --


def _event_stream(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    """The events as a stream, with one more far ahead in time that moves the watermark past all of them."""
    path = scratch_path(spark, "events")
    e = _events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value").where(where)
    last = e.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("flush").alias("event_type"), F.lit(0.0).alias("value"))
    e.coalesce(1).write.parquet(f"{path}/a")
    last.coalesce(1).write.parquet(f"{path}/b")
    files = spark.read.schema(e.schema).parquet(f"{path}/a")
    files.write.mode("append").parquet(f"{path}/all")
    last.select(e.columns).write.mode("append").parquet(f"{path}/all")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


def stream_append(spark, sf):
    out = scratch_path(spark, "append")
    made = windows.run_available(_event_stream(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id"), f"{out}/data", f"{out}/check")
    return made


def stream_windows(spark, sf):
    out = scratch_path(spark, "windows")
    made = windows.windowed_aggregate(_event_stream(spark, sf), "ts", ["event_type"], "1 day", "1 day", None, n=F.count("*"), total=F.sum("value"))
    flat = made.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")
    return windows.run_available(flat, f"{out}/data", f"{out}/check").where("event_type <> 'flush'").select("start", "event_type", "n", F.round("total", 2).alias("total"))


def stream_interval_join(spark, sf):
    out = scratch_path(spark, "join")
    a = _event_stream(spark, sf, "event_type = 'purchase'").select(F.col("event_id").alias("a_id"), F.col("user_id").alias("user_id"), F.col("ts").alias("a_ts"))
    b = _event_stream(spark, sf, "event_type = 'click'").select(F.col("event_id").alias("b_id"), F.col("user_id").alias("user_id"), F.col("ts").alias("b_ts"))
    made = windows.interval_join(a, b, "user_id", "a_ts", "b_ts", "1 hour", "400 days", "400 days").select("a_id", "b_id")
    return windows.run_available(made, f"{out}/data", f"{out}/check").where("a_id >= 0 and b_id >= 0")


def stream_event_sourcing(spark, sf):
    root = scratch_path(spark, "topics")
    transport = topics.FileTransport(f"{root}/topics")
    value = F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id", "value")))
    transport.publish(_events(spark, sf).select(F.concat_ws(".", F.col("user_id").cast("string"), F.unix_seconds("ts").cast("string")).alias("key"), value.alias("value")), "events")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    settings = topics.TopicSettings(topics.TopicName("events"), transport, topics.SinkSettings(f"{root}/sink", cache=False), schemas={"value": schema}, entity_key=lambda df: topics.split_string_key(F.col("key")), payload="value")
    table = topics.ParquetTopicTable(spark, settings)
    table.process_available()
    return table.data.select("event_id", F.col("value").alias("amount"))


# the pipeline --


def search(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    """Semantic search with the standard stages: documents and a query text, both cleaned, cut to words, embedded; score and boost."""
    body, query = TextColumns("text"), TextColumns("query")
    docs = _rows(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias(body.language))
    cut = ("TextCleaner", "Tokenizer", "StopWordsRemover")
    settings = Settings(supported=LANGS, acronyms={})
    docs = materialized(build([PipelineInput([body], cut)], settings).transform(docs).drop("text", body.clean, body.tokens), "words")
    settings.dictionary = _dictionary(spark, sf, text_ops.vocabulary([(docs, body.language, body.words)]).withColumnRenamed("language", "lang"))
    prepared = build([PipelineInput([body], ("EmbeddingsModel",))], settings).transform(docs)
    asked = _t(spark, sf, "benchmark").orderBy("item_id").limit(1).select(F.col("text").alias("query"), F.lit("en").alias(query.language))
    asked = build([PipelineInput([query], (*cut, "EmbeddingsModel"))], settings).transform(asked).first()
    vector = F.array(*[F.lit(float(x)).cast("float") for x in asked[query.vector]])
    pair = SimilarityColumns(query, body)
    scored = build([PipelineInput([pair], ("SimilarityScorer", "OtherLanguageBooster"))], settings).transform(prepared.withColumns({query.vector: vector, query.language: F.lit("en")}))
    found = scored.select("doc_id", F.round(F.col(f"`{pair.score}`").cast("double"), 3).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(k) if k else found


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark, sf, 10)


_QUERIES = [
    frame_flatten, frame_expand, frame_sanitize, frame_prefix, frame_rename_original, frame_nested, frame_merge_arrays, frame_merge_by_position, frame_empty_and_limit, frame_id_to_string, csv_roundtrip, parquet_overwrite,
    es_latest, es_latest_with_ties, key_split, clean_text, clean_text_acronyms, clean_text_acronyms_all, tokens, word_count, bag_of_words, bag_of_words_documents, stop_words, acronym_inventory, vocabulary, lang_detect, normalize,
    embed_docs, similarity_top_k, distances, boosted_score, synonyms, analogy, word_movers, row_aggregates, linear_weights, haversine, min_distance, distance_scores, coordinates,
    url_valid, url_detect, url_redirects, json_infer, schema_ids, stream_append, stream_windows, stream_interval_join, stream_event_sourcing, search,
]


def queries() -> dict:
    from textloom.catalog_more import QUERIES

    return {q.__name__: q for q in _QUERIES} | QUERIES


def oracle_sql() -> dict[str, str]:
    from textloom.catalog_more import SQL
    from textloom.catalog_sql import statements

    return statements() | SQL
