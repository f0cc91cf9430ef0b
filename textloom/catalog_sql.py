"""SQL for the queries of ``catalog``, in the dialect of the engine that checks them."""

from __future__ import annotations

from textloom.functions.text import STOP_WORD_LANGUAGES, stop_words

_LANGS = ("de", "en", "es", "fr")
_TAIL = " See https://x.org/a_b now;then(ok)a.B and x_y 3,14 m 15.000 n a,1 1,b c,d it´s (ii) A/B-C"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _clean(x: str) -> str:
    """The cleaning rules; look-around and back-references are spelled out."""
    steps = [
        (r"https?://[^ \t\n\x0B\f\r]+", ""), (r"[ \r\n]+", " "), (r"_+", " "), (r"([0-9\p{Ll}])\.(\p{Lu})", r"\1. \2"), (r"([):;])([^/ ])", r"\1 \2"), (r"([^ ])\(", r"\1 ("),
        (r"([0-9]),([0-9]{2}[^0-9])", r"\1.\2"), (r"([0-9])\.([0-9]{3})", r"\1,\2"), (r"(\p{L},)([0-9])", r"\1 \2"), (r"([0-9],)(\p{L})", r"\1 \2"), (r"(\p{L},)(\p{L})", r"\1 \2"),
        ('["“”™®]', ""), ("[-–—]", " "),
    ]
    for pattern, new in steps:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(new)}, 'g')"
    x = f"replace(replace(replace({x}, '//', chr(1)), '/', ' '), chr(1), '//')"
    x = f"regexp_replace({x}, {_q('[‘’´]')}, '''', 'g')"
    x = f"regexp_replace({x}, {_q('[ \r\n]+'.encode('unicode_escape').decode())}, ' ', 'g')"
    same = "|".join((("\\" if not chr(c).isalnum() and chr(c) != " " else "") + chr(c)) + "{2,}" for c in range(32, 127))
    return f"regexp_replace({x}, {_q(rf'\((?:{same})\)')}, '. ', 'g')"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[^\p{{Lu}}\p{{Ll}}0-9]'), lambda t: length(t) >= 2)"


def _stop_list(code: str) -> str:
    return "[" + ", ".join(_q(w.lower()) for w in stop_words(code)) + "]"


def _kept(words: str, lang: str) -> str:
    arms = " ".join(f"WHEN {lang} = {_q(c)} THEN list_filter({words}, lambda w: NOT list_contains({_stop_list(c)}, lower(w)))" for c in _LANGS if c != "en")
    return f"CASE {arms} ELSE list_filter({words}, lambda w: NOT list_contains({_stop_list('en')}, lower(w))) END"


_PICK = "(('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def _embedded(source: str) -> str:
    """Sum and norm of word vectors per document of ``source`` (doc_id, lang, words)."""
    sums = ", ".join(f"sum(v[{i}]) AS s{i}" for i in range(1, 65))
    vector = "[" + ", ".join(f"s{i}" for i in range(1, 65)) + "]"
    return f"""
w AS (SELECT doc_id, lang, lower(unnest(words)) AS word FROM ({source})),
c AS (SELECT doc_id, lang, word, count(*) AS n FROM w WHERE doc_id >= 0 OR word IN (SELECT word FROM w WHERE doc_id >= 0 AND lang = 'en') GROUP BY ALL),
p AS (SELECT doc_id, n, {_PICK} AS pick FROM c),
g AS (SELECT doc_id, pick, sum(n) AS n FROM p GROUP BY ALL),
m AS (SELECT doc_id, list_transform(embedding::DOUBLE[], lambda x: x * g.n) AS v FROM g JOIN embeddings e ON e.vec_id = g.pick),
t AS (SELECT doc_id, {sums} FROM m GROUP BY doc_id),
u AS (SELECT doc_id, {vector} AS v FROM t),
e2 AS (SELECT doc_id, list_transform(v, lambda x: (x / sqrt({_dot('v', 'v')}))::FLOAT) AS v FROM u WHERE {_dot('v', 'v')} > 0)"""


def _hits(code: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({'[' + ', '.join(_q(s) for s in stop_words(code)) + ']'}, x)))"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))::FLOAT"


def statements() -> dict[str, str]:
    assert set(_LANGS) <= set(STOP_WORD_LANGUAGES)
    texts = "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'p' || page_id, html FROM pages"
    latest = "SELECT *, epoch(ts)::BIGINT AS s FROM events"
    supplier = "SELECT s_suppkey, (s_suppkey * 7 % 160 - 80)::DOUBLE AS la, (s_suppkey * 13 % 340 - 170)::DOUBLE AS lo, (s_suppkey * 3 % 100 - 50)::DOUBLE AS lb, (s_suppkey * 11 % 300 - 150)::DOUBLE AS lp FROM supplier"
    own = _haversine("la", "lo", "lb", "lp")
    three = "SELECT l_orderkey, l_linenumber, l_quantity::FLOAT AS a, l_discount::FLOAT AS b, coalesce(CASE WHEN l_linenumber > 1 THEN l_tax END, 0)::FLOAT AS c FROM lineitem"
    kept_docs = f"SELECT doc_id, lang, {_kept(_tokens('text'), 'lang')} AS words FROM documents"
    bench_words = f"d AS (SELECT DISTINCT lower(unnest({_tokens('text')})) AS word FROM benchmark), dict AS (SELECT word, embedding::DOUBLE[] AS v FROM (SELECT word, {_PICK} AS pick FROM d) JOIN embeddings ON vec_id = pick)"
    q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
    q1 = "(SELECT embedding FROM embeddings WHERE vec_id = 1)"
    q2 = "(SELECT embedding FROM embeddings WHERE vec_id = 2)"
    ab, aa, bb = _dot("embedding", q1), _dot("embedding", "embedding"), _dot(q1, q1)
    boost = "CASE WHEN lang <> 'en' THEN s * 1.1::FLOAT ELSE s END"
    cleaned_kept = f"SELECT doc_id, lang, {_kept('tk', 'lang')} AS words FROM (SELECT doc_id, lang, {_tokens('c')} AS tk FROM (SELECT doc_id, lang, {_clean('text')} AS c FROM documents))"
    asked = f"SELECT -1 AS doc_id, 'en' AS lang, {_kept('tk', chr(39) + 'en' + chr(39))} AS words FROM (SELECT {_tokens('c')} AS tk FROM (SELECT {_clean('text')} AS c FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)))"
    return {
        "frame_flatten": "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "frame_expand": "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "frame_sanitize": "SELECT c_custkey AS ccustkey, c_name AS cname, c_acctbal AS cacctbal FROM customer",
        "frame_prefix": "SELECT s_suppkey, s_name AS sup__s_name FROM supplier",
        "frame_rename_original": "SELECT s_suppkey, s_name AS name FROM supplier",
        "frame_nested": "SELECT n_nationkey, n_name || '/' || r_name AS label, (n_nationkey * 2)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey",
        "frame_merge_arrays": "SELECT vec_id, (len(embedding) + 3)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]) + list_sum(embedding[1:3]::DOUBLE[]), 4) AS total FROM embeddings",
        "frame_merge_by_position": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "frame_empty_and_limit": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region",
        "frame_id_to_string": "SELECT o_orderkey::VARCHAR AS id, o_orderstatus FROM orders",
        "csv_roundtrip": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
        "parquet_overwrite": "SELECT r_regionkey, lower(r_name) AS r_name FROM region",
        "es_latest": f"SELECT user_id, event_id, event_type, value FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY s DESC) AS r FROM ({latest})) WHERE r = 1 AND event_type <> 'error'",
        "es_latest_with_ties": f"SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY s - s % 86400 DESC) AS r FROM ({latest})) WHERE r = 1 AND event_type <> 'error'",
        "key_split": "SELECT event_id, event_type || '.' || user_id AS entity, event_id::BIGINT AS produced FROM events",
        "clean_text": f"SELECT id, md5(c) AS digest, length(c)::BIGINT AS n FROM (SELECT id, {_clean('x')} AS c FROM (SELECT id, text || {_q(_TAIL)} AS x FROM ({texts})))",
        "clean_text_acronyms": f"SELECT item_id, md5(regexp_replace(regexp_replace(regexp_replace(c, {_q('(^|[ \t\n])CI($|[ \t\n.,])')}, {_q(r'\1Continuous Integration\2')}, 'g'), {_q('(^|[ \t\n])HR($|[ \t\n.,])')}, {_q(r'\1Human Resources\2')}, 'g'), {_q('(^|[ \t\n])IT($|[ \t\n.,])')}, {_q(r'\1Information Technology\2')}, 'g')) AS digest FROM (SELECT item_id, {_clean('x')} AS c FROM (SELECT item_id, text || ' IT and HR, then the CI.' AS x FROM benchmark))",
        "clean_text_acronyms_all": f"SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(c, {_q('(^|[ \t\n\f\r])CI($|[ \t\n\f\r[:punct:]])')}, {_q(r'\1Continuous Integration\2')}, 'g'), {_q('(^|[ \t\n\f\r])HR($|[ \t\n\f\r[:punct:]])')}, {_q(r'\1Human Resources\2')}, 'g'), {_q('(^|[ \t\n\f\r])IT($|[ \t\n\f\r[:punct:]])')}, {_q(r'\1Information Technology\2')}, 'g')) AS digest FROM (SELECT id, {_clean('x')} AS c FROM (SELECT id, text || ' IT and HR, then the CI.' AS x FROM ({texts})))",
        "tokens": f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
        "word_count": "SELECT doc_id, (CASE WHEN text = '' THEN 1 WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END)::BIGINT AS n FROM (SELECT doc_id, text, rtrim(replace(text, chr(10), ' '), ' ') AS x FROM documents)",
        "bag_of_words": f"SELECT item_id, word, count(*)::BIGINT AS n FROM (SELECT item_id, unnest({_tokens('text')}) AS word FROM benchmark) GROUP BY ALL",
        "bag_of_words_documents": f"SELECT doc_id, word, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS word FROM documents) GROUP BY ALL",
        "stop_words": f"SELECT doc_id, len(words)::BIGINT AS n, md5(array_to_string(words, '|')) AS digest FROM ({kept_docs})",
        "acronym_inventory": rf"SELECT acronym, array_to_string(list_sort(list(DISTINCT lang)), ' ||| ') AS languages, md5(array_to_string(list_sort(list(DISTINCT id)), ' ||| ')) AS texts, '' AS expansion FROM (SELECT doc_id::VARCHAR AS id, lang, unnest(list_distinct(list_filter({_tokens('text')}, lambda w: regexp_full_match(w, '\p{{Lu}}+')))) AS acronym FROM documents) GROUP BY acronym",
        "vocabulary": f"SELECT language, count(*) AS n, min(word) AS first, max(word) AS last FROM (SELECT DISTINCT * FROM (SELECT lang AS language, lower(unnest({_tokens('text')})) AS word FROM documents UNION ALL SELECT 'en', lower(unnest({_tokens('text')})) FROM conversations)) GROUP BY language",
        "lang_detect": rf"SELECT doc_id, CASE WHEN text = '' OR greatest(de, en, es, fr) = 0 THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS language FROM (SELECT doc_id, text, {', '.join(f'{_hits(c)} AS {c}' for c in _LANGS)} FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS w FROM documents))",
        "normalize": rf"SELECT doc_id, md5(strip_accents(lower(trim(text, {_q(' ')} || chr(10) || chr(9) || chr(13))))) AS digest FROM documents",
        "embed_docs": f"WITH {_embedded(kept_docs)} SELECT d.doc_id, round(coalesce({_dot('v', q0)}, 0), 4) AS score, round(coalesce({_dot('v', 'v')}, 0), 3) AS norm FROM documents d LEFT JOIN e2 ON d.doc_id = e2.doc_id",
        "similarity_top_k": f"SELECT vec_id, round({_dot('embedding', q0)}, 4) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY {_dot('embedding', q0)} DESC LIMIT 10",
        "distances": f"SELECT vec_id, round(sqrt(greatest(0, {aa} + {bb} - 2 * {ab})), 4) AS euclidean, round(sqrt(greatest(0, 2 - 2 * {ab})), 4) AS euclidean_normalized, round(1 - {ab} / sqrt({aa} * {bb}), 4) AS cosine, round(1 - {ab}, 4) AS cosine_normalized, round(1 - {ab} / ({aa} + {bb} - {ab}), 4) AS tanimoto, round(1 - {ab} / (2 - {ab}), 4) AS tanimoto_normalized FROM embeddings WHERE vec_id <> 1",
        "boosted_score": f"SELECT doc_id, round(({boost})::DOUBLE, 4) AS score FROM (SELECT doc_id, lang, {_dot('embedding', q2)}::FLOAT AS s FROM documents JOIN embeddings ON doc_id = vec_id)",
        "synonyms": f"WITH {bench_words} SELECT word, round(s::DOUBLE, 4) AS similarity FROM (SELECT word, {_dot('v', '(SELECT v FROM dict ORDER BY word LIMIT 1)')}::FLOAT AS s FROM dict WHERE word <> (SELECT min(word) FROM dict)) ORDER BY s DESC, word LIMIT 10",
        "analogy": f"WITH {bench_words}, t AS (SELECT list_transform(list_zip(a, b), lambda p: p[1] - p[2]) AS t FROM (SELECT (SELECT v FROM dict ORDER BY word LIMIT 1) AS a, (SELECT v FROM dict ORDER BY word DESC LIMIT 1) AS b)) SELECT word, round(s::DOUBLE, 3) AS similarity FROM (SELECT word, ({_dot('v', 't')} / sqrt({_dot('t', 't')}))::FLOAT AS s FROM dict, t WHERE word NOT IN ((SELECT min(word) FROM dict), (SELECT max(word) FROM dict))) ORDER BY s DESC, word LIMIT 5",
        "word_movers": f"""WITH {bench_words},
b AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, lower(unnest({_tokens('text')})) AS word FROM benchmark) GROUP BY ALL),
l AS (SELECT item_id, sum(n) AS len FROM b GROUP BY item_id),
x AS (SELECT item_id, word, n, v FROM b JOIN dict USING (word)),
p AS (SELECT o.item_id, o.word AS wo, o.n AS no, q.word AS wq, q.n AS nq, sqrt(greatest(0, 2 - 2 * {_dot('o.v', 'q.v')})) AS d FROM x o, x q WHERE q.item_id = (SELECT min(item_id) FROM benchmark)),
s1 AS (SELECT item_id, sum(no * d) AS c FROM (SELECT item_id, wo, no, min(d) AS d FROM p GROUP BY ALL) GROUP BY item_id),
s2 AS (SELECT item_id, sum(nq * d) AS c FROM (SELECT item_id, wq, nq, min(d) AS d FROM p GROUP BY ALL) GROUP BY item_id)
SELECT s1.item_id, round(greatest(s1.c / l.len, s2.c / (SELECT len FROM l WHERE item_id = (SELECT min(item_id) FROM benchmark))), 3) AS distance FROM s1 JOIN s2 USING (item_id) JOIN l USING (item_id)""",
        "row_aggregates": f"SELECT l_orderkey, l_linenumber, round(greatest(a, b, c)::DOUBLE, 3) AS v_max, round(least(a, b, c)::DOUBLE, 3) AS v_min, round(((a + b)::FLOAT + c)::FLOAT::DOUBLE, 3) AS v_sum, round((((a + b)::FLOAT + c)::FLOAT / 3::FLOAT)::FLOAT::DOUBLE, 3) AS v_mean FROM ({three})",
        "linear_weights": f"SELECT l_orderkey, l_linenumber, round((((a * 0.5::FLOAT + b * 2::FLOAT)::FLOAT + c * 3::FLOAT)::FLOAT / 2::FLOAT)::FLOAT::DOUBLE, 3) AS v FROM ({three})",
        "haversine": f"SELECT s_suppkey, round({own}::DOUBLE, 1) AS km FROM ({supplier})",
        "min_distance": f"SELECT s_suppkey, round(least({own}, {_haversine('48.1', '17.1', 'la', 'lo')}, {_haversine('-33.9', '18.4', 'la', 'lo')})::DOUBLE, 1) AS km FROM ({supplier})",
        "distance_scores": f"SELECT s_suppkey, round((1 - tanh(0.0002::DOUBLE * {own}::DOUBLE))::FLOAT::DOUBLE, 4) AS score FROM ({supplier})",
        "coordinates": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 2.5::DOUBLE ELSE 0::DOUBLE END AS latitude, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey - 10::DOUBLE ELSE 0::DOUBLE END AS longitude FROM nation",
        "url_valid": r"SELECT page_id, regexp_full_match(lower(u), '(ftp|https?)://([^\s/?#@]+@)?([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(:\d{2,5})?([/?#]\S*)?') OR (regexp_full_match(lower(u), '(ftp|https?)://\d{1,3}(\.\d{1,3}){3}([/?#]\S*)?') AND NOT regexp_matches(u, '^[a-z]+://(10|127)\.')) AS valid FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://10.0.0.' || (page_id % 9) WHEN 1 THEN 'http://93.184.216.' || (page_id % 9 + 1) WHEN 2 THEN 'http:// x.com' ELSE url END AS u FROM pages)",
        "url_detect": r"SELECT page_id, lower(regexp_extract(url, '^([^/]*//[^/?#]*)', 1)) || CASE WHEN rest = '' THEN '/' WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS found FROM (SELECT page_id, url, substr(url, length(regexp_extract(url, '^([^/]*//[^/?#]*)', 1)) + 1) AS rest FROM pages) UNION ALL SELECT page_id, 'http://www.test.org/' FROM pages",
        "url_redirects": "WITH RECURSIVE k AS (SELECT page_id FROM pages), w AS (SELECT page_id AS a, page_id AS b, 0 AS h FROM k UNION ALL SELECT a, b + 1, h + 1 FROM w JOIN k ON k.page_id = w.b WHERE b % 7 <> 6 AND h < 11) SELECT 'u' || a AS orig, 'u' || max(b) AS final, max(h)::BIGINT AS hops FROM w GROUP BY a",
        "json_infer": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "schema_ids": "SELECT event_id, (event_id * 7 % 65521)::BIGINT AS schema_id FROM events WHERE event_id * 7 % 65521 % 11 = 0",
        "stream_append": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
        "stream_windows": "SELECT (epoch(ts)::BIGINT // 86400) * 86400 AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, date_trunc('second', ts) AS ts FROM events) GROUP BY ALL",
        "stream_interval_join": "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'click'",
        "stream_event_sourcing": f"SELECT event_id, value AS amount FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY s DESC) AS r FROM ({latest})) WHERE r = 1 AND event_type <> 'error'",
        "search": f"WITH {_embedded(f'{cleaned_kept} UNION ALL {asked}')} SELECT d.doc_id, round((CASE WHEN d.lang <> 'en' THEN s * 1.1::FLOAT ELSE s END)::DOUBLE, 3) AS score FROM documents d JOIN (SELECT x.doc_id, coalesce({_dot('x.v', 'q.v')}, 0)::FLOAT AS s FROM (SELECT d.doc_id, e2.v FROM documents d LEFT JOIN e2 ON d.doc_id = e2.doc_id) x, (SELECT v FROM e2 WHERE doc_id = -1) q) y ON d.doc_id = y.doc_id",
    }
