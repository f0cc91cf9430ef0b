import importlib.util
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
corpus_pipeline = importlib.util.module_from_spec(spec)
sys.modules.setdefault("corpus_pipeline", corpus_pipeline)
spec.loader.exec_module(corpus_pipeline)

from textloom.llm import langid, quality, simhash  # noqa: E402


@pytest.fixture(scope="module")
def frames(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], sf).cache())
    return docs


def test_each_stage_against_single_machine_rules(spark, sf, frames):
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames[:4]]
    langs, scores = langid.learn(frames[0]).predict(list(rows[0].values()))
    assert set(rows[1]) == {i for i, lang, s in zip(rows[0], langs, scores) if lang != "und" and s >= 0.5}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    measured = frames[1].select("doc_id", quality.statistics_column()("text").alias("x"))
    good = quality.learn(measured, labels).score(quality.statistics(list(rows[1].values()))) >= 0.3
    assert set(rows[2]) == {i for i, g in zip(rows[1], good) if g}
    fps = [int(x) for x in simhash.fingerprints(list(rows[2].values()))]
    ids = list(rows[2])
    group = {}
    for a in range(len(ids)):
        todo = [a] if a not in group else []
        while todo:
            b = todo.pop()
            if b not in group:
                group[b] = a
                todo += [c for c in range(len(ids)) if (fps[b] ^ fps[c]).bit_count() <= 3]
    smallest = {}
    for k, g in group.items():
        smallest[g] = min(smallest.get(g, ids[k]), ids[k])
    assert set(rows[3]) == set(smallest.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    pieces = {}
    for r in frames[4].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in rows[3].items():
        assert sum(p.length for p in pieces[i]) == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert set(pieces) == set(rows[3])


def test_columns_and_run(spark, sf, frames):
    for f in frames[1:4]:
        assert f.columns == frames[0].columns
    got, want = corpus_pipeline.run(spark, sf), frames[4]
    drop = ["sequence_id", "offset"]
    assert sorted(map(str, got.drop(*drop).collect())) == sorted(map(str, want.drop(*drop).collect()))
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_all_stages(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "the and of thing that", "en", "s", 3), (1, "the and of thing that", "en", "s", 3), (1, "the and of thing that", "en", "s", 3), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:3]:
            now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns and now.count() <= 1
        assert corpus_pipeline.STAGES[3][1](spark, now, sf).count() == now.count()
