import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import trained_language as L
from textloom.plans import pipeline as P
from textloom.plans.columns import TextColumns

SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю.",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью.",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
}
PROBES = {"en": "the rights of human beings", "de": "gleich an Rechten und frei", "it": "gli uni verso gli altri", "el": "ελεύθεροι άνθρωποι", "uk": "вільними і рівними", "ru": "свободными и равными", "zh": "尊严和权利"}


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.createDataFrame([(k, v) for k, v in SAMPLES.items()] * 2 + [(None, "x"), ("en", None)], "lang string, text string"), "text", "lang")


def test_short_texts_in_many_scripts(model):
    assert {k: model.detect(v, "xx") for k, v in PROBES.items()} == {k: k for k in PROBES}
    assert [model.detect(t, "xx") for t in (None, "", "12 ?!", "\n")] == ["xx"] * 4
    assert model.detect(PROBES["ru"], "xx", frozenset({"en"})) == "xx"
    assert model.detect("and rights " * 1_000_000, "xx") == "en"


def test_counts_by_hand(spark, model):
    from collections import Counter

    row = L._counts("Ab, ab")
    assert row.sum() == Counter(a=2, b=2).total() + len(" ab ab ") - 1 + len(" ab ab ") - 2
    assert np.allclose(np.exp(model.weights.astype(float)).sum(axis=1), 1, atol=1e-3)
    assert L.train(spark.createDataFrame([], "lang string, text string"), "text", "lang").detect("abc", "xx") == "xx"


def test_held_out_documents_and_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    trained = L.train(docs.where(~third), "text", "lang")
    stage = P.build([P.PipelineInput([TextColumns("text")], ("LanguageDetector",))], P.Settings(supported=("de", "en", "es", "fr"), language_model=trained))
    rows = stage.transform(docs).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.text__language == r.lang for r in held) >= 0.98 * len(held)
    assert stage.fit([{}]).transform([{"text": rows[0].text}])[0]["text__language"] == rows[0].text__language
