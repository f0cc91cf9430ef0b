import random

import pytest

from textloom.llm import licences as L

NEGATIVE = ["The river flows past the old mill.", "In 1999 the committee met twice to discuss the budget of the town.", "Ouvrage publié en mai.", "Nothing of note happened on that day."] * 3


@pytest.fixture(scope="module")
def model():
    return L.LicenceModel(NEGATIVE)


def test_held_out_and_templates(model):
    assert model.held_out_accuracy > 0.93
    for family, texts in L.TEMPLATES.items():
        for text in texts:
            found = list(model.scan(f"First line.\n{text}\nLast line."))
            assert [(f[0], f[3], f[6]) for f in found] == [(1, family, True)], text
            assert f"First line.\n{text}\nLast line."[found[0][1] : found[0][2]] == text


def test_unknown_and_unconfirmed(model):
    for text in [*L._ALIKE, "", "\n\n", "zzz qqq", "the of and to"]:
        assert not [f for f in model.scan(text) if f[6]], text
    assert abs(sum(model._softmax(model.bias[None] / model.temperature)[0]) - 1) < 1e-5
    assert model.classify([])[0] == L.UNKNOWN


def test_perturbed(model):
    rng = random.Random(9)
    good = total = 0
    for family, texts in L.TEMPLATES.items():
        for text in texts:
            words = text.split()
            if len(words) < 5:
                continue
            words[rng.randrange(len(words))] = "xxxx"
            total += 1
            good += [f[3] for f in model.scan(" ".join(["see", "below:", *words]))] == [family]
    assert good >= 0.85 * total


def test_prune_is_exact(model):
    """Scanning every paragraph without the shortcut finds the same."""
    text = "\n".join(NEGATIVE + [t for v in L.TEMPLATES.values() for t in v])
    slow = []
    for n, line in enumerate(text.split("\n")):
        family, p = model.classify(L.words_of(line))
        if family != L.UNKNOWN and p >= L.MIN_PROBABILITY:
            slow.append((n, family))
    assert [(f[0], f[3]) for f in model.scan(text)] == slow


def test_query_finds_the_planted_lines_and_no_others(spark, sf):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in L.op2_licence_scan(spark, sf.replace("0.001", "0.01")).where("confirmed").collect())
    want = sorted((r.doc_id, n, lines[x]) for r in docs.collect() for n, x in enumerate(r.text.split("\n")) if x in lines)
    assert got == want and want


def test_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (None, "Released under the MIT License.", "a"), (3, "x\nReleased under the MIT License.", "a"), (3, "x\nReleased under the MIT License.", "a"), (4, "pad " * 200_000 + "\nSPDX-License-Identifier: MIT", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    assert sorted(map(str, ((r.doc_id, r.paragraph, r.family) for r in L.scan_documents(docs, model).collect()))) == sorted(map(str, [(None, 0, "mit"), (3, 1, "mit"), (3, 1, "mit"), (4, 1, "mit")]))
    assert L.scan_documents(docs.limit(0), model).count() == 0
    assert L.learn(docs.limit(0)).families[-1] == L.UNKNOWN


def families(model, text, confirmed=True):
    return [f[3] for f in model.scan(text) if f[6] or not confirmed]


def test_names_and_versions_tell_families_apart(model):
    for text, want in {
        "Licensed under the Eclipse Public License 2.0": ["epl"], "Licensed under the Eclipse Public License, Version 2.0": ["epl"], "Apache License, Version 1.1": ["apache-1.1"],
        "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc-sa"], "Licensed under CC BY-ND 4.0.": ["cc-by-nd"], "Licensed under the EUPL": ["eupl"], "Boost Software License, Version 1.0": ["boost"], "Released under the zlib License": ["zlib"],
        "Licensed under either of Apache License, Version 2.0 or MIT": ["apache-2.0", "mit"], "Licensed under the Apache License, Version 2.0 or the MIT license, at your option.": ["apache-2.0", "mit"],
        "Licensed under the Server Side Public License": [], "Academic Free License 3.0": [], "Apache License, Version 3.0": [], "Sie kam mit der Lizenz 2.0 an": [],
    }.items():
        assert families(model, text) == want, text


def test_shared_fragments_are_ambiguous(model):
    (found,) = model.scan("This program is free software: you can redistribute it and/or modify it under")
    assert not found[6] and {found[3], *found[7].split(",")} >= {"gpl", "agpl"}


@pytest.mark.parametrize("width", [40, 50, 78, 100])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", "; "])
def test_wrapped_and_commented_notices(model, width, mark):
    import textwrap

    for family in ("gpl", "lgpl", "agpl", "isc", "bsd", "apache-2.0", "cc0"):
        notice = max(L.TEMPLATES[family], key=len)
        block = [mark + x for x in textwrap.wrap(notice, width)]
        text = "\n".join(["Some prose about a mill.", "", *block, "", "The end."])
        found = [f for f in model.scan(text) if f[6]]
        assert [f[3] for f in found] == [family], (family, found)
        assert 2 <= found[0][0] and text[found[0][1] : found[0][2]] in text and found[0][2] <= text.index("\n\nThe end.")


def test_a_notice_inside_a_very_long_line(model):
    filler = "the quiet river ran along the old mill and nobody spoke of it "
    line = filler * 40 + "Released under the MIT License. " + filler * 30 + "Licensed under CC BY-SA 4.0. " + filler * 5
    assert sorted(families(model, line)) == ["cc-by-sa", "mit"]


def test_held_out_frames_cuts_and_licences(model):
    r = model.report
    assert r["accuracy_frame"] > 0.97 and r["accuracy_other_licence"] > 0.93 and r["accuracy_notice"] > 0.9
    assert r["precision_confirmed"] > 0.99 and r["recall_confirmed"] > 0.85 and r["unknown_confirmed"] < 0.01


def test_brute_force(spark, sf, model):
    """Every line of every document, scored densely from the weights: the same families with the same probabilities."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.paragraph, r.family): r.probability for r in L.scan_documents(docs, model).collect()}
    want = {}
    names = sorted(model.index, key=model.index.get)
    for r in docs.collect():
        for n, line in enumerate(r.text.split("\n")):
            words = L.words_of(line)
            if len(words) > L.WINDOW:
                continue
            held = {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
            x = np.array([g in held for g in names], float)
            z = (x @ model.weights + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if p.argmax() < len(model.families) - 1 and p.max() >= L.MIN_PROBABILITY:
                want[r.doc_id, n, model.families[p.argmax()]] = p.max()
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
