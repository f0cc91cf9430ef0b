import random

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, root long, n long"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    near = [[j for j, y in enumerate(fps) if j != i and (x ^ y).bit_count() <= 3] for i, x in enumerate(fps)]
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            comp |= dict.fromkeys(seen, min(ids) if ids else None)
    return sorted(((rows[i][0], fps[i], len(near[i]), comp[i]) for i in range(len(rows))), key=str)


def test_fingerprints_match_definition():
    texts = ["", None, "a", "One two", "A b C d e", "x " * 999, "É A\x0bÉ\x0cb c d", "  \n"]
    assert [int(x) for x in S.fingerprints(texts)] == [slow_fingerprint(t) for t in texts]


def test_long_text_segments(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000))
    want = slow_fingerprint(text)
    monkeypatch.setattr(S, "_SEGMENT", 100)
    assert int(S.fingerprints([text])[0]) == want


def test_home_anchor_of_a_neighbour_is_among_replicas():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 300)
    rows, keys = S.anchors(x)
    mine = {}
    for r, k in zip(rows, keys):
        mine.setdefault(r, set()).add(k)
    for bit in range(32):
        _, other = S.anchors(x ^ (1 << bit))
        assert all(other[i] in mine[i] for i in range(300))
    assert len(keys) / 300 < 14


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["the", "of", "lamp", "tree", "river", f"w{i}"]) for i in range(300)) for _ in range(12)]
    rows = []
    for k in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = "zz"
        rows.append((k, " ".join(words)))
    return rows + [(500, None), (501, ""), (None, " "), (None, base[0]), (7, base[1]), (7, base[1]), (502, "only two")]


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_near_duplicates_against_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], DOCS)
    got, _ = S.near_duplicates(docs, block=block)
    got = sorted(((r[0], r[1] % (1 << 64), r[2], r[3]) for r in got.collect()), key=str)
    assert got == brute(rows)


def test_keep_one_per_group(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], DOCS)
    kept = S.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, _, c in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert S.keep_one_per_group(docs.limit(0)).count() == 0


def test_stage_keeps_clashing_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "f", "r", "g", 3) for i, t in rows], "doc_id long, text string, __fp string, root string, __gone string, component int")
    kept = S.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {tuple(r)[2:] for r in got} == {("f", "r", "g", 3)} and sorted(r.doc_id for r in got) == sorted({c for _, _, _, c in brute(rows)})
