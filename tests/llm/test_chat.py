import random

from textloom.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, pos string, part int, gone int"


def brute(rows, segment):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = []
    for c, s in seqs.items():
        others = [(o, q) for o, q in seqs.items() if o != c and q[: len(s)] == s]
        if any(len(q) > len(s) for _, q in others) or any(o is not None and (c is None or o < c) for o, q in others if len(q) == len(s)):
            continue
        for at in range(0, len(s), segment):
            part = s[at : at + segment]
            out.append((c, at // segment, len(part), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in part)))
    return sorted(out, key=str)


def log():
    rng = random.Random(8)
    rows = []
    for c in range(60):
        turns = [("user" if i % 2 == 0 else "assistant", f"t{rng.randrange(3)}") for i in range(rng.randrange(1, 6))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(100, i, "user", "same") for i in range(900)] + [(101, i, "user", "same") for i in range(350)] + [(102, i, "user", "same") for i in range(900)]
    rows += [(200, None, "user", None), (200, 1, None, "x"), (201, 0, "user", ""), (201, 1, "", "x"), (None, 3, "user", "alone"), (300, 5, "a", "b"), (300, 5, "a", "b"), (301, 1, "a", "b")]
    return rows


def test_against_brute_force(spark):
    rows = log()
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA).repartition(5)
    for segment in (512, 7):
        assert sorted((tuple(r) for r in C.render(df, segment).collect()), key=str) == brute(rows, segment)


def test_a_conversation_may_span_tasks(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(4000)] + [(2, i, "user", f"t{i}") for i in range(3999)] + [(3, 0, "user", "t0"), (3, 1, "user", "other")]
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, spans = C._placed(df)
        assert spans.where("conv_id = 1").count() > 1
        assert sorted((tuple(r) for r in C.render(df).collect()), key=str) == brute(rows, 512)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty(spark):
    assert C.render(spark.createDataFrame([], SCHEMA)).count() == 0
