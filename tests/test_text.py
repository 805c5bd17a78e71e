"""Text measures and segmentation against plain Python."""

import re

import pytest

from lexloom import config as C
from lexloom.functions import rewards as R
from lexloom.functions import text as T
from lexloom.operators import segment

SAMPLES = ["", " ", "One two. Three! Four?", "the apple tree is idle\n\nand the eye sees\tfire", "A" * 40 + ". " + "b c d e. " * 60, None, "don't stop; we'll go."]


def _syl(w):
    if len(w) <= 3:
        return 1
    n = len(re.findall("[aeiouy]+", w)) - (1 if w.endswith("e") else 0)
    return max(1, n)


def _flesch(t):
    t = t or ""
    w = re.findall("[A-Za-z']+", t)
    if not w:
        return 0.0
    s = max(len(re.findall("[.!?]+", t)), len([x for x in t.split("\n") if x.strip()]), 1)
    return 206.835 - 1.015 * len(w) / s - 84.6 * sum(_syl(x) for x in re.findall("[a-z']+", t.lower())) / len(w)


def test_flesch(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    for r in df.select("i", T.flesch("t").alias("f"), T.word_count("t").alias("w")).collect():
        assert r.f == pytest.approx(_flesch(SAMPLES[r.i]))
        assert r.w == len((SAMPLES[r.i] or "").split())


def test_copy_score(spark):
    src = "a b c d e f g h i j k l"
    rows = [(src, src), (src, "z " * 12), (src, "a b c"), ("", ""), (None, src)]
    df = R.with_copy_score(spark.createDataFrame(rows, "src string, rew string"), "rew", "src", "x")
    assert [r.x for r in df.collect()] == [0.0, 1.0, 0.5, 0.5, 0.5]


def test_format_score(spark):
    src = " ".join(["word"] * 10)
    rows = [("too short", src), (src, src), ("Here is the text that I need to give you now", src), (" ".join(["w"] * 40), src)]
    got = [r.x for r in spark.createDataFrame(rows, "rew string, src string").select(R.format_score("rew", "src").alias("x")).collect()]
    assert got == pytest.approx([0.0, 1.0, 0.4, 0.7])


def test_simplification_bounds(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"], ["a", "b", "c"]), (["a"], ["b"], ["c"])], "o array<string>, r array<string>, s array<string>")
    x = [r.x for r in R.with_ngrams(df, "o", "r", "s").select(R.simplification("o", "r", "s").alias("x")).collect()]
    assert x[0] == pytest.approx(1.0)
    assert 0 <= x[1] <= 1


def _packed(text):
    """Independent version of the snippet rule."""
    n = len(text.split())
    if n <= 300:
        return [text.strip()] if n >= 150 else []
    out, cur, w = [], [], 0
    for s in [x.strip() for x in re.split(r"(?<=[.;])\s+", text) if x.strip()]:
        k = len(s.split())
        cur, w = [*cur, s], w + k
        if 150 <= w <= 320:
            out.append(" ".join(cur))
            cur, w = [], 0
        elif w > 320 and len(cur) >= 2:
            head = " ".join(" ".join(cur).split()[:300])
            if len(head.split()) > 150:
                out.append(head)
            cur, w = [s], k
    if w >= 150:
        out.append(" ".join(cur))
    return out


def test_snippet_split(spark):
    texts = ["", "short text.", " ".join(["w"] * 200), " ".join(["w"] * 400), " ".join("a b c d e f g h i j." for _ in range(70)), ("x " * 149 + "y. ") * 4, "p " * 100 + ". " + "q " * 310 + ". tail"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "k int, t string")
    got = {}
    for r in segment.split_snippets(df, "t", "k").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.snippet)
    for i, t in enumerate(texts):
        assert got.get(i, []) == _packed(t)


def test_pack_passages(spark):
    line = " ".join(["w"] * 100)
    df = spark.createDataFrame([(1, "\n".join([line] * 9)), (2, line), (3, None), (4, " \n ")], "k int, t string")
    got = [(r.k, len(r.passage.split())) for r in segment.pack_passages(df, "t", ["k"]).orderBy("k", "pos").collect()]
    assert got == [(1, 400), (1, 400)]


def test_clean_output(spark):
    body = "The court held that the tenant must pay the rent in full today."
    rows = [
        ("Drafting:\n" + body, body, True),
        ("Drafting:\nshort", "", True),
        ("I need to keep it plain.\n\n- split the first part\n\n" + body, body, True),
        (body + "\n\nI need to add this.", body + " I need to add this.", False),
        (body, body, False),
        ("only five words right here", "", True),
        ("", "", False),
        (None, "", False),
    ]
    df = segment.clean_output(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string"), "t").orderBy("i")
    assert [(r.cleaned, r.removed) for r in df.collect()] == [(b, c) for _, b, c in rows]


def test_parse_scores(spark):
    keys = ("difficulty", "fluency")
    rows = ['{"difficulty": 3, "fluency": 4}', 'x {"difficulty": 1} y {"difficulty": 2, "fluency": 5}', "Difficulty：4\nfluency: 2", '{"difficulty": "?", "fluency": 1}', "difficulty: 3", "", None, "{court}"]
    got = [(r.difficulty, r.fluency) for r in segment.parse_scores(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string"), "raw", keys).orderBy("i").collect()]
    assert got == [(3.0, 4.0), (2.0, 5.0), (4.0, 2.0), (None, None), (None, None), (None, None), (None, None), (None, None)]


def test_lexical_simplify(spark):
    src = "The tenant must, pursuant to the lease, pay the rent before noon on the first day of each month; the landlord gives notice. Liability follows."
    df = spark.createDataFrame([(src, lv, ["liability", "rent"], {"liability": "a duty", "rent": ""}) for lv in [*C.LEVELS, "other"]], "src string, lv string, terms array<string>, defs map<string,string>")
    got = {r.lv: r.simplified for r in segment.lexical_simplify(df, "src", "lv", "terms", "defs").collect()}
    assert "under the lease" in got["beginner"]
    assert "liability (a duty)" in got["beginner"]
    assert "(a duty)" not in got["intermediate"]
    assert got["other"] is None
    assert all(len(s.split()) <= 12 + 4 for s in got["beginner"].split(". "))


def test_strip_preamble(spark):
    rows = [("Thinking process: abc\n\nThe text.", "The text."), ("thinking process: abc", "thinking process: abc"), ("plain", "plain"), (None, "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string").orderBy("i")
    assert [r.x for r in df.select(T.strip_preamble("t", ["thinking process", "thought process"]).alias("x")).collect()] == [b for _, b in rows]


def test_gate_direction(spark):
    from pyspark.sql import functions as F

    one = F.lit(1.0)
    df = spark.range(1).select(*[R.gate_notes(one, F.lit(0.1), one, one, F.lit(e), F.lit("beginner"), F.array().cast("array<string>")).alias(n) for n, e in (("easy", 90.0), ("hard", 30.0))])
    r = df.first()
    assert "too easy" in r.easy and "too hard" in r.hard
