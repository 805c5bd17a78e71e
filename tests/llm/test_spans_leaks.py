"""Shared spans, leaks and components against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.llm import components, leakage, registry, spans


def _words(rng, n):
    return [rng.choice("law court judge tenant rent lease party claim term act".split()) + str(rng.randint(0, 400)) for _ in range(n)]


def test_leaks_brute_force(spark):
    rng = random.Random(2)
    items = [(f"h{i}", " ".join(_words(rng, n))) for i, n in enumerate((19, 20, 60, 250, 250))] + [("null", None), (None, "x " * 30), ("h5", "")]
    docs = []
    for i in range(60):
        w = _words(rng, rng.choice([0, 5, 300, 5000]))
        if i % 3 == 0:
            src = (rng.choice([t for _, t in items[:5]])).split()
            k = min(len(src), rng.choice([19, 20, 21, 80]))
            a, at = rng.randint(0, len(src) - k), rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.3 else x for x in src[a : a + k]]
        docs.append((i, rng.choice([" ", ", ", " — "]).join(w)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, "ISTANBUL İi K")]
    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = lambda w: {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
    want = {(d, i) for d, t in docs for i, s in items if i and s and runs(tok(t)) & runs(tok(s))}
    assert want
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs], "doc_id long, text string, id string, containment double")
    hs = spark.createDataFrame([(i, s, "t") for i, s in items], "id string, src string, text string")
    got = leakage.contained(df, hs)
    assert {(r.doc_id, r.id) for r in got.collect()} == want and got.count() == len(want)
    assert leakage.contained(df.limit(0), hs).count() == 0
    assert leakage.contained(df, hs.limit(0)).count() == 0


def test_leaks_by_join(spark, data, monkeypatch):
    """Passages too many for an index give the same rows."""
    docs, held = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "heldout"))
    one = {(r.doc_id, r.id, round(r.containment, 9)) for r in leakage.contained(docs, held).collect()}
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 10)
    assert one and {(r.doc_id, r.id, round(r.containment, 9)) for r in leakage.contained(docs, held).collect()} == one
    monkeypatch.setattr(leakage, "PARTITIONS", ((30, 1), (200, 2), (1 << 62, 3)))
    assert {(r.doc_id, r.id, round(r.containment, 9)) for r in leakage.contained(docs, held).collect()} == one


def _brute(rows, span):
    grams = lambda t: {t[i : i + span] for i in range(len(t) - span + 1)} if t else set()
    g = [(r, i, grams(s) | grams(w)) for r, i, s, w in rows]
    return {(min(a[0], b[0]), max(a[0], b[0])) for x, a in enumerate(g) for b in g[x + 1 :] if a[1] != b[1] and a[0] != b[0] and a[2] & b[2]}


@pytest.mark.parametrize("crowd", [64, 2])
def test_spans_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(spans, "CROWD", crowd)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh é漢") for _ in range(n))
    base, boiler = [text(500) for _ in range(6)], text(150)
    rows = []
    for r in range(70):
        s = base[r % 6] if r % 4 == 0 else text(rng.randint(0, 400))
        w = rng.choice([None, "", text(150), base[r % 5][rng.randint(0, 100) : rng.randint(250, 400)] + text(30), base[1][:199], base[2][100:300]])
        if r % 3 == 0:
            w = (w or "") + boiler  # boilerplate below the span, shared by many
        rows.append((r, f"i{r // 3}", s, w))
    rows += [(200, "same1", base[3], None), (201, "same2", base[3], None), (202, None, base[3], None), (203, "n", None, None)]
    df = spark.createDataFrame([(*x, "c", 5) for x in rows], "row_id long, id string, src string, rew string, th string, text int")
    owners, _, pairs = spans.shared_spans(df)
    got = [(r.row_id_a, r.row_id_b) for r in spans.row_pairs(owners, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute([x for x in rows if x[1]], 200)


def test_crowded_shares(spark, monkeypatch):
    """Boilerplate of many texts: each is compared with a few others only, shares and clusters stay the same."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ijklm") for _ in range(n))
    boiler, other = text(260), text(230)
    rows = [(r, f"i{r // 2}", text(rng.randint(0, 90)) + (boiler if r % 3 else other)[r % 5 :] + text(40), None if r % 4 else text(250)) for r in range(60)]
    df = spark.createDataFrame(rows, "row_id long, id string, src string, rew string")
    plain = {tuple(r) for r in spans.row_shares(df).collect()}
    full = spans.shared_spans(df)[2].count()
    monkeypatch.setattr(spans, "CROWD", 4)
    assert {tuple(r) for r in spans.row_shares(df).collect()} == plain and len({r[4] for r in plain}) == 2
    assert spans.shared_spans(df, every_pair=False)[2].count() < full / 4
    assert spans.shared_spans(df)[2].count() == full


def test_row_shares(spark):
    a, b = "x1 y2 z3 " * 30, "".join(chr(97 + i * 7 % 26) + str(i) for i in range(200))
    rows = [(1, "p", b, "own text"), (2, "q", "lead " + b[:300] + " tail", None), (3, "r", a, ""), (4, "s", None, None)]
    got = {r.row_id: r for r in spans.row_shares(spark.createDataFrame(rows, "row_id long, id string, src string, rew string")).collect()}
    assert got[2].shared_chars == 300 and got[1].shared_chars == 300 and got[3].shared_chars == 0
    assert got[1].cluster == got[2].cluster and got[3].cluster is None and got[4].share is None


def test_empty_spans(spark):
    df = spark.createDataFrame([], "row_id long, id string, src string, rew string")
    owners, _, pairs = spans.shared_spans(df)
    assert spans.row_pairs(owners, pairs).count() == 0
    assert spans.row_shares(df).count() == 0


def test_matches_maximal():
    s = "".join(chr(97 + i * 11 % 26) + str(i) for i in range(200))
    assert spans.matches("q" + s[:250] + "w", "zz" + s[:250], 200) == [(1, 2, 250)]
    assert spans.matches(s[:150], s[:150], 200) == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(500, 500), (None, 3)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", ["p1_kinds", "p2_levels", "p2_sources", "p3_reliability", "p3_consensus", "p4_items", "p5_rates", "p6_shares", "p8_certificate", "p9_scores", "p9_sources"])
def test_runs(name, spark, data):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_levels_cover_every_row(spark, data):
    n = spark.read.parquet(f"{data}/scored.parquet").count() + spark.read.parquet(f"{data}/documents.parquet").count()
    assert registry.QUERIES["p2_levels"](spark, data).count() == n
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert registry.QUERIES["p9_scores"](spark, data).count() == docs.count()
    assert registry.QUERIES["p9_sources"](spark, data).agg(F.sum("n")).first()[0] == docs.count()
