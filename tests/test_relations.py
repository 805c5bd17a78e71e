"""Splits, samples, ranks and joins: properties and small cases."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import ranks, ratings, relational


def test_hash_split_matches_python(spark):
    ids = [f"x{i}" for i in range(300)]
    got = {r.id: r.bucket for r in relational.hash_split(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id string"), "id").collect()}
    assert got.pop(None) is None
    assert got == {i: int(hashlib.md5(("legal:" + i).encode()).hexdigest(), 16) % 100 for i in ids}


def test_numbered_paths_agree(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    a = {r.v: r.rank for r in relational.numbered(df, ["v"]).collect()}
    b = {r.v: r.rank for r in relational.numbered(df, ["v"], plain_rows=10).collect()}
    assert a == b == {v: v + 1 for v in range(1000)}


def test_average_rank_paths_agree(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 31 % 97).cast("double").alias("v"), F.col("id").alias("__n0"), F.col("id"))
    for plain in (10, 100_000):
        rows = ranks.average_rank(df, ["g"], "v", "r", plain).collect()
        for g in range(3):
            mine = [(r.v, r.r) for r in rows if r.g == g]
            assert abs(sum(r for _, r in mine) - len(mine) * (len(mine) + 1) / 2) < 1e-6
            values = sorted(v for v, _ in mine)
            for v, r in mine[:20]:
                assert r == values.index(v) + (values.count(v) + 1) / 2


def test_average_rank_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", 5.0)], "g string, v double")
    assert sorted((r.g or "", r.v or 0, r.r) for r in ranks.average_rank(df, ["g"], "v", "r").collect()) == [("", 1.0, 1.0), ("", 2.0, 2.0), ("a", 0, None), ("a", 5.0, 1.0)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_bh_monotone(spark, p):
    rows = ranks.bh(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(p)], "g int, i int, p double"), ["g"], "p").collect()
    rows.sort(key=lambda r: r.p)
    assert all(a.q <= b.q + 1e-12 for a, b in zip(rows, rows[1:]))
    n = len(p)
    s = sorted(max(1e-300, x) for x in p)
    want = [min(s[j] * n / (j + 1) for j in range(i, n)) for i in range(n)]
    assert all(abs(r.q - w) < 1e-9 for r, w in zip(rows, want))


def test_fraction_sample(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("id"))
    got = {r.id for r in relational.fraction_sample(df, "id", 0.1).collect()}
    want = sorted((hashlib.md5(f"42:k{i}".encode()).hexdigest(), f"k{i}") for i in range(1000))[:100]
    assert got == {k for _, k in want}
    assert relational.fraction_sample(df.limit(0), "id", 0.1).count() == 0


def test_group_split_keeps_groups(spark):
    df = spark.range(500).select("id", F.concat(F.lit("g"), F.col("id") % 50).alias("g"))
    s = relational.group_split(df, ["g"])
    assert s.groupBy("g").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] == 1
    assert {r.part: r["count"] for r in s.groupBy("part").count().collect()} == {"train": 400, "val": 50, "test": 50}


def test_best_attempts(spark):
    rows = [("a", 1, 0.5, False), ("a", 2, 0.9, True), ("a", 3, 1.0, True), ("b", 1, 0.4, False), ("b", 2, 0.4, False), ("c", 1, None, False)]
    df = spark.createDataFrame(rows, "k string, n int, s double, ok boolean")
    got = {r.k: (r.n, r.tried) for r in relational.best_attempts(df, ["k"], "n", "s", "ok", 5).collect()}
    assert got == {"a": (2, 2), "b": (1, 2), "c": (1, 1)}


def test_unblind_fallback(spark):
    sheet = spark.createDataFrame([("R1", "i_b", "A"), ("R2", "i_b", "A"), ("R1", "i_b", "C")], "rater string, item_id string, label string")
    key = spark.createDataFrame([("R1", "i_b", "a", "x"), ("R1", "i_b", "B", "y")], "rater string, item_id string, label string, system string")
    got = {(r.rater, r.label): r.system for r in ratings.unblinded(sheet, key).collect()}
    assert got == {("R1", "A"): "x", ("R2", "A"): "x"}


def test_dense_topk_brute_force(spark):
    import random

    from lexloom.operators import retrieval

    rng = random.Random(3)
    vec = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(vec, "k long, v array<float>")
    got = {}
    for r in retrieval.dense_topk(df, df.where("k % 10 = 0"), "k", "v", 5).collect():
        got.setdefault(r.q, []).append((r["rank"], r.key))
    for q, v in vec:
        if q % 10 == 0 and v:
            want = sorted(((-sum(a * b for a, b in zip(v, w)), k) for k, w in vec if w and k != q))[:5]
            assert [k for _, k in sorted(got[q])] == [k for _, k in want]


def test_ngram_matches_brute_force(spark):
    """Clipped matches within a row; null and short arrays have none; groups may be null."""
    import random
    from collections import Counter

    from lexloom.operators.retrieval import ngram_matches

    rng = random.Random(6)
    text = lambda: rng.choice([None, [], ["x"], [rng.choice("abc") for _ in range(rng.randint(1, 12))]])
    rows = [(rng.choice(["u", "v", None]), text(), text()) for _ in range(80)]
    want: Counter = Counter()
    for g, o, r in rows:
        for n in range(1, 4):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (o or [], r or []))
            want[g, n, "m"] += sum((a & b).values())
            want[g, n, "t"] += sum(a.values())
    got = ngram_matches(spark.createDataFrame(rows, "g string, o array<string>, r array<string>"), "g", "o", "r", 3).collect()
    assert {(x.g, x.n, k): v for x in got for k, v in (("m", x.matched), ("t", x.total))} == dict(want)


def test_overtaken_deliveries(spark, data, monkeypatch):
    """Both ways of dropping redeliveries keep the same rows."""
    from lexloom.plans import kit

    monkeypatch.setattr(kit, "_parts", lambda _: 99)
    keep = sorted(tuple(r) for r in kit.scored(spark, data, "row_id", "nli").select("row_id", "tag").collect())
    monkeypatch.setattr(kit, "OVERTAKEN", -1)
    assert keep == sorted(tuple(r) for r in kit.scored(spark, data, "row_id", "nli").select("row_id", "tag").collect())
    assert keep == sorted(tuple(r) for r in kit.scored(spark, data, "row_id").select("row_id", "tag").collect())


def test_label_scores_keep_the_best(spark):
    """The fusion over few pairs is that over all pairs of a label, ties and null labels included."""
    import random

    from lexloom.operators import retrieval as R

    rng = random.Random(9)
    labels = spark.createDataFrame([(i, rng.choice(["a", "a", "b", None])) for i in range(60)], "k long, term string")
    dense = spark.createDataFrame([(q, k, rng.choice([0.1, 0.2, -0.9, 0.6])) for q in range(0, 60, 7) for k in rng.sample(range(60), 8) if k != q], "q long, k long, sim double")
    queries = labels.where("k % 7 = 0")
    for k in (1, 3):
        rows = [sorted((r.q, r.k, r.rank, round(r.score, 9)) for r in R.fused(dense, g, "k", k).collect()) for g in (R.graph_scores(queries, labels, "k"), R.label_scores(queries, labels, dense, "k", k))]
        assert rows[0] == rows[1] and rows[0]
    assert R.leading(labels, "term", "k", 2, 4).where("term = 'a'").count() == 2
