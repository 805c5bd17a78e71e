"""Consensus on simulated raters, and the cleaning of sheets."""

import random

import pytest

from lexloom.llm import consensus as C


def _simulated(spark, cells=300):
    rng = random.Random(7)
    kinds = {"R1": "good", "R2": "good", "R3": "strict", "R4": "mild", "R5": "narrow", "R6": "noisy", "R7": "random", "R8": "opposed", "R9": "constant"}
    rows, truth = [], {}
    clip = lambda x: max(1, min(5, round(x)))

    def label(kind, t):
        if kind == "random":
            return rng.randint(1, 5)
        if kind == "opposed":
            return clip(6 - t + rng.gauss(0, 0.5))
        if kind == "constant":
            return 3
        x = t + rng.gauss(0, 1.0 if kind == "noisy" else 0.5)
        return clip({"strict": x - 1, "mild": x + 1, "narrow": 3 + (x - 3) * 0.4}.get(kind, x))

    for c in range(cells):
        t = rng.randint(1, 5)
        truth[f"i{c}"] = t
        for r in rng.sample(sorted(kinds), 6):
            rows.append((r, f"i{c}", "s", *[label(kinds[r], t) for _ in range(3)], None if rng.random() < 0.1 else label("good" if kinds[r] == "random" else kinds[r], t)))
    return spark.createDataFrame(rows, "rater string, item_id string, system string, difficulty int, meaning int, terminology int, fluency int"), kinds, truth


@pytest.mark.parametrize(("limit", "held"), [(5_000, 64), (5_000, 5), (0, 64)])
def test_simulated(spark, limit, held, monkeypatch):
    """All ways give the verdicts of the simulation: packed cells, cells of many ratings, many raters."""
    monkeypatch.setattr(C, "BROADCAST_RATERS", limit)
    monkeypatch.setattr(C, "PACKED", held)
    monkeypatch.setattr(C, "BLOCK", 700)
    monkeypatch.setattr(C, "SETTLED", 1e-3)
    df, kinds, truth = _simulated(spark)
    fit = C.fit(df)
    rows = fit.raters.collect()
    got = {(r.rater, r.dim) for r in rows if r.gain < C.UNINFORMED}
    want = {(r, d) for r, k in kinds.items() for d in C.DIMS if k in ("random", "opposed", "constant") and not (k == "random" and d == "fluency")}
    assert got == want
    near = [abs(max(range(5), key=lambda t: r.q[t]) + 1 - truth[r.item_id]) <= 1 for r in fit.posterior.collect()]
    assert len(near) == len(truth) and sum(near) / len(near) > 0.95
    comp = {(r.rater, r.dim): r.competence for r in rows}
    assert comp["R1", "meaning"] > 0.6 > 0.4 > comp["R7", "meaning"] and len(comp) == 36
    kept = _kept.setdefault("all", (comp, fit.rounds))
    assert kept[1] == fit.rounds and all(abs(kept[0][k] - comp[k]) < 1e-6 for k in comp)


_kept: dict = {}


def test_coupling():
    """A strict rater's scores share the levels they are given for; a coarse rater's score covers several levels."""
    whole = [[10, 10, 10, 10, 10]] * 4
    w = C._coupling([[[10, 10, 10, 10, 10], [20, 10, 10, 10, 0], [0, 25, 0, 25, 0], [0, 0, 50, 0, 0]]], whole)[0]
    assert abs(w.sum(1) - 1).max() < 1e-9 and abs(w[0] - [[float(i == j) for j in range(5)] for i in range(5)]).max() < 1e-5
    assert w[1][0].round(3).tolist() == [1, 1, 0, 0, 0] and w[2][1].round(3).tolist() == [1, 1, 0.5, 0, 0] and w[3][2].round(3).tolist() == [1] * 5


def test_empty(spark):
    df, _, _ = _simulated(spark, 1)
    f = C.fit(df.limit(0))
    assert f.raters.count() == 0 and f.posterior.count() == 0
    blank = df.selectExpr("rater", "item_id", "system", *[f"cast(null as int) as {d}" for d in C.DIMS])
    f = C.fit(blank)
    assert f.raters.count() == 0 and f.posterior.count() == 0


def test_last_delivery_counts(spark):
    rows = [("R1", "i", " a", 1, 9, None, 3, "2025-01-01 00:00:00"), ("R1", "i", "A", 2, 0, 3, 3, "2025-01-02 00:00:00"), ("R1", "i", "A", 5, 5, 5, 5, None), (None, "i", "A", 1, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "rater string, item_id string, label string, difficulty_1_5 int, meaning_1_5 int, terminology_1_5 int, fluency_1_5 int, rated_at string").selectExpr("*", "1 as system", "cast(rated_at as timestamp) as t").drop("rated_at").withColumnRenamed("t", "rated_at")
    got = [tuple(r) for r in C.clean_ratings(df).collect()]
    assert got == [("R1", "i", "A", 2, None, 3, 3)]
    assert [tuple(r) for r in C.clean_ratings(df.selectExpr("* except (rated_at)", "cast(rated_at as timestamp_ntz) as rated_at")).collect()] == got
    key = spark.createDataFrame([("R1", "i", "a", "x"), ("R1", "i", "A", "x"), ("R1", "i", "b", None)], "rater string, item_id string, label string, system string")
    assert [r.system for r in C.unblind(C.clean_ratings(df), key).collect()] == ["x"]
