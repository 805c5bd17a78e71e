"""Tests and reliability on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import reliability as L
from lexloom.operators import tests_stat as S


def test_kruskal_wallis(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 5.0, 6.0)] + [("b", None)]
    r = S.kruskal_wallis(spark.createDataFrame(rows, "g string, v double"), [], "g", "v").first()
    assert (r.n, r.k) == (6, 2) and r.h == pytest.approx(3.857142857142857)


def test_friedman(spark):
    rows = [(b, g, float(v)) for b in range(4) for g, v in (("x", 1), ("y", 2), ("z", 3))]
    r = S.friedman(spark.createDataFrame(rows, "b int, g string, v double"), "b", "g", "v", 3).first()
    assert r.n == 4 and r.chi2 == pytest.approx(8.0)


def test_signed_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, -2.0), (1, 3.0), (1, 0.0), (2, 0.0)], "g int, d double")
    got = {r.g: (r.n_pairs, r.n_zero, r.n, r.w_plus, r.w_minus, r.w) for r in S.signed_rank(df, ["g"], "d").collect()}
    assert got == {1: (4, 1, 3, 4.0, 2.0, 2.0), 2: (1, 1, 0, 0.0, 0.0, 0.0)}


def test_chi2_yates(spark):
    r = S.chi2(spark.createDataFrame([("a", 10.0, 20.0), ("b", 30.0, 40.0)], "r string, x double, y double"), "r", ["x", "y"]).first()
    assert r.dof == 1 and r.chi2 == pytest.approx(0.4464285714285714)


def test_kappa_identity_and_chance(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (5, 5)], "a int, b int")
    assert L.kappa(df, [], True).first().kappa == pytest.approx(1.0)
    df = spark.createDataFrame([("Y", "Y"), ("Y", "N"), ("N", "Y"), ("N", "N")], "a string, b string")
    assert L.kappa(df, [], False).first().kappa == pytest.approx(0.0)
    assert L.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), [], True).first().kappa is None


def _beside(spark, rows):
    """Scores (cell, rater, score) beside the others of their cell."""
    from lexloom.operators.ratings import beside

    return beside(spark.createDataFrame([(c, "s", "d", r, float(v)) for c, r, v in rows], "item_id string, system string, dim string, rater string, score double"))


def test_icc_of_a_complete_table(spark):
    """With the same raters for each cell the values are those of the two-way analysis."""
    import numpy as np

    x = np.array([[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]], float)
    n, k = x.shape
    r = L.icc(_beside(spark, [(f"c{i}", f"r{j}", x[i, j]) for i in range(n) for j in range(k)]), ["dim"], ["item_id", "system"]).first()
    msr = k * x.mean(1).var(ddof=1)
    msc = n * x.mean(0).var(ddof=1)
    mse = ((x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()) ** 2).sum() / ((n - 1) * (k - 1))
    assert (r.n, r.k) == (6, 4) and r.icc3k == pytest.approx((msr - mse) / msr) and r.icc2k == pytest.approx((msr - mse) / (msr + (msc - mse) / n))
    assert r.icc3k == pytest.approx(0.9093, abs=1e-4) and r.icc2k == pytest.approx(0.6201, abs=1e-4)


def test_all_raters_of_a_cell_count(spark):
    rows = [("a", f"r{i}", v) for i, v in enumerate((1, 2, 4, 5, 3, 3))] + [("b", "r0", 2), ("b", "r9", 5), ("b", "r3", None)]
    got = {(r.item_id, r.rater): (r.n, r.others) for r in _beside(spark, [r for r in rows if r[2] is not None]).collect()}
    assert len(got) == 6 and got["a", "r0"] == (6, 3.4)


@pytest.mark.parametrize("weighted", [True, False])
def test_pooled_kappa_brute_force(spark, weighted):
    import random

    rng = random.Random(3)
    rows = [(f"c{i}", f"r{j}", rng.choice([1, 2, 2, 3, 5, None])) for i in range(30) for j in range(rng.randint(0, 6))]
    df = spark.createDataFrame(rows, "c string, r string, v int")
    cells = [[r[2] for r in rows if r[0] == c and r[2]] for c in {r[0] for r in rows}]
    pairs = [(a, b) for v in cells for x, a in enumerate(v) for y, b in enumerate(v) if x != y]
    w = (lambda a, b: abs(a - b)) if weighted else (lambda a, b: float(a != b))
    o = sum(w(a, b) for a, b in pairs) / len(pairs)
    e = sum(w(a, b) for a, _ in pairs for b, _ in pairs) / len(pairs) ** 2
    r = L.pooled_kappa(df, [], ["c"], "v", [1, 2, 3, 4, 5], weighted).first()
    assert r.n == len(pairs) / 2 and r.kappa == pytest.approx(1 - o / e)
    assert L.pooled_kappa(df.where("v = 1"), [], ["c"], "v", [1, 2], True).first().kappa is None


def test_spearman_brown(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in L.spearman_brown(F.lit(0.30408836341008083)).items()]).first()
    assert r.single == pytest.approx(0.12713663539438969) and r.factor == pytest.approx(1.1610149948622368)


def test_calibration(spark):
    # bins of (n, accuracy, confidence): (1, 0, .3), (30, 1/3, .72633), (65, .584615, .904923)
    rows = [(0.3, False)] + [(0.72633, i < 10) for i in range(30)] + [(0.904923, i < 38) for i in range(65)]
    r = L.calibration(spark.createDataFrame(rows, "c double, k boolean"), [], "c", "k").first()
    assert r.n == 96 and r.ece == pytest.approx(0.3428125, abs=1e-4)
    r = L.calibration(spark.createDataFrame([(0.0, True), (1.0, True)], "c double, k boolean"), [], "c", "k").first()
    assert (r.n, r.ece) == (2, 0.0)


def test_draws():
    """Poisson counts of mean 1; a resample is the same in whatever block it is drawn."""
    t = L.times([f"k{i}" for i in range(200)], 7, 0, 400)
    assert abs(t.mean() - 1) < 0.02 and abs(t.var() - 1) < 0.03 and L.POISSON[0] == 24109
    assert (L.times(["k3", "k5"], 7, 200, 150) == t[[3, 5], 200:350]).all()


def test_bootstraps_against_repeated_rows(spark, monkeypatch):
    """Weighing rows gives what repeating them gives, null keys and values left out."""
    import random

    monkeypatch.setattr(L, "BLOCK", 16)
    from lexloom.operators.ranks import spearman

    rng = random.Random(1)
    rows = [(rng.choice("uv"), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([1.0, 2.0, 2.5, -1.0, 0.0, None]), float(rng.randint(1, 4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, k string, x double, y double")
    near = lambda a, b: a is b is None or a == pytest.approx(b)
    want = {r.b: (r.n, r.rho) for r in spearman(L.resampled(df, "k", 40, 1), ["b"], "x", "y").collect()}
    got = {r.b: (r.n, r.rho) for r in L.bootstrap_spearman(df, "k", "x", "y", 40, 1).where("n > 0").collect()}
    assert got.keys() == want.keys() and all(got[b][0] == want[b][0] and near(got[b][1], want[b][1]) for b in want)
    cols = ("n_pairs", "n_zero", "n", "w_plus", "w_minus", "w", "ties")
    want = {(r.g, r.b): [r[c] for c in cols] for r in S.signed_rank(L.resampled(df, "k", 40, 1), ["g", "b"], "x").collect()}
    got = {(r.g, r.b): [r[c] for c in cols] for r in L.bootstrap_signed_rank(df, "g", "k", "x", 40, 1).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx([v or 0 for v in want[k]]) for k in want)
    assert L.bootstrap_spearman(df.limit(0), "k", "x", "y", 8, 1).count() == 0


def test_bootstrap_icc_by_hand(spark):
    import numpy as np

    rows = [(f"c{i}", f"r{j}", (i * 7 + j * 3 + i * j) % 5 + 1) for i in range(12) for j in range(4) if (i + j) % 7]
    got = {r.b: r.icc3k for r in L.bootstrap_icc(_beside(spark, rows), "dim", ["item_id", "system"], "item_id", 8, 1).collect()}
    x = np.full((12, 4), np.nan)
    for c, r, v in rows:
        x[int(c[1:]), int(r[1:])] = v
    x -= np.nanmean(x, 0)
    t = L.times([f"c{i}" for i in range(12)], 1, 0, 8)
    n, s, q = (~np.isnan(x)).sum(1), np.nansum(x, 1), np.nansum(x * x, 1)
    for b in range(8):
        m, total, a = t[:, b].sum(), t[:, b] @ n, t[:, b] @ (s * s / n)
        msr, mse = (a - (t[:, b] @ s) ** 2 / total) / (m - 1), (t[:, b] @ q - a) / (total - m - 3)
        assert got[b] == pytest.approx((msr - mse) / msr)


def test_partial_correlation_closed_form(spark):
    rows = [(float(a), float(b), float(c)) for a, b, c in ((1, 2, 9), (2, 1, 7), (3, 5, 6), (4, 3, 8), (5, 6, 1), (6, 4, 3), (7, 7, 2))]
    n, rho, p = S.partial_spearman(spark.createDataFrame(rows, "x double, y double, c double"), "x", "y", ["c"])
    import numpy as np

    m = np.corrcoef(np.array(rows).argsort(0).argsort(0).T)
    want = (m[0, 1] - m[0, 2] * m[1, 2]) / np.sqrt((1 - m[0, 2] ** 2) * (1 - m[1, 2] ** 2))
    assert n == 7 and rho == pytest.approx(want) and 0 < p < 1
    assert S.partial_spearman(spark.createDataFrame(rows[:3], "x double, y double, c double"), "x", "y", ["c"])[1:] == (None, None)


@pytest.mark.parametrize("name", ["cluster_bootstrap", "icc_bootstrap", "gap_bootstrap"])
def test_bootstraps_draw_all_resamples(spark, data, name):
    from lexloom import config as C
    from lexloom.plans import reliable

    rows = getattr(reliable, name)(spark, data).collect()
    want = {"cluster_bootstrap": 2000, "icc_bootstrap": 2000, "gap_bootstrap": 800}[name]
    assert rows and all(0.9 * want < r.rounds <= want for r in rows), rows
    assert name != "icc_bootstrap" or {r.dim for r in rows} == set(C.DIMS)


def test_bootstrap_sums_in_parts(spark, monkeypatch):
    """What leaves a task follows the number of distinct values; handing on partial sums changes nothing."""
    df = spark.range(3000).selectExpr("id % 900 as k", "double(id * 7 % 5) as x", "double(id * id % 4) as y")
    counted = df.groupBy(F.col("k").cast("string").alias("k"), "x", "y").agg(F.count("*").alias("c")).coalesce(1)
    assert L._drawn(counted, {"x": "double", "y": "double"}, 40, 1).count() <= 4 * 20
    whole = sorted(tuple(r) for r in L.bootstrap_spearman(df, "k", "x", "y", 40, 1).collect())
    monkeypatch.setattr(L, "HELD", 20)
    assert whole == sorted(tuple(r) for r in L.bootstrap_spearman(df, "k", "x", "y", 40, 1).collect()) and len(whole) == 40
