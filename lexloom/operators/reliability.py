"""Agreement, reliability, calibration and resampling as grouped aggregates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.ranks import spearman


def kappa(df: DataFrame, by: list[str], weighted: bool) -> DataFrame:
    """(by, n, kappa) of labels a and b: Cohen's kappa, with linear weights over the sorted labels seen if `weighted`; null where chance agreement is whole."""
    cells = df.where("a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count("*").alias("c"))
    labels = cells.select(*by, F.col("a").alias("x")).union(cells.select(*by, "b")).distinct()
    labels = labels.withColumn("i", F.dense_rank().over(Window.partitionBy(*by).orderBy("x")))
    ia, ib = (labels.select(*by, F.col("x").alias(s), F.col("i").alias(f"i{s}")) for s in "ab")
    ca, cb = (cells.groupBy(*by, s).agg(F.sum("c").alias(f"n{s}")) for s in "ab")
    w = F.abs(F.col("ia") - F.col("ib")) if weighted else (F.col("ia") != F.col("ib")).cast("int")
    seen = cells.join(ia, [*by, "a"]).join(ib, [*by, "b"]).groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * w).cast("double").alias("o"))
    chance = ca.join(ia, [*by, "a"]).join(cb.join(ib, [*by, "b"]), by) if by else ca.join(ia, "a").crossJoin(cb.join(ib, "b"))
    e = chance.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb") * w).cast("double").alias("e"))
    j = seen.join(e, by) if by else seen.crossJoin(e)
    return j.select(*by, "n", (1 - F.try_divide(F.col("o") * F.col("n"), F.nullif(F.col("e"), F.lit(0.0)))).alias("kappa"))


def pooled_kappa(df: DataFrame, by: list[str], cell: list[str], label: str, labels: list, weighted: bool) -> DataFrame:
    """(by, n, kappa): chance-corrected agreement over all pairs of labels of a cell, each pair once and in both orders.

    From the counts of each label in a cell, so that a cell may have any number of raters; with two raters a cell it is
    Cohen's kappa of the symmetric table. Linear weights over `labels` if `weighted`; null where chance agreement is whole.
    """
    k = len(labels)
    w = lambda i, j: abs(i - j) if weighted else 1
    c = [F.col(f"_c{i}") for i in range(k)]
    cells = df.where(F.col(label).isin(*labels)).groupBy(*by, *cell).agg(*[F.count_if(F.col(label) == x).cast("double").alias(f"_c{i}") for i, x in enumerate(labels)])
    cells = cells.withColumn("_n", sum(c[1:], c[0])).where("_n > 1")
    cross = [(i, j) for i in range(k) for j in range(i + 1, k)]
    unlike = lambda x: sum((w(i, j) * x[i] * x[j] for i, j in cross), F.lit(0.0))
    a = cells.groupBy(*by).agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_p"), F.sum(unlike(c)).alias("_o"), *[F.sum((F.col("_n") - 1) * x).alias(f"_m{i}") for i, x in enumerate(c)])
    chance = 2 * unlike([F.col(f"_m{i}") for i in range(k)]) / (4 * F.col("_p") * F.col("_p"))
    return a.select(*by, F.col("_p").cast("long").alias("n"), (1 - F.try_divide(F.col("_o") / F.col("_p"), F.nullif(chance, F.lit(0.0)))).alias("kappa"))


def _centred(beside: DataFrame, by: list[str], cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums of each cell of the scores less their rater's mean: (by, cell, n, t, q); and (by, raters, ssc) of the raters."""
    means = beside.groupBy(*by, "rater").agg(F.count("*").alias("_nj"), F.avg("score").alias("_mj"))
    x = F.col("score") - F.col("_mj")
    cells = beside.join(means, [*by, "rater"]).groupBy(*by, *cell).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("t"), F.sum(x * x).alias("q"))
    s = F.sum(F.col("_nj") * F.col("_mj"))
    return cells, means.groupBy(*by).agg(F.count("*").cast("double").alias("raters"), (F.sum(F.col("_nj") * F.col("_mj") * F.col("_mj")) - s * s / F.sum("_nj")).alias("ssc"))


def _mean_squares(cells: Column, total: Column, a: Column, t: Column, q: Column, raters: Column) -> tuple[Column, Column]:
    """Mean squares of the cells and of the rest, from the numbers of cells and scores and the sums of t*t/n, t and q."""
    return F.try_divide(a - t * t / total, cells - 1), F.try_divide(q - a, total - cells - raters + 1)


def icc(beside: DataFrame, by: list[str], cell: list[str]) -> DataFrame:
    """(by, n, k, icc2k, icc3k): average-measures intraclass correlations over all raters, each cell with its own number of them.

    Sums of squares of cells and of the rest are taken after the raters' means, so that for a complete table of
    raters the values are those of the two-way analysis. `k` is the effective number of scores a cell.
    """
    cells, raters = _centred(beside, by, cell)
    a = cells.groupBy(*by).agg(F.count("*").cast("double").alias("m"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("a"), F.sum("t").alias("t"), F.sum("q").alias("q"))
    j = a.join(raters, by) if by else a.crossJoin(F.broadcast(raters))  # one row each
    msr, mse = _mean_squares(F.col("m"), F.col("total"), F.col("a"), F.col("t"), F.col("q"), F.col("raters"))
    j = j.withColumns({"msr": msr, "mse": mse, "msc": F.try_divide(F.col("ssc"), F.col("raters") - 1)})
    wide = F.col("msr") + (F.col("msc") - F.col("mse")) * F.col("raters") / F.col("total")
    k = F.try_divide(F.col("total") - F.col("nn") / F.col("total"), F.col("m") - 1)
    return j.select(*by, F.col("m").cast("long").alias("n"), k.alias("k"), F.try_divide(F.col("msr") - F.col("mse"), F.nullif(wide, F.lit(0.0))).alias("icc2k"), F.try_divide(F.col("msr") - F.col("mse"), F.nullif("msr", F.lit(0.0))).alias("icc3k"))


def leave_one_out(beside: DataFrame, by: list[str]) -> DataFrame:
    """(by, raters, rho): mean over the raters of the rank correlation of each with the mean of the cell's others; a rater needs five scores."""
    each = spearman(beside, [*by, "rater"], "score", "others").where("rho is not null")
    return each.groupBy(*by).agg(F.count("*").alias("raters"), F.avg("rho").alias("rho"))


def spearman_brown(icc3: Column, k: Column | float = 3, to: int = 3, of: int = 2) -> dict[str, Column]:
    """Single-rater reliability behind an average of `k`, that of `of` and `to` raters, and the factor between them."""
    k = F.lit(k) if not isinstance(k, Column) else k
    single = icc3 / (k - (k - 1) * icc3)
    rel = lambda m: m * single / (1 + (m - 1) * single)
    return {"single": single, f"rel{of}": rel(of), f"rel{to}": rel(to), "factor": F.sqrt(F.try_divide(rel(to), rel(of)))}


def design_effect(df: DataFrame, cluster: list[str], member: str, value: str) -> DataFrame:
    """One row (n_clusters, m, icc1, deff): clusters cut to the size of the least, mean squares as plain means."""
    v = df.where(F.col(value).isNotNull()).select(*cluster, member, F.col(value).cast("double").alias("v"))
    sized = v.groupBy(*cluster).agg(F.count("*").alias("c"))
    least = sized.agg(F.min("c").alias("m"))
    k = v.withColumn("k", F.row_number().over(Window.partitionBy(*cluster).orderBy(member))).crossJoin(F.broadcast(least)).where("k <= m")
    g = k.groupBy(*cluster).agg(F.avg("v").alias("g"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max("m").cast("double").alias("m"))
    within = F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("m"), F.col("m") - 1)
    a = g.agg(F.count("*").alias("n_clusters"), F.max("m").alias("m"), F.var_pop("g").alias("b"), F.avg(within).alias("msw"))
    msb = F.col("m") * F.col("b")
    out = a.withColumn("icc1", F.try_divide(msb - F.col("msw"), F.nullif(msb + (F.col("m") - 1) * F.col("msw"), F.lit(0.0))))
    return out.select("n_clusters", F.col("m").cast("long").alias("m"), "icc1", (1 + (F.col("m") - 1) * F.col("icc1")).alias("deff"))


def calibration(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 5) -> DataFrame:
    """(by, n, ece): expected calibration error over right-closed bins; a confidence of 0 or outside 0..1 is in no bin but counts in n."""
    b = F.ceil(F.round(F.col(confidence) * bins, 9))
    rows = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).select(*by, F.when(b.between(1, bins), b).alias("bin"), F.col(confidence).alias("c"), F.col(correct).cast("double").alias("k"))
    g = rows.groupBy(*by, "bin").agg(F.count("*").alias("m"), F.avg("c").alias("conf"), F.avg("k").alias("acc"))
    gap = F.when(F.col("bin").isNotNull(), F.col("m") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return g.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum(gap) / F.sum("m")).alias("ece"))


#: Cumulative probabilities of a Poisson count of mean 1, in 65,536ths: a draw is the number of them that a 16-bit number reaches.
POISSON = [int(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
BLOCK = 200  # resamples that one task works on
HELD = 2048  # distinct values whose draws a task holds


def times(keys: list[str], seed: int, first: int, rounds: int) -> np.ndarray:
    """(keys, rounds): how often each cluster is drawn in resamples `first`.. (a multiple of 8), Poisson counts of mean 1 each.

    Resample 8 j + i takes the i-th 16 bits of MD5(seed:j:key), so that a draw depends on its cluster alone: no cluster
    needs a number, none is joined, and the resamples are the same wherever they are made.
    """
    out = np.zeros((len(keys), -(-rounds // 8) * 8), np.int8)
    for r, key in enumerate(keys):
        raw = b"".join(hashlib.md5(f"{seed}:{j}:{key}".encode()).digest() for j in range(first // 8, first // 8 + out.shape[1] // 8))
        out[r] = np.searchsorted(POISSON, np.frombuffer(raw, ">u2"), side="right")
    return out[:, :rounds]


def resampled(df: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """The rows of every resample, each row as often as its cluster was drawn, with the resample's number `b`.

    For small tables; `bootstrap_spearman` and the like weigh rows instead of repeating them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            t = times(keys, seed, 0, rounds)
            r, b = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(r)), pa.array(b, pa.int32()), pa.array(t[r, b], pa.int32())], ["_key", "b", "_n"])

    d = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key")).distinct().mapInArrow(run, "_key string, b int, _n int")
    each = d.select("_key", "b", F.explode(F.sequence(F.lit(1), "_n")))
    return df.join(each.select("_key", "b"), F.col(key).cast("string") == F.col("_key")).drop("_key")


def _ranks(values: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each value in each column of the weights, ties sharing the mean of their places; weight of each distinct value)."""
    u, inv = np.unique(values, return_inverse=True)
    order = np.argsort(inv, kind="stable")
    n = np.add.reduceat(w[order], np.searchsorted(inv[order], np.arange(len(u))), 0)
    return (np.cumsum(n, 0) - n + (n + 1) / 2)[inv], n


def _drawn(df: DataFrame, values: dict[str, str], rounds: int, seed: int) -> DataFrame:
    """(block, values, w): how often each distinct row of `values` (name: type) is drawn in the resamples of a block, as partial sums.

    `df` has a cluster `k`, the values and their count `c`. A task adds up its clusters' draws by value, so that what leaves it
    follows the number of distinct values and not that of the rows; beyond HELD of them it hands on what it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        total = np.zeros((HELD, rounds), np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*held)) or [()] * len(values)
            for block, first in enumerate(range(0, rounds, BLOCK)):
                w = [np.ascontiguousarray(t[first : first + BLOCK]).tobytes() for t in total[: len(held)]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.int32()), *[pa.array(x, pa.string() if kind == "string" else pa.float64()) for x, kind in zip(columns, values.values())], pa.array(w, pa.binary())], ["block", *values, "w"])

        for batch in batches:
            keys = batch.column("k").to_pylist()
            rows = list(zip(*[batch.column(v).to_pylist() for v in values]))
            count = batch.column("c").to_numpy()
            for lo in range(0, len(keys), 1000):
                if len(held) + len(set(rows[lo : lo + 1000])) > HELD:
                    yield from out()
                    held.clear()
                    total[:] = 0
                own, at = np.unique(np.array(keys[lo : lo + 1000], str), return_inverse=True)
                ids = np.array([held.setdefault(r, len(held)) for r in rows[lo : lo + 1000]])
                order = np.argsort(ids, kind="stable")
                seen, starts = np.unique(ids[order], return_index=True)
                t = times(list(own), seed, 0, rounds)[at[order]] * count[lo : lo + 1000][order][:, None]
                total[seen] += np.add.reduceat(t, starts, 0)
        yield from out()

    near = df.repartition("k").sortWithinPartitions("k")  # a cluster's draws are made once
    return near.mapInArrow(run, f"block int, {', '.join(f'{n} {kind}' for n, kind in values.items())}, w binary")


def _summed(g: pd.DataFrame, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, their draws in each resample) of the partial sums of a block."""
    own, at = np.unique(g[values].to_numpy(float), axis=0, return_inverse=True)
    w = np.zeros((len(own), len(g["w"].iloc[0]) // 8))
    for i, b in zip(at.ravel(), g["w"]):
        w[i] += np.frombuffer(b, np.int64)
    return own, w


def bootstrap_spearman(df: DataFrame, key: str, x: str, y: str, rounds: int, seed: int, least: int = 5) -> DataFrame:
    """(b, n, rho): the rank correlation of x and y in each resample of the clusters of `key`, with ranks anew in each.

    The draws are first added up by value pair. A task takes BLOCK resamples over all distinct value pairs, so that its memory
    follows their number (means of a few ratings have few), however many rows there are; rows are never repeated.
    """
    v = df.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    v = v.groupBy(F.col(key).cast("string").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["block"].iloc[0]) * BLOCK
        own, w = _summed(g, ["x", "y"])
        n = w.sum(0)
        (rx, _), (ry, _) = _ranks(own[:, 0], w), _ranks(own[:, 1], w)
        with np.errstate(invalid="ignore", divide="ignore"):
            rx, ry = rx - (w * rx).sum(0) / n, ry - (w * ry).sum(0) / n
            rho = (w * rx * ry).sum(0) / np.sqrt((w * rx * rx).sum(0) * (w * ry * ry).sum(0))
        rho = np.where((n >= least) & np.isfinite(rho), rho, np.nan)
        return pd.DataFrame({"b": np.arange(first, first + w.shape[1]), "n": n.astype(np.int64), "rho": [None if np.isnan(r) else r for r in rho]})

    return _drawn(v, {"x": "double", "y": "double"}, rounds, seed).groupBy("block").applyInPandas(run, "b int, n long, rho double")


def bootstrap_signed_rank(df: DataFrame, by: str, key: str, diff: str, rounds: int, seed: int) -> DataFrame:
    """(by, b) and the columns of `signed_rank`, in each resample of the clusters of `key`; memory as in `bootstrap_spearman`."""
    v = df.where(F.col(key).isNotNull() & F.col(diff).isNotNull()).groupBy(F.col(by).cast("string").alias(by), F.col(key).cast("string").alias("k"), F.col(diff).cast("double").alias("d")).agg(F.count("*").alias("c"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["block"].iloc[0]) * BLOCK
        own, w = _summed(g, ["d"])
        d = own[:, 0]
        live = d != 0
        zero = w[~live].sum(0)
        plus = minus = ties = np.zeros(w.shape[1])
        if live.any():
            r, n = _ranks(np.abs(d[live]), w[live])
            plus, minus = (w[live] * r * (d[live] > 0)[:, None]).sum(0), (w[live] * r * (d[live] < 0)[:, None]).sum(0)
            ties = (n**3 - n).sum(0)
        all_ = w.sum(0)
        out = pd.DataFrame({"b": np.arange(first, first + w.shape[1]), "n_pairs": all_.astype(np.int64), "n_zero": zero.astype(np.int64), "n": (all_ - zero).astype(np.int64), "w_plus": plus, "w_minus": minus, "w": np.minimum(plus, minus), "ties": ties})
        out.insert(0, by, g[by].iloc[0])
        return out[out.n_pairs > 0]

    drawn = _drawn(v, {by: "string", "d": "double"}, rounds, seed)
    return drawn.groupBy(by, "block").applyInPandas(run, f"{by} string, b int, n_pairs long, n_zero long, n long, w_plus double, w_minus double, w double, ties double")


def bootstrap_icc(beside: DataFrame, by: str, cell: list[str], key: str, rounds: int, seed: int) -> DataFrame:
    """(by, b, icc3k): the average-measures correlation in each resample of the clusters of `key` (one of `cell`).

    Each cluster enters with five sums; the raters' means are those of the whole table. A task returns five sums for each
    resample, however many clusters it holds.
    """
    cells, raters = _centred(beside, [by], cell)
    stats = cells.groupBy(by, F.col(key).cast("string").alias("k")).agg(F.count("*").cast("double").alias("m"), F.sum("n").alias("n"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("a"), F.sum("t").alias("t"), F.sum("q").alias("q"))
    names = ("m", "n", "a", "t", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            group = np.array(batch.column(by).to_pylist(), object)
            x = np.stack([batch.column(c).to_numpy() for c in names], 1)
            keys, at = np.unique(np.array(batch.column("k").to_pylist(), str), return_inverse=True)
            for lo in range(0, len(keys), 1000):
                t = times(list(keys[lo : lo + 1000]), seed, 0, rounds).astype(float)
                for g in sorted(set(group)):
                    rows = np.flatnonzero((group == g) & (at >= lo) & (at < lo + 1000))
                    total[g] = total.get(g, 0) + t[at[rows] - lo].T @ x[rows]
        for g, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * rounds), pa.array(np.arange(rounds), pa.int32()), *[pa.array(s[:, i]) for i in range(5)]], [by, "b", *names])

    sums = stats.mapInArrow(run, f"{by} string, b int, m double, n double, a double, t double, q double").groupBy(by, "b").agg(*[F.sum(c).alias(c) for c in names]).join(raters, by)
    msr, mse = _mean_squares(F.col("m"), F.col("n"), F.col("a"), F.col("t"), F.col("q"), F.col("raters"))
    return sums.withColumns({"msr": msr, "mse": mse}).select(by, "b", F.try_divide(F.col("msr") - F.col("mse"), F.nullif("msr", F.lit(0.0))).alias("icc3k"))


def interval(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row, or one of each group of `by`: percentile interval of 95 %, and the shares of resamples above and below 0."""
    p = lambda q: F.percentile(F.col(value), q)
    return df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("rounds"), p(0.025).alias("low"), p(0.975).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("above"), F.avg((F.col(value) < 0).cast("double")).alias("below"))
