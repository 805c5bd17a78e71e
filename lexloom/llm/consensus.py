"""Consensus of several annotators (problem 3).

A competence-and-spamming mixture: with probability `competence` an annotator's label follows the true
quality of the cell (through one noise matrix that all share), otherwise it is drawn from the annotator's
own guess distribution. Expectation-maximisation yields the posterior of every cell and the competence of
every annotator. Each annotator's scores are coupled with a common scale by ranks (the lowest share of the
labels of all with the same share of the annotator's own), so that strict, mild and narrow annotators are not
taken for spammers.

The ratings of a cell are packed into one row once; each round is then a map over the packed cells and one
sum of soft counts by annotator. Cells of more than `PACKED` ratings, and all cells where there are more
annotators than `BROADCAST_RATERS`, take grouped sums over single ratings instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.components import cut

DIMS = ("difficulty", "meaning", "terminology", "fluency")
LEVELS = 5
#: Up to so many raters their parameters (about 1 kB each) travel with the tasks; beyond, they are joined by shuffle.
BROADCAST_RATERS = 5_000
PACKED = 64  # ratings that one packed cell holds at most
TASK = 300_000  # ratings of a task at least, as each task returns sums for all raters
SETTLED = 2e-4  # gain of log likelihood a label below which the rounds end; it grows in each round, so they do end
#: Gain of log likelihood a label, over guessing alone and given the others' posterior, below which the mixture calls
#: a rater a spammer: the labels are less than 7 % likelier as truthful ones than as guesses.
UNINFORMED = 0.065
BINS = 32
BLOCK = 25_600  # sums that travel as one row

_ND = len(DIMS)
_K = _ND * LEVELS * LEVELS


def clean_ratings(rated: DataFrame) -> DataFrame:
    """The last delivery of each (rater, item, label), with scores outside 1-5 set to null.

    Labels are compared without case and blanks; of deliveries with the same `rated_at` (null is earliest)
    the one with the greatest scores counts, so that the result is one and the same. Rows whose rater,
    item or label is null are left out.
    """
    score = [F.coalesce(F.when(F.col(f"{d}_1_5").between(1, LEVELS), F.col(f"{d}_1_5").cast("int")), F.lit(0)) for d in DIMS]
    base = LEVELS + 1
    packed = F.lit(0)
    for x in score:
        packed = packed * base + x
    # time and scores in one number: it is summed up in place, where a struct would be sorted
    when = F.coalesce(_micros(rated), F.lit("-10000000000000000000").cast("decimal(20,0)"))
    key = (when * F.lit(base**_ND).cast("decimal(5,0)") + packed.cast("decimal(5,0)")).cast("decimal(38,0)")
    rows = rated.select("rater", "item_id", F.upper(F.trim("label")).alias("label"), key.alias("x")).where("rater is not null and item_id is not null and label is not null")
    last = rows.groupBy("rater", "item_id", "label").agg(F.pmod(F.max("x"), F.lit(base**_ND).cast("decimal(5,0)")).cast("int").alias("x"))
    digits = [F.nullif(F.floor(F.col("x") / base ** (_ND - 1 - i)).cast("int") % base, F.lit(0)).alias(d) for i, d in enumerate(DIMS)]
    return last.select("rater", "item_id", "label", *digits)


def _micros(rated: DataFrame) -> Column:
    """`rated_at` as a number that grows with it, whatever the session's time zone."""
    at = F.col("rated_at")
    if dict(rated.dtypes)["rated_at"] != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp")).cast("decimal(20,0)")
    seconds = F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return (seconds.cast("decimal(14,0)") * 1_000_000 + F.extract(F.lit("SECOND"), at) * 1_000_000).cast("decimal(20,0)")


def unblind(ratings: DataFrame, blind_key: DataFrame) -> DataFrame:
    """Ratings with the `system` behind each label; a rating whose leaf is missing is left out."""
    key = blind_key.select("rater", "item_id", F.upper(F.trim("label")).alias("label"), "system").where("system is not null")
    key = key.groupBy("rater", "item_id", "label").agg(F.min("system").alias("system"))
    return ratings.join(key, ["rater", "item_id", "label"]).drop("label")


def _coupling(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The share of each common level that falls to each score of each rater, (raters, dims, scores, levels), where both are laid along their ranks."""

    def ranks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = n + 1e-6  # a score that is never given has hardly any width
        upper = np.cumsum(n, -1) / n.sum(-1, keepdims=True)
        return upper - n / n.sum(-1, keepdims=True), upper

    (a, b), (lo, hi) = ranks(np.asarray(counts, float)), ranks(np.asarray(whole, float))
    shared = np.minimum(b[:, :, :, None], hi[None, :, None, :]) - np.maximum(a[:, :, :, None], lo[None, :, None, :])
    share = np.maximum(shared, 0) + 1e-9
    return share / share.sum(2, keepdims=True)


def _likelihood(coupling: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The probability of each (rater, dim, score) of a truthful label by truth."""
    return np.einsum("rdsl,dtl->rdst", coupling, noise)


def _log_table(theta: np.ndarray, xi: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The log likelihood of each (rater, dim, score, truth)."""
    return np.log(theta[:, :, None, None] * like + (1 - theta)[:, :, None, None] * xi[:, :, :, None])


def _mstep(c: np.ndarray, theta: np.ndarray, xi: np.ndarray, coupling: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(theta, xi, truthful soft counts by dim, truth and common level) from the soft counts (rater, dim, score, truth)."""
    like = _likelihood(coupling, noise)
    p = theta[:, :, None, None] * like
    used = c * p / (p + (1 - theta)[:, :, None, None] * xi[:, :, :, None])
    theta = (used.sum((2, 3)) + 1) / (c.sum((2, 3)) + 2)
    xi = (c - used).sum(3) + 0.5
    return theta, xi / xi.sum(2, keepdims=True), np.einsum("rdst,rdsl->dtl", used / like, coupling) * noise


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _blocks(values: np.ndarray) -> pa.RecordBatch:
    n = -(-len(values) // BLOCK)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([values[i * BLOCK : (i + 1) * BLOCK].astype(np.float32).tobytes() for i in range(n)], pa.binary())], ["block", "sums"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays that `_blocks` cut up; each task of the second step holds the blocks of its own only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                v = np.frombuffer(x, np.float32).astype(float)
                total[i] = total[i] + v if i in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "sums"])

    out = np.zeros(size)
    for r in parts.repartition("block").mapInArrow(run, "block long, sums binary").collect():  # one row a block
        v = np.frombuffer(r.sums)
        out[r.block * BLOCK : r.block * BLOCK + len(v)] = v
    return out


_TAIL = 2 * _ND * LEVELS + _ND + 1  # sums of the posterior, number of cells by dim, log likelihood


@dataclass
class _Round:
    """What one pass needs: the parameters of a round and what to count."""

    logs: np.ndarray
    prior: np.ndarray  # log prior, dims x levels
    like: np.ndarray | None = None  # set: count bins of the truthful likelihood given the others' posterior, for the final competence
    final: bool = False

    def width(self) -> int:
        return _ND * LEVELS * BINS if self.final else _K

    def soft(self, rater: np.ndarray, label: np.ndarray, total: np.ndarray, m: np.ndarray, like: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(keys, values) of what each rating adds; total: log sums of its cell with the prior, m: its own part of them, like: its truthful likelihood by truth."""
        ok = label >= 0
        at = (rater[:, None] * _ND + np.arange(_ND)) * LEVELS + np.maximum(label, 0)
        if not self.final:
            q = _softmax(total)
            return (at[:, :, None] * LEVELS + np.arange(LEVELS))[ok].ravel(), q[ok].ravel()
        a = (_softmax(total - m) * like).sum(2)
        return (at * BINS + np.minimum((a * BINS).astype(int), BINS - 1))[ok], np.ones(int(ok.sum()))

    def parts(self, rater: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.where((label >= 0)[:, :, None], self.logs[rater[:, None], np.arange(_ND)[None], np.maximum(label, 0)], 0.0)

    def likes(self, rater: np.ndarray, label: np.ndarray) -> np.ndarray | None:
        return self.like[rater[:, None], np.arange(_ND)[None], np.maximum(label, 0)] if self.final else None

    def cells(self, total: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Sums over cells: the posterior by dim and level, the cells with a label by dim, the log likelihood."""
        top = total.max(2, keepdims=True)
        e = np.exp(total - top)
        z = e.sum(2, keepdims=True)
        q = np.where(has[:, :, None], e / z, 0.0).sum(0)
        return np.concatenate([q.ravel(), has.sum(0), [np.where(has, (top + np.log(z))[:, :, 0], 0.0).sum()]])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rater number, scores from 0 with -1 for none, first rating of each cell) of packed cells."""
    col = batch.column("packed")
    x = col.flatten().to_numpy()
    first = col.offsets.to_numpy()[:-1] - col.offsets.to_numpy()[0]
    label = np.stack([(x >> (3 * d)) & 7 for d in range(_ND)], 1).astype(np.int64) - 1
    return (x >> 12).astype(np.int64), label, first


def _pack(cells: DataFrame, raters: list[str]) -> DataFrame:
    """(item_id, system, packed): the ratings of each cell as numbers of rater and scores."""
    names = pa.array(raters, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ratings")
            x = col.flatten()
            rater = pa.compute.index_in(x.field("rater"), names).to_numpy(zero_copy_only=False).astype(np.int64)
            out = rater << 12
            for d, name in enumerate(DIMS):
                out |= x.field(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) << (3 * d)
            off = pa.array(col.offsets.to_numpy() - col.offsets.to_numpy()[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("system"), pa.ListArray.from_arrays(off, pa.array(out))], ["item_id", "system", "packed"])

    import pyarrow.compute  # noqa: F401  makes pa.compute known to the tasks

    return cells.mapInArrow(run, "item_id string, system string, packed array<long>")


def _packed_pass(packed: DataFrame, r: _Round, raters: int) -> np.ndarray:
    """The sums of one round over packed cells; those beyond the raters' are those of `_Round.cells`."""
    tail = raters * r.width()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(tail + _TAIL)
        for batch in batches:
            if not batch.num_rows:
                continue
            rater, label, first = _flat(batch)
            m = r.parts(rater, label)
            total = np.add.reduceat(m, first) + r.prior
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rater))))
            k, v = r.soft(rater, label, total[own], m, r.likes(rater, label))
            out[:tail] += np.bincount(k, v, tail)
            has = np.add.reduceat((label >= 0).astype(int), first) > 0
            part = r.cells(total, has)
            out[tail : tail + len(part)] += part
        yield _blocks(out)

    return _summed(packed.mapInArrow(run, "block long, sums binary"), tail + _TAIL)


def _packed_posterior(packed: DataFrame, r: _Round) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rater, label, first = _flat(batch)
            total = np.add.reduceat(r.parts(rater, label), first) + r.prior
            n = np.add.reduceat((label >= 0).astype(np.int64), first)
            q = _softmax(total).reshape(len(first), -1)
            off = pa.array(np.arange(len(first) + 1) * _ND * LEVELS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("system"), pa.ListArray.from_arrays(off, pa.array(q.ravel())), *[pa.array(n[:, d]) for d in range(_ND)]], ["item_id", "system", "q", *[f"n{d}" for d in range(_ND)]])

    return packed.mapInArrow(run, _POSTERIOR)


_POSTERIOR = "item_id string, system string, q array<double>, " + ", ".join(f"n{d} long" for d in range(_ND))


def _by_cell(rows: DataFrame, logs: DataFrame, prior: np.ndarray) -> DataFrame:
    """(item_id, system, total, n0..n3): the log sums of each cell with the prior, by grouped sums in two phases."""
    j = rows.join(logs, "rater")
    part = lambda d, t: F.sum(F.coalesce(F.col("lp")[F.lit(d * LEVELS * LEVELS + t) + F.col(f"l{d}") * LEVELS], F.lit(0.0)))
    sums = j.groupBy("item_id", "system").agg(*[part(d, t).alias(f"s{d}_{t}") for d in range(_ND) for t in range(LEVELS)], *[F.count(f"l{d}").alias(f"n{d}") for d in range(_ND)])
    return sums.select("item_id", "system", F.array(*[F.col(f"s{d}_{t}") + float(prior[d, t]) for d in range(_ND) for t in range(LEVELS)]).alias("total"), *[f"n{d}" for d in range(_ND)])


def _single_pass(rows: DataFrame, logs: DataFrame, cells: DataFrame, r: _Round) -> tuple[DataFrame, np.ndarray]:
    """The sums of one round over single ratings (rater, item_id, system, l0..l3): (rater, k, v), and those of the cells."""
    width = r.width()

    def soft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("rater").dictionary_encode()
            label = np.stack([batch.column(f"l{d}").fill_null(-1).to_numpy(zero_copy_only=False) for d in range(_ND)], 1).astype(np.int64)
            own = lambda c: np.take_along_axis(batch.column(c).flatten().to_numpy().reshape(-1, _ND, LEVELS, LEVELS), np.maximum(label, 0)[:, :, None, None], 2)[:, :, 0]  # noqa: B023, E731
            m = np.where((label >= 0)[:, :, None], own("lp"), 0.0)
            total = batch.column("total").flatten().to_numpy().reshape(-1, _ND, LEVELS)
            k, v = r.soft(names.indices.to_numpy().astype(np.int64), label, total, m, own("like") if r.final else None)
            out = np.bincount(k, v, len(names.dictionary) * width)
            i = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(i // width)), pa.array(i % width), pa.array(out[i])], ["rater", "k", "v"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(_TAIL)
        for batch in batches:
            total = batch.column("total").flatten().to_numpy().reshape(-1, _ND, LEVELS)
            if len(total):
                part = r.cells(total, np.stack([batch.column(f"n{d}").to_numpy() > 0 for d in range(_ND)], 1))
                out[: len(part)] += part
        yield _blocks(out)

    j = rows.join(cells.select("item_id", "system", "total"), ["item_id", "system"]).join(logs, "rater").select("rater", *[f"l{d}" for d in range(_ND)], "lp", "like", "total")
    return j.mapInArrow(soft, "rater string, k long, v double").groupBy("rater", "k").agg(F.sum("v").alias("v")), _summed(cells.mapInArrow(whole, "block long, sums binary"), _TAIL)


@dataclass
class Fit:
    """posterior (item_id, system, q: 20 probabilities, n0..n3), raters (rater, dim, competence, gain, n_labels)."""

    posterior: DataFrame
    raters: DataFrame
    rounds: int


def _score_counts(ratings: DataFrame) -> DataFrame:
    """(rater, counts): how often each rater gave each score on each dimension, 20 numbers."""
    return ratings.groupBy("rater").agg(F.array(*[F.count(F.when(F.col(d) == s, 1)) for d in DIMS for s in range(1, LEVELS + 1)]).alias("counts"))


_PARAMS = "rater string, counts array<long>, theta array<double>, xi array<double>, used array<double>"


def _params(soft: DataFrame, noise: np.ndarray, whole: np.ndarray) -> DataFrame:
    """Parameters of each rater from (rater, counts, theta, xi, cells: (k, v)), and their truthful soft counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rater, counts, theta, xi, cells in zip(b["rater"], b["counts"], b["theta"], b["xi"], b["cells"]):
                c = np.zeros(_K)
                for x in cells:
                    c[x["k"]] = x["v"]
                w = _coupling(np.reshape(counts, (1, _ND, LEVELS)), whole)
                t, x, used = _mstep(c.reshape(1, _ND, LEVELS, LEVELS), np.reshape(theta, (1, -1)), np.reshape(xi, (1, _ND, LEVELS)), w, noise)
                yield pd.DataFrame({"rater": [rater], "counts": [counts], "theta": [t[0]], "xi": [x.ravel()], "used": [used.ravel()]})

    return soft.mapInPandas(run, _PARAMS)


def _logs(params: DataFrame, noise: np.ndarray, whole: np.ndarray) -> DataFrame:
    """(rater, lp, like) of `_log_table` and `_likelihood`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                like = _likelihood(_coupling(np.stack(b["counts"]).reshape(-1, _ND, LEVELS), whole), noise)
                lp = _log_table(np.stack(b["theta"]), np.stack(b["xi"]).reshape(-1, _ND, LEVELS), like)
                yield pd.DataFrame({"rater": b["rater"], "lp": list(lp.reshape(len(b), -1)), "like": list(like.reshape(len(b), -1))})

    return params.select("rater", "counts", "theta", "xi").mapInPandas(run, "rater string, lp array<double>, like array<double>")


def _competence(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(competence, gain of log likelihood over guessing alone, labels) by rater and dim, from the counts (rater, dim, score, bin) of labels
    by their truthful likelihood given the others' posterior."""
    a = (np.arange(BINS) + 0.5) / BINS
    n = c.sum((2, 3))
    alone = (c.sum(3) + 0.5) / (n[:, :, None] + 0.5 * LEVELS)
    theta, xi = np.full(n.shape, 0.5), alone.copy()
    for _ in range(200):
        p = theta[:, :, None, None] * a
        r = p / (p + ((1 - theta)[:, :, None] * xi)[:, :, :, None])
        new = ((c * r).sum((2, 3)) + 1) / (n + 2)
        xi = (c * (1 - r)).sum(3) + 0.5
        xi /= xi.sum(2, keepdims=True)
        moved = np.abs(new - theta).max(initial=0)
        theta = new
        if moved < 1e-4:
            break
    both = np.log(theta[:, :, None, None] * a + ((1 - theta)[:, :, None] * xi)[:, :, :, None])
    return theta, (c * (both - np.log(alone)[:, :, :, None])).sum((2, 3)), n


_RATERS = "rater string, dim string, competence double, gain double, n_labels long"


def _verdicts(names: list[str], c: np.ndarray) -> pd.DataFrame:
    """Rows of _RATERS; `gain` is a label's; dimensions without labels are left out."""
    c = c.reshape(-1, _ND, LEVELS, BINS)
    parts = [_competence(c[i : i + 256]) for i in range(0, len(c), 256)] or [(np.zeros((0, _ND)),) * 3]
    theta, gain, n = (np.concatenate(x) for x in zip(*parts))
    out = pd.DataFrame({"rater": np.repeat(np.array(names, object), _ND), "dim": list(DIMS) * len(names), "competence": theta.ravel(), "gain": (gain / np.maximum(n, 1)).ravel(), "n_labels": np.round(n).astype(np.int64).ravel()})
    return out[out.n_labels > 0]


def _many_verdicts(counts: DataFrame) -> DataFrame:
    """`_verdicts` from (rater, k, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = np.zeros((len(b), _ND * LEVELS * BINS))
            for i, cells in enumerate(b["cells"]):
                for x in cells:
                    c[i, x["k"]] = x["v"]
            yield _verdicts(list(b["rater"]), c)

    lists = counts.groupBy("rater").agg(F.collect_list(F.struct("k", "v")).alias("cells"))  # at most 640 each
    return lists.mapInPandas(run, _RATERS)


def fit(ratings: DataFrame) -> Fit:
    """Expectation-maximisation over ratings (rater, item_id, system, difficulty, meaning, terminology, fluency).

    A cell is (item_id, system). Null scores say nothing; a cell or rater without any score gets no row; an
    empty table gives empty results. A cell or rater may hold any share of the rows: sums are taken in two
    phases, and only cells of at most PACKED ratings are gathered.
    """
    spark = ratings.sparkSession
    ratings = cut(ratings.select("rater", F.col("item_id").cast("string").alias("item_id"), F.col("system").cast("string").alias("system"), *DIMS))
    counts = cut(_score_counts(ratings))
    n_raters = counts.count()
    sums = counts.agg(*[F.sum(F.col("counts")[i]) for i in range(_ND * LEVELS)]).first()
    whole = np.array([x or 0 for x in sums], float).reshape(_ND, LEVELS)
    few = n_raters <= BROADCAST_RATERS
    hot = cut(ratings.groupBy("item_id", "system").count().where(F.col("count") > (PACKED if few else 0)).select("item_id", "system")) if few else None
    any_hot = few and not hot.isEmpty()
    packed = single = None
    names: list[str] = []
    if few:
        got = counts.orderBy("rater").collect()  # at most BROADCAST_RATERS rows
        names = [r.rater for r in got]
        coupling = _coupling(np.array([r.counts for r in got], float).reshape(-1, _ND, LEVELS), whole)
        rest = ratings.join(hot, ["item_id", "system"], "left_anti") if any_hot else ratings
        cells = rest.groupBy("item_id", "system").agg(F.collect_list(F.struct("rater", *DIMS)).alias("ratings"))  # at most PACKED each
        packed = cut(_pack(cells, names).coalesce(max(1, int(whole.sum() / _ND / TASK))))
    if not few or any_hot:
        rest = ratings.join(hot, ["item_id", "system"], "left_semi") if few else ratings
        single = rest.select("rater", "item_id", "system", *[(F.col(x) - 1).cast("int").alias(f"l{d}") for d, x in enumerate(DIMS)])
    dist = np.abs(np.arange(LEVELS)[:, None] - np.arange(LEVELS)[None, :])
    noise = np.exp(-1.2 * dist)
    noise = np.repeat((noise / noise.sum(1, keepdims=True))[None], _ND, 0)  # d, T, l
    prior = np.full((_ND, LEVELS), 1 / LEVELS)
    theta, xi = np.full((len(names), _ND), 0.8), np.full((len(names), _ND, LEVELS), 1 / LEVELS)
    params = None if few else counts.select("rater", "counts", F.array_repeat(F.lit(0.8), _ND).alias("theta"), F.array_repeat(F.lit(1 / LEVELS), _ND * LEVELS).alias("xi"))
    number = {x: i for i, x in enumerate(names)}

    def one(final: bool) -> tuple[np.ndarray, np.ndarray, DataFrame | None, _Round, DataFrame | None]:
        """(soft counts of the known raters, sums over cells, soft counts of many raters, the round, cells of single ratings)."""
        like = _likelihood(coupling, noise) if few else np.zeros((0, _ND, LEVELS, LEVELS))
        r = _Round(_log_table(theta, xi, like), np.log(prior), like, final)
        width = r.width()
        c, tail, many, totals = np.zeros(len(names) * width), np.zeros(_TAIL), None, None
        if packed is not None:
            flat = _packed_pass(packed, r, len(names))
            c, tail = flat[: len(c)], flat[len(c) :]
        if single is not None:
            if few:
                table = F.broadcast(spark.createDataFrame([(x, r.logs[i].ravel().tolist(), like[i].ravel().tolist()) for i, x in enumerate(names)], "rater string, lp array<double>, like array<double>"))
            else:
                table = _logs(params, noise, whole)
            totals = cut(_by_cell(single, table, np.log(prior)))
            many, sums = _single_pass(single, table, totals, r)
            tail += sums
            if few:
                for x in many.toPandas().itertuples(index=False):
                    c[number[x.rater] * width + x.k] += x.v
                many = None
        return c, tail, many, r, totals

    last, rounds = -np.inf, 0
    while True:
        c, tail, many, _, _ = one(False)
        seen = tail[_ND * LEVELS : _ND * LEVELS + _ND]
        if not seen.any():
            break
        rounds += 1
        if few:
            theta, xi, used = _mstep(c.reshape(-1, _ND, LEVELS, LEVELS), theta, xi, coupling, noise)
        else:
            cells = many.groupBy("rater").agg(F.collect_list(F.struct("k", "v")).alias("cells"))  # at most 100 each
            params = cut(_params(cells.join(params.select("rater", "counts", "theta", "xi"), "rater"), noise, whole))
            used = np.array(params.agg(*[F.sum(F.col("used")[i]) for i in range(_K)]).first()).reshape(_ND, LEVELS, LEVELS)
        prior = np.maximum(tail[: _ND * LEVELS].reshape(_ND, LEVELS) / np.maximum(seen, 1)[:, None], 1e-6)
        noise = used + 1
        noise /= noise.sum(2, keepdims=True)
        if tail[_ND * LEVELS + _ND] - last < SETTLED * whole.sum():
            break
        last = tail[_ND * LEVELS + _ND]
    c, _, many, r, totals = one(True)
    raters = spark.createDataFrame(_verdicts(names, c), _RATERS) if few else _many_verdicts(many)
    posterior = None if packed is None else _packed_posterior(packed, r)
    if totals is not None:
        q = []
        for d in range(_ND):
            s = [F.col("total")[d * LEVELS + t] for t in range(LEVELS)]
            e = [F.exp(x - F.greatest(*s)) for x in s]
            q += [x / (e[0] + e[1] + e[2] + e[3] + e[4]) for x in e]
        wide = totals.select("item_id", "system", F.array(*q).alias("q"), *[f"n{d}" for d in range(_ND)])
        posterior = wide if posterior is None else posterior.unionByName(wide)
    return Fit(posterior.where(" + ".join(f"n{d}" for d in range(_ND)) + " > 0"), raters, rounds)


def _fit(spark: SparkSession, sf_dir: str) -> Fit:
    rated, key = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("rated", "blind_key"))
    return fit(unblind(clean_ratings(rated), key))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).raters.where(F.col("gain") < UNINFORMED).select("rater", "dim")


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rater and dimension: share of truthful labels, gain of log likelihood a label over guessing alone, number of labels."""
    return _fit(spark, sf_dir).raters.select("rater", "dim", F.round("competence", 6).alias("competence"), F.round("gain", 6).alias("gain"), "n_labels")


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell and dimension with a score: the most probable level, the expected level, its probability and the number of scores."""
    q = F.slice("q", F.col("d") * LEVELS + 1, LEVELS)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(name).alias("dim"), F.col(f"n{d}").alias("n_scores")) for d, name in enumerate(DIMS)])).alias("x")
    rows = _fit(spark, sf_dir).posterior.select("item_id", "system", "q", each).select("item_id", "system", "q", "x.*").where("n_scores > 0").withColumn("p", q)
    expected = F.aggregate(F.transform("p", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    top = F.array_max("p")
    return rows.select("item_id", "system", "dim", F.array_position("p", top).cast("int").alias("consensus"), F.round(expected, 6).alias("expected"), F.round(top, 6).alias("probability"), "n_scores")


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha for interval scores of each dimension, over cells with two scores or more."""
    rated, key = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("rated", "blind_key"))
    rows = unblind(clean_ratings(rated), key)
    long = rows.select("item_id", "system", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("s")) for d in DIMS])).alias("x")).select("item_id", "system", "x.*").where("s is not null")
    cells = long.groupBy("item_id", "system", "dim").agg(F.count("*").alias("n"), F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("b")).where("n > 1")
    total = cells.groupBy("dim").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_scores"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum((F.col("n") * F.col("b") - F.col("a") * F.col("a")) / (F.col("n") - 1)).alias("within"))
    observed = F.col("within") / F.col("n_scores")
    chance = (F.col("n_scores") * F.col("b") - F.col("a") * F.col("a")) / (F.col("n_scores") * (F.col("n_scores") - 1))
    return total.select("dim", "n_cells", "n_scores", F.round(1 - F.try_divide(observed, chance), 6).alias("alpha"))


_AGREEMENT = f"""
with r as (select rater, item_id, upper(trim(label)) as label, rated_at, {', '.join(f"case when {d}_1_5 between 1 and 5 then {d}_1_5 end as {d}" for d in DIMS)} from rated where rater is not null and item_id is not null and label is not null),
     last as (select * from (select *, row_number() over (partition by rater, item_id, label order by rated_at desc nulls last, {', '.join(f'{d} desc nulls last' for d in DIMS)}) as k from r) where k = 1),
     k as (select rater, item_id, upper(trim(label)) as label, min(system) as system from blind_key where system is not null group by all),
     u as (select item_id, system, {', '.join(DIMS)} from last join k using (rater, item_id, label)),
     long as (select item_id, system, dim, s::double as s from u unpivot (s for dim in ({', '.join(DIMS)}))),
     c as (select item_id, system, dim, count(*) as n, sum(s) as a, sum(s * s) as b from long group by all having count(*) > 1),
     t as (select dim, count(*) as n_cells, sum(n)::bigint as n_scores, sum(a) as a, sum(b) as b, sum((n * b - a * a) / (n - 1)) as w from c group by dim)
select dim, n_cells, n_scores, round(1 - (w / n_scores) / nullif((n_scores * b - a * a) / (n_scores::double * (n_scores - 1)), 0), 6) as alpha from t
"""

QUERIES = {"p3_found": p3_found, "p3_reliability": p3_reliability, "p3_consensus": p3_consensus, "p3_agreement": p3_agreement}
SQL = {"p3_agreement": _AGREEMENT}
