"""Long exact spans shared between records (problem 6).

Paragraphs here are all stretches of `SPAN` characters, each the set of its grams of `GRAM` characters.
A stretch that two texts share letter for letter has the same least gram hash in both, so one MinHash
band per stretch (the extreme of the banding curve: recall 1) makes every sharing pair collide. Colliding
texts are joined (a band that many texts share is first refined to whole stretches, so that boilerplate
shorter than a stretch brings no candidates), their shared spans are verified character by character and extended to full length,
and the removals are clustered by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.llm.components import components, cut

SPAN = 200
GRAM = 120
CROWD = 64  # texts that may share a band key before it is refined to whole stretches


def band_keys(col: pa.Array, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct least gram hashes of the stretches of each text."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in K.chunks(col):
        cps, starts = K.code_points(col.slice(a, b - a))
        n = len(cps) - gram + 1
        if n <= 0:
            continue
        at = np.arange(n)
        h = K.span_hash(K.prefix(cps), at, at + gram)
        own = np.repeat(np.arange(b - a), np.diff(starts))[:n]
        m = K.sliding_min(h, span - gram + 1)
        own = own[: len(m)]
        within = at[: len(m)] + span <= starts[own + 1]  # stretches must not cross into the next text
        new = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (own[1:] != own[:-1]) | ~within[:-1])[: len(m)] & within)
        rows.append(own[new] + a)
        keys.append(m[new])
    return np.concatenate(rows), np.concatenate(keys)


def refined_keys(text: str, crowded: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Hashes of the whole stretches of a text whose least gram has one of the crowded keys."""
    cps, _ = K.code_points(pa.array([text], pa.large_string()))
    if len(cps) < span:
        return np.zeros(0, np.uint64)
    p = K.prefix(cps)
    at = np.arange(len(cps) - gram + 1)
    m = K.sliding_min(K.span_hash(p, at, at + gram), span - gram + 1)
    s = np.flatnonzero(np.isin(m, crowded))
    return np.unique(K.span_hash(p, s, s + span))


def _refined(texts: DataFrame, crowded: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, th, ih) where texts in crowded bands meet only in whole stretches that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for th, ih, text, keys in zip(*(batch.column(c).to_pylist() for c in ("th", "ih", "text", "keys"))):
                k = refined_keys(text, np.array(keys, np.int64).view(np.uint64), span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), th)), pa.array(np.full(len(k), ih))], ["key", "th", "ih"])

    rows = texts.join(crowded, "th").groupBy("th", "ih").agg(F.first("text").alias("text"), F.first("keys").alias("keys"))
    return rows.select("th", "ih", "text", "keys").mapInArrow(run, "key long, th long, ih long")


def _shared_only(keys: DataFrame) -> DataFrame:
    """The distinct rows of keys that texts of different ids hold; the keys are computed twice, not stored."""
    several = keys.groupBy("key").agg(F.min("ih").alias("lo"), F.max("ih").alias("hi")).where("lo < hi").select("key")
    return cut(keys.join(several, "key", "left_semi").distinct())


def _keys(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, th, ih) of each distinct (text hash, id hash) of a batch and band key of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th, ih = batch.column("th").to_numpy(), batch.column("ih").to_numpy()
            _, first, inv = np.unique(th, return_index=True, return_inverse=True)
            row, key = band_keys(batch.column("text").take(pa.array(first)), span, gram)
            owners = np.unique(np.stack([inv, ih]), axis=1)  # the ids of each distinct text
            lo, hi = np.searchsorted(owners[0], row), np.searchsorted(owners[0], row, side="right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n).view(np.int64)), pa.array(th[first][np.repeat(row, n)]), pa.array(owners[1][at])], ["key", "th", "ih"])

    return texts.mapInArrow(run, "key long, th long, ih long")


def matches(a: str, b: str, span: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of maximal equal stretches of at least `span` characters.

    Every stretch of `a` that also stands in `b`, and the reverse, lies within the result.
    """
    if len(a) < span or len(b) < span:
        return []
    col = pa.array([a, b], pa.large_string())
    cps, starts = K.code_points(col)
    p = K.prefix(cps)
    sa, sb = np.arange(len(a) - span + 1), len(a) + np.arange(len(b) - span + 1)
    ha, hb = K.span_hash(p, sa, sa + span), K.span_hash(p, sb, sb + span)
    if a == b:
        return [(0, 0, len(a))]
    out = []
    for left, right, flip in ((ha, hb, False), (hb, ha, True)):
        o = np.argsort(right, kind="stable")
        i = np.minimum(np.searchsorted(right[o], left), len(right) - 1)
        hit = np.flatnonzero(right[o][i] == left)
        where = o[i[hit]]
        x, y = (a, b) if not flip else (b, a)
        k = 0
        while k < len(hit):
            j = k
            while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1 and where[j + 1] == where[j] + 1:
                j += 1
            s, t, n = int(hit[k]), int(where[k]), int(hit[j] - hit[k]) + span
            if x[s : s + n] == y[t : t + n]:
                out.append((s, t, n) if not flip else (t, s, n))
            k = j + 1
    return sorted(set(out))


def _starred(keys: DataFrame) -> DataFrame:
    """(ta, tb): each text of a key with one text of another id that stands for the key, so that the pairs grow with the texts."""
    ends = keys.groupBy("key").agg(F.min(F.struct("ih", "th")).alias("lo"), F.max(F.struct("ih", "th")).alias("hi"))
    other = F.when(F.col("lo.ih") != F.col("ih"), F.col("lo.th")).otherwise(F.col("hi.th"))
    pairs = keys.join(ends, "key").select("th", other.alias("o")).where("th <> o")
    return pairs.select(F.least("th", "o").alias("ta"), F.greatest("th", "o").alias("tb")).distinct()


def shared_spans(records: DataFrame, fields: tuple[str, ...] = ("src", "rew"), span: int = SPAN, gram: int = GRAM, every_pair: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared spans of the texts in `fields` of records (row_id, id) with different ids.

    Returns (owners, texts, pairs): owners (th, id, row_id, field) of the texts that share a span,
    texts (th, text) and pairs (ta, tb, spans) of text hashes with the verified spans, ta = tb where
    one text belongs to several ids. A null or empty text, one shorter than `span`, and a row of null id or
    row_id share nothing. Copies of a text are one text; other columns are ignored. Without `every_pair` the texts
    of a stretch that more than CROWD texts share are only paired with one that stands for them all, which keeps
    what each text shares and the components.
    """
    cols = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    base = records.where("id is not null and row_id is not null").select("row_id", F.col("id").cast("string").alias("id"), F.explode(F.array(*cols)).alias("x")).select("row_id", "id", "x.field", "x.text")
    base = base.where(F.length("text") >= span).withColumns({"th": F.xxhash64("text"), "ih": F.xxhash64("id")})
    rows = base.select("th", "ih", "text")
    keys = _shared_only(_keys(rows, span, gram))
    counted = keys.select("key", "th").distinct().groupBy("key").count().where(F.col("count") > CROWD).select("key")
    crowded = cut(keys.join(counted, "key", "left_semi").groupBy("th").agg(F.collect_set("key").alias("keys")))
    many = keys.groupBy("th").agg(F.min("ih").alias("lo"), F.max("ih").alias("hi"))
    stars = None
    if not crowded.isEmpty():
        refined = _shared_only(_refined(rows, crowded, span, gram))
        keys = keys.join(counted, "key", "left_anti")
        if every_pair:
            keys = keys.unionByName(refined)
        else:
            stars = _starred(refined)
    a = keys.select("key", F.col("th").alias("ta"), F.col("ih").alias("ia"))
    b = keys.select("key", F.col("th").alias("tb"), F.col("ih").alias("ib"))
    cand = a.join(b, "key").where("ta < tb and ia <> ib").select("ta", "tb")
    cand = cut((cand if stars is None else cand.unionByName(stars)).distinct())
    same = many.where("lo < hi").select(F.col("th").alias("ta"), F.col("th").alias("tb"))
    wanted = cand.select(F.col("ta").alias("th")).union(cand.select("tb")).union(same.select("ta")).distinct()
    owned = base.join(wanted, "th", "left_semi")
    texts = cut(owned.groupBy("th").agg(F.first("text").alias("text")))
    owners = cut(owned.select("th", "id", "row_id", "field").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            keep, spans = [], []
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())):
                if found := matches(x, y, span):
                    keep.append(i)
                    spans.append([{"sa": s, "sb": t, "n": n} for s, t, n in found])
            yield pa.RecordBatch.from_arrays([pa.array([ta[i] for i in keep], pa.int64()), pa.array([tb[i] for i in keep], pa.int64()), pa.array(spans, pa.list_(pa.struct([("sa", pa.int32()), ("sb", pa.int32()), ("n", pa.int32())])))], ["ta", "tb", "spans"])

    both = cand.union(same).join(texts.select(F.col("th").alias("ta"), F.col("text").alias("xa")), "ta").join(texts.select(F.col("th").alias("tb"), F.col("text").alias("xb")), "tb")
    pairs = both.select("ta", "tb", "xa", "xb").mapInArrow(verify, "ta long, tb long, spans array<struct<sa:int,sb:int,n:int>>")
    return owners, texts, cut(pairs)


def row_pairs(owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: the pairs of rows with different ids behind the pairs of texts."""
    a = owners.select(F.col("th").alias("ta"), F.col("id").alias("ia"), F.col("row_id").alias("ra")).distinct()
    b = owners.select(F.col("th").alias("tb"), F.col("id").alias("ib"), F.col("row_id").alias("rb")).distinct()
    j = pairs.select("ta", "tb").join(a, "ta").join(b, "tb").where("ia <> ib and ra <> rb")
    return j.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners, _, pairs = shared_spans(spark.read.parquet(f"{sf_dir}/scored.parquet"))
    return row_pairs(owners, pairs)


def row_shares(records: DataFrame, fields: tuple[str, ...] = ("src", "rew"), span: int = SPAN) -> DataFrame:
    """(row_id, n_chars, shared_chars, share, cluster) of each record.

    `share` is the part of the record's texts that lies within spans found in records of other ids,
    0 where nothing is shared and null for a record without text. `cluster` is the least text hash of the
    connected texts (null where nothing is shared). Repeated rows of one row_id give one row.
    """
    owners, texts, pairs = shared_spans(records, fields, span, every_pair=False)
    one = pairs.where("ta <> tb").select("ta", F.explode("spans").alias("s"), "tb")
    side = one.select(F.col("ta").alias("th"), F.col("s.sa").alias("at"), F.col("s.n").alias("n")).union(one.select("tb", "s.sb", "s.n"))
    # a text of several ids is found in another record as a whole
    side = side.union(pairs.where("ta = tb").join(texts, F.col("ta") == F.col("th")).select("th", F.lit(0), F.length("text"))).distinct()
    # union of intervals: a window over the starts of each text carries the furthest end so far
    reach = F.expr("max(at + n) over (partition by th order by at, n rows between unbounded preceding and 1 preceding)")
    covered = side.withColumn("reach", F.coalesce(reach, F.lit(0))).groupBy("th").agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "reach"))).alias("shared"))
    links = components(pairs.select(F.col("ta").alias("a"), F.col("tb").alias("b")))
    per_row = owners.join(covered, "th").join(links.withColumnRenamed("node", "th"), "th").groupBy("row_id", "field").agg(F.max("shared").alias("shared"), F.min("component").alias("cluster"))
    per_row = per_row.groupBy("row_id").agg(F.sum("shared").alias("shared_chars"), F.min("cluster").alias("cluster"))
    total = None
    for f in fields:
        n = F.coalesce(F.length(f), F.lit(0))
        total = n if total is None else total + n
    base = records.where("row_id is not null").groupBy("row_id").agg(F.max(total).cast("long").alias("n_chars"))
    out = base.join(per_row, "row_id", "left")
    return out.select("row_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.expr("try_divide(coalesce(shared_chars, 0), n_chars)"), 6).alias("share"), "cluster")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_shares(spark.read.parquet(f"{sf_dir}/scored.parquet"))


QUERIES = {"p6_found": p6_found, "p6_shares": p6_shares}
