"""Lexicon, graph and vector retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries are searched for in blocks of about so many vectors; a block travels with the tasks.
BLOCK = 2_000


def unit(v: Column) -> Column:
    """The vector over its length (plus 1e-9), in double precision."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(d, lambda x: x / (F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, y: a + y * y)) + 1e-9))


def dense_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
    """(q, key, sim, rank): the k vectors of greatest inner product with each query vector, ties by key.

    Exact. The query vectors are a stated set and are taken in blocks; each task keeps the best k of its rows
    for each query, so that at most k rows a query and task are shuffled. Null vectors and keys are left out; a
    query is not compared with its own key.
    """
    q = queries.where(f"{key} is not null and {vector} is not null").select(key, vector)
    blocks = max(1, -(-q.count() // BLOCK))
    v = vectors.where(f"{key} is not null and {vector} is not null").select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    parts = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        ids = np.array([r[0] for r in rows], np.int64)
        mat = np.array([r[1] for r in rows], np.float64)

        def scan(batches, ids=ids, mat=mat):
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                keys = batch.column("key").to_numpy()
                col = batch.column("v")
                x = col.flatten().to_numpy().reshape(len(keys), -1)
                # sums in a fixed order, so that ties come out alike everywhere
                sim = np.zeros((len(ids), len(keys)))
                for j in range(x.shape[1]):
                    sim += mat[:, j, None] * x[None, :, j]
                sim[ids[:, None] == keys[None, :]] = -np.inf
                # only what reaches the k-th best is sorted
                least = -np.partition(-sim, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1]
                r, c = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
                o = np.lexsort((keys[c], -sim[r, c], r))
                r, c = r[o], c[o]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[best], c[best]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(keys[c]), pa.array(sim[r, c])], ["q", "key", "sim"])

        part = v.mapInArrow(scan, "q long, key long, sim double")
        parts = part if parts is None else parts.unionByName(part)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "key")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def edges(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term) of each text that contains a term, anywhere and in any case. The lexicon is of fixed size."""
    all_terms = terms.agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    rows = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low")).crossJoin(F.broadcast(all_terms))  # one row
    return rows.select(key, F.explode(F.filter("_terms", lambda t: F.contains(F.col("_low"), t))).alias("term"))


def graph_scores(query_edges: DataFrame, doc_edges: DataFrame, key: str) -> DataFrame:
    """(q, key, graph): 0.4 times the share of the query's terms that a document has, for documents that share any.

    Pairs come from equal terms only, and are summed before they leave a task.
    """
    q = query_edges.select(F.col(key).alias("q"), "term").distinct()
    n = q.groupBy("q").agg(F.count("*").alias("n"))
    j = q.join(doc_edges.select(key, "term").distinct(), "term").where(F.col("q") != F.col(key))
    return j.groupBy("q", key).agg(F.count("*").alias("shared")).join(n, "q").select("q", key, (0.4 * F.col("shared") / F.greatest(F.lit(1), "n")).alias("graph"))


def leading(df: DataFrame, by: str, key: str, k: int, parts: int = 64) -> DataFrame:
    """The k rows of least key of each group; a group is first cut into parts, so that it may hold any share of the rows."""
    part = F.row_number().over(Window.partitionBy(by, F.pmod(F.xxhash64(key), F.lit(parts))).orderBy(key))
    whole = F.row_number().over(Window.partitionBy(by).orderBy(key))
    return df.withColumn("_k", part).where(F.col("_k") <= k).withColumn("_k", whole).where(F.col("_k") <= k).drop("_k")


def label_scores(queries: DataFrame, labels: DataFrame, dense: DataFrame, key: str, k: int) -> DataFrame:
    """(q, key, graph): what `graph_scores` gives for graphs of one term a document, of the pairs that can be among the k best of a fusion.

    All documents of a query's label score alike, so beside those in `dense` only the first k by key can be among the best;
    the pairs grow with the queries, not with the label. `queries` and `labels` are (key, term), `dense` is (q, key, sim).
    """
    q = queries.where("term is not null").select(F.col(key).alias("q"), "term").distinct()
    d = labels.where("term is not null").select(key, "term").distinct()
    first = q.join(leading(d, "term", key, k + 1), "term").where(F.col("q") != F.col(key)).select("q", key)
    near = dense.select("q", key).join(q, "q").join(d, [key, "term"]).select("q", key)
    return first.union(near).distinct().withColumn("graph", F.lit(0.4))


def fused(dense: DataFrame, graph: DataFrame, key: str, k: int = 2) -> DataFrame:
    """(q, key, score, rank): the k best of 0.7 times the dense similarity plus the graph score, ties by key."""
    j = dense.select("q", key, "sim").join(graph.select("q", key, "graph"), ["q", key], "full")
    s = j.select("q", key, (0.7 * F.coalesce("sim", F.lit(0.0)) + F.coalesce("graph", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_context(terms: Column, definitions: Column, most: int = 6) -> Column:
    """One line for each of the first terms, with its definition if it has one."""
    line = lambda t: F.concat(F.lit('- Term "'), t, F.lit('"'), F.when(F.coalesce(F.try_element_at(definitions, t), F.lit("")) != "", F.concat(F.lit(": "), F.try_element_at(definitions, t))).otherwise(""))
    return F.array_join(F.transform(F.slice(terms, 1, most), line), "\n")


def token_sets(sentences: Column) -> Column:
    """The distinct lower-case words of each sentence of an array."""
    from lexloom.functions import text as T

    return F.transform(sentences, lambda x: F.array_distinct(T.lower_tokens(x)))


def best_match(own: Column, others: Column) -> Column:
    """(match, jaccard) of the first of the word sets `others` of greatest Jaccard similarity with the word set `own`; null if all are 0.

    Works within the row: only its own sentences meet and nothing is shuffled.
    """
    jaccard = lambda y: F.coalesce(F.try_divide(F.size(F.array_intersect(own, y)).cast("double"), F.size(F.array_union(own, y))), F.lit(0.0))
    best = F.array_max(F.transform(others, lambda y, i: F.struct(jaccard(y).alias("jaccard"), (-i).alias("m"))))
    return F.when(best["jaccard"] > 0, F.struct((-best["m"]).alias("match"), best["jaccard"].alias("jaccard")))


def ngram_matches(df: DataFrame, by: str, out: str, ref: str, most: int = 5) -> DataFrame:
    """(by, n, matched, total): n-grams of the word arrays `out`, and those of them that `ref` of the same row holds, each as often as there.

    A batch numbers its words and compares counted n-grams row by row in arrays; only the sums leave a task. Null
    arrays have no n-grams.
    """

    def grams(col: pa.Array, words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of each n-gram: numbers are those of equal n-grams within the batch."""
        flat = pc.index_in(col.flatten(), words).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        k = max(len(flat) - n + 1, 0)
        at = np.flatnonzero(row[:k] == row[n - 1 : n - 1 + k])
        return row[at], np.stack([flat[at + i] for i in range(n)], 1)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("g").to_pylist()
            o, r = batch.column("o"), batch.column("r")
            words = pc.unique(pa.concat_arrays([o.flatten(), r.flatten()]))
            of = {g: i for i, g in enumerate(dict.fromkeys(group))}
            at = np.array([of[g] for g in group])
            for n in range(1, most + 1):
                (ro, go), (rr, gr) = grams(o, words, n), grams(r, words, n)
                u, inv = np.unique(np.concatenate([np.column_stack([ro, go]), np.column_stack([rr, gr])]), axis=0, return_inverse=True)
                inv = inv.ravel()
                co, cr = np.bincount(inv[: len(ro)], minlength=len(u)), np.bincount(inv[len(ro) :], minlength=len(u))
                total = np.bincount(at[ro], minlength=len(of))
                matched = np.bincount(at[u[:, 0]], np.minimum(co, cr), len(of)) if len(u) else np.zeros(len(of))
                for g, i in of.items():
                    a = sums.setdefault((g, n), [0, 0])
                    a[0] += int(matched[i])
                    a[1] += int(total[i])
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *[pa.array([sums[k][i] for k in keys], pa.int64()) for i in (0, 1)]], [by, "n", "matched", "total"])

    parts = df.select(F.col(by).cast("string").alias("g"), F.col(out).alias("o"), F.col(ref).alias("r")).mapInArrow(run, f"{by} string, n int, matched long, total long")
    return parts.groupBy(by, "n").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))
