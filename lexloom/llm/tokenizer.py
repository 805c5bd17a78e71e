"""Byte-pair encoding of whole columns with a public vocabulary (problem 7).

Texts are cut into pre-tokens by the vocabulary's published pattern, computed as array passes over
character classes. Each distinct pre-token is encoded once per worker: its byte positions are the
leaves of a segment tree whose root is the leftmost pair of lowest rank, a merge updates the leaves
of the live neighbours and their ancestors only, and all new pre-tokens of a chunk merge in step.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import kernel as K

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 2_000_000  # pre-tokens a worker remembers; beyond that it starts afresh, with the same results
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4

#: The code points of Unicode White_Space beyond ASCII.
WIDE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _kind(cp: int) -> int:
    if 9 <= cp <= 13 or cp == 32 or cp in WIDE_SPACE:
        return SPACE
    c = unicodedata.category(chr(cp))[0]
    return LETTER if c == "L" else NUMBER if c == "N" else OTHER


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.array([_kind(c) for c in range(1 << 16)], np.uint8)


def kinds(cps: np.ndarray) -> np.ndarray:
    table = _kinds()
    if cps.dtype == np.uint8 or not len(cps) or cps.max() < 1 << 16:
        return table[cps]
    out = table[np.minimum(cps, 0xFFFF)]
    far = np.flatnonzero(cps > 0xFFFF)
    u, inv = np.unique(cps[far], return_inverse=True)
    out[far] = np.array([_kind(int(c)) for c in u], np.uint8)[inv]
    return out


def pretokens(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of all texts (they cover every character)."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds(cps)
    first = np.zeros(n + 1, bool)
    first[starts[:-1]] = True
    first[n] = True
    edge = np.ones(n, bool)
    edge[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    edge_next = np.append(edge[1:], True)
    # the last white space before other text leaves its run: a space joins the next pre-token, any other stands alone
    last = (kind == SPACE) & edge_next & ~first[1 : n + 1]
    begin = edge | last
    joined = np.flatnonzero(last & (cps == 32)) + 1
    begin[joined] = False
    # contractions: a lone apostrophe that no space precedes, before s t m d or re ve ll
    q = np.flatnonzero((cps == 39) & begin & edge & edge_next & ~first[1 : n + 1])
    if len(q):
        q = q[kind[q + 1] == LETTER]
        c = np.append(cps, [0, 0])
        same = np.append(first, [True])
        one = np.isin(c[q + 1], [115, 116, 109, 100])
        two = ((np.isin(c[q + 1], [114, 118]) & (c[q + 2] == 101)) | ((c[q + 1] == 108) & (c[q + 2] == 108))) & ~same[q + 2]
        for hit, size in ((one, 1), (two & ~one, 2)):
            at = q[hit]
            begin[at + 1] = False
            after = at + 1 + size
            after = after[after < n]
            begin[after[(kind[after] == LETTER) & ~first[after]]] = True
    return np.flatnonzero(begin)


class Bpe:
    """Encoder of one rank file; use `Bpe.load`, which keeps one per worker process."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.shift = np.int64(1 << 17)
        pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair[a * (1 << 17) + b] = rank
        self.keys = np.array(sorted(pair), np.int64)
        self.vals = np.array([pair[int(k)] for k in self.keys], np.int64)
        self.ranks = ranks
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Bpe:
        return Bpe(path)

    def rank(self, a: np.ndarray, b: np.ndarray, none: np.int64) -> np.ndarray:
        """Rank of each pair of ids, or `none`."""
        key = a * self.shift + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.vals[i], none)

    def merge(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each) of words of at least one byte."""
        n = len(begin)
        counts = np.zeros(n, np.int64)
        parts: dict[int, np.ndarray] = {}
        order: list[np.ndarray] = []
        level = np.ceil(np.log2(np.maximum(length, 2))).astype(int)
        for lv in np.unique(level):
            words = np.flatnonzero(level == lv)
            step = max(1, (1 << 21) >> int(lv))
            for a in range(0, len(words), step):
                some = words[a : a + step]
                ids, live = self._merge_sized(data, begin[some], length[some], 1 << int(lv))
                counts[some] = live.sum(1)
                parts[len(order)] = ids[live]
                order.append(some)
        out = np.zeros(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        for i, some in enumerate(order):
            c = counts[some]
            base = np.repeat(ends[some] - c - (np.cumsum(c) - c), c)
            out[base + np.arange(int(c.sum()))] = parts[i]
        return out, counts

    def _merge_sized(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(begin)
        pos = np.arange(size)
        live = pos[None, :] < length[:, None]
        sym = np.where(live, self.byte[data[np.minimum(begin[:, None] + pos[None, :], max(len(data) - 1, 0))]], -1)
        nxt = np.where(pos[None, :] + 1 < length[:, None], pos[None, :] + 1, size)
        prv = np.broadcast_to(pos - 1, (n, size)).copy()
        none = np.int64(1 << 40)
        tree = np.full((n, 2 * size), none, np.int64)
        if size > 1:
            r = self.rank(sym[:, :-1], np.where(live[:, 1:], sym[:, 1:], -1), none)
            tree[:, size : 2 * size - 1] = np.where(r < none, r * size + pos[None, :-1], none)
        width = size
        while width > 1:  # each level holds the minimum of its two children
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half
        w = np.flatnonzero(tree[:, 1] < none)
        while len(w):
            root = tree[w, 1]
            i, rank = root % size, root // size
            j = nxt[w, i]
            k = nxt[w, j]
            sym[w, i] = rank
            live[w, j] = False
            nxt[w, i] = k
            has = k < size
            prv[w[has], k[has]] = i[has]
            p = prv[w, i]
            after = self.rank(rank, np.where(has, sym[w, np.minimum(k, size - 1)], -1), none)
            before = self.rank(np.where(p >= 0, sym[w, np.maximum(p, 0)], -1), rank, none)
            tree[w, size + j] = none
            tree[w, size + i] = np.where(after < none, after * size + i, none)
            b = p >= 0
            tree[w[b], size + p[b]] = np.where(before[b] < none, before[b] * size + p[b], none)
            for row, leaf in ((w, j), (w, i), (w[b], p[b])):
                node = (size + leaf) >> 1
                while len(node) and node[0]:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
            w = w[tree[w, 1] < none]
        return sym, live

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in K.chunks(col):
            part = col.slice(a, b - a)
            cps, starts = K.code_points(part)
            s = pretokens(cps, starts)
            if not len(s):
                sizes.append(np.zeros(b - a, np.int64))
                continue
            e = np.append(s[1:], len(cps))
            h = K.span_hash(K.prefix(cps), s, e)
            u, where, inv = np.unique(h, return_index=True, return_inverse=True)
            i = np.searchsorted(self.known, u)
            new = ~((i < len(self.known)) & (self.known[np.minimum(i, max(len(self.known) - 1, 0))] == u)) if len(self.known) else np.ones(len(u), bool)
            if new.any():
                if len(self.known) > CACHE:
                    self.reset()
                    new = np.ones(len(u), bool)
                data, at, _ = K.byte_view(part)
                first = where[new]
                begin, end = at[s[first]], at[e[first]]
                ids, counts = self.merge(data, begin, end - begin)
                starts_new = len(self.flat) + np.cumsum(counts) - counts
                self.flat = np.concatenate([self.flat, ids])
                known = np.concatenate([self.known, u[new]])
                o = np.argsort(known, kind="stable")
                self.known, self.at, self.size = known[o], np.concatenate([self.at, starts_new])[o], np.concatenate([self.size, counts])[o]
                i = np.searchsorted(self.known, u)
            at, size = self.at[i][inv], self.size[i][inv]
            total = np.cumsum(size)
            flat.append(self.flat[np.repeat(at - (total - size), size) + np.arange(int(total[-1]))])
            sizes.append(np.bincount(K.owner(s, starts), weights=size, minlength=b - a).astype(np.int64))
        return np.concatenate(flat), np.concatenate(sizes)


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
LENGTHS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType())])


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each `text`, without special tokens.

    Empty and null texts give an empty list; repeated rows each give one; other columns are ignored.
    """
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for batch in batches:
            ids, sizes = bpe.encode(batch.column("text"))
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDS)


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) with the number of ids that `encode` gives; 0 for empty and null texts."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for batch in batches:
            _, sizes = bpe.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LENGTHS)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p7_ids": p7_ids}
