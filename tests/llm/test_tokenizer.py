"""Encoding against the reference library, and packing against its own certificate."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import packing, tokenizer

PATH = f"{tokenizer.TOKENIZERS}/{tokenizer.VOCABULARY}"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _mine(texts):
    ids, sizes = tokenizer.Bpe.load(PATH).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    return [ids[e - s : e].tolist() for s, e in zip(sizes, ends)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" '\n\t　sltdremvxyzAB1Ⅷ٣.,!_éß漢字🙂​\x1c\x85กิ"), max_size=60), min_size=1, max_size=20))
def test_same_as_library(library, texts):
    assert _mine(texts) == [library.encode_ordinary(t) for t in texts]


def test_edges(library):
    texts = [None, "", " ", "a" * 20_000, "don't we'LL 's\n'retry ''s", "\n\n  x", "<|endoftext|>", "é" * 3000]
    assert _mine(texts) == [library.encode_ordinary(t or "") for t in texts]


def test_cache_restart(library, monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE", 5)
    bpe = tokenizer.Bpe(PATH)
    for t in ("alpha beta gamma delta", "epsilon zeta eta theta", "alpha zeta iota kappa"):
        assert bpe.encode(pa.array([t]))[0].tolist() == library.encode_ordinary(t)


def test_query_shapes(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokenizer.p7_ids(spark, data).collect()}
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    assert got == want
    odd = spark.createDataFrame([(1, "a b", 7, [1]), (1, "a b", 7, [1]), (2, None, None, None)], "doc_id long, text string, n long, ids array<int>")
    assert sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode(odd).collect()) == sorted([(1, library.encode_ordinary("a b"))] * 2 + [(2, [])])
    assert tokenizer.encode(odd.limit(0)).count() == 0


def _check(packed, sizes, capacity):
    whole = {}
    fill = {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert whole == sizes
    assert max(fill.values(), default=0) <= capacity
    for d, n in sizes.items():
        assert len([r for r in packed if r.doc_id == d]) == max(1, -(-n // capacity))
    return len(fill)


@pytest.mark.parametrize("part_tokens", [packing.PART_TOKENS, 3000])
def test_packing(spark, part_tokens):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 5, 60, 99, 100, 101, 250, rng.randint(0, 130)]) for i in range(600)}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()] + [(0, sizes[0], "x"), (None, 5, "x")], "doc_id long, n_tokens long, container string")
    packed = packing.pack(df, 100, part_tokens=part_tokens).collect()
    used = _check(packed, sizes, 100)
    bound = packing.lower_bound(np.array([r.n_tokens for r in packed]), 100)
    assert bound <= used <= bound * 1.02 + 2
    assert packing.pack(df.limit(0), 100).count() == 0


def test_null_count_is_empty(spark):
    r = packing.pack(spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")).collect()
    assert [(x.doc_id, x.piece, x.n_tokens) for x in r] == [(1, 0, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=7))
def test_bound_is_below_best(sizes):
    import itertools

    def fits(k):
        return any(all(sum(s for s, c in zip(sizes, a) if c == b) <= 10 for b in range(k)) for a in itertools.product(range(k), repeat=len(sizes)))

    best = next(k for k in range(1, len(sizes) + 1) if k == len(sizes) or fits(k))
    assert packing.lower_bound(np.array(sizes), 10) <= best <= packing.best_fit_decreasing(np.array(sizes), 10).max() + 1
