import hashlib
import random

import numpy as np
import pytest
from fixtures import documents, got, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from inclina.llm import recompression as rec


def expected(data, window=50):
    ident = lambda d: float("inf") if d is None else d
    low = {}
    split = [(text or "").encode().split() for _, text, *_ in data]
    for (doc, *_), w in zip(data, split):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            low[k] = min(low.get(k, float("inf")), ident(doc))
    out = []
    for (doc, *_), w in zip(data, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < ident(doc):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, clash):
    assert got(rec.drop_repeats(documents(spark, clash=clash))) == expected(rows())


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts(spark, seed):
    """Small alphabets, long runs, periods, and passages cut out of one another."""
    rng = random.Random(seed)
    pool = [prose(rng, 150, v) for v in (2, 3, 8, 3000, 3000)] + [["a"] * 130, ["a", "b"] * 80, ["x", "y", "z"] * 50]
    data = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(20, 120)] + prose(rng, rng.randint(0, 8), 50)
        data.append((rng.randrange(30), " ".join(words), None, None, None))
    assert got(rec.drop_repeats(documents(spark, data))) == expected(data)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.lists(st.integers(0, 400), max_size=40), st.lists(st.integers(0, 400), max_size=40), st.integers(0, 10**6), st.sampled_from([1, 2, 3, 50, 10**6]))
def test_names_inside_a_window_travel(n, left, right, seed, alphabet):
    """A name whose reach lies in a stretch of words is made wherever that stretch stands."""
    middle = np.random.default_rng(seed).integers(0, alphabet, n)

    def names(before, after):
        words = np.concatenate([np.array(before, dtype=np.int64) % alphabet, middle, np.array(after, dtype=np.int64) % alphabet])
        symbols = rec._mix(words.astype(np.uint64), np.uint64(1), 5)
        name, _, lo, hi = rec.names(symbols, np.zeros(len(words), np.int64), np.array([0]), np.array([len(words)]))
        k = len(before)
        return {(x, a - k, b - k) for x, a, b in zip(name.tolist(), lo.tolist(), hi.tolist()) if a >= k and b <= k + n}

    assert names(left, right) == names(right, left) == names([], [])


def test_window_hashes_are_equal_for_equal_words():
    a = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    h = rec.window_hashes(a, 7)
    words = [tuple(a[i : i + 50].tolist()) for i in range(251)]
    assert len(set(h.tolist())) == len(set(words)) and len(set(zip(h.tolist(), words))) == len(set(words))


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(rec, "PIECE", 100)
    data = rows()[:30]
    assert got(rec.drop_repeats(documents(spark, data))) == expected(data)


def test_empty(spark):
    assert rec.drop_repeats(documents(spark, [])).count() == 0
