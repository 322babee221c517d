import random
import tracemalloc
import zlib

import numpy as np
import pytest
from fixtures import documents, prose, rows
from pyspark.sql import functions as F

from inclina.llm import quality


def corpus(n=500):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = prose(rng, rng.randint(5, 120), 3000)
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w for w in words[:9] for _ in range(8)], [w + rng.choice(["###", "$$$"]) for w in words]])
        data.append((i, " ".join(words), "en", "a", None))
        labels.append((i, int(good), 0))
    return data, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    data, labels = corpus()
    docs = documents(spark, data, clash=True).drop("_score")
    awkward = [(1, None, 0), (None, 1, 0), (2, 1 - labels[2][1], 0), (10**6, 1, 0), labels[3]]
    machine = quality.train(docs, spark.createDataFrame(labels + awkward, LABELS))
    scored = quality.score(docs, machine)
    assert scored.columns == [*docs.columns, "_score"]
    right = total = 0
    at = docs.columns.index("doc_id")
    for r in [(x[at], x[len(docs.columns)]) for x in scored.collect()]:
        if zlib.crc32(str(r[0]).encode()) % 5 == 0:
            total += 1
            right += (r[1] >= quality.GOOD) == bool(labels[r[0]][1])
    assert total > 50 and right / total > 0.95


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    dims = quality.WORD_DIMS + len(quality.STATS) * quality.BINS
    m = quality.Machine(np.sort(rng.normal(size=(len(quality.STATS), quality.BINS - 1)), axis=1), 0.1, rng.normal(0, 0.1, dims), rng.normal(0, 0.1, (dims, quality.RANK)))
    places, stats = quality.features("some words, and some more words", None, {})
    at, x = m.vector(m.edges, places, stats)
    z = m.bias + m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.score(places, stats) == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_rule(spark):
    df = spark.createDataFrame([(0,), (17,), (123456,), (-5,), (None,)], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    assert {r["doc_id"]: r["h"] for r in df.collect()} == {**{i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 17, 123456, -5)}, None: True}


def test_awkward_rows_and_no_labels(spark):
    docs = documents(spark)
    machine = quality.train(docs, spark.createDataFrame([], LABELS))
    out = quality.score(docs, machine).collect()
    assert len(out) == len(rows()) and {r["_score"] for r in out} == {0.5}
    assert quality.score(documents(spark, []), machine).count() == 0
    again = quality.score(docs.drop("n_chars"), machine)
    assert again.count() == len(out)


def test_reruns_agree(spark):
    data, labels = corpus(120)
    table = spark.createDataFrame(labels, LABELS)
    one, two = (quality.train(documents(spark, data).repartition(k), table) for k in (1, 4))
    assert one.bias == two.bias and (one.w == two.w).all()


def peak_mb(fn):
    """What ``fn`` returns and the most memory its Python objects took on the driver meanwhile."""
    tracemalloc.start()
    try:
        return fn(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_training_rows_stay_packed_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(f"w{w}" for w in rng.integers(0, 10**6, 400)), None, None, None) for i in range(1500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1500)], LABELS)
    docs, held = documents(spark, data), {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    monkeypatch.setattr(quality, "fit", lambda rows: list(rows))
    rows, mb = peak_mb(lambda: quality.train(docs, labels))
    assert mb < 5  # as lists of integers: over 15
    known = [i for i in range(1500) if i not in held]
    assert [r[2] for r in rows] == [i % 2 for i in known]
    for r, i in zip(rows, known):
        places, stats = quality.features(data[i][1], None, {})
        assert r[0].tolist() == places.tolist() and list(r[1]) == stats


def test_fit_keeps_two_bytes_a_place():
    rng = np.random.default_rng(4)
    stats = rng.normal(size=(4000, len(quality.STATS)))
    rows = [(np.unique(rng.integers(0, quality.WORD_DIMS, 300)).astype(np.uint16), stats[i], i % 2) for i in range(4000)]
    rows[0] = (np.zeros(0, np.uint16), stats[0], 1)  # a text without words
    machine, mb = peak_mb(lambda: quality.fit(rows, epochs=1, least_steps=1, batch=16))
    assert mb < 10 and np.isfinite(machine.v).all()  # with 16 bytes a place: over 18


def test_remembered_words_are_few():
    memo = {}
    places = [quality.bucket(b"w%d" % i, memo) for i in range(40_000)]
    assert len(memo) <= 1 << 14 and places == [zlib.crc32(b"w%d" % i) % quality.WORD_DIMS for i in range(40_000)]
