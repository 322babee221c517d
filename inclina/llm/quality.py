"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its distinct words, hashed to ``WORD_DIMS`` places and scaled to unit
length, and one place per structure or metadata statistic for the bin its value falls in. The score is
``w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2)``: all pairwise interactions of rank
``RANK`` in time linear in the words, by the sum-of-squares identity.

Training reads a bounded sample: about ``max_rows`` labelled documents chosen by a hash of the id, whose
features (a few hundred numbers each) are fitted on the driver by Adam. They arrive as Arrow columns and stay packed there, two
bytes a place. Everything else (features of
all documents, scores) runs in one pass over whole texts without a shuffle; the model, a few hundred
kB whatever the corpus, goes along with the tasks.

Defined results: null text is empty and scored by its statistics. Rows without an id are held out.
Labels that are null, or whose id has several different labels, are left out. Without any usable label
every score is 0.5. Repeated rows get equal scores; an empty table gives an empty result. Columns of the
input are passed on as they are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_DIMS = 1 << 12
RANK = 6
BINS = 12
#: Words remembered per task; more take memory from the executor and are not found faster.
MEMO = 1 << 14
#: Scores from here on are predicted good.
GOOD = 0.3
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
STATS = (
    "chars", "words", "word_length", "upper", "digits", "marks", "lines", "distinct", "commonest", "repeats", "marked_words", "high_bytes", "odd_marks", "listed_chars",
)
_ODD = bytes(set(_MARKS) - set(b".,'\"-?:;()"))
#: Marks become one letter and white space another, so that words ending in a mark can be counted.
_ENDS = bytes(ord("!") if b in _MARKS else ord(" ") if b in b" \t\n\x0b\x0c\r" else ord("a") for b in range(256))


def bucket(word: bytes, memo: dict[bytes, int]) -> int:
    if len(memo) >= MEMO:
        memo.clear()
    return memo.setdefault(word, zlib.crc32(word) % WORD_DIMS)


def features(text: str | None, n_chars: int | None, memo: dict[bytes, int]) -> tuple[np.ndarray, list[float]]:
    """Distinct word places and the statistics of one document."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    places = np.array([memo[w] if w in memo else bucket(w, memo) for w in words], dtype=np.int64)
    counts = np.bincount(places, minlength=1)
    distinct = np.flatnonzero(counts)
    share = lambda letters: (len(raw) - len(raw.translate(None, letters))) / size
    repeats = np.count_nonzero(places[1:] == places[:-1]) / max(1, n - 1)
    ends = (raw.translate(_ENDS) + b" ").count(b"! ") / max(1, n)
    high = 0.0 if raw.isascii() else 1 - len(text) / size
    return distinct, [
        math.log1p(len(raw)), math.log1p(n), len(raw) / max(1, n), share(_UPPER), share(_DIGIT), share(_MARKS), raw.count(b"\n") / size,
        len(distinct) / max(1, n), float(counts.max()) / max(1, n), repeats, ends, high, share(_ODD),
        math.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text or "")),
    ]


@dataclass
class Machine:
    """A fitted factorisation machine: bin edges per statistic, bias, weights, factors."""

    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def vector(edges: np.ndarray, places: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = [WORD_DIMS + i * BINS + int(np.searchsorted(edges[i], s, side="right")) for i, s in enumerate(stats)]
        at = np.concatenate([places, np.array(bins, dtype=np.int64)])
        x = np.ones(len(at))
        if len(places):
            x[: len(places)] = 1 / math.sqrt(len(places))
        return at, x

    def score(self, places: np.ndarray, stats: list[float]) -> float:
        at, x = self.vector(self.edges, places, stats)
        vx = self.v[at] * x[:, None]
        z = self.bias + float(self.w[at] @ x) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx * vx).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(rows: list[tuple[np.ndarray, list[float], int]], epochs: int = 14, least_steps: int = 500, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Fit by Adam on the logistic loss; rows are (places, statistics, label)."""
    dims = WORD_DIMS + len(STATS) * BINS
    rng = np.random.default_rng(seed)
    if not rows:
        return Machine(np.zeros((len(STATS), BINS - 1)), 0.0, np.zeros(dims), np.zeros((dims, RANK)))
    stats = np.array([r[1] for r in rows])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    bins = np.column_stack([np.searchsorted(edges[i], stats[:, i], side="right") + WORD_DIMS + i * BINS for i in range(len(STATS))]).astype(np.uint16)
    vectors = [np.concatenate([np.asarray(r[0], np.uint16), b]) for r, b in zip(rows, bins)]
    widths = np.array([len(v) for v in vectors])
    words = widths - len(STATS)
    scales = np.column_stack([1 / np.sqrt(np.maximum(words, 1)), np.ones(len(rows))])
    spans = np.column_stack([words, np.full(len(rows), len(STATS))])
    y = np.array([r[2] for r in rows], dtype=float)
    rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias, w, v = math.log(rate0 / (1 - rate0)), np.zeros(dims), rng.normal(0, 0.02, (dims, RANK))
    p = np.column_stack([w, v])
    m1, m2, step = np.zeros_like(p), np.zeros_like(p), 0
    per_epoch = -(-len(rows) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            at = np.concatenate([vectors[i] for i in part]).astype(np.int64)
            x = np.repeat(scales[part].ravel(), spans[part].ravel())
            width = widths[part]
            first = np.cumsum(width) - width
            px = p[at] * x[:, None]
            total = np.add.reduceat(px, first)
            squares = np.add.reduceat(px[:, 1:] ** 2, first)
            z = bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - squares).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]
            e = np.repeat(error, width) * x / len(part)
            grad = np.empty_like(px)
            grad[:, 0] = e
            grad[:, 1:] = e[:, None] * (np.repeat(total[:, 1:], width, axis=0) - px[:, 1:])
            g = np.column_stack([np.bincount(at, grad[:, j], dims) for j in range(RANK + 1)]) + decay * p
            step += 1
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            now = rate * max(0.02, 1 - step / (epochs * per_epoch))
            p -= now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            bias -= now * error.mean()
    return Machine(edges, bias, p[:, 0].copy(), p[:, 1:].copy())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into fold 0; rows without an id do."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _read(docs: DataFrame) -> list[Column]:
    n_chars = docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [docs["text"].alias("_text"), n_chars.alias("_chars")]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Machine:
    """Fit on about ``max_rows`` documents that have a label and are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("_id")).agg(
        F.min("quality").alias("_y"), F.max("quality").alias("_z")
    ).where("_y = _z").where(~held_out(F.col("_id"))).select("_id", F.col("_y").cast("int").alias("_y"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about max_rows rows at most, so it may be broadcast
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), *_read(docs)).join(F.broadcast(sample), "_id").select("_id", "_text", "_chars", "_y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            found = [features(t, c, memo) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column(3)],
                names=["id", "places", "stats", "y"],
            )

    got = rows.mapInArrow(extract, "id long, places binary, stats array<double>, y int").toArrow()
    ids, y = got["id"].to_pylist(), got["y"].to_pylist()
    places = [np.frombuffer(p.as_buffer(), "<u2") for p in got["places"]]
    stats = np.array(got["stats"].to_pylist()).reshape(-1, len(STATS))
    times = Counter(ids)
    # rows of one id come by their features, so that the fit does not depend on how the table is split
    order = sorted(range(len(ids)), key=lambda i: (ids[i], places[i].tolist(), stats[i].tolist()) if times[ids[i]] > 1 else (ids[i],))
    return fit([(places[i], stats[i], y[i]) for i in order])


def score(docs: DataFrame, machine: Machine, name: str = "_score") -> DataFrame:
    """``docs`` with the machine's score as one more column."""
    columns = docs.columns
    n = len(columns)
    ready = docs.select(*columns, *_read(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            scores = [machine.score(*features(t, c, memo)) for t, c in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], names=[*columns, name])

    return ready.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_column(docs: DataFrame, machine: Machine) -> Column:
    """The machine's score as a column of ``docs``. Only texts and lengths go to Python and only scores come back, so other
    columns may have any name."""

    @F.arrow_udf("double")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memo: dict[bytes, int] = {}
        for texts, chars in parts:
            yield pa.array([machine.score(*features(t.as_py(), c.as_py(), memo)) for t, c in zip(texts, chars)], pa.float64())

    return run(*_read(docs))
