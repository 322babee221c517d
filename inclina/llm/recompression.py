"""Long repeats by recompression: word sequences are renamed level by level, alike wherever they occur.

A round names runs of one symbol by (symbol, length), then pairs: a coin per symbol, fixed by its name and
the round, merges each left symbol with a right one that follows. Names are hashes of what they stand for,
so every executor gives equal sequences equal names without asking. Inside two equal stretches of words the
rounds make the same symbols, but for a few at the ends whose neighbours differ; each symbol therefore carries the
stretch of words that its making depended on (its *reach*). A symbol whose reach lies inside a window occurs in
every document that holds the window.

1. Every document is renamed (``LEVELS`` rounds). Symbols that are local minima of a hash, taken with both
   neighbours, are its *names*; the root name stands for the whole document.
2. Documents with the root of a smaller one are whole copies. Of the rest, names held by two documents are
   *shared*.
3. A window can repeat only if every name whose reach lies inside it is shared. Such windows alone are
   hashed (128 bits of all their words), and those whose hash first occurs in a smaller document
   are repeats. A window without any name is hashed too: nothing is missed.
4. Words covered by repeats go.

Hot names and hot windows are pre-aggregated; lookups of many documents for one name are plain equi-joins
that adaptive execution splits. A document's names and repeats are gathered per document, bounded by its
own length.

Defined results: null or empty text has no words. Rows without an id count as one document after
all others. Repeated rows of one document never repeat each other. Documents shorter than a window
keep everything. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.llm.store import NO_ID, identity, stored
from inclina.operators.joins import BROADCAST_ROWS

WINDOW = 50
LEVELS = 3
#: Words that are worked on at a time.
PIECE = 400_000
_MEMO = 1 << 18
_U = np.uint64


def _mix(a: np.ndarray, b, salt: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit columns."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> _U(31))) * _U(0x7FB5D329728EA185) + (b ^ (b >> _U(27))) * _U(0x81DADEF4BC2DD44D) + _U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class Words:
    """Two independent 64-bit hashes per word, remembered within bounds."""

    def __init__(self):
        self.memo: dict[bytes, bytes] = {}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_128_digest(w)
        both = np.frombuffer(b"".join([memo[w] for w in words]), np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _side(values: np.ndarray, same: np.ndarray, step: int, outside: np.ndarray) -> np.ndarray:
    """Value of the neighbour ``step`` places on where it is of the same document, else ``outside``."""
    out = outside.copy()
    if step < 0:
        out[1:][same] = values[:-1][same]
    else:
        out[:-1][same] = values[1:][same]
    return out


def names(symbols: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, reach from, reach to) of the names of several documents laid end to end.

    ``symbols`` and ``doc`` are per word, ``first`` and ``end`` the word range of each document. Reaches
    that need the border of a document lie outside it."""
    at = np.arange(len(symbols))
    lo, hi = at.copy(), at + 1
    for level in range(levels):
        if len(symbols) == 0:
            break
        # runs
        begins = np.append(True, (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1]))
        heads = np.flatnonzero(begins)
        length = np.diff(np.append(heads, len(symbols))).astype(np.uint64)
        symbols = np.where(length > 1, _mix(symbols[heads], length, 4 * level + 1), symbols[heads])
        # A run ends where the next symbol, before it joins a run of its own, is another: its reach belongs to the run's.
        same = doc[1:] == doc[:-1]
        before, after = _side(lo, same, -1, first[doc] - 1)[heads], _side(hi, same, 1, end[doc] + 1)[np.append(heads[1:] - 1, len(hi) - 1)]
        lo, hi, doc = np.minimum(np.minimum.reduceat(lo, heads), before), np.maximum(np.maximum.reduceat(hi, heads), after), doc[heads]
        same = doc[1:] == doc[:-1]
        # pairs
        right = (_mix(symbols, symbols, 4 * level + 2) >> _U(40)) & _U(1) == 1
        merges = np.append(~right[:-1] & right[1:] & same, False)
        merged = np.append(False, merges[:-1])
        before, after = _side(lo, same, -1, first[doc] - 1), _side(hi, same, 1, end[doc] + 1)
        new_lo, new_hi = np.where(right, np.minimum(lo, before), lo), np.where(right, hi, np.maximum(hi, after))
        m = np.flatnonzero(merges)
        symbols = symbols.copy()
        symbols[m] = _mix(symbols[m], symbols[m + 1], 4 * level + 3)
        new_lo[m], new_hi[m] = np.minimum(lo[m], lo[m + 1]), np.maximum(hi[m], hi[m + 1])
        keep = ~merged
        symbols, doc, lo, hi = symbols[keep], doc[keep], new_lo[keep], new_hi[keep]
    if len(symbols) < 3:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    draw = _mix(symbols, symbols, 99)
    inner = (doc[1:-1] == doc[:-2]) & (doc[1:-1] == doc[2:])
    low = inner & (draw[1:-1] <= draw[:-2]) & (draw[1:-1] <= draw[2:])
    i = np.flatnonzero(low) + 1
    name = _mix(_mix(symbols[i - 1], symbols[i], 100), symbols[i + 1], 101)
    lo, hi = np.minimum(np.minimum(lo[i - 1], lo[i]), lo[i + 1]), np.maximum(np.maximum(hi[i - 1], hi[i]), hi[i + 1])
    doc = doc[i]
    usable = (lo >= first[doc]) & (hi <= end[doc]) & (hi - lo <= WINDOW)
    return name[usable], doc[usable], lo[usable], hi[usable]


def window_hashes(symbols: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the ``WINDOW`` symbols from each place on, built from doubling pieces."""
    parts, size, h = [], 1, symbols
    left, at, out = WINDOW, 0, None
    pieces = {1: symbols}
    while size * 2 <= WINDOW:
        h = _mix(h[:-size], h[size:], salt + size)
        size *= 2
        pieces[size] = h
    n = len(symbols) - WINDOW + 1
    while left:
        take = 1 << (left.bit_length() - 1)
        part = pieces[take][at : at + n]
        out = part if out is None else _mix(out, part, salt + 1000 + at)
        at, left = at + take, left - take
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """Rows and their words, about ``PIECE`` words at a time. The text is the last column."""
    rows, texts, n = [], [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            words = (text.as_py() or "").encode().split()
            rows.append(tuple(c[i] for c in columns))
            texts.append(words)
            n += len(words)
            if n >= PIECE:
                yield rows, texts
                rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


def _laid(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(sizes)
    return np.repeat(np.arange(len(texts)), sizes), end - sizes, end


PARSED = "doc long, body long, r1 long, r2 long, n_words long, whole string, bare boolean, names array<long>"
FOUND = "doc long, body long, h1 long, h2 long, place int, asks boolean"
KEPT = "doc long, body long, n_removed long, kept string"


def _untouched(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Window starts with none of the reaches [lo, hi) inside the window."""
    steps = np.bincount(np.maximum(hi - WINDOW, 0), minlength=n + 2)[: n + 2] - np.bincount(lo + 1, minlength=n + 2)[: n + 2]
    return np.cumsum(steps)[: max(0, n - WINDOW + 1)] == 0


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, body, text) to what step 1 knows of each document."""
    hashed = Words()
    for rows, texts in _pieces(batches):
        doc, first, end = _laid(texts)
        symbols, _ = hashed([w for t in texts for w in t])
        name, of, lo, hi = names(symbols, doc, first, end)
        n = len(doc)
        bare = np.zeros(len(texts), dtype=bool)
        if n >= WINDOW:
            whole = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
            bare[np.unique(doc[: n - WINDOW + 1][whole & _untouched(n, lo, hi)])] = True
        joined = [b" ".join(t) for t in texts]
        roots = np.frombuffer(b"".join(xxhash.xxh3_128_digest(j) for j in joined), "<i8").reshape(-1, 2)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(roots[:, 0]), pa.array(roots[:, 1]),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined]), pa.array(bare),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(name.view(np.int64))),
            ],
            names=["doc", "body", "r1", "r2", "n_words", "whole", "bare", "names"],
        )


def _member(values: np.ndarray, of: np.ndarray, sets: list) -> np.ndarray:
    """Whether ``values[i]`` is in ``sets[of[i]]``; ``of`` ascends."""
    out = np.zeros(len(values), dtype=bool)
    cuts = np.searchsorted(of, np.arange(len(sets) + 1))
    for i, s in enumerate(sets):
        if s is not None and len(s) and cuts[i] < cuts[i + 1]:
            out[cuts[i] : cuts[i + 1]] = np.isin(values[cuts[i] : cuts[i + 1]], np.asarray(s, dtype=np.int64))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, body, shared names, names first held here, text) to the windows that may repeat."""
    hashed = Words()
    for rows, texts in _pieces(batches):
        doc, first, end = _laid(texts)
        n = len(doc)
        if n < WINDOW:
            continue
        a, b = hashed([w for t in texts for w in t])
        name, of, lo, hi = names(a, doc, first, end)
        name = name.view(np.int64)
        shared, own = _member(name, of, [r[2] for r in rows]), _member(name, of, [r[3] for r in rows])
        may = (doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]) & _untouched(n, lo[~shared], hi[~shared])
        # a window with a name that no smaller document holds repeats none, but may be repeated
        asks = may & _untouched(n, lo[own], hi[own])
        at = np.flatnonzero(may)
        h1, h2 = window_hashes(a, 7)[at], window_hashes(b, 8)[at]
        ids, bodies = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
        of_window = doc[at]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[of_window]), pa.array(bodies[of_window]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                pa.array((at - first[of_window]).astype(np.int32)), pa.array(asks[at]),
            ],
            names=["doc", "body", "h1", "h2", "place", "asks"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, body, starts of repeated windows, text) to what is left of the text."""
    for rows, texts in _pieces(batches):
        out = []
        for (doc, body, places), words in zip(rows, texts):
            steps = np.zeros(len(words) + 1, dtype=np.int64)
            starts = np.unique(np.array(places, dtype=np.int64))
            steps[starts] += 1
            steps[starts + WINDOW] -= 1
            stays = np.cumsum(steps)[:-1] == 0
            kept = b" ".join([w for w, s in zip(words, stays.tolist()) if s]).decode()
            out.append({"doc": doc, "body": body, "n_removed": int((~stays).sum()), "kept": kept})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc", pa.int64()), ("body", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))


def _with_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (doc, body, ...) with their ``text``. If counted to be few, only their texts are moved."""
    ids = wanted.select("doc").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    return wanted.join(texts, ["doc", "body"]).select(*wanted.columns, "text")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): every row of ``docs`` (doc, body, n_words, digest of its words, and ``first``, the smallest
    document of the same words); and, for documents that repeat smaller ones in part, what is left."""
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(identity(docs).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    parsed = stored(texts.mapInArrow(_parse, PARSED), "parsed")
    firsts = stored(parsed.groupBy("r1", "r2").agg(F.min("doc").alias("first")), "firsts")
    rooted = stored(parsed.join(firsts, ["r1", "r2"]), "rooted")
    # One row per document and text that is not a copy of a smaller one and holds a window.
    own = rooted.where((F.col("doc") == F.col("first")) & (F.col("n_words") >= WINDOW)).dropDuplicates(["doc", "body"])
    listed = stored(own.select("doc", "body", F.explode("names").alias("name")), "names")
    # Stored before it is joined: adaptive execution can then split the rows of a name that many documents hold.
    spread = listed.groupBy("name").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    shared = stored(spread.select("name", "low"), "shared")
    held = listed.join(shared, "name").select("doc", "body", "name", "low")
    bare = own.where("bare").select("doc", "body", F.lit(None).cast("long").alias("name"), F.lit(None).cast("long").alias("low"))
    mine = F.when(F.col("low") == F.col("doc"), F.col("name"))
    marked = stored(held.unionByName(bare).groupBy("doc", "body").agg(F.collect_set("name").alias("shared"), F.collect_set(mine).alias("own")), "marked")
    windows = stored(_with_texts(marked, texts).mapInArrow(_windows, FOUND), "windows")
    spread = windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    seen = stored(spread.select("h1", "h2", "low"), "seen")
    again = windows.where("asks").join(seen, ["h1", "h2"]).where("low < doc")
    places = stored(again.groupBy("doc", "body").agg(F.collect_set("place").alias("places")), "repeats")
    cut = _with_texts(places, texts).mapInArrow(_cut, KEPT)
    return rooted.select("doc", "body", "n_words", "whole", "first"), cut


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and ``kept_sha256``, the digest of the words that stay."""
    rows, cut = repeats(docs)
    left = cut.groupBy("doc", "body").agg(F.first("n_removed").alias("gone"), F.first(F.sha2("kept", 256)).alias("digest"))
    copy = (F.col("first") < F.col("doc")) & (F.col("n_words") >= WINDOW)
    joined = rows.join(left, ["doc", "body"], "left")
    return joined.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    )
