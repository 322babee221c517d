"""Benchmark decontamination by greedy string tiling.

A test item counts as leaked into a document if non-overlapping tiles, each a run of words that both
share, cover enough of the item. Tiles may lie in any order, so reordered passages are caught.

Seeds: runs of ``SEED`` words of the items. They are joined with the seeds of every whole document by
an index of the items that goes along with the tasks. The index is bounded: items are dealt to blocks of
at most ``block_words`` words (their size is counted), and all documents are scanned once per block, so
a large benchmark costs more passes, never more memory. Words that no item holds cannot be part of a
tile and are told apart by one dictionary look-up each.

Tiling: for a document and an item with a common seed, all maximal common runs of at least ``SEED``
words are grown from Karp-Rabin hashes of windows that halve until the seed length is reached; the
longest unmarked run is marked first and so on until none is left (ties: first in the item, then first
in the document).

Defined results: words are maximal runs of letters, digits and underscores, lower-cased; null or empty
texts hold none, and items shorter than ``SEED`` words match as a whole. Items without a word, and rows
without an item id, cannot leak. Repeated documents and items give repeated or equal results. Rows
without a doc_id are judged like others. Empty tables give an empty result. Other columns are kept or
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.llm.store import stored

SEED = 4
#: Share of an item's words that tiles have to cover.
COVERAGE = 0.5
BLOCK_WORDS = 200_000
BASE, PRIME = 1_000_003, (1 << 61) - 1
_WORD = re.compile(r"\w+")
LEAKS = "doc_id long, item_id long, item_words long, covered long, tiles long, coverage double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _hashes(ids: list[int], size: int, free: list[bool]) -> dict[int, list[int]]:
    """Karp-Rabin: hash of every window of ``size`` free words to its places."""
    found: dict[int, list[int]] = defaultdict(list)
    top = pow(BASE, size - 1, PRIME)
    h = run = 0
    for i, word in enumerate(ids):
        if not free[i]:
            h = run = 0
            continue
        if run == size:
            h = (h - (ids[i - size] + 1) * top) % PRIME
            run -= 1
        h = (h * BASE + word + 1) % PRIME
        run += 1
        if run == size:
            found[h].append(i - size + 1)
    return found


def tile(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of each tile, longest first.

    Ids below zero match nothing."""
    a_free, b_free = [w >= 0 for w in item], [w >= 0 for w in doc]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while True:
        seen = _hashes(item, size, a_free)
        best: list[tuple[int, int, int]] = []
        longest = size
        if seen:
            for h, places in _hashes(doc, size, b_free).items():
                for i in seen.get(h, ()):
                    for j in places:
                        n = 0
                        while i + n < len(item) and j + n < len(doc) and a_free[i + n] and b_free[j + n] and item[i + n] == doc[j + n]:
                            n += 1
                        if n >= size:
                            best.append((n, i, j))
                            longest = max(longest, n)
        if longest > 2 * size:  # a run far longer than the window: look for such runs first
            size = longest
            continue
        marked = False
        for n, i, j in sorted(best, key=lambda t: (-t[0], t[1], t[2])):
            if all(a_free[i : i + n]) and all(b_free[j : j + n]):
                a_free[i : i + n] = [False] * n
                b_free[j : j + n] = [False] * n
                tiles.append((i, j, n))
                marked = True
            elif n > size:  # partly marked meanwhile: what is left of it is found again
                marked = True
        if marked and best:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


class Items:
    """Index of one block of items: word ids, seeds, and the items in ids."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.seed, self.vocabulary = seed, {}
        self.items: list[tuple[int, list[int]]] = []
        self.seeds: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            at = len(self.items)
            self.items.append((item_id, ids))
            size = min(seed, len(ids))
            for i in range(len(ids) - size + 1):
                self.seeds[tuple(ids[i : i + size])].add(at)
        self.sizes = sorted({len(s) for s in self.seeds})

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, its words, words covered, tiles) of every item with a tile in ``text``."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words_of(text)]
        found: set[int] = set()
        for size in self.sizes:
            for seed in zip(*[ids[i:] for i in range(size)]):
                if seed in self.seeds:
                    found |= self.seeds[seed]
        out = []
        for at in sorted(found):
            item, words = self.items[at]
            tiles = tile(words, self._near(ids, set(words)), min(self.seed, len(words)))
            out.append((item, len(words), sum(n for _, _, n in tiles), len(tiles)))
        return out

    @staticmethod
    def _near(ids: list[int], wanted: set[int]) -> list[int]:
        """``ids`` less stretches that hold no word of the item; one -1 stands for each."""
        out: list[int] = []
        for w in ids:
            if w in wanted:
                out.append(w)
            elif not out or out[-1] != -1:
                out.append(-1)
        return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Broadcast]:
    """The items in blocks of about ``block_words`` words, each sent to the executors once."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("body"))
    items = stored(rows.distinct().withColumn("size", F.length("body")), "items")
    # A word and its space take about five characters or more, so a block's characters bound its words.
    blocks = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // (5 * block_words)))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)))
    for block in range(blocks):
        held = [(r["item_id"], r["body"]) for r in dealt.where(F.col("block") == block).orderBy("item_id", "body").collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every (document, item) whose tiles cover at least ``coverage`` of the item."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("body"))
    passes = [texts.mapInArrow(_report(held, coverage), LEAKS) for held in item_blocks(benchmark, block_words)]
    return reduce(DataFrame.unionByName, passes)


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item; nothing is joined or shuffled, and only texts go to Python."""
    for held in item_blocks(benchmark, block_words):
        docs = docs.where(~_leaks(held, coverage)(docs["text"]))
    return docs


def _report(held: Broadcast, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(held.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item, n, covered, tiles in index.leaks(text.as_py()):
                    if covered >= coverage * n:
                        rows.append({"doc_id": doc, "item_id": item, "item_words": n, "covered": covered, "tiles": tiles, "coverage": covered / n})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _leaks(held: Broadcast, coverage: float):
    @F.arrow_udf("boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Items(held.value)
        for texts in parts:
            yield pa.array([any(covered >= coverage * n for _, n, covered, _ in index.leaks(t.as_py())) for t in texts], pa.bool_())

    return run


_SCHEMA = pa.schema([(c.split()[0], pa.float64() if c.split()[1] == "double" else pa.int64()) for c in LEAKS.split(", ")])
