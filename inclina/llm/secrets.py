"""Secrets in text: fixed patterns plus credential values that would be hard to guess.

Fixed patterns give the base spans. Beyond them, a value that stands in a credential context (a wider
set of names than the base pattern knows, with any name parts before and between its words, words such as "password is",
or a bearer header) is scored by the guesses an
attacker would need: the cheapest segmentation of the value into known words, dates, repeats, keyboard
or alphabet walks and brute-force spans, found by dynamic programming over its positions. Values of at
least ``LEAST_GUESSES`` (as a power of ten) are added as spans of kind ``guess``; base spans stay.

Known words are a short fixed list and, ranked after it, the ``DICTIONARY`` words that most documents hold, counted
over all whole texts: an ordinary word of any language is then cheap. Only that ranked list, of bounded size, reaches
the driver; the texts themselves are read once more and not shuffled.

Defined results: null or empty text has no spans. Offsets are code points, the end is exclusive.
Repeated rows give repeated results (each counts as a document for the ranks), an empty table an empty one. Only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.llm.store import stored

#: A guessed value needs at least ten to this power guesses to be reported.
LEAST_GUESSES = 10.0
#: Words learned from the corpus at most, and the documents that must hold one.
DICTIONARY = 20_000
LEAST_DOCS = 5
#: A word of the corpus: letters alone between white space, with one closing mark.
_WORD = r"(?<!\S)(\p{L}{4,24})[.,;:!?]?(?!\S)"
#: Values up to this length are remembered with their costs; longer ones are scored anew.
REMEMBERED = 64
#: Kinds of the base patterns in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A whole name with what stands between it and its value; "bearer" needs a space alone.
_NAME = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)(?=(["']?(?:\x20*(?:[:=]|:=|=>)\x20*|\x20+(?:is|was)\x20+)|(?<=bearer)\x20+))""", re.I | re.A)
_VALUE = re.compile(r"""["']?(?:bearer\x20+)?([^\s"'<>,;]{6,})""", re.I | re.A)
#: Last words of a credential's name, and those that make one of a name that ends with "key".
_LAST = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|pin)$")
_BEFORE_KEY = ("private", "access", "api", "secret", "client", "auth", "token", "credential")
#: Frequent parts of passwords, most frequent first.
WORDS = (
    "password pass love admin welcome login master hello secret monkey dragon sunshine princess football baseball shadow "
    "super michael jordan summer winter spring autumn letmein trustno batman access flower cheese hunter killer soccer "
    "hockey ranger daniel thomas robert charlie andrew jessica pepper ginger cookie silver golden orange purple yellow "
    "computer internet server system default change test temp user guest root demo example sample token key house happy "
    "angel heart freedom secure private public company office money"
).split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LEET = str.maketrans("4@8301!$57", "aabeoiisst")
#: Rows of a keyboard and the two runs people type.
_WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = {(a, b) for row in _WALKS for a, b in zip(row, row[1:])} | {(b, a) for row in _WALKS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_DATES = {True: math.log10(365 * 120), False: math.log10(120)}


def _alphabet(value: str) -> int:
    sizes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10), (lambda c: not c.isalnum(), 33))
    return max(2, sum(n for test, n in sizes if any(test(c) for c in value)))


def _lower(value: str) -> str:
    """Lower case, one character for each."""
    return value.lower() if value.isascii() else "".join(c if len(c.lower()) > 1 else c.lower() for c in value)


class Guesses:
    """Decimal logarithm of the guesses for a value: the cheapest way to cover it by segments.

    Every segment after the first doubles the work (its kind has to be guessed too). The whole value is
    covered, in time that grows with its length. ``learned`` lists more words, most frequent first."""

    def __init__(self, learned: Sequence[str] = ()):
        self.rank = {**{w: i + 1 for i, w in enumerate(learned, len(WORDS))}, **_RANK}
        self.longest = max(map(len, self.rank))
        self._short = lru_cache(maxsize=65_536)(self._whole)
        self._block = lru_cache(maxsize=65_536)(self._cheapest)  # blocks of at most eight characters

    def __call__(self, value: str) -> float:
        return (self._short if len(value) <= REMEMBERED else self._whole)(value)

    def _whole(self, value: str) -> float:
        return self._cheapest(value, math.log10(_alphabet(value)))

    def _cheapest(self, head: str, brute: float) -> float:
        low, n = _lower(head), len(head)
        plain = low.translate(_LEET)
        best = [0.0] + [math.inf] * n
        dates: dict[int, list[int]] = {}
        for at in range(n):
            if low[at].isdigit() and (m := _DATE.match(low, at)):
                dates.setdefault(m.end(), []).append(at)
        run = walk = 0
        same = [0] * 9  # by period: how many characters up to here equal those a period before
        for end in range(1, n + 1):
            i = end - 1
            best[end] = best[i] + brute
            if i and low[i] == low[i - 1]:
                pass
            else:
                run = i
            if end - run >= 3:  # a repeated character: which one, and how often
                best[end] = min(best[end], best[run] + brute + math.log10(end - run) + 0.3)
            if not (i and (low[i - 1], low[i]) in _NEXT):
                walk = i
            if end - walk >= 3:  # a walk: where it starts, how far it goes, which way
                best[end] = min(best[end], best[walk] + math.log10(47 * 2 * (end - walk)) + 0.3)
            for size in range(3, min(self.longest, end) + 1):
                start = end - size
                rank = self.rank.get(plain[start:end])
                if rank:
                    twist = sum(a.isupper() for a in head[start:end]) + sum(a != b for a, b in zip(low[start:end], plain[start:end]))
                    best[end] = min(best[end], best[start] + math.log10(rank + 1) + 0.3 * (1 + twist))
            for start in dates.get(end, ()):
                best[end] = min(best[end], best[start] + _DATES[end - start > 4] + 0.3)
            for period in range(2, min(8, i) + 1):  # a repeated block costs the block and its count
                same[period] = same[period] + 1 if low[i] == low[i - period] else 0
                if same[period] >= period:
                    first = end - period * (1 + same[period] // period)
                    block = self._block(head[end - period : end], brute)
                    best[end] = min(best[end], best[first] + block + math.log10((end - first) / period) + 0.3)
        return best[n]


#: Costs by the fixed words alone.
guesses = Guesses()


def frequent_words(docs: DataFrame, most: int = DICTIONARY, least: int = LEAST_DOCS) -> list[str]:
    """The ``most`` words that most rows hold, at least ``least`` rows each, ties by the word; counted over whole texts."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(docs["text"]), F.lit(_WORD), F.lit(1)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # Stored first: the partitions' best words then meet in a task, and only ``most`` rows reach the driver.
    best = stored(counts.orderBy(F.desc("n"), "word").limit(most), "frequent-words").collect()
    return [r["word"] for r in sorted(best, key=lambda r: (-r["n"], r["word"]))]


def _credential(name: str, said: bool) -> bool:
    """A name that ends with a credential word; in a sentence (``said``) no letter may stand before that word."""
    low = name.lower()
    if low.endswith("key"):
        at = min((i for w in _BEFORE_KEY if 0 <= (i := low.find(w)) <= len(low) - 3 - len(w)), default=-1)
    else:
        at = m.start() if (m := _LAST.search(low)) else -1
    return at >= 0 and not (said and at and low[at - 1].isalpha())


def _values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values after credential names, none inside another."""
    done = 0
    for m in _NAME.finditer(text):
        if m.start() >= done and _credential(m[1], not set(m[2]) & set(":=")) and (v := _VALUE.match(text, m.end(2))):
            yield v.start(1), v.start(1) + len(v[1].rstrip("."))
            done = v.end()


def spans(text: str, cost: Guesses = guesses, least: float = LEAST_GUESSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind."""
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found += [(a, b, 3) for a, b in _values(text) if cost(text[a:b]) >= least]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


def _row(text: str | None, cost: Guesses) -> tuple[int, int, int, str, str]:
    found = spans(text, cost) if text else []
    base = [f"{k}:{a}:{b}" for a, b, k in found if k != "guess"]
    counts = [sum(k == kind for _, _, k in found) for kind in KINDS[:3]]
    return (*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in found))


def scan(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    learned = frequent_words(docs, dictionary) if dictionary else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = Guesses(learned)
        for batch in batches:
            rows = [_row(t, cost) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(np.array(c, dtype=np.int64)) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
