"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint of 64 bits is cut into ``blocks`` pieces. Two fingerprints that differ in at most ``d`` bits
agree on at least ``blocks - d`` pieces, so they meet in one of the tables keyed by that many pieces;
fingerprints that meet are linked if their Hamming distance is small enough. Only distinct
fingerprints are compared (all copies of one are a class), and no group is ever expanded into all its
pairs: a key shared by more than ``PAIRED`` fingerprints is handled by middle points. Any two
fingerprints within ``2 r`` bits have one within ``r`` bits of both, so each such fingerprint is listed
under every fingerprint within ``r`` bits; those who meet there are within ``2 r`` bits of each other, and
linking them to the smallest keeps every connection. Both ways are exact.

:func:`near_copies` checks what the fingerprints connect: texts whose fingerprints (of five-word shingles) share a component
are candidates, and a candidate is linked when the whole shingle sets are similar enough. Copies whose fingerprints
lie further apart are candidates by ``BANDS`` further keys of ``HELD`` smallest shingle hashes each.
Every node first meets the smallest node of its keys. Keys that still hold more than one group are compared whole:
up to ``PAIRED`` members as pairs, more of them all with all inside tasks, in salted blocks.

Defined results: null or empty text has fingerprint 0, linked like any other; a text shorter than a shingle
is one shingle. Rows without an id share the components of their fingerprints but never name one (the id
is null where no row has one). Repeated rows are repeated in the result. Empty tables give empty
results. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inclina.llm.components import components
from inclina.llm.store import stored

#: Keys with at most this many fingerprints are compared pair by pair.
PAIRED = 64
#: Keys of a text, and smallest hashes in a key: texts 0.8 similar share none with probability (1 - 0.8 ^ 6) ^ 48 = 5e-7.
BANDS, HELD = 48, 6
#: A block of a crowded family holds about this many shingle sets, and bytes of them, at most.
CROWD, CROWD_BYTES = 1024, 4 << 20
#: Hash seed that the fingerprints are defined with.
SEED = 42
_PIECE = 1 << 16
#: Odd factors that put 32 bits of a shingle's hash in another order.
_FACTORS = np.array([xxhash.xxh32_intdigest(i.to_bytes(4, "little"), SEED) | 1 for i in range(BANDS * HELD)], np.uint32)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by single spaces, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in more than half of ``hashes``; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = np.ascontiguousarray(hashes[at : at + _PIECE])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc, fp) of every row: its id and the fingerprint of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(_words(t.as_py()), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc"), docs["text"].alias("body")).mapInArrow(run, "doc long, fp long")


def block_masks(blocks: int, agree: int) -> list[int]:
    """Bit masks, one per choice of ``agree`` pieces out of ``blocks``, as signed integers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(pieces, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def keyed(points: DataFrame, masks: list[int]) -> DataFrame:
    """``points`` under each key: columns ``t`` (table) and ``key`` besides their own."""
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return points.withColumn("_k", F.explode(keys)).select("*", "_k.*").drop("_k")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, bits: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within ``bits`` (even) of each other."""
    if bits % 2:
        raise ValueError("bits must be even")
    placed = keyed(distinct.select("fp"), block_masks(blocks, blocks - bits))
    sizes = stored(placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key-sizes")
    shared = stored(placed.join(sizes, ["t", "key"]), "shared-keys")
    few = shared.where(F.col("n") <= PAIRED)
    pairs = few.select("t", "key", F.col("fp").alias("a")).join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
    close = pairs.where((F.col("a") > F.col("b")) & (distance(F.col("a"), F.col("b")) <= bits)).select("a", "b").distinct()
    near = shared.where(F.col("n") > PAIRED).select("fp").distinct().withColumn("middle", F.col("fp"))
    for _ in range(bits // 2):
        steps = F.array(F.col("middle"), *[F.col("middle").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(64)])
        near = near.select("fp", F.explode(steps).alias("middle")).distinct()
    # Few distinct fingerprints can lie that close to one middle point: 65 for a radius of one bit.
    met = near.groupBy("middle").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    return close.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, blocks: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, component_id (smallest id reachable over links of at most ``bits``)."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc").alias("least")), "fingerprint-classes")
    roots = components(links(groups, bits, blocks))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("doc").alias("doc_id"), "fp", "component_id")


def _whole(hashes: np.ndarray) -> bytes:
    """Distinct hashes, ascending."""
    return np.unique(hashes).astype("<u8").tobytes()


def _sketch(words: list[bytes], size: int) -> bytes:
    """The whole shingle set: its distinct hashes, ascending."""
    return _whole(shingle_hashes(words, size))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two whole shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def band_keys(sketch: bytes) -> list[int]:
    """``BANDS`` keys of a shingle set, each of the smallest hashes in ``HELD`` orders; none for an empty set."""
    hashes = np.frombuffer(sketch, "<u8")
    if not len(hashes):
        return []
    half, least = len(_FACTORS) // 2, np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512]
        for place, bits in ((slice(0, half), part >> np.uint64(32)), (slice(half, None), part)):
            least[place] = np.minimum(least[place], (_FACTORS[place, None] * bits.astype(np.uint32)).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, HELD))]
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``sets`` (node, sketch) are at least ``least`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_links(sketches: list[bytes], groups: np.ndarray, sides: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Positions of sets that connect all pairs at least ``least`` similar, given that equal ``groups`` are connected.

    With two ``sides`` only pairs across them are compared. Exact: intersections are counted for one set with all
    sets whose size allows the similarity."""
    order = np.argsort([len(s) for s in sketches], kind="stable")
    sizes = np.array([len(sketches[i]) // 8 for i in order], np.int64)
    ids, times = np.unique(np.frombuffer(b"".join(sketches[i] for i in order), "<u8"), return_inverse=True, return_counts=True)[1:]
    shared = times[ids] > 1
    ends = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(sizes)])]
    ids, mark = ids[shared], np.zeros(len(times), np.bool_)
    label, side = np.unique(groups, return_inverse=True)[1][order], np.asarray(sides)[order]
    reach = np.searchsorted(sizes, np.floor(sizes / least + 1e-6), "right")
    across, found = len(np.unique(side)) > 1, []
    for p in range(len(order)):
        low, high = p + 1, int(reach[p])
        wanted = label[low:high] != label[p]
        if across:
            wanted &= side[low:high] != side[p]
        others = low + np.flatnonzero(wanted)
        own = ids[ends[p] : ends[p + 1]]
        if not len(others) or not len(own):
            continue
        mark[own] = True
        if 8 * len(others) < high - low:
            both = np.array([np.count_nonzero(mark[ids[ends[q] : ends[q + 1]]]) for q in others])
        else:
            sums = np.concatenate([[0], np.cumsum(mark[ids[ends[low] : ends[high]]])])
            both = sums[ends[others + 1] - ends[low]] - sums[ends[others] - ends[low]]
        mark[own] = False
        for q in others[both / (sizes[p] + sizes[others] - both) >= least].tolist():
            if label[q] != label[p]:
                label[label == label[q]] = label[p]
                found.append((int(order[p]), int(order[q])))
    return found


def _crowded(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect all similar nodes of the crowded keys of ``rest`` (node, root, lead).

    Nodes that share such keys, directly or over others, are one family. A family is dealt to salted blocks; every two
    blocks meet in one task with whole shingle sets, so its pairs are compared but never rows of a table."""

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        met = block_links(table["sketch"].to_pylist(), table["root"].to_numpy(), table["salt"].to_numpy(), least)
        return pa.table({"a": node[[p for p, _ in met]].astype(np.int64), "b": node[[q for _, q in met]].astype(np.int64)})

    family = components(rest.select(F.col("node").alias("a"), F.col("lead").alias("b"))).select("node", F.col("root").alias("family"))
    own = rest.select("node", "root").distinct().join(family, "node")
    bulk = own.join(sets.select("node", F.length("sketch").alias("bytes")), "node").groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CROWD), F.ceil(F.sum("bytes") / CROWD_BYTES)).cast("int").alias("blocks")
    )
    salted = own.join(stored(bulk, "families"), "family").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "root", "family", "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    return dealt.join(sets, "node").groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def _met_prints(own: DataFrame) -> DataFrame:
    """(node, n, key) of the stored ``own`` (node, n, fp) under the component of their fingerprints, over links of at most two bits:
    all that the fingerprints connect meets under one key."""
    roots = components(links(own.select("fp").distinct()))
    met = own.join(roots, own["fp"] == roots["node"], "left").select(own["node"], "n", F.coalesce("root", "fp").alias("root"))
    return met.select("node", "n", F.xxhash64(F.lit("fp"), "root").alias("key")).distinct()


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents that have near copies: shingles of ``words`` words at least
    ``least`` similar. Candidates are what SimHash fingerprints of the shingles connect and what shares a band key.
    Rows without an id are left out."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                hashes = shingle_hashes(_words(t.as_py()), words)
                own = _whole(hashes)
                found.append((xxhash.xxh3_128_digest(own, SEED), len(own) // 8, fingerprint(hashes), band_keys(own)))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc", "same", "n", "fp", "bands"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sketches = pa.array([_sketch(_words(t.as_py()), words) for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sketches], names=["node", "sketch"])

    rows = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc"), docs["text"].alias("body"))
    prints = stored(rows.mapInArrow(keys, "doc long, same binary, n int, fp long, bands array<long>"), "shingle-keys")
    # Equal shingle sets: one class, named by its smallest id.
    classes = stored(
        prints.groupBy("same").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("docs"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")),
        "shingle-classes",
    )
    many = classes.where("docs > 1").select("same", "node")
    copies = prints.select("doc", "same").join(many, "same").where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b")).distinct()
    # Rows of one shingle set may repeat shingles differently, so a node has the fingerprints of all its rows.
    own = stored(prints.where("n > 0").select("same", "fp").distinct().join(classes.select("same", "node", "n"), "same").drop("same"), "fingerprints")
    placed = classes.select("node", "n", F.explode("bands").alias("key")).unionByName(_met_prints(own))
    sizes = stored(placed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("lead")).where("held > 1"), "key-sizes")
    inside = stored(placed.join(sizes, "key"), "shared-keys")
    nodes = inside.select(F.col("node").alias("doc")).distinct()
    sets = stored(rows.join(nodes, "doc", "left_semi").dropDuplicates(["doc", "body"]).mapInArrow(whole, "node long, sketch binary"), "shingle-sets")
    # Most nodes are similar to the smallest node they meet; what that connects need not be compared again.
    leads = inside.where("node <> lead").groupBy("node").agg(F.min("lead").alias("b")).select(F.col("node").alias("a"), "b")
    found = stored(_similar(leads, sets, least), "links")
    roots = stored(components(found), "roots")
    rooted = inside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parted = rooted.groupBy("key").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).where("_r <> _s").select("key")
    rest = stored(rooted.join(parted, "key"), "open-keys")
    few = rest.where(F.col("held") <= PAIRED)
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n")]) for x in "ab")
    fits = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6
    pairs = a.join(b, "key").where((F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & fits)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    found = copies.unionByName(found).unionByName(_similar(pairs, sets, least))
    crowded = rest.where(F.col("held") > PAIRED)
    if crowded.limit(1).count():
        found = found.unionByName(_crowded(crowded, sets, least))
    return components(found).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
