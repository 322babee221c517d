"""Hard negatives by inner products: length buckets with sorted coordinate lists, pruned by focus coordinates.

Rows are range-partitioned by length, longest first, and cut into *buckets* of about :data:`BUCKET` rows. A bucket keeps, for
every coordinate of its vectors divided by their lengths, the list of its rows in the order of that coordinate. An anchor that looks for
products of at least ``t`` needs a cosine of at least ``c = t / (its length * the bucket's longest)``: above 1 the bucket is
skipped, else each of the anchor's *focus* coordinates (its largest) bounds the same coordinate of a candidate to a
range, found in the list by bisection. Rows in the ranges of all focus coordinates are verified by
exact integer products.

Two searches are made this way. Positives (the best rows of the anchor's label) start from the bound that the anchor's own bucket
gives. Negatives (rows of other labels in a band below each positive's score) start from the lowest band. Every bucket meets every block
of anchors that its longest vector can serve; blocks are broadcast while their bytes are few (counted), else buckets and
blocks are joined. A task holds one bucket and one block; what it has found for an anchor raises the bound for its next buckets.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Components are taken as
``floor(scale * x)``, cut to 64-bit integers; scores beyond 64 bits are cut too. Vectors of other lengths have no product with
the anchor and are passed over. Zero vectors score 0. Equal rows (id, label and vector) count once; rows that share an id otherwise are
rows of their own. Ties go to the smaller id. An anchor without positives, or a positive without
negatives in its band (any below 0), gives no row. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inclina.llm.store import stored
from inclina.operators.ordering import top_per_group

#: Rows of a bucket, anchors of a block, focus coordinates of an anchor.
BUCKET, BLOCK, FOCUS = 2048, 512, 5
#: Bytes of anchor blocks that may be broadcast.
BLOCK_BYTES = 32 << 20
#: Room for rounding in bounds on cosines of whole vectors.
SLACK = 1e-9
INDEX = "dim int, bucket long, longest double, rows binary, lists binary"
ANCHORS = "dim int, uid long, vec_id long, label long, q array<long>, length double, least double"
_LONG = 2**63 - 1


def whole_rows(vectors: DataFrame, label: Column, is_anchor: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, asked, q): rows that take part, once each, with integer components."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), label.cast("long").alias("label"), is_anchor.alias("asked"), vectors["embedding"].alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", finite))
    q = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.select("vec_id", "label", F.coalesce("asked", F.lit(False)).alias("asked"), q.alias("q")).dropDuplicates(["vec_id", "label", "asked", "q"])


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def lengths(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))


def unit(q: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; zero rows stay."""
    return q / np.maximum(lengths(q), 1e-300)[:, None]


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer ``rows`` with ``q`` (a vector, or vectors as rows: one line each), cut to 64 bits."""
    a, b = rows.astype(np.float64), q.astype(np.float64)
    if not rows.size or not q.size:
        return np.zeros((*q.shape[:-1], len(rows)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * q.shape[-1] < 2.0**53:
        return (b @ a.T).astype(np.int64)
    cut = np.frompyfunc(lambda p: max(-_LONG - 1, min(_LONG, p)), 1, 1)
    return cut(q.astype(object) @ rows.astype(object).T).astype(np.int64)


def feasible(x: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Range of a coordinate of unit vectors whose cosine with a unit vector is at least ``c``; that vector has ``x`` there."""
    side = np.sqrt(np.maximum((1 - x * x) * (1 - c * c), 0.0))
    return np.where(x < -c, -1.0, x * c - side) - SLACK, np.where(x > c, 1.0, x * c + side) + SLACK


class Bucket:
    """A stored bucket: its rows and, per coordinate, their order."""

    def __init__(self, dim: int, number: int, longest: float, rows: bytes, lists: bytes):
        held = _read(rows)
        self.dim, self.number, self.longest = dim, number, longest
        self.ids, self.labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
        self.asked = held["asked"].to_numpy(zero_copy_only=False)
        self.q = _matrix(held["q"], dim)
        self.unit = unit(self.q)
        self.order = np.frombuffer(lists, np.int32).reshape(dim, len(self.ids))
        self.sorted = np.take_along_axis(self.unit.T, self.order, 1)

    def candidates(self, u: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Places of the rows that may have a product of ``least`` with the vector of direction ``u``; None: all."""
        if least <= 0 or not self.dim:
            return None
        reach = length * self.longest
        c = least / reach * (1 - SLACK) if reach else 2.0
        if c > 1:
            return np.zeros(0, np.int64)
        focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        low, high = feasible(u[focus], c)
        spans = [(np.searchsorted(self.sorted[f], a, "left"), np.searchsorted(self.sorted[f], b, "right")) for f, a, b in zip(focus, low, high)]
        first = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        found = self.order[focus[first], spans[first][0] : spans[first][1]]
        values = self.unit[np.ix_(found, focus)]
        return found[((values >= low) & (values <= high)).all(axis=1)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def build_index(rows: DataFrame) -> DataFrame:
    """The buckets of ``rows`` (of :func:`whole_rows`), stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def bucket(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            batch = table.select(["vec_id", "label", "asked", "q"]).combine_chunks().to_batches()[0]
            dim = table["dim"][0].as_py()
            q = _matrix(batch["q"], dim)
            order = np.argsort(unit(q), axis=0, kind="stable").T.astype(np.int32)
            row = {"dim": dim, "bucket": number, "longest": float(lengths(q).max()), "rows": _ipc(batch), "lists": np.ascontiguousarray(order).tobytes()}
            number += 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("longest", pa.float64()), ("rows", pa.binary()), ("lists", pa.binary())]))

        for batch in batches:
            dims = batch["dim"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for s, e in zip(cuts, cuts[1:]):
                if held and held[0]["dim"][0] != batch["dim"][s]:
                    yield bucket(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
                while sum(map(len, held)) >= BUCKET:
                    table = pa.Table.from_batches(held)
                    yield bucket(table.slice(0, BUCKET))
                    held = table.slice(BUCKET).to_batches()
        if sum(map(len, held)):
            yield bucket(pa.Table.from_batches(held))

    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    keyed = rows.select(F.size("q").alias("dim"), (-length).alias("turn"), "vec_id", "label", "asked", "q")
    placed = keyed.repartitionByRange("dim", "turn", "vec_id", "label").sortWithinPartitions("dim", "turn", "vec_id", "label")
    return stored(placed.mapInArrow(pack, INDEX), "buckets")


def find_anchors(index: DataFrame, positives: int) -> DataFrame:
    """The anchors of an index and the score that each one's ``positives`` best rows reach at least (``least``), by its own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Bucket(*(c[i].as_py() for c in batch.columns))
                at = np.flatnonzero(b.asked)
                least = []
                for p in at.tolist():
                    same = np.flatnonzero(b.labels == b.labels[p])
                    scores = np.sort(products(b.q[same[same != p]], b.q[p]))
                    least.append(float(scores[-positives]) if len(scores) >= positives else float("-inf"))
                q = pa.array(list(b.q[at]), pa.list_(pa.int64()))
                columns = [pa.array([b.dim] * len(at), pa.int32()), pa.array((b.number << 11) + at), pa.array(b.ids[at]), pa.array(b.labels[at]), q, pa.array(lengths(b.q[at]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(least, pa.float64())], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return stored(index.mapInArrow(run, ANCHORS), "anchors")


def pack_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors in blocks, stored: dim, block, their longest and least bound, and the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for s, e in zip(cuts, cuts[1:]):
                for at in range(s, e, BLOCK):
                    part = batch.slice(at, min(BLOCK, e - at))
                    row = {"dim": int(dims[s]), "block": number, "reach": max(part["length"].to_pylist()), "least": min(part["least"].to_pylist()), "anchors": _ipc(part)}
                    number += 1
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("reach", pa.float64()), ("least", pa.float64()), ("anchors", pa.binary())]))

    return stored(anchors.sortWithinPartitions("dim").mapInArrow(pack, "dim int, block long, reach double, least double, anchors binary"), "anchor-blocks")


def meet(index: DataFrame, blocks: DataFrame, look: Callable[[Bucket, int, pa.RecordBatch, Bounds], pa.RecordBatch], schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``look`` at every bucket with every block of anchors that its longest vector can serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bounds = None, Bounds()
        for batch in batches:
            for i in range(batch.num_rows):
                if bucket is None or bucket.number != batch["bucket"][i].as_py():
                    bucket = Bucket(*(batch[c][i].as_py() for c in ("dim", "bucket", "longest", "rows", "lists")))
                yield look(bucket, batch["block"][i].as_py(), _read(batch["anchors"][i].as_py()), bounds)

    serves = F.col("least") <= F.col("longest") * F.col("reach") * (1 + SLACK)
    size = blocks.agg(F.sum(F.length("anchors"))).first()[0] or 0
    if size <= block_bytes:
        pairs = index.join(F.broadcast(blocks), "dim").where(serves)
    else:  # headers find the pairs, dealt evenly; then blocks go to the buckets they serve
        salts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        heads = index.select("dim", "bucket", "longest").withColumn("salt", F.pmod(F.xxhash64("bucket"), F.lit(salts)).cast("int"))
        asks = blocks.select("dim", "block", "reach", "least").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        served = heads.join(asks, ["dim", "salt"]).where(serves).select("bucket", "block")
        sent = served.join(blocks.select("block", "anchors"), "block")
        pairs = index.join(sent, "bucket")
    return pairs.select("dim", "bucket", "longest", "rows", "lists", "block", "anchors").mapInArrow(run, schema)


class Bounds:
    """What a task has found so far: per block of anchors the scores that new rows have to reach. Forgotten blocks only
    cost work, so a few are kept."""

    def __init__(self, kept: int = 64):
        self.kept, self.held = kept, OrderedDict()

    def of(self, block: int, start: Callable[[], np.ndarray]) -> np.ndarray:
        if block not in self.held:
            self.held[block] = start()
            if len(self.held) > self.kept:
                self.held.popitem(last=False)
        self.held.move_to_end(block)
        return self.held[block]


def verified(b: Bucket, asked: pa.RecordBatch, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the anchor, candidates, their scores), candidates by focus coordinates for products of ``least``. Anchors
    that keep much of the bucket are verified together, in one matrix product."""
    q = _matrix(asked["q"], b.dim)
    near = [b.candidates(u, length, low) for u, length, low in zip(unit(q), asked["length"].to_pylist(), least.tolist())]
    many = [i for i, c in enumerate(near) if c is None or 4 * len(c) > len(b.ids)]
    whole = dict(zip(many, products(b.q, q[many]))) if many else {}
    for i, c in enumerate(near):
        if i in whole:
            c = np.arange(len(b.ids)) if c is None else c
            yield i, c, whole[i][c]
        elif len(c):
            yield i, c, products(b.q[c], q[i])


def find_positives(index: DataFrame, anchors: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, place, positive_id, positive_score): the first ``k`` other rows of each anchor's label."""

    def look(b: Bucket, block: int, asked: pa.RecordBatch, bounds: Bounds) -> pa.RecordBatch:
        # the k best scores so far; the last is the bound
        best = bounds.of(block, lambda: np.repeat(asked["least"].to_numpy()[:, None], k, axis=1))
        uids, labels = asked["uid"].to_pylist(), asked["label"].to_pylist()
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for i, near, scores in verified(b, asked, best[:, -1]):
            fits = (b.labels[near] == labels[i]) & (scores >= best[i, -1])
            if uids[i] >> 11 == b.number:
                fits &= near != uids[i] & 2047
            near, scores = near[fits], scores[fits]
            top = _best(scores, b.ids[near], k)
            if len(top):
                best[i] = -np.sort(-np.concatenate([best[i], scores[top]]))[:k] if uids[i] >> 11 != b.number else best[i]
                found.append((np.full(len(top), uids[i]), b.ids[near[top]], scores[top]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["uid", "positive_id", "positive_score"])

    hits = meet(index, pack_anchors(anchors), look, "uid long, positive_id long, positive_score long", block_bytes)
    return top_per_group(hits, ["uid"], [F.desc("positive_score"), F.asc("positive_id")], k, "place")


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of other labels that score at least ``band[0]`` and at most ``band[1]``
    percent of the positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    low, high = band
    index = build_index(whole_rows(vectors, label, is_anchor, scale))
    anchors = find_anchors(index, positives)
    liked = find_positives(index, anchors, positives, block_bytes)
    lists = stored(
        liked.where("positive_score >= 0").groupBy("uid").agg(
            F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("liked"), F.min("positive_score").alias("lowest")  # at most ``positives``
        ), "positives",
    )
    wanted = anchors.drop("least").join(lists, "uid").withColumn("least", F.ceil(F.col("lowest").cast("decimal(38,0)") * low / 100).cast("double"))
    wanted = wanted.select("dim", "uid", "vec_id", "label", "q", "length", "least", "liked")

    def look(b: Bucket, block: int, asked: pa.RecordBatch, bounds: Bounds) -> pa.RecordBatch:
        likes, labels, rows = asked["liked"].to_pylist(), asked["label"].to_pylist(), []

        def start() -> np.ndarray:
            """Per anchor and positive the best scores in its band so far, first its lower end."""
            best = np.full((len(likes), positives, negatives), _LONG, np.int64)
            for i, own in enumerate(likes):
                for j, like in enumerate(own):
                    best[i, j] = -(-low * like["positive_score"] // 100)
            return best

        best = bounds.of(block, start)
        for i, near, scores in verified(b, asked, best[:, :, -1].min(axis=1).astype(np.float64)):
            other = b.labels[near] != labels[i]
            near, scores = near[other], scores[other]
            for j, like in enumerate(likes[i]):
                score = like["positive_score"]
                fits = np.flatnonzero((scores >= best[i, j, -1]) & (scores <= high * score // 100))
                if not len(fits):
                    continue
                top = fits[_best(scores[fits], b.ids[near[fits]], negatives)]
                best[i, j] = -np.sort(-np.concatenate([best[i, j], scores[top]]))[:negatives]
                rows += [(asked["uid"][i].as_py(), like["place"], asked["vec_id"][i].as_py(), like["positive_id"], score, int(b.ids[near[p]]), int(scores[p])) for p in top.tolist()]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        names = ["uid", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    hits = meet(
        index, pack_anchors(wanted), look, "uid long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", block_bytes
    )
    best = top_per_group(hits, ["uid", "place"], [F.desc("negative_score"), F.asc("negative_id")], negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
