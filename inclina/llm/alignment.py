"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often in the corpus.

Tokenizer A (a ``tokenizers`` byte-level BPE) encodes a space and the text, tokenizer B (a ``sentencepiece``
model) the text, before which it puts the space itself. Each side's tokens cover the same bytes, so a document is
two partitions of one byte range. Everything after the encoders is Arrow: token lists are flattened beside
their parent indices, byte lengths are summed up and cut at the documents (segmented cumulative sums), and a
full outer hash join of both sides on (document, end) gives all ends of either side in byte order. Every such end closes one
stretch of bytes that lies in one token of A and one of B, so the rows of the join *are* the links; ends that both
sides have close a group.

Links travel as distinct pairs with their counts (``Table.group_by``) per document. Partial counts of the corpus are
taken per task by ``Table.group_by`` again and merged by Spark; a document's links are weighed by a join with
the merged table, which is broadcast only when counted to be small.

A task works on :data:`PIECE` bytes of text at a time, or one document. Results do not depend on how rows are dealt.

Defined results: a text that is null or empty, or whose tokens on either side do not spell a space and the text
byte by byte (a normalised or unknown character), has no tokens: zeros, an empty digest, empty lists. Special tokens'
strings inside a text are plain text. Rows without an id and repeated rows are documents like any other and each counts. An
empty table gives empty results. Columns besides id and text are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inclina.llm.store import stored
from inclina.operators.joins import attach_checked

#: Bytes of text that are encoded and joined at a time.
PIECE = 1 << 18
#: A pair of ids is ``a << SHIFT | b``.
SHIFT = 20
#: A document-end key is ``document << PLACE`` plus the offset.
PLACE = 40
#: Pairs of ids (two longs and a flag) that may be broadcast.
PAIRS = 1_000_000
#: Partial counts that a task keeps before it hands them on.
HELD = 1 << 20

_LISTS = {"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "a_group": pa.list_(pa.int32()), "b_group": pa.list_(pa.int32())}
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_level() -> dict[str, int]:
    """Characters of the byte-level alphabet and their bytes: visible Latin-1 stands for itself, the rest follows U+00FF."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Pieces of A that a worker remembers, and their longest.
MEMO, MEMO_CHARS = 1 << 17, 48
#: Texts of code points below U+0300, whose letters, numbers and white space no version of Unicode tells apart otherwise.
_SIMPLE = re.compile("[\u0000-\u02ff]*")


def _of_kind(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c)).startswith(kind))


_BLANK, _LETTER, _NUMBER = "\\x09-\\x0d\\x20\\x85\\xa0", _of_kind("L"), _of_kind("N")
#: How A cuts a simple text before it merges, with letters, numbers and white space spelled out.
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?[{_LETTER}]+|\x20?[{_NUMBER}]+|\x20?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


class Sides:
    """Both tokenizers and, per id, the token's bytes, its length and its decimal spellings."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.memo: dict[str, bytes] = {}
        letters, names = byte_level(), {i: t for t, i in self.a.get_vocab().items()}
        of_a = [bytes(letters[c] for c in t) if (t := names.get(i, "")) and all(c in letters for c in t) else names.get(i, "").encode() for i in range(max(names) + 1)]
        of_b = [self._bytes_of_b(i) for i in range(self.b.get_piece_size())]
        self.tokens = {"a": pa.array(of_a, pa.binary()), "b": pa.array(of_b, pa.binary())}
        self.lengths = {s: pc.cast(pc.binary_length(t), pa.int64()) for s, t in self.tokens.items()}
        self.ids = max(len(of_a), len(of_b))
        self.spelled = pa.array([sep + str(i) for sep in ",;|" for i in range(self.ids)])

    def _bytes_of_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> dict[str, pa.ListArray]:
        """The ids of non-empty texts on both sides."""
        return {
            "a": _packed_lists(self._packed_a([" " + t for t in texts])),
            "b": _lists(self.b.encode(texts, num_threads=1)),
        }

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces of simple texts, packed. A row of pieces that open with a space before something visible is cut into
        just these pieces again, so they are encoded as one text, whose tokens are dealt back by their bytes."""
        row, others = [], []
        for p in pieces:
            (row if p[0] == " " and not p.isspace() else others).append(p)
        out = {p: _packed(ids) for p, ids in zip(others, self._whole(others))}
        if row:
            ids = np.array(self._whole(["".join(row)])[0], np.int32)
            ends = np.cumsum(self.lengths["a"].take(pa.array(ids)).to_numpy())
            places = (np.searchsorted(ends, np.cumsum(pc.binary_length(pa.array(row)).to_numpy(), dtype=np.int64)) + 1) * ids.itemsize
            packed, stops = ids.tobytes(), places.tolist()
            out.update(zip(row, [packed[s:e] for s, e in zip([0, *stops], stops)]))
        return out

    def _packed_a(self, texts: list[str]) -> list[bytes]:
        """A's ids, packed. Its merges never cross its pieces, so simple texts are put together from pieces' ids, each piece
        encoded when it is new; other texts go through A whole."""
        pieces = [_PIECES.findall(t) if _SIMPLE.fullmatch(t) else None for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*(p for p in pieces if p is not None)).difference(self.memo))
        self.memo.update(self._of_pieces(new))
        known, whole = self.memo, iter(self._whole([t for t, p in zip(texts, pieces) if p is None]))
        ids = [_packed(next(whole)) if own is None else b"".join([known[p] for p in own]) for own in pieces]
        for piece in new:
            if len(piece) > MEMO_CHARS:
                del self.memo[piece]
        return ids

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, np.int32).tolist() for ids in self._packed_a(texts)]

    def spell(self, side: str, tokens: pa.ListArray, wanted: list[bytes]) -> list[bool]:
        """Whether each document's tokens join to the wanted bytes."""
        ids = pc.list_flatten(tokens)
        whole = memoryview(self.tokens[side].take(ids).buffers()[2] or b"").cast("B")
        sums = np.concatenate([[0], pc.cumulative_sum(self.lengths[side].take(ids)).to_numpy()])
        ends = sums[tokens.offsets.to_numpy()]
        return [whole[s:e] == w for s, e, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted)]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _packed_lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids]) // 4]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


#: The tokenizers of a Python worker, loaded once.
_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a_file: str, b_file: str) -> Sides:
    if (a_file, b_file) not in _SIDES:
        _SIDES[a_file, b_file] = Sides(a_file, b_file)
    return _SIDES[a_file, b_file]


def token_ends(tokens: pa.ListArray, lengths: pa.Array, side: str) -> pa.Table:
    """Per token: the document-end key (its document's place and the byte offset in it where the token ends) and the
    token's own place in the flattened list."""
    doc = pc.list_parent_indices(tokens)
    sums = pc.cumulative_sum(lengths.take(pc.list_flatten(tokens)))
    # segmented: what the documents before have summed up to is taken off
    before = np.concatenate([[0], sums.to_numpy()])[tokens.offsets.to_numpy()[:-1]]
    base = pa.array((np.arange(len(before)) << PLACE) - before)
    return pa.table({"key": pc.add(sums, base.take(doc)), side: pa.array(np.arange(len(doc)))})


def link_rows(tokens: dict[str, pa.ListArray], lengths: dict[str, pa.Array]) -> pa.Table:
    """One row per link of documents that both sides spell: ``doc``, places ``a`` and ``b``, and ``both``, whether both
    tokens end here. In byte order."""
    a, b = (token_ends(tokens[s], lengths[s], s) for s in "ab")
    ends = a.join(b, keys="key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    # An end of one side alone lies inside the other side's next token; a document's last end is always shared.
    both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"]))
    return pa.table({"doc": pc.shift_right(ends["key"], PLACE), "a": pc.fill_null_backward(ends["a"]), "b": pc.fill_null_backward(ends["b"]), "both": both})


def _groups_of(links: pa.Table) -> dict[str, np.ndarray]:
    """The group of each token, counted through all documents, on both sides."""
    both = links["both"].to_numpy().astype(np.int64)
    group = np.cumsum(both) - both
    return {s: group[np.concatenate([np.flatnonzero(np.diff(place)), [len(place) - 1]])] for s in "ab" if len(place := links[s].to_numpy())}


def _spelled_groups(known: Sides, tokens: dict[str, pa.ListArray], groups: dict[str, np.ndarray]) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per document: tokens of both sides in one stream, groups in order, A before B."""
    n = int(groups["a"][-1]) + 1
    of = {s: np.bincount(groups[s], minlength=n) for s in "ab"}
    earlier = {s: np.cumsum(of[s]) - of[s] for s in "ab"}
    stream = np.empty(len(groups["a"]) + len(groups["b"]), np.int64)
    for s, other, first_mark in (("a", earlier["b"], 1), ("b", earlier["a"] + of["a"], 2)):
        g = groups[s]
        mark = np.where(np.diff(g, prepend=-1) > 0, first_mark, 0)
        stream[np.arange(len(g)) + other[g]] = mark * known.ids + pc.list_flatten(tokens[s]).to_numpy()
    text = known.spelled.take(pa.array(stream))
    places = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1]
    bounds = places[tokens["a"].offsets.to_numpy() + tokens["b"].offsets.to_numpy()]
    data = memoryview(text.buffers()[2])
    return [hashlib.sha256(data[s + 1 : e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def align_texts(known: Sides, ids: list, texts: list[str | None], lists: bool = False) -> pa.RecordBatch:
    """The rows of :func:`align` for some documents."""
    asked = [i for i, t in enumerate(texts) if t]
    none = np.zeros(len(texts), np.int64)
    out = {"n_a": none, "n_b": none.copy(), "n_groups": none.copy(), "n_links": none.copy()}
    digests, parts = [""] * len(texts), {name: [[]] * len(texts) for name in ("pairs", "times", *(_LISTS if lists else ()))}
    if asked:
        tokens, wanted = known.encode([texts[i] for i in asked]), [b" " + texts[i].encode() for i in asked]
        good = np.logical_and(*(known.spell(s, tokens[s], wanted) for s in "ab"))
        asked = np.array(asked)[good]
        tokens = {s: _compact(t.filter(pa.array(good))) for s, t in tokens.items()}
    if len(asked):
        links = link_rows(tokens, known.lengths)
        groups = _groups_of(links)
        for name, s in (("n_a", "a"), ("n_b", "b")):
            out[name][asked] = np.diff(tokens[s].offsets.to_numpy())
        sums = links.group_by("doc", use_threads=False).aggregate([("both", "sum"), ([], "count_all")])
        at = asked[sums["doc"].to_numpy()]
        out["n_groups"][at], out["n_links"][at] = sums["both_sum"].to_numpy(), sums["count_all"].to_numpy()
        for i, digest in zip(asked.tolist(), _spelled_groups(known, tokens, groups)):
            digests[i] = digest
        flat = {s: pc.list_flatten(tokens[s]).cast(pa.int64()) for s in "ab"}
        pair = pc.bit_wise_or(pc.shift_left(flat["a"].take(links["a"]), SHIFT), flat["b"].take(links["b"]))
        counted = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        bounds = np.searchsorted(counted["doc"].to_numpy(), np.arange(len(asked) + 1))
        pairs, times = counted["pair"].to_numpy(), counted["count_all"].to_numpy()
        for i, s, e in zip(asked.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            parts["pairs"][i], parts["times"][i] = pairs[s:e], times[s:e]
        if lists:
            first = groups["a"][tokens["a"].offsets.to_numpy()[:-1]]
            for s in "ab":
                at = tokens[s].offsets.to_numpy()
                for k, i in enumerate(asked.tolist()):
                    parts[s][i] = pc.list_flatten(tokens[s]).to_numpy()[at[k] : at[k + 1]]
                    parts[f"{s}_group"][i] = groups[s][at[k] : at[k + 1]] - first[k]
    schema = pa.schema([*_SCHEMA, *(_LISTS.items() if lists else ())])
    columns = {"doc_id": pa.array(ids, pa.int64()), **out, "groups_sha256": pa.array(digests), **parts}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def _compact(tokens: pa.ListArray) -> pa.ListArray:
    """The same lists with offsets from 0 over their own values."""
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pc.list_flatten(tokens))


def align(docs: DataFrame, a_file: str, b_file: str, lists: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs of ids with
    how often each is linked (``pairs``, ``times``). With ``lists`` also the ids of both sides and each token's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sides(a_file, b_file)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + PIECE, "right")))
                part = batch.slice(at, to - at)
                yield align_texts(known, part.column(0), part.column(1).to_pylist(), lists)
                at = to

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("body"))
    return texts.mapInArrow(run, ALIGNED + (", a array<int>, b array<int>, a_group array<int>, b_group array<int>" if lists else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, links, best): how many links of the corpus hold two ids linked, and whether no other A id has more
    with that B id. ``aligned`` should be stored; a B id has at most as many pairs as A has ids."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)

        held = pa.table({"pair": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        for batch in batches:
            new = pa.table({"pair": pc.list_flatten(batch.column(0)), "links": pc.list_flatten(batch.column(1))})
            held = pa.concat_tables([held, new]).group_by("pair", use_threads=False).aggregate([("links", "sum")]).rename_columns(["pair", "links"])
            if held.num_rows > HELD:
                yield from handed(held)
                held = held.slice(0, 0)
        yield from handed(held)

    counts = aligned.select("pairs", "times").mapInArrow(partial, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    pair = F.col("pair")
    named = counts.select("pair", F.shiftright(pair, SHIFT).cast("int").alias("a"), pair.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int").alias("b"), "links")
    return named.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def weigh_links(aligned: DataFrame, counts: DataFrame, pairs_limit: int = PAIRS) -> DataFrame:
    """``aligned`` (stored) less its pairs, with ``n_best`` (links whose count is the highest of their B id) and ``count_sum``
    (counts of all links, summed). Above ``pairs_limit`` rows of ``counts`` (stored) the join is a shuffle, where hot pairs are split."""
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    spread = aligned.select(F.monotonically_increasing_id().alias("row"), *own, F.arrays_zip("pairs", "times").alias("list")).select(
        "row", *own, F.inline_outer("list").alias("pair", "times")
    )
    weighed = attach_checked(spread, counts.select("pair", "links", "best"), ["pair"], pairs_limit)
    sums = weighed.groupBy("row", *own).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("links")), F.lit(0)).alias("count_sum")
    )
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def cross_align(docs: DataFrame, a_file: str, b_file: str, pairs_limit: int = PAIRS) -> DataFrame:
    """Alignment of every document, its links weighed by the counts of the whole corpus."""
    aligned = stored(align(docs, a_file, b_file), "aligned")
    return weigh_links(aligned, stored(pair_counts(aligned), "pair-counts"), pairs_limit)
