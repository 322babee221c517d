"""Token-id files: one concatenated id array with Elias-Fano coded document boundaries.

Documents are range-partitioned by id (only ids are sampled for that, texts are encoded once, after
the exchange) and sorted; each partition is a shard of *blocks*. A block is a row of a Parquet file:
little-endian ids (16 bits wide where the vocabulary allows, else 32), the document ids, and the
boundaries of its documents as an Elias-Fano code with select samples, so offset ``i`` is found without
a table of 64-bit offsets. A block closes at ``BLOCK_IDS`` ids or ``BLOCK_DOCS`` documents; a document
is never split, so memory is bounded by one block and one document. Where a block starts within the
whole array is a prefix sum over the block headers, which are few and are never collected.

A text's ids are the ids of its pieces in order, for the tokenizer drops white space and never merges over a
piece's end (tests hold this against whole texts). So Arrow splits some texts at a time into words and numbers the
distinct ones; only those are cut into pieces, and pieces are memoised per Python worker, as Arrow arrays. The memos are
bounded; what does not fit is encoded again.

Defined results: null text is empty and has the end id only. Rows without a doc_id come last. Rows
that share a doc_id each keep their own ids, in an order fixed by their text. Ids and offsets of
equal inputs are equal in every run. An empty table writes no block and reads back as no row. Only id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inclina.llm.elias_fano import Offsets, encode
from inclina.llm.store import NO_ID, identity, scratch
from inclina.operators.ordering import prefix_sums

BLOCK_IDS = 1 << 20
BLOCK_DOCS = 1 << 14
#: Bytes of the pieces remembered per Python worker, with their ids (about 25 a piece).
MEMO = 1 << 24
#: Bytes of texts whose distinct words are looked up together.
SLICE = 1 << 22
BLOCK = (
    "shard int, block int, n_docs long, n_ids long, id_bytes int, ids binary, doc_ids binary, "
    "low_width int, low binary, high binary, samples binary"
)


#: Texts of code points below U+0300, where nothing composes and each letter lower-cases on its own.
_SIMPLE = re.compile("[^\u0130\u0300-\U0010ffff]*")


def _of_kind(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c)).startswith(kind))


#: What the tokenizer's pre-tokenizer keeps of a lower-cased simple text: its pattern, with letters, numbers
#: and white space spelled out. The line feed that ends a word is kept too.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('L')}]+|[{_of_kind('N')}]|[^\x09-\x0d\x20\x85\xa0{_of_kind('L')}{_of_kind('N')}]+|\n")
#: Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for what follows U+00FF, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTES = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))


def _listed(values: pa.Array) -> list:
    """Strings or bytes of ``values``; ``to_pylist`` makes an Arrow scalar of each first, which takes ten times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _joined(values: pa.Array, offsets: np.ndarray | pa.Array) -> pa.Array:
    """Binary ``values`` one after another, from each offset to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), b"")


class _Memo:
    """Results of ``make`` by key, in two Arrow arrays of :data:`MEMO` bytes at most, for Python objects take several
    times the room. Beyond that only the keys of the last call stay, if they fit."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.keys, self.values = make, pa.array([], pa.string()), pa.array([], pa.binary())

    def __call__(self, keys: pa.Array) -> pa.Array:
        """The results of distinct ``keys``, in their order."""
        known = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(known.is_null())
        made = pa.array([self.make(key) for key in _listed(new)], pa.binary())
        at = known.fill_null(-1).to_numpy().copy()
        at[at < 0] = len(self.keys) + np.arange(len(new))
        self.keys, self.values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, made])
        found = self.values.take(pa.array(at))
        if self.keys.nbytes + self.values.nbytes > MEMO:
            kept = len(keys) if keys.nbytes + found.nbytes <= MEMO else 0
            self.keys, self.values = keys[:kept], found[:kept]
        return found


class WordEncoder:
    """Ids of texts by memoised pieces. ``file``: a tokenizers file of lower-casing, byte-level BPE words.

    Texts are split at ASCII white space, and each distinct word is looked up once. A simple word is cut into the
    tokenizer's pieces, and each new piece goes through its BPE model; any other new word goes through the whole tokenizer,
    which deals with other white space itself. A text with the literal of one of the tokenizer's added tokens goes through it whole, as it comes."""

    def __init__(self, file: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code, self.words, self.pieces = {2: "H", 4: "I"}[width], _Memo(self._whole), _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece == "\n":
            return b""
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _distinct(self, words: pa.Array) -> pa.Array:
        """The ids of each of distinct ``words`` without ASCII white space."""
        spelled = _listed(words)
        simple = np.array([word.isascii() or _SIMPLE.fullmatch(word) is not None for word in spelled], dtype=bool)
        pieces = _PIECES.findall("".join([f"{word}\n" if plain else "\n" for word, plain in zip(spelled, simple.tolist())]).lower())
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        ends = np.flatnonzero(coded.indices.to_numpy() == coded.dictionary.index("\n").as_py()) + 1
        ids = _joined(self.pieces(coded.dictionary).take(coded.indices), np.append(0, ends))
        if simple.all():
            return ids
        return pc.replace_with_mask(ids, pa.array(~simple), self.words(words.filter(pa.array(~simple))))

    def all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        out = _listed(_joined(self._distinct(coded.dictionary).take(coded.indices), words.offsets))
        for i in np.flatnonzero(pc.match_substring(texts, "<").to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            if any(t in text.lower() for t in self.added):
                out[i] = self._whole(text)
        return out

    def __call__(self, text: str) -> bytes:
        return self.all(pa.array([text], pa.string()))[0]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of :data:`SLICE` bytes at most together, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start, before = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield texts.slice(start, end - start)
        start, before = end, int(ends[end - 1])


#: One encoder per Python worker: its memo outlives a task.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(file: str, width: int) -> WordEncoder:
    if (file, width) not in _ENCODERS:
        _ENCODERS[file, width] = WordEncoder(file, width)
    return _ENCODERS[file, width]


def _close(shard: int, block: int, ids: list[bytes], docs: list[int], width: int) -> dict:
    sizes = np.array([len(b) // width for b in ids], dtype=np.int64)
    total = int(sizes.sum())
    low_width, low, high, samples = encode(np.cumsum(sizes) - sizes, total)
    return {
        "shard": shard, "block": block, "n_docs": len(docs), "n_ids": total, "id_bytes": width, "ids": b"".join(ids),
        "doc_ids": np.array(docs, dtype="<i8").tobytes(), "low_width": low_width, "low": low, "high": high, "samples": samples,
    }


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int, vocabulary: int = 1 << 16, shards: int | None = None) -> None:
    """Encode ``docs`` into ``folder`` in ascending doc_id order, ``end_id`` after each document."""
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    width = 2 if vocabulary <= 1 << 16 else 4
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in BLOCK.split(", "))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _encoder(tokenizer_file, width)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        shard, block, size, ids, at = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            encoded = (text for texts in _slices(batch.column(1)) for text in words.all(texts))
            for doc, text in zip(batch.column(0).to_pylist(), encoded):
                ids.append(text + end)
                at.append(doc)
                size += len(ids[-1]) // width
                if size >= BLOCK_IDS or len(at) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist([_close(shard, block, ids, at, width)], schema)
                    block, size, ids, at = block + 1, 0, [], []
        if at:
            yield pa.RecordBatch.from_pylist([_close(shard, block, ids, at, width)], schema)

    texts = docs.select(identity(docs).alias("doc"), docs["text"].alias("body"))
    placed = texts.repartitionByRange(shards, "doc").sortWithinPartitions("doc", "body")
    placed.mapInArrow(pack, BLOCK).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit little-endian)."""
    blocks = spark.read.schema(BLOCK).parquet(folder)
    starts = prefix_sums(blocks.select("shard", "block", "n_ids"), [], ["shard", "block"], {"n_ids": F.col("n_ids")})
    placed = blocks.join(starts.select("shard", "block", F.col("n_ids_before").alias("base")), ["shard", "block"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                starts = Offsets(b["n_docs"], b["low_width"], b["low"], b["high"], b["samples"]).all()
                ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}").astype("<u4")
                ends = np.append(starts[1:], b["n_ids"])
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b["doc_ids"], "<i8")), pa.array(starts + b["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc", "start", "n_tokens", "ids_crc32"],
                )

    out = placed.select("n_docs", "n_ids", "id_bytes", "ids", "doc_ids", "low_width", "low", "high", "samples", "base").mapInArrow(
        unpack, "doc long, start long, n_tokens long, ids_crc32 long"
    )
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_file, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
