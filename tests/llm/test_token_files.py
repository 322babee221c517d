import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import documents, got, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inclina.llm import elias_fano, token_files

FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 3))
def test_elias_fano_round_trip(sizes, scale):
    offsets = np.cumsum([0] + [s * 10**scale for s in sizes])
    starts, universe = offsets[:-1], int(offsets[-1])
    coded = elias_fano.Offsets(len(starts), *elias_fano.encode(starts, universe))
    assert coded.all().tolist() == starts.tolist()
    assert [coded[i] for i in range(len(starts))] == starts.tolist()
    if len(starts) > 50:  # about two bits beyond the low bits
        assert 8 * len(coded.high) <= 4 * len(starts) + 8


def test_offsets_bounds():
    with pytest.raises(IndexError):
        elias_fano.Offsets(0, *elias_fano.encode(np.zeros(0), 0))[0]


TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r\x1c\u0085  　́Σσς'sİ")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_words_give_the_ids_of_the_whole_text(text):
    own = np.frombuffer(token_files.WordEncoder(FILE, 2)(text), "<u2").tolist()
    whole = Tokenizer.from_file(FILE)
    assert own == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "été<|endoftext|>漢", "<|endoftext|", "x <|endoftext|><|endoftext|> Ⅷ"])
def test_literals_of_added_tokens(text):
    own = np.frombuffer(token_files.WordEncoder(FILE, 2)(text), "<u2").tolist()
    assert own == Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids


def test_pieces_are_encoded_once(monkeypatch):
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(150_000)]
    encode_one, calls = token_files.WordEncoder._piece, []
    monkeypatch.setattr(token_files.WordEncoder, "_piece", lambda self, piece: calls.append(piece) or encode_one(self, piece))
    encoder = token_files.WordEncoder(FILE, 2)
    parts = [" ".join(words[at : at + 30_000]) for at in range(0, len(words), 30_000)]
    first, again = [encoder(text) for text in parts], [encoder(text) for text in parts]
    assert first == again
    assert sorted(p for p in calls if p != "\n") == sorted(words)


def test_small_slices_and_memo(monkeypatch):
    texts = ["a b", None, "", " \n", "It's  12 été, l'été x\xa0y \x1c\x85", "漢字 Σας é" * 9, "a <|endoftext|> b", "b a B A", "z" * 300 + " a"] * 3
    monkeypatch.setattr(token_files, "MEMO", 200)
    monkeypatch.setattr(token_files, "SLICE", 16)
    encoder, whole = token_files.WordEncoder(FILE, 2), Tokenizer.from_file(FILE)
    slices = list(token_files._slices(pa.array(texts)))
    assert [t for part in slices for t in part.to_pylist()] == texts
    assert all(len(part) == 1 or len("".join(filter(None, part.to_pylist())).encode()) <= 16 for part in slices)
    own = []
    for part in slices:
        own += encoder.all(part)
        assert all(memo.keys.nbytes + memo.values.nbytes <= 200 for memo in (encoder.pieces, encoder.words))
    assert [np.frombuffer(ids, "<u2").tolist() for ids in own] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def expected(data):
    whole = Tokenizer.from_file(FILE)
    ordered = sorted(data, key=lambda r: (float("inf") if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    out, at = [], 0
    for doc, text, *_ in ordered:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_files_hold_every_document(spark, clash):
    assert got(token_files.token_output(documents(spark, clash=clash), FILE)) == expected(rows())


def test_small_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 3)
    docs = documents(spark)
    token_files.write_token_files(docs, FILE, str(tmp_path / "t"), 2, vocabulary=1 << 20, shards=2)
    blocks = spark.read.parquet(str(tmp_path / "t"))
    assert got(token_files.read_token_files(spark, str(tmp_path / "t"))) == expected(rows())
    assert {r["id_bytes"] for r in blocks.collect()} == {4}


def test_empty(spark):
    assert token_files.token_output(documents(spark, []), FILE).count() == 0
