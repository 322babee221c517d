"""Alignment against plain Python over the tokenizers as they are."""

import hashlib
from collections import Counter

import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from fixtures import documents, got, rows

from inclina.llm import alignment

A, B = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = [
    (9001, "<|endoftext|> and <s>plain</s> text <unk> <0x41>", None, None, None), (9002, "a▁b", "en", "a", 3), (9003, "ﬁne ligature ½ ²", "en", "a", 1), (9004, "   ", None, None, None),
    (9005, "\t\n\n  x   y　z\r\n", None, None, None), (9006, "👩‍👩‍👧 emoji 𝔘𝔫𝔦 שלום مرحبا नमस्ते", None, None, None), (9007, "\x00\x01 nul", None, None, None),
    (9008, "word " * 60_000, None, None, None), (9009, "x" * 20_000, None, None, None), (9010, "naïvé é", None, None, None),
]


def plain(data: list[tuple]) -> tuple[list[tuple], Counter]:
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_level()
    found = []
    for doc, text, *_ in data:
        links, groups, ids = [], [], ([], [])
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ids, i, j, end_a, end_b, first = (ids_a, ids_b), 0, 0, len(bytes_a[0]), len(bytes_b[0]), (0, 0)
                while True:
                    links.append((ids_a[i], ids_b[j]))
                    at = min(end_a, end_b)
                    if end_a == end_b:
                        groups.append((ids_a[first[0] : i + 1], ids_b[first[1] : j + 1]))
                        first = (i + 1, j + 1)
                    done_a, done_b = end_a == at, end_b == at
                    if done_a:
                        i += 1
                    if done_b:
                        j += 1
                    if i == len(ids_a) or j == len(ids_b):
                        break
                    end_a += len(bytes_a[i]) if done_a else 0
                    end_b += len(bytes_b[j]) if done_b else 0
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc, ids, groups, links, hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    counts = Counter(link for f in found for link in f[3])
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    table = [
        (doc, len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for doc, ids, groups, links, digest in found
    ]
    return sorted(table, key=repr), counts


@pytest.mark.parametrize("limit", [alignment.PAIRS, 0])
def test_equals_plain(spark, limit):
    data = rows() + EXTRA
    wanted, _ = plain(data)
    assert got(alignment.cross_align(documents(spark, data, clash=True), A, B, limit)) == wanted
    assert sum(r[1] == 0 for r in wanted) == 3 and sum(r[1] > 0 for r in wanted) > 50


def test_pair_table_and_small_pieces(spark, monkeypatch):
    data = rows() + EXTRA[:7]
    _, counts = plain(data)
    monkeypatch.setattr(alignment, "HELD", 3)
    aligned = alignment.align(documents(spark, data), A, B)
    found = {(r["a"], r["b"]): r["links"] for r in alignment.pair_counts(aligned).collect()}
    assert found == dict(counts)


def test_lists(spark):
    data = rows()[:20] + EXTRA[:7]
    aligned = alignment.align(documents(spark, data), A, B, lists=True).collect()
    for r in aligned:
        groups = [([], []) for _ in range(r["n_groups"])]
        for side, (tokens, places) in enumerate(((r["a"], r["a_group"]), (r["b"], r["b_group"]))):
            for token, place in zip(tokens, places):
                groups[place][side].append(token)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert r["groups_sha256"] == (hashlib.sha256(spelled.encode()).hexdigest() if groups else "")


def test_links_are_stretches():
    known = alignment.sides(A, B)
    tokens = known.encode(["some unbelievable words", "x"])
    links = alignment.link_rows(tokens, known.lengths)
    assert links.num_rows == sum(len(t.flatten()) for t in tokens.values()) - sum(links["both"].to_pylist())


def test_empty(spark):
    assert alignment.cross_align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    only = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)
    assert got(alignment.cross_align(only, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


LATIN = st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]) | st.sampled_from(" \n\t'sldvemrt.09\x85\xa0"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(LATIN | st.text(max_size=20), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    known = alignment.sides(A, B)
    assert known._encode_a(texts) == known._whole(texts)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 50)
    known = alignment.Sides(A, B)
    for i in range(30):
        texts = [f" word{i}x{j} {'y' * 100}{i}" for j in range(10)]
        assert known._encode_a(texts) == known._whole(texts)
        assert len(known.memo) < 50 + 40 and all(len(p) <= alignment.MEMO_CHARS for p in known.memo)
