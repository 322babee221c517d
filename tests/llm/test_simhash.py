import random

import numpy as np
import pytest
import xxhash
from fixtures import documents, got, rows

from inclina.llm import components, simhash


def plain_print(text, words=3):
    own = (text or "").encode().lower().split()
    size = min(words, len(own))
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + size]), 42) for i in range(len(own) - size + 1)] if own else []
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >= 1 << 63 else out


def groups(n, linked):
    """Smallest index reachable, for every index."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates(spark, clash):
    data = rows()
    prints = [plain_print(t) for _, t, *_ in data]
    root = groups(len(data), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2 if prints[i] >= 0 and prints[j] >= 0 else ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2)
    least = {}
    for r, (doc, *_) in zip(root, data):
        least[r] = min((d for d in (least.get(r), doc) if d is not None), default=None)
    want = sorted(((doc, p, least[r]) for (doc, *_), p, r in zip(data, prints, root)), key=repr)
    assert got(simhash.near_duplicates(documents(spark, clash=clash))) == want


@pytest.mark.parametrize("paired", [64, 2])
def test_links_connect_exactly(spark, monkeypatch, paired):
    """Pairs and middle points give the components of all pairs within two bits."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        for _ in range(rng.randint(0, 25)):
            p ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))})
            prints.add(p)
    prints = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    root = groups(len(prints), lambda i, j: near(prints[i], prints[j]))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    assert {p: found.get(p, p) for p in prints} == {p: prints[r] for p, r in zip(prints, root)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(200)}}



def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars, repeated, reversed or loops besides, are stored once; others once more per round that changes them."""
    kept = []
    monkeypatch.setattr(components, "stored", lambda df, name: kept.append(name) or df.localCheckpoint())
    roots = lambda edges: {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    star = [(0, i) for i in range(1, 9)] + [(3, 0), (5, 5), (20, 30), (None, 4)]
    assert roots(star) == {**{i: 0 for i in range(9)}, 20: 20, 30: 20} and len(kept) == 1
    assert roots([]) == {} and len(kept) == 2
    assert roots([(9, i) for i in range(1, 9)]) == {i: 1 for i in range(1, 10)} and len(kept) == 4

def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_near_copies(spark):
    rng = random.Random(8)
    data = [r for r in rows() if r[0] is not None]
    base = [f"v{rng.randrange(5000)}" for _ in range(400)]
    for k in range(90):  # a large group of near copies
        words = list(base)
        words[rng.randrange(400)] = f"x{k}"
        data.append((1000 + k, " ".join(words), None, None, None))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, data, clash=True)).collect()}
    sets = [shingles(t) for _, t, *_ in data]
    alike = lambda a, b: (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8
    ids = [d for d, *_ in data]
    root = groups(len(data), lambda i, j: ids[i] == ids[j] or alike(sets[i], sets[j]))
    least = {}
    for d, r in zip(ids, root):
        least[r] = min(least.get(r, d), d)
    want = {d: least[r] for d, r in zip(ids, root)}
    missed = sum(want[d] != found.get(d, d) for d in want)
    assert missed <= 1  # keys propose candidates: a rare pair may share none
    assert all(want[d] == want[r] for d, r in found.items())  # nothing else is ever linked
    assert len({found[1000 + k] for k in range(90)}) == 1


def test_sketches_are_exact_when_whole():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = ([f"t{i}".encode() for i in rng.integers(0, 60, rng.integers(1, 120))] for _ in range(2))
        x, y = (set(simhash.shingle_hashes(w, 2).tolist()) for w in (a, b))
        assert simhash.similarity(simhash._sketch(a, 2), simhash._sketch(b, 2)) == pytest.approx(len(x & y) / len(x | y))


def test_crowded_keys_lose_no_copy(spark):
    """Thousands of copies similar to one text with the largest id and not to each other: all are one component."""
    rng = random.Random(5)
    hub = [f"v{rng.randrange(5000)}" for _ in range(400)]
    data = [(10**6, " ".join(hub), None, None, None)]
    for k in range(2000):
        words = list(hub)
        for spot in rng.sample(range(80), 5):
            words[5 * spot : 5 * spot + 4] = [f"x{k}_{spot}_{i}" for i in range(4)]
        data.append((k, " ".join(words), None, None, None))
    sets = [shingles(t) for _, t, *_ in data]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8
    assert not any(alike(*rng.sample(sets[1:], 2)) for _ in range(300))
    want = {d for (d, *_), s in zip(data, sets) if alike(s, sets[0])}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, data)).collect()}
    assert len(want) > 1500 and {d for d in want if found.get(d) == min(want)} == want


def pairs_found(spark, pairs):
    """The numbers of the (a, b) texts that near_copies puts into one component."""
    data = [(2 * k + i, " ".join(t), None, None, None) for k, pair in enumerate(pairs) for i, t in enumerate(pair)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, data)).collect()}
    assert all(d // 2 == r // 2 for d, r in found.items())
    return {d // 2 for d in found}


def test_appended_cut_and_replaced_parts_are_found(spark):
    rng, pairs = random.Random(9), []
    weights = [1 / k for k in range(1, 20001)]
    prose = lambda n: [f"v{w}" for w in rng.choices(range(20000), weights, k=n)]
    for n in [30] * 40 + [300] * 40 + [2000] * 10:
        for add, cut in ((round(0.18 * n), 0), (round(0.08 * n), round(0.08 * n)), (0, round(0.15 * n))):
            text = prose(n)
            pairs.append((text, text[: n - cut] + prose(add)))
    want = {k for k, (a, b) in enumerate(pairs) if len({*shingles(" ".join(a))} & {*shingles(" ".join(b))}) >= 0.8 * len({*shingles(" ".join(a))} | {*shingles(" ".join(b))})}
    assert len(want) > 200 and pairs_found(spark, pairs) == want


def test_long_texts_at_the_threshold_are_decided_exactly(spark):
    rng, pairs = random.Random(10), []
    for k in range(24):
        text = [f"v{rng.randrange(50000)}" for _ in range(3000)]
        size, at = 328 + 2 * (k % 2), rng.randrange(10, 2600)  # 0.8005 or 0.7994 similar
        pairs.append((text, text[:at] + [f"x{k}_{i}" for i in range(size)] + text[at + size :]))
    assert pairs_found(spark, pairs) == set(range(0, 24, 2))


@pytest.mark.parametrize("sides", [1, 2])
def test_blocks_connect_all_similar_sets(sides):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    sets = [sorted({*rng.sample(base, rng.randint(30, 60)), *(rng.getrandbits(64) for _ in range(rng.randint(0, 6)))}) for _ in range(150)] + [[]]
    side = [rng.randrange(sides) for _ in sets]
    alike = lambda i, j: (side[i] != side[j] or sides == 1) and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}) > 0
    met = simhash.block_links([np.array(s, "<u8").tobytes() for s in sets], np.arange(len(sets)), np.array(side), 0.8)
    assert all(alike(i, j) for i, j in met)
    pairs = {frozenset(p) for p in met}
    assert groups(len(sets), lambda i, j: frozenset((i, j)) in pairs) == groups(len(sets), alike)


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_copies(documents(spark, [])).count() == 0


def test_near_copies_start_from_fingerprints(spark, monkeypatch):
    """Copies whose fingerprints are within two bits are found without any other key, crowded or not; a shared fingerprint is not enough."""
    monkeypatch.setattr(simhash, "band_keys", lambda sketch: [])
    rng = random.Random(14)
    base = [f"v{rng.randrange(5000)}" for _ in range(3000)]
    data = [(k, " ".join([*base[:-1], f"x{k}"] if k else base), None, None, None) for k in range(100)]
    loud = "again " * 900
    data += [(200 + k, loud + " ".join(f"y{k}_{i}" for i in range(40)), None, None, None) for k in range(3)]
    prints = {d: simhash.fingerprint(simhash.shingle_hashes(t.encode().split(), 5)) for d, t, *_ in data}
    assert all(((prints[k] ^ prints[0]) & (2**64 - 1)).bit_count() <= 2 for k in range(100)) and len({prints[200 + k] for k in range(3)}) == 1
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, data)).collect()}
    assert found == {k: 0 for k in range(100)}
