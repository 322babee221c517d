import hashlib
import math
import re

import pytest
from fixtures import documents, got, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from inclina.llm import secrets


def base_spans(text):
    """The contract's patterns by their letters, one after the other."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


PIECES = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "pwd", " is ", ":", "=", " ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "abcdef", "-", ".", "é", "ſecret", "hunter2", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_stay(text):
    spans = [f"{k}:{a}:{b}" for a, b, k in secrets.spans(text)]
    assert [s for s in spans if not s.startswith("guess")] == base_spans(text)
    starts = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in spans]
    assert starts == sorted(starts)


@pytest.mark.parametrize("clash", [False, True])
def test_rows(spark, clash):
    want = []
    for doc, text, *_ in rows():
        base = base_spans(text or "")
        want.append((doc, *[sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert got(secrets.scan(documents(spark, clash=clash)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)


def test_guess_cost_orders_values():
    easy = ["password", "aaaaaaaaaaaa", "qwertyuiop", "19991231", "abcabcabcabc", "P4ssw0rd"]
    hard = ["zX9!kQ2-pLm7", "tr0ub4dor&3xKq", "8fJ2nvQ0sLpW"]
    assert max(map(secrets.guesses, easy)) < secrets.LEAST_GUESSES <= min(map(secrets.guesses, hard))
    assert secrets.guesses("hunter2" * 500) < secrets.guesses("zX9!kQ2-pLm7" * 500)


@pytest.mark.parametrize("value", ["a" * 500, "password" * 40, "=" * 400, "-" * 5000, "abc" * 200, "a" * 300 + "19991231"])
def test_long_easy_values_are_no_secrets(value):
    assert secrets.guesses(value) < secrets.LEAST_GUESSES
    assert not any(k == "guess" for _, _, k in secrets.spans("my pwd is " + value))


def test_long_values_are_scored_to_their_end():
    assert secrets.guesses("zX9!kQ2-pLm7" + "a" * 400) < secrets.guesses("zX9!kQ2-pLm7" + "a" * 400 + "zX9!kQ2-pLm7") < 60
    assert secrets.guesses("x" * 400 + "İpassword") < 20  # a character whose lower case is longer


def test_context_values_are_added():
    found = secrets.spans('my pwd is zX9!kQ2-pLm7 and pass: aaaaaaaa')
    assert [k for _, _, k in found] == ["guess"]


@pytest.mark.parametrize(
    "text, value",
    [
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", "wJalrXUtnFEMI/K7MDENG"),
        ("aws.secret-access-key: wJalrXUtnFEMI/K7MDENG", "wJalrXUtnFEMI/K7MDENG"),
        ("DB_PASS=zX9!kQ2-pLm7", "zX9!kQ2-pLm7"),
        ("db_pwd: zX9!kQ2-pLm7.", "zX9!kQ2-pLm7"),
        ("DB_PASSWORD=x$9!kQ2-pLm7", "x$9!kQ2-pLm7"),
        ('{"spring.datasource.password": "x$9!kQ2-pLm7"}', "x$9!kQ2-pLm7"),
        ("mysqlpwd=zX9!kQ2-pLm7", "zX9!kQ2-pLm7"),
        ("this is app.api_key = zX9!kQ2-pLm7", "zX9!kQ2-pLm7"),
        ("Authorization: Bearer eyJhbGciOi.J9x-_", "eyJhbGciOi.J9x-_"),
        ("auth: Bearer eyJhbGciOi.J9x-_", "eyJhbGciOi.J9x-_"),
        ("bearer = eyJhbGciOi.J9x-_", "eyJhbGciOi.J9x-_"),
    ],
)
def test_prefixed_names_and_bearer_headers(text, value):
    assert [text[a:b] for a, b, k in secrets.spans(text) if k == "guess"] == [value]


def test_other_names_give_no_value():
    for text in ("monkey = zX9!kQ2-pLm7", "The compass is zX9!kQ2-pLm7", "api = zX9!kQ2-pLm7", "bearer zX9!k"):
        assert secrets.spans(text) == []


def test_segmentation_is_cheapest():
    """The program's table against every segmentation of short values into single characters and words."""
    import math

    value = "passx"
    brute = math.log10(26)
    assert secrets.guesses(value) == pytest.approx(math.log10(secrets.WORDS.index("pass") + 2) + 0.3 + brute)


def test_frequent_words_of_the_corpus_are_cheap(spark):
    words = "zanahoria, Wissenschaftler bibliothèque. зоопарковый"
    data = [(i, f"{words} text{i} xq-{i}zvw a1b2c3d4", None, None, None) for i in range(secrets.LEAST_DOCS)]
    data += [(100 + i, "rarewordhere rarewordhere " * 9, None, None, None) for i in range(secrets.LEAST_DOCS - 2)]
    values = ["zanahoria", "Wissenschaftler", "bibliothèque", "zooпарк-zX9!kQ2", "rarewordhere", "qxvkzjwptr", "зоопарковый", "zanahoria2zanahoria"]
    data += [(1000 + i, f"my pwd is {v}!", None, None, None) for i, v in enumerate(values)] + [(2000, None, None, None, None)]
    docs = documents(spark, data)
    assert sorted(secrets.frequent_words(docs)) == ["bibliothèque", "wissenschaftler", "zanahoria", "зоопарковый"]
    assert secrets.frequent_words(docs, 2) == ["bibliothèque", "wissenschaftler"]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert [bool(found[1000 + i]) for i in range(len(values))] == [False, False, False, True, True, True, False, False]
    plain = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, dictionary=0).collect()}
    assert plain[1001] and plain[1006]


def _all_segmentations(value, cost, brute):
    """Least cost over every way to cut ``value`` into single characters and listed words."""
    if not value:
        return 0.0
    ways = [brute + _all_segmentations(value[1:], cost, brute)]
    for size in range(3, len(value) + 1):
        if value[:size] in cost.rank:
            ways.append(math.log10(cost.rank[value[:size]] + 1) + 0.3 + _all_segmentations(value[size:], cost, brute))
    return min(ways)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "over", "verb", "m", "p", "ov", "rbo"]), min_size=1, max_size=4).map("".join))
def test_words_are_cut_at_least_cost(value):
    cost = secrets.Guesses(["over", "verb", "overv", "ssw"])
    least = _all_segmentations(value, cost, math.log10(26))
    repeats = any(value[i : i + p] == value[i + p : i + 2 * p] for p in range(1, 9) for i in range(len(value) - 2 * p + 1))
    assert cost(value) <= least + 1e-9 and (repeats or cost(value) == pytest.approx(least))


def test_long_values_are_not_remembered():
    cost = secrets.Guesses()
    cost("zX9!kQ2-pLm7" * 10_000)
    cost("short-value")
    assert cost._short.cache_info().currsize == 1


def test_empty(spark):
    assert secrets.scan(documents(spark, [])).count() == 0
