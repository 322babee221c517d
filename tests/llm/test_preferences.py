import random

import pytest
from fixtures import got
from pyspark.sql import functions as F

from inclina.llm import preferences

SCHEMA = "pair_id long, turn long, role string, text string"


def ordered(rows):
    by = {}
    for pair, turn, role, text in rows:
        if pair is not None:
            by.setdefault(pair, set()).add((-1 if turn is None else turn, role or "", text or ""))
    return {k: [t[1:] for t in sorted(v)] for k, v in by.items()}


def expected(chosen, rejected):
    a, b = ordered(chosen), ordered(rejected)
    out = []
    for pair in a.keys() | b.keys():
        x, y = a.get(pair, []), b.get(pair, [])
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        render = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
        out.append((pair, n, render(x[:n]), mask(x[n:]), mask(y[n:])))
    return sorted(out, key=repr)


def mask(turns):
    out = []
    for role, text in turns:
        if role == "assistant":
            out += [(f"<|{role}|>\n", False), (f"{text}<|end|>\n", True)]
        else:
            out.append((f"<|{role}|>\n{text}<|end|>\n", False))
    return tuple(out)


def tables():
    rng = random.Random(1)
    chosen, rejected = [], []
    for pair in range(30):
        n, cut = rng.randint(1, 6), rng.randint(0, 6)
        for t in range(n):
            row = (pair, t, "user" if t % 2 == 0 else "assistant", f"turn {t} é\n{pair % 3}")
            chosen.append(row)
            rejected.append(row if t < cut else (pair, t, row[2], "other"))
    chosen += [chosen[0], chosen[3], (100, 0, "user", "only chosen"), (None, 0, "user", "nobody's"), (101, None, None, None), (101, 1, "assistant", ""), (3, 0, "user", "a second first turn"), (102, 1, "assistant", "x" * 50_000)]
    rejected += [(103, 0, "assistant", "only rejected"), (101, 1, "assistant", "y"), (102, 1, "assistant", "x" * 50_000)]
    return chosen, rejected


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, clash):
    chosen, rejected = tables()
    frames = [spark.createDataFrame(t, SCHEMA) for t in (chosen, rejected)]
    if clash:
        frames = [f.withColumns({c: F.lit("z") for c in ("chosen", "rejected", "_key", "_turn", "prompt", "train")}) for f in frames]
    found = preferences.preference_pairs(*frames).collect()
    rows = [
        (r["pair_id"], r["n_prompt_turns"], r["prompt"], *[tuple((s["text"], s["train"]) for s in r[c]) for c in ("chosen_completion", "rejected_completion")])
        for r in found
    ]
    assert sorted(rows, key=repr) == expected(chosen, rejected)


def test_only_built_in_functions(spark, plan_of):
    chosen, rejected = tables()
    plan = plan_of(preferences.preference_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_stale_reply(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "second"), (1, 4, "user", "s"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "alone")]
    df = preferences.transcripts(spark.createDataFrame(turns, SCHEMA), "pair_id")
    out = {r["pair_id"]: [t["text"] for t in r["s"]] for r in df.select("pair_id", preferences.stale_reply(F.col("turns")).alias("s")).collect()}
    assert out == {1: ["q", "first", "r", "first"], 2: ["q"], 3: ["alone"]}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(preferences.preference_pairs(none, none)) == []
