import hashlib
import re
from collections import defaultdict

import pytest
from fixtures import CLASHES, documents, got, rows
from pyspark.sql import functions as F

from inclina.llm import line_dedup

SPACES = "[\x20\x09-\x0d]"


def expected(data, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"^{SPACES}+|{SPACES}+$", "", line))

    held = defaultdict(set)
    ident = lambda d: float("inf") if d is None else d
    for doc, text, *_ in data:
        for line in (text or "").split("\n"):
            held[key(line)].add(ident(doc))
    out = []
    for doc, text, *_ in data:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or ident(doc) == min(held[key(x)])]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout, clash", [(1, 2, False), (4, 2, True), (7, 3, False)])
def test_equals_brute_force(spark, batches, fanout, clash):
    kept = line_dedup.drop_repeated_lines(documents(spark, clash=clash), batches, fanout)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    assert got(kept.select("doc_id", "n_lines", "n_dropped", digest)) == expected(rows())


def test_other_columns_stay_as_they_are(spark):
    names = [*CLASHES, "_body", "_places", "_kept", "batch", "line", "h2", "a.b", "a`b", "N_DROPPED"]
    names = [n for n in names if n not in ("n_lines", "N_DROPPED")]
    docs = documents(spark, clash=True).withColumns({n: F.lit(f"its {n}") for n in names if n not in ("a.b", "a`b")})
    docs = docs.withColumn("a.b", F.lit("its a.b")).withColumn("a`b", F.lit("its a`b")).withColumn("N_DROPPED", F.lit("x"))
    kept = line_dedup.drop_repeated_lines(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    assert got(kept.select("doc_id", "n_lines", "n_dropped", digest)) == expected(rows())
    assert sorted(kept.columns) == sorted({*docs.columns} - {"N_DROPPED"} | {"n_lines", "n_dropped"})
    assert {tuple(r[n] for n in names) for r in kept.collect()} == {tuple(f"its {n}" for n in names)}
    assert got(kept, "doc_id", "lang", "source", "n_chars") == got(docs, "doc_id", "lang", "source", "n_chars")


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0


def test_runs_are_compacted(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    for i in range(5):
        lines = line_dedup.hashed_lines(documents(spark, [(i, f"a line of batch {i}\nshared by every batch", None, None, None)]))
        gone = {r["place"] for r in runs.add(lines).collect()}
        assert gone == ({1} if i else set())
        assert all(len(level) <= 2 for level in runs.levels)
    assert len(runs.levels) == 3
    runs.close()
