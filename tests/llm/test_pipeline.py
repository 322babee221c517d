"""Every stage over small documents against plain Python."""

import random

import pytest
from fixtures import CLASHES, prose
from pyspark.sql import functions as F
from test_decontaminate import benchmark_rows
from test_quality import LABELS
from test_simhash import shingles
from test_token_files import expected as token_rows

import corpus_pipeline
from fixtures import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    data, labels = [], []
    for i in range(260):
        good = i % 5 != 0
        words = prose(rng, rng.randint(20, 150), 4000)
        if not good:
            words = [w.upper() + "!!" for w in words]
        data.append((i, " ".join(words), "en", rng.choice(["a", "b", None]), len(" ".join(words))))
        if i % 3:
            labels.append((i, int(good), 0))
    items, bench = benchmark_rows()
    good = [r for r in data if r[0] % 5]
    for k in range(8):
        data.append((300 + k, good[k][1], "en", "a", 1))  # exact copies
        words = good[20 + k][1].split() + prose(rng, 200, 4000)
        data.append((320 + k, " ".join(words), "en", "b", None))
        words[100] = "changed"
        data.append((340 + k, " ".join(words), "en", "a", None))  # near copies
        data.append((360 + k, " ".join(prose(rng, 30, 4000) + items[k][1].split()), "en", "b", None))  # leaks
    data += [(None, " ".join(prose(rng, 60, 4000)), None, "a", None), (400, None, None, None, None), (401, "", "en", "a", 0)]
    path = tmp_path_factory.mktemp("corpus")
    documents(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept[name] = [tuple(r) for r in docs.collect()]
    quality, near, clean, mix = (kept[n] for n, _ in corpus_pipeline.STAGES[:-1])
    ids = lambda rows: {r[0] for r in rows}
    junk = {i for i in range(0, 260, 5)}
    assert len(junk & ids(quality)) <= 2 and len(ids(quality) & set(range(260)) - junk) >= 200
    assert {300 + k for k in range(8)} | {320 + k for k in range(8)} | {340 + k for k in range(8)} <= ids(quality)
    sets = {r[0]: shingles(r[1]) for r in quality if r[0] is not None}
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8
    for doc in sets.keys() - ids(near):  # whatever went has a smaller copy that stayed
        assert any(o < doc and o in ids(near) and alike(sets[o], sets[doc]) for o in sets)
    assert not ids(near) & {300 + k for k in range(8)} and not ids(near) & {340 + k for k in range(8)}
    assert {320 + k for k in range(8)} <= ids(near)
    assert ids(near) - ids(clean) == {360 + k for k in range(8)} & ids(near) and len(ids(near) - ids(clean)) >= 7
    words = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert ids(mix) <= ids(clean) and abs(words(mix) - 1.5 * words(clean)) < 3 * 160
    out = sorted((tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)
    assert out == token_rows(mix)


def test_run(spark, folder):
    first, second = (sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == second and first
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_documents(spark, folder, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder):
    """Columns that share names with the operators' own pass through every stage."""
    data = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id IS NULL OR doc_id >= 300")
    docs = data.withColumns({c: F.lit(c) for c in [*CLASHES, "_copy", "_shards", "copies"]})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        assert all(r["_score"] == "_score" and r["_doc"] == "_doc" and r["_copy"] == "_copy" for r in out.collect())
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count() > 0
