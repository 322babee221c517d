"""The registered queries over the small test tables: beside SQL where there is some, else their columns."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry
from inclina.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Contract columns of the queries without SQL.
COLUMNS = {
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op6_decontaminate": ["doc_id", "item_id"],
    "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_vector_search": ["query_id", "rank", "vec_id", "score"],
    "op12_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    wanted = COLUMNS[name]
    assert df.columns[: len(wanted)] == wanted
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = df.count()
    assert rows == documents if name not in ("op6_decontaminate", "op10_vector_search") else rows > 0


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and COLUMNS.keys() | ORACLE.keys() == QUERIES.keys()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
