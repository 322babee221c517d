"""The operators of this subpackage as queries over the test tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inclina.llm import (
    alignment, decontaminate, hard_negatives, line_dedup, mixing, preferences, quality, recompression, secrets, simhash, token_files, vector_search, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_line_dedup",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id > first_doc, false) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op1_line_dedup(spark, folder):
    kept = line_dedup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


@query("op2_quality")
def op2_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    scored = quality.score(docs, quality.train(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.GOOD).cast("int").alias("predicted")
    )


@query(
    "op3_preference_pairs",
    """
    WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM t),
    f AS (SELECT conv_id, max(p) FILTER (role = 'assistant') AS fp, count(*) AS n FROM c GROUP BY conv_id),
    v AS (SELECT conv_id, arg_max(text, p) AS prev FROM c JOIN f USING (conv_id) WHERE role = 'assistant' AND p < fp GROUP BY conv_id),
    r AS (SELECT conv_id, p, role, text FROM c JOIN f USING (conv_id) WHERE fp IS NULL OR p < fp
          UNION ALL SELECT conv_id, fp, 'assistant', prev FROM f JOIN v USING (conv_id)),
    b AS (SELECT c.conv_id, min(c.p) AS p FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.p = r.p AND c.role = r.role AND c.text = r.text
          WHERE r.p IS NULL GROUP BY c.conv_id),
    l AS (SELECT f.conv_id, coalesce(b.p - 1, n) AS same FROM f LEFT JOIN b ON f.conv_id = b.conv_id),
    s AS (SELECT 'c' AS side, conv_id, p, role, text FROM c UNION ALL SELECT 'r', conv_id, p, role, text FROM r),
    d AS (SELECT side, s.conv_id, p, p <= same AS shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x,
                 CASE WHEN role = 'assistant' THEN (length(role) + 5) || ':0,' || (length(text) + 8) || ':1'
                      ELSE (length(role) + length(text) + 13) || ':0' END AS m
          FROM s JOIN l ON s.conv_id = l.conv_id)
    SELECT l.conv_id, any_value(same) AS n_prompt_turns,
           coalesce(string_agg(x, '' ORDER BY p) FILTER (shared AND side = 'c'), '') AS prompt,
           coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT shared AND side = 'c'), '') AS chosen,
           coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT shared AND side = 'r'), '') AS rejected,
           coalesce(string_agg(m, ',' ORDER BY p) FILTER (NOT shared AND side = 'c'), '') AS chosen_mask,
           coalesce(string_agg(m, ',' ORDER BY p) FILTER (NOT shared AND side = 'r'), '') AS rejected_mask
    FROM l JOIN d ON l.conv_id = d.conv_id GROUP BY l.conv_id
    """,
)
def op3_preference_pairs(spark, folder):
    """Every conversation against itself with its last reply gone stale: one pair each."""
    chosen = preferences.transcripts(table(spark, folder, "conversations"), "conv_id", "chosen")
    pairs = preferences.format_pairs(chosen.withColumn("rejected", preferences.stale_reply(F.col("chosen"))))
    good, bad = F.col("chosen_completion"), F.col("rejected_completion")
    return pairs.select(
        "conv_id", "n_prompt_turns", "prompt", preferences.text_of(good).alias("chosen"), preferences.text_of(bad).alias("rejected"),
        preferences.mask_of(good).alias("chosen_mask"), preferences.mask_of(bad).alias("rejected_mask"),
    )


@query("op4_mix_sources")
def op4_mix_sources(spark, folder):
    plan = mixing.plan_mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    taken = F.col("size") * F.size("shards")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join("shards", ",").alias("shards"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_decontaminate")
def op6_decontaminate(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_token_files")
def op7_token_files(spark, folder):
    import public_tokenizers

    return token_files.token_output(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op8_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
    g AS (SELECT doc_id, p, word, string_agg(word, ' ') OVER w AS k, count(*) OVER w AS c FROM u
          WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
    f AS (SELECT k, min(doc_id) AS low FROM g WHERE c = 50 GROUP BY k),
    x AS (SELECT g.doc_id, g.p, g.word, CASE WHEN c = 50 AND low < g.doc_id THEN 1 ELSE 0 END AS hit FROM g LEFT JOIN f USING (k)),
    y AS (SELECT doc_id, p, word, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM x)
    SELECT d.doc_id, len(d.ws) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256
    FROM d LEFT JOIN y ON d.doc_id = y.doc_id GROUP BY d.doc_id, d.ws
    """,
)
def op8_substring_dedup(spark, folder):
    return recompression.drop_repeats(table(spark, folder, "documents"))


@query("op9_secret_scan")
def op9_secret_scan(spark, folder):
    return secrets.scan(table(spark, folder, "documents"))


@query("op10_vector_search")
def op10_vector_search(spark, folder):
    return vector_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op11_hard_negatives",
    """
    WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """,
)
def op11_hard_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings")
    own, label = vectors["vec_id"], vectors["label"].cast("long")
    return hard_negatives.mine(vectors, F.when(own % 7 == 0, (label + 1) % 10).otherwise(label), own % 50 == 0)


@query("op12_token_alignment")
def op12_token_alignment(spark, folder):
    import public_tokenizers as files

    return alignment.cross_align(table(spark, folder, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


@query(
    "op13_warc_round_trip",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
    t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM t
    """,
)
def op13_warc_round_trip(spark, folder):
    return warc.round_trip(table(spark, folder, "pages")).drop("payload")
