"""The queries of the operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    fill_middle,
    hamming,
    html_text,
    line_crf,
    mixing,
    packing,
    pii,
    pivots,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    vptree,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and its source."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of each vector whose vec_id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, n_entities and entity_types of every document."""
    return pii.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = _table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, distance: the 10 nearest sign codes of each vector whose vec_id is divisible by 50."""
    codes = hamming.sign_codes(_table(spark, sf_dir, "embeddings"))
    return hamming.nearest_codes(codes, codes.where("vec_id % 50 = 0"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens as loaded, n_tokens_edited after the revision's edits, and the characters encoded for them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.revision(F.col("text")).alias("edits"))
    edited = token_counts.apply(token_counts.build(docs))
    return edited.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_edited"), "n_chars", "n_encoded")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the visible text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    return fill_middle.digests(fill_middle.transform(_table(spark, sf_dir, "documents")))


def op12_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each vec_id divisible by 100."""
    return pivots.hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_mix_sources,
        op3_vantage_point_search,
        op4_surrogate_pii,
        op5_line_crf_quality,
        op6_hamming_top_k,
        op7_harmonic_packing,
        op8_suffix_array_dedup,
        op9_edit_aware_token_counts,
        op10_html_text,
        op11_fill_in_middle,
        op12_lexicon_toxicity,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_hamming_top_k": """
        WITH v AS (
          SELECT vec_id, embedding FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        c AS (
          SELECT vec_id, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS code
          FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v) u
          WHERE i <= 64 GROUP BY vec_id),
        p AS (
          SELECT q.vec_id AS query_id, r.vec_id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
          FROM c q JOIN c r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
        FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b FROM t),
        f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
          array_to_string(list_slice(tok, 1, a), '') AS p, array_to_string(list_slice(tok, a + 1, b), '') AS m, array_to_string(list_slice(tok, b + 1, n), '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v),
        c AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM c a JOIN c b ON a.i = b.i WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
        l AS (SELECT s.*, p.label = q.label AS same FROM s JOIN v p ON p.vec_id = anchor_id JOIN v q ON q.vec_id = row_id WHERE anchor_id <> row_id),
        pos AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM l WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
        neg AS (SELECT p.anchor_id, positive_id, positive_score, row_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id) AS rank
          FROM pos p JOIN l ON l.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5""",
}
