"""The corpus queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from strandline.llm import decontam, exact_dedup, html_extract, langid, mixing, quality, sharding, simhash, suffix_dedup, tokens
from strandline.llm.common import read_table

#: Place of the sentencepiece model; None: that of the installed package of public tokenizers.
TOKENIZER = None


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark, sf_dir):
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_source_mixing(spark, sf_dir):
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_sharding(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_quality_classifier,
        op3_source_mixing,
        op4_language_id,
        op5_benchmark_decontamination,
        op6_sharding,
        op7_token_counts,
        op8_simhash_near_dedup,
        op9_suffix_array_dedup,
        op10_exact_dedup,
        pipeline,
    )
}

ORACLE_SQL = {
    "op5_benchmark_decontamination": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM w, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN it USING (r)""",
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST, r)""",
}
