"""The registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from relevia.llm import (
    decontaminate,
    exact_dedup,
    importance,
    line_dedup,
    minhash_dedup,
    mixing,
    periodic_runs,
    pii,
    pieces,
    quality,
    separator_scan,
    token_parquet,
    url_filter,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The rules that the url query is asked to apply.
URL_RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]


def op1_url_filter(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


def op2_token_counts(spark, folder):
    return separator_scan.count_tokens(table(spark, folder, "documents"))


def op3_minhash_dedup(spark, folder):
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), minhash_dedup.Method(width=2))


def op4_token_output(spark, folder):
    return token_parquet.write_and_index(table(spark, folder, "documents"))


def op5_line_dedup(spark, folder):
    return line_dedup.line_report(table(spark, folder, "documents"), bands=line_dedup.BANDS)


def op6_quality(spark, folder):
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_pii(spark, folder):
    return pii.find_pii(table(spark, folder, "documents"))


def op8_exact_dedup(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op9_decontamination(spark, folder):
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


def op11_importance(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_sentencepiece(spark, folder):
    return pieces.round_trip(table(spark, folder, "documents"))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Fixed by the query: one document in ten, by its id, repeats a stretch of its words to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    numbers = np.arange(n)
    numbers[a:] = a + (numbers[a:] - a) % period
    return numbers


def op13_periodic_runs(spark, folder):
    return periodic_runs.run_report(table(spark, folder, "documents"), rewrite=repeated_tail)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_token_output": op4_token_output,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_importance": op11_importance,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_periodic_runs": op13_periodic_runs,
}

CHECKS: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents
        ), r AS (
          SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
          FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op9_decontamination": r"""
        WITH iw AS (
          SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE text IS NOT NULL
        ), wins AS (
          SELECT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS run
          FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0
        ), dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), runs AS (
          SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS run
          FROM dw, (SELECT DISTINCT size FROM wins), unnest(range(1, len(w) - size + 2)) AS t(k)
        ), hits AS (
          SELECT doc_id, k, wins.size, item_id FROM runs JOIN wins ON runs.size = wins.size AND runs.run = wins.run
        ), words AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + size)) AS t(p) GROUP BY doc_id
        ), found AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
}
