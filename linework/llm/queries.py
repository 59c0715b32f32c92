"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontaminate, exact_dedup, gru_lm, language_id, line_dedup, near_dedup, passage_dedup, periodic_runs, quality, secret_scan, token_counts, url_filter, whitening
from .common import table


@functools.lru_cache(maxsize=1)
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_findings(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op7_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, sf_dir, "documents"), sentences=False, least_words=1)


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.without_passages(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_url_filter, op4_near_dedup, op5_token_counts, op6_bpe_codec, op7_line_dedup, op7_every_line, op7_passage_dedup, op8_quality_rules, op9_decontaminate, op10_gru_lm, op11_periodic_runs, op12_exact_dedup, op13_whitening, pipeline)}


#: The twin of ``op7_line_dedup`` (and, with whole lines, of ``op7_every_line``).
LINES = r"""
WITH u AS (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS unit FROM (SELECT doc_id, string_split({text}, chr(10)) AS parts FROM documents)),
s AS (SELECT *, CAST(coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u),
w AS (SELECT *, regexp_extract_all(unit, '[^\x20\x09-\x0D]+') AS words FROM s),
n AS (SELECT doc_id, start, start + length(unit) AS stop, len(words) AS words, lower(array_to_string(words, ' ')) AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM w WHERE len(words) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS later, count(*) OVER (PARTITION BY norm) AS n FROM n),
i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS every, place - row_number() OVER (PARTITION BY doc_id, later ORDER BY place) AS own FROM r WHERE n > 1),
k AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, every) >= {least} AS shared, later AND sum(words) OVER (PARTITION BY doc_id, later, own) >= {least} AS gone FROM i),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, CAST(sum(stop - start) FILTER (gone) AS BIGINT) AS removed_chars, string_agg(concat(start, ':', stop), ',' ORDER BY start) FILTER (gone) AS removed, count(*) FILTER (shared) AS n_shared FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars, coalesce(removed, '') AS removed, coalesce(n_shared, 0) AS n_shared FROM documents d LEFT JOIN g USING (doc_id)
"""
SENTENCES = r"regexp_replace(coalesce(text, ''), '([.!?])[\x20\t]', '\1' || chr(10), 'g')"

EXACT = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best = 1 AS kept, text_sha256
FROM n WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_exact_dedup": EXACT, "op7_line_dedup": LINES.replace("{text}", SENTENCES).replace("{least}", "30"), "op7_every_line": LINES.replace("{text}", "coalesce(text, '')").replace("{least}", "1")}
