"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents.

1. ``language_id``: documents without a recognised language go; ``lang`` becomes the prediction.
2. ``near_dedup``: one document of each group of near copies stays.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``secret_scan``: every secret is masked in the text; all documents stay.
5. ``bpe``: all columns but the text, and n_tokens, ids and decoded_sha256: the ids of the whole text
   and the digest of what they decode to.

Null and empty texts have no language and go in the first stage. A row with a null id is a document
of its own. Tables may be empty, and may have more columns of any name, which stay.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm import bpe_codec, decontaminate, language_id, near_dedup, secret_scan
from linework.llm.common import shared_folder
from linework.llm.queries import tokenizer_path

#: A language whose pairwise machines are less sure than this is not recognised.
LEAST_SCORE = 0.5
#: Words that a task of the last stage remembers.
MEMO = 60_000


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns that stages know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256")


def names_aside(stage: Stage) -> Stage:
    """``stage`` with all other columns under plain names meanwhile, so that none can clash or need quotes."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: c if c in KNOWN else f"other{k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*aside.values()), sf_dir)
        back = {plain: c for c, plain in aside.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


@names_aside
def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.filter(~language_id.held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang")
    long = "_" * max(map(len, docs.columns))  # longer than any name that is there
    lang, score = f"_lang{long}", f"_score{long}"
    guessed = language_id.predict(docs, language_id.fit(labelled), lang_out=lang, score_out=score)
    kept = guessed.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(lang)).select(*docs.columns)


@names_aside
def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


@names_aside
def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@names_aside
def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@names_aside
def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    coded = bpe_codec.encode(docs, path, memo=MEMO)
    back = bpe_codec.decode(coded, path, text_col="text", memo=MEMO)
    more = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded_sha256")]
    return back.select(*more, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("secret_scan", stage_secrets),
    ("bpe", stage_bpe),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
