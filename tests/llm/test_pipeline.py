"""Each stage of the pipeline on what the one before kept, against a plain version."""

import hashlib
import re

import pytest

import corpus_pipeline
from linework.llm import queries
from tests.llm.test_exact import SF, spans


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for name in ("language_id", "near_dedup", "decontaminate", "secret_scan"):
        assert stages[name].columns == stages["documents"].columns and stages[name].dtypes == stages["documents"].dtypes


def test_language(stages):
    before, after = rows(stages["documents"]), rows(stages["language_id"])
    assert set(after) == {k for k, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert sum(after[k].lang == before[k].lang for k in after) >= 0.95 * len(after)


def test_one_of_each_group_stays(spark, stages):
    from linework.llm.near_dedup import near_duplicates

    groups = near_duplicates(stages["language_id"]).collect()
    assert sorted(rows(stages["near_dedup"])) == sorted({r.group_id for r in groups})
    texts = [" ".join(r.text.lower().split()) for r in stages["near_dedup"].collect()]
    assert len(texts) == len(set(texts))


def test_no_benchmark_item_stays(spark, stages):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages["near_dedup"]), rows(stages["decontaminate"])
    assert set(after) == {k for k, r in before.items() if not any(f" {i} " in f" {norm(r.text)} " for i in items)}


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = rows(stages["decontaminate"]), rows(stages["secret_scan"])
    assert set(before) == set(after)
    for k, r in before.items():
        assert not [s for s in spans(after[k].text) if "[SECRET]" not in after[k].text[s[0] : s[3]]]
        if not spans(r.text):
            assert after[k] == r
        else:
            assert "[SECRET]" in after[k].text and after[k].n_chars == len(after[k].text)


def test_ids_are_the_library_s(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    texts = rows(stages["secret_scan"])
    for k, r in rows(stages["bpe"]).items():
        ids = library.encode(texts[k].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    got = {(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.decoded_sha256) for r in stages["bpe"].collect()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, a text of over a million characters and columns whose names could clash."""
    base = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars").collect()
    own = "the quick brown fox said api_key = abcdef1234567 and went home along the old river bank before the rain came down again"
    odd = [(None, own, "en", "s", 1), (None, own, "en", "s", 1), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (base[0].doc_id, base[0].text, base[0].lang, base[0].source, base[0].n_chars)]
    words = [w for r in base for w in (r.text or "").split()]
    odd.append((9003, " ".join(words * (1_100_000 // len(" ".join(words)) + 1)), "en", "s", 2))
    more = ("_salt", "_blob", "_found", "id", "hash", "key", "a.b", "text ", "group_id")
    docs = spark.createDataFrame([(*r, *more) for r in [tuple(x) for x in base] + odd], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.columns == columns and all(tuple(r[5:]) == more for r in docs.collect()), name
        assert docs.count() <= before.count()
    kept = docs.collect()
    assert [c for c in docs.columns if c in more] == list(more) and {"n_tokens", "ids", "decoded_sha256"} <= set(docs.columns)
    assert sum(r.doc_id is None for r in kept) == 2 and 9001 not in {r.doc_id for r in kept} and 9002 not in {r.doc_id for r in kept}
    assert len({r.doc_id for r in kept if r.doc_id is not None}) == sum(r.doc_id is not None for r in kept)
