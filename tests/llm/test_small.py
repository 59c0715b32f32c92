"""Every operator on nulls, empty texts, repeated rows, clashing columns and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from linework.llm import bpe_codec, decontaminate, gru_lm, language_id, line_dedup, near_dedup, quality, secret_scan, token_counts, url_filter
from linework.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, id string, blob string, word string, n long"
BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PROSE = "The quick brown fox jumps over the lazy dog and then it walks home along the river bank."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, PROSE, "en"), (4, PROSE, "en"), (5, PROSE, "en"), (None, "Le chat est sur la table et le chien dort.", "fr"), (6, "12345 !!! ---", None),
        (7, "Der Hund und die Katze sind im Haus und schlafen.", "de"), (8, "Le chat noir est sur la table avec le chien.", "fr"), (9, ("word " * 5000).strip(), "en"), (10, "x" * 30000, "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", 0, "h", "k", "i", "b", "w", 1) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight", "x"), (2, None, "x"), (3, "too short", "x")], "item_id long, text string, doc string")


ALL = {
    "language": language_id.identify,
    "secrets": secret_scan.secret_findings,
    "near": near_dedup.near_duplicates,
    "counts": lambda d: token_counts.token_counts(d, BYTES),
    "codec": lambda d: bpe_codec.round_trip_digests(d, WORDS),
    "lines": line_dedup.without_repeats,
    "quality": quality.quality,
    "bench": lambda d: decontaminate.contaminated(d, bench(d.sparkSession)),
    "lm": gru_lm.score,
}
#: Operators with a row for each row, and those with one for each document.
BY_ROW = {"language", "secrets", "counts", "codec", "lines", "quality", "lm"}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows(odd, name):
    got = ALL[name](odd).collect()
    if name in BY_ROW:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(empty, name):
    assert ALL[name](empty).collect() == []


def test_language_of_nothing(odd):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd).collect()}
    for k in (1, 2, 3, 6):
        assert got[k] == ("und", 0.0)
    assert got[8][0] == "fr" and got[5][0] == "en"


def test_near_of_copies(odd):
    got = {r.doc_id: (r.group_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert got[4] == (4, True) and got[5] == (4, False) and got[1] == (1, True) and got[2] == (2, True)
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 6, 7, 8, 9, 10]))


def test_counts_of_nothing(odd):
    got = {r.doc_id: r for r in token_counts.token_counts(odd, BYTES).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (0, 0, False) and got[10].over_limit


def test_codec_of_nothing(odd):
    got = {r.doc_id: r for r in bpe_codec.round_trip_digests(odd, WORDS).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (0, none, none)


def test_quality_of_nothing(odd):
    got = {r.doc_id: r for r in quality.quality(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].kept and got[9].n_repeat_words == 5000 and got[9].base_failed


def test_secrets_mask_and_keep_rows(spark):
    df = spark.createDataFrame([(1, 'say token = "abcdef123" now'), (2, None), (3, "AKIA" + "B" * 16 + " x"), (3, "clean")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in secret_scan.redact(df).collect()}
    assert got == {(1, 'say [SECRET]" now'), (2, None), (3, "[SECRET] x"), (3, "clean")}


def test_masking_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x AKIA" + "B" * 16, "b", "k", 5)], "doc_id long, text string, blob string, kind string, start int")
    assert secret_scan.redact(df).collect() == [(1, "x [SECRET]", "b", "k", 5)]
    assert near_dedup.one_of_each(df.withColumnsRenamed({"kind": "id", "start": "hash"})).columns == ["doc_id", "text", "blob", "id", "hash"]
    assert language_id.predict(df.withColumnRenamed("kind", "lang"), language_id.Model(None)).columns == ["doc_id", "text", "blob", "lang", "start", "lang_pred", "lang_score"]


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([("secret: abcdefg",), ("plain",)], "text string")
    ledger = secret_scan.scan_blobs(old)
    both = old.unionByName(spark.createDataFrame([("api_key=zzzzzz9",), ("plain",)], "text string"))
    new = secret_scan.scan_blobs(both, ledger).collect()
    assert {r.blob for r in new} == {hashlib.sha256(b"api_key=zzzzzz9").hexdigest()} and len(new) == len(secret_scan.RULES)
    later = tuple(secret_scan.Rule(r.kind, r.pattern, r.group, r.least, 2, r.hint) if r.kind == "hex" else r for r in secret_scan.RULES)
    again = secret_scan.scan_blobs(both, ledger, rules=later).collect()
    assert sum(r.kind == "hex" for r in again) == 3 and sum(r.kind != "hex" for r in again) == len(secret_scan.RULES) - 1
    assert secret_scan.secret_findings(both.withColumn("doc_id", F.lit(1)), ledger).filter("n_assign = 1").count() == 2


URLS = "page_id long, url string, html string, host string, verdict string, score string"


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f"), (2, "https://x.net/other"), (3, "http://example.com/de/1"), (4, "http://notexample.com/de/1"), (5, "ftp://b.org/fr/"), (6, "http://b.org"), (7, None), (8, "no scheme"), (9, "http://net/"), (10, "http://x.net"), (10, "http://x.net"), (11, "http://h.net#a/b"), (12, "http://h.net?x/y"),
    ]
    df = spark.createDataFrame([(i, u, "", "", "", "") for i, u in rows], URLS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][:3] == ("x.net", "/other", "net/") and got[2][3] == "block"
    assert got[3][2] == "example.com/de/" and got[4][2] is None and got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("b.org", "", None) and got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert got[9][2] == "net/" and got[10][:3] == ("x.net", "", None) and got[11][:2] == ("h.net", "") and got[12][:2] == ("h.net", "")
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0


def test_short_items_and_nulls(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine"), (2, "too short"), (3, None), (3, "ONE two, three four five six seven eight")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word) for r in got) == [(1, 1, 1), (2, 3, 0), (3, 1, 0)]


def test_lines_keep_the_first_and_its_offsets(spark):
    line = " ".join(f"word{k}" for k in range(31))
    df = spark.createDataFrame([(2, f"short\n{line}\nend"), (1, f"{line.upper()}  \nx"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.without_repeats(df, with_text=True).collect()}
    assert got[1].n_removed == 0 and got[2].removed == f"6:{6 + len(line)}" and got[2].clean_text == "short\nend" and got[3].n_removed == 0
    assert got[1].n_shared == got[2].n_shared == 1 and got[3].n_shared == 0


def test_stretches_of_short_sentences(spark):
    said = [" ".join(f"w{k}x{i}" for i in range(10)) + "." for k in range(4)]
    other = "One more. It is."
    df = spark.createDataFrame(
        [(1, f"Start here. {' '.join(said)} {other}"), (2, f"Cut in {' '.join(said[:1])} {said[1]} {said[2]}\n\n{said[3]} Own end. {other}"), (3, f"{said[0]} Own words. {said[1]} {other}"), (3, f"{said[0]} Own words. {said[1]} {other}")],
        "doc_id long, text string",
    )
    got = [(r.doc_id, r.n_removed, r.n_shared, r.clean_text) for r in line_dedup.without_repeats(df, with_text=True).orderBy("doc_id").collect()]
    # Three sentences of ten words each, over a blank line, go; the first, with two more words, and short ones by themselves stay.
    assert got[1] == (2, 3, 3, f"Cut in {said[0]} \nOwn end. {other}")
    assert got[0][:2] == (1, 0) and got[0][2] >= 4
    assert [g[1] for g in got[2:]] == [0, 0]


def test_urls_of_one_side_only_are_allowed(spark):
    rows = [(k, f"http://a{k}.net/p/{k}") for k in range(40)] + [(100, "http://s3.xnet.com/p/3")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[100] == "allow" and got[3] == "block"


def test_a_ledger_of_some_rules(spark):
    docs = spark.createDataFrame([(1, "password = abcdef123 and AKIA" + "A" * 16), (2, "nothing"), (3, None)], "doc_id long, text string")
    rules = secret_scan.BASE_RULES
    ledger = secret_scan.scan_blobs(docs, rules=rules[:1])
    more = secret_scan.scan_blobs(docs, ledger, rules=rules)
    assert ledger.count() == 3 and sorted({r.kind for r in more.collect()}) == ["access", "hex"] and more.count() == 6
    assert secret_scan.scan_blobs(docs, ledger.unionByName(more), rules=rules).count() == 0
    rows = lambda x: sorted(map(tuple, secret_scan.secret_findings(docs, x, rules=rules).collect()), key=str)
    assert rows(ledger) == rows(None)
