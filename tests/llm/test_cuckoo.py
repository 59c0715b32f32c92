"""Exact duplicates against plain Python, and the cuckoo filter on its own."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linework.llm import exact_dedup, queries
from linework.llm.exact_dedup import Cuckoo, Key
from tests import twins


def key(text, live=1, chars=0, id=0, row=0):
    return Key(hashlib.sha256(text.encode()).digest(), len(text), live, chars, id, row)


def test_twin(spark, small):
    name = "op12_exact_dedup"
    twins.same(spark, twins.duck(small), small, queries.queries()[name], queries.oracle_sql()[name])


def test_filter_with_insertions_and_deletions():
    rng, own, want = random.Random(7), Cuckoo(buckets=2), {}
    for step in range(20_000):
        text = f"t{rng.randrange(1500)}"
        k = key(text)
        if rng.random() < 0.6:
            own.insert(k)
            want[text] = want.get(text, 0) + 1
        else:
            assert own.delete(k.digest, k.length) == (want.get(text, 0) > 0)
            if want.get(text):
                want[text] -= 1
        if step % 4000 == 0:
            for t in range(1500):
                k = key(f"t{t}")
                found = own.get(k.digest, k.length)
                assert (found.live if found else 0) == want.get(f"t{t}", 0)
    live = sum(v > 0 for v in want.values())
    assert own.resized >= 7 and len(list(own.keys())) == live == sum(s > 0 for s in own.slots)


def test_equal_fingerprints_are_told_apart_by_content():
    a = key("a")
    other = Key(a.digest[:10] + bytes(22), 5, 1, 0, 1, 1)  # same shard, home and fingerprint
    own = Cuckoo()
    own.insert(a)
    assert own.get(other.digest, other.length) is None
    own.insert(other)
    assert len(list(own.keys())) == 2 and own.delete(a.digest, a.length) and own.get(other.digest, 5) is other
    assert own.get(a.digest, a.length) is None and not own.delete(a.digest, a.length)


def test_more_equal_fingerprints_than_slots():
    """More keys of one fingerprint than two buckets hold: doubling parts them by the other bits of the digest."""
    own = Cuckoo()
    base = hashlib.sha256(b"x").digest()
    keys = [Key(base[:4] + k.to_bytes(4, "big") + base[8:10] + k.to_bytes(22, "big"), 1, 1, 0, k, k) for k in range(0, 16 * 40, 16)]
    for k in keys:
        own.insert(k)
    assert own.resized and all(own.get(k.digest, 1) is k for k in keys)


def test_best_row():
    better = exact_dedup._better
    assert better((5, 9, 9), (4, 1, 1)) and better((5, 1, 9), (5, 2, 1)) and better((5, 1, 1), (5, 1, 2))
    assert better((5, 1, 9), (5, None, 1)) and not better((5, None, 1), (5, 1, 9)) and better((5, None, 1), (5, None, 2))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "ab"), (5, "ab"), (6, "a  \n b"), (7, "a  \n b"), (None, "A b"), (8, "Ab"), (9, "a b"), (None, "same"), (None, "same"), (10, "x" * 200_000), (11, "x " * 200_000)]
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, digest string, row int, live int")


def test_odd_rows_of_copies(odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == 15
    by = {r.doc_id: (r.keep_id, r.group_size) for r in got if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == (3, 3)
    assert by[4] == by[5] == by[6] == by[7] == (6, 5)
    assert by[8] == (None, 2) and by[9] == (9, 1) and by[10] == by[11] == (11, 2)
    assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(["3", "6", "None", "9", "None", "11"])
    assert {r.text_sha256 for r in got if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}


def test_empty_table_of_copies(odd):
    assert exact_dedup.exact_duplicates(odd.limit(0)).collect() == []


def test_copies_over_many_tasks_and_shards(spark):
    """A third of all rows are one text; groups of every size, over more tasks than cores."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t "), (F.col("id") % 700).cast("string"))).alias("text")).repartition(13)
    got = exact_dedup.exact_duplicates(rows).collect()
    want = {}
    for i in range(3000):
        want.setdefault("hot" if i % 3 == 0 else i % 700, []).append(i)
    assert len(got) == 3000
    # "t 7" is longer than no other spelling, so the smallest id of each group stays.
    for members in want.values():
        rows = [r for r in got if r.doc_id in set(members)]
        assert {r.keep_id for r in rows} == {min(members)} and {r.group_size for r in rows} == {len(members)}
    assert sum(r.kept for r in got) == len(want)


def test_index_over_batches(spark):
    """Insert, delete, ask; with another depth the filters are filled from the stored keys."""
    texts = lambda *t: exact_dedup.combined(exact_dedup.text_keys(spark.createDataFrame([(k, x) for k, x in enumerate(t)], "doc_id long, text string")))
    first = exact_dedup.stored(exact_dedup.updated(None, texts("one", "two", "two", "three"), depth=2))
    assert sorted(r.live for r in exact_dedup.live_keys(first).collect()) == [1, 1, 2]
    second = exact_dedup.stored(exact_dedup.updated(first, texts("four", "one"), texts("t wo", "three", "never"), depth=2))
    known = lambda index, depth: [r.known for r in exact_dedup.probe(index, texts("one", "two", "three", "four", "never"), depth=depth).orderBy("id").collect()]
    assert known(second, 2) == [True, True, False, True, False]
    third = exact_dedup.stored(exact_dedup.updated(second, texts("five"), texts("one"), depth=5))
    assert known(third, 5) == [True, True, False, True, False]
    assert sorted(r.live for r in exact_dedup.live_keys(third).collect()) == [1, 1, 1, 1]
    gone = exact_dedup.updated(third, texts(), texts("one", "two", "four", "five"), depth=5)
    assert exact_dedup.live_keys(gone).count() == 0
