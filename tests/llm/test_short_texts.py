"""Near copies among texts of few words, against all pairs."""

import itertools
import random

from linework.llm import near_dedup


def test_short_pairs_are_found(spark):
    rnd = random.Random(6)
    texts = {}
    for pair in range(300):
        w = [f"p{pair}w{rnd.randrange(1000)}" for _ in range(5 + pair % 15)]
        more = w[:]
        for _ in range(1 + (pair % 15 >= 8)):
            more.insert(rnd.choice([0, len(more)]), f"x{pair}")
        texts[2 * pair], texts[2 * pair + 1] = " ".join(w), " ".join(more)
    texts[1000], texts[1001] = "a b c d e f g h", "a b c d e f g h i"
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1001] == 1000
    for a in range(0, 600, 2):
        runs = [near_dedup.kmers(near_dedup.words(texts[k])).tolist() for k in (a, a + 1)]
        words = [near_dedup.words(texts[k]) for k in (a, a + 1)]
        if near_dedup.aligned(*runs, 0.8) >= 0.8:
            assert got[a + 1] == a, (texts[a], texts[a + 1])
        assert got[a + 1] != a or near_dedup.aligned(*words, 0.8) >= 0.8, (texts[a], texts[a + 1])


def test_recall_of_edited_words():
    """Share of pairs with 1 to 10 % of 300 words edited that share a sketch, among those whose words align."""
    rnd = random.Random(11)
    for share in (0.01, 0.03, 0.05, 0.1):
        found = []
        for _ in range(150):
            a = [f"w{rnd.randrange(3000)}" for _ in range(300)]
            b = [rnd.choice([[f"x{rnd.randrange(10**6)}"], [], [w, "y"]]) if rnd.random() < share else [w] for w in a]
            b = [w for part in b for w in part]
            if near_dedup.aligned(a, b, 0.8) >= 0.8:
                found.append(bool(set(near_dedup.sketches(a)) & set(near_dedup.sketches(b))))
        assert len(found) > 100 and sum(found) >= 0.9 * len(found), (share, sum(found), len(found))


def test_prefix_keys_meet_whenever_texts_are_alike():
    rnd = random.Random(7)
    texts = [[f"v{rnd.randrange(3)}" for _ in range(rnd.randint(1, 23))] for _ in range(150)]
    for t in texts[:100]:
        other = t[:]
        other.insert(rnd.randrange(len(t) + 1), "new")
        texts.append(other)
    runs = [near_dedup.kmers(t).tolist() for t in texts]
    keys = [set(near_dedup.prefix_keys(t, 0.8)) for t in texts]
    met = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if min(len(runs[a]), len(runs[b])) <= near_dedup.SHORT and near_dedup.aligned(runs[a], runs[b], 0.8) >= 0.8:
            assert keys[a] & keys[b]
            met += 1
    assert met > 20
