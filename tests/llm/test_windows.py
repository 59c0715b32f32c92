"""Decontamination against brute force over all windows, where the parts of an item stand in another order."""

import random
from collections import Counter

from linework.llm import decontaminate


def brute(docs, items, similarity=0.8):
    """Best (similarity, earliest start) by document and item, over all windows as long as the item."""
    want = {}
    for d, text in docs:
        w = (text or "").split()
        for i, item in items:
            item = (item or "").split()
            k = min(5, len(item))
            if not item or len(w) < k:
                continue
            x = Counter(tuple(item[j : j + k]) for j in range(len(item) - k + 1))
            for s in range(max(1, len(w) - len(item) + 1)):
                own = w[s : s + len(item)]
                y = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
                got = sum((x & y).values()) / sum((x | y).values())
                if got >= similarity and (got, -s) > want.get((d, i), (0, 0)):
                    want[d, i] = (got, -s)
    return {k: (round(v, 6), -s) for k, (v, s) in want.items()}


def test_all_windows_with_enough_shared_shingles(spark):
    rnd = random.Random(3)
    word = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    a, b, c, short = word(40), word(40), word(30), word(3)
    twice = word(6) * 4
    items = [(1, a + b), (2, c), (3, short), (4, twice), (5, []), (6, None)]
    docs = [
        (1, word(25) + b + a + word(25)),  # the halves in the other order
        (2, word(7) + a + b[:-4] + word(9)), (3, word(5) + a + word(3) + b + word(5)), (4, a + b), (5, word(300)), (6, word(4) + c[:25]), (7, c[2:28]),
        (8, word(9) + short + word(9)), (9, short[:2]), (10, word(3) + twice[:18] + word(8)), (11, None), (12, []), (None, word(11) + c), (13, word(5)), (13, word(8) + c),
        (14, c * 3), (15, [*a[:20], "x", *a[20:], *b]),
    ]
    text = lambda w: None if w is None else " ".join(w)
    docs, items = [(d, text(w)) for d, w in docs], [(i, text(w)) for i, w in items]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.contaminated(table, bench).collect()}
    want = brute(docs, items)
    assert got == want and (1, 1) in want and (8, 3) in want and (None, 2) in want and (13, 2) in want
    left = decontaminate.without_contaminated(table, bench)
    held = {(d, t) for (d, t) in docs if brute([(d, t)], items)}
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in table.collect() if (r.doc_id, r.text) not in held)


def test_no_broadcast_gives_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    item = [f"w{rnd.randrange(50)}" for _ in range(30)]
    docs = [(k, " ".join([*(f"w{rnd.randrange(50)}" for _ in range(k)), *item[k % 3 :], "end"])) for k in range(12)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontaminate.contaminated(table, bench).collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert rows() == want and want
