"""Passages that repeat inside longer lines, against grouping all windows by brute force."""

import random
import re

from linework.llm import line_dedup, passage_dedup, queries
from linework.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    """Spans by text: every window of 51 words that stood before, less what its first occurrence covers."""
    seen, want = {}, {}
    for k in sorted(texts):
        found = list(WORD.finditer(texts[k]))
        w, spans = [m.group().lower() for m in found], []
        for s in range(len(w) - 50):
            key = tuple(w[s : s + 51])
            doc, first = seen.setdefault(key, (k, s))
            at, start = s, found[s].start()
            if (doc, first) == (k, s):
                continue
            if doc == k and s < first + 51:
                at, start = first + 51, found[first + 50].end()
            if spans and at <= spans[-1][1]:
                spans[-1][1], spans[-1][3] = s + 51, found[s + 50].end()
            else:
                spans.append([at, s + 51, start, found[s + 50].end()])
        want[k] = ",".join(f"{a}:{b}" for _, _, a, b in spans)
    return want


def rows(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.removed for r in passage_dedup.without_passages(df).collect()}


def test_passages_of_51_words_inside_lines(spark):
    rnd = random.Random(4)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    p, q = fresh(51), fresh(50)
    texts = {
        1: " ".join(fresh(30) + p + fresh(9)), 2: " ".join(fresh(7) + p + fresh(20)).upper(), 3: " ".join(fresh(5)) + "\n" + "\n".join(p[:20]) + "  " + " ".join(p[20:]),
        4: " ".join(fresh(9) + q + fresh(9)), 5: " ".join(fresh(2) + q + fresh(3)), 6: " ".join(p[:50]), 7: "", 8: "é💥 " + " ".join(p) + " end",
    }
    got = rows(spark, texts)
    assert got == brute(texts)
    assert [k for k in texts if got[k]] == [2, 3, 8]


def test_passages_equal_brute_force(spark):
    rnd = random.Random(8)
    pool = [[f"p{i}x{rnd.randrange(10**6)}" for _ in range(rnd.randint(40, 160))] for i in range(12)]
    texts = {}
    for k in range(120):
        w = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            w += p[a : a + rnd.randint(1, 160)] if rnd.random() < 0.6 else p
            w += [f"z{rnd.randrange(40)}" for _ in range(rnd.randint(0, 30))]
        texts[k] = "".join(x + rnd.choice([" ", "\n", "  ", " \t"]) for x in w)
    texts[200], texts[201] = "a b " * 150, "A b a " * 90
    texts[202], texts[203] = " ".join(f"r{i % 37}" for i in range(400)), " ".join(f"r{i % 90}" for i in range(400))
    assert rows(spark, texts) == brute(texts)


def test_rows_without_id_and_with_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (5, "x " + text), (5, "y " + text), (6, None), (7, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in passage_dedup.without_passages(df).collect())
    assert got == [(0, 0), (5, 1), (5, 1), (6, 0), (7, 1)]


def test_short_lines_are_grouped_too(spark):
    sf, seen, want = "/root/testdata/sf0.001", set(), {}
    for k, text in sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect()):
        at, out = 0, []
        for line in text.split("\n"):
            key = " ".join(WORD.findall(line)).lower()
            if key and key in seen:
                out.append(f"{at}:{at + len(line)}")
            seen.add(key)
            at += len(line) + 1
        want[k] = ",".join(out)
    got = {r.doc_id: r for r in queries.queries()["op7_every_line"](spark, sf).collect()}
    # The same units, whole lines, in stretches of 30 words and more: op7_line_dedup counts sentences.
    lines = {r.doc_id: r for r in line_dedup.without_repeats(table(spark, sf, "documents"), sentences=False).collect()}
    assert {k: r.removed for k, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > sum(r.n_removed for r in lines.values())
