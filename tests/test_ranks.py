"""Running sums and order statistics over ranges of a skewed order, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from linework.operators import metrics, shop


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(3)
    # Group 1: a third of all rows share one value; group 2: few values; group 3: a long tail; group 4: one row.
    rows = [(1, 0.5 if rng.random() < 0.4 else rng.random() ** 6, rng.randrange(2)) for _ in range(3000)]
    rows += [(2, float(rng.randrange(3)), rng.randrange(2)) for _ in range(500)]
    rows += [(3, rng.paretovariate(1.0), rng.randrange(2)) for _ in range(1500)]
    rows += [(4, -1.0, 1)]
    return spark.createDataFrame(rows, "g int, v double, y int").persist()


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_prefix_sums(scores, ranges):
    values = scores.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("y"))
    got = metrics.prefix_sums(values, "v", ["c", "y"], "g", ranges=ranges).collect()
    rows = {}
    for r in values.collect():
        rows.setdefault(r.g, []).append(r)
    assert len(got) == sum(map(len, rows.values()))
    for r in got:
        under = [x for x in rows[r.g] if x.v < r.v]
        assert (r.before_c, r.before_y) == (sum(x.c for x in under), sum(x.y for x in under))
        assert (r.all_c, r.all_y) == (sum(x.c for x in rows[r.g]), sum(x.y for x in rows[r.g]))


def test_prefix_sums_without_groups_and_with_nulls(spark):
    values = spark.createDataFrame([(None, 5), (1.0, 2), (3.0, 4)], "v double, c long")
    got = {r.v: (r.before_c, r.all_c) for r in metrics.prefix_sums(values, "v", ["c"], ranges=4).collect()}
    assert got == {None: (0, 11), 1.0: (5, 11), 3.0: (7, 11)}
    assert metrics.prefix_sums(values.limit(0), "v", ["c"]).collect() == []


@pytest.mark.parametrize("ranges", [2, 5, 256])
def test_order_statistics(scores, ranges):
    n = F.col("n")
    ranks = {"first": F.lit(1), "median": F.floor(n * 0.5) + 1, "p99": F.floor(n * 0.99) + 1, "last": n, "none": n + 1}
    got = {r.g: r for r in metrics.order_statistics(scores, "v", ranks, "g", ranges=ranges).collect()}
    rows = {}
    for r in scores.collect():
        rows.setdefault(r.g, []).append(r.v)
    assert set(got) == set(rows)
    for g, xs in rows.items():
        xs = sorted(xs)
        assert tuple(got[g][1:]) == (len(xs), xs[0], xs[len(xs) // 2], xs[int(len(xs) * 0.99)], xs[-1], None)
    one = metrics.order_statistics(scores, "v", {"median": F.floor(n * 0.5) + 1}, ranges=ranges).collect()
    every = sorted(x for xs in rows.values() for x in xs)
    assert [tuple(r) for r in one] == [(len(every), every[len(every) // 2])]


def test_auc_and_ks_over_ranges(scores):
    for r in metrics.auc(scores.filter("g < 4"), "y", "v", "g").collect():
        rows = [x for x in scores.collect() if x.g == r.g]
        pos, neg = [x.v for x in rows if x.y], [x.v for x in rows if not x.y]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert r.auc == pytest.approx(wins / len(pos) / len(neg))
    inside = scores.filter("g = 1")
    xs = sorted(r.v for r in inside.collect())
    want = max(abs((i + 1) / len(xs) - x) for i, x in enumerate(xs))
    assert metrics.ks_uniform(inside, "v", "g").first().ks_upper == pytest.approx(want)


def test_curve_counts_every_cut_in_one_pass(spark):
    opps = spark.createDataFrame([("h2h", e, n, "sharp") for e, n in [(-1.0, 3), (0.0, 5), (2.5, 9), (8.0, 9), (1.0, 4)]], "market_type string, edge_pct double, book_count long, anchor string")
    pairs = spark.createDataFrame([("h2h", 100, -110), ("h2h", 100, None), ("h2h", None, -110), ("totals", 100, None)], "market_type string, price_a int, price_b int")
    got = {r.market_type: r for r in shop.edge_curve(opps, pairs, {"A": 9, "B": 10}, "market_type").collect()}
    h = got["h2h"]
    assert (h.paired, h.one_sided, h.markets, h.at_0, h.at_1, h.at_2, h.at_8, h.best_books, h.median_books) == (1, 2, 5, 4, 3, 2, 1, 9, 5)
    assert h.reach_A and not h.reach_B and got["totals"].markets is None and not got["totals"].reach_A
