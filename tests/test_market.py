import random

import pytest
from pyspark.sql import functions as F

from linework.functions import odds
from linework.functions.stats import normal_cdf, weighted_median, wilson
from linework.operators import consensus, grading, picks, quotes, shop


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("price", "prob", "dec"), [(100, 0.5, 2.0), (-110, 110 / 210, 1 + 100 / 110), (150, 0.4, 2.5), (-200, 2 / 3, 1.5)])
def test_known_prices(spark, price, prob, dec):
    assert one(spark, odds.implied_probability(F.lit(price))) == pytest.approx(prob)
    assert one(spark, odds.decimal_odds(F.lit(price))) == pytest.approx(dec)
    assert one(spark, odds.american_from_probability(F.lit(prob))) in (price, -price if price == 100 else price)


def test_zero_price_is_null(spark):
    assert one(spark, odds.implied_probability(F.lit(0))) is None
    assert one(spark, odds.decimal_odds(F.lit(0))) is None


def test_full_margin_costs_4_55_percent(spark):
    assert one(spark, odds.edge_pct(F.lit(0.5), F.lit(-110))) == pytest.approx(-4.545, abs=1e-3)


def test_devig_sums_to_one_and_keeps_order(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([-1, 1]) * rnd.randint(101, 5000), rnd.choice([-1, 1]) * rnd.randint(101, 5000)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p int, q int").select(odds.implied_probability(F.col("p")).alias("a"), odds.implied_probability(F.col("q")).alias("b"))
    for m in odds.METHODS:
        both = df.filter("a + b > 1.0").select("a", "b", odds.devig(F.col("a"), F.col("b"), m).alias("x"), odds.devig(F.col("b"), F.col("a"), m).alias("y")).collect()
        for r in both:
            assert r.x + r.y == pytest.approx(1.0, abs=1e-9)
            assert (r.a > r.b) == (r.x > r.y) or r.a == r.b


def test_lower_weighted_median(spark):
    entry = lambda v, w: F.struct(F.lit(float(v)).alias("v"), F.lit(float(w)).alias("w"))
    assert one(spark, weighted_median(F.array(entry(3, 1), entry(1, 1), entry(2, 1), entry(4, 1)))) == 2.0
    assert one(spark, weighted_median(F.array(entry(3, 9), entry(1, 1)))) == 3.0


def test_normal_cdf(spark):
    assert one(spark, normal_cdf(F.lit(0.0))) == pytest.approx(0.5, abs=2e-7)
    assert one(spark, normal_cdf(F.lit(1.0))) == pytest.approx(0.8413447, abs=2e-7)
    assert one(spark, normal_cdf(F.lit(-1.96))) == pytest.approx(0.0249979, abs=2e-7)


def test_wilson_of_nothing(spark):
    assert one(spark, wilson(F.lit(0.0), F.lit(0.0), True)) == 0.0


QUOTE = "game_id long, market_type string, player_id string, side string, line double, book string, price int"


def test_spreads_pair_on_opposite_lines(spark):
    rows = [(1, "spreads", "", "home", -3.0, "b1", -110), (1, "spreads", "", "away", 3.0, "b1", -110), (1, "totals", "", "over", 44.0, "b1", -105)]
    pairs = quotes.priced_pairs(spark.createDataFrame(rows, QUOTE)).collect()
    assert [(p.pair_line, p.price_a, p.price_b, p.plausible) for p in pairs] == [(-3.0, -110, -110, True)]


def test_broken_quote_has_no_vote(spark):
    good = [(1, "h2h", "", s, 0.0, f"b{k}", p) for k in range(3) for s, p in (("home", -120), ("away", 100))]
    broken = [(1, "h2h", "", s, 0.0, "bad", -10000) for s in ("home", "away")]
    with_it = consensus.fair_prices(spark.createDataFrame(good + broken, QUOTE)).orderBy("side").collect()
    without = consensus.fair_prices(spark.createDataFrame(good, QUOTE)).orderBy("side").collect()
    assert with_it == without and with_it[0].book_count == 3 and with_it[0].dispersion == 0.0


def test_main_line_counts_signed_lines_and_breaks_ties_down(spark):
    rows = [(1, "spreads", "", "home", -3.0, b, -110) for b in "abc"] + [(1, "spreads", "", "away", 3.0, b, -110) for b in "abc"] + [(1, "spreads", "", "home", -7.0, b, 150) for b in "def"]
    assert shop.main_lines(spark.createDataFrame(rows, QUOTE)).select("main_line", "n_books").collect() == [(3.0, 3)]


def test_best_price_tie_goes_to_first_book(spark):
    rows = [(1, "h2h", "", "home", 0.0, b, 120) for b in ("z", "c", "m")] + [(1, "h2h", "", "home", 0.0, "a", 110)]
    assert shop.best_prices(spark.createDataFrame(rows, QUOTE)).select("best_book", "best_price").collect() == [("c", 120)]


def test_missing_kickoff_and_missing_game_stay(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "game_id long")
    games = spark.createDataFrame([(1, "2001-01-01 00:00:00"), (2, "2002-01-01 00:00:00"), (3, None)], "game_id long, k string").select("game_id", F.col("k").cast("timestamp").alias("kickoff_utc"))
    assert sorted(r.game_id for r in shop.upcoming(df, games, "2001-06-01 00:00:00").collect()) == [2, 3, 4]


def test_implausible_edge_is_rejected_not_clamped(spark):
    rows = [(1, "h2h", "", s, 0.0, f"b{k}", p) for k in range(8) for s, p in (("home", -110), ("away", -110))] + [(1, "h2h", "", "home", 0.0, "odd", 544)]
    q = spark.createDataFrame(rows, QUOTE)
    games = spark.createDataFrame([(1, None)], "game_id long, kickoff_utc timestamp")
    got = shop.opportunities(consensus.fair_prices(q), q, games, "2001-01-01 00:00:00").collect()
    assert [(r.best_price, r.rejected) for r in got] == [(544, True)]


@pytest.mark.parametrize(("market", "side", "line", "home", "away", "want"), [
    ("spreads", "home", -3.5, 24, 20, "win"), ("spreads", "home", -7.0, 24, 17, "push"), ("spreads", "away", 3.0, 24, 20, "loss"), ("h2h", "away", 0.0, 10, 20, "win"), ("h2h", "home", 0.0, 20, 20, "push"),
    ("totals", "over", 44.0, 24, 20, "push"), ("totals", "under", 44.5, 24, 20, "win"), ("spreads_h1", "home", -3.0, 24, 20, "pending"), ("team_totals", "over", 20.5, 24, 20, "pending"), ("h2h", "home", 0.0, None, 3, "pending"),
])
def test_grading(spark, market, side, line, home, away, want):
    assert one(spark, grading.grade_game(F.lit(market), F.lit(side), F.lit(line), F.lit(home).cast("int"), F.lit(away).cast("int"))) == want


def test_caps_never_raise_a_stake(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randint(1, 9), rnd.random() * 0.02) for k in range(200)]
    df = spark.createDataFrame(rows, "pick_id int, game_id int, stake double")
    got = picks.exposure_caps(df).collect()
    before = {k: s for k, _, s in rows}
    assert all(r.stake <= before[r.pick_id] + 1e-15 for r in got)
    assert sum(r.stake for r in got) <= 0.25 + 1e-9
    assert max(sum(r.stake for r in got if r.game_id == g) for g in range(1, 10)) <= 0.04 + 1e-9


def test_reprice_only_withdraws(spark):
    side = "game_id long, market_type string, player_id string, side string, line double"
    pending = spark.createDataFrame([(1, "h2h", "", "home", 0.0, True), (2, "h2h", "", "home", 0.0, False), (3, "h2h", "", "home", 0.0, True), (4, "h2h", "", "home", 0.0, True)], f"{side}, published boolean")
    best = spark.createDataFrame([(1, "h2h", "", "home", 0.0, -150), (2, "h2h", "", "home", 0.0, 120), (4, "h2h", "", "home", 0.0, 110)], f"{side}, best_price int")
    columns = f"{side}, fair_prob double, book_count int, sharp_prob double, dispersion double"
    fair = spark.createDataFrame([(k, "h2h", "", "home", 0.0, 0.5, 20, None, 0.0) for k in (1, 2, 3, 4)], columns)
    got = {r.game_id: r.still_published for r in picks.reprice(pending, best, fair).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def test_reprice_asks_for_the_bar_of_the_class_on_the_anchor(spark):
    side = "game_id long, market_type string, player_id string, side string, line double"
    # Edges of 2.9 and 3.3 percent: enough for a game (2.0), and only the second for a prop (3.2).
    rows = [(1, "h2h", 0.49, None, 20, 0.0), (2, "receptions", 0.49, None, 20, 0.0), (3, "receptions", 0.492, None, 20, 0.0), (4, "h2h", 0.49, 0.47, 20, 0.0), (5, "h2h", 0.47, 0.49, 20, 0.0), (6, "h2h", 0.49, None, 20, 0.16), (7, "h2h", 0.49, None, 7, 0.0), (8, "h2h", 0.7, None, 20, 0.0)]
    keys = lambda g, m: (g, m, "", "over", 4.5)
    fair = spark.createDataFrame([(*keys(g, m), p, n, sharp, spread) for g, m, p, sharp, n, spread in rows], f"{side}, fair_prob double, book_count int, sharp_prob double, dispersion double")
    best = spark.createDataFrame([(*keys(g, m), 110) for g, m, *_ in rows], f"{side}, best_price int")
    pending = spark.createDataFrame([(*keys(g, m), True) for g, m, *_ in rows], f"{side}, published boolean")
    got = {r.game_id: r.still_published for r in picks.reprice(pending, best, fair).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False}


def test_loosest_books_is_reachable():
    assert picks.loosest_books() == 4 and picks.thresholds("prop", "A")[1] == 8


def test_closing_value_is_of_the_own_line_and_player(spark):
    from datetime import datetime as t

    side = ("g", "spreads", "", "home")
    picks = spark.createDataFrame([(1, *side, -3.5, 100), (2, *side, -7.0, 100), (3, "g", "receptions", "p1", "over", 4.5, 120), (4, *side, -1.0, 100)], "pick_id int, game_id string, market_type string, player_id string, side string, line double, price int")
    quote = lambda s, line, book, price, hour, seq: (*s, line, book, price, t(2024, 1, 1, hour), seq)
    prop = ("g", "receptions", "p1", "over")
    observed = spark.createDataFrame(
        [quote(side, -3.5, "a", -120, 9, 1), quote(side, -3.5, "a", -110, 10, 2), quote(side, -3.5, "b", -115, 10, 3), quote(side, -3.5, "b", 300, 13, 4), quote(side, -7.0, "a", 150, 10, 5), quote(prop, 4.5, "a", 110, 10, 6), quote(("g", "receptions", "p2", "over"), 4.5, "a", 500, 10, 7)],
        "game_id string, market_type string, player_id string, side string, line double, book string, price int, observed_at timestamp, seq int",
    )
    games = spark.createDataFrame([("g", t(2024, 1, 1, 12))], "game_id string, kickoff_utc timestamp")
    fair = spark.createDataFrame([(*side, -3.5, 0.5, 0.52), (*side, -7.0, 0.4, None), (*prop, 4.5, 0.48, None)], "game_id string, market_type string, player_id string, side string, line double, fair_prob double, sharp_prob double")
    got = {r.pick_id: (r.closing_price, r.closing_prob, r.clv_pct) for r in grading.closing_lines(picks, grading.closing_quotes(observed, games), fair).collect()}
    assert got[1][:2] == (-110, 0.52) and got[1][2] == pytest.approx(0.52 * (2.0 - (1 + 100 / 110)) * 100)
    assert got[2][:2] == (150, 0.4) and got[2][2] == pytest.approx(0.4 * (2.0 - 2.5) * 100)
    assert got[3][:2] == (110, 0.48) and got[3][2] == pytest.approx(0.48 * (2.2 - 2.1) * 100)
    assert got[4] == (None, None, None)


def test_quotes_after_kickoff_change_nothing_at_the_close(spark):
    """Price and consensus of the close, and the value of users' own prices, with and without what came later."""
    from datetime import datetime as t

    quote = lambda side, book, price, hour, seq: (7, "h2h", "", side, 0.0, book, price, t(2024, 1, 1, hour), seq)
    before = [quote("home", "a", -120, 9, 1), quote("away", "a", 100, 9, 2), quote("home", "b", -110, 10, 3), quote("away", "b", -110, 12, 4), quote("home", "a", -130, 11, 5)]
    after = [quote("home", "a", 900, 13, 6), quote("away", "a", -900, 13, 7), quote("home", "c", 400, 14, 8), quote("away", "c", -500, 14, 9)]
    schema = "game_id long, market_type string, player_id string, side string, line double, book string, price int, observed_at timestamp, seq long"
    games = spark.createDataFrame([(7, t(2024, 1, 1, 12)), (8, None)], "game_id long, kickoff_utc timestamp")
    picks = spark.createDataFrame([(1, 7, "h2h", "", "home", 0.0, 105), (2, 8, "h2h", "", "home", 0.0, 105)], "pick_id int, game_id long, market_type string, player_id string, side string, line double, price int")
    bets = spark.createDataFrame([(1, 1, 120), (2, 1, -150), (3, 2, 100), (4, 99, 100)], "bet_id int, pick_id int, price int")

    def closed(rows):
        closing = grading.closing_quotes(spark.createDataFrame(rows, schema), games)
        lines = grading.closing_lines(picks, closing, consensus.fair_prices(closing, method="multiplicative"))
        own = grading.user_closing_value(bets, lines).collect()
        return {r.pick_id: r for r in lines.collect()}, {r.bet_id: r.clv_pct for r in own}

    lines, own = closed(before + after)
    assert (lines, own) == closed(before)
    # At noon: a -130 / +100, b -110 / -110; fair home is the lower of 0.5306 and 0.5.
    assert lines[1].closing_price == -110 and lines[1].closing_books == 2 and lines[1].closing_prob == pytest.approx(0.5)
    assert own[1] == pytest.approx(0.5 * (2.2 - (1 + 100 / 110)) * 100) and own[2] == pytest.approx(0.5 * (1 + 100 / 150 - 1 - 100 / 110) * 100)
    assert own[3] is None and own[4] is None and lines[2].closing_price is None and lines[2].clv_pct is None


def _field(spark, markets):
    rows = [(k, [float(p) for p in ps]) for k, ps in enumerate(markets)]
    return spark.createDataFrame(rows, "k int, ps array<double>")


def test_margin_of_any_number_of_outcomes(spark):
    import random

    rng = random.Random(11)
    markets = [[0.5, 0.3, 0.25], [0.9, 0.08, 0.05, 0.01], [0.3, 0.3, 0.3], [0.7], [0.55, 0.52], [0.99, 0.99], [0.2, 0.2, 0.2]]
    for _ in range(200):
        raw = [rng.random() ** 3 + 0.002 for _ in range(rng.randint(2, 12))]
        markets.append([min(0.97, x / sum(raw) * rng.uniform(0.93, 1.3)) for x in raw])
    for method in odds.METHODS_N:
        for r in _field(spark, markets).select("ps", odds.devig_n(F.col("ps"), method).alias("d")).collect():
            got, ps = r.d.probs, r.ps
            assert sum(got) == pytest.approx(1.0, abs=1e-12) and all(x > 0 for x in got)
            assert all((a - b) * (x - y) >= -1e-15 for a, x in zip(ps, got, strict=True) for b, y in zip(ps, got, strict=True))  # order kept
            if method == "power" and len(ps) > 1:
                import math

                k = math.log(got[0]) / math.log(ps[0])
                assert all(p**k == pytest.approx(x, rel=1e-9) for p, x in zip(ps, got, strict=True))
            if method == "additive":
                assert r.d.method_used == ("additive" if min(p - (sum(ps) - 1) / len(ps) for p in ps) > 0 else "multiplicative")
            if method == "shin" and r.d.method_used == "shin":
                # One share of insiders explains every price.
                s = sum(ps)
                z = [(p * p / s - x * x) / (x - x * x) for p, x in zip(ps, got, strict=True)]
                assert max(z) - min(z) < 1e-9 and 0 <= z[0] <= 0.99
    two = {r.k: r for r in _field(spark, [[0.55, 0.52], [0.45, 0.5]]).select("k", *[odds.devig_n(F.col("ps"), m).alias(m) for m in odds.METHODS_N], odds.power(F.col("ps")[0], F.col("ps")[1]).alias("pair")).collect()}
    assert two[0].shin.probs == pytest.approx(two[0].additive.probs) and two[0].power.probs[0] == pytest.approx(two[0].pair)
    assert two[1].shin.method_used == "power" and two[1].shin.probs == pytest.approx(two[1].power.probs)


def test_margin_of_broken_markets(spark):
    rows = _field(spark, [[0.5, 1.2], [0.0, 0.5], []]).unionByName(spark.createDataFrame([(9, None), (10, [0.4, None])], "k int, ps array<double>"))
    assert all(r.d is None for m in odds.METHODS_N for r in rows.select(odds.devig_n(F.col("ps"), m).alias("d")).collect())


def test_three_way_prices_count_the_draw(spark):
    q = lambda book, side, price: (1, "h2h_3_way", "", side, 0.0, book, price)
    rows = [q("pinnacle", "home", 120), q("pinnacle", "draw", 250), q("pinnacle", "away", 200), q("b", "home", 110), q("b", "draw", 240), q("b", "away", 210), q("c", "home", -200), q("c", "away", 150)]
    df = spark.createDataFrame(rows, "game_id long, market_type string, player_id string, side string, line double, book string, price int")
    got = {r.side: r for r in consensus.field_prices(df, method="multiplicative").collect()}
    assert sorted(got) == ["away", "draw", "home"] and {r.book_count for r in got.values()} == {2} and {r.n_sides for r in got.values()} == {3}
    assert sum(r.fair_prob for r in got.values()) == pytest.approx(1.0)
    raw = [100 / 220, 100 / 350, 100 / 300]
    assert got["home"].sharp_prob == pytest.approx(raw[0] / sum(raw))


def test_fields_across_batches(spark):
    """Markets that lie across Arrow batches are whole; a book with a missing, repeated or broken outcome is told apart."""
    rows = [(m, f"b{b}", f"s{s}", 150 + 10 * s + m % 90 + b) for m in range(300) for b in range(3) for s in range(3)]
    rows += [(m, "short", f"s{s}", 200) for m in range(300) for s in range(2)] + [(7, "twice", s, 200) for s in ("s0", "s1", "s2", "s2")] + [(8, "broken", f"s{s}", 0 if s else 200) for s in range(3)]
    df = spark.createDataFrame(rows, "m long, book string, side string, price int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = consensus.fair_fields(df, ["m"], ["power", "shin"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {(r.m, r.book, r.side) for r in got} == {(m, f"b{b}", f"s{s}") for m in range(300) for b in range(3) for s in range(3)} | {(8, "broken", f"s{s}") for s in range(3)}
    assert len(got) == 2703 and all(r.n_sides == 3 for r in got) and all((r.power is None) == (r.shin_used is None) == (r.book == "broken") for r in got)
    sums = {}
    for r in got:
        sums[r.m, r.book] = sums.get((r.m, r.book), 0.0) + (r.power or 0.0)
    assert all(v == pytest.approx(0.0 if b == "broken" else 1.0) for (_, b), v in sums.items())


def test_quotes_and_shuffles_are_made_once(spark, small, monkeypatch):
    """What several steps read is written once, not worked out anew for each."""
    from linework.operators import grading, quotes
    from linework.plans import market

    made = []
    for module, name in ((quotes, "current_quotes"), (grading, "closing_quotes")):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _own=own, _name=name: made.append(_name) or _own(*a))
    for query in (market.market_funnel, market.edge_curve, market.edge_summary):
        made.clear()
        assert query(spark, small).count() and made == ["current_quotes"]
    plan = market.closing_lines(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # the quotes are read from the written table


def test_funnel_is_of_games_ahead_down_to_picks(spark, monkeypatch):
    """Every stage is of the same games; one-sided, broken, rejected and withdrawn ones are beside; a kind with nothing ahead has zeros."""
    from linework.plans import market

    def q(game, kind, side, book, price, day=1, line=0.0):
        return (game, kind, "", side, line, f"book{book}", price, f"2001-06-0{day} 00:00:00", len(seen))

    seen = []
    for game in (1, 2):  # the second has begun; its own totals are all there is of them
        seen += [q(game, kind, side, b, -110) for kind, sides in (("h2h", ("home", "away")), ("totals", ("over", "under"))) if kind == "h2h" or game == 2 for b in (1, 2, 4, 5) for side in sides]
        seen += [q(game, "h2h", "home", 7, 125, 3 * game)] + [q(game, "h2h", side, 9, -10000) for side in ("home", "away")]
    seen += [q(4, "h2h", side, b, 300 if (b, side) == (1, "home") else -110) for b in (1, 2, 4, 5) for side in ("home", "away")]
    seen += [q(3, "spreads", "home", 1, -110, line=-3.0)]
    games = [(1, "2001-09-01 00:00:00"), (2, "2001-07-01 00:00:00"), (3, None), (4, "2001-09-02 00:00:00")]
    picked = [(1, "h2h", 1), (1, "h2h", 0), (2, "h2h", 1), (2, "totals", 1), (3, "spreads", 1)]
    frames = {
        "fx_quote_obs": spark.createDataFrame(seen, "game_id long, market_type string, player_id string, side string, line double, book string, price int, observed_at string, seq long").withColumn("observed_at", F.col("observed_at").cast("timestamp")),
        "fx_games": spark.createDataFrame(games, "game_id long, kickoff_utc string").withColumn("kickoff_utc", F.col("kickoff_utc").cast("timestamp")),
        "fx_picks": spark.createDataFrame(picked, "game_id long, market_type string, published int"),
    }
    monkeypatch.setattr(market, "view", lambda _spark, _d, name: frames[name])
    rows = market.market_funnel(spark, "").collect()
    got = {(r.market_type, r.stage): (r.n, r.beside) for r in rows}
    curve = [f"6 edge {c:g}" for c in shop.CURVE]
    stages = ["0 games", "1 quotes", "2 pairs", "3 plausible", "4 fair", "5 bettable", *curve, "7 opportunities", "8 picks"]
    assert sorted(got) == sorted((kind, stage) for kind in ("h2h", "spreads", "totals") for stage in stages) and len(rows) == len(got)
    assert [got["h2h", s] for s in stages] == [(3, None), (19, None), (9, 1), (8, 1), (4, None), (3, 1), *[(1, None)] * len(curve), (1, None), (1, 1)]
    assert [got["spreads", s] for s in stages] == [(3, None), (1, None), (0, 1), (0, 0), (0, None), (0, 0), *[(0, None)] * len(curve), (0, None), (1, 0)]
    assert [got["totals", s] for s in stages] == [(3, None), (0, None), (0, 0), (0, 0), (0, None), (0, 0), *[(0, None)] * len(curve), (0, None), (0, 0)]
    assert sorted((r.market_type, r.stage) for r in rows if r.first_zero) == [("spreads", "2 pairs"), ("totals", "1 quotes")]
    assert {(r.market_type, r.stage): (r.books, r.median_books) for r in rows if r.books} == {("h2h", "1 quotes"): (6, None), ("spreads", "1 quotes"): (1, None), ("h2h", "4 fair"): (4, 4), ("h2h", "5 bettable"): (4, 4)}
    assert {(r.market_type, r.latest) for r in rows if r.latest} == {("h2h", "2001-06-03 00:00:00"), ("spreads", "2001-06-01 00:00:00")}


def test_median_of_books_is_that_of_the_rank(spark):
    counts = {"a": [7, 5, 5, 3], "b": [9, 2], "c": [4]}
    sides = spark.createDataFrame([(k, b, v.count(b)) for k, v in counts.items() for b in {*v, 1}], "market_type string, book_count long, n long")
    got = {r.market_type: (r.x_books, r.x_middle) for r in shop._by_books(sides, "x").collect()}
    assert got == {k: (max(v), sorted(v, reverse=True)[len(v) // 2]) for k, v in counts.items()}
