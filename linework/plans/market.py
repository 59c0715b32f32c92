"""Registered queries of the market operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds
from ..functions.stats import half_up
from ..operators import consensus, grading, picks, quotes, shop
from ..sources.cuts import written
from ..sources.fixtures import view, with_views

AS_OF = "2001-08-01 00:00:00"
SHARP = ("book3",)
BETTABLE = tuple(f"book{i}" for i in range(1, 23, 2))
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


def r(column: str | Column, digits: int = 6) -> Column:
    name = column if isinstance(column, str) else None
    out = F.round(column, digits)
    return out.alias(name) if name else out


# ---- SQL pieces that the twins share ------------------------------------------------------------

CURRENT = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, market_type, player_id, side, line, book ORDER BY observed_at DESC, seq DESC) AS rn FROM fx_quote_obs) WHERE rn = 1)"""
IMPLIED = "CASE WHEN {0} > 0 THEN 100.0::DOUBLE / ({0} + 100.0::DOUBLE) ELSE -{0}::DOUBLE / (100.0::DOUBLE - {0}) END"
DECIMAL = "CASE WHEN {0} > 0 THEN 1.0::DOUBLE + {0} / 100.0::DOUBLE ELSE 1.0::DOUBLE - 100.0::DOUBLE / {0} END"
PAIRS = CURRENT + f""",
keyed AS (SELECT *, CASE WHEN market_type = 'h2h' THEN 0.0::DOUBLE WHEN market_type = 'spreads' AND side = 'away' THEN 0.0::DOUBLE - line ELSE line END AS pair_line FROM cur),
two AS (SELECT game_id, market_type, player_id, pair_line, book, max(CASE WHEN side IN ('home', 'over') THEN price END) AS price_a, max(CASE WHEN side IN ('away', 'under') THEN price END) AS price_b,
  max(CASE WHEN side IN ('home', 'over') THEN side END) AS side_a, max(CASE WHEN side IN ('away', 'under') THEN side END) AS side_b FROM keyed GROUP BY ALL),
probs AS (SELECT *, {IMPLIED.format('price_a')} AS prob_a, {IMPLIED.format('price_b')} AS prob_b FROM two WHERE price_a IS NOT NULL AND price_b IS NOT NULL),
pairs AS (SELECT *, (1.0 - 1.0 / (prob_a + prob_b)) * 100.0 AS hold_pct, (1.0 - 1.0 / (prob_a + prob_b)) * 100.0 <= 25.0 AS plausible FROM probs)"""
FAIR = PAIRS + """,
fairs AS (SELECT *, prob_a / (prob_a + prob_b) AS p FROM pairs WHERE plausible),
sides AS (SELECT game_id, market_type, player_id, pair_line, book, side_a AS side, p FROM fairs UNION ALL SELECT game_id, market_type, player_id, pair_line, book, side_b, 1.0 - p FROM fairs),
walked AS (SELECT *, sum(1.0::DOUBLE) OVER (PARTITION BY game_id, market_type, player_id, pair_line, side ORDER BY p, book ROWS UNBOUNDED PRECEDING) AS acc, count(*) OVER (PARTITION BY game_id, market_type, player_id, pair_line, side) AS n FROM sides),
fair AS (SELECT game_id, market_type, player_id, side, CASE WHEN market_type = 'spreads' AND side = 'away' THEN 0.0::DOUBLE - pair_line ELSE pair_line END AS line,
  min(CASE WHEN acc >= n / 2.0 THEN p END) AS fair_prob, avg(CASE WHEN book = 'book3' THEN p END) AS sharp_prob, count(*) AS book_count, coalesce(stddev_pop(p), 0.0) AS dispersion FROM walked GROUP BY game_id, market_type, player_id, pair_line, side)"""
BEST = """,
best AS (SELECT * FROM (SELECT game_id, market_type, player_id, side, line, price AS best_price, book AS best_book, row_number() OVER (PARTITION BY game_id, market_type, player_id, side, line ORDER BY price DESC, book) AS rn FROM cur WHERE CAST(substr(book, 5) AS INT) % 2 = 1) WHERE rn = 1),
counts AS (SELECT game_id, market_type, player_id, line, count(DISTINCT book) AS n FROM cur GROUP BY ALL),
absolute AS (SELECT game_id, market_type, player_id, abs(line) AS main_line, max(n) AS n FROM counts GROUP BY ALL),
mains AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, market_type, player_id ORDER BY n DESC, main_line) AS rn FROM absolute) WHERE rn = 1)"""
OPPS = FAIR + BEST + f""",
priced AS (SELECT f.*, b.best_price, b.best_book, CASE WHEN sharp_prob > 0 THEN sharp_prob ELSE fair_prob END AS anchor_prob, CASE WHEN sharp_prob > 0 THEN 'sharp' ELSE 'consensus' END AS anchor
  FROM fair f JOIN best b USING (game_id, market_type, player_id, side, line) JOIN mains m ON m.game_id = f.game_id AND m.market_type = f.market_type AND m.player_id = f.player_id AND m.main_line = abs(f.line) WHERE f.book_count >= 4),
edged AS (SELECT *, (anchor_prob * ({DECIMAL.format('best_price')}) - 1.0) * 100.0 AS edge_pct FROM priced),
opps AS (SELECT e.*, edge_pct > 25.0 AS rejected FROM edged e LEFT JOIN fx_games g USING (game_id) WHERE edge_pct >= 0.5 AND (g.kickoff_utc IS NULL OR g.kickoff_utc > TIMESTAMP '{AS_OF}'))"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    return quotes.current_quotes(view(spark, d, "fx_quote_obs"))


def _fair(spark: SparkSession, d: str, method: str = "multiplicative") -> DataFrame:
    return consensus.fair_prices(_current(spark, d), sharp=SHARP, method=method)


def _opps(spark: SparkSession, d: str) -> DataFrame:
    return shop.opportunities(_fair(spark, d), _current(spark, d), view(spark, d, "fx_games"), AS_OF, books=BETTABLE, least_edge=0.5, least_books=4)


@query(f"WITH {CURRENT} SELECT game_id, market_type, side, line, book, price, seq FROM cur")
def quotes_current(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("game_id", "market_type", "side", "line", "book", "price", "seq")


CHANGES = "chg AS (SELECT * FROM (SELECT *, lag(price) OVER (PARTITION BY game_id, market_type, player_id, side, line, book ORDER BY observed_at, seq) AS prev_price FROM fx_quote_obs) WHERE prev_price IS NULL OR prev_price <> price)"


@query(f"WITH {CHANGES} SELECT seq, game_id, market_type, side, line, book, price, prev_price FROM chg")
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return quotes.price_changes(view(spark, d, "fx_quote_obs")).select("seq", "game_id", "market_type", "side", "line", "book", "price", "prev_price")


@query(f"WITH {PAIRS} SELECT game_id, market_type, pair_line, book, price_a, price_b, round(hold_pct, 6) AS hold_pct, plausible FROM pairs")
def book_pairs(spark: SparkSession, d: str) -> DataFrame:
    return quotes.priced_pairs(_current(spark, d)).select("game_id", "market_type", "pair_line", "book", "price_a", "price_b", r("hold_pct"), "plausible")


@query(f"""WITH {PAIRS}, bis AS (SELECT *, list_reduce(range(60), lambda s, i: CASE WHEN prob_a ** (2.0 ** ((s[1] + s[2]) / 2.0)) + prob_b ** (2.0 ** ((s[1] + s[2]) / 2.0)) > 1.0 THEN [(s[1] + s[2]) / 2.0, s[2]] ELSE [s[1], (s[1] + s[2]) / 2.0] END, [-7.0::DOUBLE, 7.0::DOUBLE]) AS s FROM pairs)
SELECT game_id, market_type, pair_line, book, round(prob_a / (prob_a + prob_b), 6) AS multiplicative,
  round(CASE WHEN prob_a - (prob_a + prob_b - 1) / 2 > 0 AND prob_b - (prob_a + prob_b - 1) / 2 > 0 THEN prob_a - (prob_a + prob_b - 1) / 2 ELSE prob_a / (prob_a + prob_b) END, 6) AS additive,
  round(prob_a ** (2.0 ** ((s[1] + s[2]) / 2.0)), 6) AS power FROM bis""".replace("list_reduce(range(60)", "list_reduce(list_transform(range(60), lambda i: [i::DOUBLE])"))
def devig_methods(spark: SparkSession, d: str) -> DataFrame:
    pairs = quotes.priced_pairs(_current(spark, d))
    a, b = F.col("prob_a"), F.col("prob_b")
    return pairs.select("game_id", "market_type", "pair_line", "book", r(odds.multiplicative(a, b)).alias("multiplicative"), r(odds.additive(a, b)).alias("additive"), r(odds.power(a, b)).alias("power"))


@query(f"""WITH {PAIRS}, bis AS (SELECT *, list_reduce(list_transform(range(60), lambda i: [i::DOUBLE]), lambda s, i: CASE WHEN prob_a ** (2.0 ** ((s[1] + s[2]) / 2.0)) + prob_b ** (2.0 ** ((s[1] + s[2]) / 2.0)) > 1.0 THEN [(s[1] + s[2]) / 2.0, s[2]] ELSE [s[1], (s[1] + s[2]) / 2.0] END, [-7.0::DOUBLE, 7.0::DOUBLE]) AS s FROM pairs),
m AS (SELECT *, prob_a / (prob_a + prob_b) AS mul, CASE WHEN least(prob_a, prob_b) > (prob_a + prob_b - 1) / 2 THEN prob_a - (prob_a + prob_b - 1) / 2 ELSE prob_a / (prob_a + prob_b) END AS add, prob_a ** (2.0 ** ((s[1] + s[2]) / 2.0)) AS pow FROM bis)
SELECT game_id, market_type, pair_line, book, round(least(mul, add, pow) + 1e-9, 6) AS fair_prob_min, round(greatest(mul, add, pow) - least(mul, add, pow) + 1e-9, 6) AS disagreement FROM m""")
def least_favourable(spark: SparkSession, d: str) -> DataFrame:
    """The least fair probability of the first side under any method, and how far the methods are apart."""
    a, b = F.col("prob_a"), F.col("prob_b")
    rows = quotes.priced_pairs(_current(spark, d)).withColumn("low", odds.fair_prob_min(a, b)).withColumn("high", F.greatest(*[m(a, b) for m in odds.METHODS.values()]))
    return rows.select("game_id", "market_type", "pair_line", "book", F.round(F.col("low") + 1e-9, 6).alias("fair_prob_min"), F.round(F.col("high") - F.col("low") + 1e-9, 6).alias("disagreement"))


@query(f"WITH {FAIR} SELECT game_id, market_type, side, line, round(fair_prob, 6) AS fair_prob, round(sharp_prob, 6) AS sharp_prob, book_count, round(dispersion, 6) AS dispersion FROM fair")
def fair_prices(spark: SparkSession, d: str) -> DataFrame:
    return _fair(spark, d).select("game_id", "market_type", "side", "line", r("fair_prob"), r("sharp_prob"), "book_count", r("dispersion"))


POWER = FAIR.replace("SELECT *, prob_a / (prob_a + prob_b) AS p FROM pairs", """SELECT *, prob_a ** (2.0 ** ((s[1] + s[2]) / 2.0)) AS p FROM (SELECT *, list_reduce(list_transform(range(60), lambda i: [i::DOUBLE]),
  lambda s, i: CASE WHEN prob_a ** (2.0 ** ((s[1] + s[2]) / 2.0)) + prob_b ** (2.0 ** ((s[1] + s[2]) / 2.0)) > 1.0 THEN [(s[1] + s[2]) / 2.0, s[2]] ELSE [s[1], (s[1] + s[2]) / 2.0] END, [-7.0::DOUBLE, 7.0::DOUBLE]) AS s FROM pairs)""")


@query(f"WITH {POWER} SELECT game_id, market_type, side, line, round(fair_prob, 6) AS fair_prob, round(sharp_prob, 6) AS sharp_prob, book_count, round(dispersion, 6) AS dispersion, 'power' AS method_used FROM fair")
def fair_prices_power(spark: SparkSession, d: str) -> DataFrame:
    return _fair(spark, d, "power").select("game_id", "market_type", "side", "line", r("fair_prob"), r("sharp_prob"), "book_count", r("dispersion"), "method_used")


@query(f"WITH {FAIR} SELECT game_id, market_type, side, line, round(sharp_prob - fair_prob, 6) AS delta, book_count FROM fair WHERE abs(sharp_prob - fair_prob) >= 0.005 AND book_count >= 3")
def sharp_soft(spark: SparkSession, d: str) -> DataFrame:
    return consensus.sharp_soft(_fair(spark, d), least_gap=0.005).select("game_id", "market_type", "side", "line", r("delta"), "book_count")


@query(f"WITH {CURRENT}{BEST} SELECT game_id, market_type, main_line, n AS n_books FROM mains")
def main_lines(spark: SparkSession, d: str) -> DataFrame:
    return shop.main_lines(_current(spark, d)).select("game_id", "market_type", "main_line", "n_books")


@query(f"WITH {CURRENT}{BEST} SELECT game_id, market_type, side, line, best_price, best_book FROM best")
def best_prices(spark: SparkSession, d: str) -> DataFrame:
    return shop.best_prices(_current(spark, d), BETTABLE).drop("player_id")


OPP_COLUMNS = ["game_id", "market_type", "side", "line", "best_book", "best_price", "anchor", "book_count", "rejected"]


@query(f"WITH {OPPS} SELECT {', '.join(OPP_COLUMNS)}, round(anchor_prob, 6) AS anchor_prob, round(edge_pct, 6) AS edge_pct FROM opps")
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    return _opps(spark, d).select(*OPP_COLUMNS, r("anchor_prob"), r("edge_pct"))


@query(f"WITH {OPPS} SELECT game_id, market_type, side, line, best_book, round(edge_pct, 6) AS edge_pct FROM opps WHERE NOT rejected ORDER BY opps.edge_pct DESC, game_id, market_type, player_id, side, line LIMIT 25")
def top_opportunities(spark: SparkSession, d: str) -> DataFrame:
    return shop.top(_opps(spark, d).filter("not rejected"), 25).select("game_id", "market_type", "side", "line", "best_book", r("edge_pct"))


@query(f"WITH {CURRENT}, v AS (SELECT *, {DECIMAL.format('price')} AS dec FROM cur) SELECT game_id, market_type, side, line, book, price, round(max(dec) OVER w - dec, 6) AS gap, max(dec) OVER w = dec AS is_best FROM v WINDOW w AS (PARTITION BY game_id, market_type, player_id, side, line)")
def price_ladder(spark: SparkSession, d: str) -> DataFrame:
    return shop.price_ladder(_current(spark, d)).select("game_id", "market_type", "side", "line", "book", "price", r("gap"), "is_best")


@query(f"""WITH {CURRENT}, v AS (SELECT *, {DECIMAL.format('price')} AS dec FROM cur),
g AS (SELECT game_id, market_type, player_id, side, line, max(dec) AS hi, min(dec) AS lo, count(*) AS n FROM v GROUP BY ALL HAVING count(*) > 1)
SELECT book, count(*) AS n_quotes, CAST(sum(CASE WHEN dec = hi THEN 1 ELSE 0 END) AS BIGINT) AS n_best, round(avg((hi / lo - 1.0) * 100.0), 6) AS avg_gain_pct, round(max((hi / lo - 1.0) * 100.0), 6) AS max_gain_pct FROM v JOIN g USING (game_id, market_type, player_id, side, line) GROUP BY book""")
def shopping_value(spark: SparkSession, d: str) -> DataFrame:
    return shop.shopping_value(_current(spark, d)).select("book", "n_quotes", "n_best", r("avg_gain_pct"), r("max_gain_pct"))


@query(f"""WITH {OPPS} SELECT CASE WHEN edge_pct >= 10 THEN 10.0::DOUBLE WHEN edge_pct >= 5 THEN 5.0 WHEN edge_pct >= 2 THEN 2.0 WHEN edge_pct >= 1 THEN 1.0 ELSE 0.0 END AS edge_from, count(*) AS n, CAST(sum(CASE WHEN anchor = 'sharp' THEN 1 ELSE 0 END) AS BIGINT) AS n_sharp, round(avg(edge_pct), 6) AS mean_edge FROM opps GROUP BY 1""")
def edge_distribution(spark: SparkSession, d: str) -> DataFrame:
    return shop.edge_distribution(_opps(spark, d)).select("edge_from", "n", "n_sharp", r("mean_edge"))


#: Every priced market side at its best price, with no bar on edge, books, line or book.
LOOSE = FAIR + f""",
anybest AS (SELECT game_id, market_type, player_id, side, line, max(price) AS best_price FROM cur GROUP BY ALL),
anchors AS (SELECT f.*, best_price, CASE WHEN sharp_prob > 0 THEN sharp_prob ELSE fair_prob END AS anchor_prob, CASE WHEN sharp_prob > 0 THEN 'sharp' ELSE 'consensus' END AS anchor FROM fair f JOIN anybest USING (game_id, market_type, player_id, side, line)),
loose AS (SELECT a.*, (anchor_prob * ({DECIMAL.format('best_price')}) - 1.0) * 100.0 AS edge_pct FROM anchors a LEFT JOIN fx_games g USING (game_id) WHERE g.kickoff_utc IS NULL OR g.kickoff_utc > TIMESTAMP '{AS_OF}')"""


def _loose(spark: SparkSession, d: str, now: DataFrame) -> DataFrame:
    """Of the current quotes ``now``. Written once: its ranking reads it several times."""
    return written(shop.opportunities(consensus.fair_prices(now, sharp=SHARP, method="multiplicative"), now, view(spark, d, "fx_games"), AS_OF, least_edge=-100.0, least_books=1, main_only=False))


@query(f"""WITH {LOOSE}, k AS (SELECT *, row_number() OVER (PARTITION BY market_type ORDER BY edge_pct) AS i, count(*) OVER (PARTITION BY market_type) AS n FROM loose)
SELECT market_type, max(n) AS n, round(max(CASE WHEN i = floor(n * 0.5) + 1 THEN edge_pct END), 6) AS median, round(max(CASE WHEN i = floor(n * 0.9) + 1 THEN edge_pct END), 6) AS p90, round(max(CASE WHEN i = floor(n * 0.99) + 1 THEN edge_pct END), 6) AS p99, round(max(edge_pct), 6) AS max,
  round(avg(CASE WHEN edge_pct > 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS positive_pct, round(avg(CASE WHEN anchor = 'sharp' THEN 100.0::DOUBLE ELSE 0 END), 6) AS sharp_pct FROM k GROUP BY 1""")
def edge_summary(spark: SparkSession, d: str) -> DataFrame:
    return shop.edge_summary(_loose(spark, d, written(_current(spark, d))), "market_type").select("market_type", "n", r("median"), r("p90"), r("p99"), r("max"), r("positive_pct"), r("sharp_pct"))


@query(f"""WITH {LOOSE}, up AS (SELECT two.* FROM two LEFT JOIN fx_games g USING (game_id) WHERE g.kickoff_utc IS NULL OR g.kickoff_utc > TIMESTAMP '{AS_OF}'),
p AS (SELECT market_type, count(*) FILTER (price_a IS NOT NULL AND price_b IS NOT NULL) AS paired, count(*) FILTER (price_a IS NULL OR price_b IS NULL) AS one_sided, round(avg(CASE WHEN price_a IS NOT NULL AND price_b IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS pair_rate FROM up GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY market_type ORDER BY book_count DESC) AS i, count(*) OVER (PARTITION BY market_type) AS n FROM loose),
c AS (SELECT market_type, count(*) AS markets, {', '.join(f'count(*) FILTER (edge_pct >= {c}) AS at_{c:g}' for c in shop.CURVE)}, max(book_count) AS best_books, max(CASE WHEN i = floor(n / 2) + 1 THEN book_count END) AS median_books FROM b GROUP BY 1)
SELECT p.*, c.* EXCLUDE (market_type), {', '.join(f'coalesce(best_books, 0) >= {picks.thresholds("game", t)[1]} AS reach_{t}' for t in 'ABC')} FROM p LEFT JOIN c USING (market_type)""")
def edge_curve(spark: SparkSession, d: str) -> DataFrame:
    now = written(_current(spark, d))
    pairs = shop.upcoming(quotes.pair_quotes(now), view(spark, d, "fx_games"), AS_OF)
    rows = shop.edge_curve(_loose(spark, d, now), pairs, {t: picks.thresholds("game", t)[1] for t in "ABC"}, "market_type")
    return rows.withColumn("pair_rate", F.round("pair_rate", 6))


#: Every stage of the funnel is of games that have not begun; kinds of market with none of them are there with zeros.
AHEAD = f"kickoff_utc IS NULL OR kickoff_utc > TIMESTAMP '{AS_OF}'"
FUNNEL = FAIR + BEST + f""",
begun AS (SELECT game_id FROM fx_games WHERE NOT ({AHEAD})),
kinds AS (SELECT DISTINCT market_type FROM (SELECT market_type FROM fx_quote_obs UNION ALL SELECT market_type FROM fx_picks)),
bettable AS (SELECT *, edge_pct <= 25.0 AS fine FROM (SELECT f.*, (CASE WHEN sharp_prob > 0 THEN sharp_prob ELSE fair_prob END * ({DECIMAL.format('best_price')}) - 1.0) * 100.0 AS edge_pct
  FROM fair f JOIN best b USING (game_id, market_type, player_id, side, line) JOIN mains m ON m.game_id = f.game_id AND m.market_type = f.market_type AND m.player_id = f.player_id AND m.main_line = abs(f.line))),
q AS (SELECT market_type, count(*) AS n, NULL::BIGINT AS beside, count(DISTINCT book) AS books, max(observed_at)::VARCHAR AS latest FROM cur ANTI JOIN begun USING (game_id) GROUP BY 1),
t AS (SELECT market_type, count(*) FILTER (price_a IS NOT NULL AND price_b IS NOT NULL) AS n, count(*) FILTER (price_a IS NULL OR price_b IS NULL) AS beside FROM two ANTI JOIN begun USING (game_id) GROUP BY 1),
h AS (SELECT market_type, count(*) FILTER (plausible) AS n, count(*) FILTER (NOT plausible) AS beside FROM pairs ANTI JOIN begun USING (game_id) GROUP BY 1),
f AS (SELECT market_type, count(*) AS n, max(book_count) AS books, list_sort(list(book_count), 'DESC')[count(*) // 2 + 1] AS median_books FROM fair ANTI JOIN begun USING (game_id) GROUP BY 1),
a AS (SELECT b.* FROM bettable b ANTI JOIN begun USING (game_id)),
l AS (SELECT market_type, count(*) AS n, max(book_count) AS books, list_sort(list(book_count), 'DESC')[count(*) // 2 + 1] AS median_books FROM a WHERE fine GROUP BY 1),
p AS (SELECT market_type, count(*) FILTER (published = 1) AS n, count(*) FILTER (published <> 1) AS beside FROM fx_picks ANTI JOIN begun USING (game_id) GROUP BY 1),
stages AS (SELECT '0 games' AS stage, market_type, (SELECT count(*) FROM fx_games WHERE {AHEAD}) AS n, NULL::BIGINT AS beside, NULL::BIGINT AS books, NULL::BIGINT AS median_books, NULL::VARCHAR AS latest FROM kinds
UNION ALL SELECT '1 quotes', market_type, coalesce(n, 0), NULL, coalesce(books, 0), NULL, latest FROM kinds LEFT JOIN q USING (market_type)
UNION ALL SELECT '2 pairs', market_type, coalesce(n, 0), coalesce(beside, 0), NULL, NULL, NULL FROM kinds LEFT JOIN t USING (market_type)
UNION ALL SELECT '3 plausible', market_type, coalesce(n, 0), coalesce(beside, 0), NULL, NULL, NULL FROM kinds LEFT JOIN h USING (market_type)
UNION ALL SELECT '4 fair', market_type, coalesce(n, 0), NULL, coalesce(books, 0), coalesce(median_books, 0), NULL FROM kinds LEFT JOIN f USING (market_type)
UNION ALL SELECT '5 bettable', market_type, coalesce(n, 0), (SELECT count(*) FROM a WHERE NOT fine AND a.market_type = kinds.market_type), coalesce(books, 0), coalesce(median_books, 0), NULL FROM kinds LEFT JOIN l USING (market_type)
{' '.join(f"UNION ALL SELECT '6 edge {c:g}', market_type, (SELECT count(*) FROM a WHERE fine AND edge_pct >= {c} AND a.market_type = kinds.market_type), NULL, NULL, NULL, NULL FROM kinds" for c in shop.CURVE)}
UNION ALL SELECT '7 opportunities', market_type, (SELECT count(*) FROM a WHERE fine AND edge_pct >= 0.5 AND book_count >= 4 AND a.market_type = kinds.market_type), NULL, NULL, NULL, NULL FROM kinds
UNION ALL SELECT '8 picks', market_type, coalesce(n, 0), coalesce(beside, 0), NULL, NULL, NULL FROM kinds LEFT JOIN p USING (market_type))"""


@query(f"WITH {FUNNEL} SELECT *, coalesce(stage = min(CASE WHEN n = 0 AND NOT starts_with(stage, '6') THEN stage END) OVER (PARTITION BY market_type), false) AS first_zero FROM stages")
def market_funnel(spark: SparkSession, d: str) -> DataFrame:
    observed, picked = view(spark, d, "fx_quote_obs"), view(spark, d, "fx_picks")
    games = written(view(spark, d, "fx_games").select("game_id", "kickoff_utc"))
    now = written(shop.upcoming(quotes.current_quotes(observed), games, AS_OF).drop("kickoff_utc"))  # each stage of the funnel starts from these
    fair = written(consensus.fair_prices(now, sharp=SHARP, method="multiplicative"))
    bettable = shop.opportunities(fair, now, games, AS_OF, books=BETTABLE, least_edge=-100.0, least_books=1)
    kinds = observed.select("market_type").union(picked.select("market_type"))
    pairs = quotes.with_hold(quotes.pair_quotes(now))
    rows = shop.funnel(kinds, games.filter(shop.not_begun(AS_OF)), now, pairs, fair, bettable, shop.upcoming(picked, games, AS_OF), least_edge=0.5, least_books=4)
    return rows.withColumn("latest", F.col("latest").cast("string"))


@query(f"""WITH {CHANGES}, b AS (SELECT game_id, market_type, player_id, side, book, arg_min(line, observed_at::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS first_line, arg_max(line, observed_at::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS last_line, count(*) AS n_changes FROM chg GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY game_id, market_type, player_id, side ORDER BY n_changes DESC, book) AS rn FROM b)
SELECT game_id, market_type, side, book, first_line, last_line, n_changes, last_line - first_line AS move,
 CASE WHEN (CASE WHEN side = 'under' THEN first_line - last_line ELSE last_line - first_line END) > 0 THEN 'up' WHEN (CASE WHEN side = 'under' THEN first_line - last_line ELSE last_line - first_line END) < 0 THEN 'down' ELSE 'none' END AS direction FROM m WHERE rn = 1""")
def net_move(spark: SparkSession, d: str) -> DataFrame:
    return quotes.net_move(quotes.price_changes(view(spark, d, "fx_quote_obs"))).select("game_id", "market_type", "side", "book", "first_line", "last_line", "n_changes", "move", "direction")


@query(f"WITH {CHANGES}, x AS (SELECT *, row_number() OVER (PARTITION BY game_id, market_type, player_id ORDER BY observed_at DESC, seq DESC) AS back FROM chg) SELECT game_id, market_type, seq, price, row_number() OVER (PARTITION BY game_id, market_type, player_id ORDER BY observed_at, seq) AS position FROM x WHERE back <= 6")
def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    return quotes.recent_changes(quotes.price_changes(view(spark, d, "fx_quote_obs"))).select("game_id", "market_type", "seq", "price", F.col("position").cast("long"))


@query(f"""WITH {CHANGES}, f AS (SELECT game_id, market_type, player_id, side, line, book, min(observed_at) AS t FROM chg GROUP BY ALL), l AS (SELECT game_id, market_type, player_id, side, line, min(t) AS lead_at FROM f GROUP BY ALL)
SELECT book, count(*) AS n_markets, CAST(sum(CASE WHEN t = lead_at THEN 1 ELSE 0 END) AS BIGINT) AS n_first, round(avg(date_diff('second', lead_at, t)), 3) AS mean_lag_s FROM f JOIN l USING (game_id, market_type, player_id, side, line) GROUP BY book""")
def book_latency(spark: SparkSession, d: str) -> DataFrame:
    return quotes.book_latency(quotes.price_changes(view(spark, d, "fx_quote_obs"))).select("book", "n_markets", "n_first", r("mean_lag_s", 3))


TIERED = OPPS + """,
tiered AS (SELECT *, CASE WHEN dispersion > 0.15 THEN NULL WHEN edge_pct >= 5.0 AND book_count >= 15 AND dispersion <= 0.03 AND anchor = 'sharp' THEN 'A' WHEN edge_pct >= 3.0 AND book_count >= 10 AND dispersion <= 0.05 THEN 'B' WHEN edge_pct >= 2.0 AND book_count >= 8 AND dispersion <= 1.0 THEN 'C' END AS tier FROM opps WHERE NOT rejected)"""


@query(f"WITH {TIERED} SELECT game_id, market_type, side, line, round(edge_pct, 6) AS edge_pct, 'game' AS bet_class, tier, CASE WHEN tier = 'C' THEN 'premium' ELSE 'all' END AS visibility FROM tiered")
def tiered_picks(spark: SparkSession, d: str) -> DataFrame:
    tiered = picks.assign_tier(_opps(spark, d).filter("not rejected"))
    return tiered.select("game_id", "market_type", "side", "line", r("edge_pct"), "bet_class", "tier", picks.visibility(F.col("tier"), F.lit("market")).alias("visibility"))


STAKED = f"""staked AS (SELECT *, CASE WHEN (fair_prob * dec - 1.0) / (dec - 1.0) > 0 THEN least((fair_prob * dec - 1.0) / (dec - 1.0) * 0.25, 0.02) ELSE 0.0 END AS raw FROM (SELECT *, {DECIMAL.format('price')} AS dec FROM fx_picks)),
g AS (SELECT game_id, sum(raw) AS total FROM staked GROUP BY 1), s AS (SELECT sum(least(total, 0.04)) AS slate FROM g)"""


@query(f"WITH {STAKED} SELECT pick_id, round(raw * CASE WHEN total > 0.04 THEN 0.04 / total ELSE 1.0 END * CASE WHEN slate > 0.25 THEN 0.25 / slate ELSE 1.0 END, 9) AS stake FROM staked JOIN g USING (game_id), s")
def exposure_caps(spark: SparkSession, d: str) -> DataFrame:
    sized = view(spark, d, "fx_picks").withColumn("stake", odds.stake(F.col("fair_prob"), F.col("price")))
    return picks.exposure_caps(sized).select("pick_id", r("stake", 9))


@query(f"WITH {OPPS} SELECT game_id, market_type, side, line, round(edge_pct, 6) AS edge_pct FROM opps o WHERE NOT rejected AND NOT EXISTS (SELECT 1 FROM fx_picks p WHERE p.game_id = o.game_id AND p.market_type = o.market_type AND p.side = o.side AND p.line = o.line AND p.published = 1 AND p.tier = 'A')")
def new_picks(spark: SparkSession, d: str) -> DataFrame:
    pending = view(spark, d, "fx_picks").filter("published = 1 and tier = 'A'").withColumn("player_id", F.lit(""))
    return picks.new_picks(_opps(spark, d).filter("not rejected"), pending).select("game_id", "market_type", "side", "line", r("edge_pct"))


@query(f"""WITH {FAIR}{BEST}, now AS (SELECT f.game_id, f.market_type, f.side, f.line, b.best_price AS new_price, (CASE WHEN sharp_prob > 0 THEN sharp_prob ELSE fair_prob END * ({DECIMAL.format('b.best_price')}) - 1.0) * 100.0 AS new_edge, f.book_count, f.dispersion FROM fair f JOIN best b USING (game_id, market_type, player_id, side, line))
SELECT pick_id, new_price, round(new_edge, 6) AS new_edge, published = 1 AND (new_price IS NULL OR (new_edge >= 2.0 AND new_edge <= 25.0 AND book_count >= 8 AND dispersion <= 0.15)) AS still_published FROM fx_picks p LEFT JOIN now n ON n.game_id = p.game_id AND n.market_type = p.market_type AND n.side = p.side AND n.line = p.line""")
def repriced_picks(spark: SparkSession, d: str) -> DataFrame:
    pending = view(spark, d, "fx_picks").withColumn("player_id", F.lit("")).withColumn("published", F.col("published") == 1)
    return picks.reprice(pending, shop.best_prices(_current(spark, d), BETTABLE), _fair(spark, d)).select("pick_id", "new_price", r("new_edge"), "still_published")


@query(f"SELECT pick_id, tier, round(edge_pct, 6) AS edge_pct FROM fx_picks p LEFT JOIN fx_games g USING (game_id) WHERE published = 1 AND (kickoff_utc IS NULL OR kickoff_utc > TIMESTAMP '{AS_OF}')")
def current_slate(spark: SparkSession, d: str) -> DataFrame:
    return picks.current_slate(view(spark, d, "fx_picks"), view(spark, d, "fx_games"), AS_OF).select("pick_id", "tier", r("edge_pct"))


GRADED = f"""gap AS (SELECT p.*, home_score, away_score, CASE WHEN market_type = 'h2h' THEN (CASE WHEN side = 'home' THEN 1 ELSE -1 END) * (home_score - away_score) WHEN market_type = 'spreads' THEN (CASE WHEN side = 'home' THEN 1 ELSE -1 END) * (home_score - away_score) + line ELSE (CASE WHEN side = 'over' THEN 1 ELSE -1 END) * (home_score + away_score - line) END AS x FROM fx_picks p JOIN fx_games USING (game_id)),
graded AS (SELECT *, CASE WHEN abs(x) < 1e-9 THEN 'push' WHEN x > 0 THEN 'win' ELSE 'loss' END AS result, CASE WHEN abs(x) < 1e-9 THEN 0.0 WHEN x > 0 THEN stake * (({DECIMAL.format('price')}) - 1.0) ELSE -stake END AS profit FROM gap)"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return grading.grade_picks(view(spark, d, "fx_picks"), view(spark, d, "fx_games"))


@query(f"WITH {GRADED} SELECT pick_id, result, round(profit, 6) AS profit FROM graded")
def graded_picks(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("pick_id", "result", r("profit"))


PERFORMANCE = """count(*) AS picks, count(*) AS settled, CAST(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN result = 'loss' THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN result = 'push' THEN 1 ELSE 0 END) AS BIGINT) AS pushes, round(sum(stake), 4) AS staked, round(sum(profit), 4) AS profit, sum(CASE WHEN result <> 'push' THEN 1.0::DOUBLE ELSE 0 END) AS n, sum(CASE WHEN result = 'win' THEN 1.0::DOUBLE ELSE 0 END) AS w, 100.0 * sum(profit) / sum(stake) AS roi"""
RECORD = "picks, settled, wins, losses, pushes, staked, profit, round(w / n, 6) AS win_rate, round((w / n + 1.96 ** 2 / (2 * n) - 1.96 * sqrt(w / n * (1 - w / n) / n + 1.96 ** 2 / (4 * n * n))) / (1 + 1.96 ** 2 / n), 6) AS win_low, round((w / n + 1.96 ** 2 / (2 * n) + 1.96 * sqrt(w / n * (1 - w / n) / n + 1.96 ** 2 / (4 * n * n))) / (1 + 1.96 ** 2 / n), 6) AS win_high, round(roi, 4) AS roi_pct"


def _record(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "picks", "settled", "wins", "losses", "pushes", r("staked", 4), r("profit", 4), r("win_rate"), r("win_low"), r("win_high"), r("roi_pct", 4))


@query(f"WITH {GRADED}, t AS (SELECT tier, {PERFORMANCE} FROM graded WHERE demo = 0 GROUP BY tier) SELECT tier, {RECORD} FROM t")
def performance_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return _record(grading.performance(_graded(spark, d).filter("demo = 0"), "tier"), "tier")


@query(f"WITH {GRADED}, named AS (" + " UNION ALL ".join(f"SELECT '{name}' AS filter, * FROM graded WHERE {cond}" for name, cond in grading.FILTERS.items()) + f"), t AS (SELECT filter, {PERFORMANCE} FROM named GROUP BY filter) SELECT filter, {RECORD} FROM t")
def performance_by_filter(spark: SparkSession, d: str) -> DataFrame:
    return _record(grading.performance_by_filter(_graded(spark, d)), "filter")


#: The state of every quote key at its own game's kickoff; price and consensus of the close are both made of it.
AT_KICKOFF = """
cur AS (SELECT q.* FROM fx_quote_obs q JOIN fx_games g ON g.game_id = q.game_id WHERE q.observed_at <= g.kickoff_utc
  AND NOT EXISTS (SELECT 1 FROM fx_quote_obs l WHERE l.game_id = q.game_id AND l.market_type = q.market_type AND l.player_id = q.player_id AND l.side = q.side AND l.line = q.line AND l.book = q.book AND l.observed_at <= g.kickoff_utc AND (l.observed_at > q.observed_at OR (l.observed_at = q.observed_at AND l.seq > q.seq))))"""
CLOSED = FAIR.replace(CURRENT, AT_KICKOFF) + f""",
c AS (SELECT game_id, market_type, side, line, max(price) AS closing_price, count(*) AS closing_books FROM cur WHERE player_id = '' GROUP BY ALL),
cp AS (SELECT game_id, market_type, side, line, CASE WHEN sharp_prob > 0 THEN sharp_prob ELSE fair_prob END AS closing_prob FROM fair WHERE player_id = ''),
closed AS (SELECT p.*, closing_price, closing_books, closing_prob, closing_prob * (({DECIMAL.format('price')}) - ({DECIMAL.format('closing_price')})) * 100.0 AS clv_pct FROM fx_picks p LEFT JOIN c USING (game_id, market_type, side, line) LEFT JOIN cp USING (game_id, market_type, side, line)),
clv AS (SELECT * FROM closed WHERE clv_pct IS NOT NULL)"""


def _closed(spark: SparkSession, d: str) -> DataFrame:
    own = view(spark, d, "fx_picks").withColumn("player_id", F.lit(""))
    closing = written(grading.closing_quotes(view(spark, d, "fx_quote_obs"), view(spark, d, "fx_games")))  # price and consensus both read it
    return grading.closing_lines(own, closing, consensus.fair_prices(closing, sharp=SHARP, method="multiplicative"))


@query(f"WITH {CLOSED} SELECT pick_id, closing_price, closing_books, round(closing_prob, 6) AS closing_prob, round(clv_pct, 6) AS clv_pct FROM closed")
def closing_lines(spark: SparkSession, d: str) -> DataFrame:
    return _closed(spark, d).select("pick_id", "closing_price", "closing_books", r("closing_prob"), r("clv_pct"))


@query(f"WITH {GRADED} SELECT CAST((kickoff_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day, CASE result WHEN 'win' THEN 'winning' WHEN 'loss' THEN 'losing' ELSE 'level' END AS standing, count(*) AS bets, round(sum(stake), 4) AS units FROM graded JOIN (SELECT game_id, kickoff_utc FROM fx_games) k USING (game_id) GROUP BY ALL")
def open_exposure(spark: SparkSession, d: str) -> DataFrame:
    live = view(spark, d, "fx_games").select("game_id", "kickoff_utc", "home_score", "away_score")
    return grading.open_exposure(view(spark, d, "fx_picks"), live).select("day", "standing", "bets", r("units", 4))


@query(f"WITH {GRADED} SELECT result, count(*) AS n FROM graded GROUP BY result")
def grade_counts(spark: SparkSession, d: str) -> DataFrame:
    return grading.grade_counts(_graded(spark, d))


@query(f"WITH {CURRENT}, {CHANGES} SELECT seq, game_id, market_type, side, book FROM chg c WHERE EXISTS (SELECT 1 FROM cur u WHERE u.game_id = c.game_id AND u.market_type = c.market_type AND u.book = c.book AND u.observed_at >= TIMESTAMP '1998-07-01')")
def active_moves(spark: SparkSession, d: str) -> DataFrame:
    now = _current(spark, d).filter("observed_at >= timestamp '1998-07-01'")
    return quotes.active_moves(quotes.price_changes(view(spark, d, "fx_quote_obs")), now).select("seq", "game_id", "market_type", "side", "book")


@query(f"WITH {CLOSED} SELECT tier, market_type, count(*) AS n, round(avg(clv_pct), 6) AS avg_clv_pct, round(avg(CASE WHEN clv_pct > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS beat_close FROM clv GROUP BY ALL")
def closing_value(spark: SparkSession, d: str) -> DataFrame:
    return grading.closing_value_by(_closed(spark, d), "tier", "market_type").select("tier", "market_type", "n", r("avg_clv_pct"), r("beat_close"))


@query(f"WITH {CLOSED}, v AS (SELECT market_type, count(*) AS n, avg(clv_pct) AS a FROM clv GROUP BY 1), w AS (SELECT DISTINCT market_type, 0.1::DOUBLE AS weight FROM fx_picks) SELECT market_type, round(greatest(0.0, least(0.6, CASE WHEN coalesce(n, 0) < 30 THEN weight WHEN a > 0 THEN weight + 0.02 ELSE weight - 0.04 END)), 6) AS weight, coalesce(n, 0) AS n FROM w LEFT JOIN v USING (market_type)")
def next_blend_weight(spark: SparkSession, d: str) -> DataFrame:
    weights = view(spark, d, "fx_picks").select("market_type").distinct().withColumn("weight", F.lit(0.1))
    return grading.next_blend_weight(_closed(spark, d), weights).select("market_type", r("weight"), "n")


@query(f"WITH {CLOSED} SELECT bet_id, b.user_id, pick_id, closing_price, round(closing_prob * (({DECIMAL.format('b.price')}) - ({DECIMAL.format('closing_price')})) * 100.0, 6) AS clv_pct FROM fx_bets b LEFT JOIN closed USING (pick_id)")
def user_closing_value(spark: SparkSession, d: str) -> DataFrame:
    return grading.user_closing_value(view(spark, d, "fx_bets"), _closed(spark, d)).select("bet_id", "user_id", "pick_id", "closing_price", r("clv_pct"))


@query(f"""WITH {CLOSED}, {GRADED}, t AS (SELECT market_type, tier, {PERFORMANCE} FROM graded GROUP BY ALL), v AS (SELECT market_type, tier, count(*) AS n_closed, avg(clv_pct) AS a, avg(CASE WHEN clv_pct > 0 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM clv GROUP BY ALL),
s AS (SELECT g.market_type, g.tier, count(*) AS n_bets, avg((({DECIMAL.format('g.price')}) - ({DECIMAL.format('b.price')})) * 100.0) AS slip FROM fx_bets b JOIN graded g USING (pick_id) GROUP BY ALL)
SELECT market_type, tier, {RECORD}, n_closed, round(a, 6) AS avg_clv_pct, round(b, 6) AS beat_close, n_bets, round(slip, 6) AS slippage_pct FROM t LEFT JOIN v USING (market_type, tier) LEFT JOIN s USING (market_type, tier)""")
def track_record(spark: SparkSession, d: str) -> DataFrame:
    rows = grading.track_record(_graded(spark, d), _closed(spark, d), view(spark, d, "fx_bets"), "market_type", "tier")
    record = ["picks", "settled", "wins", "losses", "pushes", r("staked", 4), r("profit", 4), r("win_rate"), r("win_low"), r("win_high"), r("roi_pct", 4)]
    return rows.select("market_type", "tier", *record, "n_closed", r("avg_clv_pct"), r("beat_close"), "n_bets", r("slippage_pct"))


FIELDS = f"""q AS (SELECT market_id, book, list(side ORDER BY side) AS names, list({IMPLIED.format('price')} ORDER BY side) AS ps FROM fx_fields GROUP BY ALL HAVING count(*) = count(DISTINCT side)),
e AS (SELECT market_id, list_sort(list_distinct(flatten(list(names)))) AS every FROM q GROUP BY ALL),
w AS (SELECT q.*, list_sum(ps) AS t FROM q JOIN e USING (market_id) WHERE names = every)"""
#: Roots by sixty halvings.
HALVED = """list_reduce(list_transform(range(60), lambda i: [i::DOUBLE]), lambda s, i: CASE WHEN {above} THEN [(s[1] + s[2]) / 2.0, s[2]] ELSE [s[1], (s[1] + s[2]) / 2.0] END, [{lo}::DOUBLE, {hi}::DOUBLE])"""
EXPONENT = HALVED.format(above="list_sum(list_transform(ps, lambda p: p ** ((s[1] + s[2]) / 2.0))) > 1.0", lo="0", hi="128")
INSIDERS = HALVED.format(above="list_sum(list_transform(ps, lambda p: (sqrt(((s[1] + s[2]) / 2.0) ** 2 + 4.0 * (1.0 - (s[1] + s[2]) / 2.0) * p * p / t) - (s[1] + s[2]) / 2.0) / (2.0 * (1.0 - (s[1] + s[2]) / 2.0)))) > 1.0", lo="0", hi="0.99")
FIELD_METHODS = FIELDS + f""",
k AS (SELECT *, list_extract({EXPONENT}, 1) AS k, list_extract({INSIDERS}, 1) AS z, list_sum(list_transform(ps, lambda p: (sqrt(0.9801::DOUBLE + 0.04::DOUBLE * p * p / t) - 0.99::DOUBLE) / 0.02::DOUBLE)) <= 1.0 AND t > 1.0 AS fits FROM w),
m AS (SELECT market_id, book, names, list_transform(ps, lambda p: p / t) AS mul, CASE WHEN list_min(ps) > (t - 1.0) / len(ps) THEN list_transform(ps, lambda p: p - (t - 1.0) / len(ps)) ELSE list_transform(ps, lambda p: p / t) END AS add, CASE WHEN len(ps) = 1 THEN [1.0::DOUBLE] ELSE list_transform(ps, lambda p: p ** k) END AS pow, list_transform(ps, lambda p: (sqrt(z * z + 4.0 * (1.0 - z) * p * p / t) - z) / (2.0 * (1.0 - z))) AS shi, fits FROM k)"""


@query(f"WITH {FIELD_METHODS} SELECT market_id, book, unnest(names) AS side, round(unnest(mul) + 1e-9, 6) AS multiplicative, round(unnest(add) + 1e-9, 6) AS additive, round(unnest(pow) + 1e-9, 6) AS power, round(unnest(CASE WHEN fits THEN shi ELSE pow END) + 1e-9, 6) AS shin, CASE WHEN fits THEN 'shin' ELSE 'power' END AS method_used FROM m")
def field_methods(spark: SparkSession, d: str) -> DataFrame:
    """All methods over the whole fields of books, with the name of what stood in for Shin's.

    Two outcomes often give exact halves of the last digit; a billionth more keeps both engines off them.
    """
    rows = consensus.fair_fields(view(spark, d, "fx_fields"), ["market_id"], list(odds.METHODS_N))
    return rows.select("market_id", "book", "side", *[half_up(F.col(m) + 1e-9, 6).alias(m) for m in odds.METHODS_N], F.col("shin_used").alias("method_used"))


@query(f"""WITH {FIELD_METHODS}, o AS (SELECT market_id, book, unnest(names) AS side, unnest(list_transform(pow, lambda x: x / list_sum(pow))) AS p FROM m),
a AS (SELECT *, sum(1) OVER (PARTITION BY market_id, side ORDER BY p, book ROWS UNBOUNDED PRECEDING) AS acc, count(*) OVER (PARTITION BY market_id, side) AS n FROM o),
f AS (SELECT market_id, side, min(CASE WHEN acc >= n / 2.0 THEN p END) AS med, avg(CASE WHEN book = 'book3' THEN p END) AS sharp_prob, count(*) AS book_count, stddev_pop(p) AS dispersion FROM a GROUP BY ALL)
SELECT market_id, side, count(*) OVER (PARTITION BY market_id) AS n_sides, round(med / sum(med) OVER (PARTITION BY market_id), 6) AS fair_prob, round(sharp_prob, 6) AS sharp_prob, book_count, round(dispersion, 6) AS dispersion FROM f""")
def field_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_fields").select(F.col("market_id").alias("game_id"), F.lit("outright").alias("market_type"), F.lit("").alias("player_id"), F.lit(0.0).alias("line"), "side", "book", "price")
    return consensus.field_prices(rows, sharp=SHARP, weights={}).select(F.col("game_id").alias("market_id"), "side", F.col("n_sides").cast("long").alias("n_sides"), r("fair_prob"), r("sharp_prob"), "book_count", r("dispersion"))
