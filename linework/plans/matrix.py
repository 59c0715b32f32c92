"""Registered queries of the feature matrix and of the models and checks that run on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, models, panel, validate
from ..sources.cuts import written
from ..sources.fixtures import view, with_views
from .market import AT_KICKOFF, CURRENT, FAIR, SHARP, r
from .research import FINAL, SIMPLE, SNAPS, _simple

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


GAME_MARKET = FAIR.replace(CURRENT, AT_KICKOFF) + """,
prob AS (SELECT game_id, fair_prob AS market_home_prob, sharp_prob - fair_prob AS sharp_soft_delta FROM fair WHERE market_type = 'h2h' AND side = 'home' AND player_id = ''),
sp AS (SELECT q.game_id, book, line, row_number() OVER (PARTITION BY q.game_id, book ORDER BY observed_at, seq) AS i, row_number() OVER (PARTITION BY q.game_id, book ORDER BY observed_at DESC, seq DESC) AS j FROM fx_quote_obs q JOIN fx_games g ON g.game_id = q.game_id WHERE market_type = 'spreads' AND side = 'home' AND observed_at <= kickoff_utc),
bk AS (SELECT game_id, book, max(CASE WHEN i = 1 THEN line END) AS f, max(CASE WHEN j = 1 THEN line END) AS l FROM sp GROUP BY ALL),
mv AS (SELECT game_id, avg(l - f) AS line_move_spread, stddev_pop(l) AS book_dispersion FROM bk GROUP BY game_id),
gm AS (SELECT * FROM prob FULL JOIN mv USING (game_id))"""
REST = """
sides AS (SELECT game_id, season, kickoff_utc, home_team AS team, 1 AS home FROM fx_games WHERE kickoff_utc IS NOT NULL UNION ALL SELECT game_id, season, kickoff_utc, away_team, 0 FROM fx_games WHERE kickoff_utc IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY kickoff_utc, game_id) AS k FROM sides),
gaps AS (SELECT a.game_id, a.home, CAST(a.kickoff_utc AS DATE) - CAST(b.kickoff_utc AS DATE) AS days FROM ranked a JOIN ranked b ON b.season = a.season AND b.team = a.team AND b.k = a.k - 1),
rest AS (SELECT g.game_id, h.days AS home_rest, a.days AS away_rest FROM fx_games g LEFT JOIN gaps h ON h.game_id = g.game_id AND h.home = 1 LEFT JOIN gaps a ON a.game_id = g.game_id AND a.home = 0)"""
WEATHER = "we AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY w.game_id ORDER BY knowledge_time DESC, reading_id DESC) AS rn FROM fx_weather w JOIN fx_games g ON g.game_id = w.game_id WHERE knowledge_time <= kickoff_utc - INTERVAL 3 HOUR) WHERE rn = 1)"
REGULAR = FINAL.format("WHERE season_type IS NULL OR season_type = 'REG'")


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    games = view(spark, d, "fx_games").withColumn("season", F.col("season").cast("int")).withColumn("week", F.col("week").cast("int"))
    return games.join(view(spark, d, "fx_grounds"), "game_id")


def _market(spark: SparkSession, d: str) -> DataFrame:
    return features.game_market(view(spark, d, "fx_quote_obs"), view(spark, d, "fx_games"), sharp=SHARP, method="multiplicative")


@query(f"WITH {GAME_MARKET} SELECT game_id, round(market_home_prob, 6) AS market_home_prob, round(sharp_soft_delta, 6) AS sharp_soft_delta, round(line_move_spread, 6) AS line_move_spread, round(book_dispersion, 6) AS book_dispersion FROM gm")
def game_market(spark: SparkSession, d: str) -> DataFrame:
    return _market(spark, d).select("game_id", *[r(c) for c in ("market_home_prob", "sharp_soft_delta", "line_move_spread", "book_dispersion")])


@query(f"WITH {REST} SELECT game_id, home_rest, away_rest FROM rest")
def game_rest(spark: SparkSession, d: str) -> DataFrame:
    return features.with_rest(view(spark, d, "fx_games")).select("game_id", F.col("home_rest").cast("long").alias("home_rest"), F.col("away_rest").cast("long").alias("away_rest"))


@query(f"WITH {WEATHER} SELECT game_id, reading_id, temp_c, wind_kph, gust_kph, precip_mm FROM we")
def weather_at_kickoff(spark: SparkSession, d: str) -> DataFrame:
    return features.weather_at_kickoff(view(spark, d, "fx_weather"), view(spark, d, "fx_games"), 3.0).select("game_id", "reading_id", "temp_c", "wind_kph", "gust_kph", "precip_mm")


def _feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    rated = _simple(spark, d).withColumn("confident", F.col("off_plays") >= 120)
    # The reports of the tables are of one season; here each season has them.
    absent = panel.availability_summary(view(spark, d, "fx_reports"), view(spark, d, "fx_usage")).withColumn("season", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    weather = features.weather_at_kickoff(view(spark, d, "fx_weather"), view(spark, d, "fx_games"), 3.0)
    return features.training_matrix(_schedule(spark, d), rated, absent, _market(spark, d), weather)


# Each feature of the matrix in SQL, of the tables that the twin joins.
_INDOOR = "coalesce(lower(roof) IN ('dome', 'closed'), false)"
_READING = {c: f"CASE WHEN {_INDOOR} THEN {indoor} ELSE w.{c} END" for c, indoor in (("wind_kph", 0.0), ("gust_kph", 0.0), ("temp_c", 21.0), ("precip_mm", 0.0))}
_TERMS = {
    "market_spread": "spread_line", "market_total": "total_line", **{c: c for c in ("market_home_prob", "line_move_spread", "book_dispersion", "sharp_soft_delta", "home_rest", "away_rest", "div_game")},
    "rest_diff": "coalesce(home_rest, 7) - coalesce(away_rest, 7)", "is_dome": "lower(roof) IN ('dome', 'closed', 'retractable')", "week": "g.week",
    "kickoff_slot": "CASE WHEN kickoff_utc IS NULL OR hour(kickoff_utc) < 17 THEN 1 WHEN hour(kickoff_utc) < 21 THEN 2 ELSE 3 END",
    **_READING, "high_wind": f"greatest({_READING['wind_kph']}, {_READING['gust_kph']}) >= 32.0",
    **{f"{s}_{u}_{c}": f"{s[0]}.{u}_{c}" for s in ("home", "away") for u in ("off", "def") for c in ("all", "pass", "rush")},
    **{f"{s}_edge_{c}": f"{s[0]}.off_{c} - {o}.def_{c}" for s, o in (("home", "a"), ("away", "h")) for c in ("pass", "rush")},
    "net_edge": "(h.off_all - a.def_all) - (a.off_all - h.def_all)", "ratings_confident": "coalesce(h.sure AND a.sure, false)",
    **{f"{s}_{m}": f"x{s[0]}.{m}" for s in ("home", "away") for m in ("n_out", "n_questionable", "qb_out", "snap_share_out")}, "availability_known": "xh.n_out IS NOT NULL OR xa.n_out IS NOT NULL",
}
# The snap shares of the table are rounded to six digits where some are ties, which the engines break differently.
_DIGITS = {name: 3 if "snap_share" in name else 6 for name in features.NAMES}
_PICKED = ", ".join(f"round(coalesce(CAST({_TERMS[f.name]} AS DOUBLE), {f.default}), {_DIGITS[f.name]}) AS {f.name}" for f in features.SPEC)
_WIDE = ", ".join(f"max(CASE WHEN play_class = '{c}' THEN {u}_rating END) AS {u}_{c}" for c in ("all", "pass", "rush") for u in ("off", "def"))
MATRIX = f"""{GAME_MARKET}, {REST.replace('sides AS', 'two_sides AS').replace('FROM sides', 'FROM two_sides')}, {WEATHER}, {SIMPLE}, {REGULAR}, {SNAPS},
av AS (SELECT y.season, week, team, sum(CASE WHEN report_status = 'Out' THEN 1 ELSE 0 END) AS n_out, sum(CASE WHEN report_status = 'Questionable' THEN 1 ELSE 0 END) AS n_questionable, max(CASE WHEN report_status = 'Out' AND position = 'QB' THEN 1 ELSE 0 END) AS qb_out, coalesce(sum(CASE WHEN report_status = 'Out' THEN prior_snap END), 0.0) AS snap_share_out FROM sn CROSS JOIN (SELECT unnest(range(1995, 2002)) AS season) y GROUP BY ALL),
wide AS (SELECT season, week, team, {_WIDE}, min(off_plays) >= 120 AS sure FROM sr GROUP BY ALL),
mx AS (SELECT g.game_id, g.season, home_score - away_score AS margin, home_score - away_score - spread_line AS residual, home_score - away_score > spread_line AS cover, home_score + away_score - total_line AS total_residual, home_score + away_score > total_line AS ov, {_PICKED}
 FROM fx_games g JOIN fx_grounds USING (game_id) LEFT JOIN gm ON gm.game_id = g.game_id LEFT JOIN rest ON rest.game_id = g.game_id LEFT JOIN we w ON w.game_id = g.game_id
 LEFT JOIN wide h ON h.season = g.season AND h.week = g.week AND h.team = g.home_team LEFT JOIN wide a ON a.season = g.season AND a.week = g.week AND a.team = g.away_team
 LEFT JOIN av xh ON xh.season = g.season AND xh.week = g.week AND xh.team = g.home_team LEFT JOIN av xa ON xa.season = g.season AND xa.week = g.week AND xa.team = g.away_team
 WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND spread_line IS NOT NULL AND total_line IS NOT NULL)"""


@query(f"WITH {MATRIX} SELECT game_id, CAST(season AS INT) AS season, margin, residual, CAST(cover AS INT) AS home_cover, total_residual, CAST(ov AS INT) AS over, {', '.join(features.NAMES)} FROM mx")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _feature_matrix(spark, d).select("game_id", "season", "margin", "residual", "home_cover", "total_residual", "over", *[r(c, _DIGITS[c]) for c in features.NAMES])


@query(f"""WITH {MATRIX}, one AS (SELECT count(*) AS n, count(DISTINCT game_id) AS games, corr(market_spread, margin) AS c, corr(market_total, total_residual + market_total) AS t, avg(residual) AS m, stddev_samp(residual) / sqrt(count(*)) AS se, avg(CAST(cover AS INT)) AS k FROM mx)
SELECT name, round(value, 6) AS value, value BETWEEN lo AND hi AS passed FROM (SELECT 'duplicate_games' AS name, CAST(n - games AS DOUBLE) AS value, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi FROM one UNION ALL SELECT 'spread_margin_corr', coalesce(c, 0.0), 1e-9, 1.0 FROM one UNION ALL SELECT 'total_points_corr', coalesce(t, 0.0), 1e-9, 1.0 FROM one UNION ALL SELECT 'mean_residual_se', coalesce(m / se, 0.0), -4.0, 4.0 FROM one UNION ALL SELECT 'home_cover_se', (k - 0.5) * 2.0 * sqrt(n), -4.0, 4.0 FROM one)""")
def matrix_sanity(spark: SparkSession, d: str) -> DataFrame:
    return features.sanity(_feature_matrix(spark, d)).select("name", r("value"), "passed")


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """The matrix, worked out once: every fold of every model reads it."""
    return written(_feature_matrix(spark, d).withColumn("home_cover", F.col("home_cover").cast("double")))


@query()
def cover_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Chances to cover from predicted residuals, each season by the seasons before it, beside the market's even chance."""
    fit = models.residual_model(features.NAMES, "residual", models.SD["spread"], linear=True)
    scored = validate.walk_forward(_numbers(spark, d).filter(~F.col("push")).withColumn("even", F.lit(0.5)), fit)
    return validate.summary(scored, "home_cover", "even").select("season", "n", r("brier"), r("market_brier"), r("accuracy"), "suspicious")


@query()
def matrix_leakage(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbers(spark, d)
    fit = models.residual_model(features.NAMES, "residual", models.SD["spread"], linear=True)
    tested = validate.leakage_report(rows, features.NAMES, "home_cover", fit)
    return tested.unionByName(validate.timing_checks(rows, features.validate_availability(3.0), "game_id")).select("name", r("value"), "limit", "passed")


@query()
def residual_importances(spark: SparkSession, d: str) -> DataFrame:
    """What the trees of the residual model split on; sums to 1 where there is any split."""
    return models.residual_importances(_numbers(spark, d), features.NAMES, "residual").select("feature", r("importance"))
