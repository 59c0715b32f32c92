"""Registered queries of the research operators, each with its SQL twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, panel, ratings, warehouse
from ..sources.fixtures import view, with_views
from .market import r

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


PLAYS = "pl AS (SELECT *, CASE WHEN down <= 2 THEN 1 ELSE 0 END AS early_down, CASE WHEN yardline_100 <= 20 THEN 1 ELSE 0 END AS red_zone, CASE WHEN air_yards IS NULL THEN NULL WHEN air_yards < 0 THEN 'behind' WHEN air_yards <= 9 THEN 'short' WHEN air_yards <= 19 THEN 'intermediate' ELSE 'deep' END AS depth_bucket FROM fx_plays)"


def _plays(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.plays(view(spark, d, "fx_plays"))


@query(f"WITH {PLAYS} SELECT play_id, season, week, offense, defense, play_class, round(epa, 6) AS epa, success, early_down, red_zone, depth_bucket FROM pl")
def flagged_plays(spark: SparkSession, d: str) -> DataFrame:
    return _plays(spark, d).select("play_id", "season", "week", "offense", "defense", "play_class", r("epa"), "success", "early_down", "red_zone", "depth_bucket")


SITUATIONS = "si AS (SELECT *, CASE WHEN play_id % 50 = 0 THEN NULL ELSE (play_id % 101) / 100.0 END AS wp, play_id % 37 - 9 AS yards_gained FROM fx_plays)"


@query(f"WITH {SITUATIONS} SELECT season, offense AS team, count(*) AS plays, CAST(sum(CASE WHEN wp >= 0.1 AND wp <= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS neutral_plays, round(avg(CASE WHEN wp >= 0.1 AND wp <= 0.9 THEN epa END), 6) AS off_epa_neutral, round(avg(CASE WHEN yards_gained >= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS off_explosive_rate FROM si GROUP BY ALL")
def team_situations(spark: SparkSession, d: str) -> DataFrame:
    raw = view(spark, d, "fx_plays").withColumn("wp", F.when(F.col("play_id") % 50 != 0, (F.col("play_id") % 101) / F.lit(100.0))).withColumn("yards_gained", F.col("play_id") % 37 - 9)
    return warehouse.team_situations(warehouse.plays(raw)).select("season", "team", "plays", "neutral_plays", r("off_epa_neutral"), r("off_explosive_rate"))


@query(f"""WITH {PLAYS} SELECT season, week, offense AS team, defense AS opponent, game_id, count(*) AS plays, round(avg(epa), 6) AS off_epa, round(avg(CASE WHEN play_class = 'pass' THEN epa END), 6) AS off_pass_epa, round(avg(CASE WHEN play_class = 'rush' THEN epa END), 6) AS off_rush_epa,
 round(avg(CASE WHEN early_down = 1 THEN epa END), 6) AS off_epa_early, round(avg(success::DOUBLE), 6) AS off_success, round(avg(CASE WHEN red_zone = 1 THEN epa END), 6) AS off_epa_redzone, round(sum(CASE WHEN play_class = 'pass' THEN 1.0::DOUBLE ELSE 0 END) / count(*), 6) AS pass_rate, round(avg(CASE WHEN play_class = 'pass' THEN air_yards END), 6) AS avg_air_yards FROM pl GROUP BY ALL""")
def team_weeks(spark: SparkSession, d: str) -> DataFrame:
    out = warehouse.team_weeks(_plays(spark, d))
    return out.select("season", "week", "team", "opponent", "game_id", "plays", *[r(c) for c in ("off_epa", "off_pass_epa", "off_rush_epa", "off_epa_early", "off_success", "off_epa_redzone", "pass_rate", "avg_air_yards")])


@query(f"WITH {PLAYS} SELECT season, week, defense AS team, game_id, depth_bucket, count(*) AS plays, round(avg(epa), 6) AS epa_allowed, round(avg(success::DOUBLE), 6) AS success_allowed FROM pl WHERE play_class = 'pass' AND depth_bucket IS NOT NULL GROUP BY ALL")
def defense_depth_weeks(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.defense_depth_weeks(_plays(spark, d)).select("season", "week", "team", "game_id", "depth_bucket", "plays", r("epa_allowed"), r("success_allowed"))


USAGE = PLAYS + """,
tt AS (SELECT game_id, offense AS team, CAST(sum(CASE WHEN play_class = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS team_targets, CAST(sum(CASE WHEN play_class = 'rush' THEN 1 ELSE 0 END) AS BIGINT) AS team_carries, CAST(sum(CASE WHEN play_class = 'pass' THEN coalesce(air_yards, 0) ELSE 0 END) AS BIGINT) AS team_air_yards FROM pl GROUP BY ALL),
rec AS (SELECT game_id, season, week, offense AS team, player_id, count(*) AS targets, CAST(sum(coalesce(air_yards, 0)) AS BIGINT) AS air_yards, avg(epa) AS epa_per_target FROM pl WHERE play_class = 'pass' GROUP BY ALL),
rush AS (SELECT game_id, season, week, offense AS team, player_id, count(*) AS carries, avg(epa) AS epa_per_carry FROM pl WHERE play_class = 'rush' GROUP BY ALL)"""


@query(f"WITH {USAGE} SELECT * FROM tt")
def team_totals(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.team_totals(_plays(spark, d))


@query(f"WITH {USAGE} SELECT game_id, team, player_id, targets, air_yards, round(epa_per_target, 6) AS epa_per_target FROM rec")
def receiving_usage(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.receiving_usage(_plays(spark, d)).select("game_id", "team", "player_id", "targets", "air_yards", r("epa_per_target"))


@query(f"""WITH {USAGE}, f AS (SELECT * FROM rec FULL JOIN rush USING (game_id, season, week, team, player_id) LEFT JOIN tt USING (game_id, team))
SELECT game_id, season, week, team, player_id, coalesce(targets, 0) AS targets, coalesce(carries, 0) AS carries, coalesce(air_yards, 0) AS air_yards, round(epa_per_target, 6) AS epa_per_target, round(epa_per_carry, 6) AS epa_per_carry,
 round(coalesce(targets, 0)::DOUBLE / nullif(team_targets, 0), 6) AS target_share, round(coalesce(carries, 0)::DOUBLE / nullif(team_carries, 0), 6) AS carry_share, round(coalesce(air_yards, 0)::DOUBLE / nullif(team_air_yards, 0), 6) AS air_yards_share FROM f""")
def player_weeks(spark: SparkSession, d: str) -> DataFrame:
    out = warehouse.player_weeks(_plays(spark, d))
    return out.select("game_id", "season", "week", "team", "player_id", "targets", "carries", "air_yards", r("epa_per_target"), r("epa_per_carry"), r("target_share"), r("carry_share"), r("air_yards_share"))


@query("SELECT count(DISTINCT player_id) AS ids, count(DISTINCT CASE WHEN n = 1 THEN player_id END) AS matched, round(count(DISTINCT CASE WHEN n = 1 THEN player_id END)::DOUBLE / count(DISTINCT player_id), 6) AS rate FROM (SELECT player_id, count(DISTINCT offense) AS n FROM fx_plays WHERE season = 1996 AND week <= 2 GROUP BY 1)")
def crosswalk_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _plays(spark, d).filter("season = 1996 and week <= 2")
    cross = warehouse.id_crosswalk(rows, "player_id", "offense")
    return warehouse.crosswalk_coverage(rows, cross, "player_id", "offense").select("ids", "matched", r("rate"))


@query(f"""WITH {USAGE}, f AS (SELECT * FROM rec FULL JOIN rush USING (game_id, season, week, team, player_id) LEFT JOIN tt USING (game_id, team)),
s AS (SELECT game_id, team, sum(coalesce(targets, 0)::DOUBLE / nullif(team_targets, 0)) AS s, count(*) - count(DISTINCT player_id) AS dup FROM f GROUP BY ALL),
w AS (SELECT (SELECT count(*)::DOUBLE FROM pl) AS plays, (SELECT avg(epa) FROM pl) AS mean_epa, (SELECT avg(success::DOUBLE) FROM pl) AS success_rate, (SELECT avg(s) FROM s) AS target_share_sum, (SELECT sum(dup)::DOUBLE FROM s) AS duplicate_keys)
SELECT name, round(value, 6) AS value, value BETWEEN lo AND hi AS passed FROM (SELECT 'plays' AS name, plays AS value, 1.0 AS lo, 1e15 AS hi FROM w UNION ALL SELECT 'mean_epa', mean_epa, -0.5, 0.5 FROM w UNION ALL SELECT 'success_rate', success_rate, 0.3, 0.6 FROM w UNION ALL SELECT 'target_share_sum', target_share_sum, 0.999, 1.001 FROM w UNION ALL SELECT 'duplicate_keys', duplicate_keys, 0, 0 FROM w)""")
def warehouse_verify(spark: SparkSession, d: str) -> DataFrame:
    flagged = _plays(spark, d)
    return warehouse.verify(flagged, warehouse.player_weeks(flagged)).select("name", r("value"), "passed")


def _rated_plays(spark: SparkSession, d: str) -> DataFrame:
    """Plays of a known class; the sums by week leave out unknown teams themselves."""
    return view(spark, d, "fx_plays").filter(F.col("play_class").isin("pass", "rush"))


DECAYED = """wk AS (SELECT season, week, c AS play_class, offense, defense, sum(epa) AS epa, count(*) AS n FROM (SELECT *, unnest([play_class, 'all']) AS c FROM fx_plays) GROUP BY ALL),
dec AS (SELECT w.season, c.cutoff, w.play_class, offense, defense, sum(0.93 ** (c.cutoff - w.week) * n) AS w, sum(0.93 ** (c.cutoff - w.week) * epa) AS w_epa, CAST(sum(n) AS BIGINT) AS n FROM wk w JOIN (SELECT DISTINCT season, week AS cutoff FROM wk) c ON c.season = w.season AND c.cutoff > w.week GROUP BY ALL)"""


@query(f"WITH {DECAYED} SELECT season, cutoff, play_class, offense, defense, round(w, 6) AS w, round(w_epa, 6) AS w_epa, n FROM dec")
def decayed_sums(spark: SparkSession, d: str) -> DataFrame:
    return ratings.decayed_sums(_rated_plays(spark, d)).select("season", "cutoff", "play_class", "offense", "defense", r("w"), r("w_epa"), "n")


@query(f"WITH {DECAYED}, o AS (SELECT season, cutoff, play_class, offense AS team, CAST(sum(n) AS BIGINT) AS off_plays FROM dec GROUP BY ALL), e AS (SELECT season, cutoff, play_class, defense AS team, CAST(sum(n) AS BIGINT) AS def_plays FROM dec GROUP BY ALL) SELECT season, cutoff, play_class, team, coalesce(off_plays, 0) AS off_plays, coalesce(def_plays, 0) AS def_plays, coalesce(off_plays, 0) >= 120 AND coalesce(def_plays, 0) >= 120 AS confident FROM o FULL JOIN e USING (season, cutoff, play_class, team)")
def unit_play_counts(spark: SparkSession, d: str) -> DataFrame:
    cells = ratings.decayed_sums(_rated_plays(spark, d))
    key = ["season", "cutoff", "play_class", "team"]
    unit = lambda side, o: F.struct(F.col(side).alias("team"), F.lit(o).alias("o"))
    both = cells.select("season", "cutoff", "play_class", "n", F.explode(F.array(unit("offense", 1), unit("defense", 0))).alias("s"))
    out = both.groupBy("season", "cutoff", "play_class", F.col("s.team").alias("team")).agg(F.sum(F.when(F.col("s.o") == 1, F.col("n")).otherwise(0)).alias("off_plays"), F.sum(F.when(F.col("s.o") == 0, F.col("n")).otherwise(0)).alias("def_plays"))
    return out.select(*key, "off_plays", "def_plays", ((F.col("off_plays") >= 120) & (F.col("def_plays") >= 120)).alias("confident"))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return ratings.unit_ratings(_plays(spark, d))


@query()
def unit_ratings(spark: SparkSession, d: str) -> DataFrame:
    return _ratings(spark, d).select("season", "week", "play_class", "team", r("off_rating"), r("def_rating"), "off_plays", "def_plays", "confident")


@query()
def rating_as_of(spark: SparkSession, d: str) -> DataFrame:
    rated = _ratings(spark, d)
    return ratings.rating_as_of(rated, ratings.build_priors(rated)).select("season", "week", "play_class", "team", r("off_rating"), r("def_rating"), r("prior_weight"))


@query()
def fit_k(spark: SparkSession, d: str) -> DataFrame:
    rated, flagged = _ratings(spark, d), ratings.with_all_class(_plays(spark, d))
    after = flagged.groupBy("season", "week", "play_class", F.col("offense").alias("team")).agg(F.avg("epa").alias("actual"))
    return ratings.fit_k(rated, ratings.build_priors(rated), after).select("play_class", "k", r("mae"), "n")


@query()
def matchups(spark: SparkSession, d: str) -> DataFrame:
    games = view(spark, d, "fx_games").withColumn("season", F.col("season").cast("int")).withColumn("week", F.col("week").cast("int"))
    out = ratings.matchups(games, _ratings(spark, d))
    return out.select("game_id", "home_team", "away_team", r("home_edge_all"), r("away_edge_all"), r("net_edge"), "confident")


# Ratings that SQL can also say: the decayed mean of each offense.
SIMPLE = f"{DECAYED}, sr AS (SELECT season, cutoff AS week, play_class, offense AS team, sum(w_epa) / sum(w) AS off_rating, 0.0::DOUBLE AS def_rating, CAST(sum(n) AS BIGINT) AS off_plays FROM dec GROUP BY ALL), pr AS (SELECT season + 1 AS season, team, play_class, arg_max(off_rating, week) * 0.55 AS off_prior FROM sr GROUP BY ALL)"


def _simple(spark: SparkSession, d: str) -> DataFrame:
    cells = ratings.decayed_sums(_rated_plays(spark, d))
    return cells.groupBy("season", F.col("cutoff").alias("week"), "play_class", F.col("offense").alias("team")).agg((F.sum("w_epa") / F.sum("w")).alias("off_rating"), F.lit(0.0).alias("def_rating"), F.sum("n").alias("off_plays"), F.sum("n").alias("def_plays"))


@query(f"WITH {SIMPLE} SELECT season, team, play_class, round(off_prior, 6) AS off_prior FROM pr")
def build_priors(spark: SparkSession, d: str) -> DataFrame:
    return ratings.build_priors(_simple(spark, d)).select("season", "team", "play_class", r("off_prior"))


@query(f"WITH {SIMPLE}, k AS (SELECT s.*, coalesce(off_prior, 0.0) AS prior, CASE WHEN play_class = 'rush' THEN 120.0::DOUBLE ELSE 240.0::DOUBLE END AS k FROM sr s LEFT JOIN pr USING (season, team, play_class)) SELECT season, week, play_class, team, round(off_plays / (off_plays + k) * off_rating + (1 - off_plays / (off_plays + k)) * prior, 6) AS off_rating, round(k / (off_plays + k), 6) AS prior_weight FROM k")
def shrunk_means(spark: SparkSession, d: str) -> DataFrame:
    simple = _simple(spark, d)
    return ratings.rating_as_of(simple, ratings.build_priors(simple)).select("season", "week", "play_class", "team", r("off_rating"), r("prior_weight"))


# ---- panels and reports -------------------------------------------------------------------------

ACTIVE = "act AS (SELECT player_id, season, team, count(*) AS n_active, median(volume) AS baseline_vol, min(week) AS first_wk, max(week) AS last_wk FROM fx_usage GROUP BY ALL HAVING count(*) >= 4 AND median(volume) >= 1)"
PANEL = ACTIVE + """,
pan AS (SELECT a.player_id, a.season, a.team, t.week, a.baseline_vol, coalesce(u.volume, 0) AS volume, CASE WHEN u.volume IS NULL THEN 0 ELSE 1 END AS played FROM act a JOIN (SELECT DISTINCT season, team, week FROM fx_usage) t ON t.season = a.season AND t.team = a.team AND t.week BETWEEN a.first_wk AND a.last_wk
  LEFT JOIN fx_usage u ON u.player_id = a.player_id AND u.season = a.season AND u.team = a.team AND u.week = t.week),
form AS (SELECT *, avg(volume) OVER w4 AS trail_mean, max(volume) OVER w4 AS trail_max, avg(CASE WHEN volume = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w4 AS trail_zero_rate, count(volume) OVER w4 AS trail_n, lag(volume) OVER (PARTITION BY player_id, season ORDER BY week) AS last_week_vol, CASE WHEN volume < 0.5 * baseline_vol THEN 1 ELSE 0 END AS bust FROM pan WINDOW w4 AS (PARTITION BY player_id, season ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.player_panel(view(spark, d, "fx_usage"))


@query(f"WITH {ACTIVE} SELECT player_id, season, team, n_active, baseline_vol, first_wk, last_wk FROM act")
def active_players(spark: SparkSession, d: str) -> DataFrame:
    return panel.active_players(view(spark, d, "fx_usage"))


@query(f"WITH {PANEL} SELECT * FROM pan")
def player_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d)


@query(f"WITH {PANEL} SELECT player_id, season, week, volume, round(trail_mean, 6) AS trail_mean, trail_max, round(trail_zero_rate, 6) AS trail_zero_rate, trail_n, last_week_vol, bust FROM form")
def trailing_form(spark: SparkSession, d: str) -> DataFrame:
    return panel.trailing_form(_panel(spark, d)).select("player_id", "season", "week", "volume", r("trail_mean"), "trail_max", r("trail_zero_rate"), "trail_n", "last_week_vol", "bust")


@query("SELECT player_id, season, week, round(avg(snap_pct) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 9) AS form_short, round(avg(snap_pct) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 9) AS form_long FROM fx_usage")
def prior_form(spark: SparkSession, d: str) -> DataFrame:
    return panel.prior_form(view(spark, d, "fx_usage")).select("player_id", "season", "week", r("form_short", 9), r("form_long", 9))


@query(f"WITH {PANEL} SELECT count(*) AS rows, round(avg(1.0::DOUBLE - played), 6) AS absence_rate, round(avg(bust), 6) AS bust_rate, round(avg(CASE WHEN played = 1 THEN bust END), 6) AS present_bust_rate, round(avg(bust) / avg(CASE WHEN played = 1 THEN bust END), 6) AS understatement FROM form")
def panel_summary(spark: SparkSession, d: str) -> DataFrame:
    return panel.panel_summary(panel.trailing_form(_panel(spark, d))).select("rows", r("absence_rate"), r("bust_rate"), r("present_bust_rate"), r("understatement"))


FINAL = "fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season, week ORDER BY knowledge_time DESC, report_id DESC) AS rn FROM fx_reports {0}) WHERE rn = 1)"
SNAPS = "sn AS (SELECT *, (SELECT avg(snap_pct) FROM fx_usage u WHERE u.player_id = f.player_id AND u.season = f.season AND u.week BETWEEN f.week - 4 AND f.week - 1) AS prior_snap FROM fin f)"


@query(f"WITH {FINAL.format('')} SELECT report_id, player_id, season, week, report_status, practice_status FROM fin")
def latest_reports(spark: SparkSession, d: str) -> DataFrame:
    return panel.latest_reports(view(spark, d, "fx_reports"), "player_id", "season", "week").select("report_id", "player_id", "season", "week", "report_status", "practice_status")


@query(f"WITH {FINAL.format('')}, {SNAPS} SELECT report_id, player_id, week, round(prior_snap, 9) AS prior_snap FROM sn")
def prior_snap_share(spark: SparkSession, d: str) -> DataFrame:
    final = panel.latest_reports(view(spark, d, "fx_reports"), "player_id", "season", "week")
    return panel.prior_snap_share(final, view(spark, d, "fx_usage")).select("report_id", "player_id", "week", r("prior_snap", 9))


@query(f"WITH {FINAL.format(chr(39).join(['WHERE season_type IS NULL OR season_type = ', 'REG', '']))}, {SNAPS} SELECT season, week, team, CAST(sum(CASE WHEN report_status = 'Out' THEN 1 ELSE 0 END) AS BIGINT) AS n_out, CAST(sum(CASE WHEN report_status = 'Questionable' THEN 1 ELSE 0 END) AS BIGINT) AS n_questionable, max(CASE WHEN report_status = 'Out' AND position = 'QB' THEN 1 ELSE 0 END) AS qb_out, round(coalesce(sum(CASE WHEN report_status = 'Out' THEN prior_snap END), 0.0), 9) AS snap_share_out FROM sn GROUP BY ALL")
def availability_summary(spark: SparkSession, d: str) -> DataFrame:
    return panel.availability_summary(view(spark, d, "fx_reports"), view(spark, d, "fx_usage")).select("season", "week", "team", "n_out", "n_questionable", "qb_out", r("snap_share_out", 9))


@query(f"WITH {FINAL.format('')} SELECT report_status, practice_status, count(*) AS n, round(avg(CASE WHEN u.snap_pct IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS active_rate, round(avg(u.snap_pct), 6) AS mean_snap FROM fin f LEFT JOIN fx_usage u USING (player_id, season, week) GROUP BY ALL")
def report_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return panel.report_crosstab(view(spark, d, "fx_reports"), view(spark, d, "fx_usage")).select("report_status", "practice_status", "n", r("active_rate"), r("mean_snap"))


@query("SELECT o.o_orderkey AS decision_id, k.report_id AS known_report_id, k.report_status AS known_report_status FROM (SELECT *, concat('P', CAST(o_custkey % 150 AS VARCHAR)) AS player_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(o_orderkey % 40000 AS INT) AS decided_at FROM orders) o LEFT JOIN LATERAL (SELECT * FROM fx_reports f WHERE f.player_id = o.player_id AND f.knowledge_time <= o.decided_at ORDER BY knowledge_time DESC, report_id DESC LIMIT 1) k ON true")
def known_as_of(spark: SparkSession, d: str) -> DataFrame:
    decisions = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("decision_id"), F.concat(F.lit("P"), (F.col("o_custkey") % 150).cast("string")).alias("player_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 40000).cast("int"))).alias("decided_at"))
    reports = view(spark, d, "fx_reports").select("player_id", "report_id", "report_status", "knowledge_time")
    return panel.known_as_of(decisions, reports, "player_id", "decided_at").select("decision_id", "known_report_id", "known_report_status")


@query("SELECT game_id, season, week, home_team AS team, away_team AS opponent, 1 AS is_home, total_line / 2.0 + spread_line / 2.0 AS implied_total, abs(spread_line) AS abs_spread FROM fx_games UNION ALL SELECT game_id, season, week, away_team, home_team, 0, total_line / 2.0 - spread_line / 2.0, abs(spread_line) FROM fx_games")
def team_game_context(spark: SparkSession, d: str) -> DataFrame:
    return panel.team_game_context(view(spark, d, "fx_games"))


# ---- metrics --------------------------------------------------------------------------------------


@query("SELECT season, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) + (1 - y) * ln(1 - least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)))), 5) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM fx_forecasts GROUP BY season")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_metrics(view(spark, d, "fx_forecasts"), "y", "p", "season").select("season", "n", r("brier"), r("log_loss", 5), r("accuracy"))


@query("WITH k AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY p) + (count(*) OVER (PARTITION BY season, p) - 1) / 2.0::DOUBLE AS rk FROM fx_forecasts) SELECT season, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY season")
def auc_by_season(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(view(spark, d, "fx_forecasts"), "y", "p", "season").select("season", r("auc"))


CALIBRATION = "cal AS (SELECT season, bin, count(*) AS n, avg(p) AS predicted, avg(y) AS actual FROM (SELECT *, " + "CASE " + " ".join(f"WHEN p >= {i / 10} AND p < 1.0 THEN {i / 10}::DOUBLE" for i in range(9, -1, -1)) + " END AS bin FROM fx_forecasts) WHERE bin IS NOT NULL GROUP BY ALL)"


@query(f"WITH {CALIBRATION} SELECT season, bin, n, round(predicted, 6) AS predicted, round(actual, 6) AS actual, round(actual - predicted, 6) AS gap FROM cal")
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_table(view(spark, d, "fx_forecasts"), "y", "p", "season").select("season", "bin", "n", r("predicted"), r("actual"), r("gap"))


@query(f"WITH {CALIBRATION} SELECT season, round(sum(n * abs(actual - predicted)) / sum(n), 6) AS ece FROM cal GROUP BY season")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    table = metrics.calibration_table(view(spark, d, "fx_forecasts"), "y", "p", "season")
    return metrics.expected_calibration_error(table, "season").select("season", r("ece"))


@query("SELECT season, tenth, count(*) AS n, round(count(*)::DOUBLE / max(t), 6) AS share FROM (SELECT *, count(*) OVER (PARTITION BY season) AS t, CASE " + " ".join(f"WHEN p >= {i / 10} THEN {i / 10}::DOUBLE" for i in range(9, -1, -1)) + " END AS tenth FROM fx_forecasts) GROUP BY season, tenth")
def pit_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pit_table(view(spark, d, "fx_forecasts"), "p", "season").select("season", "tenth", "n", r("share"))


@query("WITH k AS (SELECT season, p, row_number() OVER (PARTITION BY season ORDER BY p) AS i, count(*) OVER (PARTITION BY season) AS n FROM fx_forecasts) SELECT season, round(max(abs(i::DOUBLE / n - p)), 6) AS ks_upper, round(max(greatest(abs(i::DOUBLE / n - p), abs((i - 1)::DOUBLE / n - p))), 6) AS ks FROM k GROUP BY season")
def ks_uniform(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ks_uniform(view(spark, d, "fx_forecasts"), "p", "season").select("season", r("ks_upper"), r("ks"))


@query(f"WITH {FINAL.format(chr(39).join(['WHERE season_type IS NULL OR season_type = ', 'REG', '']))}, {SNAPS} SELECT s.report_id, s.player_id, s.week, s.report_status, round(s.prior_snap, 9) AS prior_snap, CASE WHEN u.snap_pct IS NULL THEN 0 ELSE 1 END AS active FROM sn s LEFT JOIN fx_usage u USING (player_id, season, week)")
def report_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.report_panel(view(spark, d, "fx_reports"), view(spark, d, "fx_usage")).select("report_id", "player_id", "week", "report_status", r("prior_snap", 9), "active")
