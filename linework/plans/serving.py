"""Registered queries of identity, operations, projections and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import availability, identity, metrics, models, ops, panel, props, validate
from ..sources import tables
from ..sources.cuts import written
from ..sources.fixtures import view, with_views
from .market import r
from .research import FINAL, PANEL

QUERIES, ORACLES = {}, {}
AS_OF = "2024-01-20 00:00:00"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


def _norm(column: str) -> str:
    step = f"trim(regexp_replace(regexp_replace(lower(trim({column})), '[''`’]', '', 'g'), '[.,\\-\\s]+', ' ', 'g'))"
    step = f"regexp_replace({step}, '( (jr|sr|ii|iii|iv|v))+$', '')"
    return f"regexp_replace({step}, '^(\\w) (\\w)( |$)', '\\1\\2\\3')"


@query(f"SELECT player_id, {_norm('player_name')} AS name_key FROM fx_players")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_players").select("player_id", names.normal_name(F.col("player_name")).alias("name_key"))


RESOLVED = f"""pl AS (SELECT player_id, team, {_norm('player_name')} AS k FROM fx_players), rec AS (SELECT player_id AS source_id, CASE WHEN substr(player_id, -1) IN ('0', '5') THEN player_id ELSE concat('sleeper:', player_id) END AS player_id, team, {_norm('player_name')} AS k FROM fx_players),
n AS (SELECT k, count(DISTINCT player_id) AS n, min(player_id) AS id FROM pl GROUP BY 1), t AS (SELECT k, team, count(DISTINCT player_id) AS n, min(player_id) AS id FROM pl GROUP BY 1, 2),
res AS (SELECT source_id, CASE WHEN rec.player_id NOT LIKE 'sleeper:%' THEN 'native' WHEN n.n = 1 THEN 'by_name' WHEN t.n = 1 THEN 'by_name_team' ELSE 'ambiguous' END AS status, CASE WHEN rec.player_id NOT LIKE 'sleeper:%' THEN rec.player_id WHEN n.n = 1 THEN n.id WHEN t.n = 1 THEN t.id ELSE rec.player_id END AS resolved_id FROM rec LEFT JOIN n USING (k) LEFT JOIN t ON t.k = rec.k AND t.team = rec.team)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    players = view(spark, d, "fx_players")
    native = F.substring("player_id", -1, 1).isin("0", "5")
    records = players.withColumn("source_id", F.col("player_id")).withColumn("player_id", F.when(native, F.col("player_id")).otherwise(F.concat(F.lit("sleeper:"), "player_id")))
    return identity.resolve_players(records, players)


@query(f"WITH {RESOLVED} SELECT * FROM res")
def resolved_players(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("source_id", "status", "resolved_id")


@query(f"WITH {RESOLVED} SELECT status, count(*) AS n FROM res GROUP BY 1")
def resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolution_counts(_resolved(spark, d))


@query(f"WITH k AS (SELECT *, {_norm('player_name')} AS name_key FROM fx_players), one AS (SELECT name_key, min(player_id) AS id FROM k GROUP BY 1 HAVING count(DISTINCT player_id) = 1) SELECT k.player_id AS source_id, CASE WHEN length(k.player_id) % 2 = 0 THEN k.player_id ELSE one.id END AS player_id FROM k LEFT JOIN one USING (name_key)")
def ids_by_unique_name(spark: SparkSession, d: str) -> DataFrame:
    """Records without an id get that of their name where only one player has it."""
    players = view(spark, d, "fx_players").withColumn("name_key", names.normal_name(F.col("player_name")))
    records = players.select(F.col("player_id").alias("source_id"), "name_key", F.when(F.length("player_id") % 2 == 0, F.col("player_id")).alias("player_id"))
    return panel.resolve_by_unique_name(records, players).select("source_id", "player_id")


@query("SELECT g.game_id FROM fx_games g WHERE NOT EXISTS (SELECT 1 FROM fx_picks p WHERE p.game_id = g.game_id AND p.tier = 'A' AND p.demo = 1)")
def missing_weather(spark: SparkSession, d: str) -> DataFrame:
    return identity.missing_weather(view(spark, d, "fx_games"), view(spark, d, "fx_picks").filter("tier = 'A' and demo = 1")).select("game_id")


@query("SELECT report_id, CASE report_status WHEN 'Out' THEN 'Out' ELSE report_status END AS game_status, CASE WHEN practice_status LIKE 'Did Not%' THEN 'DNP' WHEN practice_status LIKE 'Limited%' THEN 'LP' WHEN practice_status LIKE 'Full%' THEN 'FP' END AS practice FROM fx_reports")
def report_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_reports").select("report_id", names.game_status(F.col("report_status")).alias("game_status"), names.practice_status(F.col("practice_status")).alias("practice"))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY knowledge_time DESC, report_id DESC) AS rn FROM fx_reports) SELECT report_id, player_id, report_status FROM l WHERE rn = 1")
def upserted_reports(spark: SparkSession, d: str) -> DataFrame:
    reports = view(spark, d, "fx_reports")
    return tables.upsert(reports.filter("report_id % 2 = 0"), reports.filter("report_id % 2 = 1"), ["player_id"], ["knowledge_time", "report_id"]).select("report_id", "player_id", "report_status")


@query("SELECT DISTINCT player_id, week FROM fx_reports WHERE report_id % 2 = 1 EXCEPT SELECT player_id, week FROM fx_reports WHERE report_id % 2 = 0")
def appended_reports(spark: SparkSession, d: str) -> DataFrame:
    reports = view(spark, d, "fx_reports")
    return tables.append_new(reports.filter("report_id % 2 = 0"), reports.filter("report_id % 2 = 1"), ["player_id", "week"]).select("player_id", "week")


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def list_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.list_tables(spark, d, ["orders", "lineitem", "events"])


LAST_RUNS = "lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY finished_at DESC, run_id DESC) AS rn FROM fx_runs {0}) WHERE rn = 1)"


@query(f"WITH {LAST_RUNS.format('')} SELECT job_name, run_id, status FROM lr")
def last_runs(spark: SparkSession, d: str) -> DataFrame:
    return ops.last_runs(view(spark, d, "fx_runs")).select("job_name", "run_id", "status")


@query(f"WITH {LAST_RUNS.format(f'WHERE finished_at <= TIMESTAMP {chr(39)}{AS_OF}{chr(39)}')}, ex AS (SELECT DISTINCT job_name, 60 + 30 * CAST(substr(job_name, 4) AS INT) AS max_age_min FROM fx_runs) SELECT job_name, round(epoch(TIMESTAMP '{AS_OF}' - finished_at) / 60.0, 3) AS age_min, CASE WHEN finished_at IS NULL THEN 'never_run' WHEN status <> 'ok' THEN 'failed' WHEN epoch(TIMESTAMP '{AS_OF}' - finished_at) / 60.0 > max_age_min THEN 'stale' ELSE 'ok' END AS state FROM ex LEFT JOIN lr USING (job_name)")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "fx_runs")
    expected = runs.select("job_name").distinct().withColumn("max_age_min", 60 + 30 * F.substring("job_name", 4, 3).cast("int"))
    return ops.staleness(runs, expected, AS_OF).select("job_name", r("age_min", 3), "state")


@query("WITH s AS (SELECT job_name AS alert_key, run_id AS seq, status = 'error' AS firing, lag(status = 'error', 1, false) OVER (PARTITION BY job_name ORDER BY finished_at, run_id) AS was FROM fx_runs) SELECT alert_key, seq, CASE WHEN firing THEN 'broke' ELSE 'recovered' END AS event FROM s WHERE firing <> was")
def alert_transitions(spark: SparkSession, d: str) -> DataFrame:
    states = view(spark, d, "fx_runs").select(F.col("job_name").alias("alert_key"), F.col("finished_at").alias("at"), F.col("run_id").alias("seq"), (F.col("status") == "error").alias("firing"))
    return ops.alert_transitions(states).select("alert_key", "seq", "event")


@query("SELECT CAST(finished_at AS DATE) AS day, source, CAST(sum(credits) AS BIGINT) AS credits, count(*) AS calls FROM fx_runs GROUP BY ALL")
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return ops.usage_by_day(view(spark, d, "fx_runs"))


@query(f"""WITH b AS (SELECT CAST(coalesce(sum(credits) FILTER (WHERE date_trunc('month', finished_at) = date_trunc('month', TIMESTAMP '{AS_OF}')), 0) AS BIGINT) AS month_credits, CAST(coalesce(sum(credits) FILTER (WHERE date_trunc('day', finished_at) = date_trunc('day', TIMESTAMP '{AS_OF}')), 0) AS BIGINT) AS day_credits, CAST(coalesce(sum(credits) FILTER (WHERE source = 'manual' AND date_trunc('month', finished_at) = date_trunc('month', TIMESTAMP '{AS_OF}')), 0) AS BIGINT) AS manual_credits FROM fx_runs WHERE finished_at <= TIMESTAMP '{AS_OF}'),
p AS (SELECT *, greatest(0.0::DOUBLE, (1.0 - month_credits / 500000.0::DOUBLE) * 100.0) AS remaining_pct FROM b) SELECT month_credits, day_credits, manual_credits, round(remaining_pct, 6) AS remaining_pct, CASE WHEN remaining_pct > 30 THEN 'all' WHEN remaining_pct > 15 THEN 'no_props' WHEN remaining_pct > 5 THEN 'featured' ELSE 'none' END AS allowed FROM p""")
def budget_state(spark: SparkSession, d: str) -> DataFrame:
    return ops.budget_state(view(spark, d, "fx_runs"), AS_OF, 500000.0).select("month_credits", "day_credits", "manual_credits", r("remaining_pct"), "allowed")


@query("SELECT pick_id, CASE WHEN pick_id % 7 = 1 AND tier = 'A' THEN 'B' ELSE tier END AS tier, CASE WHEN pick_id % 7 = 2 THEN 0 ELSE published END AS published FROM fx_picks")
def applied_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_picks")
    verdicts = rows.select("pick_id", F.when(F.col("pick_id") % 7 == 1, "FLAG").when(F.col("pick_id") % 7 == 2, "KILL").otherwise("OK").alias("verdict"))
    return ops.apply_verdicts(rows, verdicts).select("pick_id", "tier", "published")


@query()
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_picks")
    facts = view(spark, d, "fx_games").select("game_id", F.concat_ws(":", F.lit("total"), F.col("total_line").cast("string")).alias("fact"))
    digests = ops.review_digest(rows, facts)
    reviewed = digests.withColumn("ok", F.col("pick_id") % 2 == 0)
    return ops.review_queue(rows, digests, reviewed).select("pick_id", "digest")


# ---- projections and models -------------------------------------------------------------------------


#: Each game with all earlier games of its player, by a plain join; mixture and scores from SQL's own aggregates.
EARLIER = """g AS (SELECT player_id, season, week, targets AS volume, rec_yards AS value, CASE WHEN targets > 0 AND rec_yards IS NOT NULL THEN rec_yards / targets END AS eff FROM fx_player_games),
h AS (SELECT t.player_id, t.season, t.week, t.value, e.volume AS v, e.eff, median(CASE WHEN e.volume > 0 THEN e.volume END) OVER (PARTITION BY t.player_id, t.season, t.week) AS typical FROM g t JOIN g e ON e.player_id = t.player_id AND (e.season < t.season OR (e.season = t.season AND e.week < t.week))),
"""
MIXED = """a{0} AS (SELECT player_id, season, week, any_value(value) AS value, count(*) AS games, count(*) FILTER (v >= line) AS n_ok, avg(v) FILTER (v >= line) AS v_ok, stddev_samp(v) FILTER (v >= line) AS s_ok, avg(v) AS v_all, stddev_samp(v) AS s_all, avg(v) FILTER (v < line) AS v_bust, count(eff) AS n_eff, avg(eff) AS e_own, stddev_samp(eff) AS e_sd
  FROM (SELECT *, greatest(1.0, coalesce(typical, 0.0) * {0}) AS line FROM h) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
b{0} AS (SELECT *, CASE WHEN n_ok > 0 THEN v_ok ELSE v_all END AS vm, CASE WHEN n_ok > 1 THEN s_ok WHEN n_ok = 1 THEN v_ok * 0.5 ELSE s_all END AS vs, CASE WHEN n_eff > 0 THEN (n_eff * e_own + 12.0 * 7.8) / (n_eff + 12.0) ELSE 7.8::DOUBLE END AS em, CASE WHEN n_eff > 1 THEN e_sd WHEN n_eff = 1 THEN e_own * 0.4 ELSE 7.8::DOUBLE * 0.45 END AS es FROM a{0})"""
PROJECTED = EARLIER + MIXED.format("0.35") + """,
p AS (SELECT player_id, season, week, value, games, vm * em AS mean, sqrt(greatest(vs * vs * es * es + vs * vs * em * em + es * es * vm * vm, 1e-9)) AS sd, least((games - n_ok + 6.0 * 0.12) / (games + 6.0), 0.45) AS p_bust, greatest(CASE WHEN games > n_ok THEN v_bust * em ELSE vm * em * 0.15 END, 0.3) AS bust_mean FROM "b0.35"),
q AS (SELECT *, p_bust * bust_mean + (1 - p_bust) * mean AS expected FROM p)""".replace('"b0.35"', "b035")
PROJECTED = PROJECTED.replace("a0.35", "a035").replace("b0.35", "b035")
#: The normal distribution by the same tabled formula.
PHI = "(CASE WHEN {0} >= 0 THEN 1.0 - {1} ELSE {1} END)"


def _phi(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / 1.4142135623730951))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2.0) / 2.0)"
    return PHI.format(z, tail)


def _lognormal(x: str, mean: str, sd: str) -> str:
    width = f"sqrt(ln(1.0 + ({sd}) ** 2 / ({mean}) ** 2))"
    return _phi(f"((ln({x}) - ln(({mean}) ** 2 / sqrt(({sd}) ** 2 + ({mean}) ** 2))) / {width})")


def _mixed(x: str, spread: str = "0.9") -> str:
    low = "greatest(bust_mean, 0.5)"
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE p_bust * {_lognormal(x, low, f'{low} * {spread}')} + (1 - p_bust) * {_lognormal(x, 'mean', 'sd')} END)"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return props.histories(props.stat_history(view(spark, d, "fx_player_games")))


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return props.project(_history(spark, d))


@query(f"WITH {PROJECTED} SELECT player_id, season, week, games, round(mean + 1e-9, 6) AS mean, round(sd, 5) AS sd, round(p_bust, 6) AS p_bust, round(bust_mean + 1e-9, 6) AS bust_mean, round(expected + 1e-9, 6) AS expected FROM q")
def projections(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).select("player_id", "season", "week", F.col("games").cast("long").alias("games"), *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "bust_mean", "expected")], r("sd", 5), r("p_bust"))


#: The line is where half of the mixture lies; the twin checks it from both sides, a tenth apart.
@query(f"""WITH {PROJECTED}, s AS (SELECT *, list_reduce(list_transform(range(60), lambda i: [i::DOUBLE]), lambda s, i: CASE WHEN {_mixed('((s[1] + s[2]) / 2.0)').replace('mean', 's[4]').replace('bust_s[4]', 's[6]').replace('sd', 's[3]').replace('p_bust', 's[5]')} < 0.5 THEN [(s[1] + s[2]) / 2.0, s[2], s[3], s[4], s[5], s[6]] ELSE [s[1], (s[1] + s[2]) / 2.0, s[3], s[4], s[5], s[6]] END, [0.0::DOUBLE, mean * 5.0 + 10.0, sd, mean, p_bust, bust_mean]) AS s FROM q)
SELECT player_id, season, week, round((s[1] + s[2]) / 2.0, 1) AS fair_line FROM s""")
def projected_lines(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).select("player_id", "season", "week", props.fair_line().alias("fair_line"))


SCORED = PROJECTED + """,
w AS (SELECT *, (value - expected) / sd AS z FROM q WHERE value IS NOT NULL AND expected >= 20.0),
cal AS (SELECT s.season, count(w.season) AS n, CASE WHEN count(w.season) >= 200 THEN avg(w.value - w.expected) ELSE 0.0 END AS bias, CASE WHEN count(w.season) >= 200 THEN stddev_pop(w.z) ELSE 1.0 END AS sd_scale FROM (SELECT DISTINCT season FROM q) s LEFT JOIN w ON w.season < s.season GROUP BY 1),
c AS (SELECT player_id, season, week, value, games, greatest(mean + bias, 0.1) AS mean, greatest(sd * sd_scale, 0.1) AS sd, p_bust, bust_mean FROM w JOIN cal USING (season)),
x AS (SELECT *, p_bust * bust_mean + (1 - p_bust) * mean AS expected FROM c)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    projected = written(_projected(spark, d))
    return written(props.score_projections(projected, props.fit_calibration(projected)))


@query(f"WITH {SCORED} SELECT season, n, round(bias, 6) AS bias, round(sd_scale, 6) AS sd_scale FROM cal")
def projection_calibration(spark: SparkSession, d: str) -> DataFrame:
    return props.fit_calibration(_projected(spark, d)).select("season", "n", r("bias"), r("sd_scale"))


@query(f"WITH {SCORED}, u AS (SELECT season, {_mixed('value')} AS pit FROM x), t AS (SELECT season, CASE {' '.join(f'WHEN pit >= {i / 10} THEN {i / 10}::DOUBLE' for i in range(9, -1, -1))} END AS tenth FROM u) SELECT season, tenth, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY season), 6) AS share FROM t GROUP BY 1, 2")
def projection_pit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pit_table(_scored(spark, d), "pit", "season").select("season", "tenth", "n", r("share"))


@query(f"""WITH {SCORED}, u AS (SELECT *, {_mixed('value')} AS pit FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY pit) AS i, count(*) OVER (PARTITION BY season) AS m FROM u)
SELECT season, count(*) AS n, round(avg(abs(value - expected)), 6) AS mae, round(avg(value - expected), 6) AS bias, round(corr(expected, value), 6) AS corr, round(avg(CASE WHEN abs(value - expected) <= sd THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_1sd, round(avg(CASE WHEN abs(value - expected) <= 2 * sd THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_2sd, round(stddev_pop((value - expected) / sd), 6) AS z_sd, round(avg(pit), 6) AS pit_mean, round(max(abs(pit - i::DOUBLE / m)), 6) AS ks FROM k GROUP BY 1""")
def projection_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    errors = metrics.forecast_errors(scored, "value", "expected", "sd", "over", "season").drop("over_rate")
    means = scored.groupBy("season").agg(F.avg("pit").alias("pit_mean"))
    rows = errors.join(means, "season").join(metrics.ks_uniform(scored, "pit", "season"), "season")
    return rows.select("season", "n", r("mae"), r("bias"), r("corr"), r("within_1sd"), r("within_2sd"), r("z_sd"), r("pit_mean"), F.round("ks_upper", 6).alias("ks"))


CELLS = ",\n".join(MIXED.format(c) for c in props.CUTS)
for _c in props.CUTS:
    CELLS = CELLS.replace(f"a{_c}", f"a{int(_c * 100):03d}").replace(f"b{_c}", f"b{int(_c * 100):03d}")
GRID = ",\n".join(
    f"""g{int(c * 100):03d} AS (SELECT {c}::DOUBLE AS cut, prior, spread, season, value, vm * em AS mean, sqrt(greatest(vs * vs * es * es + vs * vs * em * em + es * es * vm * vm, 1e-9)) AS sd, least((games - n_ok + 6.0 * prior) / (games + 6.0), 0.45) AS p_bust, greatest(CASE WHEN games > n_ok THEN v_bust * em ELSE vm * em * 0.15 END, 0.3) AS bust_mean
  FROM b{int(c * 100):03d}, (SELECT unnest({list(props.PRIORS)})::DOUBLE AS prior), (SELECT unnest({list(props.SPREADS)})::DOUBLE AS spread))"""
    for c in props.CUTS
)
TUNED = EARLIER + CELLS + ",\n" + GRID + f""",
u AS (SELECT *, {_mixed('value', 'spread')} AS pit, season >= 2025 AS held FROM ({' UNION ALL '.join(f'SELECT * FROM g{int(c * 100):03d}' for c in props.CUTS)}) WHERE value IS NOT NULL AND p_bust * bust_mean + (1 - p_bust) * mean >= 20.0),
k AS (SELECT *, row_number() OVER (PARTITION BY cut, prior, spread, held ORDER BY pit) AS i, count(*) OVER (PARTITION BY cut, prior, spread, held) AS m FROM u),
s AS (SELECT cut, prior, spread, held, count(*) AS n, max(abs(pit - i::DOUBLE / m)) AS ks FROM k GROUP BY 1, 2, 3, 4),
best AS (SELECT cut, prior, spread FROM s WHERE NOT held AND n >= 500 ORDER BY ks, cut, prior, spread LIMIT 1)"""


@query(f"WITH {TUNED} SELECT 'rec_yards' AS stat, cut, prior, spread, CASE WHEN held THEN 'held_out' ELSE 'train' END AS part, n, round(ks, 6) AS ks FROM s WHERE (NOT held AND n >= 500) OR (held AND (cut, prior, spread) IN (SELECT (cut, prior, spread) FROM best))")
def tuned_projections(spark: SparkSession, d: str) -> DataFrame:
    return props.tune(_history(spark, d), holdout_from=2025).withColumn("ks", F.round("ks", 6))


BUSTS = "wk AS (SELECT player_id, concat('T', CAST(CAST(substr(player_id, 2) AS INT) % 16 AS VARCHAR)) AS team, season, week, CAST(targets AS BIGINT) AS volume FROM fx_player_games), " + PANEL.replace("fx_usage", "wk") + ", " + FINAL.format("") + """,
sides AS (SELECT 2021 + game_id % 5 AS season, week, home_team AS team, 1 AS is_home, total_line / 2.0 + spread_line / 2.0 AS implied_total, abs(spread_line) AS abs_spread FROM fx_games UNION ALL SELECT 2021 + game_id % 5, week, away_team, 0, total_line / 2.0 - spread_line / 2.0, abs(spread_line) FROM fx_games),
ctx AS (SELECT season, week, team, max(is_home) AS is_home, max(implied_total) AS implied_total, max(abs_spread) AS abs_spread FROM sides GROUP BY 1, 2, 3)"""


def _busts(spark: SparkSession, d: str) -> DataFrame:
    weeks = view(spark, d, "fx_player_games").select("player_id", F.concat(F.lit("T"), (F.substring("player_id", 2, 9).cast("int") % 16).cast("string")).alias("team"), "season", "week", F.col("targets").cast("long").alias("volume"))
    games = view(spark, d, "fx_games").withColumn("season", (2021 + F.col("game_id") % 5).cast("int"))
    context = panel.team_game_context(games).groupBy("season", "week", "team").agg(*[F.max(c).alias(c) for c in availability.CONTEXT])
    return availability.bust_matrix(panel.trailing_form(panel.player_panel(weeks)), view(spark, d, "fx_reports"), context)


@query(f"""WITH {BUSTS} SELECT f.player_id, f.season, f.week, CASE WHEN fin.report_status = 'Questionable' THEN 1.0::DOUBLE ELSE 0 END AS report_questionable, CASE WHEN fin.report_status IS NULL OR fin.report_status NOT IN ('Doubtful', 'Questionable', 'Probable') THEN 1.0::DOUBLE ELSE 0 END AS report_none, CASE WHEN fin.practice_status LIKE 'Did Not%' THEN 1.0::DOUBLE ELSE 0 END AS practice_dnp,
  round(trail_mean, 6) AS trail_mean, round(last_week_vol / baseline_vol, 6) AS vol_vs_baseline, implied_total, CAST(is_home AS DOUBLE) AS is_home, CAST(bust AS DOUBLE) AS bust FROM form f LEFT JOIN fin ON fin.player_id = f.player_id AND fin.season = f.season AND fin.week = f.week JOIN ctx c ON c.season = f.season AND c.week = f.week AND c.team = f.team WHERE trail_n > 0 AND coalesce(fin.report_status, '') <> 'Out'""")
def bust_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _busts(spark, d).select("player_id", "season", "week", "report_questionable", "report_none", "practice_dnp", r("trail_mean"), r("vol_vs_baseline"), "implied_total", "is_home", "bust")


def _bust_model(spark: SparkSession, d: str) -> tuple:
    rows = written(_busts(spark, d))
    train, test = rows.filter(f"season <= {availability.TRAIN_MAX}"), rows.filter(f"season = {availability.DEV_SEASON}")
    return availability.fit(train), train, test


@query()
def bust_model(spark: SparkSession, d: str) -> DataFrame:
    """The development season by a model of the seasons before, beside its base rate."""
    return availability.evaluation(*_bust_model(spark, d)).select("n_train", "n_test", r("base_rate"), r("brier", 4), r("brier_baseline"), r("log_loss", 4), r("ece", 4), "beats_base")


@query()
def bust_importance(spark: SparkSession, d: str) -> DataFrame:
    model, _, test = _bust_model(spark, d)
    return availability.permutation_importance(model, test).select("feature", r("importance"))


@query(f"WITH {BUSTS}, x AS (SELECT f.*, c.implied_total, c.is_home FROM form f LEFT JOIN fin ON fin.player_id = f.player_id AND fin.season = f.season AND fin.week = f.week JOIN ctx c ON c.season = f.season AND c.week = f.week AND c.team = f.team WHERE trail_n > 0 AND coalesce(fin.report_status, '') <> 'Out') SELECT unnest(['trail_mean', 'trail_zero_rate', 'last_week_vol', 'implied_total', 'is_home']) AS feature, round(unnest([corr(trail_mean, bust), corr(trail_zero_rate, bust), corr(last_week_vol, bust), corr(implied_total, bust), corr(is_home, bust)]), 6) AS corr, false AS suspicious FROM x")
def bust_correlations(spark: SparkSession, d: str) -> DataFrame:
    return availability.closest_features(_busts(spark, d)).filter(F.col("feature").isin("trail_mean", "trail_zero_rate", "last_week_vol", "implied_total", "is_home")).withColumn("corr", F.round("corr", 6))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """Written once: every fold reads it several times."""
    rows = view(spark, d, "fx_forecasts")
    return written(rows.withColumn("x", F.pmod(F.xxhash64("row_id"), F.lit(100)) / 100.0).withColumn("y", F.col("y").cast("double")))


@query()
def walk_forward_logit(spark: SparkSession, d: str) -> DataFrame:
    scored = validate.walk_forward(_matrix(spark, d).withColumnRenamed("p", "market"), models.probability_model(["market", "x"], "y"))
    return validate.summary(scored, "y", "market").select("season", "n", r("brier"), r("market_brier"), r("accuracy"), "suspicious")


@query()
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _matrix(spark, d).withColumnRenamed("p", "market")
    return validate.leakage_report(rows, ["market", "x"], "y", models.probability_model(["market", "x"], "y")).select("name", r("value"), "limit", "passed")


@query()
def residual_cover(spark: SparkSession, d: str) -> DataFrame:
    plays = view(spark, d, "fx_plays").withColumn("residual", F.col("epa") * 5.0).withColumn("y", (F.col("epa") > 0).cast("double")).withColumn("is_pass", (F.col("play_class") == "pass").cast("double"))
    scored = validate.walk_forward(plays.select("season", "residual", "y", F.col("down").cast("double").alias("down"), F.col("yardline_100").cast("double").alias("yardline_100"), "is_pass"), models.residual_model(["down", "yardline_100", "is_pass"], "residual", models.SD["spread"], linear=True))
    return metrics.binary_metrics(scored, "y", "p", "season").select("season", "n", r("brier", 4))




@query()
def practice_two_arm(spark: SparkSession, d: str) -> DataFrame:
    """What a second feature adds to the first, by season, walking forward."""
    rows = view(spark, d, "fx_forecasts").withColumn("y", F.col("y").cast("double")).withColumn("extra", F.pmod(F.col("row_id"), F.lit(7)) / 7.0)
    return models.two_arm(rows.withColumnRenamed("p", "base"), ["extra"], ["base"], "y", least_train=4).select("season", r("auc_base"), r("auc_full"), r("auc_gain"))
