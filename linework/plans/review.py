"""Registered queries of reviews, severity, blending and kickoff slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds
from ..operators import board, grading, ops, panel
from ..sources.fixtures import view, with_views
from .market import AS_OF, r

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, with_views(oracle)
        return f

    return add


@query("SELECT CASE WHEN kickoff_utc IS NULL OR hour(kickoff_utc) < 17 THEN 'early' WHEN hour(kickoff_utc) < 21 THEN 'late' ELSE 'primetime' END AS slot, season, count(*) AS n FROM (SELECT season, kickoff_utc + INTERVAL '1' HOUR * (game_id % 24) AS kickoff_utc FROM fx_games) GROUP BY ALL")
def kickoff_slots(spark: SparkSession, d: str) -> DataFrame:
    games = view(spark, d, "fx_games").withColumn("kickoff_utc", F.expr("kickoff_utc + make_interval(0, 0, 0, 0, cast(game_id % 24 as int), 0, 0)"))
    return games.groupBy(panel.kickoff_slot(F.col("kickoff_utc")).alias("slot"), "season").agg(F.count(F.lit(1)).alias("n"))


IMPLIED = "CASE WHEN price > 0 THEN 100.0 / (price + 100.0) ELSE -price / (100.0 - price) END"


@query(f"WITH p AS (SELECT pick_id, fair_prob, {IMPLIED} AS market FROM fx_picks) SELECT pick_id, round(1.0 / (1.0 + exp(-(0.3 * ln(fair_prob / (1 - fair_prob)) + 0.7 * ln(market / (1 - market))))), 6) AS blended FROM p")
def blended_probabilities(spark: SparkSession, d: str) -> DataFrame:
    market = 1.0 / odds.decimal_odds(F.col("price"))
    return view(spark, d, "fx_picks").withColumn("blended", odds.blend(F.col("fair_prob"), market, F.lit(0.3))).select("pick_id", r("blended"))


@query("SELECT report_id, player_id, severity FROM (SELECT report_id, player_id, CASE report_status WHEN 'Out' THEN 0 WHEN 'Doubtful' THEN 1 WHEN 'Questionable' THEN 2 ELSE 3 END AS severity FROM fx_reports) ORDER BY severity, player_id, report_id LIMIT 25")
def gravest_reports(spark: SparkSession, d: str) -> DataFrame:
    return board.by_severity(view(spark, d, "fx_reports")).select("report_id", "player_id", "severity")


VERDICTS = "v AS (SELECT *, CASE tier WHEN 'A' THEN 'OK' WHEN 'B' THEN 'FLAG' ELSE CASE WHEN published = 1 THEN 'KILL' END END AS verdict FROM fx_picks)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    tier = F.col("tier")
    return view(spark, d, "fx_picks").withColumn("verdict", F.when(tier == "A", "OK").when(tier == "B", "FLAG").when(F.col("published") == 1, "KILL"))


@query(f"WITH {VERDICTS} SELECT pick_id, round(edge_pct, 6) AS edge_pct FROM v LEFT JOIN fx_games g USING (game_id) WHERE coalesce(verdict, '') IN ('OK', '') AND (kickoff_utc IS NULL OR kickoff_utc > TIMESTAMP '{AS_OF}') ORDER BY v.edge_pct DESC NULLS LAST, pick_id LIMIT 60")
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    pending = _verdicts(spark, d).withColumn("result", F.lit("pending"))
    return board.review_candidates(pending, view(spark, d, "fx_games"), AS_OF).select("pick_id", r("edge_pct"))


@query(f"WITH {VERDICTS} SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 9) AS share FROM v GROUP BY 1")
def verdict_shares(spark: SparkSession, d: str) -> DataFrame:
    return ops.review_summary(_verdicts(spark, d)).select("verdict", "n", r("share", 9))


@query(f"WITH {VERDICTS}, e AS (SELECT game_id AS case_id, CASE WHEN game_id % 2 = 0 THEN ['OK'] ELSE ['OK', 'KILL'] END AS expected, verdict FROM v) SELECT case_id, count(verdict) AS answers, CAST(sum(CASE WHEN list_contains(expected, verdict) THEN 1 ELSE 0 END) AS BIGINT) AS passes, CAST(sum(CASE WHEN verdict = 'KILL' AND NOT list_contains(expected, 'KILL') THEN 1 ELSE 0 END) AS BIGINT) AS false_kills, count(DISTINCT verdict) > 1 AS unstable FROM e GROUP BY 1")
def golden_case_scores(spark: SparkSession, d: str) -> DataFrame:
    verdicts = _verdicts(spark, d).select(F.col("game_id").alias("case_id"), "verdict")
    expected = F.when(F.col("case_id") % 2 == 0, F.array(F.lit("OK"))).otherwise(F.array(F.lit("OK"), F.lit("KILL")))
    return ops.golden_scores(verdicts.select("case_id").distinct().withColumn("expected", expected), verdicts)


@query("SELECT regexp_replace(regexp_replace(concat('quote ', pick_id, ' of ''', side, ''' lacks ', market_type), '''[^'']*''', '''*''', 'g'), '\\d+', '#', 'g') AS message, count(*) AS n FROM fx_picks GROUP BY 1 ORDER BY n DESC, message LIMIT 3")
def frequent_errors(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat(F.lit("quote "), F.col("pick_id").cast("string"), F.lit(" of '"), F.col("side"), F.lit("' lacks "), F.col("market_type"))
    return ops.error_summary(view(spark, d, "fx_picks").select(message.alias("message")))


NOW = "2024-01-20 00:00:00"


@query(f"""WITH ok AS (SELECT count(*) AS reviews FROM fx_runs WHERE status = 'ok' AND source = 'manual' AND finished_at <= TIMESTAMP '{NOW}' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(finished_at)) <= 21600), made AS (SELECT count(*) AS calls FROM fx_runs WHERE finished_at <= TIMESTAMP '{NOW}' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(finished_at)) <= 21600),
judged AS (SELECT *, CASE tier WHEN 'A' THEN 'OK' WHEN 'B' THEN 'FLAG' ELSE '' END AS ai_verdict, CASE WHEN pick_id % 3 > 0 THEN 'seen' END AS review_hash, CASE WHEN pick_id % 4 = 0 THEN 'win' ELSE 'pending' END AS result FROM fx_picks),
missed AS (SELECT count(*) AS n FROM judged LEFT JOIN (SELECT game_id, kickoff_utc + INTERVAL '8207' DAY AS kickoff_utc FROM fx_games) g USING (game_id) WHERE result = 'pending' AND published = 1 AND review_hash IS NULL AND ai_verdict IN ('OK', '') AND (kickoff_utc IS NULL OR kickoff_utc > TIMESTAMP '{NOW}')) SELECT reviews, calls, CASE WHEN reviews > 0 THEN n ELSE 0 END AS unreviewed FROM ok, made, missed""")
def review_coverage(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "fx_runs")
    verdict = F.when(F.col("tier") == "A", "OK").when(F.col("tier") == "B", "FLAG")
    judged = view(spark, d, "fx_picks").withColumns({"verdict": verdict, "review_hash": F.when(F.col("pick_id") % 3 > 0, "seen"), "result": F.when(F.col("pick_id") % 4 == 0, "win").otherwise("pending")})
    games = view(spark, d, "fx_games").withColumn("kickoff_utc", F.expr("kickoff_utc + INTERVAL '8207' DAY"))
    return board.review_coverage(runs.filter("source = 'manual'"), judged, games, runs.select(F.col("finished_at").alias("at")), NOW)


@query("SELECT game_id FROM fx_games WHERE kickoff_utc > TIMESTAMP '2001-08-01 12:00:00' AND CAST((kickoff_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) = DATE '2001-08-01'")
def games_today(spark: SparkSession, d: str) -> DataFrame:
    return board.games_today(view(spark, d, "fx_games"), "2001-08-01 12:00:00").select("game_id")


@query("""WITH pk AS (SELECT report_id AS pick_id, player_id, season, week, CASE position WHEN 'QB' THEN 'yards' WHEN 'S' THEN 'touchdowns' ELSE 'volume' END AS stat, CASE WHEN report_status = 'Out' THEN 'under' ELSE 'over' END AS side, position = 'TE' AS one_sided, CASE position WHEN 'QB' THEN 500.0::DOUBLE ELSE 1.0::DOUBLE END AS line FROM fx_reports),
st AS (SELECT player_id, season, week, 'yards' AS stat, CAST(yards AS DOUBLE) AS v FROM fx_usage UNION ALL SELECT player_id, season, week, 'volume', CAST(volume AS DOUBLE) FROM fx_usage),
g AS (SELECT pick_id, CASE WHEN v IS NULL THEN 'pending' WHEN one_sided THEN CASE WHEN (side = 'over') = (v >= 1) THEN 'win' ELSE 'loss' END WHEN abs(v - line) < 1e-9 THEN 'push' WHEN (side = 'over') = (v > line) THEN 'win' ELSE 'loss' END AS result FROM pk LEFT JOIN st USING (player_id, season, week, stat))
SELECT pick_id, result, CASE result WHEN 'win' THEN 2.2::DOUBLE WHEN 'loss' THEN -2.0 ELSE 0.0 END AS profit FROM g""")
def graded_props(spark: SparkSession, d: str) -> DataFrame:
    position = F.col("position")
    stat = F.when(position == "QB", "yards").when(position == "S", "touchdowns").otherwise("volume")
    side = F.when(F.col("report_status") == "Out", "under").otherwise("over")
    props = view(spark, d, "fx_reports").select(
        F.col("report_id").alias("pick_id"), "player_id", "season", "week", stat.alias("stat"), side.alias("side"), (position == "TE").alias("one_sided"),
        F.when(position == "QB", 500.0).otherwise(1.0).alias("line"), F.lit(110).alias("price"), F.lit(2.0).alias("stake"))
    usage = view(spark, d, "fx_usage")
    long = [usage.select("player_id", "season", "week", F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in ("yards", "volume")]
    return grading.grade_props(props, long[0].unionByName(long[1])).select("pick_id", "result", r("profit"))
