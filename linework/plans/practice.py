"""Registered queries of the practice reports: their panel, its coverage, and what practice adds to the status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import practice
from ..sources.cuts import written
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


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    """Snaps are known by another id, which the crosswalk has for all players but one in eleven."""
    snaps, reports = view(spark, d, "fx_snaps"), view(spark, d, "fx_injuries")
    number = F.regexp_extract("source_id", r"(\d+)", 1)
    usage = snaps.select(F.concat(F.lit("P"), number).alias("player_id"), "season", "week", "usage_share")
    crosswalk = snaps.select("source_id").distinct().filter(number.cast("int") % 11 != 10).select("source_id", F.concat(F.lit("P"), number).alias("player_id"))
    return practice.reported_weeks(reports, usage, snaps.drop("usage_share"), crosswalk)


WEEKS = """fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season, week ORDER BY knowledge_time DESC, report_id DESC) AS rn FROM fx_injuries WHERE season_type IS NULL OR season_type = 'REG') WHERE rn = 1 AND position <> 'S'),
sp AS (SELECT concat('P', substr(source_id, 4)) AS player_id, season, week, snap_pct, usage_share, CAST(substr(source_id, 4) AS INT) % 11 <> 10 AS known FROM fx_snaps),
wk AS (SELECT report_id, f.player_id, f.season, f.week, position, report_status, CASE WHEN practice_status LIKE '%Full%' THEN 'full' WHEN practice_status LIKE '%Limited%' THEN 'limited' WHEN practice_status LIKE '%Not%' THEN 'none' END AS practice, coalesce(usage_share, 0.0) AS usage_share, CASE WHEN known THEN snap_pct END AS snap_pct FROM fi f LEFT JOIN sp s ON s.player_id = f.player_id AND s.season = f.season AND s.week = f.week)"""
PANEL = WEEKS + """,
era AS (SELECT min(season) AS first FROM wk WHERE snap_pct IS NOT NULL), sh AS (SELECT avg(CASE WHEN snap_pct IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS share FROM wk, era WHERE season >= first),
ac AS (SELECT wk.*, CASE WHEN share > 0.5 THEN coalesce(snap_pct, 0) > 0 ELSE usage_share > 0 END AS active FROM wk, era, sh WHERE share <= 0.5 OR season >= first),
fo AS (SELECT *, avg(usage_share) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_usage_3, avg(usage_share) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS prior_usage_8, avg(CAST(active AS INT)) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_active_3 FROM ac WINDOW w AS (PARTITION BY player_id ORDER BY season, week))"""
_FLAGS = {f"pos_{p.lower()}": f"position = '{p}'" for p in practice.POSITIONS} | {f"status_{s.lower()}": f"report_status = '{s}'" for s in practice.STATUSES} | {"status_none": "report_status IS NULL"} | {f"practice_{p}": f"practice = '{p}'" for p in practice.PRACTICES} | {"practice_missing": "practice IS NULL"}


@query(f"WITH {WEEKS} SELECT report_id, player_id, season, week, practice, round(usage_share, 6) AS usage_share, round(snap_pct, 6) AS snap_pct FROM wk")
def reported_weeks(spark: SparkSession, d: str) -> DataFrame:
    return _weeks(spark, d).select("report_id", "player_id", "season", "week", "practice", r("usage_share"), r("snap_pct"))


@query(f"""WITH {WEEKS}, era AS (SELECT min(season) AS first FROM wk WHERE snap_pct IS NOT NULL), one AS (SELECT avg(CASE WHEN practice IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS a, count(DISTINCT practice)::DOUBLE AS b, avg(CASE WHEN season < first THEN NULL WHEN snap_pct IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS c FROM wk, era)
SELECT name, round(value, 6) AS value, value >= least AS passed FROM (SELECT 'practice_understood' AS name, a AS value, 0.5 AS least FROM one UNION ALL SELECT 'practice_kinds', b, 2 FROM one UNION ALL SELECT 'snaps_in_era', c, 0.5 FROM one)""")
def practice_coverage(spark: SparkSession, d: str) -> DataFrame:
    return practice.coverage(_weeks(spark, d)).select("name", r("value"), "passed")


@query(f"WITH {PANEL} SELECT report_id, player_id, season, week, CAST(active AS INT) AS active, round(prior_usage_3, 6) AS prior_usage_3, round(prior_usage_8, 6) AS prior_usage_8, round(prior_active_3, 6) AS prior_active_3, {', '.join(f'CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END AS {k}' for k, c in _FLAGS.items())} FROM fo WHERE prior_usage_3 IS NOT NULL")
def practice_panel(spark: SparkSession, d: str) -> DataFrame:
    return practice.practice_panel(_weeks(spark, d)).select("report_id", "player_id", "season", "week", "active", *[r(c) for c in practice.FORM], *_FLAGS)


@query()
def practice_signal(spark: SparkSession, d: str) -> DataFrame:
    """By season what practice adds to the chance to play and to the usage of those who do, for all and for those listed Questionable."""
    panel = written(practice.practice_panel(_weeks(spark, d)))
    parts = []
    for name, rows in (("all", panel), ("questionable", panel.filter("report_status = 'Questionable'"))):
        gain = practice.practice_gain(practice.practice_signal(rows, least_test=20))
        parts.append(gain.select(F.lit(name).alias("subset"), "season", "n", *[r(c, 4) for c in ("d_brier", "d_log_loss", "d_auc", "d_usage_mae")], "helped"))
    return parts[0].unionByName(parts[1])
