"""Market and research inputs derived from the given tables, as SQL that both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BLOCKS: dict[str, str] = {}


def _block(name: str, sql: str) -> None:
    _BLOCKS[name] = sql.strip()


_block(
    "fx_quote_obs",
    """
SELECT game_id, market_type, '' AS player_id, side,
       CASE WHEN market_type='h2h' THEN CAST(0 AS DOUBLE) WHEN side='away' THEN -base_line ELSE base_line END AS line,
       concat('book', CAST(book_no AS VARCHAR(4))) AS book,
       CAST(CASE WHEN raw>=0.5 THEN -floor(100*raw/(1-raw)+0.5) ELSE floor(100*(1-raw)/raw+0.5) END AS INT) AS price,
       observed_at, seq
FROM (
 SELECT *, CASE WHEN broken=1 THEN 0.99 ELSE (CASE WHEN side IN ('home','over') THEN p0 ELSE 1-p0 END)*1.045 + noise END AS raw
 FROM (
  SELECT game_id,
   CASE l_returnflag WHEN 'A' THEN 'h2h' WHEN 'N' THEN 'spreads' ELSE 'totals' END AS market_type,
   CASE WHEN l_returnflag='R' THEN (CASE WHEN l_linestatus='O' THEN 'over' ELSE 'under' END) ELSE (CASE WHEN l_linestatus='O' THEN 'home' ELSE 'away' END) END AS side,
   l_suppkey%23 AS book_no,
   -(CAST(game_id % 7 AS DOUBLE) + 0.5 * CAST(CASE WHEN (l_suppkey%23)%5=0 THEN 1 ELSE 0 END AS DOUBLE) + 0.5) * (CASE WHEN l_returnflag='R' THEN -7.0 ELSE 1.0 END) AS base_line,
   0.35 + 0.30*((game_id*37)%100)/100.0 AS p0,
   (CAST(l_quantity AS INT)%7 - 3)*0.004 AS noise,
   CASE WHEN (l_suppkey%23)=7 AND game_id%11=0 THEN 1 ELSE 0 END AS broken,
   l_shipdate AS observed_at, l_orderkey*10+l_linenumber AS seq
  FROM (SELECT *, CAST(floor(l_partkey/10) AS BIGINT) AS game_id FROM lineitem) l) a ) b
""",
)

_block(
    "fx_games",
    """
SELECT game_id, 1995 + game_id%7 AS season, 1 + game_id%18 AS week,
  concat('T',CAST(game_id%16 AS VARCHAR(2))) AS home_team, concat('T',CAST((game_id+1+(game_id*5)%15)%16 AS VARCHAR(2))) AS away_team,
  CASE WHEN game_id%29=0 THEN NULL ELSE CAST('2001-05-01 17:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST((game_id*37)%211 AS INT) END AS kickoff_utc,
  CAST((game_id*13)%41 AS INT) AS home_score, CAST((game_id*29)%38 AS INT) AS away_score,
  CAST(game_id%7 AS DOUBLE) + 0.5 AS spread_line, 40.0 + CAST(game_id%9 AS DOUBLE) AS total_line
FROM (SELECT DISTINCT CAST(floor(l_partkey/10) AS BIGINT) AS game_id FROM lineitem) g
""",
)

_block(
    "fx_grounds",
    """
SELECT game_id, CASE game_id%8 WHEN 0 THEN 'dome' WHEN 1 THEN 'Closed' WHEN 2 THEN 'retractable' WHEN 3 THEN NULL ELSE 'outdoors' END AS roof, CASE WHEN game_id%3=0 THEN 1 ELSE 0 END AS div_game
FROM (SELECT DISTINCT CAST(floor(l_partkey/10) AS BIGINT) AS game_id FROM lineitem) g
""",
)

_block(
    "fx_weather",
    """
SELECT l_orderkey*10+l_linenumber AS reading_id, CAST(floor(l_partkey/10) AS BIGINT) AS game_id, CAST('2001-04-20 05:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST((l_orderkey*7)%230 AS INT) AS knowledge_time,
  CAST(l_quantity AS DOUBLE) - 12.0 AS temp_c, CAST(l_linenumber*6 AS DOUBLE) AS wind_kph, CASE WHEN l_linenumber=4 THEN NULL ELSE CAST(l_linenumber*9 AS DOUBLE) END AS gust_kph, CASE WHEN l_linestatus='O' THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE)/2.0 END AS precip_mm
FROM lineitem
""",
)

_block(
    "fx_fields",
    """
SELECT market_id, concat('book', CAST(book_no AS VARCHAR(4))) AS book, concat('s', CAST(side_no AS VARCHAR(4))) AS side,
  CAST(CASE WHEN raw >= 0.5 THEN -floor(100*raw/(1-raw)+0.5) ELSE floor(100*(1-raw)/raw+0.5) END AS INT) AS price
FROM (
 SELECT market_id, book_no, side_no, least(0.97, greatest(0.004, (quantity + (book_no*side_no)%5) / (total + 2.0*n) * (0.98 + 0.03*CAST((market_id + book_no)%7 AS DOUBLE)))) AS raw
 FROM (SELECT l_orderkey AS market_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS side_no, CAST(l_quantity AS DOUBLE) AS quantity,
   sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS total, CAST(count(*) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS n FROM lineitem) f
 CROSS JOIN (SELECT 1 AS book_no UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 6) b) o
WHERE NOT (book_no = 4 AND side_no = 3 AND market_id % 5 = 0)
""",
)

_block(
    "fx_plays",
    """
SELECT seq AS play_id, season, week, season*10000+week*100+least(off_no,(2*week+65-off_no)%16) AS game_id,
  concat('T',CAST(off_no AS VARCHAR(2))) AS offense, concat('T',CAST((2*week+65-off_no)%16 AS VARCHAR(2))) AS defense,
  play_class, epa, CASE WHEN epa>0 THEN 1 ELSE 0 END AS success, down, yardline_100, air_yards, player_id
FROM (SELECT l_orderkey*10+l_linenumber AS seq, CAST(year(l_shipdate) AS INT) AS season,
  CAST(floor((dayofyear(l_shipdate)-1)/21.0) AS INT)+1 AS week, l_suppkey%16 AS off_no,
  CASE WHEN l_linestatus='O' THEN 'pass' ELSE 'rush' END AS play_class,
  (l_discount-0.05)*20 + (l_suppkey%16-7.5)*0.02 AS epa, 1+l_linenumber%4 AS down, CAST(l_quantity*2 AS INT) AS yardline_100,
  CASE WHEN l_linestatus='O' THEN CAST(l_quantity-10 AS INT) END AS air_yards, concat('P',CAST(l_partkey%300 AS VARCHAR(4))) AS player_id FROM lineitem) p
""",
)

_block(
    "fx_reports",
    """
SELECT event_id AS report_id, concat('P',CAST(user_id AS VARCHAR(6))) AS player_id, concat('T',CAST(user_id%16 AS VARCHAR(2))) AS team,
  2024 AS season, 1 + CAST(floor((dayofmonth(ts)-1)/2.0) AS INT) AS week,
  CASE event_type WHEN 'error' THEN 'Out' WHEN 'click' THEN 'Questionable' WHEN 'view' THEN NULL ELSE 'Doubtful' END AS report_status,
  CASE CAST(floor(value) AS INT)%4 WHEN 0 THEN 'Did Not Participate In Practice' WHEN 1 THEN 'Limited Participation in Practice' WHEN 2 THEN 'Full Participation in Practice' ELSE NULL END AS practice_status,
  CASE WHEN event_id%15=0 THEN 'REG' ELSE NULL END AS season_type,
  CASE user_id%5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'S' END AS position, ts AS knowledge_time
FROM events
""",
)

_block(
    "fx_usage",
    """
SELECT concat('P',CAST(user_id AS VARCHAR(6))) AS player_id, concat('T',CAST(user_id%16 AS VARCHAR(2))) AS team, 2024 AS season,
  1 + CAST(floor((dayofmonth(ts)-1)/2.0) AS INT) AS week, count(*) AS volume, round(sum(value),2) AS yards, round(avg(value)/500.0,6) AS snap_pct
FROM events GROUP BY 1,2,3,4
""",
)

_block(
    "fx_player_games",
    """
SELECT player_id, season, week, CAST(sum(units) AS DOUBLE) AS targets, CASE WHEN max(event_id) % 19 = 0 THEN NULL ELSE floor(sum(units * (500.0 + value * 10.0)) + 0.45) / 100.0 END AS rec_yards
FROM (SELECT event_id, value, concat('P',CAST(user_id % 400 AS VARCHAR(6))) AS player_id, 2021 + CAST(floor(event_id / 7) AS INT) % 5 AS season, 1 + CAST(floor((dayofmonth(ts)-1)/2.0) AS INT) AS week,
  CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 1 ELSE 4 + CAST(floor(value) AS INT) % 7 END AS units FROM events) e
GROUP BY 1,2,3
""",
)

_block(
    "fx_injuries",
    """
SELECT event_id AS report_id, concat('P',CAST(user_id AS VARCHAR(6))) AS player_id, 2015 + CAST(event_id % 7 AS INT) AS season, 1 + CAST(floor((dayofmonth(ts)-1)/2.0) AS INT) AS week,
  CASE event_type WHEN 'error' THEN 'Out' WHEN 'click' THEN 'Questionable' WHEN 'view' THEN NULL ELSE 'Doubtful' END AS report_status,
  CASE CAST(floor(value) AS INT)%4 WHEN 0 THEN 'Did Not Participate In Practice' WHEN 1 THEN 'Limited Participation in Practice' WHEN 2 THEN ' Full Participation in Practice' ELSE NULL END AS practice_status,
  CASE WHEN event_id%15=0 THEN 'REG' WHEN event_id%41=0 THEN 'POST' ELSE NULL END AS season_type,
  CASE user_id%5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'S' END AS position, ts AS knowledge_time
FROM events
""",
)

_block(
    "fx_snaps",
    """
SELECT concat('pfr',CAST(user_id AS VARCHAR(6))) AS source_id, 2015 + CAST(event_id % 7 AS INT) AS season, 1 + CAST(floor((dayofmonth(ts)-1)/2.0) AS INT) AS week, max((1.0 + CAST(event_id % 64 AS DOUBLE)) / 64.0) AS snap_pct, sum(CAST(event_id % 9 AS DOUBLE)) / 64.0 AS usage_share
FROM events WHERE event_id % 7 > 0 AND (CAST(floor(value) AS INT)%4 <> 0 OR event_id % 5 = 0) GROUP BY 1,2,3
""",
)

_block(
    "fx_forecasts",
    """
SELECT l_orderkey*10+l_linenumber AS row_id, CAST(year(l_shipdate) AS INT) AS season, (CAST(l_quantity AS DOUBLE)-1)/49.0 AS p,
  CASE WHEN (l_partkey*31+l_suppkey*17)%50 < l_quantity THEN 1 ELSE 0 END AS y FROM lineitem
""",
)


_block(
    "fx_picks",
    """
SELECT o_orderkey AS pick_id, CAST(floor(o_orderkey/75) AS BIGINT) AS game_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'h2h' WHEN 1 THEN 'spreads' ELSE 'totals' END AS market_type,
  CASE WHEN o_orderkey % 3 = 2 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'over' ELSE 'under' END) ELSE (CASE WHEN o_custkey % 2 = 0 THEN 'home' ELSE 'away' END) END AS side,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(o_custkey % 15 AS DOUBLE) - 7.0 ELSE 30.0 + CAST(o_custkey % 30 AS DOUBLE) END AS line,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(100 + o_custkey % 150 AS INT) ELSE -CAST(100 + o_custkey % 150 AS INT) END AS price,
  0.5 + 0.25 * CAST(o_orderkey % 8 AS DOUBLE) AS stake,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' ELSE 'C' END AS tier,
  CAST(o_custkey % 100 AS DOUBLE) / 10.0 AS edge_pct, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END AS demo, 0.35 + CAST(o_custkey % 30 AS DOUBLE) / 100.0 AS fair_prob,
  CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS published
FROM orders
""",
)

_block(
    "fx_players",
    """
SELECT concat('P', CAST(c_custkey AS VARCHAR(10))) AS player_id,
  concat(CASE c_custkey % 4 WHEN 0 THEN 'D.K. Smith' WHEN 1 THEN 'Brian O''Neil' WHEN 2 THEN 'A.J. Brown Jr.' ELSE 'Marvin Jones III' END, ' ', c_mktsegment, CAST(c_custkey % 700 AS VARCHAR(10))) AS player_name,
  concat('T', CAST(c_nationkey % 16 AS VARCHAR(2))) AS team
FROM customer
""",
)

_block(
    "fx_runs",
    """
SELECT event_id AS run_id, concat('job', CAST(user_id % 12 AS VARCHAR(2))) AS job_name,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(ts AS TIMESTAMP) AS finished_at, CAST(floor(value) AS BIGINT) AS credits,
  CASE WHEN user_id % 9 = 0 THEN 'manual' ELSE 'scheduler' END AS source
FROM events
""",
)


_block(
    "fx_bets",
    """
SELECT o_orderkey AS bet_id, concat('u', CAST(o_custkey % 50 AS VARCHAR(4))) AS user_id, o_orderkey AS pick_id,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(95 + o_custkey % 150 AS INT) ELSE -CAST(105 + o_custkey % 150 AS INT) END AS price,
  1.0 + 0.5 * CAST(o_custkey % 3 AS DOUBLE) AS stake
FROM orders
""",
)


def names() -> list[str]:
    return list(_BLOCKS)


def sql(name: str) -> str:
    """The view as SQL over the given tables."""
    return _BLOCKS[name]


#: The tables that each view reads.
_TABLES = ("lineitem", "events", "orders", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _BLOCKS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **used)


def with_views(select: str) -> str:
    """A DuckDB statement: the views that ``select`` names, as common table expressions, before it."""
    used = [f"{name} AS ({text})" for name, text in _BLOCKS.items() if name in select]
    select = select.strip()
    if not used:
        return select
    head = "WITH " + ", ".join(used)
    return f"{head}, {select[5:]}" if select.upper().startswith("WITH ") else f"{head} {select}"
