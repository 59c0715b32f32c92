"""Operations: job health, alerts, budgets, due polls, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import grounded


def last_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each job."""
    return runs.groupBy("job_name").agg(F.max_by(F.struct("status", "finished_at", "run_id"), F.struct("finished_at", "run_id")).alias("r")).select("job_name", "r.*")


def staleness(runs: DataFrame, expected: DataFrame, as_of: str) -> DataFrame:
    """Each expected job (job_name, max_age_min): never_run, failed, stale or ok at ``as_of``."""
    met = expected.join(last_runs(runs.filter(F.col("finished_at") <= F.lit(as_of).cast("timestamp"))), "job_name", "left")
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.col("finished_at").cast("double")) / 60.0
    state = F.when(F.col("finished_at").isNull(), "never_run").when(F.col("status") != "ok", "failed").when(age > F.col("max_age_min"), "stale").otherwise("ok")
    return met.withColumn("age_min", age).withColumn("state", state)


def alert_transitions(states: DataFrame) -> DataFrame:
    """Rows of (alert_key, at, seq, firing) where firing flips; before the first it is off.

    Each day of a key is ordered by itself; only the last state of every day is carried over.
    """
    rows = states.withColumn("_day", F.col("at").cast("date"))
    own = rows.withColumn("_own", F.lag(F.struct("firing")).over(Window.partitionBy("alert_key", "_day").orderBy("at", "seq")))
    ends = rows.groupBy("alert_key", "_day").agg(F.max_by(F.struct("firing"), F.struct("at", "seq")).alias("_end"))
    carried = ends.select(F.col("alert_key").alias("_key"), F.col("_day").alias("_on"), F.lag("_end").over(Window.partitionBy("alert_key").orderBy("_day")).alias("_carried"))
    met = own.join(carried, F.col("alert_key").eqNullSafe(F.col("_key")) & F.col("_day").eqNullSafe(F.col("_on")))
    last = F.coalesce("_own", "_carried")
    was = F.when(last.isNull(), False).otherwise(last["firing"])
    return met.filter(was != F.col("firing")).withColumn("event", F.when(F.col("firing"), "broke").otherwise("recovered")).select(*states.columns, "event")


def allowed_sources(remaining_pct: Column) -> Column:
    """What the budget still allows: all, no_props, featured or none; bounds are strict."""
    return F.when(remaining_pct > 30, "all").when(remaining_pct > 15, "no_props").when(remaining_pct > 5, "featured").otherwise("none")


def budget_state(ledger: DataFrame, as_of: str, monthly: float) -> DataFrame:
    """Credits of the month and day of ``as_of``, by source kind, what is left, and what that allows."""
    now = F.lit(as_of).cast("timestamp")
    month = (F.date_trunc("month", "finished_at") == F.date_trunc("month", now)) & (F.col("finished_at") <= now)
    day = (F.date_trunc("day", "finished_at") == F.date_trunc("day", now)) & (F.col("finished_at") <= now)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("credits"))), F.lit(0))
    out = ledger.agg(part(month).alias("month_credits"), part(day).alias("day_credits"), part(month & (F.col("source") == "manual")).alias("manual_credits"))
    out = out.withColumn("remaining_pct", F.greatest(F.lit(0.0), (1.0 - F.col("month_credits") / monthly) * 100.0))
    return out.withColumn("allowed", allowed_sources(F.col("remaining_pct")))


def usage_by_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.to_date("finished_at").alias("day"), "source").agg(F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("calls"))


# Minutes between polls by hours to kickoff (inclusive upper bounds), and cost of a sweep.
POLL_TIERS = {
    "featured": {2: 5, 12: 10, 72: 30, 240: 60, 720: 360, 100_000: 720},
    "period": {2: 60, 12: 180, 72: 720},
    "props": {2: 20, 12: 60, 72: 360},
}


def interval_minutes(hours: Column, tier: str) -> Column:
    out = F.lit(None).cast("int")
    for bound, minutes in sorted(POLL_TIERS[tier].items(), reverse=True):
        out = F.when(hours <= bound, minutes).otherwise(out)
    return out


def due_polls(games: DataFrame, last_polls: DataFrame, as_of: str) -> DataFrame:
    """Each tier (tier, last_at) with its interval by the next kickoff after ``as_of``, and whether it is due."""
    now = F.lit(as_of).cast("timestamp")
    nearest = games.filter(F.col("kickoff_utc") > now).agg(F.min("kickoff_utc").alias("next_at"))
    met = last_polls.join(F.broadcast(nearest))
    hours = (F.unix_timestamp("next_at") - F.unix_timestamp(now)) / 3600.0
    every = F.lit(None).cast("int")
    for tier in POLL_TIERS:
        every = F.when(F.col("tier") == tier, interval_minutes(hours, tier)).otherwise(every)
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_at")) / 60.0
    return met.withColumn("every_min", every).withColumn("due", F.coalesce(every.isNotNull() & (F.col("last_at").isNull() | (age >= every)), F.lit(False)))


# ---- reviews ---------------------------------------------------------------------------------------


def review_digest(picks: DataFrame, facts: DataFrame) -> DataFrame:
    """(pick_id, digest): SHA-256 over a pick's banded edge and the sorted facts of its game.

    ``facts`` is (game_id, fact). A change within a band, or of the order, changes nothing.
    """
    known = facts.groupBy("game_id").agg(F.sort_array(F.collect_set("fact")).alias("facts"))
    met = picks.join(known, "game_id", "left")
    body = F.to_json(F.struct("market_type", "side", F.format_number("line", 1).alias("line"), F.floor(F.col("edge_pct") / 2.0).alias("band"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts")))
    return met.select("pick_id", F.sha2(body, 256).alias("digest"))


def review_queue(picks: DataFrame, digests: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Picks whose digest is not the one last reviewed; a failed review leaves none."""
    last = reviewed.filter("ok").select("pick_id", F.col("digest").alias("_seen"))
    return picks.join(digests, "pick_id").join(last, "pick_id", "left").filter(F.col("_seen").isNull() | (F.col("_seen") != F.col("digest"))).drop("_seen")


def apply_verdicts(picks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """FLAG caps tier A at B, KILL unpublishes; nothing is ever raised or published."""
    met = picks.join(verdicts.select("pick_id", "verdict"), "pick_id", "left")
    tier = F.when((F.col("verdict") == "FLAG") & (F.col("tier") == "A"), "B").otherwise(F.col("tier"))
    return met.withColumn("tier", tier).withColumn("published", F.when(F.col("verdict") == "KILL", F.lit(0)).otherwise(F.col("published")))


def demote_ungrounded(verdicts: DataFrame) -> DataFrame:
    """A KILL whose reason shares no word with its evidence is a FLAG."""
    weak = (F.col("verdict") == "KILL") & ~grounded(F.col("reason"), F.col("evidence"))
    return verdicts.withColumn("verdict", F.when(weak, "FLAG").otherwise(F.col("verdict")))


def review_summary(verdicts: DataFrame) -> DataFrame:
    total = verdicts.agg(F.count(F.lit(1)).alias("_all"))
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def golden_scores(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each case (case_id, expected) with how many verdicts pass, false kills, and whether runs disagree."""
    met = cases.join(verdicts, "case_id", "left")
    return met.groupBy("case_id").agg(
        F.count("verdict").alias("answers"), F.coalesce(F.sum(F.array_contains("expected", F.col("verdict")).cast("long")), F.lit(0)).alias("passes"),
        F.coalesce(F.sum(((F.col("verdict") == "KILL") & ~F.array_contains("expected", F.lit("KILL"))).cast("long")), F.lit(0)).alias("false_kills"), (F.count_distinct("verdict") > 1).alias("unstable"))


def error_summary(errors: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent messages with digits and quoted parts collapsed."""
    kind = F.regexp_replace(F.regexp_replace("message", r"'[^']*'|\"[^\"]*\"", "'*'"), r"\d+", "#")
    return errors.groupBy(kind.alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(n)
