from pyspark.sql import functions as F

from linework.operators import grading, ops, quotes
from linework.sources.fixtures import view
from linework.streaming import jobs
from linework.streaming.snapshots import Snapshot


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def landed(spark, df, folder, parts):
    df.repartition(parts, "seq").write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_change_log_equals_the_batch_one(spark, small, tmp_path):
    observed = view(spark, small, "fx_quote_obs").withColumn("observed_at", F.col("observed_at").cast("timestamp")).filter("game_id < 10")
    # Time order over the files, as polls come.
    for k, cut in enumerate(("1990-01-01", "1995-06-01", "1998-06-01", "2030-01-01")):
        low = ("1900-01-01", "1990-01-01", "1995-06-01", "1998-06-01")[k]
        observed.filter(f"observed_at >= '{low}' and observed_at < '{cut}'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
    stream = spark.readStream.schema(observed.schema).parquet(f"{tmp_path}/obs")
    got = drain(jobs.quote_changes_stream(stream), "changes")
    want = quotes.price_changes(observed)
    assert sorted(r.seq for r in got.select("seq").collect()) == sorted(r.seq for r in want.select("seq").collect())


def test_alerts_equal_the_batch_ones(spark, small, tmp_path):
    states = view(spark, small, "fx_runs").select(F.col("job_name").alias("alert_key"), F.col("finished_at").alias("at"), F.col("run_id").alias("seq"), (F.col("status") == "error").alias("firing"))
    states.coalesce(1).write.parquet(f"{tmp_path}/states")
    got = drain(jobs.alert_stream(spark.readStream.schema(states.schema).parquet(f"{tmp_path}/states")), "alerts")
    assert sorted((r.alert_key, r.seq, r.event) for r in got.collect()) == sorted((r.alert_key, r.seq, r.event) for r in ops.alert_transitions(states).collect())


def test_reports_are_appended_once(spark, small, tmp_path):
    reports = view(spark, small, "fx_reports").select("report_id", F.col("knowledge_time").cast("timestamp").alias("knowledge_time"))
    for _ in range(2):
        reports.coalesce(1).write.mode("append").parquet(f"{tmp_path}/reports")
    got = drain(jobs.append_once(spark.readStream.schema(reports.schema).parquet(f"{tmp_path}/reports"), "report_id"), "once")
    assert got.count() == reports.count()


def stored_rows(df):
    return sorted(map(tuple, df.collect()))


def test_snapshot_keeps_the_last_row_of_each_key(spark, small, tmp_path):
    observed = view(spark, small, "fx_quote_obs").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    stream = landed(spark, observed, f"{tmp_path}/obs", 5)
    snap = Snapshot(f"{tmp_path}/snap", quotes.QUOTE, ["observed_at", "seq"], buckets=8)
    q = stream.writeStream.foreachBatch(snap.write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    assert sorted(r.seq for r in snap.read(spark).collect()) == sorted(r.seq for r in quotes.current_quotes(observed).collect())


def test_snapshot_rewrites_only_what_a_batch_touches(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([*xs], "k int, at int, v string")
    snap = Snapshot(str(tmp_path), ["k"], ["at"], buckets=16, keep=2)
    assert snap.read(spark) is None
    snap.write(rows(*[(k, 1, "a") for k in range(200)]), 0)
    snap.write(rows((7, 2, "b"), (7, 3, "c")), 1)
    data = tmp_path / "data"
    assert len(list(data.glob("version=0/_bucket=*"))) == 16 and len(list(data.glob("version=1/_bucket=*"))) == 1
    want = sorted([(k, 1, "a") for k in range(200) if k != 7] + [(7, 3, "c")])
    assert stored_rows(snap.read(spark)) == want
    # The same batch once more, and an older row, change nothing.
    snap.write(rows((7, 2, "b"), (7, 3, "c")), 1)
    snap.write(rows((7, 1, "old")), 2)
    assert stored_rows(snap.read(spark)) == want
    snap.write(rows().limit(0), 3)
    assert stored_rows(snap.read(spark)) == want
    # The bucket's first two folders are named by no manifest that is kept; the others stay.
    touched = next(data.glob("version=2/_bucket=*")).name
    assert not (data / "version=1" / touched).exists() and not (data / "version=0" / touched).exists() and len(list(data.glob("version=0/_bucket=*"))) == 15
    assert sorted(p.name for p in (tmp_path / "manifest").glob("version=*")) == ["version=2", "version=3"]


def test_a_batch_that_fails_before_its_manifest_leaves_the_old_version(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([*xs], "k int, at int, v string")
    snap = Snapshot(str(tmp_path), ["k"], ["at"], buckets=4)
    snap.write(rows((1, 1, "a"), (2, 1, "a")), 0)
    rows((1, 9, "half")).withColumn("_bucket", snap.bucket()).write.partitionBy("_bucket").parquet(f"{tmp_path}/data/version=1")
    assert stored_rows(snap.read(spark)) == [(1, 1, "a"), (2, 1, "a")]
    snap.write(rows((1, 2, "b")), 1)
    assert stored_rows(snap.read(spark)) == [(1, 2, "b"), (2, 1, "a")]


def test_only_touched_games_are_priced_again(spark, tmp_path):
    current = spark.createDataFrame([(g, 100 + g) for g in range(5)], "game_id long, price int")
    write = jobs.touched_writer(f"{tmp_path}/priced", lambda rows: rows.withColumn("fair", F.col("price") / 2.0), lambda: current)
    write(spark.createDataFrame([(3,), (3,), (1,), (99,)], "game_id long"), 0)
    assert sorted(r.game_id for r in spark.read.parquet(f"{tmp_path}/priced/batch=0").collect()) == [1, 3]


def test_closing_stream_equals_the_batch_one(spark, small, tmp_path):
    """Quotes land in files shuffled within a window; each key closes once, at its game's kickoff."""
    games = view(spark, small, "fx_games")
    observed = view(spark, small, "fx_quote_obs").join(games.filter("kickoff_utc is not null").select("game_id", "kickoff_utc"), "game_id").filter("game_id < 40")
    # Three years of quotes move to the days around each kickoff, some after it.
    near = F.expr("kickoff_utc + make_dt_interval(0, 0, 0, (seq * 7919) % 500000 - 400000)")
    observed = observed.withColumn("observed_at", near).drop("kickoff_utc").persist()
    low, high = observed.agg(F.min("observed_at"), F.max("observed_at")).first()
    days = (high - low).days + 1
    for k in range(0, days, 3):  # a file holds three days, shuffled
        part = observed.filter((F.datediff("observed_at", F.lit(low)) >= k) & (F.datediff("observed_at", F.lit(low)) < k + 3))
        part.orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
    # A last quote long after all kickoffs moves the watermark past them.
    late = observed.limit(1).withColumn("observed_at", F.lit(high) + F.expr("interval 30 days"))
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
    stream = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 20).parquet(f"{tmp_path}/obs")
    got = [tuple(r) for r in drain(jobs.closing_stream(stream, games, "4 days"), "closing").select(*quotes.QUOTE, "price", "seq").collect()]
    want = [tuple(r) for r in grading.closing_quotes(observed, games).select(*quotes.QUOTE, "price", "seq").collect()]
    assert len(want) > 500 and observed.join(games.select("game_id", "kickoff_utc"), "game_id").filter("observed_at > kickoff_utc").count() > 100
    assert sorted(got) == sorted(want)


def test_windows(spark, small, tmp_path):
    changes = quotes.price_changes(view(spark, small, "fx_quote_obs")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    stream = landed(spark, changes, f"{tmp_path}/chg", 1)
    got = drain(jobs.windowed_changes(stream, "30 days", "3000 days"), "windows", "update")
    assert got.agg(F.sum("n_changes")).first()[0] == changes.count()
