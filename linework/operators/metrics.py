"""Quality of probabilities: losses, rank statistics, calibration, uniformity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation


def binary_metrics(df: DataFrame, y: str, p: str, *by: str, clip: float = 1e-12) -> DataFrame:
    """Brier score, log loss and accuracy at one half."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"),
        F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"))


#: Ranges of an order in which running sums are made apart from one another.
RANGES = 256


def _placed(values: DataFrame, order: str, by: tuple[str, ...], ranges: int) -> DataFrame:
    """``values`` with ``_range``: how many split points of its group lie at or under the value; nulls come first.

    Split points are approximate quantiles of the values, ``ranges`` - 1 a group at most, found by binary search.
    """
    share = [k / ranges for k in range(1, ranges)]
    points = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order, share, 20 * ranges)).alias("_points"))
    met = values.join(points, list(by)) if by else values.crossJoin(points)  # one row in all
    steps = max(1, ranges.bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size("_points"), F.lit(0)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.get("_points", mid) <= F.col(order)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(under, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(mid).alias("hi")))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    return met.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(place)).drop("_points")


def prefix_sums(values: DataFrame, order: str, columns: list[str], *by: str, ranges: int = RANGES) -> DataFrame:
    """``values`` with ``before_c`` and ``all_c`` for each column c: its sum over smaller values of the group and over all.

    ``values`` has one row for each group and value. Sums run within ranges of the order, whose
    split points come from the data, and start where the ranges before them end: no task holds a group.
    """
    placed = _placed(values, order, by, ranges)
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in columns])
    ahead, every = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    firsts = totals.select(*by, "_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_first_{c}") for c in columns], *[F.sum(c).over(every).alias(f"all_{c}") for c in columns])
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumns({f"_within_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns})
    met = rows.join(firsts, [*by, "_range"])
    return met.select(*values.columns, *[(F.col(f"_first_{c}") + F.col(f"_within_{c}")).alias(f"before_{c}") for c in columns], *[F.col(f"all_{c}") for c in columns])


def order_statistics(df: DataFrame, value: str, ranks: dict[str, Column], *by: str, ranges: int = RANGES) -> DataFrame:
    """(by, n, a column for each name of ``ranks``): exact values at ranks from 1, given as columns of ``n``.

    Values are counted, then the counts of ranges; only the ranges that hold a wanted rank are put in
    order. Ranks outside [1, n] give null; null values do not count.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = _placed(counts, value, by, ranges)
    totals = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_c"))
    ahead, every = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    spans = totals.select(*by, "_range", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_first"), F.col("_c").alias("_span"), F.sum("_c").over(every).alias("n"))
    wanted = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]), lambda w: (w["rank"] > F.col("_first")) & (w["rank"] <= F.col("_first") + F.col("_span")))
    holding = spans.withColumn("_wanted", wanted).filter(F.size("_wanted") > 0)
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(holding, [*by, "_range"]).withColumn("_from", F.col("_first") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    hits = rows.select(*by, value, F.explode(F.filter("_wanted", lambda w: (w["rank"] > F.col("_from")) & (w["rank"] <= F.col("_from") + F.col("_c"))))).select(*by, value, "col.name")
    found = hits.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks])
    sizes = spans.groupBy(*by).agg(F.max("n").alias("n"))
    return sizes.join(found, list(by), "left") if by else sizes.join(found)


def auc(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """Area under the ROC curve with ties at half; null where all outcomes are alike.

    Rows are counted by distinct score first; running sums then go over scores, in ranges.
    """
    scores = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1.0 - F.col(y)).alias("neg"))
    ranked = prefix_sums(scores, p, ["neg"], *by)
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")).alias("auc"))


def bin_of(p: Column, bins: int = 10) -> Column:
    """Lower edge of the bin [lo, hi) that holds p; none holds 1."""
    edges = [i / bins for i in range(bins)]
    return F.greatest(*[F.when((p >= e) & (p < 1.0), F.lit(e)) for e in edges])


def calibration_table(df: DataFrame, y: str, p: str, *by: str, bins: int = 10, least: int = 1) -> DataFrame:
    table = df.withColumn("bin", bin_of(F.col(p), bins)).filter("bin is not null").groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual"))
    return table.filter(F.col("n") >= least).withColumn("gap", F.col("actual") - F.col("predicted"))


def expected_calibration_error(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def pit_table(df: DataFrame, pit: str, *by: str) -> DataFrame:
    """Rows and share in each tenth of a probability integral transform; 1 belongs to the last."""
    tenth = F.coalesce(bin_of(F.col(pit)), F.when(F.col(pit) >= 1.0, F.lit(0.9)))
    counts = df.groupBy(*by, tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    met = counts.join(total, list(by)) if by else counts.join(total)
    return met.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def ks_uniform(df: DataFrame, pit: str, *by: str, ranges: int = RANGES) -> DataFrame:
    """Largest gaps between the ranks of a PIT and the uniform: ``ks_upper`` on one side (i / n), ``ks`` on both.

    Ranks are sums over distinct values, in ranges of their order.
    """
    values = df.groupBy(*by, pit).agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(values, pit, ["c"], *by, ranges=ranges).withColumnsRenamed({"before_c": "below", "all_c": "n"})
    # Within ties every rank from below + 1 to below + c meets the same value; the ends decide.
    first, last = F.abs((F.col("below") + 1) / F.col("n") - F.col(pit)), F.abs((F.col("below") + F.col("c")) / F.col("n") - F.col(pit))
    low = F.abs(F.col("below") / F.col("n") - F.col(pit))
    return ranked.groupBy(*by).agg(F.max(F.greatest(first, last)).alias("ks_upper"), F.max(F.greatest(first, last, low)).alias("ks"))


def forecast_errors(df: DataFrame, actual: str, expected: str, sd: str, over: str, *by: str) -> DataFrame:
    """How far outcomes fell from expectations: (by, n, mae, bias, corr, within_1sd, within_2sd, z_sd, over_rate).

    ``over`` is whether the outcome beat the forecast's own line.
    """
    err = F.col(actual) - F.col(expected)
    z = err / F.col(sd)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"), correlation(expected, actual).alias("corr"),
        share(F.abs(z) <= 1.0).alias("within_1sd"), share(F.abs(z) <= 2.0).alias("within_2sd"), F.stddev_pop(z).alias("z_sd"), share(F.col(over)).alias("over_rate"),
    )


def band(value: Column, edges: list[float]) -> Column:
    """Number of edges at or under the value; null stays null."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return out
