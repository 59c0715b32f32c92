"""Fair prices: the margin removed book by book, then a weighted consensus."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds
from ..functions.stats import weighted_median
from .quotes import MARKET, priced_pairs

# Trust in books whose prices others follow; all others weigh 1.
BOOK_WEIGHTS = {"pinnacle": 5.0, "betonlineag": 2.0, "lowvig": 2.0, "bookmaker": 2.0, "circasports": 3.0}


def book_weight(weights: Mapping[str, float]) -> Column:
    weight = F.lit(1.0)
    for book, w in weights.items():
        weight = F.when(F.col("book") == book, F.lit(float(w))).otherwise(weight)
    return weight


def fair_prices(quotes: DataFrame, *, sharp: tuple[str, ...] = ("pinnacle",), weights: Mapping[str, float] = BOOK_WEIGHTS, method: str = "power") -> DataFrame:
    """(market, side, line, fair_prob, sharp_prob, book_count, dispersion, method_used).

    One shuffle by book pair, one by market: the entries of a market line are a struct for each
    book, so the arrays are as long as the number of books.
    """
    pairs = priced_pairs(quotes).filter("plausible")
    fair = odds.devig(F.col("prob_a"), F.col("prob_b"), method)
    one = pairs.select(*MARKET, "pair_line", "book", "side_a", "side_b", fair.alias("p"), book_weight(weights).alias("w"), F.col("book").isin(*sharp).alias("is_sharp"), odds.method_used(F.col("prob_a"), F.col("prob_b"), method).alias("method_used"))
    sides = one.select("*", F.explode(F.array(F.struct(F.col("side_a").alias("side"), F.col("p").alias("prob")), F.struct(F.col("side_b").alias("side"), (1.0 - F.col("p")).alias("prob")))).alias("s"))
    grouped = sides.groupBy(*MARKET, "pair_line", F.col("s.side").alias("side")).agg(
        F.collect_list(F.struct(F.col("s.prob").alias("v"), "w")).alias("entries"),
        F.avg(F.when(F.col("is_sharp"), F.col("s.prob"))).alias("sharp_prob"),
        F.count(F.lit(1)).alias("book_count"),
        F.coalesce(F.stddev_pop("s.prob"), F.lit(0.0)).alias("dispersion"),
        F.max("method_used").alias("method_used"),
    )
    line = odds.own_line(F.col("market_type"), F.col("side"), F.col("pair_line"))
    return grouped.select(*MARKET, "side", line.alias("line"), weighted_median(F.col("entries")).alias("fair_prob"), "sharp_prob", "book_count", "dispersion", "method_used")


def fair_fields(quotes: DataFrame, key: list[str], methods: Sequence[str]) -> DataFrame:
    """(key, book, side, n_sides, and of each method its fair price and ``<method>_used``), an outcome of a book a row.

    Of each market the books that quote every outcome that any book quotes, and each once; null prices
    where one of the book's is not valid. One shuffle by market; a task walks its sorted rows and holds
    one batch and one market.
    """
    rows = quotes.select(*key, "book", "side", odds.implied_probability(F.col("price")).alias("p"))
    out = rows.select(*key, "book", "side", F.lit(0).alias("n_sides"), *[c for m in methods for c in (F.lit(None).cast("double").alias(m), F.lit(None).cast("string").alias(f"{m}_used"))]).schema

    def differs(column: pa.ChunkedArray) -> np.ndarray:
        """Whether each value is another than the one before it; nulls are alike."""
        column = column.combine_chunks()
        a, b = column[1:], column[:-1]
        return np.r_[True, pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)]

    def markets(t: pa.Table) -> np.ndarray:
        return np.logical_or.reduce([differs(t[c]) for c in key])

    def solved(t: pa.Table, market: np.ndarray) -> list[pa.RecordBatch]:
        first = market | differs(t["book"])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(first)])
        once = np.add.reduceat((~first & ~differs(t["side"])).astype(np.int64), starts) == 0
        counted, number = np.repeat(once, sizes), np.cumsum(market) - 1
        codes = pc.dictionary_encode(t["side"].combine_chunks(), null_encoding="encode")
        sides = np.unique(number[counted] * len(codes.dictionary) + codes.indices.to_numpy()[counted]) // max(1, len(codes.dictionary))
        whole = once & (sizes == np.bincount(sides, minlength=number[-1] + 1)[number[starts]])
        t, sizes = t.filter(pa.array(np.repeat(whole, sizes))), sizes[whole]
        flat = t["p"].to_numpy().astype(float)
        columns = [*[t[c] for c in (*key, "book", "side")], pa.array(np.repeat(sizes, sizes), pa.int32())]
        for m in methods:
            probs, fine, own = odds.solve_fields(flat, sizes, m)
            broken = np.repeat(~fine, sizes)
            columns += [pa.array(probs, mask=broken), pa.array(np.repeat(np.where(own, m, odds.INSTEAD.get(m, m)), sizes), pa.string(), mask=broken)]
        return pa.Table.from_arrays(columns, out.names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            market = markets(held) if held.num_rows else np.zeros(0, bool)
            last = int(np.flatnonzero(market)[-1]) if len(market) else 0
            if last:
                yield from solved(held[:last], market[:last])
                held = held[last:]
        if held is not None and held.num_rows:
            yield from solved(held, markets(held))

    return rows.repartition(*key).sortWithinPartitions(*key, "book", "side").mapInArrow(run, out)


def field_prices(quotes: DataFrame, *, sharp: tuple[str, ...] = ("pinnacle",), weights: Mapping[str, float] = BOOK_WEIGHTS, method: str = "power") -> DataFrame:
    """Fair prices of markets with any number of outcomes: three-way moneylines, winners, first scorers.

    (market, line, side, n_sides, fair_prob, sharp_prob, book_count, dispersion, method_used), an
    outcome a row. A book's margin is removed over all outcomes at once, so a book counts only where it
    quotes every outcome that any book quotes, once and with a valid price. The median of books over the
    outcomes need not sum to 1, so it is scaled to. Two shuffles, both by market; the books of an outcome
    are walked in the order of their prices.
    """
    key = [*MARKET, "line"]
    fair = fair_fields(quotes, key, [method]).filter(F.col(method).isNotNull()).repartition(*MARKET)  # not by the line: a float is normalised, which hides that rows are dealt already
    weight = F.coalesce(F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col("book")], F.lit(1.0)) if weights else F.lit(1.0)
    rows = fair.select(*key, "side", "book", "n_sides", F.col(method).alias("p"), F.col(f"{method}_used").alias("method_used"), weight.alias("w"))
    outcome = Window.partitionBy(*key, "side")
    walked = rows.withColumns({"_up_to": F.sum("w").over(outcome.orderBy("p", "book").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("w").over(outcome)})
    agreed = walked.groupBy(*key, "side").agg(
        F.max("n_sides").alias("n_sides"), F.min(F.when(F.col("_up_to") >= F.col("_all") / 2.0, F.col("p"))).alias("_median"), F.avg(F.when(F.col("book").isin(*sharp), F.col("p"))).alias("sharp_prob"),
        F.count(F.lit(1)).alias("book_count"), F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("dispersion"), F.max("method_used").alias("method_used"),
    )
    total = F.sum("_median").over(Window.partitionBy(*key))
    return agreed.select(*key, "side", "n_sides", (F.col("_median") / total).alias("fair_prob"), "sharp_prob", "book_count", "dispersion", "method_used")


def sharp_soft(fair: DataFrame, *, least_gap: float = 0.02, least_books: int = 3) -> DataFrame:
    """Market sides where the sharp books differ from the consensus, the widest gap first."""
    gap = F.col("sharp_prob") - F.col("fair_prob")
    found = fair.withColumn("delta", gap).filter((F.abs("delta") >= least_gap) & (F.col("book_count") >= least_books))
    return found.orderBy(F.desc(F.abs("delta")), *MARKET, "side", "line")
