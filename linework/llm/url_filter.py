"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models over characters are counted from all URLs that a rule accepts
and all that one rejects. A character's probability interpolates the orders (Witten-Bell: the
weight of an order is its count over its count plus the kinds of characters seen after it). A URL
that no rule fits is blocked if the mean of log P(accepted) - log P(rejected) over its characters
is under a threshold, calibrated on labelled URLs that the models did not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of characters: end, 26 letters (case folded), one for all digits, the commonest punctuation, and one for the rest.
LETTERS = "\0abcdefghijklmnopqrstuvwxyz0-._~:/?#&=%+"
KINDS = len(LETTERS) + 1
#: Characters of context at most. The tables of a model have KINDS ** (ORDER + 1) cells, whatever the input.
ORDER = 3
#: One in so many labelled URLs calibrates instead of being counted.
CALIBRATION = 5
#: Bins of scores for calibration, from -LIMIT to LIMIT.
BINS, LIMIT = 4000, 10.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str  # without the leading slash

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


# The rules.
RULES = (UrlRule("block", "net", ""), UrlRule("allow", "example.net", "en/"), UrlRule("block", "example.com", "de/"), UrlRule("allow", "org", "fr/"))


def host_of(url: Column) -> Column:
    after = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)
    found = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), found).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith("/" + r.path)
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        best = F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


_CODE = np.full(256, KINDS - 1, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
_CODE[[*range(65, 91)]] = _CODE[[*range(97, 123)]]
_CODE[[*range(49, 58)]] = _CODE[48]


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each character of all URLs with ORDER characters before it, and the URL that it is in."""
    text = np.frombuffer(b"".join(u + b"\0" for u in urls), np.uint8)
    sizes = np.array([len(u) + 1 for u in urls])
    code = _CODE[text]
    owner = np.repeat(np.arange(len(urls)), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, cell = np.arange(len(text)), np.zeros(len(text), np.int64)
    for back in range(ORDER, 0, -1):  # before the start stands the end mark
        cell = cell * KINDS + np.where(at - back >= starts, code[np.maximum(at - back, 0)], 0)
    return cell * KINDS + code, owner


def count_cells(labelled: DataFrame) -> DataFrame:
    """(verdict, cell, n) over all rows of (url, verdict); partial sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            urls, verdicts = [u.encode() for u in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist())
            if urls:
                cells, owner = grams(urls)
                for v in set(verdicts):
                    got, n = np.unique(cells[(verdicts == v)[owner]], return_counts=True)
                    have = total.setdefault(v, np.zeros(KINDS ** (ORDER + 1), np.int32))
                    have[got] += n.astype(np.int32)
        for v, have in total.items():
            cells = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([str(v)] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(have[cells], pa.int64())], ["verdict", "cell", "n"])

    return labelled.select("url", "verdict").mapInArrow(run, "verdict string, cell long, n long").groupBy("verdict", "cell").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(character | ORDER before it) for every cell, interpolated from order -1 (all alike) upwards."""
    full = counts.reshape((KINDS,) * (ORDER + 1)).astype(np.float64)
    p = np.full(KINDS, 1.0 / KINDS)
    for order in range(ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full
        total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), np.broadcast_to(p, c.shape))
    return np.log(p).ravel().astype(np.float32)


def fit(labelled: DataFrame) -> np.ndarray:
    """Table of log P(accepted) - log P(rejected) for each cell; bounded by KINDS ** (ORDER + 1) floats."""
    tables = {v: np.zeros(KINDS ** (ORDER + 1)) for v in ("allow", "block")}
    rows = count_cells(labelled).filter(F.col("verdict").isin("allow", "block")).toPandas()
    for v, part in rows.groupby("verdict"):
        tables[v][part["cell"].to_numpy()] = part["n"].to_numpy()
    if not tables["allow"].any() or not tables["block"].any():  # nothing to tell apart
        return np.zeros(KINDS ** (ORDER + 1), np.float32)
    return log_probabilities(tables["allow"]) - log_probabilities(tables["block"])


def score(urls: DataFrame, table: np.ndarray, *, url_col: str = "url", out_col: str = "score") -> DataFrame:
    """All columns and the mean log ratio over the characters and the end of each URL; null counts as empty."""
    shared = urls.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("double")
    def ratio(column):
        import pandas as pd

        if not len(column):
            return pd.Series([], dtype="float64")
        cells, owner = grams([u.encode() for u in column])
        return pd.Series(np.bincount(owner, weights=shared.value[cells], minlength=len(column)) / np.bincount(owner, minlength=len(column)))

    return urls.withColumn(out_col, ratio(F.coalesce(F.col(url_col), F.lit(""))))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the fewest errors on (score, verdict), the mean error rate of both sides; midway among ties."""
    at = F.floor((F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT - 1e-9)) + LIMIT) / (2 * LIMIT) * BINS).cast("int")
    rows = scored.groupBy(at.alias("bin"), "verdict").count().toPandas()  # BINS * 2 rows at most
    sides = {v: np.zeros(BINS) for v in ("allow", "block")}
    for b, v, n in rows.itertuples(index=False):
        sides[v][b] += n
    if not sides["allow"].sum() or not sides["block"].sum():
        return 0.0
    # Under the edge of bin b: blocked. Errors: accepted URLs under it, rejected ones from it on.
    lost = np.concatenate([[0], np.cumsum(sides["allow"])]) / sides["allow"].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(sides["block"])]) / sides["block"].sum()
    best = np.flatnonzero(np.isclose(lost + passed, (lost + passed).min()))
    return float(np.median(best) / BINS * 2 * LIMIT - LIMIT)


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each row.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the
    method's verdict for its whole text. Where no URL is accepted or none is rejected by a rule,
    there is no ratio and the method allows. Repeated rows each give a row; other columns are
    ignored; an empty table gives an empty table.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")).withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("_id", "url", "host", "path", "_r.rule", "_r.verdict")
    labelled, side = rows.filter("rule is not null"), F.pmod(F.xxhash64("url"), F.lit(CALIBRATION))
    table = fit(labelled.filter(side != 0))
    threshold = calibrate(score(labelled.filter(side == 0).select("url", "verdict"), table)) if np.any(table) else -np.inf
    method = F.when(F.col("score") < F.lit(float(threshold)), "block").otherwise("allow")
    return score(rows, table).select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.round("score", 9).alias("score"))
