"""Substring dedup of passages: a run of ``LEAST`` words that stands earlier is removed, wherever it begins.

A text is its words in lower case, so lines and their breaks do not matter. Every window of
``LEAST`` words picks the run of ``K`` words in it with the least hash, so equal windows pick equal
runs. Neighbouring windows with one pick are a block, a few for each hundred words; blocks are what
is grouped. A block whose words stand earlier as a block goes as a whole. Of the rest, only the
first block of each kind whose pick stands in other kinds too is taken apart into windows. So the
result is that of grouping all windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_rows, pa_type, stored
from .near_dedup import _hashes, mix

#: Words of a window; words of the run that it picks.
LEAST, K = 51, 25
_WORD = re.compile(WORD)
#: Odd multipliers of two rolling hashes; each has an inverse modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits of the filter that tells which texts may have blocks to take apart; 2 MB whatever the input.
BITS = 1 << 24


class Runs:
    """Hashes of any run of words of one text, by sums of its powers."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
        self.back = power(pow(base, -1, 1 << 64))
        self.sums = np.r_[np.uint64(0), np.cumsum(words * power(base)[:n], dtype=np.uint64)]

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64))


def words_at(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; offsets are in characters."""
    hashes = np.fromiter((_hashes[w.lower()] for w in _WORD.findall(text)), np.uint64)
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = np.diff(np.r_[0, ((letters != 32) & ((letters < 9) | (letters > 13))).astype(np.int8), 0])
    return hashes, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def blocks(text: str) -> list[np.ndarray] | None:
    """Pick, hash, first and last window, start, end and end of the first window of each block; none for a text of fewer than ``LEAST`` words."""
    if len(text) < 2 * LEAST - 1:
        return None
    words, starts, ends = words_at(text)
    if len(words) < LEAST:
        return None
    runs, at = Runs(words, _BASES[0]), np.arange(len(words) - K + 1)
    picks = runs.of(at, at + K)
    pick = np.lib.stride_tricks.sliding_window_view(picks, LEAST - K + 1).argmin(axis=1) + at[: len(words) - LEAST + 1]
    first = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
    last = np.r_[first[1:], len(pick)] - 1
    return [picks[pick[first]].view(np.int64), Runs(words, _BASES[1]).of(first, last + LEAST).view(np.int64), first, last, starts[first], ends[last + LEAST - 1], ends[first + LEAST - 1]]


def windows(text: str, taken: list[tuple[int, int]]) -> list[np.ndarray]:
    """Two hashes, place, start and end of each window from the first to the last of each of ``taken``."""
    words, starts, ends = words_at(text)
    at = np.concatenate([np.arange(a, b + 1) for a, b in taken])
    return [*[Runs(words, b).of(at, at + LEAST).view(np.int64) for b in _BASES], at, starts[at], ends[at + LEAST - 1]]


def maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose (doc, copy) may be among ``keys``; all that are stay, and few others."""
    slot = lambda: F.pmod(F.xxhash64("doc", "copy"), F.lit(BITS))
    bits = np.zeros(BITS // 8, np.uint8)
    one = slot() + 1  # Spark's bitmaps count from 1, in buckets of 32768
    for no, bitmap in keys.groupBy(F.bitmap_bucket_number(one)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one))).collect():  # BITS / 32768 rows at most
        bits[(no - 1) << 12 : no << 12] = np.frombuffer(bitmap, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def told(at):
        import pandas as pd

        at = at.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(told(slot()))


def block_table(texts: DataFrame) -> DataFrame:
    """(doc, copy, h, b, at, last, start, end, stop) of each block of (doc, copy, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch in batches:
                for doc, copy, text in zip(*batch.columns):
                    got = blocks(text.as_py())
                    if got:
                        yield (doc.as_py(), copy.as_py()), got

        yield from arrow_rows(made(), names, kinds)

    names = ["doc", "copy", "h", "b", "at", "last", "start", "end", "stop"]
    kinds = [pa_type(texts, "doc"), pa.int64()]
    return texts.select("doc", "copy", "text").mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, copy long, h long, b long, at long, last long, start long, end long, stop long")


def window_table(texts: DataFrame) -> DataFrame:
    """(doc, copy, w, v, at, start, end) of the windows that ``taken`` names, of (doc, copy, text, taken)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch in batches:
                for doc, copy, text, taken in zip(*batch.columns):
                    yield (doc.as_py(), copy.as_py()), windows(text.as_py(), [(t["at"], t["last"]) for t in taken.as_py()])

        yield from arrow_rows(made(), names, kinds)

    names = ["doc", "copy", "w", "v", "at", "start", "end"]
    kinds = [pa_type(texts, "doc"), pa.int64()]
    return texts.select("doc", "copy", "text", "taken").mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, copy long, w long, v long, at long, start long, end long")


def later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, copy, at, until, start, end): the words that each row but the first of its keys takes.

    Words that its first window covers stay (a text that repeats with a period overlaps itself).
    ``rows`` has (doc, copy, at, until, start, end, stop); ``stop`` is the end of the window at ``at``.
    """
    kinds = rows.groupBy(*keys).agg(F.min(F.struct("doc", "copy", "at", "stop")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("copy") == F.col("first.copy"))
    until = F.col("first.at") + LEAST
    laps = own & (F.col("at") < until)
    found = rows.join(kinds, keys).filter(~(own & (F.col("at") == F.col("first.at"))))
    taken = found.select(
        "doc", "copy", F.when(laps, until).otherwise(F.col("at")).alias("at"), "until",
        F.when(laps, F.col("first.stop")).otherwise(F.col("start")).alias("start"), "end",
    )
    return taken


def merged(spans: Column) -> Column:
    """Spans sorted by place, those that touch or overlap joined."""
    kind = "array<struct<until:bigint,start:bigint,end:bigint>>"

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.struct(F.greatest(last["until"], s["until"]).alias("until"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touch = (F.size(out) > 0) & (s["at"] <= F.get(out, F.size(out) - 1)["until"])
        new = F.array(F.struct(s["until"].alias("until"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(touch, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, new))

    return F.aggregate(spans, F.array().cast(kind), step)


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, spans) of each text with a passage that stands earlier, by (id, hash of the text, place)."""
    text = F.col(text_col)
    texts = docs.filter(text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))
    every = stored(block_table(texts))
    again = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    some = stored(every.join(again, "h", "left_semi").withColumn("until", F.col("last") + LEAST))
    kinds = some.groupBy("h", "b").agg(F.min(F.struct("doc", "copy", "at", "last")).alias("first"))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    taken = kinds.join(mixed, "h").groupBy("first.doc", "first.copy").agg(F.collect_list(F.struct("first.at", "first.last")).alias("taken"))
    taken = taken.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "taken")
    apart = maybe_in(texts, taken.select(F.col("_doc").alias("doc"), F.col("_copy").alias("copy"))).join(taken, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")))
    single = stored(window_table(apart).withColumn("until", F.col("at") + LEAST).withColumn("stop", F.col("end")))
    gone = later(some, ["h", "b"]).unionByName(later(single, ["w", "v"]))
    return gone.groupBy("doc", "copy").agg(merged(F.array_sort(F.collect_set(F.struct("at", "until", "start", "end")))).alias("spans"))


def without_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_removed, removed_chars, removed): spans ``start:end`` in the original text, comma-joined.

    Every row gives a row. Texts of fewer than ``LEAST`` words, and null ones, have no spans. Rows
    of one id with different texts are different texts; with the same text they are one. Null ids
    come first.
    """
    found = repeated_passages(docs, id_col=id_col, text_col=text_col).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "spans")
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"))
    out = base.join(found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<until:bigint,start:bigint,end:bigint>>"))
    return out.select(
        F.col("doc").alias(id_col), F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("removed"),
    )
