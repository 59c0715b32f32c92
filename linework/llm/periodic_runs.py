"""Periodic runs of words in whole texts, found by internal pattern matching.

Tasks take texts in packs of some ten thousand words and work on them in numpy:

1. *Ranks.* Prefix doubling gives the suffix array of the pack and, for each power of two, the rank of
   the words that begin at each place; the words of one text never equal those of another. Suffixes
   whose prefix stands once in their text are left alone from there on, so prose costs a few levels.
2. *Dyadic blocks.* A run of smallest period q with m <= q < 2m, m = 2^k, and at least 3q words holds
   the aligned block of m words that begins first in it, and the same words q further on. The block's
   suffixes are one interval of the suffix array; a wavelet matrix over it answers "the next place in
   this interval at or after x" (range successor) and "the last before x".
3. *Progressions.* The places of a block in a window of m places form one arithmetic progression. One or
   two places are candidates as they stand. Of three or more the difference d is the block's own period;
   then the run's period is the distance between the beginnings, or the ends, of the two stretches
   of period d around the block and around the progression: one of the two lies inside the run.
   Periods under 8 are the first place after a block of 8 words.
4. *Runs.* Each candidate is extended both ways by longest common extensions over the ranks. Of equal
   stretches the smallest period stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A run has at least so many words and so many times its period. The search relies on TIMES >= 3 and LEAST >= 24.
LEAST, TIMES = 24, 3
#: Words of the smallest block, 2^FIRST.
FIRST = 3
#: Words of a pack; a longer text is a pack of its own.
PACK = 60_000

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _ranks(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The suffix array, and for each k the ranks of 2^k words from each place and the places that
    share theirs. A rank is the first slot of its group in the suffix array."""
    n = len(symbols)

    def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(keys)))
        return np.repeat(first, sizes), np.repeat(sizes > 1, sizes)

    order = np.argsort(symbols, kind="stable")
    first, shared = groups(symbols[order])
    rank = np.empty(n, np.int32)
    rank[order] = first
    levels, alive = [rank], [order[shared]]
    slots = np.flatnonzero(shared)
    width = 1
    while len(slots):
        places = order[slots]
        after = places + width
        second = np.where(after < ends[places], rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[places].astype(np.int64) * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        places = places[by]
        order[slots] = places
        first, shared = groups(keys[by])
        rank = rank.copy()
        rank[places] = slots[first]
        levels.append(rank)
        slots = slots[shared]
        alive.append(places[shared])
        width *= 2
    return order, levels, alive


class Wavelet:
    """A wavelet matrix over an array of places; all queries come as arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.before = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.before.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in slots [lo, hi) are under x."""
        count, top = np.zeros(len(lo), np.int64), x >= 1 << self.bits
        out = hi - lo
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.before, strict=True):
            l0, h0, one = zeros[lo], zeros[hi], (x >> b & 1).astype(bool)
            count += np.where(one, h0 - l0, 0)
            lo, hi = np.where(one, zeros[-1] + lo - l0, l0), np.where(one, zeros[-1] + hi - h0, h0)
        return np.where(top, out, count)

    def at(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k among slots [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.before, strict=True):
            l0, h0 = zeros[lo], zeros[hi]
            one = k >= h0 - l0
            k = np.where(one, k - (h0 - l0), k)
            value |= one.astype(np.int64) << b
            lo, hi = np.where(one, zeros[-1] + lo - l0, l0), np.where(one, zeros[-1] + hi - h0, h0)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The least value at or over x in slots [lo, hi), else ``none``."""
        k = self.less(lo, hi, x)
        return np.where(k < hi - lo, self.at(lo, hi, np.minimum(k, hi - lo - 1)), none)

    def predecessor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The greatest value under x in slots [lo, hi), else -1."""
        k = self.less(lo, hi, x)
        return np.where(k > 0, self.at(lo, hi, np.maximum(k - 1, 0)), -1)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray, starts: np.ndarray, back: bool) -> np.ndarray:
    """Words that follow (or, ``back``, precede) places a < b of one text alike."""
    a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        x, y = (a - w, b - w) if back else (a, b)
        fits = x >= starts if back else y < ends
        same = fits & (levels[k][np.clip(x, 0, n - 1)] == levels[k][np.clip(y, 0, n - 1)])
        step = np.where(same, w, 0)
        got += step
        a, b = (a - step, b - step) if back else (a + step, b + step)
    return got


def find_runs(symbols: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts that stand one after another, by start then period.

    ``symbols`` numbers the words so that texts share none; starts are places in the whole array.
    """
    if times < 3 or least < 24:
        raise ValueError("the search finds runs of at least 24 words and three periods")
    none = np.zeros((0, 3), np.int64)
    n = len(symbols)
    if n < least:
        return none
    start_of = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end_of = np.repeat(np.cumsum(sizes), sizes)
    order, levels, alive = _ranks(symbols, end_of)
    if len(alive) <= FIRST or not len(alive[FIRST]):
        return none  # no eight words stand twice
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    # The part of the suffix array that the queries need: suffixes whose first eight words stand twice.
    used = np.sort(slot[alive[FIRST]])
    tree = Wavelet(order[used].astype(np.int64))
    blocks = []
    for k in range(FIRST, len(alive)):
        held = alive[k]
        of = levels[k][held]
        firsts, counts = np.unique(of, return_counts=True)
        lo = np.searchsorted(used, of)
        aligned = (held - start_of[held]) % (1 << k) == 0
        blocks.append(np.stack([held, lo, lo + counts[np.searchsorted(firsts, of)], np.full(len(held), 1 << k)])[:, aligned])
    i, lo, hi, m = np.concatenate(blocks, axis=1)
    if not len(i):
        return none
    first = tree.successor(lo, hi, i + m, n)
    last = tree.predecessor(lo, hi, i + 2 * m)
    some = first < i + 2 * m
    second = tree.successor(lo, hi, np.where(some, first + 1, n), n)
    close = m == 1 << FIRST
    near = np.full(len(i), n, np.int64)
    near[close] = tree.successor(lo[close], hi[close], i[close] + 1, n)
    few, many = some & (second >= last), some & (second < last)
    at, period = [i[few], i[few], i[near < i + m]], [(first - i)[few], (last - i)[few], (near - i)[near < i + m]]
    if many.any():
        a, f, d = i[many], first[many], (second - first)[many]
        s, e = start_of[a], end_of[a]
        reach = lambda x, back: _common(levels, x, x + d, e, s, back)
        at += [a, a]
        period += [(f - reach(f, True)) - (a - reach(a, True)), (f + reach(f, False)) - (a + reach(a, False))]
    at, period = np.concatenate(at), np.concatenate(period)
    fine = (period > 0) & (at + period < end_of[at])
    at, period = at[fine], period[fine]
    s, e = start_of[at], end_of[at]
    left = at - _common(levels, at, at + period, e, s, True)
    length = at + period + _common(levels, at, at + period, e, s, False) - left
    good = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([left[good], length[good], period[good]], axis=1), axis=0)
    if not len(found):
        return none
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)  # of one stretch the smallest period
    found = found[keep]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _pack(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """For each text its runs, from its own first word, and the words that stay."""
    numbers: dict[bytes, int] = {}
    number = lambda w: numbers.setdefault(w, len(numbers))
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter((number(w) for t in texts for w in t), np.int64, int(sizes.sum()))
    found = find_runs(flat + np.repeat(np.arange(len(texts)), sizes) * len(numbers), sizes, least, times)
    starts = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(found[:, 0], np.append(starts, len(flat)))
    for k, words in enumerate(texts):
        runs = found[cuts[k] : cuts[k + 1]] - [starts[k], 0, 0]
        if len(runs):
            words = [words[j] for j in np.flatnonzero(collapsed(len(words), runs))]
        yield runs, words


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Rewrite | None = None) -> DataFrame:
    """(id, runs, collapsed) of each row: the runs of its whole text by start, then period, and the
    words that stay, joined by one space. One pass, no shuffle.

    A run is a stretch of words in which words ``period`` apart are equal, for its smallest period,
    that no word beside it continues, of at least ``least`` words and ``times`` periods. A word
    goes if any run holds it after that run's first period. ``rewrite(id, words)`` may change the
    words first.

    A null, empty or blank text has no words and no runs and collapses to an empty text. Repeated rows each
    give a row, null ids stay null, other columns are ignored and an empty table gives an empty one. The
    working set of a task is that of one pack of 60,000 words, or of its longest text: about
    4 bytes a word for each doubling up to that text's longest repeat.
    """
    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    shape = pa.struct([pa.field(c, pa.int64()) for c in RUN.names])

    def emit(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        done = list(_pack(texts, least, times))
        counts = np.cumsum([0, *(len(runs) for runs, _ in done)])
        flat = np.concatenate([runs for runs, _ in done])
        runs = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], fields=list(shape)))
        return pa.RecordBatch.from_arrays([ids, runs, pa.array([b" ".join(words).decode() for _, words in done], pa.string())], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[object] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            kind = batch.column(0).type
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().encode().split()  # bytes split at ASCII white space only
                if rewrite:
                    words = rewrite(own.as_py(), words)
                if texts and (held + len(words) > PACK or len(texts) >= PACK // LEAST):
                    yield emit(pa.array(ids, kind), texts)
                    ids, texts, held = [], [], 0
                ids.append(own.as_py())
                texts.append(words)
                held += len(words)
        if texts:
            yield emit(pa.array(ids, kind), texts)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of the contract: a tenth of the ids repeat a stretch of their own text to its end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def run_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: n_runs, the run of greatest exponent (start, length, period, exponent_milli; null
    without a run) and the digests of all runs and of the collapsed text, after ``planted``."""
    found = periodic_runs(docs, id_col=id_col, text_col=text_col, rewrite=planted)
    # Of two runs the better has the greater length / period, compared by whole numbers; the first of equals stays.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("_best", best)
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
