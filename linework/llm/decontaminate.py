"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame functions alone.

A window of a text has as many words as the item that it may hold. Windows and items get 64-bit
SimHash fingerprints of their weighted shingles. A fingerprint is cut in ``radius + 1`` blocks; two
within ``radius`` bits share a block, so joining on (size, block, value) finds all of them. Those
are verified by exact weighted-shingle similarity (sum of the smaller weights over sum of the
larger; the weight of a shingle is its count).

A window that reaches the similarity has a certain number of places whose shingles items of its
size have, at any offsets. All windows with that many, and no others, get fingerprints: what is
left out can't pass the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let

#: Words of a shingle.
K = 5
#: Rows of item shingles, and of texts with windows, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_hashed(text: Column) -> Column:
    """Hashes of the lower-case words (runs of letters and digits), in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, size: int = K) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""

    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    return let(words, made)


def simhash(parts: Column) -> Column:
    """64-bit fingerprint: bit b is set if more than half of the weight has bit b set.

    Four bits are counted at once, each in 16 bits of a sum; longer lists are counted bit by bit.
    """
    lanes = F.lit(0x0001000100010001).cast("bigint")
    count = lambda j: F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n + F.shiftrightunsigned(x, j).bitwiseAND(lanes))

    def both(columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out.bitwiseOR(c)
        return out

    mask = lambda b: F.lit((1 << b) if b < 63 else -(1 << 63)).cast("bigint")
    no = F.lit(0).cast("bigint")
    heavy = lambda sums, j, lane: F.shiftrightunsigned(sums, 16 * lane).bitwiseAND(F.lit(0xFFFF).cast("bigint")) * 2 > F.size(parts)
    lifted = lambda j: let(count(j), lambda sums: both([F.when(heavy(sums, j, lane), mask(j + 16 * lane)).otherwise(no) for lane in range(4)]))
    fast = both([lifted(j) for j in range(16)])
    single = lambda m: F.when(F.size(F.filter(parts, lambda x: x.bitwiseAND(m) != 0)) * 2 > F.size(parts), m).otherwise(no)
    slow = both([single(mask(b)) for b in range(64)])
    return F.when(F.size(parts) < 1 << 15, fast).otherwise(slow)


def blocks(print_: Column, radius: int) -> Column:
    """array<struct<no, value>>: the 64 bits in ``radius + 1`` blocks of nearly one size."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two lists of shingles, the weight of each its count."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    small = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return small / (F.size(a) + F.size(b) - small)


def if_small(df: DataFrame) -> DataFrame:
    """With a hint to broadcast it, if it has ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def window_starts(places: Column, total: Column, size: Column, similarity: float) -> Column:
    """Starts of all windows of ``size`` shingles that may be ``similarity`` alike to an item of that size.

    ``places`` has the sorted places of shingles that such items have, of ``total`` in the text. Of
    two lists of one size, 2s / (1 + s) of the shingles must be in both. A shorter text is one
    window, and must have the share s of the item's shingles.
    """
    least = F.greatest(F.lit(1), F.ceil(size * (2 * similarity / (1 + similarity)) - 1e-9).cast("int"))

    def from_first(at: Column, i: Column) -> Column:
        """The windows whose first such place is the i-th: none, or a range of starts."""
        low = F.greatest(F.coalesce(F.get(places, i - 1) + 1, F.lit(0)), F.get(places, i + least - 1) - size + 1, F.lit(0))
        high = F.least(at, total - size)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    inside = F.flatten(F.transform(places, lambda at, i: F.coalesce(from_first(at, i), F.array().cast("array<int>"))))
    whole = F.when(F.size(places) >= size * similarity - 1e-9, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(total >= size, inside).otherwise(whole)


def matches(docs: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(doc, copy, item, start, n, hamming, similarity) of all windows of (doc, copy, text) that pass, for (item, w)."""
    items = items.select("item", F.size("w").alias("n"), F.least(F.size("w"), F.lit(K)).alias("k"), "w").filter("n > 0")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # K rows at most
    made = lambda k: shingles(F.col("w"), k)
    parts = F.coalesce(*[F.when(F.col("k") == k, made(k)) for k in sizes or [K]])
    items = items.select("item", "n", "k", parts.alias("parts"))
    anchors = items.select("k", (F.col("n") - F.col("k") + 1).alias("size"), F.explode("parts").alias("h")).distinct()
    hashed = docs.select("doc", "copy", words_hashed(F.col("text")).alias("w"))
    # Narrow rows, a few bytes for each word: the texts come in again when their windows are known.
    of_size = [hashed.select("doc", "copy", made(k).alias("parts")).select("doc", "copy", F.lit(k).alias("k"), F.size("parts").alias("total"), F.posexplode("parts").alias("pos", "h")) for k in sizes or [K]]
    places = of_size[0]
    for more in of_size[1:]:
        places = places.unionByName(more)
    hits = places.join(if_small(anchors), ["k", "h"]).groupBy("doc", "copy", "k", "size").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.max("total").alias("total"))
    starts = hits.withColumn("starts", window_starts(F.col("places"), F.col("total"), F.col("size"), similarity)).filter(F.size("starts") > 0)
    wanted = checkpoint(starts.groupBy("doc", "copy").agg(F.collect_list(F.struct("k", "size", "starts")).alias("want")))
    wanted = wanted.withColumnsRenamed({"doc": "_doc", "copy": "_copy"})
    some = docs.join(if_small(wanted), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")), "inner").dropDuplicates(["doc", "copy"])
    some = some.select("doc", "copy", words_hashed(F.col("text")).alias("w"), F.explode("want").alias("q"))
    some = some.select("doc", "copy", "q.k", "q.size", F.col("q.starts").alias("starts"), F.coalesce(*[F.when(F.col("q.k") == k, made(k)) for k in sizes or [K]]).alias("parts"))
    window = some.select("doc", "copy", "k", "size", "parts", F.explode("starts").alias("start")).select("doc", "copy", "k", "size", "start", F.slice("parts", F.col("start") + 1, F.col("size")).alias("window"))
    found = checkpoint(window.withColumn("print", simhash(F.col("window"))))
    item_prints = items.select("item", "n", "k", (F.col("n") - F.col("k") + 1).alias("size"), F.col("parts").alias("item_window"), simhash(F.col("parts")).alias("item_print"))
    keyed = found.select("doc", "copy", "k", "size", "start", "print", F.explode(blocks(F.col("print"), radius)).alias("b"))
    item_keys = item_prints.select("item", "k", "size", "item_print", F.explode(blocks(F.col("item_print"), radius)).alias("b"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = keyed.join(item_keys, ["k", "size", "b"]).filter(near <= radius).select("doc", "copy", "k", "size", "start", "item", near.cast("int").alias("hamming")).distinct()
    own = found.select(*[F.col(c).alias(f"_{c}") for c in ("doc", "copy", "k", "size", "start")], "window")
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    for c in ("copy", "k", "size", "start"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    checked = pairs.join(own, same).join(item_prints.select("item", "n", "item_window"), "item").withColumn("similarity", weighted_similarity(F.col("window"), F.col("item_window")))
    return checked.filter(F.col("similarity") >= similarity).select("doc", "copy", "item", "start", "n", "hamming", "similarity")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))


def hashed_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words_hashed(F.col(text_col)).alias("w"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, radius: int = 19
) -> DataFrame:
    """(id, item, start_word, n_words, hamming, similarity): the best window of each document and item.

    Null and empty texts hold nothing, and a null or empty item is never found. An item of fewer
    than five words is one shingle, found where its words stand in a row. Ties take the earliest
    window. Texts under one id, null too, count together; all are looked at. Other columns are
    ignored.
    """
    checked = matches(keyed_texts(docs, id_col, text_col), hashed_items(benchmark, item_col, item_text_col), similarity, radius)
    best = checked.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n", "hamming")).alias("b"))
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("b.start")).alias("start_word"), F.col("b.n").alias("n_words"), "b.hamming", F.round("b.similarity", 6).alias("similarity"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, radius: int = 19
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; a row goes by its own text, whatever its id."""
    checked = matches(keyed_texts(docs, id_col, text_col), hashed_items(benchmark, item_col, item_text_col), similarity, radius)
    gone = checked.select("copy").distinct()
    copy = "_copy" + "_" * max(map(len, docs.columns))  # longer than any name that is there
    return docs.withColumn(copy, F.xxhash64(text_col)).join(if_small(checkpoint(gone.withColumnRenamed("copy", copy))), copy, "left_anti").select(*docs.columns)
