"""Near-duplicate groups by Order MinHash and banded alignment.

The k-mers of a text are its runs of five words, each labelled with its occurrence number, so a
repeated run counts as often as it stands there. Each of ``SKETCHES`` hash functions picks the
``LEAST`` smallest labelled k-mers, and they are kept in text order: two texts agree on a sketch
if they pick the same k-mers in the same order, which is likelier the fewer edits lie between
them. Texts that agree on a sketch share a bucket and are candidates. A pair is verified by
aligning its words within a band as wide as the threshold allows: with 0.8, one word in ten may be
another. Verified pairs are joined to groups by connected components.

If a share p of the words is replaced, two texts have c = (1 - p) ** 5 of their k-mers in common and
agree on a sketch with a chance of about (c / (2 - c)) ** LEAST; of ``SKETCHES`` one is enough.
Sketches of short texts say little. Texts of up to ``SHORT`` k-mers, and those long enough to be
alike to one, also share a bucket if one of their least labelled k-mers is the same, as many of
them as the threshold lets differ and one more: no pair with such a text and that share of common
k-mers is missed.

Exact copies (of the words in lower case) are one text from the start. In a bucket of at most
``SMALL`` texts all pairs are verified. In a larger one every text is first verified against the
earliest; those that this does not bring into its group are then held against all texts of the
bucket, in blocks. So neither a large group of copies nor a common passage makes rows of pairs,
and no pair that could still join two groups goes unverified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import checkpoint

K, LEAST, SKETCHES = 5, 3, 40
#: K-mers up to which candidates are exact.
SHORT = 15
#: Texts of a bucket of which all pairs are verified; sketches that are taken first.
SMALL, FIRST = 16, 4
#: Texts of a block, in expectation.
BLOCK = 256
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a worker remembers.
MEMO = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: str) -> list[str]:
    return text.lower().split()


def word_hashes(own: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))


def kmers(own: list[str], k: int = K) -> np.ndarray:
    """Hash of each run of k words; a text of fewer is one run; none for no words."""
    h = word_hashes(own)
    k = min(k, len(h))
    if not k:
        return h
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _P + h[i : len(h) - k + 1 + i]
    return mix(out)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Each hash mixed with the number of its earlier occurrences."""
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return runs
    at = np.arange(len(runs))
    seen = np.empty(len(runs), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(runs + seen * _P)


def sketches(own: list[str], k: int = K, least: int = LEAST, number: int = SKETCHES) -> list[int]:
    """One signed 64-bit key for each hash function; none for a text without words."""
    runs = kmers(own, k)
    if not len(runs):
        return []
    runs = labelled(runs)
    seeds = mix(np.arange(1, number + 1, dtype=np.uint64) * _P)
    weights = mix(np.arange(1, least + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.empty(number, np.uint64)
    rows = max(1, min(number, 1_000_000 // len(runs)))  # bounds the memory for very long texts
    for a in range(0, number, rows):
        ranks = (runs[None, :] ^ seeds[a : a + rows, None]) * _M1
        ranks ^= ranks >> np.uint64(29)
        ranks *= _M2
        if len(runs) > least:
            picks, row = np.empty((len(ranks), least), np.int64), np.arange(len(ranks))
            for i in range(least):  # a few scans for the least are faster than a partial sort
                picks[:, i] = ranks.argmin(axis=1)
                ranks[row, picks[:, i]] = _MOST
            picks.sort(axis=1)
        else:
            picks = np.broadcast_to(np.arange(len(runs)), (len(ranks), len(runs)))
        keys[a : a + rows] = (runs[picks] * weights[: picks.shape[1]]).sum(axis=1, dtype=np.uint64)
    return mix(keys + seeds).view(np.int64).tolist()


def prefix_keys(own: list[str], similarity: float) -> list[int]:
    """The least labelled k-mers of a text that is alike to one of ``SHORT`` at most; none for a longer one.

    Of n k-mers at least ``similarity * n`` are in any text that is alike, so of the n less that
    many and one least of either, in one order of all k-mers, one is in both.
    """
    runs = kmers(own) if len(own) <= SHORT / similarity + K else np.empty(0, np.uint64)
    if not len(runs) or len(runs) > SHORT / similarity + 1e-9:
        return []
    taken = len(runs) - math.ceil(similarity * len(runs) - 1e-9) + 1
    return np.sort(labelled(runs))[:taken].view(np.int64).tolist()


def aligned(a: list[int], b: list[int], similarity: float) -> float:
    """Similarity of two sequences by alignment: matches / (both lengths - matches).

    Only matches on diagonals within the band are made; the band is as wide as the most
    insertions and deletions that the threshold allows, so a pair that reaches the threshold gets
    its exact value. Rows of the alignment are bit vectors (one bit for each place of ``a``).
    """
    if not a or not b:
        return float(not a and not b)
    total = len(a) + len(b)
    # matches / (total - matches) >= s  <=>  matches >= s * total / (1 + s)
    band = int(total - 2 * similarity * total / (1 + similarity) + 1e-9)
    if abs(len(a) - len(b)) > band:
        return 0.0
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row, window = full, (1 << (2 * band + 1)) - 1
    for j, w in enumerate(y):
        at = places.get(w)
        if at:
            shift = j - band
            at &= (window << shift) if shift >= 0 else window >> -shift
            step = row & at
            row = ((row + step) | (row - step)) & full
    matches = head + tail + len(x) - row.bit_count()
    return matches / (total - matches)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, text_hash, keys) of each row with a word; ``text_hash`` is of the words in lower case.

    The first ``SKETCHES`` keys are the sketches, all others prefix keys.
    """
    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("hash", BinaryType()), StructField("keys", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, keys = [], []
            for text in batch.column(1):  # the words of one text at a time
                own = words(text.as_py())
                hashes.append(xxhash.xxh3_128_digest(" ".join(own)))
                keys.append(np.array(sketches(own) + prefix_keys(own, similarity), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], out.names)

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, out)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts align; both texts meet by joins on the ids."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, own = x, word_hashes(words(x)).tolist()
                if aligned(own, word_hashes(words(y)).tolist(), similarity) >= similarity:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    kind = StructType([StructField("a", texts.schema["id"].dataType), StructField("b", texts.schema["id"].dataType)])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, kind)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of each id in ``edges`` (a, b) but the roots: root is the least id of its component.

    Large-star and small-star steps in turn, until every component is a star around its least id;
    each round is cut by a checkpoint, and no component is ever in one place.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
        if ends.filter("up > 1 or (up = 1 and n > 1)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "u", "m")
        edges = checkpoint(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def bucket_members(distinct: DataFrame) -> DataFrame:
    """(no, key, id, n, leader) of each text in a bucket of two or more; ``leader`` has its least id."""
    entries = distinct.select("id", F.posexplode("keys").alias("no", "key")).withColumn("no", F.least("no", F.lit(SKETCHES)))
    sizes = entries.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).filter("n > 1")
    return entries.join(sizes, ["no", "key"])


def with_root(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` and ``name``: the root of ``column``, or itself where it has no edge."""
    return rows.join(roots.select(F.col("id").alias("_id"), F.col("root").alias("_root")), F.col(column) == F.col("_id"), "left").withColumn(name, F.coalesce("_root", column)).drop("_id", "_root")


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): all of a small bucket, and each text of a larger one with its leader."""
    small, large = members.filter(F.col("n") <= SMALL), members.filter((F.col("n") > SMALL) & (F.col("id") != F.col("leader")))
    other = small.select("no", "key", F.col("id").alias("other"))
    pairs = small.join(other, ["no", "key"]).filter("id < other").select(*_pair(F.col("id"), F.col("other")))
    return pairs.unionByName(large.select(*_pair(F.col("id"), F.col("leader")))).distinct()


def groups_of(distinct: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(id, root) of the texts of ``distinct`` (id, keys) that are alike; ``docs`` is (id, text).

    The first few sketches are taken first; of the pairs of all others only those that are not in
    one group by then are verified, as no other can change a group.
    """
    members = checkpoint(bucket_members(distinct))
    texts = checkpoint(docs.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
    edges = checkpoint(verify(candidates(members.filter(F.col("no") < FIRST)), texts, similarity))
    roots = components(edges)

    def widened(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        apart = with_root(with_root(pairs, roots, "a", "root_a"), roots, "b", "root_b").filter("root_a <> root_b").select("a", "b")
        more = checkpoint(edges.unionByName(verify(apart, texts, similarity)))
        return more, components(more)

    edges, roots = widened(candidates(members.filter(F.col("no") >= FIRST)))
    large = with_root(members.filter(F.col("n") > SMALL).select("no", "key", "id", "leader"), roots, "id", "root")
    open_ = checkpoint(with_root(large, roots, "leader", "led").filter("root <> led"))
    if open_.isEmpty():
        return roots
    return components(edges.unionByName(block_edges(open_, large, texts, similarity)))


def block_edges(open_: DataFrame, large: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified pairs (a, b) of texts that are not in the group of their bucket's leader, against all of those buckets.

    Buckets that share such texts are taken together. The open texts are the query set; they and
    the members are dealt into blocks of about ``BLOCK``, and a task takes one block of each. So
    no row stands for a pair, a task holds two blocks at most, and nothing is left out.
    """
    heads = open_.groupBy("no", "key").agg(F.min("id").alias("head"))
    roots = components(open_.join(heads, ["no", "key"]).filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    comps = checkpoint(with_root(heads, roots, "head", "comp").select("no", "key", "comp"))
    queries = open_.join(comps, ["no", "key"]).select("comp", "id", "root").distinct()
    against = large.join(comps, ["no", "key"]).select("comp", "id", "root").distinct()
    blocks = lambda df, name: df.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = checkpoint(blocks(queries, "nq").join(blocks(against, "nm"), "comp"))
    deal = lambda df, own, other, i, j, side: (
        df.join(sizes, "comp").withColumn(i, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select("comp", "i", "j", "id", "root", F.lit(side).alias("side"))
    )
    dealt = deal(queries, "nq", "nm", "i", "j", 0).unionByName(deal(against, "nm", "nq", "j", "i", 1)).join(texts, "id")

    def alike(block):
        import pandas as pd

        runs = [word_hashes(words(t)) for t in block["text"]]
        marked = [labelled(r) if len(r) else r for r in runs]
        ids, roots_, side = block["id"].tolist(), block["root"].tolist(), block["side"].to_numpy()
        q, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        shared = intersections([marked[k] for k in q], [marked[k] for k in m])
        sizes_q, sizes_m = np.array([len(marked[k]) for k in q]), np.array([len(marked[k]) for k in m])
        # No alignment has more matches than the words that both hold.
        bound = shared >= similarity * (sizes_q[:, None] + sizes_m[None, :] - shared) - 1e-6
        out = []
        for x, y in zip(*np.nonzero(bound)):
            a, b = q[x], m[y]
            if roots_[a] != roots_[b] and aligned(runs[a].tolist(), runs[b].tolist(), similarity) >= similarity:
                out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pd.DataFrame(out, columns=["a", "b"])

    kind = texts.schema["id"].dataType.simpleString()
    return checkpoint(dealt.groupBy("comp", "i", "j").applyInPandas(alike, f"a {kind}, b {kind}"))


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Number of labelled words that each of ``left`` shares with each of ``right``: products of
    0/1 matrices, ``width`` words at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    _, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(r) for r in (*left, *right)])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [start, start + width])
        some = np.zeros((len(left) + len(right), width), np.float32)
        some[owner[a:b], place[a:b] - start] = 1
        out += some[: len(left)] @ some[len(left) :].T
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, group_id, kept) of each distinct (id, text): ``group_id`` is the least id of the group.

    ``kept`` is true for one document of each group, the one with the least id. Texts without a
    word (null, empty, blank) are alike to none: each is a group of its own. Rows with the same id
    and the same words are one document. Ids stand for documents: of several texts under one id
    the greatest is aligned. A row with a null id is a group of its own. Other columns are
    ignored; an empty table gives an empty table.
    """
    sketched = checkpoint(sketch_table(docs, id_col, text_col, similarity).dropDuplicates(["id", "hash"]))
    wordy = sketched.filter(F.col("id").isNotNull() & (F.size("keys") > 0))
    distinct = checkpoint(wordy.groupBy("hash").agg(F.min(F.struct("id", "keys")).alias("r")).select("hash", "r.id", "r.keys"))
    roots = groups_of(distinct.select("id", "keys"), docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), similarity)
    groups = with_root(distinct.select("hash", "id"), roots, "id", "group_id").select("hash", "group_id")
    alone = F.col("id").isNull() | (F.size("keys") == 0)
    known = sketched.select("id", "hash", alone.alias("alone")).join(groups, "hash", "left")
    group = F.when(F.col("alone"), F.col("id")).otherwise(F.col("group_id"))
    return known.select(F.col("id").alias(id_col), group.alias("group_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group; rows with a null id stay.

    Rows of one id and one text are one row; of several texts under an id that stays, all stay.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, similarity=similarity).filter("kept").select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
