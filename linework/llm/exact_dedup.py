"""Exact duplicates of whole texts over a cuckoo-filter index.

The index holds every live text once, by the SHA-256 and length of what is left of it without white
space, and how many copies are live. It is dealt into shards by the first bits of the digest. Each shard has a
cuckoo filter (buckets of four 16-bit fingerprints) and its stored keys, bucketed by the filter's
home bucket. A lookup asks the filter first: a miss is certain; a hit is compared with the keys
stored in that bucket, so a fingerprint shared by two texts never joins them. Insertions and deletions
change filter and keys together; where an insertion finds no place, the filter is doubled and filled
again from the stored keys.

Copies meet twice: within each task over its own rows, so that a text with very many copies leaves each
task as one row, and then in the shard of its digest. Whole texts never leave the task that reads them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StructField, StructType

from .common import stored

#: Fingerprints in a bucket, moves before an insertion gives up, and buckets of a new filter.
SLOTS, MOVES, BUCKETS = 4, 200, 16
#: Keys that a task holds before it passes them on, and rows that a shard is made for.
HELD, SHARD = 50_000, 50_000
#: A text with more than one in so many of all rows is joined by broadcast; there are fewer of those than this.
HOT = 1000


@dataclass(slots=True)
class Key:
    digest: bytes
    length: int
    live: int
    chars: int
    id: object
    row: int


def _better(a: tuple, b: tuple) -> bool:
    """Whether (chars, id, row) ``a`` stays rather than ``b``: most code points, smallest id (null last), first row."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1]:
        return b[1] is None or (a[1] is not None and a[1] < b[1])
    return a[2] < b[2]


class Cuckoo:
    """The filter and the stored keys of one shard."""

    def __init__(self, buckets: int = BUCKETS):
        self.resized = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))
        self.content: dict[int, list[Key]] = {}

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[4:8], "big") & self.mask

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "big") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 40503 + 1)) & self.mask

    def _find(self, bucket: int, mark: int) -> int:
        at = SLOTS * bucket
        for k in range(at, at + SLOTS):
            if self.slots[k] == mark:
                return k
        return -1

    def get(self, digest: bytes, length: int) -> Key | None:
        """The live key, asked of the filter and compared with the content of its bucket."""
        home, mark = self._home(digest), self._print(digest)
        if self._find(home, mark) < 0 and self._find(self._other(home, mark), mark) < 0:
            return None
        return next((k for k in self.content.get(home, ()) if k.digest == digest and k.length == length), None)

    def _place(self, digest: bytes) -> bool:
        mark = self._print(digest)
        bucket = self._home(digest)
        for b in (bucket, self._other(bucket, mark)):
            if (free := self._find(b, 0)) >= 0:
                self.slots[free] = mark
                return True
        for move in range(MOVES):
            at = SLOTS * bucket + move % SLOTS
            self.slots[at], mark = mark, self.slots[at]
            bucket = self._other(bucket, mark)
            if (free := self._find(bucket, 0)) >= 0:
                self.slots[free] = mark
                return True
        return False

    def _grow(self) -> None:
        keys = list(self.keys())
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resized += 1
            self._empty(buckets)
            for key in keys:
                self.content.setdefault(self._home(key.digest), []).append(key)
            if all(self._place(key.digest) for key in keys):
                return

    def insert(self, key: Key) -> None:
        """Add the key's copies to those that are live."""
        known = self.get(key.digest, key.length)
        if known is None:
            self.content.setdefault(self._home(key.digest), []).append(key)
            if not self._place(key.digest):
                self._grow()
            return
        known.live += key.live
        if _better((key.chars, key.id, key.row), (known.chars, known.id, known.row)):
            known.chars, known.id, known.row = key.chars, key.id, key.row

    def delete(self, digest: bytes, length: int, copies: int = 1) -> bool:
        """Take copies away, the key with the last of them; false if the text is not live."""
        known = self.get(digest, length)
        if known is None:
            return False
        known.live -= copies
        if known.live <= 0:
            home, mark = self._home(digest), self._print(digest)
            at = self._find(home, mark)
            self.slots[at if at >= 0 else self._find(self._other(home, mark), mark)] = 0
            self.content[home].remove(known)
        return True

    def keys(self) -> Iterator[Key]:
        return (key for bucket in self.content.values() for key in bucket)

    @classmethod
    def load(cls, slots: bytes | None, keys: list[Key]) -> Cuckoo:
        """From stored keys, and the filter that was stored with them where there is one."""
        own = cls(len(slots) // (2 * SLOTS) if slots else BUCKETS)
        if slots:
            own.slots = array("H", slots)
        for key in keys:
            own.content.setdefault(own._home(key.digest), []).append(key)
        if not slots and not all(own._place(key.digest) for key in keys):
            own._grow()
        return own


def _fields(kind: DataType) -> list[StructField]:
    names = (("digest", BinaryType()), ("length", LongType()), ("live", LongType()), ("chars", LongType()), ("id", kind), ("row", LongType()))
    return [StructField(name, t) for name, t in names]


def index_schema(kind: DataType) -> StructType:
    """One row a key, and one row a shard with its filter (``slots``) and no key; ``depth`` is the number of bits that name a shard."""
    return StructType([StructField("shard", IntegerType()), *_fields(kind), StructField("slots", BinaryType()), StructField("depth", IntegerType())])


def _columns(keys: list[Key], like: pa.Schema) -> list[pa.Array]:
    return [pa.array([getattr(k, c) for k in keys], like.field(c).type) for c in ("digest", "length", "live", "chars", "id", "row")]


def _read(table: pa.Table | pa.RecordBatch) -> list[Key]:
    columns = (table.column(c).to_pylist() for c in ("digest", "length", "live", "chars", "id", "row"))
    return [Key(*values) for values in zip(*columns, strict=True)]


def text_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, chars, length, digest) of each row: a number of its own, the code points of the text, and
    bytes and SHA-256 of the text without white space. A null text counts as empty."""
    kind = docs.schema[id_col].dataType
    out = StructType([StructField("row", LongType()), StructField("id", kind), StructField("chars", LongType()), StructField("length", LongType()), StructField("digest", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, lengths, digests = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                left = b"".join(text.encode().split())  # bytes split at ASCII white space only
                chars.append(len(text))
                lengths.append(len(left))
                digests.append(hashlib.sha256(left).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chars, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary())], out.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, out)


def combined(keys: DataFrame) -> DataFrame:
    """One row for each text and task (of at most 50,000 texts at a time): its copies and the best of them."""
    out = StructType(_fields(keys.schema["id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = Cuckoo(), 0
        for batch in batches:
            like = batch.schema
            for key in _read(batch):
                before = own.get(key.digest, key.length)
                own.insert(key)
                held += before is None
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays(_columns(list(own.keys()), like), out.names)
                    own, held = Cuckoo(), 0
        if held:
            yield pa.RecordBatch.from_arrays(_columns(list(own.keys()), like), out.names)

    return keys.withColumn("live", F.lit(1).cast("long")).select(*out.names).mapInArrow(run, out)


def _shard(digest: Column, depth: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long").bitwiseAND((1 << depth) - 1).cast("int")


def depth_for(rows: int, spark) -> int:
    """Bits of the digest that deal out shards: each for some 50,000 rows, and as many as shuffle partitions."""
    return min(24, (max(rows // SHARD + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length())


def updated(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None, *, depth: int) -> DataFrame:
    """The index after a batch of ``combined`` insertions and then deletions.

    ``keep_*`` of a text (chars, id, row) are those of the best row inserted since it became live.
    Deletions of texts that are not live change nothing. With another ``depth`` than the index was
    made with the filters are filled again from the stored keys. To keep an index, write the result
    and read it for the next batch.
    """
    kind = inserts.schema["id"].dataType
    schema = index_schema(kind)
    spark = inserts.sparkSession
    old = spark.createDataFrame([], schema) if index is None else index
    old = old.filter(F.col("slots").isNull() | (F.col("depth") == depth)).withColumn("shard", F.coalesce(_shard(F.col("digest"), depth), F.col("shard")))
    changes = inserts.withColumn("sign", F.lit(1))
    if deletes is not None:
        changes = changes.unionByName(deletes.withColumn("sign", F.lit(-1)))
    changes = changes.withColumn("shard", _shard(F.col("digest"), depth))

    def merge(before: pa.Table, batch: pa.Table) -> pa.Table:
        filters = [x for x in before.column("slots").to_pylist() if x is not None]
        own = Cuckoo.load(filters[0] if filters else None, [k for k in _read(before) if k.digest is not None])
        signs = batch.column("sign").to_pylist()
        rows = _read(batch)
        for key, sign in zip(rows, signs, strict=True):
            if sign > 0:
                own.insert(key)
        for key, sign in zip(rows, signs, strict=True):
            if sign < 0:
                own.delete(key.digest, key.length, key.live)
        shard = (before if before.num_rows else batch).column("shard")[0].as_py()
        keys = list(own.keys())
        rest = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in _columns(keys, before.schema)]
        slots = pa.array([None] * len(keys) + [own.slots.tobytes()], pa.binary())
        every = lambda v: pa.array([v] * (len(keys) + 1), pa.int32())
        return pa.Table.from_arrays([every(shard), *rest, slots, every(depth)], schema.names)

    return old.select(*schema.names).groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(merge, schema)


def live_keys(index: DataFrame) -> DataFrame:
    return index.filter("slots is null").drop("slots", "shard", "depth")


def probe(index: DataFrame, keys: DataFrame, *, depth: int) -> DataFrame:
    """``keys`` of ``combined`` with ``known``: whether the text is live in an index of this ``depth``. The filter answers first, then the stored keys."""
    schema = StructType([*keys.schema.fields, StructField("known", IntegerType())])
    asked = keys.withColumn("shard", _shard(F.col("digest"), depth))

    def ask(before: pa.Table, batch: pa.Table) -> pa.Table:
        filters = [x for x in before.column("slots").to_pylist() if x is not None]
        own = Cuckoo.load(filters[0] if filters else None, [k for k in _read(before) if k.digest is not None])
        known = [int(own.get(d, n) is not None) for d, n in zip(batch.column("digest").to_pylist(), batch.column("length").to_pylist(), strict=True)]
        return batch.drop_columns("shard").append_column("known", pa.array(known, pa.int32()))

    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(ask, schema).withColumn("known", F.col("known") == 1)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row, dropped ones too.

    Texts are equal when they are without ASCII white space. Of equal texts the one with most code
    points in the original stays, then the smallest id (null last), then the first row, so that
    one row of each group is kept even where rows repeat. Null, empty and blank texts are one group.
    Other columns are ignored; an empty table gives an empty one.

    Digests are written once to the shared folder; texts are read once and never shuffled. Rows of
    texts with more than a thousandth of all rows meet their group by broadcast (fewer than 1,000
    groups, whatever the table), the others by a join on the digest.
    """
    keys = stored(text_keys(docs, id_col=id_col, text_col=text_col))
    total = keys.count()
    index = updated(None, combined(keys), depth=depth_for(total, docs.sparkSession))
    groups = stored(live_keys(index).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("_keep"), F.col("live").alias("group_size")))
    hot, rest = F.col("group_size") * HOT > total, F.col("group_size") * HOT <= total
    rows = keys.select("row", "id", "digest")
    few = groups.filter(hot)
    met = rows.join(F.broadcast(few), "digest").unionByName(rows.join(F.broadcast(few.select("digest")), "digest", "left_anti").join(groups.filter(rest), "digest"))
    return met.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("_keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
